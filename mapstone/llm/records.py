"""Token ids as length-delimited binary records, with a separate offset index for shuffled reads.

A record file is a sequence of frames: the payload's length (unsigned 64-bit little-endian), the masked checksum of
those eight bytes, the payload, the masked checksum of the payload (both unsigned 32-bit). The checksum is CRC-32; it
is masked by a rotation right of 15 bits plus a constant, so that a checksum stored among data doesn't check itself. A payload is one
byte of flags (1: the identifier is null; 2: ids have two bytes, else four), the identifier (signed 64-bit) and the
ids. The index file beside it has a fixed 28-byte entry for each record: identifier, offset, number of ids, flags.
With both, any record can be read by one seek.

Documents are range-partitioned by identifier, so file numbers and places within them follow ascending identifiers.
Every attempt at a task writes a pair of files under a name of its own, and the manifest, a JSON table beside them, names
the pairs of the attempts that ended. A task that runs again after the loss of an executor neither moves nor
replaces a file; what a lost attempt left is in no manifest.

Defined results: a null text counts as empty and yields the end id alone; null identifiers come first; repeated
identifiers give a record each; an empty table gives no file and an empty result.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, shared_dir, ship
from .tokens import encoder
from .words import gathered

MASK_DELTA = 0xA282EAD8  # the constant of the well-known masked-checksum record framing
HEAD, ENTRY = "<QI", "<qqqI"
NULL_ID, TWO_BYTES = 1, 2
CACHE = 300_000  # words, of one task
MANIFEST = "part long, file string, records long, ids long"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return size + struct.pack("<I", masked(size)) + payload + struct.pack("<I", masked(payload))


def payload(doc_id: int | None, ids: np.ndarray, wide: bool) -> bytes:
    flags = (NULL_ID if doc_id is None else 0) | (0 if wide else TWO_BYTES)
    return struct.pack("<Bq", flags, doc_id or 0) + ids.astype("<u4" if wide else "<u2").tobytes()


def parse(data: bytes) -> tuple[int | None, np.ndarray]:
    flags, doc_id = struct.unpack_from("<Bq", data)
    return None if flags & NULL_ID else doc_id, np.frombuffer(data, "<u2" if flags & TWO_BYTES else "<u4", offset=9).astype("<u4")


def read_frame(f) -> bytes | None:
    """The next payload of an open file, checked; None at its end."""
    head = f.read(struct.calcsize(HEAD))
    if not head:
        return None
    if len(head) < struct.calcsize(HEAD):
        raise ValueError("a record is cut off")
    size, check = struct.unpack(HEAD, head)
    if masked(head[:8]) != check:
        raise ValueError("a record's length is damaged")
    data, tail = f.read(size), f.read(4)
    if len(data) < size or len(tail) < 4:
        raise ValueError("a record is cut off")
    if masked(data) != struct.unpack("<I", tail)[0]:
        raise ValueError("a record's payload is damaged")
    return data


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_records(docs: DataFrame, out: str, tokenizer: str, end_id: int, text: str = "text", doc_id: str = "doc_id") -> list[dict]:
    """Write record and index files under out; the manifest: file, first place, records and ids of each file."""
    spark = docs.sparkSession
    ship(spark)
    if out.startswith("file:/") and not out.startswith("file://"):
        out = "file://" + out[5:]

    def run(batches):
        from pyspark import TaskContext

        enc = encoder(tokenizer, CACHE)
        wide = max(enc.tokenizer.get_vocab_size(with_added_tokens=True) - 1, end_id) > 0xFFFF
        end, k, n, total, at = np.array([end_id], "<u4"), TaskContext.get().partitionId(), 0, 0, 0
        filesystem, top = _fs(out)
        filesystem.create_dir(top, recursive=True)
        name = f"{top}/part-{k:06d}-{uuid.uuid4().hex}"
        data = index = None
        for t in gathered(batches):
            all_ids, offs = enc.encode_batch(t.column("body").combine_chunks())
            for j, i in enumerate(t.column("id").to_pylist()):
                if data is None:
                    data, index = filesystem.open_output_stream(name + ".rec"), filesystem.open_output_stream(name + ".idx")
                ids = np.concatenate([all_ids[offs[j] : offs[j + 1]], end])
                got = frame(payload(i, ids, wide))
                data.write(got)
                index.write(struct.pack(ENTRY, i or 0, at, len(ids), NULL_ID if i is None else 0))
                n, total, at = n + 1, total + len(ids), at + len(got)
        if data is not None:
            data.close()
            index.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([k]), "file": pa.array([name]), "records": pa.array([n]), "ids": pa.array([total])})

    dealt = (
        docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("body"))
        .repartitionByRange(max(partitions(spark), 1), "id")
        .sortWithinPartitions("id")
    )
    got = dealt.mapInArrow(run, MANIFEST).collect()  # a row for each file
    manifest = sorted((r.asDict() for r in got), key=lambda r: r["part"])
    spark.createDataFrame([tuple(r.values()) for r in manifest], MANIFEST).coalesce(1).write.mode("overwrite").json(f"{out}/manifest")
    return manifest


def read_manifest(spark: SparkSession, out: str) -> list[dict]:
    """The manifest of records written earlier."""
    return [r.asDict() for r in spark.read.schema(MANIFEST).json(f"{out}/manifest").orderBy("part").collect()]


def read_records(spark: SparkSession, manifest: list[dict], out: str, with_ids: bool = False) -> DataFrame:
    """doc_id, part, start_in_part, n_tokens, ids_crc32 (and ids), a row for each record, read from the files in order."""
    ship(spark)
    columns = "doc_id long, part long, start_in_part long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def run(batches):
        filesystem, _ = _fs(out if "://" in out or out.startswith("/") else "file://" + out[5:])
        for b in batches:
            for part, name in zip(b.column("part").to_pylist(), b.column("file").to_pylist(), strict=True):
                rows, start = [], 0
                with filesystem.open_input_stream(name + ".rec") as f:
                    while (data := read_frame(f)) is not None:
                        i, ids = parse(data)
                        rows.append((i, part, start, len(ids), zlib.crc32(ids.tobytes()), *([ids.tolist()] if with_ids else [])))
                        start += len(ids)
                        if len(rows) >= 2000:
                            yield _batch(rows, with_ids)
                            rows = []
                if rows:
                    yield _batch(rows, with_ids)

    files = spark.createDataFrame([(r["part"], r["file"]) for r in manifest], "part long, file string")
    return files.repartition(max(1, len(manifest))).mapInArrow(run, columns)


def _batch(rows: list[tuple], with_ids: bool):
    names = ["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    kinds = [pa.int64()] * 5 + ([pa.list_(pa.int64())] if with_ids else [])
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def read_at(file: str, k: int) -> tuple[int | None, np.ndarray]:
    """The k-th record of a file (its path without suffix), by one look at the index and one seek."""
    filesystem, path = _fs(file)
    with filesystem.open_input_file(path + ".idx") as f:
        f.seek(k * struct.calcsize(ENTRY))
        _, at, _, _ = struct.unpack(ENTRY, f.read(struct.calcsize(ENTRY)))
    with filesystem.open_input_file(path + ".rec") as f:
        f.seek(at)
        return parse(read_frame(f))


def tokens_to_records(
    docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, out: str | None = None, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """Encode, write, and read back: doc_id, start, n_tokens, ids_crc32 of every document in ascending doc_id order."""
    spark = docs.sparkSession
    out = out or f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
    manifest = write_records(docs, out, tokenizer, end_id, text, doc_id)
    back = read_records(spark, manifest, out)
    sizes = spark.createDataFrame([(r["part"], r["ids"]) for r in manifest], "part long, ids long")  # a row for each file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    return back.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")
