"""Vector bin packing of training examples: tokens, segments and loss-bearing tokens are limited at once.

An example is a text whose tokens all bear loss, or a list of parts some of which (prompts) don't. Each task takes its
examples in pools, as they are read, and fills one sequence after another: of the examples that fit whole it places the
one whose demand has the largest dot product with the room left, both as shares of the limits and weighted by what
the pool demands of each. When none fits whole, the best one is cut where the first limit is reached. So nothing is
shuffled, a task holds one pool, and of each sequence only its parts' ids until it is full.

Where cuts are allowed a sequence that can't be filled (too many segments, or too much loss) ends at a power of two, which
isn't padded, and what is beyond goes back to the pool; so does the last sequence of a task, which is divided into powers
of two. Where they aren't, only examples beyond a limit are cut, and sequences may stay short.

Defined results: a null text counts as empty and packs its end id; null identifiers and repeated rows are packed like any
other; an empty table gives an empty result; an empty list of parts counts as an empty text; other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, materialize, ship
from .tokens import encoder
from .words import gathered

CACHE = 300_000  # words, of one task
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


@dataclass
class Limits:
    tokens: int = 2048
    segments: int = 64
    loss: int = 2048


class Example:
    """What is left of an example: ids from `start` to the end; bears[k] counts the loss-bearing ids before k."""

    __slots__ = ("doc_id", "ids", "bears", "start", "stop", "whole")

    def __init__(self, doc_id, ids, bears, start, stop, whole) -> None:
        self.doc_id, self.ids, self.bears, self.start, self.stop, self.whole = doc_id, ids, bears, start, stop, whole

    @property
    def tokens(self) -> int:
        return self.stop - self.start

    @property
    def loss(self) -> int:
        return self.tokens if self.bears is None else int(self.bears[self.stop] - self.bears[self.start])

    def reach(self, tokens: int, loss: int) -> int:
        """How many ids fit into so much room."""
        if self.bears is None:
            return min(self.tokens, tokens, loss)
        most = int(np.searchsorted(self.bears[self.start : self.stop + 1], self.bears[self.start] + loss, "right")) - 1
        return min(self.tokens, tokens, most)

    def part(self, n: int) -> tuple[Example, Example | None]:
        at = self.start + n
        cut = lambda a, b: Example(self.doc_id, self.ids, self.bears, a, b, self.whole)
        return cut(self.start, at), cut(at, self.stop) if at < self.stop else None


class Packer:
    """Packs the examples of one task; out gets a row for each piece."""

    def __init__(self, limits: Limits, cut: bool, first_sequence: int) -> None:
        self.limits, self.cut, self.sequence, self.out = limits, cut, first_sequence, []
        self.open: list[Example] = []

    def close(self, pieces: list[Example]) -> None:
        at = 0
        for x in pieces:
            raw = np.ascontiguousarray(x.ids[x.start : x.stop], "<u4").data
            self.out.append((x.doc_id, x.start, x.tokens, zlib.crc32(raw), x.whole, self.sequence, at, x.loss))
            at += x.tokens
        self.sequence += 1

    def room(self) -> tuple[int, int, int]:
        return (
            self.limits.tokens - sum(x.tokens for x in self.open), self.limits.segments - len(self.open), self.limits.loss - sum(x.loss for x in self.open)
        )

    def shorten(self) -> list[Example]:
        """Close the open sequence at a power of two; what is beyond it."""
        keep, back, left = 1 << (sum(x.tokens for x in self.open).bit_length() - 1), [], []
        for x in self.open:
            n = min(x.tokens, keep)
            keep -= n
            if n:
                head, x = x.part(n)
                left.append(head)
            if x is not None:
                back.append(x)
        self.close(left)
        self.open = []
        return back

    def pack(self, examples: list[Example]) -> None:
        """All examples but those of the sequence that is still open."""
        lim, pool = self.limits, []
        for x in examples:  # what no sequence can hold is cut first
            while x is not None and (x.tokens > lim.tokens or x.loss > lim.loss):
                head, x = x.part(max(1, x.reach(lim.tokens, lim.loss)))
                if head.tokens == lim.tokens:
                    self.close([head])
                else:
                    pool.append(head)
            if x is not None:
                pool.append(x)
        tokens, loss = np.array([x.tokens for x in pool], np.int64), np.array([x.loss for x in pool], np.int64)
        left = len(pool)
        while left:
            rt, rs, rl = self.room()
            want = tokens.sum() / lim.tokens * rt / lim.tokens**2, loss.sum() / lim.loss * rl / lim.loss**2, left / lim.segments * rs / lim.segments**2
            best = -1
            if rs > 0:
                fits = (tokens > 0) & (tokens <= rt) & (loss <= rl)
                score = np.where(fits, want[0] * tokens + want[1] * loss + want[2], -1.0)
                best = int(score.argmax())
                best = best if score[best] >= 0 else -1
            if best >= 0:
                self.open.append(pool[best])
                pool[best], tokens[best], loss[best] = None, 0, 0
                left -= 1
            elif self.cut and rt > 0 and rs > 0 and (k := self._cuttable(pool, tokens, loss, rt, rl, want)) is not None:
                head, rest = pool[k].part(pool[k].reach(rt, rl))
                self.open.append(head)
                pool[k], tokens[k], loss[k] = rest, rest.tokens, rest.loss
            elif rt > 0 and self.cut:
                for x in self.shorten():
                    pool.append(x)
                    tokens, loss, left = np.append(tokens, x.tokens), np.append(loss, x.loss), left + 1
            else:
                self.close(self.open)
                self.open = []
            if left < len(pool) // 2:
                live = np.flatnonzero(tokens)
                pool, tokens, loss = [pool[j] for j in live.tolist()], tokens[live], loss[live]
        for x in self.open:  # the ids of a pool go; an open sequence keeps its own
            x.ids = x.ids.copy()

    def _cuttable(self, pool, tokens, loss, rt, rl, want) -> int | None:
        """The example to cut: the largest dot product of what the room can take of it, the longest of equals."""
        score = want[0] * np.minimum(tokens, rt) + want[1] * np.minimum(loss, rl)
        for k in np.lexsort((-tokens, -score))[:8].tolist():
            if pool[k] is not None and 0 < pool[k].reach(rt, rl) < pool[k].tokens:
                return k
        return None

    def finish(self) -> None:
        while self.open and self.cut and sum(x.tokens for x in self.open) != self.limits.tokens:
            self.open = self.shorten()
        if self.open:
            self.close(self.open)
        self.open = []


def _examples(t: pa.Table, enc, end_id: int) -> list[Example]:
    """The examples of a table: id, and body or parts (text, loss)."""
    ids_of = t.column("id").to_pylist()
    if "parts" in t.column_names:
        parts = t.column("parts").combine_chunks()
        counts = pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = parts.flatten()
        ids, offs = enc.encode_batch(flat.field("text"))
        bears = np.repeat(pc.fill_null(flat.field("loss"), True).to_numpy(zero_copy_only=False), np.diff(offs))
        offs = offs[np.append(0, np.cumsum(counts))]
    else:
        (ids, offs), bears = enc.encode_batch(t.column("body").combine_chunks()), None
    out = []
    for k, doc in enumerate(ids_of):
        own = np.append(ids[offs[k] : offs[k + 1]], np.uint32(end_id))
        count = None if bears is None else np.append(0, np.cumsum(np.append(bears[offs[k] : offs[k + 1]], True)))
        out.append(Example(doc, own, count, 0, len(own), len(own)))
    return out


def pack_examples(
    examples: DataFrame, limits: Limits | None = None, cut: bool = True, tokenizer: str = "byte_bpe_50k.json", end_id: int = 1, text: str = "text", parts: str | None = None, doc_id: str = "doc_id"
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    Examples have a text, all of which bears loss, or parts: an array of structs (text, loss).
    """
    ship(examples.sparkSession)
    limits = limits or Limits()
    if min(limits.tokens, limits.segments, limits.loss) < 1:
        raise ValueError(f"limits must be positive: {limits}")

    def run(batches):
        from pyspark import TaskContext

        packer, enc = Packer(limits, cut, TaskContext.get().partitionId() << 36), encoder(tokenizer, CACHE)
        for t in gathered(batches, size):
            packer.pack(_examples(t, enc, end_id))
            yield from _rows(packer)
        packer.finish()
        yield from _rows(packer)

    if parts is None:
        own, size = examples.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("body")), "body"
    else:
        listed = F.col(parts).cast("array<struct<text:string,loss:boolean>>")
        listed = F.when(F.size(listed) > 0, listed).otherwise(F.array(F.struct(F.lit("").alias("text"), F.lit(True).alias("loss"))))
        own, size = examples.select(F.col(doc_id).cast("long").alias("id"), listed.alias("parts")).withColumn("body", F.expr("concat_ws('', parts.text)")), "body"
    return materialize(own.mapInArrow(lean(run), PIECE), "packed")


def _rows(packer: Packer):
    rows, packer.out = packer.out, []
    if rows:
        names = [x.split()[0] for x in PIECE.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)


def answers(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", speaker: str = "assistant") -> DataFrame:
    """Instruction examples: doc_id (conversation), turn, parts of each answer: the turn before it without loss, and itself with loss."""
    before = F.lag(F.col(text)).over(Window.partitionBy(conv_id).orderBy(turn, role, text))
    own = conversations.select(F.col(conv_id).alias("doc_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("answer"), before.alias("prompt"))
    part = lambda c, loss: F.struct(F.coalesce(F.col(c), F.lit("")).alias("text"), F.lit(loss).alias("loss"))
    return own.where(F.col("role") == speaker).select("doc_id", "turn", F.array(part("prompt", False), part("answer", True)).alias("parts"))
