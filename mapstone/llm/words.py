"""Words of whole Arrow batches, cut by byte classes in NumPy: no Python object is made for a word.

The separators of the contracts are ASCII, so UTF-8 bytes can be classed one by one; all bytes of other characters
belong to words. Only A-Z are lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD, SPACE, BREAK = 0, 1, 2
#: Bytes of text that are cut at once; longer texts are cut alone.
AT_ONCE = 8 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def classes(space: bytes = b"", breaks: bytes = b"") -> np.ndarray:
    """The class of each byte value."""
    out = np.zeros(256, np.uint8)
    out[list(space)], out[list(breaks)] = SPACE, BREAK
    return out


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of texts, and where each text begins and the last one ends; a null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return data, offs - offs[0]


@dataclass
class Cut:
    """codes: the number in `terms` of each word, in order. doc: the text that it stands in. fresh: a break precedes it."""

    codes: np.ndarray
    terms: pa.Array
    doc: np.ndarray
    fresh: np.ndarray


def cut(texts: pa.Array, kinds: np.ndarray) -> Cut:
    data, offs = buffers(texts)
    kind = kinds[data]
    word = kind == WORD
    first = word.copy()
    first[1:] &= ~word[:-1]
    tops = offs[:-1][offs[:-1] < len(data)]
    first[tops] = word[tops]
    starts = np.flatnonzero(first)
    doc = np.searchsorted(offs, starts, "right") - 1
    kind_of = np.int32 if len(data) < 1 << 31 else np.int64
    before = np.cumsum(word, dtype=kind_of)[starts] - 1
    ends = np.append(before, np.count_nonzero(word)).astype(np.int64)
    letters = _LOWER[data[word]]
    del first, before
    flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(letters)])
    coded = flat.dictionary_encode()
    broken = np.cumsum(kind == BREAK, dtype=kind_of)[starts]
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (broken[1:] != broken[:-1]) | (doc[1:] != doc[:-1])
    return Cut(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, doc, fresh)


def gathered(batches, text: str = "body", most: int = AT_ONCE) -> Iterator[pa.Table]:
    """Arrow batches, put together or split until a table holds some `most` bytes of text, or one longer text."""
    held, size = [], 0
    for b in batches:
        lengths = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False)
        at = 0
        for stop in (*np.flatnonzero(np.diff((size + np.cumsum(lengths)) // most, prepend=size // most)).tolist(), b.num_rows - 1):
            if stop < at:
                continue
            held.append(b.slice(at, stop + 1 - at))
            size += int(lengths[at : stop + 1].sum())
            at = stop + 1
            if size >= most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if any(x.num_rows for x in held):
        yield pa.Table.from_batches(held)
