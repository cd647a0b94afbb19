"""Whole-text tokenization with the tokenizers library behind a word cache.

Both public vocabularies used here split a text into pre-tokens before they merge, and a pre-token never spans the
boundary before a single space (byte-level) or any space (word-level). So a text can be encoded piece by piece with the
same ids, and a piece that has been seen before costs one dictionary look-up. A text with white space other than single
spaces and line ends between words is given to the byte-level tokenizer whole, and so is a text with the string of an
added token, which the library reads as that token.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa

from .common import tokenizer_path
from .words import buffers

CACHE = 700_000
#: A full stop or comma that may be part of a longer run of signs; else it is a pre-token of its own.
_JOINED = re.compile(r"[.,](?:(?<![^\W_][.,])|(?=[^\w\s\0]|_))")
_LOADED: dict[str, Encoder] = {}


def _byte_letters() -> list[str]:
    """The visible character by which byte-level vocabularies write each byte."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(rest)) for b in range(256)]


class Encoder:
    """encode(text) gives a text's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, name: str, cache: int | None = None) -> None:
        self.most = cache or CACHE
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        path = tokenizer_path(name)
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        self.mode = "whole"
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm:
            self.mode = "spaced"
        elif pre.get("type") == "Sequence" and pre["pretokenizers"][0].get("behavior") == "Removed" and "\\s" in str(norm):
            self.mode = "words"
        added = spec.get("added_tokens") or []
        self.added = [t["content"] for t in added]  # the library reads their strings in a text as one token each
        if any(t.get("normalized") for t in added):
            self.mode = "whole"
        self.added_bytes = [t.encode() for t in self.added]
        self.begins = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        self.begins[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith("\u0120")]] = True
        self.cache: dict[str, bytes] = {}
        byte = _byte_letters()
        self.letters = {ord(" "): "\u0120"} | {c: "".join(byte[b] for b in chr(c).encode()) for c in range(128, 0x250) if chr(c).isalpha()}

    def _ids(self, piece: str) -> bytes:
        word = piece[1:] if piece[0] == " " and self.mode == "spaced" else piece
        if word.isalpha() and max(word) < "\u0250" and (self.mode == "spaced" or self.mode == "words" and word == word.lower()):
            # letters alone are one pre-token in normal form: the library's merge step is all that is left to do
            return array("I", [t.id for t in self.tokenizer.model.tokenize(piece.translate(self.letters))]).tobytes()
        return array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()

    def _piece(self, w: str) -> bytes:
        got = self._ids(w) if w else b""
        if len(self.cache) < self.most:
            self.cache[w] = got
        return got

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.mode == "whole" or any(t in text for t in self.added):
            return self._ids(text)
        if self.mode == "words":
            if "\0" in text or "\u0130" in text:  # lower-casing the latter leaves a combining mark, which joins a sign that follows
                return self._ids(text)
            if "\u03a3" not in text:  # its lower case depends on what stands around it
                text = text.lower()
            text = text.replace("\n", " ").replace(" ", "\0")
        else:
            words = text.split() if self.mode == "spaced" and "\0" not in text else []
            if len(words) + sum(map(len, words)) - 1 != len(text) or text.count(" ") + text.count("\n") != len(words) - 1:
                return self._ids(text)  # white space that isn't one space or line end between words
            text = text.replace(" ", "\0 ").replace("\n", "\0\n\0")
        if not _JOINED.search(text):
            text = text.replace(".", "\0.").replace(",", "\0,")
        pieces = text.split("\0")
        got = list(map(self.cache.get, pieces))
        try:
            return b"".join(got)
        except TypeError:
            return b"".join([self._piece(w) if x is None else x for x, w in zip(got, pieces, strict=True)])


    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where those of each text begin and the last ones end.

        Texts of plain white space (single spaces and line ends between words) are cut by byte positions and each different piece is
        encoded once; other texts go through encode().
        """
        data, offs = buffers(texts)
        plain, signs = self._plain(data, offs) if self.mode == "spaced" else (np.zeros(len(texts), bool), np.zeros(0, np.int64))
        for k in np.flatnonzero(plain):
            if any(t in (whole := data[offs[k] : offs[k + 1]].tobytes()) for t in self.added_bytes) or b"\0" in whole:
                plain[k] = False
        end = data == 10
        at = end | (data == 32)
        at[1:] |= end[:-1]
        at[signs] = True
        at[offs[:-1][offs[:-1] < len(data)]] = True
        cuts = np.flatnonzero(at)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(np.append(cuts, len(data)).astype(np.int64)), pa.py_buffer(data)])
        of = np.searchsorted(offs, cuts, "right") - 1
        used = plain[of]
        pieces, of = (pieces, of) if used.all() else (pieces.filter(pa.array(used)), of[used])
        coded = pieces.dictionary_encode()
        each = self._pieces(coded.dictionary.cast(pa.large_string()).to_pylist())
        sizes = np.fromiter(map(len, each), np.int64, len(each)) // 4
        flat = np.frombuffer(b"".join(each), "<u4")
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        n = sizes[codes]
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[codes] - (np.cumsum(n) - n), n) + np.arange(n.sum())] if len(n) else flat
        counts = np.bincount(of, n, len(texts)).astype(np.int64)
        if plain.all():
            return ids, np.append(0, np.cumsum(counts))
        mine, out, k = np.append(0, np.cumsum(counts)), [], 0
        for j in np.flatnonzero(~plain):
            whole = np.frombuffer(self.encode(data[offs[j] : offs[j + 1]].tobytes().decode()), "<u4")
            out += [ids[mine[k] : mine[j]], whole]
            counts[j], k = len(whole), j
        return np.concatenate([*out, ids[mine[k] :]]), np.append(0, np.cumsum(counts))

    def _pieces(self, words: list[str]) -> list[bytes]:
        """The ids of pieces; those not seen before that begin with their only space are encoded in one text, where each begins a token anew."""
        got = list(map(self.cache.get, words))
        new = [k for k, x in enumerate(got) if x is None]
        spaced = [k for k in new if words[k][0] == " " and words[k].isprintable()]
        for lo in range(0, len(spaced), 20_000):
            some = spaced[lo : lo + 20_000]
            ids = np.array(self.tokenizer.encode("".join([words[k] for k in some]), add_special_tokens=False).ids, "<u4")
            starts = np.flatnonzero(self.begins[ids])
            if len(starts) == len(some):
                raw, ends = ids.tobytes(), (4 * np.append(starts, len(ids))).tolist()
                for j, k in enumerate(some):
                    got[k] = raw[ends[j] : ends[j + 1]]
                    if len(self.cache) < self.most:
                        self.cache[words[k]] = got[k]
        return [self._piece(w) if x is None else x for x, w in zip(got, words, strict=True)]

    def _plain(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which texts have no white space but single spaces and line ends between words; the full stops and commas that stand alone after a letter or digit."""
        n = len(offs) - 1
        kind = _KINDS[data]
        latin = np.flatnonzero(data[:-1] == 0xC3) + 1
        kind[latin[(data[latin] != 0x97) & (data[latin] != 0xB7)]] = _ALNUM  # all of this block are letters but the two signs of arithmetic
        gap = kind == _GAP
        odd = kind == _OTHER
        before, after = np.empty_like(kind), np.empty_like(kind)  # of the byte before and after; texts begin and end with a gap
        before[1:], after[:-1] = kind[:-1], kind[1:]
        full = offs[:-1] < offs[1:]
        before[offs[:-1][full]], after[offs[1:][full] - 1] = _GAP, _GAP
        odd |= gap & ((before == _GAP) | (after == _GAP))
        lead = np.flatnonzero(kind == _LEAD)
        if len(lead):
            b = [np.append(data, [0, 0])[lead + j].astype(np.int64) for j in (0, 1, 2)]
            odd[lead] |= np.isin(b[0] << 8 | b[1], _SPACES_OF_TWO) | np.isin(b[0] << 16 | b[1] << 8 | b[2], _SPACES_OF_THREE)
        out = np.ones(n, bool)
        out[np.searchsorted(offs, np.flatnonzero(odd), "right") - 1] = False
        sign = np.flatnonzero((data == 46) | (data == 44))
        return out, sign[(before[sign] == _ALNUM) & ((after[sign] == _ALNUM) | (after[sign] == _GAP))]


#: Classes of bytes for _plain: letters and digits, the two plain gaps, other white space, first bytes of characters some of which are white space.
_SIGN, _ALNUM, _GAP, _OTHER, _LEAD = 0, 1, 2, 3, 4
_KINDS = np.zeros(256, np.uint8)
_KINDS[[c for c in range(128) if chr(c).isalnum()]] = _ALNUM
_KINDS[[c for c in range(128) if chr(c).isspace()]] = _OTHER
_KINDS[[10, 32]] = _GAP
_SPACE_BYTES = [chr(c).encode() for c in range(128, 0x3100) if chr(c).isspace()]
_KINDS[sorted({b[0] for b in _SPACE_BYTES})] = _LEAD
_SPACES_OF_TWO = [int.from_bytes(b, "big") for b in _SPACE_BYTES if len(b) == 2]
_SPACES_OF_THREE = [int.from_bytes(b, "big") for b in _SPACE_BYTES if len(b) == 3]


def encoder(name: str, cache: int | None = None) -> Encoder:
    """One encoder for each Python worker and vocabulary, that remembers the ids of up to so many words."""
    if name not in _LOADED:
        _LOADED[name] = Encoder(name, cache)
    return _LOADED[name]
