"""Token ids of whole texts by a public tokenizer, with a bounded table of words.

Texts are cut where both kinds of vocabulary split them anyway: before a space or a line break between two visible
characters, and between a Latin letter and the punctuation behind it. Each piece is looked up by its 64-bit hash in a
table with two slots for each hash, all pieces of a batch at once, and the tokenizer is asked for the rest. A wrong
match needs 43 equal bits beside the slot's, so it comes about once in 10^13 lookups of pieces that the table lacks.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from seriate.llm.common import mixed, stretch_hashes

#: Slots of the table of pieces, and ids that it holds before it starts anew (29 and 32 MB).
SLOTS, POOL = 1 << 21, 1 << 24
#: Bytes of text that are cut at once.
SLICE = 1 << 20
#: White space as the tokenizers and Python have it, in UTF-8: one byte, or several.
_SPACES = np.zeros(256, bool)
_SPACES[[*range(9, 14), *range(28, 33)]] = True
_WIDE = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_LEADS = np.zeros(256, bool)
_LEADS[[w[0] for w in _WIDE]] = True
_WIDE_CODES = np.array(sorted(int.from_bytes(w.ljust(3, b"\0")) for w in _WIDE))
_FINAL = np.zeros(256, bool)
_FINAL[list(b".,;:!?)")] = True
_ASCII = np.zeros(256, bool)
_ASCII[[*range(65, 91), *range(97, 123)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Composed Latin letters: no rule splits a run of them.
_LETTERS_ONLY = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
BARE, SPACED, LINE = 0, 1, 2
_KINDS = mixed(np.arange(1, 4, dtype=np.uint64))


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write each byte as a visible character: itself, or the next one from U+0100 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()
_SPACE = _LETTERS[32]


def pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and kind of the pieces of texts that begin and end at these places and follow on one another.

    A piece behind a space or a line break doesn't hold it; its kind says so.
    """
    space = _SPACES[data]
    lead = np.flatnonzero(_LEADS[data])
    if len(lead):
        one, two, three = (np.append(data, [0, 0]).astype(np.int64)[lead + i] for i in range(3))
        for size, code in ((2, one << 16 | two << 8), (3, one << 16 | two << 8 | three)):
            wide = lead[(one == 0xC2) == (size == 2)]
            wide = wide[np.isin(code[(one == 0xC2) == (size == 2)], _WIDE_CODES)]
            for i in range(size):
                space[wide + i] = True
    cut = (data == 32) | (data == 10)
    cut[1:] &= ~space[:-1]
    cut[:-1] &= ~space[1:]
    letter = _ASCII[data]
    latin = (data >= 0x80) & (data != 0x97) & (data != 0xB7)
    letter[1:] |= (data[:-1] == 0xC3) & latin[1:]
    tail = _FINAL[data]
    tail[1:] &= letter[:-1]
    full = ends > starts
    edges = np.r_[starts[full], ends[full] - 1]
    cut[edges] = False
    tail[starts[full]] = False
    tail &= ~cut
    begins = np.zeros(len(data), bool)
    begins[starts[full]] = True
    at = np.flatnonzero(cut | tail | begins)
    gap = cut[at]
    kind = np.where(gap, np.where(data[at] == 10, LINE, SPACED), BARE)
    end = np.r_[at[1:], len(data)] if len(at) else at
    return at + gap, end, kind


class Encoder:
    """Ids of whole texts, as the tokenizer gives them, in 16 bits.

    special: whether the strings of special tokens stand for them wherever a text holds them, as in a plain call
    of the library; else they are ordinary text.
    """

    def __init__(self, path: str, special: bool = True):
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = not special
        if self.tok.get_vocab_size() > 65536:
            raise ValueError("ids don't fit 16 bits")
        self.model, self.lower = self.tok.model, self.tok.normalizer is not None
        self.line = self._asked("\n")
        self._clear()

    def _clear(self) -> None:
        self.keys, self.at, self.n = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint32), np.zeros(SLOTS, np.uint16)
        self.pool, self.used = np.empty(1 << 20, np.uint16), 0

    def _asked(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _pieces(self, texts: list[str], kinds: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, and their numbers: runs of letters go straight through the tokenizer's model."""
        tokenize, lower, line, ids, upto = self.model.tokenize, self.lower, self.line, [], []
        for text, kind in zip(texts, kinds, strict=True):
            if kind == LINE:
                ids += line
            if text.isascii() and text.isalpha():
                # the vocabulary in lower case drops white space; the other writes it as a letter
                ids += [t.id for t in tokenize(text.lower() if lower else _SPACE + text if kind == SPACED else text)]
            elif _LETTERS_ONLY.fullmatch(text):
                text = text.lower() if lower else " " + text if kind == SPACED else text
                ids += [t.id for t in tokenize(text.encode().decode("latin-1").translate(_LETTERS))]
            else:
                ids += self._asked(" " + text if kind == SPACED else text)
            upto.append(len(ids))
        return np.array(ids, np.uint16), np.diff(upto, prepend=0)

    def _found(self, data: np.ndarray, first: np.ndarray, end: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each piece lie in the pool, and how many."""
        plain = not self.lower or b"<|" in data.tobytes()  # special tokens are known by their case
        key = stretch_hashes(data if plain else _LOWER[data], first, end) ^ _KINDS[kind]
        slot = (key & np.uint64(SLOTS - 1)).astype(np.int64)
        other = np.flatnonzero(self.keys[slot] != key)
        slot[other] = (key[other] >> np.uint64(32)).astype(np.int64) & (SLOTS - 1)
        at, n = self.at[slot].astype(np.int64), self.n[slot].astype(np.int64)
        new = other[(self.keys[slot[other]] != key[other]) | (key[other] == 0)]
        if not len(new):
            return at, n
        u, one, back = np.unique(key[new], return_index=True, return_inverse=True)
        raw, one = data.tobytes(), new[one]
        ids, size = self._pieces([raw[s:e].decode() for s, e in zip(first[one].tolist(), end[one].tolist(), strict=True)], kind[one].tolist())
        upto = self.used + np.cumsum(size)
        if upto[-1] > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.empty(max(int(upto[-1]), 2 * len(self.pool)) - self.used, np.uint16)])
        self.pool[self.used : upto[-1]] = ids
        self.used = int(upto[-1])
        at[new], n[new] = (upto - size)[back], size[back]
        kept = size < 1 << 16
        u, start, size = u[kept], (upto - size)[kept], size[kept]
        slot = (u & np.uint64(SLOTS - 1)).astype(np.int64)
        slot = np.where(self.keys[slot] == 0, slot, (u >> np.uint64(32)).astype(np.int64) & (SLOTS - 1))
        slot, one = np.unique(slot, return_index=True)
        self.keys[slot], self.at[slot], self.n[slot] = u[one], start[one], size[one]
        return at, n

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty), one after another, each with end_id behind it if given; and their numbers."""
        texts = pc.cast(pc.fill_null(texts, ""), pa.large_string())
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        held = texts.buffers()[2] if len(texts) else None
        whole = np.frombuffer(held, np.uint8) if held is not None and held.size else np.empty(0, np.uint8)
        ids, counts, i = [], [], 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, "right")) - 1)
            if self.used > POOL:
                self._clear()
            starts, ends = offsets[i:j] - offsets[i], offsets[i + 1 : j + 1] - offsets[i]
            data = whole[offsets[i] : offsets[j]]
            first, end, kind = pieces(data, starts, ends)
            at, n = self._found(data, first, end, kind)
            bounds = np.searchsorted(first, ends)  # a piece belongs to the text that it begins in
            if end_id is not None:
                at, n = np.insert(at, bounds, -1), np.insert(n, bounds, 1)
                bounds = bounds + np.arange(1, len(bounds) + 1)
            out = np.cumsum(n, dtype=np.int64)
            total = int(out[-1]) if len(out) else 0
            from_ = np.repeat(at - (out - n), n) + np.arange(total)
            if end_id is not None:
                last = np.r_[0, out][bounds] - 1
                from_[last] = 0
            own = self.pool[from_] if total else np.empty(0, np.uint16)
            if end_id is not None:
                own[last] = end_id
            upto = np.r_[0, out][bounds]
            ids.append(own)
            counts.append(np.diff(np.r_[0, upto]))
            i = j
        return (np.concatenate(ids), np.concatenate(counts)) if ids else (np.empty(0, np.uint16), np.empty(0, np.int64))

    def ids(self, text: str) -> bytes:
        return self.encode(pa.array([text], pa.string()))[0].tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """A worker's encoder, kept between tasks (its table is bounded); another vocabulary takes its place."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def blobs(ids: np.ndarray, n: np.ndarray) -> pa.Array:
    """Ids of texts as one Arrow array of little-endian bytes."""
    offsets = np.r_[0, np.cumsum(2 * n)].astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids, "<u2"))]).cast(pa.binary())
