"""A trigram language model in Elias-Fano tries.

Training counts all words, pairs and triples of the training texts. Estimates are interpolated by absolute discounting down to the unigram estimate (c + 0.5) / (N + 0.5 (V + 1)), so each
context's probabilities sum to one up to quantisation.

The training data are gathered as triples alone: each word that follows another comes with the word behind it (or none,
behind the end of a text), so that sums of triples are the counts of pairs too. Triples are summed in their task and sent
sorted, as planes of bytes.

The model is a set of files in the shared folder, memory-mapped by the tasks that score, and deleted when all
scores are written. Words are known by the rank of their 64-bit hash. A shard of the trie holds the contexts (words) that have pairs in it, monotone pointers to
their successors, the successors' ids made monotone by adding the context's rank times V, the same again for
triples below each pair, and 16-bit probabilities and back-off weights. All sequences are Elias-Fano coded. A lookup
finds the context's range and searches the successor relative to it. Shards are dealt by a hash of the pair, so a
word before a third of all words is spread over all of them.

Defined results: a null or empty text is its end token alone; rows with a null doc_id are training rows; words
unseen in training have count 0; without training rows every base probability is one; repeated rows are counted
and scored each; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriate.llm.common import arrow_map, buckets_for, by_bucket, bytes_of, dropped, mapped, mixed, new_path, saved, squeezed, steps, stored, sums_by, text_slices, unsqueezed, word_hashes

DISCOUNT = 0.7
#: Shards of the words and of the trie, at least; the first bits of a hash name one.
SHARD_BITS = 6
#: Bytes of text to a shard of words.
WORD_BYTES = 1 << 25
#: Training tokens of a shard of the trie, at most; more tokens make more shards.
SHARD_TOKENS = 2_000_000
#: Words, and triples, that a task sums before it sends them.
GATHERED, GRAMS = 4_000_000, 2_500_000
#: Bytes of text whose tokens are looked up at once, and words that a worker remembers.
SLICE_BYTES, REMEMBERED = 6_000_000, 1 << 19
SCALE = 4096
END = np.uint64(xxhash.xxh64_intdigest(b"\n"))  # no word holds a line break
_RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


# ---- Elias-Fano sequences -------------------------------------------------------------------------------


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """Values of width bits each, in 64-bit words (one spare at the end)."""
    n = len(values)
    out = np.zeros(n * width // 64 + 2, np.uint64)
    if width and n:
        at = np.arange(n, dtype=np.uint64) * np.uint64(width)
        word, off = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        np.bitwise_or.at(out, word, values << off)
        over = off + np.uint64(width) > np.uint64(64)
        np.bitwise_or.at(out, word[over] + 1, values[over] >> (np.uint64(64) - off[over]))
    return out


def _unpacked(words: np.ndarray, width: int, i: np.ndarray) -> np.ndarray:
    if not width:
        return np.zeros(len(i), np.uint64)
    at = i.astype(np.uint64) * np.uint64(width)
    word, off = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    high = np.where(off == 0, np.uint64(0), words[word + 1] << ((np.uint64(64) - off) & np.uint64(63)))
    return ((words[word] >> off) | high) & np.uint64((1 << width) - 1)


_ONES = np.uint64(0x0101010101010101)
_TOPS = np.uint64(0x8080808080808080)
#: Place of the r-th set bit of each byte, at byte * 8 + r.
_IN_BYTE = np.array([([i for i in range(8) if x >> i & 1] + [0] * 8)[:8] for x in range(256)], np.int64).ravel()


def _nth(words: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Place of the r-th set bit (from 0) in each 64-bit word."""
    x = words - ((words >> np.uint64(1)) & np.uint64(0x5555555555555555))
    x = (x & np.uint64(0x3333333333333333)) + ((x >> np.uint64(2)) & np.uint64(0x3333333333333333))
    upto = ((x + (x >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * _ONES  # bits set up to each byte
    r = r.astype(np.uint64)
    # bytes that end before the bit
    shift = np.bitwise_count(((r * _ONES | _TOPS) - upto) & _TOPS).astype(np.uint64) << np.uint64(3)
    before = ((upto << np.uint64(8)) >> shift) & np.uint64(255)
    at = (((words >> shift) & np.uint64(255)) << np.uint64(3)) + (r - before)
    return shift.astype(np.int64) + _IN_BYTE[at.astype(np.int64)]


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and the place of each x among them."""
    o = np.argsort(x)
    x = x[o]
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    back = np.empty(len(x), np.int64)
    back[o] = np.cumsum(new) - 1
    return x[new], back


class EliasFano:
    """A sorted sequence: low bits as they are, high bits in unary, with counts of ones before each word."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ones, self.zeros = n, low_bits, low, high, ones, zeros

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (top // max(1, n)).bit_length() - 1)
        v = values.astype(np.uint64)
        up = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(((top >> low_bits) + n + 2 + 63) // 64 * 64, np.uint8)
        bits[up] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(high).astype(np.int64)
        ones = np.r_[0, np.cumsum(counts)[:-1]]
        zeros = np.arange(len(high)) * 64 - ones
        return cls(n, low_bits, _packed(v & np.uint64((1 << low_bits) - 1), low_bits), high, ones.astype(np.uint32), zeros.astype(np.uint32))

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits], np.int64), self.low, self.high, self.ones, self.zeros]

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero bit."""
        w = np.searchsorted(self.zeros, k, "right") - 1
        return w * 64 + _nth(~self.high[w], k - self.zeros[w])

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        w = np.searchsorted(self.ones, i, "right") - 1
        up = w * 64 + _nth(self.high[w], i - self.ones[w]) - i
        return (up.astype(np.uint64) << np.uint64(self.low_bits)) | _unpacked(self.low, self.low_bits, i)

    def find(self, x: np.ndarray) -> np.ndarray:
        """The place of each x, or -1."""
        u, back = _distinct(x)
        return self.found(u)[back]

    def found(self, x: np.ndarray) -> np.ndarray:
        """The place of each of the sorted x, or -1: values with its high bits are searched by their low ones."""
        out = np.full(len(x), -1, np.int64)
        if not self.n or not len(x):
            return out
        x = x[: np.searchsorted(x, self[np.array([self.n - 1])][0], "right")].astype(np.uint64)
        h = (x >> np.uint64(self.low_bits)).astype(np.int64)
        own = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][: len(h)])
        top = h[own]
        ends = self._zero(np.r_[top, np.maximum(top - 1, 0)])
        hi, lo = ends[: len(top)] - top, np.where(top == 0, 0, ends[len(top) :] - np.maximum(top - 1, 0))
        times = np.diff(np.r_[own, len(h)])
        hi, lo = np.repeat(hi, times), np.repeat(lo, times)
        want, end = x & np.uint64((1 << self.low_bits) - 1), hi.copy()
        left = np.flatnonzero(lo < hi)
        while len(left):
            mid = (lo[left] + hi[left]) >> 1
            less = _unpacked(self.low, self.low_bits, mid) < want[left]
            lo[left[less]], hi[left[~less]] = mid[less] + 1, mid[~less]
            left = left[lo[left] < hi[left]]
        some = np.flatnonzero(lo < end)
        some = some[_unpacked(self.low, self.low_bits, lo[some]) == want[some]]
        out[some] = lo[some]
        return out


# ---- values ---------------------------------------------------------------------------------------------


def _sequence(arrays: list[np.ndarray]) -> EliasFano:
    n, low_bits = arrays[0].tolist()
    return EliasFano(n, low_bits, *arrays[1:5])


def _coded(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(p) * SCALE), 0, 65535).astype(np.uint16)


def _weights(w: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Coded back-off weights: 0 where nothing follows, at least 1 elsewhere."""
    return np.where(follows, np.maximum(_coded(np.maximum(w, 1e-15)), 1), 0).astype(np.uint16)


_POWERS = 10.0 ** (-np.arange(65536) / SCALE)


class _Memory:
    """Words that a worker looked up last: each hash has one slot, which the latest takes."""

    def __init__(self):
        self.keys, self.ids = np.zeros(REMEMBERED, np.uint64), np.zeros(REMEMBERED, np.int64)
        self.counts, self.weights = np.zeros(REMEMBERED, np.int64), np.zeros(REMEMBERED, np.uint16)


_MEMORY: dict[tuple[str, int], _Memory] = {}


class Model:
    """Lookups in the mapped files. bases: ids before each shard of words; have, weighed: shards of the trie and of weights that exist."""

    def __init__(self, folder: str, bases: list[int], tokens: int, have: list[int], weighed: list[int], shard_bits: int):
        self.folder, self.bases, self.tokens, self.have = folder, np.array(bases, np.int64), tokens, frozenset(have)
        self.weighed, self.shard_bits = frozenset(weighed), shard_bits
        self.word_bits = (len(bases) - 1).bit_length() - 1
        self.size = int(self.bases[-1])
        # one more value stands for no word
        self.id_type = np.uint32 if self.size < (1 << 32) - 1 else np.uint64

    def words(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Id (or -1), count and coded back-off weight of each hash."""
        name = (self.folder, len(self.weighed))
        if name not in _MEMORY:
            _MEMORY.clear()
            _MEMORY[name] = _Memory()
        m, slot = _MEMORY[name], (h & np.uint64(REMEMBERED - 1)).astype(np.int64)
        new = np.flatnonzero((m.keys[slot] != h) | (h == 0))
        out = m.ids[slot], m.counts[slot], m.weights[slot]
        if len(new):
            u, back = np.unique(h[new], return_inverse=True)
            found = self._found(u)
            for x, y in zip(out, found, strict=True):
                x[new] = y[back]
            slot = (u & np.uint64(REMEMBERED - 1)).astype(np.int64)
            slot, first = np.unique(slot, return_index=True)
            for x, y in zip((m.keys, m.ids, m.counts, m.weights), (u, *found), strict=True):
                x[slot] = y[first]
        return out

    def _found(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, counts, weights = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64), np.zeros(len(h), np.uint16)
        shard = shard_of(h, self.word_bits)
        for s, rows in _by_shard(shard, None):
            if self.bases[s + 1] == self.bases[s]:
                continue
            a = mapped(f"{self.folder}/words-{s}")
            at = _sequence(a).find(_rest(h[rows], self.word_bits))
            rows, at = rows[at >= 0], at[at >= 0]
            ids[rows], counts[rows] = at + self.bases[s], a[6][a[5][at]]
            if s in self.weighed:
                weights[rows] = mapped(f"{self.folder}/weights-{s}")[0][at]
        return ids, counts, weights

    def bucket_of(self, ids: np.ndarray) -> np.ndarray:
        """The shard of words that holds each id."""
        return np.searchsorted(self.bases, ids, "right") - 1

    def counts(self, ids: np.ndarray) -> np.ndarray:
        out, bucket = np.zeros(len(ids), np.int64), self.bucket_of(ids)
        for s in np.unique(bucket).tolist():
            a, rows = mapped(f"{self.folder}/words-{s}"), np.flatnonzero(bucket == s)
            out[rows] = a[6][a[5][ids[rows].astype(np.int64) - self.bases[s]]]
        return out

    def pairs(self, shard: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Place of each pair of ids in its shard, or -1."""
        out = np.full(len(x), -1, np.int64)
        for s, rows in _by_shard(shard, self.have):
            a = mapped(f"{self.folder}/trie-{s}")
            ctx, succ = _sequence(a[0:5]), _sequence(a[10:15])
            j = ctx.find(x[rows].astype(np.uint64))
            rows, j = rows[j >= 0], j[j >= 0]
            # the successor's value relative to its context; it can only lie in the context's own range
            out[rows] = succ.find(j.astype(np.uint64) * np.uint64(self.size) + y[rows].astype(np.uint64))
        return out

    def pair_values(self, shard: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Coded probability, coded back-off weight, and whether any triple follows."""
        p, w, more = np.zeros(len(at), np.uint16), np.zeros(len(at), np.uint16), np.zeros(len(at), bool)
        for s, rows in _by_shard(shard, self.have):
            a, i = mapped(f"{self.folder}/trie-{s}"), at[rows]
            p[rows], w[rows] = a[15][i], a[16][i]
            more[rows] = w[rows] > 0
        return p, w, more

    def triples(self, shard: np.ndarray, pair: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Probability of each word after a pair, zero if not in the trie."""
        out, size = np.zeros(len(pair)), np.uint64(self.size)
        for s, rows in _by_shard(shard, self.have):
            a = mapped(f"{self.folder}/trie-{s}")
            pointers, succ = _sequence(a[17:22]), _sequence(a[22:27])
            u, back = _distinct(pair[rows].astype(np.uint64) * size + z[rows].astype(np.uint64))
            p = np.zeros(len(u))
            context = (u // size).astype(np.int64)
            first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]][: len(context)])
            bounds = pointers[np.r_[context[first], context[first] + 1]].astype(np.int64)
            some = np.repeat(bounds[len(first) :] > bounds[: len(first)], np.diff(np.r_[first, len(context)]))
            at = succ.found(u[some])
            hit = np.flatnonzero(some)[at >= 0]
            p[hit] = _POWERS[a[27][at[at >= 0]]]
            out[rows] = p[back]
        return out


def _by_shard(shard: np.ndarray, have: frozenset[int] | None) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard (of those in have) and the places of its rows."""
    if not len(shard):
        return
    o = np.argsort(shard.astype(np.uint16) if shard.max() < 65536 else shard, kind="stable")
    own = shard[o]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    for s, lo, hi in zip(own[first].tolist(), first, np.r_[first[1:], len(o)], strict=True):
        if have is None or s in have:
            yield s, o[lo:hi]


# ---- training -------------------------------------------------------------------------------------------


def shard_of(h: np.ndarray, bits: int = SHARD_BITS) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def pair_keys(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A 64-bit key of each pair of ids."""
    return mixed(x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + y.astype(np.uint64))


def _rest(h: np.ndarray, bits: int) -> np.ndarray:
    return h & np.uint64((1 << (64 - bits)) - 1)


def hashed(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slices of texts: hashes of all tokens (END behind each text), and each text's number of tokens."""
    for i, j in text_slices(texts, SLICE_BYTES):
        words, n = word_hashes([t.lower() for t in texts[i:j]])
        h, ends = np.empty(len(words) + len(n), np.uint64), np.cumsum(n + 1) - 1
        inner = np.ones(len(h), bool)
        inner[ends] = False
        h[inner], h[ends] = words, END
        yield h, n + 1


def _inner(h: np.ndarray) -> np.ndarray:
    """Places of tokens that have one before them in their text."""
    return np.flatnonzero(h[:-1] != END) + 1


def _gather(bits: int):
    """Words with counts, summed for each task, as blobs by shard."""

    def flush(words, n):
        shard = shard_of(words, bits)
        st = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
        blobs = [squeezed([steps(words[i:j]), n[i:j].astype(np.uint32)]) for i, j in zip(st, np.r_[st[1:], len(words)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(shard[st].astype(np.int32)), pa.array(blobs, pa.binary())], ["bucket", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n, held, size = np.empty(0, np.uint64), np.empty(0, np.int64), [], 0
        for b in batches:
            for h, _ in hashed(bytes_of(b["text"])):
                held.append(h)
                size += len(h)
                if size > GATHERED:
                    u, c = np.unique(np.concatenate(held), return_counts=True)
                    words, n = sums_by(np.r_[words, u], np.r_[n, c])
                    held, size = [], 0
                    if len(words) > GATHERED:
                        yield from flush(words, n)
                        words, n = words[:0], n[:0]
        if held:
            u, c = np.unique(np.concatenate(held), return_counts=True)
            words, n = sums_by(np.r_[words, u], np.r_[n, c])
        if len(words):
            yield from flush(words, n)

    return run


def _word_file(folder: str, bits: int):
    """Writes shards of words: hashes and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, blobs in by_bucket(batches, "words"):
            parts = [unsqueezed(x, [np.uint64, np.uint32]) for x in blobs]
            h, n = sums_by(np.concatenate([np.cumsum(x) for x, _ in parts]), np.concatenate([y for _, y in parts]).astype(np.int64))
            values, codes = np.unique(n, return_inverse=True)
            kind = np.uint16 if len(values) < 65536 else np.uint32
            saved(f"{folder}/words-{bucket}", [*EliasFano.of(_rest(h, bits)).arrays(), codes.astype(kind), values])
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([len(h)], pa.int64()), pa.array([int(n.sum())], pa.int64())], ["bucket", "size", "total"])

    return run


def _summed(x: np.ndarray, y: np.ndarray, z: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct triples, and the sum of n of each."""
    if x.dtype == np.uint32:
        pair = (x.astype(np.uint64) << np.uint64(32)) | y
        o = np.argsort(z)
        o = o[np.argsort(pair[o], kind="stable")]
    else:
        o = np.lexsort((z, y, x))
    x, y, z, n = x[o], y[o], z[o], n[o]
    st = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (z[1:] != z[:-1])])
    return x[st], y[st], z[st], np.add.reduceat(n, st)


def _grams(model: Model):
    """All triples of ids, summed for each task, as blobs by the shard of their first two."""

    def flush(held):
        x, y, z = (np.concatenate(c) for c in zip(*held, strict=True))
        x, y, z, n = _summed(x, y, z, np.ones(len(x), np.uint32))
        shards, blobs = [], []
        for s, rows in _by_shard(shard_of(pair_keys(x, y), model.shard_bits), None):
            shards.append(s)
            blobs.append(squeezed([steps(x[rows]), y[rows], z[rows], n[rows].astype(np.uint32)]))
        yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "grams"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for h, _ in hashed(bytes_of(b["text"])):
                ids, at = model.words(h)[0].astype(model.id_type), _inner(h)
                behind = np.r_[ids[1:], ids[:1]]
                behind[h == END] = model.size  # nothing follows the end
                held.append((ids[at - 1], ids[at], behind[at]))
                size += len(at)
                if size > GRAMS:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)

    return run


def _trie_file(model: Model):
    """Sums triples and pairs, writes their shard of the trie, and gives the number of each context's successors by the context's shard of words."""

    def write(bucket: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        kind = model.id_type
        parts = [unsqueezed(b, [kind, kind, kind, np.uint32]) for b in blobs]
        x, y, z, n = _summed(np.concatenate([np.cumsum(p[0], dtype=kind) for p in parts]), *(np.concatenate([p[i] for p in parts]) for i in (1, 2)), np.concatenate([p[3] for p in parts]).astype(np.int64))
        new = np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]
        at = np.flatnonzero(new)
        c, some = np.add.reduceat(n, at), z != kind(model.size)
        place, z, c3 = (np.cumsum(new) - 1)[some], z[some].astype(np.uint64), n[some]
        x, y = x[at], y[at]
        st = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
        size, ends = np.uint64(model.size), np.r_[st[1:], len(x)]
        rank = np.repeat(np.arange(len(st)), ends - st)
        below = np.bincount(place, minlength=len(x))
        arrays = [*EliasFano.of(x[st].astype(np.uint64)).arrays(), *EliasFano.of(np.r_[st, len(x)].astype(np.uint64)).arrays(), *EliasFano.of(rank.astype(np.uint64) * size + y.astype(np.uint64)).arrays()]
        # every pair but those at the end of a text has its count in triples, so the discounts are what they leave
        arrays += [_coded((c - DISCOUNT) / model.counts(x[st])[rank]), _weights(DISCOUNT * below / c, below > 0)]
        arrays += [*EliasFano.of(np.r_[0, np.cumsum(below)].astype(np.uint64)).arrays(), *EliasFano.of(place.astype(np.uint64) * size + z).arrays(), _coded((c3 - DISCOUNT) / c[place])]
        saved(f"{model.folder}/trie-{bucket}", arrays)
        context, home, out = x[st].astype(np.int64), model.bucket_of(x[st]), [[], []]
        for s, rows in _by_shard(home, None):
            out[0].append(s)
            out[1].append(squeezed([steps((context[rows] - model.bases[s]).astype(np.uint64)), (ends - st)[rows].astype(np.uint64)]))
        yield pa.RecordBatch.from_arrays([pa.array([bucket] * len(out[0]), pa.int32()), pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary())], ["shard", "bucket", "followers"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, blobs in by_bucket(batches, "grams"):
            yield from write(bucket, blobs)

    return run


def _weight_file(model: Model):
    """Writes shards of the words' back-off weights: what the discounts of their successors leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, blobs in by_bucket(batches, "followers"):
            n = np.zeros(int(model.bases[bucket + 1] - model.bases[bucket]), np.int64)
            for blob in blobs:
                at, more = unsqueezed(blob, [np.uint64, np.uint64])
                n[np.cumsum(at).astype(np.int64)] += more.astype(np.int64)  # a shard of the trie names each context once
            counts = model.counts(np.arange(len(n)) + model.bases[bucket])
            saved(f"{model.folder}/weights-{bucket}", [_weights(DISCOUNT * n / counts, n > 0)])
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32())], ["bucket"])

    return run


def train(docs: DataFrame) -> Model:
    """Counts all texts of docs and writes the model's files."""
    folder = new_path(docs.sparkSession, "lm")
    texts = docs.select(F.col("text").cast("string").alias("text"))
    bits = buckets_for(texts, WORD_BYTES, 1 << SHARD_BITS).bit_length() - 1
    words = arrow_map(texts, _gather(bits), "bucket int, words binary").repartition("bucket")
    sizes = {r["bucket"]: r for r in arrow_map(words, _word_file(folder, bits), "bucket int, size long, total long").collect()}
    bases = np.r_[0, np.cumsum([sizes[i]["size"] if i in sizes else 0 for i in range(1 << bits)])].tolist()
    tokens = sum(r["total"] for r in sizes.values())
    shard_bits = max(SHARD_BITS, (tokens // SHARD_TOKENS).bit_length())
    model = Model(folder, bases, tokens, [], [], shard_bits)
    # one shard of the trie for each task
    grams = arrow_map(texts, _grams(model), "bucket int, grams binary").repartitionById(1 << shard_bits, F.col("bucket"))
    made = stored(arrow_map(grams, _trie_file(model), "shard int, bucket int, followers binary"), "lm-trie", f"{folder}/followers")
    have = [r["shard"] for r in made.select("shard").distinct().collect()]
    weighed = [r["bucket"] for r in arrow_map(made.select("bucket", "followers").repartition("bucket"), _weight_file(model), "bucket int").collect()]
    return Model(folder, bases, tokens, have, weighed, shard_bits)


# ---- scoring --------------------------------------------------------------------------------------------


def probabilities(model: Model, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token: whether it is known, its unigram estimate, and the model's probability."""
    ids, counts, weights = model.words(h)
    base = (counts + 0.5) / (model.tokens + 0.5 * (model.size + 1))
    p = base.copy()
    # pairs: only behind words that have successors in the trie
    i = _inner(h)
    p[i] = base[i] * _POWERS[weights[i - 1]]
    i = i[(weights[i - 1] > 0) & (ids[i] >= 0)]
    shard = np.zeros(len(h), np.int64)
    shard[i] = shard_of(pair_keys(ids[i - 1], ids[i]), model.shard_bits)
    place = np.full(len(h), -1, np.int64)
    place[i] = model.pairs(shard[i], ids[i - 1], ids[i])
    i = np.flatnonzero(place >= 0)
    value, weight, more = model.pair_values(shard[i], place[i])
    p[i] += _POWERS[value]
    # triples: behind pairs that have successors
    follow = np.zeros(len(h), bool)
    weight3 = np.zeros(len(h), np.uint16)
    follow[i], weight3[i] = more, weight
    j = _inner(h)
    j = j[follow[j - 1]]
    p[j] *= _POWERS[weight3[j - 1]]
    k = j[ids[j] >= 0]
    p[k] += model.triples(shard[k - 1], place[k - 1], ids[k])
    return ids >= 0, base, p


def _scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list[np.ndarray]] = [[], [], [], []]
            for h, sizes in hashed(bytes_of(b["text"])):
                known, base, p = probabilities(model, h)
                st = np.r_[0, np.cumsum(sizes)[:-1]]
                for c, v in zip(cols, (sizes, np.add.reduceat(known.astype(np.int64), st), np.add.reduceat(np.log10(base), st), np.add.reduceat(np.log10(p), st)), strict=True):
                    c.append(v)
            n, known, base, score = (np.concatenate(c) if c else np.empty(0) for c in cols)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(np.full(len(n), model.tokens, np.int64)), pa.array(base.astype(float)), pa.array(score.astype(float))], [c.split()[0] for c in _RESULT.split(", ")])

    return run


def score(docs: DataFrame) -> DataFrame:
    """Scores of every row by a model of the rows that are not held out."""
    held = F.crc32(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).cast("binary")) % 5 == 1
    model = train(docs.where(~held))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    out = stored(arrow_map(rows, _scores(model), _RESULT), "lm-scores")
    dropped(docs.sparkSession, model.folder)
    return out
