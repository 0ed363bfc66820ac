"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints are made once for each document and reduced to distinct values, so copies of a text cost one
entry. Two fingerprints that differ in at most 3 of 64 bits agree on one of four 16-bit blocks; each rotation
of the bits puts one block first and gives a forest of tries, one for each value of the leading block. A trie is
joined with itself: pairs of nodes descend together, bit by bit, the bits in which they differ are summed, and
a pair is left as soon as the sum exceeds the error budget. Within a task the links found are kept as a
union-find forest, so a group of m near copies leaves m - 1 links, not m * m. Components over all tasks come
from components.py.

Defined results: a null text has no words, and the fingerprint zero; rows with a null doc_id get a fingerprint
and a component but never name one (if all members are null, the component is null); repeated rows stay;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriate.llm.common import arrow_map, bytes_of, stored, with_hint
from seriate.llm.components import components

SHINGLE = 3
SEED = 42
BUDGET = 3
BLOCKS = 4  # more than BUDGET, so that two near fingerprints agree on one
#: A pair of nodes with so few pairs of fingerprints is compared outright.
LEAF = 64
#: Pairs of nodes that descend at once; the rest wait on a stack.
FRONTIER = 1 << 18
#: Fingerprints that share a leading block are dealt over several tasks above this number.
HOT = 1 << 15


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text's UTF-8 bytes."""
    words = text.lower().split()  # bytes: A-Z only, and the six characters of the contract
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    hashes = np.fromiter((h(s, SEED) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):  # a very long text in bounded memory
        ones += np.unpackbits(hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.array([fingerprint(t) for t in bytes_of(b.column("text"))], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("t"), pa.array(fp.view(np.int64))], ["doc_id", "t", "fp"])


class Forest:
    """Union-find over positions, in whole arrays; the smallest position is the root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while True:
            s = self.up[r]
            if (s == r).all():
                self.up[x] = r
                return r
            r = s

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))


def self_join(keys: np.ndarray, depth: int, budget: int, sides: np.ndarray | None = None) -> Forest:
    """Links between sorted distinct 64-bit keys that agree on the first depth bits and differ in budget bits at most.

    sides: if given, only keys of different sides are compared.
    """
    forest = Forest(len(keys))
    top = keys >> np.uint64(64 - depth)
    lo = np.flatnonzero(np.r_[True, top[1:] != top[:-1]]) if len(keys) else np.empty(0, np.int64)
    hi = np.r_[lo[1:], len(keys)].astype(np.int64)
    keep = hi - lo > 1
    lo, hi = lo[keep], hi[keep]
    stack = [(depth, lo, hi, lo, hi, np.zeros(len(lo), np.int64))]
    while stack:
        d, a0, a1, b0, b1, err = stack.pop()
        if len(a0) > FRONTIER:
            h = len(a0) // 2
            stack += [(d, *(x[:h] for x in (a0, a1, b0, b1, err))), (d, *(x[h:] for x in (a0, a1, b0, b1, err)))]
            continue
        small = ((a1 - a0) * (b1 - b0) <= LEAF) | (d >= 64)
        if small.any():
            _leaves(keys, forest, *(x[small] for x in (a0, a1, b0, b1)), budget, sides)
            a0, a1, b0, b1, err = (x[~small] for x in (a0, a1, b0, b1, err))
        if not len(a0):
            continue
        # a node's own bits are those of its first key; its middle is the first key with the next bit set
        mask, bit = ~np.uint64(0) << np.uint64(64 - d) if d else np.uint64(0), np.uint64(1) << np.uint64(63 - d)
        am = np.clip(np.searchsorted(keys, (keys[a0] & mask) | bit), a0, a1)
        bm = np.clip(np.searchsorted(keys, (keys[b0] & mask) | bit), b0, b1)
        same = a0 == b0
        low, high = (a0, am, b0, bm, err), (am, a1, bm, b1, err)
        cross, back = (a0, am, bm, b1, err + 1), (am[~same], a1[~same], b0[~same], bm[~same], err[~same] + 1)
        parts = [np.concatenate(x) for x in zip(low, high, cross, back, strict=True)]
        ok = (parts[1] > parts[0]) & (parts[3] > parts[2]) & (parts[4] <= budget)
        ok &= ~((parts[0] == parts[2]) & (parts[1] - parts[0] < 2))
        parts = [x[ok] for x in parts]
        if len(parts[0]):
            stack.append((d + 1, *parts))
    return forest


def _leaves(keys, forest, a0, a1, b0, b1, budget, sides) -> None:
    """Compares all keys of each pair of small nodes."""
    step = max(1, (1 << 21) // LEAF)
    for s in range(0, len(a0), step):
        x0, nx, y0, ny = a0[s : s + step], (a1 - a0)[s : s + step], b0[s : s + step], (b1 - b0)[s : s + step]
        n = nx * ny
        at = np.repeat(np.arange(len(n)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        i, j = x0[at] + k // ny[at], y0[at] + k % ny[at]
        near = (i != j) & (np.bitwise_count(keys[i] ^ keys[j]) <= budget)
        if sides is not None:
            near &= sides[i] != sides[j]
        forest.link(i[near], j[near])


def _rotated(x: np.ndarray, r: int) -> np.ndarray:
    s = np.uint64(16 * r)
    return x if not r else (x << s) | (x >> (np.uint64(64) - s))


def _join_tries(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b["r"].to_numpy(), b["cell"].to_numpy(), b["fp"].to_numpy()) for b in batches]
        if not got:
            return
        r, cell, fp = (np.concatenate(x) for x in zip(*got, strict=True))
        for k in range(BLOCKS):
            for hot in (False, True):
                chosen = (r == k) & ((cell >= 0) == hot)
                for c in np.unique(cell[chosen]) if hot else [-1]:
                    own = np.unique(_rotated(fp[chosen & (cell == c)].view(np.uint64), k))
                    forest = self_join(own, 16, budget)
                    root = forest.roots(np.arange(len(own)))
                    moved = np.flatnonzero(root != np.arange(len(own)))
                    plain = _rotated(own, (BLOCKS - k) % BLOCKS).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(plain[moved]), pa.array(plain[root[moved]])], ["u", "v"])

    return run


def links(fps: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Links (u, v) that connect all distinct fingerprints (column fp, long) at budget or fewer differing bits.

    A leading block shared by more than HOT fingerprints is cut by four further 12-bit slices of the bits behind
    it: near fingerprints agree on one of the slices, so the tasks (slice, value) together hold every pair. A task that
    would still hold more is cut once more, by four 9-bit pieces of the other three slices.
    """
    rotations = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.shiftrightunsigned(F.expr(f"shiftleft(fp, {16 * r}) | shiftrightunsigned(fp, {64 - 16 * r})") if r else F.col("fp"), 48).alias("head")) for r in range(BLOCKS)]))
    rows = fps.select("fp", rotations.alias("x")).select("fp", "x.r", "x.head")
    rows = stored(rows, "simhash-rows")
    hot = stored(rows.groupBy("r", "head").count().where(F.col("count") > HOT).select("r", "head", F.lit(True).alias("hot")), "simhash-hot")
    rows = rows.withColumn("cell", F.lit(-1)) if hot.isEmpty() else _cells(rows, hot)
    return arrow_map(rows.select("r", "head", "cell", "fp").repartition("r", "head", "cell"), _join_tries(budget), "u long, v long")


def _cells(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """rows (r, head, fp), those of hot blocks once for each of their cells."""
    rows = rows.join(hot, ["r", "head"], "left")
    # bits behind the leading block, as the rotation has them
    spun = F.expr("CASE r WHEN 0 THEN fp WHEN 1 THEN shiftleft(fp, 16) | shiftrightunsigned(fp, 48) WHEN 2 THEN shiftleft(fp, 32) | shiftrightunsigned(fp, 32) ELSE shiftleft(fp, 48) | shiftrightunsigned(fp, 16) END")
    part = [F.shiftrightunsigned(spun, 48 - 12 * (s + 1)).bitwiseAND(F.lit(4095)) for s in range(4)]
    cells = F.array(*[(F.lit(s * 4096) + part[s]).cast("int") for s in range(4)])
    rows = rows.withColumn("cell", F.explode(F.when(F.col("hot"), cells).otherwise(F.array(F.lit(-1)))))
    again = rows.where("cell >= 0").groupBy("r", "head", "cell").count().where(F.col("count") > HOT).select("r", "head", "cell", F.lit(True).alias("still"))
    rows = rows.join(again, ["r", "head", "cell"], "left")
    other = [[part[i] for i in range(4) if i != s] for s in range(4)]
    rest = F.coalesce(*[F.when(F.floor(F.col("cell") / 4096) == s, F.shiftleft(o[0], 24) + F.shiftleft(o[1], 12) + o[2]) for s, o in enumerate(other)])
    finer = F.array(*[(F.lit(4 * 4096 + j * 512) + F.col("cell") * 2048 + F.shiftright(rest, 9 * j).bitwiseAND(F.lit(511))).cast("int") for j in range(4)])
    return rows.withColumn("cell", F.explode(F.when(F.col("still"), finer).otherwise(F.array("cell"))))


def near_duplicates(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """doc_id, t (a hash of the text), fp (long), component_id of every document, and root, a fingerprint that names its group."""
    text = F.col("text").cast("string")
    fps = stored(arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text")), _fingerprints, "doc_id long, t long, fp long"), "simhash-fps")
    classes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-classes")
    parts = components(links(classes.select("fp"), budget))
    # the component's smallest document, for each class that has more than one document
    named = classes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("members"))
    ids = stored(named.join(least.where("members > 1"), "root").select("fp", "root", "component_id"), "simhash-ids")
    return fps.join(ids, "fp", "left").select("doc_id", "t", "fp", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("root", "fp").alias("root"))


def deduplicated(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """One row of each group of near copies: that with the smallest id (then text hash), with all its columns.

    Rows are judged by id and text, so rows that share an id but belong to different groups are judged apart. Rows
    without an id stay. Only the rows of ids that come several times in their group are shuffled with their texts.
    """
    groups = stored(near_duplicates(docs, budget).where("doc_id IS NOT NULL").select("doc_id", "t", "root", "component_id"), "simhash-groups")
    copies = groups.where("component_id <> doc_id").select("doc_id", "t").distinct()
    twice = groups.where("component_id = doc_id").groupBy("root", "doc_id").agg(F.count("*").alias("n"), F.min("t").alias("first")).where("n > 1")
    others = groups.join(twice.select("root", "doc_id", "first"), ["root", "doc_id"]).where("t <> first").select("doc_id", "t").distinct()
    name = "near"
    while any(c.lower().startswith(name) for c in docs.columns):
        name += "_"
    ids = [F.col("doc_id").alias(f"{name}_id"), F.col("t").alias(f"{name}_t")]
    gone = stored(copies.union(others).select(*ids), "simhash-gone")
    again = stored(twice.select(*ids[:1], F.col("first").alias(f"{name}_t")), "simhash-again")
    keyed = docs.withColumns({f"{name}_doc": F.col("doc_id").cast("long"), f"{name}_text": F.xxhash64(F.col("text").cast("string"))})
    same = (F.col(f"{name}_doc") == F.col(f"{name}_id")) & (F.col(f"{name}_text") == F.col(f"{name}_t"))
    left = keyed.join(with_hint(gone, 1_000_000), same, "left_anti")
    once = left.join(with_hint(again, 1_000_000), same, "left_anti").select(*docs.columns)
    several = left.join(with_hint(again, 1_000_000), same, "left_semi")
    first = several.groupBy(f"{name}_doc", f"{name}_text").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias(f"{name}_row"))
    return once.unionByName(first.select(*[F.col(f"{name}_row")[c].alias(c) for c in docs.columns]))
