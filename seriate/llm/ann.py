"""Approximate nearest neighbours by multiprobe p-stable hashing.

Inner products become distances: with M the greatest norm, a vector v gets one more component sqrt(M^2 - |v|^2)
and a query is scaled to norm M, so the nearest in Euclidean distance is the one with the largest product. Each
table hashes by a few projections on normal (2-stable) directions, cut into intervals of WIDTH. A query visits
its own bucket and perturbed ones, in the order in which they are estimated to hold its neighbours: its
distances to the interval borders are ranked, and sets of perturbations of ranks come by their expected sum of
squares. Candidates of all tables are merged and ranked by the exact product of the original vectors.

The number of hash functions, the width of their intervals and the number of probes are fitted on a bounded sample
(SAMPLE vectors, SAMPLE_QUERIES of them as queries): of those that reach TARGET recall, the ones that visit the
smallest share of all vectors; where none does, there is one bucket, which is a scan of all. So the target is
met whatever the size, at the price of a larger share. Everything is indexed. A bucket with more than HOT vectors is
cut into parts, and a query that visits it visits all of them. Buckets are put together into groups of some GROUP
vectors; a group's queries stream past it, so their number doesn't matter. Recall against brute force is in the tests
and the README.

Defined results: vectors that are null, zero, empty or hold null or non-finite components take no part; ties go
to the smaller vec_id; rows with the same vec_id never answer each other and count once, with their highest score; of
several vectors of one query id the one with the least hash is asked; vectors of different lengths never meet; an
empty table gives no rows; only vec_id and embedding are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriate.llm.common import arrow_map, mixed, stored, with_hint
from seriate.llm.vectors import best, matrix, once, one_each, streamed, top, usable

K = 20
TABLES = 4
#: Interval widths to choose from, in standard deviations of the projections.
WIDTHS = (1.5, 2.5, 4.0)
#: Vectors that a bucket should hold, about.
BUCKET = 1024
TARGET = 0.97
SAMPLE, SAMPLE_QUERIES = 8192, 128
MOST_PROBES = 729
HOT, GROUP = 2048, 16_384
SEED = 12345
_FOUND = "query_id long, vec_id long, score double"


def perturbations(m: int, most: int) -> list[tuple[int, ...]]:
    """Sets of ranks 1 to 2m of border distances, by expected squared distance; a rank and its opposite never meet."""
    if not m:
        return [()]
    cost = [0.0] + [j * (j + 1) / (4 * (m + 1) * (m + 2)) for j in range(1, m + 1)]
    cost += [1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(m + 1, 2 * m + 1)]
    out, heap = [()], [(cost[1], (1,))]
    while heap and len(out) < most:
        c, s = heapq.heappop(heap)
        if not any(2 * m + 1 - j in s for j in s):
            out.append(s)
        last = s[-1]
        if last < 2 * m:
            heapq.heappush(heap, (c - cost[last] + cost[last + 1], (*s[:-1], last + 1)))
            heapq.heappush(heap, (c + cost[last + 1], (*s, last + 1)))
    return out


@dataclass
class Index:
    """Hash functions; those of each vector length come from the seed and the length."""

    hashes: int
    norm: float
    tables: int = TABLES
    probes: int = 1
    width: float = WIDTHS[0]
    recall: float = 1.0
    share: float = 1.0

    def functions(self, dim: int) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng((SEED, dim, self.hashes))
        return rng.normal(size=(self.tables, dim + 1, self.hashes)), rng.uniform(size=(self.tables, 1, self.hashes))

    def places(self, v: np.ndarray, query: bool) -> np.ndarray:
        """Projections in units of intervals: table, vector, function. Projections have the norm as deviation."""
        size = np.sqrt((v * v).sum(1))
        x = v / size[:, None] if query else v / self.norm
        rest = np.zeros(len(v)) if query else np.sqrt(np.maximum(0, 1 - (size / self.norm) ** 2))
        a, b = self.functions(v.shape[1])
        return np.einsum("nd,tdm->tnm", np.c_[x, rest], a, optimize=True) / self.width + b

    def cells(self, codes: np.ndarray, dim: int) -> np.ndarray:
        """A 64-bit name of each table's bucket: codes are table, ..., function."""
        out = np.broadcast_to(np.arange(self.tables, dtype=np.uint64).reshape(-1, *[1] * (codes.ndim - 2)), codes.shape[:-1]) + np.uint64(dim * 64)
        for i in range(self.hashes):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + codes[..., i].astype(np.int64).view(np.uint64))
        return out.view(np.int64)

    def base(self, v: np.ndarray) -> np.ndarray:
        return self.cells(np.floor(self.places(v, False)), v.shape[1])

    def visited(self, v: np.ndarray, probes: int | None = None) -> np.ndarray:
        """Names of the buckets that queries visit, the likeliest first: table, query, probe."""
        p = self.places(v, True)
        code = np.floor(p)
        below = p - code  # distance to the lower border, and from there to the upper one
        borders = np.concatenate([below, 1 - below], axis=2)
        order = np.argsort(borders, axis=2, kind="stable")
        sets = perturbations(self.hashes, probes or self.probes)
        out = np.repeat(code[:, :, None, :], len(sets), axis=2)
        for k, s in enumerate(sets):
            for j in s:
                at = order[:, :, j - 1]
                fn, up = at % self.hashes, np.where(at >= self.hashes, 1, -1)
                t, n = np.indices(at.shape)
                out[t, n, k, fn] += up
        return self.cells(out, v.shape[1])


def _reached(index: Index, sample: np.ndarray, asked: np.ndarray, near: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each number of probes: the share of the neighbours near (positions in sample) of the asked ones that it finds, and the share of the sample that it visits."""
    cells, visits = index.base(sample), index.visited(sample[asked], most)
    # the first probe that reaches each vector, in any table
    first = np.full((len(asked), len(sample)), most, np.int32)
    for t in range(index.tables):
        names, back = np.unique(cells[t], return_inverse=True)
        for i in range(len(asked)):
            at = np.searchsorted(names, visits[t, i])
            hit = np.flatnonzero(names[np.minimum(at, len(names) - 1)] == visits[t, i])[::-1]
            probe = np.full(len(names), most, np.int32)
            probe[at[hit]] = hit  # the least probe of a bucket is written last
            np.minimum(first[i], probe[back], out=first[i])
    found = np.take_along_axis(first, near, 1)
    return tuple(np.cumsum(np.bincount(x.ravel(), minlength=most + 1)[:most]) / x.size for x in (found, first))


def fitted(sample: np.ndarray, rows: int, norm: float, k: int = K) -> Index:
    """The index that finds TARGET of the sample's own neighbours and visits the least share of the sample."""
    # an interval of 1.5 deviations tells about 1.5 bits
    most_hashes = int(np.clip(np.ceil(np.log2(max(2, rows / BUCKET)) / 1.5), 2, 24))
    if len(sample) <= 2:
        return Index(hashes=most_hashes, norm=norm)
    asked = np.arange(0, len(sample), max(1, len(sample) // SAMPLE_QUERIES))[:SAMPLE_QUERIES]
    s = sample[asked] @ sample.T
    s[np.arange(len(asked)), asked] = -np.inf
    near = np.argsort(-s, axis=1)[:, : min(k, len(sample) - 1)]
    chosen = Index(hashes=0, norm=norm, tables=1)  # one bucket holds all vectors, and the search is exact
    for width in WIDTHS:
        for hashes in range(most_hashes, 1, -1):
            index = Index(hashes=hashes, norm=norm, width=width)
            recall, share = _reached(index, sample, asked, near, min(MOST_PROBES, 3**hashes))
            if recall[-1] < TARGET:
                continue
            probes = int(np.searchsorted(recall, TARGET)) + 1
            if share[probes - 1] < chosen.share:
                index.probes, index.recall, index.share = probes, float(recall[probes - 1]), float(share[probes - 1])
                chosen = index
            break  # fewer functions visit more
    return chosen


def _by_dim(b: pa.RecordBatch, index: Index, query: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    dims = np.diff(b["v"].offsets.to_numpy())
    for dim in np.unique(dims):
        rows = np.flatnonzero(dims == dim)
        v = matrix(b["v"].take(pa.array(rows)))
        yield rows, (index.visited(v) if query else index.base(v))


def _hashed(index: Index, query: bool, with_vectors: bool = True):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), 128 if query else 10_000):
                b = whole.slice(i, 128 if query else 10_000)
                for rows, cells in _by_dim(b, index, query):
                    ids = b["vec_id"].take(pa.array(rows)).to_numpy()
                    if query:
                        own = np.broadcast_to(ids[None, :, None], cells.shape)
                        yield pa.RecordBatch.from_arrays([pa.array(cells.ravel()), pa.array(own.ravel())], ["cell", "query_id"])
                    elif with_vectors:
                        for t in range(len(cells)):
                            yield pa.RecordBatch.from_arrays([pa.array(cells[t]), pa.array(ids), b["v"].take(pa.array(rows))], ["cell", "vec_id", "v"])
                    else:
                        names, n = np.unique(cells, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(n)], ["cell", "n"])

    return run


@dataclass
class _Group:
    """A group's vectors, of one length, in the order of their buckets."""

    cells: np.ndarray
    ids: np.ndarray
    v: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    longest: float
    #: Whether no bucket holds an id twice.
    unique: bool


def _grouped(table: pa.Table) -> dict[int, _Group]:
    """The vectors of a group by their length."""
    table = table.sort_by([("cell", "ascending"), ("vec_id", "ascending")])
    dims, out = np.array(pc.list_value_length(table["v"])), {}
    for dim in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == dim)
        cells, v = table["cell"].to_numpy()[rows], matrix(table["v"].take(pa.array(rows)))
        starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
        ids = table["vec_id"].to_numpy()[rows]  # sorted within their bucket
        unique = not ((cells[1:] == cells[:-1]) & (ids[1:] == ids[:-1])).any()
        out[dim] = _Group(cells, ids, v, starts, np.r_[starts[1:], len(cells)], float(np.sqrt((v * v).sum(1).max())), unique)
    return out


#: A sum of products differs by less than this share of the vectors' lengths, in whatever order it is taken.
SLACK = 1e-12


def _answers(k: int):
    def run(groups: dict[int, _Group], asked: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list[np.ndarray]] = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]]
        dims = np.array(pc.list_value_length(asked["qv"]))
        for dim, group in groups.items():
            mine = np.flatnonzero(dims == dim)
            for i in range(0, len(mine), 1024):
                rows = pa.array(mine[i : i + 1024])
                found = _nearest(group, asked["query_id"].take(rows).to_numpy(), matrix(asked["qv"].take(rows)), asked["cells"].take(rows), k)
                for o, x in zip(out, found, strict=True):
                    o.append(x)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], [c.split()[0] for c in _FOUND.split(", ")])

    return run


def _nearest(g: _Group, ids: np.ndarray, q: np.ndarray, cells: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query_id, vec_id, score of the k nearest that each query meets in the buckets that it visits."""
    n = np.array(pc.list_value_length(cells))
    visit, who = cells.flatten().to_numpy(), np.repeat(np.arange(len(n)), n)
    o = np.argsort(visit, kind="stable")
    visit, who = visit[o], who[o]
    slack = SLACK * np.sqrt((q * q).sum(1)) * g.longest
    floor, held, size = np.full(len(q), -np.inf), [], 0

    def settled() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, vec, score = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        o = once(row, vec, score)  # a vector comes from several buckets, an id from several rows
        o = o[top(row[o], vec[o], score[o], k)]
        row, vec, score = row[o], vec[o], score[o]
        full = np.bincount(row, minlength=len(floor)) >= k
        least = np.full(len(floor), np.inf)
        np.minimum.at(least, row, score)
        floor[full] = np.maximum(floor[full], least[full])
        return row, vec, score

    for s, e in zip(g.starts.tolist(), g.ends.tolist(), strict=True):
        lo, hi = np.searchsorted(visit, [g.cells[s], g.cells[s] + 1]) if g.cells[s] < np.iinfo(np.int64).max else (np.searchsorted(visit, g.cells[s]), len(visit))
        rows = np.unique(who[lo:hi])
        for i in range(0, len(rows), 256):
            for at in range(s, e, 4096):
                r, upto = rows[i : i + 256], min(e, at + 4096)
                score = q[r] @ g.v[at:upto].T
                score[ids[r][:, None] == g.ids[at:upto][None, :]] = -np.inf
                if upto - at > 2 * k and g.unique:
                    # what isn't among the chunk's own k highest, or as high, can't be among all
                    kth = -np.partition(-score, k - 1, axis=1)[:, k - 1]
                    floor[r] = np.maximum(floor[r], kth - slack[r])
                a, b = np.nonzero((score >= (floor[r] - slack[r])[:, None]) & (score > -np.inf))
                # in one order whatever the batch, so that equal vectors tie
                held.append((r[a], g.ids[at + b], np.einsum("nd,nd->n", q[r[a]], g.v[at + b])))
                size += len(a)
                if size > 400_000:
                    held = [settled()]
                    size = len(held[0][0])
    row, vec, score = settled()
    return ids[row], vec, score


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: for each query (vec_id, embedding), the k nearest that were found."""
    base, asked = usable(vectors, zero=False), one_each(usable(queries, zero=False))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    facts = base.agg(F.count("*").alias("n"), F.max(norm).alias("norm")).first()
    sample = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()
    longest = max((len(r["v"]) for r in sample), default=0)
    index = fitted(np.array([r["v"] for r in sample if len(r["v"]) == longest], float), facts["n"], facts["norm"] or 1.0, k)
    counts = arrow_map(base, _hashed(index, False, with_vectors=False), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    parts = stored(counts.where(F.col("n") > HOT).select("cell", F.ceil(F.col("n") / HOT).cast("int").alias("parts")), "ann-hot")
    hot = with_hint(parts, 100_000)
    groups = max(1, -(-facts["n"] * index.tables // GROUP))
    # rows of one id are dealt by what they hold, too
    part = F.pmod(F.xxhash64("vec_id", "v"), F.coalesce("parts", F.lit(1)).cast("long")).cast("int")
    kind = base.schema["v"].dataType.simpleString()
    rows = arrow_map(base, _hashed(index, False), f"cell long, vec_id long, v {kind}")
    dealt = rows.join(hot, "cell", "left").select(F.pmod(F.xxhash64("cell", part), F.lit(groups)).alias("g"), "cell", "vec_id", "v")
    visits = arrow_map(asked, _hashed(index, True), "cell long, query_id long").join(hot, "cell", "left")
    visits = visits.select("query_id", "cell", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    visits = visits.groupBy("query_id", F.pmod(F.xxhash64("cell", "part"), F.lit(groups)).alias("g")).agg(F.collect_set("cell").alias("cells"))
    visits = visits.join(asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv")), "query_id")
    return best(streamed(dealt, visits, ["g"], _grouped, _answers(k), _FOUND), k, "double")
