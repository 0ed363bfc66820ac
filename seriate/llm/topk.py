"""Exact top-k by inner product, pruned a block at a time.

Vectors become integers and play the part of documents, their signed components that of terms. Vectors are dealt
into groups, each of which is put in an order that brings like vectors together and cut into ranges of BLOCK. Each
block keeps its greatest and least value of every term and a forward index. For a query, blocks are ordered by the
sum of its terms' bounds and scored through their forward indexes until the next bound falls below the k-th score so
far, so nothing that could belong to the result is left out.

Each query starts with the k-th score that it reaches in a bounded sample of vectors, and isn't sent to groups whose
bound is lower. Vectors are shuffled once; a group's index is built once, and its queries stream past it.

Defined results: vectors that are null or hold null or non-finite components take no part; zero vectors do; ties
go to the smaller vec_id; rows with the same vec_id never answer each other and count once, with their highest
score; of several vectors of one query id the one with the least hash is asked; an empty table gives no rows; vectors of
different lengths never meet; a score beyond 64 bits is given as the nearest number that has them; only vec_id and
embedding are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriate.llm.common import arrow_map, stored
from seriate.llm.vectors import best, matrix, one_each, streamed, usable

SCALE = 1024
K = 10
BLOCK = 64
#: Vectors of a group: so many at most, and so few that every core has a group.
MOST, LEAST = 1 << 17, 1 << 12
#: Vectors from which queries get their first bound.
SAMPLE = 4096
#: Groups whose bounds are sent to the queries; of more, every query goes to all.
BOUNDED = 4096
#: Blocks that a query scores at once.
STRIDE = 4
#: Sums of products below these are exact in double precision, and fit 64 bits.
EXACT, LONG = 1 << 53, 1 << 63
_FOUND = "query_id long, vec_id long, score long"


def _kind(a: np.ndarray, b: np.ndarray):
    """The type in which all products of rows of a and b are exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1] if a.ndim > 1 else 1)
    return np.float64 if most < EXACT else np.int64 if most < LONG / 2 and max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) < LONG / 2 else object


def _typed(a: np.ndarray, kind) -> np.ndarray:
    return np.array([[int(x) for x in row] for row in a], object).reshape(a.shape) if kind is object else a.astype(kind)


class Blocks:
    """The forward indexes and term bounds of a group of vectors."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, block: int = BLOCK):
        if not values.shape[1]:
            values = np.zeros((len(values), 1))
        # like vectors share the signs of a few of their strongest varying terms
        lead = np.argsort(-values.astype(float).std(0), kind="stable")[:12]
        code = (values[:, lead] > np.median(values[:, lead], axis=0)) @ (1 << np.arange(len(lead))[::-1])
        order = np.lexsort((ids, code))
        self.ids, self.values = ids[order], values[order]
        starts = np.arange(0, len(ids), block)
        self.starts, self.ends = starts, np.r_[starts[1:], len(ids)]
        self.most, self.least = np.maximum.reduceat(self.values, starts), np.minimum.reduceat(self.values, starts)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """No vector of the block scores higher with the query."""
        return np.maximum(queries, 0) @ self.most.T + np.minimum(queries, 0) @ self.least.T

    def search(self, query_id: int, query: np.ndarray, bound: np.ndarray, k: int, least=None) -> tuple[np.ndarray, np.ndarray]:
        """The k highest, of those that aren't below least."""
        order = np.argsort(-bound, kind="stable")
        ids, scores, kth = np.empty(0, np.int64), np.empty(0, self.values.dtype), least
        for i in range(0, len(order), STRIDE):
            if kth is not None and bound[order[i]] < kth:
                break
            rows = np.concatenate([np.arange(self.starts[j], self.ends[j]) for j in order[i : i + STRIDE]])
            rows = rows[self.ids[rows] != query_id]
            found = self.values[rows] @ query
            if kth is not None:
                rows, found = rows[found >= kth], found[found >= kth]
            ids, scores = np.r_[ids, self.ids[rows]], np.r_[scores, found]
            once = np.lexsort((-scores, ids))  # rows of one id count once, with their highest score
            ids, scores = ids[once], scores[once]
            new = np.r_[True, ids[1:] != ids[:-1]][: len(ids)]
            ids, scores = ids[new], scores[new]
            keep = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[keep], scores[keep]
            if len(ids) == k:
                kth = scores[-1]
        return ids, scores


def _prepared(table: pa.Table) -> tuple[np.ndarray, np.ndarray, dict]:
    """Ids and values of a group, and its blocks for each type of number that queries turn out to need."""
    return table["vec_id"].to_numpy(), matrix(table["v"]), {}


def _answered(k: int):
    def run(group: tuple, asked: pa.RecordBatch) -> pa.RecordBatch:
        ids, values, made = group
        q = matrix(asked["qv"])
        if not values.shape[1]:
            q = np.zeros((len(asked), 0))
        kind = _kind(values, q)
        if kind not in made:
            made[kind] = Blocks(ids, _typed(values, kind))
        blocks, out = made[kind], [[np.empty(0, np.int64)] for _ in range(3)]
        q = _typed(q if q.shape[1] else np.zeros((len(q), 1)), kind)
        floors = asked["floor"].to_pylist()
        q_ids = asked["query_id"].to_numpy()
        for i in range(0, len(q), 256):
            for qid, x, bound, least in zip(q_ids[i : i + 256], q[i : i + 256], blocks.bounds(q[i : i + 256]), floors[i : i + 256], strict=True):
                vec, score = blocks.search(qid, x, bound, k, least)
                score = np.array([min(max(int(y), -LONG), LONG - 1) for y in score], np.int64) if kind is object else score.astype(np.int64)
                for o, v in zip(out, (np.full(len(vec), qid), vec, score), strict=True):
                    o.append(v)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(o).astype(np.int64)) for o in out], [c.split()[0] for c in _FOUND.split(", ")])

    return run


def _sent(sample: dict[int, tuple[np.ndarray, np.ndarray]], bounds: dict[int, tuple[list[int], np.ndarray, np.ndarray]], k: int):
    """Each query with its first bound, once for each group that may hold something above it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                b = whole.slice(at, 256)
                dims = b["dim"].to_numpy()
                for dim in np.unique(dims).tolist():
                    if dim not in bounds:
                        continue  # no vector has this length
                    rows = np.flatnonzero(dims == dim)
                    part = b.take(pa.array(rows))
                    q, ids = matrix(part["v"]), part["vec_id"].to_numpy()
                    floors: list = [None] * len(rows)
                    if dim in sample and dim and _kind(sample[dim][1], q) is np.float64:
                        own, values = sample[dim]
                        score = q @ values.T
                        score[ids[:, None] == own[None, :]] = -np.inf
                        # ids may come several times in the sample: only different ones count
                        if len(own) > k and len(np.unique(own)) == len(own):
                            kth = -np.partition(-score, k - 1, axis=1)[:, k - 1]
                            floors = [int(x) if np.isfinite(x) else None for x in kth]
                    groups, most, least = bounds[dim]
                    if most is not None and dim:
                        reach = np.maximum(q, 0) @ most.T + np.minimum(q, 0) @ least.T
                        slack = 1e-9 * (np.abs(q) @ np.maximum(np.abs(most), np.abs(least)).T)  # sums of doubles may be rounded
                        go = np.array([np.ones(len(groups), bool) if f is None else reach[i] + slack[i] >= f for i, f in enumerate(floors)]).reshape(len(rows), len(groups))
                    else:
                        go = np.ones((len(rows), len(groups)), bool)
                    a, g = np.nonzero(go)
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), dim, np.int32)), pa.array(np.array(groups, np.int64)[g]), pa.array(ids[a]), part["v"].take(pa.array(a)), pa.array([floors[i] for i in a.tolist()], pa.int64())], ["dim", "g", "query_id", "qv", "floor"])

    return run


def _floored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components as floor(SCALE * x), kept as double."""
    for b in batches:
        v = b["v"]
        flat = pa.array(np.floor(SCALE * v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)))
        yield pa.RecordBatch.from_arrays([b["vec_id"], pa.ListArray.from_arrays(v.offsets.to_numpy() - v.offsets[0].as_py(), flat)], ["vec_id", "v"])


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: of each query (vec_id, embedding), the k highest of vectors but its own."""
    spark = vectors.sparkSession
    values = stored(arrow_map(usable(vectors, zero=True), _floored, "vec_id long, v array<double>").withColumn("dim", F.size("v")), "topk-vectors")
    asked = arrow_map(one_each(usable(queries, zero=True)), _floored, "vec_id long, v array<double>").withColumn("dim", F.size("v"))
    n = values.count()
    groups = max(1, -(-n // MOST), min(2 * spark.sparkContext.defaultParallelism, -(-n // LEAST)))
    # rows of one id are dealt by what they hold, too
    dealt = values.withColumn("g", F.pmod(F.xxhash64("vec_id", "v"), F.lit(groups)))
    sample: dict[int, list] = {}
    for r in values.orderBy(F.xxhash64("vec_id", "v")).limit(SAMPLE).collect():
        sample.setdefault(r["dim"], []).append((r["vec_id"], r["v"]))
    near = {d: (np.array([i for i, _ in rows], np.int64), np.array([v for _, v in rows], float)) for d, rows in sample.items()}
    bounds = _group_bounds(dealt)
    sent = arrow_map(asked, _sent(near, bounds, k), "dim int, g long, query_id long, qv array<double>, floor long")
    found = streamed(dealt.select("dim", "g", "vec_id", "v"), sent, ["dim", "g"], _prepared, _answered(k), _FOUND)
    return best(found, k, "long")


def _group_bounds(dealt: DataFrame) -> dict[int, tuple[list[int], np.ndarray | None, np.ndarray | None]]:
    """Of each length of vectors: its groups, and their greatest and least components (none where there are too many groups)."""
    names = dealt.select("dim", "g").distinct().collect()
    out = {d: ([r["g"] for r in names if r["dim"] == d], None, None) for d in {r["dim"] for r in names}}
    if len(names) <= BOUNDED:
        each = arrow_map(dealt.select("dim", "g", "v"), _extremes, "dim int, g long, most array<double>, least array<double>")
        for r in each.collect() if len(names) <= BOUNDED else ():
            groups, most, least = out[r["dim"]]
            if most is None:
                most, least = np.full((len(groups), r["dim"]), -np.inf), np.full((len(groups), r["dim"]), np.inf)
                out[r["dim"]] = groups, most, least
            i = groups.index(r["g"])
            most[i], least[i] = np.maximum(most[i], r["most"]), np.minimum(least[i], r["least"])
    return out


def _extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each group of a task, its greatest and least components."""
    held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for b in batches:
        dims, groups = b["dim"].to_numpy(), b["g"].to_numpy()
        for dim, g in set(zip(dims.tolist(), groups.tolist(), strict=True)):
            v = matrix(b["v"].take(pa.array(np.flatnonzero((dims == dim) & (groups == g)))))
            most, least = v.max(0), v.min(0)
            if (dim, g) in held:
                most, least = np.maximum(most, held[dim, g][0]), np.minimum(least, held[dim, g][1])
            held[dim, g] = most, least
    rows = [(d, g, m.tolist(), x.tolist()) for (d, g), (m, x) in held.items()]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())), strict=True)], ["dim", "g", "most", "least"])


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, [FLOOR(1024 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""
