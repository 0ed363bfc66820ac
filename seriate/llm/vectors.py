"""Vectors shared by both searches: which take part, groups that queries are streamed through, and the merge of lists of nearest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from seriate.llm.common import arrow_map


def usable(vectors: DataFrame, zero: bool) -> DataFrame:
    """vec_id (long) and v (array of float, if they are floats, else of double): vectors that are not null, nor hold
    null or non-finite components.

    zero: whether zero vectors and empty ones take part.
    """
    kind = vectors.schema["embedding"].dataType
    v = F.col("embedding").cast("array<float>" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    out = vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).where(~bad)
    if not zero:
        out = out.where(F.exists(v, lambda x: x != 0))
    return out.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def one_each(asked: DataFrame) -> DataFrame:
    """Queries by their id; of several vectors of one id, that with the least hash is asked."""
    return asked.groupBy("vec_id").agg(F.min_by("v", F.xxhash64("v")).alias("v"))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(a, pa.ChunkedArray):
        a = a.chunk(0) if a.num_chunks else pa.array([], a.type)
    return a.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(a), -1) if len(a) else np.empty((0, 0))


def streamed(base: DataFrame, asked: DataFrame, keys: list[str], prepare: Callable, answer: Callable, ddl: str) -> DataFrame:
    """Queries through groups: a task holds one group's base rows, and the group's queries pass by in batches.

    base and asked have the keys and other columns, none of them in both. prepare(table) makes an index of a group's base
    rows, answer(index, batch) gives a record batch of results. Nothing is held of a group's queries, so it doesn't
    matter how many there are.
    """
    own, others = [c for c in base.columns if c not in keys], [c for c in asked.columns if c not in keys]
    of = {f.name: f.dataType for f in [*base.schema.fields, *asked.schema.fields]}
    null = lambda c: F.lit(None).cast(of[c]).alias(c)
    rows = base.select(*keys, F.lit(0).alias("side"), *own, *map(null, others)).unionByName(asked.select(*keys, F.lit(1).alias("side"), *map(null, own), *others))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, index = None, [], None
        for b in batches:
            names = list(zip(*(b[k].to_pylist() for k in keys), strict=True))
            sides, first = b["side"].to_numpy(), 0
            while first < len(b):
                end = first + 1
                while end < len(b) and names[end] == names[first] and sides[end] == sides[first]:
                    end += 1
                if names[first] != at:
                    at, held, index = names[first], [], None
                piece = b.slice(first, end - first)
                if sides[first] == 0:
                    held.append(piece.select(own))
                elif held or index is not None:  # no query has an answer in a group without base rows
                    if index is None:
                        index, held = prepare(pa.Table.from_batches(held)), []
                    yield answer(index, piece.select(others))
                first = end

    return arrow_map(rows.repartition(*keys).sortWithinPartitions(*keys, "side"), run, ddl)


def best(found: DataFrame, k: int, kind: str) -> DataFrame:
    """The k highest scores of each query, of rows query_id, vec_id, score; ties to the smaller vec_id."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id")))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("score").cast(kind).alias("score"))


def top(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k highest scores, ties to the smaller vec."""
    o = np.lexsort((vec, -score, query))
    q = query[o]
    if not len(q):
        return o
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    return o[place < k]


def once(query: np.ndarray, vec: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Positions of the highest score of each query and vec."""
    o = np.lexsort((-score, vec, query))
    return o[np.r_[True, (query[o][1:] != query[o][:-1]) | (vec[o][1:] != vec[o][:-1])]] if len(o) else o
