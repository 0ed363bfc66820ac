"""Packing by concatenate and cut.

Pass one encodes each document and keeps, for each partition, a running count of tokens; the totals of the
partitions, summed in order, give each partition's global offset. Pass two adds that offset to each document's
own start and cuts at multiples of the window. Documents never move between partitions.

Defined results: a null text is the empty text, whose only id is the end id; rows with the same or a null
doc_id are packed each on its own; an empty table gives no pieces; only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriate.llm.common import arrow_map, stored, with_hint
from seriate.llm.tokens import blobs, encoder

WINDOW = 4096
END_ID = 2
_PASS_ONE = "part int, local_start long, doc_id long, n long, ids binary"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _encoded(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, at = encoder(path).encode, TaskContext.get().partitionId(), 0
        for whole in batches:
            for i in range(0, len(whole), 1024):
                b = whole.slice(i, 1024)
                ids, n = encode(b["text"], end_id)
                ends = at + np.cumsum(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part, np.int32)), pa.array(ends - n), b.column("doc_id"), pa.array(n), blobs(ids, n)],
                    ["part", "local_start", "doc_id", "n", "ids"],
                )
                at = int(ends[-1])

    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc, n, start, blob in zip(b["doc_id"].to_pylist(), b["n"].to_pylist(), b["global_start"].to_pylist(), b["ids"], strict=True):
                ids = np.frombuffer(blob.as_buffer(), "<u2").astype("<u4")
                at = 0
                while at < n:
                    seq, off = divmod(start + at, window)
                    m = min(n - at, window - off)
                    for o, v in zip(out, (doc, at, m, zlib.crc32(ids[at : at + m]), n, seq, off), strict=True):
                        o.append(v)
                    at += m
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], [c.split()[0] for c in _PIECES.split(", ")])

    return run


def encoded(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Each document's ids (16 bits each, the end id included) and its place in the concatenation."""
    one = stored(arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _encoded(path, end_id), _PASS_ONE), "packing-ids")
    totals = one.groupBy("part").agg(F.sum("n").alias("total"))
    # one row for each partition of the scan, so this window is small however large the documents are
    before = F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = stored(totals.select("part", before.alias("base")), "packing-bases")
    return one.join(with_hint(bases, 1_000_000), "part").select("doc_id", "n", "ids", (F.col("base") + F.col("local_start")).alias("global_start"))


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of documents in sequences of window tokens; only the last sequence is padded."""
    return arrow_map(encoded(docs, path, end_id), _cut(window), _PIECES)
