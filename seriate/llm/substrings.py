"""Removal of repeated passages by compaction of a de Bruijn graph.

Nodes are runs of 12 words, edges runs of 13: the windows. Only windows that start in two different documents
matter, so a first pass finds what may repeat: each window is stood for by the least hash of its 7-word runs (its
minimizer), and a bitmap of fixed size holds the minimizers of several documents. A second pass keeps the
stretches of documents whose windows pass the bitmap; what passes without need is found out later.

The edges are then counted exactly: for each window its occurrences, its first document and place, and the
windows before and after it if all occurrences agree on them. Where neighbours agree on each other the path doesn't
branch, and all its windows occur in the same places, one word on: such paths are compacted, first within blocks of
the first document's words, then across blocks by Spark joins that double the distance. Source coordinates
(document and place) must follow on, so a path is a span of its first document. A document holds the span
if it holds the path's first window, and gives it up if the first document is a smaller one.

Windows are known by 96 bits: two polynomial hashes of the words' 64-bit hashes.

Defined results: a null text has no words; rows with a null doc_id keep all words and take none from others; of
rows with the same doc_id and different texts each is judged by its own words, and none takes words from the
others; an empty table gives no rows; very long documents are cut into blocks where that bounds a task; only
doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriate.llm.common import Bitmap, arrow_map, blob_batches, buckets_for, by_bucket, bytes_of, mixed, rolled, settle, stored, text_slices, together, word_hashes

WINDOW = 13
ANCHOR = 7
BLOCK = 1024
PROBES = 3
#: Windows that a task gathers before it sums them up.
GATHERED = 2_000_000
#: Bytes of text to a bucket of what is gathered, by Spark's estimate: as many buckets as that makes, 256 at least.
BUCKET_BYTES = 1 << 26
_B1, _B2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_RUNS = "doc_id long, t long, start int, words binary"
_EDGES = "a long, b int, prev int, next int, doc long, pos int, n long"
_SPANS = "a long, b int, tail int, prev int, next int, doc long, pos int, len int, n long"


def hashed(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The hashes of each text's words."""
    for i, j in text_slices(texts):
        h, n = word_hashes(texts[i:j])
        yield from np.split(h, np.cumsum(n)[:-1])


def _least(a: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of width values."""
    size = 1
    while size * 2 <= width:
        a = np.minimum(a[:-size], a[size:])
        size *= 2
    return np.minimum(a[: len(a) - (width - size)], a[width - size :]) if width > size else a


def anchors(words: np.ndarray) -> np.ndarray:
    """The minimizer of each window: 48 bits of it are enough for what only may repeat."""
    return _least(mixed(rolled(words, ANCHOR, _B1)), WINDOW - ANCHOR + 1) >> np.uint64(16)


def _keys(minimizers: np.ndarray) -> np.ndarray:
    """64 bits for the bitmap, with the minimizer's on top."""
    return (minimizers << np.uint64(16)) | (mixed(minimizers) & np.uint64(0xFFFF))


_MINIMIZERS = [np.uint64, np.int64, np.int64]


def _packed(chunks: list[tuple[np.ndarray, np.ndarray]], slices: int) -> Iterator[pa.RecordBatch]:
    """Of gathered minimizers and their documents: each with its least and greatest document."""
    h, d = (np.concatenate(x) for x in zip(*chunks, strict=True))
    o = np.argsort(h, kind="stable")
    h, d = h[o], d[o]
    st = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    h, lo, hi = h[st], np.minimum.reduceat(d, st), np.maximum.reduceat(d, st)
    o = np.argsort(lo, kind="stable")  # close values compress
    h, lo, hi = h[o], lo[o], hi[o]
    yield from blob_batches(Bitmap(slices).slice_of(_keys(h)), [h, lo, hi - lo], slices)


def _gather(slices: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for doc, words in zip(b["doc_id"].to_pylist(), hashed(bytes_of(b["text"])), strict=True):
                if doc is None or len(words) < WINDOW:
                    continue
                m = anchors(words)
                m = m[np.r_[True, m[1:] != m[:-1]]]
                held.append((m, np.full(len(m), doc, np.int64)))
                size += len(m)
                if size > GATHERED:
                    yield from _packed(held, slices)
                    held, size = [], 0
        if held:
            yield from _packed(held, slices)

    return run


def _slices(slices: int, pick):
    """Of all rows of a bucket, the bitmap's slice with the keys that pick chooses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, blobs in by_bucket(batches, "values"):
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([Bitmap(slices).made(pick(blobs), PROBES)], pa.binary())], ["bucket", "bits"])

    return run


def _several(blobs: list[bytes]) -> np.ndarray:
    """Keys of the minimizers of more than one document."""
    h, lo, more = together(blobs, _MINIMIZERS)
    o = np.argsort(h, kind="stable")
    h, lo, hi = h[o], lo[o], (lo + more)[o]
    st = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    return _keys(h[st][np.minimum.reduceat(lo, st) != np.maximum.reduceat(hi, st)])


def _bitmap(spark: SparkSession, rows: DataFrame, slices: int, pick):
    """The broadcast bitmap, whose size is fixed, of rows of blobs by bucket."""
    found = arrow_map(rows.repartition("bucket"), _slices(slices, pick), "bucket int, bits binary").collect()
    return spark.sparkContext.broadcast(Bitmap(slices).whole({r["bucket"]: bytes(r["bits"]) for r in found}))


def _runs(bits, slices: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.frombuffer(bits.value, np.uint8)
        for b in batches:
            out: list[list] = [[], [], [], []]
            for doc, t, h in zip(b["doc_id"].to_pylist(), b["t"].to_pylist(), hashed(bytes_of(b["text"])), strict=True):
                if doc is None or len(h) < WINDOW:
                    continue
                ok = np.r_[False, Bitmap(slices).has(flags, _keys(anchors(h)), PROBES), False]
                starts, ends = np.flatnonzero(ok[1:] & ~ok[:-1]), np.flatnonzero(~ok[1:] & ok[:-1])
                for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                    for o, v in zip(out, (doc, t, s, h[s : e + WINDOW - 1].tobytes()), strict=True):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.binary())], ["doc_id", "t", "start", "words"])

    return run


def windows(words: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Both hashes of each window of a run of hashed words."""
    w = np.frombuffer(words, np.uint64)
    return mixed(rolled(w, WINDOW, _B1)), (rolled(mixed(w), WINDOW, _B2) >> np.uint64(32)).astype(np.uint32)


def _short(a: np.ndarray) -> np.ndarray:
    """32 bits that stand for a neighbour; zero is none, or several."""
    return (a.astype(np.uint32) | np.uint32(1)).view(np.int32)


def _summed(a, b, prev, nxt, doc, pos, n, more):
    """One row for each window: neighbours if all rows agree, the first place, occurrences, and how far the documents range."""
    o = np.lexsort((pos, doc, b, a))
    a, b, prev, nxt, doc, pos, n, more = (x[o] for x in (a, b, prev, nxt, doc, pos, n, more))
    st = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    same = [np.where(np.minimum.reduceat(x, st) == np.maximum.reduceat(x, st), x[st], np.int32(0)) for x in (prev, nxt)]
    return a[st], b[st], *same, doc[st], pos[st], np.add.reduceat(n, st), np.maximum.reduceat(doc + more, st) - doc[st]


_COLUMNS = {"a": np.uint64, "b": np.uint32, "prev": np.int32, "next": np.int32, "doc": np.int64, "pos": np.int32, "n": np.int64, "more": np.int64}


def _counted(buckets: int):
    """Edges of each task, summed, as blobs by bucket."""

    def flush(held):
        rows = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
        o = np.lexsort((rows[5], rows[4]))
        rows = [x[o] for x in rows]
        yield from blob_batches((rows[0] >> np.uint64(65 - buckets.bit_length())).astype(np.int64), rows, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for doc, start, words in zip(batch["doc_id"].to_pylist(), batch["start"].to_pylist(), batch["words"].to_pylist(), strict=True):
                a, b = windows(words)
                n, s, none = len(a), _short(a), np.zeros(1, np.int32)
                held.append((a, b, np.r_[none, s[:-1]], np.r_[s[1:], none], np.full(n, doc, np.int64), np.arange(start, start + n, dtype=np.int32), np.ones(n, np.int64), np.zeros(n, np.int64)))
                size += n
                if size > GATHERED:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return run


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows that start in more than one document, of whole buckets."""
    for _, blobs in by_bucket(batches, "values"):
        rows = _summed(*together(blobs, list(_COLUMNS.values())))
        several = rows[7] != 0
        a, b, prev, nxt, doc, pos, n, _ = (x[several] for x in rows)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a.view(np.int64), b.view(np.int32), prev, nxt, doc, pos, n)], [c.split()[0] for c in _EDGES.split(", ")])


def _compacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths within blocks of the first document's words."""
    got = [[b[c.split()[0]].to_numpy() for c in _EDGES.split(", ")] for b in batches]
    if not got:
        return
    a, b, prev, nxt, doc, pos, n = (np.concatenate(x) for x in zip(*got, strict=True))
    o = np.lexsort((pos, doc))
    a, b, prev, nxt, doc, pos, n = (x[o] for x in (a, b, prev, nxt, doc, pos, n))
    s = _short(a.view(np.uint64))
    on = (doc[1:] == doc[:-1]) & (pos[1:] == pos[:-1] + 1) & (pos[1:] // BLOCK == pos[:-1] // BLOCK)
    on &= (n[1:] == n[:-1]) & (nxt[:-1] == s[1:]) & (prev[1:] == s[:-1])
    st = np.flatnonzero(np.r_[True, ~on]) if len(a) else np.empty(0, np.int64)
    end = np.r_[st[1:], len(a)].astype(np.int64) - 1
    cols = (a[st], b[st], s[end], prev[st], nxt[end], doc[st], pos[st], (end - st + 1).astype(np.int32), n[st])
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], [c.split()[0] for c in _SPANS.split(", ")])


def _glued(spans: DataFrame) -> DataFrame:
    """Spans that follow on across blocks become one: joins that double the distance to the first."""
    rows = spans.withColumn("own", F.expr("CAST(shiftright(shiftleft(a, 32), 32) AS INT) | 1"))  # as _short has it
    left = rows.where((F.col("pos") + F.col("len")) % BLOCK == 0).select("doc", (F.col("pos") + F.col("len")).alias("pos"), F.col("pos").alias("before"), F.col("n").alias("n0"), F.col("tail").alias("tail0"), F.col("next").alias("next0"))
    follows = rows.where(f"pos % {BLOCK} = 0").join(left, ["doc", "pos"]).where("n = n0 AND next0 = own AND prev = tail0")
    up = stored(follows.select("doc", "pos", "before"), "substr-glue")
    if not up.count():
        return spans.select("a", "b", "doc", "pos", "len")
    while True:
        far = up.select("doc", F.col("pos").alias("before"), F.col("before").alias("further"))
        after = stored(up.join(far, ["doc", "before"], "left").select("doc", "pos", F.coalesce("further", "before").alias("before"), F.col("further").isNotNull().alias("moved")), "substr-glue")
        up = after.drop("moved")
        if not after.where("moved").count():
            break
    first = spans.join(up, ["doc", "pos"], "left").withColumn("head", F.coalesce("before", "pos"))
    whole = first.groupBy("doc", F.col("head").alias("pos")).agg(F.sum("len").cast("int").alias("len"))
    return spans.select("a", "b", "doc", "pos").join(whole, ["doc", "pos"])


def _heads(slices: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a = b["a"].to_numpy().view(np.uint64)
            yield from blob_batches(Bitmap(slices).slice_of(a), [a], slices)

    return run


def _found(bits, slices: int):
    """Where documents hold the first window of a path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            out: list[list[np.ndarray]] = [[np.empty(0, x)] for x in (np.int64, np.int32, np.int64, np.int64, np.int32)]
            for doc, t, start, words in zip(*(batch[c].to_pylist() for c in ("doc_id", "t", "start", "words")), strict=True):
                a, b = windows(words)
                at = np.flatnonzero(Bitmap(slices).has(flags, a, PROBES))
                for o, v in zip(out, (a[at].view(np.int64), b[at].view(np.int32), np.full(len(at), doc, np.int64), np.full(len(at), t, np.int64), (start + at).astype(np.int32)), strict=True):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["a", "b", "doc_id", "t", "start"])

    return run


def _rows(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spans, occurrences): each compacted path with its source (doc, pos, len in windows); each document that
    holds it (doc_id, t, the hash of the row's text, start, and the source)."""
    spark, rows = docs.sparkSession, _rows(docs)
    n = buckets_for(rows, BUCKET_BYTES, 256)
    bits = _bitmap(spark, arrow_map(rows.select("doc_id", "text"), _gather(n), "bucket int, values binary"), n, _several)
    runs = stored(arrow_map(rows, _runs(bits, n), _RUNS), "substr-runs")
    bits.unpersist()
    settle(spark)
    blobs = arrow_map(runs, _counted(n), "bucket int, values binary")
    edges = arrow_map(blobs.repartition("bucket"), _edges, _EDGES)
    parts = edges.repartition("doc", F.floor(F.col("pos") / BLOCK))
    spans = stored(_glued(stored(arrow_map(parts, _compacted, _SPANS), "substr-paths")), "substr-spans")
    settle(spark)
    heads = _bitmap(spark, arrow_map(spans.select("a"), _heads(n), "bucket int, values binary"), n, lambda blobs: together(blobs, [np.uint64])[0])
    starts = arrow_map(runs, _found(heads, n), "a long, b int, doc_id long, t long, start int")
    return spans, starts.join(spans, ["a", "b"])


def removals(docs: DataFrame) -> DataFrame:
    """doc_id, t, cuts: the stretches of words (start, end) that each document gives up."""
    _, found = repeated_spans(docs)
    cut = found.where("doc_id > doc").select("doc_id", "t", F.struct("start", (F.col("start") + F.col("len") + (WINDOW - 1)).alias("end")).alias("cut"))
    return stored(cut.groupBy("doc_id", "t").agg(F.collect_set("cut").alias("cuts")), "substr-cuts")


def kept_words(text: bytes, cuts: list[dict] | None) -> tuple[int, list[bytes]]:
    words = text.split()
    if not cuts:
        return len(words), words
    keep = np.ones(len(words) + 1, bool)
    for c in cuts:
        keep[c["start"] : c["end"]] = False
    return len(words), [w for w, k in zip(words, keep[: len(words)].tolist(), strict=True) if k]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[list] = [[], [], []]
        for text, cuts in zip(bytes_of(b["text"]), b["cuts"].to_pylist(), strict=True):
            n, words = kept_words(text, cuts)
            for o, v in zip(out, (n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest()), strict=True):
                o.append(v)
        yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    rows = _rows(docs).join(removals(docs), ["doc_id", "t"], "left").select("doc_id", "text", "cuts")
    return arrow_map(rows, _digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _texts(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [b" ".join(kept_words(t, c)[1]).decode() if c else None for t, c in zip(bytes_of(b[f"{name}_text"]), b[f"{name}_cuts"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in b.schema.names), pa.array(texts, pa.string())], [*b.schema.names, f"{name}_kept"])

    return run


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents without the words that they give up; texts that lose none stay as they are."""
    name = "passage"
    while any(c.lower().startswith(name) for c in docs.columns):
        name += "_"
    own = lambda c: F.col(f"{name}_{c}")
    marked = docs.withColumn(f"{name}_id", F.col("doc_id").cast("long")).withColumn(f"{name}_text", F.col("text").cast("string")).withColumn(f"{name}_t", F.xxhash64(own("text")))
    cuts = removals(docs).select(F.col("doc_id").alias(f"{name}_id"), F.col("t").alias(f"{name}_t"), F.col("cuts").alias(f"{name}_cuts"))
    rows = marked.join(cuts, [f"{name}_id", f"{name}_t"], "left").select(*docs.columns, F.when(own("cuts").isNotNull(), own("text")).alias(f"{name}_text"), own("cuts"))
    out = arrow_map(rows, _texts(name), rows.select("*", F.lit(None).cast("string").alias(f"{name}_kept")).schema)
    text = F.coalesce(own("kept"), F.col("text").cast("string")).alias("text")
    size = F.when(own("kept").isNotNull(), F.length(own("kept")).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")).alias("n_chars") if "n_chars" in docs.columns else None
    return out.select(*[text if c == "text" else size if c == "n_chars" else F.col(c) for c in docs.columns])


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
n AS (SELECT doc_id, words, len(words)::BIGINT AS n_words FROM w),
k AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS win FROM n, LATERAL UNNEST(range(1, n_words - 11)) AS t(i) WHERE n_words >= 13),
f AS (SELECT win, MIN(doc_id) AS first_doc FROM k GROUP BY win HAVING MIN(doc_id) < MAX(doc_id)),
r AS (SELECT DISTINCT k.doc_id, k.i + j AS spot FROM k JOIN f ON k.win = f.win AND f.first_doc < k.doc_id, LATERAL UNNEST(range(0, 13)) AS t(j)),
x AS (SELECT doc_id, list(spot) AS gone, COUNT(*)::BIGINT AS n_removed FROM r GROUP BY doc_id)
SELECT n.doc_id, n.n_words, COALESCE(x.n_removed, 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN x.gone IS NULL THEN n.words ELSE [y FOR y, i IN n.words IF NOT list_contains(x.gone, i)] END, ' ')) AS kept_sha256
FROM n LEFT JOIN x ON n.doc_id = x.doc_id
"""
