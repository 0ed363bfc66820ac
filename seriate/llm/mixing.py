"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only.

Each document has a hash that depends on its id, and behind that on its text. A source whose target is r times its
size takes each document floor(r) times, and once more those whose hash lies below a threshold. The threshold is
found by summing words in 4096 hash buckets for each source; only the bucket in which the budget ends is refined,
twice by 12 and 8 further bits, and three times more by the text's bits if several rows share the id's. Of equal
rows that share the last value as many are taken as come nearest to the budget. Thresholds of smaller budgets are
nested in those of larger ones. No documents are sorted, and a source with a third of all rows is pre-aggregated
before its sums are shuffled. Sources themselves are put in order in one task: one row for each.

Defined results: a null text has size 0; a null source is a source, last in order; rows with the same or a null
doc_id are told apart by their texts, and rows with the same id and text are taken by number (which of them is
not defined, nor does it matter); sources of size 0 have target 0; an empty table gives no rows; other columns are
not read, and keep their names, values and types in mixed_documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriate.llm.common import WORD, stored, with_hint

WEIGHTS = (1, 2, 3)
MOST = 3
#: Bits of the levels of the histogram: 32 of the id's hash, then 31 of the text's.
LEVELS = (12, 12, 8, 12, 12, 7)
TEXT_BITS = 31


def n_words(text: Column) -> Column:
    """Words of a text: one character for each word is left when all else goes."""
    return F.coalesce(F.length(F.regexp_replace(F.regexp_replace(text, WORD, "w"), r"[\x20\x09-\x0D]+", "")), F.lit(0)).cast("long")


def hashed(doc_id: Column) -> Column:
    """32 bits of the MD5 of the id, the same in every engine."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size -> target: shares by weight, none above most times its size.

    The shares level off at caps: sorted by cap over weight, the caps that bind come first, and the level is
    what is left over the weights that are left, at the first source whose cap doesn't bind. There is one row for each source, so the window is small.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("long")
    s = sources.withColumn("weight", w).withColumn("cap", F.col("source_size") * most)
    by_cap = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    s = s.withColumn("level", level)
    s = s.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything))
    return s.select("source", "source_size", F.least(F.col("level") * F.col("weight"), F.col("cap").cast("double")).alias("target"))


def key_of(doc_id: Column, text: Column) -> Column:
    """63 bits: the id's hash (the text's where there is no id), then the text's."""
    return hashed(F.coalesce(doc_id.cast("string"), text)) * F.lit(1 << TEXT_BITS) + F.xxhash64(text).bitwiseAND(F.lit((1 << TEXT_BITS) - 1))


def thresholds(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size, u) of each document, and for each source its target, whole copies and threshold.

    Rows below the threshold are taken once more, and of those at it the first `some`.
    """
    text = F.col("text").cast("string")
    sized = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(text).alias("size"), key_of(F.col("doc_id").cast("long"), text).alias("u")), "mixing-sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = stored(targets(sources, weights, most), "mixing-targets")
    s = s.withColumn("whole", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(F.lit(0)).cast("long"))
    # words that the threshold must still bring, and the words below the part of the hashes being refined
    zero = F.lit(0).cast("long")
    s = s.select("*", (F.col("target") - F.col("whole") * F.col("source_size")).alias("need"), zero.alias("below"), zero.alias("prefix"))
    rows, left = sized.where("size > 0"), sum(LEVELS)
    for level, bits in enumerate(LEVELS):
        edge = with_hint(s.select(F.col("source").alias("b_source"), "prefix", "below", "need"), 100_000)
        inside = F.col("b_source").eqNullSafe(F.col("source")) & (F.shiftright("u", left) == F.col("prefix"))
        left -= bits
        sums = rows.join(edge, inside).groupBy("source", F.shiftright("u", left).alias("bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("rows"), F.first("below").alias("below0"), F.first("need").alias("need0"))
        ordered = Window.partitionBy("source").orderBy("bucket")  # 4096 buckets at most
        sums = sums.withColumn("upto", F.col("below0") + F.sum("words").over(ordered))
        crossing = sums.where(F.col("upto") > F.col("need0")).groupBy("source").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("below"), "words", "rows")).alias("at")).select(F.col("source").alias("b_source"), "at")
        s = s.join(crossing, F.col("b_source").eqNullSafe(F.col("source")), "left")
        # no crossing: the budget takes all
        s = s.select("source", "source_size", "target", "whole", "need", F.coalesce("at.below", "below").alias("below"), F.coalesce(F.col("at.bucket"), F.shiftleft(F.col("prefix") + 1, bits)).alias("prefix"), F.coalesce("at.words", zero).alias("words"), F.coalesce("at.rows", zero).alias("rows"))
        s = stored(s, f"mixing-edges{level}")
        if left <= TEXT_BITS and s.where("rows > 1").isEmpty():
            break
    # rows of the last bucket have one size; as many are taken as come nearest to the target
    taken = F.when(F.col("rows") > 0, F.floor((F.col("need") - F.col("below")) * F.col("rows") / F.col("words") + 0.5)).otherwise(0).cast("long")
    s = s.withColumn("some", F.least(taken, F.col("rows")))
    every = (F.col("some") > 0) & (F.col("some") == F.col("rows"))
    threshold = F.shiftleft(F.col("prefix") + every.cast("long"), left)
    return sized, s.select(F.col("source").alias("b_source"), "source_size", "target", "whole", threshold.alias("threshold"), F.when(every, 0).otherwise(F.col("some")).cast("long").alias("some"))


def _numbered(rows: DataFrame, source: str, name: str) -> DataFrame:
    """Stored rows with a number from 1 on within their source: by file and place, so that no task gets them all."""
    placed = rows.select("*", F.col("_metadata.file_path").alias(f"{name}_file"), F.col("_metadata.row_index").alias(f"{name}_row"))
    counts = placed.groupBy(F.col(source).alias(f"{name}_of"), F.col(f"{name}_file").alias(f"{name}_in")).agg(F.count("*").alias(f"{name}_n"))
    before = Window.partitionBy(f"{name}_of").orderBy(f"{name}_in").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn(f"{name}_before", F.coalesce(F.sum(f"{name}_n").over(before), F.lit(0)))
    own = F.row_number().over(Window.partitionBy(source, f"{name}_file").orderBy(f"{name}_row"))
    same = F.col(f"{name}_of").eqNullSafe(F.col(source)) & (F.col(f"{name}_in") == F.col(f"{name}_file"))
    return placed.withColumn(f"{name}_own", own).join(counts, same).withColumn(f"{name}_number", F.col(f"{name}_own") + F.col(f"{name}_before"))


def _copies(rows: DataFrame, s: DataFrame, source: str, u: str, name: str) -> DataFrame:
    """rows with the columns of s (all renamed to begin with name) and, as name_copies, how often each is taken."""
    s = s.select(*[F.col(c).alias(f"{name}_{c}") for c in s.columns])
    joined = rows.join(with_hint(s, 100_000), F.col(f"{name}_b_source").eqNullSafe(F.col(source)))
    whole, at = F.col(f"{name}_whole"), F.col(u) == F.col(f"{name}_threshold")
    out = joined.withColumn(f"{name}_copies", whole + (F.col(u) < F.col(f"{name}_threshold")).cast("long"))
    if s.where(f"{name}_some > 0").isEmpty():
        return out
    equal = stored(out.where((F.col(f"{name}_some") > 0) & at), "mixing-equal")
    more = (F.col(f"{name}_number") <= F.col(f"{name}_some")).cast("long")
    numbered = _numbered(equal, f"{name}_b_source", name).withColumn(f"{name}_copies", whole + more).select(*out.columns)
    return out.where((F.col(f"{name}_some") == 0) | ~at).unionByName(numbered)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document, and the number of copies."""
    sized, s = thresholds(docs, weights, most)
    out = _copies(sized, s, "source", "u", "mix")
    return out.select("doc_id", "size", F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_copies").alias("copies"), (F.col("mix_copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of docs."""
    _, s = thresholds(docs, weights, most)
    name = "mix"
    while any(c.lower().startswith(name) for c in docs.columns):
        name += "_"
    rows = docs.withColumns({f"{name}_u": key_of(F.col("doc_id").cast("long"), F.col("text").cast("string")), f"{name}_source": F.col("source").cast("string")})
    out = _copies(rows, s, f"{name}_source", f"{name}_u", name)
    copy = F.explode(F.sequence(F.lit(1), F.col(f"{name}_copies").cast("int"))).alias(f"{name}_copy")
    return out.where(F.col(f"{name}_copies") > 0).select(*docs.columns, copy).select(*docs.columns)


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(COALESCE(doc_id::VARCHAR, text, '')), 1, 8))::BIGINT AS u
  FROM documents),
src AS (SELECT source, SUM(size)::BIGINT AS source_size FROM sized GROUP BY source),
wt AS (SELECT *, ((ROW_NUMBER() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM src),
lv AS (SELECT *, 3 * source_size AS cap,
  ((SUM(source_size) OVER ())::BIGINT - COALESCE(SUM(3 * source_size) OVER w, 0)::BIGINT)::DOUBLE
  / ((SUM(weight) OVER ())::BIGINT - COALESCE(SUM(weight) OVER w, 0)::BIGINT)::DOUBLE AS level
  FROM wt WINDOW w AS (ORDER BY (3 * source_size)::DOUBLE / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
one AS (SELECT MAX(level) AS level FROM lv WHERE level * weight <= cap),
tg AS (SELECT source, source_size, LEAST(one.level * weight, cap::DOUBLE) AS target FROM lv, one),
wh AS (SELECT *, CASE WHEN source_size > 0 THEN LEAST(FLOOR(target / source_size), 3)::BIGINT ELSE 0 END AS whole FROM tg),
nd AS (SELECT *, target - whole * source_size AS need FROM wh),
g AS (SELECT s.source, s.u, SUM(s.size)::BIGINT AS words FROM sized s WHERE s.size > 0 GROUP BY s.source, s.u),
c AS (SELECT g.*, nd.need, (SUM(words) OVER (PARTITION BY g.source ORDER BY g.u))::BIGINT AS upto
  FROM g JOIN nd ON g.source IS NOT DISTINCT FROM nd.source),
x AS (SELECT source, MIN(u) AS u FROM c WHERE upto > need GROUP BY source),
th AS (SELECT nd.source, CASE WHEN x.u IS NULL THEN 4294967296
    WHEN c.need - (c.upto - c.words) >= c.upto - c.need THEN x.u + 1 ELSE x.u END AS threshold
  FROM nd LEFT JOIN x ON nd.source IS NOT DISTINCT FROM x.source
  LEFT JOIN c ON c.source IS NOT DISTINCT FROM x.source AND c.u = x.u)
SELECT s.doc_id, s.size, nd.source_size, nd.target,
  (nd.whole + CASE WHEN s.u < th.threshold THEN 1 ELSE 0 END)::BIGINT AS copies,
  ((nd.whole + CASE WHEN s.u < th.threshold THEN 1 ELSE 0 END) * s.size)::BIGINT AS taken
FROM sized s JOIN nd ON s.source IS NOT DISTINCT FROM nd.source JOIN th ON s.source IS NOT DISTINCT FROM th.source
"""
