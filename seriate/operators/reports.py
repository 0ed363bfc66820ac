"""Reports over whole corpora, and the helpers that answer one question at a time."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriate.functions import fields, grammar, render
from seriate.operators import reading

#: Seconds that things are kept, by kind, from their last use.
KEPT = {"upload": 6 * 3600, "decisions": 6 * 3600, "library": 30 * 86400}


def parse_text(text: str, **options) -> dict:
    """One statement: its reading, and its fields as they are shown."""
    parsed = grammar.read(text)
    c = fields.convert(parsed, **options)
    shown = [fields.display(f) for f in [c["field_853"], *c["fields_863"]] if f]
    return {"parsed": reading.to_row(parsed), "held": c["held"], "warnings": c["warnings"], "fields": shown, "rendered": render.render(c["field_853"], c["fields_863"]) if shown else None}


def tried(statements: DataFrame, java: str) -> DataFrame:
    """How many statements the expression (of the Java dialect, unanchored) matches whole, in part, or not."""
    text = F.trim("text")
    full, part = text.rlike(rf"(?is)\A(?:{java})\z"), text.rlike(rf"(?is)(?:{java})")
    return statements.where(F.trim("text") != "").agg(F.count("*").alias("total"), F.count_if(full).alias("full"), F.count_if(part & ~full).alias("partial"), F.round(F.coalesce(F.avg(full.cast("double")), F.lit(1.0)), 4).alias("rate"))


def exposure(statements: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """Statements that a pattern (id, Java expression) would find in part only, with the least share of the text found."""
    text = F.trim("text")
    hit = lambda i, rx: F.when(text.rlike(rf"(?is)(?:{rx})") & ~text.rlike(rf"(?is)\A(?:{rx})\z"), F.struct((F.length(F.regexp_extract(text, rf"(?is)({rx})", 0)) / F.length(text)).alias("share"), F.lit(i).alias("pattern")))
    found = F.array_compact(F.array(*[hit(i, rx) for i, rx in patterns]))
    return statements.select("text", F.array_min(found).alias("x")).where("x IS NOT NULL").select("text", F.col("x.pattern").alias("pattern"), F.col("x.share").alias("share"))


def corpus_report(corpus: DataFrame, read: DataFrame) -> DataFrame:
    """Statements and occurrences by declared status and by outcome; read: text, outcome."""
    rows = corpus.join(read.select("text", "outcome").distinct(), "text", "left")
    return rows.groupBy("section", "status", "outcome").agg(F.count("*").alias("statements"), F.sum("times").alias("occurrences"))


def indicator_examples(pages: DataFrame, text: str) -> DataFrame:
    """tag, ind1, ind2 and shape (codes in order) of each holdings field written out in a text."""
    rx = r"(86[345])\s+([34])([0-9# ])((?:\s*[$][a-z0-9]\s*[^$\n<]*)+)"
    found = F.explode(F.regexp_extract_all(F.col(text), F.lit(rx), F.lit(0)))
    rows = pages.where(F.col(text).isNotNull()).select(found.alias("x"))
    part = lambda i: F.regexp_extract("x", rx, i)
    codes = F.array_join(F.regexp_extract_all(part(4), F.lit(r"[$]([a-z0-9])"), F.lit(1)), "")
    return rows.select(part(1).alias("tag"), part(2).alias("ind1"), part(3).alias("ind2"), codes.alias("shape"))


def indicator_crosstab(examples: DataFrame) -> DataFrame:
    """Of each shape, how often each second indicator goes with it, and whether both do."""
    by = examples.groupBy("shape").agg(F.count_if(F.col("ind2") == "0").alias("closed"), F.count_if(F.col("ind2") == "1").alias("open"))
    return by.withColumn("ambiguous", (F.col("closed") > 0) & (F.col("open") > 0))


def alive(kept: DataFrame, now: Column) -> DataFrame:
    """Things (kind, last_used) that haven't outlived their kind's time."""
    ttl = F.coalesce(*[F.when(F.col("kind") == k, F.lit(s)) for k, s in KEPT.items()])
    return kept.where(F.unix_timestamp("last_used") + ttl > F.unix_timestamp(now))


def download_name(identifier: str, number: int) -> str:
    """A file name of a record: its identifier in safe characters, at most 60 of them."""
    return (re.sub(r"[^A-Za-z0-9._-]", "_", identifier.strip())[:60] or f"record-{number}") + ".mrc"


def one_record(records: DataFrame, number: int) -> DataFrame:
    return records.where(F.col("record_index") == number)
