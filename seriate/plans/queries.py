"""Queries of the engine's operators over the shared tables, each with the SQL that must give the same rows.

The tables hold no holdings statements, so statements are built from dates and keys of orders and line items; the
SQL computes the fields from the same columns without reading any statement.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriate.functions import chronology
from seriate.functions.schemas import RECORD_FIELDS
from seriate.operators import decisions, patterns, quality, reading, records, reports

MONTHS = ("Jan.", "Feb.", "Mar.", "Apr.", "May", "June", "July", "Aug.", "Sept.", "Oct.", "Nov.", "Dec.")
_MON = "[" + ", ".join(f"'{m}'" for m in MONTHS) + "]"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with y, m and volume v."""
    o = _table(spark, sf_dir, "orders")
    y, m = F.year("o_orderdate"), F.month("o_orderdate")
    return o.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", y.alias("y"), m.alias("m"), (y - 1900).alias("v"), F.element_at(F.array(*map(F.lit, MONTHS)), m).alias("mon"))


_DATED = f"d AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_orderstatus, year(o_orderdate) AS y, month(o_orderdate) AS m, year(o_orderdate) - 1900 AS v, {_MON}[month(o_orderdate)] AS mon FROM orders)"


def _text(*parts) -> F.Column:
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


def _s(name: str) -> F.Column:
    return F.col(name).cast("string")


def _value(code: str, field: str = "field") -> F.Column:
    return F.get(F.filter(F.col(f"{field}.subfields"), lambda s: s["code"] == code), F.lit(0))["value"]


def _written(statements: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each holdings field of each statement: its values and its break."""
    read = reading.read_statements(statements)
    return read.select(*keys, F.posexplode("converted.fields_863").alias("n", "field")).select(*keys, F.col("n").cast("int").alias("n"), *[_value(c).alias(f"sub_{c}") for c in ("a", "b", "i", "j", "w")])


def read_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _dated(spark, sf_dir).withColumn("text", _text("v.", _s("v"), ":no.", _s("m"), "(", _s("y"), ":", F.col("mon"), ")"))
    return _written(d.select("o_orderkey", "text"), ["o_orderkey"])


READ_UNIT = f"WITH {_DATED} SELECT o_orderkey, 0::INTEGER AS n, v::VARCHAR AS sub_a, m::VARCHAR AS sub_b, y::VARCHAR AS sub_i, lpad(m::VARCHAR, 2, '0') AS sub_j, NULL::VARCHAR AS sub_w FROM d"


def read_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _dated(spark, sf_dir).groupBy("o_custkey").agg(F.min("y").alias("y")).withColumn("text", _text("v.", (F.col("y") - 1900).cast("string"), "(", _s("y"), ")-"))
    return _written(d, ["o_custkey"])


READ_OPEN = f"WITH {_DATED} SELECT o_custkey, 0::INTEGER AS n, (MIN(y) - 1900)::VARCHAR || '-' AS sub_a, NULL::VARCHAR AS sub_b, MIN(y)::VARCHAR || '-' AS sub_i, NULL::VARCHAR AS sub_j, NULL::VARCHAR AS sub_w FROM d GROUP BY o_custkey"


def hierarchy_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _dated(spark, sf_dir).groupBy("o_custkey").agg(F.min(F.struct("y", "m", "mon")).alias("f"), F.max(F.struct("y", "m", "mon")).alias("l"))
    side = lambda c: _text("v.", (F.col(f"{c}.y") - 1900).cast("string"), ":no.", F.col(f"{c}.m").cast("string"), "(", F.col(f"{c}.y").cast("string"), ":", F.col(f"{c}.mon"), ")")
    return _written(d.select("o_custkey", _text(side("f"), "-", side("l")).alias("text")), ["o_custkey"])


_PAIR = "CASE WHEN f.y = l.y AND f.m = l.m THEN {0} WHEN {0} = {1} AND f.y = l.y THEN {0} ELSE {0} || '-' || {1} END"
HIERARCHY_PAIRING = f"""WITH {_DATED}, g AS (SELECT o_custkey, MIN({{'y': y, 'm': m}}) AS f, MAX({{'y': y, 'm': m}}) AS l FROM d GROUP BY o_custkey)
SELECT o_custkey, 0::INTEGER AS n, CASE WHEN f.y = l.y THEN (f.y - 1900)::VARCHAR ELSE (f.y - 1900) || '-' || (l.y - 1900) END AS sub_a,
{_PAIR.format("(f.m)::VARCHAR", "(l.m)::VARCHAR")} AS sub_b, CASE WHEN f.y = l.y THEN f.y::VARCHAR ELSE f.y || '-' || l.y END AS sub_i,
{_PAIR.format("lpad((f.m)::VARCHAR, 2, '0')", "lpad((l.m)::VARCHAR, 2, '0')")} AS sub_j, NULL::VARCHAR AS sub_w FROM g"""


def discontinuous_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _table(spark, sf_dir, "lineitem").where("l_quantity > 20").select("l_orderkey", "l_linenumber").distinct()
    g = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("ns")).where("size(ns) > 1")
    text = _text("v. ", (F.col("l_orderkey") % 40 + 1).cast("string"), " nos. ", F.array_join(F.col("ns").cast("array<string>"), ", "))
    return _written(g.select("l_orderkey", text.alias("text")), ["l_orderkey"]).select("l_orderkey", "n", "sub_a", "sub_b", "sub_w")


DISCONTINUOUS_LIST = """WITH q AS (SELECT DISTINCT l_orderkey, l_linenumber AS k FROM lineitem WHERE l_quantity > 20),
w AS (SELECT *, ROW_NUMBER() OVER o AS r, LEAD(k) OVER o AS nx, COUNT(*) OVER (PARTITION BY l_orderkey) AS c FROM q WINDOW o AS (PARTITION BY l_orderkey ORDER BY k))
SELECT l_orderkey, (r - 1)::INTEGER AS n, (l_orderkey % 40 + 1)::VARCHAR AS sub_a, k::VARCHAR AS sub_b, CASE WHEN nx - k > 1 THEN 'g' END AS sub_w FROM w WHERE c > 1"""


def month_season_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _dated(spark, sf_dir)
    season = F.element_at(F.array(*map(F.lit, ("Spring", "Summer", "Fall", "Winter"))), (F.col("m") % 4 + 1).cast("int"))
    mixed = _text("v.", _s("v"), "(", F.col("mon"), " ", _s("y"), ")-v.", (F.col("v") + 1).cast("string"), "(", season, " ", (F.col("y") + 1).cast("string"), ")")
    plain = _text("v.", _s("v"), "(", season, " ", _s("y"), ")")
    read = reading.read_statements(d.select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, mixed).otherwise(plain).alias("text")))
    return read.select("o_orderkey", reading.outcome(F.col("parsed"), F.col("converted")).alias("outcome"), F.col("converted.switch").alias("switch"), F.get("converted.fields_863", F.lit(0)).alias("field")).select("o_orderkey", "outcome", "switch", _value("j").alias("sub_j"))


MONTH_SEASON_HOLD = f"WITH {_DATED} SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'held' ELSE 'clean' END AS outcome, CASE WHEN o_orderkey % 2 = 0 THEN 'within' END AS switch, CASE WHEN o_orderkey % 2 <> 0 THEN (21 + m % 4)::VARCHAR END AS sub_j FROM d"


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of six shapes by the order's key."""
    d = _dated(spark, sf_dir)
    k = F.col("o_orderkey") % 6
    text = (
        F.when(k == 0, _text("v.", _s("v"), "(", _s("y"), ")"))
        .when(k == 1, _text("v.", _s("v"), ":no.", _s("m"), "(", _s("y"), ":", F.col("mon"), ")"))
        .when(k == 2, _text(_s("y"), "-"))
        .when(k == 3, _text("v.", _s("v"), " Suppl. (", _s("y"), ")"))
        .when(k == 4, _text("? ", _s("m")))
        .otherwise(_text("v. ", _s("v"), " - v. ", (F.col("v") + 3).cast("string"), " no. 3 (", _s("y"), " - Sep ", (F.col("y") + 3).cast("string"), ")"))
    )
    return d.select("o_orderkey", "o_custkey", "v", "y", "m", text.alias("text"))


_K = "o_orderkey % 6"
_SIGNATURE = f"CASE {_K} WHEN 0 THEN 'VOL_CAP|NUMBER|PAREN_OPEN|YEAR|PAREN_CLOSE' WHEN 1 THEN 'VOL_CAP|NUMBER|SEP_COLON|ISS_CAP|NUMBER|PAREN_OPEN|YEAR|SEP_COLON|CHRON|PAREN_CLOSE' WHEN 2 THEN 'YEAR|SEP_HYPHEN' WHEN 3 THEN 'VOL_CAP|NUMBER|UNKNOWN|PAREN_OPEN|YEAR|PAREN_CLOSE' WHEN 4 THEN 'UNKNOWN|NUMBER' ELSE 'VOL_CAP|NUMBER|SEP_HYPHEN|VOL_CAP|NUMBER|ISS_CAP|NUMBER|PAREN_OPEN|YEAR|SEP_HYPHEN|CHRON|YEAR|PAREN_CLOSE' END"


def cluster_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = patterns.clusters(_shapes(spark, sf_dir).select("text", F.col("o_orderkey").alias("pos")))
    return found.select("signature", F.col("count").alias("n"), "match_rate", "declined")


CLUSTER_COUNTS = f"SELECT {_SIGNATURE} AS signature, COUNT(*) AS n, 1.0::DOUBLE AS match_rate, NULL::VARCHAR AS declined FROM orders GROUP BY 1"


def cluster_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = patterns.clusters(_shapes(spark, sf_dir).select("text", F.col("o_orderkey").alias("pos")))
    return found.select("label", F.array_join("groups", ",").alias("groups"), F.col("count").alias("n"))


CLUSTER_LABELS = f"""SELECT CASE {_K} WHEN 0 THEN 'VOL(YEAR)' WHEN 1 THEN 'VOL:ISS(YEAR:CHRON)' WHEN 2 THEN 'YEAR-' WHEN 3 THEN 'VOL ‹Suppl.›(YEAR)' WHEN 4 THEN '‹?› NUM' ELSE 'VOL — VOL ISS(YEAR-CHRON YEAR)' END AS label,
CASE {_K} WHEN 0 THEN 'start_vol,start_year' WHEN 1 THEN 'start_vol,start_iss,start_year,start_month' WHEN 2 THEN 'start_year' WHEN 3 THEN 'start_vol,start_year' WHEN 4 THEN 'start_num' ELSE 'start_vol,end_vol,start_iss,start_year,start_month,end_year' END AS groups, COUNT(*) AS n FROM orders GROUP BY 1, 2"""


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.signed(_shapes(spark, sf_dir).select("o_orderkey", "text")).select("o_orderkey", "signature")


SIGNATURES = f"SELECT o_orderkey, {_SIGNATURE} AS signature FROM orders"


def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = reading.read_statements(_shapes(spark, sf_dir))
    return read.groupBy(reading.outcome(F.col("parsed"), F.col("converted")).alias("outcome")).agg(F.count("*").alias("n"))


_OUTCOME = f"CASE {_K} WHEN 3 THEN 'elsewhere' WHEN 4 THEN 'unread' WHEN 5 THEN 'left_out' ELSE 'clean' END"
OUTCOME_COUNTS = f"SELECT {_OUTCOME} AS outcome, COUNT(*) AS n FROM orders GROUP BY 1"


def review_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = reading.read_statements(_shapes(spark, sf_dir).withColumnRenamed("o_custkey", "record_index"))
    return quality.review(read).withColumn("elsewhere", F.array_join("elsewhere", ","))


REVIEW_INDEX = f"SELECT o_custkey AS record_index, COUNT(*) AS statements, COUNT(*) FILTER ({_K} NOT IN (3, 4)) AS converted, COUNT(*) FILTER ({_K} = 4) AS held, CASE WHEN COUNT(*) FILTER ({_K} = 3) > 0 THEN '867' ELSE '' END AS elsewhere, 0::BIGINT AS flagged, COUNT(*) FILTER ({_K} = 5) AS left_out FROM orders GROUP BY o_custkey"


def log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = reading.read_statements(_shapes(spark, sf_dir).withColumn("record_index", F.col("o_orderkey")))
    return quality.log_rows(read).groupBy("record_index", "what").agg(F.count("*").alias("n"))


LOG_ROWS = f"SELECT o_orderkey AS record_index, CASE {_K} WHEN 3 THEN 'belongs in 867' WHEN 4 THEN 'not converted' ELSE 'converted, part left out' END AS what, CASE WHEN {_K} = 5 THEN 2 ELSE 1 END::BIGINT AS n FROM orders WHERE {_K} >= 3"


def pattern_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda i, rx, n: {"id": i, "label": i, "regex": rx, "priority": n, "roles": [{"group": "start_vol", "boundary": "start", "kind": "enum", "level": 0, "caption": "v."}]}
    library, _ = patterns.load([one("years", r"(?P<start_vol>\d{4})-?", 1), one("volumes", r"v\. ?(?P<start_vol>\d+).*", 0), one("issues", r"v\.(?P<start_vol>\d+):no\..*", 5)])
    found = patterns.apply(_shapes(spark, sf_dir), library, "off")
    return found.groupBy("source").agg(F.count("*").alias("n"))


PATTERN_PRIORITY = f"SELECT CASE {_K} WHEN 1 THEN 'issues' WHEN 2 THEN 'years' WHEN 4 THEN 'unmatched' ELSE 'volumes' END AS source, COUNT(*) AS n FROM orders GROUP BY 1"


def pattern_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    library, _ = patterns.load([{"id": "vol", "label": "", "regex": r"v\.(?P<start_vol>\d+)\((?P<start_year>\d{4})\)", "roles": [{"group": "start_vol", "boundary": "start", "kind": "enum", "level": 0, "caption": "v."}, {"group": "start_year", "boundary": "start", "kind": "year"}]}, {"id": "q", "label": "", "regex": r"\? \d+", "roles": [], "skip": True, "priority": 3}])
    found = patterns.apply(_shapes(spark, sf_dir), library)
    return found.groupBy("source", F.col("parsed.success").alias("success")).agg(F.count("*").alias("n"))


PATTERN_APPLY = f"SELECT CASE {_K} WHEN 0 THEN 'vol' WHEN 4 THEN 'skipped' ELSE 'parser' END AS source, {_K} NOT IN (3, 4) AS success, COUNT(*) AS n FROM orders GROUP BY 1, 2"


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements that only patterns can settle: a list of runs, an uncaptioned end, free text, part of a list, and one with nothing to say."""
    d, k = _dated(spark, sf_dir), F.col("o_orderkey") % 5
    text = (
        F.when(k == 0, _text(_s("v"), " no 3, 4 (", _s("y"), ")"))
        .when(k == 1, _text("? ", _s("v")))
        .when(k == 2, _text("Heft ", _s("v"), " ?"))
        .when(k == 3, _text("? ", _s("v"), ", lost"))
        .otherwise(_text("v.", _s("v"), "(", _s("y"), ")"))
    )
    return d.select("o_orderkey", "v", "y", text.alias("text"))


def pattern_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What patterns add: captions of a list that they are passed over for, readings, wording that goes nowhere, and parts that hold a statement."""
    roles = [{"group": "start_num", "boundary": "start", "kind": "enum", "level": 0, "caption": "v."}]
    raw = [("list", r"(?P<start_num>\d+) no 3, 4 \(\d+\)", False), ("bare", r"\? (?P<start_num>\d+)", True), ("word", r"heft (?P<start_num>\d+) \?", False)]
    library, _ = patterns.load([{"id": i, "label": i, "regex": rx, "roles": roles, "split": split} for i, rx, split in raw])
    found = patterns.apply(_lists(spark, sf_dir), library)
    first = F.get("parsed.ranges", F.lit(0))["start"]["enum"]
    return found.select("o_orderkey", "source", F.size("parsed.ranges").alias("ranges"), F.get(first, F.lit(0))["caption"].alias("caption"), F.col("parsed.needs_review").alias("held"), F.size("parsed.attention").alias("attention"))


PATTERN_READING = """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'parser' WHEN 1 THEN 'bare' WHEN 2 THEN 'word' WHEN 3 THEN 'bare' ELSE 'parser' END AS source,
CASE o_orderkey % 5 WHEN 0 THEN 2 ELSE 1 END::INTEGER AS ranges, 'v.' AS caption, o_orderkey % 5 = 3 AS held, CASE o_orderkey % 5 WHEN 2 THEN 2 WHEN 3 THEN 2 WHEN 1 THEN 1 ELSE 0 END::INTEGER AS attention FROM orders"""


def pattern_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under the strict setting what leaves anything to say is held: a date that is left out, or an unread part."""
    found = patterns.apply(_shapes(spark, sf_dir), [], "strict")
    return found.groupBy((F.col("o_orderkey") % 6).alias("shape"), F.col("parsed.success").alias("success"), F.col("parsed.needs_review").alias("held")).agg(F.count("*").alias("n"))


PATTERN_STRICT = f"SELECT {_K} AS shape, {_K} < 3 AS success, {_K} >= 3 AS held, COUNT(*) AS n FROM orders GROUP BY 1"


def number_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.audit(_shapes(spark, sf_dir))
    return found.select("text", F.size("missing").cast("int").alias("missing"), "trip")


_SHAPE_TEXT = f"CASE {_K} WHEN 0 THEN 'v.' || v || '(' || y || ')' WHEN 1 THEN 'v.' || v || ':no.' || m || '(' || y || ':' || mon || ')' WHEN 2 THEN y || '-' WHEN 3 THEN 'v.' || v || ' Suppl. (' || y || ')' WHEN 4 THEN '? ' || m ELSE 'v. ' || v || ' - v. ' || (v + 3) || ' no. 3 (' || y || ' - Sep ' || (y + 3) || ')' END"
NUMBER_AUDIT = f"WITH {_DATED} SELECT DISTINCT {_SHAPE_TEXT} AS text, 0::INTEGER AS missing, CASE {_K} WHEN 3 THEN 'not converted' WHEN 4 THEN 'not converted' WHEN 5 THEN 'caption only' ELSE 'same' END AS trip FROM d"


def render_866(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _dated(spark, sf_dir).select(_text("vol. ", _s("v"), " no ", _s("m"), " (", F.col("mon"), " ", _s("y"), ")").alias("text"))
    return quality.audit(d).select("text", "rendered")


RENDER_866 = f"WITH {_DATED} SELECT DISTINCT 'vol. ' || v || ' no ' || m || ' (' || mon || ' ' || y || ')' AS text, 'v.' || v || ':no.' || m || '(' || y || ':' || mon || ')' AS rendered FROM d"


def _caption_field(link: str, *subs: tuple[str, str]) -> F.Column:
    """One 853, as a record has it."""
    sub = lambda c, v: F.struct(F.lit(c).alias("code"), F.lit(v).alias("value"))
    return F.struct(F.lit("853").alias("tag"), F.lit("2").alias("ind1"), F.lit("0").alias("ind2"), F.array(sub("8", link), *[sub(c, v) for c, v in subs]).alias("subfields"))


def record_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each priority has captions of its own, so each change of priority opens a run; link 2 is in use."""
    d = _dated(spark, sf_dir)
    words = F.element_at(F.array(*map(F.lit, ("v.", "no.", "pt.", "ser.", ""))), F.substring("o_orderpriority", 1, 1).cast("int"))
    s = d.select(F.col("o_custkey").alias("record_index"), F.col("o_orderkey").cast("int").alias("field_index"), F.trim(_text(words, " ", _s("v"), " (", _s("y"), ")")).alias("text"))
    old = d.select(F.col("o_custkey").alias("record_index")).distinct().withColumn("existing", F.array(_caption_field("2", ("a", "bk."), ("b", "ch."))))
    made = records.convert_records(s, old)
    return made.select(F.col("field_index").cast("long").alias("o_orderkey"), F.col("run").cast("long").alias("run"), F.col("link").cast("int").alias("link"), F.col("first").alias("seq"))


RECORD_RUNS = """WITH c AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderpriority IS DISTINCT FROM LAG(o_orderpriority) OVER w OR ROW_NUMBER() OVER w = 1 THEN 1 ELSE 0 END AS ch FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
r AS (SELECT *, (SUM(ch) OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::BIGINT AS run FROM c)
SELECT o_orderkey, run, (CASE WHEN run >= 2 THEN run + 1 ELSE run END)::INTEGER AS link, (ROW_NUMBER() OVER (PARTITION BY o_custkey, run ORDER BY o_orderkey))::INTEGER AS seq FROM r"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements with one and with two levels, with months, seasons or years alone, take turns."""
    d = _dated(spark, sf_dir)
    k = F.col("o_orderkey") % 4
    text = F.when(k == 3, _text("v.", _s("v"), "(Spring ", _s("y"), ")")).when(k == 1, _text("v.", _s("v"), ":no.", _s("m"), "(", _s("y"), ":", F.col("mon"), ")")).otherwise(_text("v.", _s("v"), "(", _s("y"), ")"))
    return d.select(F.col("o_custkey").alias("record_index"), F.col("o_orderkey").cast("int").alias("field_index"), text.alias("text"))


def _shown(made: DataFrame) -> DataFrame:
    """Of each statement: its run, its field's number, the run's caption field where it is written, and flags."""
    caption = F.array_join(F.transform("field_853.subfields", lambda s: F.concat(F.lit("$"), s["code"], s["value"])), "")
    number = F.get(F.filter(F.get("fields_863", F.lit(0))["subfields"], lambda s: s["code"] == "8"), F.lit(0))["value"]
    return made.select("record_index", F.col("field_index").cast("long").alias("field_index"), F.col("run").cast("long").alias("run"), number.alias("number"), caption.alias("caption"), "merged", "flagged", "held")


def record_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fuller pattern takes the sparser in; months and seasons don't agree and open runs of their own."""
    return _shown(records.convert_records(_turns(spark, sf_dir)))


#: Kinds of date, and the last kind before a statement: what has none agrees with all.
_TURNS = """t AS (SELECT o_custkey AS c, o_orderkey AS o, CASE o_orderkey % 4 WHEN 1 THEN 'month' WHEN 3 THEN 'season' END AS kind FROM orders),
p AS (SELECT *, LAST_VALUE(kind IGNORE NULLS) OVER (PARTITION BY c ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM t)"""
_PATTERN = "CASE {0} WHEN 'month' THEN '$av.$bno.$i(year)$j(month)' WHEN 'season' THEN '$av.$i(year)$j(season)' ELSE '$av.$i(year)' END"
RECORD_FOLD = f"""WITH {_TURNS},
r AS (SELECT *, 1 + (SUM(CASE WHEN kind <> before THEN 1 ELSE 0 END) OVER (PARTITION BY c ORDER BY o))::BIGINT AS run FROM p),
q AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY c, run ORDER BY o) AS seq, MAX(kind) OVER (PARTITION BY c, run) AS whole, MAX(kind) OVER (PARTITION BY c, run ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM r)
SELECT c AS record_index, o AS field_index, run, run || '.' || seq AS number, CASE WHEN seq = 1 THEN '$8' || run || {_PATTERN.format("whole")} END AS caption,
seq > 1 AND kind IS DISTINCT FROM upto AS merged, COALESCE(kind <> before, FALSE) AS flagged, FALSE AS held FROM q"""


def record_fold_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a caption field of their own: one that covers no statement (link 2), or one that covers those with years alone (link 7)."""
    s = _turns(spark, sf_dir)
    k = F.col("record_index") % 3
    own = F.when(k == 1, F.array(_caption_field("2", ("a", "v.")))).when(k == 2, F.array(_caption_field("7", ("a", "v."), ("i", "(year)"))))
    return _shown(records.convert_records(s, s.select("record_index").distinct().withColumn("existing", own)))


RECORD_FOLD_EXISTING = f"""WITH {_TURNS},
m AS (SELECT *, c % 3 AS g, c % 3 = 2 AND kind IS NULL AS own, LAG(kind) OVER w AS prev, ROW_NUMBER() OVER w = 1 AS top FROM p WINDOW w AS (PARTITION BY c ORDER BY o)),
b AS (SELECT *, CASE WHEN own THEN 0 WHEN g = 2 THEN CASE WHEN top OR prev IS NULL OR kind <> prev THEN 1 ELSE 0 END WHEN top OR kind <> before THEN 1 ELSE 0 END AS opens FROM m),
r AS (SELECT *, CASE WHEN own THEN 0 ELSE SUM(opens) OVER (PARTITION BY c ORDER BY o) END AS nth FROM b),
f AS (SELECT *, MIN(o) OVER (PARTITION BY c, nth) AS since FROM r),
n AS (SELECT *, DENSE_RANK() OVER (PARTITION BY c ORDER BY since) AS run, ROW_NUMBER() OVER (PARTITION BY c, nth ORDER BY o) AS seq,
  CASE WHEN own THEN 7 WHEN g = 1 AND nth >= 2 THEN nth + 1 WHEN g = 2 AND nth >= 7 THEN nth + 1 ELSE nth END::BIGINT AS link,
  MAX(kind) OVER (PARTITION BY c, nth) AS whole, MAX(kind) OVER (PARTITION BY c, nth ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM f)
SELECT c AS record_index, o AS field_index, run::BIGINT AS run, link || '.' || seq AS number, CASE WHEN seq = 1 AND NOT own THEN '$8' || link || {_PATTERN.format("whole")} END AS caption,
NOT own AND seq > 1 AND kind IS DISTINCT FROM upto AS merged, COALESCE(kind <> before, FALSE) AS flagged, FALSE AS held FROM n"""


def left_out_refold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements that would lose a month at one end are held, and the rest are numbered as if they weren't there."""
    made = records.convert_records(_shapes(spark, sf_dir).select(F.col("o_custkey").alias("record_index"), F.col("o_orderkey").alias("field_index"), "text").where("o_orderkey % 6 IN (0, 5)"), policy="statement")
    return _shown(made).select("record_index", "field_index", "number", "held")


LEFT_OUT_REFOLD = """WITH k AS (SELECT o_custkey AS record_index, o_orderkey AS field_index, o_orderkey % 6 = 5 AS held FROM orders WHERE o_orderkey % 6 IN (0, 5))
SELECT record_index, field_index, CASE WHEN NOT held THEN '1.' || ROW_NUMBER() OVER (PARTITION BY record_index, held ORDER BY field_index) END AS number, held FROM k"""


def left_out_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of which something would be left out stay as they are."""
    s = _shapes(spark, sf_dir).select(F.col("o_custkey").alias("record_index"), F.col("o_orderkey").alias("field_index"), "text").where("o_orderkey % 6 IN (0, 5)")
    return records.convert_records(s, policy="record").groupBy("record_index", "left_as_uploaded").agg(F.count_if("held").alias("held"), F.sum(F.size("fields_863")).alias("fields"))


LEFT_OUT_RECORDS = """SELECT o_custkey AS record_index, COUNT(*) FILTER (o_orderkey % 6 = 5) > 0 AS left_as_uploaded, CASE WHEN COUNT(*) FILTER (o_orderkey % 6 = 5) > 0 THEN COUNT(*) ELSE 0 END AS held,
(CASE WHEN COUNT(*) FILTER (o_orderkey % 6 = 5) > 0 THEN 0 ELSE COUNT(*) END)::BIGINT AS fields FROM orders WHERE o_orderkey % 6 IN (0, 5) GROUP BY o_custkey"""


def partly_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a statement that can be read in part, that part is written, and the statement is flagged."""
    d = _dated(spark, sf_dir).select("o_orderkey", _text("v. ", _s("v"), " (", _s("y"), "), lacks ", _s("m")).alias("text"))
    read = reading.read_statements(d)
    return read.select("o_orderkey", F.col("converted.held").alias("held"), F.col("converted.flagged").alias("flagged"), F.element_at("parsed.skipped", -1).alias("skipped"), F.get("converted.fields_863", F.lit(0)).alias("field")).select("o_orderkey", "held", "flagged", "skipped", _value("a").alias("sub_a"), _value("i").alias("sub_i"))


PARTLY_READ = f"WITH {_DATED} SELECT o_orderkey, FALSE AS held, TRUE AS flagged, 'lacks ' || m AS skipped, v::VARCHAR AS sub_a, y::VARCHAR AS sub_i FROM d"


def chron_switch_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements with a month, with a season or with a year alone, by status: changes are flagged."""
    d = _dated(spark, sf_dir)
    date = F.when(F.col("o_orderstatus") == "F", _text(F.col("mon"), " ", _s("y"))).when(F.col("o_orderstatus") == "O", _text("Spring ", _s("y"))).otherwise(_s("y"))
    s = d.select(F.col("o_custkey").alias("record_index"), F.col("o_orderkey").cast("int").alias("field_index"), _text("v.", _s("v"), "(", date, ")").alias("text"))
    return records.convert_records(s).select(F.col("field_index").cast("long").alias("o_orderkey"), F.col("flagged").alias("changed"))


CHRON_SWITCH_FLAG = """WITH k AS (SELECT o_orderkey, o_custkey, CASE o_orderstatus WHEN 'F' THEN 'month' WHEN 'O' THEN 'season' END AS kind FROM orders),
b AS (SELECT *, LAST_VALUE(kind IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k)
SELECT o_orderkey, COALESCE(kind <> before, FALSE) AS changed FROM b"""


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as records: number, segment and nation as fields."""
    c = _table(spark, sf_dir, "customer")
    sub = lambda code, v: F.struct(F.lit(code).alias("code"), v.cast("string").alias("value"))
    field = lambda i, tag, data, *subs: F.struct(F.lit(i).alias("pos"), F.lit(tag).alias("tag"), F.lit(" ").alias("ind1"), F.lit(" ").alias("ind2"), (data if data is not None else F.lit(None)).cast("string").alias("data"), (F.array(*subs) if subs else F.array().cast("array<struct<code:string,value:string>>")).alias("subfields"))
    fields = F.array(field(0, "001", F.col("c_custkey")), field(1, "245", None, sub("a", F.col("c_mktsegment"))), field(2, "852", None, sub("b", F.col("c_nationkey"))), field(3, "866", None, sub("a", _text("v.", F.col("c_custkey").cast("string"), "(1990)")))).cast(RECORD_FIELDS)
    leader = F.concat(F.lit("00000cy  a2200000"), (F.col("c_custkey") % 5).cast("string"), F.lit("n  4500"))
    return c.select(F.col("c_custkey").alias("record_index"), leader.alias("leader"), fields.alias("fields"), F.lit(False).alias("unreadable"))


def identifier_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.identifier_candidates(_customers(spark, sf_dir)).select("key", "present", "distinct", "repeats", "unique")


IDENTIFIER_PROFILE = """WITH f AS (SELECT '001' AS key, c_custkey::VARCHAR AS value FROM customer UNION ALL SELECT '245$a', c_mktsegment FROM customer UNION ALL SELECT '852$b', c_nationkey::VARCHAR FROM customer)
SELECT key, COUNT(*) AS present, COUNT(DISTINCT value) AS "distinct", 1::BIGINT AS repeats, COUNT(*) = COUNT(DISTINCT value) AS "unique" FROM f GROUP BY key HAVING COUNT(DISTINCT value) >= 2"""


def record_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.summary(_customers(spark, sf_dir), "001").select("record_index", "title", "identifier", "location", F.array_join("statements", ";").alias("statements"), "has_853", "has_863")


RECORD_SUMMARY = "SELECT c_custkey AS record_index, c_mktsegment AS title, c_custkey::VARCHAR AS identifier, c_nationkey::VARCHAR AS location, 'v.' || c_custkey || '(1990)' AS statements, FALSE AS has_853, FALSE AS has_863 FROM customer"


def encoding_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.encoding_levels(_customers(spark, sf_dir))


ENCODING_LEVELS = "SELECT (c_custkey % 5)::VARCHAR AS level, COUNT(*) AS n FROM customer GROUP BY 1"


def records_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of each record after its statement was replaced by what it says."""
    r = _customers(spark, sf_dir)
    s = records.statements(r)
    made = records.convert_records(s.select("record_index", F.col("field_index").cast("int").alias("field_index"), "text"), records.existing_853s(r))
    out = records.apply(r, made, remove_866=True)
    shown = F.array_join(F.transform("fields", lambda f: F.when(f["tag"] >= "850", F.concat(f["tag"], F.lit(" "), F.array_join(F.transform(f["subfields"], lambda s: F.concat(F.lit("$"), s["code"], s["value"])), ""))).otherwise(f["tag"])), ";")
    return out.select("record_index", shown.alias("shown"))


RECORDS_REWRITTEN = "SELECT c_custkey AS record_index, '001;245;852 $b' || c_nationkey || ';853 $81$av.$i(year);863 $81.1$a' || c_custkey || '$i1990' AS shown FROM customer"


def elsewhere_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where texts belong by their words, by the operator's own native expression."""
    d = _table(spark, sf_dir, "documents")
    return d.select("doc_id", reading.elsewhere(F.coalesce("text", F.lit(""))).alias("belongs_in"))


ELSEWHERE_FLAGS = r"""WITH t AS (SELECT doc_id, regexp_replace(COALESCE(text, ''), '\{[^{}]*\}?', ' ', 'g') AS text FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)(^|[^a-z])(index|indexes|indices)([^a-z]|$)') THEN '868'
WHEN regexp_matches(text, '(?i)(^|[^a-z])(suppls?|supplements?|supplementary|special\s+(issue|iss|number|no|edition|ed)\.?)([^a-z]|$)') THEN '867' END AS belongs_in FROM t"""


def chron_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _dated(spark, sf_dir).select("mon", "m", F.col("y").cast("long").alias("y")).distinct()
    code = chronology.code_column(F.col("mon"))
    short = F.concat(F.col("y").cast("string"), F.lit("/"), F.substring((F.col("y") + 1).cast("string"), 3, 2))
    return d.select("mon", "y", code.alias("code"), chronology.name_column(code).alias("name"), chronology.house_column(F.concat(code, F.lit("-12"))).alias("house"), chronology.codeable_column("month", code).alias("codeable"), chronology.full_year_column(short).alias("years"))


CHRON_CODES = f"WITH {_DATED} SELECT DISTINCT mon, y, lpad(m::VARCHAR, 2, '0') AS code, ['January','February','March','April','May','June','July','August','September','October','November','December'][m] AS name, ['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][m] || '-Dec' AS house, TRUE AS codeable, y || '/' || (y + 1) AS years FROM d"


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").cast("long").alias("record_index"), F.lit(0).alias("field_index"), F.col("n_name").alias("text"), F.lit(None).cast("string").alias("z"), F.lit(None).cast("string").alias("x"))


def edit_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _nations(spark, sf_dir)
    edits = s.where("record_index % 3 = 0").select("record_index", "field_index", F.lit("a").alias("code"), F.concat(F.lit("v."), _s("record_index")).alias("value"))
    out = decisions.edited(s, edits)
    return out.select("record_index", "text", "edited")


EDIT_OVERLAY = "SELECT n_nationkey::BIGINT AS record_index, CASE WHEN n_nationkey % 3 = 0 THEN 'v.' || n_nationkey ELSE n_name END AS text, n_nationkey % 3 = 0 AS edited FROM nation"


def split_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _nations(spark, sf_dir)
    parts = s.where("record_index % 4 = 1").select("record_index", "field_index", F.array(F.substring("text", 1, 2), F.substring("text", 3, 2)).alias("parts"))
    return decisions.split(s, parts).select("record_index", "text", "split_part")


SPLIT_OVERLAY = "SELECT n_nationkey::BIGINT AS record_index, n_name AS text, NULL::INTEGER AS split_part FROM nation WHERE n_nationkey % 4 <> 1 UNION ALL SELECT n_nationkey::BIGINT, substr(n_name, 1, 2), 0 FROM nation WHERE n_nationkey % 4 = 1 UNION ALL SELECT n_nationkey::BIGINT, substr(n_name, 3, 2), 1 FROM nation WHERE n_nationkey % 4 = 1"


def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return quality.page(quality.search(c, "BUILD", ["c_mktsegment"]), ["c_custkey"], 1, 10)


SEARCH_PAGE = "SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) LIKE '%build%' ORDER BY c_custkey LIMIT 10 OFFSET 10"


def origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _shapes(spark, sf_dir).select(F.col("o_custkey").alias("record_index"), F.col("o_orderkey").alias("field_index"), "text")
    return decisions.origins(s).select("text", F.col("first.record_index").alias("first_record"), F.col("first.field_index").alias("first_field"), "times", "records")


ORIGINS = f"WITH {_DATED}, t AS (SELECT o_custkey AS r, o_orderkey AS f, {_SHAPE_TEXT} AS text FROM d) SELECT text, MIN({{'r': r, 'f': f}}).r AS first_record, MIN({{'r': r, 'f': f}}).f AS first_field, COUNT(*) AS times, COUNT(DISTINCT r) AS records FROM t GROUP BY text"


def left_out_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = reading.read_statements(_shapes(spark, sf_dir)).select("o_orderkey", F.col("o_custkey").alias("record_index"), F.col("converted.warnings").alias("warnings"))
    return decisions.under_policy(read, "record").select("o_orderkey", "hold")


LEFT_OUT_POLICY = f"WITH b AS (SELECT DISTINCT o_custkey FROM orders WHERE {_K} = 5) SELECT o_orderkey, b.o_custkey IS NOT NULL AS hold FROM orders LEFT JOIN b USING (o_custkey)"

def tested_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.tried(_shapes(spark, sf_dir), r"v\.\d+\(\d{4}\)|v\.\d+")


TESTED_PATTERN = f"SELECT COUNT(*) AS total, COUNT(*) FILTER ({_K} = 0) AS \"full\", COUNT(*) FILTER ({_K} IN (1, 3)) AS partial, round(avg(CASE WHEN {_K} = 0 THEN 1.0::DOUBLE ELSE 0.0 END), 4) AS rate FROM orders"


def kept_things(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, "upload").otherwise("library").alias("kind"), F.col("ts").alias("last_used"))
    last = e.agg(F.max("last_used").alias("now"))  # one row
    return reports.alive(e.join(F.broadcast(last)), F.col("now")).groupBy("kind").agg(F.count("*").alias("n"))


KEPT_THINGS = """WITH e AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'upload' ELSE 'library' END AS kind, ts FROM events), m AS (SELECT MAX(ts) AS now FROM e)
SELECT kind, COUNT(*) AS n FROM e, m WHERE floor(epoch(ts)) + CASE kind WHEN 'upload' THEN 21600 ELSE 2592000 END > floor(epoch(now)) GROUP BY kind"""


def indicator_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields written out in generated pages: closed and open ones of two shapes."""
    d = _dated(spark, sf_dir)
    closed = F.when(F.col("m") > 6, _text("863 40 $8 1.1 $a ", _s("v"), "-", _s("m"), " $i ", _s("y"))).otherwise(_text("863 41 $8 1.1 $a ", _s("v")))
    page = d.select(_text("see ", closed, "\nand 863 41 $8 1.2 $a ", _s("m"), " $i ", _s("y"), "\n").alias("page"))
    return reports.indicator_crosstab(reports.indicator_examples(page, "page"))


INDICATOR_CROSSTAB = """WITH d AS (SELECT month(o_orderdate) AS m FROM orders)
SELECT '8ai' AS shape, COUNT(*) FILTER (m > 6) AS closed, COUNT(*) AS open, COUNT(*) FILTER (m > 6) > 0 AS ambiguous FROM d UNION ALL SELECT '8a', 0::BIGINT, COUNT(*) FILTER (m <= 6), FALSE FROM d"""


def partial_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.exposure(_shapes(spark, sf_dir), [("year", r"\d{4}"), ("volume", r"v\.\d+")])
    return found.groupBy("pattern").agg(F.count("*").alias("n"))


PARTIAL_EXPOSURE = f"WITH {_DATED} SELECT CASE WHEN {_K} IN (2, 5) OR v > 99 THEN 'year' ELSE 'volume' END AS pattern, COUNT(*) AS n FROM d WHERE {_K} <> 4 GROUP BY 1"

_ALL = (
    ("tested_pattern", tested_pattern, TESTED_PATTERN),
    ("kept_things", kept_things, KEPT_THINGS),
    ("indicator_crosstab", indicator_crosstab, INDICATOR_CROSSTAB),
    ("partial_exposure", partial_exposure, PARTIAL_EXPOSURE),
    ("read_unit", read_unit, READ_UNIT),
    ("read_open", read_open, READ_OPEN),
    ("hierarchy_pairing", hierarchy_pairing, HIERARCHY_PAIRING),
    ("discontinuous_list", discontinuous_list, DISCONTINUOUS_LIST),
    ("month_season_hold", month_season_hold, MONTH_SEASON_HOLD),
    ("cluster_counts", cluster_counts, CLUSTER_COUNTS),
    ("cluster_labels", cluster_labels, CLUSTER_LABELS),
    ("signatures", signatures, SIGNATURES),
    ("outcome_counts", outcome_counts, OUTCOME_COUNTS),
    ("review_index", review_index, REVIEW_INDEX),
    ("log_rows", log_rows, LOG_ROWS),
    ("pattern_priority", pattern_priority, PATTERN_PRIORITY),
    ("pattern_apply", pattern_apply, PATTERN_APPLY),
    ("pattern_reading", pattern_reading, PATTERN_READING),
    ("pattern_strict", pattern_strict, PATTERN_STRICT),
    ("number_audit", number_audit, NUMBER_AUDIT),
    ("render_866", render_866, RENDER_866),
    ("record_runs", record_runs, RECORD_RUNS),
    ("record_fold", record_fold, RECORD_FOLD),
    ("record_fold_existing", record_fold_existing, RECORD_FOLD_EXISTING),
    ("left_out_refold", left_out_refold, LEFT_OUT_REFOLD),
    ("left_out_records", left_out_records, LEFT_OUT_RECORDS),
    ("partly_read", partly_read, PARTLY_READ),
    ("chron_switch_flag", chron_switch_flag, CHRON_SWITCH_FLAG),
    ("identifier_profile", identifier_profile, IDENTIFIER_PROFILE),
    ("record_summary", record_summary, RECORD_SUMMARY),
    ("encoding_levels", encoding_levels, ENCODING_LEVELS),
    ("records_rewritten", records_rewritten, RECORDS_REWRITTEN),
    ("elsewhere_flags", elsewhere_flags, ELSEWHERE_FLAGS),
    ("chron_codes", chron_codes, CHRON_CODES),
    ("edit_overlay", edit_overlay, EDIT_OVERLAY),
    ("split_overlay", split_overlay, SPLIT_OVERLAY),
    ("search_page", search_page, SEARCH_PAGE),
    ("origins", origins, ORIGINS),
    ("left_out_policy", left_out_policy, LEFT_OUT_POLICY),
)
QUERIES = {name: f for name, f, _ in _ALL}
ORACLES = {name: sql for name, _, sql in _ALL}
