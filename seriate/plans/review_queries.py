"""Queries of review, sessions and reports, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriate.functions.schemas import RECORD_FIELDS
from seriate.operators import decisions, patterns, quality, reading, records, reports, review, sessions
from seriate.plans.queries import _DATED, _K, _SHAPE_TEXT, _SIGNATURE, _customers, _dated, _s, _shapes, _table, _text


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six shapes as statements of customers' records, read."""
    s = _shapes(spark, sf_dir).select(F.col("o_custkey").alias("record_index"), F.col("o_orderkey").cast("int").alias("field_index"), F.col("o_orderkey"), "text")
    return reading.read_statements(s)


def cluster_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups with what confirming decides and how their statements come out."""
    s = _statements(spark, sf_dir)
    s = s.join(patterns.signed(s.select("text").distinct()), "text")
    found = patterns.clusters(s.select("text", F.col("o_orderkey").alias("pos")))
    return review.annotated(found, s).select("signature", F.col("count").alias("n"), "decides", "held", "to_check", "left_out", "unread", "belongs_in", "records")


CLUSTER_OUTCOMES = f"""SELECT {_SIGNATURE} AS signature, COUNT(*) AS n, CASE {_K} WHEN 3 THEN 'elsewhere' WHEN 4 THEN 'reading' ELSE 'nothing' END AS decides, 0::BIGINT AS held, 0::BIGINT AS to_check,
COUNT(*) FILTER ({_K} = 5) AS left_out, COUNT(*) FILTER ({_K} = 4) AS unread, CASE WHEN {_K} = 3 THEN '867' END AS belongs_in, COUNT(DISTINCT o_custkey) AS records FROM orders GROUP BY {_K}"""


def to_look_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 texts that want a look, by where they come first."""
    found = review.to_look_at(_statements(spark, sf_dir))
    return found.select("text", F.array_join("kinds", ",").alias("kinds"), F.col("first.record_index").alias("record_index"), F.col("first.field_index").cast("long").alias("field_index"), "records")


TO_LOOK_AT = f"""WITH {_DATED}, t AS (SELECT o_custkey AS r, o_orderkey AS f, {_SHAPE_TEXT} AS text, {_K} AS k FROM d WHERE {_K} IN (4, 5)),
g AS (SELECT text, CASE MIN(k) WHEN 4 THEN 'unread' ELSE 'left_out' END AS kinds, MIN({{'r': r, 'f': f}}) AS x, COUNT(DISTINCT r) AS records FROM t GROUP BY text)
SELECT text, kinds, x.r AS record_index, x.f AS field_index, records FROM g ORDER BY x, text LIMIT 200"""


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as if they were groups of patterns, in all states that a group can have."""
    k = F.col("p_partkey")
    return _table(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), k.cast("string")).alias("pattern_id"),
        F.when(k % 11 == 0, "41 tokens").alias("declined"),
        F.when(k % 11 != 0, "v").alias("regex"),
        F.element_at(F.array(*map(F.lit, ("nothing", "elsewhere", "caption", "reading"))), (k % 4 + 1).cast("int")).alias("decides"),
        *[F.when(k % m == 0, 1).otherwise(0).alias(c) for m, c in ((5, "unread"), (6, "held"), (9, "to_check"), (10, "left_out"))],
        (k % 7 == 0).alias("confirmed"),
        (k % 13 == 0).alias("skipped"),
        (k % 3 == 0).alias("open_roles"),
    )


_GROUPS = """g AS (SELECT 'p' || p_partkey AS pattern_id, p_partkey % 11 = 0 AS complex, ['nothing', 'elsewhere', 'caption', 'reading'][p_partkey % 4 + 1] AS decides, p_partkey % 5 = 0 AS unread,
p_partkey % 6 = 0 AS held, p_partkey % 9 = 0 AS to_check, p_partkey % 10 = 0 AS left_out, p_partkey % 7 = 0 AS confirmed, p_partkey % 13 = 0 AS skipped, p_partkey % 3 = 0 AS open_roles FROM part)"""


def pattern_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _groups(spark, sf_dir)
    both = review.partition(g).withColumn("mode", F.lit("file")).unionByName(review.partition(g, pasted=True).withColumn("mode", F.lit("paste")))
    return both.groupBy("mode", "part").agg(F.count("*").alias("n"))


_PART = """CASE WHEN skipped THEN 'skipped' WHEN decides <> 'elsewhere' AND {look} AND NOT (NOT confirmed AND NOT complex AND decides NOT IN ('nothing', 'elsewhere')) THEN 'attention'
WHEN complex THEN 'complex' WHEN confirmed THEN 'confirmed' WHEN decides = 'nothing' THEN 'readable' WHEN decides = 'elsewhere' THEN 'elsewhere' ELSE 'open' END"""
PATTERN_PARTITION = f"WITH {_GROUPS} SELECT 'file' AS mode, {_PART.format(look='unread')} AS part, COUNT(*) AS n FROM g GROUP BY 2 UNION ALL SELECT 'paste', {_PART.format(look='(held OR to_check)')}, COUNT(*) FROM g GROUP BY 2"


def auto_confirm(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _groups(spark, sf_dir)
    return review.to_confirm(g, g.where("confirmed"), g.where("left_out = 1")).select("pattern_id", "decides")


AUTO_CONFIRM = f"WITH {_GROUPS} SELECT pattern_id, decides FROM g WHERE NOT complex AND decides NOT IN ('reading', 'elsewhere') AND NOT open_roles AND NOT confirmed AND NOT left_out"


def outcome_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.outcome_totals(_groups(spark, sf_dir).where("NOT skipped"))


OUTCOME_TOTALS = f"WITH {_GROUPS} SELECT COUNT(*) FILTER (held) AS held, COUNT(*) FILTER (to_check) AS to_check, COUNT(*) FILTER (left_out) AS left_out FROM g WHERE NOT skipped"


def _field(tag: str, *subs: tuple[str, object], data=None) -> F.Column:
    value = lambda v: v if isinstance(v, F.Column) else F.lit(v)
    made = F.array(*[F.struct(F.lit(c).alias("code"), value(v).cast("string").alias("value")) for c, v in subs]) if subs else F.array().cast("array<struct<code: string, value: string>>")
    return F.struct(F.lit(0).alias("pos"), F.lit(tag).alias("tag"), F.lit(" ").alias("ind1"), F.lit("0").alias("ind2"), (F.lit(None) if data is None else data).cast("string").alias("data"), made.alias("subfields"))


def _file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as records of a file: with two statements, and some with holdings fields, odd caption fields or declared levels."""
    c, k = _table(spark, sf_dir, "customer"), F.col("c_custkey")
    one = F.when(k % 4 == 0, _text("v. ", k.cast("string"), " Suppl. (1990)")).when(k % 4 == 1, _text("? ", k.cast("string"))).otherwise(_text("v.", k.cast("string"), "(1990)"))
    two = F.when(k % 3 == 0, _text("v. ", (k + 1).cast("string"), " - v. ", (k + 4).cast("string"), " no. 3 (1991 - Sep 1994)")).otherwise(_text("v.", (k + 1).cast("string"), "(1991)"))
    own = F.when(k % 10 == 7, F.array(_field("853", ("8", "1"), ("a", "v."), ("i", "(year)")).withField("ind1", F.lit("2")), _field("863", ("8", "1.1"), ("a", "1"), ("i", "1980")))).otherwise(F.array().cast(RECORD_FIELDS))
    odd = F.when(k % 10 == 8, F.array(_field("853", ("8", "3"), ("a", "bk.")).withField("ind1", F.lit("7")))).otherwise(F.array().cast(RECORD_FIELDS))
    fields = F.concat(F.array(_field("001", data=k), _field("245", ("a", F.col("c_mktsegment"))), _field("852", ("b", F.col("c_nationkey")))).cast(RECORD_FIELDS), own.cast(RECORD_FIELDS), odd.cast(RECORD_FIELDS), F.array(_field("866", ("a", one), ("z", "note")), _field("866", ("a", two))).cast(RECORD_FIELDS))
    leader = F.concat(F.lit("00000c"), F.when(k % 5 == 0, "x").otherwise("y"), F.lit("  a2200000"), F.element_at(F.array(F.lit("3"), F.lit("4"), F.lit("u")), (k % 3 + 1).cast("int")), F.lit("n  4500"))
    return c.select(F.lit("f").alias("file"), k.alias("record_index"), leader.alias("leader"), fields.alias("fields"), F.lit(False).alias("unreadable"))


def _rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    r = _file(spark, sf_dir)
    s = records.statements(r)
    made = records.convert_records(s, records.existing_853s(r))
    skipped = r.where("record_index % 9 = 2").select("record_index")
    return r, made, review.rows(r, made, reading.read_statements(s), spec="001", skipped=skipped)


#: Of each record of _file: what its two statements come to, and what stops it from being converted.
_FILE = """c AS (SELECT c_custkey AS k, c_mktsegment AS seg, c_nationkey AS nation, c_custkey % 10 = 7 AS kept, c_custkey % 9 = 2 AS skipped, c_custkey % 4 = 0 AS supplement, c_custkey % 4 = 1 AS unread,
c_custkey % 3 = 0 AS lost, c_custkey % 10 = 8 AS odd, c_custkey % 5 = 0 AS single, ['3', '4', 'u'][c_custkey % 3 + 1] AS level FROM customer),
r AS (SELECT *, kept OR skipped AS idle FROM c),
f AS (SELECT *, CASE WHEN idle THEN 0 ELSE 2 - supplement::INT - unread::INT END AS converted, CASE WHEN idle OR NOT unread THEN 0 ELSE 1 END AS held, CASE WHEN idle OR NOT lost THEN 0 ELSE 1 END AS left_out FROM r)"""


def review_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)[2]
    return rows.select("record_index", "title", "identifier", "location", "skipped", "kept_existing", "has_866", "converted", "held", "left_out", F.array_join("elsewhere", ",").alias("elsewhere"), F.array_join("sources", ",").alias("sources"), F.array_join("record_notes", ";").alias("record_notes"), "level_differs", "single_part")


REVIEW_ROWS = f"""WITH {_FILE} SELECT k AS record_index, seg AS title, k::VARCHAR AS identifier, nation::VARCHAR AS location, skipped, kept AS kept_existing, TRUE AS has_866, converted::BIGINT AS converted, held::BIGINT AS held, left_out::BIGINT AS left_out,
CASE WHEN supplement AND NOT idle THEN '867' ELSE '' END AS elsewhere, CASE WHEN idle THEN '' ELSE 'parser' END AS sources, CASE WHEN odd THEN 'indicators 70' ELSE '' END AS record_notes, level = '3' AS level_differs, single AND converted > 0 AS single_part FROM f"""


def review_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records each filter lets through."""
    rows = _rows(spark, sf_dir)[2]
    seen = rows.where("record_index % 2 = 0").select("record_index")
    parts = [review.filtered(rows, name, reviewed=seen, pattern="parser").agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name in review.FILTERS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


REVIEW_FILTERS = f"""WITH {_FILE}, w AS (SELECT *, NOT skipped AND (held > 0 OR (supplement AND NOT idle) OR odd) AS looks FROM f)
SELECT 'all' AS name, COUNT(*) AS n FROM w UNION ALL SELECT 'held', COUNT(*) FILTER (looks) FROM w UNION ALL SELECT 'leftout', COUNT(*) FILTER (left_out > 0) FROM w
UNION ALL SELECT 'encoding', COUNT(*) FILTER (level = '3' OR (single AND converted > 0)) FROM w UNION ALL SELECT 'pattern', 0 UNION ALL SELECT 'parser', COUNT(*) FILTER (NOT idle) FROM w
UNION ALL SELECT 'unreviewed', COUNT(*) FILTER (k % 2 <> 0) FROM w UNION ALL SELECT 'skipped', COUNT(*) FILTER (skipped) FROM w UNION ALL SELECT 'one-pattern', COUNT(*) FILTER (NOT idle) FROM w"""


def file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.file_counts(_rows(spark, sf_dir)[2]).select("records", "with_holdings", "kept_existing", "single_part", "level_differs")


FILE_COUNTS = f"WITH {_FILE} SELECT COUNT(*) AS records, COUNT(*) AS with_holdings, COUNT(*) FILTER (kept) AS kept_existing, COUNT(*) FILTER (single AND converted > 0) AS single_part, COUNT(*) FILTER (level = '3') AS level_differs FROM f"


def full_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, made, rows = _rows(spark, sf_dir)
    notes = r.where("record_index % 6 = 5").select("record_index", F.lit("seen").alias("note"))
    idle = rows.where("skipped OR kept_existing").select("record_index")
    return review.log(r, made.join(idle, "record_index", "left_anti"), rows, notes).groupBy("record", "identifier", "title", "what").agg(F.count("*").alias("n"))


FULL_LOG = f"""WITH {_FILE}, l AS (SELECT k, seg, 'Belongs in 867' AS what, 1 AS n FROM f WHERE supplement AND NOT idle UNION ALL SELECT k, seg, 'Not converted', 1 FROM f WHERE unread AND NOT idle
UNION ALL SELECT k, seg, 'Converted, part left out', 2 FROM f WHERE lost AND NOT idle UNION ALL SELECT k, seg, 'Record skipped', 1 FROM f WHERE skipped UNION ALL SELECT k, seg, 'Kept as it is', 1 FROM f WHERE kept AND NOT skipped
UNION ALL SELECT k, seg, 'About the record', 1 FROM f WHERE odd UNION ALL SELECT k, seg, 'Note', 1 FROM f WHERE k % 6 = 5 UNION ALL SELECT k, seg, 'Converted, with a note', CASE WHEN supplement OR unread THEN 2 ELSE 3 END FROM f WHERE odd AND NOT idle)
SELECT k + 1 AS record, k::VARCHAR AS identifier, seg AS title, what, SUM(n)::BIGINT AS n FROM l GROUP BY ALL"""


def batch_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by the first decision that applies: a skip, one on the record alone, the run over the file."""
    r = _file(spark, sf_dir)
    own = {i: sessions.Options(remove_866=True, clear_existing=True) for i in range(10, 60)}
    out = sessions.rebuilt(r, batch=sessions.Options(skipped=frozenset(range(50, 80))), own=own)
    n = lambda tag: F.size(records.tagged(tag)).alias(f"n_{tag}")
    return out.select("record_index", "decided", n("853"), n("863"), n("866"))


BATCH_REBUILD = f"""WITH {_FILE}, p AS (SELECT *, CASE WHEN k BETWEEN 50 AND 79 THEN 'skipped' WHEN k BETWEEN 10 AND 59 THEN 'own' ELSE 'batch' END AS decided, 2 - supplement::INT - unread::INT AS wrote FROM f)
SELECT k AS record_index, decided, CASE WHEN decided = 'skipped' OR (decided = 'batch' AND kept) THEN (kept OR odd)::INT WHEN decided = 'own' THEN 1 ELSE odd::INT + 1 END::INTEGER AS n_853,
CASE WHEN decided = 'skipped' OR (decided = 'batch' AND kept) THEN kept::INT ELSE wrote END::INTEGER AS n_863, CASE WHEN decided = 'own' THEN 2 - wrote ELSE 2 END::INTEGER AS n_866 FROM p"""


def records_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits and splits laid over the records themselves, and the statements that they then have."""
    r = _file(spark, sf_dir)
    at = F.array_position(F.transform("fields", lambda f: f["tag"]), "866").cast("int") - 1
    edits = r.where("record_index % 6 = 1").select("record_index", at.alias("field_index"), F.lit("a").alias("code"), F.lit("v.9(1999)").alias("value"))
    edits = edits.unionByName(r.where("record_index % 6 = 1").select("record_index", at.alias("field_index"), F.lit("z").alias("code"), F.lit("").alias("value")))
    splits = r.where("record_index % 6 = 2").select("record_index", at.alias("field_index"), F.array(F.lit("v.1(1990)"), F.lit("v.2(1991)"), F.lit("v.3(1992)")).alias("parts"))
    out = records.statements(decisions.edited_records(r, edits, splits))
    return out.groupBy("record_index").agg(F.count("*").alias("statements"), F.count("z").alias("notes"), F.count("origin").alias("parts"), F.min_by("text", "field_index").alias("first"))


RECORDS_EDITED = """SELECT c_custkey AS record_index, CASE c_custkey % 6 WHEN 2 THEN 4 ELSE 2 END::BIGINT AS statements, CASE c_custkey % 6 WHEN 1 THEN 0 WHEN 2 THEN 3 ELSE 1 END::BIGINT AS notes, CASE c_custkey % 6 WHEN 2 THEN 3 ELSE 0 END::BIGINT AS parts,
CASE WHEN c_custkey % 6 = 1 THEN 'v.9(1999)' WHEN c_custkey % 6 = 2 THEN 'v.1(1990)' WHEN c_custkey % 4 = 0 THEN 'v. ' || c_custkey || ' Suppl. (1990)' WHEN c_custkey % 4 = 1 THEN '? ' || c_custkey ELSE 'v.' || c_custkey || '(1990)' END AS first FROM customer"""


def edit_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = records.statements(_file(spark, sf_dir)).withColumn("field_index", F.col("field_index").cast("int"))
    first = s.where("z IS NOT NULL")
    edit = lambda c, v: first.select("record_index", "field_index", F.lit(c).alias("code"), v.alias("value"))
    edits = edit("z", F.lit("")).unionByName(edit("x", F.lit("new"))).unionByName(edit("a", F.concat("text", F.lit("."))))
    return decisions.edit_notes(edits, s).select("record_index", "note")


_FIRST = "CASE WHEN c_custkey % 4 = 0 THEN 'v. ' || c_custkey || ' Suppl. (1990)' WHEN c_custkey % 4 = 1 THEN '? ' || c_custkey ELSE 'v.' || c_custkey || '(1990)' END"
EDIT_NOTES = f"SELECT c_custkey AS record_index, 'took away the public note: note' AS note FROM customer UNION ALL SELECT c_custkey, 'added the staff note: new' FROM customer UNION ALL SELECT c_custkey, 'changed the statement from ' || {_FIRST} || ' to ' || {_FIRST} || '.' FROM customer"


def picked_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records.summary(_customers(spark, sf_dir), "001").select("record_index", "title")
    return review.picked(rows, [5, 3, 3, -1, 10**9, 70])


PICKED_RECORDS = "SELECT c_custkey AS record_index, c_mktsegment AS title FROM customer WHERE c_custkey IN (3, 5, 70)"


def notation_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _dated(spark, sf_dir)
    text = F.when(F.col("o_orderkey") % 2 == 0, _text("[", _s("y"), ":", _s("m"), "]")).otherwise(_text("v.", _s("v")))
    scheme = F.element_at(F.array(F.lit(None).cast("string"), F.lit("usnp"), F.lit("other")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return d.select("o_orderkey", quality.notation_note(text, scheme).alias("note"))


NOTATION_NOTES = """SELECT o_orderkey, CASE o_orderkey % 2 || ',' || o_orderkey % 3 WHEN '1,1' THEN 'declared usnp, but not of that form' WHEN '0,0' THEN 'of the usnp form, which isn''t declared' WHEN '0,2' THEN 'of the usnp form, declared other' END AS note FROM orders"""


def record_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.existing_853_notes(_file(spark, sf_dir))


RECORD_NOTES = "SELECT c_custkey AS record_index, 'indicators 70' AS note FROM customer WHERE c_custkey % 10 = 8"


def level_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose own holdings fields contradict their leader, or go past the level that is declared."""
    k = F.col("c_custkey")
    subs = [("8", "1.1"), ("a", k)]
    held = F.when(k % 3 == 0, F.array(_field("863", *subs, ("b", 2)))).when(k % 3 == 1, F.array(_field("863", ("8", "1.1"), ("i", "1990-1992")))).otherwise(F.array(_field("863", ("8", "1.1"), ("i", "1990"))))
    r = _table(spark, sf_dir, "customer").select(k.alias("record_index"), F.concat(F.lit("00000c"), F.when(k % 2 == 0, "x").otherwise("y"), F.lit("  a22000003n  4500")).alias("leader"), held.cast(RECORD_FIELDS).alias("fields"))
    return r.select("record_index", quality.exceeds_summary().alias("beyond"), quality.single_part_conflict().alias("single"))


LEVEL_CONFLICTS = "SELECT c_custkey AS record_index, c_custkey % 3 = 0 AS beyond, c_custkey % 2 = 0 AND c_custkey % 3 < 2 AS single FROM customer"


def same_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other records with the text of one statement."""
    s = _shapes(spark, sf_dir).select(F.col("o_custkey").alias("record_index"), F.col("o_orderkey").alias("field_index"), "text")
    one = s.orderBy("field_index").first()
    return decisions.same_statement(s, one["record_index"], one["field_index"]).select("record_index", "field_index")


SAME_STATEMENTS = f"WITH {_DATED}, t AS (SELECT o_custkey AS record_index, o_orderkey AS field_index, {_SHAPE_TEXT} AS text FROM d), o AS (SELECT * FROM t ORDER BY field_index LIMIT 1) SELECT t.record_index, t.field_index FROM t, o WHERE t.text = o.text AND t.record_index <> o.record_index"


def record_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of single records over those of the file: a value that is set counts even if it is empty."""
    r = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("record_index"))
    k = F.col("record_index")
    own = r.where("record_index % 2 = 0").select("record_index", F.when(k % 4 == 0, "m").otherwise("").alias("frequency"), (k % 3 == 0).alias("frequency_set"))
    return decisions.settings(r, own, {"frequency": "q"})


RECORD_SETTINGS = "SELECT c_custkey AS record_index, CASE WHEN c_custkey % 6 = 0 THEN CASE WHEN c_custkey % 4 = 0 THEN 'm' ELSE '' END ELSE 'q' END AS frequency FROM customer"


def settings_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequency and captions of single records in the caption fields that are written."""
    s = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("record_index"), F.lit(0).alias("field_index"), _text(F.col("c_custkey").cast("string"), " no 3 (1990)").alias("text"))
    k = F.col("record_index")
    caps = F.array(F.struct(F.lit(0).alias("level"), F.lit("Bd.").alias("caption")))
    own = s.where("record_index % 2 = 0").select("record_index", F.when(k % 4 == 0, "m").alias("frequency"), F.lit(None).cast("string").alias("per_higher"), F.lit(None).cast("string").alias("continuity"), F.when(k % 3 == 0, caps).alias("captions"))
    made = records.convert_records(s, settings=sessions.settings_of(own), frequency="q")
    return made.select("record_index", reading.display(F.col("field_853")).alias("caption"))


SETTINGS_APPLIED = "SELECT c_custkey AS record_index, '853 31 $8 1 $a ' || CASE WHEN c_custkey % 6 = 0 THEN 'Bd.' ELSE '(*)' END || ' $b no. $i (year) $w ' || CASE WHEN c_custkey % 4 = 0 THEN 'm' ELSE 'q' END AS caption FROM customer"


def corpus_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements and occurrences of a corpus by what was declared and what comes of them."""
    s = _shapes(spark, sf_dir)
    corpus = s.groupBy("text").agg(F.count("*").alias("times"), F.min(F.col("o_orderkey") % 6).alias("k")).select("text", "times", F.lit("all").alias("section"), F.when(F.col("k") == 5, "loss").otherwise("").alias("status"))
    read = reading.read_statements(s).withColumn("outcome", reading.outcome(F.col("parsed"), F.col("converted")))
    return reports.corpus_report(corpus, read)


CORPUS_OUTCOMES = f"""WITH {_DATED}, t AS (SELECT {_SHAPE_TEXT} AS text, COUNT(*) AS times, MIN({_K}) AS k FROM d GROUP BY 1)
SELECT 'all' AS section, CASE WHEN k = 5 THEN 'loss' ELSE '' END AS status, CASE k WHEN 3 THEN 'elsewhere' WHEN 4 THEN 'unread' WHEN 5 THEN 'left_out' ELSE 'clean' END AS outcome, COUNT(*) AS statements, SUM(times)::BIGINT AS occurrences FROM t GROUP BY 1, 2, 3"""


def uncaptioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels that statements state without a caption, and what confirming a pattern would decide."""
    k = F.col("o_orderkey") % 3
    d = _dated(spark, sf_dir)
    s = d.select("o_orderkey", F.when(k == 0, _text(_s("v"), " no ", _s("m"), " (", _s("y"), ")")).when(k == 1, _text("v.", _s("v"), "(", _s("y"), ")")).otherwise(_text("? ", _s("v"))).alias("text"))
    read = reading.read_statements(s)
    return read.select("o_orderkey", F.array_join(review.uncaptioned_levels(F.col("parsed")).cast("array<string>"), ",").alias("levels"), review.decides(F.col("parsed")).alias("decides"))


UNCAPTIONED = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '0' ELSE '' END AS levels, CASE o_orderkey % 3 WHEN 0 THEN 'caption' WHEN 1 THEN 'nothing' ELSE 'reading' END AS decides FROM orders"


def pattern_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one more pattern would change: only what the grammar can't read."""
    library, _ = patterns.load([{"id": "q", "label": "q", "regex": r"\? (?P<start_num>\d+)", "roles": [{"group": "start_num", "boundary": "start", "kind": "enum", "level": 0, "caption": "no."}]}])
    found = sessions.preview(_shapes(spark, sf_dir), [], library[0])
    return found.select("text", "source", "differs", F.array_join("after", "; ").alias("after")).where("differs")


PATTERN_PREVIEW = "SELECT DISTINCT '? ' || month(o_orderdate) AS text, 'q' AS source, TRUE AS differs, '853 31 $8 1 $a no.; 863 41 $8 1.1 $a ' || month(o_orderdate) AS after FROM orders WHERE o_orderkey % 6 = 4"


def sources_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _shapes(spark, sf_dir).select(F.col("o_custkey").alias("record_index"), F.col("o_orderkey").alias("field_index"), "text")
    library, _ = patterns.load([{"id": "q", "label": "q", "regex": r"\? \d+", "roles": [], "skip": True}])
    return review.by_source(records.convert_records(s, library=library))


SOURCES_COUNTED = f"SELECT CASE WHEN {_K} = 4 THEN 'skipped' ELSE 'parser' END AS source, COUNT(*) AS n FROM orders GROUP BY 1"


def cluster_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings of captions that a cluster has seen."""
    d = _dated(spark, sf_dir)
    word = F.element_at(F.array(*map(F.lit, ("v.", "Vol.", "volume"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return patterns.clusters(d.select(_text(word, " ", _s("v")).alias("text"), F.col("o_orderkey").alias("pos"))).select("label", "variants", F.col("count").alias("n"), "match_rate")


CLUSTER_VARIANTS = "SELECT 'VOL' AS label, '{\"VOL_CAP\": [\"volume\", \"vol.\", \"v.\"]}' AS variants, COUNT(*) AS n, 1.0::DOUBLE AS match_rate FROM orders"



def cluster_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters as JSON documents, looked into."""
    found = patterns.cluster_json(patterns.clusters(_shapes(spark, sf_dir).select("text", F.col("o_orderkey").alias("pos"))))
    at = lambda path: F.get_json_object("json", path)
    return found.select(at("$.label").alias("label"), at("$.count").cast("long").alias("n"), at("$.match_rate").cast("double").alias("match_rate"), at("$.too_complex").alias("too_complex"))


CLUSTER_DOCUMENTS = f"""SELECT CASE {_K} WHEN 0 THEN 'VOL(YEAR)' WHEN 1 THEN 'VOL:ISS(YEAR:CHRON)' WHEN 2 THEN 'YEAR-' WHEN 3 THEN 'VOL ‹Suppl.›(YEAR)' WHEN 4 THEN '‹?› NUM' ELSE 'VOL — VOL ISS(YEAR-CHRON YEAR)' END AS label, COUNT(*) AS n, 1.0::DOUBLE AS match_rate, 'false' AS too_complex FROM orders GROUP BY 1"""


def statements_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts given back in reverse order, one in five of them changed."""
    s = _shapes(spark, sf_dir).select(F.col("o_custkey").alias("record_index"), F.col("o_orderkey").alias("field_index"), F.concat(F.lit("v."), (F.col("o_orderkey") % 3).cast("string")).alias("text"))
    given = s.select("record_index", (-F.col("field_index")).alias("nth"), F.when(F.col("field_index") % 5 == 0, F.concat("text", F.lit("x"))).otherwise(F.concat(F.lit(" "), "text")).alias("text"))
    return decisions.matched(s, given).select("record_index", "nth", "text", "field_index")


STATEMENTS_MATCHED = """WITH s AS (SELECT o_custkey AS r, o_orderkey AS f, 'v.' || o_orderkey % 3 AS text FROM orders), o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY r, text ORDER BY f) AS n FROM s),
g AS (SELECT r, -f AS nth, CASE WHEN f % 5 = 0 THEN text || 'x' ELSE text END AS text FROM s), h AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY r, text ORDER BY nth) AS n FROM g)
SELECT h.r AS record_index, h.nth, h.text, o.f AS field_index FROM h LEFT JOIN o ON h.r = o.r AND h.text = o.text AND h.n = o.n"""


def audit_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.tallies(quality.audit(_shapes(spark, sf_dir)))


AUDIT_TALLY = f"WITH {_DATED}, t AS (SELECT DISTINCT {_SHAPE_TEXT} AS text, {_K} AS k FROM d) SELECT COUNT(*) AS statements, 0::BIGINT AS silent, COUNT(*) FILTER (k < 3) AS same, COUNT(*) FILTER (k = 5) AS caption_only, 0::BIGINT AS drift, COUNT(*) FILTER (k IN (3, 4)) AS not_converted FROM t"


def corpus_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _shapes(spark, sf_dir)
    return quality.statuses(reading.read_statements(s), quality.audit(s))


CORPUS_STATUSES = f"WITH {_DATED} SELECT DISTINCT {_SHAPE_TEXT} AS text, CASE {_K} WHEN 3 THEN 'fail' WHEN 4 THEN 'fail' WHEN 5 THEN 'warn' ELSE 'ok' END AS status FROM d"


def texts_in_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _shapes(spark, sf_dir).withColumnRenamed("o_custkey", "record_index")
    return decisions.records_with(s).groupBy("text").agg(F.count("*").alias("records"), F.sum("record_index").alias("total"))


TEXTS_IN_RECORDS = f"WITH {_DATED}, t AS (SELECT DISTINCT {_SHAPE_TEXT} AS text, o_custkey FROM d) SELECT text, COUNT(*) AS records, SUM(o_custkey)::BIGINT AS total FROM t GROUP BY text"

_ALL = tuple((f.__name__, f, globals()[f.__name__.upper()]) for f in (cluster_outcomes, to_look_at, pattern_partition, auto_confirm, outcome_totals, review_rows, review_filters, file_counts, full_log, batch_rebuild, records_edited, edit_notes, picked_records, notation_notes, record_notes, level_conflicts, same_statements, record_settings, settings_applied, corpus_outcomes, uncaptioned, pattern_preview, sources_counted, cluster_variants, cluster_documents, statements_matched, audit_tally, corpus_statuses, texts_in_records))
QUERIES = {name: f for name, f, _ in _ALL}
ORACLES = {name: sql for name, _, sql in _ALL}

