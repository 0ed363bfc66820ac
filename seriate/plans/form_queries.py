"""Queries of the forms that statements, files, libraries and expressions take, each with the SQL that must give the same rows.

Where an operator works on a few things that people write (patterns, expressions, conventions), its query gives a row for
each, and the SQL states the rows.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriate.functions import budget, dialects, fields
from seriate.operators import code, patterns, quality, reading, records, reports, sessions
from seriate.plans.queries import _DATED, _K, _customers, _dated, _s, _shapes, _table, _text
from seriate.plans.review_queries import _file
from seriate.sources import marc

#: What a template may hold: a year y and the second and third behind it, years ten and eight before it, volumes, and years without their century.
_PLACES = {"y": "y", "s": "y + 1", "z": "y + 2", "v": "v", "w": "v + 2", "u": "(y + 1) % 100", "p": "y - 10", "q": "y - 8", "r": "(y - 8) % 100"}
#: A form of statement: text, fields, caption field, and whether it is flagged.
FORMS = (
    ("v.<v> {bound copy}(<y>)", "41 $a <v> $i <y>", "$a v. $i (year)", False),
    ("<y>: <v> (2 [May])", "41 $a <v> $b 2 $i <y> $j 05", "$a (*) $b (*) $i (year) $j (month)", False),
    ("<y>: <v> (2-4 [May 3-Jul 9])", "40 $a <v> $b 2-4 $i <y> $j 05-07 $k 3-9", "$a (*) $b (*) $i (year) $j (month) $k (day)", False),
    ("N <y>: (2 [May])", "41 $a 2 $i <y> $j 05", "$a (*) $i (year) $j (month)", False),
    ("v.<v>(<y>) / v.<w>(<z>)", "41 $a <v> $i <y> / 41 $a <w> $i <z>", "$a v. $i (year)", False),
    ("v.<v>(<y>); v.<w>(<z>)", "41 $a <v> $i <y> $w n / 41 $a <w> $i <z>", "$a v. $i (year)", False),
    ("Series 2, v. <v> (<y>)", "41 $a 2 $b <v> $i <y>", "$a ser. $b v. $i (year)", False),
    ("v.<v>-<w> <y>-<z>", "40 $a <v>-<w> $i <y>-<z>", "$a v. $i (year)", False),
    ("v.<v> no.2 <y>.", "41 $a <v> $b 2 $i <y>", "$a v. $b no. $i (year)", False),
    ("v. <v>-<w> (<p>-<r>)", "40 $a <v>-<w> $i <p>-<q>", "$a v. $i (year)", False),
    ("v. <v> (<y>/<u>)", "41 $a <v> $i <y>/<s>", "$a v. $i (year)", False),
    ("(Mar, May <y>)", "41 $i <y> $j 03 $w g / 41 $i <y> $j 05", "$i (year) $j (month)", False),
    ("(Nov, Dec <y>, Jan <s>)", "41 $i <y> $j 11 / 41 $i <y> $j 12 / 41 $i <s> $j 01", "$i (year) $j (month)", False),
    ("v. <v>, <w> (<y>, <z>)", "41 $a <v> $i <y> $w g / 41 $a <w> $i <z>", "$a v. $i (year)", False),
    ("<y>?", "41 $i <y>", "$i (year)", True),
    ("<y>:May-<z>:Jul", "40 $i <y>-<z> $j 05-07", "$i (year) $j (month)", False),
    ("v. <v> - v. <w> (<y> - <z>)", "40 $a <v>-<w> $i <y>-<z>", "$a v. $i (year)", False),
    ("v. <v> no. 2-no. 4 (<y>)", "40 $a <v> $b 2-4 $i <y>", "$a v. $b no. $i (year)", False),
    ("v.<v>(<y>)-v.<w> no. 3(<z>)", "40 $a <v>-<w> $i <y>-<z>", "$a v. $b no. $i (year)", False),
    ("no.<v>(<y>)-v.<w>(<z>)", "40 $a <v> $i <y>-<z>", "$a no. $i (year)", False),
    ("v. <v> no. 2 pt. 3 ser. 4 (<y>)", "41 $a <v> $b 2 $c 3 $d 4 $i <y>", "$a v. $b no. $c pt. $d ser. $i (year)", True),
    ("v.<v>(May 3, <y>)", "41 $a <v> $i <y> $j 05 $k 3", "$a v. $i (year) $j (month) $k (day)", False),
    ("v. <v>-<w> (<y>-<s>-<z>)", "40 $a <v>-<w> $i <y>-<z>", "$a v. $i (year)", True),
    ("v.<w>(<z>), v.<v>(<y>)", "41 $a <w> $i <z> $w g / 41 $a <v> $i <y>", "$a v. $i (year)", True),
    ("v. <v> nos. 2-4, 6 (Feb-Apr, Jun <y>)", "40 $a <v> $b 2-4 $i <y> $j 02-04 $w g / 41 $a <v> $b 6 $i <y> $j 06", "$a v. $b no. $i (year) $j (month)", False),
)


def _filled(template: str) -> F.Column:
    parts = re.split(r"<(\w)>", template)
    return _text(*[_two(_PLACES[p]) if i % 2 else p for i, p in enumerate(parts) if p])


def _two(expression: str) -> F.Column:
    value = F.expr(expression).cast("string")
    return F.lpad(value, 2, "0") if "%" in expression else value


def _filled_sql(template: str) -> str:
    parts = re.split(r"<(\w)>", template)
    one = lambda e: f"lpad(({e})::VARCHAR, 2, '0')" if "%" in e else f"({e})::VARCHAR"
    return " || ".join(one(_PLACES[p]) if i % 2 else "'" + p.replace("'", "''") + "'" for i, p in enumerate(parts) if p)


def _lines(column: str) -> F.Column:
    """Fields as they are shown, without their numbers."""
    plain = lambda f: F.substring(reading.display(f.withField("subfields", F.filter(f["subfields"], lambda s: s["code"] != "8"))), 5, 200)
    return F.array_join(F.transform(column, plain), " / ")


def statement_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brace notes, blocks, segments, prefixes, bare dates, lists, abbreviated and double years, doubts, ends that don't pair."""
    k = F.col("o_orderkey") % len(FORMS)
    text = F.coalesce(*[F.when(k == i, _filled(t)) for i, (t, *_) in enumerate(FORMS)])
    read = reading.read_statements(_dated(spark, sf_dir).withColumn("text", text).select("o_orderkey", "text"))
    caption = F.substring(reading.display(F.col("converted.field_853")), 13, 200)
    return read.select("o_orderkey", _lines("converted.fields_863").alias("shown"), caption.alias("caption"), F.col("converted.flagged").alias("flagged"))


_FORM = lambda i: "CASE o_orderkey % {} {} END".format(len(FORMS), " ".join(f"WHEN {n} THEN {_filled_sql(f[i])}" for n, f in enumerate(FORMS)))
STATEMENT_FORMS = f"WITH {_DATED} SELECT o_orderkey, {_FORM(1)} AS shown, {_FORM(2)} AS caption, o_orderkey % {len(FORMS)} IN ({', '.join(str(i) for i, f in enumerate(FORMS) if f[3])}) AS flagged FROM d"

#: Statements of which nothing is written, and a word of what is said.
_REFUSED = (("? <v>", "bare number"), ("<v>.2 3-4 <y>", "863"), ("v.<v>(<y>)-v.<w>(<z>-)", "not read"), ("the copies of <y> are lost", "not read"), ("?: <v>", "no year"))


def statement_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % len(_REFUSED)
    text = F.coalesce(*[F.when(k == i, _filled(t)) for i, (t, _) in enumerate(_REFUSED)])
    word = F.coalesce(*[F.when(k == i, F.lit(w)) for i, (_, w) in enumerate(_REFUSED)])
    read = reading.read_statements(_dated(spark, sf_dir).select("o_orderkey", text.alias("text"), word.alias("word")))
    said = F.array_join(F.transform("converted.warnings", lambda w: w["text"]), "; ")
    return read.select("o_orderkey", F.col("converted.held").alias("held"), said.contains(F.col("word")).alias("said"))


STATEMENT_REFUSALS = "SELECT o_orderkey, TRUE AS held, TRUE AS said FROM orders"


def house_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A convention of one's own, with units, continuity and frequency."""
    conv, _ = fields.resolve("house", {"subfields": {"day": "k"}})
    d = _dated(spark, sf_dir).select("o_orderkey", _text("v.", _s("v"), ":no.", _s("m"), "(", _s("y"), ":", F.col("mon"), ")").alias("text"))
    read = reading.read_statements(d, conv=conv, per_higher="12", continuity="r", frequency="m")
    return read.select("o_orderkey", _lines("converted.fields_863").alias("shown"), reading.display(F.col("converted.field_853")).alias("caption"))


HOUSE_STYLE = f"WITH {_DATED} SELECT o_orderkey, '41 $a ' || y || ' $b ' || v || ' $c ' || m || ' $i ' || ['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][m] AS shown, '853 20 $8 1 $a (year) $b v. $c no. $u 12 $v r $i (month) $w m' AS caption FROM d"


def conventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What overrides come to, and how many of them are refused."""
    asked = [("standard", {}), ("house", {}), ("none", {}), ("standard", {"subfields": {"year": "a", "month": "m"}, "indicators": ["7", "1"]}), ("standard", {"subfields": {"enum": ["a", "a"]}}), ("house", {"subfields": {"day": "k"}})]
    rows = []
    for i, (preset, overrides) in enumerate(asked):
        conv, bad = fields.resolve(preset, overrides)
        rows.append((i, "".join(conv.enum), conv.year, conv.month, conv.day, "".join(conv.indicators), conv.text, len(bad)))
    return spark.createDataFrame(rows, "nth int, enum string, year string, month string, day string, indicators string, words boolean, refused int")


CONVENTIONS = """SELECT * FROM (VALUES (0, 'abcdef', 'i', 'j', 'k', '31', FALSE, 0), (1, 'bcdef', 'a', 'i', NULL, '20', TRUE, 0), (2, 'abcdef', 'i', 'j', 'k', '31', FALSE, 1), (3, 'abcdef', 'i', 'm', 'k', '31', FALSE, 2), (4, 'abcdef', 'i', 'j', 'k', '31', FALSE, 1), (5, 'bcdef', 'a', 'i', 'k', '20', TRUE, 0)) AS t(nth, enum, year, month, day, indicators, words, refused)"""


def units_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(x, fields.units(x)) for x in ("0", "1", "012", "999", "1000", "var", "und", " 12 ", "x", "")], "given string, units string")


UNITS_READ = "SELECT * FROM (VALUES ('0', ''), ('1', '1'), ('012', ''), ('999', '999'), ('1000', ''), ('var', 'var'), ('und', 'und'), (' 12 ', '12'), ('x', ''), ('', '')) AS t(given, units)"


# ---- shapes and libraries ---------------------------------------------------------------------------------


def shape_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranged numbers, runs of unknown text, ends of runs, and parts between dividers."""
    k = F.col("o_orderkey") % 4
    d = _dated(spark, sf_dir)
    text = (
        F.when(k == 0, _text("v. ", _s("v"), " no. 3-4-v. ", (F.col("v") + 1).cast("string"), " no. 5 (", _s("y"), ")"))
        .when(k == 1, _text("v. ", _s("v"), " bound with & more (", _s("y"), ")"))
        .when(k == 2, _text("v.", _s("v"), "(", _s("y"), "), v.", (F.col("v") + 2).cast("string"), "(", (F.col("y") + 2).cast("string"), ") / ", (F.col("y") + 3).cast("string"), "-"))
        .otherwise(_text(_s("y"), "-", (F.col("y") + 2).cast("string")))
    )
    return patterns.parted(patterns.signed(d.select("o_orderkey", text.alias("text")))).select("o_orderkey", "signature", F.size("parts").alias("parts"))


SHAPE_FORMS = """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'VOL_CAP|NUMBER|ISS_CAP|NUMBER|SEP_HYPHEN|VOL_CAP|NUMBER|ISS_CAP|NUMBER|PAREN_OPEN|YEAR|PAREN_CLOSE' WHEN 1 THEN 'VOL_CAP|NUMBER|UNKNOWN|PAREN_OPEN|YEAR|PAREN_CLOSE'
WHEN 2 THEN 'VOL_CAP|NUMBER|PAREN_OPEN|YEAR|PAREN_CLOSE|SEP_COMMA|VOL_CAP|NUMBER|PAREN_OPEN|YEAR|PAREN_CLOSE|UNKNOWN|YEAR|SEP_HYPHEN' ELSE 'YEAR|SEP_HYPHEN|YEAR' END AS signature, CASE o_orderkey % 4 WHEN 2 THEN 3 ELSE 1 END::INTEGER AS parts FROM orders"""


def cluster_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the groups of each cluster's expression are taken to hold."""
    found = patterns.clusters(_shapes(spark, sf_dir).select("text", F.col("o_orderkey").alias("pos")))
    return patterns.roles_of(found).select("label", "group", "boundary", "kind", "level", "caption", "suggested")


CLUSTER_ROLES = """SELECT * FROM (VALUES ('VOL(YEAR)', 'start_vol', 'start', 'enum', 0, 'v.', FALSE), ('VOL(YEAR)', 'start_year', 'start', 'year', NULL, NULL, FALSE),
('VOL:ISS(YEAR:CHRON)', 'start_vol', 'start', 'enum', 0, 'v.', FALSE), ('VOL:ISS(YEAR:CHRON)', 'start_iss', 'start', 'enum', 1, 'no.', FALSE), ('VOL:ISS(YEAR:CHRON)', 'start_year', 'start', 'year', NULL, NULL, FALSE), ('VOL:ISS(YEAR:CHRON)', 'start_month', 'start', 'month', NULL, NULL, FALSE),
('YEAR-', 'start_year', 'start', 'year', NULL, NULL, FALSE), ('VOL ‹Suppl.›(YEAR)', 'start_vol', 'start', 'enum', 0, 'v.', FALSE), ('VOL ‹Suppl.›(YEAR)', 'start_year', 'start', 'year', NULL, NULL, FALSE), ('‹?› NUM', 'start_num', 'start', 'unresolved', NULL, NULL, FALSE),
('VOL — VOL ISS(YEAR-CHRON YEAR)', 'start_vol', 'start', 'enum', 0, 'v.', FALSE), ('VOL — VOL ISS(YEAR-CHRON YEAR)', 'end_vol', 'end', 'enum', 0, 'v.', FALSE), ('VOL — VOL ISS(YEAR-CHRON YEAR)', 'start_iss', 'start', 'enum', 1, 'no.', FALSE),
('VOL — VOL ISS(YEAR-CHRON YEAR)', 'start_year', 'start', 'year', NULL, NULL, FALSE), ('VOL — VOL ISS(YEAR-CHRON YEAR)', 'start_month', 'start', 'month', NULL, NULL, FALSE), ('VOL — VOL ISS(YEAR-CHRON YEAR)', 'end_year', 'end', 'year', NULL, NULL, FALSE)) AS t(label, "group", boundary, kind, level, caption, suggested)"""


def _role(group: str, kind: str = "enum", level: int | None = 0, **more) -> dict:
    return {"group": group, "boundary": group.partition("_")[0], "kind": kind, "level": level} | more


def library_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns that can't enter a library, by id, and how many things are wrong with each."""
    raw = [
        {"id": "good", "label": "", "regex": r"v\.(?P<start_vol>\d+)", "roles": [_role("start_vol")]},
        {"id": "broken", "label": "", "regex": "(", "roles": []},
        {"id": "nameless", "label": "", "regex": r"v\.(\d+)", "roles": []},
        {"id": "roleless", "label": "", "regex": r"(?P<start_vol>\d+)", "roles": []},
        {"id": "doubled", "label": "", "regex": r"(?P<start_vol>\d+)(?P<start_iss>\d+)", "roles": [_role("start_vol"), _role("start_iss")]},
        {"id": "ignored", "label": "", "regex": r"(?P<start_vol>\d+)", "roles": [_role("start_vol", "ignore", None)]},
        {"id": "skips", "label": "", "regex": "anything", "roles": [], "skip": True},
        {"id": "runaway", "label": "", "regex": r"(?P<start_vol>(\s*a+)*)b", "roles": [_role("start_vol")]},
        {"id": "long", "label": "", "regex": "x" * 4001, "roles": []},
    ]
    kept, errors = patterns.load(raw)
    rows = [(p["id"], p["id"] in {k.id for k in kept}, sum(e.startswith(f"{p['id']}:") for e in errors)) for p in raw]
    return spark.createDataFrame(rows, "id string, kept boolean, errors int")


LIBRARY_FAULTS = "SELECT * FROM (VALUES ('good', TRUE, 0), ('broken', FALSE, 1), ('nameless', FALSE, 1), ('roleless', FALSE, 1), ('doubled', FALSE, 1), ('ignored', FALSE, 1), ('skips', TRUE, 0), ('runaway', FALSE, 1), ('long', FALSE, 1)) AS t(id, kept, errors)"


def library_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A library written, read again, and merged with another or replaced by it."""
    one = lambda i, n, w: {"id": i, "label": w, "regex": r"(?P<start_vol>\d+)", "priority": n, "roles": [{"group": "start_vol", "level": "vol"}]}
    old = sessions.library_from(json.dumps([one("a", 1, "old"), one("b", 2, "old")]))
    new = sessions.library_from(sessions.library_text(patterns.load([one("b", 9, "new")], probe=False)[0]))
    rows = [(how, p.id, p.label, p.roles[0].caption, p.roles[0].level) for how, replace in (("merge", False), ("replace", True)) for p in patterns.merged_library(old, new, replace)]
    return spark.createDataFrame(rows, "how string, id string, label string, caption string, level int")


LIBRARY_MERGED = "SELECT * FROM (VALUES ('merge', 'b', 'new', 'v.', 0), ('merge', 'a', 'old', 'v.', 0), ('replace', 'b', 'new', 'v.', 0)) AS t(how, id, label, caption, level)"


def roles_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions that outlive an edit of the expression."""
    old = [patterns.Role("start_num", "start", "enum", 0, "Bd.")]
    rows = [(r.group, r.kind, r.caption, r.level) for r in patterns.merged_roles(old, ["start_num", "start_iss", "start_year", "end_num", "end_num_2"])]
    return spark.createDataFrame(rows, "group string, kind string, caption string, level int")


ROLES_KEPT = """SELECT * FROM (VALUES ('start_num', 'enum', 'Bd.', 0), ('start_iss', 'enum', 'no.', 1), ('start_year', 'year', NULL, NULL), ('end_num', 'unresolved', NULL, NULL), ('end_num_2', 'ignore', NULL, NULL)) AS t("group", kind, caption, level)"""


def expressions_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One expression in each dialect, and what dialects refuse."""
    rx = r"v\.(?P<start_vol>\d+)(?:-(?P<end_vol>\d+))?"
    asked = [(rx, d) for d in dialects.DIALECTS] + [(r"\d++", "javascript"), (r"(?=x)y", "oracle"), ("(", "java"), ("a", "none"), (r"(?x)a", "pcre"), (r"(?i)(?>a)(?#note)", "java")]
    rows = [(i, x, d, c.text, c.error is not None) for i, (x, d) in enumerate(asked) for c in dialects.convert_all([x], d, whole=False)]
    return spark.createDataFrame(rows, "nth int, given string, dialect string, text string, refused boolean").drop("given")


EXPRESSIONS_CONVERTED = r"""SELECT * FROM (VALUES (0, 'python', 'v\.(?P<start_vol>\d+)(?:-(?P<end_vol>\d+))?', FALSE), (1, 'pcre', 'v\.(?<start_vol>\d+)(?:-(?<end_vol>\d+))?', FALSE), (2, 'javascript', 'v\.(?<start_vol>\d+)(?:-(?<end_vol>\d+))?', FALSE),
(3, 'java', 'v\.(?<startVol>\d+)(?:-(?<endVol>\d+))?', FALSE), (4, 'dotnet', 'v\.(?<start_vol>\d+)(?:-(?<end_vol>\d+))?', FALSE), (5, 'marcedit', 'v\.(\d+)(?:-(\d+))?', FALSE), (6, 'alma', 'v\.(\d+)(?:-(\d+))?', FALSE), (7, 'oracle', 'v\.([[:digit:]]+)(-([[:digit:]]+))?', FALSE),
(8, 'javascript', NULL, TRUE), (9, 'oracle', NULL, TRUE), (10, 'java', NULL, TRUE), (11, 'none', NULL, TRUE), (12, 'pcre', NULL, TRUE), (13, 'java', '(?>a)', FALSE)) AS t(nth, dialect, text, refused)"""


def expressions_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An expression in the Java dialect, natively, finds what it is meant to find."""
    java = dialects.convert(r"v\.(?P<start_vol>\d+)(?:\((?P<start_year>\d{4})\))?", "java").text
    return _shapes(spark, sf_dir).select("o_orderkey", F.col("text").rlike(java).alias("found"))


EXPRESSIONS_AGREE = f"SELECT o_orderkey, {_K} = 0 AS found FROM orders"


def expressions_tried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches under a budget of time, and expressions that run away."""
    texts = ["v.1", "xv.22", "none"]
    rows = [(t, m["full"], m["partial"], m["groups"].get("n"), *(m["span"] or (None, None))) for t, m in zip(texts, budget.match(r"v\.(?P<n>\d+)", texts), strict=True)]
    rows += [(rx, False, False, "runaway", None, None) for rx in budget.runaways([r"(\s*a+)*b", r"v\.\d+"], seconds=1.0)]
    return spark.createDataFrame(rows, "text string, whole boolean, part boolean, n string, first int, behind int")


EXPRESSIONS_TRIED = r"SELECT * FROM (VALUES ('v.1', TRUE, TRUE, '1', 0, 3), ('xv.22', FALSE, TRUE, NULL, 1, 5), ('none', FALSE, FALSE, NULL, NULL, NULL), ('(\s*a+)*b', FALSE, FALSE, 'runaway', NULL, NULL)) AS t(text, whole, part, n, first, behind)"


# ---- files ------------------------------------------------------------------------------------------------


def marc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as MARC files and read again, with dense numbers in their order."""
    path = code.scratch(spark, "marc")
    spark.dataSource.register(marc.MarcSource)
    _file(spark, sf_dir).repartitionByRange(3, "record_index").sortWithinPartitions("record_index").write.format("marc2709").mode("overwrite").save(path)
    back = marc.numbered(spark.read.format("marc2709").load(path))
    return back.select("record_index", records.first_value("001", None).alias("id"), F.array_join(F.transform("fields", lambda f: f["tag"]), " ").alias("tags"), records.first_value("866", "z").alias("note"), "unreadable")


MARC_ROUND_TRIP = """SELECT (ROW_NUMBER() OVER (ORDER BY c_custkey) - 1)::BIGINT AS record_index, c_custkey::VARCHAR AS id, '001 245 852 ' || CASE c_custkey % 10 WHEN 7 THEN '853 863 ' WHEN 8 THEN '853 ' ELSE '' END || '866 866' AS tags, 'note' AS note, FALSE AS unreadable FROM customer"""


def marc_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of a MARC file by their record's control number."""
    path = code.scratch(spark, "scan")
    spark.dataSource.register(marc.MarcSource)
    _customers(spark, sf_dir).withColumn("file", F.lit("f")).coalesce(1).write.format("marc2709").mode("overwrite").save(path)
    return marc.statement_scan(spark, f"{path}/*.mrc")


MARC_STATEMENTS = "SELECT c_custkey::VARCHAR AS place, 'v.' || c_custkey || '(1990)' AS text FROM customer"


def damaged_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The message that refuses a file with damaged records."""
    r = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("record_index"), (F.col("c_custkey") % 10 == 3).alias("unreadable"))
    try:
        quality.refuse_unreadable(r)
        said = ""
    except ValueError as e:
        said = str(e)
    return spark.createDataFrame([(said,)], "said string")


DAMAGED_REFUSED = """WITH b AS (SELECT c_custkey + 1 AS p, ROW_NUMBER() OVER (ORDER BY c_custkey) AS n FROM customer WHERE c_custkey % 10 = 3)
SELECT 'damaged records: ' || string_agg(p::VARCHAR, ', ' ORDER BY p) FILTER (n <= 10) || CASE WHEN COUNT(*) > 10 THEN ' and ' || (COUNT(*) - 10) || ' more' ELSE '' END AS said FROM b"""


def corpus_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of a text corpus, with the section above each and its annotation."""
    path = code.scratch(spark, "corpus")
    n = _table(spark, sf_dir, "nation").orderBy("n_nationkey")
    section = F.when(F.col("n_nationkey") % 5 == 0, F.array(F.lit("# a comment"), F.concat(F.lit("[section: s"), _s("n_nationkey"), F.lit("]")))).otherwise(F.array().cast("array<string>"))
    line = F.concat(F.lit("v."), _s("n_nationkey"), F.when(F.col("n_nationkey") % 2 == 1, F.concat(F.lit(" # [x"), _s("n_nationkey"), F.lit("] loss:D7"))).otherwise(""))
    n.coalesce(1).select(F.explode(F.concat(section, F.array(line))).alias("value")).write.mode("overwrite").text(path)
    return marc.corpus(spark, path).select("section", "text", "times", "status", "defect")


CORPUS_SCAN = "SELECT 's' || (n_nationkey - n_nationkey % 5) AS section, 'v.' || n_nationkey AS text, CASE WHEN n_nationkey % 2 = 1 THEN n_nationkey ELSE 1 END::INTEGER AS times, CASE WHEN n_nationkey % 2 = 1 THEN 'loss' ELSE '' END AS status, CASE WHEN n_nationkey % 2 = 1 THEN 'D7' ELSE '' END AS defect FROM nation"


def fields_displayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All caption and holdings fields of records as they are shown."""
    shown = F.transform(F.filter("fields", lambda f: f["tag"].between("850", "866")), reading.display)
    return _file(spark, sf_dir).select("record_index", F.array_join(shown, "; ").alias("shown"))


FIELDS_DISPLAYED = """SELECT c_custkey AS record_index, '852 #0 $b ' || c_nationkey || '; ' || CASE c_custkey % 10 WHEN 7 THEN '853 20 $8 1 $a v. $i (year); 863 #0 $8 1.1 $a 1 $i 1980; ' WHEN 8 THEN '853 70 $8 3 $a bk.; ' ELSE '' END
|| '866 #0 $a ' || CASE WHEN c_custkey % 4 = 0 THEN 'v. ' || c_custkey || ' Suppl. (1990)' WHEN c_custkey % 4 = 1 THEN '? ' || c_custkey ELSE 'v.' || c_custkey || '(1990)' END || ' $z note; 866 #0 $a ' || CASE WHEN c_custkey % 3 = 0 THEN 'v. ' || (c_custkey + 1) || ' - v. ' || (c_custkey + 4) || ' no. 3 (1991 - Sep 1994)' ELSE 'v.' || (c_custkey + 1) || '(1991)' END AS shown FROM customer"""


def statements_projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """866s with their indicators and notes."""
    return records.statements(_file(spark, sf_dir)).groupBy("record_index").agg(F.count("*").alias("n"), F.min("ind2").alias("ind2"), F.max("z").alias("z"), F.max("x").alias("x"), F.max("scheme").alias("scheme"))


STATEMENTS_PROJECTED = "SELECT c_custkey AS record_index, 2::BIGINT AS n, '0' AS ind2, 'note' AS z, NULL::VARCHAR AS x, NULL::VARCHAR AS scheme FROM customer"


def notes_carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of an 866 on the last holdings field of its statement, and 866s that went."""
    r = _file(spark, sf_dir)
    made = records.convert_records(records.statements(r))
    out = records.apply(r, made, remove_866=True, clear_existing=True)
    last = F.element_at(F.filter("fields", lambda f: f["tag"] == "863"), 1)["subfields"]
    return out.select("record_index", F.array_join(F.transform(last, lambda s: F.concat(s["code"], s["value"])), " ").alias("first_863"), F.size(records.tagged("866")).alias("n_866"))


NOTES_CARRIED = """SELECT c_custkey AS record_index, '81.1 a' || CASE WHEN c_custkey % 4 < 2 THEN CASE WHEN c_custkey % 3 = 0 THEN (c_custkey + 1) || '-' || (c_custkey + 4) || ' i1991-1994' ELSE (c_custkey + 1) || ' i1991' END ELSE c_custkey || ' i1990 znote' END AS first_863, CASE WHEN c_custkey % 4 < 2 THEN 1 ELSE 0 END::INTEGER AS n_866 FROM customer"""


def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of records under several specifications; one that can't be read gives none."""
    r = _customers(spark, sf_dir)
    parts = [records.summary(r, spec).select(F.lit(spec).alias("spec"), "record_index", "identifier") for spec in ("001", "245$a", "245 $a", "852|b", "999", "")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


IDENTIFIERS = """SELECT '001' AS spec, c_custkey AS record_index, c_custkey::VARCHAR AS identifier FROM customer UNION ALL SELECT '245$a', c_custkey, c_mktsegment FROM customer UNION ALL SELECT '245 $a', c_custkey, c_mktsegment FROM customer
UNION ALL SELECT '852|b', c_custkey, c_nationkey::VARCHAR FROM customer UNION ALL SELECT '999', c_custkey, '' FROM customer UNION ALL SELECT '', c_custkey, '' FROM customer"""


def one_downloaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record, and the file name that its identifier makes."""
    one = reports.one_record(records.summary(_customers(spark, sf_dir), "245$a"), 7)
    return one.select("record_index", "title").withColumn("file", F.lit(reports.download_name("a/b ü" + "x" * 70, 7)))


ONE_DOWNLOADED = "SELECT c_custkey AS record_index, c_mktsegment AS title, 'a_b__' || repeat('x', 55) || '.mrc' AS file FROM customer WHERE c_custkey = 7"


def parsed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One statement at a time: its fields and the statement that they say."""
    rows = [(t, "; ".join(x["fields"]), x["rendered"], x["held"]) for t in ("v.3:no.2(1921:Feb.)-v.9:no.5(1927:May)", "? 4") for x in [reports.parse_text(t)]]
    return spark.createDataFrame(rows, "text string, fields string, rendered string, held boolean")


PARSED_TEXT = "SELECT * FROM (VALUES ('v.3:no.2(1921:Feb.)-v.9:no.5(1927:May)', '853 31 $8 1 $a v. $b no. $i (year) $j (month); 863 40 $8 1.1 $a 3-9 $b 2-5 $i 1921-1927 $j 02-05', 'v.3:no.2(1921:Feb.)-v.9:no.5(1927:May)', FALSE), ('? 4', '', NULL, TRUE)) AS t(text, fields, rendered, held)"


def requests_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options of requests, of which some can't be used."""
    asked = [None, {"parser_fallback": "no"}, {"parser_strict": True, "left_out_policy": "record"}, {"left_out_policy": "x", "skip_records": [1, "2", None, -3], "keep_separate": "5", "holdings_level": "3", "units_per_higher": "012", "remove_866": "on"}]
    rows = [(i, o.fallback, o.policy, o.level, o.per_higher, o.remove_866, len(o.skipped), len(o.separate)) for i, o in enumerate(map(sessions.Options.of, asked))]
    return spark.createDataFrame(rows, "nth int, fallback string, policy string, level string, units string, remove boolean, skipped int, separate int")


REQUESTS_READ = "SELECT * FROM (VALUES (0, 'parser', 'convert', '4', '', FALSE, 0, 0), (1, 'off', 'convert', '4', '', FALSE, 0, 0), (2, 'strict', 'record', '4', '', FALSE, 0, 0), (3, 'parser', 'convert', '3', '', TRUE, 2, 0)) AS t(nth, fallback, policy, level, units, remove, skipped, separate)"


def decisions_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored decisions, of which some can't be read."""
    raw = ['{"edits": [], "notes": {"1": "x"}, "batch": 3}', "{", "", '{"batch": {"remove_866": true}}', "[1]"]
    rows = [(i, len(d["notes"]), len(d["edits"]), d["batch"] is not None) for i, d in enumerate(map(sessions.decisions_from, raw))]
    return spark.createDataFrame(rows, "nth int, notes int, edits int, batch boolean")


DECISIONS_READ = "SELECT * FROM (VALUES (0, 1, 0, FALSE), (1, 0, 0, FALSE), (2, 0, 0, FALSE), (3, 0, 0, TRUE), (4, 0, 0, FALSE)) AS t(nth, notes, edits, batch)"

_NAMES = (statement_forms, statement_refusals, house_style, conventions, units_read, shape_forms, cluster_roles, library_faults, library_merged, roles_kept, expressions_converted, expressions_agree, expressions_tried, marc_round_trip, marc_statements, damaged_refused, corpus_scan, fields_displayed, statements_projected, notes_carried, identifiers, one_downloaded, parsed_text, requests_read, decisions_read)
QUERIES = {f.__name__: f for f in _NAMES}
ORACLES = {f.__name__: globals()[f.__name__.upper()] for f in _NAMES}
