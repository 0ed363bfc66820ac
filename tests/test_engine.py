import math
import os

import duckdb
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from seriate.functions import budget, dialects, grammar, shape
from seriate.operators import decisions, patterns, quality, reading, records, review, sessions
from seriate.plans import form_queries, queries, review_queries
from seriate.sources import marc
from seriate.streaming import holdings

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else round(float(v), 9) if isinstance(v, float) else v


ALL = queries.QUERIES | review_queries.QUERIES | form_queries.QUERIES
SQL = queries.ORACLES | review_queries.ORACLES | form_queries.ORACLES


@pytest.mark.parametrize("name", ALL)
def test_query_equals_sql(spark, con, name):
    got = ALL[name](spark, SF)
    want = con.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    key = lambda r: tuple(map(str, r))
    a = sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=key)
    b = sorted((tuple(plain(v) for v in r) for r in want.select(*[f'"{c}"' for c in cols]).fetchall()), key=key)
    assert a == b


# ---- records --------------------------------------------------------------------------------------------


def folded(texts, existing=(), **options):
    rows = [{"field_index": i, "parsed": grammar.read(t)} for i, t in enumerate(texts)]
    out = records.fold(rows, list(existing), **options)
    return out, [[dict(f["subfields"])["8"] for f in r["fields_863"]] for r in out]


def test_gapped_runs_share_a_link():
    assert folded(["v.3(1920)-v.8(1925)", "v.11(1928)-v.14(1931)"])[1] == [["1.1"], ["1.2"]]


@pytest.mark.parametrize("texts", [["v.4(1924)", "v.5:no.2(1925:Feb.)"], ["v.5:no.2(1925:Feb.)", "v.4(1924)"]])
def test_the_fuller_pattern_is_shared(texts):
    out, links = folded(texts)
    assert sum(r["field_853"] is not None for r in out) == 1
    assert dict(out[0]["field_853"]["subfields"])["j"] == "(month)" and {x for xs in links for x in xs} == {"1.1", "1.2"}


def test_month_season_month_opens_three_runs():
    assert folded(["v.6(May 1931)", "v.7(Winter 1932)", "v.8(May 1933)"])[1] == [["1.1"], ["2.1"], ["3.1"]]


def test_a_held_statement_breaks_no_run():
    assert folded(["v.2(1911)", "? 88", "v.5(1914)"])[1] == [["1.1"], [], ["1.2"]]


def test_links_step_over_those_in_use_and_conform():
    old = {"tag": "853", "ind1": "2", "ind2": "0", "subfields": [("8", "1"), ("a", "v.")]}
    assert folded(["v.2(1931)-v.6(1935)"], [old])[1] == [["2.1"]]
    assert folded(["v.7"], [old])[1] == [["1.1"]]


def test_without_merging_patterns_stay_apart():
    assert folded(["v.4(1924)", "v.5:no.2(1925:Feb.)"], merge=False)[1] == [["1.1"], ["2.1"]]


def test_season_between_statements_is_flagged():
    out, _ = folded(["v.6(May 1931)", "v.7(1932)", "v.8(Winter 1933)"])
    assert [r["flagged"] for r in out] == [False, False, True]


# ---- shape and patterns ---------------------------------------------------------------------------------


def test_shapes():
    assert shape.signature("v.9(1931)") == shape.signature("Vol. 4 (1932)")
    assert [k for k, _ in shape.tokens("1799 1800 2099 2100") if k != "SPACE"] == ["NUMBER", "YEAR", "YEAR", "NUMBER"]
    made = shape.pattern(["v.2(1931)-v.8(1937)"])
    assert made["groups"] == ["start_vol", "start_year", "end_vol", "end_year"]
    assert shape.pattern(["v.2-8(1931-1937)"])["groups"] == ["start_vol", "end_vol", "start_year", "end_year"]
    assert shape.label("v.2-8(1931-1937)") == "VOL-VOL(YEAR-YEAR)"
    assert shape.label("v. 6 no. 3/4-v. 9 no. 11/12 (1931-1934)") == "VOL ISS — VOL ISS(YEAR-YEAR)"
    assert len(shape.split_runs("v.2(1931)-v.4(1933), v.6(1935)- / v.8(1937)-")) == 3
    assert all(len(shape.split_runs(t)) == 1 for t in ("v.2(1931, 1932)", "1931/32", "v.2/3(1931)"))
    assert shape.pattern([" ".join(f"v.{i}" for i in range(40))])["declined"]


def test_sums_of_a_signature_add_up_in_any_order():
    texts = ["v.1 Suppl. (1990)", "Vol. 22 Supplement (1991)", "volume 3 Sup (1992)"]
    want = shape.pattern(texts)
    a, b, c = (shape.State.loads(shape.State.of(t, i).dumps()) for i, t in enumerate(texts))
    assert c.plus(b).plus(a).pattern() == a.plus(b.plus(c)).pattern() == want and c.plus(a.plus(b)).text == texts[0]
    assert c.plus(a.plus(b)).variants() == {"VOL_CAP": ["volume", "vol.", "v."]}


def test_library_keeps_repeated_ids_and_tells_what_it_ignores():
    one = lambda i, rx: {"id": i, "label": "", "regex": rx, "roles": [], "skip": True}
    kept, errors = patterns.load([one("p", "a"), one("p", "b")])
    assert [p.regex for p in kept] == ["a", "b"] and len({p.id for p in kept}) == 2 and not errors
    kept, errors = patterns.load([one(str(i), f"x{i}") for i in range(203)])
    assert len(kept) == 200 and "3 more were ignored" in errors[0]


def test_clusters_of_hard_shapes(spark):
    texts = ["v.7 Suppl. (1931)", "? 5", "v. 7 - v. 9 no. 4 (1931 - May 1933)"]
    got = patterns.clusters(spark.createDataFrame(list(enumerate(texts)), "pos long, text string")).select("label", F.array_join("groups", ",").alias("groups")).collect()
    assert sorted(map(tuple, got)) == sorted([("VOL ‹Suppl.›(YEAR)", "start_vol,start_year"), ("‹?› NUM", "start_num"), ("VOL — VOL ISS(YEAR-CHRON YEAR)", "start_vol,end_vol,start_iss,start_year,start_month,end_year")])


def test_library(spark):
    roles = patterns.infer_roles(["start_num", "start_iss", "start_year"])
    assert [r.kind for r in roles] == ["enum", "enum", "year"] and roles[0].suggested
    good = patterns.Pattern("p", "", r"(?P<start_vol>\d+)", patterns.infer_roles(["start_vol"]))
    assert patterns.faults(good) == [] and patterns.faults(patterns.Pattern("q", "", "(", []))
    again, errors = patterns.load(patterns.export([good, good]))
    assert len(again) == 1 and errors
    assert patterns.read_by("12", again)[0] == "p" and patterns.read_by("v.1(1990)", again)[0] == "parser"
    assert patterns.read_by("x", again, "off")[0] == "unmatched" and patterns.load({"schema": 2})[1]


def test_dialects():
    rx = r"v\.(?P<start_vol>\d+)\s*(?:no\.)?"
    assert dialects.convert(rx, "java").groups == ("startVol",)
    assert "(?<start_vol>" in dialects.convert(rx, "pcre").text
    assert dialects.convert(rx, "oracle").text == r"^(v\.([[:digit:]]+)[[:space:]]*(no\.)?)$"
    assert dialects.convert("(?=x)y", "oracle").error and dialects.convert("(", "java").error and dialects.convert("a", "none").error
    assert dialects.convert("^ab$", "python", whole=False).text == "ab"


def test_java_dialect_agrees_with_python(spark):
    rx = r"v\.(?P<start_vol>\d+)(?:-(?P<end_vol>\d+))?\s*\((?P<start_year>\d{4})\)"
    texts = ["v.1(1990)", "V.1-2 (1990)", "v.(1990)", "v.1(1990)x"]
    import re

    java = dialects.convert(rx, "java").text
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(F.col("t").rlike(java)).collect()
    assert [r[0] for r in got] == [bool(re.fullmatch(rx, t, re.I)) for t in texts]


def test_budget():
    assert budget.match(r"v\.(?P<n>\d+)", ["v.1", "xv.2"])[0]["groups"] == {"n": "1"}
    assert budget.runaways([r"(\s*a+)*b", r"v\.\d+"], seconds=0.7) == [r"(\s*a+)*b"]


# ---- sources, decisions, quality, streaming ---------------------------------------------------------------


def test_marc_round_trip(spark, tmp_path):
    spark.dataSource.register(marc.MarcSource)
    sub = [{"code": "a", "value": "v.1 (1990) – ü"}]
    fields = [{"pos": 0, "tag": "001", "ind1": None, "ind2": None, "data": "x1", "subfields": []}, {"pos": 1, "tag": "866", "ind1": " ", "ind2": "0", "data": None, "subfields": sub}]
    one = marc.encode("00000cy  a2200000   4500", fields)
    (tmp_path / "in.mrc").write_bytes(one + b"00030broken\x1d" + one)
    r = spark.read.format("marc2709").load(str(tmp_path / "in.mrc"))
    rows = r.orderBy("record_index").collect()
    assert [x["unreadable"] for x in rows] == [False, True, False]
    assert rows[0]["fields"][1]["subfields"][0]["value"] == sub[0]["value"]
    with pytest.raises(ValueError, match="2"):
        quality.refuse_unreadable(r)
    r.where("NOT unreadable").coalesce(1).write.format("marc2709").mode("overwrite").save(str(tmp_path / "out"))
    assert b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*.mrc"))) == one + one
    assert [s["text"] for s in records.statements(r).collect()] == [sub[0]["value"]] * 2


def test_corpus(spark, tmp_path):
    (tmp_path / "c.txt").write_text("# note\n[section: one]\nv.1(1990) # [x3] loss:D4\nv.2\n")
    rows = marc.corpus(spark, str(tmp_path / "c.txt")).orderBy("line").collect()
    assert [(r["section"], r["text"], r["times"], r["status"], r["defect"]) for r in rows] == [("one", "v.1(1990)", 3, "loss", "D4"), ("one", "v.2", 1, "", "")]


def test_own_holdings_are_kept(spark):
    own = [Row(pos=0, tag="863", ind1=" ", ind2=" ", data=None, subfields=[Row(code="8", value="1.1")]), Row(pos=1, tag="866", ind1=" ", ind2=" ", data=None, subfields=[Row(code="a", value="v.1(1990)"), Row(code="z", value="note")])]
    from seriate.functions.schemas import RECORDS

    r = spark.createDataFrame([("f", 0, "leader", own, False), ("f", 1, "leader", own[1:], False)], RECORDS)
    made = records.convert_records(records.statements(r).select("record_index", F.col("field_index").cast("int").alias("field_index"), "text"), records.existing_853s(r))
    rows = records.apply(r, made).orderBy("record_index").collect()
    assert [f["tag"] for f in rows[0]["fields"]] == ["863", "866"]
    assert [f["tag"] for f in rows[1]["fields"]] == ["853", "863", "866"]
    assert [s["code"] for s in rows[1]["fields"][1]["subfields"]] == ["8", "a", "i", "z"]
    cleared = records.apply(r, made, clear_existing=True, remove_866=True).orderBy("record_index").collect()
    assert [f["tag"] for f in cleared[0]["fields"]] == ["853", "863"]


def test_policies(spark):
    rows = spark.createDataFrame([(1, [("left_out", "x")]), (1, []), (2, [])], "record_index int, warnings array<struct<kind: string, text: string>>")
    hold = lambda p: [r["hold"] for r in decisions.under_policy(rows, p).orderBy("record_index", F.size("warnings").desc()).collect()]
    assert hold("convert") == [False] * 3 and hold("statement") == [True, False, False] and hold("record") == [True, True, False]


def test_native_display_and_nulls(spark):
    s = spark.createDataFrame([("v.9(1931)-",), (None,), ("",)], "text string")
    rows = {r["text"]: r["shown"] for r in reading.read_statements(s).select("text", reading.display(F.get("converted.fields_863", F.lit(0))).alias("shown")).collect()}
    assert rows["v.9(1931)-"] == "863 40 $8 1.1 $a 9- $i 1931-"


def test_stream_gives_what_a_batch_gives(spark, tmp_path):
    s = spark.createDataFrame([(1, 0, "v.1(1990)"), (1, 1, "? 3")], "record_index bigint, field_index int, text string")
    s.write.parquet(str(tmp_path / "in"))
    holdings.to_table(holdings.statements(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("text", "converted.held").collect()
    assert sorted(map(tuple, got)) == [("? 3", True), ("v.1(1990)", False)]


# ---- what came in later ---------------------------------------------------------------------------------


def test_dialects_say_what_holds_on_and_refuse_settings():
    of = lambda rx, d: dialects.convert(rx, d, whole=False)
    assert of(r"\d++", "pcre").text == r"\d++" and of(r"(?>\d+)", "java").text == r"(?>\d+)"
    assert of(r"\d++", "dotnet").text == r"(?>\d+)"
    assert "possessive" in of(r"\d++", "javascript").error and "atomic" in of(r"(?>\d+)", "oracle").error
    assert of(r"(?i)v(?#a note)\.\d", "pcre").text == r"v\.\d" and of(r"(?i:v)\d", "java").text == r"(?:v)\d"
    assert "(?x)" in of(r"(?x)v \. \d", "pcre").error and "(?s)" in of(r"(?s:.)", "java").error
    assert [bool(x.error) for x in dialects.convert_all(["a", "("], "java")] == [False, True]


def test_runaways_never_enter_a_library(monkeypatch):
    monkeypatch.setattr(budget, "SECONDS", 0.7)
    monkeypatch.setattr(patterns.budget, "runaways", lambda rx, texts: budget_runaways(rx, texts, 0.7))
    raw = lambda i, rx: {"id": i, "label": i, "regex": rx, "roles": [{"group": "start_vol", "boundary": "start", "kind": "enum", "level": 0}]}
    good, bad = raw("good", r"v\.(?P<start_vol>\d+)"), raw("bad", r"(?P<start_vol>(\s*a+)*)b")
    kept, errors = patterns.load([good, bad])
    assert [p.id for p in kept] == ["good"] and any("bad" in e and "time" in e for e in errors)
    kept, errors = patterns.load([good, bad], known=frozenset([bad["regex"]]))
    assert len(kept) == 2 and not errors


budget_runaways = budget.runaways


def test_libraries_merge_or_replace_and_old_roles_are_read():
    one = lambda i, n: {"id": i, "label": "", "regex": r"(?P<start_vol>\d+)", "priority": n, "roles": [{"group": "start_vol", "level": "vol"}]}
    old, _ = patterns.load([one("a", 1), one("b", 2)], probe=False)
    new, _ = patterns.load([one("b", 9)], probe=False)
    assert [(p.id, p.priority) for p in patterns.merged_library(old, new)] == [("b", 9), ("a", 1)]
    assert [p.id for p in patterns.merged_library(old, new, replace=True)] == ["b"]
    assert (old[0].roles[0].kind, old[0].roles[0].caption, old[0].roles[0].level) == ("enum", "v.", 0)
    assert patterns.load("{not json")[1] and patterns.load([{"no": "pattern"}])[1] and patterns.load('"x"')[1]
    assert sessions.library_from(sessions.library_text(old))[0].id == "b" and sessions.library_from(b"broken") == []


def test_requests_and_stored_decisions_are_coerced():
    o = sessions.Options.of({"parser_fallback": "no", "left_out_policy": "x", "skip_records": [1, "2", None, -3], "keep_separate": "5", "holdings_level": "9", "units_per_higher": "012", "remove_866": "on"})
    assert (o.fallback, o.policy, o.skipped, o.separate, o.level, o.per_higher, o.remove_866) == ("off", "convert", {1, 2}, frozenset(), "4", "", True)
    assert sessions.Options.of({"parser_strict": True}).fallback == "strict" and sessions.Options.of(None) == sessions.Options()
    got = sessions.decisions_from('{"edits": [], "notes": {"1": "x"}, "batch": 3}')
    assert got == {"records": {}, "batch": None, "edits": {}, "notes": {"1": "x"}, "record_853": {}} and sessions.decisions_from("{")["records"] == {}


def test_store_keeps_and_forgets(tmp_path):
    store = sessions.Store(str(tmp_path))
    name = store.save("upload", b"x")
    assert store.load("upload", name) == b"x" and store.load("upload", "0" * 32) is None
    with pytest.raises(ValueError):
        store.load("upload", "../../etc/passwd")
    os.utime(tmp_path / "upload" / name, (0, 0))
    assert store.load("upload", name) is None and store.sweep() == 1


def test_split_files_append_and_oversize(spark, tmp_path, monkeypatch):
    spark.dataSource.register(marc.MarcSource)
    made = [marc.encode("00000cy  a2200000   4500", [{"pos": 0, "tag": "001", "ind1": None, "ind2": None, "data": f"x{i:03d}", "subfields": []}]) for i in range(50)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.mrc").write_bytes(b"".join(made[:30]))
    (tmp_path / "in" / "b.mrc").write_bytes(b"".join(made[30:]))
    monkeypatch.setattr(marc, "SPLIT_BYTES", 100)
    r = marc.numbered(spark.read.format("marc2709").load(str(tmp_path / "in")))
    assert [(x["record_index"], x["fields"][0]["data"]) for x in r.orderBy("record_index").collect()] == [(i, f"x{i:03d}") for i in range(50)]
    out = str(tmp_path / "out")
    for _ in range(2):
        r.where("record_index < 3").coalesce(1).write.format("marc2709").mode("append").save(out)
    assert spark.read.format("marc2709").load(out).count() == 6
    sub = lambda n: [{"pos": 0, "tag": "500", "ind1": " ", "ind2": " ", "data": None, "subfields": [{"code": "a", "value": "x" * n}]}]
    with pytest.raises(ValueError, match="9999"):
        marc.encode("", sub(10_000))
    with pytest.raises(ValueError, match="99999"):
        marc.encode("", sub(9_000) * 12)
    scan = marc.statement_scan(spark, str(tmp_path / "in" / "a.mrc"))
    assert scan.columns == ["place", "text"] and scan.count() == 0


def test_upload_and_log(spark, tmp_path):
    fields = [{"pos": 0, "tag": "001", "ind1": None, "ind2": None, "data": "n1", "subfields": []}, {"pos": 1, "tag": "866", "ind1": " ", "ind2": "0", "data": None, "subfields": [{"code": "a", "value": "v. 4 no. 5-v. 6 no. 7 (1931-Winter 1933)"}]}]
    (tmp_path / "u.mrc").write_bytes(marc.encode("00000cy  a2200000   4500", fields))
    got = sessions.uploaded(spark, str(tmp_path / "u.mrc"), "001")
    assert got["summary"].first()["identifier"] == "n1" and got["statements"].count() == 1
    for policy, what in (("convert", "Converted, part left out"), ("statement", "Not converted"), ("record", "Left as uploaded")):
        made = records.convert_records(got["statements"], policy=policy)
        rows = review.rows(got["records"], made, reading.read_statements(got["statements"]), "001")
        found = review.log(got["records"], made, rows)
        assert what in {r["what"] for r in found.collect()}
    review.write_log(found, str(tmp_path / "log"))
    body = b"".join(p.read_bytes() for p in (tmp_path / "log").glob("part-*"))
    assert body.startswith(b"\xef\xbb\xbfRecord,Identifier,Title,What,866,Details") and b"n1" in body


def test_a_split_at_the_change_asks_nothing():
    rows = [{"field_index": 0, "parsed": grammar.read("v.1(Mar. 1990)"), "origin": 4}, {"field_index": 1, "parsed": grammar.read("v.2(Spring 1991)"), "origin": 4}]
    out = records.fold(rows, [])
    assert [r["flagged"] for r in out] == [False, False] and out[1]["change"] == "split"
    old = {"tag": "853", "ind1": "2", "ind2": "0", "subfields": [("8", "1"), ("a", "v."), ("i", "(year)"), ("j", "(month)")]}
    out = records.fold([{"field_index": 0, "parsed": grammar.read("v.2(Spring 1991)")}], [old])
    assert out[0]["change"] == "existing" and out[0]["flagged"] and out[0]["link"] == "2"


def test_a_record_may_span_batches(spark):
    rows = [(r, i, f"v.{i}({1900 + i})") for r in range(3) for i in range(1, 60)]
    s = spark.createDataFrame(rows, "record_index bigint, field_index int, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = records.fields_863(records.convert_records(s)).select("record_index", "field_index", "seq", "link").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got)) == [(r, i, i, "1") for r in range(3) for i in range(1, 60)]


def test_statements_without_text_are_held(spark):
    s = spark.createDataFrame([(1, 0, None), (1, 1, "v.1(1990)"), (None, 0, "v.1(1990)")], "record_index bigint, field_index int, text string")
    got = {(r["record_index"], r["field_index"]): r["held"] for r in records.convert_records(s).collect()}
    assert got == {(1, 0): True, (1, 1): False, (None, 0): False}


def test_engine_stands_without_the_training_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    top = Path(__file__).resolve().parents[1]
    for name in ("seriate", "tests"):
        shutil.copytree(top / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(top / "__spark_entry__.py", tmp_path)
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q); import tests.test_engine"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr


def test_splits_reach_the_fold_through_statements_and_records(spark):
    s = spark.createDataFrame([(1, 0, "v.6(May 1931), v.7(Winter 1932)", None, None), (2, 0, "v.6(May 1931)", None, None), (2, 1, "v.7(Winter 1932)", None, None)], "record_index bigint, field_index int, text string, z string, x string")
    splits = spark.createDataFrame([(1, 0, ["v.6(May 1931)", "v.7(Winter 1932)"])], "record_index bigint, field_index int, parts array<string>")
    got = {(r["record_index"], r["text"]): r for r in records.convert_records(decisions.split(s, splits)).collect()}
    assert got[1, "v.7(Winter 1932)"]["change"] == "split" and not got[1, "v.7(Winter 1932)"]["flagged"]
    assert got[2, "v.7(Winter 1932)"]["change"] == "between" and got[2, "v.7(Winter 1932)"]["flagged"]
    from seriate.functions.schemas import RECORDS

    f = lambda t: Row(pos=0, tag="866", ind1=" ", ind2=" ", data=None, subfields=[Row(code="a", value=t)])
    r = spark.createDataFrame([("f", 1, "l", [f("both")], False), ("f", 2, "l", [f("v.6(May 1931)"), f("v.7(Winter 1932)")], False)], RECORDS)
    out = sessions.rebuilt(r, batch=sessions.Options(remove_866=True), splits=splits).orderBy("record_index").collect()
    assert [[x["tag"] for x in y["fields"]] for y in out] == [["853", "853", "863", "863"]] * 2 and out[0].asDict().keys() == {*r.columns, "decided"}


def test_records_that_skip_or_keep_stay_as_they_are(spark):
    from seriate.functions.schemas import RECORDS

    f = lambda tag, **subs: Row(pos=0, tag=tag, ind1=" ", ind2=" ", data=None, subfields=[Row(code=c[1:], value=v) for c, v in subs.items()])
    rows = [("f", i, "l", [f("853", _8="1", _a="v."), f("863", **{"_8": "1.1", "_a": "1"}), f("866", _a="v.6(1931)")], False) for i in range(3)]
    r = spark.createDataFrame(rows, RECORDS)
    out = sessions.rebuilt(r, batch=sessions.Options(skipped=frozenset([0]), remove_866=True), own={1: sessions.Options(clear_existing=True)}).orderBy("record_index").collect()
    assert [x["decided"] for x in out] == ["skipped", "own", "batch"]
    assert out[0]["fields"] == out[2]["fields"] == r.where("record_index = 0").first()["fields"]
    assert [reading_shown(x) for x in out[1]["fields"]] == ["853 8=1 a=v. i=(year)", "863 8=1.1 a=6 i=1931", "866 a=v.6(1931)"]


def reading_shown(field):
    return " ".join([field["tag"], *(f"{s['code']}={s['value']}" for s in field["subfields"])])
