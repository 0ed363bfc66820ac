import os

import corpus_pipeline
from seriate.llm.common import new_path, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, docs, rows, tmp_path):
    kept = docs.select(*COLUMNS)
    before = {r[0] for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stored(stage(spark, kept, str(tmp_path)), f"test-{name}")
        assert kept.columns == COLUMNS
        now = {r["doc_id"] for r in kept.select("doc_id").collect()}
        assert now <= before and now
        before = now
        if name == "near_duplicates":
            assert kept.where("doc_id IS NOT NULL").count() == len(now - {None})
    assert corpus_pipeline.STAGES[-1][1](spark, kept, "").count() >= len(before)


def words(seed, n=60):
    import random

    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))


def test_near_copies_are_judged_by_row(spark):
    """Rows that share an id, but not their text, belong to groups of their own."""
    a, b, c, d = (words(i, 400) for i in range(4))
    near = a.rsplit(" ", 1)[0] + " other"
    rows = [(1, a), (5, a), (5, b), (7, c), (7, d), (8, near), (9, b), (9, b), (None, a), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 2, 3) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, near int, root int").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(1, a), (5, b), (7, c), (7, d), (None, a), (None, None)], key=str)


def test_of_equal_rows_one_stays(spark):
    a, b = words(1), words(2)
    rows = [(3, a, "x"), (3, a, "y"), (3, a, "x"), (4, a, "z"), (6, b, "x")]
    docs = spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    for _ in range(2):
        got = sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
        assert got == [(3, a), (6, b)]


def test_a_run_leaves_its_result_alone(spark, docs, tmp_path):
    docs.select(*COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    folder = os.path.dirname(new_path(spark, "x").removeprefix("file://"))
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0
    left = set(os.listdir(folder)) - before
    assert len(left) == 1 and next(iter(left)).startswith("pipeline-pack")
