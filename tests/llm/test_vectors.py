import numpy as np
import pytest

from seriate.llm import ann, topk

VEC = "vec_id long, embedding array<float>, label int"


def table(spark, v, extra=()):
    rows = [(i, [float(x) for x in r], 0) for i, r in enumerate(v)]
    return spark.createDataFrame(rows + list(extra), VEC).repartition(3)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(size=(700, 16)), rng.normal(size=(1, 16)).repeat(300, 0) + rng.normal(size=(300, 16)) * 1e-3, np.ones((60, 16)) * 0.5])
    return v.astype(np.float32)


ODD = [(5000, None, 0), (5001, [None] + [1.0] * 15, 0), (5002, [float("nan")] * 16, 0), (5003, [float("inf")] * 16, 0), (5020, [0.0] * 16, 0), (5100, [1.0] * 3, 0), (5101, [2.0] * 3, 0), (None, [1.0] * 16, 0), (5200, [], 0)]


def test_topk_is_exact(spark, vectors):
    t = table(spark, vectors, ODD)
    got = topk.search(t, t.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect()
    q = np.floor(1024 * np.concatenate([vectors.astype(float), np.zeros((1, 16))])).astype(int)
    ids = np.r_[np.arange(len(vectors)), 5020]
    for query in [i for i in ids if i % 100 == 0]:
        s = q @ q[list(ids).index(query)]
        want = sorted(((-x, i) for x, i in zip(s, ids, strict=True) if i != query))[:10]
        assert [(-r["score"], r["vec_id"]) for r in got if r["query_id"] == query] == want
    assert [(r["vec_id"], r["score"]) for r in got if r["query_id"] == 5100] == [(5101, 3 * 2 * 1024 * 1024)]


def test_blocks_leave_out_only_what_cannot_win():
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(20, 8)) * 900
    v = np.floor(centre.repeat(100, 0) + rng.normal(size=(2000, 8)) * 20)
    blocks = topk.Blocks(np.arange(2000), v)
    for i in (0, 777, 1999):
        ids, score = blocks.search(i, v[i], blocks.bounds(v[i : i + 1])[0], 10)
        s = v @ v[i]
        assert [(int(a), float(b)) for a, b in zip(ids, score, strict=True)] == [(int(j), float(s[j])) for j in sorted(set(range(2000)) - {i}, key=lambda j: (-s[j], j))[:10]]


def test_topk_counts_repeated_rows_once(spark):
    v = np.random.default_rng(3).normal(size=(100, 6)).astype(np.float32)
    again = [(i, [float(x) for x in v[i] * f], 0) for i in range(100) for f in (1.0, 0.5, *([1.0] * 12 if i < 10 else []))]
    t = table(spark, v, again)
    got = topk.search(t, table(spark, v).where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()
    q, half = np.floor(1024 * v.astype(float)).astype(int), np.floor(1024 * (v * np.float32(0.5)).astype(float)).astype(int)
    for query in range(0, 100, 20):
        s = np.maximum(q @ q[query], half @ q[query])
        want = sorted((-x, i) for i, x in enumerate(s) if i != query)[:10]
        assert [(-r["score"], r["vec_id"]) for r in got if r["query_id"] == query] == want


def test_huge_components_stay_exact(spark):
    t = spark.createDataFrame([(0, [2.0e6, 1.0]), (1, [2.0e6, 2.0]), (2, [2.0e6, 3.0])], "vec_id long, embedding array<double>")
    got = topk.search(t, t.where("vec_id = 0")).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(i, (1024 * 2_000_000) ** 2 + 1024 * 1024 * (i + 1)) for i in (2, 1)]


def test_ann_recall_and_scores(spark, vectors):
    t = table(spark, vectors, ODD)
    got = ann.search(t, t.where("vec_id % 20 = 0")).collect()
    v = vectors.astype(float)
    hit = total = 0
    for q in range(0, len(v), 20):
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1)) and q not in [r["vec_id"] for r in mine]
        assert all(r["score"] == pytest.approx(v[q] @ v[r["vec_id"]], abs=1e-9) for r in mine)
        assert all(a["score"] > b["score"] or (a["score"] == b["score"] and a["vec_id"] < b["vec_id"]) for a, b in zip(mine, mine[1:], strict=False))
        s = v @ v[q]
        s[q] = -np.inf
        kth = np.sort(s)[-20]
        hit += sum(r["score"] >= kth - 1e-9 for r in mine[:20])
        total += 20
    assert hit / total >= 0.9
    assert [r["vec_id"] for r in got if r["query_id"] == 5100] == [5101]
    assert not {5000, 5001, 5002, 5003, 5020, 5200} & {r["vec_id"] for r in got} | {r["query_id"] for r in got} & {5020, 5200}


def test_ann_of_other_norms_finds_products(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(800, 8)) * rng.exponential(size=(800, 1))
    t = table(spark, v)
    got = ann.search(t, t.where("vec_id % 20 = 0")).collect()
    v = v.astype(np.float32).astype(float)
    hit = 0
    for q in range(0, 800, 20):
        s = v @ v[q]
        s[q] = -np.inf
        hit += len(set(np.argsort(-s)[:20].tolist()) & {r["vec_id"] for r in got if r["query_id"] == q})
    assert hit / (40 * 20) >= 0.9


def test_ann_fit_reaches_its_target_for_many_rows():
    v = np.random.default_rng(2).normal(size=(2048, 64))
    v /= np.sqrt((v * v).sum(1))[:, None]
    index = ann.fitted(v, 12_000_000, 1.0)
    s = v[:60] @ v.T
    s[np.arange(60), np.arange(60)] = -np.inf
    cells, visits = index.base(v), index.visited(v[:60])
    hit = sum(any(cells[t, j] in visits[t, i] for t in range(index.tables)) for i in range(60) for j in np.argsort(-s[i])[:20])
    assert hit / (60 * 20) >= 0.95


def test_ann_without_a_fitting_hash_is_exact(spark, monkeypatch):
    monkeypatch.setattr(ann, "TARGET", 1.1)
    v = np.random.default_rng(5).normal(size=(300, 8)).astype(np.float32)
    t = table(spark, v)
    got = ann.search(t, t.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()
    v = v.astype(float)
    for q in range(0, 300, 50):
        s = v @ v[q]
        s[q] = -np.inf
        assert [r["vec_id"] for r in got if r["query_id"] == q] == np.argsort(-s, kind="stable")[:20].tolist()


@pytest.mark.parametrize("rows", [5_000_000, 50_000_000])
def test_ann_fit_holds_at_any_assumed_size(rows):
    rng = np.random.default_rng(6)
    flat = rng.normal(size=(2000, 64))  # without any structure, where hashing helps least
    centre = rng.normal(size=(40, 64)) * 2
    lumpy = centre[rng.integers(0, 40, 2000)] + rng.normal(size=(2000, 64)) * 0.3
    shares = []
    for v in (flat, lumpy):
        v = v / np.sqrt((v * v).sum(1))[:, None]
        index = ann.fitted(v, rows, 1.0)
        assert index.recall >= 0.9 and 0 < index.share <= 1
        s = v[:60] @ v.T
        s[np.arange(60), np.arange(60)] = -np.inf
        cells, visits = index.base(v), index.visited(v[:60])
        hit = sum(any(cells[t, j] in visits[t, i] for t in range(index.tables)) for i in range(60) for j in np.argsort(-s[i])[:20])
        assert hit / (60 * 20) >= 0.9
        shares.append(index.share)
    assert shares[1] < 0.2 and shares[1] < shares[0]


def test_ann_of_repeated_ids_and_clashing_names(spark):
    v = np.random.default_rng(8).normal(size=(200, 6)).astype(np.float32)
    again = [(i, [float(x) for x in v[i] * f], 0) for i in range(200) for f in (0.5, 1.0)]
    t = table(spark, v, again)
    named = t.selectExpr("*", "1 AS v", "2 AS cell", "3 AS query_id", "4 AS g", "5 AS n", "6 AS score", "7 AS dim", "8 AS side")
    got = ann.search(named, table(spark, v).where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()
    v = v.astype(float)
    for q in range(0, 200, 20):
        mine = [r["vec_id"] for r in got if r["query_id"] == q]
        assert len(mine) == len(set(mine)) == 20 and q not in mine
        assert all(r["score"] == pytest.approx(max(v[q] @ v[r["vec_id"]], v[q] @ (v[r["vec_id"]] * 0.5)), abs=1e-6) for r in got if r["query_id"] == q)
    top = topk.search(named, named.where("vec_id % 100 = 0")).collect()
    assert {r["query_id"] for r in top} == {0, 100} and len(top) == 20


def test_ann_orders_large_equal_vectors_by_id(spark):
    v = np.random.default_rng(9).normal(size=6) * 1e5
    t = spark.createDataFrame([(i, [float(x) for x in v]) for i in range(60)] + [(100, [float(x) for x in v * 0.9])], "vec_id long, embedding array<double>")
    got = [r["vec_id"] for r in ann.search(t, t.where("vec_id = 40")).orderBy("rank").collect()]
    assert got == list(range(20))


def test_topk_scores_beyond_64_bits_are_the_nearest_number(spark):
    t = spark.createDataFrame([(0, [1.0e9, 0.0]), (1, [1.0e9, 1.0]), (2, [-1.0e9, 1.0]), (3, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = topk.search(t, t.where("vec_id = 0")).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 2**63 - 1), (3, 1024 * 1024 * 10**9), (2, -(2**63))]


def test_topk_over_many_groups(spark, monkeypatch):
    monkeypatch.setattr(topk, "LEAST", 50)
    monkeypatch.setattr(topk, "MOST", 60)
    rng = np.random.default_rng(10)
    v = np.concatenate([rng.normal(size=(500, 8)), np.ones((100, 8)) * 3]).astype(np.float32)
    t = table(spark, v)
    got = topk.search(t, t.where("vec_id % 25 = 0")).orderBy("query_id", "rank").collect()
    q = np.floor(1024 * v.astype(float)).astype(int)
    for i in range(0, 600, 25):
        s = q @ q[i]
        assert [(r["vec_id"], r["score"]) for r in got if r["query_id"] == i] == [(j, s[j]) for j in sorted(set(range(600)) - {i}, key=lambda j: (-s[j], j))[:10]]


def test_perturbations_come_in_order():
    sets = ann.perturbations(4, 81)
    assert sets[0] == () and sets[1] == (1,) and len(set(sets)) == len(sets) == 81


def test_empty(spark):
    t = spark.createDataFrame([], VEC)
    assert ann.search(t, t).collect() == [] and topk.search(t, t).collect() == []
