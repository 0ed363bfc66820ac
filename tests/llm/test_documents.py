import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
import xxhash
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seriate.llm import components, langid, lm, mixing, packing, simhash, store, substrings, toxicity
from seriate.llm.common import word_hashes
from seriate.llm.tokens import encoder

WORDS = re.compile("[^\x20\x09-\x0d]+")
WORD_BPE, BYTE_BPE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))


@lru_cache
def tokenizer(path):
    return Tokenizer.from_file(path)


# ---- tokens ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
@settings(max_examples=250, deadline=None)
@given(text=st.lists(st.one_of(st.text(st.sampled_from("ab XÉéß.,!'s\n\t\r ́ 12$|<>endoftx中"), max_size=12), st.sampled_from(["<|endoftext|>", "<|startoftext|>", " <|endoftext|> ", "<|ENDOFTEXT|>", "a.\nB", "\n", "\n\n", "x\x1c y", "\x85"]))).map("".join))
def test_ids_are_the_tokenizers(path, text):
    assert np.frombuffer(encoder(path).ids(text), "<u2").tolist() == tokenizer(path).encode(text, add_special_tokens=False).ids


# ---- packing --------------------------------------------------------------------------------------------


def test_packing(docs, rows):
    tok = tokenizer(WORD_BPE)
    window = 256
    got = packing.pack(docs, WORD_BPE, window=window).collect()
    whole = Counter((r[0], len(tok.encode(r[1] or "", add_special_tokens=False).ids) + 1) for r in rows)
    assert Counter((r["doc_id"], r["doc_tokens"]) for r in got if r["start"] == 0) == whole
    at = defaultdict(list)
    for r in got:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for k, pieces in at.items():
        end = 0
        for off, n in sorted(pieces):
            assert off == end
            end += n
        assert end == window or k == max(at)
    assert sorted(at) == list(range(len(at)))
    ids = {r[0]: np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4") for r in rows}
    assert all(zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in got)
    assert sum(r["length"] for r in got) == sum(n * k for (_, n), k in whole.items())


# ---- store ----------------------------------------------------------------------------------------------


def test_store_round_trip(docs, rows):
    tok, at = tokenizer(BYTE_BPE), 0
    got = sorted(store.stored_ids(docs, BYTE_BPE).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda x: -1 if x is None else x)
    ids = {r[0]: np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4") for r in rows}
    for r in got:
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids[r["doc_id"]]), zlib.crc32(ids[r["doc_id"]].tobytes()))
        at += r["n_tokens"]


def test_chunks_are_stored_once_and_damage_is_found(spark, docs):
    folder = store.write(docs.repartition(7), BYTE_BPE)
    blocks = spark.read.parquet(f"{folder}/objects").collect()
    keys = [r["keys"][i : i + 16] for r in blocks for i in range(0, len(r["keys"]), 16)]
    assert len(keys) == len(set(keys)) == sum(len(r["sizes"]) // 2 for r in blocks)
    wanted = spark.read.parquet(f"{folder}/recipes").where("kind = 0").select("digests").collect()
    assert set(map(bytes, keys)) == {bytes(r["digests"][i : i + 16]) for r in wanted for i in range(0, len(r["digests"]), 16)}
    ids = store.unpacked(blocks[0]["body"]).copy()
    ids[0] += 1
    bad = {(blocks[0]["part"], blocks[0]["block"]): store.packed(ids)}
    spark.createDataFrame([(r["part"], r["block"], bytes(r["keys"]), bytes(r["sizes"]), bad.get((r["part"], r["block"]), bytes(r["body"]))) for r in blocks], store._OBJECTS).write.parquet(f"{folder}-damaged/objects")
    for part in ("recipes", "manifest"):
        spark.read.parquet(f"{folder}/{part}").withColumn("kind", F.lit(0) if part == "manifest" else F.col("kind")).write.partitionBy("kind").parquet(f"{folder}-damaged/{part}")
    with pytest.raises(Exception, match="digest"):
        store.read(spark, f"{folder}-damaged").collect()


def test_chunks_that_several_parts_hold_travel_once(spark, monkeypatch):
    monkeypatch.setattr(store, "SEGMENT", 3000)
    rng = random.Random(8)
    text = " ".join(f"w{rng.randrange(9999)}" for _ in range(3000))
    rows = [(i, text if i % 3 == 0 else " ".join(f"x{rng.randrange(9999)}" for _ in range(800)) + (text if i % 5 == 0 else "")) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: r for r in store.stored_ids(docs, BYTE_BPE).collect()}
    for i, t in rows:
        want = np.array([*tokenizer(BYTE_BPE).encode(t, add_special_tokens=False).ids, 2], "<u4")
        assert (got[i]["n_tokens"], got[i]["ids_crc32"]) == (len(want), zlib.crc32(want.tobytes()))


def test_cuts_follow_content():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 50_000, 20_000).astype(np.uint16)
    b = np.concatenate([rng.integers(0, 50_000, 700).astype(np.uint16), a])
    ends_a, ends_b = store.cuts(a), store.cuts(b)
    assert ends_a[-1] == len(a) and len({x + 700 for x in ends_a} & set(ends_b)) > 0.8 * len(ends_a)
    assert all(y - x <= store.MOST for x, y in zip([0, *ends_a], ends_a, strict=False))
    assert store.cuts(a[:1]) == [1] and store.cuts(np.zeros(10_000, np.uint16))[-1] == 10_000


# ---- SimHash --------------------------------------------------------------------------------------------


def fingerprint(text):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def least(ids, linked):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_simhash_equals_brute_force(docs, rows):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    fp = {r[0]: fingerprint(r[1]) for r in rows}
    assert all(r["fp"] % (1 << 64) == fp[r["doc_id"]] for r in got)
    ids = [i for i in fp if i is not None]
    near = [(a, b) for a in fp for b in fp if (fp[a] ^ fp[b]).bit_count() <= 3]
    # a row without an id may link others
    key = lambda x: 10**9 if x is None else x
    want = least([key(i) for i in fp], [(key(a), key(b)) for a, b in near])
    assert all(r["component_id"] == want[r["doc_id"]] for r in got if r["doc_id"] in ids)


def test_trie_join_finds_every_near_pair():
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(300)]
    keys = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) for b in base for _ in range(4)} | {b & ~((1 << 20) - 1) | rng.getrandbits(8) for b in base[:1] for _ in range(100)})
    a = np.array(keys, np.uint64)
    own = simhash.self_join(a, 0, 3)
    want = least(range(len(keys)), [(i, j) for i in range(len(keys)) for j in range(i) if (keys[i] ^ keys[j]).bit_count() <= 3])
    assert own.roots(np.arange(len(keys))).tolist() == [want[i] for i in range(len(keys))]


@pytest.mark.parametrize("hot", [50, 3])
def test_hot_blocks_lose_no_link(spark, monkeypatch, hot):
    rng = random.Random(5)
    head = rng.getrandbits(16) << 48
    fps = [head | rng.getrandbits(48) for _ in range(150)]
    fps += [f ^ (1 << rng.randrange(48)) ^ (1 << rng.randrange(48)) for f in fps[:60]]
    fps += [fps[0] & ~0xFFFFFFFFF | rng.getrandbits(36) for _ in range(40)]  # one slice in common
    fps += [f ^ (1 << rng.randrange(36)) ^ (1 << rng.randrange(36)) ^ (1 << rng.randrange(36)) for f in fps[-40:]]
    monkeypatch.setattr(simhash, "HOT", hot)
    signed = [f - (1 << 64) if f >> 63 else f for f in dict.fromkeys(fps)]
    found = components.components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))).collect()
    want = least(signed, [(a, b) for a in signed for b in signed if ((a ^ b) % (1 << 64)).bit_count() <= 3])
    assert {r["node"]: r["root"] for r in found} == {k: v for k, v in want.items() if v != k or k in [x for y, x in want.items() if y != x]}


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


# ---- passages -------------------------------------------------------------------------------------------


def kept(rows, size=13):
    first = {}
    texts = [(r[0], WORDS.findall(r[1] or "")) for r in rows]
    for i, w in texts:
        for j in range(len(w) - size + 1):
            if i is not None:
                k = tuple(w[j : j + size])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, w in texts:
        gone = {j + d for j in range(len(w) - size + 1) if i is not None and first[tuple(w[j : j + size])] < i for d in range(size)}
        left = [x for j, x in enumerate(w) if j not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(left).encode()).hexdigest()))
    return Counter(out)


def test_passages_equal_brute_force(docs, rows):
    assert Counter(map(tuple, substrings.dedup(docs).collect())) == kept(rows)


def test_passages_across_blocks_and_branches(spark, monkeypatch):
    rng = random.Random(9)
    line = [f"w{i}" for i in range(300)]
    rows = [(3, " ".join(line), "", "", 0), (5, " ".join(["x", *line[20:280], "y", *line[100:140], *line[:30]]), "", "", 0), (4, " ".join([*line[:150], "z", *line[150:]]), "", "", 0), (9, " ".join("ab"[rng.random() < 0.5] for _ in range(400)), "", "", 0), (8, "a " * 60, "", "", 0), (2, " ".join(line[200:]), "", "", 0)]
    monkeypatch.setattr(substrings, "BLOCK", 16)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert Counter(map(tuple, substrings.dedup(docs).collect())) == kept(rows)


def test_deduplicated_keeps_columns_and_clean_texts(docs, rows):
    out = substrings.deduplicated(docs)
    assert out.columns == docs.columns
    got = Counter((r["doc_id"], hashlib.sha256(" ".join(WORDS.findall(r["text"] or "")).encode()).hexdigest()) for r in out.collect())
    assert got == Counter((i, h) for (i, _, _, h), n in kept(rows).items() for _ in range(n))


# ---- mixing ---------------------------------------------------------------------------------------------


def test_mixing(docs, rows):
    got = mixing.mix(docs).collect()
    size = lambda t: len(WORDS.findall(t or ""))
    by = Counter()
    for r in rows:
        by[r[3]] += size(r[1])
    order = sorted(by, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, target, free = sum(by.values()), {}, set(order)
    while free:
        left, w = total - sum(target.values()), sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / w > 3 * by[s] + 1e-9}
        if not over:
            target |= {s: left * weight[s] / w for s in free}
            break
        target |= {s: 3 * by[s] for s in over}
        free -= over
    of = {r[0]: r[3] for r in rows}
    taken = Counter()
    for r in got:
        s = of[r["doc_id"]]
        assert r["target"] == pytest.approx(target[s]) and r["source_size"] == by[s] and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    most = {s: max(size(r[1]) for r in rows if r[3] == s) for s in order}
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 2 * most[s] for s in order)
    assert Counter(map(tuple, mixing.mix(docs.repartition(5)).collect())) == Counter(map(tuple, got))
    copies = Counter(r["doc_id"] for r in mixing.mixed_documents(docs).collect())
    want = Counter()
    for r in got:
        want[r["doc_id"]] += r["copies"]
    assert copies == +want


# ---- learned operators ----------------------------------------------------------------------------------


def test_language(docs, rows):
    got = {r["doc_id"]: r for r in langid.predict(docs).collect()}
    of = {r[0]: r for r in rows}
    clear = [i for i, r in of.items() if r[1] and len(r[1]) > 80 and i is not None and i % 7 != 3 and i % 11 != 5 and i < 60]
    assert sum(got[i]["lang_pred"] == of[i][2] for i in clear) >= 0.95 * len(clear)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (61, 62, 63, 64))
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items() if i is not None)
    kept_ = langid.accepted(docs)
    assert kept_.columns == docs.columns and set(clear) <= {r["doc_id"] for r in kept_.collect()}


def test_toxicity(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        sents = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 8))) for _ in range(rng.randint(1, 12))]
        bad = rng.random() < 0.25
        if bad:
            k = rng.randrange(len(sents))
            sents[k] += " " + rng.choice(["scum", "idiot", "trash"])
        rows.append((i, ". ".join(sents) + ".", "en", "s", 1))
        labels.append((i, 0, int(bad)))
    rows += [(1000, None, None, None, None), (1001, "", "en", "s", 0), (None, "scum", "en", "s", 1)]
    labels += [(2000, 0, 1), (3, 0, None), (None, 1, 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(d, lab).collect()}
    held = [i for i, _, t in labels if i in got and t is not None and i is not None and got[i]["held_out"]]
    truth = {i: t for i, _, t in labels}
    assert sum(got[i]["predicted"] == truth[i] for i in held) >= 0.97 * len(held)
    assert got[1000]["score"] == got[1001]["score"] == 0 and got[None]["predicted"] == 1
    hit = next(i for i in held if truth[i] and got[i]["predicted"])
    found = toxicity.sentences(next(r[1] for r in rows if r[0] == hit).encode())
    assert all({b"scum", b"idiot", b"trash"} & set(found[k]) for k in got[hit]["offending"])
    none = toxicity.score(d, lab.where("toxic = 0")).collect()
    assert {r["score"] for r in none} == {0.0}


def test_language_model(docs, rows):
    got = lm.score(docs).collect()
    tokens = lambda t: [*WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    crc = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5
    c = Counter(w for r in rows if crc(r[0]) != 1 for w in tokens(r[1]))
    n, v = sum(c.values()), len(c)
    of = {r[0]: r for r in rows}
    for r in got:
        t = tokens(of[r["doc_id"]][1])
        base = sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        assert r["base_score"] == pytest.approx(base) and r["n_tokens"] == len(t) and r["n_known"] == sum(c[w] > 0 for w in t) and r["train_tokens"] == n
        assert r["held_out"] == (crc(r["doc_id"]) == 1)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) and held


def trigram(texts):
    """The model's definition, by plain dictionaries: log10 probability of a list of tokens that ends with None."""
    one, two, three = Counter(), Counter(), Counter()
    for t in texts:
        one.update(t)
        two.update(zip(t, t[1:], strict=False))
        three.update(zip(t, t[1:], t[2:], strict=False))
    n, v, d = sum(one.values()), len(one), lm.DISCOUNT
    after1, after2 = Counter(p[:1] for p in two), Counter(p[:2] for p in three)

    def probability(w, before):
        p = (one[w] + 0.5) / (n + 0.5 * (v + 1))
        if before and after1[before[-1:]]:
            c = one[before[-1]]
            p = max(0, two[before[-1], w] - d) / c + d * after1[before[-1:]] / c * p
        if len(before) > 1 and after2[before[-2:]]:
            c = two[before[-2:]]
            p = max(0, three[*before[-2:], w] - d) / c + d * after2[before[-2:]] / c * p
        return p

    return lambda t: sum(np.log10(probability(w, tuple(t[max(0, i - 2) : i]))) for i, w in enumerate(t))


def test_scores_equal_a_model_of_dictionaries(docs, rows):
    tokens = lambda t: [*WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    crc = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5
    of, want = {r[0]: tokens(r[1]) for r in rows}, trigram([tokens(r[1]) for r in rows if crc(r[0]) != 1])
    for r in lm.score(docs).collect():
        t = of[r["doc_id"]]
        # probabilities are kept to 1/4096 of a power of ten, in two levels and their weights
        assert r["score"] == pytest.approx(want(t), abs=4 * len(t) / lm.SCALE)


def test_word_hashes_tell_words_apart_and_nothing_else():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"ab \n\t\xc3c") for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    texts += [b"x" * 600_000 + b" a", b"a " * 200_000, b" " + b"y" * 262_144 + b" z", b"ab" * 40 + b" q", b"\v\f\r\x1c\xa0"]
    h, n = word_hashes(texts)
    words = [t.split() for t in texts]
    assert n.tolist() == [len(w) for w in words]
    of = {}
    for w, x in zip([w for t in words for w in t], h.tolist(), strict=True):
        assert of.setdefault(w, x) == x
    assert len(set(of.values())) == len(of)


def codes(text):
    """The model's hashes of a text's words and of its end."""
    return next(lm.hashed([text.encode()]))[0]


def test_model_probabilities_sum_to_one(spark):
    texts = ["a b c a b d", "a b c", "b c a b", "a b d d", "c a b c"] * 3
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    model = lm.train(d)
    h = {w: codes(w)[0] for w in "abcdz"} | {"end": lm.END}
    for context in ("a", "ab", "bc", "zz"):
        last = [lm.probabilities(model, np.array([*(h[x] for x in context), h[w]], np.uint64))[2][-1] for w in h]
        assert sum(last) == pytest.approx(1, abs=5e-3)
    # the trie against counts
    pairs = Counter(p for t in texts for w in [t.split()] for p in zip(w, w[1:], strict=False))
    known = lm.probabilities(model, np.array([h["a"], h["b"]], np.uint64))[2][1]
    assert known > (pairs["a", "b"] - 1) / sum(t.split().count("a") for t in texts) - 1e-3


def test_model_keeps_what_training_saw_once(spark):
    d = spark.createDataFrame([("a b c",), ("a d",), ("c b a",)], "text string")
    model = lm.train(d)
    _, base, p = lm.probabilities(model, codes("a b c")[:3])
    # 11 tokens of 5 words; a comes thrice and has three successors, b twice and has two, the pair a b once
    assert base[1] == pytest.approx(2.5 / 14)
    two = lambda n, successors, count, below: (n - lm.DISCOUNT) / count + lm.DISCOUNT * successors / count * below
    assert p[1] == pytest.approx(two(1, 3, 3, base[1]), rel=1e-2)
    assert p[2] == pytest.approx(two(1, 1, 1, two(1, 2, 2, base[2])), rel=1e-2)


def test_weights_near_one_still_tell_that_something_follows():
    got = lm._weights(np.array([0.9999, 1.0, 0.5]), np.array([True, False, True]))
    assert got[0] == 1 and got[1] == 0 and got[2] == round(np.log10(2) * lm.SCALE)


def test_model_in_more_shards_is_the_same(spark, docs, monkeypatch):
    want = sorted(map(str, lm.score(docs).collect()))
    monkeypatch.setattr(lm, "SHARD_TOKENS", 200)
    assert sorted(map(str, lm.score(docs).collect())) == want


@given(st.lists(st.integers(0, 2**40), max_size=200), st.lists(st.integers(0, 2**40), max_size=20))
@settings(deadline=None)
def test_elias_fano(values, others):
    values = sorted(values)
    e = lm.EliasFano.of(np.array(values, np.uint64))
    if values:
        assert e[np.arange(len(values))].tolist() == values
    ask = np.array(values + others, np.uint64)
    for x, at in zip(ask.tolist(), e.find(ask).tolist(), strict=True):
        assert (at == -1) == (x not in values) and (at < 0 or values[at] == x)


# ---- empty tables ---------------------------------------------------------------------------------------


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (packing.pack(empty, WORD_BPE), store.stored_ids(empty, BYTE_BPE), simhash.near_duplicates(empty), substrings.dedup(empty), substrings.deduplicated(empty), mixing.mix(empty), mixing.mixed_documents(empty), langid.predict(empty), langid.accepted(empty), toxicity.score(empty, labels), lm.score(empty)):
        assert out.collect() == []


# ---- odd tables -----------------------------------------------------------------------------------------


NAMES = ["whole", "threshold", "target", "source_size", "b_source", "mix", "mix_u", "copies", "prefix", "need"]


def test_mixing_keeps_columns_whatever_their_names(spark, docs, rows):
    named = docs.select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(i).alias(n) for i, n in enumerate(NAMES)])
    got = mixing.mixed_documents(named)
    assert got.columns == named.columns
    plain = mixing.mixed_documents(docs.select("doc_id", "text", "lang", "source", "n_chars"))
    assert Counter(r["doc_id"] for r in got.collect()) == Counter(r["doc_id"] for r in plain.collect())


def test_passages_keep_columns_whatever_their_names(spark, docs):
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    named = plain.select("*", F.lit(1).alias("passage"), F.lit("x").alias("passage_text"), F.lit(2).alias("cuts"), F.lit(3).alias("t"))
    got = substrings.deduplicated(named)
    assert got.columns == named.columns and {(r["passage"], r["passage_text"], r["cuts"], r["t"]) for r in got.collect()} == {(1, "x", 2, 3)}
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter((r["doc_id"], r["text"]) for r in substrings.deduplicated(plain).collect())


def test_a_source_without_ids_still_meets_its_target(spark):
    rng = random.Random(4)
    rows = [(None, " ".join("w" for _ in range(rng.randint(5, 30))) + f" {i}", "en", "a", 1) for i in range(300)]
    rows += [(None, "same words here", "en", "b", 1)] * 500 + [(7, f"other {i} text", "en", "c", 1) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        taken[r["source_size"]] += r["taken"]
    for r in {(r["source_size"], r["target"]) for r in got}:
        assert abs(taken[r[0]] - r[1]) <= 31
    assert Counter(map(tuple, mixing.mix(docs.repartition(2)).collect())) == Counter(map(tuple, got))
    copies = Counter(r["source"] for r in mixing.mixed_documents(docs).collect())
    size = {"a": sum(len(r[1].split()) for r in rows if r[3] == "a"), "b": 1500, "c": 1200}
    want = Counter({s: sum(r["copies"] for r in got if r["source_size"] == n) for s, n in size.items()})
    assert copies == want


def test_very_long_words_and_line_breaks(spark):
    long = "x" * 400_000
    rows = [(1, long), (2, long + " tail"), (3, f"{long}\u2003{long}"), (4, "\n".join(["line"] * 5000)), (5, " \u00a0 "), (6, "\x1c"), (7, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert Counter(map(tuple, substrings.dedup(docs).collect())) == kept([(i, t) for i, t in rows])
    tok = tokenizer(WORD_BPE)
    got = {r["doc_id"]: r["doc_tokens"] for r in packing.pack(docs, WORD_BPE).collect()}
    assert got == {i: len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in rows}
    assert {r["doc_id"]: r["fp"] % (1 << 64) for r in simhash.near_duplicates(docs).collect()} == {i: fingerprint(t) for i, t in rows}
    assert lm.score(docs).count() == langid.predict(docs).count() == len(rows)


# ---- learned operators against plain definitions ----------------------------------------------------------


def test_language_sizes_are_those_of_direct_compression(docs):
    raw = langid.learned(docs)
    assert len({len(x) for x in raw.values()}) == 1 and set(raw) == {"de", "en"}
    classify = langid.Classifier(raw)
    for text in ("ung schei Über 12 chch", "the, an: re?on", "x" * 9000):
        data = re.sub(r"[\W\d_]+", " ", text.lower()).encode()
        for lang, size in zip(classify.langs, classify.sizes(text), strict=True):
            d = zstandard.ZstdCompressionDict(raw[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
            assert size == sum(len(own.compress(data[i : i + langid.PIECE])) for i in range(0, len(data), langid.PIECE))


def test_languages_that_tie_are_rejected():
    same = b"one two three four five six seven"
    classify = langid.Classifier({"a": same, "b": same}, margin=0.0)
    lang, score, margin, rejected = classify("two three")
    assert (lang, margin, rejected) == ("a", 0.0, True) and score == pytest.approx(0.5)


def test_texts_of_several_languages_are_not_learned(spark):
    shared = "gemeinsam " * 50
    rows = [(i, f"{shared}" if i % 2 else f"own words of {lang} {i} " * 20, lang, "s", 1) for lang in ("aa", "bb") for i in range(40 * (lang == "bb"), 40 + 40 * (lang == "bb"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert all(b"gemeinsam" not in raw for raw in langid.learned(docs).values())


@given(st.lists(st.lists(st.sampled_from([b"bad", b"worse", b"fine", b"well"]), max_size=4), max_size=6))
@settings(deadline=None)
def test_noisy_or_is_its_formula(bag):
    model = (-3.0, {b"bad": 2.5, b"worse": 4.0})
    text = b". ".join(b" ".join(s) for s in bag)
    p = [1 / (1 + np.exp(3.0 - sum({b"bad": 2.5, b"worse": 4.0}.get(w, 0) for w in set(s)))) for s in bag if s]
    score, offending = toxicity.scored(text, model)
    assert score == pytest.approx(1 - np.prod([1 - x for x in p]) if p else 0, abs=1e-12)
    assert offending == [i for i, x in enumerate(p) if x >= 0.5]


def test_training_climbs_the_likelihood_of_the_noisy_or():
    words = {b"bad": 0, b"fine": 1}
    texts = [b"fine. fine", b"fine. bad", b"bad", b"fine"] * 30
    labels = [0, 1, 1, 0] * 30
    bags = [[[list(k), n] for k, n in toxicity.bag(t, words).items()] for t in texts]
    bias, weights = toxicity.trained(bags, labels, 2, 0.5)
    model = bias, dict(zip(words, weights, strict=True))

    def likelihood(m):
        p = [min(max(toxicity.scored(t, m)[0], 1e-12), 1 - 1e-12) for t in texts]
        return sum(np.log(x if y else 1 - x) for x, y in zip(p, labels, strict=True))

    assert likelihood(model) > likelihood((-6.0, {b"bad": 0.0, b"fine": 0.0})) and toxicity.scored(b"bad", model)[0] > 0.5 > toxicity.scored(b"fine. fine", model)[0]
    assert toxicity.trained(bags, [0] * len(bags), 2, 0.5) is None
