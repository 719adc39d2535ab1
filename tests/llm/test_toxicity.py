"""The toxicity network: features and scores against plain loops, gradients by its training, held-out accuracy."""

import zlib

import numpy as np
import pytest

from supplyscope.llm import toxicity as ops

DOCS = "doc_id long, text string, lang string, source string, toxic int, id string, score double, order string"
LABELS = "doc_id long, quality int, toxic int, text string, lang string"


def made_corpus(n, seed):
    """Clean words at random; toxic texts hold one of three stems with an ending, each language its own."""
    rng = np.random.default_rng(seed)
    syllables = [a + b for a in "bdfklm" for b in "aeiou"]
    stems = {"x": ["zorgu", "vryza"], "y": ["quxti"]}
    docs, labels = [], []
    for k in range(n):
        lang = "xy"[k % 2]
        words = ["".join(rng.choice(syllables, rng.integers(1, 5))) for _ in range(int(rng.integers(3, 60)))]
        bad = rng.random() < 0.3
        if bad:
            words.insert(int(rng.integers(0, len(words))), str(rng.choice(stems[lang])) + str(rng.choice(syllables)))
        docs.append((k, " ".join(words).capitalize(), lang, "s", 9, "i", 0.5, "o"))
        labels.append((k, 1, int(bad), "t", "l"))
    return docs, labels


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = made_corpus(600, 1)
    frames = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    from pyspark.sql import functions as F

    return ops.fit(*frames, ops.not_held_out(F.col("id")))


def plain_features(word):
    """The same pieces one by one; equal hashes must mean equal pieces."""
    marked = f"<{word}>"
    return [("word", word)] + [(n, marked[k : k + n]) for n in range(3, 7) for k in range(len(marked) - n + 1)]


def test_features_are_the_pieces_of_a_word():
    words = ["a", "ab", "abcabcabc", "éß", "a" * 30, "ab<", "😀x"]
    hashes, owners = ops.features(words)
    names = {}
    for k, w in enumerate(words):
        assert len(plain_features(w)) == (owners == k).sum()
    flat = sorted((h, k) for h, k in zip(hashes.tolist(), owners.tolist()))
    pieces = {}
    for w in words:
        for f in plain_features(w):
            pieces.setdefault(f, []).append(w)
    # as many different hashes as different pieces, shared by the same words
    assert len({h for h, _ in flat}) == len(pieces)
    for h, k in flat:
        names.setdefault(h, []).append(words[k])
    assert sorted(map(sorted, names.values())) == sorted(map(sorted, pieces.values()))


def plain_logit(network, text):
    words = ops.words_of(text) or [""]
    table = {"": np.zeros(ops.DIM)}
    table.update({w: ops.embed([w], network.known, network.vectors)[0] for w in words if w})
    x = [table[w] for w in words] + [np.zeros(ops.DIM)] * max(ops.WIDTHS)
    total = network.base
    for n, (width, w, b) in enumerate(zip(ops.WIDTHS, network.filters, network.bias)):
        for f in range(ops.FILTERS):
            best = max(b[f] + sum(float(x[t + j] @ w[j][:, f]) for j in range(width)) for t in range(len(words)))
            total += max(best, 0) * network.weights[n * ops.FILTERS + f]
    return total


def test_scores_as_plain_loops(model, monkeypatch):
    network = ops.Network(ops.get(model["net"]))
    texts = [d[1] for d in made_corpus(12, 5)[0]] + [None, "", "!?", "word", "two words"]
    want = [plain_logit(network, t) for t in texts]
    assert np.allclose(network.logits(texts), want, atol=1e-3)
    # stretches and a small table of words change nothing
    monkeypatch.setattr(ops, "STRETCH", 7)
    monkeypatch.setattr(ops, "CACHE_WORDS", 5)
    assert np.allclose(ops.Network(ops.get(model["net"])).logits(texts), want, atol=1e-3)


def test_finds_held_out_toxic_texts(spark, model):
    docs, labels = made_corpus(500, 2)
    scored = ops.score_texts(spark.createDataFrame(docs, DOCS), model, keep=("lang",))
    rows = scored.withColumn("flagged", ops.flagged(scored["score"], scored["lang"], model)).collect()
    truth = {d: t for d, _, t, *_ in labels}
    assert len(rows) == 500 and set(model["limits"]) == {"x", "y"}
    for hit in (lambda r: r["score"] >= 0.3, lambda r: r["flagged"]):
        found = {r["doc_id"] for r in rows if hit(r)}
        toxic = {d for d, t in truth.items() if t}
        assert len(found & toxic) >= 0.9 * len(toxic) and len(found - toxic) <= 0.05 * len(docs)


def test_long_texts_are_learned_from(spark):
    """The toxic stems stand in texts of more than 20,000 characters only."""
    from pyspark.sql import functions as F

    docs, labels = made_corpus(300, 6)
    filler = "bada " * 4500
    long = [(d[0], d[1] + " " + filler if label[2] else d[1], *d[2:]) for d, label in zip(docs, labels)]
    model = ops.fit(spark.createDataFrame(long, DOCS), spark.createDataFrame(labels, LABELS), F.lit(True))
    fresh, truth = made_corpus(200, 7)
    got = {r["doc_id"]: r["score"] for r in ops.score_texts(spark.createDataFrame(fresh, DOCS), model).collect()}
    toxic = {d for d, _, t, *_ in truth if t}
    assert sum(got[d] >= 0.3 for d in toxic) >= 0.9 * len(toxic)
    assert sum(got[d] >= 0.3 for d in got.keys() - toxic) <= 0.05 * len(got)


def test_shards_train_one_network(spark, monkeypatch):
    """Each shard has a few documents; a document on its own is no shard's whole knowledge."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(ops, "SHARD_DOCS", 60)
    docs, labels = made_corpus(600, 1)
    model = ops.fit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), F.lit(True))
    fresh, truth = made_corpus(300, 8)
    got = {r["doc_id"]: r["score"] for r in ops.score_texts(spark.createDataFrame(fresh, DOCS), model).collect()}
    toxic = {d for d, _, t, *_ in truth if t}
    assert sum(got[d] >= 0.3 for d in toxic) >= 0.9 * len(toxic)
    assert sum(got[d] >= 0.3 for d in got.keys() - toxic) <= 0.05 * len(got)


def test_every_labelled_document_is_counted(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(ops, "CHUNK", 3)
    monkeypatch.setattr(ops, "HELD_FEATURES", 50)
    texts = ["abc abc", "ABC de", None, "", "abcd", "de " * 9000, "abc", "xyz"]
    docs = [(k, t, "x", "s", 1, "i", 0.5, "o") for k, t in enumerate(texts)]
    docs += [(0, "abc twice", "x", "s", 1, "i", 0.5, "o"), (None, "abc", "x", "s", 1, "i", 0.5, "o")]
    labels = [(k, 1, int(k in (1, 5)), "t", "l") for k in range(7)] + [(5, 1, 0, "t", "l"), (99, 1, 1, "t", "l"), (None, 1, 1, "t", "l")]
    rows, n, shares = ops.labelled_texts(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), F.lit(True), "doc_id", "text", "lang")
    assert sum(n.values()) == 8 and sum(v for (_, toxic), v in n.items() if toxic) == 2 and shares == (5, 3)
    got = {r["feature"]: (r["n"], r["bad"]) for r in ops.count_features(rows).collect()}
    word = lambda w: int(ops.features([w])[0].view(np.int64)[0])
    assert got[word("abc")] == (4, 1) and got[word("de")] == (2, 2) and got[word("abcd")] == (1, 0) and word("xyz") not in got


def test_compact_texts_have_the_same_answers():
    rng = np.random.default_rng(4)
    number = {"": (), "o": (), "bad": (0,), "worse": (0, 1)}
    params = ops.first_params(np.ones(2), 5)
    for params_bias in params[4:7]:
        params_bias[:] = rng.normal(size=ops.FILTERS)
    for _ in range(60):
        words = [str(w) for w in rng.choice(["o", "o", "o", "bad", "worse"], int(rng.integers(0, 25)))]
        full = [number[w] for w in words or [""]]
        plain = ops.Examples([np.array([x for w in full for x in (len(w), *w)], "<i4").tobytes()])
        short = ops.Examples([np.array(ops.compact(words, number), "<i4").tobytes()])
        assert np.allclose(plain.logits(params), short.logits(params), atol=1e-5)
        assert len(short.docs[0]) <= max(len(words), 1)


def test_odd_rows(spark, model):
    docs = [(1000 + d[0], *d[1:]) for d in made_corpus(3, 3)[0]]
    long = "Bada " * 130_000 + "zorguba " + "dilo " * 60_000
    odd = [(1, None), (2, ""), (2, ""), (None, "bada"), (4, long), (5, "퟿ 😀 \x00")]
    rows = [(i, t, None, "s", 1, "i", 0.5, "o") for i, t in odd] + docs
    got = ops.score_texts(spark.createDataFrame(rows, DOCS), model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by_id = {r["doc_id"]: r["score"] for r in got}
    assert by_id[1] == by_id[2] < 0.3 and by_id[4] >= 0.3


def test_nothing_to_learn_from(spark):
    from pyspark.sql import functions as F

    docs, labels = made_corpus(5, 4)
    table = spark.createDataFrame(docs, DOCS)
    for given, want in (([], 0.0), ([(1, 1, 1, "t", "l"), (None, 1, 0, "t", "l"), (2, 1, None, "t", "l")], 1.0), ([(1, 1, 0, "t", "l")], 0.0)):
        model = ops.fit(table, spark.createDataFrame(given, LABELS), F.lit(True))
        assert [r["score"] for r in ops.score_texts(table, model).collect()] == [want] * 5
    empty = spark.createDataFrame([], DOCS)
    model = ops.fit(empty, spark.createDataFrame(labels, LABELS), F.lit(True))
    assert ops.score_texts(empty, model).collect() == []


def test_surprise_needs_more_than_chance():
    n = np.full(20_000, 3)
    assert ops.surprise(n, n, 0.3).max() == 0  # three of three is nothing among 20,000 features
    assert ops.surprise(np.append(n, 40), np.append(n, 40), 0.3)[-1] > 1
    assert ops.surprise(np.array([0, 5]), np.array([400, 50]), 0.3).max() == 0


def test_thresholds_and_calibration():
    score, toxic = np.array([0.9, 0.8, 0.7, 0.2, 0.1]), np.array([1, 1, 0, 0, 0])
    assert ops.best_threshold(score, toxic) == pytest.approx(0.75)
    rng = np.random.default_rng(0)
    z = np.concatenate([rng.normal(2, 1, 4000), rng.normal(-2, 1, 4000)])
    y = np.repeat([1.0, 0.0], 4000)
    slope, shift = ops.calibrate(z, y, np.where(y > 0, 0.2, 1.8))
    p = ops.sigmoid(slope * z + shift)
    assert (p * np.where(y > 0, 0.2, 1.8)).sum() == pytest.approx(800, rel=0.02)


def test_registered_query(spark):
    from supplyscope.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op12_toxicity"](spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(d["doc_id"] for d in docs)
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    judged = [r for r in rows if r["held_out"] and r["doc_id"] in toxic]
    found = sum(toxic[r["doc_id"]] for r in judged if r["predicted"])
    assert found >= 0.6 * sum(toxic[r["doc_id"]] for r in judged)
    assert found >= 0.8 * sum(r["predicted"] for r in judged)
