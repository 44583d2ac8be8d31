"""Quality classifier and nearest neighbours: held-out accuracy, recall, and awkward rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempograph.llm import ann, quality
from tempograph.llm.queries import queries

DATA = "/root/testdata/sf0.01"


def test_quality_query(spark):
    found = {r["doc_id"]: r for r in queries()["op4_quality_classifier"](spark, DATA).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert len(found) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for d, r in found.items())
    held = [(found[d]["predicted"], y) for d, y in labels.items() if found[d]["held_out"]]
    assert np.mean([p == y for p, y in held]) > 0.95


def test_quality_of_awkward_rows(spark, tables, documents):
    found = queries()["op4_quality_classifier"](spark, tables).collect()
    assert len(found) == documents.count() and all(0 <= r["score"] <= 1 for r in found)
    model = quality.train(documents, spark.read.parquet(f"{tables}/labels.parquet"))
    kept = quality.kept(documents, model)
    assert kept.columns == documents.columns and kept.count() == sum(r["predicted"] for r in found)


def test_labels_of_the_held_out_fold_are_not_read(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    other = labels.withColumn("quality", F.when(quality.fold_of(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.train(docs, labels), quality.train(docs, other)
    assert all((a.w[k] == b.w[k]).all() for k in a.w)


def test_gradients():
    draw = np.random.default_rng(0)
    model = quality.Model(seed=1, hidden=5, gate=3)
    model.w = {k: draw.normal(0, 0.5, x.shape) for k, x in model.w.items()}
    x, counts, y = draw.normal(size=(7, quality.SIZE)), np.array([3, 1, 3]), np.array([1.0, 0.0, 1.0])
    loss = lambda: -np.mean(np.log(np.where(y == 1, p := model.forward(x, counts)["p"], 1 - p)))
    g = model.gradient(model.forward(x, counts), y, counts)
    for k, w in model.w.items():
        place = tuple(draw.integers(0, n) for n in w.shape)
        before = w[place]
        w[place] = before + 1e-5
        up = loss()
        w[place] = before - 1e-5
        down = loss()
        w[place] = before
        assert g[k][place] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_attention_sums_to_one_and_passages_cover_texts():
    x, counts = quality.encode(["", "a" * 600, "a" * 601, "é!" * 1000])
    assert counts.tolist() == [1, 1, 2, 4]
    alpha = quality.Model().forward(x, counts)["alpha"]
    np.testing.assert_allclose(np.add.reduceat(alpha, [0, 1, 2, 4]), 1, rtol=1e-5)


def test_without_labels_scores_are_a_half(spark, documents):
    model = quality.train(documents, spark.createDataFrame([], "doc_id long, quality int"))
    assert model.score(["some text", ""]).tolist() == [0.5, 0.5]


def nearest(rows, every=100, k=10):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], "f8")
    out = {}
    for q in np.unique(ids[ids % every == 0]):
        score = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        order = [p for p in np.lexsort((ids, score)) if ids[p] != q][:k]
        out[int(q)] = [(int(ids[p]), score[p]) for p in order]
    return out


def by_query(found):
    out = {}
    for r in found.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
    expected, found = nearest(rows), by_query(queries()["op7_nearest_neighbours"](spark, f"/root/testdata/{sf}"))
    assert set(found) == set(expected)
    hits = sum(len({v for v, _ in found[q]} & {v for v, _ in expected[q]}) for q in expected)
    assert hits >= 0.9 * sum(map(len, expected.values()))
    exact = {q: dict(own) for q, own in expected.items()}
    for q, own in found.items():
        assert own == sorted(own, key=lambda x: (x[1], x[0])) and all(s == pytest.approx(exact[q][v], rel=1e-12) for v, s in own if v in exact[q])


def test_few_and_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0]), (100, [3.0, 4.0]), (200, None), (None, [1.0, 1.0]), (1, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, list int, code string")
    found = by_query(ann.search(df))
    assert [v for v, _ in found[0]] == [1, 1, 2, 100] and set(found) == {0, 100}
    assert found[100][0][0] == 2 and found[100][0][1] == pytest.approx(18**0.5)
    assert ann.search(df.limit(0)).count() == 0


def test_a_vector_that_a_third_of_the_rows_hold(spark):
    draw = np.random.default_rng(0)
    rows = [(k, draw.normal(size=8).tolist() if k % 3 else [1.0] + [0.0] * 7) for k in range(9000)]
    found = by_query(ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=900, lists=64))
    expected = nearest(rows, 900)
    hits = sum(len({v for v, _ in found[q]} & {v for v, _ in expected[q]}) for q in expected)
    assert set(found) == set(expected) and hits >= 0.9 * 10 * len(expected)
    assert [v for v, _ in found[900]] == list(range(0, 30, 3))


def test_all_passages_of_a_long_text_are_learned_from(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality.Model, "fit", lambda self, bags, y: seen.extend(map(len, bags)))
    docs = spark.createDataFrame([(k, "a word " * 6000) for k in range(20)], "doc_id long, text string")
    quality.train(docs, docs.selectExpr("doc_id", "1 as quality"))
    assert set(seen) == {70}


def passage_numbers(text):
    """One passage's encoding by counting in plain Python, from the definitions."""
    out = [0.0] * quality.SIZE
    kinds = [int(quality.TABLE[min(ord(c), 256)]) for c in text]
    for k in kinds:
        out[k] += 1 / len(text)
    words = text.split()
    out[quality.FIGURES : quality.LETTERS_FROM] = [sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, len(words)), len(set(words)) / max(1, len(words)), len(words) / 600, len(text) / 600, sum(w.isupper() for w in words) / max(1, len(words))]
    for w in words:
        out[quality.WORDS_FROM + zlib.crc32(w.encode()) % quality.WORDS] += 1 / len(words)
    return out, kinds


def test_scores_against_a_forward_pass_in_plain_python(spark):
    """Every passage by itself, its weight from the gated attention layer, the weighted sum, the logistic output."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = quality.train(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    w = {k: v.astype("f8") for k, v in model.w.items()}
    for text in ["", "\u0434\u043e\u043c " * 300, "x" * 1801, *[r["text"] or "" for r in docs.orderBy("doc_id").limit(30).collect()]]:
        passages = [text[k : k + 600] for k in range(0, len(text), 600)] or [""]
        rows = quality.encode([text])[0].astype("f8")
        assert len(rows) == len(passages)
        for row, own in zip(rows, passages, strict=True):
            expected, kinds = passage_numbers(own) if own else ([0.0] * quality.SIZE, [])
            simple = [*range(quality.CLASSES), *range(quality.FIGURES, quality.LETTERS_FROM), *range(quality.WORDS_FROM, quality.SIZE)]
            np.testing.assert_allclose(row[simple], np.array(expected)[simple], atol=1e-6)
        hidden, energy = [], []
        for row in rows:
            h = np.tanh((row - model.mean) / model.scale @ w["W"] + w["b"])
            gate = 1 / (1 + np.exp(-(h @ w["U"])))
            hidden.append(h)
            energy.append(float((np.tanh(h @ w["V"]) * gate) @ w["a"][:, 0]))
        weights = np.exp(np.array(energy) - max(energy))
        z = sum(a * h for a, h in zip(weights / weights.sum(), hidden, strict=True))
        assert model.score([text])[0] == pytest.approx(1 / (1 + np.exp(-(float(z @ w["c"][:, 0]) + float(w["d"][0])))), abs=2e-5)


def test_words_of_every_script_tell_texts_apart():
    a, b = (quality.encode([t])[0] for t in ("\u0434\u043e\u043c \u043c\u0438\u0440 \u043b\u0435\u0441", "\u0440\u043e\u0442 \u0441\u043e\u043d \u0434\u0430\u0440"))
    assert (a[:, : quality.FIGURES] == b[:, : quality.FIGURES]).all() and (a != b).any()
    a, b = (quality.encode([t])[0] for t in ("\u7684\u4e00\u662f", "\u4eba\u5929\u5730"))
    assert (a != b).any()


def test_the_sample_is_bounded_in_passages(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality.Model, "fit", lambda self, bags, y: seen.extend(map(len, bags)))
    docs = spark.createDataFrame([(k, "a word " * (6000 if k % 2 else 10)) for k in range(40)], "doc_id long, text string")
    quality.train(docs, docs.selectExpr("doc_id", "1 as quality"), passages=200)
    assert sum(seen) <= 200 and set(seen) == {1, 70} and seen.count(1) > 8  # a long document that is too much does not end the sample


def test_queries_in_several_chunks_and_blocks(spark):
    draw = np.random.default_rng(5)
    rows = [(k, draw.normal(size=6).tolist()) for k in range(6000)]
    found = by_query(ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=20, most=50))
    expected = nearest(rows, 20)
    hits = sum(len({v for v, _ in found[q]} & {v for v, _ in expected[q]}) for q in expected)
    assert set(found) == set(expected) and hits >= 0.9 * 10 * len(expected)


def test_asymmetric_distances():
    draw = np.random.default_rng(6)
    x = draw.normal(size=(500, 10))
    index = ann.Index(x, 7, 4)
    near, codes, own = index.encode(x)
    coded = index.coarse[near] + np.hstack([book[codes[:, k]] for k, (_, _, book) in enumerate(index.parts())])
    q = draw.normal(size=10)
    told = ((index.coarse[near] - q) ** 2).sum(1) + own + index.table(q)[codes + 256 * np.arange(4)].sum(1)
    np.testing.assert_allclose(told, ((coded - q) ** 2).sum(1), rtol=1e-4, atol=1e-4)
