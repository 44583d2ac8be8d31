import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from awkward import words
from tempograph.llm import near_dedup
from tempograph.llm.queries import queries

DATA = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    own = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(zip(*[own[k:] for k in range(5)], strict=False)) if len(own) >= 5 else frozenset([tuple(own)] if own else [])


def brute(rows):
    """component of each id by comparing all pairs that share a shingle."""
    sets = {d: shingle_set(t) for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = defaultdict(list)
    for d in sorted(sets):
        common = Counter()
        for s in sets[d]:
            common.update(held[s])
            held[s].append(d)
        for e, n in common.items():
            if 100 * n >= 75 * (len(sets[d]) + len(sets[e]) - n):
                a, b = root(d), root(e)
                parent[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), root(d)) for d in sets}


def check(found, rows):
    expected = brute([r for r in rows if r[0] is not None])
    for r in found:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == expected[r["doc_id"]], r
            assert r["kept"] == (r["doc_id"] == r["component_id"])


@pytest.mark.parametrize("where", ["data", "awkward"])
def test_query(spark, tables, where):
    path = DATA if where == "data" else tables
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    found = queries()["op10_near_dedup"](spark, path).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(d for d, _ in rows)
    check(found, rows)


def variants(base, n, seed, most):
    draw, own = np.random.default_rng(seed), base.split()
    for k in range(n):
        out = list(own)
        for place in draw.choice(len(out), draw.integers(1, most), replace=False):
            out[place] = f"w{seed}x{k}y{place}"
        yield " ".join(out)


@pytest.fixture
def hot(spark):
    """A third copies, a chain of near copies of every similarity around the threshold, and texts that only share a passage."""
    texts = [words(50, 120)] * 200
    texts += [v for s in range(3) for v in variants(words(60 + s, 150), 90, s, 14)]
    passage = words(70, 60)
    texts += [f"{passage} {words(100 + k, 90)}" for k in range(60)]
    return [(k, t) for k, t in enumerate(np.random.default_rng(0).permutation(np.array(texts, dtype=object)).tolist())]


@pytest.mark.parametrize("block", [512, 16])
def test_hot_groups(spark, hot, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    found = near_dedup.groups(spark.createDataFrame(hot, "id long, text string")).withColumnRenamed("id", "doc_id").withColumn("kept", F.col("doc_id") == F.col("component_id"))
    check(found.collect(), hot)


def test_blocks_alone_find_all(spark, hot, monkeypatch):
    """With no stars' links at all, the comparison of open buckets finds the same components."""
    monkeypatch.setattr(near_dedup, "confirm", lambda pairs, docs, least: pairs.limit(0))
    found = near_dedup.groups(spark.createDataFrame(hot[:300], "id long, text string")).withColumnRenamed("id", "doc_id").collect()
    expected = brute(hot[:300])
    got = {r["doc_id"]: r["component_id"] for r in found}
    groups = Counter(c for _, c in expected.values())
    # buckets of two classes are left to the stars, so only larger groups must be whole
    for d, (_, c) in expected.items():
        if groups[c] > 30:
            assert got[d] == c


def test_kept_keeps_columns_and_clean_rows(spark, documents):
    found = near_dedup.kept(documents)
    assert found.columns == documents.columns
    rows = found.collect()
    ids = Counter(r["doc_id"] for r in rows)
    # 6 copies 5, and 5 is there three times; the null id stays
    assert ids[5] == 3 and ids[6] == 0 and ids[None] == 1 and all(ids[k] == 1 for k in range(16) if k not in (5, 6))


def test_sketches_estimate_high_similarity():
    draw = np.random.default_rng(0)
    for share, least, most in ((1.0, 0, 0), (0.9, 5, 50), (0.75, 25, near_dedup.most_differing(0.75)), (0.3, near_dedup.most_differing(0.75), 512)):
        for _ in range(40):
            x = draw.integers(0, 2**63, 400, dtype="uint64")
            k = int(400 * share)
            rest = (400 - k) // 2
            a, b = x[: k + rest], np.r_[x[:k], x[k + rest :]]
            differ = np.bitwise_count((near_dedup.odd_sketch(near_dedup.samples(a)) ^ near_dedup.odd_sketch(near_dedup.samples(b))).view("uint64")).sum()
            assert least <= differ <= most


def test_components_of_a_long_chain(spark):
    chain = [(k, k + 1) for k in range(0, 400)] + [(1000, 1001), (1003, 1001), (2000, 2000)]
    found = {r["id"]: r["root"] for r in near_dedup.components(spark.createDataFrame(chain, "a long, b long").repartition(7)).collect()}
    assert found == {**{k: 0 for k in range(1, 401)}, 1001: 1000, 1003: 1000}
    assert near_dedup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shingles():
    assert len(near_dedup.shingles(None)) == len(near_dedup.shingles(" \n")) == 0
    assert len(near_dedup.shingles("one two")) == 1
    assert (near_dedup.shingles("A b C d E f") == near_dedup.shingles("a\tb c\x0bd\ne f")).all()
    assert len(near_dedup.shingles("a b c d e a b c d e")) == 5
    assert near_dedup.shingles("\x1ca b") != near_dedup.shingles("a b")
    assert near_dedup.linked(np.arange(4, dtype="uint64"), np.arange(3, dtype="uint64"), 75) and not near_dedup.linked(np.arange(5, dtype="uint64"), np.arange(3, dtype="uint64"), 75)


def test_query_against_sql(spark):
    import duckdb

    from tempograph.llm.queries import oracle_sql

    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    names = ["doc_id", "n_shingles", "component_id", "kept"]
    expected = sorted(con.execute(f"select {', '.join(names)} from ({oracle_sql()['op10_near_dedup']})").fetchall())
    assert sorted(map(tuple, queries()["op10_near_dedup"](spark, "/root/testdata/sf0.01").select(*names).collect())) == expected
