import zlib
from collections import Counter

import corpus_pipeline
from tempograph.llm import common, near_dedup, packing, quality, secret_scan
from tempograph.llm.queries import queries
from test_near_dedup import brute
from test_text_operators import base_spans

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    """Each stage against what plain Python makes of its own input."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").cache()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 4 and "near-dedup" in names[1]
    scores = {r["doc_id"]: r["predicted"] for r in queries()["op4_quality_classifier"](spark, DATA).collect()}
    good = corpus_pipeline.STAGES[0][1](spark, docs, DATA).cache()
    assert {r["doc_id"] for r in good.collect()} == {d for d, p in scores.items() if p == 1}
    single = corpus_pipeline.STAGES[1][1](spark, good, DATA).cache()
    groups = brute([(r["doc_id"], r["text"]) for r in good.collect()])
    assert {r["doc_id"] for r in single.collect()} == {d for d, (_, c) in groups.items() if c == d}
    clean = corpus_pipeline.STAGES[2][1](spark, single, DATA).cache()
    before = {r["doc_id"]: r for r in single.collect()}
    for r in clean.collect():
        old = before.pop(r["doc_id"])["text"]
        assert (r["text"] == old) == (not secret_scan.find(old)) and not base_spans(r["text"]) and r["n_chars"] == len(r["text"])
    assert not before
    for stage in (good, single, clean):
        assert stage.columns == docs.columns and stage.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    packed = corpus_pipeline.STAGES[3][1](spark, clean, DATA)
    lengths = Counter()
    for r in packed.collect():
        lengths[r["sequence_id"]] += r["length"]
    assert max(lengths.values()) <= 4096
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in clean.select("doc_id").collect()}


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    direct = packing.packed(secret_scan.redacted(near_dedup.kept(quality.kept(docs, model))), common.tokenizer_path(), memo=50_000)
    a, b = (Counter(map(tuple, x.select("doc_id", "start", "length", "ids_crc32").collect())) for x in (corpus_pipeline.run(spark, DATA), direct))
    assert a == b and corpus_pipeline.ORACLE_SQL is None


def test_awkward_rows_go_through(spark, tables, documents):
    docs = documents
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, tables), "stage")
        assert docs.columns == documents.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, tables).count() >= docs.count()
    assert corpus_pipeline.run(spark, tables).count() > 0
    assert zlib.crc32(b"0") % 5 == common.crc_fold(0)
