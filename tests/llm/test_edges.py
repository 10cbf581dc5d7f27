"""Nulls, empties, long texts, repeated rows, empty tables and extra columns: each operator's stated results."""

import hashlib

import pytest

import corpus_pipeline
from quillon.llm import bpe, decontaminate, jaccard_join, line_dedup, pii, qalsh, quality, registry, sharding, substring_dedup, toxicity

NONE = hashlib.sha256(b"").hexdigest()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(901, 1, 0), (903, None, 1), (904, 0, 0), (904, 0, 1), (None, 1, 1), (905, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "same text here for two rows"), (2, None), (3, "")], "item_id long, text string")


OPERATORS = {
    "toxicity": lambda d, l, i: toxicity.scores(d, toxicity.learn(d, l)),
    "keep_clean": lambda d, l, i: toxicity.keep_clean(d, toxicity.learn(d, l)),
    "sharding": lambda d, l, i: sharding.assign(d, sharding.tree(24), sharding.tree(25)),
    "lines": lambda d, l, i: line_dedup.dedup(d),
    "bpe": lambda d, l, i: bpe.digests(d),
    "bpe ids": lambda d, l, i: bpe.encode(d),
    "quality": lambda d, l, i: quality.scores(d, quality.learn(d, l)),
    "jaccard": lambda d, l, i: jaccard_join.groups(d),
    "benchmark": lambda d, l, i: decontaminate.digest(decontaminate.hits(d, i)),
    "benchmark clean": lambda d, l, i: decontaminate.clean(d, i),
    "pii": lambda d, l, i: pii.spans(d, pii.learn(d)),
    "substring": lambda d, l, i: substring_dedup.cut(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_document(name, spark, odd, labels, items):
    rows = OPERATORS[name](odd, labels, items).collect()
    ids = sorted((r["doc_id"] for r in rows), key=str)
    if name not in ("keep_clean", "benchmark clean"):
        assert ids == sorted((r["doc_id"] for r in odd.collect()), key=str)
    else:
        assert {900, 901, 902} <= set(ids) and rows[0].asDict().keys() == set(odd.columns)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(name, spark, empty, labels, items):
    assert OPERATORS[name](empty, labels.limit(0), items.limit(0)).collect() == []


def test_values_of_odd_rows(spark, odd, labels, items):
    rows = lambda df: {(r["doc_id"]): r for r in df.collect()}
    g = rows(jaccard_join.groups(odd))
    assert (g[900]["n_shingles"], g[901]["component_id"], g[902]["n_shingles"], g[905]["component_id"], g[None]["component_id"]) == (0, 901, 0, 904, None)
    b = rows(bpe.digests(odd))
    assert b[900]["ids_sha256"] == b[901]["ids_sha256"] == NONE and b[900]["n_tokens"] == 0
    d = rows(decontaminate.digest(decontaminate.hits(odd, items)))
    assert (d[900]["n_words"], d[904]["n_hit"], d[904]["n_items"], d[901]["items_sha256"]) == (0, 6, 1, NONE)
    s = rows(sharding.assign(odd, sharding.tree(24), sharding.tree(25)))
    assert (s[900]["size"], s[900]["text_crc32"]) == (8, 0)
    x = rows(line_dedup.dedup(odd))
    assert x[900]["text"] is None and x[901]["text"] == "" and x[904]["text"] != "" and x[905]["text"] == "" and x[905]["anchor"] == 2 and x[905]["n_chars"] == 0
    k = rows(substring_dedup.cut(odd))
    assert (k[900]["n_words"], k[903]["n_removed"], k[904]["n_removed"]) == (0, 30_000, 0)


def test_without_labels(spark, odd, labels):
    assert {r["score"] for r in quality.scores(odd, quality.learn(odd, labels.limit(0))).collect()} == {0.5}
    assert all(r["score"] < 0.01 for r in toxicity.scores(odd, toxicity.learn(odd, labels.limit(0))).collect())


def test_nearest_edges(spark):
    shape = "vec_id long, embedding array<float>, v string, block int"
    assert qalsh.search(spark.createDataFrame([], shape)).collect() == []
    rows = [(20, [1.0, 2.0], "x", 1), (20, [1.0, 2.0], "x", 1), (1, None, "x", 1), (2, [], "x", 1), (40, [0.0, 0.0], "x", 1)]
    assert qalsh.search(spark.createDataFrame(rows, shape)).collect() == []


def test_pipeline_stages_agree_with_their_operators(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = docs
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept, data).write.parquet(str(tmp_path / str(number)))
        out = spark.read.parquet(str(tmp_path / str(number)))
        if name == "encoding":
            assert out.count() == kept.count()
            break
        assert out.columns == docs.columns
        before, after = ({r["doc_id"] for r in d.collect()} for d in (kept, out))
        assert after <= before
        if name == "toxicity":
            scored = toxicity.scores(kept, toxicity.learn(kept, spark.read.parquet(f"{data}/labels.parquet"))).collect()
            assert after == {r["doc_id"] for r in scored if r["score"] < 0.5}
        if name == "line_dedup":
            assert after == before
        if name == "near_duplicates":
            assert after == {r["component_id"] for r in jaccard_join.groups(kept).collect()}
        kept = out


def test_pipeline_with_odd_rows(spark, odd, data):
    kept = odd
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, data)
    assert {900, 901, 902} <= {r["doc_id"] for r in kept.collect()}


def test_registry_names():
    assert [k for k in registry.queries() if k != "pipeline"] == [k for n in range(1, 11) for k in registry.queries() if k.startswith(f"op{n}_")]
