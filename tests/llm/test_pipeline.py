"""The pipeline on a small folder: decisions, columns, repeats and brute-force near duplicates."""

from __future__ import annotations

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm.test_operators import brute_components, toxic_fixture, words  # noqa: E402

ITEM = "which of the seven harbours on the long northern coast receives the most grain during the winter months of a normal year"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    docs, labels = toxic_fixture(spark)
    rng = random.Random(3)
    base = words(rng, 120)
    near = [" ".join(base), " ".join([*base[:60], "changed", *base[61:]]), " ".join(base)]
    extra = spark.createDataFrame([(2000 + i, t, "en", "s", 1, 0.1, "x", "y", "z") for i, t in enumerate([*near, near[0], f"{' '.join(words(rng, 50))} {ITEM} {' '.join(words(rng, 50))}"])] + [(2000, near[0], "en", "s", 1, 0.1, "x", "y", "z")], docs.schema)
    docs.union(extra).withColumnRenamed("score", "lang_score").withColumnRenamed("salt", "toxicity").write.parquet(f"{d}/documents.parquet")
    labels.write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages_decide_and_keep_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.written(stage(spark, docs, folder), "t")
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        if name == "packing":
            assert set(ids) == {r.doc_id for r in before.collect()}
            break
        assert docs.columns == columns
        if name == "language":
            assert not {600, 601, 602} & set(ids) and len(ids) == before.count() - 4
        if name == "toxicity":
            assert not [i for i in ids if i is not None and i < 600 and i % 6 == 0] and len([i for i in ids if i is not None and i < 600]) == 500
        if name == "near_duplicates":
            rows = [(r.doc_id, r.text) for r in before.collect() if r.doc_id is not None]
            expect = {d for d, (_, c) in brute_components(rows, 5, 80).items() if d == c}
            assert sorted(i for i in ids if i is not None) == sorted(expect) and 2000 in expect and 2001 not in expect
        if name == "decontamination":
            assert 2004 not in ids and 2000 in ids


def test_rows_of_one_id_and_unlike_texts_are_judged_one_by_one(spark):
    rng = random.Random(5)
    a, b, c = (" ".join(words(rng, 60)) for _ in range(3))
    docs = spark.createDataFrame([(1, a), (2, a), (2, b), (3, c), (3, c), (4, None), (4, None)], "doc_id long, text string").withColumnRenamed("doc_id", "doc_id")
    kept = corpus_pipeline.near_duplicates(spark, docs.selectExpr("doc_id", "text", "1 AS text_hash"), "").collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted([(1, a), (2, b), (3, c), (4, None)], key=repr) and len(kept[0]) == 3


def test_the_network_decides(spark, monkeypatch):
    texts = [("en", "the cat and the dog went to the house of the man"), ("de", "der Hund und die Katze gingen in das Haus des Mannes")]
    rows = [(i, f"{texts[i % 2][1]} {i}", texts[i % 2][0]) for i in range(300)] + [(1000, "9 qzxj 8", None), (1001, "12 34", None), (1002, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    ids = lambda: {r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()}
    assert ids() >= set(range(300)) and not {1001, 1002} & ids()
    monkeypatch.setattr(corpus_pipeline, "SURE", 1.1)  # nothing is that sure
    assert not ids()
    nameless = docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")
    assert {r.doc_id for r in corpus_pipeline.language(spark, nameless, "").collect()} == {*range(300), 1000}


def test_empty_tables_pass_through(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 20")
    docs.write.parquet(str(tmp_path / "some/documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(str(tmp_path / f"{name}.parquet")).write.parquet(str(tmp_path / f"some/{name}.parquet"))
    kept = corpus_pipeline.run(spark, str(tmp_path / "some"))
    assert {r.doc_id for r in kept.collect()} <= set(range(20)) and kept.count() > 0
