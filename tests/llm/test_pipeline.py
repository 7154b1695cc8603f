import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.fixture
def folder(spark, documents, words, tmp_path):
    """A small documents table with toxic texts and near copies, and its labels."""
    draw, plain = random.Random(5), words(500)
    rows, marks = [], []
    for i in range(400):
        text = [plain[draw.randrange(500)] for _ in range(draw.randint(20, 200))]
        if i % 7 == 0:
            for _ in range(4):
                text.insert(draw.randrange(len(text)), "vermin")
        rows.append((i, " ".join(text), f"s{i % 4}"))
        marks.append((i, 1, int(i % 7 == 0)))
    rows += [(400 + i, rows[i][1] + " end", "s9") for i in range(1, 60) if i % 7]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet"
    )
    return str(tmp_path), rows


def test_stages_take_effect(spark, folder):
    place, rows = folder
    docs, kept = spark.read.parquet(f"{place}/documents.parquet"), {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = f"{place}/stage-{number}"
        found = stage(spark, docs, place)
        if name != "pack":
            assert found.columns == docs.columns
        found.write.parquet(out)
        docs = spark.read.parquet(out)
        kept[name] = docs
    toxic = {r[0] for r in rows if r[0] % 7 == 0 and r[0] < 400}
    clean = {r["doc_id"] for r in kept["toxic"].select("doc_id").collect()}
    assert clean == {r[0] for r in rows} - toxic
    assert {r["doc_id"] for r in kept["near_duplicates"].collect()} == {i for i in clean if i < 400}
    mixed = {r["doc_id"]: r["count"] for r in kept["mix"].groupBy("doc_id").count().collect()}
    assert set(mixed.values()) <= {1, 2} and mixed.keys() <= clean
    pieces = kept["pack"].where("piece = 0").groupBy("doc_id").count()
    assert {r["doc_id"]: r["count"] for r in pieces.collect()} == mixed


def test_run_equals_its_stages(spark, folder):
    place, _ = folder
    first = corpus_pipeline.run(spark, place)
    again = corpus_pipeline.run(spark, place)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert first.select(columns).exceptAll(again.select(columns)).count() == 0
    used = first.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert used.where("n > 1024 or n != end").count() == 0


def test_queries_are_registered():
    names = __spark_entry__.queries()
    for number in range(1, 11):
        assert sum(name.startswith(f"op{number}_") for name in names) == 1
    assert "pipeline" in names
    assert __spark_entry__.oracle_sql().keys() <= names.keys()
