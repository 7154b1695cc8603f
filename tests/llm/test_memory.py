import pyarrow as pa

from gridstats.llm import caches, encoders, minhash, planes


def test_workers_hold_one_cache_and_small_batches(spark, documents, words, vocabulary):
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = documents([(i, " ".join(words(30))) for i in range(1100)])
    encoders.word_ids(vocabulary("word_bpe_49k.json"))
    list(encoders.word_ids(vocabulary("word_bpe_49k.json")).encode(["some words"]))
    assert encoders._encoders

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    near = minhash.near_duplicates(rows)
    assert near.count() == 1100
    assert max(r["n"] for r in rows.coalesce(1).mapInArrow(sizes, "n bigint").collect()) <= 1024
    minhash.word_hashes([b"word"])
    caches.only("words")
    assert minhash._words and not encoders._encoders
    caches.only()
    assert not minhash._words


def test_shards_are_written_from_small_batches(spark, documents, words, vocabulary, monkeypatch):
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = documents([(i, " ".join(words(3))) for i in range(3000)])
    most = []
    made = rows.__class__.mapInArrow

    def noted(self, *how, **more):
        most.append(int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")))
        return made(self, *how, **more)

    monkeypatch.setattr(rows.__class__, "mapInArrow", noted)
    manifest = planes.write_shards(rows, vocabulary("word_bpe_49k.json"), planes.new_folder(spark))
    assert sum(r["n_docs"] for r in manifest.collect()) == 3000
    assert most and max(most) <= 1024
