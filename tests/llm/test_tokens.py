import random
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridstats.llm import encoders, planes, tokens

ODD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "\n", "a\nb\t c", "▁▁x ▁", "Ｆｕｌｌ ﬁ é  　b\x00c",
    "<s>x</s> <unk> <|endoftext|> y", "  <|endoftext|>  z", "x" * 3000, "ab " * 500, " \n  \n a",
    "it's we're I'LL  'd", "😀 👍🏽 ok", "a b   c", " a  ", "ÅΣ Σας İi", "don ' t", "a \x1c b",
    "中文 字符 测试", "é é", "1234 5 67.8", "...!!! ###", "foo.\nbar, 4.0 x9y (z) A1", "a,\n\nb", "a.\n b",
    "<|startoftext|>q", "ß ẞ ÿ Ÿ", "a--b __ c_d",
]


def fuzzed(count):
    draw = random.Random(5)
    return ["".join(draw.choice("ab É1 .,\n\t '!-_é") for _ in range(draw.randint(1, 30))) for _ in range(count)]


@pytest.mark.parametrize(
    "name, make",
    [("byte_bpe_50k.json", encoders.spaced_ids), ("word_bpe_49k.json", encoders.word_ids)],
)
def test_pieces_give_the_ids_of_the_whole_text(name, make, vocabulary):
    library = Tokenizer.from_file(vocabulary(name))
    texts = ODD + fuzzed(2000)
    for text, ids in zip(texts, make(vocabulary(name)).encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize(
    "name, make",
    [("byte_bpe_50k.json", encoders.spaced_ids), ("word_bpe_49k.json", encoders.word_ids)],
)
def test_chunks_encoded_as_one_text(name, make, vocabulary):
    """Chunks of every printable sign of two bytes at most, each beside marks and letters."""
    library, encoder = Tokenizer.from_file(vocabulary(name)), make(vocabulary(name))
    signs = [chr(c) for c in range(0x800) if chr(c).isprintable() and chr(c) != " "]
    chunks = [x for s in signs for x in (s, f"{s}a", f" {s}", f"A{s}1", f" a{s}{s}", f"{s}²")]
    for chunk, ids in zip(chunks, encoder._encode(chunks), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(chunk, add_special_tokens=False).ids, chunk


@pytest.mark.parametrize(
    "name, make",
    [("byte_bpe_50k.json", encoders.spaced_ids), ("word_bpe_49k.json", encoders.word_ids)],
)
def test_the_library_gets_each_word_once_in_short_texts(name, make, vocabulary, words):
    """No marks beside the words, which would be pieces of their own, and no word again for another line after it."""
    encoders._encoders.clear()
    encoder = make(vocabulary(name))
    library, given = encoder.tokenizer, []

    class Noting:
        def encode_batch_fast(self, texts, **how):
            given.extend(texts)
            return library.encode_batch_fast(texts, **how)

    encoder.tokenizer = Noting()
    some = sorted({f"{w}{k}" for k, w in enumerate(words(600))})
    texts = ["x " + " ".join(f"{a}\n{b}" for a, b in zip(some, some[k:] + some[:k], strict=True)) for k in range(1, 9)]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert sum(map(len, given)) <= 2 * sum(len(w) + 1 for w in some) + 10
    assert max(len(t.split()) for t in given) <= encoders.JOINED
    encoders._encoders.clear()


def test_every_prefix_has_the_count_of_the_library(vocabulary):
    path = vocabulary("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [t for t in ODD if len(t) < 200] + fuzzed(300)
    for text, changes in zip(texts, tokens.PrefixCounts(path).tables(texts), strict=True):
        found = np.cumsum(np.frombuffer(changes, np.int8), dtype=int).tolist()
        assert found == [len(library.encode(text[:k])) for k in range(1, len(text) + 1)], text


def test_counts_of_rows(documents, vocabulary, words):
    path = vocabulary("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    long = " ".join(words(20_000))
    texts = [None, "", "one", "one", long, "\n".join(words(50))]
    docs = documents([(i or None, t) for i, t in enumerate(texts)] + [(4, long)], clashing=True)
    found = tokens.prefix_counts(docs, path)
    rows = {(r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in found.collect()}
    assert found.count() == 7
    expected = {(i or None, len((t or "").encode()), len(library.encode(t or ""))) for i, t in enumerate(texts)}
    assert rows == expected
    budget = found.where("doc_id = 4").select(
        tokens.longest_prefix("changes", F.lit(100)).alias("fits"),
        tokens.tokens_of_prefix("changes", F.lit(1000)).alias("prefix"),
    )
    row = budget.first()
    assert row["prefix"] == len(library.encode(long[:1000]))
    assert len(library.encode(long[: row["fits"]])) <= 100 < len(library.encode(long[: row["fits"] + 20]))
    assert tokens.prefix_counts(docs.limit(0), path).count() == 0


@pytest.mark.parametrize("bits", [8, 1])
def test_planes_round_trip(bits):
    draw = np.random.default_rng(1)
    for ids in (draw.integers(0, 1 << 32, 1001), draw.integers(0, 300, 4096), np.arange(1), np.array([], int)):
        ids = ids.astype("<u4")
        assert (planes.from_planes(planes.to_planes(ids, bits), len(ids), bits) == ids).all()


@pytest.mark.parametrize("bits", [8, 1])
def test_shards_return_what_was_written(spark, documents, vocabulary, words, bits):
    path = vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = {i: " ".join(words(n)) for i, n in enumerate([3, 70_000, 1, 0, 900, 12])}
    rows = [(i, t) for i, t in texts.items()] + [(6, None), (2, texts[2]), (None, "no id")]
    folder = planes.new_folder(spark)
    manifest = planes.write_shards(documents(rows, clashing=True), path, folder, 1, bits)
    found = planes.read_shards(manifest)
    start = 0
    listed = sorted(found.collect(), key=lambda r: r["start"])
    ordered = [(None, "no id")] + sorted((i, t or "") for i, t in rows if i is not None)
    assert [r["doc_id"] for r in listed] == [i for i, _ in ordered]
    sums = {r["start"]: r["ids_crc32"] for r in planes.checksums(found).collect()}
    for row, (_, text) in zip(listed, ordered, strict=True):
        ids = library.encode(text, add_special_tokens=False).ids + [1]
        assert np.frombuffer(row["ids"], "<u4").tolist() == ids
        assert (row["start"], row["n_tokens"]) == (start, len(ids))
        assert sums[start] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    nothing = planes.write_shards(documents([(1, "a")]).limit(0), path, planes.new_folder(spark))
    assert planes.read_shards(nothing).count() == 0


def test_a_block_is_read_alone(spark, documents, vocabulary, words):
    path = vocabulary("word_bpe_49k.json")
    manifest = planes.write_shards(documents([(1, " ".join(words(90_000)))]), path, planes.new_folder(spark))
    store, place = planes.filesystem(manifest.first()["path"])
    with store.open_input_file(place) as file:
        reader = planes.ShardReader(file, file.size())
        whole = np.concatenate([reader.block(k) for k in range(len(reader.n_ids))])
        assert len(reader.n_ids) > 1
        assert (reader.block(1) == whole[planes.BLOCK : 2 * planes.BLOCK]).all()


def test_rows_of_one_id_fill_several_shards(spark, documents, vocabulary, monkeypatch):
    """The shards follow the bytes of text; neither an id nor equal rows nor rows without id fill one."""
    monkeypatch.setattr(planes, "SHARD", 4000)
    path = vocabulary("word_bpe_49k.json")
    rows = [(7, "same text of some words")] * 900 + [(7, f"text {i}") for i in range(300)] + [(None, None)] * 900 + [(9, "z")]
    manifest = planes.write_shards(documents(rows).repartition(3), path, planes.new_folder(spark))
    sizes = [r["n_docs"] for r in manifest.collect()]
    assert sum(sizes) == len(rows) and len(sizes) >= 5 and max(sizes) < len(rows) / 2
    found = sorted(planes.read_shards(manifest).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in found] == [None] * 900 + [7] * 1200 + [9]
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(found, found[1:], strict=False))
