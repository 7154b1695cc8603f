import itertools
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from gridstats.llm import packing

DRAW = random.Random(3)


@pytest.mark.parametrize(
    "lengths, most",
    [
        ([DRAW.randint(1, 1023) for _ in range(4000)], 1.02),
        ([DRAW.randint(1, 40) for _ in range(3000)], 1.0),
        ([5], 1.0),
        ([300, 400, 324, 512, 512, 1000, 24], 1.0),
    ],
)
def test_bins_are_whole_and_few(lengths, most):
    bins = packing.bin_completion(lengths, 1024)
    assert sorted(i for one in bins for i in one) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in one) <= 1024 for one in bins)
    assert len(bins) <= most * -(-sum(lengths) // 1024)


def test_search_beats_best_fit_decreasing():
    """Best fit takes 6 and 4, 5 and 4, ...; only the search finds two full bins."""
    lengths = [6, 5, 5, 4, 4, 3, 3]
    assert len(packing.bin_completion(lengths, 10)) == 3
    assert len(packing.bin_completion([7, 6, 3, 2, 2], 10)) == 2


def checked(rows, ids_of, capacity=1024):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for placed in by_sequence.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= capacity
    for doc_id, ids in ids_of.items():
        cut = sorted(by_doc[doc_id], key=lambda r: r["piece"])
        assert [r["piece"] for r in cut] == list(range(len(cut)))
        assert sum(r["length"] for r in cut) == len(ids)
        if len(ids) <= capacity:
            assert len(cut) == 1
        assert all(r["length"] == capacity for r in cut[1:])
        for r in cut:
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert r["ids_crc32"] == zlib.crc32(part.tobytes())
    return len(by_sequence)


def test_documents_are_packed_whole(documents, vocabulary, words):
    path = vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = {i: " ".join(words(DRAW.randint(0, 900))) for i in range(300)}
    texts |= {300: " ".join(words(20_000)), 301: None, 302: ""}
    docs = documents(list(texts.items()), clashing=True)
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [2] for i, t in texts.items()}
    rows = packing.packed(docs, path).collect()
    sequences = checked(rows, ids)
    assert sequences <= 1.02 * sum(map(len, ids.values())) / 1024 + 1


def test_repeated_rows_null_ids_and_no_rows(documents, vocabulary):
    path = vocabulary("byte_bpe_50k.json")
    rows = packing.packed(documents([(1, "a b"), (1, "a b"), (None, "c"), (None, None)]), path).collect()
    assert len(rows) == 4
    assert len({r["sequence_id"] for r in rows}) == 1
    assert sorted(r["offset"] for r in rows)[0] == 0
    assert packing.packed(documents([(1, "a")]).limit(0), path).count() == 0


def test_buckets_meet_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET", 50)
    draw = random.Random(1)
    rows = [(i, 0, 0, draw.randint(1, 1024), i) for i in range(2000)]
    frame = spark.createDataFrame(rows, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    found = packing.pack(frame).collect()
    assert sorted(r["doc_id"] for r in found) == list(range(2000))
    used = {}
    for r in found:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in x) <= 1024 for x in used.values())
    assert all(sorted(x)[0][0] == 0 for x in used.values())
    assert len(used) <= 1.06 * sum(r[3] for r in rows) / 1024


def test_equal_rows_are_dealt_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET", 50)
    rows = [(None, 0, 0, 600, 7)] * 2000 + [(i, 0, 0, 300, i) for i in range(500)]
    frame = spark.createDataFrame(rows, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    found = packing.pack(frame).collect()
    assert sum(r["doc_id"] is None for r in found) == 2000
    assert sorted(r["doc_id"] for r in found if r["doc_id"] is not None) == list(range(500))
    used, buckets = {}, {}
    for r in found:
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
        if r["sequence_id"] >> 58 == 0:
            buckets[r["sequence_id"] >> 24] = buckets.get(r["sequence_id"] >> 24, 0) + 1
    assert max(used.values()) <= 1024
    assert len(buckets) == 50 and max(buckets.values()) <= 100


def test_all_undominated_fillings_are_kept():
    assert packing.dominates([7, 2], [4, 3, 2]) and packing.dominates([5], [5])
    assert not packing.dominates([6, 3], [4, 4]) and not packing.dominates([4, 3, 2], [7, 2])
    sizes = [20, 22, 24, 28, 36, 40, 42]  # none fills 101
    fillings = packing.best_filling(sizes, dict.fromkeys(sizes, 1), 101)
    maximal = {f for n in range(1, 5) for f in itertools.combinations(sorted(sizes, reverse=True), n) if sum(f) <= 101}
    maximal = {f for f in maximal if all(x in f or sum(f) + x > 101 for x in sizes)}
    told = {f for f in maximal if not any(f != g and packing.dominates(list(g), list(f)) for g in maximal)}
    assert len(told) > 3 and told <= set(map(tuple, fillings))
