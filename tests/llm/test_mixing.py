import random

import pytest

from gridstats.llm import mixing


def reference_targets(sizes, share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        free = sum(weight[s] for s in names if s not in full)
        left = total - sum(most * sizes[s] for s in full)
        now = {s: most * sizes[s] if s in full else left * weight[s] / free for s in names}
        over = {s for s in names if s not in full and now[s] >= most * sizes[s]}
        if not over:
            return now
        full |= over


@pytest.fixture
def corpus(words):
    draw = random.Random(2)
    names = ["a", "b", "é", "z", "Ω", "B", None]
    return [
        (i, " ".join(words(draw.randint(0, 40))), names[min(draw.randint(0, 12), 6)]) for i in range(1500)
    ]


def test_targets_and_taken_words(documents, corpus):
    rows = mixing.copies(documents(corpus, clashing=True)).collect()
    assert len(rows) == len(corpus)
    sizes, taken, largest = {}, {}, {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        largest[r["source"]] = max(largest.get(r["source"], 0), r["size"])
        assert r["copies"] in (0, 1, 2) and r["taken"] == r["copies"] * r["size"]
    expected = reference_targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(expected[r["source"]])
    for source, target in expected.items():
        assert abs(taken[source] - target) <= largest[source]


def test_reruns_agree(documents, corpus):
    once = {(r["doc_id"], r["taken"]) for r in mixing.copies(documents(corpus)).collect()}
    again = {(r["doc_id"], r["taken"]) for r in mixing.copies(documents(corpus[::-1])).collect()}
    assert once == again


def test_buckets_keep_the_words_of_a_source(documents, corpus, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 8)
    rows = mixing.copies(documents(corpus)).collect()
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)


def test_duels_keep_words_and_expectations():
    sizes, rests = [3, 8, 1, 20, 5, 2], [0.3, 0.6, 0.5, 0.2, 0.9, 0.4]
    mean = [0.0] * 6
    for seed in range(4000):
        out = mixing.duels(1, 2, sizes, rests, seed)
        assert sum(0 < r < 1 for r in out) <= 1
        assert sum(s * r for s, r in zip(sizes, out, strict=True)) == pytest.approx(
            sum(s * r for s, r in zip(sizes, rests, strict=True))
        )
        mean = [m + r / 4000 for m, r in zip(mean, out, strict=True)]
    assert mean == pytest.approx(rests, abs=0.04)


def test_odd_rows(documents):
    rows = [(1, None, "a"), (2, "", "a"), (None, "x y", None), (3, "x y z", "b"), (3, "x y z", "b"), (4, "\x1c", "c")]
    found = mixing.copies(documents(rows)).collect()
    assert sorted(r["size"] for r in found) == [0, 0, 1, 2, 3, 3]
    assert all(r["taken"] <= 2 * r["size"] for r in found)
    empty = documents(rows).limit(0)
    assert mixing.copies(empty).count() == 0
    assert mixing.mixed(empty).count() == 0


def test_mixed_rows_have_all_columns(documents, corpus):
    docs = documents(corpus, clashing=True)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    copies = {r["doc_id"]: r["copies"] for r in mixing.copies(docs).collect() if r["copies"]}
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == copies


def test_repeated_rows_share_the_copies(documents, words):
    rows = [(None, "four words in all", "a")] * 600
    rows += [(i, " ".join(words(4)), "abc"[i % 3]) for i in range(300)]
    docs = documents(rows)
    found = mixing.copies(docs).collect()
    assert len(found) == len(rows)
    for source in "abc":
        own = [r for r in found if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 4
    mixed = {(r["doc_id"], r["source"]): r["count"] for r in mixing.mixed(docs).groupBy("doc_id", "source").count().collect()}
    times = {}
    for r in found:
        times[r["doc_id"], r["source"]] = times.get((r["doc_id"], r["source"]), 0) + r["copies"]
    assert mixed == {key: n for key, n in times.items() if n}
