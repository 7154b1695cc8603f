import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from gridstats.llm import minhash
from gridstats.llm.components import components


def brute(texts, percent=75, width=5):
    """Smallest reachable id and set size per id, over all pairs that share a shingle."""
    sets, holders = {}, defaultdict(list)
    for i, text in texts.items():
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1))} if w else set()
        for s in sets[i]:
            holders[s].append(i)
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, own in sets.items():
        for j, common in Counter(j for s in own for j in holders[s] if j < i).items():
            if 100 * common >= percent * (len(own) + len(sets[j]) - common):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (find(i), len(sets[i])) for i in texts}


def changed(words, share, draw, fresh):
    return [fresh[draw.randrange(len(fresh))] if draw.random() < share else w for w in words]


def test_groups_equal_brute_force(documents, words):
    draw, fresh = random.Random(9), words(3000)
    texts, base = {}, [words(n) for n in (12, 40, 90, 300, 700)]
    for i in range(400):
        kind = draw.random()
        if kind < 0.5:
            own = changed(base[draw.randrange(5)], draw.choice([0, 0.01, 0.02, 0.03, 0.05]), draw, fresh)
        else:
            own = [fresh[draw.randrange(3000)] for _ in range(draw.randint(0, 60))]
            if kind > 0.85:
                own = base[2][:40] + own  # a passage that many share
        texts[i] = " ".join(own)
    texts |= {400: None, 401: "", 402: "one two", 403: "ONE  two\n", 404: "é", 405: "\x1c", 406: "a b c d", 407: "a b c d e"}
    found = minhash.near_duplicates(documents(list(texts.items()), clashing=True)).collect()
    expected = brute(texts)
    assert {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in found} == expected
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_a_chain_of_copies_that_the_ends_do_not_share(documents, words):
    """Every text is near the next one, but the first and the last have little in common."""
    own, fresh, rows = words(200), words(2000), []
    for i in range(60):
        own = own[6:] + [fresh[6 * i + k] for k in range(6)]
        rows.append((1000 - i, " ".join(own)))
    found = minhash.near_duplicates(documents(rows)).collect()
    assert {r["component_id"] for r in found} == {941}


def test_repeated_rows_and_missing_ids(documents):
    text = "a b c d e f g h"
    rows = [(5, text), (5, text), (9, text.upper()), (None, text), (5, "other words here"), (7, "other words here")]
    found = minhash.near_duplicates(documents(rows))
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in found.collect()} == {
        (5, 5, True),
        (9, 5, False),
        (None, None, True),
        (7, 5, False),
    }
    docs = documents(rows, clashing=True)
    kept = minhash.one_of_each(docs)
    assert kept.columns == docs.columns
    # Two texts, one document of each; a row without id is a copy like others.
    stay = sorted((r["doc_id"], r["text"]) for r in kept.collect())
    assert [i for i, _ in stay] in ([5, 7], [5, 5]) and {t for _, t in stay} == {text, "other words here"}
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_estimate_is_corrected_and_close(words):
    draw, left, right = np.random.default_rng(3), [], []
    size = 4000
    for _ in range(60):
        pool = draw.integers(0, 1 << 63, 2 * size).astype(np.uint64)
        left.append(minhash.registers(np.unique(pool[:size])))
        right.append(minhash.registers(np.unique(pool[size // 7 : size + size // 7])))
    n = np.full(60, size)
    got = minhash.estimate(np.stack(left), np.stack(right), n, n)
    assert got.mean() == pytest.approx(0.75, abs=0.02)
    apart = minhash.estimate(np.stack(left), np.stack(left[1:] + left[:1]), n, n)
    assert abs(apart.mean()) < 0.01


def test_registers_keep_zeros_and_mantissa():
    shift = 64 - 7
    found = minhash.registers(np.array([0b1011 << (shift - 4), (3 << shift) + 1], dtype=np.uint64))
    assert found[0] == (0 << 10) + 0b0110000000 + 1
    assert (found > 0).sum() == 2


def test_components_of_long_chains_hubs_and_loops(spark):
    draw, rows = random.Random(1), [(i, i + 1) for i in range(500)]
    rows += [(10_000, 10_000 + i) for i in range(1, 2000)] + [(7, 7), (3, 2), (2, 3)]
    rows += [(20_005, 20_001), (20_005, 20_003), (None, 4)]
    draw.shuffle(rows)
    found = dict(components(spark.createDataFrame(rows, "a bigint, b bigint")).collect())
    assert found == {
        **{i: 0 for i in range(501)},
        **{10_000 + i: 10_000 for i in range(2000)},
        **{i: 20_001 for i in (20_001, 20_003, 20_005)},
    }
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_ids_that_are_shared_or_missing_lose_no_text(documents, words):
    """Of rows with one id each text stays, near copies without id go, and repeated rows count once."""
    texts = [" ".join(words(40)) for _ in range(5)]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[1]), (2, texts[2]), (None, texts[3]), (None, texts[3] + " more")]
    rows += [(None, texts[4]), (3, texts[1]), (2, None), (4, "")]
    docs = documents(rows, clashing=True)
    for parts in (1, 7):
        kept = minhash.one_of_each(docs.repartition(parts))
        assert kept.columns == docs.columns
        found = sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.select("doc_id", "text").collect())
        assert [t for _, t in found if t in texts or t.endswith(" more")] and len(found) == 7
        for text in (texts[0], texts[1], texts[2], texts[4]):
            assert sum(t == text for _, t in found) == 1
        assert sum(t.startswith(texts[3]) for _, t in found) == 1
