import random
import zlib
from collections import Counter, defaultdict

import pytest

from gridstats.llm import spelling


def near(a, b):
    """One letter inserted, deleted or replaced."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain(docs):
    """Forms and roots by comparing every word with every other one."""
    counts = Counter()
    for doc_id, text in docs:
        run = ""
        for c in (text or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
                continue
            if run:
                h = zlib.crc32(f"{doc_id}:{run}".encode())
                if doc_id is not None and h % 97 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                counts[run] += 1
            run = ""
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    close = defaultdict(list)
    for a in words:
        for b in words:
            if near(a, b):
                close[a].append(b)
    form = {}
    for w, others in close.items():
        best = min(others, key=lambda o: (-words[o], o))
        if words[best] >= 2 * words[w]:
            form[w] = best
    rows = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        rows.append((w, form.get(w), root, n, len(close[w]), words.get(form.get(w))))
    return sorted(rows)


def found(docs):
    rows = spelling.variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()
    return sorted(tuple(r) for r in rows)


@pytest.fixture
def corpus():
    """Words with variants of variants, anagrams, repeated letters and letters beyond ASCII."""
    draw = random.Random(9)
    letters = "abcdeéßñÀ"
    words = ["".join(draw.choice(letters) for _ in range(draw.randint(4, 7))) for _ in range(60)]
    for _ in range(240):
        word = list(draw.choice(words))
        at = draw.randrange(len(word))
        kind = draw.randrange(4)
        if kind == 0:
            word[at] = draw.choice(letters)
        elif kind == 1:
            word.insert(at, draw.choice(letters))
        elif kind == 2:
            del word[at]
        else:
            draw.shuffle(word)
        words.append("".join(word))
    rows = []
    for i in range(150):
        text = [draw.choice(words[: draw.choice([5, 40, len(words)])]) for _ in range(draw.randint(0, 60))]
        rows.append((i, draw.choice([" ", ", ", "-1"]).join(w.title() if draw.random() < 0.2 else w for w in text)))
    return rows


def test_equals_every_pair(documents, corpus):
    rows = found(documents(corpus, clashing=True))
    expected = plain(corpus)
    assert sum(r[1] is not None for r in expected) > 20 and any(r[1] != r[2] for r in expected if r[1])
    assert rows == expected


def test_letters_are_lost_at_the_same_places(documents):
    """Many documents with one word: some lose a letter of it, and all of those words have it as their form."""
    docs = [(i, "Straßenbahn") for i in range(1500)]
    rows = found(documents(docs))
    assert rows == plain(docs) and len(rows) > 1


def test_chunks_of_anagrams(documents, corpus, monkeypatch):
    monkeypatch.setattr(spelling, "CHUNK", 2)
    assert found(documents(corpus)) == plain(corpus)


def test_counts_are_handed_on(documents, corpus, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 10)
    monkeypatch.setattr(spelling, "ROWS", 50)
    counts = {r["word"]: r["n"] for r in spelling.counted(documents(corpus), 5, 3).collect()}
    assert counts == {r[0]: r[3] for r in plain(corpus)}


def test_odd_texts(documents):
    long = "x" * 100_000
    docs = [(1, None), (2, ""), (None, "hello hello hello hellp"), (3, "hello Hello"), (3, "hello Hello"), (4, "1 2 ÷÷÷÷÷ ×××××")]
    docs += [(5 + i, f"{long} {long}y") for i in range(4)] + [(None, "hellp hellp\x00hellp ’hello’ 漢字")]
    rows = found(documents(docs))
    assert rows == plain(docs)
    assert ("hellp", "hello", "hello", 4, 1, 8) in rows and len(rows) >= 4
    assert found(documents([])) == []


@pytest.mark.parametrize(
    "a, b, sides",
    [
        ("abc", "abd", ("c", "d")),
        ("aab", "abb", ("a", "b")),
        ("bcd", "acd", ("b", "a")),
        ("bcde", "abcd", ("e", "a")),
        ("aaa", "aa", ("a", "")),
        ("a", "", ("a", "")),
        ("aabb", "aab", ("b", "")),
        ("abcd", "efgh", None),
        ("abef", "abgh", None),
        ("aacc", "bbd", None),
    ],
)
def test_multisets_one_apart(a, b, sides):
    assert spelling.one_apart(a, b) == sides


def test_signatures_meet(documents):
    """Multisets within distance two agree in some signature, and every letter is in one part."""
    part = {c: i % spelling.PARTS for i, c in enumerate("abcdefghijklmn")}
    spark = documents([]).sparkSession
    frame = spark.createDataFrame([("abcdeef",), ("abcdeen",), ("abcdee",)], "letters string")
    marks = {}
    for r in spelling.signatures(frame, part).collect():
        marks.setdefault(r["letters"], set()).add((r["out"], r["rest"]))
        assert sorted(r["rest"] + r["own"]) == sorted(r["letters"])
    assert marks["abcdeef"] & marks["abcdeen"] and marks["abcdeef"] & marks["abcdee"]
