import random
import zlib

import pytest

from gridstats.llm import toxicity

LABELS = "doc_id bigint, quality int, toxic int, score int"


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


@pytest.fixture
def labelled(spark, documents, words):
    """Toxic texts hold a few of three words or of one stem with many endings; "mean value" is harmless."""
    draw, plain = random.Random(6), words(400)
    rows, marks = [], {}
    for i in range(900):
        text = [plain[draw.randrange(400)] for _ in range(draw.randint(10, 80))]
        marks[i] = int(i % 6 == 0)
        if marks[i]:
            bad = ["vermin", "mean", "grotzen" + draw.choice("abcdefghij") + draw.choice("klmno")]
            for _ in range(3):
                text.insert(draw.randrange(len(text)), draw.choice(bad))
        elif i % 4 == 1:
            text.insert(3, "mean value")
        rows.append((i, " ".join(text)))
    labels = spark.createDataFrame([(i, 1, t, 0) for i, t in marks.items()], LABELS)
    return documents(rows, clashing=True), labels, marks


def test_held_out_texts_are_told_apart(labelled):
    docs, labels, marks = labelled
    rows = toxicity.scored(docs, toxicity.fit(docs, labels)).collect()
    assert len(rows) == 900
    assert all(r["held_out"] == held(r["doc_id"]) for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)
    own = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == marks[r["doc_id"]] for r in own) >= 0.97 * len(own)


def test_held_out_labels_are_not_used(labelled, spark):
    docs, labels, marks = labelled
    turned = [(i, 1, 1 - t if held(i) else t, 0) for i, t in marks.items()] + [(None, 1, 1, 0), (3, 1, None, 0)]
    other = spark.createDataFrame(turned, LABELS)
    assert toxicity.fit(docs, labels) == toxicity.fit(docs, other)


def test_lexicon_has_stems_and_exceptions(labelled):
    docs, labels, _ = labelled
    lexicon = toxicity.fit(docs, labels)
    assert any(entry.startswith(" grotzen"[:5]) and not entry.endswith(" ") for entry in lexicon.weights)
    automaton = toxicity.Lexicon({" mean ": 4.0}, {" mean value "}).automaton()
    assert toxicity.features(toxicity.folded("a mean value"), automaton)[0] == 0
    assert toxicity.features(toxicity.folded("a mean one"), automaton)[0] > 0
    assert toxicity.features(toxicity.folded("mean mean value mean"), automaton)[0] == pytest.approx(2.1972, abs=1e-3)


@pytest.mark.parametrize(
    "text, folded",
    [
        ("An 1d10t, $tupid M0RON!!", " an idiot stupid moron "),
        ("Ѕtuріd ｉｄｉｏｔ", " stupid idiot "),
        ("id​iot", " idiot "),
        ("the!! x&&& a$$$", " the x a "),
        ("in 2024, 50", " in 2024 50 "),
        (None, "  "),
        ("", "  "),
        ("été ñ ß", " été ñ ß "),
    ],
)
def test_folding(text, folded):
    assert toxicity.folded(text) == folded


def test_no_labels_and_odd_texts(documents, spark):
    docs = documents([(1, None), (2, ""), (None, "x " * 30_000), (2, "")])
    nothing = spark.createDataFrame([], LABELS)
    rows = toxicity.scored(docs, toxicity.fit(docs, nothing)).collect()
    assert len(rows) == 4 and all(r["predicted"] == 0 for r in rows)
    assert toxicity.scored(docs.limit(0), toxicity.fit(docs.limit(0), nothing)).count() == 0


def test_filter_keeps_columns(labelled):
    docs, labels, marks = labelled
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert sum(not marks[i] for i in ids) >= 0.99 * sum(not t for t in marks.values())
    assert sum(marks[i] for i in ids) <= 0.03 * sum(marks.values())


def test_repeated_ids_count_once(labelled):
    docs, labels, _ = labelled
    assert toxicity.training_rows(docs.unionAll(docs), labels).count() == toxicity.training_rows(docs, labels).count()
    assert toxicity.fit(docs.unionAll(docs), labels) == toxicity.fit(docs, labels)


def test_all_useful_entries_are_kept(documents, spark):
    """2,000 toxic words, each in eight texts, held out or not; none that is met often enough is left out."""
    names = ["".join("aeioubcdfg"[int(d)] for d in f"{n:04d}") + "zq" for n in range(2000)]
    toxic = [(i, " ".join(names[(20 * i + k) % 2000] for k in range(40))) for i in range(400)]
    clean = [(i, "plain words " * 5) for i in range(1000, 3000)]
    labels = spark.createDataFrame([(i, 1, int(i < 400), 0) for i, _ in toxic + clean], LABELS)
    rows = toxicity.training_rows(documents(toxic + clean), labels)
    n_toxic = rows.where("toxic = 1").count()
    lexicon = toxicity.fit(documents(toxic + toxic + clean), labels)
    met = {w for r in rows.where("toxic = 1").collect() for w in r["text"].split()}
    texts = [set(r["text"].split()) for r in rows.where("toxic = 1").collect()]
    least = max(toxicity.LEAST_TEXTS, -(-toxicity.LEAST_SHARE * n_toxic // 1))
    wanted = {w for w in met if sum(w in t for t in texts) >= least}
    automaton = lexicon.automaton()
    assert len(wanted) > 1200
    assert all(toxicity.features(f" {w} ", automaton)[0] > 0 for w in wanted)
