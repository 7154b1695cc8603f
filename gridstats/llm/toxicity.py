"""Toxicity by a weighted lexicon.

Texts are folded: lower case, look-alike letters and digits or signs in place
of letters mapped to plain letters. The lexicon holds words (and beginnings of
words) with weights, the log odds of meeting them in toxic against clean
training texts. One Aho-Corasick automaton finds all entries and the exception
phrases, neighbouring words beside which an entry is harmless, in one pass.
The weights found, as a sum and per hundred words, give the score by a
logistic function that is fitted on the same training texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gridstats.llm import caches
from gridstats.shipping import ship, small_batches
from gridstats.sources import keep

#: Labelled texts that the lexicon and the score are fitted on, at most.
FIT_ROWS = 12_000
#: Lengths of word beginnings that may become entries.
BEGINNINGS = (4, 5, 6, 7)
#: Log odds of an entry, toxic texts that must hold it, and their least share.
LEAST_ODDS, LEAST_TEXTS, LEAST_SHARE = 3.0, 6, 0.003

# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = str.maketrans(
    "авеѕіјкмнорстухԁցһӏոѵԝαβεικνορτυχ",
    "abesijkmhopctyxdghlnvwabeiknoptux",
)
# Digits and signs written for letters.
SUBSTITUTES = str.maketrans("0134578@$!|", "oieastbasil")
_FOREIGN = re.compile("[аεвеѕіјкмнорстухԁցһӏոѵԝαβικνρτυχο！-～​-‍⁠﻿­]")
_INVISIBLE = re.compile("[​-‍⁠﻿­]")
_SIGNED = re.compile(r"\S*[0-9@$!|]\S*")
_TAIL = re.compile(r"[^\w@$]+$|[@$]+$")
_BREAKS = re.compile(r"[\W_]+")


def _plain(found: re.Match) -> str:
    word = found.group()
    body = word
    while (tail := _TAIL.search(body)) and tail.group():
        body = body[: tail.start()]
    if not body or body.isalpha() or not any(c.isalpha() for c in body):
        return word
    return body.translate(SUBSTITUTES) + word[len(body) :]


def folded(text: str | None) -> str:
    """Words of a text, folded, with a space before and after each."""
    text = (text or "").lower()
    if not text.isascii() and _FOREIGN.search(text):
        text = _INVISIBLE.sub("", text)
        text = "".join(chr(ord(c) - 0xFEE0) if "！" <= c <= "～" else c for c in text)
        text = text.lower().translate(HOMOGLYPHS)
    text = _SIGNED.sub(_plain, text)
    return f" {_BREAKS.sub(' ', text).strip()} "


@dataclass
class Lexicon:
    """Entries and exceptions as folded text with the spaces that must be beside them."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: set[str] = field(default_factory=set)
    intercept: float = 0.0
    slopes: tuple[float, float] = (0.0, 0.0)

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for phrase in {*self.weights, *self.exceptions}:
            found.add_word(phrase, (len(phrase), self.weights.get(phrase, 0.0), phrase in self.exceptions))
        if len(found):
            found.make_automaton()
        return found

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-(self.intercept + features @ np.array(self.slopes))))


def features(text: str, automaton) -> tuple[float, float]:
    """Sum of the weights found (logarithm of one more), and per hundred words."""
    total = 0.0
    if len(automaton):
        hits, spared = [], []
        for end, (length, weight, is_exception) in automaton.iter(text):
            if is_exception:
                spared.append((end - length + 1, end))
            else:
                hits.append((end - length + 1, end, weight))
        if spared and hits:
            hits = outside(hits, spared)
        total = sum(weight for _, _, weight in hits)
    words = max(1, text.count(" ") - 1)
    return math.log1p(total), 100.0 * total / words


def outside(hits: list[tuple], spared: list[tuple]) -> list[tuple]:
    """Hits that no exception covers; both come in the order of their ends."""
    spared = sorted(spared)
    starts = np.array([s for s, _ in spared])
    reach = np.maximum.accumulate(np.array([e for _, e in spared]))
    at = np.searchsorted(starts, [s for s, _, _ in hits], side="right") - 1
    return [h for h, k in zip(hits, at, strict=True) if k < 0 or reach[k] < h[1] - 1]


def entries_of(text: str) -> set[str]:
    """What a folded text offers to the lexicon: its words and their beginnings."""
    words = set(text.split())
    begun = {f" {w[:k]}" for w in words for k in BEGINNINGS if k <= len(w)}
    return begun | {f" {w} " for w in words}


def training_rows(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Folded ``text`` and ``toxic`` of labelled documents that are not held out.

    Labels of documents whose ``crc32(doc_id as text) mod 5`` is 0, null ones
    and repeats are not used. Where there are more than ``fit_rows``, those
    with the smallest hashes of their id are taken, a documented bound. Rows
    that share an id count once, by the smallest text.
    """
    known = (
        labels.where(~held_out() & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    # A rough cut by hash first, so that the ordered part does not grow with the labels.
    share = fit_rows * 1.2 / max(1, known.count())
    near = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < min(1.0, share) * (1 << 30)
    chosen = known.where(near).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most fit_rows ids
    return texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def counts(rows: DataFrame, offer) -> DataFrame:
    """Per entry of ``offer(text)``, the toxic and clean texts that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.only()
        found = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, toxic in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic")), strict=True):
                found[int(toxic)].update(offer(folded(text)))
        names = list(found[0].keys() | found[1].keys())
        for start in range(0, len(names), 50_000):
            part = names[start : start + 50_000]
            yield pa.RecordBatch.from_pydict(
                {"entry": part, "toxic": [found[1][e] for e in part], "clean": [found[0][e] for e in part]}
            )

    counted = rows.mapInArrow(run, "entry string, toxic bigint, clean bigint")
    return counted.groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Lexicon:
    """Lexicon, exceptions and score function learned from labelled texts.

    Without toxic or without clean training texts the lexicon is empty and
    every score is 0 or 1, as the labels are (0 without labels).
    """
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)
    rows = keep(training_rows(docs, labels, fit_rows))
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return Lexicon(intercept=40.0 if n_toxic else -40.0)
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    least = max(LEAST_TEXTS, math.ceil(LEAST_SHARE * n_toxic))
    strong = (
        counts(rows, entries_of)
        .withColumn("odds", odds)
        .where((F.col("toxic") >= least) & (F.col("odds") >= LEAST_ODDS))
        .orderBy(F.desc("toxic"), F.desc(F.length("entry")), "entry")
    )
    # All entries that pass: their number is bounded by the sample, whose toxic texts each hold a share of them.
    lexicon = Lexicon(weights=widest([(r["entry"], r["odds"], r["toxic"]) for r in strong.collect()]))
    lexicon.exceptions = exceptions(rows, lexicon, n_toxic, n_clean)
    lexicon.intercept, lexicon.slopes = calibrated(rows, lexicon)
    return lexicon


def widest(ordered: list[tuple[str, float, int]]) -> dict[str, float]:
    """Entries with weight and number of texts to those that the ones before do not make needless.

    An entry is needless after a beginning of its own, and as a beginning that
    is met in no more texts than an entry before it.
    """
    kept: dict[str, float] = {}
    met: dict[str, int] = {}
    for entry, weight, texts in ordered:
        beginnings = [entry[: k + 1] for k in range(min(BEGINNINGS), len(entry))]
        if met.get(entry) == texts or any(b in kept for b in beginnings):
            continue
        kept[entry] = weight
        for beginning in beginnings:
            met[beginning] = max(met.get(beginning, 0), texts)
    return kept


def exceptions(rows: DataFrame, lexicon: Lexicon, n_toxic: int, n_clean: int) -> set[str]:
    """Two neighbouring words, one an entry, that are met in clean texts rather than toxic ones."""
    if not lexicon.weights:
        return set()
    weights = lexicon.weights

    def is_entry(word: str) -> bool:
        return f" {word} " in weights or any(f" {word[:k]}" in weights for k in BEGINNINGS)

    def phrases(text: str) -> set[str]:
        words = text.split()
        hot = {w for w in set(words) if is_entry(w)}
        if not hot:
            return set()
        pairs = zip(words, words[1:], strict=False)
        return {f" {a} {b} " for a, b in pairs if a in hot or b in hot}

    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    harmless = counts(rows, phrases).where((F.col("clean") >= LEAST_TEXTS) & (odds < 0))
    return {r["entry"] for r in harmless.select("entry").collect()}


def calibrated(rows: DataFrame, lexicon: Lexicon) -> tuple[float, tuple[float, float]]:
    """Logistic regression on the two features of the at most FIT_ROWS training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            found = [features(folded(t), automaton) for t in batch.column("text").to_pylist()]
            a, b = zip(*found, strict=True) if found else ((), ())
            columns = [pa.array(a, pa.float64()), pa.array(b, pa.float64()), batch.column("toxic")]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "toxic"])

    sample = rows.select("text", F.col("toxic").cast("int")).mapInArrow(run, "a double, b double, toxic int")
    # Equal texts in another order would add up differently in the last bits.
    points = sorted((r["a"], r["b"], r["toxic"]) for r in sample.collect())
    x = np.array([(1.0, a, b) for a, b, _ in points])
    y = np.array([t for _, _, t in points], dtype=float)
    scale = np.maximum(x.std(axis=0), 1e-9) + (x.std(axis=0) == 0)
    z, beta = x / scale, np.zeros(3)
    penalty = np.diag([1e-6, 0.05, 0.05]) * len(y) / 100
    for _ in range(60):
        p = 1.0 / (1.0 + np.exp(-np.clip(z @ beta, -30, 30)))
        gradient = z.T @ (p - y) + penalty @ beta
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty + 1e-9 * np.eye(3), gradient)
        beta -= step * min(1.0, 4.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-10:
            break
    beta = beta / scale
    return float(beta[0]), (float(beta[1]), float(beta[2]))


def scored(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (0 to 1) and ``predicted`` of every whole text.

    Label, language, source and id play no part in the score. Null and empty
    texts have the score of a text without hits. A row without id is not held out.
    """
    rows = _with_scores(docs.select("doc_id", "text"), lexicon, "score")
    return rows.select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def _with_scores(docs: DataFrame, lexicon: Lexicon, name: str) -> DataFrame:
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.only()
        automaton = lexicon.automaton()
        for batch in batches:
            texts = (t.as_py() for t in batch.column("text"))
            found = np.array([features(folded(t), automaton) for t in texts]).reshape(-1, 2)
            yield batch.append_column(name, pa.array(lexicon.score(found), pa.float64()))

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def without_toxic(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The documents that the fitted lexicon does not call toxic, with all their columns.

    Only the texts go to Python and only their scores come back.
    """
    lexicon = fit(docs, labels, fit_rows)
    ship(docs.sparkSession)

    @F.arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        caches.only()
        automaton = lexicon.automaton()
        for batch in batches:
            found = np.array([features(folded(t.as_py()), automaton) for t in batch]).reshape(-1, 2)
            yield pa.array(lexicon.score(found), pa.float64())

    return docs.where(scores("text") < 0.5)
