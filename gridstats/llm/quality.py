"""Quality of texts, learned from trusted positives and unlabelled text.

No bad text is named to the learner. Texts labelled good are the positives;
texts of the corpus at large, good or bad, are the unlabelled ones. The risk of
a linear score g is estimated without negatives,

    pi * P[loss(g)] + max(0, U[loss(-g)] - pi * P[loss(-g)]),

where P and U are means over positives and unlabelled texts, pi is the share of
good texts in the corpus, and the second part, the risk on bad texts, is kept
from falling below zero, where a flexible score would begin to overfit
(Kiryo, Niu, du Plessis, Sugiyama: Positive-unlabeled learning with non-negative
risk estimator, 2017). pi is not known: it is the least ratio of unlabelled to
positive texts above any threshold of a score that tells the two sets apart,
with its confidence bound, on texts that this score was not fitted on (Garg,
Wu, Smola, Balakrishnan, Lipton: Mixture proportion estimation and PU learning,
2021).

A text is seen as shares of pairs of neighbouring kinds of signs (letters by
case, digits, blanks, line ends, marks), of lengths of words, of repeats.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstats.shipping import ship
from gridstats.sources import keep

#: Labelled good texts and unlabelled texts that the score is fitted on, at most.
FIT_ROWS, UNLABELLED_ROWS = 10_000, 20_000
#: Steps of the fit, its step size, weight of the squares of the coefficients, and confidence of the bound on pi.
STEPS, STEP, PENALTY, DELTA = 600, 0.05, 1e-4, 0.1

#: Kinds of bytes: 0 lower case, 1 upper case, 2 digit, 3 blank, 4 line end, 5 end of a sentence, 6 comma and the like,
#: 7 quotes and brackets, 8 other signs, 9 part of a longer sign (a letter, mostly), 10 control signs.
KINDS = 11


def kinds() -> np.ndarray:
    table = np.full(256, 8, np.uint8)
    table[:32], table[127] = 10, 10
    for kind, signs in ((3, b" \t"), (4, b"\n\r\x0b\x0c"), (5, b".!?"), (6, b",;:-"), (7, b"'\"()[]")):
        table[list(signs)] = kind
    table[ord("a") : ord("z") + 1], table[ord("A") : ord("Z") + 1], table[ord("0") : ord("9") + 1] = 0, 1, 2
    table[128:] = 9
    return table


#: Edges of the classes of word lengths in bytes, and of the texts' numbers of words.
LENGTHS = np.array([1, 2, 3, 4, 6, 8, 11, 15, 21, 31, 61])
COUNTS = np.array([1, 4, 16, 64, 256, 1024, 4096])
WIDTH = KINDS * KINDS + len(LENGTHS) + 1 + len(COUNTS) + 1 + 6


def features(text: str | None, table: np.ndarray) -> np.ndarray:
    """A text as WIDTH numbers between 0 and 1, in one pass over the whole of it."""
    data = (text or "").encode()
    out = np.zeros(WIDTH, np.float32)
    codes = table[np.frombuffer(data, np.uint8)]
    pairs = np.bincount(codes[:-1].astype(np.int32) * KINDS + codes[1:], minlength=KINDS * KINDS)
    at = KINDS * KINDS
    out[:at] = np.sqrt(pairs / max(1, len(codes) - 1))  # roots bring rare pairs nearer to common ones
    gap = (codes == 3) | (codes == 4)
    edges = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    n_words = len(starts)
    sizes = np.bincount(np.searchsorted(LENGTHS, ends - starts, side="right"), minlength=len(LENGTHS) + 1)
    out[at : at + len(sizes)] = sizes / max(1, n_words)
    at += len(sizes)
    out[at + np.searchsorted(COUNTS, n_words, side="right")] = 1.0
    at += len(COUNTS) + 1
    lines = [x for x in data.split(b"\n") if x.strip()]
    words = data.split()
    if words:
        # Words that end in two marks or more, or hold no letter; repeats of words, pairs, lines and bytes of lines.
        last = codes[ends - 1]
        before = codes[np.maximum(ends - 2, 0)]
        signs = (5, 8)
        out[at] = (np.isin(last, signs) & np.isin(before, signs)).mean()
        letters = np.concatenate(([0], np.cumsum((codes <= 1) | (codes == 9))))
        out[at + 1] = (letters[ends] == letters[starts]).mean()
        out[at + 2] = len(set(words)) / len(words)
        out[at + 3] = len(set(zip(words, words[1:], strict=False))) / max(1, len(words) - 1)
        out[at + 4] = len(set(lines)) / len(lines)
        out[at + 5] = sum(len(x) for x in set(lines)) / sum(len(x) for x in lines)
    return out


@dataclass
class Scorer:
    """A linear score on standardised features, and the share of good texts it was fitted with."""

    prior: float = 0.5
    intercept: float = 0.0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(WIDTH))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(x @ self.weights + self.intercept, -60, 60)))


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def _few(ids: DataFrame, rows: int) -> DataFrame:
    """The ``rows`` ids with the smallest hashes, if there are more."""
    # A rough cut by hash first, so that the ordered part does not grow with the ids.
    share = rows * 1.2 / max(1, ids.count())
    near = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < min(1.0, share) * (1 << 30)
    return ids.where(near).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def training_rows(docs: DataFrame, labels: DataFrame, fit_rows: int, unlabelled_rows: int) -> DataFrame:
    """``text`` and ``good`` (1: trusted positive, 0: unlabelled) of documents that are not held out.

    Positives are documents labelled good and nothing else; conflicting, null
    and repeated labels are not used, negative labels not at all. Unlabelled
    texts are drawn from all documents, whatever their label. A document can be
    in both sets, as the risk asks for. Where there are more than ``fit_rows``
    and ``unlabelled_rows``, those with the smallest hashes of their id are
    taken, a documented bound. Rows that share an id count once.
    """
    good = (
        labels.where(~held_out() & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .where("quality = 1")
        .select("doc_id")
    )
    good = good.join(docs.select("doc_id"), "doc_id", "left_semi")
    everyone = docs.where(~held_out() & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    chosen = (
        _few(good, fit_rows)
        .withColumn("good", F.lit(1))
        .unionAll(_few(everyone, unlabelled_rows).withColumn("good", F.lit(0)))
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id", "good").agg(F.min("text").alias("text")).select("doc_id", "text", "good")


def fit(
    docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, unlabelled_rows: int = UNLABELLED_ROWS
) -> Scorer:
    """A scorer learned from labelled good and unlabelled texts.

    Without positives every score is 0.5.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = kinds()
        for batch in batches:
            found = [features(t.as_py(), table).tobytes() for t in batch.column("text")]
            columns = [batch.column("doc_id"), batch.column("good"), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "good", "x"])

    rows = training_rows(docs, labels, fit_rows, unlabelled_rows)
    rows = rows.select(F.col("doc_id").cast("string"), "good", "text")
    seen = keep(rows.mapInArrow(run, "doc_id string, good int, x binary"))
    # At most fit_rows + unlabelled_rows rows of WIDTH floats, in the order of their ids.
    both = seen.orderBy("doc_id", "good").toArrow()
    x = np.frombuffer(b"".join(both.column("x").to_pylist()), np.float32).reshape(-1, WIDTH).astype(np.float64)
    good = both.column("good").to_numpy() == 1
    if not good.any():
        return Scorer()
    return learned(x[good], x[~good])


def learned(positive: np.ndarray, unlabelled: np.ndarray) -> Scorer:
    """The scorer of least non-negative risk."""
    both = np.concatenate([positive, unlabelled])
    centre, spread = both.mean(axis=0), both.std(axis=0)
    spread = np.where(spread > 1e-6, spread, 1.0)
    # Coefficients of the standardised features; far outliers are as good as the bulk's edge in the fit.
    p, u = (np.clip((x - centre) / spread, -10, 10) for x in (positive, unlabelled))
    prior = estimated_prior(p, u)
    beta = least_risk(p, u, prior)
    weights = beta[1:] / spread
    return Scorer(prior, float(beta[0] - centre @ weights), weights)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


def _descended(gradient, width: int) -> np.ndarray:
    """Adam over all rows at once: no draws, the same result every time."""
    beta, first, second = np.zeros(width), np.zeros(width), np.zeros(width)
    for step in range(1, STEPS + 1):
        g = gradient(beta)
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        rate = STEP * (1 - step / (STEPS + 1))
        beta = beta - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return beta


def _with_ones(x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones((len(x), 1)), x], axis=1)


def least_risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> np.ndarray:
    """Coefficients (intercept first) of least non-negative risk under the logistic loss."""
    p, u = _with_ones(positive), _with_ones(unlabelled)

    def gradient(beta: np.ndarray) -> np.ndarray:
        gp, gu = p @ beta, u @ beta
        as_bad = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        on_bad = u.T @ _sigmoid(gu) / len(u) - prior * (p.T @ _sigmoid(gp)) / len(p)
        on_good = -prior * (p.T @ _sigmoid(-gp)) / len(p)
        shrink = 2 * PENALTY * np.concatenate([[0.0], beta[1:]])
        # Where the risk on bad texts is below zero, it is led back up instead.
        return on_good + on_bad + shrink if as_bad >= 0 else -on_bad + shrink

    return _descended(gradient, p.shape[1])


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of good texts among the unlabelled ones, from the top of a score that tells the sets apart.

    The score is fitted on the rows of even number and read on the others.
    """
    if min(len(positive), len(unlabelled)) < 4:
        return 0.5
    p, u = _with_ones(positive[::2]), _with_ones(unlabelled[::2])

    def gradient(beta: np.ndarray) -> np.ndarray:
        shrink = 2 * PENALTY * np.concatenate([[0.0], beta[1:]])
        return u.T @ _sigmoid(u @ beta) / len(u) - p.T @ _sigmoid(-(p @ beta)) / len(p) + shrink

    beta = _descended(gradient, p.shape[1])
    on_p, on_u = (np.sort(_with_ones(x[1::2]) @ beta) for x in (positive, unlabelled))
    cuts = np.unique(on_p)
    above_p = 1 - np.searchsorted(on_p, cuts) / len(on_p)
    above_u = 1 - np.searchsorted(on_u, cuts) / len(on_u)
    error = np.sqrt(np.log(4 / DELTA) / 2) * (len(on_p) ** -0.5 + len(on_u) ** -0.5)
    at = int(((above_u + error) / above_p).argmin())
    return float(np.clip(above_u[at] / above_p[at], 0.02, 0.98))


def scored(docs: DataFrame, scorer: Scorer, limit: float = 0.3) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (0 to 1) and ``predicted`` (score of ``limit`` or more) of every whole text.

    Label, language, source and id play no part in the score. Null texts have
    the score of the empty text. A row without id is not held out.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = kinds()
        for batch in batches:
            x = np.zeros((len(batch), WIDTH), np.float32)
            for i, text in enumerate(batch.column("text")):
                x[i] = features(text.as_py(), table)
            found = pa.array(scorer.score(x.astype(np.float64)), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return rows.select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= limit).cast("int").alias("predicted"),
    )
