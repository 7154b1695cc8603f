"""Spelling variants of the words of a corpus, by PartEnum signatures.

Two words that differ by one inserted, deleted or replaced letter have letter
multisets that differ by one letter, or by one letter on each side. A multiset
is a binary vector (one place per letter and occurrence), and those vectors
have a Hamming distance of at most two. The letters are dealt into PARTS parts;
vectors within distance two agree outside some two parts, so that a multiset
gets one signature per two parts left out: its letters of all the others.
Multisets with equal signatures are candidates, their distance is taken over
the two parts left out, and the words of a pair of multisets are verified: the
surplus letter, replaced by the missing one, must give a word of the other.

Anagrams share a multiset and are one node of the search. They are cut into
chunks, so that no row holds a class of any size.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstats.shipping import ship
from gridstats.sources import keep

#: Parts that the letters are dealt into; two are left out of a signature.
PARTS = 7
#: Words of one multiset that a row holds, at most about.
CHUNK = 256
#: Distinct words that a task counts before it hands them on.
HELD = 200_000
#: Candidates that are handed on at once.
ROWS = 50_000


def _letters() -> bytes:
    """Per Latin-1 code its lower case (A to Z only) if it is a letter of a run (A-Z, a-z, U+00C0 to U+00FF), else a blank."""
    kept = [c for c in range(256) if 65 <= c <= 90 or 97 <= c <= 122 or c >= 0xC0]
    return bytes((c + 32 if 65 <= c <= 90 else c) if c in kept else 32 for c in range(256))


def runs_of(text: str | None, letters: bytes) -> list[bytes]:
    """The runs of letters of a text in Latin-1, a byte a code point; other signs part them."""
    return (text or "").encode("latin-1", "replace").translate(letters).split()


def counted(docs: DataFrame, shortest: int, least: int, every: int = 97) -> DataFrame:
    """Distinct words of ``shortest`` letters and ``least`` occurrences or more, with their number ``n``.

    A run whose crc32 of ``<doc_id>:<run>`` is a multiple of ``every`` loses one
    letter. Runs of rows without id are taken as they are. Words are counted in
    the tasks before they are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, found = _letters(), Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                own = Counter(runs_of(text.as_py(), letters))
                if doc_id.is_valid:
                    start = crc32(f"{doc_id.as_py()}:".encode())
                    for word, n in own.items():
                        mark = crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                        if mark % every == 0:
                            at = mark % len(word)
                            word = word[:at] + word[at + 1 :]
                        if len(word) >= shortest:
                            found[word] += n
                else:
                    found.update({w: n for w, n in own.items() if len(w) >= shortest})
                if len(found) >= HELD:
                    yield handed_on(found)
                    found = Counter()
        yield handed_on(found)

    def handed_on(found: Counter) -> pa.RecordBatch:
        words = pa.array([w.decode("latin-1") for w in found], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(list(found.values()), pa.int64())], ["word", "n"])

    words = docs.select("doc_id", "text").mapInArrow(run, "word string, n bigint")
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def multisets(vocabulary: DataFrame) -> DataFrame:
    """The words' multisets: ``letters`` in order, in chunks with ``words`` and ``counts`` parted by blanks."""
    letters = F.array_join(F.array_sort(F.split("word", "")), "")
    rows = vocabulary.select(letters.alias("letters"), "word", F.col("n").cast("string").alias("n"))
    sizes = rows.groupBy("letters").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))
    chunk = F.pmod(F.xxhash64("word"), F.col("chunks")).cast("int")
    members = F.sort_array(F.collect_list(F.struct("word", "n")))
    return (
        rows.join(sizes, "letters")
        .withColumn("chunk", chunk)
        .groupBy("letters", "chunk")
        .agg(members.alias("members"))
        .select(
            "letters",
            F.array_join(F.col("members.word"), " ").alias("words"),
            F.array_join(F.col("members.n"), " ").alias("counts"),
        )
    )


def dealt(classes: DataFrame) -> dict[str, int]:
    """Per letter its part, so that parts are met about equally often; at most 90 letters come here."""
    met = classes.select(F.explode(F.array_distinct(F.split("letters", ""))).alias("letter"))
    counts = met.where("letter != ''").groupBy("letter").count().collect()
    part, load = {}, [0] * PARTS
    for row in sorted(counts, key=lambda r: (-r["count"], r["letter"])):
        lightest = min(range(PARTS), key=lambda p: (load[p], p))
        part[row["letter"]] = lightest
        load[lightest] += row["count"]
    return part


def signatures(classes: DataFrame, part: dict[str, int]) -> DataFrame:
    """Per multiset and two parts ``out``: the letters of the other parts (``rest``) and of the two (``own``)."""
    left_out = list(combinations(range(PARTS), 2))
    others = [[r for r in range(PARTS) if r not in pair] for pair in left_out]
    types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("letters").to_pylist()
            for start in range(0, len(column), ROWS // len(left_out)):
                rows = []
                for letters in column[start : start + ROWS // len(left_out)]:
                    cut = [""] * PARTS
                    for letter in dict.fromkeys(letters):
                        cut[part[letter]] += letter * letters.count(letter)
                    for out, ((p, q), kept) in enumerate(zip(left_out, others, strict=True)):
                        rows.append((letters, len(letters), out, "".join([cut[r] for r in kept]), cut[p] + cut[q]))
                columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays(columns, ["letters", "size", "out", "rest", "own"])

    return classes.mapInArrow(run, "letters string, size int, out int, rest string, own string")


def one_apart(a: str, b: str) -> tuple[str, str] | None:
    """The letter that only ``a`` has and the one that only ``b`` has ('' if none), for multisets in one order.

    None if they differ by more than one letter on a side. ``b`` is as long as
    ``a`` or shorter by one.
    """
    start, end = 0, 0
    while start < len(b) and a[start] == b[start]:
        start += 1
    while end < len(b) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if len(a) > len(b):
        return (a, "") if len(a) == 1 else None
    if a[1:] == b[:-1]:
        return a[0], b[-1]
    if a[:-1] == b[1:]:
        return a[-1], b[0]
    return None


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sides = [one_apart(a, b) for a, b in zip(*(batch.column(c).to_pylist() for c in ("a_own", "b_own")), strict=True)]
        met = pa.array([s is not None for s in sides], pa.bool_())
        found = [s for s in sides if s is not None]
        columns = [batch.column(c).filter(met) for c in ("a_letters", "b_letters")]
        columns += [pa.array([f[i] for f in found], pa.string()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays(columns, ["a_letters", "b_letters", "lost", "won"])


def neighbours(marks: DataFrame) -> DataFrame:
    """Pairs of multisets that differ by one letter, or by one on each side.

    ``a`` has the surplus letter ``lost``, ``b`` the letter ``won`` ('' if none).
    Multisets of one size meet once, and larger ones meet those smaller by one.
    A pair that differs within one part meets under several signatures, and is
    returned once.
    """
    left_out = list(combinations(range(PARTS), 2))
    left = marks.select("out", "rest", *[F.col(c).alias(f"a_{c}") for c in ("letters", "size", "own")])
    right = marks.select("out", "rest", *[F.col(c).alias(f"b_{c}") for c in ("letters", "size", "own")])
    # One letter replaced: equal sizes, each pair once.
    same = left.withColumn("b_size", F.col("a_size")).join(right, ["out", "rest", "b_size"])
    same = same.where("a_letters < b_letters")
    # One letter more: its part is left out by any signature that names it, so few signatures will do.
    few = [left_out.index((p, p + 1)) for p in range(0, PARTS - 1, 2)]
    few += [left_out.index((0, PARTS - 1))] if PARTS % 2 else []
    larger = left.where(F.col("out").isin(few)).withColumn("b_size", F.col("a_size") - 1)
    more = larger.join(right.where(F.col("out").isin(few)), ["out", "rest", "b_size"])
    columns = ["a_letters", "b_letters", "a_own", "b_own"]
    met = same.select(*columns).unionAll(more.select(*columns))
    return met.mapInArrow(_compared, "a_letters string, b_letters string, lost string, won string").distinct()


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, types = ["word", "n", "other", "other_n"], [pa.string(), pa.int64(), pa.string(), pa.int64()]
    columns = ["lost", "won", "a_words", "a_counts", "b_words", "b_counts"]

    def handed_on(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(types)], names)

    for batch in batches:
        found: list[tuple] = []
        for lost, won, words, counts, others, their in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            known = dict(zip(others.split(" "), their.split(" "), strict=True))
            for word, n in zip(words.split(" "), counts.split(" "), strict=True):
                tried, at = None, word.find(lost)
                while at >= 0:
                    other = word[:at] + won + word[at + 1 :]
                    if other in known and other != tried:
                        # The same word again comes only from a run of one letter, so it comes next.
                        tried = other
                        found.append((word, int(n), other, int(known[other])))
                    at = word.find(lost, at + 1)
            if len(found) >= ROWS:
                yield handed_on(found)
                found = []
        yield handed_on(found)


def near_words(nodes: DataFrame) -> DataFrame:
    """Words that differ by one inserted, deleted or replaced letter, each pair once, with both numbers."""
    classes = keep(nodes.select("letters").distinct())
    marks = keep(signatures(classes, dealt(classes)))
    pairs = neighbours(marks)

    def side(name: str) -> DataFrame:
        return nodes.select(*[F.col(c).alias(f"{name}_{c}") for c in ("letters", "words", "counts")])

    met = pairs.join(side("a"), "a_letters").join(side("b"), "b_letters")
    rows = met.select("lost", "won", "a_words", "a_counts", "b_words", "b_counts")
    return rows.mapInArrow(_verified, "word string, n bigint, other string, other_n bigint")


def roots(forms: DataFrame) -> DataFrame:
    """Per word with a form, the last form of its chain.

    A form has at least twice the occurrences of its word, so a chain is
    shorter than 63 steps; each round halves what is left of it.
    """
    now = keep(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        later = keep(now.join(ahead, "root", "left"))
        if later.where("next is not null").isEmpty():
            return now
        now = later.select("word", F.coalesce("next", "root").alias("root"))


def variants(docs: DataFrame, *, shortest: int = 5, least: int = 3) -> DataFrame:
    """Every word of the corpus with its form, the far more frequent word that it is a variant of.

    ``docs`` has ``doc_id`` and ``text``; other columns are not read. Words are
    those of ``counted``. Returns ``word``, ``form`` (the near word with the largest number,
    ties to the smallest in code-point order, if it has at least twice the
    word's; else null), ``root`` (the last form of the chain, the word itself
    without one), ``n``, ``n_near`` and ``form_n``.

    Null and empty texts have no words. Rows that are repeated count as often
    as they occur. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    vocabulary = keep(counted(docs, shortest, least))
    pairs = keep(near_words(keep(multisets(vocabulary))))
    ends = F.array(
        F.struct(F.col("word").alias("word"), F.col("other").alias("near"), F.col("other_n").alias("near_n")),
        F.struct(F.col("other").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")),
    )
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), "near"))
    stats = pairs.select(F.inline(ends)).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    near = keep(vocabulary.join(stats, "word", "left"))
    has_form = -F.col("best.minus") >= 2 * F.col("n")
    forms = near.where(has_form).select("word", F.col("best.near").alias("form"))
    last = roots(forms)
    return near.join(last, "word", "left").select(
        "word",
        F.when(has_form, F.col("best.near")).alias("form"),
        F.coalesce("root", "word").alias("root"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(has_form, -F.col("best.minus")).alias("form_n"),
    )
