"""Token counts of every prefix of a text, by prefix dynamic programming.

Let ``last[i]`` be the last token of the first ``i`` characters. Dropping it
leaves the encoding of a shorter prefix, so ``count[i] = count[i - len(last[i])]
+ 1``. Among the tokens that end at ``i`` the right one is the only one that
the merge rules leave beside the last token of what comes before it. One pass
over a text thus gives the exact count of all its prefixes. As a text's words
are encoded independently, the pass runs once per word that a worker meets.

The table of a text holds, per character, by how much the count changes: one
signed byte, as a token has at most 16 characters and a character at most 4
byte tokens. Its running sum answers how many tokens a prefix has and how much
of a text fits a budget, without encoding again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstats.llm.encoders import Remembered, held, slices
from gridstats.shipping import ship

MARK = "▁"  # the vocabulary's sign for a space
_RUNS = re.compile(r" *[^ ]+| +$")
#: Pairs of neighbouring tokens whose verdict a worker remembers.
_PAIRS = 1_000_000


class PrefixCounts:
    """Per-character changes of the token count under one sentencepiece vocabulary."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.library = library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [library.id_to_piece(i) for i in range(library.vocab_size())]
        self.ends = ahocorasick.Automaton()
        for token, piece in enumerate(self.pieces):
            if not (library.is_control(token) or library.is_unknown(token) or library.is_byte(token)):
                self.ends.add_word(piece, (token, len(piece)))
        self.ends.make_automaton()
        self.none = len(self.pieces)  # stands before a text and for a character without token
        self.stays: dict[int, bool] = {}
        self.cache = Remembered(lambda chunks: [self.changes(c) for c in chunks])

    def neighbours(self, left: int, right: int) -> bool:
        """Whether the merge rules keep two tokens apart.

        A line break before them, which no token holds, takes up the space
        that the library puts before a text.
        """
        both = [self.pieces[t] for t in (left, right) if t != self.none]
        return self.library.encode("\n" + "".join(both), out_type=str)[2:] == both

    def counts(self, chunk: str) -> list[int]:
        """Tokens of the first 0, 1, ... characters; the chunk has its space signs."""
        stays, none, width = self.stays, self.none, self.none + 1
        if len(stays) > _PAIRS:
            stays.clear()
        count, last = [0] * (len(chunk) + 1), [none] * (len(chunk) + 1)
        known = 0  # characters of the longest prefix that has a count
        for at, (token, length) in self.ends.iter(chunk):
            end = at + 1
            if end == known:
                continue
            while known < at:  # characters outside the vocabulary: their bytes
                known += 1
                count[known] = count[known - 1] + byte_tokens(chunk[known - 1])
            before = end - length
            pair = last[before] * width + token
            apart = stays.get(pair)
            if apart is None:
                apart = stays[pair] = self.neighbours(last[before], token)
            if apart:
                count[end], last[end], known = count[before] + 1, token, end
        while known < len(chunk):
            known += 1
            count[known] = count[known - 1] + byte_tokens(chunk[known - 1])
        return count

    def changes(self, chunk: str) -> bytes:
        counts = self.counts(chunk)
        return bytes([(after - now) & 255 for now, after in zip(counts, counts[1:], strict=False)])

    def tables(self, texts) -> Iterator[bytes]:
        """Per text, the change of the token count at each of its characters."""
        for part in slices(texts):
            for found in self.cache.lists([self.chunks(text) for text in part]):
                if not found:
                    yield b""
                    continue
                first, *rest = found
                # The library's own leading space is no character of the text.
                both = np.frombuffer(first[:2], dtype=np.int8).sum(dtype=np.int8)
                yield b"".join([both.tobytes(), first[2:], *rest])

    def chunks(self, text: str) -> list[str]:
        """Words with the spaces before them, the first one after the library's space."""
        if not text:
            return []
        text = text.replace(MARK, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [run.replace(" ", MARK) for run in _RUNS.findall(" " + text)]
        return [MARK + word for word in text.split(" ")]


def byte_tokens(char: str) -> int:
    return len(char.encode("utf-8", "surrogatepass"))


def prefix_counts(docs: DataFrame, model: str) -> DataFrame:
    """The prefix table of every whole text.

    Returns ``doc_id``, ``n_bytes`` (UTF-8), ``changes`` (one signed byte per
    character) and ``n_tokens``, the count of the longest prefix. A null text
    is an empty one: 0 bytes, 0 tokens. A row comes out per row that goes in,
    repeated or without id; other columns are not read.
    """
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = held(("prefix", model), lambda: PrefixCounts(model))
        for batch in batches:
            found = list(tables.tables(batch.column("text").to_pylist()))
            ends = [int(np.frombuffer(t, dtype=np.int8).sum(dtype=np.int64)) for t in found]
            columns = [
                batch.column("doc_id"),
                batch.column("n_bytes"),
                pa.array(found, pa.binary()),
                pa.array(ends, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "changes", "n_tokens"])

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    rows = docs.select(F.col("doc_id").cast("bigint"), "text", size.alias("n_bytes"))
    return rows.mapInArrow(count, "doc_id bigint, n_bytes bigint, changes binary, n_tokens bigint")


def tokens_of_prefix(changes: str | Column, chars: str | Column) -> Column:
    """How many tokens the first ``chars`` characters have."""

    @F.pandas_udf("bigint")
    def summed(tables: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series(
            [
                int(np.frombuffer(t, dtype=np.int8)[: max(0, int(n))].sum(dtype=np.int64))
                for t, n in zip(tables, ends, strict=True)
            ]
        )

    return summed(changes, chars)


def longest_prefix(changes: str | Column, budget: str | Column) -> Column:
    """The most characters whose encoding has at most ``budget`` tokens."""

    @F.pandas_udf("bigint")
    def reach(tables: pd.Series, budgets: pd.Series) -> pd.Series:
        ends = []
        for table, most in zip(tables, budgets, strict=True):
            counts = np.cumsum(np.frombuffer(table, dtype=np.int8), dtype=np.int64)
            fits = np.flatnonzero(counts <= most)
            ends.append(int(fits[-1]) + 1 if len(fits) else 0)
        return pd.Series(ends)

    return reach(changes, budget)
