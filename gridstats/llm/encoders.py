"""Token ids of whole texts, made from the ids of their space-delimited chunks.

No vocabulary used here has a token that runs across the space before a word,
so a text's ids are those of its chunks one after the other. Words repeat, so
each worker process remembers the chunks it has met lately, and looks up every
chunk of neighbouring texts once. New chunks are encoded many at once, as one
text whose ids are told apart by the bytes that each of them stands for.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gridstats.llm import caches

#: Chunks that a cache remembers before its older half is dropped.
REMEMBERED = 300_000
#: Longer chunks are encoded anew each time.
LONGEST_REMEMBERED = 64
#: Characters of text that are looked up at once, in ``slices`` and by ``TokenIds``, which meets fewer chunks twice.
SLICE, IDS_SLICE = 1 << 18, 1 << 22
#: Stands between chunks; texts that have it are encoded whole.
MARK = "\x1f"
#: New chunks that are encoded as one text: the library's time for a text grows faster than its length.
JOINED = 128
#: Joined texts that are given to the library at once.
TEXTS = 64
_SAFE = "[!-&(-~À-ÖØ-öø-ÿ]+"
_PLAIN, _PLAIN_SPACED = re.compile(_SAFE), re.compile(rf"[ \n]{_SAFE}")
_LONG = re.compile(r"[^\x00-\xff]")
_LOOSE_SPACE, _WORD_SPACE = re.compile(r" (?=\s|$)"), re.compile(r" (?=\S)")
_LOOSE_BREAK = re.compile(r"\s\n")
_encoders: dict[tuple, object] = {}
caches.held("encoders", _encoders.clear)


class Remembered:
    """A bounded cache of two generations: what is not met again is dropped."""

    def __init__(self, make):
        self.make, self.new, self.old = make, {}, {}

    def lists(self, wanted: list[list[str]]) -> list[list[bytes]]:
        """What was made of every string of every list."""
        if len(self.new) > REMEMBERED:
            self.old, self.new = self.new, {}
        found = [list(map(self.new.get, keys)) for keys in wanted]
        gaps = [[at for at, value in enumerate(values) if value is None] for values in found]
        missing = {keys[at] for keys, where in zip(wanted, gaps, strict=True) for at in where}
        known = {key: self.old[key] for key in missing if key in self.old}
        fresh = [key for key in missing if key not in known]
        known.update(zip(fresh, self.make(fresh), strict=True))
        for keys, values, where in zip(wanted, found, gaps, strict=True):
            for at in where:
                values[at] = known[keys[at]]
        self.new.update((k, v) for k, v in known.items() if len(k) <= LONGEST_REMEMBERED)
        return found

    def each(self, keys: list[str]) -> list[bytes]:
        """What was made of every string, of which no two are alike."""
        if len(self.new) > REMEMBERED:
            self.old, self.new = self.new, {}
        found = list(map(self.new.get, keys))
        gaps = [at for at, value in enumerate(found) if value is None]
        for at in gaps:
            found[at] = self.old.get(keys[at])
        fresh = [at for at in gaps if found[at] is None]
        for at, value in zip(fresh, self.make([keys[at] for at in fresh]), strict=True):
            found[at] = value
        self.new.update((keys[at], found[at]) for at in gaps if len(keys[at]) <= LONGEST_REMEMBERED)
        return found


def spaced_chunks(text: str) -> str:
    """The text with a MARK between its words, each of which has the space before it.

    A space that another white space follows stays with the word before it,
    because tokenizers treat runs of white space as a whole. In a text without
    such runs, line breaks begin a chunk too.
    """
    if _LOOSE_SPACE.search(text):
        return _WORD_SPACE.sub(f"{MARK} ", text)
    marked = text.replace(" ", f"{MARK} ")
    return marked if _LOOSE_BREAK.search(text) else marked.replace("\n", f"{MARK}\n")


def word_chunks(text: str) -> str:
    """The text with a MARK in place of spaces and line breaks, for a vocabulary that ignores white space and case.

    Letters beyond Latin-1 are left to the library's own rules of case.
    """
    return (text if _LONG.search(text) else text.lower()).replace(" ", MARK).replace("\n", MARK)


class TokenIds:
    """Ids as little-endian unsigned 32-bit integers, by a tokenizers file with a byte-level alphabet.

    ``chunks`` marks a text where its ids fall apart. A text that might hold a
    special string is encoded whole, so that the library finds it. ``spaced``
    says that ids stand for white space too; a space or line break then begins
    every chunk that may be joined to others. Joined are chunks of ASCII and
    Latin-1 letters, digits and signs other than apostrophes; others are
    encoded one by one.
    """

    def __init__(self, path: str, chunks, spaced: bool):
        from tokenizers import Tokenizer

        # A task has one core; the library's own threads would spin on the others.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.chunks, self.spaced = chunks, spaced
        self.specials = [MARK, *(t.content for t in self.tokenizer.get_added_tokens_decoder().values())]
        # Bytes of text that an id stands for: the byte-level alphabet has a sign for each.
        vocabulary = self.tokenizer.get_vocab()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None) or ""
        self.widths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, number in vocabulary.items():
            self.widths[number] = len(token.removesuffix(suffix))
        self.cache = Remembered(self._encode)

    def _encode(self, chunks: list[str]) -> list[bytes]:
        out = [b""] * len(chunks)
        shape = _PLAIN_SPACED if self.spaced else _PLAIN
        plain = [shape.fullmatch(c) is not None for c in chunks]
        alone = [at for at, is_plain in enumerate(plain) if not is_plain]
        plain = [at for at, is_plain in enumerate(plain) if is_plain]
        for begin in range(0, len(plain), JOINED * TEXTS):
            part = plain[begin : begin + JOINED * TEXTS]
            found = self._joined([chunks[at] for at in part])
            if found is None:
                alone += part
                continue
            for at, ids in zip(part, found, strict=True):
                out[at] = ids
        several = self.tokenizer.encode_batch_fast([chunks[at] for at in alone], add_special_tokens=False)
        for at, one in zip(alone, several, strict=True):
            out[at] = array("I", one.ids).tobytes()
        return out

    def _joined(self, chunks: list[str]) -> list[bytes] | None:
        """Ids of chunks that are encoded together; None if the bytes of some do not end where an id's do."""
        between = "" if self.spaced else " "
        texts = [between.join(chunks[at : at + JOINED]) for at in range(0, len(chunks), JOINED)]
        several = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.array(list(chain.from_iterable(one.ids for one in several)), "<u4")
        sizes = [len(c.encode()) for c in chunks]
        wanted, ends = np.cumsum(sizes), np.cumsum(self.widths[ids])
        stops = np.searchsorted(ends, wanted) + 1
        if not len(ids) or ends[-1] != wanted[-1] or (ends[stops - 1] != wanted).any():
            return None
        raw, stops = ids.tobytes(), (4 * stops).tolist()
        return [raw[start:stop] for start, stop in zip([0, *stops], stops, strict=False)]

    def encode(self, texts: Iterable[str | None]) -> Iterable[bytes]:
        caches.only("encoders")
        for part in slices(texts, IDS_SLICE):
            special = [any(s in text for s in self.specials) for text in part]
            marked = ["" if odd else self.chunks(text) for text, odd in zip(part, special, strict=True)]
            cut = pc.split_pattern(pa.array(marked, pa.large_string()), pattern=MARK)
            coded = cut.flatten().dictionary_encode()
            found = self.cache.each(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
            ids = pa.array(found, pa.large_binary()).take(coded.indices)
            _, places, raw = ids.buffers()
            places = np.frombuffer(places, np.int64)[cut.offsets.to_numpy()].tolist()
            for text, odd, start, stop in zip(part, special, places, places[1:], strict=False):
                yield self._encode([text])[0] if odd else raw[start:stop].to_pybytes()


def slices(texts: Iterable[str | None], most: int = SLICE) -> Iterable[list[str]]:
    """Lists of neighbouring texts of about ``most`` characters; null is empty."""
    part, size = [], 0
    for text in texts:
        part.append(text or "")
        size += len(part[-1])
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def spaced_ids(path: str) -> TokenIds:
    """This process's encoder for a byte-level vocabulary that keeps white space."""
    return held(("spaced", path), lambda: TokenIds(path, spaced_chunks, spaced=True))


def word_ids(path: str) -> TokenIds:
    """This process's encoder for a vocabulary that ignores white space."""
    return held(("word", path), lambda: TokenIds(path, word_chunks, spaced=False))


def held(key: tuple, make):
    """One encoder per worker process: loading a vocabulary takes long."""
    if key not in _encoders:
        _encoders[key] = make()
    return _encoders[key]
