import random

import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def documents(spark):
    """A documents table from (doc_id, text[, source]) rows, with columns that clash with ours."""

    def make(rows, clashing=False):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        frame = spark.createDataFrame(full, DOCUMENTS)
        if clashing:
            for name in "size copies bucket id n score ids same bands _own _ident _times _copy _kept _score".split():
                frame = frame.selectExpr("*", f"doc_id as `{name}`")
        return frame

    return make


@pytest.fixture
def words():
    """Reproducible made-up words."""
    draw = random.Random(4)
    letters = "abcdefghijklmnoprstuvwé"

    def make(count, size=6):
        return ["".join(draw.choice(letters) for _ in range(draw.randint(2, size))) for _ in range(count)]

    return make


@pytest.fixture
def vocabulary():
    from gridstats.llm.queries import vocabulary as place

    return place
