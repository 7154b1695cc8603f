import random
import re

import pytest

from gridstats.llm import licenses

PHRASES = {t.label: t.words.split() for t in licenses.BASE}
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    words = re.findall(licenses.WORD, (text or "").translate(UPPER))
    hits = [
        (k, label)
        for label, phrase in PHRASES.items()
        for k in range(len(words))
        if words[k : k + len(phrase)] == phrase
    ]
    labels = ",".join(sorted({label for _, label in hits}))
    starts = [k for k, _ in hits]
    return len(words), len(hits), min(starts, default=None), max(starts, default=None), labels


def test_base_places_equal_brute_force(documents):
    draw = random.Random(2)
    pool = "GNU General public license, license apache Apache MIT cc BY by-nc 2.0 version É λ lesser x mit".split()
    texts = {i: " ".join(draw.choice(pool) for _ in range(draw.randint(0, 60))) for i in range(300)}
    texts |= {300: None, 301: "", 302: "mit license " * 20_000, 303: "İ MIT\nLICENSE", 304: "mit éœ license 😀 cc\tby"}
    rows = licenses.scan(documents(list(texts.items()), clashing=True)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        got = (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])
        assert got == brute(texts[r["doc_id"]]), texts[r["doc_id"]][:200]
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert (r["score"] == 1.0) if r["n_base"] else (0 <= r["score"] <= 1)


@pytest.mark.parametrize(
    "text, labels, spans",
    [
        ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc", [("cc-by", 2, 2), ("cc-by-nc", 2, 3)]),
        ("GNU General Public License, version 3", "gpl,gpl-3.0", [("gpl", 0, 4), ("gpl-3.0", 0, 6)]),
        ("under the Apache License, Version 2.0", "apache,apache-2.0", [("apache", 2, 2), ("apache-2.0", 2, 5)]),
        ("Redistribution and use in source and binary forms", "bsd", [("bsd", 0, 8)]),
        ("use in source and binary forms", "bsd", [("bsd", -2, 8)]),
        ("binary forms", "", []),
        ("Permission is hereby granted, free of charge", "mit", [("mit", 0, 7)]),
        ("a general public licence of the GNU", "", []),
    ],
)
def test_own_labels(documents, text, labels, spans):
    row = licenses.scan(documents([(1, text)])).first()
    assert row["labels"] == labels
    assert [tuple(s) for s in row["spans"]] == spans


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""


def found_in(documents, *texts):
    rows = licenses.scan(documents(list(enumerate(texts)), clashing=True)).collect()
    return [(r["labels"], r["score"]) for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_passages_are_found_whole_changed_and_in_long_texts(documents):
    changed = MIT.replace("person", "user").replace("furnished", "given")
    without_key = MIT.replace("merge, publish", "publish, merge").replace("hereby granted", "hereby given")
    whole, other, long, none = found_in(documents, MIT, changed, "lorem " * 30_000 + MIT + " ipsum" * 30_000, without_key)
    assert whole == long == ("mit", 1.0)
    assert other[0] == "mit"
    assert none[0] == "", "no key phrase is in place"


def test_a_changed_passage_has_the_share_of_its_weight(documents):
    only = tuple(t for t in licenses.PASSAGES if "sublicense" in t.words)
    changed = MIT.replace("person", "user").replace("furnished", "given")
    rows = {r["doc_id"]: r for r in licenses.scan(documents([(1, MIT), (2, changed)]), only).collect()}
    assert rows[1]["score"] == 1.0 and 0.6 <= rows[2]["score"] < 1.0
    assert [tuple(s) for s in rows[2]["spans"]] == [("mit", 0, len(re.findall(licenses.WORD, MIT)))]
    cut = " ".join(MIT.split()[35:50])
    assert licenses.scan(documents([(1, cut)]), only).first()["labels"] == "", "less than the least share"


def test_every_template_finds_its_own_words(documents):
    texts = [t.words.replace("_", "filler") for t in licenses.TEMPLATES]
    for template, (labels, score) in zip(licenses.TEMPLATES, found_in(documents, *texts), strict=True):
        assert template.label in labels.split(",") and score == 1.0, template


def test_common_licence_words_alone_are_no_licence(documents):
    text = "free software copy the public work under general conditions and distribute files license notice rights " * 50
    assert found_in(documents, text) == [("", 0.0)]


def test_repeated_rows_missing_ids_and_no_rows(documents):
    docs = documents([(1, "mit license"), (1, "mit license"), (None, "cc by")])
    assert licenses.scan(docs).count() == 3
    assert licenses.scan(docs.limit(0)).count() == 0


def test_main_path_has_no_python(documents):
    plan = licenses.scan(documents([(1, "mit license")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
