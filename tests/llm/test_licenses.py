"""License scans against a search word by word."""

from __future__ import annotations

import re

from texts import documents

from salesaudit.llm.licenses import NOTICES, PHRASES, license_labels, license_spans

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def _scan(spark, rows):
    found = license_labels(license_spans(documents(spark, rows))).collect()
    return {row["doc_id"]: row for row in found}


def _places(text: str) -> tuple[list[int], set[str], int]:
    words = WORDS.findall("".join(c.lower() if c.isascii() else c for c in text))
    starts, labels = [], set()
    for phrase, label in PHRASES.items():
        own = phrase.split()
        for i in range(len(words) - len(own) + 1):
            if words[i : i + len(own)] == own:
                starts.append(i)
                labels.add(label)
    return starts, labels, len(words)


def test_phrases_anywhere(spark):
    texts = [
        "Released under the MIT License.",
        "under the mit\nlicense, UNDER-THE-MIT-LICENSE! cc by nc nd; CC BY-NC 4.0 and Apache License, Version 2.0",
        "cc by-nc cc by nc",
        "under the mit licenses; apache license version 20; cc by ncx; écc by nc",
        "under under the mit license license",
        "word " * 30_000 + "cc by nc",
        "",
        "cc by",
    ]
    rows = list(enumerate(texts))
    found = _scan(spark, [*rows, (99, None)])
    for doc, text in rows:
        starts, labels, count = _places(text)
        row = found[doc]
        assert (row["n_words"], row["n_base"], row["base_labels"]) == (count, len(starts), ",".join(sorted(labels)))
        assert (row["first_word"], row["last_word"]) == ((min(starts), max(starts)) if starts else (None, None))
        assert labels <= set(row["labels"].split(",")) and (row["score"] == 1.0) >= bool(starts)
    assert (found[99]["n_words"], found[99]["n_base"], found[99]["labels"], found[99]["score"]) == (0, 0, "", 0.0)


def test_notices_with_changes(spark):
    notice = NOTICES["mit"].split()
    changed = notice[:6] + ["really"] + notice[6:14] + notice[15:]
    found = _scan(spark, [(1, "intro " * 7 + " ".join(changed)), (2, " ".join(notice[:9])), (3, " ".join(reversed(notice)))])
    assert found[1]["labels"] == "mit" and found[1]["base_labels"] == "" and 0.6 <= found[1]["score"] < 1
    assert found[2]["labels"] == found[3]["labels"] == ""


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "cc by nc"), (1, "cc by nc"), (None, "under the mit license"), (None, "x")]
    found = license_labels(license_spans(documents(spark, rows))).collect()
    assert sorted((row["doc_id"] is None, row["n_base"]) for row in found) == [(False, 1), (False, 1), (True, 0), (True, 1)]


def test_empty_table(spark):
    assert license_labels(license_spans(documents(spark, []))).count() == 0
