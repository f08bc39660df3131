"""Learned scores against plain versions and held-out rows."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from texts import documents

from salesaudit.llm.language import identify, keep_identified
from salesaudit.llm.lm import DEPTH, language_model_scores
from salesaudit.llm.quality import quality_scores
from salesaudit.llm.shared import fold

SYLLABLES = {"en": ["the", "ing", "er", "and", "th", "re"], "fr": ["eau", "é", "le", "qu", "ou", "ai"], "de": ["sch", "ung", "ü", "ein", "ch", "ge"]}


def every():
    return F.lit(True)


def _text(rng: random.Random, lang: str, words: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(words))


# --- language -------------------------------------------------------------


def _grams(text: str) -> Counter:
    counts = Counter()
    words = "".join(c if c.isalpha() else " " for c in text).split()
    for word in words:
        letters = "".join(c.lower() if len(c.lower()) == 1 else c for c in word)
        padded = f"_{letters}_"
        counts.update(letters)
        counts.update(padded[i : i + 2] for i in range(len(padded) - 1))
        counts.update(padded[i : i + 3] for i in range(len(padded) - 2))
    return counts


def _code(gram: str) -> int:
    places = [0x1FFFFF if c == "_" else ord(c) for c in reversed(gram)]
    return sum(place << 21 * i for i, place in enumerate(places))


def _ranking(counts: Counter, length: int) -> dict[str, int]:
    ordered = sorted(counts, key=lambda gram: (-counts[gram], _code(gram)))
    return {gram: i for i, gram in enumerate(ordered[:length])}


def test_profiles_and_distances_match_a_plain_version(spark):
    rng = random.Random(3)
    rows = [(i, lang, _text(rng, lang, rng.randrange(3, 40))) for i in range(60) for lang in SYLLABLES]
    frame = spark.createDataFrame([(i, text, lang) for i, lang, text in rows], "doc_id long, text string, lang string")
    profiles = {}
    for lang in SYLLABLES:
        total = Counter()
        for _, own, text in rows:
            if own == lang:
                total.update(_grams(text))
        profiles[lang] = _ranking(total, 40)
    expected = []
    for i, _, text in rows:
        own = _ranking(_grams(text), 40)
        away = {lang: sum(abs(r - p[g]) if g in p else 40 for g, r in own.items()) for lang, p in profiles.items()}
        best = min(sorted(away), key=away.get)
        expected.append((i, best, round(1 - away[best] / (40 * len(own)), 9)))
    found = identify(frame.repartition(4), every(), length=40).collect()
    assert sorted((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in found) == sorted(expected)


def test_language_of_odd_rows(spark):
    rows = [(1, "the thing"), (2, None), (3, ""), (4, "12 !? \n"), (None, "the and"), (5, "ther " * 40_000), (2**62 + 1, "İΣ ßé 日本")]
    frame = documents(spark, rows)
    found = {row["doc_id"]: (row["lang_pred"], row["score"]) for row in identify(frame, every()).collect()}
    assert found.keys() == {doc for doc, _ in rows}
    assert {doc for doc, (lang, _) in found.items() if lang == "und"} == {2, 3, 4}
    assert all(0 <= score <= 1 for _, score in found.values()) and found[2][1] == 0
    kept = keep_identified(frame, every())
    assert kept.columns == frame.columns and kept.count() == 4
    nothing = identify(frame, F.lit(False)).collect()
    assert {row["lang_pred"] for row in nothing} == {"und"}
    assert identify(documents(spark, []), every()).count() == 0


# --- language model -------------------------------------------------------


def _log_kt(zeros: int, ones: int) -> float:
    return math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.lgamma(zeros + ones + 1) - math.log(math.pi)


def _tree(texts: list[bytes]) -> dict:
    """(context, node) -> [zeros, ones], for contexts of every depth."""
    counts: dict = {}
    for text in texts:
        data = bytes(DEPTH) + text + b"\0"
        for i in range(DEPTH, len(data)):
            for depth in range(DEPTH + 1):
                context, node = data[i - depth : i], 1
                for k in range(7, -1, -1):
                    bit = data[i] >> k & 1
                    counts.setdefault((context, node), [0, 0])[bit] += 1
                    node = 2 * node + bit
    return counts


def _weighted(counts: dict) -> dict:
    """(context, node) -> (ln of the weighted probability, weight of ending there)."""
    children: dict = {}
    for context, node in counts:
        if context:
            children.setdefault((context[1:], node), []).append((context, node))
    done: dict = {}
    for key in sorted(counts, key=lambda key: -len(key[0])):
        own = _log_kt(*counts[key])
        if len(key[0]) == DEPTH:
            done[key] = (own, 1.0)
        else:
            longer = sum(done[child][0] for child in children[key])
            high = max(own, longer)
            both = math.exp(own - high) + math.exp(longer - high)
            done[key] = (high + math.log(both / 2), math.exp(own - high) / both)
    return done


def _ends(counts: dict, weights: dict, text: bytes, i: int, node: int, depth: int) -> float:
    """The chance of a one, by the definition: half to the own estimate, half to the longer context, seen or not."""
    key = (text[i - depth : i], node)
    zeros, ones = counts.get(key, (0, 0))
    one = (ones + 0.5) / (zeros + ones + 1)
    if depth == DEPTH:
        return one
    stop = weights[key][1] if key in weights else 0.5
    return stop * one + (1 - stop) * _ends(counts, weights, text, i, node, depth + 1)


def _score(counts: dict, weights: dict, text: bytes) -> float:
    data, total = bytes(DEPTH) + text + b"\0", 0.0
    for i in range(DEPTH, len(data)):
        node = 1
        for k in range(7, -1, -1):
            bit = data[i] >> k & 1
            chance = _ends(counts, weights, data, i, node, 0)
            total += math.log10(chance if bit else 1 - chance)
            node = 2 * node + bit
    return total


def test_chances_are_a_ratio_of_whole_code_lengths():
    """The tree's probability of a text and one more bit over that of the text: what a predicted chance must be."""
    train = [b"abcabdabc", b"xabc"]
    counts = _tree(train)
    weights = _weighted(counts)
    for context, node in ((b"zzabc", 1), (b"xxxxx", 1), (b"abdab", 1), (b"\x00\x00abz", 3)):
        more = {key: list(value) for key, value in counts.items()}
        for depth in range(DEPTH + 1):
            more.setdefault((context[DEPTH - depth :], node), [0, 0])[1] += 1
        root = (b"", node)
        before = weights[root][0] if root in weights else 0.0
        ratio = math.exp(_weighted(more)[root][0] - before)
        assert _ends(counts, weights, context, DEPTH, node, 0) == pytest.approx(ratio, rel=1e-9)


@pytest.mark.parametrize("head_words", [1 << 17, 4])
def test_scores_match_plain_models(spark, head_words):
    rng = random.Random(8)
    rows = [(i, _text(rng, rng.choice(list(SYLLABLES)), rng.randrange(12))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "The\tthe THE"), (103, "日本 日本"), (104, "hot " * 200), (104, "hot " * 200), (None, "x")]
    learn = [doc is None or zlib.crc32(str(doc).encode()) % 7 != 2 for doc, _ in rows]
    frame = documents(spark, rows).repartition(3)
    found = language_model_scores(frame, ~fold("doc_id", 2, 7), head_words=head_words).collect()
    texts = [(text or "").encode() for _, text in rows]
    train = [text for text, own in zip(texts, learn, strict=True) if own]
    counts = _tree(train)
    weights = _weighted(counts)
    words = Counter()
    for text in train:
        words.update([*text.lower().split(), None])
    total = sum(words.values())
    expected = []
    for (doc, _), text in zip(rows, texts, strict=True):
        tokens = [*text.lower().split(), None]
        base = sum(math.log10((words[w] + 1) / (total + len(words) + 1)) for w in tokens)
        expected.append((doc or -1, len(tokens), sum(words[w] > 0 for w in tokens), total, base, _score(counts, weights, text)))
    found = [(r["doc_id"] or -1, r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in found]
    for a, b in zip(sorted(found), sorted(expected), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9) and a[5] == pytest.approx(b[5], rel=1e-4)


@pytest.mark.parametrize("most_nodes", [0, 8, 500])
def test_scores_do_not_depend_on_what_tasks_hold(spark, most_nodes):
    rng = random.Random(21)
    rows = [(i, _text(rng, rng.choice(list(SYLLABLES)), rng.randrange(15))) for i in range(50)]
    rows += [(100, None), (102, "日本 zzz"), (103, "the " * 60), (103, "the " * 60), (104, "ünseen QQQ the"), (105, "qj " * 1000)]
    frame = documents(spark, rows).repartition(3)
    learn = [doc % 3 == 0 for doc, _ in rows]
    found = language_model_scores(frame, F.col("doc_id") % 3 == 0, most_nodes=most_nodes).collect()
    texts = [(text or "").encode() for _, text in rows]
    counts = _tree([text for text, own in zip(texts, learn, strict=True) if own])
    weights = _weighted(counts)
    expected = sorted((doc, _score(counts, weights, text)) for (doc, _), text in zip(rows, texts, strict=True))
    for a, b in zip(sorted((r["doc_id"], r["score"]) for r in found), expected, strict=True):
        assert a[0] == b[0] and a[1] == pytest.approx(b[1], rel=1e-9)


def test_language_model_without_rows_or_training(spark):
    assert language_model_scores(documents(spark, []), every()).count() == 0
    (row,) = language_model_scores(documents(spark, [(1, "ab")]), F.lit(False)).collect()
    assert (row["train_tokens"], row["n_known"]) == (0, 0) and row["score"] == pytest.approx(24 * math.log10(0.5))


# --- quality --------------------------------------------------------------


def _quality_tables(spark, count: int = 900):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(count):
        good = rng.random() < 0.7
        text = _text(rng, rng.choice(list(SYLLABLES)), rng.randrange(20, 80)) + "."
        rows.append((i, text if good else " ".join(word.upper() + "!!" for word in text.split()[:3]) + " ### $$$ " + "go " * 30))
        if i % 5 < 2:
            labels.append((i, int(good)))
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int"), rows


def test_quality_is_told_from_positives_and_unlabelled_text(spark):
    docs, labels, rows = _quality_tables(spark)
    scores = quality_scores(docs, labels, ~fold("doc_id", 1, 3)).toPandas().merge(labels.toPandas(), on="doc_id")
    held_out = scores[[zlib.crc32(str(i).encode()) % 3 == 1 for i in scores["doc_id"]]]
    assert ((held_out["score"] >= 0.5) == (held_out["quality"] == 1)).mean() > 0.95
    assert 0.6 < scores["prior"].iloc[0] < 0.85
    # Labels of held-out rows and labels of 0 change nothing.
    other = labels.withColumn("quality", F.when(fold("doc_id", 1, 3), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality_scores(docs, other, ~fold("doc_id", 1, 3)).toPandas().set_index("doc_id")["score"].sort_index()
    first = scores.set_index("doc_id")["score"]
    assert np.allclose(again[first.index], first, atol=1e-6)


def test_quality_of_odd_rows(spark):
    docs = documents(spark, [(1, None), (2, ""), (None, "x"), (3, "y " * 100_000), (3, "z")])
    none = spark.createDataFrame([], "doc_id long, quality int")
    found = quality_scores(docs, none, every()).collect()
    assert len(found) == 5 and {row["score"] for row in found} == {0.5} and {row["predicted"] for row in found} == {1}
    some = spark.createDataFrame([(3, 0), (3, 1), (9, None), (None, 1)], "doc_id long, quality int")
    assert quality_scores(docs, some, every()).filter("score BETWEEN 0 AND 1").count() == 5
    assert quality_scores(documents(spark, []), some, every()).count() == 0


def test_every_feature_is_finite():
    from salesaudit.llm.quality import features

    texts = ["", " ", "\n\n", "a", "A!", "é" * 9, "\x00\x1f", "a b a b a b", "x" * 100_000]
    frame = pd.DataFrame([features(text) for text in texts])
    assert np.isfinite(frame.to_numpy()).all()
