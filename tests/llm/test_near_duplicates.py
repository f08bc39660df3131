"""Near-duplicates against all pairs of full sets."""

from __future__ import annotations

import random

import numpy as np
import pytest
from texts import documents

from salesaudit.llm.graph import components
from salesaudit.llm.neardup import bands, collisions, drop_near_copies, near_groups, registers


def _set(text: str | None, width: int) -> frozenset:
    words = (text or "").encode().lower().split()
    if len(words) < width:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def _expected(rows: list[tuple], width: int, percent: int = 80) -> list[tuple]:
    sets = [_set(text, width) for _, text in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    ids = {}
    for x, (doc, _) in zip(label, rows, strict=True):
        ids.setdefault(x, []).append(doc)
    lowest = {x: min((doc for doc in docs if doc is not None), default=None) for x, docs in ids.items()}
    return [(doc, len(s), lowest[x]) for x, s, (doc, _) in zip(label, sets, rows, strict=True)]


def _changed(rng: random.Random, words: list[str], count: int) -> list[str]:
    words = list(words)
    for _ in range(count):
        at = rng.randrange(len(words))
        words[at : at + 1] = rng.choice(([], [f"new{rng.randrange(9)}"], [words[at], f"more{rng.randrange(9)}"]))
    return words


@pytest.mark.parametrize("width", [2, 5])
def test_families_of_edited_copies_match_all_pairs(spark, width):
    rng = random.Random(width)
    rows = []
    for _ in range(6):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice((30, 90, 200)))]
        family = [base]
        for _ in range(30):
            source = rng.choice(family)
            family.append(_changed(rng, source, rng.randrange(1, max(2, len(base) // (9 if width == 2 else 25)))))
        rows += [" ".join(words) for words in family]
    rng.shuffle(rows)
    rows = [(i, text) for i, text in enumerate(rows)]
    found = near_groups(documents(spark, rows), width=width).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, found.collect())) == sorted(_expected(rows, width))


@pytest.mark.parametrize(("common", "only_a", "only_b"), [(4, 0, 1), (5, 0, 1), (8, 1, 1), (8, 0, 2), (10, 1, 1), (12, 1, 2)])
def test_tiny_similar_sets_share_a_band(common, only_a, only_b):
    rng, trials = np.random.default_rng(common), 4000
    pairs = []
    for _ in range(trials):
        values = rng.integers(0, 1 << 64, common + only_a + only_b, dtype=np.uint64)
        pairs += [np.sort(values[: common + only_a]), np.sort(np.delete(values, np.s_[common : common + only_a]))]
    keys = bands(registers(pairs))
    assert int((~(keys[::2] == keys[1::2]).any(axis=1)).sum()) == 0


def test_short_texts_match_all_pairs(spark):
    rng, rows = random.Random(31), []
    for _ in range(400):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 14))]
        rows += [" ".join(base), " ".join([*base, f"more{rng.randrange(9)}"])]
    rows = list(enumerate(rows))
    found = near_groups(documents(spark, rows), width=2).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, found.collect())) == sorted(_expected(rows, 2))


def test_odd_rows(spark):
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [(7, None), (3, ""), (5, " \n"), (9, "One"), (2, "one"), (4, "one two"), (None, "ONE two"), (6, long), (1, long), (1, long), (8, "é é é")]
    frame = documents(spark, rows)
    found = near_groups(frame, width=2).select("doc_id", "n_shingles", "component_id")
    key = lambda row: tuple((x is None, x or 0) for x in row)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(_expected(rows, 2), key=key)
    kept = drop_near_copies(frame, width=2)
    assert kept.columns == frame.columns
    assert sorted(row.doc_id for row in kept.collect()) == [1, 2, 3, 4, 5, 7, 8]


def test_empty_table(spark):
    assert near_groups(documents(spark, [])).count() == 0


def test_components_of_chains_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert found == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200, 202: 200}


def test_chance_agreement_is_small_and_falls_with_unequal_loads():
    assert 0 < collisions(4.0, 4.0) < 0.002
    assert collisions(4.0, 64.0) < collisions(4.0, 4.0)
