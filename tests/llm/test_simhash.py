"""SimHash groups and the Gray-order index against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from texts import documents

from salesaudit.llm.simhash import GrayIndex, gray_rank, near_edges, simhash_groups


def _fingerprint(text, width=3):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(run, 42) for run in runs]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def _roots(prints, most=2):
    """Lowest place of the component of each fingerprint, by all pairs."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def _expected(rows):
    prints = [_fingerprint(text) for _, text in rows]
    roots, low = _roots(prints), {}
    for (doc, _), root in zip(rows, roots, strict=True):
        if doc is not None:
            low[root] = min(low.get(root, doc), doc)
    return sorted(((doc, f"{p:016x}", low.get(r)) for (doc, _), p, r in zip(rows, prints, roots, strict=True)), key=repr)


def test_groups_match_all_pairs(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for family in range(25):
        base = rng.choices(words, k=rng.choice([3, 8, 60, 300]))
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), (" \t" if family % 2 else "\n").join(copy)))
    rows += [(500, None), (490, ""), (501, " \n\t "), (None, "two words"), (502, "Two  WORDS"), (None, "alone here now"), (5, rows[5][1]), (5, rows[5][1])]
    rows += [(600, "long " * 200_000 + "end"), (601, "Ünï cödé   wörds here"), (602, "ünï cödé   wörds here")]
    found = simhash_groups(documents(spark, rows))
    assert sorted(map(tuple, found.select("doc_id", "fingerprint", "component_id").collect()), key=repr) == _expected(rows)


def test_empty_table(spark):
    found = simhash_groups(documents(spark, [(1, "x")]).limit(0))
    assert found.columns == ["__row", "doc_id", "fingerprint", "component_id"] and found.count() == 0


def test_gray_rank_is_the_place_in_the_sequence(spark):
    codes = [i ^ (i >> 1) for i in [0, 1, 2, 3, 1000, 2**63 - 1, 2**63, 2**63 + 5, 2**64 - 1]]
    rows = spark.createDataFrame([(i, c - 2**64 if c >> 63 else c) for i, c in enumerate(codes)], "n int, code long")
    assert [row["n"] for row in rows.orderBy(gray_rank(F.col("code"))).collect()] == list(range(len(codes)))


def _index_of(groups):
    starts = np.cumsum([0] + [len(group) for group in groups[:-1]])
    return GrayIndex(np.array([x for group in groups for x in group], dtype=np.uint64), starts), starts


@pytest.mark.parametrize("most", [0, 1, 2, 5])
def test_index_finds_the_pairs_of_each_group(most):
    rng = random.Random(most)
    groups = []
    for size in (1, 2, 7, 8, 9, 65, 600):
        base = rng.getrandbits(64)
        own = {base ^ sum(1 << bit for bit in rng.sample(range(24), rng.randrange(6))) for _ in range(size)}
        groups.append(sorted(own))
    index, starts = _index_of(groups)
    found = {(int(a), int(b)) for left, right in index.pairs(most) for a, b in zip(left, right, strict=True)}
    expected = {
        (start + i, start + j)
        for start, group in zip(starts.tolist(), groups, strict=True)
        for j in range(len(group))
        for i in range(j)
        if (group[i] ^ group[j]).bit_count() <= most
    }
    assert found == expected


def test_upper_nodes_prune_whole_groups():
    """Two far families in one group: the root's children tell them apart, so few leaves are compared."""
    rng = random.Random(1)
    families = [[base ^ rng.getrandbits(12) for _ in range(512)] for base in (0, 0xFFFF << 40)]
    index, _ = _index_of([sorted(families[0]) + sorted(families[1])])
    looked, real = [], index._differences

    def counted(query, node, level):
        looked.append(len(query))
        return real(query, node, level)

    index._differences = counted
    for _ in index.pairs(0):
        pass
    assert sum(looked) < 1024 * 1023 / 2 / 4


def _components(edges, prints):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for u, v in edges:
        root[max(find(u), find(v))] = min(find(u), find(v))
    return {p: find(p) for p in prints}


def test_dense_nodes_are_parted_until_they_fit(spark):
    """All fingerprints share 44 bits: one node holds them all and is parted again and again."""
    rng = random.Random(9)
    prints = sorted({(rng.getrandbits(20) << 20) - (1 << 62) for _ in range(700)} | {(1 << i) - (1 << 62) for i in range(20, 40)})
    frame = spark.createDataFrame([(p,) for p in prints], "fingerprint long")
    edges = [tuple(row) for row in near_edges(frame, 2, 16).collect()]
    plain = _roots([p % 2**64 for p in prints])
    found = _components(edges, prints)
    same = {}
    for p, r in zip(prints, plain, strict=True):
        same.setdefault(r, set()).add(found[p])
    assert all(len(x) == 1 for x in same.values()) and len(same) == len({min(x) for x in same.values()})


def test_edges_grow_with_the_rows_in_a_dense_group(spark):
    """Fingerprints all within two bits of each other: a forest for each part, not all pairs."""
    prints = [0] + [1 << bit for bit in range(62)]
    frame = spark.createDataFrame([(p,) for p in prints], "fingerprint long")
    assert near_edges(frame, 2).count() <= 3 * len(prints)
