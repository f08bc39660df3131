"""Exact dedup against a plain grouping; the index with few key bits, so that texts collide."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F
from texts import documents

from salesaudit.llm.exact import directory, drop_copies, exact_groups, text_index


def _expected(rows):
    groups = {}
    for doc, text in rows:
        groups.setdefault(text or "", []).append(doc)
    out = []
    for doc, text in rows:
        same = groups[text or ""]
        keep = max((x for x in same if x is not None), default=None)
        out.append((doc, keep, len(same), hashlib.sha256((text or "").encode()).hexdigest()))
    return out


KEY = lambda row: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in row)


@pytest.mark.parametrize(("capacity", "bits"), [(4096, 62), (2, 6), (1, 3)])
def test_groups_match_whatever_the_directory(spark, capacity, bits):
    rng = random.Random(bits)
    rows = [(i, f"text {rng.randrange(60)}" if i % 3 else "hot") for i in range(300)]
    rows += [(900, None), (901, ""), (None, "hot"), (None, "alone"), (5, "long " * 50_000), (5, "long " * 50_000)]
    found = exact_groups(documents(spark, rows), capacity=capacity, bits=bits)
    columns = ("doc_id", "keep_id", "group_size", "text_sha256")
    assert sorted(map(tuple, found.select(*columns).collect()), key=KEY) == sorted(_expected(rows), key=KEY)
    # One row of each group stays, also of rows repeated with the same id.
    kept = found.filter("kept").groupBy("text_sha256").count().collect()
    assert len(kept) == len({text or "" for _, text in rows}) and {row["count"] for row in kept} == {1}


def test_chains_hold_the_texts_of_a_key(spark):
    rows = [(i, f"text {i}") for i in range(40)]
    index = text_index(documents(spark, rows), capacity=1, bits=3).collect()
    chains = {}
    for row in index:
        chains.setdefault(row["key"], []).append(row["chain"])
    assert len(index) == 40 and all(sorted(c) == list(range(1, len(c) + 1)) for c in chains.values())


def test_a_chain_alone_tells_texts_of_one_key_apart(spark):
    """One key bit: two keys for all texts, so that equality is decided by the bytes in the chains."""
    rows = [(i, f"text {i % 25}") for i in range(200)] + [(300, "Text 1"), (301, "text 1 "), (302, "")]
    index = text_index(documents(spark, rows), capacity=1, bits=1).collect()
    assert len(index) == 28 and len({row["key"] for row in index}) == 2
    assert max(row["chain"] for row in index) >= 14
    found = exact_groups(documents(spark, rows), capacity=1, bits=1)
    assert sorted(map(tuple, found.select("doc_id", "keep_id", "group_size", "text_sha256").collect())) == sorted(_expected(rows))


def test_a_bucket_is_a_range_of_keys(spark):
    rows = [(i, f"text {i}") for i in range(300)]
    index = text_index(documents(spark, rows), capacity=4, bits=12).collect()
    held = {}
    for row in index:
        assert row["key"] >> (12 - row["depth"]) == row["bucket"]
        held.setdefault((row["depth"], row["bucket"]), set()).add(row["key"])
    assert max(map(len, held.values())) <= 4 and len({depth for depth, _ in held}) > 1


def test_buckets_are_split_only_where_they_overflow(spark):
    keys = spark.createDataFrame([(i,) for i in range(8)] + [(i * 8,) for i in range(2, 8)], "key long")
    cells = directory(keys, capacity=2, bits=6).collect()
    filled = {}
    for key in (row["key"] for row in keys.collect()):
        (cell,) = [c for c in cells if c["cell"] == key >> c["low_bits"]]
        filled.setdefault((cell["depth"], cell["bucket"]), []).append(key)
    assert all(len(x) <= 2 for x in filled.values())
    assert len({depth for depth, _ in filled}) > 1
    for depth, bucket in filled:
        other = [key for key in filled if key[0] == depth and key[1] == bucket ^ 1]
        deeper = [key for key in filled if key[0] > depth and key[1] >> (key[0] - depth) == bucket ^ 1]
        together = len(filled[(depth, bucket)]) + sum(len(filled[key]) for key in other + deeper)
        assert depth == 0 or together > 2


def test_rows_that_stay_keep_their_columns(spark):
    frame = documents(spark, [(1, "a"), (2, "a"), (2, "a"), (3, None), (4, "")]).withColumn("key1", F.lit("x"))
    kept = drop_copies(frame)
    assert kept.columns == frame.columns
    assert sorted(row.doc_id for row in kept.collect()) == [2, 4]


def test_columns_of_any_name_stay_and_ties_have_an_order(spark):
    """Columns named like the operators' own, a column with a point, a map; repeated rows that differ elsewhere."""
    rows = [(1, "a", 7, "x", 1), (1, "a", 5, "y", 2), (1, "a", 6, "z", 3), (None, "b", 1, "u", 4), (None, "b", 2, "v", 5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, __id long, `a.b` string, __key1 long")
    frame = frame.withColumns({"__digest": F.lit("d"), "mark": F.lit(1), "order": F.lit(2), "row": F.create_map(F.lit("k"), F.lit(3))})
    ways = []
    for parts in (1, 4):
        dealt = frame.repartition(parts, "__id")
        kept = drop_copies(dealt)
        assert kept.columns == frame.columns
        ways.append(sorted(map(str, kept.collect())))
    assert ways[0] == ways[1] and len(ways[0]) == 2


def test_empty_table(spark):
    assert exact_groups(documents(spark, [])).count() == 0
    assert drop_copies(documents(spark, [])).count() == 0
