"""Near-duplicate documents by HyperMinHash sketches, banding and confirmation on full sets."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from salesaudit.llm.graph import components
from salesaudit.llm.grams import mixed, shingles, word_hashes
from salesaudit.llm.shared import KEYS, ROW, begins, numbered, one_of_each, saved, text_keys, whole_text

BUCKET_BITS = 7
BUCKETS = 1 << BUCKET_BITS
PLACES = 52  # bits of a hash below its bucket that are looked at
MANTISSA = 10
BAND = 4  # registers of a band: at a similarity of 0.8 a pair shares no band once in 10 million
PROBES = 16
SURE = 256  # shingles from which on the registers' estimate is near normal

BLOCK_TEXTS = 1000


@lru_cache(maxsize=1)
def _probes() -> np.ndarray:
    """For each attempt, which bucket an empty bucket looks into."""
    grid = np.arange(PROBES * BUCKETS, dtype=np.uint64) + np.uint64(1)
    return (mixed(grid) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64).reshape(PROBES, BUCKETS)


@lru_cache(maxsize=1)
def _salts() -> np.ndarray:
    """A number of its own for each bucket."""
    return mixed(np.arange(BUCKETS, dtype=np.uint64) + np.uint64(1 << 32))


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """A row of registers for each set of sorted hashes; an empty set has zeros.

    The first bits of a hash name its bucket. A bucket keeps its lowest hash as
    the count of leading zeros and the bits after the leading one. An empty
    bucket borrows from one that another hash points to, so that sparse sets
    agree in a register as often as they are similar. Where all probes
    meet empty buckets, the register is a min-hash of the whole set by an order
    of its own, so that registers of tiny sets agree independently.
    """
    found = np.zeros((len(sets), BUCKETS), dtype=np.uint16)
    for i, values in enumerate(sets):
        if not len(values):
            continue
        bucket = (values >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        low = (values[first] << np.uint64(BUCKET_BITS)) >> np.uint64(64 - PLACES)
        zeros = PLACES - np.frexp(low.astype(np.float64))[1]
        after = ((low << zeros.astype(np.uint64)) >> np.uint64(PLACES - 1 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)
        found[i, bucket[first]] = (np.minimum(zeros, 62).astype(np.uint16) << MANTISSA) + after.astype(np.uint16) + 1
    filled = found.copy()
    for probe in _probes():
        empty = filled == 0
        if not empty.any():
            break
        filled[empty] = found[:, probe][empty]
    for i in np.flatnonzero((filled == 0).any(axis=1)).tolist():
        if len(sets[i]):
            empty = np.flatnonzero(filled[i] == 0)
            low = mixed(sets[i][:, None] ^ _salts()[empty]).min(axis=0)
            filled[i, empty] = np.maximum(low & np.uint64(0xFFFF), np.uint64(1)).astype(np.uint16)
    return filled


def bands(rows: np.ndarray) -> np.ndarray:
    """A 64-bit key of each run of registers and its place."""
    keys = np.ascontiguousarray(rows).view(np.uint64)
    return mixed(mixed(keys) + np.arange(1, keys.shape[1] + 1, dtype=np.uint64)).view(np.int64)


def _set(text: str, width: int) -> np.ndarray:
    return shingles(word_hashes(text), width)


def _sketcher(width: int) -> Callable[[Column], Column]:
    def sketched(column: pd.Series) -> pd.DataFrame:
        begins("near-dedup")
        texts, parts = column.tolist(), []
        for start in range(0, len(texts), BLOCK_TEXTS):
            sets = [_set(text, width) for text in texts[start : start + BLOCK_TEXTS]]
            rows = registers(sets)
            parts.append(
                pd.DataFrame(
                    {
                        "n_shingles": [len(values) for values in sets],
                        "set_key": [blake2b(values.tobytes(), digest_size=16).digest() for values in sets],
                        "registers": [row.tobytes() for row in rows],
                        "bands": list(bands(rows)),
                    }
                )
            )
        return pd.concat(parts)

    return F.pandas_udf(sketched, "n_shingles long, set_key binary, registers binary, bands array<long>")


def _setter(width: int) -> Callable[[Column], Column]:
    def listed(column: pd.Series) -> pd.Series:
        begins("near-dedup")
        return pd.Series([_set(text, width).view(np.int64) for text in column])

    return F.pandas_udf(listed, "array<long>")


@lru_cache(maxsize=4096)
def collisions(load_a: float, load_b: float) -> float:
    """How often registers of unlike sets agree by chance, given the hashes a bucket gets from each.

    The chance that a bucket's lowest hash lies in a register's span, for both
    sets, summed over all spans of (leading zeros, mantissa).
    """
    steps = 1 + np.arange(0, (1 << MANTISSA) + 1) / (1 << MANTISSA)
    total = 0.0
    for zeros in range(24):
        bounds = steps * 2.0 ** -(zeros + 1)
        spans = [-np.diff((1 - bounds) ** max(load, 1.0)) for load in (load_a, load_b)]
        total += float(spans[0] @ spans[1])
    return total


def _class(count: int) -> float:
    return 2.0 ** (round(2 * np.log2(max(count, 1) / BUCKETS)) / 2)


@F.pandas_udf(DoubleType())
def estimated(a: pd.Series, b: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
    """Jaccard similarity by registers, less what agrees by chance."""
    begins("near-dedup")
    left, right = (np.frombuffer(b"".join(x), dtype=np.uint16).reshape(-1, BUCKETS) for x in (a, b))
    agree = (left == right).mean(axis=1) if len(a) else np.zeros(0)
    chance = np.array([collisions(_class(x), _class(y)) for x, y in zip(n_a, n_b, strict=True)])
    return pd.Series((agree - chance) / (1 - chance))


def _not_excluded(threshold: float) -> Column:
    """Whether registers leave it open that a pair is similar: five deviations below count as dissimilar."""
    slack = 5 * (threshold * (1 - threshold) / BUCKETS) ** 0.5
    sparse = F.least("n_a", "n_b") < SURE
    return sparse | (estimated("registers_a", "registers_b", "n_a", "n_b") >= threshold - slack)


def _beside(pairs: DataFrame, values: DataFrame, side: str) -> DataFrame:
    """The columns of ``values`` (by row) added to ``pairs`` for its side a or b."""
    return pairs.join(values.select(*[F.col(c).alias(side if c == ROW else f"{c}_{side}") for c in values.columns]), side)


def _joined(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """(row, component) after more links."""
    edges = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if labels is not None:
        edges = edges.unionByName(labels.select(F.col(ROW).alias("u"), F.col("component").alias("v")))
    return saved(components(edges).select(F.col("node").alias(ROW), "component"), "labels")


def _families(members: DataFrame, labels: DataFrame, links: DataFrame) -> DataFrame:
    """(family, hub, row, n, component): who shares a band with whom, where that is still open.

    A band belongs to the component that most of its members are in. All members
    of a component's bands are its family, listed with the member that has most
    links as hub. Bands that lie in one component, or that hold two members, are
    settled.
    """
    placed = members.join(labels, ROW, "left").withColumn("component", F.coalesce("component", ROW))
    parts = placed.groupBy("band", "component").agg(F.count(F.lit(1)).alias("times"))
    most = F.max(F.struct("times", (-F.col("component")).alias("component")))
    parts = parts.groupBy("band").agg(F.count(F.lit(1)).alias("parts"), F.sum("times").alias("size"), most.alias("most"))
    parts = parts.filter("parts > 1 AND size > 2").select("band", (-F.col("most.component")).alias("family"))
    listed = placed.join(parts, "band").select("family", ROW, "n", "component").distinct()
    degrees = links.groupBy(F.col("a").alias(ROW)).agg(F.count(F.lit(1)).alias("links")).join(labels, ROW)
    best = degrees.groupBy("component").agg(F.max(F.struct("links", (-F.col(ROW)).alias("hub"))).alias("best"))
    hubs = best.select(F.col("component").alias("family"), (-F.col("best.hub")).alias("hub"))
    return listed.join(hubs, "family", "left").withColumn("hub", F.coalesce("hub", "family"))


def _family_links(families: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of similar members of a family in different components.

    Each member is held as what sets it apart from the hub: hashes that one of
    the two lacks. Two members share |hub| - missing_a - missing_b + common
    hashes, where common counts the entries that both lists have. So a pair is
    similar if common >= need_a + need_b - |hub|, with need = missing + percent /
    (100 + percent) * n. A pair that needs none is found by the member of least
    need; for all others the lists must meet in the rarest entries of one of
    them, as in prefix filtering.
    """
    own, other = F.col("hashes"), F.col("hub_hashes")
    full = families.join(sets, ROW).join(sets.withColumnsRenamed({ROW: "hub", "hashes": "hub_hashes"}), "hub")
    # need is kept as a whole number: times (100 + percent).
    missing = F.array_except(other, own)
    members = full.select(
        "family",
        ROW,
        "component",
        (F.size(missing) * (100 + percent) + F.col("n") * percent).alias("need"),
        (F.size(other) * (100 + percent)).alias("whole"),
        F.concat(F.array_except(own, other), missing).alias("apart"),
    )
    members = saved(members, "family-members")
    outside = F.col("component") != F.col("family")
    least = members.groupBy("family").agg(
        F.min(F.struct("need", ROW, outside.alias("outside"))).alias("nearest"), F.min(F.when(outside, F.col("need"))).alias("outside_need")
    )
    members = members.join(least, "family")
    near = (F.col(ROW) != F.col("nearest." + ROW)) & (F.col("need") + F.col("nearest.need") <= F.col("whole"))
    certain = members.filter(near & (outside | F.col("nearest.outside"))).select(F.col(ROW).alias("a"), F.col("nearest." + ROW).alias("b"))

    keys = ["family", ROW, "component", "need", "outside_need", "least_need", "whole", "entries"]
    members = members.withColumns({"entries": F.size("apart"), "least_need": F.col("nearest.need")})
    listed = saved(members.select(*keys, F.explode("apart").alias("entry")), "family-entries")
    rarity = listed.groupBy("family", "entry").agg(F.count(F.lit(1)).alias("times"), F.count_if(outside).alias("outside_times"))
    # Entries that no pair of different components can share come first in everybody's order, then the rare ones.
    rarity = rarity.filter("times > 1 AND outside_times > 0").select("family", "entry", "times")
    ranked = listed.join(rarity, ["family", "entry"]).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("times", "entry"))).alias("order")
    )
    least = lambda other: F.greatest(F.lit(1), F.ceil((F.col("need") + other - F.col("whole")) / (100 + percent)))
    partner = F.when(outside, F.col("least_need")).otherwise(F.col("outside_need"))
    placed = ranked.select(*keys, F.size("order").alias("shared"), F.posexplode("order").alias("at", "x"))
    placed = placed.withColumn("at", F.col("at") + 1 + F.col("entries") - F.col("shared"))
    placed = placed.filter(F.col("at") <= F.col("entries") - least(partner) + 1)
    placed = placed.select("family", F.col("x.entry").alias("entry"), ROW, "component", "need", "whole", "entries", "at", outside.alias("outside"))
    placed = saved(placed, "family-prefixes")
    other = placed.drop("whole").withColumnsRenamed({c: f"{c}_b" for c in (ROW, "component", "need", "entries", "at", "outside")})
    both_sides = placed.filter("outside").join(other, ["family", "entry"])
    # The first entry that two lists share leaves room for all they must share in both.
    enough = least(F.col("need_b")) - 1
    met = both_sides.filter(
        (F.col("component") != F.col("component_b"))
        & (~F.col("outside_b") | (F.col(ROW) < F.col(f"{ROW}_b")))
        & (F.col("at") <= F.col("entries") - enough)
        & (F.col("at_b") <= F.col("entries_b") - enough)
    )
    pairs = saved(met.select("family", F.col(ROW).alias("a"), F.col(f"{ROW}_b").alias("b")).distinct(), "family-pairs")
    held = members.select("family", ROW, "need", "whole", "apart")
    both = pairs
    for side in ("a", "b"):
        both = both.join(held.select("family", *[F.col(c).alias(side if c == ROW else f"{c}_{side}") for c in held.columns[1:]]), ["family", side])
    common = F.size(F.array_intersect("apart_a", "apart_b")) * (100 + percent)
    similar = both.filter(common >= F.col("need_a") + F.col("need_b") - F.col("whole_a"))
    return saved(similar.select("a", "b").unionByName(certain), "family-links")


def _links(docs: DataFrame, sketches: DataFrame, text: str, width: int, percent: int) -> DataFrame:
    """(row, component) of the sets that are linked with another set; row stands for all equal sets."""
    exploded = sketches.select(ROW, "n_shingles", F.explode("bands").alias("band"))
    shared = exploded.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min(ROW).alias("hub")).filter("size > 1")
    members = saved(exploded.join(shared, "band").select("band", "hub", ROW, F.col("n_shingles").alias("n")), "members")
    # The texts are read again and found by their keys; copies of a text give its set once.
    needed = members.select(ROW).distinct().join(sketches.select(ROW, *KEYS), ROW)
    texts = docs.select(*text_keys(text), whole_text(text).alias("text")).join(needed.select(KEYS), KEYS, "left_semi")
    texts = texts.groupBy(*KEYS, "text").agg(F.lit(True).alias("there"))
    sets = saved(texts.join(needed, KEYS).select(ROW, _setter(width)("text").alias("hashes")), "sets")
    sketches = sketches.select(ROW, "registers", F.col("n_shingles").alias("n"))

    pairs = members.filter(F.col("hub") != F.col(ROW)).select(F.col("hub").alias("a"), F.col(ROW).alias("b")).distinct()
    likely = _beside(_beside(pairs, sketches, "a"), sketches, "b")
    likely = likely.filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent).filter(_not_excluded(percent / 100))
    full = _beside(_beside(likely.select("a", "b"), sets, "a"), sets, "b")
    common = F.size(F.array_intersect("hashes_a", "hashes_b"))
    union = F.size("hashes_a") + F.size("hashes_b") - common
    links = saved(full.filter(100 * common >= percent * union).select("a", "b"), "links")
    labels = _joined(None, links)
    return _joined(labels, _family_links(_families(members, labels, links), sets, percent))


def near_groups(docs: DataFrame, text: str = "text", id_column: str = "doc_id", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: its number, text keys, id, n_shingles, component_id, and whether it stays.

    Words are runs without blanks, A-Z in lower case; a document's set holds its
    runs of ``width`` words, or all words as one if there are fewer. Documents
    are linked if 100 * intersection >= ``percent`` * union; component_id is the
    lowest id that links lead to. Texts without words are linked with nothing.
    NULL ids are never the lowest; of rows with the lowest id the first stays.

    Equal sets count as one. Sets that share a band of registers are tested
    against the first one of that band. Where this leaves members of a band in
    different components, those are compared by what sets them apart from a
    common hub: no pair within a component is expanded, and no similar pair of
    different components that shares a band is missed.
    """
    sketch = _sketcher(width)(whole_text(text)).alias("sketch")
    rows = numbered(docs, F.col(id_column).alias("doc_id"), *text_keys(text), sketch)
    sketches = saved(rows.select(ROW, "doc_id", *KEYS, "sketch.*"), "sketches")
    some = sketches.filter("n_shingles > 0")
    different = saved(some.groupBy("set_key").agg(F.min(ROW).alias(ROW)), "different-sets")
    own = some.select(ROW, *KEYS, "n_shingles", "registers", "bands").join(different.select(ROW), ROW, "left_semi")
    labels = _links(docs, own, text, width, percent)
    placed = different.withColumnRenamed(ROW, "set_row").join(labels.withColumnRenamed(ROW, "set_row"), "set_row", "left")
    placed = placed.select("set_key", F.coalesce("component", "set_row").alias("component"))
    # An empty set has no entry among the different sets and is its own component.
    slim = sketches.select(ROW, "doc_id", *KEYS, "n_shingles", "set_key").join(placed, "set_key", "left")
    slim = saved(slim.select(ROW, "doc_id", *KEYS, "n_shingles", F.coalesce("component", ROW).alias("component"), F.col("component").isNull().alias("alone")), "placed")
    lowest = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", ROW))).alias("lowest")
    stays = slim.groupBy("component", "alone").agg(lowest, F.min(ROW).alias("first"))
    found = slim.join(stays, ["component", "alone"])
    return found.select(
        ROW,
        *KEYS,
        "doc_id",
        "n_shingles",
        F.col("lowest.doc_id").alias("component_id"),
        (F.col(ROW) == F.coalesce("lowest." + ROW, "first")).alias("stays"),
    )


def drop_near_copies(docs: DataFrame, text: str = "text", id_column: str = "doc_id", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with all their columns.

    They are found again by id and text, so that it does not matter how another
    reading of ``docs`` deals out its rows; of repeated rows with one id and
    text, one stays. Columns may have any name.
    """
    stays = near_groups(docs, text, id_column, width, percent).filter("stays")
    stays = stays.select(F.concat_ws("/", *KEYS, F.col("doc_id").cast("string")).alias("mark"))
    return one_of_each(docs, F.concat_ws("/", *text_keys(text), F.col(id_column).cast("string")), stays)
