"""SimHash near-dedup over a hierarchical index of fingerprints in Gray order."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesaudit.llm.grams import blocks
from salesaudit.llm.graph import components
from salesaudit.llm.shared import ROW, numbered, saved, whole_text

BITS = 64
SEED = 42
FANOUT = 8  # children of an index node
BLOCK_BYTES, BLOCK_TEXTS, BLOCK_RUNS = 1 << 20, 2000, 1 << 16
BATCH_ROWS = 1 << 16  # fingerprints whose groups are searched together
FRONTIER = 1 << 20  # (fingerprint, node) pairs that a search holds at once

Batches = Iterator[pd.DataFrame]


def _runs(text: str, width: int) -> Iterator[bytes]:
    """The runs of ``width`` words, space-joined; the whole sequence if there are fewer."""
    words = text.encode("utf-8", "replace").lower().split()
    if len(words) <= width:
        return iter([b" ".join(words)] if words else [])
    return map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))


def _set_bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def text_fingerprints(texts: list[str], width: int) -> np.ndarray:
    """64 bits per text: those that are set in over half of the hashes of its word runs."""
    import xxhash

    found = np.zeros(len(texts), dtype=np.uint64)
    for part in blocks(np.array([len(text) for text in texts]), BLOCK_BYTES, BLOCK_TEXTS):
        for at in range(part.start, part.stop):
            runs, total, seen = _runs(texts[at], width), np.zeros(BITS, dtype=np.int64), 0
            while True:
                hashes = np.fromiter((xxhash.xxh64_intdigest(run, SEED) for run in islice(runs, BLOCK_RUNS)), np.uint64)
                if not len(hashes):
                    break
                total += _set_bits(hashes).sum(axis=0, dtype=np.int64)
                seen += len(hashes)
            found[at] = np.packbits(2 * total > seen, bitorder="little").view(np.uint64)[0]
    return found


def fingerprints(docs: DataFrame, width: int = 3, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(row, doc_id, fingerprint as a long) of every row of ``docs``."""
    prints = F.pandas_udf(lambda column: pd.Series(text_fingerprints(column.tolist(), width).view(np.int64)), "long")
    return numbered(docs, F.col(id_column).alias("doc_id"), prints(whole_text(text)).alias("fingerprint"))


def gray_rank(code: Column) -> Column:
    """Place of a 64-bit code in the Gray sequence, as a long in the same order."""
    rank = code
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank.bitwiseXOR(F.lit(-(1 << (BITS - 1))))


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _thirds(mask: int, parts: int) -> list[int]:
    """``mask`` with one more part of the bits it leaves free, for each of ``parts`` even parts of them."""
    free = [bit for bit in range(BITS) if not mask >> bit & 1]
    return [mask | sum(1 << int(bit) for bit in part) for part in np.array_split(free, parts) if len(part)]


class GrayIndex:
    """A hierarchy over groups of fingerprints, each group in Gray order.

    The leaves are the fingerprints; a node stands for up to FANOUT following
    nodes of the level below. It keeps the bits that all below it share
    (mask, pattern), less those that its own parent keeps already.
    """

    def __init__(self, prints: np.ndarray, starts: np.ndarray):
        self.prints = prints
        sizes = np.diff(np.append(starts, len(prints)))
        self.group = np.repeat(np.arange(len(starts)), sizes)
        self.sizes = sizes
        every, none = prints.copy(), prints.copy()  # bits set in all, bits set in any
        counts, last = sizes, np.arange(len(prints))
        # by level, the leaves first: pattern, mask, last leaf, first child, children
        self.levels = [(prints, np.full(len(prints), ~np.uint64(0)), last, None, None)]
        while (counts > 1).any():
            group = np.repeat(np.arange(len(counts)), counts)
            within = np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)
            first = np.flatnonzero(within % FANOUT == 0)
            every, none = np.bitwise_and.reduceat(every, first), np.bitwise_or.reduceat(none, first)
            children = np.diff(np.append(first, len(group)))
            last = last[first + children - 1]
            counts = np.bincount(group[first], minlength=len(counts))
            mask = ~(every ^ none)
            self.levels.append((every & mask, mask, last, first, children))
        for level in range(len(self.levels) - 1):
            pattern, mask, last, first, children = self.levels[level]
            above = np.repeat(self.levels[level + 1][1], self.levels[level + 1][4])
            self.levels[level] = (pattern, mask & ~above, last, first, children)

    def pairs(self, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of the fingerprints of one group that differ in at most ``most`` bits, each pair once.

        Each fingerprint goes down from the root of its group; a node adds the
        differences in its own bits, and with more than ``most`` the whole group
        below it is left out.
        """
        for part in blocks(self.sizes[self.group], FRONTIER, len(self.prints)):
            query = np.arange(part.start, part.stop)
            node = self.group[query]
            differ = self._differences(query, node, len(self.levels) - 1)
            for level in range(len(self.levels) - 1, 0, -1):
                first, children = self.levels[level][3:]
                many = children[node]
                below = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[node], many)
                query, differ = np.repeat(query, many), np.repeat(differ, many)
                later = self.levels[level - 1][2][below] > query
                query, node, differ = query[later], below[later], differ[later]
                differ = differ + self._differences(query, node, level - 1)
                near = differ <= most
                query, node, differ = query[near], node[near], differ[near]
            later = node > query
            yield query[later], node[later]

    def _differences(self, query: np.ndarray, node: np.ndarray, level: int) -> np.ndarray:
        pattern, mask = self.levels[level][:2]
        return np.bitwise_count((self.prints[query] ^ pattern[node]) & mask[node]).astype(np.int64)


def _joined(root: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Lower ``root`` in place until linked places have the same one."""
    while len(left):
        one, two = root[left], root[right]
        apart = one != two
        left, right, one, two = left[apart], right[apart], one[apart], two[apart]
        np.minimum.at(root, np.maximum(one, two), np.minimum(one, two))
        while (root[root] != root).any():
            root[:] = root[root]


def _searcher(most: int) -> Callable[[Batches], Batches]:
    def search(rows: pd.DataFrame) -> pd.DataFrame:
        prints = rows["fingerprint"].to_numpy(np.int64).view(np.uint64)
        mask, pattern = rows["mask"].to_numpy(np.int64), rows["pattern"].to_numpy(np.int64)
        new = np.ones(len(rows), bool)
        new[1:] = (mask[1:] != mask[:-1]) | (pattern[1:] != pattern[:-1])
        index, root = GrayIndex(prints, np.flatnonzero(new)), np.arange(len(rows))
        for left, right in index.pairs(most):
            _joined(root, left, right)
        tied = np.flatnonzero(root != np.arange(len(root)))
        return pd.DataFrame({"u": prints[root[tied]].view(np.int64), "v": prints[tied].view(np.int64)})

    def searched(batches: Batches) -> Batches:
        held: list[pd.DataFrame] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) < BATCH_ROWS:
                continue
            rows = pd.concat(held, ignore_index=True)
            tail = rows.iloc[-1]
            open_group = ((rows["mask"] == tail["mask"]) & (rows["pattern"] == tail["pattern"])).to_numpy()
            held = [rows[open_group]]
            if not open_group.all():
                yield search(rows[~open_group].reset_index(drop=True))
        if held and len(rows := pd.concat(held, ignore_index=True)):
            yield search(rows)

    return searched


def near_edges(prints: DataFrame, most: int = 2, limit: int = 4096) -> DataFrame:
    """(u, v) that tie together all distinct ``fingerprint`` values with at most ``most`` different bits.

    Not all pairs: within a group of the index a spanning forest. The upper
    nodes of the index are the (mask, pattern) pairs of ``most`` + 1 masks, each
    a part of the bits: two near fingerprints agree in one of the parts. A node
    with more than ``limit`` fingerprints is parted again, by its mask and one
    more part of the bits it leaves free, and so on. After at most five times
    the free bits allow no more than ``limit`` values, so that no task gets a
    larger group, however alike the fingerprints are.
    """
    masks, edges = _thirds(0, most + 1), []
    rows = prints.select("fingerprint").distinct().select("fingerprint", F.explode(F.array(*map(F.lit, map(_signed, masks)))).alias("mask"))
    while True:
        rows = rows.withColumn("pattern", F.col("fingerprint").bitwiseAND(F.col("mask")))
        nodes = saved(rows.groupBy("mask", "pattern").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "gray-nodes")
        rows = rows.join(nodes, ["mask", "pattern"])
        free = BITS - min(mask.bit_count() for mask in masks)
        last = 1 << free <= limit or free <= most + 1
        ready = rows if last else rows.filter(F.col("size") <= limit)
        ready = ready.select("mask", "pattern", "fingerprint").repartition("mask", "pattern")
        ready = ready.sortWithinPartitions("mask", "pattern", gray_rank(F.col("fingerprint")))
        edges.append(saved(ready.mapInPandas(_searcher(most), "u long, v long"), "gray-edges"))
        if last or nodes.filter(F.col("size") > limit).isEmpty():
            break
        children = {mask: _thirds(mask, most + 1) for mask in masks}
        masks = [child for found in children.values() for child in found]
        pairs = [F.struct(F.lit(_signed(mask)).alias("a"), F.array(*(F.lit(_signed(x)) for x in found)).alias("b")) for mask, found in children.items()]
        below = F.map_from_entries(F.array(*pairs))[F.col("mask")]
        rows = saved(rows.filter(F.col("size") > limit).select("fingerprint", F.explode(below).alias("mask")), "gray-parts")
    both = edges[0]
    for more in edges[1:]:
        both = both.unionByName(more)
    return both


def simhash_groups(
    docs: DataFrame, width: int = 3, most: int = 2, text: str = "text", id_column: str = "doc_id", limit: int = 4096
) -> DataFrame:
    """Per row of ``docs``: row, doc_id, fingerprint (16 lower-case hex digits), component_id.

    Words are runs without blanks, A-Z in lower case; runs of ``width`` words
    are hashed with XXH64 (seed 42), repeats included. Rows are linked if their
    fingerprints differ in at most ``most`` bits; component_id is the smallest
    id that can be reached. NULL and empty texts and texts of blanks have
    fingerprint zero and are linked like any other; a text of fewer words counts
    as one run. Repeated rows are rows of their own, NULL ids are never the
    smallest (component_id is NULL where all are), an empty table gives no rows,
    and other columns are not read.
    """
    prints = saved(fingerprints(docs, width, text, id_column), "fingerprints")
    nodes = saved(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("low")), "fingerprint-nodes")
    found = components(near_edges(nodes, most, limit)).withColumnRenamed("node", "fingerprint")
    placed = nodes.join(found, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    placed = saved(placed, "fingerprint-components")
    lowest = placed.groupBy("component").agg(F.min("low").alias("component_id"))
    classes = placed.select("fingerprint", "component").join(lowest, "component").select("fingerprint", "component_id")
    return prints.join(classes, "fingerprint").select(
        ROW, "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )
