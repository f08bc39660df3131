"""Benchmark passages in documents: the q-gram lemma as a filter, banded alignment as the proof."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesaudit.llm.grams import MULTIPLIERS, blocks
from salesaudit.llm.shared import KEYS, ROW, numbered, saved, text_keys, whole_text

Q = 8  # bytes of a q-gram, one 64-bit number
WINDOW = 60  # bytes of a passage that is looked for
BYTES_PER_EDIT = 15
# Passages start so close together that any run of WINDOW bytes is off the nearest one by no more bytes than its edits.
STRIDE = 2 * (WINDOW // BYTES_PER_EDIT)
SHORTEST = 24
BLOCK_WINDOWS = 1 << 16
BLOCK_BYTES, BLOCK_TEXTS = 1 << 20, 2000

WORD = re.compile(r"[^\W_]+")
Batches = Iterator[pd.DataFrame]


def plain(text: str) -> bytes:
    """Letters and digits in lower case, everything between them as one blank."""
    return " ".join(WORD.findall(text.lower())).encode("utf-8", "replace")


def edit_budget(length: int) -> int:
    return length // BYTES_PER_EDIT


def shared_at_least(length: int) -> int:
    """The q-gram lemma: q-grams left in common by as many edits as are allowed."""
    return length - Q + 1 - Q * edit_budget(length)


def q_grams(data: bytes) -> np.ndarray:
    """The q-gram at each place of ``data``, as a number."""
    count = len(data) - Q + 1
    grams = np.empty(max(0, count), dtype=np.uint64)
    for shift in range(min(Q, max(0, count))):
        part = np.frombuffer(data, dtype="<u8", offset=shift, count=(len(data) - shift) // 8)
        grams[shift::Q] = part[: len(grams[shift::Q])]
    return grams


def aligned(pattern: bytes, text: bytes, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the place in ``text`` nearest to ``pattern``, or None if over ``budget`` edits.

    Only cells on the diagonals ``low`` to ``high`` (place in the text less place
    in the pattern) are computed; an alignment may start and end anywhere there.
    """
    width = high - low + 1
    over = budget + 1
    row = [(0, low + k) if 0 <= low + k <= len(text) else (over, 0) for k in range(width)]
    for i, byte in enumerate(pattern, 1):
        new, before = [], (over, 0)
        for k in range(width):
            at = i + low + k
            if 0 <= at <= len(text):
                edits, start = row[k]
                best = (edits + (at == 0 or text[at - 1] != byte), start)
                if at == 0:
                    best = (over, 0)
                if k + 1 < width and row[k + 1][0] + 1 < best[0]:
                    best = (row[k + 1][0] + 1, row[k + 1][1])
                if before[0] + 1 < best[0]:
                    best = (before[0] + 1, before[1])
            else:
                best = (over, 0)
            new.append(best)
            before = best
        row = new
        if min(row)[0] > budget:
            return None
    edits, k = min((cell[0], k) for k, cell in enumerate(row))
    return (edits, row[k][1], len(pattern) + low + k) if edits <= budget else None


@dataclass
class Windows:
    """Passages to look for, indexed by their q-grams."""

    passages: list[bytes]
    item: np.ndarray

    def __post_init__(self) -> None:
        grams = [q_grams(passage) for passage in self.passages]
        sizes = [len(x) for x in grams]
        codes = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        window = np.repeat(np.arange(len(grams)), sizes)
        place = np.concatenate([np.arange(n) for n in sizes]) if sizes else np.zeros(0, np.int64)
        order = np.argsort(codes, kind="stable")
        self.window, self.place = window[order], place[order]
        self.codes, self.first, self.count = np.unique(codes[order], return_index=True, return_counts=True)
        self.bits = min(26, max(12, 4 + int(len(self.codes)).bit_length()))
        self.seen = np.zeros(1 << self.bits, dtype=bool)
        self.seen[self._slot(self.codes)] = True
        self.lengths = np.array([len(x) for x in self.passages], dtype=np.int64)
        self.budgets = np.array([edit_budget(n) for n in self.lengths.tolist()], dtype=np.int64)
        self.least = np.array([shared_at_least(n) for n in self.lengths.tolist()], dtype=np.int64)

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint64(MULTIPLIERS[0])) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _known(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Places of q-grams that some passage has, and their numbers, where enough of them lie close together."""
        grams = q_grams(data)
        places = np.flatnonzero(self.seen[self._slot(grams)])
        number = np.searchsorted(self.codes, grams[places])
        number[number == len(self.codes)] = 0
        right = self.codes[number] == grams[places]
        places, number = places[right], number[right]
        reach, least = int((self.lengths + self.budgets).max()), int(self.least.min())
        if least > 1:
            ends = np.searchsorted(places, places + reach, side="left")
            dense = ends - np.arange(len(places)) >= least
            cover = np.zeros(len(places) + 1, dtype=np.int64)
            np.add.at(cover, np.flatnonzero(dense), 1)
            np.add.at(cover, ends[dense], -1)
            near = np.cumsum(cover[:-1]) > 0
            places, number = places[near], number[near]
        return places, number

    def regions(self, data: bytes) -> Iterator[tuple[int, int, int]]:
        """(passage, first diagonal, last diagonal) of the bands that share as many q-grams as the lemma asks for.

        A band is twice as wide as the budget lets an alignment drift and the
        next one starts at its middle, so that an alignment lies whole in one.
        """
        places, number = self._known(data)
        if not len(places):
            return
        times = self.count[number]
        entry = np.repeat(self.first[number] - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(times.sum())
        window = self.window[entry]
        diagonal = np.repeat(places, times) - self.place[entry] + len(data)
        step = self.budgets[window] + 1
        band = diagonal // step
        keys = np.concatenate((window * (3 * len(data) + 3) + band, window * (3 * len(data) + 3) + band - 1))
        found, shared = np.unique(keys, return_counts=True)
        passage, band = found // (3 * len(data) + 3), found % (3 * len(data) + 3)
        enough = shared >= self.least[passage]
        for i, b in zip(passage[enough].tolist(), band[enough].tolist(), strict=True):
            wide = int(self.budgets[i]) + 1
            yield i, b * wide - len(data), (b + 2) * wide - 1 - len(data)

    def verified(self, data: bytes) -> Iterator[tuple[int, int, int, int]]:
        """(passage, edits, start, end) in ``data``."""
        for i, low, high in self.regions(data):
            start = max(0, low)
            stop = min(len(data), high + int(self.lengths[i]))
            same = data.find(self.passages[i], start, stop)
            if same >= 0:  # no edits, and the first place of those without
                yield i, 0, same, same + int(self.lengths[i])
                continue
            hit = aligned(self.passages[i], data[start:stop], low - start, high - start, int(self.budgets[i]))
            if hit:
                yield i, hit[0], start + hit[1], start + hit[2]


def _cutter(batches: Batches) -> Batches:
    for batch in batches:
        rows: list[tuple[int, int, bytes]] = []
        for row, text in zip(batch[ROW], batch["text"], strict=True):
            data = plain(text)
            if len(data) < SHORTEST:
                continue
            starts = [*range(0, max(1, len(data) - WINDOW), STRIDE), max(0, len(data) - WINDOW)]
            rows.extend((row, at, data[at : at + WINDOW]) for at in dict.fromkeys(starts))
        yield pd.DataFrame(rows, columns=["item_row", "at", "passage"])


def _finder(block: pd.DataFrame) -> Callable[[Column], Column]:
    built: list[Windows] = []  # once for all batches of a task

    def found(column: pd.Series) -> pd.Series:
        if not built:
            built.append(Windows([bytes(x) for x in block["passage"]], block["item_row"].to_numpy()))
        windows = built[0]
        gap = bytes(2 * WINDOW)
        texts = [plain(text) for text in column]
        rows: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        for own in blocks(np.array([len(text) for text in texts]), BLOCK_BYTES, BLOCK_TEXTS):
            begins = np.concatenate(([0], np.cumsum([len(text) + len(gap) for text in texts[own]])))
            for i, edits, low, high in windows.verified(gap.join(texts[own])):
                doc = int(np.searchsorted(begins, low, side="right")) - 1
                begin = int(begins[doc])
                rows[own.start + doc].append((int(windows.item[i]), edits, low - begin, high - begin))
        return pd.Series(rows)

    return F.pandas_udf(found, "array<struct<item_row: long, edits: long, start: long, end: long>>")


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    id_column: str = "doc_id",
    item_text: str = "text",
    item_id: str = "item_id",
) -> DataFrame:
    """(doc_id, text keys, item_id, passages, edits, start, end): the benchmark items of which a document holds a passage.

    Texts are compared in lower case by letters and digits, with one blank for
    whatever is between. A passage is a run of 60 bytes of an item, runs start
    every 8 bytes and at its end; a shorter item is one passage. It is found
    where it can be aligned with at most one edit per 15 bytes, so that every
    exact copy of 60 bytes of an item is found, wherever it starts. Items of
    under 24 bytes are not looked for. passages is how many were found, edits the
    fewest in one, start and end the part of the plain text they cover. Repeated
    rows with one id and text count as one.

    NULL texts are empty and hold nothing; an empty benchmark finds nothing.
    Passages go to the tasks in blocks of about 65,536, whatever the size of the
    benchmark; the documents are read once per block and are never shuffled.
    """
    spark = docs.sparkSession
    items = saved(numbered(benchmark, F.col(item_id).alias("item_id"), whole_text(item_text).alias("text")), "items")
    windows = saved(items.select(ROW, "text").mapInPandas(_cutter, "item_row long, at long, passage binary"), "windows")
    parts = -(-windows.count() // BLOCK_WINDOWS)
    kind = docs.schema[id_column].dataType.simpleString()
    found = spark.createDataFrame([], f"doc_id {kind}, __key1 long, __key2 long, item_row long, edits long, start long, end long")
    for part in range(parts):
        block = windows.filter(F.pmod(F.xxhash64("item_row", "at"), F.lit(parts)) == part).toPandas()
        if len(block):
            # Of a column by name, Spark would first ask whether it is empty, and search each text twice for that.
            search = F.inline(_finder(block)(whole_text(text)))
            found = found.unionByName(docs.select(F.col(id_column).alias("doc_id"), *text_keys(text), search))
    hits = found.groupBy("doc_id", *KEYS, "item_row").agg(
        F.count_distinct("start").alias("passages"), F.min("edits").alias("edits"), F.min("start").alias("start"), F.max("end").alias("end")
    )
    named = saved(hits, "leaks").join(items.select(F.col(ROW).alias("item_row"), "item_id"), "item_row")
    return named.select("doc_id", *KEYS, "item_id", "passages", "edits", "start", "end")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose text holds no passage of the benchmark, with all their columns."""
    found = leaks(docs, benchmark, text, id_column).select(KEYS).distinct()
    rows = docs.select(F.struct("*").alias("row"), *text_keys(text))
    return rows.join(found, KEYS, "left_anti").select("row.*")
