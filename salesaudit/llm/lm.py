"""Language-model scores: context-tree weighting over bytes, beside a smoothed word unigram model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesaudit.llm.grams import blocks, word_hashes
from salesaudit.llm.shared import ROW, numbered, saved, whole_text

DEPTH = 5  # bytes of the longest context
SHARED = 2  # bytes before, by which codes are dealt to tasks: a task has the whole tree below such a pair
GRAM, WORD, ASKED = 0, 1, 2  # byte grams and words learned from, byte grams of the other texts
CHUNK = 1 << 19  # codes that a task works on at once, but for one pair's
LN2 = 0.6931471805599453
LN_PI = 1.1447298858494002
END_WORD = 1  # stands for the end of a text among word hashes
BLOCK_BYTES, BLOCK_TEXTS = 1 << 21, 2000
HELD = 1 << 20  # different keys that a task holds before it passes their counts on
BINS = 8  # of counts, to a doubling

Batches = Iterator[pd.DataFrame]


def byte_grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, code) of each byte and the end of each text: the DEPTH bytes before it and itself.

    The first byte has zeros before it, the end is a zero.
    """
    gap = bytes(DEPTH)
    data = b"".join(gap + text + b"\0" for text in texts) + bytes(8)
    total = len(data) - 8 - DEPTH
    codes = np.empty(max(0, total), dtype=np.int64)
    for shift in range(min(8, len(codes))):
        part = np.frombuffer(data, dtype=">u8", offset=shift, count=(len(data) - shift) // 8)
        own = codes[shift::8]
        own[:] = (part[: len(own)] >> np.uint64(64 - 8 * (DEPTH + 1))).astype(np.int64)
    sizes = np.array([len(text) + 1 for text in texts], dtype=np.int64)
    # After each text but the last come the codes that end in the next one's zeros.
    owner = np.repeat(np.arange(len(texts)), sizes + DEPTH)[: len(codes)]
    begins = np.concatenate(([0], np.cumsum(sizes + DEPTH)))[:-1]
    inside = np.arange(len(codes)) - begins[owner] < sizes[owner]
    return owner[inside], codes[inside]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _text_words(text: str) -> np.ndarray:
    return np.concatenate((word_hashes(text).view(np.int64), [END_WORD]))


def _counted(batches: Batches) -> Batches:
    """(word, key, learned, asked): words and byte grams of the texts (text, learn), summed as far as memory allows."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {GRAM: [], WORD: [], ASKED: []}
    sizes = {GRAM: 0, WORD: 0, ASKED: 0}

    def passed(kind: int) -> pd.DataFrame:
        keys, counts = held[kind][0]
        held[kind], sizes[kind] = [], 0
        none = np.zeros(len(keys), dtype=np.int64)
        learned, asked = (none, counts) if kind == ASKED else (counts, none)
        return pd.DataFrame({"word": np.full(len(keys), kind == WORD), "key": keys, "learned": learned, "asked": asked})

    def merge(kind: int) -> None:
        held[kind] = [_summed(*(np.concatenate(x) for x in zip(*held[kind], strict=True)))]
        sizes[kind] = len(held[kind][0][0])

    for batch in batches:
        texts, learn = batch["text"].tolist(), batch["learn"].to_numpy(dtype=bool)
        data = [text.encode("utf-8", "replace") for text in texts]
        for part in blocks(np.array([len(x) for x in data]), BLOCK_BYTES, BLOCK_TEXTS):
            owner, codes = byte_grams(data[part])
            learned = learn[part][owner]
            words = [_text_words(text) for text, own in zip(texts[part], learn[part], strict=True) if own]
            keys = {GRAM: codes[learned], ASKED: codes[~learned], WORD: np.concatenate(words) if words else np.zeros(0, np.int64)}
            for kind, found in keys.items():
                if not len(found):
                    continue
                own = np.unique(found, return_counts=True)
                held[kind].append(own)
                sizes[kind] += len(own[0])
                if sizes[kind] > 2 * HELD:
                    merge(kind)
                    if sizes[kind] > HELD:
                        yield passed(kind)
    for kind, parts in held.items():
        if parts:
            merge(kind)
            yield passed(kind)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """ln gamma by Stirling's series after eight steps up."""
    y, steps = x + 8, np.ones_like(x)
    for i in range(8):
        steps *= x + i
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + series - np.log(steps)


def _kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return np.where(zeros + ones > 0, _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - LN_PI, 0.0)


def _mixed(zeros: np.ndarray, ones: np.ndarray, longer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ln of the weighted probability, weight of ending here) of nodes: P = (KT + product of P over one byte longer) / 2."""
    own = _kt(zeros, ones)
    weighted = np.logaddexp(own, longer) - LN2
    return weighted, np.exp(own - LN2 - weighted)


class CodeTrees:
    """The context trees below each pair of bytes, for all codes that follow those pairs.

    A byte is eight binary choices; the choices made before one are its node,
    and each node has a context tree of its own over the bytes before. Codes
    that were only asked for have nodes too, with no counts: their estimate is
    one half, as that of every context that was never seen.
    """

    def __init__(self, keys: np.ndarray, learned: np.ndarray):
        self.keys, self.learned = keys, learned.astype(float)
        self.orders = {}
        for depth in range(SHARED, DEPTH + 1):
            own = keys & ((1 << 8 * (depth + 1)) - 1)
            order = np.argsort(own, kind="stable")
            self.orders[depth] = order, own[order]

    def _numbers(self, depth: int, choice: int) -> np.ndarray:
        """The number of each code's node of that choice in its context of that depth."""
        order, own = self.orders[depth]
        own = own >> (8 - choice)
        new = np.ones(len(own), dtype=np.int64)
        new[1:] = own[1:] != own[:-1]
        numbers = np.empty(len(own), dtype=np.int64)
        numbers[order] = np.cumsum(new) - 1
        return numbers

    def place(self, choice: int) -> np.ndarray:
        """The byte before and the node of each code, as one number below 65536."""
        return (self.keys >> 8 & 0xFF) << 8 | 1 << choice | (self.keys & 0xFF) >> (8 - choice)

    def bits(self, choice: int) -> np.ndarray:
        return self.keys >> (7 - choice) & 1

    def levels(self, choice: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(depth, numbers by code; zeros, ones, ln of the weighted probability, weight of ending, by node), longest first."""
        ones_of = self.learned * self.bits(choice)
        numbers = longer = None
        for depth in range(DEPTH, SHARED - 1, -1):
            above = self._numbers(depth, choice)
            total = np.bincount(above, weights=self.learned)
            ones = np.bincount(above, weights=ones_of)
            if depth == DEPTH:
                weighted, stop = _kt(total - ones, ones), np.ones(len(total))
            else:
                parent = np.empty(len(longer), dtype=np.int64)
                parent[numbers] = above
                weighted, stop = _mixed(total - ones, ones, np.bincount(parent, weights=longer, minlength=len(total)))
            yield depth, above, total - ones, ones, weighted, stop
            numbers, longer = above, weighted

    def top(self) -> np.ndarray:
        """Rows zeros, ones and sums of ln weighted probabilities, for each place: what the shorter contexts need."""
        found = np.zeros((3, 1 << 16))
        for choice in range(8):
            for depth, numbers, zeros, ones, weighted, _ in self.levels(choice):
                if depth == SHARED:
                    place = np.empty(len(zeros), dtype=np.int64)
                    place[numbers] = self.place(choice)
                    for row, values in enumerate((zeros, ones, weighted)):
                        found[row] += np.bincount(place, weights=values, minlength=1 << 16)
        return found

    def logs(self, so_far: np.ndarray, left: np.ndarray) -> np.ndarray:
        """log10 of the probability of each code; so_far and left are what the shorter contexts gave, by place."""
        total = np.zeros(len(self.keys))
        for choice in range(8):
            place = self.place(choice)
            chance, rest = so_far[place], left[place]
            for _, numbers, zeros, ones, _, stop in reversed(list(self.levels(choice))):
                one = (ones + 0.5) / (zeros + ones + 1)
                chance = chance + rest * (stop * one)[numbers]
                rest = rest * (1 - stop)[numbers]
            total += np.log10(np.where(self.bits(choice) == 1, chance, 1 - chance))
        return total


def _pairs_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of some CHUNK rows that hold all rows of each of their pairs; the rows come sorted by pair."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= CHUNK:
            table = pa.Table.from_batches(held)
            pair = table["pair"].to_numpy()
            cut = int(np.searchsorted(pair, pair[-1]))
            if cut:
                yield table.slice(0, cut)
            held, rows = table.slice(cut).combine_chunks().to_batches(), table.num_rows - cut
    if rows:
        yield pa.Table.from_batches(held)


def _trees(table: pa.Table) -> CodeTrees:
    return CodeTrees(table["key"].to_numpy(), table["learned"].to_numpy())


def _by_pair(codes: DataFrame) -> DataFrame:
    pair = (F.shiftright("key", 8) % (1 << 8 * SHARED)).cast("int")
    return codes.withColumn("pair", pair).repartition("pair").sortWithinPartitions("pair")


def short_contexts(codes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(so_far, left) by place: what contexts of no and of one byte add to the chance of a one, and leave to longer ones.

    Each task works out the trees below its pairs; their sums for the 65,536
    places are what reaches the driver.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((3, 1 << 16))
        for table in _pairs_together(batches):
            found += _trees(table).top()
        place = np.flatnonzero(found[:2].any(axis=0))
        columns = [pa.array(place.astype(np.int32)), *(pa.array(row[place]) for row in found)]
        yield pa.RecordBatch.from_arrays(columns, ["place", "zeros", "ones", "longer"])

    rows = _by_pair(codes.filter("learned > 0")).mapInArrow(task, "place int, zeros double, ones double, longer double")
    sums = rows.groupBy("place").agg(*(F.sum(name).alias(name) for name in ("zeros", "ones", "longer"))).toArrow()
    zeros, ones, longer = (np.zeros(1 << 16) for _ in range(3))
    for name, values in (("zeros", zeros), ("ones", ones), ("longer", longer)):
        values[sums["place"].to_numpy()] = sums[name].to_numpy()
    weighted, stop = _mixed(zeros, ones, longer)
    all_zeros, all_ones, all_longer = (x.reshape(256, 256).sum(axis=0) for x in (zeros, ones, weighted))
    first_stop = _mixed(all_zeros, all_ones, all_longer)[1]
    so_far, left = first_stop * (all_ones + 0.5) / (all_zeros + all_ones + 1), 1 - first_stop
    so_far, left = np.tile(so_far, 256), np.tile(left, 256)
    return so_far + left * stop * (ones + 0.5) / (zeros + ones + 1), left * (1 - stop)


def code_logs(codes: DataFrame) -> DataFrame:
    """(key, n, log) of codes (key, learned, asked): how often they occur and log10 of their probability by the whole tree."""
    so_far, left = short_contexts(codes)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _pairs_together(batches):
            n = pc.add(table["learned"], table["asked"]).combine_chunks()
            columns = [table["key"].combine_chunks(), n, pa.array(_trees(table).logs(so_far, left))]
            yield from pa.Table.from_arrays(columns, ["key", "n", "log"]).to_batches()

    return _by_pair(codes).mapInArrow(task, "key long, n long, log double")


def _most_counted(counts: DataFrame, count: Column, most: int) -> DataFrame:
    """The rows with the highest counts, at most ``most``: all of a band of counts or none."""
    band = F.floor(F.log2(count) * BINS)
    sizes = counts.groupBy(band.alias("band")).count().orderBy(F.desc("band")).collect()
    total, least = 0, None
    for row in sizes:  # at most 64 * BINS bands
        total += row["count"]
        if total > most:
            break
        least = row["band"]
    return counts.filter(band >= least) if least is not None else counts.limit(0)


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether it is among the sorted keys, its value or 0) of each wanted key."""
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    there = keys[at] == wanted
    return there, np.where(there, values[at], 0.0)


def _held(logs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(key, log) in order of the keys."""
    found = logs.select("key", "log").toArrow()
    keys, values = found["key"].to_numpy(), found["log"].to_numpy()
    order = np.argsort(keys)
    return keys[order], values[order]


def _scorer(codes: DataFrame, head: DataFrame) -> Callable[[Column], Column]:
    held = (*_held(codes), *_held(head.select("key", F.log10(F.col("n") + 1.0).alias("log"))))
    shared = codes.sparkSession.sparkContext.broadcast(held)

    def scored(column: pd.Series) -> pd.DataFrame:
        known, known_logs, words, logs = shared.value
        texts = column.tolist()
        data = [text.encode("utf-8", "replace") for text in texts]
        rows = []
        for part in blocks(np.array([len(x) for x in data]), BLOCK_BYTES, BLOCK_TEXTS):
            owner, codes = byte_grams(data[part])
            found, back = np.unique(codes, return_inverse=True)
            there, values = _looked_up(known, known_logs, found)
            score = np.bincount(owner, weights=values[back], minlength=part.stop - part.start)
            # The other codes, once for each text with their number; owners come in order.
            other = ~there[back]
            own, code = owner[other], codes[other]
            order = np.lexsort((code, own))
            own, code = own[order], code[order]
            new = np.ones(len(own), bool)
            new[1:] = (own[1:] != own[:-1]) | (code[1:] != code[:-1])
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(own)))
            bounds = np.searchsorted(own[first], np.arange(part.stop - part.start + 1))
            for i, text in enumerate(texts[part]):
                tokens = _text_words(text)
                common, values = _looked_up(words, logs, tokens)
                mine = slice(bounds[i], bounds[i + 1])
                rest = np.sort(tokens[~common])
                rows.append((len(tokens), int(common.sum()), float(values.sum()), rest, score[i], code[first[mine]], times[mine]))
        return pd.DataFrame(rows, columns=["n_tokens", "n_head", "head_log", "rest", "head_score", "codes", "times"])

    fields = "rest array<long>, head_score double, codes array<long>, times array<long>"
    return F.pandas_udf(scored, f"n_tokens long, n_head long, head_log double, {fields}")


def language_model_scores(
    docs: DataFrame,
    learn: Column,
    text: str = "text",
    id_column: str = "doc_id",
    most_nodes: int = 1 << 19,
    head_words: int = 1 << 17,
) -> DataFrame:
    """Per row of ``docs``: row, doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    score is log10 of the probability that context-tree weighting gives to the
    UTF-8 bytes of the text and its end: for each binary choice of a byte the KT
    estimates of contexts of 0 to 5 bytes are mixed by their posterior weights.
    base_score is the add-one unigram model over words (runs without blanks, A-Z
    in lower case) and an end per text. Both learn from the rows where ``learn``
    holds, from every byte and word. NULL texts are empty: one token, the end.

    Each byte is eight binary choices with a context tree of their own. A node
    of a tree gives half its weight to its own KT estimate and half to the
    product of the nodes one byte longer; a context that was never seen says one
    half. score is the code length of that mixture for the given text.

    Counts are combined in the tasks and then by Spark. The different codes (a
    context of 5 bytes and the byte after it) are dealt to tasks by the two
    bytes before, so that a task has the whole trees below a pair; the two
    shortest contexts are 65,536 sums. A task that scores holds the
    ``most_nodes`` commonest codes and the ``head_words`` commonest words; rarer
    codes and words meet their logs and counts in a shuffle. So neither number
    changes a score.
    """
    texts = docs.select(whole_text(text).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    counts = texts.mapInPandas(_counted, "word boolean, key long, learned long, asked long").groupBy("word", "key")
    counts = saved(counts.agg(F.sum("learned").alias("learned"), F.sum("asked").alias("asked")), "counts")
    words = counts.filter("word").select("key", F.col("learned").alias("n"))
    code_log = saved(code_logs(counts.filter("NOT word").drop("word")), "code-logs")
    head = saved(_most_counted(words, F.col("n"), head_words), "head-words")
    total, different = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()

    score = _scorer(_most_counted(code_log, F.col("n"), most_nodes), head)
    rows = numbered(
        docs,
        F.col(id_column).alias("doc_id"),
        F.octet_length(whole_text(text)).alias("bytes"),
        score(whole_text(text)).alias("scored"),
    )
    scored = saved(rows.select(ROW, "doc_id", "bytes", "scored.*"), "scored")
    rest = scored.select(ROW, F.explode("rest").alias("key")).groupBy(ROW, "key").agg(F.count(F.lit(1)).alias("times"))
    rare = rest.join(words, "key").groupBy(ROW).agg(
        F.sum("times").alias("n_rare"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("rare_log")
    )
    other = scored.select(ROW, F.explode(F.arrays_zip("codes", "times")).alias("x")).select(ROW, F.col("x.codes").alias("key"), "x.times")
    other = other.join(code_log.select("key", "log"), "key").groupBy(ROW).agg(F.sum(F.col("times") * F.col("log")).alias("rest_score"))
    found = scored.drop("rest", "codes", "times").join(rare, ROW, "left").join(other, ROW, "left")
    found = found.withColumn("score", F.col("head_score") + F.coalesce("rest_score", F.lit(0.0)))
    logs = F.col("head_log") + F.coalesce("rare_log", F.lit(0.0))
    return found.select(
        ROW,
        "doc_id",
        "n_tokens",
        (F.col("n_head") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.log10(F.lit(float(total + different + 1)))).alias("base_score"),
        "score",
        (-F.col("score") * F.log2(F.lit(10.0)) / F.greatest("bytes", F.lit(1))).alias("bits_per_byte"),
    )
