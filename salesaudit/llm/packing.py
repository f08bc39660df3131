"""Packing of tokenised documents into sequences by the sum-of-squares rule."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesaudit.llm.grams import blocks
from salesaudit.llm.shared import ROW, begins, numbered, remembers, saved, whole_text

END_OF_DOCUMENT = 0
HELD_WORDS = 300_000  # words of a generation; a worker remembers the ids of two generations
LEARNED_WORDS = 64  # that go to the tokenizer as one text
BLOCK_LETTERS, BLOCK_TEXTS = 1 << 20, 1000
WORD_END = "</w>"
NEVER = np.iinfo(np.int64).max

# Visible ASCII and composed Latin letters, which normalising leaves as they are, and the vocabulary's
# own pattern of the pieces of a word.
PLAIN = r"[!-~À-ÖØ-öø-ɏ]+"
LETTERS_AND_MARK = r"(?m)^([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-/:-@\[-`{-~]?)$"
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


class WordIds:
    """The ids of whole texts, with those of words that came before remembered.

    The tokenizer drops white space and works on each run between it alone, so
    the ids of a text are those of its runs between plain blanks and line ends,
    in order. It cuts a run into pieces, letters, digits or marks, and works on
    each of them alone. New pieces of plain runs go to a copy of it that neither
    normalises nor cuts; the last token of each has the mark of a word's end.
    Other runs go to the tokenizer itself.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer, self.bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), as_bytes])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[number for token, number in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.plain, self.pieces = regex.compile(PLAIN).fullmatch, regex.compile(PIECES).findall
        self.simple = re.compile(LETTERS_AND_MARK).findall
        self.held: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, pieces: list[str]) -> None:
        groups = [" ".join(pieces[at : at + LEARNED_WORDS]) for at in range(0, len(pieces), LEARNED_WORDS)]
        found = self.bare.encode_batch_fast(groups, add_special_tokens=False)
        ids = np.array([number for group in found for number in group.ids], dtype="<u4")
        data, start = ids.tobytes(), 0
        for piece, last in zip(pieces, np.flatnonzero(self.ends[ids]).tolist(), strict=True):
            self.held[piece] = data[start : 4 * last + 4]
            start = 4 * last + 4

    def _learn_words(self, new: set[str]) -> None:
        held, older = self.held, self.older
        for word in new & older.keys():
            held[word] = older[word]
        new = new.difference(held)
        # Most words are letters and at most one mark after them: one search cuts all of these.
        simple = self.simple("\n".join(new))
        parts = {letters + mark: (letters, mark) for letters, mark in simple if mark}
        whole, other = {letters for letters, _ in simple}.union({mark for _, mark in simple if mark}), []
        for word in new.difference(whole, parts):
            if (word.isascii() and word.isprintable()) or self.plain(word):
                parts[word] = self.pieces(word)
                whole.update(parts[word])
            else:
                other.append(word)
        self._learn([*whole.difference(held)])
        for word, own in parts.items():
            held[word] = b"".join(map(held.__getitem__, own))
        for word in other:
            held[word] = self._ids(word)

    def of(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        # The vocabulary has no capitals; letters whose small form depends on their place stay as they are.
        plain = [not ("<|" in text or "İ" in text or "Σ" in text) for text in texts]
        runs = [text.lower().replace("\n", " ").split(" ") if easy else [] for text, easy in zip(texts, plain, strict=True)]
        if len(self.held) > HELD_WORDS:
            self.older, self.held = self.held, {"": b""}
        if new := set().union(*runs).difference(self.held):
            self._learn_words(new)
        held = self.held
        for text, words, easy in zip(texts, runs, plain, strict=True):
            yield b"".join(map(held.__getitem__, words)) if easy else self._ids(text)


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One per Python worker, so that later tasks of the worker find its words, until another operator begins there."""
    return WordIds(path)


def _piecer(path: str, size: int) -> Callable[[pd.Series], pd.Series]:
    end = np.array([END_OF_DOCUMENT], dtype="<u4").tobytes()

    def cut(column: pd.Series) -> pd.Series:
        begins("packing")
        remembers("packing", word_ids.cache_clear)
        ids = word_ids(path)
        texts = column.tolist()
        found = []
        for part in blocks(np.array([len(text) for text in texts]), BLOCK_LETTERS, BLOCK_TEXTS):
            for data in ids.of(texts[part]):
                data += end
                own = [data[at : at + 4 * size] for at in range(0, len(data), 4 * size)]
                found.append([(i, i * size, len(x) // 4, zlib.crc32(x)) for i, x in enumerate(own)])
        return pd.Series(found)

    return cut


def pieces(docs: DataFrame, tokenizer: str, size: int = 2048, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The pieces of each document: its ids and an end mark, cut only where longer than ``size``.

    ``tokenizer`` is the path of the vocabulary file on every executor. A NULL
    text is empty: the end mark alone. Other columns are not read.
    """
    fields = "array<struct<piece: int, start: long, length: long, ids_crc32: long>>"
    cut = F.pandas_udf(_piecer(tokenizer, size), fields)
    rows = numbered(docs, F.col(id_column).alias("doc_id"), cut(whole_text(text)).alias("cut"))
    return rows.select(ROW, "doc_id", F.inline("cut"))


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item, placed in the given order; bins have ``size`` places.

    An item goes where the sum over all gaps of the squared number of open bins
    with that gap becomes smallest, into a new bin or one whose gap is large
    enough; of equal places into the one with the smallest gap left. A full bin
    is not open any more.
    """
    open_bins: list[list[int]] = [[] for _ in range(size + 1)]
    counts = np.zeros(size + 1, dtype=np.int64)  # of open bins, by gap
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, length in enumerate(lengths.tolist()):
        left = size - length
        # A bin of gap g + length becomes one of gap g: its square goes down by 2 N - 1, that of g up by 2 N + 1.
        costs = 2 * (counts[: left + 1] - counts[length:]) + 2
        costs[0] = 1 - 2 * counts[length]  # a full bin is not counted
        costs[counts[length:] == 0] = NEVER
        gap = int(costs.argmin())
        fresh = 2 * counts[left] + 1 if left else 0
        if fresh < costs[gap]:
            gap, place, offset = left, made, 0
            made += 1
        else:
            place, offset = open_bins[gap + length].pop(), size - gap - length
            counts[gap + length] -= 1
        if gap:
            open_bins[gap].append(place)
            counts[gap] += 1
        bins[i], offsets[i] = place, offset
    return bins, offsets


def _packer(size: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def packed(shard: pd.DataFrame) -> pd.DataFrame:
        # Long pieces first; the short ones then fill what is left in mixed order.
        falling = np.where(shard["length"] * 8 > size, -shard["length"], 0)
        order = np.lexsort((shard["order"], falling))
        shard = shard.iloc[order]
        bins, offsets = sum_of_squares(shard["length"].to_numpy(), size)
        return shard.drop(columns=["shard", "order"]).assign(sequence_id=shard["shard"] * 2**32 + bins, offset=offsets)

    return packed


def pack(
    docs: DataFrame,
    tokenizer: str,
    size: int = 2048,
    text: str = "text",
    id_column: str = "doc_id",
    shard_pieces: int = 32_768,
) -> DataFrame:
    """Where each piece of each document goes: its row, id, piece, start, length, crc32 of its ids, sequence_id, offset.

    Pieces are dealt by hash into shards of about ``shard_pieces``, each packed
    by one task; a shard leaves about one sequence that more pieces could have
    filled. Repeated rows are documents of their own. An empty table gives no
    pieces.
    """
    cut = saved(pieces(docs, tokenizer, size, text, id_column), "pieces")
    shards = max(1, -(-cut.count() // shard_pieces))
    mixed = F.xxhash64(ROW, "piece")
    dealt = cut.withColumn("order", mixed).withColumn("shard", F.pmod(mixed, F.lit(shards)))
    kind, dealt = dealt.schema["doc_id"].dataType, dealt.withColumn("doc_id", F.col("doc_id").cast("string"))
    schema = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in dealt.drop("order", "shard").schema)
    packed = dealt.groupBy("shard").applyInPandas(_packer(size), f"{schema}, sequence_id long, offset long")
    return packed.withColumn("doc_id", F.col("doc_id").cast(kind))
