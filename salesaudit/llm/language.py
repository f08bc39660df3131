"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from salesaudit.llm.grams import LETTERS, blocks, letters
from salesaudit.llm.shared import begins, saved

UNDETERMINED = "und"
LONGEST = 3  # letters of an n-gram, at word ends one place is the blank
BLOCK_LETTERS, BLOCK_TEXTS = 1 << 19, 512
HELD_GRAMS = 1 << 18  # different n-grams that a task counts before it passes them on
BLANK = (1 << LETTERS) - 1

Batches = Iterator[pd.DataFrame]


def _gram_counts(texts: list[np.ndarray], groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, n-gram, count) of texts in letters, sorted by group and n-gram; groups are numbers under 512.

    n-grams have one to three places, a blank at an end only. While they are
    counted, a letter is its rank among the block's letters, from 1, so that a
    group and an n-gram fit into 64 bits.
    """
    codes = np.concatenate(texts)
    owner = np.repeat(groups.astype(np.int64), [len(text) for text in texts])
    alphabet = np.unique(codes)
    ranks = np.searchsorted(alphabet, codes) + 1
    width = int(len(alphabet)).bit_length()
    letter = codes != 0
    owner <<= LONGEST * width
    same = owner[1:] == owner[:-1]
    pair = (ranks[:-1] << width) | ranks[1:]
    triple = (pair[:-1] << width) | ranks[2:]
    keys = (
        (owner | ranks)[letter],
        (owner[1:] | pair)[same & (letter[1:] | letter[:-1])],
        (owner[2:] | triple)[same[1:] & same[:-1] & letter[1:-1]],
    )
    found, counts = np.unique(np.concatenate(keys), return_counts=True)
    places = np.concatenate(([0], np.where(alphabet == 0, BLANK, alphabet).astype(np.int64)))
    grams = np.zeros(len(found), dtype=np.int64)
    for i in range(LONGEST):
        grams |= places[(found >> i * width) & ((1 << width) - 1)] << i * LETTERS
    return found >> LONGEST * width, grams, counts


def _learner() -> Callable[[Batches], Batches]:
    def counted(batches: Batches) -> Batches:
        names: dict[str, int] = {}
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def folded() -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            frame = pd.DataFrame(dict(zip(("group", "gram", "n"), map(np.concatenate, zip(*held, strict=True)), strict=True)))
            total = frame.groupby(["group", "gram"], sort=False)["n"].sum().reset_index()
            return [(total["group"].to_numpy(), total["gram"].to_numpy(), total["n"].to_numpy())]

        def rows() -> pd.DataFrame:
            labels = np.array(list(names), dtype=object)
            group, gram, n = held[0]
            return pd.DataFrame({"lang": labels[group], "gram": gram, "n": n})

        begins("language ID")
        for batch in batches:
            texts = batch["text"].tolist()
            numbers = np.array([names.setdefault(lang, len(names)) for lang in batch["lang"]])
            for part in blocks(np.array([len(text) for text in texts]), BLOCK_LETTERS, BLOCK_TEXTS):
                own, local = np.unique(numbers[part], return_inverse=True)
                group, gram, n = _gram_counts([letters(text) for text in texts[part]], local)
                held.append((own[group], gram, n))
                size += len(gram)
                if size > 4 * HELD_GRAMS:
                    held = folded()
                    size = len(held[0][0])
                    if size > HELD_GRAMS:
                        yield rows()
                        held, size = [], 0
        if held:
            held = folded()
            yield rows()

    return counted


def language_profiles(docs: DataFrame, text: str = "text", lang: str = "lang", length: int = 300) -> DataFrame:
    """The ``length`` most frequent n-grams of each language: (lang, rank, gram).

    Counts cover all texts with a language. Equal counts are ranked by the
    n-gram, so the profile is the same on every run.
    """
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    rows = rows.filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.mapInPandas(_learner(), "lang string, gram long, n long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = W.partitionBy("lang").orderBy(F.desc("n"), "gram")
    ranked = counts.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < length)
    return ranked.select("lang", "rank", "gram")


def _predictor(profiles: pd.DataFrame, length: int) -> Callable[[Column], Column]:
    langs = sorted(profiles["lang"].unique())
    known = np.unique(profiles["gram"].to_numpy(dtype=np.int64))
    table = np.full((len(known) + 1, len(langs)), -1, dtype=np.int64)
    for i, lang in enumerate(langs):
        own = profiles[profiles["lang"] == lang]
        table[np.searchsorted(known, own["gram"].to_numpy(dtype=np.int64)), i] = own["rank"]

    def scored(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        count = len(texts)
        group, gram, n = _gram_counts(texts, np.arange(count))
        order = np.lexsort((gram, -n, group))
        group, gram = group[order], gram[order]
        starts = np.searchsorted(group, np.arange(count))
        rank = np.arange(len(group)) - starts[group]
        top = rank < length
        group, gram, rank = group[top], gram[top], rank[top]
        place = np.searchsorted(known, gram)
        place[(place == len(known)) | (known[np.minimum(place, len(known) - 1)] != gram)] = len(known)
        distances = np.empty((count, len(langs)))
        for i in range(len(langs)):
            there = table[place, i]
            apart = np.where(there < 0, length, np.abs(there - rank))
            distances[:, i] = np.bincount(group, weights=apart, minlength=count)
        return distances.argmin(axis=1), 1 - distances.min(axis=1) / (length * np.bincount(group, minlength=count).clip(1))

    def predicted(column: pd.Series) -> pd.DataFrame:
        begins("language ID")
        names, scores = np.full(len(column), UNDETERMINED, dtype=object), np.zeros(len(column))
        given = column.fillna("").tolist()
        for part in blocks(np.array([len(text) for text in given]), BLOCK_LETTERS, BLOCK_TEXTS):
            texts = [letters(text) for text in given[part]]
            some = [i for i, text in enumerate(texts) if len(text) > 1 and langs]
            if some:
                best, score = scored([texts[i] for i in some])
                at = np.array(some) + part.start
                names[at], scores[at] = np.array(langs, dtype=object)[best], score
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return F.pandas_udf(predicted, "lang_pred string, score double")


def language_predictor(
    docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", length: int = 300, most_languages: int = 4096
) -> Callable[[Column], Column]:
    """A function of a text column that gives (lang_pred, score), learned from ``docs`` where ``learn`` holds.

    Only the profiles reach the driver: ``length`` n-grams for each of at most
    ``most_languages`` languages.
    """
    profiles = saved(language_profiles(docs.filter(learn), text, lang, length), "profiles")
    languages = profiles.select("lang").distinct().limit(most_languages + 1).count()
    if languages > most_languages:
        raise ValueError(f"more than {most_languages} languages in {lang!r}")
    return _predictor(profiles.toPandas(), length)


def identify(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", id_column: str = "doc_id", length: int = 300) -> DataFrame:
    """The language of each row: doc_id, lang_pred, score.

    A text's most frequent n-grams are ranked and compared with each language's
    profile by the sum of their displacements; an n-gram that a profile lacks
    counts ``length``. The nearest language is taken, the first by name of
    equally near ones. score is 1 for equal rankings, 0 if no n-gram is shared.

    Profiles are learned from the rows where ``learn`` holds and the language is
    not NULL. A text that is NULL or has no letter is ``und``, and so is every
    text when nothing could be learned. Other columns are not read.
    """
    predict = language_predictor(docs, learn, text, lang, length)
    return docs.select(F.col(id_column).alias("doc_id"), predict(F.col(text).cast("string")).alias("told")).select("doc_id", "told.*")


def keep_identified(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose language could be told, with all their columns."""
    predict = language_predictor(docs, learn, text, lang)
    told = docs.select(F.struct("*").alias("row"), predict(F.col(text).cast("string")).alias("told"))
    return told.filter(F.col("told.lang_pred") != UNDETERMINED).select("row.*")
