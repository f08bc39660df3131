"""All stages of the pipeline against a plain version of each rule, over pairs of texts and single cells."""

from __future__ import annotations

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
from texts import documents
from tokenizers import Tokenizer

import corpus_pipeline
from salesaudit.llm import language, neardup, packing

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
SIZE = 2048


def _prose(rng: random.Random, words: int) -> list[str]:
    return ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 5))) for _ in range(words)]


def _shingles(text: str) -> set[tuple]:
    words = re.findall("[^ \t-\r]+", re.sub("[A-Z]", lambda x: x[0].lower(), text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _fewest_edits(pattern: bytes, text: bytes) -> int:
    """Edits from ``pattern`` to the nearest part of ``text``: every cell of the table."""
    letters, places = np.frombuffer(text, dtype=np.uint8), np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, dtype=np.int64)
    for i, byte in enumerate(pattern, 1):
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (letters != byte))
        new[0] = i
        row = np.minimum.accumulate(new - places) + places
    return int(row.min())


def _leaks(text: str, items: list) -> bool:
    plain = lambda x: " ".join(re.findall(r"[^\W_]+", (x or "").lower())).encode()
    for item in map(plain, items):
        starts = {*range(0, max(1, len(item) - 60), 8), max(0, len(item) - 60)}
        for passage in (item[at : at + 60] for at in sorted(starts)):
            if len(item) >= 24 and _fewest_edits(passage, plain(text)) <= len(passage) // 15:
                return True
    return False


def _plain_pipeline(rows: list, items: list) -> list:
    """The rows (id, text) that are packed."""
    rows = sorted({row for row in rows if any(c.isalpha() for c in row[1] or "")}, key=str)
    of_text = defaultdict(list)
    for doc, text in rows:
        of_text[text].append(doc)
    rows = [(max((x for x in ids if x is not None), default=None), text) for text, ids in of_text.items()]
    sets, root = [_shingles(text) for _, text in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) > 0:
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    groups = defaultdict(list)
    for row, number in zip(rows, root, strict=True):
        groups[number].append(row)
    rows = [min(group, key=lambda row: (row[0] is None, row[0])) if len(group) > 1 else group[0] for group in groups.values()]
    return [(doc, text) for doc, text in rows if not _leaks(text, items)]


def _tables(spark, folder, rows: list, items: list) -> str:
    documents(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def _changed(rng: random.Random, text: str, edits: int) -> str:
    for _ in range(edits):
        at = rng.randrange(len(text))
        text = text[:at] + rng.choice(["", "q", text[at] + "z"]) + text[at + rng.randrange(2) :]
    return text


def test_stages_match_a_plain_version(spark, tmp_path):
    rng = random.Random(40)
    items = [" ".join(_prose(rng, 25)) for _ in range(3)] + ["too short", None, " ".join(_prose(rng, 5))]
    texts = []
    for _ in range(14):  # families with changed words, near 0.8 and on both sides of it
        base = _prose(rng, rng.randrange(4, 90))
        for _ in range(5):
            words = list(base)
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(["Other", "x", "changed"])
            texts.append(" ".join(words))
    for i in range(40):  # parts of items with changes, in prose of its own
        item = items[i % 3]
        at, length = rng.randrange(len(item) // 2), rng.choice([45, 60, 70, 90])
        texts.append(f"{' '.join(_prose(rng, 20))}, {_changed(rng, item[at : at + length], rng.randrange(7))} {' '.join(_prose(rng, 20))}")
    texts += [items[5], "12 34", "", None, "é", "a", "word " * 6000 + "end", " ".join(_prose(rng, 4000))]
    rows = list(enumerate(texts))
    rows += [(1000 + i, rng.choice(texts)) for i in range(30)] + [(None, texts[3]), (None, "an id is missing here"), (7, texts[7]), (7, texts[7])]
    rng.shuffle(rows)
    kept = _plain_pipeline(rows, items)
    assert 40 < len(kept) < len(set(texts)) - 20

    found = corpus_pipeline.run(spark, _tables(spark, tmp_path, rows, items)).collect()
    wanted = []
    for doc, text in kept:
        ids = [*TOKENIZER.encode(text, add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), SIZE)):
            own = np.array(ids[start : start + SIZE], dtype="<u4")
            wanted.append((doc, piece, start, len(own), zlib.crc32(own.tobytes())))
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found]
    assert sorted(got, key=str) == sorted(wanted, key=str)
    places = defaultdict(list)
    for r in found:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in places.values():
        ends = np.cumsum([length for _, length in sorted(parts)])
        assert [at for at, _ in sorted(parts)] == [0, *ends[:-1].tolist()] and ends[-1] <= SIZE
    assert len(places) <= -(-sum(r["length"] for r in found) // SIZE) + 1


def test_empty_tables(spark, tmp_path):
    found = corpus_pipeline.run(spark, _tables(spark, tmp_path, [], []))
    assert found.count() == 0 and found.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_stages_keep_the_columns_of_their_input(spark, tmp_path):
    rng = random.Random(41)
    rows = [(i, " ".join(_prose(rng, 30))) for i in range(5)]
    folder = _tables(spark, tmp_path, rows, [])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, folder)
        assert kept.schema == docs.schema and sorted(kept.collect()) == sorted(docs.collect()), name


def test_a_worker_keeps_nothing_of_the_operator_before(spark):
    """The words that packing remembers go when near-dedup or language ID begins in the same process, and stay between its own tasks."""
    cut = packing._piecer(public_tokenizers.path("word_bpe_49k.json"), SIZE)
    texts = pd.Series(["one two", "three"])
    profiles = pd.DataFrame({"lang": ["en"], "rank": [0], "gram": [1]})
    for after in (neardup._sketcher(5), neardup._setter(5), language._predictor(profiles, 300)):
        before = cut(texts).tolist()
        cut(texts)
        assert packing.word_ids.cache_info()[:2] == (1, 1)
        after.func(texts)
        assert packing.word_ids.cache_info().currsize == 0
        assert cut(texts).tolist() == before
        packing.word_ids.cache_clear()
