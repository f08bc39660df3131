"""Fill-in-the-middle against plain slicing, and exact round trips over frame borders."""

from __future__ import annotations

import hashlib
import random

import pytest
from texts import documents

from salesaudit.llm import middle
from salesaudit.llm.middle import Frames, _Packer, fill_in_middle, frame_digests, frames_text, restored


def _plain(doc, text):
    text = text or ""
    n, digest = len(text), hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    prefix, body, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{body}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{body}"


def _rows():
    rng = random.Random(4)
    letters = "ab <>PSM\n😀é́漢"
    rows = [(i, "".join(rng.choices(letters, k=rng.choice([1, 2, 3, 40, 700])))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "a <P> b"), (203, "<S>"), (204, "<M>" * 3), (None, "no id here"), (7, rows[7][1]), (7, rows[7][1])]
    return rows + [(300 + i, "ab😀" * (middle.FRAME + i)) for i in range(3)] + [(310, "x" * 2_000_000)]


def test_matches_plain_slicing(spark):
    rows = _rows()
    made = fill_in_middle(documents(spark, rows))
    made = made.withColumns({"out": frames_text("frames"), "back": restored("frames", "form"), "digest": frame_digests("frames", "form")})
    found = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "out", "back", "digest.*").collect()
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    expected = []
    for doc, text in rows:
        own = _plain(doc, text)
        expected.append((doc, *own, text or "", sha(own[-1]), sha(text or "")))
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)
    assert {row[2] for row in found} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    found = fill_in_middle(documents(spark, [(1, "x")]).limit(0))
    assert found.count() == 0 and "frames" in found.columns


@pytest.mark.parametrize("size", [1, 2, 3, 5, 64])
def test_frames_of_any_size_give_the_same(monkeypatch, size):
    monkeypatch.setattr(middle, "FRAME", size)
    text = "pre<fix>é😀 and <S then P> more"
    packer = _Packer()
    packer.text(text)
    source = Frames(packer.frames)
    assert source.units == len(text) and [f["start"] for f in packer.frames] == list(range(0, len(text), size))
    for start in range(len(text) + 1):
        for stop in range(start, len(text) + 1):
            assert "".join(source.read(start, stop)) == text[start:stop]
    for mark in ("<fix>", "😀", "P>", "none", "<S"):
        assert source.find(mark, 0) == text.find(mark)
    for kind, a, b in (("psm", 0, 0), ("psm", 4, 9), ("spm", 3, len(text)), ("spm", 0, len(text)), ("psm", len(text), len(text))):
        (out,) = middle._rearranged([packer.frames], [kind], [a], [b])
        parts = {"psm": f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}", "spm": f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"}
        assert "".join(Frames(out).read(0, 10**6)) == parts[kind]
        assert "".join(middle._original(Frames(out), kind)) == text


def test_only_cut_frames_are_unpacked(monkeypatch):
    monkeypatch.setattr(middle, "FRAME", 10)
    packer = _Packer()
    packer.text("0123456789" * 50)
    unpacked, real = [], Frames.text
    monkeypatch.setattr(Frames, "text", lambda self, number: unpacked.append(number) or real(self, number))
    middle._rearranged([packer.frames], ["psm"], [123], [377])
    assert set(unpacked) == {12, 37}
