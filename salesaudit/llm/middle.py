"""Fill-in-the-middle documents over seekable compressed frames of text."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesaudit.llm.shared import ROW, numbered, saved, whole_text

FRAME = 1 << 15  # code points of a frame, the last may be shorter
LEVEL = 3  # of compression

# The marks of the parts and how many in a hundred documents are changed, and of those suffix first.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CHANGED, SUFFIX_FIRST = 90, 20

# start: code points before the frame; data: an independent zstandard frame of UTF-8.
FRAMES = "array<struct<start: long, units: long, data: binary>>"


class Frames:
    """Ordered frames of one text, read from any place: only frames that hold the wanted part are unpacked."""

    def __init__(self, frames: Sequence[dict]):
        import zstandard

        self.frames = frames
        self.unpack = zstandard.ZstdDecompressor().decompress
        self.held: tuple[int, str] = (-1, "")

    @property
    def units(self) -> int:
        return self.frames[-1]["start"] + self.frames[-1]["units"] if len(self.frames) else 0

    def _frame_at(self, place: int) -> int:
        low, high = 0, len(self.frames)
        while low < high:
            middle = (low + high) // 2
            if self.frames[middle]["start"] + self.frames[middle]["units"] <= place:
                low = middle + 1
            else:
                high = middle
        return low

    def text(self, number: int) -> str:
        if self.held[0] != number:
            self.held = number, self.unpack(self.frames[number]["data"]).decode("utf-8", "surrogatepass")
        return self.held[1]

    def parts(self, start: int, stop: int) -> Iterator[tuple[int, int, int]]:
        """(frame, first, past the last) of the frames from ``start`` to ``stop``, places within the frame."""
        number = self._frame_at(start)
        while number < len(self.frames) and self.frames[number]["start"] < stop:
            begin, units = self.frames[number]["start"], self.frames[number]["units"]
            yield number, max(0, start - begin), min(units, stop - begin)
            number += 1

    def read(self, start: int, stop: int) -> Iterator[str]:
        for number, first, last in self.parts(start, stop):
            yield self.text(number)[first:last]

    def find(self, mark: str, start: int) -> int:
        """First place of ``mark`` from ``start`` on, also where it goes over the end of a frame; -1 if none."""
        before, at = "", start
        for piece in self.read(start, self.units):
            place = (before + piece).find(mark)
            if place >= 0:
                return at - len(before) + place
            at += len(piece)
            before = (before + piece)[-(len(mark) - 1) :]
        return -1


class _Packer:
    """Frames in order, from texts and from packed frames that are taken over as they are."""

    def __init__(self):
        import zstandard

        self.pack = zstandard.ZstdCompressor(level=LEVEL).compress
        self.frames: list[dict] = []
        self.units = 0

    def packed(self, data: bytes, units: int) -> None:
        self.frames.append({"start": self.units, "units": units, "data": data})
        self.units += units

    def text(self, text: str) -> None:
        for at in range(0, len(text), FRAME):
            part = text[at : at + FRAME]
            self.packed(self.pack(part.encode("utf-8", "surrogatepass")), len(part))

    def part(self, source: Frames, start: int, stop: int) -> None:
        for number, first, last in source.parts(start, stop):
            frame = source.frames[number]
            if last - first == frame["units"]:
                self.packed(frame["data"], frame["units"])
            elif first < last:
                self.text(source.text(number)[first:last])


def _text_frames(texts: pd.Series) -> pd.Series:
    """The frames of each text; none of an empty one."""
    found = []
    for text in texts:
        packer = _Packer()
        packer.text(text)
        found.append(packer.frames)
    return pd.Series(found)


def _frames_text(frames: pd.Series) -> pd.Series:
    """The text that frames hold."""
    return pd.Series(["".join(x.text(i) for i in range(len(x.frames))) for x in map(Frames, frames)])


def _rearranged(frames: pd.Series, form: pd.Series, first: pd.Series, second: pd.Series) -> pd.Series:
    """Frames of the output, from those of the text, its form and its two cuts.

    Frames between the cuts are taken over packed; only those that a cut goes
    through are unpacked.
    """
    found = []
    for own, kind, one, two in zip(frames, form, first, second, strict=True):
        if kind == "plain":
            found.append(list(own))
            continue
        source, packer = Frames(own), _Packer()
        parts = {PREFIX: (0, one), MIDDLE: (one, two), SUFFIX: (two, source.units)}
        for mark in (PREFIX, SUFFIX, MIDDLE) if kind == "psm" else (SUFFIX, PREFIX, MIDDLE):
            packer.text(mark)
            packer.part(source, *parts[mark])
        found.append(packer.frames)
    return pd.Series(found)


def _original(output: Frames, form: str) -> Iterator[str]:
    """The text an output was made of, piece by piece, from the output and its form alone."""
    if form == "plain":
        yield from output.read(0, output.units)
        return
    order = (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE)
    places, at = [], 0
    for mark in order:  # the text has no mark, so the first of each is the one that was set
        at = output.find(mark, at)
        if at < 0:
            raise ValueError(f"the output has no {mark}")
        places.append(at)
    ends = [*places[1:], output.units]
    parts = {mark: (place + len(mark), end) for mark, place, end in zip(order, places, ends, strict=True)}
    for mark in (PREFIX, MIDDLE, SUFFIX):
        yield from output.read(*parts[mark])


def _digest(pieces: Iterator[str]) -> str:
    digest = hashlib.sha256()
    for piece in pieces:
        digest.update(piece.encode("utf-8", "surrogatepass"))
    return digest.hexdigest()


def _frame_digests(frames: pd.Series, form: pd.Series) -> pd.DataFrame:
    """sha256 of each output and of the text rebuilt from it, frames streamed in order."""
    rows = []
    for own, kind in zip(frames, form, strict=True):
        output = Frames(own)
        rows.append((_digest(output.read(0, output.units)), _digest(_original(output, kind))))
    return pd.DataFrame(rows, columns=["output_sha256", "restored_sha256"])


def _restored(frames: pd.Series, form: pd.Series) -> pd.Series:
    """The text that each output was made of."""
    return pd.Series(["".join(_original(Frames(own), kind)) for own, kind in zip(frames, form, strict=True)])


def _udf(work: Callable[..., pd.Series | pd.DataFrame], kind: str) -> Callable[..., Column]:
    return lambda *columns: F.pandas_udf(work, kind)(*columns)


text_frames = _udf(_text_frames, FRAMES)
frames_text = _udf(_frames_text, "string")
rearranged = _udf(_rearranged, FRAMES)
frame_digests = _udf(_frame_digests, "struct<output_sha256: string, restored_sha256: string>")
restored = _udf(_restored, "string")


def _draws(id_column: str) -> list[Column]:
    """Four whole numbers below 2**32 that the id alone decides."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def text_store(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: row, doc_id, n, form, cuts of its two places, and its frames. Nothing is shuffled."""
    whole, (one, two, change, order) = whole_text(text), _draws(id_column)
    n = F.char_length(whole).cast("long")
    marked = whole.contains(PREFIX) | whole.contains(SUFFIX) | whole.contains(MIDDLE)
    plain = (n == 0) | marked | (change % 100 >= CHANGED)
    form = F.when(plain, "plain").when(order % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    cuts = [one % (n + 1), two % (n + 1)]
    return numbered(
        docs,
        F.col(id_column).alias("doc_id"),
        n.alias("n"),
        form.alias("form"),
        F.least(*cuts).alias("first_cut"),
        F.greatest(*cuts).alias("second_cut"),
        text_frames(whole).alias("frames"),
    )


def fill_in_middle(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: row, doc_id, n, form, prefix_chars, middle_chars, frames of the output.

    The text, in code points, is cut at two places that the id decides. plain
    keeps it; psm is <P> prefix <S> suffix <M> middle; spm <S> suffix <P> prefix
    <M> middle. The text is saved as frames with the code points before each;
    the output takes whole frames over and cuts the others. ``frames_text`` and
    ``restored`` give the output and the text again.

    NULL and empty texts and those that hold a mark are plain, lengths NULL. A
    NULL id draws like an empty one. Repeated rows are rows of their own, an
    empty table gives no rows, and other columns are not read. A text of any
    length is unpacked frame by frame.
    """
    store = saved(text_store(docs, text, id_column), "text-frames")
    changed = F.col("form") != "plain"
    return store.select(
        ROW,
        "doc_id",
        "n",
        "form",
        F.when(changed, F.col("first_cut")).alias("prefix_chars"),
        F.when(changed, F.col("second_cut") - F.col("first_cut")).alias("middle_chars"),
        rearranged("frames", "form", "first_cut", "second_cut").alias("frames"),
    )
