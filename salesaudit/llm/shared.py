"""What several operators need: written intermediate tables and row numbers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesaudit.sources.folders import new_folder

ROW = "__row"

# Rows of a batch that goes to Python: rows hold whole texts, so the default of 10,000 takes much memory.
BATCH_ROWS = 1000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"

_remembered: dict[str, Callable[[], None]] = {}


def remembers(owner: str, forget: Callable[[], None]) -> None:
    """Say that an operator keeps something in this Python worker, and how it is dropped."""
    _remembered[owner] = forget


def begins(owner: str) -> None:
    """Drop what other operators keep in this Python worker and give the memory back.

    Workers live on from one operator to the next, so an executor would go on
    holding it without use.
    """
    others = [name for name in _remembered if name != owner]
    for name in others:
        _remembered.pop(name)()
    if others:
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries keep freed memory, and have it
        if trim is not None:
            trim(0)


SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(frame: DataFrame, name: str, drop: bool = False) -> DataFrame:
    """``frame`` written to the shared folder and read back.

    Its lineage is cut, every executor reaches the files, and a lost executor
    costs only the tasks that were reading them. From here on the session sends
    at most ``BATCH_ROWS`` rows to Python at once. With ``drop``, what was
    shuffled for it is deleted as soon as it is written, not when the driver
    happens to collect its garbage.
    """
    settings = frame.sparkSession.conf
    if not 0 < int(settings.get(BATCH_SETTING)) <= BATCH_ROWS:
        settings.set(BATCH_SETTING, str(BATCH_ROWS))
    path = new_folder(frame.sparkSession, name)
    before = settings.get(SHUFFLES_GO, None)
    if drop:
        settings.set(SHUFFLES_GO, "true")
    try:
        frame.write.parquet(path)
    finally:
        if drop:
            settings.set(SHUFFLES_GO, before) if before else settings.unset(SHUFFLES_GO)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def numbered(docs: DataFrame, *columns: Column) -> DataFrame:
    """``columns`` of ``docs`` after a number of each row, unique but not gapless.

    Rows are told apart by it, so that repeated or NULL ids do no harm. It holds
    within one reading of ``docs``, once that is saved: another reading may deal
    the rows out in another way.
    """
    return docs.select(F.monotonically_increasing_id().alias(ROW), *columns)


def whole_text(name: str = "text") -> Column:
    """The text, NULL counting as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def text_keys(name: str = "text") -> list[Column]:
    """Two independent 64-bit hashes of the whole text: what joins one reading of a table with another."""
    return [F.xxhash64(whole_text(name)).alias("__key1"), F.xxhash64(F.lit("second"), whole_text(name)).alias("__key2")]


KEYS = ["__key1", "__key2"]


def one_of_each(docs: DataFrame, mark: Column, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose mark is in ``kept``, one row of each mark, with all their columns.

    Of rows with one mark, that with the lowest hash of its columns stays, so
    that another run chooses alike. Columns of any name are left as they are.
    """
    hashed = [F.col(f"`{field.name}`") for field in docs.schema if "map<" not in field.dataType.simpleString()]
    rows = docs.select(F.struct("*").alias("row"), mark.alias("mark"), F.xxhash64(F.lit(0), *hashed).alias("order"))
    rows = rows.join(kept.select("mark"), "mark", "left_semi")
    return rows.groupBy("mark").agg(F.min_by("row", "order").alias("row")).select("row.*")


def fold(name: str, remainder: int, modulus: int) -> Column:
    """Whether crc32(id as text) leaves ``remainder``; false for a NULL id."""
    crc = F.crc32(F.col(name).cast("string").cast("binary"))
    return F.coalesce(crc % modulus == remainder, F.lit(False))
