"""Exact dedup by an extendible-hash index kept in shared files. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from salesaudit.llm.shared import ROW, numbered, one_of_each, saved, whole_text

# Directory bits that are looked at on either side of those an even filling needs.
SPARE_BITS = 3
CAPACITY = 128  # keys of a bucket
KEY_BITS = 62


def _key(text: Column, bits: int) -> Column:
    """The first ``bits`` bits of a 64-bit hash, as a number from 0."""
    return F.shiftrightunsigned(F.xxhash64(text), 64 - bits)


def directory(keys: DataFrame, capacity: int, bits: int) -> DataFrame:
    """Which bucket holds which cell of keys: (cell, bits of a cell, depth, bucket).

    One more bit doubles the directory. A bucket is split on its next bit while
    it holds over ``capacity`` keys, so each has the least depth at which it
    fits. Counts are per cell; a cell is a bucket of the deepest directory. A
    bucket over the capacity at that depth keeps its keys as overflow.
    """
    even = max(0, (keys.count() // capacity).bit_length())
    deepest = min(bits, even + SPARE_BITS)
    first = min(max(0, even - SPARE_BITS), deepest)
    cells = keys.groupBy(F.shiftright("key", bits - deepest).alias("cell")).agg(F.count(F.lit(1)).alias("keys"))
    depths = F.explode(F.sequence(F.lit(first), F.lit(deepest))).alias("depth")
    levels = cells.select("cell", "keys", depths)
    levels = levels.withColumn("bucket", F.expr(f"shiftright(cell, {deepest} - depth)"))
    filled = levels.groupBy("depth", "bucket").agg(
        F.sum("keys").alias("keys"), F.collect_list("cell").alias("cells")
    )
    fits = filled.filter((F.col("keys") <= capacity) | (F.col("depth") == deepest))
    least = F.min(F.struct("depth", "bucket")).alias("least")
    cells = fits.select("depth", "bucket", F.explode("cells").alias("cell")).groupBy("cell").agg(least)
    return cells.select("cell", F.lit(bits - deepest).alias("low_bits"), "least.depth", "least.bucket")


def _keyed(docs: DataFrame, text: str, id_column: str, bits: int) -> DataFrame:
    """(row, doc_id, key, text_sha256) of each row."""
    rows = numbered(docs, F.col(id_column).alias("doc_id"), whole_text(text).alias("text"))
    return rows.select(ROW, "doc_id", _key(F.col("text"), bits).alias("key"), F.sha2("text", 256).alias("text_sha256"))


def _placed(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """``rows`` with the depth and the bucket in which the directory puts their key."""
    low_bits = cells.select("low_bits").first()
    cell = F.shiftright("key", low_bits[0] if low_bits else 0)
    return rows.withColumn("cell", cell).join(cells.drop("low_bits"), "cell").drop("cell")


def _chains(docs: DataFrame, cells: DataFrame, text: str, bits: int) -> DataFrame:
    """(bucket, depth, key, chain, links, text): the different texts of each key, one row per link.

    All rows of a bucket, a range of keys, go to its owner task. A bucket takes a
    text up unless it holds the same bytes under that key already, first within
    the tasks that read ``docs``, so that a hot text travels once per task. Texts
    of one key then follow each other in its chain; links is its length.
    """
    rows = docs.select(whole_text(text).alias("text"))
    rows = _placed(rows.withColumn("key", _key(F.col("text"), bits)), cells)
    buckets = rows.groupBy("depth", "bucket").agg(F.collect_set(F.struct("key", "text")).alias("entries"))
    entries = buckets.select("depth", "bucket", F.inline("entries"))
    of_key = W.partitionBy("depth", "bucket", "key")
    chain = F.row_number().over(of_key.orderBy("text")).cast("long").alias("chain")
    links = F.count(F.lit(1)).over(of_key).alias("links")
    return entries.select("bucket", "depth", "key", chain, links, "text")


def _stays() -> tuple[Column, Column]:
    return F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", (-F.col(ROW)).alias("row"))).alias("stays")


def _walked(docs: DataFrame, links: DataFrame, text: str, id_column: str, bits: int) -> DataFrame:
    """Rows whose key has several texts, with the link of its chain that has their bytes.

    The table is read again for them; their row numbers are below zero, apart
    from those of the first reading.
    """
    rows = numbered(docs, F.col(id_column).alias("doc_id"), whole_text(text).alias("text"))
    rows = rows.select((-F.col(ROW) - 1).alias(ROW), "doc_id", "text", _key(F.col("text"), bits).alias("key"))
    return rows.join(links.select("bucket", "key", "chain", "text"), ["key", "text"]).drop("text")


def _indexed(docs: DataFrame, text: str, id_column: str, capacity: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """The index and the rows (row, doc_id, bucket, key, chain) that it placed, both saved."""
    slim = saved(_keyed(docs, text, id_column, bits), "keyed")
    cells = saved(directory(slim.select("key").distinct(), capacity, bits), "directory")
    chains = _chains(docs, cells, text, bits)
    # The bytes of a text stay in the index only where a look-up needs them, to tell the links of a chain apart.
    needed = F.when(F.col("links") > 1, F.col("text")).alias("text")
    chains = chains.select("bucket", "depth", "key", "chain", "links", F.sha2("text", 256).alias("text_sha256"), F.octet_length("text").alias("bytes"), needed)
    index = saved(chains, "buckets")
    # Every text of the table was compared with its chain. So a key with one link is that link's text.
    single = index.filter("links = 1")
    rows = _placed(slim.drop("text_sha256"), cells).join(single.select("bucket", "key", "chain"), ["bucket", "key"])
    rows = rows.select(ROW, "doc_id", "bucket", "key", "chain")
    several = index.filter("links > 1")
    if not several.isEmpty():
        rows = rows.unionByName(_walked(docs, several, text, id_column, bits))
    rows = saved(rows, "placed")
    groups = rows.groupBy("bucket", "key", "chain").agg(*_stays())
    index = index.join(groups, ["bucket", "key", "chain"]).select(
        "bucket",
        "depth",
        "key",
        "chain",
        "text_sha256",
        "bytes",
        "group_size",
        F.col("stays.doc_id").alias("keep_id"),
        (-F.col("stays.row")).alias("keep_row"),
    )
    return saved(index, "text-index"), rows


def text_index(
    docs: DataFrame, text: str = "text", id_column: str = "doc_id", capacity: int = CAPACITY, bits: int = KEY_BITS
) -> DataFrame:
    """The index of ``docs``, written to the shared folder: one row per different text.

    bucket and depth say where the directory puts it, key is its hash of
    ``bits`` bits, chain its place among texts of the same key. keep_id is the
    largest id of the equal texts, group_size their number. A NULL text is
    empty. An empty table gives an empty index.
    """
    return _indexed(docs, text, id_column, capacity, bits)[0]


def exact_groups(
    docs: DataFrame, text: str = "text", id_column: str = "doc_id", capacity: int = CAPACITY, bits: int = KEY_BITS
) -> DataFrame:
    """One row per row of ``docs``: its number, id, the row that stays, size of its group, SHA-256.

    Of equal texts the row with the largest id stays. Of repeated rows with that
    id the first one stays; a NULL id stays only if all are NULL. Other columns
    are not read. Copies are never expanded into pairs.

    The answer is read from the index: a row looks up its key in the bucket
    that the directory names, and takes the link of the chain that holds its
    bytes. What is equal was decided there by the bytes of the texts alone.
    """
    index, rows = _indexed(docs, text, id_column, capacity, bits)
    found = rows.join(index, ["bucket", "key", "chain"])
    return found.select(
        ROW, "doc_id", "keep_id", "group_size", (F.col(ROW) == F.col("keep_row")).alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names; of repeated rows with one id and text, one.

    They are found again by id and text, so that it does not matter how another
    reading of ``docs`` deals out its rows.
    """
    kept = exact_groups(docs, text, id_column).filter("kept")
    kept = kept.select(F.concat_ws("/", "text_sha256", F.col("doc_id").cast("string")).alias("mark"))
    mark = F.concat_ws("/", F.sha2(whole_text(text), 256), F.col(id_column).cast("string"))
    return one_of_each(docs, mark, kept)
