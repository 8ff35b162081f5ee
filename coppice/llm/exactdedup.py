"""Exact copies by an extendible-hash index in shared files.

Every row becomes an entry, its key taken from the sha256 of its text; the texts
themselves stay where they are.  The keys go into an extendible-hash index: a directory of
slots, one for each value of a key's leading bits, points at buckets; while a bucket is
overfull it is split by its next bit, and the directory doubles where the bucket had no
bit to spare.  The index is written bucket by bucket to shared files, each owner task a
range of keys, with an entry for each key: how many rows it has and which one stays.

Equal keys aren't taken for equal texts.  Texts of all keys that have several rows are
read again, brought together by (key, text) and so compared byte by byte: copies within a
task fall together before anything is sent.  A key with more than one text is a collision;
its texts form a chain, and its rows are told apart by their bytes.

Which texts are read again is decided in the scan, by a bitmap over the leading bits of
repeated keys: 2 MB at any size.  It lets some others pass, which changes nothing but the
bytes sent.  A key that holds a large part of the rows is an entry like any other: counts
combine in each task, and its rows get what is known of it by a broadcast (``hotjoin``).

DataFrame functions only.  On the driver: the number of keys in each of 65 536 cells.

Defined results: a null text is the empty one; of equal texts the row with the largest id
stays, null ids below all others, and of rows that share that id too one; every other row
of the group is dropped, repeated rows and rows without an id too; an empty table gives no
rows; ids of any type that Spark can order; all columns to keep travel in a struct, so
their names can't clash; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.llm.hotjoin import joined_back
from coppice.llm.storage import discard, stored, working_tables

#: Bits of a key; of a directory at its largest; of the cells of the bitmap.
KEY_BITS, DIRECTORY_BITS, BITMAP_BITS = 60, 16, 24
#: Entries of a bucket over which it is split.
CAPACITY = 1 << 20
#: Bits of one bitmap, as Spark's functions have it.
_ONE_BITMAP = 32768


def key_of(sha: Column) -> Column:
    """The first 60 bits of a sha256 in hex, as a whole number."""
    return F.conv(F.substring(sha, 1, KEY_BITS // 4), 16, 10).cast("long")


def leading(key: Column, bits: int) -> Column:
    return F.shiftright(key, KEY_BITS - bits)


def directory(cells: dict[int, int], capacity: int = CAPACITY, bits: int = DIRECTORY_BITS) -> tuple[int, list[int]]:
    """(depth, bucket of each of the 2^depth slots), from how many entries each cell of ``bits`` leading bits has.

    Begins with one bucket.  Buckets are numbered in the order of their keys; one that is
    overfull at ``bits`` bits stays so.
    """
    upto = list(accumulate((cells.get(c, 0) for c in range(1 << bits)), initial=0))
    depth, whole = 0, [(0, 0)]  # buckets: (local depth, value of its leading bits)
    full = lambda d, v: upto[(v + 1) << (bits - d)] - upto[v << (bits - d)] > capacity
    while over := [b for b in whole if full(*b) and b[0] < bits]:
        if any(d == depth for d, _ in over):
            depth += 1  # the directory doubles
        whole = [b for b in whole if b not in set(over)] + [(d + 1, 2 * v + side) for d, v in over for side in (0, 1)]
    slots = [0] * (1 << depth)
    for nth, (d, v) in enumerate(sorted(whole, key=lambda b: b[1] << (bits - b[0]))):
        for slot in range(v << (depth - d), (v + 1) << (depth - d)):
            slots[slot] = nth
    return depth, slots


def _directory_table(spark: SparkSession, slots: list[int]) -> DataFrame:
    """(slot, bucket), 65 536 rows at most."""
    listed = F.split(F.lit(",".join(map(str, slots))), ",")
    return spark.range(1).select(F.posexplode(listed).alias("slot", "bucket")).select(F.col("slot").cast("long").alias("slot"), F.col("bucket").cast("int").alias("bucket"))


def indexed(entries: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """The index (bucket, key, n, keep_id, keep_row) of entries (key, id, row), in files by ranges of keys, and the number of rows."""
    spark = entries.sparkSession
    with working_tables(spark) as made:
        keys = stored(entries.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("keep_id"), F.coalesce(F.max_by("row", "id"), F.min("row")).alias("keep_row")), "keys")
    cells = keys.groupBy(leading(F.col("key"), DIRECTORY_BITS).alias("cell")).agg(F.count("*").alias("entries"), F.sum("n").alias("n")).collect()  # 65 536 rows at most
    depth, slots = directory({r.cell: r.entries for r in cells}, capacity)
    slot = leading(F.col("key"), depth).alias("slot")
    at = keys.select(slot, "*").join(F.broadcast(_directory_table(spark, slots)), "slot").drop("slot")
    index = stored(at.repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key"), "index")
    discard(spark, made)
    return index, sum(r.n for r in cells)


def _may_repeat(rows: DataFrame, index: DataFrame) -> DataFrame:
    """The rows whose key may have several rows: all that do, and some others."""
    cell = leading(F.col("key"), BITMAP_BITS)
    no, place = F.floor(cell / _ONE_BITMAP).cast("int"), (cell % _ONE_BITMAP).cast("long")
    bitmaps = index.where("n > 1").groupBy(no.alias("no")).agg(F.bitmap_construct_agg(place).alias("bits"))  # 512 of 4 KB at most
    byte = F.conv(F.hex(F.substring(F.col("bits"), (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (place % 8).cast("int"))) != 0
    return rows.withColumn("no", no).join(F.broadcast(bitmaps), "no").where(held).select(*rows.columns)


def collided(rows: DataFrame, index: DataFrame) -> DataFrame:
    """(key) of different texts with equal keys; rows: (key, text) of all texts.  Bytes are compared in the tasks that group by (key, text)."""
    different = _may_repeat(rows.select("key", "text"), index).groupBy("key", "text").agg(F.count("*").alias("n"))
    return different.groupBy("key").agg(F.count("*").alias("texts")).where("texts > 1").select("key")


def _chained(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Entries of collided keys, each with a key of its own for each text of the chain: (doc, id, sha, row, key, chain)."""
    own = stored(rows.join(keys, "key").withColumn("row", F.monotonically_increasing_id()), "collisions")
    chains = own.select("key", "text").distinct()
    place = F.struct("text")
    least = chains.groupBy("key").agg(F.sort_array(F.collect_list(place)).alias("texts"))  # the different texts of one key: a handful
    return own.join(least, "key").withColumn("chain", F.array_position("texts", place)).drop("texts", "text")


def exact_groups(docs: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", normal: Callable[[Column], Column] = lambda c: c, key: Callable[[Column], Column] = key_of, capacity: int = CAPACITY) -> DataFrame:
    """(doc: struct of ``keep``, keep_id, group_size, kept, text_sha256) of each row.

    normal: what is done to a text before it is compared.  key: from its sha256 in hex to a
    number of 60 bits.
    """
    spark = docs.sparkSession
    text = normal(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"), F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    rows = rows.withColumn("sha", F.sha2("text", 256)).withColumn("key", key(F.col("sha")))
    entries = stored(rows.select("doc", "id", "sha", F.monotonically_increasing_id().alias("row"), "key"), "entries")
    index, total = indexed(entries, capacity)
    several = index.where("n > 1").select("key", "n", "keep_id", "keep_row")
    with working_tables(spark) as made:
        clashes = stored(collided(rows, index), "clashes")
    if clashes.isEmpty():
        discard(spark, made)
        found = joined_back(entries, several, "key", total)
    else:
        plain = entries.join(clashes, "key", "left_anti")
        found = joined_back(plain, several.join(clashes, "key", "left_anti"), "key", total)
        chained = stored(_chained(rows, clashes), "chains")
        link = ["key", "chain"]
        groups = stored(chained.groupBy(*link).agg(F.count("*").alias("n"), F.max("id").alias("keep_id"), F.coalesce(F.max_by("row", "id"), F.min("row")).alias("keep_row")), "chain-groups")
        found = found.unionByName(chained.join(groups, link).drop("chain"))
    alone = F.col("n").isNull()
    return found.select(
        "doc",
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    return exact_groups(docs, docs.columns, id_col, text_col).where("kept").select("doc.*")


def op11_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of all documents."""
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"]).select("doc.doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256 FROM d
"""
