"""Packing of documents into padded batches, by optimal length buckets.

Lengths are token counts.  Their global histogram goes to the driver: exact up to
``EXACT`` tokens, so 1 M counts at most, and for longer documents in cells of 1/128 of
their length, each with its largest length.  Dynamic programming finds the bucket
boundaries with the least padding: a document is padded to its bucket's boundary.  (Where
documents are longer than ``EXACT``, boundaries above it fall on cells, at less than
1/128 of the ids padded there.)  A batch of a bucket holds as many documents as the token
budget has room for at that length, one at least; no document is cut or dropped.

Batches are filled in the order of a hash of the rows' values, without gathering a
bucket: rows are dealt out by ranges of (bucket, hash), each range counts on from the
sums of those before it, and a row's rank gives its batch and slot.  So they depend on
the documents alone, not on files or tasks.

Defined results: null text counts as empty (only the end token); repeated rows are
packed each, in any order among them; an empty table gives none; fewer distinct lengths
than buckets give a bucket for each; a document longer than the budget is a batch of its
own; very long texts are counted whole; columns named like the result's three are given
way to: the result's come last and replace them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coppice.llm.storage import mapped, stored
from coppice.llm.tokencount import MODEL, token_counts

BUCKETS = 16
BUDGET = 16_384
END_TOKENS = 1
EXACT = 1 << 20
STEPS = 128

def cell_of(length: F.Column) -> F.Column:
    """The length itself up to EXACT, above it the length with its last bits zero."""
    cut = F.greatest(F.length(F.bin(length)) - (STEPS.bit_length()), F.lit(0))
    return F.when(length <= EXACT, length).otherwise(F.call_function("shiftleft", F.call_function("shiftright", length, cut), cut))


def best_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> np.ndarray:
    """Upper boundaries (ascending, of ``lengths``) of at most ``buckets`` buckets with the least padding.

    lengths: ascending.  best[j] is the least padded size of the first j lengths in k
    buckets, where a bucket's size is its documents times its largest length.  The best
    beginning of the last bucket never moves back as j grows (the size fulfils the
    quadrangle inequality), so a layer is solved from the middle j outwards: each half
    looks only at its side of what the middle found.
    """
    n = len(lengths)
    if n <= buckets:
        return lengths.copy()
    upto = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
    top = np.concatenate(([0], lengths)).astype(np.int64)  # of the first j lengths
    best = top * upto
    choice = np.zeros((buckets, n + 1), np.int32)
    for k in range(1, buckets):
        new, begin = best.copy(), choice[k]
        low, high = np.array([k + 1]), np.array([n])  # ranges of j, and what their i may be
        least, most = np.array([k]), np.array([n - 1])
        while len(low):
            mid = (low + high) >> 1
            width = np.minimum(most, mid - 1) - least + 1
            first = np.cumsum(width) - width
            i = np.arange(int(width.sum())) - np.repeat(first - least, width)
            j = np.repeat(mid, width)
            size = best[i] + top[j] * (upto[j] - upto[i])
            new[mid] = np.minimum.reduceat(size, first)
            hits = np.flatnonzero(size == np.repeat(new[mid], width))
            found = i[hits[np.searchsorted(hits, first)]]
            begin[mid] = found
            low, high, least, most = np.concatenate((low, mid + 1)), np.concatenate((mid - 1, high)), np.concatenate((least, found)), np.concatenate((found, most))
            some = low <= high
            low, high, least, most = low[some], high[some], least[some], most[some]
        best = new
    ends, j = [], n
    for k in reversed(range(buckets)):
        ends.append(lengths[j - 1])
        j = int(choice[k, j])
    return np.array(ends[::-1], dtype=lengths.dtype)


def packed(lengths: DataFrame, length_col: str = "n_tokens", buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """``lengths`` (a table that can be read again) with bucket (the padded length), batch_id and slot of each row."""
    spark = lengths.sparkSession
    kept = [c for c in lengths.columns if c not in ("bucket", "batch_id", "slot")]
    size = F.col(f"`{length_col}`")
    histogram = lengths.groupBy(cell_of(size).alias("cell")).agg(F.count("*").alias("n"), F.max(size).alias("top"))
    found = histogram.toArrow().sort_by("top")  # at most EXACT rows and STEPS for each doubling above
    bounds = best_boundaries(found["top"].to_numpy(), found["n"].to_numpy(), buckets).tolist()
    if not bounds:
        return lengths.select(*[F.col(f"`{c}`") for c in kept], F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("batch_id"), F.lit(0).cast("long").alias("slot"))
    bucket = F.lit(bounds[-1]).cast("long")
    for b in reversed(bounds[:-1]):
        bucket = F.when(size <= b, F.lit(b).cast("long")).otherwise(bucket)
    rows = lengths.select(F.struct(*[F.col(f"`{c}`") for c in lengths.columns]).alias("doc"), bucket.alias("bucket"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())  # deals out rows that are equal in all else
    order = [F.col("bucket"), F.xxhash64("doc"), F.col("doc"), F.col("row")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = T.StructType([rows.schema["doc"], *[T.StructField(c, T.LongType(), False) for c in ("bucket", "shard", "at")]])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, seen = TaskContext.get().partitionId(), dict.fromkeys(bounds, 0)
        for b in batches:
            own = b.column(1).to_numpy()
            at = np.zeros(len(own), np.int64)
            for k in np.unique(own).tolist():
                place = np.flatnonzero(own == k)
                at[place] = seen[k] + np.arange(len(place))
                seen[k] += len(place)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.full(len(own), shard)), pa.array(at)], names=schema.names)

    numbered = stored(mapped(dealt.select("doc", "bucket"), number, schema), "numbered")
    sums = sorted((r.bucket, r.shard, r.n) for r in numbered.groupBy("bucket", "shard").count().withColumnRenamed("count", "n").collect())  # a shard holds few buckets
    begins, batches, offsets = {}, 0, []
    for b in bounds:
        total = 0
        begins[b] = batches
        for _, shard, n in (s for s in sums if s[0] == b):
            offsets.append((b, shard, total))
            total += n
        batches += -(-total // max(1, budget // b)) if b else -(-total // budget)
    before = F.broadcast(spark.createDataFrame([(b, s, o, begins[b], max(1, budget // max(b, 1))) for b, s, o in offsets], "bucket long, shard long, before long, first_batch long, room long"))
    rank = F.col("before") + F.col("at")
    done = numbered.join(before, ["bucket", "shard"])
    return done.select(*[F.col(f"doc.`{c}`") for c in kept], "bucket", (F.col("first_batch") + F.floor(rank / F.col("room"))).cast("long").alias("batch_id"), (rank % F.col("room")).alias("slot"))


def pack_documents(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """(doc_id, n_tokens: with an end token, bucket, batch_id, slot) of each row."""
    text = F.col(f"`{text_col}`").cast("string")
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    counted = token_counts(own, model_file, ["id", "text_hash"])
    lengths = stored(counted.select("doc.id", "doc.text_hash", (F.col("n_tokens") + END_TOKENS).alias("n_tokens")), "lengths")
    done = packed(lengths, "n_tokens", buckets, budget)
    return done.select(F.col("id").alias(id_col), "n_tokens", "bucket", "batch_id", "slot")


def op7_packing(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, bucket, batch_id, slot of all documents."""
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(MODEL))
