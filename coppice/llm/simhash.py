"""SimHash near-duplicate groups by a self-join of binary tries.

Fingerprints that differ in at most ``budget`` bits are linked.  The 64 bits are
cut into budget+1 slices; two linked fingerprints agree in one slice at least, so
every fingerprint is dealt out once per slice, turned so that this slice leads.
Rows that share the slice form a trie, and the trie is joined with itself: pairs
of nodes go down together, add up differing bits and are pruned past the budget.

Only a spanning forest of each trie's links leaves the task (a pair of nodes
whose leaves are known to be one component is pruned as well), so a group of n
near copies gives n-1 links, not n². A trie of more than ``split_rows`` rows is
cut below its slice: pairs of its subtrees within the budget become tasks.

``keep_first`` is to find copies with a few words changed: texts that share four fifths
of their five-word shingles.  Those differ in up to 11 bits of a fingerprint of three-word
shingles, too many for tries that hold at any size.  So it takes ``PRINTS`` fingerprints
of a text, each of independent hashes of its words (a word weighs the logarithm of its
count, so frequent ones don't decide) and of its distinct pairs of neighbouring words (so the
vocabulary alone doesn't decide), and links texts within the budget in one of them.

Defined results: a null or wordless text has fingerprint zero and is linked like
any other; rows with a null doc_id are grouped, but never name a group; repeated
rows are kept; ties (a bit set in just half) are zero; very long texts are hashed whole;
further columns are ignored or pass through, whatever their names; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coppice.llm.components import components
from coppice.llm.storage import mapped, stored
from coppice.llm.textscan import SpanHash, mix, texts

SHINGLE_WORDS = 3
BUDGET = 3
SEED = 42
#: Fingerprints of a text in ``keep_first``, and the weights of a word met once and of a pair of words.
PRINTS = 8
WORD_WEIGHT, PAIR_WEIGHT = 16, 12
#: Words whose hashes a worker remembers, 8 bytes a fingerprint and word.
REMEMBERED = 1 << 18
#: Hashes whose bits are added up at once.
CHUNK = 1 << 15
#: Node pairs that go down together.
FRONT = 1 << 17
#: Below so many candidate pairs, a node pair is compared leaf by leaf.
LEAF_PAIRS = 16


def fingerprint(text: bytes, shingle: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Bit i is 1 if it is set in over half of the shingles' XXH64 values."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    begins = (ends - lengths)[:n].tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    digest, sums = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for i in range(0, n, CHUNK):
        raw = b"".join([digest(line[a:b], seed) for a, b in zip(begins[i : i + CHUNK], ends[i : i + CHUNK], strict=True)])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, 64)
        for j in range(0, len(bits), 255):  # 255 ones fit a byte: sums stay in narrow lanes
            sums += bits[j : j + 255].sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * sums > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text as a signed 64-bit value."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = own.schema["doc_id"].dataType

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x, shingle, seed) for x in texts(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return mapped(own, scan, f"doc_id {kind.simpleString()}, fp long")


class WordPrints:
    """``prints`` 64-bit fingerprints of a text from its words and pairs of words; remembers the hashes of the words it has met."""

    def __init__(self, prints: int = PRINTS, remembered: int = REMEMBERED):
        self.seeds, self.prints = range(-(-prints // 2)), prints
        self.remembered, self.place, self.hashes = remembered, {}, np.zeros((1 << 10, prints), np.uint64)

    def _places(self, words: list[bytes]) -> np.ndarray:
        place = self.place
        if len(place) > self.remembered:
            place.clear()
        for w in words:
            if w not in place:
                if len(place) == len(self.hashes):
                    self.hashes = np.concatenate((self.hashes, np.zeros_like(self.hashes)))
                self.hashes[len(place)] = np.frombuffer(b"".join([xxhash.xxh3_128_digest(w, s) for s in self.seeds]), ">u8")[: self.prints]
                place[w] = len(place)
        return np.fromiter(map(place.__getitem__, words), np.int64, len(words))

    def _bits(self, hashes: np.ndarray) -> np.ndarray:
        return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(len(hashes), -1), axis=1)

    def __call__(self, text: bytes) -> np.ndarray:
        at = self._places(text.lower().split())
        words, counts = np.unique(at, return_counts=True)
        weights = np.rint(WORD_WEIGHT * (1 + np.log(counts)))  # whole numbers: sums are exact in any order
        sums, step = np.zeros(64 * self.prints), CHUNK // 8
        for i in range(0, len(words), step):
            sums += weights[i : i + step] @ self._bits(self.hashes[words[i : i + step]])
        pairs = np.unique(at[:-1] * len(self.hashes) + at[1:])
        for i in range(0, len(pairs), 255):  # 255 ones fit a byte: sums stay in narrow lanes
            one, two = np.divmod(pairs[i : i + 255], len(self.hashes))
            bits = self._bits(mix(self.hashes[one] * np.uint64(SpanHash.BASE) + self.hashes[two]))
            sums += PAIR_WEIGHT * bits.sum(axis=0, dtype=np.uint8).astype(np.float64)
        return np.packbits(2 * sums > weights.sum() + PAIR_WEIGHT * len(pairs)).view(">u8").astype(np.int64)


def _labels(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Least label of each component after links (a, b) are added."""
    while len(a):
        la, lb = label[a], label[b]
        differ = la != lb
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        if not len(a):
            break
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        np.minimum.at(label, high, low)
        while (jump := label[label]) is not None and (jump != label).any():
            label = jump
    return label


def trie_forest(keys: np.ndarray, group: np.ndarray, budget: int = BUDGET, skip_bits: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Indices (member, root) of a spanning forest of all links within a group.

    keys: uint64, ascending and distinct within a group; group: ascending ids; rows
    of one group agree in their first ``skip_bits`` bits.
    """
    n = len(keys)
    label = np.arange(n)
    if n < 2:
        return label[:0], label[:0]
    near = np.flatnonzero((group[1:] == group[:-1]) & (np.bitwise_count(keys[1:] ^ keys[:-1]) <= budget))
    label = _labels(n, near, near + 1, label)
    head = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    tail = np.append(head[1:], n)
    big = tail - head > 1
    head, tail = head[big], tail[big]
    if not len(head):
        return label[:0], label[:0]
    # A front: bit to look at next, and pairs of nodes, each a range of keys, with the bits they differ in.
    todo = [(63 - skip_bits, head, tail, head, tail, np.zeros(len(head), np.int64))]
    seam = np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))
    stale = False
    while todo:
        bit, lo1, hi1, lo2, hi2, err = todo.pop()
        if len(lo1) > FRONT:
            half = len(lo1) // 2
            todo.append((bit, lo1[half:], hi1[half:], lo2[half:], hi2[half:], err[half:]))
            todo.append((bit, lo1[:half], hi1[:half], lo2[:half], hi2[:half], err[:half]))
            continue
        if stale:
            seam, stale = np.concatenate(([0], np.cumsum(label[1:] != label[:-1]))), False
        one = (seam[lo1] == seam[hi1 - 1]) & (seam[lo2] == seam[hi2 - 1]) & (label[lo1] == label[lo2])
        keep = ~one
        lo1, hi1, lo2, hi2, err = lo1[keep], hi1[keep], lo2[keep], hi2[keep], err[keep]
        n1, n2 = hi1 - lo1, hi2 - lo2
        few = n1 * n2 <= LEAF_PAIRS if bit >= 0 else np.ones(len(lo1), bool)
        if few.any():
            count = (n1 * n2)[few]
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            wide = np.repeat(n2[few], count)
            a, b = np.repeat(lo1[few], count) + at // wide, np.repeat(lo2[few], count) + at % wide
            hit = (a < b) & (np.bitwise_count(keys[a] ^ keys[b]) <= budget)
            a, b = a[hit], b[hit]
            fresh = label[a] != label[b]
            if fresh.any():
                label, stale = _labels(n, a[fresh], b[fresh], label), True
        lo1, hi1, lo2, hi2, err = (x[~few] for x in (lo1, hi1, lo2, hi2, err))
        if not len(lo1):
            continue
        mid1, mid2 = _middle(keys, lo1, hi1, bit), _middle(keys, lo2, hi2, bit)
        same = lo1 == lo2
        below = []
        for first, second, extra, off in ((0, 0, 0, False), (1, 1, 0, False), (0, 1, 1, False), (1, 0, 1, True)):
            a, b = (mid1, hi1) if first else (lo1, mid1)
            c, d = (mid2, hi2) if second else (lo2, mid2)
            ok = (a < b) & (c < d) & (err + extra <= budget)
            if off:
                ok &= ~same  # a node with itself: its two crossed pairs are one
            below.append((a[ok], b[ok], c[ok], d[ok], err[ok] + extra))
        a, b, c, d, e = (np.concatenate(x) for x in zip(*below, strict=True))
        single = (a == c) & (b - a == 1)
        if len(a):
            todo.append((bit - 1, a[~single], b[~single], c[~single], d[~single], e[~single]))
    member = np.flatnonzero(label != np.arange(n))
    return member, label[member]


def _middle(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """Where the one-branch of each node (a range that agrees above ``bit``) begins."""
    lo, hi, mask = lo.copy(), hi.copy(), np.uint64(1 << bit)
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        set_ = (keys[np.minimum(mid, len(keys) - 1)] & mask) != 0
        hi = np.where(open_ & set_, mid, hi)
        lo = np.where(open_ & ~set_, mid + 1, lo)
    return lo


def _join_tries(budget: int, skip_bits: int, slices: int, hold: int = 1 << 19):
    """Arrow function over partitions sorted by (slice, lead, sub, turned): whole groups at a time."""

    def links(table: pa.Table) -> Iterator[pa.RecordBatch]:
        fp, turned, slice_ = (table.column(c).combine_chunks().to_numpy() for c in ("fp", "turned", "slice"))
        cut = np.zeros(len(fp), bool)
        for c in ("slice", "lead", "sub"):
            x = table.column(c).combine_chunks().to_numpy()
            cut[1:] |= x[1:] != x[:-1]
        group = np.cumsum(cut)
        keys = turned.view(np.uint64) ^ np.uint64(1 << 63)  # signed order of Spark's sort
        order = np.lexsort((keys, group))
        member, root = trie_forest(keys[order], group[order], budget, skip_bits)
        if len(member):
            yield pa.RecordBatch.from_arrays([pa.array(slice_[order][member] // slices), pa.array(fp[order][root]), pa.array(fp[order][member])], names=["series", "u", "v"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, limit = 0, hold
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= limit:
                table = pa.Table.from_batches(held).combine_chunks()
                key = [table.column(c).to_numpy() for c in ("slice", "lead", "sub")]
                last = np.ones(table.num_rows, bool)
                for x in key:
                    last &= x == x[-1]
                first = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
                if first:
                    yield from links(table.slice(0, first))
                    table = table.slice(first)
                held, rows = table.to_batches(), table.num_rows
                limit = max(hold, 2 * rows)  # one group may fill the buffer (split_rows and its pair bound it); it isn't looked at again at every batch
        if held:
            yield from links(pa.Table.from_batches(held))

    return scan


def near_links(fps: DataFrame, budget: int = BUDGET, split_rows: int = 1 << 18) -> DataFrame:
    """(series, u, v): links of a spanning forest over each series' distinct fingerprints; (series: int, fp: long)."""
    slices = budget + 1
    width = 64 // slices
    turn = lambda c, k: c if k == 0 else F.shiftleft(c, width * k).bitwiseOR(F.shiftrightunsigned(c, 64 - width * k))
    dealt = (
        fps.select("fp", F.explode(F.array(*[F.struct((F.col("series") * slices + k).alias("slice"), turn(F.col("fp"), k).alias("turned")) for k in range(slices)])).alias("x"))
        .select("fp", "x.slice", "x.turned")
        .withColumn("lead", F.shiftrightunsigned("turned", 64 - width))
    )
    sizes = dealt.groupBy("slice", "lead").count().where(F.col("count") > split_rows)
    large = stored(sizes.withColumn("deep", F.least(F.lit(12), F.ceil(F.log2(F.col("count") / split_rows)).cast("int"))).drop("count"), "large-tries")
    if large.isEmpty():
        spread = dealt.withColumn("sub", F.lit(0).cast("long"))
    else:
        spread = _subtrees(dealt, large, budget, width)
    ordered = spread.select("slice", "lead", "sub", "turned", "fp").repartition("slice", "lead", "sub").sortWithinPartitions("slice", "lead", "sub", "turned")
    return mapped(ordered, _join_tries(budget, width, slices), "series int, u long, v long")


def _subtrees(dealt: DataFrame, large: DataFrame, budget: int, width: int) -> DataFrame:
    """Rows of large tries, once for each pair of subtrees within the budget that theirs belongs to."""
    depths = [r.deep for r in large.select("deep").distinct().collect()]  # at most 12 values
    joined = dealt.join(large, ["slice", "lead"], "left")
    parts = [joined.where("deep is null").drop("deep").withColumn("sub", F.lit(0).cast("long"))]
    for deep in depths:
        masks = [sum(1 << i for i in bits) for k in range(budget + 1) for bits in combinations(range(deep), k)]
        own = F.shiftrightunsigned(F.shiftleft("turned", width), 64 - deep)
        pair = lambda m, own=own: F.least(own, own.bitwiseXOR(F.lit(m).cast("long"))) * 4096 + F.greatest(own, own.bitwiseXOR(F.lit(m).cast("long"))) + 1
        parts.append(joined.where(F.col("deep") == deep).drop("deep").withColumn("sub", F.explode(F.array(*[pair(m) for m in masks]))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS, budget: int = BUDGET, seed: int = SEED, split_rows: int = 1 << 18) -> DataFrame:
    """(doc_id, fp, component_id) for each row; component_id is the least doc_id reachable over links."""
    rows = stored(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    seen = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    member = components(near_links(seen.select(F.lit(0).alias("series"), "fp"), budget, split_rows).select("u", "v"))
    tied = seen.join(member.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = tied.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_fp = stored(tied.join(names, "root").select("fp", "component_id"), "groups")
    return rows.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def _printed(own: DataFrame, prints: int) -> DataFrame:
    """(row, f0 ..): the fingerprints of (row, text)."""
    schema = T.StructType([own.schema["row"], *[T.StructField(f"f{k}", T.LongType(), False) for k in range(prints)]])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = WordPrints(prints)
        for b in batches:
            found = np.array([of(x) for x in texts(b.column(1))], np.int64).reshape(-1, prints)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(found[:, k].copy()) for k in range(prints)]], names=schema.names)

    return mapped(own, scan, schema)


def near_prints(seen: DataFrame, prints: int = PRINTS, budget: int = BUDGET, split_rows: int = 1 << 18) -> DataFrame:
    """(f0, root): ``seen`` holds distinct f0 ..; those within the budget in one of the fingerprints share their root, an f0.

    Each fingerprint's tries give links between its own values; a value stands for the
    least f0 it occurs with, so all links are between values of f0.
    """
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("series"), F.col(f"f{k}").alias("fp")) for k in range(prints)])).alias("x")
    long = seen.select("f0", values).select("f0", "x.series", "x.fp")
    of = stored(long.groupBy("series", "fp").agg(F.min("f0").alias("least")), "distinct-fingerprints")
    side = lambda c: of.select("series", F.col("fp").alias(c), F.col("least").alias(f"of_{c}"))
    found = stored(near_links(of.select("series", "fp"), budget, split_rows), "print-links")
    between = found.join(side("u"), ["series", "u"]).join(side("v"), ["series", "v"]).select(F.col("of_u").alias("u"), F.col("of_v").alias("v"))
    same = long.join(of, ["series", "fp"]).where("f0 <> least").select(F.col("f0").alias("u"), F.col("least").alias("v"))
    links = between.unionByName(same)
    return components(links).withColumnRenamed("node", "f0")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prints: int = PRINTS, budget: int = BUDGET, split_rows: int = 1 << 18) -> DataFrame:
    """The first row of each group of near copies: that of the least doc_id, and among rows with that doc_id of the least row hash.

    Rows with a null doc_id are held against each other only: of each group one stays.
    """
    cols = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]  # maps have no hash
    # A hash skips nulls, so it is told where they are.  Both together name a row; rows with the same are copies in all columns.
    row_hash = [F.xxhash64(F.lit(k), *cols, *[F.isnull(c) for c in cols]).alias(name) for k, name in enumerate(("high", "low"))]
    own = docs.select(F.struct(F.col(f"`{id_col}`").alias("id"), *row_hash).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    named = F.col("row.id").isNotNull()
    keys = [f"f{k}" for k in range(prints)]
    seen = stored(_printed(own, prints).groupBy(*keys).agg(F.min(F.when(named, F.col("row"))).alias("named"), F.min(F.when(~named, F.col("row"))).alias("unnamed")), "distinct-prints")
    tied = seen.join(near_prints(seen.select(*keys), prints, budget, split_rows), "f0", "left").withColumn("root", F.coalesce("root", "f0"))
    firsts = tied.groupBy("root").agg(F.min("named").alias("named"), F.min("unnamed").alias("unnamed")).select(F.explode(F.array("named", "unnamed")).alias("row")).where("row is not null").select("row.high", "row.low")
    # Rows are dealt out by their hash at any size of the other side; dropping repeated rows needs that anyway.
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *row_hash).join(firsts.hint("shuffle_hash"), ["high", "low"], "left_semi").dropDuplicates(["high", "low"])
    return kept.select("doc.*")


def op10_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for all documents."""
    found = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
