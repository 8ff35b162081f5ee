"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts and items are brought to words (A-Z lower-cased; digits, letters and all
of non-ASCII count) joined by single spaces, a space before and after.  A pattern
is a window of 13 consecutive item words, or all words of a shorter item, with
the spaces around it, so it can only match whole words.

Patterns are searched in classes by length, each with its own tables over the
first m bytes of its patterns, m the least length in the class: SHIFT, by hash
of a block, tells how far a position may move before a pattern can end there; at
shift zero the hash of the last block picks a bucket of patterns, whose first
bytes and then whole bytes are compared directly.  Many stretches of the text are
searched side by side, one numpy step moving each to its next position.

The items are a bounded query set.  A pattern is two places in one text of all items, not a
copy, so that a block of ``block_bytes`` holds the patterns of an eighth of that in item texts, 50 MB;
a block's tables are sent to the executors and searched against all documents in one pass; the hits of
several blocks are merged per document.

Defined results: null or wordless documents have no words and no hits; null or
wordless items have no window; an item id that occurs twice is one id, a null
item id is left out of ids and their number; repeated rows give repeated results; very
long texts are searched whole; at just one word in SHARE a document is contaminated;
further columns pass through, whatever their names; no items, or no documents, give
clean results or none.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coppice.llm.storage import mapped, stored
from coppice.llm.textscan import LOWER_WORD, SpanHash, column_of, joined, passes, runs, texts

WINDOW = 13
SHARE = 20  # contaminated from one hit word in so many
BLOCK_BYTES = 400 << 20
#: Bytes that a byte of an item takes in a block: itself, and a window's places, items and table entries for each word.
BYTE_COST = 8
STRETCH = 2048
LEAST_BITS, MOST_BITS = 16, 22
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Windows:
    """The different windows of items, as stretches of one text."""

    text: bytes
    begin: np.ndarray
    end: np.ndarray
    words: np.ndarray  # how many words each has
    first: np.ndarray  # where the items of a window begin in ``items``; one more entry
    items: np.ndarray  # places in ``names``
    names: list[str]

    def __len__(self) -> int:
        return len(self.begin)

    def __getitem__(self, k: int) -> bytes:
        if not 0 <= k < len(self.begin):
            raise IndexError(k)
        return self.text[self.begin[k] : self.end[k]]

    def ids(self, k: int) -> list[str]:
        return [self.names[i] for i in self.items[self.first[k] : self.first[k + 1]].tolist()]


def item_patterns(items: list[tuple], window: int = WINDOW) -> Windows:
    """The windows of items (id, text), equal ones once, each with the ids (as text) of the items that hold it."""
    ids = [None if i is None else str(i) for i, _ in items]
    names = sorted({i for i in ids if i is not None})
    place = {n: k for k, n in enumerate(names)}
    rows = [(t or "").encode() for _, t in items]
    text, base = [], 0
    parts: list[list[np.ndarray]] = [[] for _ in range(5)]
    for low, high in passes(rows):
        buf, n, starts, firsts = normalised(rows[low:high])
        begin, end = runs((buf[:n] != 0x20) & (buf[:n] != 0x0A))
        words = np.diff(firsts)
        many = np.where(words > 0, np.maximum(1, words - window + 1), 0)
        row = np.repeat(np.arange(high - low), many)
        at = firsts[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        size = np.minimum(words[row], window)
        b, e = begin[at] - 1, end[at + size - 1] + 1
        own = np.array([-1 if i is None else place[i] for i in ids[low:high]], np.int32)
        for part, x in zip(parts, (b + base, e + base, size, own[row], SpanHash(buf).of(b, e)), strict=True):
            part.append(x)
        text.append(buf[:n].tobytes())
        base += n
    whole = b"".join(text)
    begin, end, size, own, key = (np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(parts, (np.int64, np.int64, np.int64, np.int32, np.uint64), strict=True))
    order = np.lexsort((begin, key))
    new = np.ones(len(order), bool)  # whether a window differs from the one before it in this order
    for k in (np.flatnonzero(key[order[1:]] == key[order[:-1]]) + 1).tolist():
        a, b = order[k - 1], order[k]
        new[k] = whole[begin[a] : end[a]] != whole[begin[b] : end[b]]
    of = np.cumsum(new) - 1
    kept = order[new]
    pairs = np.unique(np.stack([of, own[order]])[:, own[order] >= 0], axis=1) if len(of) else np.zeros((2, 0), np.int64)
    first = np.searchsorted(pairs[0], np.arange(len(kept) + 1))
    return Windows(whole, begin[kept], end[kept], size[kept].astype(np.int32), first, pairs[1].astype(np.int32), names)


@dataclass
class PatternClass:
    """Tables for patterns of m bytes or more."""

    m: int
    block: int
    bits: int
    shift: np.ndarray
    patterns: Windows | list[bytes]
    of: np.ndarray  # which patterns are in the class
    bucket: np.ndarray  # hash of the last block -> first place in members; one more entry
    members: np.ndarray
    heads: np.ndarray  # first bytes of each pattern, as one number


def _block_hash(values: np.ndarray, bits: int) -> np.ndarray:
    return ((values * _SPREAD) >> np.uint64(64 - bits)).astype(np.int64)


def _blocks(buf: np.ndarray, width: int) -> np.ndarray:
    """The number made of ``width`` bytes at each place; buf has 8 spare bytes at its end."""
    wide = np.ndarray(len(buf) - 7, "<u8", buf, strides=(1,))
    return wide if width == 8 else wide & np.uint64((1 << 8 * width) - 1)


def compile_class(patterns: Windows | list[bytes], of: np.ndarray, raw: np.ndarray, begin: np.ndarray, m: int) -> PatternClass:
    """Tables for the patterns ``of``, which begin at ``begin`` in ``raw`` and are m bytes or more."""
    width = min(8, m)
    bits = min(MOST_BITS, max(LEAST_BITS, (len(of) * (m - width + 1)).bit_length() + 1))
    shift = np.full(1 << bits, m - width + 1, np.int64)
    wide = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    mask = np.uint64((1 << 8 * width) - 1) if width < 8 else np.uint64(0xFFFFFFFFFFFFFFFF)
    head = wide[begin] & mask
    for at in range(m - width + 1):
        values = wide[begin + at] & mask
        np.minimum.at(shift, _block_hash(values, bits), m - width - at)
    key = _block_hash(values, bits)
    members = np.argsort(key, kind="stable")
    bucket = np.searchsorted(key[members], np.arange((1 << bits) + 1))
    return PatternClass(m, width, bits, shift, patterns, of, bucket.astype(np.int32), members.astype(np.int32), head)


def compile_patterns(patterns: Windows | list[bytes]) -> list[PatternClass]:
    """A class for each length in powers of two."""
    if isinstance(patterns, Windows):
        text, begin, size = patterns.text, patterns.begin, patterns.end - patterns.begin
    else:
        text, size = b"".join(patterns), np.array([len(p) for p in patterns], np.int64)
        begin = np.cumsum(size) - size
    raw = np.frombuffer(text + bytes(8), np.uint8)
    step = np.minimum(6, np.ceil(np.log2(size + 1)).astype(np.int64)) if len(size) else size  # bits of the length
    out = []
    for k in np.unique(step):
        of = np.flatnonzero(step == k)
        out.append(compile_class(patterns, of.astype(np.int32), raw, begin[of], int(size[of].min())))
    return out


def search(buf: np.ndarray, n: int, raw: bytes, c: PatternClass) -> list[tuple[int, int]]:
    """(begin, index into c.patterns) of each occurrence in the first n bytes of buf."""
    last = n - c.m  # last place where a window of m bytes begins
    if last < 0:
        return []
    value = _blocks(buf, c.block)
    tail = c.m - c.block
    at = np.arange(0, last + 1, STRETCH)
    stop = np.minimum(at + STRETCH, last + 1)
    found = []
    while len(at):
        step = c.shift[_block_hash(value[at + tail], c.bits)]
        zero = step == 0
        if zero.any():
            found.append(at[zero])
        at = at + np.maximum(step, 1)
        go = at < stop
        if not go.all():
            at, stop = at[go], stop[go]
    if not found:
        return []
    at = np.concatenate(found)
    key = _block_hash(value[at + tail], c.bits)
    count = c.bucket[key + 1] - c.bucket[key]
    place = np.repeat(at, count)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    which = c.members[np.repeat(c.bucket[key], count) + nth]
    same = value[place] == c.heads[which]
    out = []
    for p, k in zip(place[same].tolist(), c.of[which[same]].tolist(), strict=True):
        if raw.startswith(c.patterns[k], p):
            out.append((p, k))
    return out


def normalised(rows: list[bytes]) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
    """Words of all rows, each with one space after it, a newline and a space before each row.

    Gives the bytes (8 spare at the end), their number, where each word begins, and
    the first word of each row (one more: the end).
    """
    buf, begins = joined([x.lower() for x in rows])
    word = LOWER_WORD[buf]
    begin, end = runs(word)
    firsts = np.searchsorted(begin, begins)
    # Each word moves to its new place: kept bytes in order, plus a space for each word and two bytes for each row before it.
    lengths = end - begin
    row = np.searchsorted(begins, begin, "right") - 1
    starts = np.cumsum(lengths + 1) - (lengths + 1) + 2 * (row + 1)
    n = int(lengths.sum()) + len(begin) + 2 * len(rows)
    out = np.full(n + 8, 0x20, np.uint8)
    out[np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))] = buf[word]
    opening = np.zeros(len(rows), np.int64)
    before = np.concatenate(([0], np.cumsum(lengths + 1)))
    opening = before[firsts[:-1]] + 2 * np.arange(len(rows))
    out[opening] = 0x0A
    return out, n, starts, firsts


def hits(rows: list[bytes], classes: list[PatternClass], windows: Windows) -> tuple[np.ndarray, list[np.ndarray], list[set[str]]]:
    """Number of words, hit words (their indices, ascending) and ids of items found, of each row."""
    count = np.zeros(len(rows), np.int64)
    hit: list[np.ndarray] = [np.zeros(0, np.int64)] * len(rows)
    items: list[set[str]] = [set() for _ in rows]
    for low, high in passes(rows):
        buf, n, starts, firsts = normalised(rows[low:high])
        count[low:high] = np.diff(firsts)
        raw = buf.tobytes()
        edge = None
        for c in classes:
            for p, k in search(buf, n, raw, c):
                if edge is None:
                    edge = np.zeros(len(starts) + 1, np.int64)
                w = int(np.searchsorted(starts, p + 1))
                edge[w] += 1
                edge[w + int(windows.words[k])] -= 1
                items[low + int(np.searchsorted(firsts, w, "right")) - 1].update(windows.ids(k))
        if edge is not None:
            words = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
            rows_of = np.searchsorted(firsts, words, "right") - 1
            for r in np.unique(rows_of).tolist():
                hit[low + r] = words[rows_of == r] - firsts[r]
    return count, hit, items


def _pattern_blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int) -> Iterator[Windows]:
    """Patterns of the items, in blocks; the items stream through the driver, one block held at a time."""
    held: list[tuple] = []
    size = 0
    for r in benchmark.select(F.col(item_col), F.col(text_col).cast("string")).toLocalIterator():
        cost = BYTE_COST * len((r[1] or "").encode())
        if held and size + cost > block_bytes:
            yield item_patterns(held, window)
            held, size = [], 0
        held.append((r[0], r[1]))
        size += cost
    if held:
        yield item_patterns(held, window)


_FOUND = "n_words long, hit binary, items array<string>"


#: The tables of the block that a worker searched last; it keeps them from task to task.
_COMPILED: dict = {}


def _searched(docs: DataFrame, windows: Windows, keep: list[str], text_col: str) -> DataFrame:
    """(doc: struct of ``keep``, n_words, hit: word indices, items) of each row for one block of patterns."""
    spark = docs.sparkSession
    inside = text_col in keep and docs.schema[text_col].dataType == T.StringType()  # then the text travels once
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"), *([] if inside else [F.col(text_col).cast("string").alias("text")]))
    sent = spark.sparkContext.broadcast((uuid.uuid4().hex, windows))  # a block of patterns
    schema = T.StructType([own.schema["doc"], *T._parse_datatype_string(_FOUND).fields])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, windows = sent.value
        if name not in _COMPILED:
            _COMPILED.clear()
            _COMPILED[name] = compile_patterns(windows)
        classes = _COMPILED[name]
        for b in batches:
            count, hit, items = hits(texts(column_of(b, text_col, own=None if inside else 1)), classes, windows)
            packed = pa.array([h.astype("<u4").tobytes() for h in hit], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count), packed, pa.array([sorted(x) for x in items], pa.list_(pa.string()))], names=schema.names)

    return mapped(own, scan, schema)


def _merged(parts: list[DataFrame]) -> DataFrame:
    """The blocks' findings of each row as one; ``row`` names it."""

    def unite(key, table):
        words = np.unique(np.concatenate([np.frombuffer(x, "<u4") for x in table["hit"].to_pylist()]))
        items = sorted({i for x in table["items"].to_pylist() for i in x})
        return pa.table({"row": pa.array([key[0].as_py()]), "hit": pa.array([words.astype("<u4").tobytes()], pa.binary()), "items": pa.array([items], pa.list_(pa.string()))})

    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("row").applyInArrow(unite, "row long, hit binary, items array<string>")


def found(docs: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc, n_words, n_hit, n_items, items, contaminated) of each row of ``docs``."""
    blocks = _pattern_blocks(benchmark, item_col, item_text_col, window, block_bytes)
    first, second = next(blocks, None) or item_patterns([], window), next(blocks, None)
    if second is None:
        got = _searched(docs, first, keep, text_col)
    else:
        numbered = stored(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")).withColumn("row", F.monotonically_increasing_id()), "numbered")
        flat = numbered.select("row", F.col(f"own.`{text_col}`").alias("text"))
        whole = stored(_searched(flat, first, ["row"], "text").select("doc.row", "n_words", "hit", "items"), "hits")
        parts = [whole.where("size(items) > 0 or length(hit) > 0").select("row", "hit", "items")]
        more = second
        while more is not None:
            block = _searched(flat, more, ["row"], "text").where("size(items) > 0 or length(hit) > 0")
            parts.append(stored(block.select("doc.row", "hit", "items"), "hits"))
            more = next(blocks, None)
        doc = numbered.select("row", F.struct(*[F.col(f"own.`{c}`") for c in keep]).alias("doc"))
        got = doc.join(whole.select("row", "n_words"), "row").join(_merged(parts), "row", "left").withColumns({"hit": F.coalesce("hit", F.lit(b"")), "items": F.coalesce("items", F.array().cast("array<string>"))})
    n_hit = F.length("hit").cast("long") / F.lit(4)
    return got.select("doc", "n_words", n_hit.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items").withColumn("contaminated", F.expr(f"n_hit > 0 and {SHARE} * n_hit >= n_words"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns."""
    return found(docs, benchmark, docs.columns, **options).where("not contaminated").select("doc.*")


def op4_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of all documents."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    got = found(docs, items, ["doc_id"])
    return got.select("doc.doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: The contract's rule for DuckDB: every window of either side, compared.
OP4_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS ws FROM documents),
i AS (SELECT item_id, {_SQL_WORDS} AS ws FROM benchmark),
pat AS (SELECT DISTINCT item_id, list_slice(ws, k, k + {WINDOW - 1}) AS win, least(len(ws), {WINDOW}) AS n
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - {WINDOW - 2}, 2))) AS k FROM i WHERE len(ws) > 0)),
dw AS (SELECT r, n, k, list_slice(ws, k, k + n - 1) AS win
  FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM pat) WHERE len(ws) >= n)),
m AS (SELECT r, item_id, k, pat.n FROM dw JOIN pat ON dw.win = pat.win),
h AS (SELECT r, count(DISTINCT w) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS w FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM m WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND {SHARE} * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
