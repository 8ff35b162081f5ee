"""Deletion of runs of lines that occurred before, found by winnowing.

A line with a word is known by the hash of its words.  A *window* is the shortest
run of lines from a given line on that has ``min_words`` words; the line with the
least hash in it (the last of equals) is its fingerprint.  Windows depend on their
text alone, so every repeated run of ``min_words`` words or more has the same
fingerprints wherever it stands.

Fingerprints found once in the corpus can't lie in repeated windows; they drop out.
The positions of each other fingerprint are joined with its first one (lower doc_id, then
lower line), and each match is extended both ways, line by line, through the lines of all
windows that have this fingerprint.  The run it grows to is deleted if it has
``min_words`` words; its first occurrence stays, and runs that overlap are one.

A window that isn't within its match with the first position may still equal one at a
position between: these windows alone are compared by their hashes, each with its first
occurrence.  Together this is exact: a line goes if and only if it lies in a run of
``min_words`` words or more that occurred earlier.  No pairs of documents are formed: a
passage in n documents costs n rows a fingerprint, joined with one.

Defined results: lines without words match nothing and stay; null text stays
null; ids are whole numbers, and an id of text that is none is an error; null doc_ids come last and count as one position; rows that share doc_id
and text are treated alike, so a run at the same line of both is not a repeat; a
document may lose all its lines and is then empty; very long texts are taken whole;
further columns pass through, whatever their names; an empty table gives none.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coppice.llm.storage import mapped, stored
from coppice.llm.textscan import SpanHash, mix, texts

MIN_WORDS = 50
_KEY = "doc_id long, text_hash long"


def worded(text: bytes) -> list[tuple[int, list[bytes]]]:
    """Place and words of each line that has a word."""
    return [(i, w) for i, line in enumerate(text.split(b"\n")) if (w := line.split())]


def window_ends(words: np.ndarray, min_words: int) -> np.ndarray:
    """End (exclusive) of the window from each line on; past the last line if there aren't enough words."""
    upto = np.concatenate(([0], np.cumsum(words)))
    ends = np.searchsorted(upto, upto[:-1] + min_words)
    return ends


def winnowed(low: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Place of the least hash of each whole window, the last of equals; -1 where there is no whole window."""
    n = len(low)
    out = np.full(n, -1, np.int64)
    hashes, queue, high = low.tolist(), deque(), 0
    for i, end in enumerate(ends.tolist()):
        if end > n:
            break
        while high < end:
            while queue and hashes[queue[-1]] >= hashes[high]:
                queue.pop()
            queue.append(high)
            high += 1
        while queue[0] < i:
            queue.popleft()
        out[i] = queue[0]
    return out


class _RunHash:
    """128-bit hashes of runs of lines."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        SpanHash(np.zeros(n, np.uint8))  # makes powers for n places
        self.sums = [np.concatenate(([np.uint64(0)], np.cumsum(mix(hashes[:, k]) * SpanHash._powers[:n]))) for k in (0, 1)]

    def of(self, begin: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        return [mix((s[end] - s[begin]) * SpanHash._inverse[begin] + (end - begin).astype(np.uint64)).view(np.int64) for s in self.sums]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _lines(keyed: DataFrame) -> DataFrame:
    """(doc_id, text_hash, hashes: 16 bytes a line, words, places) of documents with a worded line."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for b in batches:
            out: list[list] = [[], [], []]
            for x in texts(b.column(2)):
                lines = worded(x)
                out[0].append(b"".join([digest(b" ".join(w)) for _, w in lines]))
                out[1].append(np.array([len(w) for _, w in lines], "<i4").tobytes())
                out[2].append(np.array([i for i, _ in lines], "<i4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(x, pa.binary()) for x in out]], names=["doc_id", "text_hash", "hashes", "words", "places"])

    return mapped(keyed, scan, f"{_KEY}, hashes binary, words binary, places binary")


def _fingerprints(lines: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, text_hash, fingerprint, n) of each document."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, found, often = [], [], []
            for i, (h, w) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                low = np.frombuffer(h, np.uint64)[::2]
                chosen = np.unique(winnowed(low, window_ends(np.frombuffer(w, "<i4"), min_words)))
                values, n = np.unique(low[chosen[chosen >= 0]], return_counts=True)
                row.append(np.full(len(values), i))
                found.append(values.view(np.int64))
                often.append(n)
            if row:
                at = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(np.concatenate(found)), pa.array(np.concatenate(often).astype(np.int64))], names=["doc_id", "text_hash", "fingerprint", "n"])

    return mapped(lines.select("doc_id", "text_hash", "hashes", "words"), scan, f"{_KEY}, fingerprint long, n long")


def _windows(words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the windows that begin at each line, and of the shortest runs of enough words that end at each."""
    n = len(words)
    ends = window_ends(words, min_words)
    upto = np.concatenate(([0], np.cumsum(words, dtype=np.int64)))
    back = np.searchsorted(upto, upto[1:] - min_words, "right") - 1
    first, last = np.flatnonzero(ends <= n), np.flatnonzero(back >= 0)
    both = np.unique(np.concatenate((first * (n + 1) + ends[first], back[last] * (n + 1) + last + 1)))
    return both // (n + 1), both % (n + 1)


_POSITION = "fingerprint long, at long, anchor int, starts int, hashes binary, words binary, places binary"


def _positions(candidates: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, text_hash, fingerprint, at: its line, and the lines of all windows that have it) for each place of a repeated fingerprint.

    anchor: the fingerprint among these lines; starts: how many of them windows begin at.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, out = [], [[] for _ in range(7)]
            for i, (h, w, p, repeated) in enumerate(zip(*(b.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True)):
                hashes, words, places = np.frombuffer(h, np.uint64).reshape(-1, 2), np.frombuffer(w, "<i4"), np.frombuffer(p, "<i4")
                chosen = winnowed(hashes[:, 0], window_ends(words, min_words))
                begin, end = _windows(words, min_words)
                far = np.zeros(len(words), np.int64)
                np.maximum.at(far, begin, end)
                known = np.isin(hashes[:, 0], np.array(repeated, np.int64).view(np.uint64))
                starts = np.flatnonzero((chosen >= 0) & known[np.maximum(chosen, 0)])
                if not len(starts):
                    continue
                # Windows that share a fingerprint begin at lines side by side.
                first = np.flatnonzero(np.diff(chosen[starts], prepend=-1))
                low, count = starts[first], np.diff(np.append(first, len(starts)))
                high, anchor = np.maximum.reduceat(far[starts], first), chosen[starts][first]
                row += [i] * len(first)
                out[0].append(hashes[anchor, 0].view(np.int64))
                out[1].append(places[anchor].astype(np.int64))
                out[2].append((anchor - low).astype(np.int32))
                out[3].append(count.astype(np.int32))
                for x, y in zip(low.tolist(), high.tolist(), strict=True):
                    out[4].append(hashes[x:y].tobytes())
                    out[5].append(words[x:y].tobytes())
                    out[6].append(places[x:y].tobytes())
            if row:
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *[pa.array(np.concatenate(x)) for x in out[:4]], *[pa.array(x, pa.binary()) for x in out[4:]]], names=names)

    names = ["doc_id", "text_hash", "fingerprint", "at", "anchor", "starts", "hashes", "words", "places"]
    return mapped(candidates, scan, f"{_KEY}, {_POSITION}")


def _alike(a: np.ndarray, b: np.ndarray) -> int:
    """How many lines are the same from the beginning on."""
    n = min(len(a), len(b))
    differ = np.flatnonzero((a[:n] != b[:n]).any(axis=1))
    return int(differ[0]) if len(differ) else n


def _extended(joined: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, text_hash, begin, end, w1, w2): the run each position shares with the first one, w1 and w2 null, and hashes of its windows that aren't within."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, out, whole = [], [[], [], [], []], []
            for i, (anchor, starts, h, w, p, first_anchor, first_h) in enumerate(zip(*(b.column(k).to_pylist() for k in range(2, 9)), strict=True)):
                own, words, places = np.frombuffer(h, np.uint64).reshape(-1, 2), np.frombuffer(w, "<i4"), np.frombuffer(p, "<i4").astype(np.int64)
                first = np.frombuffer(first_h, np.uint64).reshape(-1, 2)
                low = anchor - _alike(own[: anchor + 1][::-1], first[: first_anchor + 1][::-1]) + 1
                high = anchor + _alike(own[anchor:], first[first_anchor:])
                if high > low and words[low:high].sum() >= min_words:
                    row.append(i)
                    whole.append(True)
                    for k, x in enumerate((places[low], places[high - 1] + 1, 0, 0)):
                        out[k].append(np.array([x], np.int64))
                begin, end = _windows(words, min_words)
                rest = (begin < starts) & ((begin < low) | (end > high))
                if rest.any():
                    begin, end = begin[rest], end[rest]
                    row += [i] * len(begin)
                    whole += [False] * len(begin)
                    for k, x in enumerate((places[begin], places[end - 1] + 1, *_RunHash(own).of(begin, end))):
                        out[k].append(x)
            if row:
                at, none = pa.array(row), np.array(whole)
                values = [np.concatenate(x) for x in out]
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(values[0]), pa.array(values[1]), pa.array(values[2], mask=none), pa.array(values[3], mask=none)], names=["doc_id", "text_hash", "begin", "end", "w1", "w2"])

    columns = ["doc_id", "text_hash", "anchor", "starts", "hashes", "words", "places", "first_anchor", "first_hashes"]
    return mapped(joined.select(*columns), scan, f"{_KEY}, begin long, end long, w1 long, w2 long")


def _place(line: str) -> Column:
    """Where a line stands in the corpus, as one number."""
    return (F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1)).cast("decimal(19,0)") * F.lit(10**9).cast("decimal(10,0)") + F.col(line)).cast("decimal(38,0)")


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_hash, runs: array of (begin, end) places of lines to delete) of documents that lose lines."""
    lines = stored(_lines(_keyed(docs, id_col, text_col)), "lines")
    prints = stored(_fingerprints(lines, min_words), "line-fingerprints")
    # What is joined back is stored first, so the join deals out both sides itself and can split a frequent value.
    repeated = stored(prints.groupBy("fingerprint").agg(F.sum("n").alias("n")).where("n > 1").select("fingerprint"), "repeated")
    # Rows that share doc_id and text name one document here: it is flagged, and its lines are taken, once.
    flagged = prints.drop("n").join(repeated, "fingerprint").groupBy("doc_id", "text_hash").agg(F.collect_set("fingerprint").alias("repeated"))
    flagged = flagged.withColumnsRenamed({"doc_id": "of_doc", "text_hash": "of_text"})
    same = F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("text_hash") == F.col("of_text"))
    candidates = lines.join(flagged, same).select("doc_id", "text_hash", "hashes", "words", "places", "repeated")
    positions = stored(_positions(candidates, min_words).withColumn("place", _place("at")), "positions")
    first = positions.groupBy("fingerprint").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first < last").select("fingerprint", "first")
    # One row holds each first position; rows that share doc_id and text, or doc_id and line, give one of them.
    lines_of = positions.select(F.col("fingerprint").alias("of"), F.col("place").alias("first"), F.col("text_hash").alias("first_text"), F.col("anchor").alias("first_anchor"), F.col("hashes").alias("first_hashes"))
    firsts = stored(lines_of.join(first.withColumnRenamed("fingerprint", "of"), ["of", "first"]).groupBy("of", "first").agg(F.min(F.struct("first_text", "first_anchor", "first_hashes")).alias("x")).select("of", "first", "x.first_anchor", "x.first_hashes"), "first-positions")
    joined = positions.join(firsts, F.col("fingerprint") == F.col("of")).where("place > first")
    runs = stored(_extended(joined, min_words).withColumn("place", _place("begin")), "runs")
    rest = runs.where("w1 is not null")
    earlier = stored(rest.groupBy("w1", "w2").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first < last").drop("last"), "first-places")
    later = rest.join(earlier, ["w1", "w2"]).where("place > first")
    both = runs.where("w1 is null").select("doc_id", "text_hash", "begin", "end").unionByName(later.select("doc_id", "text_hash", "begin", "end"))
    return both.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("begin", "end")).alias("runs"))


def _without(text: bytes, runs: list[dict]) -> tuple[bytes, int, int]:
    """The text without the lines with words of its runs; how many lines and words went."""
    lines = text.split(b"\n")
    edge = np.zeros(len(lines) + 1, np.int64)
    for r in runs:
        edge[r["begin"]] += 1
        edge[r["end"]] -= 1
    inside = np.cumsum(edge)[:-1] > 0
    kept, gone, words = [], 0, 0
    for line, cut in zip(lines, inside.tolist(), strict=True):
        n = len(line.split()) if cut else 0
        if n:
            gone, words = gone + 1, words + n
        else:
            kept.append(line)
    return b"\n".join(kept), gone, words


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc: struct of all columns, text: without repeated runs, n_lines, n_removed_lines, n_removed_words) of each row."""
    runs = stored(repeated_runs(docs, id_col, text_col, min_words), "removed").withColumnsRenamed({"doc_id": "of_doc", "text_hash": "of_text"})
    text = F.col(f"`{text_col}`").cast("string")
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    own = docs.select(F.struct(*rest).alias("doc"), text.alias("text"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"))
    # Texts are dealt out at any size of the other side, which has a row a document at most and needs no sort.
    both = own.join(runs.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("text_hash") == F.col("of_text")), "left").select("doc", "text", "runs")
    fields = [T.StructField(c, T.LongType()) for c in ("n_lines", "n_removed_lines", "n_removed_words")]
    schema = T.StructType([both.schema["doc"], T.StructField("text", T.StringType()), *fields])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts_, counts = [], np.zeros((3, b.num_rows), np.int64)
            for i, (x, r) in enumerate(zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True)):
                counts[0, i] = x.count(b"\n") + 1 if x else 0
                if r:
                    x, counts[1, i], counts[2, i] = _without(x, r)
                texts_.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts_, pa.binary()).cast(pa.string()), *map(pa.array, counts)], names=schema.names)

    return mapped(both, scan, schema)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the repeated runs deleted from its texts; ``length_col``: set to the new text's characters."""
    done = deduplicated(docs, id_col, text_col, min_words)
    new = {text_col: F.col("text")} | ({length_col: F.length("text").cast(docs.schema[length_col].dataType)} if length_col else {})
    return done.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed_lines, n_removed_words and the text that stays, of all documents."""
    done = deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc.doc_id", "n_lines", "n_removed_lines", "n_removed_words", "text")


#: The same rule for DuckDB: all shortest runs from and up to each line, and where each stood first.
OP3_SQL = f"""
WITH l AS (SELECT doc_id, i - 1 AS place, lines[i] AS line, regexp_extract_all(lines[i], '[^\\x20\\x09-\\x0D]+') AS ws
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))),
w AS (SELECT doc_id, place, array_to_string(ws, ' ') AS line, len(ws) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS k,
  sum(len(ws)) OVER (PARTITION BY doc_id ORDER BY place) AS upto FROM l WHERE len(ws) > 0),
fwd AS (SELECT a.doc_id, a.k AS lo, min(b.k) AS hi FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.k >= a.k AND b.upto - a.upto + a.n >= {MIN_WORDS} GROUP BY ALL),
bwd AS (SELECT b.doc_id, max(a.k) AS lo, b.k AS hi FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.k >= a.k AND b.upto - a.upto + a.n >= {MIN_WORDS} GROUP BY ALL),
runs AS (SELECT * FROM fwd UNION SELECT * FROM bwd),
doc AS (SELECT doc_id, list(line ORDER BY k) AS lines, list(place ORDER BY k) AS places FROM w GROUP BY doc_id),
r AS (SELECT doc_id, places[lo] AS b, places[hi] AS e, list_slice(lines, lo, hi) AS content FROM runs JOIN doc USING (doc_id)),
later AS (SELECT doc_id, b, e FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, b) AS nth FROM r) WHERE nth > 1),
gone AS (SELECT DISTINCT w.doc_id, w.place, w.n FROM w JOIN later ON w.doc_id = later.doc_id AND place BETWEEN b AND e),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY place) AS text FROM l ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n_removed_lines, sum(n)::BIGINT AS n_removed_words FROM gone GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN coalesce(d.text, '') = '' THEN 0 ELSE len(string_split(d.text, chr(10))) END::BIGINT AS n_lines, coalesce(n_removed_lines, 0) AS n_removed_lines,
  coalesce(n_removed_words, 0) AS n_removed_words, CASE WHEN d.text IS NOT NULL THEN coalesce(kept.text, '') END AS text
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN g ON g.doc_id = d.doc_id
"""
