"""Quality rules with thresholds learned from quantile sketches.

A document is judged by six measures, each a count for so many words, letters or
lines.  Their rates are sketched per (lang, source): a number of rows for each bin,
bins as wide as 1/64 of their value, so sketches merge by adding and a quantile is off
by 1/64 of itself at most.  The threshold of a measure is the group's upper quartile
and ``REACH`` times its distance from the median above it (for ``word_length`` also as
far below the lower quartile).  Up to a quarter of a group can be junk without moving it.
Where over three quarters of a group have none of what is counted its threshold is 0, and the
allowance below, ``ERRORS`` standard errors at the document's length, is what decides.

A group's quartiles are drawn towards those of its language by ``PRIOR_ROWS`` rows, and
the language's likewise towards those of all rows, so that small groups lean on large
ones by degrees and verdicts don't change at a certain size.

A document's rate varies by chance: it is rejected where the rate is more than ``ERRORS``
standard errors above the threshold (counts as those of a Poisson process; a repeat in
8-word windows comes in units of 16 words).  The error is that of its own length, but of
no more than the group's median length, which the sketches give as well: a group of short
documents can't tell smaller rates apart, so a long one isn't held to them.

Base rules come first and rejected rows don't enter the sketches: fewer than 20
words, or over 30 % of the words in repeated 8-word windows.

Defined results: null text counts as empty (and fails the base rules); null lang
or source is a group of its own; repeated rows are judged alike; ties at a threshold
are kept; very long texts are counted in full; an empty table gives an empty result;
further columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from coppice.llm.storage import mapped, stored
from coppice.llm.textscan import SPACE, SpanHash, column_of, joined, mix, passes, runs, texts

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # per cent of the words
REACH = 4
ERRORS = 4
PRIOR_ROWS = 100
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_echoes")
#: Measure: count, what it is counted in, scale of the rate, what one event adds to the count, whether low values are odd too.
MEASURES = {
    "symbols": ("n_symbols", "n_words", 10_000, 1, False),
    "upper": ("n_upper", "n_letters", 10_000, 1, False),
    "same_lines": ("n_dup_lines", "n_lines", 10_000, 1, False),
    "same_words": ("n_repeat_words", "n_words", 10_000, 2 * WINDOW, False),
    "echoes": ("n_echoes", "n_words", 10_000, 1, False),
    "word_length": ("word_chars", "n_words", 1_000, 1, True),
}

SIZES = tuple(dict.fromkeys(size for _, size, _, _, _ in MEASURES.values()))

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LETTER = _UPPER.copy()
_LETTER[0x61:0x7B] = True


def _line_counts(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them equal to an earlier line."""
    if b"\n" not in text:
        return int(bool(text) and not text.isspace()), 0
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines), len(lines) - len(set(lines))


def text_counts(rows: list[bytes]) -> dict[str, np.ndarray]:
    """COUNTS of each text."""
    out = {k: np.zeros(len(rows), np.int64) for k in COUNTS}
    for i, (n, same) in enumerate(map(_line_counts, rows)):
        out["n_lines"][i], out["n_dup_lines"][i] = n, same
    for low, high in passes(rows):
        buf, begins = joined(rows[low:high])
        n, own = high - low, slice(low, high)
        space = SPACE[buf]
        begin, end = runs(~space)
        doc = np.searchsorted(begins, begin, "right") - 1
        out["n_words"][own] = np.bincount(doc, minlength=n)
        for name, mask in (("word_chars", ~space & ((buf & 0xC0) != 0x80)), ("n_symbols", _SYMBOL[buf]), ("n_upper", _UPPER[buf]), ("n_letters", _LETTER[buf])):
            out[name][own] = np.add.reduceat(mask.view(np.uint8), begins[:-1], dtype=np.int64)
        if not len(begin):
            continue
        word = SpanHash(buf).of(begin, end)
        echo = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
        out["n_echoes"][own] = np.bincount(doc[1:][echo], minlength=n)
        if len(begin) < WINDOW:
            continue
        last = len(word) - WINDOW + 1
        key = np.zeros(last, np.uint64)
        for k in range(WINDOW):
            key = key * np.uint64(SpanHash.BASE) + word[k : k + last]
        whole = np.flatnonzero(doc[:last] == doc[WINDOW - 1 :])
        key = mix(key[whole] + mix(doc[whole].astype(np.uint64)))
        order = np.argsort(key)
        equal = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(key), bool)
        twice[order[1:][equal]] = twice[order[:-1][equal]] = True
        edge = np.zeros(len(word) + 1, np.int64)
        np.add.at(edge, whole[twice], 1)
        np.add.at(edge, whole[twice] + WINDOW, -1)
        out["n_repeat_words"][own] = np.bincount(doc, weights=np.cumsum(edge)[:-1] > 0, minlength=n).astype(np.int64)
    return out


def with_counts(docs: DataFrame, keep: list[str], text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc: struct of ``keep``, lang, source, then COUNTS) of each row."""
    inside = text_col in keep and docs.schema[text_col].dataType == T.StringType()  # then the text travels once
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), *([] if inside else [F.col(text_col).cast("string").alias("text")]))
    schema = T.StructType([*own.schema.fields[:3], *[T.StructField(c, T.LongType(), False) for c in COUNTS]])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = text_counts(texts(column_of(b, text_col, own=None if inside else 3)))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *[pa.array(counts[c]) for c in COUNTS]], names=schema.names)

    return mapped(own, scan, schema)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def measure(name: str) -> Column:
    top, bottom, scale, _, _ = MEASURES[name]
    return F.expr(f"({scale} * {top}) div greatest({bottom}, 1)")


def sketch_bin(value: Column) -> Column:
    """The least value of the bin: the seven leading bits."""
    cut = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, cut), cut)


def sketches(counted: DataFrame) -> DataFrame:
    """(lang, source, measure, bin, rows) of rows that pass the base rules; counts combine before the shuffle."""
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), measure(m).alias("v")) for m in MEASURES], *[F.struct(F.lit(c).alias("measure"), F.col(c).alias("v")) for c in SIZES]))
    return counted.where(~base_failed()).select("lang", "source", values.alias("x")).groupBy("lang", "source", F.col("x.measure").alias("measure"), sketch_bin(F.col("x.v")).alias("bin")).agg(F.count("*").alias("rows"))


def _quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, rows, q1, q2, q3) from sketches, merged by the keys."""
    by = Window.partitionBy(*keys, "measure")
    merged = sketch.groupBy(*keys, "measure", "bin").agg(F.sum("rows").alias("rows"))
    ranked = merged.withColumns({"upto": F.sum("rows").over(by.orderBy("bin")), "total": F.sum("rows").over(by)})
    at = [F.min(F.when(4 * F.col("upto") >= k * F.col("total"), F.col("bin"))).alias(f"q{k}") for k in (1, 2, 3)]
    return ranked.groupBy(*keys, "measure").agg(F.max("total").alias("rows"), *at)


def _drawn(own: DataFrame, parent: DataFrame, on: Column, prior_rows: int) -> DataFrame:
    """Quartiles of ``own`` as if the parent's had been met in ``prior_rows`` further rows."""
    wide = parent.select(*[F.col(c).alias(f"of_{c}") for c in parent.columns])
    drawn = {f"q{k}": F.expr(f"(rows * q{k} + {prior_rows} * of_q{k}) div (rows + {prior_rows})") for k in (1, 2, 3)}
    return own.join(wide, on & (F.col("measure") == F.col("of_measure"))).withColumns(drawn).select(*own.columns)


def thresholds(sketch: DataFrame, prior_rows: int = PRIOR_ROWS) -> DataFrame:
    """(lang, source, high_m and low_m of each measure, typical_c of each size) of each group of ``sketch``, a table that can be read again."""
    of_lang = _drawn(_quartiles(sketch, ["lang"]), _quartiles(sketch, []), F.lit(True), prior_rows)
    own = _drawn(_quartiles(sketch, ["lang", "source"]), of_lang, F.col("lang").eqNullSafe(F.col("of_lang")), prior_rows)
    out = []
    for name in MEASURES:
        here = F.col("measure") == name
        out.append(F.max(F.when(here, F.col("q3") + REACH * (F.col("q3") - F.col("q2")))).alias(f"high_{name}"))
        out.append(F.max(F.when(here, F.greatest(F.col("q1") - REACH * (F.col("q2") - F.col("q1")), F.lit(0)))).alias(f"low_{name}"))
    out += [F.max(F.when(F.col("measure") == c, F.col("q2"))).alias(f"typical_{c}") for c in SIZES]
    return own.groupBy("lang", "source").agg(*out)


def _beyond(name: str) -> str:
    """SQL, for both engines: whether a row's count is too far beyond its group's thresholds."""
    count, size, scale, unit, both = MEASURES[name]
    seen = f"greatest(least({size}, typical_{size}), 1)"
    due = {side: f"{side}_{name} * {seen} / {scale}" for side in ("high", "low")}
    slack = {side: f"{ERRORS} * sqrt({unit} * ({d} + {unit}))" for side, d in due.items()}
    above = f"{count} * {seen} > ({due['high']} + {slack['high']}) * {size}"
    return f"({above} OR {count} * {seen} < ({due['low']} - {slack['low']}) * {size})" if both else f"({above})"


def judged(counted: DataFrame, prior_rows: int = PRIOR_ROWS) -> DataFrame:
    """``counted`` (a table that can be read twice) with base_failed and kept."""
    fences = stored(thresholds(stored(sketches(counted), "sketches"), prior_rows), "thresholds")
    fences = fences.withColumnsRenamed({"lang": "of_lang", "source": "of_source"})
    odd = F.expr(" OR ".join(f"coalesce({_beyond(m)}, false)" for m in MEASURES))
    both = counted.join(fences, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left")
    return both.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~odd).select("doc", *COUNTS, "base_failed", "kept")


def filtered(docs: DataFrame, prior_rows: int = PRIOR_ROWS) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns."""
    counted = stored(with_counts(docs, docs.columns), "counted")
    return judged(counted, prior_rows).where("kept").select("doc.*")


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = judged(stored(with_counts(docs, ["doc_id"]), "counted"))
    return found.select("doc.doc_id", *COUNTS[:5], "base_failed", "kept")


_TOP = {m: f"({s} * {a}) // greatest({b}, 1)" for m, (a, b, s, _, _) in MEASURES.items()}
_BIN = "((v >> greatest(length(bin(v)) - 7, 0)) << greatest(length(bin(v)) - 7, 0))"


def _sql_quartiles(name: str, keys: str) -> str:
    on = f"{keys}, " if keys else ""
    at = ", ".join(f"min(CASE WHEN 4 * upto >= {k} * total THEN bin END) AS q{k}" for k in (1, 2, 3))
    return f"""{name} AS (SELECT {on}measure, max(total)::BIGINT AS rows, {at} FROM (SELECT *, sum(rows) OVER (PARTITION BY {on}measure ORDER BY bin) AS upto, sum(rows) OVER (PARTITION BY {on}measure) AS total
  FROM (SELECT {on}measure, bin, sum(rows) AS rows FROM sk GROUP BY ALL)) GROUP BY ALL)"""


def _sql_drawn(own: str, parent: str) -> str:
    return ", ".join(f"(({own}.rows * {own}.q{k} + {PRIOR_ROWS} * {parent}.q{k}) // ({own}.rows + {PRIOR_ROWS}))::BIGINT AS q{k}" for k in (1, 2, 3))


def _sql_pivot() -> str:
    sizes = ", ".join(f"max(CASE WHEN measure = '{c}' THEN q2 END) AS typical_{c}" for c in SIZES)
    return sizes + ", " + ", ".join(f"max(CASE WHEN measure = '{m}' THEN {e} END) AS {side}_{m}" for m in MEASURES for side, e in (("high", f"q3 + {REACH} * (q3 - q2)"), ("low", f"greatest(q1 - {REACH} * (q2 - q1), 0)")))


#: The same rules for DuckDB, from the texts on.
OP9_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
wi AS (SELECT r, list_slice(ws, i, i + {WINDOW - 1}) AS win, i FROM (SELECT r, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW})),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM wi) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest(range(0, {WINDOW})) AS k) GROUP BY r),
ln AS (SELECT r, line FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
lc AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM ln GROUP BY r),
m AS (SELECT d.r, doc_id, lang, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
  coalesce(n_lines, 0)::BIGINT AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_upper, length(regexp_replace(text, '[^A-Za-z]', '', 'g'))::BIGINT AS n_letters,
  len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1]))::BIGINT AS n_echoes
  FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN lc USING (r)),
b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed, {', '.join(f'{e} AS m_{k}' for k, e in _TOP.items())} FROM m),
vals AS (SELECT lang, source, measure, v::BIGINT AS v FROM ({' UNION ALL '.join(f"SELECT lang, source, '{k}' AS measure, m_{k} AS v FROM b WHERE NOT base_failed" for k in MEASURES)} UNION ALL {' UNION ALL '.join(f"SELECT lang, source, '{c}', {c} FROM b WHERE NOT base_failed" for c in SIZES)})),
sk AS (SELECT lang, source, measure, {_BIN} AS bin, count(*) AS rows FROM vals GROUP BY ALL),
{_sql_quartiles('qs', 'lang, source')},
{_sql_quartiles('ql', 'lang')},
{_sql_quartiles('qa', '')},
dl AS (SELECT ql.lang, measure, {_sql_drawn('ql', 'qa')} FROM ql JOIN qa USING (measure)),
ds AS (SELECT qs.lang, qs.source, qs.measure, {_sql_drawn('qs', 'dl')} FROM qs JOIN dl ON qs.lang IS NOT DISTINCT FROM dl.lang AND qs.measure = dl.measure),
f AS (SELECT lang, source, {_sql_pivot()} FROM ds GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ({' OR '.join(f'coalesce({_beyond(m)}, false)' for m in MEASURES)}) AS kept
FROM b LEFT JOIN f ON b.lang IS NOT DISTINCT FROM f.lang AND b.source IS NOT DISTINCT FROM f.source
"""
