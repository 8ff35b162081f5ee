"""Fill-in-middle: some texts are cut in three at unit ends and written with the middle last.

A unit is a word with the white space before it, or white space at the end of a text.
``regex.finditer`` gives the end of each unit, kept as a compact array of code point
offsets; a cut after so many units is then one lookup, and a text is sliced twice.  The
sha256 of the seed and the row's id decides form and cuts, so a row's result depends on
nothing but itself and is the same on every run.

Forms: *plain*, the text; *psm*, ``<P>`` prefix ``<S>`` suffix ``<M>`` middle; *spm*, ``<S>``
suffix ``<P>`` prefix ``<M>`` middle.  Texts that hold a mark stay plain, so that what was
written can be told apart again (``restored``).

Defined results: a null text is the empty one; an empty text has no units and stays
plain; a null id counts as the empty string in the seed; rows with equal ids are cut at
equal draws, each on its own text; prefix, middle or suffix may be empty; an empty table
gives no rows; all columns to keep travel in a struct, so their names can't clash; ids of
any type go by their text.  Texts are cut whole, whatever their length: memory is a batch
(see ``storage.BATCH_BYTES``) or the longest text, and four bytes a unit of one text.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from operator import methodcaller

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.llm.storage import bounded_batches

#: Fixed values of the contract: a unit, the marks, the share of texts to cut and of those to write suffix first.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
MARKS = ("<P>", "<S>", "<M>")
SEED, CUT_PERCENT, SUFFIX_FIRST_PERCENT = 42, 50, 80

_ENDS = regex.compile(UNIT)
_END = methodcaller("end")
_CUT = "n long, form string, prefix_chars long, middle_chars long, output string"


def unit_ends(text: str) -> array:
    """Where each unit of a text ends, in code points."""
    return array("I", map(_END, _ENDS.finditer(text)))


def draws(seed: int, name: str) -> list[int]:
    """The four whole numbers that decide a row."""
    digest = hashlib.sha256(f"{seed}:{name}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


def cut(text: str, name: str, seed: int = SEED, cut_percent: int = CUT_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text; name: its row's id as text."""
    ends = unit_ends(text)
    n = len(ends)
    h1, h2, h3, h4 = draws(seed, name)
    if not text or h3 % 100 >= cut_percent or any(m in text for m in MARKS):
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (low, high))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = MARKS
    if h4 % 100 < suffix_first_percent:
        return n, "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"


def rebuilt(output: str, form: str) -> str:
    """The text that was written as ``output``; marks stand once each, as texts that hold one stay plain."""
    if form == "plain":
        return output
    first, second = (MARKS[0], MARKS[1]) if form == "psm" else (MARKS[1], MARKS[0])
    one, rest = output.removeprefix(first).split(second, 1)
    two, middle = rest.split(MARKS[2], 1)
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return prefix + middle + suffix


def fill_in_middle(docs: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, cut_percent: int = CUT_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT) -> DataFrame:
    """(doc: struct of ``keep``, n units, form, prefix_chars, middle_chars, output) of each row.  No shuffle."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf(_CUT)
    def written(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, name in batches:
            rows = [cut(t or "", "" if i is None else i, seed, cut_percent, suffix_first_percent) for t, i in zip(text, name, strict=True)]
            yield pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"], dtype=object)

    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{id_col}`").cast("string").alias("name"))
    return own.select("doc", written("text", "name").alias("x")).select("doc", "x.*")


def restored(done: DataFrame) -> DataFrame:
    """``done`` with ``text``, rebuilt from nothing but output and form."""
    bounded_batches(done.sparkSession)

    @F.pandas_udf("string")
    def again(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for output, form in batches:
            yield pd.Series([rebuilt(o, f) for o, f in zip(output, form, strict=True)], dtype=object)

    return done.withColumn("text", again("output", "form"))


def digests(done: DataFrame) -> DataFrame:
    """``done`` with the sha256 of its output and of the text rebuilt from output and form."""
    bounded_batches(done.sparkSession)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()

    @F.pandas_udf("output_sha256 string, restored_sha256 string")
    def hashed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for output, form in batches:
            yield pd.DataFrame([(sha(o), sha(rebuilt(o, f))) for o, f in zip(output, form, strict=True)], columns=["output_sha256", "restored_sha256"], dtype=object)

    return done.withColumn("_h", hashed("output", "form")).select(*done.columns, "_h.*")


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the digests of output and rebuilt text, of all documents."""
    done = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    return digests(done).select("doc.doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


#: The same for DuckDB, with the units as a list of texts.
OP12_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{UNIT}') AS units, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
e AS (SELECT *, len(units) AS n, [('0x' || substr(h, 8 * i + 1, 8))::BIGINT FOR i IN range(4)] AS hs FROM d),
f AS (SELECT *, least(hs[1] % (n + 1), hs[2] % (n + 1)) AS a, greatest(hs[1] % (n + 1), hs[2] % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR hs[3] % 100 >= {CUT_PERCENT} THEN 'plain' WHEN hs[4] % 100 < {SUFFIX_FIRST_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM e),
g AS (SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS prefix, coalesce(array_to_string(units[a + 1:b], ''), '') AS middle, coalesce(array_to_string(units[b + 1:n], ''), '') AS suffix FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM g
"""
