"""Language identification by mixture inference.

Training counts hashed byte 4-grams of letters per language over all labelled
documents outside the held-out fold.  A document is a mixture of languages: each of
its n-grams comes from language l with probability pi_l, then has that language's
likelihood.  The language set is chosen by penalised likelihood: it starts with the best
single language and takes in, one at a time, the language by which the likelihood rises
fastest; expectation-maximisation estimates the shares of each set until they have
settled.  A further language costs ``PENALTY`` times the logarithm of the number of
n-grams, and the set grows for as long as it is worth that.  (The likelihood is concave
in the shares, so its slope towards a language bounds all that could be gained: most
documents are settled without a second set.)  The prediction is the language with the
largest share in the chosen set, the score that share; all shares are returned as well.

Only the text is used for a prediction.  The model is one table of 64 MB at most:
the number of hash buckets shrinks as the number of languages grows.

Defined results: null text, or text without a letter, is ``und`` with score 0, as
is all text if no language was learned; null doc_ids are not learned from and not
held out; null lang is not learned from; repeated rows count each time; very long texts
are counted whole; ties go to the language that sorts first; columns kept pass through a
struct, whatever their names; empty tables give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coppice.llm.storage import mapped, small_rows
from coppice.llm.textscan import passes, texts

UNDETERMINED = "und"
FOLDS, HELD_OUT = 4, 2
GRAM = 4
MODEL_BYTES = 64 << 20
MOST_LANGUAGES = 4096
SMOOTHING = 0.5
PENALTY = 3.0
#: Shares have settled when a round raises the log-likelihood by less than this.
SETTLED = 1e-3

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_GAP = b" " * GRAM


def buckets_for(languages: int) -> int:
    """log2 of the number of hash buckets."""
    return min(16, max(8, (MODEL_BYTES // (4 * max(1, languages))).bit_length() - 1))


def has_letter(text: bytes) -> bool:
    if any(a <= c <= b for a, b in ((65, 90), (97, 122)) for c in text[:64]):
        return True
    return any(c.isalpha() for c in text.decode())


def _grams(buf: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the n-grams with a letter and their buckets."""
    folded = _FOLD[buf]
    value = np.ndarray(len(folded) - GRAM + 1, "<u4", folded, strides=(1,))
    place = np.flatnonzero(value != 0x20202020)
    return place, ((value[place] * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits))


def gram_counts(rows: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and count of the distinct buckets of each row, in order of rows."""
    at, found, often = [], [], []
    size = 1 << bits
    for low, high in passes(rows, 1 << 20):
        whole = _GAP + _GAP.join(rows[low:high]) + _GAP
        if high - low == 1 and len(whole) > 1 << 21:
            sums = np.zeros(size, np.int64)
            for i in range(0, len(whole) - GRAM + 1, 1 << 20):
                sums += np.bincount(_grams(np.frombuffer(whole[i : i + (1 << 20) + GRAM - 1], np.uint8), bits)[1], minlength=size)
            bucket = np.flatnonzero(sums)
            at.append(np.full(len(bucket), low))
            found.append(bucket)
            often.append(sums[bucket])
            continue
        place, bucket = _grams(np.frombuffer(whole, np.uint8), bits)
        begins = np.cumsum([0, *[len(x) + GRAM for x in rows[low : high - 1]]])
        row = np.searchsorted(begins, place, "right") - 1
        # A gap is as wide as an n-gram: none reaches letters of two rows.
        if (high - low) << bits < 1 << 32:
            key = (row.astype(np.uint32) << np.uint32(bits)) | bucket
        else:
            key = (row.astype(np.uint64) << np.uint64(bits)) | bucket
        key, n = np.unique(key, return_counts=True)
        at.append((key >> key.dtype.type(bits)).astype(np.int64) + low)
        found.append((key & key.dtype.type(size - 1)).astype(np.int64))
        often.append(n)
    join = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
    return join(at), join(found), join(often)


class Mixture:
    """Likelihoods of buckets per language, and inference over them."""

    def __init__(self, languages: list[str], likelihood: np.ndarray):
        self.languages, self.of_bucket = languages, np.ascontiguousarray(likelihood.T)  # bucket x language
        self.bits = likelihood.shape[1].bit_length() - 1

    def _em(self, p: np.ndarray, n: np.ndarray, lengths: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Settled shares from ``share`` (document x language; 0: not in the set), and the log-likelihoods.

        p: likelihoods (n-gram x language) and n: counts, document after document, ``lengths`` n-grams each.
        """
        share, found = share.copy(), np.full(len(lengths), -np.inf)
        live = np.arange(len(lengths))
        while len(live):
            begins, row = np.cumsum(lengths) - lengths, np.repeat(np.arange(len(live)), lengths)
            part = p * share[live][row]
            mixed = part.sum(axis=1)
            fit = np.add.reduceat(n * np.log(mixed), begins)
            going = fit - found[live] >= SETTLED
            found[live] = fit
            part *= (n / mixed)[:, None]
            new = np.add.reduceat(part, begins, axis=0)
            share[live[going]] = (new / new.sum(axis=1, keepdims=True))[going]
            if not going.all():
                inside = going[row]
                p, n, lengths, live = p[inside], n[inside], lengths[going], live[going]
        return share, found

    def __call__(self, rows: list[bytes]) -> np.ndarray:
        """Share of each language in each row; all zero where there is none."""
        out = np.zeros((len(rows), len(self.languages)))
        if not self.languages:
            return out
        limit = max(1 << 16, (1 << 22) // len(self.languages))
        for low, high in passes(rows, limit):
            at, bucket, n = gram_counts(rows[low:high], self.bits)
            if len(at):
                begins = np.flatnonzero(np.diff(at, prepend=-1))
                out[low + at[begins]] = self._infer(bucket, n.astype(np.float64), np.diff(np.append(begins, len(n))))
        for i in np.flatnonzero(out.any(axis=1)).tolist():
            if not has_letter(rows[i]):
                out[i] = 0
        return out

    def _infer(self, bucket: np.ndarray, n: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        p = self.of_bucket[bucket].astype(np.float64)
        docs, size = len(lengths), len(self.languages)
        begins = np.cumsum(lengths) - lengths
        logs = np.add.reduceat(np.log(p) * n[:, None], begins, axis=0)
        best = logs.argmax(axis=1)
        out = np.zeros((docs, size))
        out[np.arange(docs), best] = 1
        total = np.add.reduceat(n, begins)
        cost, value = PENALTY * np.log(1 + total), logs.max(axis=1)
        live = np.arange(docs)
        while len(live):  # of each document that may still gain, p, n and lengths hold its n-grams
            begins, row = np.cumsum(lengths) - lengths, np.repeat(np.arange(len(live)), lengths)
            mixed = np.einsum("ij,ij->i", p, out[live][row])
            slope = np.add.reduceat(p * (n / mixed)[:, None], begins, axis=0) - total[live][:, None]
            slope[out[live] > 0] = -np.inf
            may = slope.max(axis=1) > cost[live]
            if not may.all():
                inside = may[row]
                p, n, lengths, live, slope = p[inside], n[inside], lengths[may], live[may], slope[may]
            if not len(live):
                break
            start, more = out[live].copy(), slope.argmax(axis=1)
            share_of_new = 1 / (1 + (start > 0).sum(axis=1))
            start *= (1 - share_of_new)[:, None]
            start[np.arange(len(live)), more] = share_of_new
            share, fit = self._em(p, n, lengths, start)
            better = fit - value[live] > cost[live]
            out[live[better]], value[live[better]] = share[better], fit[better]
            inside = better[np.repeat(np.arange(len(live)), lengths)]
            p, n, lengths, live = p[inside], n[inside], lengths[better], live[better]
        return out


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD_OUT


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Mixture:
    """Learn every non-null language of ``docs`` from all its texts."""
    labelled = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    languages = sorted(r.lang for r in small_rows(labelled.select("lang").distinct(), MOST_LANGUAGES, "languages"))
    bits = buckets_for(len(languages))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            lang, rows = np.array(b.column(0).to_pylist(), object), texts(b.column(1))
            for name in sorted(set(lang)):
                own = [rows[i] for i in np.flatnonzero(lang == name).tolist()]
                _, bucket, n = gram_counts(own, bits)
                sums[name] = sums.get(name, 0) + np.bincount(bucket, weights=n, minlength=1 << bits).astype(np.int64)
        for name, n in sums.items():
            met = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(met), pa.string()), pa.array(met.astype(np.int32)), pa.array(n[met])], names=["lang", "bucket", "n"])

    counted = mapped(labelled, scan, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros((len(languages), 1 << bits))
    if languages:
        found = counted.toPandas()  # at most one row for each cell of the model
        counts[np.searchsorted(np.array(languages, object), found["lang"].to_numpy()), found["bucket"].to_numpy()] = found["n"].to_numpy()
    counts += SMOOTHING
    return Mixture(languages, (counts / counts.sum(axis=1, keepdims=True)).astype(np.float32))


def predicted(docs: DataFrame, model: Mixture, keep: list[str], text_col: str = "text") -> DataFrame:
    """(doc: struct of ``keep``, lang_pred, score, shares: array of (lang, share), largest first) of each row."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # MODEL_BYTES at most
    schema = T._parse_datatype_string("lang_pred string, score double, shares array<struct<lang: string, share: double>>")
    schema = T.StructType([own.schema["doc"], *schema.fields])
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            share = np.minimum(model(texts(b.column(1))), 1.0)
            order = np.argsort(-share, axis=1, kind="stable")
            found = [[{"lang": model.languages[k], "share": float(s[k])} for k in o.tolist() if s[k] > 0] for o, s in zip(order, share, strict=True)]
            first = [x[0] if x else {"lang": UNDETERMINED, "share": 0.0} for x in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x["lang"] for x in first], pa.string()), pa.array([x["share"] for x in first], pa.float64()), pa.array(found, kind)], names=schema.names)

    return mapped(own, scan, schema)


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, shares of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out()))
    got = predicted(docs, model, ["doc_id"]).select("doc.doc_id", "lang_pred", "score", "shares")
    return got.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "shares")
