"""URL filtering by rules, then by logistic regression on hashed character n-grams.

Rules come first: a rule names a host, which also stands for its subdomains, and
the beginning of a path; of the rules that fit, the longest gives the verdict.
Other URLs are scored by a model over n-grams of 3 to 5 bytes of host and of path,
hashed into ``BUCKETS`` weights and scaled to unit length per field.  The model is
trained on the driver from a small labelled table (at most ``MOST_LABELLED`` rows,
a parameter); it is of fixed size and sent to the executors.

Defined results: very long urls are scored whole; further columns pass through a struct,
whatever their names; a null url, or one without ``://``, has empty host and path and
gets the model's verdict for them, allow; equal rules are one, and of rules equally
long the first wins; repeated rows are judged alike; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coppice.llm.storage import mapped
from coppice.llm.textscan import mix, texts

BUCKETS = 1 << 14
GRAMS = (3, 4, 5)
MOST_LABELLED = 10_000
#: Probability from which a URL is blocked.
THRESHOLD = 0.4
_FIELD_SEED = (0x51ED270B, 0x2545F491)

#: Verdict, then host and beginning of path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

#: Ordinary and unwanted site names, by the subjects that public block lists and directories sort sites by.
UNWANTED = (
    "casino-royale online-casino casinos poker-room pokerstars-club slots-bonus slot-machines roulette-online sports-betting betting-tips bets-online bookmaker lottery-jackpot jackpot-winner win-money big-win prize-winner "
    "pharmacy-discount online-pharmacy buy-viagra viagra cialis-generic diet-pills pills-online pillstore weight-loss-pills cheap-meds cheap-replica cheap-watches replica-watches "
    "payday-loans loans-today quick-cash credit-repair free-money get-rich free-gift freebies-now free-download warez-download crack-serial keygen-cracks torrent-movies "
    "xxx-videos xxx porn-tube pornhub-free adult-dating adult-movies adult-shop sex-chat sexcams cam-girls escort-service "
    "adserver ads ad-banner popup-ads ads-network ads-server click-tracker tracker track-pixel tracking-pixel trackers click-ads spam spam-links link-spam seo-spam link-farm content-farm link-exchange"
).split()
ORDINARY = (
    "news daily-news weather library museum university college school kindergarten teachers students science research physics history archive encyclopedia dictionary language "
    "recipes cooking kitchen gardening garden flowers nature birds wildlife forest mountains rivers ocean beach hiking walking cycling running swimming football tennis winter-sports track-and-field adventure "
    "music orchestra choir theatre cinema film photography painting gallery design architecture books bookshop poetry writing reading stories magazine press freedom-press radio television "
    "travel hotel airport trains station bus maps city city-guide town-hall council parliament government ministry embassy police fire-brigade court law tax customs post "
    "health hospital clinic dentist doctor nursing family parents children youth seniors church charity volunteers community forum neighbours "
    "business economy market bank insurance accounting consulting engineering construction carpentry furniture windows-repair house-and-home better-homes energy water recycling organic-farm farmers "
    "software open-source programming documentation wiki database statistics mathematics alphabet astronomy chemistry biology geology medicine free-library "
    "zeitung nachrichten wetter bibliothek schule rathaus gesundheit verein musik kochen reisen musique cuisine voyage ecole mairie journal sante jardin noticias escuela ayuntamiento cocina viajes salud biblioteca"
).split()
#: Paths; none of them tells one kind of site from the other.
PATHS = ("/", "/en/1", "/de/about.html", "/fr/2020/05/item", "/es/archive/77/", "/en/search", "/index.html")


def labelled_urls() -> list[tuple[str, int]]:
    """A small labelled table: (url, 1 for sites of gambling, pills, adult content, advertising, tracking, spam and the like)."""
    out = [("", 0), ("http://example/", 0)]
    for unwanted, names in ((1, UNWANTED), (0, ORDINARY)):
        for i, name in enumerate(names):
            lead, tail = ("", "www.", "blog.", "m.")[i % 4], ("com", "org", "net")[i % 3]
            out.append((f"https://{lead}{name}.{tail}{PATHS[i % len(PATHS)]}", unwanted))
    return out


LABELLED = labelled_urls()


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), upper, upper.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*(/[^?#]*)", 1)


def _rest(url: Column) -> Column:
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))), F.lit(""))


class Rules:
    """Rules by host; looks a URL up by its host and each parent domain."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.of_host: dict[str, list[tuple[str, str]]] = {}
        for verdict, host, path in rules:
            self.of_host.setdefault(host, []).append((path, verdict))

    def __call__(self, host: str, path: str) -> tuple[str | None, str | None]:
        best, verdict, at = None, None, 0
        while True:
            name = host[at:]
            for begin, v in self.of_host.get(name, ()):
                if path.startswith(begin) and (best is None or len(name + begin) > len(best)):
                    best, verdict = name + begin, v
            dot = host.find(".", at)
            if dot < 0:
                return best, verdict
            at = dot + 1


def _hashed(rows: list[bytes], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of each n-gram; begin and end of a field are bytes of their own."""
    gap = b"\x00" * max(GRAMS)
    buf = np.frombuffer(gap.join([b"\x02" + x + b"\x03" for x in rows]) + gap + b"\x00" * 8, np.uint8)
    wide = np.ndarray(len(buf) - 7, "<u8", buf, strides=(1,))
    begins = np.cumsum([0, *[len(x) + 2 + len(gap) for x in rows[:-1]]])
    solid = np.concatenate(([0], np.cumsum(buf == 0)))
    at, found = [], []
    for n in GRAMS:
        place = np.flatnonzero(solid[n : n + len(wide)] == solid[: len(wide)])
        value = wide[place] & np.uint64((1 << 8 * n) - 1)
        at.append(np.searchsorted(begins, place, "right") - 1)
        found.append((mix(value + np.uint64(seed * n)) % np.uint64(BUCKETS)).astype(np.int64))
    return np.concatenate(at), np.concatenate(found)


def features(hosts: list[bytes], paths: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and value; each field's n-grams have length one together."""
    out = []
    for rows, seed in ((hosts, _FIELD_SEED[0]), (paths, _FIELD_SEED[1])):
        row, bucket = _hashed(rows, seed)
        size = np.sqrt(np.maximum(np.bincount(row, minlength=len(rows)), 1))
        out.append((row, bucket, 1 / size[row]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _split(url: str) -> tuple[bytes, bytes]:
    rest = url.partition("://")[2]
    cut = min([i for c in "/?#" if (i := rest.find(c)) >= 0], default=len(rest))
    path = rest[cut:]
    for c in "?#":
        path = path.partition(c)[0]
    return rest[:cut].encode().lower(), path.encode()


def train(labelled: list[tuple[str, int]], steps: int = 1500, rate: float = 4.0, decay: float = 1e-4) -> np.ndarray:
    """Weights, the last one the intercept, by gradient descent from zero over the whole table."""
    if len(labelled) > MOST_LABELLED:
        raise ValueError(f"over {MOST_LABELLED} labelled URLs")
    weights = np.zeros(BUCKETS + 1)
    if not labelled:
        return weights
    parts = [_split(u) for u, _ in labelled]
    row, bucket, value = features([h for h, _ in parts], [p for _, p in parts])
    wanted = np.array([y for _, y in labelled], float)
    n = len(labelled)
    weight = np.where(wanted == 1, 1 / max(1, wanted.sum()), 1 / max(1, n - wanted.sum())) / 2  # both kinds weigh the same
    for _ in range(steps):
        z = np.bincount(row, weights[bucket] * value, n) + weights[-1]
        error = (1 / (1 + np.exp(-z)) - wanted) * weight
        weights[:-1] -= rate * (np.bincount(bucket, error[row] * value, BUCKETS) + decay * weights[:-1])
        weights[-1] -= rate * error.sum()
    return weights


def scores(weights: np.ndarray, hosts: list[bytes], paths: list[bytes]) -> np.ndarray:
    """Probability that a URL is to be blocked."""
    if not hosts:
        return np.zeros(0)
    row, bucket, value = features(hosts, paths)
    return 1 / (1 + np.exp(-np.bincount(row, weights[bucket] * value, len(hosts)) - weights[-1]))


def judged(pages: DataFrame, keep: list[str], url_col: str = "url", rules: list[tuple[str, str, str]] = RULES, labelled: list[tuple[str, int]] = LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """(page: struct of ``keep``, host, path, rule, verdict, score) of each row."""
    url = F.col(f"`{url_col}`").cast("string")
    own = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("page"), host_of(url).alias("host"), path_of(url).alias("path"))
    sent = pages.sparkSession.sparkContext.broadcast((Rules(rules), train(labelled)))  # the rules, and BUCKETS weights
    schema = T.StructType([*own.schema.fields, *[T.StructField(c, T.StringType()) for c in ("rule", "verdict")], T.StructField("score", T.DoubleType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits, weights = sent.value
        for b in batches:
            score = np.concatenate([np.zeros(0), *[scores(weights, texts(b.column(1).slice(i, 2000)), texts(b.column(2).slice(i, 2000))) for i in range(0, b.num_rows, 2000)]])
            found = [fits(h, p) for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            verdict = [v or ("block" if s >= threshold else "allow") for (_, v), s in zip(found, score.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r for r, _ in found], pa.string()), pa.array(verdict, pa.string()), pa.array(score)], names=schema.names)

    return mapped(own, scan, schema)


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict, score of all pages."""
    found = judged(spark.read.parquet(f"{sf_dir}/pages.parquet"), ["page_id"])
    return found.select("page.page_id", "host", "path", "rule", "verdict", "score")
