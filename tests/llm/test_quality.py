import random
import re
from collections import Counter

import duckdb

from coppice.llm import quality
from coppice.llm.quality import COUNTS, filtered, judged, text_counts, with_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": sum(x in lines[:i] for i, x in enumerate(lines)),
        "n_repeat_words": len(hit), "n_lines": len(lines), "n_upper": len(re.findall("[A-Z]", text)), "n_letters": len(re.findall("[A-Za-z]", text)), "n_echoes": sum(a == b for a, b in zip(words, words[1:], strict=False)),
    }


TEXTS = ["", " ", "\n\n", "a", "a b c d e f g h", "a b c d e f g h " * 2, "x x x x x x x x x x", "é ü #*$%&|<> \x1c\x0b|\n|\n |\n", "l1 w\nl2\nl1 w\n l1 w\n\n\nl2", "Ab " * 5000, "q" * 9_000_000, None]


def test_counts_are_the_plain_ones():
    got = text_counts([(t or "").encode() for t in TEXTS])
    for i, t in enumerate(TEXTS):
        assert {k: int(v[i]) for k, v in got.items()} == plain(t)


def rows():
    clean = [(i, " ".join(f"word{(i * 7 + k * 13) % 211}" for k in range(40 + i % 9)), "en", f"s{i % 2}") for i in range(400)]
    odd = [(1000, " ".join(f"word{k}###" for k in range(60)), "en", "s0"), (1001, " ".join(f"WORD{k}" for k in range(60)), "en", "s1"), (1002, "short", "en", "s1"), (1003, None, None, None), (1004, "", "xx", None), (1004, "", "xx", None)]
    return clean + odd


def test_odd_rows_go_and_clean_rows_stay(spark):
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows()], "doc_id long, text string, lang string, source string, n_words int, kept string")
    kept = filtered(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == list(range(400))


def test_sql_gives_the_same(spark, tmp_path):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = quality.op9_quality_rules(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(quality.OP9_SQL)
    names = [c[0] for c in want.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())


def test_thresholds_follow_the_group(spark):
    """Code has symbols and prose has none: each is judged by its own kind, and a small source by its language."""
    rng = random.Random(1)
    prose = [(i, " ".join(f"word{(i * 7 + k * 13) % 211}" for k in range(60)), "en", "prose") for i in range(300)]
    code = [(1000 + i, " ".join(f"word{(i + k) % 97}" + ("*" if k % 3 else "") for k in range(60 + i % 5)), "en", "code") for i in range(300)]
    few = [(2000, code[0][1], "en", "tiny"), (2001, prose[0][1], "en", "tiny")]
    few += [(2002, " ".join([prose[0][1]] + [f"word{rng.randrange(211)}" for _ in range(3000)]) + " 5% of $3 * 7 & 8 | 9", "en", "prose")]  # a long text isn't held to rates that short ones can't show
    odd = [(3000, code[0][1], "en", "prose"), (3001, " ".join(f"word{k}**********" for k in range(60)), "en", "code")]
    docs = spark.createDataFrame(prose + code + few + odd, "doc_id long, text string, lang string, source string")
    assert {r.doc_id for r in filtered(docs).collect()} == {r[0] for r in prose + code + few}


def test_every_threshold_is_a_learned_one(spark):
    """On the test tables no constant decides: a threshold is what the quartiles of its group, drawn to its language, give."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    counted = with_counts(docs, ["doc_id"]).cache()
    got = {(r.lang, r.source): r for r in quality.thresholds(quality.sketches(counted)).collect()}
    rows = counted.where(~quality.base_failed()).collect()
    bin_ = lambda v: v >> max(v.bit_length() - 7, 0) << max(v.bit_length() - 7, 0)
    quart = lambda vs: [sorted(vs)[-(-k * len(vs) // 4) - 1] for k in (1, 2, 3)]
    drawn = lambda n, own, wide: [(n * a + quality.PRIOR_ROWS * b) // (n + quality.PRIOR_ROWS) for a, b in zip(own, wide, strict=True)]
    for m, (top, bottom, scale, _, _) in quality.MEASURES.items():
        value = lambda r: bin_(scale * r[top] // max(r[bottom], 1))
        wide = quart([value(r) for r in rows])
        for (lang, source), f in got.items():
            in_lang, own = ([value(r) for r in rows if r.lang == lang and (s is None or r.source == s)] for s in (None, source))
            q1, q2, q3 = drawn(len(own), quart(own), drawn(len(in_lang), quart(in_lang), wide))
            assert (f[f"high_{m}"], f[f"low_{m}"]) == (q3 + quality.REACH * (q3 - q2), max(0, q1 - quality.REACH * (q2 - q1)))
    counted.unpersist()


def test_clean_documents_stay(spark):
    """Labelled good documents that pass the base rules: at least 99 in 100 are kept, and junk goes."""
    sf = "/root/testdata/sf0.01"
    got = quality.op9_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").collect()
    good, bad = ([r.kept for r in got if r.quality == q] for q in (1, 0))
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.05 * len(bad)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert judged(with_counts(docs, ["doc_id"])).count() == 0
    assert set(COUNTS) <= set(judged(with_counts(docs, ["doc_id"])).columns)
