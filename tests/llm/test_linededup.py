import random

import numpy as np

from coppice.llm.linededup import deduplicated, window_ends, winnowed, without_repeats


def plain(rows, least):
    """A line goes if it lies in a run of ``least`` words or more that also begins at an earlier place."""
    docs, runs = [], {}
    for doc_id, text in rows:
        lines = [(i, tuple(x.encode().split())) for i, x in enumerate((text or "").split("\n"))]
        docs.append([(i, w) for i, w in lines if w])
    order = lambda d, i: (d is None, d or 0, i)
    spans = []
    for (doc_id, _), lines in zip(rows, docs, strict=True):
        own = []
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                if sum(len(w) for _, w in lines[a : b + 1]) >= least:
                    content, at = tuple(w for _, w in lines[a : b + 1]), order(doc_id, lines[a][0])
                    own.append((a, b, content, at))
                    runs[content] = min(runs.get(content, at), at)
        spans.append(own)
    out = []
    for (doc_id, text), lines, own in zip(rows, docs, spans, strict=True):
        gone = {lines[k][0] for a, b, content, at in own if at > runs[content] for k in range(a, b + 1)}
        out.append((doc_id, None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone), len(gone)))
    return out


def rows():
    rng = random.Random(8)
    pool = [" ".join(f"w{rng.randrange(30)}" for _ in range(rng.choice((1, 2, 3, 7, 12)))) for _ in range(14)]
    out = []
    for i in range(60):
        lines = [rng.choice(pool) if rng.random() < 0.6 else f"own {i} {rng.random()}" for _ in range(rng.randrange(1, 12))]
        if rng.random() < 0.3:
            lines.insert(rng.randrange(len(lines)), rng.choice(("", "  ", "\t")))
        out.append((i, "\n".join(lines)))
    out += [(60, out[3][1]), (61, out[3][1].replace(" ", "  ")), (62, ""), (63, None), (None, out[5][1]), (None, out[5][1]), (64, out[9][1]), (64, out[9][1]), (65, "\n".join([pool[0]] * 40))]
    rng.shuffle(out)
    return out


def test_winnowing_keeps_the_last_least_hash():
    rng = np.random.default_rng(0)
    low, words = rng.integers(0, 6, 200).astype(np.uint64), rng.integers(1, 9, 200)
    ends = window_ends(words, 12)
    for i, got in enumerate(winnowed(low, ends)):
        if ends[i] > len(low):
            assert got == -1
        else:
            part = low[i : ends[i]]
            assert words[i : ends[i]].sum() >= 12 > words[i : ends[i] - 1].sum()
            assert got == i + max(np.flatnonzero(part == part.min()))


def test_deletions_are_those_of_the_definition(spark):
    data = rows()
    docs = spark.createDataFrame([(d, t, "q", 5) for d, t in data], "doc_id long, text string, runs string, begin int").repartition(3)
    for least in (12, 20):
        got = deduplicated(docs, min_words=least).select("doc.doc_id", "text", "n_removed_lines").collect()
        key = lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[2])
        assert sorted(map(tuple, got), key=key) == sorted(plain(data, least), key=key)


def test_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b\nc", 3, "x"), (2, "a b\nc", 3, "x")], "doc_id long, text string, n_chars long, doc string")
    got = without_repeats(docs, length_col="n_chars", min_words=3).orderBy("doc_id")
    assert got.columns == docs.columns and [tuple(r) for r in got.collect()] == [(1, "a b\nc", 5, "x"), (2, "", 0, "x")]
    assert without_repeats(docs.where("false")).count() == 0
