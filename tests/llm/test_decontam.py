import hashlib
import random
import re

from coppice.llm.decontam import BYTE_COST, clean, compile_patterns, found, hits, item_patterns


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(text, items, window=13):
    ws, hit, ids = words_of(text), set(), set()
    for item_id, item in items:
        iw = words_of(item)
        for k in range(max(1, len(iw) - window + 1) if iw else 0):
            p = iw[k : k + window]
            for i in range(len(ws) - len(p) + 1):
                if ws[i : i + len(p)] == p:
                    hit |= set(range(i, i + len(p)))
                    ids |= {str(item_id)} if item_id is not None else set()
    return len(ws), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(ws)


def cases():
    rng = random.Random(3)
    vocab = ["a", "de", "É", "straße", "the", "x9", "longerword", "zz"]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, line(rng.choice((1, 2, 5, 12, 13, 14, 30)))) for i in range(3, 23)] + [(30, None), (31, "…!? "), (None, line(14)), (7, line(20)), (40, "a " * 20)]
    docs = [line(rng.choice((0, 1, 5, 40, 300))) for _ in range(40)]
    for i in range(25):
        it = rng.choice(items)[1] or ""
        docs.append(line(rng.choice((0, 3, 400))) + ", " + it.upper().replace("É", "É") + "!\n" + line(rng.choice((0, 9))))
    return items, docs + [None, "", "a " * 3000, "-" * 5000, items[0][1]]


def test_hits_are_those_of_plain_search():
    items, docs = cases()
    ids = item_patterns(items)
    count, hit, got = hits([(d or "").encode() for d in docs], compile_patterns(list(ids)), ids)
    for i, d in enumerate(docs):
        assert (count[i], len(hit[i]), sorted(got[i])) == plain(d, items)[:3]


def test_blocks_of_patterns_change_nothing(spark):
    items, docs = cases()
    docs = [(None if i == 2 else i // 2, d, "en", "s", 1, 5) for i, d in enumerate(docs)]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, row int, n_words int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((d[0] is None, d[0] or 0, *plain(d[1], items)) for d in docs)
    for size in (1 << 20, 4000):
        got = found(table, bench, ["doc_id"], block_bytes=size).select("doc.doc_id", "n_words", "n_hit", "items", "contaminated").collect()
        assert sorted((r[0] is None, r[0] or 0, *map(lambda x: x, r[1:])) for r in got) == want
        kept = clean(table, bench, block_bytes=size)
        assert kept.columns == table.columns and kept.count() == sum(not w[-1] for w in want)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b", 2)], "doc_id long, text string, n_hit int")
    assert [tuple(r) for r in found(docs, none, ["doc_id"]).select("doc.doc_id", "n_words", "n_hit", "contaminated").collect()] == [(1, 2, 0, False)]
    assert clean(docs.where("false"), none).count() == 0
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_equal_windows_are_one_and_name_all_items():
    text = " ".join(f"w{i % 17}" for i in range(60))
    windows = item_patterns([(1, text), (2, "x " + text.upper()), (None, text), (3, "w0 w1"), (2, text), (4, None)])
    assert len(windows) == 17 + 1 + 1 and len({windows[k] for k in range(len(windows))}) == len(windows)
    assert sorted({tuple(windows.ids(k)) for k in range(len(windows))}) == [("1", "2"), ("2",), ("3",)]
    assert all(windows[k].count(b" ") - 1 == windows.words[k] and windows[k][:1] == windows[k][-1:] == b" " for k in range(len(windows)))


def test_a_large_benchmark_in_one_block():
    """Over a million windows: tables stay within their cost a byte, and each planted passage is found."""
    rng = random.Random(8)
    vocab = [f"{a}{b}" for a in "ba ce di fo gu ha ke li mo nu pa re si tu vo".split() for b in "ran set tin lod mup sek vil dor gal pin".split()]
    items = [(i, " ".join(rng.choices(vocab, k=60))) for i in range(22_000)]
    windows = item_patterns(items)
    size = sum(len(t) for _, t in items)
    held = len(windows.text) + sum(x.nbytes for x in (windows.begin, windows.end, windows.words, windows.first, windows.items))
    assert len(windows) > 1_000_000 and held < BYTE_COST * size
    picked = rng.sample(items, 40)
    docs = [" ".join(rng.choices(vocab, k=200)) + " " + " ".join(t.split()[20:35]).upper() for _, t in picked] + [" ".join(rng.choices(vocab, k=5000))]
    count, hit, got = hits([d.encode() for d in docs], compile_patterns(windows), windows)
    assert [sorted(x) for x in got] == [[str(i)] for i, _ in picked] + [[]] and [len(h) for h in hit] == [15] * 40 + [0]
