import math
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import xxhash

from coppice.llm.simhash import BUDGET, PAIR_WEIGHT, PRINTS, WORD_WEIGHT, WordPrints, fingerprint, keep_first, near_groups, near_links, trie_forest


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(ids_fps, budget=3):
    parent = list(range(len(ids_fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids_fps)):
        for j in range(i):
            if (ids_fps[i][1] ^ ids_fps[j][1]).bit_count() <= budget:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(ids_fps):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, least.get(find(i))) for i, (d, _) in enumerate(ids_fps)]


TEXTS = ["", "one", "one two", "The quick brown fox", "the QUICK brown fox", "É é Straße", "a\x1cb c\x0bd e\nf", "x " * 700, "w%d " * 3 % (1, 2, 3)]


def test_fingerprint_is_the_plain_one():
    for t in TEXTS:
        assert fingerprint(t.encode()) == plain_fingerprint(t)


def test_forest_links_what_brute_force_links():
    rng = np.random.default_rng(5)
    for size, flips in ((1, 0), (2, 1), (300, 4), (900, 6)):
        base = rng.integers(0, 1 << 63, max(1, size // 9), dtype=np.uint64)
        keys = base[rng.integers(0, len(base), size)]
        for _ in range(flips):
            keys = keys ^ (np.uint64(1) << rng.integers(0, 64, size).astype(np.uint64))
        keys = np.unique(keys)
        member, root = trie_forest(keys, np.zeros(len(keys), int))
        got = {i: i for i in range(len(keys))} | dict(zip(member.tolist(), root.tolist(), strict=True))
        want = plain_components([(i, int(k)) for i, k in enumerate(keys)])
        assert [got[i] for i in range(len(keys))] == [c for _, c in want]


def test_groups_over_a_table(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(400)]
    rows, base = [], [" ".join(rng.choice(words, 120)) for _ in range(12)]
    for i in range(150):
        w = base[i % 12].split()
        for _ in range(i % 4):
            w[int(rng.integers(len(w)))] = "zz"
        rows.append((i, " ".join(w)))
    rows += [(200, None), (201, ""), (202, " \n"), (203, rows[0][1]), (203, rows[0][1]), (None, rows[1][1]), (None, "alone in null")]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, fp string, component_id int")
    want = plain_components([(d, plain_fingerprint(t)) for d, t in rows])
    for split in (1 << 18, 4):
        got = near_groups(docs, split_rows=split).select("doc_id", "component_id").collect()
        key = lambda x: (x[0] is None, x[0] or 0, x[1] or 0)
        assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


MASK = (1 << 64) - 1


def plain_mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def plain_prints(text):
    words, out = (text or "").encode().lower().split(), []
    counts, pairs = Counter(words), set(zip(words, words[1:], strict=False))
    hashes = {w: b"".join(xxhash.xxh3_128_digest(w, s) for s in range(-(-PRINTS // 2))) for w in counts}
    for k in range(PRINTS):
        own = {w: int.from_bytes(h[8 * k : 8 * k + 8], "big") for w, h in hashes.items()}
        weighed = [(own[w], round(WORD_WEIGHT * (1 + math.log(n)))) for w, n in counts.items()] + [(plain_mix((own[a] * 0x9E3779B97F4A7C15 + own[b]) & MASK), PAIR_WEIGHT) for a, b in pairs]
        out.append(sum(1 << b for b in range(64) if 2 * sum(n for h, n in weighed if h >> b & 1) > sum(n for _, n in weighed)))
    return out


def test_one_row_of_each_group_stays(spark):
    """Against all pairs, with tries whole and cut, and with few words remembered."""
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(400)]
    rows, base = [], [" ".join(rng.choice(words, 150)) for _ in range(12)]
    for i in range(150):
        w = base[i % 12].split()
        for _ in range(i % 6):
            w[int(rng.integers(len(w)))] = "zz"
        rows.append((i, " ".join(w)))
    rows += [(200, None), (201, ""), (202, " \n"), (203, rows[0][1]), (204, rows[0][1] + " É é")]
    prints = [plain_prints(t) for _, t in rows]
    few = WordPrints(remembered=50)
    assert [[int(x) for x in few((t or "").encode()).view(np.uint64)] for _, t in rows] == prints
    least = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if least[i] != least[j] and any((a ^ b).bit_count() <= BUDGET for a, b in zip(prints[i], prints[j], strict=True)):
                low, high = sorted((least[i], least[j]))
                least = [low if x == high else x for x in least]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, f0 string, root int")
    for split in (1 << 18, 4):
        kept = keep_first(docs, split_rows=split)
        assert kept.columns == docs.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted({rows[x][0] for x in least})


def test_near_copies_go_and_others_stay(spark):
    """Pairs that share four fifths of their five-word shingles, counted exactly: nine in ten and more are found; texts that share little stay."""
    docs = pd.read_parquet("/root/testdata/sf0.1/documents.parquet").drop_duplicates("text")
    texts = {int(i): tuple(t.encode().lower().split()) for i, t in zip(docs.doc_id, docs.text, strict=True) if t and len(t.split()) >= 20}
    shingles = {i: {w[k : k + 5] for k in range(len(w) - 4)} for i, w in texts.items()}
    where = defaultdict(list)
    for i, own in shingles.items():
        for x in own:
            where[x].append(i)
    shared = Counter((a, b) for ids in where.values() for n, a in enumerate(ids) for b in ids[n + 1 :])
    alike = {p: n / (len(shingles[p[0]]) + len(shingles[p[1]]) - n) for p, n in shared.items()}
    of = WordPrints()
    prints = {i: of(b" ".join(w)).view(np.uint64) for i, w in texts.items()}
    near = [p for p, x in alike.items() if x >= 0.8]
    assert len(near) > 20
    found = [bool((np.bitwise_count(prints[a] ^ prints[b]) <= BUDGET).any()) for a, b in near]
    assert np.mean(found) >= 0.9
    ids, matrix = sorted(prints), np.stack([prints[i] for i in sorted(prints)])
    for n, i in enumerate(ids):
        for m in np.flatnonzero((np.bitwise_count(matrix[n + 1 :] ^ matrix[n]) <= BUDGET).any(axis=1)):
            assert alike.get((i, ids[n + 1 + m]), alike.get((ids[n + 1 + m], i), 0)) > 0.3


def test_first_row_of_each_group_where_ids_repeat(spark):
    rng = np.random.default_rng(3)
    one, two, three, four, five = (" ".join(f"w{i}" for i in rng.integers(400, size=120)) for _ in range(5))
    rows = [(5, one, None), (5, two, "a"), (7, one, "b"), (3, three, "c"), (9, four, "d"), (9, three, None), (9, three, None), (None, five, "e"), (None, five, "e"), (None, five, "f"), (None, None, "g"), (8, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, high string").repartition(3)
    kept = keep_first(docs)
    assert kept.schema == docs.schema
    got = kept.collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(d), str(t)) for d, t in [(5, one), (5, two), (3, three), (9, four), (None, five), (None, None), (8, None)])
    assert sorted(map(str, keep_first(docs.repartition(2)).collect())) == sorted(map(str, got))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_groups(docs).count() == 0
    assert near_links(spark.createDataFrame([], "series int, fp long")).count() == 0
