import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from coppice.llm import exactdedup
from coppice.llm.hotjoin import joined_back

SCHEMA = "doc_id long, text string, id string, row string, key string, n string, doc string, sha string, bucket string"


def rows():
    rng = random.Random(5)
    texts = ["", None, " ", "a", "A", "a ", "é", "é", "x\x00", "x", "long " * 300_000, "long " * 300_000 + "."]
    texts += [f"text {i}" for i in range(300)]
    out = [(i, t) for i, t in enumerate(texts)]
    out += [(1000 + i, rng.choice(texts)) for i in range(200)] + [(2000 + i, "the same") for i in range(400)]
    out += [(7, "repeated")] * 3 + [(None, "no id")] * 2 + [(None, "the same"), (2399, "the same"), (2399, "the same")]
    return [(*r, *["z"] * 7) for r in out]


def plain(given):
    groups = defaultdict(list)
    for i, t, *_ in given:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        stays = ids.index(top)
        out += [(i, top, len(ids), k == stays, hashlib.sha256(t.encode()).hexdigest()) for k, i in enumerate(ids)]
    return out


def weak(bits):
    return lambda sha: F.call_function("shiftleft", F.conv(F.substring(sha, 1, bits // 4), 16, 10).cast("long"), F.lit(exactdedup.KEY_BITS - bits))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5).cache()


def by_value(found):
    return Counter((r.doc.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found.collect())


def test_query_against_a_plain_grouping(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(tuple(r) for r in exactdedup.op11_exact_dedup(spark, str(tmp_path)).collect())
    assert got == Counter(plain(rows()))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert Counter(db.execute(exactdedup.OP11_SQL).fetchall()) == got


@pytest.mark.parametrize("bits", [0, 4, 8])
def test_equal_keys_of_different_texts(docs, bits):
    """With keys of so few bits nearly all texts collide; bytes tell them apart."""
    key = weak(bits) if bits else lambda sha: F.length(sha) * 0
    assert by_value(exactdedup.exact_groups(docs, ["doc_id"], key=lambda sha: key(sha).cast("long"), capacity=3)) == Counter(plain(rows()))


def test_kept_rows_and_odd_tables(spark, docs):
    kept = exactdedup.without_copies(docs)
    assert kept.columns == docs.columns
    want = Counter((i, h) for i, _, _, k, h in plain(rows()) if k)
    assert Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in kept.collect()) == want
    assert exactdedup.without_copies(docs.limit(0)).collect() == []
    shown = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    assert exactdedup.without_copies(shown).count() == sum(want.values())
    folded = exactdedup.exact_groups(spark.createDataFrame([(1, "A"), (2, "a"), (3, "b")], "doc_id long, text string"), ["doc_id"], normal=F.lower)
    assert sorted((r.doc.doc_id, r.keep_id, r.kept) for r in folded.collect()) == [(1, 2, False), (2, 2, True), (3, 3, True)]


def test_directory_splits_overfull_buckets():
    depth, slots = exactdedup.directory({}, 10, 4)
    assert (depth, slots) == (0, [0])
    depth, slots = exactdedup.directory({0: 6, 1: 6, 8: 3, 15: 3}, 10, 4)
    assert depth == 4 and slots == [0, 1, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4, 4, 4, 4, 4]
    depth, slots = exactdedup.directory({3: 50}, 10, 4)  # one cell over the bound stays whole
    assert depth == 4 and slots[3] not in (slots[2], slots[4])
    rng = random.Random(1)
    cells = {c: rng.randrange(9) for c in range(256)}
    depth, slots = exactdedup.directory(cells, 40, 8)
    held = Counter()
    for c, n in cells.items():
        held[slots[c >> (8 - depth)]] += n
    assert max(held.values()) <= 40 and slots == sorted(slots) and len(held) < 120


def test_the_index_has_each_key_once_in_order(spark, docs):
    entries = docs.select(F.col("doc_id").alias("id"), exactdedup.key_of(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("key"), F.monotonically_increasing_id().alias("row"))
    index, total = exactdedup.indexed(entries, capacity=20)
    got = index.collect()
    assert total == len(rows()) == sum(r.n for r in got) and len({r.key for r in got}) == len(got)
    assert [r.bucket for r in sorted(got, key=lambda r: r.key)] == sorted(r.bucket for r in got) and max(Counter(r.bucket for r in got).values()) <= 20


def test_hot_keys_are_broadcast_and_others_joined(spark):
    rows = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 7, if(id % 3 = 1, id, null)) AS key")
    known = rows.where("key % 2 = 1").groupBy("key").agg(F.count("*").alias("n"), (F.first("key") * 2).alias("x")).cache()
    for small in (None, F.col("key") > 7):
        got = joined_back(rows, known, "key", 3000, small).collect()
        assert sorted(r.id for r in got) == list(range(3000))
        assert all((r.x, r.n) == ((r.key * 2, 1001 if r.key == 7 else 1) if r.key is not None and r.key % 2 else (None, None)) for r in got)
