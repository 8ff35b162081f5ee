from collections import Counter
from itertools import combinations

import numpy as np

from coppice.llm.packing import best_boundaries, pack_documents, packed


def padding(lengths, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts, strict=True))


def test_boundaries_are_the_best_of_all():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 9):
        lengths = np.sort(rng.choice(60, n, replace=False)).astype(np.int64)
        counts = rng.integers(1, 50, n)
        for k in (1, 2, 3, 4):
            got = best_boundaries(lengths, counts, k).tolist()
            assert len(got) <= k and got == sorted(set(got)) and got[-1] == lengths[-1]
            every = [c for m in range(1, k + 1) for c in combinations(lengths.tolist(), min(m, n)) if c[-1] == lengths[-1]]
            assert padding(lengths, counts, got) == min(padding(lengths, counts, c) for c in every)


def test_boundaries_of_many_lengths():
    """The layer-by-layer search against one that tries every beginning, and long tables in good time."""
    rng = np.random.default_rng(4)
    for n, k in ((40, 5), (300, 7), (301, 16)):
        lengths = np.cumsum(rng.integers(1, 2000, n)).astype(np.int64)
        counts = rng.integers(1, 1000, n)
        upto = np.concatenate(([0], np.cumsum(counts)))
        best = np.concatenate(([0], lengths * upto[1:]))
        for _ in range(1, k):
            best = np.array([0, *[min(best[i] + lengths[j - 1] * (upto[j] - upto[i]) for i in range(j)) for j in range(1, n + 1)]])
        got = best_boundaries(lengths, counts, k).tolist()
        assert len(got) == k and padding(lengths, counts, got) == best[n] - (lengths * counts).sum()
    lengths = np.arange(1, 200_001)
    assert len(best_boundaries(lengths, np.ones(len(lengths), np.int64), 16)) == 16


def test_places_depend_on_the_documents_alone(spark):
    rows = [(i % 40, f"w{i % 7} " * (i % 23), i % 2, "x") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket int, id string")
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    got = [sorted(map(tuple, pack_documents(docs.repartition(n), model, buckets=4, budget=64).collect())) for n in (1, 7)]
    assert got[0] == got[1] and len(got[0]) == 300
    clash = packed(spark.createDataFrame([(1, 5, "a", "b")], "n_tokens int, slot int, bucket string, keep string"))
    assert clash.columns == ["n_tokens", "keep", "bucket", "batch_id", "slot"] and clash.count() == 1


def test_batches_hold_every_row_once(spark):
    rng = np.random.default_rng(7)
    rows = [(int(i) if i % 9 else None, int(x), "b") for i, x in enumerate(np.concatenate((rng.integers(1, 40, 400), np.full(300, 17), [5000, 70_000, 2049, 2050, 3_000_000])))]
    lengths = spark.createDataFrame(rows, "doc_id long, n_tokens long, bucket_ string").repartition(5)
    got = packed(lengths, buckets=5, budget=100).collect()
    assert Counter((r.doc_id, r.n_tokens, "b") for r in got) == Counter(rows)
    batches = {}
    for r in got:
        assert r.n_tokens <= r.bucket
        batches.setdefault(r.batch_id, []).append(r)
    assert sorted(batches) == list(range(len(batches)))
    short = Counter()
    for own in batches.values():
        bucket, room = own[0].bucket, max(1, 100 // own[0].bucket)
        assert {r.bucket for r in own} == {bucket} and sorted(r.slot for r in own) == list(range(len(own))) and len(own) <= room
        short[bucket] += len(own) < room
    assert max(short.values()) <= 1 and len(short) <= 5
    cells = Counter(r[1] for r in rows)
    best = best_boundaries(np.array(sorted(cells)), np.array([cells[x] for x in sorted(cells)]), 5)
    assert sum(r.bucket - r.n_tokens for r in got) == padding(sorted(cells), [cells[x] for x in sorted(cells)], best.tolist())


def test_empty_and_null(spark):
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.createDataFrame([(1, None, 5), (1, "", 5), (2, "a b", 5)], "doc_id long, text string, slot int")
    got = sorted(tuple(r) for r in pack_documents(docs, model).select("doc_id", "n_tokens", "bucket").collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 3, 3)]
    assert pack_documents(docs.where("false"), model).count() == 0
