import heapq
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from coppice.llm import tokenfiles
from coppice.llm.tokenfiles import TOKENIZER, Code, Encoder, code_lengths, pack, read_tokens, unpack, write_tokens

PATH = public_tokenizers.path(TOKENIZER)
VOCAB = ["straße", "The", "It's", "don't,", "3.14", "É", "naïve.", "<|endoftext|>", "<|startoftext|>x", "a.b,", "...", ",", ".", "İx.", "é", "東京", "😀,", "WORD.", "x y", "　", "ﬁ①", "ǅ.", "'s", "I'LL", "a" * 300, "́a", "STRASSE'", "it's'", "Ünü_", "don''t", "ÉCOLE!?", "ĳ", "ŉ,", "ſ.", "ª", "µm.", "w\x1cw", "\x1f", "\u00a0x", "x\u2028Y.", "ǰ.", "Å."]


def samples():
    rng = random.Random(2)
    out = ["", " ", "\n\n", "a", "  a  b ", "\ta\x0bb\x1c c"]
    for n in (1, 5, 60, 900):
        out += [rng.choice((" ", "  ", " \n", "\t", "\x85", "\u00a0")).join(rng.choice(VOCAB) for _ in range(n)) for _ in range(25)]
    return out


def test_ids_are_the_librarys():
    library, rows = Tokenizer.from_file(PATH), samples()
    want = [x.ids for x in library.encode_batch(rows, add_special_tokens=False)]
    for remembered in (1 << 19, 1):
        got = Encoder(PATH, remembered)([r.encode() for r in rows])
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == want


def test_a_very_long_text():
    """Two megabytes in one document, with and without spaces."""
    rng = random.Random(5)
    long = " ".join(rng.choice(VOCAB) + str(rng.randrange(999)) for _ in range(250_000))
    rows = [long, "a", "".join(rng.choice("abcé东") for _ in range(20_000))]
    want = [x.ids for x in Tokenizer.from_file(PATH).encode_batch(rows, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in Encoder(PATH)([r.encode() for r in rows])] == want


def huffman_cost(counts):
    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        total += a
        heapq.heappush(heap, a)
    return total


def test_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(4)
    for n in (2, 3, 50, 700):
        counts = rng.zipf(1.5, n).clip(0, 10**6)
        lengths = code_lengths(counts, 40)
        assert int((counts * lengths).sum()) == huffman_cost(counts)
        short = code_lengths(counts, 10)
        assert short.max() <= 10 and sum(2.0 ** -int(x) for x in short if x) <= 1 and (short > 0).sum() == (counts > 0).sum()
    assert code_lengths(np.array([0, 7, 0])).tolist() == [0, 1, 0]
    fib = [1, 1]
    while len(fib) < 30:
        fib.append(fib[-1] + fib[-2])
    assert code_lengths(np.array(fib), 18).max() == 18


def test_blocks_round_trip():
    rng = np.random.default_rng(9)
    for n, symbols in ((1, 1), (5, 2), (256, 9), (257, 300), (5000, 40000)):
        ids = (rng.zipf(1.3, n) % symbols).astype(np.uint32)
        code = Code(code_lengths(np.bincount(ids, minlength=symbols)))
        names, flags, lengths, got = unpack(code, pack(code, [None], [n], ids))
        assert got.tolist() == ids.tolist() and flags.tolist() == [1] and lengths.tolist() == [n]


def test_files_of_a_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfiles, "BLOCK_IDS", 500)
    rows = [(i * 3, t, i) for i, t in enumerate(samples())] + [(None, "in no order", 1), (6, "again", 2), (6, None, 3)]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(5)
    write_tokens(docs, f"file://{tmp_path}/t", PATH)
    got = read_tokens(spark, f"file://{tmp_path}/t", with_ids=True).orderBy("start").collect()
    library = Tokenizer.from_file(PATH)
    want = sorted((r[0] is not None, r[0] or 0, tuple(library.encode(r[1] or "", add_special_tokens=False).ids + [2])) for r in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    assert [r.doc_id or -1 for r in got] == sorted(r.doc_id or -1 for r in got)
    total = 0
    for r in got:
        assert r.start == total and r.n_tokens == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids)
        total += r.n_tokens


def test_places_depend_on_the_documents_alone(spark, tmp_path):
    rows = [(d, f"text {k} of many", "x") for d in (None, 4, 4, 9) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    found = []
    for n in (1, 6):
        write_tokens(docs.repartition(n), f"file://{tmp_path}/t{n}", PATH)
        found.append(sorted((r.start, str(r.doc_id), r.ids_crc32) for r in read_tokens(spark, f"file://{tmp_path}/t{n}").collect()))
    assert found[0] == found[1] and len(found[0]) == len(rows)


def test_empty_table(spark, tmp_path):
    write_tokens(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/t", PATH)
    assert read_tokens(spark, f"file://{tmp_path}/t").count() == 0
