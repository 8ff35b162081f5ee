import base64
import random
import time

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from coppice.llm.tokencount import MODEL, NARROW, Counter, MergeTable, token_counts

PATH = public_tokenizers.path(MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def samples():
    rng = random.Random(11)
    alphabet = "aeinrst" * 5 + "  \n\t.,'▁éßñ東가​\x00①" + "😀"
    out = ["", " ", "  ", "\n", "▁", "<s> </s> <unk>", "<0x41>", "a" * 500, " " * 333, "a  b   c    d" * 9, "x" * NARROW, "thethethe" * 300, "   ▁▁ ① ▁①  "]
    for n in (3, 10, 40, 200, 2000):
        out += ["".join(rng.choice(alphabet) for _ in range(n)) for _ in range(60)]
    vocab = ["straße", "The", "unbelievable", "internationalization", "don't", "3.14", "é", "naïve"]
    out += [" ".join(rng.choice(vocab) for _ in range(50)) for _ in range(20)]
    return out


def test_counts_are_the_librarys(library):
    rows = samples()
    want = [len(x) for x in library.encode(rows)]
    for remembered in (1 << 19, 1):
        assert Counter(PATH, remembered)([r.encode() for r in rows]).tolist() == want


def test_both_layouts_agree():
    count = Counter(PATH).table
    words = [w.encode() for w in samples() if 0 < len(w) <= NARROW and " " not in w]
    got = count.counts(words)
    codes = [np.frombuffer(w.decode().encode("utf-32-le"), np.uint32) for w in words]
    assert count._merge_flat(np.concatenate(codes), np.array([len(c) for c in codes])).tolist() == got.tolist()


def test_merges_that_come_out_of_order():
    """Ranks of a table in which a merge can make a pair that goes before the rest of its own rank; against one merge at a time."""
    rng = random.Random(4)
    for _ in range(60):
        pieces = {c: 0.0 for c in "abc"}
        while len(pieces) < 16:
            x, y = rng.choice(list(pieces)), rng.choice(list(pieces))
            pieces.setdefault(x + y, float(rng.randrange(6)))
        table = MergeTable.__new__(MergeTable)
        table._load(pieces)
        order = {p: -pieces[p] for p in pieces if len(p) > 1}
        words = ["".join(rng.choice("abc") for _ in range(rng.choice((2, 5, 30, 80)))) for _ in range(12)]

        def plain(word):
            parts = list(word)
            while best := min(((order[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in order), default=None):
                parts[best[1] : best[1] + 2] = ["".join(parts[best[1] : best[1] + 2])]
            return len(parts)

        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        assert table._merge_flat(code, np.array([len(w) for w in words])).tolist() == [plain(w) for w in words]
        assert table.counts([w.encode() for w in words]).tolist() == [plain(w) for w in words]


def test_long_texts_without_spaces(library):
    rng = random.Random(7)
    rows = [base64.b64encode(rng.randbytes(n)).decode() for n in (60, 700, 90_000)] + ["".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(5000)), "".join(rng.choice("ththeanionerent") for _ in range(300_000)), "ab" * 50_000, "a" * 70_001]
    began = time.time()
    assert Counter(PATH)([r.encode() for r in rows]).tolist() == [len(x) for x in library.encode(rows)]
    assert time.time() - began < 60


def test_rows_of_a_table(spark, library):
    docs = spark.createDataFrame([(1, None, 3), (1, "", 4), (None, "a b", 5), (4, "a b", 5)], "doc_id long, text string, n_tokens int")
    got = token_counts(docs, PATH, ["doc_id"]).select("doc.doc_id", "n_bytes", "n_tokens").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 0, 0), (1, 0, 0), (None, 3, 2), (4, 3, 2)], key=str)
    assert token_counts(docs.where("false"), PATH, ["doc_id"]).count() == 0
