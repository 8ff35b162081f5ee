import math
import random
import zlib

import numpy as np

from coppice.llm.langid import PENALTY, gram_counts, held_out, op5_language_id, predicted, train

WORDS = {
    "en": "the of and to in that is was he for it with as his on be at by had not are but from or have".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es".split(),
    "es": "de la que el en los se del las un por con una su para es al lo como más o pero sus le ha me".split(),
    "fr": "le la les des et en un une du que est pour qui dans par plus pas au sur ne se ce sont".split(),
}


def text(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def corpus():
    rng = random.Random(6)
    rows = [(i, text(rng, lang, rng.choice((3, 20, 200))), lang) for i in range(300) for lang in [rng.choice(list(WORDS))]]
    mixed = [(1000 + i, text(rng, "en", 30) + "\n" + text(rng, "fr", 120), None) for i in range(10)]
    odd = [(2000, None, "en"), (2001, "", "en"), (2002, "123 !? \n 456", "de"), (2003, "é", None), (2003, "é", None), (None, "the of", "en"), (2004, "a" * 3_000_000, None)]
    return rows + mixed + odd


def test_gram_counts_do_not_reach_other_rows():
    rows = [b"abc", b"", b"Zz9 xyz", "é".encode(), b"q" * 3_000_000, b"abc"]
    at, bucket, n = gram_counts(rows, 16)
    for i, r in enumerate(rows):
        own_at, own_bucket, own_n = gram_counts([r], 16)
        assert bucket[at == i].tolist() == own_bucket.tolist() and n[at == i].tolist() == own_n.tolist()
    assert n[at == 0].sum() == 6 and not (at == 1).any()


def test_held_out_accuracy_and_mixtures(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 0.5, "x") for r in rows], "doc_id long, text string, lang string, score double, shares string")
    fold = {r.doc_id: r.h for r in docs.select("doc_id", held_out().alias("h")).collect()}
    assert all(fold[d] == (zlib.crc32(str(d).encode()) % 4 == 2) for d, _, _ in rows if d is not None)
    got = predicted(docs, train(docs.where(~held_out())), ["doc_id"]).select("doc.doc_id", "lang_pred", "score").collect()
    assert all(0 <= r.score <= 1 for r in got)
    pred = {r.doc_id: r for r in got}
    test = [(d, lang) for d, t, lang in rows if d is not None and d < 300 and fold[d]]
    assert np.mean([pred[d].lang_pred == lang for d, lang in test]) > 0.97
    for i in range(10):
        assert pred[1000 + i].lang_pred == "fr" and 0.6 < pred[1000 + i].score < 0.95
    assert all(pred[d].lang_pred == "und" and pred[d].score == 0 for d in (2000, 2001, 2002))
    assert pred[2003].lang_pred in WORDS and pred[2004].lang_pred in WORDS


def plain_set(model, text):
    """Shares of the chosen set, one n-gram and one round at a time; None without n-grams."""
    _, bucket, n = gram_counts([text], model.bits)
    grams = [(model.of_bucket[b].astype(float).tolist(), c) for b, c in zip(bucket.tolist(), n.tolist(), strict=True)]
    if not grams:
        return None
    size, total = len(model.languages), sum(c for _, c in grams)
    fit = lambda share: sum(c * math.log(sum(q * s for q, s in zip(p, share, strict=True))) for p, c in grams)
    single = lambda k: [float(i == k) for i in range(size)]
    share = max((single(k) for k in range(size)), key=fit)
    while True:
        mixed = [sum(q * s for q, s in zip(p, share, strict=True)) for p, _ in grams]
        rise = {k: sum(c * p[k] / m for (p, c), m in zip(grams, mixed, strict=True)) - total for k in range(size) if not share[k]}
        if not rise:
            return share
        k = max(rise, key=rise.get)
        new = [s * 0.5 + 0.5 * (i == k) for i, s in enumerate(share)]
        for _ in range(400):
            sums = [0.0] * size
            for p, c in grams:
                m = sum(q * s for q, s in zip(p, new, strict=True))
                sums = [x + c * q * s / m for x, q, s in zip(sums, p, new, strict=True)]
            new = [x / total for x in sums]
        if fit(new) - fit(share) <= PENALTY * math.log(1 + total):
            return share
        share = new


def test_sets_are_those_of_plain_inference(spark):
    """Documents of one to four languages: the set, its order and its shares."""
    rng = random.Random(9)
    train_rows = [(i, text(rng, lang, 120), lang) for i in range(200) for lang in [rng.choice(list(WORDS))]]
    model = train(spark.createDataFrame(train_rows, "doc_id long, text string, lang string"))
    docs, langs = [], []
    for i in range(40):
        own = rng.sample(list(WORDS), 1 + i % 4)
        docs.append("\n".join(text(rng, x, 60 + 20 * k) for k, x in enumerate(own)).encode())
        langs.append(set(own))
    docs += [b"the", b"a", b"", "é".encode()]
    got = model(docs)
    for d, share in zip(docs, got, strict=True):
        want = plain_set(model, d)
        assert (want is None and not share.any()) or np.allclose(share, want, atol=0.02)
    assert np.mean([{model.languages[k] for k in np.flatnonzero(s > 0)} == w for s, w in zip(got, langs, strict=False)]) > 0.9
    assert [x.tolist() for x in model(docs[::-1])] == [x.tolist() for x in got[::-1]]


def test_nothing_to_learn_from(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the text", None)], "doc_id long, text string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.lang_pred for r in op5_language_id(spark, str(tmp_path)).collect()] == ["und"]
    assert predicted(docs.where("false"), train(docs), ["doc_id"]).count() == 0
