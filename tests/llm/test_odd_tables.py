"""Tables with very long texts, and with columns named like those the operators make."""

import random

import pytest

import corpus_pipeline
from coppice.llm import decontam, langid, linededup, packing, quality, simhash, tokencount

NAMES = "doc row hit items f0 f1 fp root high low runs begin end place series u v named unnamed counted kept base_failed share shares score slot bucket batch_id id words text_hash n_words of_doc fence high_upper measure component_id".split()
WORDS = [f"{a}{b}" for a in "ba ce di fo gu ha ke li mo nu pa re si tu".split() for b in "ran set tin lod mup sek vil dor".split()]


def texts():
    rng = random.Random(2)
    line = lambda n, ends=("", "s"): " ".join(rng.choice(WORDS) + rng.choice(ends) for _ in range(n))
    out = ["\n".join(line(20) for _ in range(5)) for _ in range(60)]
    long = "\n".join(line(40, "aei") for _ in range(6000))  # 1.5 MB
    return [*out, long, line(60_000, "ouy"), "", None]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 2}", None if t is None else len(t), *["x"] * len(NAMES)) for i, t in enumerate(texts())]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES)
    return spark.createDataFrame(rows, schema).repartition(3).cache()


def test_filters_keep_columns_and_long_texts(spark, docs):
    whole = {r.doc_id: tuple(r) for r in docs.collect()}
    last = len(whole) - 1
    bench = spark.createDataFrame([(1, whole[60][1][-3000:]), (2, whole[3][1])], "item_id long, text string")
    for name, got, gone in (
        ("quality", quality.filtered(docs), {last - 1, last}),
        ("lines", linededup.without_repeats(docs, length_col="n_chars"), set()),
        ("near", simhash.keep_first(docs), {last}),
        ("clean", decontam.clean(docs, bench), {3}),
    ):
        assert got.columns == docs.columns, name
        assert {r.doc_id: tuple(r) for r in got.collect()} == {k: v for k, v in whole.items() if k not in gone}, name
    hits = {r.doc.doc_id: r.n_hit for r in decontam.found(docs, bench, docs.columns).where("n_hit > 0").collect()}
    assert hits[3] == 100 and hits[60] > 300


def test_others_take_them_whole(docs):
    import public_tokenizers

    model = public_tokenizers.path(tokencount.MODEL)
    counts = {r.doc.doc_id: r for r in tokencount.token_counts(docs, model, docs.columns).collect()}
    packed = {r.doc_id: r for r in packing.pack_documents(docs, model).collect()}
    assert all(packed[k].n_tokens == r.n_tokens + 1 and r.n_bytes == len((r.doc.text or "").encode()) for k, r in counts.items()) and len(packed) == len(counts)
    langs = langid.predicted(docs, langid.train(docs), docs.columns).collect()
    assert {r.lang_pred for r in langs if r.doc.text} == {"en"} and len(langs) == len(counts)
    groups = {r.doc_id: r.component_id for r in simhash.near_groups(docs).collect()}
    assert groups[60] == 60 and groups[61] == 61 and groups[63] == groups[62]


def test_the_pipeline_takes_them(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == list(range(62))
