import random

import corpus_pipeline
from coppice.llm.simhash import fingerprint
from coppice.llm.storage import stored


def documents():
    """Clean documents, and one of each kind that a stage must act on; with the ids that must come out."""
    rng = random.Random(12)
    words = [f"{a}{b}" for a in "ba ce di fo gu ha ke li mo nu pa re".split() for b in "ran set tin lod mup sek vil".split()]
    text = lambda n, lines=6: "\n".join(" ".join(rng.choice(words) for _ in range(n // lines)) for _ in range(lines))
    clean = [(i, text(120 + i % 40), "en", f"s{i % 3}") for i in range(260)]
    bench = [(k, text(40, 1)) for k in range(5)]
    rows = list(clean)
    mine = fingerprint(clean[7][1].encode())
    near = next(t for w in words for t in [clean[7][1].rsplit(" ", 1)[0] + " x" + w] if (fingerprint(t.encode()) ^ mine).bit_count() <= 3)
    passage = "\n".join(text(60, 1) for _ in range(1))
    rows += [
        (1000, " ".join("### junk$$ " + w for w in text(60).split()), "en", "s0"),
        (1001, "too short", "en", "s1"),
        (1002, clean[3][1], "en", "s2"),
        (1003, near.replace("\n", " "), "en", "s0"),
        (1004, text(80) + "\n" + bench[2][1] + "\n" + text(40), "en", "s1"),
        (1005, text(90) + "\n" + passage, "en", "s1"),
        (1006, text(90) + "\n" + passage + "\n" + text(30), "en", "s2"),
        (1007, None, None, None),
        (1008, text(120), None, None),
        (1008, rows[0][1], "en", "s0"),
    ]
    return rows, bench, passage


def test_stages_do_what_they_say(spark, tmp_path):
    rows, bench, passage = documents()
    docs = spark.createDataFrame([(d, t, lang, s, len(t or "")) for d, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sf, now, seen = str(tmp_path), docs, {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        now = stored(stage(spark, now, sf), "stage")
        if name != "packing":
            assert now.columns == docs.columns
        seen[name] = now.collect()
    ids = {k: {r.doc_id for r in v} for k, v in seen.items()}
    assert not ids["quality_rules"] & {1000, 1001, 1007} and set(range(260)) <= ids["quality_rules"]
    by_id = {r.doc_id: r for r in seen["line_dedup"] if r.doc_id != 1008}
    assert passage in by_id[1005].text and passage not in by_id[1006].text and by_id[1002].text == "" and by_id[1003].text
    assert all(r.n_chars == len(r.text) for r in seen["line_dedup"])
    assert set(range(260)) <= ids["near_dedup"] and 1003 not in ids["near_dedup"] and len(seen["near_dedup"]) == len(ids["near_dedup"])
    assert 1004 not in ids["decontamination"] and {1005, 1006} <= ids["decontamination"]
    assert ids["packing"] == ids["decontamination"]
    run = corpus_pipeline.run(spark, sf).collect()
    assert sorted(map(tuple, run)) == sorted(map(tuple, seen["packing"])) and corpus_pipeline.ORACLE_SQL is None


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
