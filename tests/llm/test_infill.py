import hashlib
import re

import duckdb

from coppice.llm import infill

UNITS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, n string, form string, output string, doc string, x string, name string"


def plain(doc_id, text):
    """One row by the rule, with tokens as a list of strings."""
    t = text or ""
    tokens = re.findall(UNITS, t)
    assert "".join(tokens) == t
    n = len(tokens)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if t == "" or "<P>" in t or "<S>" in t or "<M>" in t or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, sha(t), sha(t)
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    form = "spm" if h4 % 100 < 80 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, form, len(p), len(m), sha(out), sha(t)


def texts():
    odd = [None, "", " ", "\n\t ", "one", " one", "one ", "a <P> b", "<S>", "x<M>", "<P", "a<", "< S>b<", "é 日本 𝄞𝄞 x", " a b", "a\x00b \x0b c\x0c", "<<P", "S> a b c <"]
    return odd + [f"word{i} und  noch\n{i} mehr <{'PSM'[i % 3]} > 𝄞" for i in range(60)] + ["lang " * 400_000 + "\n", "x" * 3_000_000, " " * 500_000]


def rows():
    return [(i, t, *["z"] * 6) for i, t in enumerate(texts())] + [(3, "same id", *["z"] * 6)] * 2 + [(None, "no id here", *["z"] * 6)]


def test_query_against_the_plain_rule(spark, tmp_path):
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: str(tuple(r))
    got = sorted((tuple(r) for r in infill.op12_fill_in_middle(spark, str(tmp_path)).collect()), key=key)
    assert got == sorted((plain(r[0], r[1]) for r in rows()), key=key)
    assert {r[2] for r in got} == {"plain", "spm", "psm"}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet' WHERE length(coalesce(text, '')) < 100000")
    assert sorted(db.execute(infill.OP12_SQL).fetchall(), key=key) == sorted((plain(r[0], r[1]) for r in rows() if len(r[1] or "") < 100_000), key=key)


def test_outputs_give_the_texts_back(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    done = infill.restored(infill.fill_in_middle(docs, docs.columns, cut_percent=100, suffix_first_percent=50))
    got = [(r.doc.doc_id, r.doc.text, r.text, r.form, r.doc.n) for r in done.collect()]
    assert len(got) == len(rows()) and all((a or "") == b and z == "z" for _, a, b, _, z in got)
    assert sum(f == "psm" for *_, f, _ in got) > 10 and sum(f == "spm" for *_, f, _ in got) > 10


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert infill.restored(infill.fill_in_middle(docs, ["doc_id"])).collect() == []


def test_texts_without_spaces_before_words():
    assert list(infill.unit_ends("ab  cd \n")) == [2, 6, 8] and list(infill.unit_ends(" ")) == [1]
