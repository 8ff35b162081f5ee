import pytest
from pyspark.sql import functions as F

from coppice.operators import encode
from coppice.operators.encode import Rule, binarize, boundaries, codex, find_rule, profile, significant

COLUMNS = {
    "ints": (["1", "2", "3", "2"], "integral", [(">=", 1.0), (">=", 2.0), (">=", 3.0)]),
    "reals": (["1.0", "2.5", "4.0", "1.0"], "rational", [(">=", 1.75), (">=", 3.25)]),
    "words": (["a", "b", "c", "a"], "categorical", [("==", "a"), ("==", "b"), ("==", "c")]),
    "bits": (["0", "1", "0", "1"], "binary", [("==", 1.0)]),
    "pair": (["a", "b", "a", "b"], "binary", [("==", "b")]),
    "gap": (["0", "1", "NA", "1"], "integral", [(">=", 0.0), (">=", 1.0)]),
    "same": (["7", "7", "7", "7"], "redundant", []),
    "mixed": (["1", "x", "2", "1"], "categorical", [("==", "1"), ("==", "2"), ("==", "x")]),
}


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(list(zip(*[v[0] for v in COLUMNS.values()], strict=True)), list(COLUMNS))


def test_kinds_and_rules(df):
    kinds = {r["column"]: r.kind for r in profile(df, list(COLUMNS)).collect()}
    assert kinds == {c: k for c, (_, k, _) in COLUMNS.items()}
    rules = codex(df, list(COLUMNS))
    for c, (_, kind, want) in COLUMNS.items():
        own = [(r.relation, r.reference) for r in rules if r.column == c]
        number = kind in ("integral", "rational") or c == "bits"
        assert [(rel, float(ref) if number else ref) for rel, ref in own] == want
    assert [r.index for r in rules] == list(range(len(rules)))
    assert find_rule(rules, "reals", 3.0).reference == "3.25" and boundaries(rules)["ints"] == (0, 3)
    bits = binarize(df, rules).collect()
    gap = next(r.index for r in rules if r.column == "gap")
    assert [r[f"f{gap}"] for r in bits] == [1, 1, 0, 1]
    with pytest.raises(ValueError, match="rules"):
        codex(df, list(COLUMNS), most=3)


def test_significant_figures(spark):
    values = [0.0, 1234.0, -1250.0, 0.0456, 99.6, 5.0]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(significant(F.col("v"), 2).alias("r")).collect()
    assert [round(r.r, 9) for r in got] == [0.0, 1200.0, -1300.0, 0.046, 100.0, 5.0]


def test_options_by_name():
    from coppice.config import FitConfig, from_options

    assert from_options({"regularization": 0.2, "depth_budget": 3, "loss_function": "logloss", "worker_limit": 4}) == FitConfig(regularization=0.2, max_depth=3, loss="log_loss")
    with pytest.raises(ValueError, match="nope"):
        from_options({"nope": 1})


def test_numbers_of_columns_of_all_types(spark):
    """Rules take numbers from columns of any type as from their text; NaN and what is no number fail them."""
    rows = [(0, 0, 0.1, 0.1, False, "0", 1), (1, 1, 0.2, 0.2, True, "1", 2), (2, 1, float("nan"), 0.2, True, " 1 ", 3), (3, None, None, None, None, "NaN", None)]
    df = spark.createDataFrame(rows, "id int, i int, d double, f float, b boolean, s string, w long")
    rule = lambda c, rel, ref: Rule(0, 0, c, "numeric_binary" if rel == "==" else "rational", rel, ref).test().alias("x")
    got = lambda *a: [r.x for r in df.orderBy("id").select(rule(*a)).collect()]
    assert got("i", "==", "1") == got("s", "==", "1") == got("b", "==", "1") == [False, True, True, False]
    assert got("d", "==", "0.2") == [False, True, False, False] and got("f", "==", "0.2") == [False, True, True, False]
    assert got("d", ">=", "0.15") == [False, True, False, False] and got("s", ">=", "0") == [True, True, True, False] and got("w", ">=", "2") == [False, True, True, False]


def test_many_rules_are_told_like_one_by_one(spark):
    values = [(1, -0.0, "a", "1e1", 0, True), (2, 0.0, "b", "NA", 1, False), (3, 2.5, None, "7", 1, None), (4, float("nan"), "NA", "x", 0, True), (5, None, "zz", None, 0, True), (6, float("inf"), "", "-3", 1, False)]
    df = spark.createDataFrame(values, "id int, d double, s string, t string, y int, b boolean")
    rules = [encode.Rule(k, 0, "d", "rational", ">=", str(v)) for k, v in enumerate((2.5, -1.0, 0.0, 1e9, 0.0, 3))]
    rules += [encode.Rule(6 + k, 1, "s", "categorical", "==", v) for k, v in enumerate(("b", "a", "NA", "zz", "q"))]
    rules += [encode.Rule(11 + k, 2, "t", "integral", ">=", v) for k, v in enumerate(("7", "10", "-3"))]
    rules += [encode.Rule(14, 2, "t", "numeric_binary", "==", "10"), encode.Rule(15, 0, "d", "numeric_binary", "==", "0"), encode.Rule(16, 3, "b", "binary", "==", "true")]
    for times in (1, 4):  # a long, then an array of longs
        many = [encode.Rule(i, r.position, r.column, r.kind, r.relation, r.reference) for i, r in enumerate(rules * times)]
        got = df.select("id", encode.bits_of(many).alias("got"), encode.masks.pack([r.test() for r in many]).alias("want")).collect()
        assert len(got) == 6 and all(r.got == r.want for r in got) and len({str(r.got) for r in got}) == 6
        table = encode.pattern_table(df, many, F.col("y"), [0, 1])
        assert table._jdf.queryExecution().optimizedPlan().toString().count("CASE WHEN") < len(rules)  # not an expression for each rule
        assert sum(r.n_0 + r.n_1 for r in table.collect()) == 6


def test_profile_reads_different_values_as_text(spark):
    df = spark.createDataFrame([(0.0, 1, "NA", None), (-0.0, 2, "1", None), (0.0, 2, "1", None), (None, 2, "2.5", None)], "d double, i int, s string, none string")
    want = {("d", 1, 2, "rational", "rational"), ("i", 0, 2, "integral", "binary"), ("s", 1, 2, "rational", "rational"), ("none", 4, 0, "categorical", "redundant")}
    for wide in (encode.WIDE, 1):  # counted exactly, then with wide columns estimated
        got = encode.profile(df, ["d", "i", "s", "none"], wide)
        assert {(r.column, r.n_missing, r.n_distinct, r.base, r.kind) for r in got.collect()} == want
    seen = []
    counted = encode._counted(df, {0: "d", 2: "s"})
    for r in counted.collect():
        seen.append((r.position, r.text, r.n))
    assert sorted(seen, key=str) == sorted([(0, "0.0", 2), (0, "-0.0", 1), (0, None, 1), (2, None, 1), (2, "1", 2), (2, "2.5", 1)], key=str)
