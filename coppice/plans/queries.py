"""A query for each operator, over the driver's tables; SQL for the same results stands beside each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coppice.config import FitConfig
from coppice.functions import analysis, masks, metrics
from coppice.functions.losses import balanced_costs, best_class, entropy_loss, total, uniform_costs
from coppice.operators import causal, crossfit, encode, search, trees
from coppice.operators.fit import TreeModel, binary_rules, covered, predict, predict_ensemble
from coppice.plans import task
from coppice.plans.task import NAMES, P, SQL_PATTERNS, SQL_ROWS, TESTS, sql_cells
from coppice.sources.tables import check_binary
from coppice.sources.work import kept

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}
RULES = binary_rules(NAMES)
LAMBDA, BOUND = 0.005, 0.12
#: Three levels of nodes, so two splits on a path.
CONFIG = FitConfig(regularization=LAMBDA, max_depth=3, bound=BOUND, model_limit=100_000)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def patterns(spark, sf) -> DataFrame:
    return encode.pattern_table(task.lineitem(spark, sf), task.tests(), task.label(), [0, 1])


def solved(spark, sf, config: FitConfig = CONFIG) -> tuple[search.Problem, list[DataFrame]]:
    p = search.problem(kept(patterns(spark, sf), "patterns"), P, 2, config)
    return p, search.optimum(p)


def near(spark, sf, trees_: bool = False) -> tuple[search.Problem, list[DataFrame]]:
    p, levels = solved(spark, sf)
    return p, search.entries(p, search.budgets(p, levels, p.scale.bound(CONFIG)), trees_)


# ---- SQL shared by several queries ----------------------------------------------

_C2 = f"WITH {SQL_PATTERNS}, {sql_cells(2)}, one AS (SELECT sum(n_0 + n_1) AS n FROM pat), f AS (SELECT unnest(range({P}))::INT AS feature)"
_LEAF = f"""cell AS (SELECT care, val, k, n_0, n_1, n_0 + n_1 AS n_total, CASE WHEN n_1 >= n_0 THEN 1 ELSE 0 END AS prediction, least(n_0, n_1) AS falses, least(n_0, n_1) / n AS loss, least(n_0, n_1) / n + {LAMBDA} AS leaf_objective,
  CASE WHEN n_1 >= n_0 THEN n_1 ELSE 0 END AS tp, CASE WHEN n_1 >= n_0 THEN 0 ELSE n_0 END AS tn FROM c, one)"""


def _sql_best(k: int) -> str:
    return f"""s{k} AS (SELECT a.care, a.val, feature, l.v + r.v AS objective FROM cell a, f JOIN v{k + 1} l ON l.care = a.care + (1 << feature) AND l.val = a.val JOIN v{k + 1} r ON r.care = a.care + (1 << feature) AND r.val = a.val + (1 << feature)
  WHERE a.k = {k} AND a.care & (1 << feature) = 0),
v{k} AS (SELECT a.care, a.val, a.leaf_objective, least(a.leaf_objective, coalesce(min(objective), a.leaf_objective)) AS v FROM cell a LEFT JOIN s{k} s ON s.care = a.care AND s.val = a.val WHERE a.k = {k} GROUP BY a.care, a.val, a.leaf_objective)"""


_SOLVED = f"{_C2}, {_LEAF}, v2 AS (SELECT care, val, leaf_objective, leaf_objective AS v FROM cell WHERE k = 2), {_sql_best(1)}, {_sql_best(0)}"
#: The root is a leaf, one split, or two levels of splits: every tree of the depth, with its outcome.
_E1 = """e1 AS (SELECT care, val, -1 AS feature, prediction AS leaf, falses, tp, tn, 1 AS leaves, prediction::VARCHAR AS tree FROM cell WHERE k = 1
  UNION ALL SELECT a.care, a.val, feature, NULL, l.falses + r.falses, l.tp + r.tp, l.tn + r.tn, 2, '(' || feature || ' ' || r.prediction || ' ' || l.prediction || ')'
  FROM cell a, f JOIN cell l ON l.care = a.care + (1 << feature) AND l.val = a.val JOIN cell r ON r.care = a.care + (1 << feature) AND r.val = a.val + (1 << feature)
  WHERE a.k = 1 AND a.care & (1 << feature) = 0 AND l.prediction <> r.prediction)"""
_E0 = f"""e0 AS (SELECT -1 AS feature, prediction AS leaf, falses, tp, tn, 1 AS leaves, prediction::VARCHAR AS tree FROM cell WHERE k = 0
  UNION ALL SELECT f.feature, NULL, l.falses + r.falses, l.tp + r.tp, l.tn + r.tn, l.leaves + r.leaves, '(' || f.feature || ' ' || r.tree || ' ' || l.tree || ')'
  FROM f JOIN e1 l ON l.care = 1 << f.feature AND l.val = 0 JOIN e1 r ON r.care = 1 << f.feature AND r.val = 1 << f.feature WHERE l.leaf IS NULL OR r.leaf IS NULL OR l.leaf <> r.leaf),
t AS (SELECT e0.*, round(falses / n + {LAMBDA} * leaves, 9) AS objective FROM e0, one WHERE falses / n + {LAMBDA} * leaves <= {BOUND} + 1e-9)"""
_NEAR = f"{_C2}, {_LEAF}, {_E1}, {_E0}"
_BEST_TREE = f"{_NEAR}, best AS (SELECT tree, feature, falses, leaves, objective FROM t ORDER BY objective, leaves, length(tree), tree LIMIT 1)"
_FOLDS = f"fb AS (SELECT *, ((row_number() OVER (PARTITION BY y ORDER BY {', '.join(task.FOLD_ORDER)}) - 1) % 3 + 1)::INT AS fold FROM b)"


# ---- encoding --------------------------------------------------------------------

_PROFILED = ["l_quantity", "l_tax", "l_returnflag", "l_linestatus", "l_linenumber"]


def _sql_profile(c: str, i: int) -> str:
    v = f"CASE WHEN {c}::VARCHAR NOT IN ('', 'NULL', 'null', 'Null', 'NA', 'na', 'NaN') THEN {c}::VARCHAR END"
    return f"""SELECT {i} AS position, '{c}' AS "column", count(*) AS n_rows, count(*) FILTER (v IS NULL) AS n_missing, count(DISTINCT v) AS n_distinct, bool_and(regexp_full_match(v, '[+-]?[0-9]+')) AS ints,
  bool_and(regexp_full_match(v, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)')) AS numbers FROM (SELECT {v} AS v FROM lineitem)"""


_SQL_BASE = "CASE WHEN ints THEN 'integral' WHEN numbers THEN 'rational' ELSE 'categorical' END"


@query(f"""SELECT position, "column", n_rows, n_missing, n_distinct, {_SQL_BASE} AS base,
  CASE WHEN n_distinct <= 1 THEN 'redundant' WHEN n_distinct = 2 AND n_missing = 0 THEN 'binary' ELSE {_SQL_BASE} END AS kind FROM ({' UNION ALL '.join(_sql_profile(c, i) for i, c in enumerate(_PROFILED))})""")
def encoder_profile(spark, sf):
    return encode.profile(task.lineitem(spark, sf), _PROFILED)


@query("""WITH q AS (SELECT DISTINCT l_tax AS v FROM lineitem), m AS (SELECT (v + lag(v) OVER (ORDER BY v)) / 2 AS v FROM q),
r AS (SELECT 0 AS position, 'l_tax' AS "column", 'rational' AS kind, '>=' AS relation, round(v, 6) AS reference FROM m WHERE v IS NOT NULL
UNION ALL SELECT 1, 'l_linenumber', 'integral', '>=', v FROM (SELECT DISTINCT l_linenumber::DOUBLE AS v FROM lineitem))
SELECT *, row_number() OVER (PARTITION BY position ORDER BY reference)::INT AS rank FROM r""")
def encoder_codex(spark, sf):
    got = encode.codex_table(task.lineitem(spark, sf), ["l_tax", "l_linenumber"])
    return got.withColumn("reference", F.round(F.col("reference").cast("double"), 6))


@query(f"""SELECT v AS reference, row_number() OVER (ORDER BY v)::INT AS rank FROM (SELECT DISTINCT l_returnflag AS v FROM lineitem)""")
def encoder_codex_categories(spark, sf):
    return encode.codex_table(task.lineitem(spark, sf), ["l_returnflag"]).select("reference", "rank")


@query(f"SELECT l_orderkey, l_linenumber, {', '.join(f'({t})::INT AS {n}' for n, t in TESTS.items())} FROM lineitem")
def binarize(spark, sf):
    return task.binary(spark, sf, task.FOLD_KEY).drop("y")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice = 0 THEN 0 ELSE round(sign(l_extendedprice) * floor(abs(l_extendedprice) * pow(10.0, 1 - floor(log10(abs(l_extendedprice)))) + 0.5) / pow(10.0, 1 - floor(log10(abs(l_extendedprice)))), 6) END AS rounded FROM lineitem""")
def precision_round(spark, sf):
    return task.lineitem(spark, sf).select("l_orderkey", "l_linenumber", F.round(encode.significant(F.col("l_extendedprice"), 2), 6).alias("rounded"))


@query(f"WITH {SQL_ROWS} SELECT count(*) FILTER ({' OR '.join(f'({t}) IS NULL' for t in TESTS.values())}) AS bad_features, count(*) FILTER (y IS NULL) AS bad_labels, count(*) AS rows FROM b")
def binary_check(spark, sf):
    df = task.binary(spark, sf)
    check_binary(df, NAMES, "y")  # raises where one of the counts isn't zero
    bad = F.lit(False)
    for n in NAMES:
        bad = bad | F.coalesce(~F.col(n).isin(0, 1), F.lit(True))
    return df.agg(F.count_if(bad).alias("bad_features"), F.count_if(F.coalesce(~F.col("y").isin(0, 1), F.lit(True))).alias("bad_labels"), F.count("*").alias("rows"))


@query("WITH m AS (SELECT (v + lag(v) OVER (ORDER BY v)) / 2 AS reference FROM (SELECT DISTINCT l_quantity AS v FROM lineitem)), w AS (SELECT unnest([0, 7, 24.6, 30, 1000])::DOUBLE AS value), r AS (SELECT reference, row_number() OVER (ORDER BY reference)::INT - 1 AS index FROM m WHERE reference IS NOT NULL) SELECT value, index, reference FROM (SELECT *, row_number() OVER (PARTITION BY value ORDER BY abs(reference - value), index) AS nth FROM r, w) WHERE nth = 1")
def find_encoding(spark, sf):
    rules = encode.codex(task.lineitem(spark, sf), ["l_quantity"])
    near_to = [(float(v), encode.find_rule(rules, "l_quantity", v)) for v in (0, 7, 24.6, 30, 1000)]
    return spark.createDataFrame([(v, r.index, float(r.reference)) for v, r in near_to], "value double, index int, reference double")


# ---- aggregation -----------------------------------------------------------------


@query(f"WITH {SQL_PATTERNS} SELECT * FROM pat")
def pattern_table(spark, sf):
    return patterns(spark, sf)


@query(f"WITH {SQL_ROWS} SELECT y AS class, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM b GROUP BY y")
def class_counts(spark, sf):
    return metrics.class_table(task.binary(spark, sf), "y").withColumn("share", F.round("share", 9))


@query(f"WITH {SQL_ROWS} SELECT bits & 6 AS val, round(avg(y), 9) AS prob_1, count(*) AS n FROM b GROUP BY ALL")
def leaf_probabilities(spark, sf):
    cells = patterns(spark, sf).groupBy(F.col("bits").bitwiseAND(F.lit(6)).alias("val")).agg(F.sum("n_0").alias("n_0"), F.sum("n_1").alias("n_1"))
    return cells.select("val", F.round(F.col("n_1") / total(2), 9).alias("prob_1"), total(2).alias("n"))


@query(f"WITH {SQL_PATTERNS} SELECT bits, CASE WHEN n_1 >= n_0 THEN 1 ELSE 0 END AS prediction, least(n_0, n_1) AS falses FROM pat")
def leaf_misclass(spark, sf):
    return patterns(spark, sf).select("bits", best_class(2, None).alias("prediction"), F.least("n_0", "n_1").alias("falses"))


_H = " + ".join(f"-greatest(1e-12, least(1 - 1e-12, n_{k} / (n_0 + n_1))) * ln(greatest(1e-12, least(1 - 1e-12, n_{k} / (n_0 + n_1))))" for k in (0, 1))


@query(f"WITH {SQL_PATTERNS} SELECT bits, round((n_0 + n_1) * ({_H}), 6) AS loss FROM pat")
def leaf_logloss(spark, sf):
    return patterns(spark, sf).select("bits", F.round(entropy_loss(2), 6).alias("loss"))


@query(f"WITH {SQL_PATTERNS}, c AS (SELECT bits, 3.0 * n_0 AS cost_1, 1.0 * n_1 AS cost_0 FROM pat) SELECT bits, CASE WHEN cost_1 <= cost_0 THEN 1 ELSE 0 END AS prediction, least(cost_0, cost_1)::DOUBLE AS cost FROM c")
def leaf_costs(spark, sf):
    from coppice.functions.losses import leaf_columns

    leaf = leaf_columns(2, "misclassification", [[0.0, 1.0], [3.0, 0.0]], 1.0)
    return patterns(spark, sf).select("bits", leaf["prediction"].alias("prediction"), leaf["loss"].alias("cost"))


@query(f"WITH {SQL_PATTERNS} SELECT bits, n_0, n_1, CASE WHEN n_0 >= n_1 THEN 0 ELSE 1 END AS majority, greatest(n_0, n_1) AS majority_rows FROM pat")
def majority_mask(spark, sf):
    return encode.majority_mask(patterns(spark, sf), 2)


@query(f"WITH {SQL_PATTERNS} SELECT round(sum(least(n_0, n_1)) / sum(n_0 + n_1), 9) AS bound FROM pat")
def equivalent_points_bound(spark, sf):
    return patterns(spark, sf).agg(F.round(F.sum(F.least("n_0", "n_1")) / F.sum(total(2)), 9).alias("bound"))


@query(f"WITH {SQL_ROWS} SELECT y AS class, round(1 / (2 * count(*)), 12) AS cost FROM b GROUP BY y")
def balanced_cost(spark, sf):
    row = patterns(spark, sf).agg(F.sum("n_0").alias("n_0"), F.sum("n_1").alias("n_1")).first()
    costs = balanced_costs([row.n_0, row.n_1])
    return spark.createDataFrame([(0, round(costs[1][0], 12)), (1, round(costs[0][1], 12))], "class int, cost double")


@query(f"""WITH {SQL_PATTERNS}, f AS (SELECT unnest(range({P}))::INT AS feature), s AS (SELECT feature, (bits >> feature) & 1 AS side, sum(n_0) AS n_0, sum(n_1) AS n_1 FROM pat, f GROUP BY ALL), n AS (SELECT sum(n_0 + n_1) AS n FROM pat)
SELECT feature, round(sum((n_0 + n_1) / n * (CASE WHEN n_0 > 0 THEN n_0 * (ln(n_0) - ln((n_0 + n_1) / n)) ELSE 0 END + CASE WHEN n_1 > 0 THEN n_1 * (ln(n_1) - ln((n_0 + n_1) / n)) ELSE 0 END)), 3) AS information FROM s, n GROUP BY feature""")
def feature_information(spark, sf):
    side = F.explode(F.array(*[F.lit(k) for k in range(P)])).alias("feature")
    s = patterns(spark, sf).select("bits", "n_0", "n_1", side).groupBy("feature", masks.is_set(F.col("bits"), F.col("feature")).alias("side")).agg(F.sum("n_0").alias("n_0"), F.sum("n_1").alias("n_1"))
    s = s.withColumn("support", total(2) / F.sum(total(2)).over(Window.partitionBy("feature")))  # two rows a feature
    return s.groupBy("feature").agg(F.round(F.sum(analysis.information(2, F.col("support"))), 3).alias("information"))


@query(f"""WITH {SQL_PATTERNS}, f AS (SELECT unnest(range({P}))::INT AS i), n AS (SELECT sum(n_0 + n_1) AS n FROM pat), d AS (SELECT a.i AS i, c.i AS j, sum(CASE WHEN (bits >> a.i) & 1 <> (bits >> c.i) & 1 THEN n_0 + n_1 ELSE 0 END) AS differ, sum(n_0 + n_1) AS all_ FROM pat, f a, f c WHERE a.i < c.i GROUP BY ALL)
SELECT i, j, round(least(differ, all_ - differ) / n, 9) AS distance FROM d, n""")
def feature_distance(spark, sf):
    own = kept(patterns(spark, sf), "patterns")
    rows = own.agg(F.sum(total(2))).first()[0]
    return analysis.feature_distance(own, P, 2, uniform_costs(2, rows)).withColumn("distance", F.round("distance", 9))


@query(f"{_C2}, {_LEAF} SELECT care, val, tp::BIGINT AS tp, tn::BIGINT AS tn FROM cell")
def tp_tn(spark, sf):
    cells = search.cell_counts(patterns(spark, sf), P, 2, 2)
    pred = best_class(2, None)
    return cells.select("care", "val", F.when(pred == 1, F.col("n_1")).otherwise(0).alias("tp"), F.when(pred == 0, F.col("n_0")).otherwise(0).alias("tn"))


def _sql_metric(m: str) -> str:
    return {"f1": "tp / (tp + 0.5 * (p - tp + q - tn))", "bacc": "(tp / p + tn / q) / 2", "auc": "(tn * tp + 0.5 * (tp * (q - tn) + tn * (p - tp))) / (q * p)"}[m]


@query(f"{_NEAR}, pq AS (SELECT sum(n_1) AS p, sum(n_0) AS q FROM pat) SELECT tp::BIGINT AS tp, tn::BIGINT AS tn, leaves, {', '.join(f'round({_sql_metric(m)}, 9) AS {m}' for m in ('f1', 'bacc', 'auc'))} FROM (SELECT DISTINCT tp, tn, leaves FROM t), pq")
def metrics_f1_bacc_auc(spark, sf):
    p, found = near(spark, sf)
    sizes = p.cells.where("k = 0").select(F.col("n_1").alias("p"), F.col("n_0").alias("q"))
    rows = search.root_clusters(p, found).select("tp", "tn", "leaves").distinct().crossJoin(F.broadcast(sizes))  # one row on the right
    return rows.select("tp", "tn", "leaves", *[F.round(metrics.set_metric(m, F.col("p"), F.col("q")), 9).alias(m) for m in ("f1", "bacc", "auc")])


# ---- search ----------------------------------------------------------------------


@query(f"WITH {SQL_PATTERNS}, {sql_cells(P)} SELECT * FROM c")
def cell_counts(spark, sf):
    return search.cell_counts(patterns(spark, sf), P, 2, P)


@query(f"""WITH {SQL_ROWS}, g AS (SELECT {', '.join(f'(bits >> {k}) & 1 AS f{k}' for k in range(3))}, y FROM b) SELECT {', '.join(f'coalesce(f{k}, -1)::INT AS f{k}' for k in range(3))}, GROUPING(f0, f1, f2)::INT AS free, count(*) AS n, sum(y)::BIGINT AS n_1 FROM g GROUP BY CUBE (f0, f1, f2)""")
def cell_counts_cube(spark, sf):
    bits = patterns(spark, sf).select(*[F.call_function("shiftright", F.col("bits"), F.lit(k)).bitwiseAND(F.lit(1)).cast("int").alias(f"f{k}") for k in range(3)], "n_0", "n_1")
    return bits.cube("f0", "f1", "f2").agg(F.grouping_id().cast("int").alias("free"), F.sum(total(2)).alias("n"), F.sum("n_1").alias("n_1")).fillna(-1, ["f0", "f1", "f2"])


@query(f"{_C2}, {_LEAF} SELECT care, val, prediction, falses::BIGINT AS falses, round(leaf_objective, 9) AS objective FROM cell")
def cell_leaf_objective(spark, sf):
    p = search.problem(patterns(spark, sf), P, 2, CONFIG)
    return p.cells.select("care", "val", "prediction", "falses", F.round(p.scale.shown("leaf_objective"), 9).alias("objective"))


@query(f"{_SOLVED} SELECT feature, round(objective, 9) AS objective FROM s0")
def best_split(spark, sf):
    p, levels = solved(spark, sf)
    return search.best_splits(p, levels[0], levels[1]).select("feature", F.round("objective", 9).alias("objective"))


GREEDY = 0.0001
#: The best split of each cell with fewer than two literals, where it saves more than a leaf costs.
_GREEDY = f"""{_C2}, {_LEAF}, g AS (SELECT a.care, a.val, feature, l.prediction AS pl, r.prediction AS pr, row_number() OVER (PARTITION BY a.care, a.val ORDER BY l.falses + r.falses, feature) AS nth, a.falses - l.falses - r.falses AS fall
  FROM cell a, f JOIN cell l ON l.care = a.care + (1 << feature) AND l.val = a.val JOIN cell r ON r.care = a.care + (1 << feature) AND r.val = a.val + (1 << feature) WHERE a.k < 2 AND a.care & (1 << feature) = 0),
s AS (SELECT g.* FROM g, one WHERE nth = 1 AND fall > {GREEDY} * n), root AS (SELECT cell.prediction, s.feature FROM cell LEFT JOIN s USING (care, val) WHERE k = 0),
side AS (SELECT c.val > 0 AS up, CASE WHEN s.feature IS NULL THEN c.prediction::VARCHAR ELSE '(' || s.feature || ' ' || s.pr || ' ' || s.pl || ')' END AS tree FROM root JOIN cell c ON c.care = 1 << root.feature LEFT JOIN s ON s.care = c.care AND s.val = c.val)"""


@query(f"{_GREEDY} SELECT CASE WHEN feature IS NULL THEN prediction::VARCHAR ELSE '(' || feature || ' ' || (SELECT tree FROM side WHERE up) || ' ' || (SELECT tree FROM side WHERE NOT up) || ')' END AS tree FROM root")
def greedy_split(spark, sf):
    p = search.problem(kept(patterns(spark, sf), "patterns"), P, 2, CONFIG.with_(regularization=GREEDY))
    return spark.createDataFrame([(search.greedy(p),)], "tree string")


@query(f"{_SOLVED} SELECT round(v, 9) AS objective FROM v0")
def optimal_objective(spark, sf):
    p, levels = solved(spark, sf)
    return levels[0].select(F.round(p.scale.shown("v"), 9).alias("objective"))


@query(f"{_NEAR} SELECT tree, leaves, objective FROM t WHERE objective <= (SELECT min(objective) FROM t) + 1e-9")
def optimal_trees(spark, sf):
    p, levels = solved(spark, sf)
    tied = search.budgets(p, levels, F.col("v"))
    return search.entries(p, tied, trees=True)[0].select("tree", "leaves", F.round(search.objective(p), 9).alias("objective"))


@query(f"{_BEST_TREE} SELECT tree, leaves, falses::BIGINT AS falses, objective FROM best")
def optimal_tree_depth2(spark, sf):
    p, levels = solved(spark, sf)
    tied = search.budgets(p, levels, F.col("v"))
    best = search.entries(p, tied, trees=True)[0].select("tree", "leaves", "falses", F.round(search.objective(p), 9).alias("objective"))
    return best.orderBy("objective", "leaves", F.length("tree"), "tree").limit(1)


# ---- near-optimal sets -------------------------------------------------------------


@query(f"{_NEAR} SELECT objective, falses::BIGINT AS falses, leaves, count(*)::BIGINT AS trees FROM t GROUP BY ALL")
def rashomon_objectives(spark, sf):
    p, found = near(spark, sf)
    got = search.root_clusters(p, found).groupBy("objective", "falses", "leaves").agg(F.sum("trees").cast("long").alias("trees"))
    return got.withColumn("objective", F.round("objective", 9))


@query(f"{_NEAR} SELECT count(*)::BIGINT AS trees FROM t")
def rashomon_count(spark, sf):
    p, found = near(spark, sf)
    return search.root_clusters(p, found).agg(F.coalesce(F.sum("trees"), F.lit(0)).cast("long").alias("trees"))


@query(f"{_NEAR} SELECT tree, objective, leaves FROM t ORDER BY objective, leaves, tree LIMIT 10")
def rashomon_topk(spark, sf):
    p, found = near(spark, sf, True)
    return found[0].select("tree", F.round(search.objective(p), 9).alias("objective"), "leaves").orderBy("objective", "leaves", "tree").limit(10)


@query(f"{_NEAR} SELECT tree, objective, leaves FROM t")
def rashomon_trees(spark, sf):
    p, found = near(spark, sf, True)
    return found[0].select("tree", F.round(search.objective(p), 9).alias("objective"), "leaves")


@query(f"{_NEAR} SELECT tp::BIGINT AS tp, tn::BIGINT AS tn, leaves, count(*)::BIGINT AS trees FROM t GROUP BY ALL")
def rashomon_tp_tn(spark, sf):
    p, found = near(spark, sf)
    return search.root_clusters(p, found).groupBy("tp", "tn", "leaves").agg(F.sum("trees").cast("long").alias("trees"))


@query(f"{_NEAR} SELECT feature, count(*)::BIGINT AS trees FROM t GROUP BY feature")
def rashomon_root_features(spark, sf):
    _, found = near(spark, sf)
    return found[0].groupBy("feature").agg(F.sum("cnt").cast("long").alias("trees"))


def _covered(metric: str, threshold: float):
    @query(f"{_NEAR}, pq AS (SELECT sum(n_1) AS p, sum(n_0) AS q FROM pat) SELECT tp::BIGINT AS tp, tn::BIGINT AS tn, leaves, round({_sql_metric(metric)}, 9) AS metric, count(*)::BIGINT AS trees FROM t, pq WHERE 1 - {_sql_metric(metric)} + {LAMBDA} * leaves <= {threshold} + 1e-9 GROUP BY ALL")
    def run(spark, sf):
        p, found = near(spark, sf)
        sizes = p.cells.where("k = 0").first()
        got = covered(search.root_clusters(p, found), sizes.n_1, sizes.n_0, LAMBDA, metric, threshold)
        return got.groupBy("tp", "tn", "leaves", F.round("metric", 9).alias("metric")).agg(F.sum("trees").cast("long").alias("trees"))

    name = f"covered_{metric}"
    QUERIES[name], ORACLE_SQL[name] = QUERIES.pop("run"), ORACLE_SQL.pop("run")


for _m, _t in (("f1", 0.2), ("bacc", 0.12), ("auc", 0.12)):
    _covered(_m, _t)


#: Splits of trees in t: the root's, and those of its children.
_DAG = f"""{_NEAR}, r AS (SELECT DISTINCT f.feature, l.feature AS fl, r.feature AS fr, l.leaf AS ll, r.leaf AS lr, l.falses + r.falses AS falses, l.leaves + r.leaves AS leaves
  FROM f JOIN e1 l ON l.care = 1 << f.feature AND l.val = 0 JOIN e1 r ON r.care = 1 << f.feature AND r.val = 1 << f.feature WHERE l.leaf IS NULL OR r.leaf IS NULL OR l.leaf <> r.leaf),
u AS (SELECT r.* FROM r, one WHERE falses / n + {LAMBDA} * leaves <= {BOUND} + 1e-9),
d AS (SELECT 0::BIGINT AS care, 0::BIGINT AS val, feature FROM u UNION SELECT (1 << feature)::BIGINT, 0, fl FROM u WHERE fl >= 0 UNION SELECT (1 << feature)::BIGINT, (1 << feature)::BIGINT, fr FROM u WHERE fr >= 0)"""


@query(f"{_DAG} SELECT care, val, feature, (care + (1 << feature))::BIGINT AS child_care, val AS false_val, (val + (1 << feature))::BIGINT AS true_val FROM d")
def rashomon_dag(spark, sf):
    p, levels = solved(spark, sf)
    reach = search.budgets(p, levels, p.scale.bound(CONFIG))
    return search.dag_edges(p, levels, reach, search.entries(p, reach))


# ---- applying trees ----------------------------------------------------------------

#: A fixed tree over the task's rules: price_high, then discount below it, price_mid elsewhere.
FIXED = trees.parse("(2 (3 1 1) (1 0 0))")
_FIXED_CELL = "CASE WHEN l_extendedprice >= 79194 THEN CASE WHEN l_discount >= 0.05 THEN 'a' ELSE 'b' END ELSE CASE WHEN l_extendedprice >= 53028 THEN 'c' ELSE 'd' END END"


def _fixed(spark, sf, text: str = "(2 (3 1 1) (1 1 0))") -> TreeModel:
    t = trees.parse(text)
    need = sorted({(care, val) for _, care, val, s in t.cells() if s.feature is None})
    inside = [F.col("bits").bitwiseAND(F.lit(care).cast("long")) == val for care, val in need]
    row = patterns(spark, sf).agg(*[F.sum(F.when(x, F.col(f"n_{k}")).otherwise(0)).alias(f"n{i}_{k}") for i, x in enumerate(inside) for k in (0, 1)]).first()  # the leaves of one tree
    stats = {}
    for i, cell in enumerate(need):
        n = [row[f"n{i}_{k}"] for k in (0, 1)]
        stats[cell] = {"loss": 0.0, "probabilities": [x / max(1, sum(n)) for x in n], "rows": sum(n)}
    return TreeModel(CONFIG, RULES, [0, 1], "y", 0.0, 0.0, 1, 1, 0, [t], stats)


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice >= 53028 THEN 1 ELSE 0 END AS prediction FROM lineitem")
def predict_class(spark, sf):
    return predict(_fixed(spark, sf), task.binary(spark, sf, task.FOLD_KEY)).select(*task.FOLD_KEY, "prediction")


_PROB = f"WITH {SQL_ROWS}, g AS (SELECT *, {_FIXED_CELL} AS leaf FROM b), pr AS (SELECT *, avg(y) OVER (PARTITION BY leaf) AS prob_1 FROM g)"


def _probs(spark, sf) -> DataFrame:
    return predict(_fixed(spark, sf), task.binary(spark, sf, task.FOLD_KEY), "prob")


@query(f"{_PROB} SELECT l_orderkey, l_linenumber, round(1 - prob_1, 9) AS prob_0, round(prob_1, 9) AS prob_1 FROM pr")
def predict_prob(spark, sf):
    return _probs(spark, sf).select(*task.FOLD_KEY, F.round("prob_0", 9).alias("prob_0"), F.round("prob_1", 9).alias("prob_1"))


@query("SELECT l_orderkey, l_linenumber, (l_extendedprice >= 53028)::INT + (l_extendedprice >= 79194)::INT + (l_extendedprice >= 26881)::INT AS votes, CASE WHEN l_extendedprice >= 53028 THEN 1 ELSE 0 END AS prediction FROM lineitem")
def predict_ensemble_votes(spark, sf):
    m = _fixed(spark, sf)
    found = [trees.parse(t) for t in ("(1 1 0)", "(2 1 0)", "(0 1 0)")]
    return predict_ensemble(m, task.binary(spark, sf, task.FOLD_KEY), found).select(*task.FOLD_KEY, "votes", "prediction")


@query(f"WITH {SQL_ROWS} SELECT round(avg(CASE WHEN (l_extendedprice >= 53028)::INT = y THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM b")
def accuracy(spark, sf):
    df = predict(_fixed(spark, sf), task.binary(spark, sf))
    return df.agg(F.round(F.avg((F.col("prediction") == F.col("y")).cast("double")), 9).alias("accuracy"))


@query(f"{_NEAR} SELECT leaves, count(*)::BIGINT AS trees FROM t GROUP BY leaves")
def tree_leaf_counts(spark, sf):
    _, found = near(spark, sf, True)
    return found[0].select((F.length("tree") - F.length(F.translate("tree", "(", "")) + 1).alias("leaves")).groupBy("leaves").agg(F.count("*").alias("trees"))


@query(f"{_NEAR} SELECT tree, objective FROM t ORDER BY objective, leaves, length(tree), tree LIMIT 4")
def tree_comparison(spark, sf):
    p, found = near(spark, sf, True)
    return found[0].select("tree", F.round(search.objective(p), 9).alias("objective"), "leaves").orderBy("objective", "leaves", F.length("tree"), "tree").limit(4).drop("leaves")


# ---- cross-fitting -----------------------------------------------------------------


def _folded(spark, sf) -> DataFrame:
    return crossfit.stratified_folds(task.binary(spark, sf, task.FOLD_ORDER), "y", list(task.FOLD_ORDER), 3)


def _train(spark, sf) -> DataFrame:
    return kept(crossfit.fold_patterns(_folded(spark, sf), [F.col(n) == 1 for n in NAMES], F.col("y"), [0, 1]), "train")


_TRAIN = f"WITH {SQL_ROWS}, {_FOLDS}, pat AS (SELECT o.fold, bits, count(*) FILTER (y = 0) AS n_0, count(*) FILTER (y = 1) AS n_1 FROM fb, (SELECT unnest(range(1, 4))::INT AS fold) o WHERE fb.fold <> o.fold GROUP BY ALL), {sql_cells(1, keys='fold')}, nf AS (SELECT fold, sum(n_0 + n_1) AS n FROM pat GROUP BY fold), f AS (SELECT unnest(range({P}))::INT AS feature)"
_CF = CONFIG.with_(max_depth=2, bound=0.0, bound_multiplier=0.6)
_CF_TREES = f"""{_TRAIN}, cell AS (SELECT c.*, CASE WHEN n_1 >= n_0 THEN 1 ELSE 0 END AS prediction, least(n_0, n_1) / n AS loss FROM c JOIN nf USING (fold)),
a AS (SELECT fold, prediction::VARCHAR AS tree, loss + {LAMBDA} AS objective, NULL AS feature FROM cell WHERE k = 0
UNION ALL SELECT l.fold, '(' || feature || ' ' || r.prediction || ' ' || l.prediction || ')', l.loss + r.loss + 2 * {LAMBDA}, feature FROM f JOIN cell l ON l.care = 1 << feature AND l.val = 0 JOIN cell r ON r.fold = l.fold AND r.care = l.care AND r.val = 1 << feature WHERE l.prediction <> r.prediction),
best AS (SELECT fold, min(objective) AS o FROM (SELECT fold, objective FROM a UNION ALL SELECT l.fold, l.loss + r.loss + 2 * {LAMBDA} FROM f JOIN cell l ON l.care = 1 << feature AND l.val = 0 JOIN cell r ON r.fold = l.fold AND r.care = l.care AND r.val = 1 << feature) GROUP BY fold),
sets AS (SELECT a.fold, tree, objective FROM a JOIN best USING (fold) WHERE objective <= o * 1.6 + 1e-9)"""


#: Every tree of two levels of splits, with its loss on each fold's complement.
_CF_EVERY = f"""{_TRAIN.replace(sql_cells(1, keys='fold'), sql_cells(2, keys='fold'))}, cell AS (SELECT c.*, CASE WHEN n_1 >= n_0 THEN 1 ELSE 0 END AS prediction, least(n_0, n_1) / n AS loss FROM c JOIN nf USING (fold)),
e1 AS (SELECT fold, care, val, prediction AS leaf, loss, 1 AS leaves, prediction::VARCHAR AS tree FROM cell WHERE k = 1
  UNION ALL SELECT a.fold, a.care, a.val, NULL, l.loss + r.loss, 2, '(' || feature || ' ' || r.prediction || ' ' || l.prediction || ')' FROM cell a, f JOIN cell l ON l.fold = a.fold AND l.care = a.care + (1 << feature) AND l.val = a.val JOIN cell r ON r.fold = a.fold AND r.care = a.care + (1 << feature) AND r.val = a.val + (1 << feature)
  WHERE a.k = 1 AND a.care & (1 << feature) = 0 AND l.prediction <> r.prediction),
every AS (SELECT fold, loss, 1 AS leaves, prediction::VARCHAR AS tree FROM cell WHERE k = 0
  UNION ALL SELECT l.fold, l.loss + r.loss, l.leaves + r.leaves, '(' || f.feature || ' ' || r.tree || ' ' || l.tree || ')' FROM f JOIN e1 l ON l.care = 1 << f.feature AND l.val = 0 JOIN e1 r ON r.fold = l.fold AND r.care = 1 << f.feature AND r.val = 1 << f.feature WHERE l.leaf IS NULL OR r.leaf IS NULL OR l.leaf <> r.leaf)"""


def _sets(spark, sf) -> DataFrame:
    p = search.problem(_train(spark, sf), P, 2, _CF, ["fold"])
    levels = search.optimum(p)
    reach = search.budgets(p, levels, p.scale.bound(_CF))
    return kept(search.entries(p, reach, trees=True)[0].select("fold", "tree", search.objective(p).alias("objective")), "sets")


@query(f"WITH {SQL_ROWS}, {_FOLDS} SELECT l_orderkey, l_linenumber, y, fold FROM fb")
def stratified_folds(spark, sf):
    return _folded(spark, sf).select(*task.FOLD_KEY, "y", "fold")


@query(f"{_TRAIN} SELECT fold, care, val, k, n_0, n_1 FROM c")
def cf_cell_counts(spark, sf):
    return search.cell_counts(_train(spark, sf), P, 2, 1, ["fold"])


@query(f"""{_TRAIN}, cell AS (SELECT c.*, least(n_0, n_1) / n AS loss FROM c JOIN nf USING (fold)), s AS (SELECT l.fold, feature, round(l.loss + r.loss + 2 * {LAMBDA}, 9) AS objective FROM f JOIN cell l ON l.care = 1 << feature AND l.val = 0 JOIN cell r ON r.fold = l.fold AND r.care = l.care AND r.val = 1 << feature)
SELECT fold, feature, objective FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY objective, feature) AS nth FROM s) WHERE nth = 1""")
def cf_best_split(spark, sf):
    p = search.problem(_train(spark, sf), P, 2, _CF, ["fold"])
    levels = search.optimum(p)
    splits = search.best_splits(p, levels[0], levels[1]).select("fold", "feature", F.round("objective", 9).alias("objective"))
    return splits.groupBy("fold").agg(F.min(F.struct("objective", "feature")).alias("x")).select("fold", "x.feature", "x.objective")


@query(f"{_CF_TREES} SELECT tree FROM sets GROUP BY tree HAVING count(DISTINCT fold) = 3")
def tree_intersection(spark, sf):
    return crossfit.intersection(_sets(spark, sf), 3)


@query(f"{_CF_TREES}, x AS (SELECT count(*) FILTER (a.tree IS NOT NULL AND z.tree IS NOT NULL) AS common, count(*) FILTER (z.tree IS NULL) AS only_first, count(*) FILTER (a.tree IS NULL) AS only_second FROM (SELECT DISTINCT tree FROM sets WHERE fold = 1) a FULL JOIN (SELECT DISTINCT tree FROM sets WHERE fold = 2) z ON a.tree = z.tree) SELECT *, round(common / (common + only_first + only_second), 9) AS overlap FROM x")
def rashomon_compare(spark, sf):
    sets = _sets(spark, sf)
    return crossfit.compare(sets.where("fold = 1"), sets.where("fold = 2")).withColumn("overlap", F.round("overlap", 9))


@query(f"{_CF_TREES} SELECT min(n) AS min, max(n) AS max, round(avg(n), 9) AS mean, round(stddev_samp(n), 9) AS sd FROM (SELECT fold, count(*) AS n FROM sets GROUP BY fold)")
def cf_analysis(spark, sf):
    sizes = _sets(spark, sf).groupBy("fold").agg(F.count("*").alias("n"))
    return metrics.size_stats(sizes, "n").select("min", "max", F.round("mean", 9).alias("mean"), F.round("sd", 9).alias("sd"))


@query(f"{_CF_TREES}, s AS (SELECT avg(n) AS average_trees FROM (SELECT fold, count(*) AS n FROM sets GROUP BY fold)), i AS (SELECT count(*) AS intersecting FROM (SELECT tree FROM sets GROUP BY tree HAVING count(DISTINCT fold) = 3)) SELECT 3 AS total_folds, round(average_trees, 9) AS average_trees, intersecting, round(intersecting / average_trees, 9) AS stability FROM s, i")
def cf_metrics(spark, sf):
    return crossfit.cf_metrics(_sets(spark, sf), 3).withColumn("average_trees", F.round("average_trees", 9)).withColumn("stability", F.round("stability", 9))


@query(f"{_CF_TREES}, i AS (SELECT DISTINCT tree FROM sets) SELECT g.fold, i.tree, s.tree IS NOT NULL AS present FROM (SELECT DISTINCT fold FROM sets) g CROSS JOIN i LEFT JOIN sets s ON s.fold = g.fold AND s.tree = i.tree")
def cf_stability(spark, sf):
    sets = _sets(spark, sf)
    return crossfit.presence(sets, sets)


_GRID = (0.001, 0.01, 0.1, 0.5)


@query(f"""{_TRAIN}, g AS (SELECT unnest([{', '.join(map(str, _GRID))}])::DOUBLE AS regularization), cell AS (SELECT c.*, least(n_0, n_1) / n AS loss FROM c JOIN nf USING (fold)),
s AS (SELECT l.fold, l.loss + r.loss AS loss FROM f JOIN cell l ON l.care = 1 << feature AND l.val = 0 JOIN cell r ON r.fold = l.fold AND r.care = l.care AND r.val = 1 << feature),
v AS (SELECT regularization, fold, min(x) AS v FROM (SELECT regularization, fold, loss + regularization AS x FROM cell, g WHERE k = 0 UNION ALL SELECT regularization, fold, loss + 2 * regularization FROM s, g) GROUP BY ALL)
SELECT regularization, round(avg(v), 9) AS cv_loss FROM v GROUP BY regularization""")
def cv_grid(spark, sf):
    from coppice.operators.tune import cv_losses

    train, parts = _train(spark, sf), None
    for x in _GRID:
        p = search.problem(train, P, 2, _CF.with_(regularization=x), ["fold"])
        own = search.optimum(p)[0].select("fold", F.lit(x).alias("regularization"), p.scale.shown("v").alias("loss"))
        parts = own if parts is None else parts.unionByName(own)
    return cv_losses(parts).withColumn("cv_loss", F.round("cv_loss", 9))


# ---- scores ------------------------------------------------------------------------

_SCORE_SQL = {
    "mae": "avg(abs(prob_1 - y))", "rmse": "sqrt(avg((prob_1 - y) * (prob_1 - y)))", "brier": "avg((prob_1 - y) * (prob_1 - y))", "corr": "corr(prob_1, y)",
    "cross_entropy": "-avg(y * ln(greatest(1e-15, least(1 - 1e-15, prob_1))) + (1 - y) * ln(1 - greatest(1e-15, least(1 - 1e-15, prob_1))))", "calibration": "abs(avg(prob_1) - avg(y))",
}


def _score(name: str):
    def run(spark, sf):
        return _probs(spark, sf).agg(F.round(metrics.scores("y", "prob_1")[name], 6).alias(name)).select(F.when(F.abs(name) < 1e-6, 0.0).otherwise(F.col(name)).alias(name))

    QUERIES[f"prob_{name}"] = run
    ORACLE_SQL[f"prob_{name}"] = f"{_PROB}, x AS (SELECT round({_SCORE_SQL[name]}, 6) AS {name} FROM pr) SELECT CASE WHEN abs({name}) < 1e-6 THEN 0.0 ELSE {name} END::DOUBLE AS {name} FROM x"


for _n in _SCORE_SQL:
    _score(_n)


@query(f"{_PROB} SELECT greatest(1, least(10, ceil(prob_1 * 10)))::INT AS bin, count(*) AS n, round(avg(prob_1), 6) AS mean_prob, round(avg(y), 6) AS share FROM pr GROUP BY ALL")
def calibration_bins(spark, sf):
    return metrics.calibration_bins(_probs(spark, sf), "y", "prob_1").select("bin", "n", F.round("mean_prob", 6).alias("mean_prob"), F.round("share", 6).alias("share"))


@query(f"{_PROB} SELECT round(min(prob_1), 9) AS min, round(max(prob_1), 9) AS max, round(avg(prob_1), 6) AS mean FROM pr")
def probability_summary(spark, sf):
    return _probs(spark, sf).agg(F.round(F.min("prob_1"), 9).alias("min"), F.round(F.max("prob_1"), 9).alias("max"), F.round(F.avg("prob_1"), 6).alias("mean"))


# ---- causal helpers ----------------------------------------------------------------

_STUDY = "s AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 1000 AS y, (l_quantity >= 25)::INT AS a, l_returnflag AS g FROM lineitem), c AS (SELECT g, avg(a) AS pi, avg(y) FILTER (a = 1) AS mu1, avg(y) FILTER (a = 0) AS mu0 FROM s GROUP BY g), i AS (SELECT s.*, (a * y - (a - pi) * mu1) / pi - ((1 - a) * y - ((1 - a) - (1 - pi)) * mu0) / (1 - pi) AS influence FROM s JOIN c USING (g))"


def _study(spark, sf) -> DataFrame:
    df = task.lineitem(spark, sf).select(*task.FOLD_KEY, (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_quantity") >= 25).cast("int").alias("a"), F.col("l_returnflag").alias("g"))
    return causal.cell_means(df, ["g"], "y", "a").withColumn("influence", causal.influence("y", "a", "pi", "mu1", "mu0"))


@query(f"WITH {_STUDY} SELECT l_orderkey, l_linenumber, round(influence, 4) AS influence FROM i")
def dr_influence(spark, sf):
    return _study(spark, sf).select(*task.FOLD_KEY, F.round("influence", 4).alias("influence"))


@query(f"WITH {_STUDY} SELECT round(avg(influence), 6) AS estimate, round(stddev_samp(influence) / sqrt(count(*)), 6) AS std_error, count(*) AS n FROM i")
def dr_estimate(spark, sf):
    return causal.dr_estimate(_study(spark, sf)).select(F.round("estimate", 6).alias("estimate"), F.round("std_error", 6).alias("std_error"), "n")


@query("WITH s AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, avg(l_quantity) AS m FROM lineitem) SELECT l_orderkey, l_linenumber, round(l_extendedprice - (a + b * l_quantity) + a + b * m, 3) AS residual FROM lineitem, s")
def residualize(spark, sf):
    return causal.residualize(task.lineitem(spark, sf), "l_extendedprice", "l_quantity").select(*task.FOLD_KEY, F.round("residual", 3).alias("residual"))
