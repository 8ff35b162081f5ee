"""Queries that go through the public calls, over more kinds of fits; SQL enumerates the same trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from coppice.config import FitConfig
from coppice.functions import analysis
from coppice.operators import causal, crossfit, encode, search
from coppice.operators.fit import accuracy, fit_patterns, fit_rashomon, fit_tree
from coppice.operators.tune import auto_tune
from coppice.plans import task
from coppice.plans.queries import _BEST_TREE, _C2, _CF, _CF_TREES, _E1, _LEAF, _NEAR, BOUND, CONFIG, LAMBDA, ORACLE_SQL, QUERIES, RULES, patterns, query
from coppice.plans.task import NAMES, P, SQL_BITS, SQL_PATTERNS, sql_cells
from coppice.sources.work import kept

__all__ = ["QUERIES", "ORACLE_SQL"]


@query(f"{_BEST_TREE}, many AS (SELECT count(*) AS n_optimal FROM t WHERE objective <= (SELECT min(objective) FROM t) + 1e-9) SELECT tree, leaves, objective, n_optimal, n_optimal AS n_trees, n::BIGINT AS rows FROM best, many, one")
def api_fit_tree(spark, sf):
    m = fit_tree(task.binary(spark, sf), "y", NAMES, CONFIG)
    return spark.createDataFrame([(m.tree.text(), m.tree.leaves(), round(m.objective, 9), m.n_optimal, m.n_trees, m.rows)], "tree string, leaves int, objective double, n_optimal long, n_trees long, rows long")


@query(f"{_BEST_TREE} SELECT round(1 - falses / n, 9) AS accuracy FROM best, one")
def api_accuracy(spark, sf):
    df = task.binary(spark, sf)
    return spark.createDataFrame([(round(accuracy(fit_tree(df, "y", NAMES, CONFIG), df), 9),)], "accuracy double")


@query(f"{_NEAR} SELECT tree, leaves FROM t")
def api_fit_rashomon(spark, sf):
    return fit_rashomon(task.binary(spark, sf), "y", NAMES, CONFIG).trees_df(spark).select("tree", "leaves")


@query(f"{_NEAR} SELECT tree, leaves FROM t ORDER BY objective, leaves, length(tree), tree LIMIT 3")
def api_fit_rashomon_first(spark, sf):
    """The best three, under a limit that the whole set is over."""
    return fit_rashomon(task.binary(spark, sf), "y", NAMES, CONFIG.with_(model_limit=3), max_trees=3).trees_df(spark).select("tree", "leaves")


@query(f"{_CF_TREES} SELECT fold, tree, round(objective, 9) AS objective FROM sets")
def api_cross_fit(spark, sf):
    got = crossfit.cross_fit(task.binary(spark, sf, task.FOLD_ORDER), "y", NAMES, _CF, 3, list(task.FOLD_ORDER))
    return got.sets.select("fold", "tree", F.round("objective", 9).alias("objective"))


@query(f"{_CF_TREES}, x AS (SELECT DISTINCT fold, tree, unnest(regexp_extract_all(tree, '\\((\\d+)', 1))::INT AS feature FROM sets) SELECT fold, feature, count(*) AS trees FROM x GROUP BY ALL")
def api_cross_fit_features(spark, sf):
    got = crossfit.cross_fit(task.binary(spark, sf, task.FOLD_ORDER), "y", NAMES, _CF, 3, list(task.FOLD_ORDER))
    return got.features().select("fold", "feature", "trees")


# ---- other losses and limits, one split --------------------------------------------

#: Cells of at most one literal.
_ONE = f"WITH {SQL_PATTERNS}, {sql_cells(1)}, one AS (SELECT sum(n_0 + n_1) AS n, sum(n_0) AS all_0, sum(n_1) AS all_1 FROM pat), f AS (SELECT unnest(range({P}))::INT AS feature)"


def _sql_one(loss: str, prediction: str, penalty: float, where: str = "l.prediction <> r.prediction") -> str:
    """CTE ``a``: (tree, objective) of the leaf and of all trees of one split; ``w``: the same with trivial ones."""
    trees = f"""SELECT prediction::VARCHAR AS tree, loss + {penalty} AS objective FROM cell WHERE k = 0
UNION ALL SELECT '(' || feature || ' ' || r.prediction || ' ' || l.prediction || ')', l.loss + r.loss + 2 * {penalty} FROM one, f JOIN cell l ON l.care = 1 << feature AND l.val = 0 JOIN cell r ON r.care = l.care AND r.val = 1 << feature"""
    return f"{_ONE}, cell AS (SELECT c.*, n_0 + n_1 AS n_total, {prediction} AS prediction, {loss} AS loss FROM c, one), a AS ({trees} WHERE {where}), w AS ({trees}), o AS (SELECT min(objective) AS best FROM w)"


def _sql_two(loss: str, prediction: str, penalty: float, trivial: bool = False, support: int = 0) -> str:
    """CTE ``a``: (tree, objective) of all trees of up to two splits on a path."""
    ok = f" AND least(l.n_total, n - l.n_total) > {support} AND least(r.n_total, n - r.n_total) > {support}" if support else ""
    below = "JOIN {0} l ON l.care = {1} + (1 << feature) AND l.val = {2} JOIN {0} r ON r.care = l.care AND r.val = {2} + (1 << feature)"
    return f"""{_ONE.replace(sql_cells(1), sql_cells(2))}, cell AS (SELECT c.*, n_0 + n_1 AS n_total, {prediction} AS prediction, {loss} AS loss FROM c, one),
e AS (SELECT care, val, n_total, prediction AS leaf, loss, 1 AS leaves, prediction::VARCHAR AS tree FROM cell WHERE k = 1
  UNION ALL SELECT a.care, a.val, a.n_total, NULL, l.loss + r.loss, 2, '(' || feature || ' ' || r.prediction || ' ' || l.prediction || ')' FROM one, cell a, f {below.format('cell', 'a.care', 'a.val')} WHERE a.k = 1 AND a.care & (1 << feature) = 0{'' if trivial else ' AND l.prediction <> r.prediction'}{ok}),
a AS (SELECT prediction::VARCHAR AS tree, loss + {penalty} AS objective FROM cell WHERE k = 0
  UNION ALL SELECT '(' || feature || ' ' || r.tree || ' ' || l.tree || ')', l.loss + r.loss + {penalty} * (l.leaves + r.leaves) FROM one, f {below.format('e', '0', '0')} WHERE {'true' if trivial else '(l.leaf IS NULL OR r.leaf IS NULL OR l.leaf <> r.leaf)'}{ok}),
o AS (SELECT min(objective) AS best FROM a)"""


def _fitted(spark, sf, config: FitConfig):
    m = fit_rashomon(task.binary(spark, sf), "y", NAMES, config)
    rows = [(t.text(), len(m.trees), m.n_optimal) for t in m.trees]
    return spark.createDataFrame(rows, "tree string, n_trees long, n_optimal long").withColumn("objective", F.round(F.lit(m.objective), 6))


def _sql_fitted(multiplier: float) -> str:
    return f" SELECT tree, count(*) OVER () AS n_trees, (SELECT count(*) FROM a WHERE objective <= best * (1 + 1e-12)) AS n_optimal, round(best, 6)::DOUBLE AS objective FROM a, o WHERE objective <= best * (1 + {multiplier}) * (1 + 1e-12)"


_MAJORITY = "CASE WHEN n_1 >= n_0 THEN 1 ELSE 0 END"
_H = " + ".join(f"-greatest(1e-12, least(1 - 1e-12, n_{k} / (n_0 + n_1))) * ln(greatest(1e-12, least(1 - 1e-12, n_{k} / (n_0 + n_1))))" for k in (0, 1))


@query(_sql_two(f"(n_0 + n_1) * ({_H})", _MAJORITY, 20.0) + _sql_fitted(1.5))
def api_log_loss(spark, sf):
    return _fitted(spark, sf, FitConfig(loss="log_loss", regularization=20.0, max_depth=3, bound_multiplier=1.5))


@query(_sql_two("least(0.00003 * n_1, 0.00001 * n_0)", "CASE WHEN 1 * n_0 <= 3 * n_1 THEN 1 ELSE 0 END", 0.01) + _sql_fitted(1.2))
def api_costs(spark, sf):
    return _fitted(spark, sf, FitConfig(regularization=0.01, max_depth=3, bound_multiplier=1.2, costs=((0.0, 0.00003), (0.00001, 0.0))))


@query(_sql_two("least(n_1 / (2 * all_1), n_0 / (2 * all_0))", "CASE WHEN n_0 * all_1 <= n_1 * all_0 THEN 1 ELSE 0 END", 0.01) + _sql_fitted(1.2))
def api_balance(spark, sf):
    return _fitted(spark, sf, FitConfig(regularization=0.01, max_depth=3, bound_multiplier=1.2, balance=True))


@query(_sql_two("least(n_0, n_1) / n", _MAJORITY, 0.005, True, 2000) + _sql_fitted(0.9))
def api_min_support_trivial(spark, sf):
    """Splits of one class on both sides are allowed, and both sides keep, and leave, over 2 000 rows."""
    return _fitted(spark, sf, FitConfig(regularization=0.005, max_depth=3, bound_multiplier=0.9, min_support=2_000, ignore_trivial=False))


_THREE = "CASE WHEN l_extendedprice * (1 - l_discount) >= 60000 THEN 2 WHEN l_extendedprice * (1 - l_discount) >= 30000 THEN 1 ELSE 0 END"
_PAT3 = f"WITH b AS (SELECT ({SQL_BITS})::BIGINT AS bits, {_THREE} AS y FROM lineitem), pat AS (SELECT bits, count(*) FILTER (y = 0) AS n_0, count(*) FILTER (y = 1) AS n_1, count(*) FILTER (y = 2) AS n_2 FROM b GROUP BY bits)"


@query(f"""{_PAT3}, one AS (SELECT sum(n_0 + n_1 + n_2) AS n FROM pat), f AS (SELECT unnest(range({P}))::INT AS feature), c AS (SELECT m AS care, bits & m AS val, sum(n_0) AS n_0, sum(n_1) AS n_1, sum(n_2) AS n_2 FROM pat, (SELECT unnest(range({1 << P}))::BIGINT AS m) WHERE bit_count(m) <= 1 GROUP BY ALL),
cell AS (SELECT c.*, CASE WHEN n_2 >= greatest(n_0, n_1) THEN 2 WHEN n_1 >= n_0 THEN 1 ELSE 0 END AS prediction, (n_0 + n_1 + n_2 - greatest(n_0, n_1, n_2)) / n AS loss FROM c, one),
w AS (SELECT prediction::VARCHAR AS tree, loss + 0.01 AS objective, false AS trivial FROM cell WHERE care = 0 UNION ALL SELECT '(' || feature || ' ' || r.prediction || ' ' || l.prediction || ')', l.loss + r.loss + 0.02, l.prediction = r.prediction FROM f JOIN cell l ON l.care = 1 << feature AND l.val = 0 JOIN cell r ON r.care = l.care AND r.val = 1 << feature),
o AS (SELECT min(objective) AS best FROM w), a AS (SELECT tree, objective FROM w WHERE NOT trivial)""" + _sql_fitted(0.8))
def api_three_classes(spark, sf):
    df = task.binary(spark, sf, ("l_extendedprice", "l_discount")).withColumn("y", F.expr(_THREE)).select(*NAMES, "y")
    m = fit_rashomon(df, "y", NAMES, FitConfig(regularization=0.01, max_depth=2, bound_multiplier=0.8))
    rows = [(t.text(), len(m.trees), m.n_optimal) for t in m.trees]
    return spark.createDataFrame(rows, "tree string, n_trees long, n_optimal long").withColumn("objective", F.round(F.lit(m.objective), 6))


# ---- deeper trees ------------------------------------------------------------------


def _sql_deep() -> str:
    """CTE ``e0``: (falses, leaves) of all trees of up to three splits on a path."""
    cells = f"WITH {SQL_PATTERNS}, {sql_cells(3)}, one AS (SELECT sum(n_0 + n_1) AS n FROM pat), f AS (SELECT unnest(range({P}))::INT AS feature), {_LEAF}, e3 AS (SELECT care, val, prediction AS leaf, falses, 1 AS leaves FROM cell WHERE k = 3)"
    for k in (2, 1, 0):
        cells += f""", e{k} AS (SELECT care, val, prediction AS leaf, falses, 1 AS leaves FROM cell WHERE k = {k} UNION ALL SELECT a.care, a.val, NULL, l.falses + r.falses, l.leaves + r.leaves FROM cell a, f JOIN e{k + 1} l ON l.care = a.care + (1 << feature) AND l.val = a.val JOIN e{k + 1} r ON r.care = l.care AND r.val = a.val + (1 << feature)
  WHERE a.k = {k} AND a.care & (1 << feature) = 0 AND (l.leaf IS NULL OR r.leaf IS NULL OR l.leaf <> r.leaf))"""
    return cells


@query(f"{_sql_deep()} SELECT falses::BIGINT AS falses, leaves, round(falses / n + {LAMBDA} * leaves, 9) AS objective, count(*) AS trees FROM e0, one WHERE falses / n + {LAMBDA} * leaves <= 0.14 + 1e-9 GROUP BY ALL")
def api_depth_three(spark, sf):
    m = fit_patterns(kept(patterns(spark, sf), "patterns"), RULES, [0, 1], "y", CONFIG.with_(max_depth=4, bound=0.14), single_tree=False, max_trees=1)
    return m.clusters.groupBy("falses", "leaves", F.round("objective", 9).alias("objective")).agg(F.sum("trees").cast("long").alias("trees"))


@query(f"""{_C2}, {_LEAF}, {_E1}, e0 AS (SELECT prediction::VARCHAR AS tree, falses, 1 AS leaves FROM cell WHERE k = 0 UNION ALL SELECT '(' || f.feature || ' ' || r.tree || ' ' || l.tree || ')', l.falses + r.falses, l.leaves + r.leaves
  FROM f JOIN e1 l ON l.care = 1 << f.feature AND l.val = 0 JOIN e1 r ON r.care = l.care AND r.val = 1 << f.feature WHERE (l.leaf IS NOT NULL OR r.leaf IS NOT NULL) AND (l.leaf IS NULL OR r.leaf IS NULL OR l.leaf <> r.leaf))
SELECT tree, leaves FROM e0, one WHERE falses / n + {LAMBDA} * leaves <= {BOUND} + 1e-9""")
def api_rule_lists(spark, sf):
    p = search.problem(kept(patterns(spark, sf), "patterns"), P, 2, CONFIG.with_(rule_list=True))
    reach = search.budgets(p, search.optimum(p), p.scale.bound(p.config))
    return search.entries(p, reach, trees=True)[0].select("tree", "leaves")


# ---- tuning ------------------------------------------------------------------------


@query(_sql_one("least(n_0, n_1) / n", _MAJORITY, LAMBDA).replace("WITH ", "WITH RECURSIVE ", 1) + """,
s AS (SELECT 1 AS step, 0.01::DOUBLE AS low, 0.5::DOUBLE AS high, 0.255::DOUBLE AS value, (SELECT count(*) FROM a, o WHERE objective <= best * 1.255 * (1 + 1e-12)) AS n
UNION ALL SELECT step + 1, x.low, x.high, (x.low + x.high) / 2, (SELECT count(*) FROM a, o WHERE objective <= best * (1 + (x.low + x.high) / 2) * (1 + 1e-12))
FROM (SELECT step, n, CASE WHEN n > 3 THEN low ELSE value END AS low, CASE WHEN n > 3 THEN value ELSE high END AS high FROM s WHERE NOT n BETWEEN 2 AND 3 AND step < 20) x WHERE x.high - x.low > 0.001)
SELECT round(arg_min(value, greatest(2 - n, n - 3, 0) * 100 + step), 9) AS value, arg_min(n, greatest(2 - n, n - 3, 0) * 100 + step) AS n_trees, max(step)::BIGINT AS steps, bool_or(n BETWEEN 2 AND 3) AS converged FROM s""")
def api_auto_tune(spark, sf):
    got = auto_tune(task.binary(spark, sf), "y", NAMES, 2, 3, config=FitConfig(regularization=LAMBDA, max_depth=2))
    return spark.createDataFrame([(round(got.value, 9), got.n_trees, got.steps, got.converged)], "value double, n_trees long, steps long, converged boolean")


# ---- rules made from columns -------------------------------------------------------

_N_TAX = 8


@query(f"""WITH q AS (SELECT DISTINCT l_tax AS v FROM lineitem), m AS (SELECT list(x ORDER BY x) AS refs FROM (SELECT (v + lag(v) OVER (ORDER BY v)) / 2 AS x FROM q) WHERE x IS NOT NULL)
SELECT l_orderkey, l_linenumber, {', '.join(f'(l_tax >= refs[{k + 1}])::INT AS f{k}' for k in range(_N_TAX))}, (l_linestatus = (SELECT max(l_linestatus) FROM lineitem))::INT AS f{_N_TAX}, {', '.join(f"(l_returnflag = '{c}')::INT AS f{_N_TAX + 1 + k}" for k, c in enumerate('ANR'))} FROM lineitem, m""")
def encoder_rows(spark, sf):
    df = task.lineitem(spark, sf)
    rules = encode.codex(df, ["l_tax", "l_linestatus", "l_returnflag"])
    return encode.binarize(df, rules, ["l_orderkey", "l_linenumber"])


# ---- measures of sets and features -------------------------------------------------

_CARE = 6
_SPREAD = ((0.0, 2.0), (3.0, 0.5))


@query(f"""WITH {SQL_PATTERNS}, one AS (SELECT sum(n_0 + n_1) AS n FROM pat), s AS (SELECT bits & {_CARE} AS val, sum(n_0)::BIGINT AS n_0, sum(n_1)::BIGINT AS n_1, sum(least(n_0, n_1)) AS least_ FROM pat GROUP BY ALL), x AS (SELECT s.*, (n_0 + n_1) / n AS support, n FROM s, one)
SELECT val, n_0, n_1, round(support, 9) AS support, round((n_0 + n_1) / n, 9) AS potential, round(least_ / n, 9) AS min_loss, round(least(n_0, n_1) / n, 9) AS max_loss,
  round(support * ((CASE WHEN n_0 > 0 THEN n_0 * (ln(n_0) - ln(support)) ELSE 0 END) + (CASE WHEN n_1 > 0 THEN n_1 * (ln(n_1) - ln(support)) ELSE 0 END)), 3) AS information FROM x""")
def set_measures(spark, sf):
    own = kept(patterns(spark, sf), "patterns")
    rows = own.agg(F.sum(F.col("n_0") + F.col("n_1"))).first()[0]
    got = analysis.set_measures(own, _CARE, 2, rows)
    return got.select("val", "n_0", "n_1", *[F.round(c, 9).alias(c) for c in ("support", "potential", "min_loss", "max_loss")], F.round("information", 3).alias("information"))


@query(f"""WITH {SQL_PATTERNS}, f AS (SELECT unnest(range({P}))::INT AS i), d AS (SELECT a.i AS i, c.i AS j, sum(CASE WHEN (bits >> a.i) & 1 <> (bits >> c.i) & 1 THEN 3.0 * n_0 + 1.5 * n_1 ELSE 0 END) AS differ, sum(3.0 * n_0 + 1.5 * n_1) AS whole FROM pat, f a, f c WHERE a.i < c.i GROUP BY ALL)
SELECT i, j, round(least(differ, whole - differ), 6)::DOUBLE AS distance FROM d""")
def feature_distance_costs(spark, sf):
    return analysis.feature_distance(patterns(spark, sf), P, 2, _SPREAD).withColumn("distance", F.round("distance", 6))


@query(f"WITH {SQL_PATTERNS} SELECT bits, CASE WHEN 2.0 * n_1 < 3.0 * n_0 + 0.5 * n_1 THEN 2.0 * n_1 ELSE 3.0 * n_0 + 0.5 * n_1 END::DOUBLE AS least FROM pat")
def equivalent_points_costs(spark, sf):
    return patterns(spark, sf).select("bits", analysis.equivalent_points(2, _SPREAD).alias("least"))


# ---- doubly robust estimates, cross-fitted ----------------------------------------


@query("""WITH s AS (SELECT l_extendedprice / 1000 AS y, (l_quantity >= 25)::INT AS a, l_returnflag AS g, l_orderkey, l_linenumber FROM lineitem),
m AS (SELECT s.*, r AS repeat, (l_orderkey + r * l_linenumber) % 3 AS fold FROM s, (SELECT unnest(range(2))::INT AS r)),
t AS (SELECT o.repeat, o.fold, x.g, avg(x.a) AS pi, avg(x.y) FILTER (x.a = 1) AS mu1, avg(x.y) FILTER (x.a = 0) AS mu0 FROM (SELECT DISTINCT repeat, fold FROM m) o JOIN m x ON x.repeat = o.repeat AND x.fold <> o.fold GROUP BY ALL),
i AS (SELECT m.repeat, (a * y - (a - pi) * mu1) / pi - ((1 - a) * y - ((1 - a) - (1 - pi)) * mu0) / (1 - pi) AS v FROM m JOIN t USING (repeat, fold, g))
SELECT repeat, round(avg(v), 6) AS estimate, round(stddev_samp(v) / sqrt(count(*)), 6) AS std_error, count(*) AS n FROM i GROUP BY repeat""")
def dr_cross_fitted(spark, sf):
    df = task.lineitem(spark, sf).select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_quantity") >= 25).cast("int").alias("a"), F.col("l_returnflag").alias("g"))
    got = causal.cross_fitted(df, ["g"], "y", "a", [(F.col("l_orderkey") + k * F.col("l_linenumber")) % 3 for k in range(2)])
    return got.select("repeat", F.round("estimate", 6).alias("estimate"), F.round("std_error", 6).alias("std_error"), "n")
