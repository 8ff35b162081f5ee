"""Queries over whole sets of trees as tables, and over the search by levels; SQL finds the same trees by enumeration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.config import FitConfig
from coppice.operators import encode, levelwise, search, treerows, trees, votes
from coppice.operators.crossfit import tune_intersecting
from coppice.operators.fit import TreeModel, fit, fit_patterns
from coppice.plans import wide
from coppice.plans.api_queries import _sql_two
from coppice.plans.queries import _CF_EVERY, _NEAR, BOUND, CONFIG, LAMBDA, ORACLE_SQL, QUERIES, RULES, _train, near, patterns, query
from coppice.plans.task import P, SQL_PATTERNS
from coppice.sources.work import kept

__all__ = ["QUERIES", "ORACLE_SQL"]


def _set(spark, sf) -> DataFrame:
    """(tree_id, tree) of the near-optimal set; the text itself is the name."""
    _, found = near(spark, sf, True)
    return found[0].select(F.col("tree").alias("tree_id"), "tree")


#: Nodes of all trees in t, read from their texts: s is a node's own text.
_ONE = r"'^\((\d+) (\d+|\(\d+ \d+ \d+\)) (\d+|\(\d+ \d+ \d+\))\)$'"
_NODES = rf"""{_NEAR}, n1 AS (SELECT tree, 1::BIGINT AS id, 0 AS depth, tree AS s FROM t),
n2 AS (SELECT tree, 3::BIGINT AS id, 1 AS depth, regexp_extract(s, {_ONE}, 2) AS s FROM n1 WHERE s[1] = '(' UNION ALL SELECT tree, 2, 1, regexp_extract(s, {_ONE}, 3) FROM n1 WHERE s[1] = '('),
n3 AS (SELECT tree, 2 * id + 1 AS id, 2 AS depth, regexp_extract(s, {_ONE}, 2) AS s FROM n2 WHERE s[1] = '(' UNION ALL SELECT tree, 2 * id, 2, regexp_extract(s, {_ONE}, 3) FROM n2 WHERE s[1] = '('),
nd AS (SELECT tree, id, depth, s, s[1] = '(' AS split, CASE WHEN s[1] = '(' THEN regexp_extract(s, '^.(\d+)', 1)::INT END AS feature, [{', '.join(f"'{r.name}'" for r in RULES)}][coalesce(try_cast(regexp_extract(s, '^.(\d+)', 1) AS INT), 0) + 1] AS name FROM (SELECT * FROM n1 UNION ALL SELECT * FROM n2 UNION ALL SELECT * FROM n3))"""


@query(f"{_NODES} SELECT tree AS tree_id, id, coalesce(CASE WHEN id > 1 THEN id // 2 END, 0)::BIGINT AS parent_id, depth, CASE WHEN split THEN 'decision' ELSE 'leaf' END AS type, CASE WHEN split THEN name ELSE 'Pred: ' || s END AS label, CASE WHEN split THEN '' ELSE s END AS prediction, coalesce(feature, -1) AS feature FROM nd")
def tree_nodes(spark, sf):
    rows = treerows.nodes_table(_set(spark, sf), RULES, [0, 1])
    return rows.withColumns({"parent_id": F.coalesce("parent_id", F.lit(0).cast("long")), "prediction": F.coalesce("prediction", F.lit("")), "feature": F.coalesce("feature", F.lit(-1))})


@query(f"{_NODES}, x AS (SELECT *, row_number() OVER (PARTITION BY tree, depth ORDER BY id) - (count(*) OVER (PARTITION BY tree, depth) + 1) / 2 AS x, -2.0 * depth AS y FROM nd) SELECT a.tree AS tree_id, a.id AS \"from\", b.id AS \"to\", a.x::DOUBLE AS x_from, a.y::DOUBLE AS y_from, b.x::DOUBLE AS x_to, b.y::DOUBLE AS y_to FROM x a JOIN x b ON a.tree = b.tree AND b.id // 2 = a.id")
def tree_edges_layout(spark, sf):
    return trees.layout(treerows.nodes_table(_set(spark, sf), RULES, [0, 1])).select("tree_id", "from", "to", "x_from", "y_from", "x_to", "y_to")


@query(f"{_NODES} SELECT tree AS tree_id, count(*) AS n_nodes, count(*) FILTER (split) AS n_decisions, count(*) FILTER (NOT split) AS n_leaves, max(depth) AS max_depth FROM nd GROUP BY tree")
def tree_summary(spark, sf):
    return trees.tree_summary(treerows.nodes_table(_set(spark, sf), RULES, [0, 1]))


@query(f"""{_NODES}, said AS (SELECT l.tree, l.id, l.depth, l.s, CASE l.depth WHEN 0 THEN 'TRUE' WHEN 1 THEN CASE WHEN l.id % 2 = 1 THEN '' ELSE 'NOT ' END || r.name ELSE CASE WHEN l.id // 2 % 2 = 1 THEN '' ELSE 'NOT ' END || r.name || ' AND ' || CASE WHEN l.id % 2 = 1 THEN '' ELSE 'NOT ' END || p.name END AS condition
  FROM nd l JOIN nd r ON r.tree = l.tree AND r.id = 1 LEFT JOIN nd p ON p.tree = l.tree AND p.id = l.id // 2 AND l.depth = 2 WHERE NOT l.split)
SELECT tree AS tree_id, row_number() OVER (PARTITION BY tree ORDER BY id << (2 - depth) DESC)::INT AS rule_id, condition, s AS prediction FROM said""")
def tree_rules(spark, sf):
    return treerows.rules_table(_set(spark, sf), RULES, [0, 1])


def _sql_json(s: str, below: list[str]) -> str:
    heads = "[" + ", ".join(f"""'{{"feature": {r.position}, "rule": {r.index}, "name": "{r.column}", "relation": "{r.relation}", "reference": "{r.reference}", "true": '""" for r in RULES) + "]"
    leaf = f"""'{{"prediction": "' || {s} || '", "class": ' || {s} || '}}'"""
    return leaf if not below else f"""CASE WHEN {s}[1] = '(' THEN {heads}[regexp_extract({s}, '^.(\\d+)', 1)::INT + 1] || {below[0]} || ', "false": ' || {below[1]} || '}}' ELSE {leaf} END"""


@query(f"""{_NODES}, j3 AS (SELECT tree, id, {_sql_json('s', [])} AS j FROM n3), j2 AS (SELECT n2.tree, n2.id, {_sql_json('n2.s', ['a.j', 'b.j'])} AS j FROM n2 LEFT JOIN j3 a ON a.tree = n2.tree AND a.id = 2 * n2.id + 1 LEFT JOIN j3 b ON b.tree = n2.tree AND b.id = 2 * n2.id)
SELECT n1.tree, {_sql_json('n1.s', ['a.j', 'b.j'])} AS json FROM n1 LEFT JOIN j2 a ON a.tree = n1.tree AND a.id = 3 LEFT JOIN j2 b ON b.tree = n1.tree AND b.id = 2""")
def tree_json(spark, sf):
    return _set(spark, sf).select("tree", treerows.json_of("tree", RULES, [0, 1]).alias("json"))


@query(f"{_NODES} SELECT tree AS tree_id, id, depth, coalesce(feature, -1) AS rule, CASE WHEN split THEN -1 ELSE s::INT END AS class FROM nd")
def tree_json_nodes(spark, sf):
    written = _set(spark, sf).select("tree_id", treerows.json_of("tree", RULES, [0, 1]).alias("json"))
    return treerows.from_json(written).select("tree_id", "id", "depth", F.coalesce("rule", F.lit(-1)).alias("rule"), F.coalesce("class", F.lit(-1)).alias("class"))


_KEY = "CASE WHEN split THEN feature ELSE -(s::INT + 1) END"
_LEVELS = f"""{_NODES}, lv AS (SELECT tree, depth + 1 AS level, string_agg(({_KEY})::VARCHAR, ' ' ORDER BY id DESC) AS key FROM nd GROUP BY tree, depth),
pre AS (SELECT a.tree, a.level, string_agg(b.key, ' / ' ORDER BY b.level) AS prefix FROM lv a JOIN lv b ON a.tree = b.tree AND b.level <= a.level GROUP BY a.tree, a.level)"""


@query(f"{_LEVELS} SELECT level::INT AS level, prefix, count(*)::BIGINT AS trees FROM pre GROUP BY ALL")
def rashomon_trie_levels(spark, sf):
    said = F.array_join(F.transform("prefix", lambda x: F.array_join(x.cast("array<string>"), " ")), " / ")
    return treerows.trie_table(_set(spark, sf)).select("level", said.alias("prefix"), "trees")


@query(f"""{_NEAR}, k AS (SELECT tree, feature, leaf FROM t) SELECT CASE WHEN leaf IS NULL THEN feature ELSE -(leaf + 1) END AS root, count(*)::BIGINT AS trees FROM k GROUP BY ALL""")
def rashomon_trie(spark, sf):
    return treerows.trie_table(_set(spark, sf)).where("level = 1").select(F.col("key").cast("int").alias("root"), "trees")


@query(f"{_NEAR} SELECT rank, objective, leaves FROM (SELECT row_number() OVER (ORDER BY objective, leaves) - 1 AS rank, objective, leaves FROM t) WHERE rank BETWEEN 3 AND 40")
def rashomon_ranked(spark, sf):
    m = fit_patterns(kept(patterns(spark, sf), "patterns"), RULES, [0, 1], "y", CONFIG, single_tree=False, max_trees=1)
    return m.ranked(3, 40).select(F.col("rank").cast("long").alias("rank"), F.round("objective", 9).alias("objective"), "leaves")


# ---- the search by levels -------------------------------------------------------------

_UNITS = round(1 / LAMBDA)
#: What costs are, in units of a row's error times _UNITS; least: of rows of equal patterns; each level's splits with bounds and rooms, as the search by levels finds them for near-optimal trees of three levels of nodes.
_GROWN = f"""WITH {SQL_PATTERNS}, one AS (SELECT sum(n_0 + n_1)::BIGINT AS n FROM pat), f AS (SELECT unnest(range({P}))::INT AS feature),
cl AS (SELECT m AS care, bits & m AS val, bit_count(m)::INT AS k, sum(n_0)::BIGINT AS n_0, sum(n_1)::BIGINT AS n_1, {_UNITS} * sum(least(n_0, n_1))::BIGINT AS eq FROM pat, (SELECT unnest(range({1 << P}))::BIGINT AS m) WHERE bit_count(m) <= 2 GROUP BY ALL),
cell AS (SELECT care, val, k, {_UNITS} * least(n_0, n_1) + n AS leaf, eq + 2 * n AS split_low, CASE WHEN k < 2 THEN least({_UNITS} * least(n_0, n_1) + n, eq + 2 * n) ELSE {_UNITS} * least(n_0, n_1) + n END AS low FROM cl, one),
root AS (SELECT cell.*, {round(_UNITS * BOUND)} * n AS lim FROM cell, one WHERE k = 0),
s1 AS (SELECT f.feature, l.low + r.low AS low, l.low AS low_l, r.low AS low_r, l.leaf AS leaf_l, r.leaf AS leaf_r, lim AS room, CASE WHEN l.low + r.low > lim THEN 'bound' END AS cut
  FROM root, f JOIN cell l ON l.care = 1 << f.feature AND l.val = 0 JOIN cell r ON r.care = 1 << f.feature AND r.val = 1 << f.feature WHERE root.split_low <= lim),
top AS (SELECT any_value(lim) AS lim, any_value(root.leaf) AS leaf, least(any_value(root.leaf), coalesce(min(s1.low), any_value(root.leaf))) AS lo, least(any_value(root.leaf), coalesce(min(leaf_l + leaf_r), any_value(root.leaf))) AS hi FROM root LEFT JOIN s1 ON cut IS NULL),
k1 AS (SELECT c.*, lim - o AS room FROM (SELECT (1 << feature)::BIGINT AS care, 0::BIGINT AS val, low_r AS o, low FROM s1 WHERE cut IS NULL UNION ALL SELECT (1 << feature)::BIGINT, (1 << feature)::BIGINT, low_l, low FROM s1 WHERE cut IS NULL) x, top JOIN cell c ON c.care = x.care AND c.val = x.val WHERE x.low <= lim AND c.low <= lim - o),
s2 AS (SELECT k1.care, k1.val, f.feature, l.leaf + r.leaf AS low, k1.room, CASE WHEN l.leaf + r.leaf > k1.room THEN 'bound' END AS cut FROM k1, f JOIN cell l ON l.care = k1.care + (1 << f.feature) AND l.val = k1.val JOIN cell r ON r.care = k1.care + (1 << f.feature) AND r.val = k1.val + (1 << f.feature)
  WHERE k1.care & (1 << f.feature) = 0 AND k1.split_low <= k1.room),
k2 AS (SELECT care + (1 << feature) AS care, val FROM s2 WHERE cut IS NULL UNION SELECT care + (1 << feature), val + (1 << feature) FROM s2 WHERE cut IS NULL),
b1 AS (SELECT k1.care, k1.val, least(k1.leaf, coalesce(min(s2.low), k1.leaf)) AS v FROM k1 LEFT JOIN s2 ON s2.care = k1.care AND s2.val = k1.val AND cut IS NULL GROUP BY k1.care, k1.val, k1.leaf),
best AS (SELECT least(any_value(top.leaf), coalesce(min(l.v + r.v), any_value(top.leaf))) AS v FROM top LEFT JOIN (b1 l JOIN b1 r ON l.care = r.care AND l.val = 0 AND r.val = r.care) ON true)"""


@query(f"""{_GROWN}, lv AS (SELECT 0 AS level, 1 AS cells, 0 AS splits, 0 AS cut, least(low, leaf) AS lower, leaf AS upper FROM root
  UNION ALL SELECT 1, (SELECT count(*) FROM k1), (SELECT count(*) FROM s1), (SELECT count(*) FROM s1 WHERE cut IS NOT NULL), CASE WHEN last THEN v ELSE lo END, CASE WHEN last THEN v ELSE hi END FROM top, best, (SELECT count(*) = 0 AS last FROM k1 WHERE split_low <= room)
  UNION ALL SELECT 2, (SELECT count(*) FROM k2), (SELECT count(*) FROM s2), (SELECT count(*) FROM s2 WHERE cut IS NOT NULL), v, v FROM best WHERE EXISTS (FROM k1 WHERE split_low <= room))
SELECT level, cells::BIGINT AS cells, splits::BIGINT AS splits, cut::BIGINT AS cut, round(lower / ({_UNITS} * n), 9) AS lower, round(upper / ({_UNITS} * n), 9) AS upper FROM lv, one""")
def search_levels(spark, sf):
    grown = levelwise.grow(kept(patterns(spark, sf), "patterns"), P, 2, CONFIG, near=True)
    return grown.levels.withColumns({x: F.round(x, 9) for x in ("lower", "upper")})


@query(f"""{_GROWN} SELECT 0 AS level, '' AS cell, feature, round(low / ({_UNITS} * n), 9) AS low, round(room / ({_UNITS} * n), 9) AS room, coalesce(cut, '') AS cut FROM s1, one
  UNION ALL SELECT 1, (2 * round(log2(care))::INT + (val > 0)::INT)::VARCHAR, feature, round(low / ({_UNITS} * n), 9), round(room / ({_UNITS} * n), 9), coalesce(cut, '') FROM s2, one""")
def search_trace(spark, sf):
    grown = levelwise.grow(kept(patterns(spark, sf), "patterns"), P, 2, CONFIG, near=True, trace=True)
    return grown.trace.select("level", F.array_join(F.col("cell").cast("array<string>"), " ").alias("cell"), "feature", F.round("low", 9).alias("low"), F.round("room", 9).alias("room"), F.coalesce("cut", F.lit("")).alias("cut"))


@query(f"{_NEAR} SELECT tree, leaves FROM t")
def rashomon_by_levels(spark, sf):
    m = fit_patterns(kept(patterns(spark, sf), "patterns"), RULES, [0, 1], "y", CONFIG.with_(search="levels"), single_tree=False)
    return m.trees_df(spark).select("tree", "leaves")


# ---- over 62 rules ---------------------------------------------------------------------


@query(f"WITH {wide.SQL} SELECT tree, objective, leaves, (SELECT count(*) FROM rule) AS rules, (SELECT count(*) FROM obj WHERE units = (SELECT min(units) FROM obj)) AS n_optimal FROM (SELECT * FROM obj JOIN near USING (tree, leaves) ORDER BY objective, leaves, length(tree), tree LIMIT 1)")
def wide_best_tree(spark, sf):
    df = wide.table(spark, sf)
    own = wide.rules(df)
    m = fit(df, "y", rules=own, config=wide.WIDE)
    return spark.createDataFrame([(m.tree.text(), round(m.objective, 9), m.tree.leaves(), len(own), m.n_optimal)], "tree string, objective double, leaves int, rules long, n_optimal long")


def _wide_set(spark, sf):
    """The table with bits' rules, a model of its best tree, and the whole set as rows."""
    df = wide.table(spark, sf, ("l_orderkey", "l_linenumber"))
    own = wide.rules(df)
    grown = levelwise.grow(kept(wide.patterns(df, own), "patterns"), len(own), 2, wide.WIDE, near=True)
    p = grown.problem
    reach = search.budgets(p, grown.values, p.scale.bound(wide.WIDE))
    found = search.entries(p, reach, trees=True)[0].select("tree", search.objective(p).alias("objective"), "leaves")
    return df, own, p, kept(found, "wide-set")


@query(f"WITH {wide.SQL} SELECT tree, objective, leaves FROM near")
def wide_set(spark, sf):
    return _wide_set(spark, sf)[3].withColumn("objective", F.round("objective", 9))


#: Votes of all trees of the set on each row, by the leaf that it ends in.
_BIT = "list_contains(p.fs, {0})"
_VOTE = f"CASE WHEN f IS NULL THEN tree::INT WHEN {_BIT.format('f')} THEN CASE WHEN rg IS NULL OR NOT {_BIT.format('rg')} THEN rp ELSE rq END ELSE CASE WHEN lg IS NULL OR NOT {_BIT.format('lg')} THEN lp ELSE lq END END"


@query(f"""WITH {wide.SQL}, v AS (SELECT obj.* FROM obj JOIN near USING (tree)), p AS (SELECT fs, list(id) AS ids FROM (SELECT w.id, coalesce(list(held.f ORDER BY held.f), []) AS fs FROM w LEFT JOIN held ON held.id = w.id GROUP BY w.id) GROUP BY fs),
q AS (SELECT unnest(ids) AS id, votes, trees FROM (SELECT ids, sum({_VOTE})::BIGINT AS votes, count(*) AS trees FROM p, v GROUP BY ids))
SELECT l_orderkey, l_linenumber, votes, (2 * votes >= trees)::INT AS prediction FROM lineitem l JOIN w ON w.l_quantity = l.l_quantity AND w.l_discount = l.l_discount AND w.l_tax = l.l_tax AND w.l_returnflag = l.l_returnflag AND w.l_linestatus = l.l_linestatus AND w.l_extendedprice = floor(l.l_extendedprice / {wide.STEP}) * {wide.STEP} JOIN q ON q.id = w.id""")
def predict_set_votes(spark, sf):
    df, own, p, found = _wide_set(spark, sf)
    m = TreeModel(wide.WIDE, own, [0, 1], "y", 0.0, 0.0, 0, 0, p.rows, [], {})
    return votes.predict_set(m, df, found, p.cells).select("l_orderkey", "l_linenumber", "votes", "prediction")


# ---- a setting at which folds agree ------------------------------------------------------

_TUNED = [0.002, 0.005, 0.01, 0.02, 0.04]


@query(f"""{_CF_EVERY}, g AS (SELECT unnest({_TUNED})::DOUBLE AS value), o AS (SELECT fold, value, loss, leaves, tree, round(loss + value * leaves, 12) AS objective FROM every, g), m AS (SELECT fold, value, min(objective) AS best FROM o GROUP BY ALL),
i AS (SELECT value, tree FROM o JOIN m USING (fold, value) WHERE objective <= best * 1.1 + 1e-12 GROUP BY ALL HAVING count(*) = 3) SELECT value, count(tree)::BIGINT AS intersecting FROM g LEFT JOIN i USING (value) GROUP BY value""")
def auto_tune_intersecting(spark, sf):
    return tune_intersecting(_train(spark, sf), P, 2, CONFIG.with_(bound=0.0, bound_multiplier=0.1), 3, "regularization", _TUNED)


@query(f"""{_CF_EVERY}, o AS (SELECT fold, tree, loss + {LAMBDA} * leaves AS objective FROM every), m AS (SELECT fold, min(objective) AS best FROM o GROUP BY fold), e AS (SELECT tree, max(objective / best - 1) AS needed, count(*) AS folds FROM o JOIN m USING (fold) GROUP BY tree HAVING count(*) = 3),
g AS (SELECT unnest([0.05, 0.1, 0.2, 0.4])::DOUBLE AS value) SELECT value, count(tree)::BIGINT AS intersecting FROM g LEFT JOIN e ON needed <= value + 1e-9 GROUP BY value""")
def auto_tune_bound(spark, sf):
    return tune_intersecting(_train(spark, sf), P, 2, CONFIG.with_(bound=0.0), 3, "bound_multiplier", [0.05, 0.1, 0.2, 0.4])


# ---- the documents' quality label ----------------------------------------------------------

#: Conditions on the documents; the same text serves both engines.
_DOCUMENT_TESTS = ["n_chars >= 200", "n_chars >= 1000", "n_chars >= 5000", "lang = 'en'", "lang = 'de'", "lang = 'fr'", "source = 'src0'", "source = 'src1'"]
_DOCUMENTS = f"""b AS (SELECT ({' + '.join(f'CASE WHEN {t} THEN {1 << k} ELSE 0 END' for k, t in enumerate(_DOCUMENT_TESTS))})::BIGINT AS bits, quality AS y FROM documents JOIN labels USING (doc_id)),
pat AS (SELECT bits, count(*) FILTER (y = 0) AS n_0, count(*) FILTER (y = 1) AS n_1 FROM b GROUP BY bits)"""


_QUALITY = FitConfig(regularization=0.01, max_depth=3, bound_multiplier=0.1, balance=True)
_QUALITY_SQL = _sql_two("least(n_1 / (2 * all_1), n_0 / (2 * all_0))", "CASE WHEN n_0 * all_1 <= n_1 * all_0 THEN 1 ELSE 0 END", 0.01).replace(SQL_PATTERNS, _DOCUMENTS)


@query(f"{_QUALITY_SQL} SELECT tree, round(objective, 6)::DOUBLE AS objective FROM a, o WHERE objective <= best * 1.1 * (1 + 1e-12)")
def quality_label_set(spark, sf):
    """The near-optimal set of trees that tell good documents from bad ones by length, language and source, errors of both kinds weighing the same."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.select("doc_id", "n_chars", "lang", "source").join(labels.select("doc_id", "quality"), "doc_id")
    own = kept(encode.pattern_table(rows, [F.expr(t) for t in _DOCUMENT_TESTS], F.col("quality"), [0, 1]), "patterns")
    p = search.problem(own, P, 2, _QUALITY)
    reach = search.budgets(p, search.optimum(p), p.scale.bound(_QUALITY))
    return search.entries(p, reach, trees=True)[0].select("tree", F.round(search.objective(p), 6).alias("objective"))
