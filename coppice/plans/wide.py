"""A task of over 62 rules: all thresholds and categories of five columns of the line items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.config import FitConfig
from coppice.operators import encode
from coppice.plans import task

STEP, STEPS = 4000, 25
COLUMNS = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
#: Three levels of nodes; the bound leaves some 1 500 trees at every size.
WIDE = FitConfig(regularization=0.0005, max_depth=3, bound=0.05, model_limit=1_000_000)


def table(spark, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return task.lineitem(spark, sf_dir).select(*keep, *COLUMNS, "l_extendedprice", task.label().alias("y"))


def rules(df: DataFrame) -> list[encode.Rule]:
    """Those that the columns give, and a threshold at every 4 000 of the price."""
    own = encode.codex(df, COLUMNS)
    return own + [encode.Rule(len(own) + k, len(COLUMNS), "l_extendedprice", "integral", ">=", str(STEP * (k + 1))) for k in range(STEPS)]


def patterns(df: DataFrame, own: list[encode.Rule]) -> DataFrame:
    return encode.pattern_table(df, own, F.col("y"), [0, 1])


def _midpoints(column: str, place: int) -> str:
    return f"SELECT {place} AS place, v, NULL AS word FROM (SELECT (v + lag(v) OVER (ORDER BY v)) / 2 AS v FROM (SELECT DISTINCT {column} AS v FROM lineitem)) WHERE v IS NOT NULL"


#: CTEs: rules by number, patterns with the rules that hold, counts with one and with two rules, and all trees of two levels of splits.
SQL = f"""rule AS (SELECT row_number() OVER (ORDER BY place, v, word)::INT - 1 AS f, * FROM ({_midpoints('l_quantity', 0)} UNION ALL {_midpoints('l_discount', 1)} UNION ALL {_midpoints('l_tax', 2)}
  UNION ALL SELECT DISTINCT 3, NULL::DOUBLE, l_returnflag FROM lineitem UNION ALL SELECT 4, NULL, max(l_linestatus) FROM lineitem UNION ALL SELECT 5, {STEP}.0 * unnest(range(1, {STEPS + 1})), NULL)),
w AS (SELECT row_number() OVER () AS id, * FROM (SELECT {', '.join(COLUMNS)}, floor(l_extendedprice / {STEP}) * {STEP} AS l_extendedprice, count(*) FILTER (y = 0) AS n_0, count(*) FILTER (y = 1) AS n_1 FROM (SELECT *, ({task.LABEL})::INT AS y FROM lineitem) GROUP BY ALL)),
held AS (SELECT id, f, n_0, n_1 FROM w JOIN rule ON CASE place WHEN 0 THEN l_quantity >= v WHEN 1 THEN l_discount >= v WHEN 2 THEN l_tax >= v WHEN 3 THEN l_returnflag = word WHEN 4 THEN l_linestatus = word ELSE l_extendedprice >= v END),
a AS (SELECT sum(n_0) AS n_0, sum(n_1) AS n_1, sum(n_0 + n_1) AS n FROM w),
c1 AS (SELECT f, sum(n_0) AS n_0, sum(n_1) AS n_1 FROM held GROUP BY f),
c2 AS (SELECT l.f, r.f AS g, sum(l.n_0) AS n_0, sum(l.n_1) AS n_1 FROM held l JOIN held r ON l.id = r.id AND l.f <> r.f GROUP BY ALL),
pairs AS (SELECT l.f AS f, r.f AS g, coalesce(c2.n_0, 0) AS b0, coalesce(c2.n_1, 0) AS b1, l.n_0 AS l0, l.n_1 AS l1, r.n_0 AS r0, r.n_1 AS r1 FROM c1 l JOIN c1 r ON l.f <> r.f LEFT JOIN c2 ON c2.f = l.f AND c2.g = r.f),
one AS (SELECT f, 1 AS vf, n_0, n_1 FROM c1 UNION ALL SELECT f, 0, a.n_0 - c1.n_0, a.n_1 - c1.n_1 FROM c1, a),
two AS (SELECT f, 1 AS vf, g, 1 AS vg, b0 AS n_0, b1 AS n_1 FROM pairs UNION ALL SELECT f, 1, g, 0, l0 - b0, l1 - b1 FROM pairs
  UNION ALL SELECT f, 0, g, 1, r0 - b0, r1 - b1 FROM pairs UNION ALL SELECT f, 0, g, 0, a.n_0 - l0 - r0 + b0, a.n_1 - l1 - r1 + b1 FROM pairs, a),
leaf1 AS (SELECT f, vf, (n_1 >= n_0)::INT AS pred, least(n_0, n_1) AS falses, n_1 / (n_0 + n_1) AS share FROM one WHERE n_0 + n_1 > 0),
leaf2 AS (SELECT f, vf, g, vg, (n_1 >= n_0)::INT AS pred, least(n_0, n_1) AS falses, n_1 / (n_0 + n_1) AS share FROM two WHERE n_0 + n_1 > 0),
side AS (SELECT f, vf, NULL::INT AS g, pred, NULL::INT AS pred_r, falses, 1 AS leaves, share AS share_l, NULL::DOUBLE AS share_r, pred::VARCHAR AS tree FROM leaf1
  UNION ALL SELECT l.f, l.vf, l.g, l.pred, r.pred, l.falses + r.falses, 2, l.share, r.share, '(' || l.g || ' ' || r.pred || ' ' || l.pred || ')' FROM leaf2 l JOIN leaf2 r ON l.f = r.f AND l.vf = r.vf AND l.g = r.g AND l.vg = 0 AND r.vg = 1 WHERE l.pred <> r.pred),
every AS (SELECT NULL::INT AS f, least(n_0, n_1) AS falses, 1 AS leaves, (n_1 >= n_0)::INT::VARCHAR AS tree, NULL::INT AS lg, NULL::INT AS lp, NULL::INT AS lq, NULL::INT AS rg, NULL::INT AS rp, NULL::INT AS rq FROM a
  UNION ALL SELECT l.f, l.falses + r.falses, l.leaves + r.leaves, '(' || l.f || ' ' || r.tree || ' ' || l.tree || ')', l.g, l.pred, l.pred_r, r.g, r.pred, r.pred_r FROM side l JOIN side r ON l.f = r.f AND l.vf = 0 AND r.vf = 1 WHERE l.g IS NOT NULL OR r.g IS NOT NULL OR l.pred <> r.pred),
obj AS (SELECT every.*, falses * 2000 + leaves * n::BIGINT AS units, n FROM every, a),
near AS (SELECT *, round(units / (2000 * n), 9) AS objective FROM obj WHERE units * 20 <= 2000 * n)"""
