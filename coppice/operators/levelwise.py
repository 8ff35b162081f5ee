"""Cells made level by level, and only where a tree that matters can reach them.

The cube of ``search.cell_counts`` holds every conjunction of a depth.  Here a level's cells
come from the one above: a cell is split only if some tree within the bound can split it, and
a split is followed only if its two sides can fit what the rest of the tree leaves them.

What tells: no tree on a cell costs less than its rows of equal patterns that no split can tell
apart (``least``), and one with a split has two leaves, so a cell costs at least
``low`` = min(as a leaf, least + two penalties).  The bound less the least that the rest of a
tree must cost is a cell's ``room``, the most over the ways to reach it.  After each level
the bounds of all levels above are worked out again from below (``lo``, ``hi``: what the best
subtree costs at least, and what the best one met costs), and rooms again from above.  For the optimum alone a
subtree that costs more than the best one met is of no use either, and the best tree met so far
lowers the bound.  Nothing that is cut can be in a tree within the bound, so the passes
of ``search`` over what remains find the same optimum, ties and near-optimal set as over the cube.

Counting: patterns stay where they are.  The cells to split, bounded by ``max_cells``, go to all
tasks; each task counts every one of them with every feature at once, as a product of matrices,
and sends a row for each cell and feature it met.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from coppice.config import FitConfig
from coppice.functions import masks
from coppice.functions.losses import balanced_costs, total
from coppice.operators import search
from coppice.operators.search import Problem, Scale
from coppice.sources.work import kept

#: Patterns times features that a task holds, as doubles.
TASK_CELLS = 1 << 23
#: Cells whose counts a task sends at once.
BLOCK = 512
#: Whole numbers up to here are exact as doubles.
EXACT = 1 << 52


class OutOfTime(RuntimeError):
    """A search that had to be whole ran out of time; says what is known of the optimum."""


@dataclass
class Search:
    """problem: the cells that were made.  values: their optimum, a table a level.  levels: (level, cells, splits, cut, lower, upper).  trace: every split met, where asked for.

    lower and upper: what the optimum costs at least and at most, as options speak of it;
    they differ only if ``finished`` is false, that is, if time ran out.
    """

    problem: Problem
    values: list[DataFrame]
    levels: DataFrame
    trace: DataFrame | None
    finished: bool
    lower: float
    upper: float


@contextmanager
def deadline(spark, seconds: float) -> Iterator[threading.Event]:
    """Cancels this thread's jobs after so many seconds (0: never); the event tells whether it did."""
    sc, tag, ended = spark.sparkContext, f"coppice-{uuid.uuid4().hex}", threading.Event()
    if not seconds:
        yield ended
        return

    def stop() -> None:
        ended.set()
        sc.cancelJobsWithTag(tag)

    timer = threading.Timer(max(0.0, seconds), stop)
    timer.daemon = True
    sc.addJobTag(tag)
    timer.start()
    try:
        yield ended
    finally:
        timer.cancel()
        sc.removeJobTag(tag)


def _child_counts(patterns: DataFrame, live: np.ndarray, features: int, classes: int, n_patterns: int) -> DataFrame:
    """(cell, feature, n_0 .., least): the counts of each cell's rows that have the feature, where there are any.

    live: a cell a row, its literals in order (2f + 1 where feature f holds, 2f where it fails).
    """
    ns = [f"n_{k}" for k in range(classes)]
    sent = patterns.sparkSession.sparkContext.broadcast(live)  # at most max_cells rows
    tasks = max(1, -(-n_patterns * features // TASK_CELLS))
    own = patterns.select("bits", *ns, "least")
    own = own.repartition(tasks) if tasks > 1 else own.coalesce(1)
    schema = f"cell array<int>, feature int, {', '.join(f'{n} double' for n in ns)}, least double"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches) if (batches := [b for b in batches if b.num_rows]) else None
        if table is None:
            return
        n = table.num_rows
        bits = table.column("bits").combine_chunks()
        if masks.wide(features):
            word = np.asarray(bits.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(n, -1)
        else:
            word = bits.to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, 1)
        has = np.empty((n, features))
        for f in range(features):
            has[:, f] = (word[:, f // masks.WORD] >> (f % masks.WORD)) & 1
        flags = [has[:, f] > 0 for f in range(features)]
        weights = np.stack([table.column(c).to_numpy().astype(np.float64) for c in [*ns, "least"]])
        cells, depth = sent.value, sent.value.shape[1]
        path, rows = [], [np.arange(n)]
        found, at = [], []

        def block() -> pa.RecordBatch:
            counts = np.stack(found)  # cell, count, feature
            of, feature = np.nonzero(counts[:, :-1].any(axis=1))
            own_cells = cells[np.array(at)[of]]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(of) * depth + 1, max(depth, 1), dtype=np.int32) if depth else np.zeros(len(of) + 1, np.int32)), pa.array(own_cells.ravel().astype(np.int32)))
            found.clear()
            at.clear()
            return pa.RecordBatch.from_arrays([lists, pa.array(feature.astype(np.int32)), *[pa.array(counts[of, k, feature]) for k in range(classes + 1)]], names=["cell", "feature", *ns, "least"])

        for c, cell in enumerate(cells.tolist()):
            same = 0
            while same < len(path) and path[same] == cell[same]:
                same += 1
            del path[same:], rows[same + 1 :]
            for literal in cell[same:]:
                inside = flags[literal >> 1][rows[-1]]
                rows.append(rows[-1][inside if literal & 1 else ~inside])
                path.append(literal)
            if len(rows[-1]):
                found.append(weights[:, rows[-1]] @ has[rows[-1]])
                at.append(c)
            if len(found) == BLOCK:
                yield block()
        if found:
            yield block()

    sums = own.mapInArrow(scan, schema).groupBy("cell", "feature").agg(*[F.sum(c).alias(c) for c in [*ns, "least"]])
    return sums.select("cell", "feature", *[F.col(n).cast("long").alias(n) for n in ns], "least")


def _bounded(p: Problem, df: DataFrame, further: bool) -> DataFrame:
    """Cells (n_0 .., least) with their leaf columns and ``low``; further: whether splits may follow."""
    df = df.withColumn("rows_of_key", F.lit(p.rows).cast("long")).withColumn("n_total", total(p.classes))
    df = df.withColumns(search._leaf(p.classes, p.config, p.costs, p.scale))
    return df.withColumn("low", F.least(F.col("leaf_objective"), _split_low(p)) if further else F.col("leaf_objective"))


def _split_low(p: Problem) -> Column:
    """What a tree with a split costs at least on a cell."""
    least = F.col("least")
    if not p.scale.exact:
        return least - F.lit(search.TOLERANCE) * F.greatest(F.lit(1.0), F.abs(least)) + 2 * p.scale.leaf_cost()
    whole = F.when(least < EXACT, least).otherwise(F.floor(least * (1 - 1e-12))).cast("long")
    return whole + 2 * p.scale.leaf_cost()


def _side(p: Problem, df: DataFrame, side: str, further: bool) -> DataFrame:
    """``df`` with the leaf columns of one side, from n_0_l .. to leaf_l, low_l, n_l."""
    names = [*[f"n_{k}" for k in range(p.classes)], "least"]
    was = {n: f"{n}_parent" for n in names}
    df = df.withColumnsRenamed(was).withColumnsRenamed({f"{n}_{side}": n for n in names})
    df = _bounded(p, df, further).drop("rows_of_key", "prediction", "falses", "cost")
    df = df.withColumnsRenamed({**{n: f"{n}_{side}" for n in names}, "n_total": f"n_{side}", "leaf_objective": f"leaf_{side}", "low": f"low_{side}"})
    return df.withColumnsRenamed({v: k for k, v in was.items()})


def _splits(p: Problem, frontier: DataFrame, sums: DataFrame, further: bool) -> DataFrame:
    """(cell, feature, left, right: cells, counts and bounds of both sides, low, room, cut: null or why) of each split with rows on both sides."""
    ns = [*[f"n_{k}" for k in range(p.classes)], "least"]
    both = frontier.select("cell", "room", *ns).join(sums.select("cell", "feature", *[F.col(n).alias(f"{n}_r") for n in ns]), "cell")
    both = both.withColumns({f"{n}_l": F.col(n) - F.col(f"{n}_r") for n in ns})
    both = _side(p, _side(p, both, "l", further), "r", further).where("n_l > 0 and n_r > 0").withColumn("rows_of_key", F.lit(p.rows).cast("long"))
    low = F.least(F.col("leaf_l") + F.col("low_r"), F.col("low_l") + F.col("leaf_r")) if p.config.rule_list else F.col("low_l") + F.col("low_r")
    m = p.config.min_support
    few = F.least("n_l", F.col("rows_of_key") - F.col("n_l"), "n_r", F.col("rows_of_key") - F.col("n_r")) <= m if m else F.lit(False)
    with_ = lambda v: F.array_sort(F.concat("cell", F.array(2 * F.col("feature") + v)))
    both = both.withColumns({"left": with_(0), "right": with_(1), "low": low})
    return both.withColumn("cut", F.when(few, F.lit("support")).when(~p.scale.within(F.col("low"), F.col("room")), F.lit("bound")))


def _children(p: Problem, splits: DataFrame, further: bool) -> DataFrame:
    """(cell, n_0 .., least, room, leaf columns, low) of each side of the splits, once."""
    ns = [*[f"n_{k}" for k in range(p.classes)], "least"]
    sides = [F.struct(F.col(cell).alias("cell"), *[F.col(f"{n}_{s}").alias(n) for n in ns], (F.col("room") - F.col(f"low_{o}")).alias("room")) for cell, s, o in (("left", "l", "r"), ("right", "r", "l"))]
    one = splits.select(F.explode(F.array(*sides)).alias("x")).select("x.*").groupBy("cell").agg(*[F.max(n).alias(n) for n in ns], F.max("room").alias("room"))  # a cell's counts are the same whichever way it is reached
    return _bounded(p, one, further)


def _kids(p: Problem, splits: DataFrame, below: DataFrame) -> DataFrame:
    """(cell, feature, left, right, rest_l, rest_r, lo, hi): splits, what they cost at least and at most, and what each side must leave for the other."""
    side = lambda cell, s: below.select(F.col("cell").alias(cell), F.col("lo").alias(f"lo_{s}"), F.col("hi").alias(f"hi_{s}"), F.col("leaf_objective").alias(f"leaf_{s}"))
    both = splits.select("cell", "feature", "left", "right").join(side("left", "l"), "left").join(side("right", "r"), "right")
    sums = [(F.least(F.col("leaf_l") + F.col(f"{x}_r"), F.col(f"{x}_l") + F.col("leaf_r")) if p.config.rule_list else F.col(f"{x}_l") + F.col(f"{x}_r")).alias(x) for x in ("lo", "hi")]
    return both.select("cell", "feature", "left", "right", F.col("lo_r").alias("rest_l"), F.col("lo_l").alias("rest_r"), *sums)


def _worked_out(p: Problem, cells: DataFrame, splits: DataFrame, below: DataFrame) -> DataFrame:
    """Cells with lo and hi from their splits; a cell without any is a leaf."""
    best = _kids(p, splits, below).groupBy("cell").agg(F.min("lo").alias("split_lo"), F.min("hi").alias("split_hi"))
    own = cells.select("cell", "leaf_objective").join(best, "cell", "left")
    return own.select("cell", "leaf_objective", *[F.least("leaf_objective", F.coalesce(f"split_{x}", "leaf_objective")).alias(x) for x in ("lo", "hi")])


def _rooms(p: Problem, top: DataFrame, splits: list[DataFrame], worked: list[DataFrame], near: bool) -> DataFrame:
    """(cell, room) of the last level's cells that trees within the bound reach; top: the root with its room.  worked: bounds of all levels down to the last."""
    room = top
    for k, own in enumerate(splits):
        if not near:
            room = room.join(worked[k].select("cell", "hi"), "cell").select("cell", F.least("room", "hi").alias("room"))
        fits = _kids(p, own, worked[k + 1]).join(room, "cell").where(p.scale.within(F.col("lo"), F.col("room")))
        ways = F.explode(F.array(*[F.struct(F.col(c).alias("cell"), (F.col("room") - F.col(rest)).alias("room")) for c, rest in (("left", "rest_l"), ("right", "rest_r"))])).alias("x")
        room = fits.select(ways).groupBy("x.cell").agg(F.max("x.room").alias("room"))
    return room


def _units(scale: Scale, value: float, rows: int) -> int | float:
    """An objective as options speak of it, as it is counted; rounded up where counts are whole."""
    if not scale.exact:
        return float(value)
    exact = Fraction(str(value)) * scale.per * (rows if scale.by_rows else 1)
    return -(-exact.numerator // exact.denominator)


def _near(scale: Scale, config: FitConfig, best: int | float, rows: int) -> int | float:
    """What near-optimal trees may cost at most if the optimum is at most ``best``."""
    if config.bound:
        return _units(scale, config.bound, rows)
    if config.bound_adder:
        return best + _units(scale, config.bound_adder, rows)
    share = config.bound_multiplier or 0.05
    return best + (-(-best * Fraction(str(share))).__floor__() if scale.exact else best * share)


def _masked(p: Problem, cells: DataFrame, k: int) -> DataFrame:
    """Cells by literals as cells by masks, with the columns of the cube's."""
    feature = F.transform("cell", lambda x: (x / 2).cast("int"))
    holds = F.transform(F.filter("cell", lambda x: x % 2 == 1), lambda x: (x / 2).cast("int"))
    columns = [*[f"n_{c}" for c in range(p.classes)], "rows_of_key", "n_total", "prediction", "falses", "cost", "leaf_objective"]
    return cells.select(masks.of_bits(feature, p.features).alias("care"), masks.of_bits(holds, p.features).alias("val"), F.lit(k).alias("k"), *columns)


def grow(patterns: DataFrame, features: int, classes: int, config: FitConfig, near: bool = False, trace: bool = False, seconds: float = 0.0) -> Search:
    """The cells that trees within the bound can reach: the optimum and its ties, or (near) the near-optimal set that config describes.

    config.upper_bound, where there is one, says what the optimum costs at most.  trace: keep every
    split that was met, with the reason if it was cut.  seconds: after that many no further
    level is made; a near-optimal set needs all levels, so there that is an error.
    """
    began, spark = time.time(), patterns.sparkSession
    ns = [f"n_{k}" for k in range(classes)]
    sums = patterns.agg(*[F.sum(n).alias(n) for n in ns], F.count("*").alias("patterns")).first()
    class_rows = [int(sums[n] or 0) for n in ns]
    rows = sum(class_rows)
    costs = [list(r) for r in config.costs] if config.costs else balanced_costs(class_rows) if config.balance else None
    if costs is not None and len(costs) != classes:
        raise ValueError(f"costs for {len(costs)} classes, the label has {classes}")
    scale = search.scale_of(config, class_rows, costs)
    p = Problem(None, features, classes, search.literal_limit(features, config), rows, costs, config, [], scale, class_rows)
    own = patterns.withColumn("rows_of_key", F.lit(rows).cast("long")).withColumns(search._leaf(classes, config, costs, scale))
    own = own.select("bits", *ns, F.col("cost").cast("double").alias("least"))
    start = own.agg(*[F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n) for n in ns], F.coalesce(F.sum("least"), F.lit(0.0)).alias("least")).select(F.array().cast("array<int>").alias("cell"), *ns, "least")
    root = kept(_bounded(p, start, p.depth > 0), "root")
    alone = root.first()
    lower, upper, finished = min(alone.low, alone.leaf_objective), alone.leaf_objective, True
    best = min(upper, _units(scale, config.upper_bound, rows)) if config.upper_bound else upper
    limit = _near(scale, config, best, rows) if near else best
    units = "long" if scale.exact else "double"
    levels, splits, met, log = [root.withColumn("room", F.lit(limit).cast(units))], [], [], [[0, 1, 0, 0, lower, upper]]
    with deadline(spark, seconds) as ended:
        try:
            for k in range(p.depth if rows else 0):
                if seconds and time.time() - began > seconds:
                    raise OutOfTime
                last = k + 1 == p.depth
                frontier = levels[k].where(p.scale.within(_split_low(p), F.col("room")))
                live = frontier.select("cell").limit(config.max_cells + 1).toArrow().column("cell").combine_chunks()
                if not len(live):
                    break
                if len(live) > config.max_cells:
                    raise ValueError(f"over max_cells={config.max_cells} cells to split at level {k}: give a max_depth, a larger regularization or a smaller bound, or raise max_cells")
                literals = live.flatten().to_numpy(zero_copy_only=False).reshape(len(live), k) if k else np.zeros((1, 0), np.int32)
                literals = literals[np.lexsort(literals.T[::-1])] if k else literals
                counted = _child_counts(own, literals, features, classes, sums.patterns)
                seen, there = Observation(), Observation()
                found = _splits(p, frontier, counted, not last).observe(seen, F.count(F.lit(1)).alias("splits"), F.count_if(F.col("cut").isNotNull()).alias("cut"))
                found = kept(found if trace else found.where("cut is null"), "splits")
                followed = [*splits, found.where("cut is null")]
                below = kept(_children(p, followed[k], not last).observe(there, F.count(F.lit(1)).alias("cells")), "cells")
                n_cells = there.get["cells"]
                if not last:
                    # From below: what each cell's best subtree costs at least and at most.
                    worked = [None] * (k + 1) + [below.select("cell", "leaf_objective", F.col("low").alias("lo"), F.col("leaf_objective").alias("hi"))]
                    for j in reversed(range(k + 1)):
                        worked[j] = kept(_worked_out(p, levels[j], followed[j], worked[j + 1]), "worked")
                    top = worked[0].first()
                    best = min(best, top.hi)
                    limit = min(limit, _near(scale, config, best, rows) if near else best)
                    room = _rooms(p, root.select("cell", F.lit(limit).cast(units).alias("room")), followed, worked, near)
                    reached = below.drop("room").join(room, "cell").withColumn("room", F.col("room") if near else F.least("room", "leaf_objective"))
                    there = Observation()
                    below = kept(reached.where(p.scale.within(F.col("low"), F.col("room"))).observe(there, F.count(F.lit(1)).alias("cells")), "reached")
                    lower, upper, n_cells = top.lo, top.hi, there.get["cells"]
                levels.append(below)
                splits, met = followed, [*met, found]
                log.append([k + 1, n_cells, seen.get["splits"], seen.get["cut"], lower, upper])
        except Exception:
            if not ended.is_set() and not (seconds and time.time() - began > seconds):
                raise
            finished = False
    shown = lambda v: float(root.select(scale.shown(F.lit(v).cast(units))).first()[0])
    if not finished and near:
        raise OutOfTime(f"no time left to find all trees within the bound; the optimum is between {shown(lower)} and {shown(upper)}")
    p = replace(p, depth=len(levels) - 1, cells=_all(p, levels))
    values = search.optimum(p)
    upper = values[0].select("v").first()[0] if rows else upper
    if finished:
        lower = upper  # all that was cut costs more
    log[-1][4:] = [lower, upper]
    table = spark.createDataFrame([tuple(r) for r in log], f"level int, cells long, splits long, cut long, lower_units {units}, upper_units {units}").withColumn("rows_of_key", F.lit(rows).cast("long"))
    table = table.select("level", "cells", "splits", "cut", scale.shown("lower_units").alias("lower"), scale.shown("upper_units").alias("upper"))
    return Search(p, values, table, _trace(p, met) if trace else None, finished, shown(lower), shown(upper))


def _all(p: Problem, levels: list[DataFrame]) -> DataFrame:
    out = None
    for k, cells in enumerate(levels):
        one = _masked(p, cells, k)
        out = one if out is None else out.unionByName(one)
    return out


def _trace(p: Problem, met: list[DataFrame]) -> DataFrame:
    """(level, cell, feature, left, right, low, room, cut): the splits of each level's cells, from parent to children, and why one was cut."""
    out = None
    for k, own in enumerate(met):
        one = own.select(F.lit(k).alias("level"), "cell", "feature", "left", "right", p.scale.shown("low").alias("low"), p.scale.shown("room").alias("room"), "cut")
        out = one if out is None else out.unionByName(one)
    return out
