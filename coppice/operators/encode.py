"""From raw columns to binary predicates: profiling, rules, encoding."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from coppice.functions import masks

#: Spellings of a missing value.
NULL_TOKENS = ("", "NULL", "null", "Null", "NA", "na", "NaN")
INTEGRAL = r"^[+-]?[0-9]+$"
#: Values of a column up to which they are counted exactly, and up to which rules are made of them.
WIDE, MOST_VALUES = 1_000_000, 100_000
#: Rules that a table is encoded by, unless more are asked for: each is an expression of the plan.
MOST_RULES = 1_000
#: Rules up to which each is an expression over a row; more are told together from their columns' values, which took a fifth of the time with 96 rules.
FEW_RULES = 16
_PROFILE = "position int, column string, n_rows long, n_missing long, n_distinct long, base string, kind string"
RATIONAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"


def _present(text: Column) -> Column:
    return F.when(~text.isin(*NULL_TOKENS), text)


def as_text(c: str) -> Column:
    """A cell as text; spellings of a missing value are null."""
    return _present(F.col(f"`{c}`").cast("string"))


def as_number(c: str) -> Column:
    """A cell as a number; what is none is null, NaN too.  Floats go by their text, as 0.1 is another number there."""
    number = F.when(F.typeof(F.col(f"`{c}`")) == "float", as_text(c).try_cast("double")).otherwise(F.col(f"`{c}`").try_cast("double"))  # Spark settles the type before it runs
    return F.when(~F.isnan(number), number)


def _type(df: DataFrame, c: str) -> T.DataType:
    return df.select(F.col(f"`{c}`")).schema[0].dataType


def _stored(df: DataFrame, c: str) -> Column:
    """A cell as it is stored, where that is a number or text; else as text."""
    return F.col(f"`{c}`") if isinstance(_type(df, c), (T.NumericType, T.StringType)) else as_text(c)


def _counted(df: DataFrame, columns: dict[int, str]) -> DataFrame:
    """(position, text, n) of each stored value of the columns; those of one type are counted together."""
    by_type = defaultdict(list)
    for i, c in columns.items():
        kind = _type(df, c)
        by_type[kind if isinstance(kind, T.NumericType) else T.StringType()].append((i, c))
    out = None
    for kind, own in by_type.items():
        v = lambda c: F.col(f"`{c}`") if isinstance(kind, T.NumericType) else F.col(f"`{c}`").cast("string")  # noqa: B023, E731
        floating = isinstance(kind, (T.FloatType, T.DoubleType))
        # Grouping takes both zeros of a floating number for one, texts do not.
        zero = lambda c: F.when(v(c) == 0, v(c).cast("string")) if floating else F.lit(None).cast("string")  # noqa: B023, E731
        cells = F.explode(F.array(*[F.struct(F.lit(i).alias("position"), v(c).alias("v"), zero(c).alias("zero")) for i, c in own])).alias("x")
        one = df.select(cells).groupBy("x.position", "x.v", "x.zero").agg(F.count("*").alias("n"))
        one = one.select("position", _present(F.coalesce("zero", F.col("v").cast("string"))).alias("text"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def profile(df: DataFrame, columns: list[str], wide: int = WIDE) -> DataFrame:
    """(position, column, n_rows, n_missing, n_distinct, base, kind) of each column.

    base: integral, rational or categorical, whichever all present values fit.  kind:
    redundant with at most one value, binary with two and none missing, else the base.
    One aggregation over the table, without a shuffle of its cells, estimates how many
    values a column has; those of up to ``wide`` are then counted exactly: equal values combine
    before the shuffle, as they are stored, and only different ones are read as text.  Wider
    columns are read as text row by row and keep the estimate, off by some per cent.
    """
    if not columns:
        return df.sparkSession.createDataFrame([], _PROFILE)
    kinds = {"ints": INTEGRAL, "numbers": RATIONAL}
    row = df.agg(F.count("*").alias("n_rows"), *[F.approx_count_distinct(_stored(df, c), 0.02).alias(f"about_{i}") for i, c in enumerate(columns)]).first()
    narrow = [i for i in range(len(columns)) if row[f"about_{i}"] <= wide]
    found: dict[int, dict] = {}
    if narrow:
        fits = [F.coalesce(F.bool_and(F.col("text").rlike(kind)), F.lit(False)).alias(name) for name, kind in kinds.items()]
        texts = _counted(df, {i: columns[i] for i in narrow}).groupBy("position", "text").agg(F.sum("n").alias("n"))  # stored values may share a text
        got = texts.groupBy("position").agg(F.coalesce(F.sum(F.when(F.col("text").isNull(), F.col("n"))), F.lit(0)).alias("missing"), F.count("text").alias("values"), *fits)
        found = {r.position: r.asDict() for r in got.collect()}  # a row for each column
    if len(narrow) < len(columns):
        aggs = []
        for i in set(range(len(columns))) - set(narrow):
            v = as_text(columns[i])
            aggs += [F.count_if(v.isNull()).alias(f"missing_{i}"), F.approx_count_distinct(v, 0.02).alias(f"values_{i}")]
            aggs += [F.coalesce(F.bool_and(v.rlike(kind)), F.lit(False)).alias(f"{name}_{i}") for name, kind in kinds.items()]
        own = df.agg(*aggs).first()
        found |= {i: {x: own[f"{x}_{i}"] for x in ("missing", "values", *kinds)} for i in set(range(len(columns))) - set(narrow)}
    out = []
    for i, c in enumerate(columns):
        x = found.get(i, {"missing": 0, "values": 0, "ints": False, "numbers": False})  # a table without rows
        n = x["values"]
        base = "integral" if x["ints"] else "rational" if x["numbers"] else "categorical"
        kind = "redundant" if n <= 1 else "binary" if n == 2 and not x["missing"] else base
        out.append((i, c, row.n_rows, x["missing"], n, base, kind))
    return df.sparkSession.createDataFrame(out, _PROFILE)


def significant(value: Column, figures: int) -> Column:
    """A number rounded to significant figures, halves away from zero."""
    power = F.pow(F.lit(10.0), F.lit(figures - 1) - F.floor(F.log10(F.abs(value))))
    rounded = F.signum(value) * F.floor(F.abs(value) * power + 0.5) / power
    return F.when(value == 0, F.lit(0.0)).otherwise(rounded)


@dataclass(frozen=True)
class Rule:
    """A predicate over one source column; a missing value fails it."""

    index: int
    position: int
    column: str
    kind: str
    relation: str
    reference: str

    @property
    def name(self) -> str:
        return f"{self.column}{self.relation}{self.reference}"

    def test(self) -> Column:
        if self.relation == ">=":
            return F.coalesce(as_number(self.column) >= F.lit(float(self.reference)), F.lit(False))
        if self.kind == "numeric_binary":
            return F.coalesce(as_number(self.column) == F.lit(float(self.reference)), F.lit(False))
        return F.coalesce(as_text(self.column) == F.lit(self.reference), F.lit(False))

    def to_dict(self) -> dict:
        return asdict(self)


def _domain(df: DataFrame, column: str, base: str, precision: int) -> DataFrame:
    """(v: text or double) the distinct present values."""
    if base == "categorical":
        return df.select(as_text(column).alias("v")).where("v is not null").distinct()
    value = as_number(column)
    if precision:
        value = significant(value, precision)
    return df.select(value.alias("v")).where("v is not null").distinct()


def codex_table(df: DataFrame, columns: list[str], precision: int = 0, most: int = MOST_VALUES) -> DataFrame:
    """(position, column, kind, relation, reference: text, rank) of all rules.

    Binary columns test for their larger value; integral ones for at least each value;
    rational ones for at least the middle of each two neighbours; categorical ones for
    each value.  Neighbours are found by sorting a column's values in one task, so more
    than ``most`` of them are an error, met before that.
    """
    out = None
    for r in sorted(profile(df, columns).collect(), key=lambda r: r.position):  # a row for each column
        if r.kind == "redundant":
            continue
        values = _domain(df, r.column, r.base, precision)
        n = r.n_distinct if r.kind == "binary" or not precision or r.base == "categorical" or r.n_distinct <= most else values.count()
        if n > most:
            raise ValueError(f"{r.column} has {n} values, over {most}: leave it out, or give a lower precision")
        order = Window.orderBy("v")  # the values of one column, at most ``most``
        if r.kind == "binary":
            rules = values.agg(F.max("v").alias("v")).select(F.lit("==").alias("relation"), "v")
        elif r.kind == "categorical":
            rules = values.select(F.lit("==").alias("relation"), "v")
        elif r.kind == "integral":
            rules = values.select(F.lit(">=").alias("relation"), "v")
        else:
            rules = values.select(((F.col("v") + F.lag("v").over(order)) / 2).alias("v")).where("v is not null").select(F.lit(">=").alias("relation"), "v")
        kind = "numeric_binary" if r.kind == "binary" and r.base != "categorical" else r.kind
        rules = rules.withColumn("rank", F.row_number().over(order)).select(F.lit(r.position).alias("position"), F.lit(r.column).alias("column"), F.lit(kind).alias("kind"), "relation", F.col("v").cast("string").alias("reference"), "rank")
        out = rules if out is None else out.unionByName(rules)
    return out if out is not None else df.sparkSession.createDataFrame([], "position int, column string, kind string, relation string, reference string, rank int")


def codex(df: DataFrame, columns: list[str], precision: int = 0, most: int = MOST_RULES) -> list[Rule]:
    """The rules as objects; more than ``most`` is an error: give fewer columns, or a precision, or cut them yourself."""
    rows = codex_table(df, columns, precision, max(most + 1, 2)).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rules: give fewer columns or a lower precision")
    rows.sort(key=lambda r: (r.position, r["rank"]))
    return [Rule(i, r.position, r["column"], r.kind, r.relation, r.reference) for i, r in enumerate(rows)]


def find_rule(rules: list[Rule], column: str, value: float) -> Rule:
    """The rule of a numeric column whose reference is nearest to a value, the first of equals."""
    own = [r for r in rules if r.column == column and r.kind != "categorical"]
    if not own:
        raise ValueError(f"no numeric rule for {column}")
    return min(own, key=lambda r: (abs(float(r.reference) - value), r.index))


def boundaries(rules: list[Rule]) -> dict[str, tuple[int, int]]:
    """First and last-plus-one rule of each ordinal column."""
    out: dict[str, tuple[int, int]] = {}
    for r in rules:
        if r.relation == ">=":
            out[r.column] = (out.get(r.column, (r.index, 0))[0], r.index + 1)
    return out


def binarize(df: DataFrame, rules: list[Rule], keep: list[str] = ()) -> DataFrame:
    """The kept columns, then a 0/1 column for each rule, named by its index."""
    return df.select(*keep, *[r.test().cast("int").alias(f"f{r.index}") for r in rules])


def _sources(rules: list[Rule]) -> list[tuple[Column, bool, list[tuple[object, list[int], list[int]]]]]:
    """What rules read: a column as number or text, whether it is a number, and its references in order with the rules that start to hold there and those that hold there alone."""
    own: dict[tuple, dict] = {}
    for k, r in enumerate(rules):
        number = r.relation == ">=" or r.kind == "numeric_binary"
        at = own.setdefault((r.column, number), {}).setdefault(float(r.reference) if number else r.reference, ([], []))
        at[0 if r.relation == ">=" else 1].append(k)
    return [(as_number(c) if number else as_text(c), number, [(ref, *ks) for ref, ks in sorted(refs.items())]) for (c, number), refs in own.items()]


def _placed(rules: list[Rule]) -> Column:
    """The bits of many rules: each column's value is looked up among its references, and what holds there is a mask known beforehand."""
    features = len(rules)
    sources = _sources(rules)
    tables = []  # per source: references, masks where the value is the n-th reference, masks where it is past n references and none of them
    for _, number, refs in sources:
        at, past, held = [0], [0], 0
        for _, since, alone in refs:
            held += sum(masks.bit(k) for k in since)
            at.append(held + sum(masks.bit(k) for k in alone))
            past.append(held)
        stored = lambda xs: np.array([[x >> (masks.WORD * i) & (masks.bit(masks.WORD) - 1) for i in range(masks.words(features))] for x in xs], np.int64)
        names = [ref for ref, *_ in refs]
        tables.append((number, np.array(names) if number else pa.array(names, pa.string()), stored(at), stored(past)))
    width = masks.words(features)

    def bits(*values: pa.Array) -> pa.Array:
        out = np.zeros((len(values[0]), width), np.int64)
        for v, (number, refs, at, past) in zip(values, tables, strict=True):
            if number:
                x = v.to_numpy(zero_copy_only=False)  # null: NaN, past all references
                n = np.where(np.isnan(x), 0, np.searchsorted(refs, x, side="right"))
                out |= np.where((refs[n - 1] == x)[:, None], at[n], past[n])
            else:
                out |= at[pc.fill_null(pc.index_in(v, value_set=refs), -1).to_numpy(zero_copy_only=False) + 1]
        if not masks.wide(features):
            return pa.array(out[:, 0])
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(out) * width + 1, width, dtype=np.int32)), pa.array(out.ravel()))

    return F.arrow_udf(bits, masks.sql_type(features))(*[v.cast("double") if number else v.cast("string") for v, number, _ in sources])


def bits_of(tests: list[Column] | list[Rule]) -> Column:
    """Which tests hold, as a mask."""
    if len(tests) > FEW_RULES and all(isinstance(t, Rule) for t in tests):
        return _placed(tests)
    return masks.pack([t.test() if isinstance(t, Rule) else t for t in tests])


def pattern_table(df: DataFrame, tests: list[Column] | list[Rule], label: Column, classes: list, keys: list[str] = ()) -> DataFrame:
    """(keys, bits, n_0 .. n_k-1): the rows of each distinct pattern by class.  The one step that reads all rows.

    Counts combine before the shuffle, which moves a row for each pattern and task.  Many
    rules are best given as such: they are told by their columns' values, not one by one.
    """
    rows = df.select(*keys, bits_of(list(tests)).alias("bits"), label.alias("_label"))
    per = [F.count_if(F.col("_label") == F.lit(c)).alias(f"n_{k}") for k, c in enumerate(classes)]
    return rows.groupBy(*keys, "bits").agg(*per)


def majority_mask(patterns: DataFrame, classes: int, costs: list[list[float]] | None = None) -> DataFrame:
    """Patterns with the class that costs least for their rows, the lowest of equals, and the rows in it."""
    from coppice.functions.losses import cost_of

    worth = [-F.col(f"n_{k}").cast("double") if costs is None else F.round(cost_of(k, costs), 12) for k in range(classes)]
    best = F.lit(classes - 1)
    top = F.least(*worth) if classes > 1 else worth[0]
    for k in reversed(range(classes)):
        best = F.when(worth[k] == top, F.lit(k)).otherwise(best)
    rows = F.lit(0).cast("long")
    for k in range(classes):
        rows = F.when(best == k, F.col(f"n_{k}")).otherwise(rows)
    return patterns.withColumn("majority", best.cast("int")).withColumn("majority_rows", rows)
