"""Joins of two relations: equality keys, a band (a value of the left side
between two bounds of the right one), or both; inner, left, right and full.

A band is no nested loop.  Values and bounds are mapped to integer cells by a
monotone rule.  An interval takes the smallest level ``L`` at which its cells,
shifted right by ``L``, are at most two, so it gives at most two rows however
long it is; a value gives one row for each level in use (at most 54).  The two
sides meet by equality on (keys, level, shifted cell) and the band itself is
checked on the values.  Only distinct values and distinct intervals meet, so a
value or interval that a third of all rows share is one row there; the rows
come back over equality joins, which adaptive execution can split.  Rows of an
outer side without a partner need no row number: whether a row has one depends
on its keys and its value (or bounds) alone.

``counts`` gives the joined rows counted by columns of either side without
making them, as there may be quadratically many.  With ``c`` the cell of a value
and ``[a, b]`` those of the bounds, a value is in the interval

    [a <= c < b]  +  [c = b and value <= high]  -  [c = a and value < low]

times.  The first term meets by dyadic blocks of cells: a value's cell lies in
one block a level, and ``[a, b)`` is cut into at most two blocks a level, both
sides summed by block before they meet.  The others are running sums inside one
(keys, cell).  So every shuffle holds rows of the sides, never pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOW = ("inner", "left", "right", "full")
FAR = float(1 << 52)  # cells stay exact as doubles; values beyond share the last one


@dataclass(frozen=True)
class Band:
    """left.value between right.low - slack and right.high + slack.  ``step`` is
    a cell's width and ``slack`` a distance: a number, seconds for times, days
    for dates.  The result does not depend on ``step``."""

    value: str
    low: str
    high: str
    slack: float = 0
    step: float = 1


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _moved(c: Column, kind: T.DataType, by: float) -> Column:
    if not by:
        return c
    if isinstance(kind, T.DateType):
        return F.date_add(c, int(by))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return c + F.expr(f"interval '{by}' second")
    return c.cast("double") + F.lit(float(by))


def cell(c: Column, kind: T.DataType, step: float) -> Column:
    """The integer cell of a value: never smaller for a larger value (NaN is the largest)."""
    if isinstance(kind, (T.DateType, T.TimestampNTZType)):
        x = F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("double")
        if not isinstance(kind, T.DateType):  # wall-clock parts: no time zone takes part
            x = x * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    elif isinstance(kind, T.TimestampType):
        x = F.unix_seconds(c).cast("double")
    else:
        x = c.cast("double")
    x = F.when(F.isnan(x), F.lit(FAR)).otherwise(F.greatest(F.lit(-FAR), F.least(F.lit(FAR), x / F.lit(float(step)))))
    return F.floor(x).cast("long")


def _shifted(c: Column, level: Column) -> Column:
    return F.call_function("shiftright", c, level)


def _meetings(points: DataFrame, spans: DataFrame, keys: list[str], kind: T.DataType, step: float) -> DataFrame:
    """(*keys, _v, _lo, _hi): each distinct value with the distinct intervals it lies in."""
    across = F.col("_b") - F.col("_a")
    level = F.when(across <= 1, F.lit(0)).otherwise(F.length(F.bin(across - 1))).cast("int")
    spans = (spans.withColumns({"_a": cell(F.col("_lo"), kind, step), "_b": cell(F.col("_hi"), kind, step)})
             .withColumn("_level", level))
    levels = spans.agg(F.collect_set("_level")).scalar()  # at most 54 numbers
    spans = spans.withColumn("_cell", F.explode(F.sequence(_shifted(F.col("_a"), F.col("_level")), _shifted(F.col("_b"), F.col("_level")))))
    points = (points.withColumn("_c", cell(F.col("_v"), kind, step)).withColumn("_level", F.explode(levels))
              .withColumn("_cell", _shifted(F.col("_c"), F.col("_level"))))
    met = points.join(spans, [*keys, "_level", "_cell"])
    return met.filter(F.col("_v").between(F.col("_lo"), F.col("_hi"))).select(*keys, "_v", "_lo", "_hi")


def _bits(n: Column) -> Column:
    """Binary digits of a positive number, 0 for others."""
    return F.when(n > 0, F.length(F.bin(n))).otherwise(0).cast("int")


def _blocks(spans: DataFrame) -> DataFrame:
    """Each range of cells [_a, _b) as its dyadic blocks (_level, _block)."""
    low = F.expr("shiftright(_a + shiftleft(1L, _level) - 1, _level)")
    at = spans.withColumn("_level", F.explode(F.sequence(F.lit(0), _bits(F.col("_b") - F.col("_a")))))
    at = at.withColumns({"_l": low, "_r": _shifted(F.col("_b"), F.col("_level"))}).filter("_l < _r")
    odd = lambda c: F.col(c).bitwiseAND(F.lit(1)) == 1
    two = F.array_compact(F.array(F.when(odd("_l"), F.col("_l")), F.when(odd("_r"), F.col("_r") - 1)))
    return at.withColumn("_block", F.explode(two)).drop("_l", "_r")


def _summed(df: DataFrame, keys: list[str], weights: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*(F.sum(w).alias(w) for w in weights))


def counts(left: DataFrame, right: DataFrame, on: tuple[tuple[str, str], ...], band: Band, how: str = "inner",
           by: tuple[str, ...] = (), counted: tuple[str, ...] = ()) -> DataFrame:
    """``join(...).groupBy(*by).agg(count(1) as joined, count(c) as c for c in counted)``
    for columns ``l_<name>`` and ``r_<name>``, without the joined rows."""
    if how not in HOW:
        raise ValueError(f"join form {how!r} is not one of {', '.join(HOW)}")
    if not band.step > 0 or band.slack < 0:
        raise ValueError("a band needs a positive step and no negative slack")
    kind, keys = left.schema[band.value].dataType, [f"_k{i}" for i in range(len(on))]
    mine = {s: [c for c in by if c.startswith(f"{s}_")] for s in "lr"}
    told = {s: [c for c in counted if c.startswith(f"{s}_")] for s in "lr"}
    weights = {s: [f"_{s}n", *(f"_{s}n_{c}" for c in told[s])] for s in "lr"}
    bounds = [_moved(_q(c), right.schema[c].dataType, x).alias(n)
              for n, c, x in (("_lo", band.low, -band.slack), ("_hi", band.high, band.slack))]

    def rows(side: str, df: DataFrame, names: list[Column], places: list[str]) -> DataFrame:
        """The side's rows as sums of weights by keys, places and groups."""
        own = df.select(*(_q(pair["lr".index(side)]).alias(k) for k, pair in zip(keys, on)), *names,
                        *(_q(c[2:]).alias(c) for c in mine[side]), *(_q(c[2:]).isNotNull().cast("long").alias(f"_{side}n_{c}") for c in told[side]))
        return _summed(own.withColumn(f"_{side}n", F.lit(1).cast("long")), [*keys, *places, *mine[side]], weights[side])

    lefts, rights = rows("l", left, [_q(band.value).alias("_v")], ["_v"]), rows("r", right, bounds, ["_lo", "_hi"])
    fit = {"l": _present([*keys, "_v"]), "r": _present([*keys, "_lo", "_hi"])}
    fit["r"] = fit["r"] & (F.col("_lo") <= F.col("_hi"))
    points = lefts.filter(fit["l"]).withColumn("_c", cell(F.col("_v"), kind, band.step))
    spans = rights.filter(fit["r"]).withColumns({"_a": cell(F.col("_lo"), kind, band.step), "_b": cell(F.col("_hi"), kind, band.step)})
    longest = (right.select(*bounds).filter("_lo <= _hi")
               .agg(F.max(_bits(cell(F.col("_hi"), kind, band.step) - cell(F.col("_lo"), kind, band.step)))).scalar())
    up = F.explode(F.sequence(F.lit(0), F.coalesce(longest, F.lit(0)))).alias("_level")

    def raised(df: DataFrame) -> DataFrame:
        return df.select("*", up).withColumn("_block", _shifted(F.col("_c"), F.col("_level")))

    def edges(df: DataFrame, *extra: str) -> DataFrame:
        """Both bounds of every interval: the cell, the place in it, and the sign."""
        low = df.select(*keys, *extra, F.col("_a").alias("_c"), F.col("_lo").alias("_x"), F.lit(0).alias("_o"), F.lit(-1).alias("_sign"))
        return low.unionByName(df.select(*keys, *extra, F.col("_b").alias("_c"), F.col("_hi").alias("_x"), F.lit(2).alias("_o"), F.lit(1).alias("_sign")))

    def inside(df: DataFrame, *extra: str) -> DataFrame:
        return df.withColumns({"_x": F.col("_v"), "_o": F.lit(1)}).select(*keys, "_c", "_x", "_o", *extra)

    block = [*keys, "_level", "_block"]
    within = lambda *more: Window.partitionBy(*keys, "_c", *more).orderBy("_x", "_o")
    before = (Window.unboundedPreceding, -1)
    l_cells = _summed(points, [*keys, "_c", *mine["l"]], weights["l"])
    r_cells = _summed(spans, [*keys, "_a", "_b", *mine["r"]], weights["r"])
    l_blocks = _summed(raised(l_cells), [*block, *mine["l"]], weights["l"])
    r_blocks = _summed(_blocks(r_cells), [*block, *mine["r"]], weights["r"])

    products = {"joined": ("_ln", "_rn"), **{c: (f"_ln_{c}", "_rn") for c in told["l"]}, **{c: ("_ln", f"_rn_{c}") for c in told["r"]}}
    out = list(products)

    def multiplied(df: DataFrame) -> DataFrame:
        return df.select(*mine["l"], *mine["r"], *((F.col(a) * F.col(b)).alias(n) for n, (a, b) in products.items()))

    whole = multiplied(l_blocks.join(r_blocks, block))
    marks = edges(spans, *mine["r"], *weights["r"])
    if mine["l"]:  # a row for each left group that the cell holds
        marks = marks.join(l_cells.select(*keys, "_c", *mine["l"]), [*keys, "_c"])
    lined = inside(points, *mine["l"], *weights["l"]).unionByName(marks, allowMissingColumns=True)
    run = within(*mine["l"]).rowsBetween(*before)
    summed = lined.select(*mine["l"], *mine["r"], "_sign", *weights["r"], *(F.coalesce(F.sum(w).over(run), F.lit(0)).alias(w) for w in weights["l"]))
    part = multiplied(summed.filter(F.col("_sign").isNotNull()).withColumns({w: F.col("_sign") * F.col(w) for w in weights["r"]}))
    found = [_summed(whole.unionByName(part), list(by), out).filter(F.col("joined") > 0)]

    def alone(side: str, rest: DataFrame) -> DataFrame:
        """The side's rows without a partner, counted."""
        other = [c for c in by if c not in mine[side]]
        sums = rest.select(*mine[side], *(F.lit(None).cast((right if c[0] == "r" else left).schema[c[2:]].dataType).alias(c) for c in other),
                           F.col(f"_{side}n").alias("joined"), *(F.col(f"_{side}n_{c}").alias(c) if c in told[side] else F.lit(0).cast("long").alias(c) for c in counted))
        return _summed(sums, list(by), out).filter(F.col("joined") > 0)

    if how in ("left", "full"):
        # intervals a value lies in: those of its cell's blocks, and the signed bounds after it in the cell
        over = _summed(_summed(spans, [*keys, "_a", "_b"], ["_rn"]).transform(_blocks), block, ["_rn"])
        cells = _summed(raised(l_cells.select(*keys, "_c").distinct()).join(over, block), [*keys, "_c"], ["_rn"]).withColumnRenamed("_rn", "_over")
        marks = edges(spans, "_rn").withColumn("_rn", F.col("_sign") * F.col("_rn")).drop("_sign")
        lined = inside(points, *mine["l"], *weights["l"]).unionByName(marks, allowMissingColumns=True)
        after = F.coalesce(F.sum("_rn").over(within().rowsBetween(1, Window.unboundedFollowing)), F.lit(0)).alias("_after")
        held = lined.select("*", after).filter(F.col("_ln").isNotNull()).join(cells, [*keys, "_c"], "left")
        lone = held.filter(F.col("_after") + F.coalesce("_over", F.lit(0)) == 0)
        found += [alone("l", lone), alone("l", lefts.filter(~fit["l"]))]
    if how in ("right", "full"):
        # values in an interval: those of its blocks, and the signed ones before its bounds
        held = _summed(l_blocks, block, ["_ln"])
        ranges = _summed(_blocks(r_cells.select(*keys, "_a", "_b").distinct()).join(held, block), [*keys, "_a", "_b"], ["_ln"])
        place = [*keys, "_lo", "_hi"]
        marks = edges(spans.select(*place, "_a", "_b").distinct(), "_lo", "_hi")
        lined = inside(points, "_ln").unionByName(marks, allowMissingColumns=True)
        first = F.coalesce(F.sum("_ln").over(within().rowsBetween(*before)), F.lit(0)) * F.col("_sign")
        sides = lined.select(*place, "_sign", first.alias("_ln")).filter(F.col("_sign").isNotNull()).select(*place, "_ln")
        sides = _summed(sides, place, ["_ln"]).withColumnRenamed("_ln", "_edge")
        lone = (spans.join(sides, place).join(ranges, [*keys, "_a", "_b"], "left")
                .filter(F.col("_edge") + F.coalesce("_ln", F.lit(0)) == 0))
        found += [alone("r", lone), alone("r", rights.filter(~F.coalesce(fit["r"], F.lit(False))))]
    total = found[0]
    for more in found[1:]:
        total = total.unionByName(more)
    return _summed(total, list(by), out).select(*by, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("joined", *counted)))


def join(left: DataFrame, right: DataFrame, on: tuple[tuple[str, str], ...] = (), band: Band | None = None,
         how: str = "inner") -> DataFrame:
    """The joined rows, left columns as ``l_<name>``, right ones as ``r_<name>``.
    Null keys, values and bounds meet nothing, as in SQL; an interval whose
    bounds are the wrong way round holds no value."""
    if how not in HOW:
        raise ValueError(f"join form {how!r} is not one of {', '.join(HOW)}")
    if not on and band is None:
        raise ValueError("a join needs equality keys or a band")
    lefts = left.select(*(_q(c).alias(f"l_{c}") for c in left.columns))
    rights = right.select(*(_q(c).alias(f"r_{c}") for c in right.columns))
    if band is None:
        same = [_q(f"l_{a}") == _q(f"r_{b}") for a, b in on]
        return lefts.join(rights, same, how)
    if not band.step > 0 or band.slack < 0:
        raise ValueError("a band needs a positive step and no negative slack")
    out = [*lefts.columns, *rights.columns]
    kind = left.schema[band.value].dataType
    keys = [f"_k{i}" for i in range(len(on))]
    lefts = lefts.withColumns({"_v": _q(f"l_{band.value}"), **{k: _q(f"l_{a}") for k, (a, _) in zip(keys, on)}})
    bounds = {n: _moved(_q(f"r_{c}"), right.schema[c].dataType, by)
              for n, c, by in (("_lo", band.low, -band.slack), ("_hi", band.high, band.slack))}
    rights = rights.withColumns({**bounds, **{k: _q(f"r_{b}") for k, (_, b) in zip(keys, on)}})
    points = lefts.select(*keys, "_v").filter(_present(keys + ["_v"])).distinct()
    spans = rights.select(*keys, "_lo", "_hi").filter(_present(keys + ["_lo", "_hi"]) & (F.col("_lo") <= F.col("_hi"))).distinct()
    met = _meetings(points, spans, keys, kind, band.step)
    kept = "left" if how in ("left", "full") else "inner"
    rows = lefts.join(met, [*keys, "_v"], kept).join(rights, [*keys, "_lo", "_hi"], kept).select(*map(_q, out))
    if how in ("inner", "left"):
        return rows
    alone = rights.join(met.select(*keys, "_lo", "_hi").distinct(), [*keys, "_lo", "_hi"], "left_anti")
    blank = [F.lit(None).cast(left.schema[c].dataType).alias(f"l_{c}") for c in left.columns]
    return rows.unionAll(alone.select(*blank, *(_q(f"r_{c}") for c in right.columns)))


def _present(names: list[str]) -> Column:
    """None of the columns is null (``dropna`` would drop NaN too)."""
    out = F.lit(True)
    for n in names:
        out = out & _q(n).isNotNull()
    return out
