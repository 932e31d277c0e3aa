"""Ordered computations that never put a whole group into one task.

A window with an unbounded frame sorts each group inside one task, so a group holding a
third of all rows becomes one task holding a third of all rows. Here every group is cut into
ranges of the order column first. The cuts are the order values whose hash falls on zero
modulo ``rows_per_range``: about one row in every ``rows_per_range`` is a cut, whatever the
distribution, and the same data always give the same cuts. Running values are then taken
inside each range and completed by the running value over the range totals. The result is exact.

Cuts have two levels: one cut in ``FAN`` is coarse, and a row meets the coarse cuts of its group and
the fine ones of its coarse range, so no array and no window over ranges grows beyond a few
thousand entries. The cuts are written first; where none was drawn, all groups are one range. So is the group
with a NULL key: its result is exact, but it is one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.session import staged

ROWS_PER_RANGE = 65_536
#: Fine ranges in a coarse one, about.
FAN = 4_096
#: Rows of one value that meet its rank in one task; those of a commoner value are spread.
HOT_ROWS = 1_048_576
_SEARCH_STEPS = 20
_SHIFT = 24  # a range number is the coarse number, shifted, plus the fine one


def settled(df: DataFrame, name: str = "settled") -> DataFrame:
    """An aggregate written to the shared folder.

    What is read several times is computed once. And its size is known from then on: a small side
    of a join is broadcast exactly when it is below Spark's own limit, where an aggregate of unknown
    size would make the planner shuffle the large side on a few hot keys.
    """
    return staged(df, name)


def drawn_cuts(df: DataFrame, keys: list[str], order: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """(keys, _cut, _coarse, _extra): order values whose hash makes them a cut."""
    mark = F.xxhash64(F.lit(17), order)
    cuts = df.filter(F.pmod(mark, F.lit(rows_per_range)) == 0).select(*keys, F.col(order).alias("_cut"), (F.pmod(mark, F.lit(rows_per_range * FAN)) == 0).alias("_coarse"))
    return cuts.distinct().withColumn("_extra", F.lit(None).cast("long"))


def _position(cuts: Column, value: Column) -> Column:
    """How many entries of a sorted array of cuts are <= value, by binary search."""
    powers = F.array(*[F.lit(1 << s) for s in range(_SEARCH_STEPS - 1, -1, -1)])
    found = F.aggregate(
        powers,
        F.lit(0),
        lambda acc, p: F.when(F.get(cuts, acc + p - F.lit(1))["_cut"] <= value, acc + p).otherwise(acc),
    )
    return F.when(cuts.isNull() | (F.size(cuts) == 0), F.lit(0)).otherwise(found)


def place(df: DataFrame, cuts: DataFrame, keys: list[str], value: str, name: str = "_range", extra: str | None = None) -> tuple[DataFrame, bool]:
    """Add the number of each row's range, given a stored table of cuts; and tell whether coarse cuts exist.

    ``extra`` names a column for the ``_extra`` of the cut that a row's value equals.
    """
    if cuts.isEmpty():
        out = df.withColumn(name, F.lit(0).cast("long"))
        return (out.withColumn(extra, F.lit(None).cast("long")) if extra else out), False
    one = F.lit(0).alias("_all")
    join = keys or ["_all"]
    rows = df if keys else df.withColumn("_all", F.lit(0))
    own = cuts if keys else cuts.select("*", one)
    coarse = own.filter("_coarse")
    deep = not coarse.isEmpty()
    if deep:
        lists = settled(coarse.groupBy(*join).agg(F.array_sort(F.collect_list(F.struct("_cut"))).alias("_list")), "coarse")
        rows = rows.join(lists, join, "left").withColumn("_high", _position(F.col("_list"), F.col(value))).drop("_list")
        own = own.join(lists, join, "left").withColumn("_high", _position(F.col("_list"), F.col("_cut"))).drop("_list")
    else:
        rows, own = rows.withColumn("_high", F.lit(0)), own.withColumn("_high", F.lit(0))
    lists = settled(own.groupBy(*join, "_high").agg(F.array_sort(F.collect_list(F.struct("_cut", "_extra"))).alias("_list")), "cuts")
    rows = rows.join(lists, [*join, "_high"], "left").withColumn("_low", _position(F.col("_list"), F.col(value)))
    if extra:
        at = F.get("_list", F.col("_low") - 1)
        rows = rows.withColumn(extra, F.when(at["_cut"] == F.col(value), at["_extra"]))
    number = F.shiftleft(F.col("_high").cast("long"), _SHIFT) + F.col("_low")
    return rows.withColumn(name, number).drop("_list", "_high", "_low", *([] if keys else ["_all"])), deep


def before_ranges(totals: DataFrame, keys: list[str], number: str, before: dict[str, tuple[str, str]], deep: bool, back: bool = False) -> DataFrame:
    """(keys, number, and per new column the aggregate over earlier ranges), from one row per range.

    With coarse ranges, their totals are ordered on their own, so that a window holds the ranges of one of them.
    ``back`` aggregates over later ranges instead.
    """
    high = F.shiftright(F.col(number), _SHIFT)
    by = (lambda c: F.col(c).desc()) if back else F.col
    if not deep:
        w = Window.partitionBy(*keys).orderBy(by(number)).rowsBetween(Window.unboundedPreceding, -1)
        return totals.select(*keys, number, *[_over(kind, col, w).alias(new) for new, (kind, col) in before.items()])
    totals = settled(totals.withColumn("_high", high), "totals")
    tops = totals.groupBy(*keys, "_high").agg(*[_total(kind, col, number).alias(f"_s_{new}") for new, (kind, col) in before.items()])
    w = Window.partitionBy(*keys).orderBy(by("_high")).rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*keys, "_high", *[_over(kind, f"_s_{new}", w).alias(f"_s_{new}") for new, (kind, _) in before.items()])
    w = Window.partitionBy(*keys, "_high").orderBy(by(number)).rowsBetween(Window.unboundedPreceding, -1)
    inner = totals.select(*keys, "_high", number, *[_over(kind, col, w).alias(new) for new, (kind, col) in before.items()])
    both = inner.join(tops, [*keys, "_high"])
    return both.select(*keys, number, *[_merge(kind, F.col(f"_s_{new}"), F.col(new)).alias(new) for new, (kind, _) in before.items()])


def _total(kind: str, column: str, order: str) -> Column:
    if kind == "sum":
        return F.sum(column)
    if kind == "max":
        return F.max(column)
    if kind == "min":
        return F.min(column)
    if kind == "last":
        return F.max(F.when(F.col(column).isNotNull(), F.struct(F.col(order).alias("o"), F.col(column).alias("v"))))["v"]
    raise ValueError(f"unknown running aggregate {kind!r}")


def _over(kind: str, column: str, window) -> Column:
    if kind == "last":
        return F.last(column, ignorenulls=True).over(window)
    return {"sum": F.sum, "max": F.max, "min": F.min}[kind](column).over(window)


def _merge(kind: str, earlier: Column, inside: Column) -> Column:
    if kind == "sum":
        return F.coalesce(earlier, F.lit(0)) + F.coalesce(inside, F.lit(0))
    if kind == "max":
        return F.greatest(earlier, inside)
    if kind == "min":
        return F.least(earlier, inside)
    return F.coalesce(inside, earlier)


def running(
    df: DataFrame,
    keys: list[str],
    order: str,
    before: dict[str, tuple[str, str]],
    rows_per_range: int | None = None,
    stored: bool = False,
) -> DataFrame:
    """Add, per row, aggregates over the rows of its group that come strictly before it.

    ``before`` maps a new column to (kind, column), kind being sum, max, min or last (the last
    non-null value). ``order`` must be unique within a group. ``stored`` says that df is a stored table with
    few steps on top, which may be read three times; other inputs are written first.
    """
    source = df if stored else settled(df, "rows")
    cuts = settled(drawn_cuts(source, keys, order, rows_per_range or ROWS_PER_RANGE), "drawn")
    ranged, deep = place(source, cuts, keys, order)
    inside = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    if cuts.isEmpty():
        plain = {name: _over(kind, col, inside) for name, (kind, col) in before.items()}
        return ranged.select(*df.columns, *[(F.coalesce(v, F.lit(0)) if before[name][0] == "sum" else v).alias(name) for name, v in plain.items()])
    totals = ranged.groupBy(*keys, "_range").agg(*[_total(kind, col, order).alias(f"_t_{name}") for name, (kind, col) in before.items()])
    offsets = before_ranges(totals, keys, "_range", {f"_o_{name}": (kind, f"_t_{name}") for name, (kind, _) in before.items()}, deep)
    out = ranged.join(offsets, keys + ["_range"], "left")
    return out.select(*df.columns, *[_merge(kind, F.col(f"_o_{name}"), _over(kind, col, inside)).alias(name) for name, (kind, col) in before.items()])


def two_sided(
    df: DataFrame,
    keys: list[str],
    order: str,
    before: dict[str, tuple[str, str]],
    after: dict[str, tuple[str, str]],
    rows_per_range: int | None = None,
    stored: bool = False,
) -> DataFrame:
    """running, with aggregates over the rows that come strictly after a row as well (sum, max or min).

    Both sides share the cuts and the one shuffle into ranges; a range is sorted once each way.
    """
    if any(kind == "last" for kind, _ in after.values()):
        raise ValueError("rows after a row have no last value: use min or max")
    source = df if stored else settled(df, "rows")
    cuts = settled(drawn_cuts(source, keys, order, rows_per_range or ROWS_PER_RANGE), "drawn")
    ranged, deep = place(source, cuts, keys, order)
    part = Window.partitionBy(*keys, "_range")
    # A frame that ends at the last row would be aggregated anew for every row: the other order makes it a running one.
    sides = ((before, False, part.orderBy(order)), (after, True, part.orderBy(F.col(order).desc())))
    out, values = ranged, []
    if not cuts.isEmpty():
        sums = [_total(kind, col, order).alias(f"_t_{name}") for aggs, _, _ in sides for name, (kind, col) in aggs.items()]
        totals = settled(ranged.groupBy(*keys, "_range").agg(*sums), "totals")
        for aggs, back, _ in sides:
            offsets = before_ranges(totals, keys, "_range", {f"_o_{name}": (kind, f"_t_{name}") for name, (kind, _) in aggs.items()}, deep, back)
            out = out.join(settled(offsets, "offsets"), keys + ["_range"], "left")
    for aggs, _, window in sides:
        frame = window.rowsBetween(Window.unboundedPreceding, -1)
        for name, (kind, col) in aggs.items():
            elsewhere = F.lit(None) if cuts.isEmpty() else F.col(f"_o_{name}")
            values.append(_merge(kind, elsewhere, _over(kind, col, frame)).alias(name))
    return out.select(*df.columns, *values)


def row_index(df: DataFrame, keys: list[str], order: str, name: str = "row_index", rows_per_range: int | None = None, stored: bool = False) -> DataFrame:
    """Add the 0-based position of each row in its group."""
    return running(df.withColumn("_one", F.lit(1).cast("bigint")), keys, order, {name: ("sum", "_one")}, rows_per_range, stored).drop("_one")


def numbered(df: DataFrame, keys: list[str], value: str, tie: str, name: str = "rank", rows_per_range: int | None = None) -> DataFrame:
    """Add 1-based places: highest value first, missing ones last, equal values by ``tie``, which is unique in its group."""
    place_of = F.struct(F.col(value).isNull().alias("none"), (-F.col(value)).alias("value"), F.col(tie).alias("tie"))
    out = row_index(df.withColumn("_place", place_of), keys, "_place", name, rows_per_range)
    return out.withColumn(name, (F.col(name) + 1).cast("int")).drop("_place")


def trailing(
    df: DataFrame,
    keys: list[str],
    order: str,
    width: int,
    aggs: dict[str, Column],
    rows_per_range: int | None = None,
    behind: bool = True,
    stored: bool = False,
) -> DataFrame:
    """Add window aggregates over the last ``width`` rows, the current one included.

    Rows get their position, positions are cut into equal blocks, and each block also receives
    the ``width - 1`` rows before it, so that blocks are independent tasks. ``behind=False``
    looks at the next rows instead.
    """
    halo = width - 1
    frame = (-halo, 0) if behind else (0, halo)
    size, pos = max(rows_per_range or ROWS_PER_RANGE, width), F.col("_pos")
    block = F.floor(pos / size)
    near = F.floor((pos + halo) / size) if behind else F.floor((pos - halo) / size)
    first, last = (block, near) if behind else (F.greatest(near, F.lit(0)), block)
    spread = row_index(df, keys, order, "_pos", rows_per_range, stored).withColumn("_home", block).withColumn("_block", F.explode(F.sequence(first, last)))
    window = Window.partitionBy(*keys, "_block").orderBy("_pos").rowsBetween(*frame)
    out = spread
    for name, agg in aggs.items():
        out = out.withColumn(name, agg.over(window))
    return out.filter(F.col("_block") == F.col("_home")).select(*df.columns, *aggs)


def previous(df: DataFrame, keys: list[str], order: str, columns: dict[str, str], rows_per_range: int | None = None) -> DataFrame:
    """lag(1) for groups of any size: columns maps new name to source column."""
    return _neighbour(df, keys, order, columns, rows_per_range, True)


def following(df: DataFrame, keys: list[str], order: str, columns: dict[str, str], rows_per_range: int | None = None) -> DataFrame:
    """lead(1) for groups of any size."""
    return _neighbour(df, keys, order, columns, rows_per_range, False)


def _neighbour(df, keys, order, columns, rows_per_range, behind):
    pick = F.first if behind else F.last
    aggs = {f"_n_{new}": pick(F.struct(F.col(order).alias("o"), F.col(src).alias("v"))) for new, src in columns.items()}
    out = trailing(df, keys, order, 2, aggs, rows_per_range, behind)
    for new in columns:
        # With one row in the frame the neighbour is the row itself: there is none.
        out = out.withColumn(new, F.when(F.col(f"_n_{new}.o") != F.col(order), F.col(f"_n_{new}.v")))
    return out.select(*df.columns, *columns)


def value_ranks(df: DataFrame, keys: list[str], values: list[str], rows_per_range: int | None = None) -> DataFrame:
    """(keys, _column, _value, avg_rank, group_rows, value_rows): one row per distinct value of each column.

    All columns are unpivoted and counted in one pass, so their ranks are running sums over one table.
    """
    kind = "double" if len(values) > 1 else dict(df.dtypes)[values[0]]
    cells = F.inline(F.array(*[F.struct(F.lit(i).alias("_column"), F.col(v).cast(kind).alias("_value")) for i, v in enumerate(values)]))
    long = df.select(*keys, cells).filter(F.col("_value").isNotNull())
    own = [*keys, "_column"]
    counts = settled(long.groupBy(*own, "_value").agg(F.count(F.lit(1)).alias("_c")), "values")
    placed = running(counts, own, "_value", {"_below": ("sum", "_c")}, rows_per_range, stored=True)
    sizes = settled(counts.groupBy(*own).agg(F.sum("_c").alias("group_rows")), "sizes")
    ranks = placed.select(*own, "_value", (F.col("_below") + (F.col("_c") + 1) / 2).alias("avg_rank"), F.col("_c").alias("value_rows"))
    return settled(ranks.join(sizes, own), "ranks")


def _with_answers(df: DataFrame, ranks: DataFrame, keys: list[str], answers: dict[str, tuple[str, Column]], hot_rows: int) -> DataFrame:
    """Add to each row what its values have in ``ranks``: answers maps the i-th ranked column to (new name, expression).

    Rows meet their answer by (keys, value, salt). The salt is 0 but for values that more than ``hot_rows`` rows
    share: those rows are spread over one salt for every ``hot_rows`` of them, by a hash of the whole row, and the answer is there
    once per salt. Which values these are a row finds like its range, in a sorted list. Rows without an answer (NULL
    value or key) are spread as well. Rows that are equal in every column share a salt.
    """
    salts = F.ceil(F.col("value_rows") / hot_rows)
    coarse = F.pmod(F.xxhash64(F.lit(17), "_value"), F.lit(FAN)) == 0
    hot = ranks.filter(F.col("value_rows") > hot_rows).select(*keys, "_column", F.col("_value").alias("_cut"), coarse.alias("_coarse"), salts.alias("_extra"))
    hot = settled(hot, "hot")
    crowded = {r["_column"] for r in hot.select("_column").distinct().collect()}  # at most one entry per ranked column
    hashed = [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    out = df.withColumn("_spread", F.xxhash64(F.lit(29), *hashed))
    own = [F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)]
    for i, (c, (name, answer)) in enumerate(answers.items()):
        one = ranks.filter(F.col("_column") == i)
        salt = F.lit(0).cast("bigint")
        if i in crowded:
            out, _ = place(out, hot.filter(F.col("_column") == i).drop("_column"), keys, c, "_near", "_salts")
            salt = F.when(F.col("_salts").isNotNull(), F.pmod("_spread", "_salts")).otherwise(salt)
        none = F.col(c).isNull()
        for k in keys:
            none = none | F.col(k).isNull()
        out = out.withColumn("_salt", F.when(none, F.pmod("_spread", F.lit(FAN))).otherwise(salt))
        one = one.select(*own, F.col("_value").alias("_v"), answer.alias(name), F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1)).alias("_s"))
        same = (F.col(c) == F.col("_v")) & (F.col("_salt") == F.col("_s"))
        for j, k in enumerate(keys):
            same = same & (F.col(k) == F.col(f"_k{j}"))
        out = out.join(one, same, "left").drop("_v", "_s", "_salt", "_near", "_salts", *[f"_k{j}" for j in range(len(keys))])
    return out.select(*df.columns, *[name for name, _ in answers.values()])


def with_ranks(df: DataFrame, keys: list[str], values: dict[str, str], rows_per_range: int | None = None, share: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add average ranks (ties share the mean rank, NULL has none): values maps a column to its rank's name.

    With ``share`` ranks are divided by the values of the group.
    """
    ranks = value_ranks(df, keys, list(values), rows_per_range)
    rank = F.col("avg_rank") / F.col("group_rows") if share else F.col("avg_rank")
    out = _with_answers(df, ranks, keys, {c: (f"_rank{i}", rank) for i, c in enumerate(values)}, hot_rows)
    return out.withColumns({name: F.col(f"_rank{i}") for i, name in enumerate(values.values())}).drop(*[f"_rank{i}" for i in range(len(values))])


def ranked(df: DataFrame, keys: list[str], value: str, rows_per_range: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``avg_rank`` (ties share the mean rank) and ``group_rows`` to each row."""
    ranks = value_ranks(df, keys, [value], rows_per_range)
    sizes = settled(ranks.groupBy(*keys).agg(F.max("group_rows").alias("group_rows")), "sizes")
    out = _with_answers(df, ranks, keys, {value: ("avg_rank", F.col("avg_rank"))}, hot_rows)
    return out.join(sizes, keys, "left") if keys else out.withColumn("group_rows", sizes.select("group_rows").scalar())
