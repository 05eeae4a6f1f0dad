"""Fill, lag and as-of joins on raw rows at any timestamps (JN-3, WN-1, WN-2).

A window over a group needs the whole group in one task; a group with most of
all rows does not fit one. Here rows are range partitioned by (group, time), so
a large group is cut into slices, each bounded by the partition size. Every
slice is worked on alone, and what it needs from the slices before it (the last
non-null values, the last k rows) comes from a table with a row or two per
slice: partitions + groups rows in all. That table's own window is over slices,
not rows. What comes after a row is taken by a running window in falling order:
a frame up to the end of a slice would be read anew for each of its rows.

The range partitioning is fixed by a reliable checkpoint, so slice numbers hold
when executors are lost. Ties in time go by the columns of ``order``; give
enough of them to make the order total.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendspark.session import ensure_checkpoint_dir

_SLICE, _GROUP, _PLACE = "__slice", "__group", "__place"


def sliced(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """``df`` with its slice number, its group as one struct (null keys are
    equal in it) and its place in the order, range partitioned and fixed."""
    ensure_checkpoint_dir(df.sparkSession)
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    group = F.struct(*[F.col(f"`{k}`") for k in keys]) if keys else F.struct(F.lit(0).alias("all"))
    rows = df.withColumn(_GROUP, group)
    rows = rows.repartitionByRange(_GROUP, *order).sortWithinPartitions(_GROUP, *order)
    # the place is rising along the order: partition number, then row number in it
    return rows.checkpoint().withColumn(_PLACE, F.monotonically_increasing_id()).withColumn(_SLICE, F.spark_partition_id())


def _cleaned(df: DataFrame, rows: DataFrame, extra: list[Column]) -> DataFrame:
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], *extra)


def _in_slice(backward: bool = False):
    return Window.partitionBy(_SLICE, _GROUP).orderBy(F.col(_PLACE).desc() if backward else F.col(_PLACE))


def _slices(backward: bool = False):
    return Window.partitionBy(_GROUP).orderBy(F.col(_SLICE).desc() if backward else F.col(_SLICE))


def _carried(rows: DataFrame, cols: list[str], forward: bool) -> DataFrame:
    """Per slice and group the value of each column that enters it: the last
    non-null one of the slices before (``forward``) or the first after it."""
    pick = F.max_by if forward else F.min_by
    ends = rows.groupBy(_SLICE, _GROUP).agg(*[pick(F.col(f"`{c}`"), F.when(F.col(f"`{c}`").isNotNull(), F.col(_PLACE))).alias(c) for c in cols])
    frame = _slices(not forward).rowsBetween(Window.unboundedPreceding, -1)
    return ends.select(_SLICE, _GROUP, *[F.last(F.col(f"`{c}`"), ignorenulls=True).over(frame).alias(f"__in_{c}") for c in cols])


def _with_carry(rows: DataFrame, carry: DataFrame) -> DataFrame:
    return rows.join(carry, [_SLICE, _GROUP], "left")


def fill(df: DataFrame, keys: list[str], order: list[Column | str], cols: list[str], forward: bool = True,
         backward: bool = False) -> DataFrame:
    """WN-2 on raw rows: nulls of ``cols`` take the last non-null value before
    them in their group (``forward``), then the first after them (``backward``).
    All rows and columns stay; an empty table gives no rows."""
    rows = sliced(df, keys, order)
    out = {c: F.col(f"`{c}`") for c in cols}
    wide = rows
    if forward:
        wide = _with_carry(wide, _carried(rows, cols, True))
        out = {c: F.coalesce(F.last(F.col(f"`{c}`"), ignorenulls=True).over(_in_slice().rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.col(f"__in_{c}")) for c in cols}
    if backward:
        after = _carried(rows, cols, False).withColumnsRenamed({f"__in_{c}": f"__out_{c}" for c in cols})
        wide = _with_carry(wide, after)
        out = {c: F.coalesce(out[c], F.last(F.col(f"`{c}`"), ignorenulls=True).over(_in_slice(True).rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.col(f"__out_{c}")) for c in cols}
    wide = wide.select("*", *[v.alias(f"__new_{c}") for c, v in out.items()])
    return wide.select(*[F.col(f"__new_{c}").alias(c) if c in cols else F.col(f"`{c}`") for c in df.columns])


def lag(df: DataFrame, keys: list[str], order: list[Column | str], cols: list[str], lags: tuple[int, ...] = (1, 3, 6, 12)) -> DataFrame:
    """WN-1 on raw rows: ``{c}_lag{k}`` is the value of the row k places before
    in its group. A slice brings the last max(lags) rows of the slices before
    it, whatever their number of rows."""
    most = max(lags)
    rows = sliced(df, keys, order)
    item = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)])
    ranked = rows.withColumn("__n", F.row_number().over(_in_slice()))
    from_end = F.row_number().over(Window.partitionBy(_SLICE, _GROUP).orderBy(F.col(_PLACE).desc()))
    tail = rows.withColumn("__e", from_end).where(F.col("__e") <= most)  # a limit per group comes before any shuffle
    tail = tail.groupBy(_SLICE, _GROUP).agg(F.sort_array(F.collect_list(F.struct(F.col(_PLACE).alias("p"), item.alias("v")))).alias("__tail"))
    # every slice of a group has a row at least, so the last ``most`` slices hold the last ``most`` rows
    frame = _slices().rowsBetween(-most, -1)
    carry = tail.select(_SLICE, _GROUP, F.flatten(F.collect_list("__tail").over(frame)).alias("__before"))
    wide = _with_carry(ranked, carry)
    new = []
    for k in lags:
        back = F.get(F.col("__before"), (F.size("__before") - (F.lit(k) - F.col("__n")) - 1).cast("int"))
        for i, c in enumerate(cols):
            here = F.lag(F.col(f"`{c}`"), k).over(_in_slice())
            new.append(F.when(F.col("__n") > k, here).otherwise(back["v"][f"c{i}"]).alias(f"{c}_lag{k}"))
    names = [f"{c}_lag{k}" for k in lags for c in cols]
    return wide.select("*", *new).select(*[F.col(f"`{c}`") for c in df.columns], *names)


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str],
          tie: list[str] | None = None, backfill: bool = False) -> DataFrame:
    """JN-3 on raw rows: every row of ``left`` with the ``values`` of the
    latest row of ``right`` in its group at or before its time (the greatest
    ``tie`` among equal times); ``backfill``: before the first one, its values.
    The latest row counts whole: its null values stay null. Null keys are a
    group; rows of ``left`` without a time match nothing, rows of ``right``
    without one are never matched. Both sides are one sorted stream of rows, so
    nothing is compared pair by pair."""
    tie = tie or []
    match = F.struct(*[F.col(f"`{v}`").alias(f"v{i}") for i, v in enumerate(values)])
    rest = [c for c in left.columns if c not in keys]
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)])
    none = [F.lit(None).cast(right.schema[t].dataType).alias(f"__t{i}") for i, t in enumerate(tie)]
    found_type = right.select(match.alias("m")).schema["m"].dataType
    row_type = left.select(row.alias("r")).schema["r"].dataType
    key = [F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)]
    lines = left.select(*key, F.col(f"`{left_time}`").alias("__at"), F.lit(1).alias("__side"), *none, F.lit(None).cast(found_type).alias("__m"), row.alias("__r"))
    events = right.where(F.col(f"`{right_time}`").isNotNull()).select(
        *key, F.col(f"`{right_time}`").alias("__at"), F.lit(0).alias("__side"), *[F.col(f"`{t}`").alias(f"__t{i}") for i, t in enumerate(tie)],
        match.alias("__m"), F.lit(None).cast(row_type).alias("__r"))
    order = ["__at", "__side", *[f"__t{i}" for i in range(len(tie))]]
    both = fill(events.unionByName(lines), [f"__k{i}" for i in range(len(keys))], order, ["__m"], True, backfill)
    out = both.where("__side = 1").withColumn("__m", F.when(F.col("__at").isNotNull(), F.col("__m")))
    back = [F.col(f"__k{keys.index(c)}").alias(c) if c in keys else F.col("__r")[f"c{rest.index(c)}"].alias(c) for c in left.columns]
    return out.select(*back, *[F.col("__m")[f"v{i}"].alias(v) for i, v in enumerate(values)])
