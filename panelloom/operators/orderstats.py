"""Exact quantiles and average ranks within groups of any size.

Groups are counted first. One with at most `values_per_task` values (rows x columns) is handled
whole by one task; the columns of a larger one go to different tasks; and a column that is still
too long is never sorted or held in one place but cut at split values:

1. a quantile sketch per (group, feature) proposes split values; they only balance the work,
   and are written down once so that every later pass sees the same ones;
2. counting rows per bucket gives the number of rows below each bucket. A split value is a
   bucket of its own, so heavily tied values are resolved by counting alone;
3. only rows of the one bucket that holds the wanted position are ever sorted. A round makes `MOST_BUCKETS` at most,
   so that finding a row's bucket costs the same however many rows there are; a bucket that is too long yet is cut again.

Ranks of such columns are taken in ranges of the sorted values, and shifted by what lies in earlier ranges. A range is read
as a stream: there are no more of them than tasks in a shuffle, unless even those would be longer than VALUES_PER_TASK.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom.constants import FEW_COLUMNS, SLICE_VALUES, VALUES_PER_TASK
from panelloom.operators.joins import join_small
from panelloom.sources.shipping import ship
from panelloom.sources.storage import materialize


#: Buckets that a round of the search for quantiles makes at most.
MOST_BUCKETS = 512


def to_long(df: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    """One row per (row, value column): ids, `feature` (position in `values`) and `value` as double."""
    together = ", ".join(f"CAST({quoted(v)} AS DOUBLE)" for v in values)
    return df.select(*ids, F.expr(f"posexplode(array({together})) AS (feature, value)"))


def quoted(name: str) -> str:
    """A column name inside an SQL expression. Long column lists are written as SQL text: one call per list."""
    return "`" + name.replace("`", "``") + "`"


def group_sizes(df: DataFrame, group: list[str]) -> DataFrame:
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("group_rows"))


def largest_group(df: DataFrame, group: list[str]) -> int:
    return group_sizes(df, group).agg(F.max("group_rows")).first()[0] or 0


# -- splitting hot groups ------------------------------------------------------------------

def _bucket_count(largest: int, values_per_task: int) -> int:
    return max(2, math.ceil(largest / values_per_task) + 1)


def _split_values(hot_long: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """keys, `splits` (ascending, distinct) and `coarse` (last split of every run of splits)."""
    probs = [i / buckets for i in range(1, buckets)]
    sketch = F.percentile_approx("value", F.array(*[F.lit(p) for p in probs]),
                                 F.lit(max(10_000, 10 * buckets)))
    step = _step(buckets)
    found = hot_long.groupBy(*keys).agg(F.array_sort(F.array_distinct(sketch)).alias("splits"))
    return materialize(found.withColumn(
        "coarse", F.filter("splits", lambda s, i: (i + 1) % step == 0)), "splits")


def _step(buckets: int) -> int:
    return max(2, math.isqrt(buckets))


def _with_bucket(long: DataFrame, splits: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """Adds `bucket`: 2k between splits k-1 and k, 2k+1 for rows equal to split k.

    Rows of a group without splits get bucket 0. The search first looks through every `step`-th
    split, then through one run of splits.
    """
    step = _step(buckets)
    value = F.col("value")
    none = F.array().cast("array<double>")
    joined = join_small(long, splits, keys, "left", cells_per_row=2 * buckets + len(keys))
    found = joined.select(
        *long.columns,
        F.coalesce("splits", none).alias("_splits"),
        (F.size(F.filter(F.coalesce("coarse", none), lambda s: s < value)) * step).alias("_start"))
    below = F.col("_start") + F.size(
        F.filter(F.slice("_splits", F.col("_start") + 1, F.lit(step)), lambda s: s < value))
    at_split = F.coalesce(F.get("_splits", F.col("_below")) == value, F.lit(False))
    return (found.withColumn("_below", below)
                 .select(*long.columns, (2 * F.col("_below") + at_split.cast("int")).alias("bucket")))


def _bucket_offsets(bucketed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, bucket, `bucket_rows` and `below_rows`: rows of the group in lower buckets."""
    counts = bucketed.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("bucket_rows"))
    lower = W.partitionBy(*keys).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    return materialize(counts.withColumn(
        "below_rows", F.coalesce(F.sum("bucket_rows").over(lower), F.lit(0))), "offsets")


def part_large_groups(df: DataFrame, group: list[str], max_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of groups within `max_rows`, and rows of larger groups (None if there are none).

    Larger groups are few, at most one per `max_rows` rows of `df`. Where all are larger, and none is NULL, `df` itself is returned as theirs.
    """
    sizes, rows = group_sizes(df, group), F.col("group_rows")
    nameless = F.greatest(*[F.col(c).isNull().cast("int") for c in group], F.lit(0))
    least, most, null = sizes.agg(F.min(rows), F.max(rows), F.max(nameless)).first()
    if (most or 0) <= max_rows:
        return df, None
    if least > max_rows and not null:
        return df.limit(0), df
    large = materialize(sizes.filter(F.col("group_rows") > max_rows).select(*group, F.lit(True).alias("_large")),
                        "large-groups")
    marked = join_small(df, large, group, "left")
    return marked.filter(F.col("_large").isNull()).drop("_large"), marked.filter(F.col("_large")).drop("_large")


# -- quantiles -----------------------------------------------------------------------------

def _row_position(p: float, n: Column, method: str) -> Column:
    """0-based position of the observed value that a method other than "linear" takes."""
    if method == "nearest":  # halves go up
        return F.floor(F.lit(p) * (n - 1) + 0.5)
    # first row whose share of rows up to and including itself reaches p
    rank = F.ceil(F.lit(p) * n)
    rank = F.when((rank - 1) / n >= p, rank - 1).otherwise(rank)
    return F.greatest(rank - 1, F.lit(0))


def _plain_quantiles(long: DataFrame, keys: list[str], probs: list[float], method: str) -> DataFrame:
    """Interpolated: one map of values and counts for each key, shared by the probabilities. Else: the rows in order."""
    if method == "linear":
        return long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"),
                                       F.percentile("value", F.array(*map(F.lit, probs))).alias("q"))
    # the exact share of a position, so that interpolation meets an observed value; sorted rows spill, an array of them would not
    spots = [_row_position(p, F.col("n"), method) for p in probs]
    placed = (long.withColumn("_row", F.row_number().over(W.partitionBy(*keys).orderBy("value")) - 1)
              .withColumn("n", F.count(F.lit(1)).over(W.partitionBy(*keys))))
    return placed.groupBy(*keys).agg(F.max("n").alias("n"), F.array(*[F.max(F.when(F.col("_row") == at, F.col("value"))) for at in spots]).alias("q"))


def _wanted_positions(offsets: DataFrame, keys: list[str], probs: list[float], method: str) -> DataFrame:
    """keys, n, `p_index`, `pos` (0-based row position in sorted order) and its `share`."""
    totals = offsets.groupBy(*keys).agg(F.sum("bucket_rows").alias("n"))
    wanted = []
    for i, p in enumerate(probs):
        if method == "linear":
            spot = F.lit(p) * (F.col("n") - 1)
            low, frac = F.floor(spot).cast("bigint"), spot - F.floor(spot)
            wanted.append(F.struct(F.lit(i).alias("p_index"), low.alias("pos"), (1 - frac).alias("share")))
            wanted.append(F.struct(F.lit(i).alias("p_index"), F.least(low + 1, F.col("n") - 1).alias("pos"),
                                   frac.alias("share")))
        else:
            wanted.append(F.struct(F.lit(i).alias("p_index"), _row_position(p, F.col("n"), method).cast("bigint").alias("pos"),
                                   F.lit(1.0).alias("share")))
    return totals.select(*keys, "n", F.inline(F.array(*wanted)))


def _split_quantiles(hot_long: DataFrame, keys: list[str], probs: list[float], method: str,
                     largest: int, values_per_task: int) -> DataFrame:
    """Rounds of cutting: the first over all rows, later ones over the rows of buckets that hold a wanted position and are too long to sort."""
    rows, nested, wanted, found = hot_long, list(keys), None, []
    columns = [*keys, "n", "p_index", "share", "value"]
    while True:
        buckets = _bucket_count(largest, values_per_task)
        capped, buckets = buckets > MOST_BUCKETS, min(buckets, MOST_BUCKETS)
        splits = _split_values(rows, nested, buckets)
        bucketed = _with_bucket(rows, splits, nested, buckets)
        offsets = _bucket_offsets(bucketed, nested)
        if wanted is None:
            wanted = _wanted_positions(offsets, keys, probs, method)
        holds = (F.col("below_rows") <= F.col("pos")) & (F.col("pos") < F.col("below_rows") + F.col("bucket_rows"))
        spots = materialize(wanted.join(offsets, nested).filter(holds), "spots")

        at_split = F.col("bucket") % 2 == 1
        known = (spots.filter(at_split).join(splits.select(*nested, "splits"), nested)
                      .withColumn("value", F.get("splits", F.floor(F.col("bucket") / 2).cast("int"))))
        found.append(known.select(columns))
        open_spots = spots.filter(~at_split)
        longest = open_spots.agg(F.max("bucket_rows")).first()[0]
        if longest is None:
            break
        inside = join_small(bucketed, open_spots.select(*nested, "bucket").distinct(), nested + ["bucket"], "inner")
        if not capped or longest <= values_per_task or longest >= largest:
            placed = inside.withColumn("_row", F.row_number().over(W.partitionBy(*nested, "bucket").orderBy("value")) - 1)
            found.append(placed.join(open_spots, nested + ["bucket"])
                               .filter(F.col("_row") == F.col("pos") - F.col("below_rows")).select(columns))
            break
        within = f"_in_{len(nested) - len(keys)}"
        rows = materialize(inside.select(*nested, F.col("bucket").alias(within), "value"), "open-buckets")
        wanted = open_spots.select(*nested, F.col("bucket").alias(within), "n", "p_index", (F.col("pos") - F.col("below_rows")).alias("pos"), "share")
        nested, largest = [*nested, within], longest
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    each = (whole.groupBy(*keys, "n", "p_index")
                 .agg(F.sum(F.when(F.col("share") > 0, F.col("share") * F.col("value"))).alias("q")))
    return each.groupBy(*keys, "n").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("p_index", "q"))), lambda s: s["q"]).alias("q"))


def group_quantiles(df: DataFrame, group: list[str], values: list[str], probs: list[float],
                    method: str = "linear", values_per_task: int = VALUES_PER_TASK) -> DataFrame:
    """Exact quantiles of each value column within each group, NULLs left out.

    Returns group, `feature` (position in `values`), `n` (values seen) and `q`, an array in the order
    of `probs`. `method` is "linear" (interpolated), "nearest" (the observed value closest to that place) or "disc"
    (the first observed value that reaches the share). `df` is read several times when a group is large: pass a
    stored table.
    """
    if method not in ("linear", "nearest", "disc"):
        raise ValueError("method must be 'linear', 'nearest' or 'disc'")
    keys = group + ["feature"]

    def long(part: DataFrame) -> DataFrame:
        return to_long(part, group, values).filter(F.col("value").isNotNull())

    if not group:
        total = df.count()
        if total <= values_per_task:
            return _plain_quantiles(long(df), keys, probs, method)
        return _split_quantiles(long(df), keys, probs, method, total, values_per_task)
    small, large = part_large_groups(df, group, values_per_task)
    found = _plain_quantiles(long(small), keys, probs, method)
    if large is None:
        return found
    return found.unionByName(_split_quantiles(long(large), keys, probs, method, largest_group(large, group), values_per_task))


def group_medians(df: DataFrame, group: list[str], values: list[str], prefix: str = "median_",
                  values_per_task: int = VALUES_PER_TASK) -> DataFrame:
    """One row per group: its number of rows as `group_rows` and the median of every value column."""
    def whole(part: DataFrame) -> DataFrame:
        return part.groupBy(*group).agg(F.count(F.lit(1)).alias("group_rows"), *[
            F.expr(f"median(CAST({quoted(v)} AS DOUBLE)) AS {quoted(prefix + v)}") for v in values])

    small, large = part_large_groups(df, group, values_per_task // len(values))
    if large is None:
        return whole(small)
    long = group_quantiles(large, group, values, [0.5], "linear", values_per_task)
    found = long.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("feature", F.col("q")[0]))).alias("_q"))
    # the sizes carry the groups in which every value is missing
    wide = group_sizes(large, group).join(found, group, "left").selectExpr(
        *group, "group_rows", *[f"_q[{i}] AS {quoted(prefix + v)}" for i, v in enumerate(values)])
    return whole(small).unionByName(wide)


# -- average ranks -------------------------------------------------------------------------

def _local_rank(group: list[str], value: str) -> Column:
    """1-based rank in which equal values share the mean of their positions; NULL for NULL, which counts nowhere."""
    window = W.partitionBy(*group).orderBy(F.col(value).asc_nulls_last())
    ties = F.count(F.lit(1)).over(window.rangeBetween(W.currentRow, W.currentRow))
    return F.when(F.col(value).isNotNull(), F.rank().over(window) + (ties - 1) / F.lit(2.0))


def _ranks_by_column(df: DataFrame, group: list[str], values: list[str], suffix: str) -> DataFrame:
    return df.select("*", *[
        _local_rank(group, v).alias(v + suffix) for v in values])


def _ranks_by_group(df: DataFrame, group: list[str], values: list[str], suffix: str) -> DataFrame:
    """A group at a time, all columns, in Arrow batches; other columns pass through untouched."""
    schema = T.StructType(df.schema.fields + [T.StructField(v + suffix, T.DoubleType()) for v in values])
    shared_ranks = array_ranker()

    def rank_all(table: pa.Table) -> pa.Table:
        for v in values:
            column = table.column(v).combine_chunks()
            there = column.is_valid().to_numpy(zero_copy_only=False)
            ranks = np.zeros(len(there))
            ranks[there] = shared_ranks(column.drop_null().to_numpy(zero_copy_only=False).astype(np.float64))
            table = table.append_column(v + suffix, pa.array(ranks, mask=~there))
        return table

    ship(df.sparkSession)
    return df.groupBy(*group).applyInArrow(rank_all, schema)


def array_ranker() -> Callable[[np.ndarray], np.ndarray]:
    """A function for 1-based ranks of an array, equal values (NaN included) sharing the mean of their positions.

    Built inside a function so that it travels to the workers whole, without this package.
    """
    def shared_ranks(values: np.ndarray) -> np.ndarray:
        order = np.argsort(values, kind="stable")
        ordered = values[order]
        new = np.append(True, (ordered[1:] != ordered[:-1]) & ~np.isnan(ordered[:-1]))
        first = np.flatnonzero(new)
        length = np.diff(np.append(first, len(values)))
        ranks = np.empty(len(values))
        ranks[order] = np.repeat(first + (length + 1) / 2.0, length)
        return ranks

    return shared_ranks


def fill_and_rank(df: DataFrame, group: list[str], values: list[str], precision: str = "double") -> DataFrame:
    """Groups that fit a task: missing values filled with the group's median (zero without one), then ranked.

    One shuffle and one Arrow function for a group at a time: no map of values is built and no median table joined.
    `values` are replaced by `<value>_rank`, average ranks spread over [-1, 1]; the only row of a group sits at 0.
    """
    others = [f for f in df.schema.fields if f.name not in values]
    kind = T.FloatType() if precision == "float" else T.DoubleType()
    schema = T.StructType(others + [T.StructField(f"{v}_rank", kind) for v in values])
    spread_ranks, names = _filler(precision), [f.name for f in others]

    def both(table: pa.Table) -> pa.Table:
        columns = [table.column(c) for c in names]
        for v in values:
            column = table.column(v).combine_chunks()
            there = column.is_valid().to_numpy(zero_copy_only=False)
            columns.append(pa.array(spread_ranks(there, column.drop_null().to_numpy(zero_copy_only=False))))
        return pa.Table.from_arrays(columns, schema.names)

    ship(df.sparkSession)
    return df.groupBy(*group).applyInArrow(both, schema)


def _filler(precision: str) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function of where a column has values, and of those: filled, ranked, spread over [-1, 1]."""
    shared_ranks, number = array_ranker(), np.float32 if precision == "float" else np.float64

    def spread_ranks(there: np.ndarray, seen: np.ndarray) -> np.ndarray:
        n = len(there)
        full = np.zeros(n)
        full[there] = seen = seen.astype(np.float64)
        if len(seen):
            full[~there] = np.median(seen)
        ranks = shared_ranks(full.astype(number).astype(np.float64))
        return (2 * (ranks - 1) / (n - 1) - 1 if n > 1 else np.zeros(n)).astype(number)

    return spread_ranks


def fill_and_rank_in_blocks(df: DataFrame, key: list[str], group: list[str], values: list[str], precision: str = "double",
                            values_per_task: int = VALUES_PER_TASK) -> DataFrame:
    """`fill_and_rank` for groups of which a task holds some columns, not all: a block of columns of a group at a time.

    Two shuffles of a row's values as one array for each block: to the blocks, and back to the row. `key` identifies a row; a repeated
    one is refused.
    """
    others = [c for c in df.columns if c not in values]
    width = max(1, values_per_task // max(1, largest_group(df, group)))
    blocks = [values[k: k + width] for k in range(0, len(values), width)]
    ids = key + [c for c in group if c not in key]
    arrays = ", ".join("array(" + ", ".join(f"CAST({quoted(v)} AS DOUBLE)" for v in block) + ")" for block in blocks)
    long = df.select(*ids, F.expr(f"posexplode(array({arrays})) AS (_block, _values)"))
    kind = T.FloatType() if precision == "float" else T.DoubleType()
    schema = T.StructType([f for f in long.schema.fields if f.name in key] + [T.StructField("_block", T.IntegerType()), T.StructField("_spread", T.ArrayType(kind))])
    spread_ranks, names = _filler(precision), [f.name for f in schema.fields[:-1]]

    def both(table: pa.Table) -> pa.Table:
        flat = table.column("_values").combine_chunks().flatten()
        there = flat.is_valid().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
        value = flat.to_numpy(zero_copy_only=False).reshape(there.shape)
        spread = np.empty(there.shape, np.float32 if precision == "float" else np.float64)
        for j in range(spread.shape[1]):
            spread[:, j] = spread_ranks(there[:, j], value[there[:, j], j])
        lists = pa.ListArray.from_arrays(np.arange(0, spread.size + 1, spread.shape[1], dtype=np.int32), pa.array(spread.ravel()))
        return pa.Table.from_arrays([*[table.column(c) for c in names], lists], schema.names)

    ship(df.sparkSession)
    made = long.groupBy(*group, "_block").applyInArrow(both, schema)
    back = _back_to_rows(df, key, others, made.select(*key, F.struct("_block", "_spread").alias("_part")))
    return back.selectExpr(*[f"_row.{quoted(c)} AS {quoted(c)}" for c in others], *[
        f"_parts[{k}][{j}] AS {quoted(v + '_rank')}" for k, block in enumerate(blocks) for j, v in enumerate(block)])


def fill_and_rank_in_ranges(df: DataFrame, key: list[str], group: list[str], values: list[str], precision: str = "double",
                            values_per_task: int = VALUES_PER_TASK) -> DataFrame:
    """`fill_and_rank` for groups of which a task does not hold a column: ranges of a column's values at a time, as arrays.

    1. The rows of a group are dealt by their key into slices of SLICE_VALUES (`_pack`). A slice keeps its rows with each value as a number among
       the slice's distinct ones, and sends those out, sorted and counted: a line of arrays for each column and range. A value that any number
       of rows share is so one entry of each slice.
    2. The lines of a range meet in a task, which ranks them above the rows of lower ranges (`_rank_lines`). Equal values lie in one range.
    3. The ranks return to their slice, are moved up by the missing values that the median fills, and looked up for its rows (`_spread_slices`).

    A sample of rows proposes where to cut; that only balances the work. `key` identifies a row; a repeated one is refused. `df` is read
    several times: pass a stored table.
    """
    others = [c for c in df.columns if c not in values]
    tasks, rows = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col("group_rows")
    sizes = materialize(group_sizes(df, group), "group-sizes")
    spare = max(1, tasks // max(1, sizes.count() * len(values)))
    sizes = sizes.select(
        *group, "group_rows", F.ceil(rows * len(values) / SLICE_VALUES).cast("int").alias("_slices"),
        (F.least(F.floor(rows / values_per_task), F.greatest(F.lit(spare), F.floor(rows / VALUES_PER_TASK))) + 1).cast("int").alias("_ranges"))
    doubles = df.selectExpr(*map(quoted, others), *[f"CAST({quoted(v)} AS DOUBLE) AS {quoted(v)}" for v in values])
    sized = join_small(doubles, sizes, group, "inner")
    ids = T.StructType([df.schema[c] for c in group])
    names = [quoted(c) for c in [*others, *values]]
    ship(df.sparkSession)

    sample = sized.filter(F.pmod(F.xxhash64(*map(quoted, key)), rows) < F.greatest(F.lit(1000), 100 * F.col("_ranges")))
    cuts = materialize(sample.groupBy(*group).applyInArrow(
        _cuts(group, values, precision), T.StructType([*ids.fields, T.StructField("_cuts", T.ArrayType(T.ArrayType(T.DoubleType())))])), "cuts")
    slices = (sizes.join(cuts, group, "left")
              .select(*group, F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)).alias("_slice"), "_cuts"))
    dealt = sized.select(F.pmod(F.hash(*map(quoted, key)), "_slices").alias("_slice"), *names)
    line = [*ids.fields, *[T.StructField(c, T.IntegerType()) for c in ("_slice", "_feature", "_range")]]
    packed = T.StructType([*line, T.StructField("_rows", T.LongType()), T.StructField("_values", T.ArrayType(T.DoubleType())),
                           T.StructField("_counts", T.ArrayType(T.LongType())), T.StructField("_whole", T.BinaryType())])
    lines = materialize(dealt.groupBy(*group, "_slice").cogroup(slices.groupBy(*group, "_slice")).applyInArrow(
        _pack(key, group, others, values, precision), packed), "slices")

    spot = [*group, "_feature", "_range"]
    counts = lines.filter("_feature >= 0").groupBy(*spot).agg(F.sum("_rows").alias("_here"))
    column = W.partitionBy(*group, "_feature")
    lower = column.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = materialize(counts.select(*spot, F.coalesce(F.sum("_here").over(lower), F.lit(0)).alias("_below"),
                                        F.sum("_here").over(column).alias("_n")), "offsets")
    placed = join_small(lines.filter("_feature >= 0").drop("_whole", "_rows"), offsets, spot, "inner")
    ranked = materialize(placed.groupBy(*spot).applyInArrow(
        _rank_lines(precision), T.StructType([*line, T.StructField("_ranks", T.ArrayType(T.DoubleType()))])), "ranks")

    marks = ranked.filter("_slice < 0").groupBy(*group).agg(F.collect_list(F.struct("_feature", "_ranks")).alias("_marks"))
    whole = lines.filter("_feature < 0").select(*group, "_slice", "_whole")
    whole = join_small(whole, materialize(sizes.select(*group, "group_rows").join(marks, group, "left"), "marks"), group, "inner",
                       cells_per_row=21 * len(values))
    kind = T.FloatType() if precision == "float" else T.DoubleType()
    schema = T.StructType([*[df.schema[c] for c in others], *[T.StructField(f"{v}_rank", kind) for v in values]])
    return whole.groupBy(*group, "_slice").cogroup(ranked.filter("_slice >= 0").groupBy(*group, "_slice")).applyInArrow(
        _spread_slices(len(values), schema.names, precision), schema)


def _cuts(group: list[str], values: list[str], precision: str) -> Callable[[pa.Table], pa.Table]:
    """For a group's sample: where each column is cut, ascending and as narrow as the ranks; a range ends with its cut."""
    number = np.float32 if precision == "float" else np.float64

    def cut(table: pa.Table) -> pa.Table:
        ranges, found = table.column("_ranges")[0].as_py(), []
        for v in values:
            seen = np.sort(table.column(v).drop_null().to_numpy().astype(number))
            at = np.arange(1, ranges) * len(seen) // ranges
            found.append(np.unique(seen[at]).astype(np.float64).tolist() if len(seen) else [])
        return table.slice(0, 1).select(group).append_column("_cuts", pa.array([found], pa.list_(pa.list_(pa.float64()))))

    return cut


def _pack(key: list[str], group: list[str], others: list[str], values: list[str], precision: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For a slice: a line for each column and range with the distinct values there and their counts, and one (column -1) with its rows as
    an Arrow stream, each value as its place among the distinct ones."""
    number = np.float32 if precision == "float" else np.float64

    def pack(table: pa.Table, cuts: pa.Table) -> pa.Table:
        if not table.num_rows:
            return nothing(cuts)
        if table.select(key).group_by(key).aggregate([]).num_rows < table.num_rows:
            raise ValueError(f"a repeated key of {key} within a group")
        given = cuts.column("_cuts")[0].as_py() or [[]] * len(values)
        whole, features, ranges, lengths, seen, counts = table.select(others), [-1], [-1], [0], [np.zeros(0)], [np.zeros(0, np.int64)]
        for j, v in enumerate(values):
            column = table.column(v).combine_chunks()
            there = column.is_valid().to_numpy(zero_copy_only=False)
            distinct, place, count = np.unique(column.drop_null().to_numpy(zero_copy_only=False), return_inverse=True, return_counts=True)
            places = np.zeros(len(there), np.int32)
            places[there] = place
            whole = whole.append_column(f"_{j}", pa.array(places, mask=~there))
            ends = np.searchsorted(distinct.astype(number), np.array(given[j], number), side="right")
            length = np.diff(np.concatenate([[0], ends, [len(distinct)]]))
            some = np.flatnonzero(length)
            features += [j] * len(some)
            ranges += some.tolist()
            lengths += length[some].tolist()
            seen.append(distinct)
            counts.append(count)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_table(whole)
        ends, counts = np.cumsum([0, *lengths]).astype(np.int32), np.concatenate(counts)
        rows, n = np.diff(np.append(0, np.cumsum(counts))[ends]), len(features)
        first = table.slice(0, 1)
        return pa.table({
            **{c: first.column(c).take(np.zeros(n, np.int64)) for c in [*group, "_slice"]},
            "_feature": pa.array(features, pa.int32()), "_range": pa.array(ranges, pa.int32()), "_rows": rows,
            "_values": pa.ListArray.from_arrays(ends, np.concatenate(seen)), "_counts": pa.ListArray.from_arrays(ends, counts),
            "_whole": pa.array([sink.getvalue().to_pybytes()] + [None] * (n - 1), pa.binary())})

    def nothing(cuts: pa.Table) -> pa.Table:
        types = {"_feature": pa.int32(), "_range": pa.int32(), "_rows": pa.int64(), "_values": pa.list_(pa.float64()),
                 "_counts": pa.list_(pa.int64()), "_whole": pa.binary()}
        return pa.table({**{c: cuts.column(c).slice(0, 0) for c in [*group, "_slice"]}, **{c: pa.array([], t) for c, t in types.items()}})

    return pack


def _rank_lines(precision: str) -> Callable[[pa.Table], pa.Table]:
    """For the lines of a range: each entry's rank among the column's values that are there, as narrow as asked, in place of its value.

    Further lines, of slice -1: for the two values in the column's middle and its largest one a number (0, 1, 2), the value, how many are
    lower, how many equal, how many there are.
    """
    number = np.float32 if precision == "float" else np.float64

    def rank(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        lists, below, n = table.column("_values").combine_chunks(), table.column("_below")[0].as_py(), table.column("_n")[0].as_py()
        value, count = lists.flatten().to_numpy(zero_copy_only=False), table.column("_counts").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        order = np.argsort(value, kind="stable")
        upto, value = below + np.cumsum(count[order]), value[order]
        narrow = value.astype(number)
        new = np.append(True, (narrow[1:] != narrow[:-1]) & ~np.isnan(narrow[:-1]))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(value)) - 1
        lower = np.append(below, upto[last[:-1]])
        equal = upto[last] - lower
        ranks, run = np.empty(len(value)), np.cumsum(new) - 1
        ranks[order] = (lower + (equal + 1) / 2.0)[run]
        marks = []
        for k, spot in enumerate(((n - 1) // 2, n // 2, n - 1)):
            if below <= spot < upto[-1]:
                at = np.searchsorted(upto, spot, side="right")
                marks.append([k, value[at], lower[run[at]], equal[run[at]], n])
        where = pa.array(np.append(np.arange(table.num_rows), np.zeros(len(marks), np.int64)))
        ends = np.cumsum([0, *lists.value_lengths().to_pylist(), *[5] * len(marks)]).astype(np.int32)
        made = table.drop_columns(["_values", "_counts", "_below", "_n"]).take(where)
        slices = np.append(table.column("_slice").to_numpy(), np.full(len(marks), -1)).astype(np.int32)
        made = made.set_column(made.schema.get_field_index("_slice"), "_slice", pa.array(slices))
        return made.append_column("_ranks", pa.ListArray.from_arrays(ends, np.concatenate([ranks, *marks])))

    return rank


def _spread_slices(columns: int, names: list[str], precision: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For a slice's rows and the ranks of its distinct values: the rows with their ranks, filled values among them, spread over [-1, 1]."""
    number = np.float32 if precision == "float" else np.float64

    def spread(slices: pa.Table, lines: pa.Table) -> pa.Table:
        rows, marks, pieces = slices.column("group_rows")[0].as_py(), {}, {}
        for mark in slices.column("_marks")[0].as_py() or []:
            marks.setdefault(mark["_feature"], {})[int(mark["_ranks"][0])] = mark["_ranks"][1:]
        lists = lines.column("_ranks").combine_chunks()
        flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
        features, ranges = lines.column("_feature").to_numpy(), lines.column("_range").to_numpy()
        for k in np.argsort(ranges, kind="stable"):
            pieces.setdefault(features[k], []).append(flat[ends[k]: ends[k + 1]])
        with pa.ipc.open_stream(slices.column("_whole")[0].as_buffer()) as stream:
            whole = stream.read_all()
        made = [whole.column(k) for k in range(whole.num_columns - columns)]
        for j in range(columns):
            lower, equal, missing = filled_at(marks.get(j), rows)
            fill = lower + (equal + missing + 1) / 2.0
            rank = np.concatenate(pieces.get(j, [np.zeros(0)]))
            rank = np.where(rank > lower + equal, rank + missing, np.where(rank > lower, fill, rank))
            places = whole.column(f"_{j}").combine_chunks()
            there = places.is_valid().to_numpy(zero_copy_only=False)
            full = np.full(len(there), fill)
            full[there] = rank[places.drop_null().to_numpy(zero_copy_only=False)]
            made.append(pa.array((2 * (full - 1) / (rows - 1) - 1 if rows > 1 else np.zeros(len(full))).astype(number)))
        return pa.Table.from_arrays(made, names)

    def filled_at(marks: dict[int, list[float]] | None, rows: int) -> tuple[float, float, float]:
        """How many values of the column are below its median, how many equal it, and how many are missing."""
        if marks is None:
            return 0.0, 0.0, rows
        (low, *_, n), (high, *_), (top, *_) = marks[0], marks[1], marks[2]
        median = number(low if low == high else 0.5 * low + 0.5 * high)
        if np.isnan(median):  # above every number
            return *(marks[2][1:3] if np.isnan(top) else (n, 0.0)), rows - n
        for value, lower, equal, _ in (marks[0], marks[1]):
            if number(value) == median:
                return lower, equal, rows - n
        return marks[1][1], 0.0, rows - n

    return spread


def _back_to_rows(df: DataFrame, key: list[str], columns: list[str], parts: DataFrame) -> DataFrame:
    """key, `_row` (a struct of `columns` of `df`) and `_parts`, a map of the pairs `_part` that `parts` has for the key; a key that repeats one is refused."""
    whole = F.struct(*[F.col(quoted(c)) for c in columns])
    rows = df.select(*key, whole.alias("_row"))
    both = (parts.withColumn("_row", F.lit(None).cast(rows.schema["_row"].dataType))
            .unionByName(rows.withColumn("_part", F.lit(None).cast(parts.schema["_part"].dataType))))
    return both.groupBy(*key).agg(F.first("_row", ignorenulls=True).alias("_row"), F.map_from_entries(F.collect_list("_part")).alias("_parts"))


def _sorted_runs(keys: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For a partition sorted by `keys` and value, a batch at a time: adds `_first`, the place of a row's run of equal values among
    the partition's rows of a key, `_ties`, the run's length in the batch, `_local`, its average rank by these two, and `_edge`: 0 inside, else
    a number for the batch's first run and one for its last, the only ones that may go on beyond it.
    """
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen, run_at, number = None, 0, 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new_key = np.zeros(n, bool)
            for k in keys:
                codes = batch.column(k).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                new_key[1:] |= codes[1:] != codes[:-1]
            value = batch.column("value").to_numpy(zero_copy_only=False)
            new_run = new_key.copy()
            new_run[1:] |= (value[1:] != value[:-1]) & ~(np.isnan(value[1:]) & np.isnan(value[:-1]))
            here = [batch.column(k)[0].as_py() for k in keys]
            new_key[0] = last is None or here != last[0]
            same_run = not new_key[0] and (value[0] == last[1] or np.isnan(value[0]) and np.isnan(last[1]))
            new_run[0] = True
            starts = np.flatnonzero(new_run)
            lengths = np.diff(np.append(starts, n))
            # rows of the key before each key's first row here: none, but for the key that goes on
            heads = np.flatnonzero(new_key)
            key_start = np.maximum.accumulate(np.where(new_key, np.arange(n), -seen if not new_key[0] else 0))
            first = starts - key_start[starts]
            if same_run:
                first[0] = run_at
            edge = np.zeros(len(starts), np.int64)
            edge[-1], edge[0] = 2 * number + 2, 2 * number + 1
            for name, per_run in (("_local", first + (lengths + 1) / 2), ("_first", first), ("_ties", lengths), ("_edge", edge)):
                batch = batch.append_column(name, pa.array(np.repeat(per_run, lengths)))
            yield batch
            seen = int(n - heads[-1]) if len(heads) else seen + n
            last = [batch.column(k)[n - 1].as_py() for k in keys], value[-1]
            run_at, number = int(first[-1]), number + 1

    return mark


def _rank_shifts(marked: DataFrame, keys: list[str]) -> DataFrame:
    """keys, `_part`, `_edge` and what the ranks there lack: rows of the key in earlier partitions, and ties on the far side of a border.

    Every partition continues one key at most, and every batch of rows has two edges.
    """
    earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    pieces = (marked.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n"))
    run = W.partitionBy(*keys, "value")
    edges = (marked.filter("_edge > 0").select(*keys, "_part", "_edge", "value", "_first", "_ties", "_local").distinct()
             .join(pieces, [*keys, "_part"])
             .withColumn("_rank", F.min(F.col("_before") + F.col("_first")).over(run) + (F.sum("_ties").over(run) + 1) / F.lit(2.0))
             .select(*keys, "_part", "_edge", (F.col("_rank") - F.col("_local")).alias("_shift")))
    inner = pieces.select(*keys, "_part", F.lit(0).cast("bigint").alias("_edge"), F.col("_before").cast("double").alias("_shift"))
    return materialize(edges.unionByName(inner).filter("_shift != 0"), "rank-shifts")


def _range_count(values: int, values_per_task: int, tasks: int) -> int:
    """One more than full ranges of `values_per_task`, but not beyond `tasks` while those are no longer than VALUES_PER_TASK: a range is read
    as a stream, so that its length costs no memory, and every further range costs a task in each of several passes."""
    return min(values // values_per_task, max(tasks, values // VALUES_PER_TASK)) + 1


def _ranks_by_range(df: DataFrame, key: list[str], group: list[str], values: list[str],
                    suffix: str, values_per_task: int) -> DataFrame:
    """All columns as one long table in the order of (group, feature, value, key), cut into ranges (see `_range_count`).

    Ranks are taken inside a range and shifted by what lies in others, ties across borders included: the key in the order lets
    any number of equal values be cut. Two shuffles: one into ranges, one that brings a row's ranks back to its other columns.
    """
    ids = key + [c for c in group if c not in key]
    keys = group + ["feature"]
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = _range_count(df.count() * len(values), values_per_task, tasks)
    order = [*keys, "value", *[c for c in key if c not in group]]
    long = (to_long(df, ids, values).filter(F.col("value").isNotNull()).withColumn("value", F.col("value") + F.lit(0.0))  # no -0.0
            .repartitionByRange(parts, *order).sortWithinPartitions(*order))
    ship(df.sparkSession)
    schema = T.StructType([*long.schema.fields, T.StructField("_local", T.DoubleType()), T.StructField("_first", T.LongType()),
                           T.StructField("_ties", T.LongType()), T.StructField("_edge", T.LongType())])
    marked = materialize(long.mapInArrow(_sorted_runs(keys), schema).withColumn("_part", F.spark_partition_id()), "ranges")
    shifted = join_small(marked, _rank_shifts(marked, keys), [*keys, "_part", "_edge"], "left")
    rank = F.struct("feature", (F.col("_local") + F.coalesce("_shift", F.lit(0.0))).alias("rank"))
    back = _back_to_rows(df, key, df.columns, shifted.select(*key, rank.alias("_part")))
    return back.selectExpr(*[f"_row.{quoted(c)} AS {quoted(c)}" for c in df.columns], *[
        f"try_element_at(_parts, {i}) AS {quoted(v + suffix)}" for i, v in enumerate(values)])


def average_ranks(df: DataFrame, key: list[str], group: list[str], values: list[str],
                  suffix: str = "_avg_rank", values_per_task: int = VALUES_PER_TASK) -> DataFrame:
    """Add the average rank (1-based) of every value column within its group; `key` identifies a row (not checked).

    A NULL has no rank and counts in nobody's.

    A few columns each get a sort after one common shuffle; many columns of a group are ranked
    together in one task; groups too large for that take the long way round. Groups of different
    sizes in one table are told apart and handled each in its own way.
    """
    small, large = part_large_groups(df, group, values_per_task // len(values))
    whole = _ranks_by_column if len(values) <= FEW_COLUMNS else _ranks_by_group
    ranked = whole(small, group, values, suffix)
    if large is None:
        return ranked
    return ranked.unionByName(_ranks_by_range(large, key, group, values, suffix, values_per_task))
