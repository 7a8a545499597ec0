"""Grouped operators that stay distributed when one key holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from repoquarry.plans.storage import settle

SALTS = 64
CHUNK = 4096


def top_k_per_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    spread: Sequence[str],
    rank: str = "rank",
    salts: int = SALTS,
) -> DataFrame:
    """First `k` rows of every group, with their 1-based `rank`.

    Two window passes.  The first ranks within (keys, salt), where the salt is
    a hash of the `spread` columns, so a hot group is split over `salts` tasks
    and Spark's window group limit already cuts it before that shuffle.  The
    second sees at most `k * salts` rows per group.
    """
    salt = "__salt"
    salted = df.withColumn(salt, F.pmod(F.xxhash64(*spread), F.lit(salts)))
    inner = Window.partitionBy(*keys, salt).orderBy(*order)
    outer = Window.partitionBy(*keys).orderBy(*order)
    kept = salted.withColumn(rank, F.row_number().over(inner)).where(F.col(rank) <= k)
    return kept.drop(salt, rank).withColumn(rank, F.row_number().over(outer)).where(F.col(rank) <= k)


def first_seen(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per key: the earliest by `order`.  A partial aggregation, not a window."""
    first = F.min(F.struct(*order, *keep)).alias("__first")
    grouped = df.groupBy(*keys).agg(first)
    return grouped.select(*keys, *[F.col(f"__first.{name}").alias(name) for name in (*order, *keep)])


def _joined(order: Column, text: str, separator: str) -> Column:
    pairs = F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col(text).alias("t"))))
    return F.array_join(F.transform(pairs, lambda pair: pair["t"]), separator)


def ordered_concat(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    text: str,
    separator: str = "",
    sections: Sequence[str] = (),
    chunk: int = CHUNK,
    sliced: bool = False,
    leading: str | None = None,
) -> DataFrame:
    """Concatenate `text` per key in (sections, position) order.

    `position` is unique within (keys, sections), so a first pass over slices
    of `chunk` positions never gathers more than `chunk` rows; the second pass
    joins the slices into the one output value the caller asked for.  Where a position is a struct,
    `leading` names its first field, an integer, which is what is cut into slices.
    """
    pieces = concat_slices(df, keys, position, text, separator, sections, chunk, sliced, leading)
    order = F.struct(*sections, "slice")
    return pieces.groupBy(*keys).agg(_joined(order, text, separator).alias(text))


def slice_of(position: str, chunk: int = CHUNK) -> Column:
    """Number of the slice of `chunk` positions a row belongs to."""
    return F.floor(F.col(position) / F.lit(chunk)).cast("long")


def concat_slices(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    text: str,
    separator: str = "",
    sections: Sequence[str] = (),
    chunk: int = CHUNK,
    sliced: bool = False,
    leading: str | None = None,
) -> DataFrame:
    """The slices of `ordered_concat`, for values too long to be one row: (keys, sections, slice, text).

    `sliced` says that the table has its `slice` column already; one that is
    partitioned by it is not shuffled again.
    """
    pieces = df if sliced else df.withColumn("slice", slice_of(leading or position, chunk))
    return pieces.groupBy(*keys, *sections, "slice").agg(_joined(F.col(position), text, separator).alias(text))


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    out: str,
    chunk: int = CHUNK * 16,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Exact 1-based row number per key in `position` order, without one task per key.

    Rows are counted per slice of `chunk` positions (a partial aggregation), a
    window over those few counts gives each slice its offset, and rows are
    numbered inside their slice only.  `position` is an integer, unique per key.
    `counted` is a cheaper table with the same keys and positions, if there is one.
    """
    slice_col, offset = "__slice", "__offset"
    sliced = df.withColumn(slice_col, slice_of(position, chunk))
    source = df if counted is None else counted
    counts = source.groupBy(*keys, slice_of(position, chunk).alias(slice_col)).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, slice_col, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(offset))
    inside = Window.partitionBy(*keys, slice_col).orderBy(position)
    # the size of a derived table is guessed: without the hint its rows may be taken for the smaller side and be broadcast
    joined = sliced.join(offsets.hint("shuffle_hash"), [*keys, slice_col])
    return joined.withColumn(out, F.row_number().over(inside) + F.col(offset)).drop(slice_col, offset)


def number_sorted(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Exact 0-based row number per key in the order of columns of any type, without one task per key.

    Rows are sorted by range partitioning, so a key may fill many tasks; a row's number follows from its place in its part and
    the counts of (key, part).  The sorted rows are written to shared storage once, as both must see the same parts.
    """
    by = [*keys, *order]
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    placed = settle(placed.withColumn("__part", F.shiftright("__at", 33)), "sorted")
    counts = placed.groupBy(*keys, "__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(*keys, "__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"))
    joined = placed.join(shifts, [*keys, "__part"])
    return joined.withColumn(out, F.col("__at") + F.col("__shift")).drop("__at", "__part", "__shift")


def even_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join two tables of about one row per key, both of which grow with the input, in parts that stay small.

    Spark judges a table by the size of its files and would broadcast the keys of millions of rows; or it would
    merge the parts of a shuffle until there are as many as cores, and sort each of them at once.  Parts whose
    number is given are not merged, on neither side of a join.
    """
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the left side follows; a number given there too would be a second shuffle, as Spark moves a semi join below it
    return left.join(right.repartition(parts, *keys).hint("merge"), list(keys), how)


def spread_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    spread: str,
    how: str = "inner",
    salts: int = 16,
    even: bool = False,
) -> DataFrame:
    """Join a table that may be hot on `keys` to one with few rows per key.

    The small side is repeated once per salt and the big side picks its salt
    from `spread`, a column that differs between its rows, so a hot key is
    joined in `salts` tasks instead of one.  Neither side is broadcast: the small one has few rows per key,
    not few rows, and Spark judges its size before it is repeated.  With `even`, for small sides that grow with
    the input, the parts of the join are not merged, as in `even_join`.
    """
    salt = "__salt"
    salted = big.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(salts)))
    every = F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))
    repeated = small.withColumn(salt, F.explode(every))
    if even:
        return even_join(salted, repeated, [*keys, salt], how).drop(salt)
    repeated = repeated.hint("merge")
    return salted.join(repeated, [*keys, salt], how).drop(salt)
