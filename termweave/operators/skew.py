"""Joins, groupings, ranks and samples that stay balanced when one key owns much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termweave.session import durable


def _names(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def hot_keys(df: DataFrame, on: str | Sequence[str], rows_per_split: int, max_hot: int) -> DataFrame:
    """Keys with more than `rows_per_split` rows and into how many pieces each is cut.

    At most `max_hot` rows, so the result may be broadcast whatever the size of
    `df`. A key that is hot but not among them holds under 1/max_hot of the rows
    and is handled by an ordinary shuffle: `max_hot` bounds the broadcast, no row is lost by it.
    """
    on = _names(on)
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    hot = counts.where(F.col("_rows") > rows_per_split).orderBy(F.desc("_rows"), *on).limit(max_hot)
    return hot.select(*on, F.ceil(F.col("_rows") / rows_per_split).cast("int").alias("_pieces"))


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    how: str = "inner",
    rows_per_split: int = 1_000_000,
    max_hot: int = 10_000,
) -> DataFrame:
    """Equi-join in which the hot keys of `left` are cut into pieces.

    Only rows of hot keys are repeated on the right, once per piece, so the
    extra volume is (rows of left / rows_per_split) rows, and every task sees
    about `rows_per_split` rows of one key at most. The piece is a hash of the
    whole left row: deterministic, hence safe when a lost task is run again.
    """
    on = _names(on)
    hot = F.broadcast(hot_keys(left, on, rows_per_split, max_hot))
    piece = F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.col("_pieces")).cast("int")
    salted_left = left.join(hot, on, "left").withColumn("_piece", F.coalesce(piece, F.lit(0))).drop("_pieces")
    pieces = F.sequence(F.lit(0), F.coalesce(F.col("_pieces"), F.lit(1)) - 1)
    salted_right = right.join(hot, on, "left").withColumn("_piece", F.explode(pieces)).drop("_pieces")
    return salted_left.join(salted_right, [*on, "_piece"], how).drop("_piece")


def with_group_count(df: DataFrame, key: str, name: str = "frequency", **split: int) -> DataFrame:
    """The size of its group on every row.

    A count window would sort a hot group in one task; a partially aggregated
    count joined back does not.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    return salted_join(df, counts, key, **split)


def keyed_values(df: DataFrame, key: str | Sequence[str], **values: Column) -> DataFrame:
    """The groups of `df` in long form: one row per member, with its key and the named values.

    A list per group would hold an unbounded number of rows in one task; rows need no
    shuffle, and counts or joins over them combine on the map side.
    """
    return df.select(*_names(key), *[value.alias(name) for name, value in values.items()])


def keep_first(df: DataFrame, key: str | Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """One row per key, the first in the declared order.

    A minimum over the row is combined on the map side, unlike a rank window
    that sorts every copy of a hot key in one task.
    """
    key = _names(key)
    rest = [c for c in df.columns if c not in key and c not in order_by]
    ordered = [c for c in order_by if c not in key]
    first = df.groupBy(*key).agg(F.min(F.struct(*ordered, *rest)).alias("_first"))
    return first.select(*[F.col(c) if c in key else F.col(f"_first.{c}").alias(c) for c in df.columns])


def dense_id(df: DataFrame, order_by: Sequence[Column | str], name: str, start: int = 0) -> DataFrame:
    """Gap-free ids in the declared order without pulling all rows into one task.

    Rows are range partitioned and sorted; only one count per partition is
    accumulated centrally. The sorted rows are made durable first because range
    bounds are sampled and must be the same for both reads.
    """
    columns = df.columns
    ranged = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    placed = durable(
        ranged.withColumn("_at", F.monotonically_increasing_id()).select(
            *columns,
            F.shiftright("_at", 33).alias("_slice"),
            F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_offset"),
        )
    )
    sizes = placed.groupBy("_slice").agg(F.count(F.lit(1)).alias("_size"))
    before = W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("_slice", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    # One row per partition of `placed`: bounded by the number of tasks.
    numbered = placed.join(F.broadcast(starts), "_slice")
    return numbered.select(*columns, (F.col("_before") + F.col("_offset") + start).alias(name))


def smallest_n(
    df: DataFrame, order: Column, tie_break: str, n: int | Column, by: Sequence[str] = (), buckets: int = 4096
) -> DataFrame:
    """Exactly the `n` smallest rows by an md5-like hex `order`, overall or per group of `by`.

    The leading hex digits form buckets whose sizes are counted with partial
    aggregation; whole buckets below the cut are kept, and only the one bucket at
    the cut is ranked. No task sorts a whole group, whatever its size. `n` may be
    a column of `by` (one quota per group).
    """
    by = list(by)
    quota = F.lit(n) if isinstance(n, int) else n
    width = max(1, (buckets - 1).bit_length() // 4)
    keyed = df.withColumn("_order", order).withColumn("_bucket", F.substring("_order", 1, width))
    sizes = keyed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    running = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    cut = (
        sizes.withColumn("_upto", F.sum("_size").over(running))
        .withColumn("_room", quota - (F.col("_upto") - F.col("_size")))
        .where(F.col("_room") > 0)
        .select(*by, "_bucket", "_room", (F.col("_room") >= F.col("_size")).alias("_whole"))
    )
    candidates = keyed.join(cut, [*by, "_bucket"])
    whole = candidates.where("_whole")
    edge = candidates.where(~F.col("_whole")).withColumn(
        "_rank", F.row_number().over(W.partitionBy(*by, "_bucket").orderBy("_order", tie_break))
    )
    kept = edge.where(F.col("_rank") <= F.col("_room"))
    return whole.select(*df.columns).unionByName(kept.select(*df.columns))
