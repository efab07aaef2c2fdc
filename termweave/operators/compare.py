"""Statistics that compare scored samples."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termweave.session import durable


def sample_statistics(scored: DataFrame, sample: str, metrics: Sequence[str]) -> DataFrame:
    """Mean and sample standard deviation of each metric per sample."""
    columns = []
    for metric in metrics:
        columns += [F.avg(metric).alias(f"mean_{metric}"), F.stddev_samp(metric).alias(f"std_{metric}")]
    return scored.groupBy(sample).agg(F.count(F.lit(1)).alias("n_docs"), *columns)


def metric_histogram(scored: DataFrame, sample: str, metric: str, low: float, high: float, bins: int) -> DataFrame:
    """Documents per bin; bin 0 lies below `low`, bin `bins + 1` from `high` on."""
    binned = F.width_bucket(F.col(metric).cast("double"), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")
    return scored.groupBy(sample, binned).agg(F.count(F.lit(1)).alias("n_docs"))


#: Values are counted in so many ranges per group and wanted place, in each pass.
RANGES = 2048
#: Ranges with at most so many rows are not cut further, but ranked.
RANKED_ROWS = 10_000


def _range_of(value: Column, low: Column, high: Column) -> Column:
    """Which of RANGES equal parts of low..high a value lies in."""
    share = (value / 2 - low / 2) / (high / 2 - low / 2)  # halves, as the whole width may overflow
    return F.when(high > low, F.least(F.floor(share * RANGES), F.lit(RANGES - 1))).otherwise(F.lit(0)).cast("int")


def order_statistics(df: DataFrame, group: str, value: str, places: DataFrame) -> DataFrame:
    """`(group, place, value)`: for each row of `places(group, place long)` the value at that place (from 0) of its group's sorted values.

    Selection by counting: the range in which a place lies is cut into equal parts, whose
    counts are combined on the map side, until its rows are few or all equal. No task
    sees all values of a group, and no list of values is built. Null values have no place;
    NaN and infinite values are not taken.
    """
    v = F.col(value).cast("double")
    rows = df.select(F.col(group).alias("g"), v.alias("v")).where(v.isNotNull() & (F.abs(v) < float("inf")))
    spans = rows.groupBy("g").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("n"))
    wanted = places.select(F.col(group).alias("pg"), "place").distinct()
    # A place is looked for by its number of rows before the range, the range, and the rows in it.
    open_places = durable(wanted.join(spans, F.col("pg").eqNullSafe(F.col("g"))).where("place < n").select("g", "place", F.col("place").alias("left"), "low", "high", "n"))
    done = []
    while True:
        narrow = (F.col("n") <= RANKED_ROWS) | (F.col("low") == F.col("high"))
        done.append(open_places.where(narrow))
        rest = open_places.where(~narrow)
        if rest.isEmpty():
            break
        ask = rest.select(F.col("g").alias("ag"), "place", "left", "low", "high")
        met = rows.join(F.broadcast(ask.select("ag", "low", "high").distinct()), F.col("g").eqNullSafe(F.col("ag")) & F.col("v").between(F.col("low"), F.col("high")))
        counts = met.groupBy("ag", "low", "high", _range_of(F.col("v"), F.col("low"), F.col("high")).alias("part")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        before = F.sum("c").over(W.partitionBy("ag", "low", "high").orderBy("part")) - F.col("c")
        parts = counts.withColumn("before", before).select(F.col("ag").alias("cg"), F.col("low").alias("cl"), F.col("high").alias("ch"), "c", "lo", "hi", "before")
        inside = (F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("c"))
        found = ask.join(parts, F.col("ag").eqNullSafe(F.col("cg")) & (F.col("low") == F.col("cl")) & (F.col("high") == F.col("ch")) & inside)
        open_places = durable(found.select(F.col("ag").alias("g"), "place", (F.col("left") - F.col("before")).alias("left"), F.col("lo").alias("low"), F.col("hi").alias("high"), F.col("c").alias("n")))
    ends = reduce(DataFrame.unionByName, done)
    equal = ends.where("low = high").select("g", "place", F.col("low").alias("v"))
    few = ends.where("low < high")
    spans = few.select(F.col("g").alias("ag"), "low", "high").distinct()
    near = rows.join(F.broadcast(spans), F.col("g").eqNullSafe(F.col("ag")) & F.col("v").between(F.col("low"), F.col("high")))
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("ag", "low", "high").orderBy("v")) - 1).select(F.col("ag").alias("cg"), F.col("low").alias("cl"), F.col("high").alias("ch"), "rank", "v")
    picked = few.join(ranked, F.col("g").eqNullSafe(F.col("cg")) & (F.col("low") == F.col("cl")) & (F.col("high") == F.col("ch")) & (F.col("left") == F.col("rank")))
    return equal.unionByName(picked.select("g", "place", "v")).select(F.col("g").alias(group), "place", F.col("v").alias(value))


def five_numbers(scored: DataFrame, sample: str, metric: str) -> DataFrame:
    """Minimum, quartiles (interpolated between neighbours) and maximum per sample, by distributed selection. The number of samples is bounded."""
    metric_value = F.col(metric).cast("double")
    sound = scored.where(metric_value.isNotNull() & (F.abs(metric_value) < float("inf")))
    sizes = durable(sound.groupBy(sample).agg(F.count(F.lit(1)).alias("n")))
    quarters = F.explode(F.array(*[F.struct(F.lit(i).alias("q"), ((F.col("n") - 1) * i / 4.0).alias("at")) for i in range(5)]))
    asked = sizes.select(sample, quarters.alias("a")).select(sample, "a.q", "a.at")
    ends = asked.select(sample, "q", "at", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("place"))
    found = order_statistics(sound, sample, metric, ends.select(sample, "place")).select(F.col(sample).alias("fs"), F.col("place").alias("fp"), F.col(metric).alias("v"))
    both = ends.join(found, F.col(sample).eqNullSafe(F.col("fs")) & (F.col("place") == F.col("fp")))
    share_of = F.when(F.col("place") == F.col("at"), 1.0).otherwise(1 - F.abs(F.col("place") - F.col("at")))
    numbers = both.groupBy(sample, "q").agg(F.sum(F.col("v") * share_of).alias("v"))
    names = ("minimum", "quartile1", "median", "quartile3", "maximum")
    return numbers.groupBy(sample).agg(*[F.max(F.when(F.col("q") == i, F.col("v"))).alias(n) for i, n in enumerate(names)])


def share(condition: Column) -> Column:
    """Share of rows for which `condition` holds."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def class_report(predictions: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall, f1 and support per class, from one label-by-prediction count."""
    confusion = predictions.groupBy(F.col(label).alias("l"), F.col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    both = confusion.select(
        F.explode(
            F.array(
                F.struct(F.col("l").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0).alias("right")),
                F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("right")),
            )
        ).alias("c")
    ).select("c.*")
    totals = both.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "right")])
    precision = F.when(F.col("predicted") > 0, F.col("right") / F.col("predicted")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("right") / F.col("support")).otherwise(0.0)
    scored = totals.select("class", "support", precision.alias("precision"), recall.alias("recall"))
    total = F.col("precision") + F.col("recall")
    return scored.withColumn("f1", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights: rows / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.struct(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes"))).scalar()
    return counts.withColumn("_t", totals).select(
        label, "n", (F.col("_t.rows") / (F.col("_t.classes") * F.col("n"))).alias("weight")
    )
