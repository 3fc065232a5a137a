"""Distance gate calibration: distributions, confusion at a threshold, sweep and histogram."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lorequarry.operators.scans import pick_by_rank


def distance_stats(distances: DataFrame) -> DataFrame:
    """``(kind, n, min, median, mean, max)`` of ``(kind, dist)``; the median is the upper one."""
    plain = distances.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.min("dist").alias("min"), F.round(F.avg("dist"), 9).alias("mean"), F.max("dist").alias("max")
    )
    return plain.join(pick_by_rank(distances, ["kind"], "dist", {"median": F.floor(F.col("_n") / 2)}), "kind")


def threshold_metrics(distances: DataFrame, thresholds: Column) -> DataFrame:
    """Confusion at each threshold of an array: kind ``positive`` should be accepted (dist <= threshold), all others not.

    A row counts once, under the first threshold that accepts it; running sums
    over the thresholds do the rest, so work does not grow with their number.
    Precision is 1 where nothing is accepted.
    """
    first = F.array_position(F.transform(thresholds, lambda t: F.col("dist") <= t), True)
    marked = distances.select(F.col("kind") == "positive", first.alias("first")).toDF("good", "first")
    step = F.when(F.col("first") > 0, F.col("first")).otherwise(F.size(thresholds) + 1)
    counted = marked.groupBy(step.alias("step")).agg(F.count_if("good").alias("p"), F.count_if(~F.col("good")).alias("q"))
    grid = distances.sparkSession.range(1).select(F.posexplode(thresholds).alias("step", "threshold")).withColumn("step", F.col("step") + 1)
    total = counted.agg(F.sum("p").alias("all_p"), F.sum("q").alias("all_q"))  # one row
    upto = W.orderBy("step").rowsBetween(W.unboundedPreceding, 0)  # one row a threshold
    summed = grid.join(counted, "step", "left").select(
        "threshold", F.coalesce(F.sum("p").over(upto), F.lit(0)).alias("tp"), F.coalesce(F.sum("q").over(upto), F.lit(0)).alias("fp")
    ).crossJoin(F.broadcast(total))
    both = F.col("tp") + F.col("fp")
    precision = F.when(both > 0, F.col("tp") / both).otherwise(1.0)
    recall = F.when(F.col("all_p") > 0, F.col("tp") / F.col("all_p")).otherwise(0.0)
    rated = summed.withColumn("precision", precision).withColumn("recall", recall)
    pr = F.col("precision") + F.col("recall")
    return rated.select(
        "threshold", "tp", (F.col("all_p") - F.col("tp")).alias("fn"), "fp", (F.col("all_q") - F.col("fp")).alias("tn"),
        F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"),
        F.round(F.when(pr > 0, 2 * F.col("precision") * F.col("recall") / pr).otherwise(0.0), 9).alias("f1"),
        F.round(F.when(F.col("all_q") > 0, F.col("fp") / F.col("all_q")).otherwise(0.0), 9).alias("fpr"),
        F.round(F.when(both > 0, F.col("fp") / both).otherwise(0.0), 9).alias("fdr"),
    )


def best_threshold(swept: DataFrame) -> DataFrame:
    """The lowest threshold among those of the best F1; one row."""
    return swept.orderBy(F.desc("f1"), "threshold").limit(1)


def histogram(distances: DataFrame, low: float = 0.4, high: float = 1.6, width: float = 0.05) -> DataFrame:
    """``(kind, bin, n)``: counts of equal bins between ``low`` and ``high``; others fall outside."""
    bin_of = F.floor(F.round((F.col("dist") - low) / width, 6))
    inside = distances.where((F.col("dist") >= low) & (F.col("dist") < high))
    return inside.groupBy("kind", bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
