"""Scores against labelled truth, tallies, run lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(labels: DataFrame) -> DataFrame:
    """How often each true label was predicted as each other; ``labels`` has truth and predicted."""
    return labels.groupBy("truth", "predicted").agg(F.count("*").alias("n"))


def label_scores(labels: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each label. Nothing predicted is precision 1, nothing true recall 1; F1 is 0 where both are 0."""
    counts = confusion(labels)
    sides = counts.select(F.explode(F.array(F.struct(F.col("truth").alias("label"), F.col("n").alias("true"), F.lit(0).cast("long").alias("found")), F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("true"), F.col("n").alias("found")))).alias("s")).select("s.*")
    hits = counts.filter("truth = predicted").select(F.col("truth").alias("label"), F.col("n").alias("hit"))
    totals = sides.groupBy("label").agg(F.sum("true").alias("n_true"), F.sum("found").alias("n_found")).join(hits, "label", "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    precision = F.when(F.col("n_found") == 0, 1.0).otherwise(F.col("hit") / F.col("n_found"))
    recall = F.when(F.col("n_true") == 0, 1.0).otherwise(F.col("hit") / F.col("n_true"))
    scored = totals.select("label", "n_true", "n_found", "hit", precision.alias("precision"), recall.alias("recall"))
    total = F.col("precision") + F.col("recall")
    return scored.withColumn("f1", F.when(total == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / total))


def compared(truth: DataFrame, found: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Truth and found rows side by side: right, wrong, missed or extra."""
    t, f = truth.select(*keys, F.col(value).alias("expected"), F.lit(True).alias("_t")), found.select(*keys, F.col(value).alias("actual"), F.lit(True).alias("_f"))
    verdict = F.when(F.col("_f").isNull(), "missed").when(F.col("_t").isNull(), "extra").when(F.col("expected").eqNullSafe(F.col("actual")), "right").otherwise("wrong")
    return t.join(f, keys, "full_outer").withColumn("verdict", verdict).drop("_t", "_f")


def tallies(rows: DataFrame, file: str, verdict: str) -> DataFrame:
    """Counts and the share of right ones for each file, and in a last row (file null) for all."""
    right = F.sum((F.col(verdict) == "right").cast("long"))
    return rows.rollup(file).agg(F.count("*").alias("n"), right.alias("n_right")).withColumn("share", F.try_divide("n_right", "n"))


def run_lengths(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Runs of equal neighbouring values: the value, where the run starts and how long it is."""
    w = Window.partitionBy(group).orderBy(order)
    new = F.coalesce(~F.lag(value).over(w).eqNullSafe(F.col(value)), F.lit(True))
    runs = rows.withColumn("_run", F.sum(new.cast("long")).over(w))
    return runs.groupBy(group, "_run", value).agg(F.min(order).alias("start"), F.count("*").alias("n")).drop("_run")


def message_shares(rows: DataFrame, message: str) -> DataFrame:
    """How often each message occurs, and its share of all."""
    counts = rows.groupBy(message).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select(message, "n", (F.col("n") / F.col("total")).alias("share"))


def accuracies(labels: DataFrame, instance: str) -> DataFrame:
    """Share of right tokens, and of instances all of whose tokens are right; micro-averaged hits over all labels."""
    right = F.col("truth") == F.col("predicted")
    each = labels.groupBy(instance).agg(F.count("*").alias("n"), F.sum(right.cast("long")).alias("hit"))
    return each.agg(F.sum("n").alias("n_tokens"), F.sum("hit").alias("n_right"), F.count("*").alias("n_instances"), F.sum((F.col("n") == F.col("hit")).cast("long")).alias("n_whole")).withColumns({"token_accuracy": F.try_divide("n_right", "n_tokens"), "instance_accuracy": F.try_divide("n_whole", "n_instances")})


def differing(labels: DataFrame, instance: str) -> DataFrame:
    """All rows of the instances in which some prediction is wrong."""
    wrong = F.max((F.col("truth") != F.col("predicted")).cast("int")).over(Window.partitionBy(instance))
    return labels.withColumn("_wrong", wrong).filter("_wrong = 1").drop("_wrong")
