"""Evaluation over the table of scored samples; experiments; history. Counts are divided once, so rates are exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rate(where: Column) -> Column:
    """Part of the rows for which ``where`` holds; null of no rows."""
    return F.try_divide(F.count_if(where), F.count(F.lit(1)))


def per_class_metrics(rows: DataFrame, labels: list[str]) -> DataFrame:
    """label, support, precision, recall, f1 for every label given; a division by zero counts 0."""
    pairs = rows.groupBy("true_class", "predicted_class").agg(F.count(F.lit(1)).alias("n"))
    names = F.explode(F.array(*[F.lit(x) for x in labels])).alias("label")
    spread = pairs.select("*", names).groupBy("label").agg(
        F.sum(F.when((F.col("true_class") == F.col("label")) & (F.col("predicted_class") == F.col("label")), F.col("n")).otherwise(0)).alias("hit"),
        F.sum(F.when(F.col("predicted_class") == F.col("label"), F.col("n")).otherwise(0)).alias("said"),
        F.sum(F.when(F.col("true_class") == F.col("label"), F.col("n")).otherwise(0)).alias("support"),
    )
    part = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    out = spread.select("label", "support", part("hit", "said").alias("precision"), part("hit", "support").alias("recall"))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return out.withColumn("f1", F.round(f1, 9))


def confusion(rows: DataFrame, labels: list[str]) -> DataFrame:
    """Rows by true class, a column for each label, zeros filled in."""
    counted = rows.groupBy("true_class").pivot("predicted_class", labels).count()
    listed = rows.sparkSession.createDataFrame([(x,) for x in labels], "true_class string")
    return listed.join(counted, "true_class", "left").na.fill(0, labels)


def ablation(rows: DataFrame, systems: dict[str, Column]) -> DataFrame:
    """system, split, acceptance, precision (null if nothing is accepted), wrong_accepted for nested acceptance rules."""
    flags = F.explode(F.array(*[F.struct(F.lit(k).alias("system"), v.alias("accepted")) for k, v in systems.items()])).alias("f")
    right = F.col("predicted_class") == F.col("true_class")
    return rows.select("split", right.alias("right"), flags).groupBy("f.system", "split").agg(
        rate(F.col("f.accepted")).alias("acceptance"),
        F.try_divide(F.count_if(F.col("f.accepted") & F.col("right")), F.count_if("f.accepted")).alias("precision"),
        F.count_if(F.col("f.accepted") & ~F.col("right")).alias("wrong_accepted"),
    )


def pick(rows: DataFrame, case: str, where: Column, *order: Column) -> DataFrame:
    """The first row of a demonstration case; none where no row fits."""
    return rows.filter(where).orderBy(*order).limit(1).withColumn("case", F.lit(case))


def group_folds(groups: DataFrame, folds: int, seed: str = "cv") -> DataFrame:
    """group_id, fold for ``groups`` (group_id, class_name, size): groups stay whole, folds are alike in classes.

    Within a class, larger groups come first (ties by a seeded hash) and are dealt to and fro, so that
    the images of the class, not only its groups, are spread evenly.
    """
    order = W.partitionBy("class_name").orderBy(F.desc("size"), F.md5(F.concat(F.lit(seed), "group_id").cast("binary")), "group_id")
    nth = F.row_number().over(order) - 1
    place = F.col("nth") % folds
    fold = F.when(F.floor(F.col("nth") / folds) % 2 == 0, place).otherwise(folds - 1 - place)
    return groups.withColumn("nth", nth).select("group_id", fold.cast("int").alias("fold"))


def adopts(accuracy: Column, loss: Column, best_accuracy: Column, best_loss: Column, latency: Column, budget: float) -> Column:
    """Within the latency budget: higher accuracy, or the same with lower log-loss."""
    return (latency <= budget) & ((accuracy > best_accuracy) | ((accuracy == best_accuracy) & (loss < best_loss)))


def ladder(rungs: DataFrame, budget: float) -> DataFrame:
    """Rungs in order, each held against the best before it. ``rungs``: rung, accuracy, loss, latency; a ladder is short."""
    item = F.array_sort(F.collect_list(F.struct("rung", "accuracy", "loss", "latency")))
    start = F.struct(F.lit(-1.0).alias("accuracy"), F.lit(float("inf")).alias("loss"), F.array().cast("array<struct<rung:bigint,adopted:boolean,best:double>>").alias("out"))

    def step(acc: Column, r: Column) -> Column:
        yes = adopts(r["accuracy"], r["loss"], acc["accuracy"], acc["loss"], r["latency"], budget)
        accuracy = F.when(yes, r["accuracy"]).otherwise(acc["accuracy"])
        return F.struct(accuracy.alias("accuracy"), F.when(yes, r["loss"]).otherwise(acc["loss"]).alias("loss"), F.array_append(acc["out"], F.struct(r["rung"].alias("rung"), yes.alias("adopted"), accuracy.alias("best"))).alias("out"))

    return rungs.agg(item.alias("items")).select(F.explode(F.aggregate("items", start, step)["out"]).alias("o")).select("o.rung", "o.adopted", F.col("o.best").alias("best_accuracy"))


def recent(history: DataFrame, limit: int = 50) -> DataFrame:
    """The latest analyses, 1 to 200 of them; ties by id."""
    if not 1 <= limit <= 200:
        raise ValueError("limit must be from 1 to 200")
    return history.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def format_bytes(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.concat(F.floor(n / 1024).cast("string"), F.lit(" KB"))).otherwise(F.concat(F.floor(n / (1024 * 1024)).cast("string"), F.lit(" MB")))


def gauge(value: Column, most: float) -> Column:
    """Place on a gauge from 0 to 1."""
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(most)) / most
