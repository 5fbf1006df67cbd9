"""Evaluation of the contact classifier on (label, pred, logit, mask) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideloom.functions.angles import bce_with_logits
from strideloom.sources.scratch import scratched


def class_balance(df: DataFrame) -> DataFrame:
    """One row: negatives, positives and pos_weight of the masked steps."""
    real = df.filter("mask").agg(F.count_if(F.col("label") == 0).alias("negatives"), F.count_if(F.col("label") == 1).alias("positives"))
    return real.withColumn("pos_weight", F.when(F.col("positives") > 0, F.col("negatives") / F.col("positives")))


def masked_bce(df: DataFrame, by: list[str], pos_weight: DataFrame | None = None) -> DataFrame:
    """by and ``loss``: the mean of the weighted loss over masked steps; padding targets count as 0 before they are masked out.

    The loss is linear in the weight, so that the sums of both parts, and the classes' counts if no ``pos_weight`` (one row) is
    given, come from one pass over df; a row for each group is then written, as both the loss and the weight need it.
    """
    y = F.when(F.col("mask"), F.col("label").cast("double")).otherwise(0.0)
    part = lambda w: F.sum(F.when(F.col("mask"), bce_with_logits(F.col("logit"), y, F.lit(w))))
    count = lambda k: F.count_if(F.col("mask") & (F.col("label") == k))
    sums = df.groupBy(*by).agg(part(0.0).alias("_rest"), (part(1.0) - part(0.0)).alias("_each"), F.count_if("mask").alias("_n"), count(0).alias("_neg"), count(1).alias("_pos"))
    if pos_weight is None:
        sums = scratched(sums, "sums")
        neg, pos = F.sum("_neg"), F.sum("_pos")
        pos_weight = sums.agg(F.when(pos > 0, neg / pos).alias("pos_weight"))
    t = sums.crossJoin(F.broadcast(pos_weight.select("pos_weight")))  # one row
    return t.select(*by, ((F.col("_rest") + F.col("pos_weight") * F.col("_each")) / F.col("_n")).alias("loss"))


def classification_report(df: DataFrame) -> DataFrame:
    """(class, precision, recall, f1, support) for each class of the masked steps, with accuracy, macro avg and weighted avg; 0 for an empty denominator.

    One pass over df counts each class's part; the classes, few rows, then meet in one row from which the averages come.
    """
    n = F.col("n")
    pairs = df.filter("mask").groupBy(F.col("label").cast("int").alias("label"), F.col("pred").cast("int").alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    part = lambda name, tp, named, support: F.struct(F.col(name).alias("class"), tp.alias("tp"), named.alias("named"), support.alias("support"))
    none = F.lit(0).cast("long")
    parts = F.array(part("label", F.when(F.col("label") == F.col("pred"), n).otherwise(none), none, n), part("pred", none, n, none))
    per = pairs.select(F.explode(parts).alias("p")).select("p.*").groupBy("class").agg(*(F.sum(c).alias(c) for c in ("tp", "named", "support")))
    over = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    per = per.withColumns({"precision": over(F.col("tp"), F.col("named")), "recall": over(F.col("tp"), F.col("support"))})
    per = per.withColumn("f1", over(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    cols = ("precision", "recall", "f1")
    total = F.sum("support")
    one = per.agg(
        F.collect_list(F.struct(F.col("class").cast("string").alias("class"), *cols, "support")).alias("each"), total.alias("support"), over(F.sum("tp"), total).alias("right"),
        *(F.avg(c).alias(f"macro_{c}") for c in cols), *(over(F.sum(F.col(c) * F.col("support")), total).alias(f"weighted_{c}") for c in cols))
    line = lambda name, values: F.struct(F.lit(name).alias("class"), *(F.col(v).alias(c) for v, c in zip(values, cols)), F.col("support"))
    lines = F.array(line("accuracy", ["right"] * 3), line("macro avg", [f"macro_{c}" for c in cols]), line("weighted avg", [f"weighted_{c}" for c in cols]))
    return one.select(F.explode(F.concat("each", lines)).alias("r")).select("r.*")
