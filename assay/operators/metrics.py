"""Scoring of binary predictions, grouped by any keys, from one shared score table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.ordered import numbered, running, settled

EPS_F1 = 1e-12
MACRO = ["auroc", "auprc", "f1", "precision", "recall", "specificity"]


def score_counts(df: DataFrame, keys: list[str], score: str = "prob", y: str = "y", weight: str | None = None) -> DataFrame:
    """pos and neg per (group, distinct score), from one pass over the rows.

    Counting combines map-side, so a score shared by a third of all rows is one row per task before
    the shuffle. For large inputs the counts are written once; what follows reads them, not df.
    """
    w = F.col(weight) if weight else F.lit(1)
    # Undefined scores add nothing and their group is dropped after counting. A filter before it
    # would be merged with the score's own expression and evaluate that several times per row.
    defined = F.col(score).isNotNull() & ~F.isnan(score)
    counts = df.groupBy(*keys, score).agg(
        F.sum(F.when(defined, w * F.col(y)).cast("double")).alias("pos"), F.sum(F.when(defined, w * (1 - F.col(y))).cast("double")).alias("neg")
    ).filter(F.col("pos") + F.col("neg") > 0)
    return settled(counts, "scores")


def score_table(counts: DataFrame, keys: list[str], score: str, **kw) -> DataFrame:
    """Score counts with tp and fp at ``score >= it``, running sums over ranges of scores."""
    falling = counts.withColumn("_falling", -F.col(score))
    return (
        running(falling, keys, "_falling", {"_pos_above": ("sum", "pos"), "_neg_above": ("sum", "neg")}, stored=True, **kw)
        .withColumn("tp", F.col("_pos_above") + F.col("pos"))
        .withColumn("fp", F.col("_neg_above") + F.col("neg"))
        .drop("_falling", "_pos_above", "_neg_above")
    )


def ranking_from_table(table: DataFrame, keys: list[str]) -> DataFrame:
    p, n = F.sum("pos"), F.sum("neg")
    worse = F.sum(F.col("pos") * (F.col("fp") - F.col("neg") / 2))
    gained = F.sum(F.when(F.col("pos") > 0, F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))))
    return table.groupBy(*keys).agg(
        F.when((p > 0) & (n > 0), 1 - worse / (p * n)).alias("auroc"),
        F.when(p > 0, gained / p).alias("auprc"),
        p.cast("bigint").alias("n_pos"),
        n.cast("bigint").alias("n_neg"),
    )


def ranking_metrics(df: DataFrame, keys: list[str], score: str = "prob", y: str = "y", weight: str | None = None, **kw) -> DataFrame:
    """AUROC (ties count half, NULL for one class) and average precision (NULL without positives)."""
    return ranking_from_table(score_table(score_counts(df, keys, score, y, weight), keys, score, **kw), keys)


def curve(df: DataFrame, keys: list[str], score: str = "prob", y: str = "y", **kw) -> DataFrame:
    """Precision, recall, false-positive rate and F1 at every distinct score."""
    counts = score_counts(df, keys, score, y)
    table = score_table(counts, keys, score, **kw)
    p, n = F.sum("pos").alias("p_total"), F.sum("neg").alias("n_total")
    if keys:
        t = table.join(settled(counts.groupBy(*keys).agg(p, n), "totals"), keys)
    else:
        t = table.select("*", counts.agg(p).scalar().alias("p_total"), counts.agg(n).scalar().alias("n_total"))
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    recall = F.try_divide("tp", "p_total")
    return (
        t.withColumn("threshold", F.col(score))
        .withColumn("precision", precision)
        .withColumn("recall", recall)
        .withColumn("fpr", F.try_divide("fp", "n_total"))
        .withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + EPS_F1))
    )


def best_f1(df: DataFrame, keys: list[str], score: str = "prob", y: str = "y", default: float = 0.5, **kw) -> DataFrame:
    """Threshold with the highest F1, the lowest one on ties; ``default`` when one class is missing."""
    c = curve(df, keys, score, y, **kw)
    both = (F.max("p_total") > 0) & (F.max("n_total") > 0)
    best = F.max(F.struct(F.col("f1"), (-F.col("threshold")).alias("t")))
    return c.groupBy(*keys).agg(
        F.when(both, -best["t"]).otherwise(F.lit(default)).alias("threshold"),
        F.when(both, best["f1"]).alias("best_f1"),
    )


def with_threshold(df: DataFrame, threshold, on: list[str], default: float | None = None) -> DataFrame:
    """Attach a cut: a number for all rows, or a table joined on ``on``."""
    if isinstance(threshold, DataFrame):
        out = df.join(settled(threshold.select(*on, "threshold"), "cuts"), on, "left")
        return out if default is None else out.withColumn("threshold", F.coalesce("threshold", F.lit(default)))
    return df.withColumn("threshold", F.lit(float(threshold)))


def confusion(df: DataFrame, keys: list[str], score: str = "prob", y: str = "y", excluded: str | None = None) -> DataFrame:
    """tp, fp, tn, fn at ``score >= threshold`` and the number of excluded cells; a NULL score is below any cut."""
    keep = ~F.col(excluded) if excluded else F.lit(True)
    hit, pos = F.coalesce(F.col(score) >= F.col("threshold"), F.lit(False)), F.col(y) == 1

    def count(cond):
        return F.count_if(keep & cond)

    return df.groupBy(*keys).agg(
        count(hit & pos).alias("tp"),
        count(hit & ~pos).alias("fp"),
        count(~hit & ~pos).alias("tn"),
        count(~hit & pos).alias("fn"),
        F.count_if(~keep).alias("n_excluded"),
        F.max("threshold").alias("threshold"),
    )


def safe_ratio(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num, den), F.lit(0.0))


def point_metrics(counts: DataFrame) -> DataFrame:
    """Precision, recall, specificity, F1; 0.0 where the denominator is 0."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    return (
        counts.withColumn("precision", safe_ratio(tp, tp + fp))
        .withColumn("recall", safe_ratio(tp, tp + fn))
        .withColumn("specificity", safe_ratio(tn, tn + fp))
        .withColumn("f1", safe_ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    )


def report(df: DataFrame, keys: list[str], score: str = "prob", y: str = "y", excluded: str | None = None, **kw) -> DataFrame:
    """All per-group metrics. ``df`` carries a ``threshold`` column; excluded cells are not scored."""
    kept = df.filter(~F.col(excluded)) if excluded else df
    ranks = ranking_metrics(kept, keys, score, y, **kw)
    points = point_metrics(confusion(df, keys, score, y, excluded))
    return points.join(ranks, keys, "left").select(
        *keys, "auroc", "auprc", "f1", "precision", "recall", "specificity",
        F.coalesce("n_pos", F.lit(0)).alias("n_pos"), "n_excluded", "threshold",
    )


def macro(per_task: DataFrame, keys: list[str], metrics: list[str] = MACRO) -> DataFrame:
    """Means over tasks; undefined AUROC / AUPRC are NULL and so skipped."""
    return per_task.groupBy(*keys).agg(*[F.avg(m).alias(f"mean_{m}") for m in metrics])


def calibrate(df: DataFrame, keys: list[str], score: str = "prob", y: str = "y") -> DataFrame:
    """Max-F1 cut per group and the metrics reached at it on the same rows."""
    cuts = best_f1(df, keys, score, y)
    return report(with_threshold(df, cuts, keys), keys, score, y)


def log_loss(y: Column, p: Column, pos_weight: float = 1.0, smoothing: float = 0.0, clip: float = 1e-7) -> Column:
    """Mean binary cross-entropy over non-missing targets; 0 when none is left."""
    p = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    t = y * (1 - smoothing) + 0.5 * smoothing
    return F.coalesce(F.avg(-(pos_weight * t * F.ln(p) + (1 - t) * F.ln(1 - p))), F.lit(0.0))


def cross_entropy(label: Column, logits: list[Column]) -> Column:
    """-log softmax(logits)[label], stable for large logits."""
    top = F.greatest(*logits)
    total = sum((F.exp(z - top) for z in logits[1:]), F.exp(logits[0] - top))
    chosen = F.get(F.array(*logits), label.cast("int"))
    return -(chosen - top - F.ln(total))


def size_label(n: Column) -> Column:
    """val{n/1000, rounded half to even}k from 1000 on, val{n} below."""
    thousands = F.bround(n.cast("double") / 1000).cast("bigint").cast("string")
    return F.when(n >= 1000, F.concat(F.lit("val"), thousands, F.lit("k"))).otherwise(F.concat(F.lit("val"), n.cast("string")))


def compare_scorings(a: DataFrame, b: DataFrame, run: str, score: str) -> DataFrame:
    """Same runs under two scorings (one row per run): delta, both ranks, who stands at each place."""
    j = a.select(run, F.col(score).alias("score_a")).join(b.select(run, F.col(score).alias("score_b")), run)
    out = settled(j.withColumn("delta", F.col("score_b") - F.col("score_a")), "pairs")
    for side in ("a", "b"):
        out = numbered(out, [], f"score_{side}", run, f"rank_{side}")
    return out
