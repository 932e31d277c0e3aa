"""Run catalogue: summaries, settings, scores and leaderboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.ordered import numbered
from assay.operators.joins import fallback
from assay.operators.labels import POLICY_WIDTH

# Words in a stage's name that mark the stage to score.
SCORED_STAGES = ("finetune", "chexpert")
SUMMARY = "struct<stages: map<string,string>, best_metrics: map<string,string>, best_value: double, monitor: string>"


def pick_stage(doc: Column) -> Column:
    """JSON text of the snapshot to score: the first marked stage, else the last, else doc."""
    stages = F.from_json(doc, F.lit(SUMMARY))["stages"]
    entries = F.map_entries(stages)
    tagged = F.filter(entries, lambda e: e["key"].rlike("|".join(SCORED_STAGES)))
    chosen = F.when(F.size(tagged) > 0, F.get(tagged, F.lit(0))["value"]).otherwise(F.get(entries, F.size(entries) - 1)["value"])
    return F.when(F.size(stages) > 0, chosen).otherwise(doc)


def summary_scores(docs: DataFrame, run: str, doc: str) -> DataFrame:
    """(run, split, auroc) from summaries of either schema.

    Newer summaries key their metrics by set size: val<N>k is the primary validation set, of the
    val<N> sets the smallest is the reviewed one. Older ones are flat, and their best value is the
    reviewed score only when it differs from the flat one.
    """
    s = docs.select(run, F.from_json(pick_stage(F.col(doc)), F.lit(SUMMARY)).alias("s")).select(run, "s.*").filter("best_metrics is not null")
    new = F.map_contains_key("best_metrics", F.lit("monitored"))
    entries = s.filter(new).select(run, F.explode("best_metrics").alias("k", "v")).filter((F.col("k") != "monitored") & F.col("v").startswith("{"))
    n, thousand = F.regexp_extract("k", r"^val(\d+)(k?)$", 1), F.regexp_extract("k", r"^val(\d+)(k?)$", 2)
    entries = entries.select(
        run,
        F.when(thousand == "k", "val19k").when(n != "", "val200").otherwise(F.col("k")).alias("split"),
        F.coalesce(F.try_to_number(n, F.lit("999999999")).cast("bigint"), F.lit(0)).alias("_n"),
        F.get_json_object("v", "$.mean_auroc").cast("double").alias("auroc"),
    )
    newer = entries.groupBy(run, "split").agg(F.min_by("auroc", "_n").alias("auroc"))
    flat_value = F.try_element_at("best_metrics", F.lit("mean_auroc")).cast("double")
    old = s.filter(~new).withColumn("_f", flat_value)
    primary = old.select(run, F.lit("val19k").alias("split"), F.col("_f").alias("auroc"))
    differs = (F.col("monitor") == "val_mean_auroc") & (F.abs(F.col("best_value") - F.col("_f")) > 1e-9)
    reviewed = old.filter(differs).select(run, F.lit("val200").alias("split"), F.col("best_value").alias("auroc"))
    return newer.unionByName(primary).unionByName(reviewed)


def primary_scores(docs: DataFrame, run: str, doc: str) -> DataFrame:
    """(run, auroc, fell_back): the primary validation score; the recorded best value where a summary holds no metrics."""
    best = docs.select(run, F.from_json(pick_stage(F.col(doc)), F.lit(SUMMARY))["best_value"].alias("_best"))
    known = summary_scores(docs, run, doc).filter(F.col("split") == "val19k").select(run, "auroc")
    return best.join(known, run, "left").select(run, F.coalesce("auroc", "_best").alias("auroc"), F.col("auroc").isNull().alias("fell_back"))


def mean_board(scores: DataFrame, run: str, task: str, score: str) -> DataFrame:
    """Runs ranked by their mean over tasks. A run of one task has no such mean: it is listed without a rank."""
    per = scores.groupBy(run).agg(F.count_distinct(task).alias("n_tasks"), F.avg(score).alias("mean_score"))
    per = per.withColumn("omitted", F.col("n_tasks") < 2).withColumn("mean_score", F.when(~F.col("omitted"), F.col("mean_score")))
    return numbered(per, [], "mean_score", run).withColumn("rank", F.when(~F.col("omitted"), F.col("rank")))


def board(sources: list[tuple[str, DataFrame]], splits: list[str], primary: str, run: str = "run") -> DataFrame:
    """Runs ranked on the primary split with the other splits beside; * marks a fallback source."""
    tagged = [(tag, df.withColumn("_key", F.struct(run, "split"))) for tag, df in sources]
    best = fallback(tagged, "_key", "score").select(F.col(f"_key.{run}").alias(run), F.col("_key.split").alias("split"), "value", "fell_back")
    cells = []
    for s in splits:
        here = F.col("split") == s
        cells += [F.max(F.when(here, F.col("value"))).alias(s), F.max(F.when(here & F.col("fell_back"), F.lit("*"))).alias(f"{s}_mark")]
    wide = best.groupBy(run).agg(*cells).fillna("", [f"{s}_mark" for s in splits])
    return numbered(wide, [], primary, run)


def consistency(top: DataFrame, recorded: DataFrame, run: str = "run") -> DataFrame:
    """Does the best logged step agree with the recorded one, and its value within 1e-6?"""
    j = top.select(run, "step", "metric").join(recorded.select(run, "best_step", "best_value"), run)
    warn = (
        F.when(F.col("step") != F.col("best_step"), "step differs")
        .when(F.abs(F.col("metric") - F.col("best_value")) > 1e-6, "value differs")
        .otherwise("ok")
    )
    return j.withColumn("warning", warn)


def first_match(groups: list[tuple[str, Column]]) -> Column:
    """Name of the first predicate that holds; the last one is the catch-all."""
    out = None
    for name, test in groups:
        hit = F.coalesce(test, F.lit(False))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def merge_settings(base: DataFrame, override: DataFrame, path: str = "path", value: str = "value") -> DataFrame:
    """Merge flattened settings (dotted path, value): override wins leaf by leaf.

    An override that is NULL at a section leaves the section alone; a value put over a section
    replaces it whole, and a section put over a leaf replaces the leaf.
    """
    parts = F.split(path, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    parents = F.when(F.size(parts) > 1, above).otherwise(F.array().cast("array<string>"))
    base_parents = base.select(F.col(path), F.explode(parents).alias("_a"))
    sections = base_parents.select(F.col("_a").alias(path)).distinct().withColumn("_section", F.lit(True))
    kept = override.join(sections, path, "left").filter(F.col(value).isNotNull() | F.col("_section").isNull()).select(path, value)
    covered = base_parents.join(kept.filter(F.col(value).isNotNull()).select(F.col(path).alias("_a")), "_a").select(path)
    opened = kept.select(F.explode(parents).alias(path))
    replaced = covered.unionByName(opened).unionByName(kept.select(path)).distinct()
    return base.select(path, value).join(replaced, path, "left_anti").unionByName(kept)


def upsert_scores(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    j = old.join(new.select(key, F.col(value).alias("_new")), key, "left")
    return j.withColumn("refreshed", F.col("_new").isNotNull()).withColumn(value, F.coalesce("_new", value)).drop("_new")


def infer_layout(policies: DataFrame, run: str, policy: str, n_logits: str) -> DataFrame:
    """Head layout of a run from its per-task policies; a width mismatch is unknown."""
    width = F.when(F.col(policy) == "multiclass", POLICY_WIDTH["multiclass"]).otherwise(1)
    g = policies.groupBy(run).agg(F.sum(width).alias("width"), F.count(F.lit(1)).alias("n_tasks"), F.max(n_logits).alias("n_logits"))
    layout = F.when(F.col("width") != F.col("n_logits"), "unknown").when(F.col("n_logits") == F.col("n_tasks"), "one per task").otherwise("mixed")
    return g.withColumn("layout", layout)


def resolve_alias(name: Column, canonical: list[str]) -> Column:
    """Canonical split meant by a short name: equal number and one word a prefix of the other."""
    pattern = r"^([a-z]*)(\d*)$"
    word, number = F.regexp_extract(F.lower(name), pattern, 1), F.regexp_extract(F.lower(name), pattern, 2)
    out = F.when(name.isin(canonical), name)
    for c in canonical:
        letters = c.rstrip("0123456789")
        if not letters.isalpha():
            continue
        same = (number == c[len(letters):]) & (word != "") & (F.lit(letters).startswith(word) | word.startswith(F.lit(letters)))
        out = out.when(same, c)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown split "), name)))
