"""Joins and set operations of the evaluation work flow."""

from __future__ import annotations

from functools import reduce
from itertools import combinations, groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.functions.ordered import row_index, running, two_sided
from assay.operators.labels import keep_first

#: Runs that one Python call of assign_distinct takes: a call costs milliseconds, a run has a few rows.
RUNS_PER_CALL = 256


def left_first(left: DataFrame, right: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Left join that meets only the first right row of each key."""
    return left.join(keep_first(right, keys, ordinal), keys, "left")


def flag_members(df: DataFrame, ids: DataFrame, key: str, name: str) -> DataFrame:
    marked = ids.select(key).distinct().withColumn(name, F.lit(True))
    return df.join(marked, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def manifest_status(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """present / missing / orphan for every name of either list."""
    e = expected.select(key).distinct().withColumn("_e", F.lit(1))
    a = actual.select(key).distinct().withColumn("_a", F.lit(1))
    status = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "orphan").otherwise("present")
    return e.join(a, key, "full").select(key, status.alias("status"))


def work_list(local: DataFrame, remote: DataFrame, key: str) -> DataFrame:
    return local.join(remote.select(key), key, "left_anti")


def collision_union(parts: list[tuple[str, DataFrame]], name: str) -> DataFrame:
    """Union of sources in order; of several rows with one name the first source's is kept.

    Returns (source, name, copies, kept): copies counts the rows of that name in that source.
    """
    tagged = [df.withColumn("_p", F.lit(i)).withColumn("source", F.lit(tag)) for i, (tag, df) in enumerate(parts)]
    per = reduce(DataFrame.unionByName, tagged).groupBy(name, "source", "_p").agg(F.count(F.lit(1)).alias("copies"))
    # At most one row per source and name is left, so the per-name minimum is a small merge.
    first = per.groupBy(name).agg(F.min("_p").alias("_first"))
    return per.join(first, name).select("source", name, "copies", (F.col("_p") == F.col("_first")).cast("int").alias("kept"))


def collision_audit(parts: list[tuple[str, DataFrame]], name: str) -> DataFrame:
    return collision_union(parts, name).groupBy("source").agg(
        F.sum("copies").alias("n_seen"), F.sum("kept").alias("n_kept"), (F.sum("copies") - F.sum("kept")).alias("n_skipped")
    )


def duplicate_audit(df: DataFrame, key: str) -> DataFrame:
    per = df.groupBy(key).agg(F.count(F.lit(1)).alias("c"))
    return per.agg(F.sum("c").alias("n_rows"), F.count(F.lit(1)).alias("n_names"), F.count_if(F.col("c") > 1).alias("n_repeated"))


def alignment_audit(predictions: DataFrame, member: str, keys: list[str]) -> DataFrame:
    """Cells per member, and whether every member covers exactly the cells of the whole."""
    cells = predictions.groupBy(*keys).agg(F.count_distinct(member).alias("_m"), F.count(F.lit(1)).alias("_c"))
    full = cells.agg(F.count(F.lit(1)).alias("n_cells"), F.min("_m").alias("least"), F.max("_m").alias("most"), F.sum("_c").alias("n_rows"))
    return full.withColumn("aligned", (F.col("least") == F.col("most")) & (F.col("n_rows") == F.col("n_cells") * F.col("most")))


def fallback(sources: list[tuple[str, DataFrame]], key: str, value: str) -> DataFrame:
    """Per key the first source, in order, with a non-null value; the source's place is kept."""
    parts = [df.select(key, F.col(value).alias("value"), F.lit(i).alias("place"), F.lit(tag).alias("source")) for i, (tag, df) in enumerate(sources)]
    union = reduce(DataFrame.unionByName, parts)
    hit = F.min(F.when(F.col("value").isNotNull(), F.struct("place", "source", "value")))
    return union.groupBy(key).agg(hit.alias("_h")).select(key, "_h.value", "_h.source", (F.col("_h.place") > 0).alias("fell_back"))


def nearest(targets: DataFrame, candidates: DataFrame, keys: list[str], at: str, id_col: str, prefer: str = "earlier", **kw) -> DataFrame:
    """Closest candidate position to each target in the same group, and gap = chosen - target.

    Targets and candidates are laid on one order; the neighbour on either side is a running value of one
    two-sided pass, so no target meets more than its two neighbours.
    """
    t = targets.select(*keys, F.col(at).alias("_at"), F.col(id_col).cast("string").alias("_id"), F.lit(1).alias("_side"), F.lit(None).cast("double").alias("_c"))
    c = candidates.select(*keys, F.col(at).alias("_at")).distinct()
    c = c.select(*keys, "_at", F.lit("").alias("_id"), F.lit(0).alias("_side"), F.col("_at").cast("double").alias("_c"))
    # A candidate at the target's own position comes before it.
    line = t.unionByName(c).withColumn("_order", F.struct("_at", "_side", "_id"))
    seen = two_sided(line, keys, "_order", {"_before": ("max", "_c")}, {"_after": ("min", "_c")}, **kw).filter(F.col("_side") == 1)
    back, ahead = F.col("_at") - F.col("_before"), F.col("_after") - F.col("_at")
    take_before = (back <= ahead) if prefer == "earlier" else (back < ahead)
    chosen = F.when(F.col("_after").isNull() | take_before, F.col("_before")).otherwise(F.col("_after"))
    out = seen.select(*keys, F.col("_id").alias(id_col), F.col("_at").alias(at), chosen.alias("chosen"))
    return out.withColumn("gap", F.col("chosen") - F.col(at))


def assign_distinct(targets: DataFrame, candidates: DataFrame, run: str, at: str, rank: str, **kw) -> DataFrame:
    """Per run, targets in rank order each take the nearest candidate not yet taken; NULL where none is left.

    With ``most`` targets in the largest run, a target loses at most ``most - 1`` candidates to better ranks, so
    its ``most`` neighbours on either side decide: a run has at most 2 * most * most rows. About RUNS_PER_CALL runs share a
    Python call. Targets are meant to be few per run (a top-k list); their number is taken from the data.
    """
    sizes = targets.groupBy(run).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("runs")).first()
    most, buckets = sizes["most"] or 1, max(1, -(-sizes["runs"] // RUNS_PER_CALL))
    cand = row_index(candidates.select(run, F.col(at).alias("_c")).distinct(), [run], "_c", "_pos", **kw)
    line = targets.select(run, F.struct(F.col(at).alias("a"), F.lit(1).alias("s"), F.col(rank).alias("r")).alias("_o"), F.lit(None).cast("bigint").alias("_pos"))
    line = line.unionByName(cand.select(run, F.struct(F.col("_c").alias("a"), F.lit(0).alias("s"), F.lit(0).alias("r")).alias("_o"), "_pos"))
    placed = running(line, [run], "_o", {"_prev": ("max", "_pos")}, **kw).filter(F.col("_o.s") == 1)
    near = F.sequence(F.coalesce("_prev", F.lit(-1)) - (most - 1), F.coalesce("_prev", F.lit(-1)) + most)
    options = placed.select(run, F.col("_o.a").alias("target"), F.col("_o.r").alias("rank"), F.explode(near).alias("_pos")).join(cand, [run, "_pos"], "left")

    kinds = dict(options.dtypes)
    # A missing candidate is told by a column of its own: NULLs would turn whole numbers of the bucket into doubles.
    known = F.col("_c").isNotNull()
    dealt = options.select(
        F.pmod(F.xxhash64(run), F.lit(buckets)).alias("_bucket"), F.col(run).cast("string").alias("_run"), "rank", "target", known.alias("_known"), F.coalesce("_c", F.col("target").cast(kinds["_c"])).alias("_c")
    )

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_run", "rank", "target", "_c"])
        rows, taken, last = [], set(), None
        options = zip(*(pdf[c].tolist() for c in ("_run", "rank", "target", "_known", "_c")))
        for (own, r, t), near in groupby(options, key=lambda o: o[:3]):
            if not rows or own != last:
                taken, last = set(), own
            best = min((c for *_, known, c in near if known and c not in taken), key=lambda c: abs(c - t), default=None)
            taken.add(best)
            rows.append((own, r, t, best, None if best is None else best - t))
        return pd.DataFrame(rows, columns=["_run", "rank", "target", "chosen", "gap"], dtype=object)

    schema = f"_run string, rank {kinds['rank']}, target {kinds['target']}, chosen {kinds['_c']}, gap {kinds['_c']}"
    out = dealt.groupBy("_bucket").applyInPandas(greedy, schema)
    return out.select(F.col("_run").cast(kinds[run]).alias(run), "rank", "target", "chosen", "gap")


def pair_differences(wide: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """All pairs of columns side by side: mean absolute difference, from one aggregation."""
    pairs = list(combinations(columns, 2))
    sums = wide.groupBy(*keys).agg(*[F.avg(F.abs(F.col(a) - F.col(b))).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    return sums.select(*keys, F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("mean_diff")) for i, (a, b) in enumerate(pairs)])))


def each_value(df: DataFrame, values: list, name: str) -> DataFrame:
    """Every row with every value of a short driver-side list, generated in place."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def step_sets(grid: DataFrame, found: DataFrame, step: str) -> DataFrame:
    """Union of expected and found steps; a found step off the grid is extra."""
    both = grid.select(step, F.lit(1).alias("_g"), F.lit(0).alias("_f")).unionByName(found.select(step, F.lit(0).alias("_g"), F.lit(1).alias("_f")))
    per = both.groupBy(step).agg(F.max("_g").alias("_g"), F.max("_f").alias("_f"))
    return per.select(step, (F.col("_f") == 1).alias("found"), ((F.col("_f") == 1) & (F.col("_g") == 0)).alias("extra"))
