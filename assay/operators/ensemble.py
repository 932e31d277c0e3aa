"""Blending of members and search for blending weights.

Two shapes are used: long (one row per item, task and member), which any number of members fits,
and wide (a column per member), where blending is a plain expression and costs no shuffle.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.functions.ordered import running, settled, with_ranks
from assay.operators.metrics import MACRO, ranking_metrics, report, with_threshold
from assay.operators.profile import correlations, rank_columns
from assay.session import small_table

CLIP = 1e-6
TIE = 1e-9
SPACES = ("prob", "logit", "rank")
LATTICE_LIMIT = 200_000
#: Bins of a histogram that bounds an AUROC; more make fewer vectors worth ordering.
BINS = 1_024


def logit(p: Column, clip: float = CLIP) -> Column:
    q = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    return F.ln(q / (1 - q))


def from_space(x: Column, space: str) -> Column:
    return 1 / (1 + F.exp(-x)) if space == "logit" else x


def to_space(df: DataFrame, space: str, keys: list[str], score: str = "prob", **kw) -> DataFrame:
    """Map ``score`` to the combining space, per group ``keys`` (member and task)."""
    if space == "prob":
        return df
    if space == "logit":
        return df.withColumn(score, logit(F.col(score)))
    if space == "rank":
        return to_rank_columns(df, keys, [score], **kw)
    raise ValueError(f"space must be one of {SPACES}, not {space!r}")


def flat_blend(df: DataFrame, cell: list[str], score: str = "prob", carry: list[str] = ("y",)) -> DataFrame:
    return df.groupBy(*cell).agg(F.avg(score).alias(score), *[F.first(c).alias(c) for c in carry])


def aligned(predictions: DataFrame, cell: list[str], members: list[str], score: str = "prob", carry: list[str] = ("y",), strict: bool = True) -> DataFrame:
    """Long predictions (cell, member, score) as one row per cell with a column per member.

    A cell that a member misses or scores twice raises, with the cell and member in the message. With
    ``strict`` off such cells stay, with NULL or the mean, and ``aligned`` tells them apart. Rows of other
    members are not looked at.
    """
    mine = [F.col("member") == m for m in members]
    # Where a second score raises, the sum of one is its mean, and holds one number in place of two.
    only = F.sum if strict and dict(predictions.dtypes)[score] == "double" else F.avg
    wide = predictions.filter(F.col("member").isin(members)).groupBy(*cell).agg(
        *[only(F.when(c, F.col(score))).alias(m) for c, m in zip(mine, members)],
        *[F.first(c).alias(c) for c in carry],
        F.array(*[F.count_if(c) for c in mine]).alias("_n"),
    )
    whole = F.forall("_n", lambda n: n == 1)
    if not strict:
        return wide.withColumn("aligned", whole).drop("_n")
    text = F.concat(F.lit("members not aligned at "), F.concat_ws(" / ", *[F.col(c).cast("string") for c in cell]), F.lit(": rows per member "), F.col("_n").cast("string"))
    return wide.withColumn("_n", F.when(whole, True).otherwise(F.raise_error(text).cast("boolean"))).filter("_n").drop("_n")


def mean_of(columns: list[str]) -> Column:
    total = F.col(columns[0])
    for c in columns[1:]:
        total = total + F.col(c)
    return total / len(columns)


def weighted_blend(df: DataFrame, weights: DataFrame, cell: list[str], score: str = "prob", carry: list[str] = ("y",)) -> DataFrame:
    """Per-task weights, renormalized over the members present; all-zero weights blend evenly.

    A (task, member) without a weight raises.
    """
    j = df.join(settled(weights.select("task", "member", "w"), "weights"), ["task", "member"], "left")
    w = F.when(F.col("w").isNull(), F.raise_error(F.concat(F.lit("no weight for "), "task", F.lit(" / "), "member"))).otherwise(F.col("w"))
    total, blend = F.sum("_w"), F.sum(F.col("_w") * F.col(score))
    return j.withColumn("_w", w).groupBy(*cell).agg(
        F.when(total > 0, blend / total).otherwise(F.avg(score)).alias(score), *[F.first(c).alias(c) for c in carry]
    )


def member_label(node) -> str:
    """A leaf is its name; a group (space, [children]) reads avg(a + b) or avg-space(a + b)."""
    if isinstance(node, str):
        return node
    space, children = node
    return ("avg" if space == "prob" else f"avg-{space}") + "(" + " + ".join(member_label(c) for c in children) + ")"


def label_groups(members: DataFrame, group: str, space: str, member: str, order: str) -> DataFrame:
    """(group, label, n_twice) of a member table: labels as in member_label, and members listed again."""
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, member))), lambda s: s[member]), " + ")
    head = F.when(F.min(space) == "prob", F.lit("avg(")).otherwise(F.concat(F.lit("avg-"), F.min(space), F.lit("(")))
    twice = (F.count(member) - F.count_distinct(member)).alias("n_twice")
    return members.groupBy(group).agg(F.concat(head, names, F.lit(")")).alias("label"), twice)


def check_labels(nodes: list) -> list[str]:
    labels = [member_label(n) for n in nodes]
    twice = [name for name, n in Counter(labels).items() if n > 1]
    if twice:
        raise ValueError(f"members listed twice: {twice}")
    return labels


def nested_blend(wide: DataFrame, node, keys: list[str], name: str, **kw) -> DataFrame:
    """Add the column of a member tree: every group is blended in its own space, bottom up.

    Probability and logit groups are expressions; only a rank group needs its children ranked.
    """
    if isinstance(node, str):
        return wide.withColumn(name, F.col(node))
    space, children = node
    check_labels(children)
    parts = []
    for i, child in enumerate(children):
        part = f"{name}_{i}"
        wide = nested_blend(wide, child, keys, part, **kw)
        parts.append(part)
    if space == "rank":
        wide = to_rank_columns(wide, keys, parts, **kw)
    elif space == "logit":
        wide = wide.withColumns({p: logit(F.col(p)) for p in parts})
    return wide.withColumn(name, from_space(mean_of(parts), space)).drop(*parts)


def to_rank_columns(wide: DataFrame, keys: list[str], columns: list[str], **kw) -> DataFrame:
    """Replace each column by its average rank over the group's rows; all are ranked in one pass."""
    ranks = {c: f"_r_{c}" for c in columns}
    out = with_ranks(wide, keys, ranks, share=True, **kw)
    return out.withColumns({c: F.col(r) for c, r in ranks.items()}).drop(*ranks.values())


def specialist_member(df: DataFrame, specialists: dict[str, str], name: str) -> DataFrame:
    """One member made of a dedicated member per task."""
    pick = F.create_map(*[F.lit(x) for kv in specialists.items() for x in kv])[F.col("task")]
    return df.filter(F.col("member") == pick).withColumn("member", F.lit(name))


def lattice_size(members: int, units: int) -> int:
    return math.comb(units + members - 1, members - 1)


def each_lattice_vector(df: DataFrame, members: int, units: int, prefix: str = "u") -> DataFrame:
    """Every row with every way to give ``units`` units to the members, generated in place."""
    size = lattice_size(members, units)
    if size > LATTICE_LIMIT:
        raise ValueError(f"{size} weight vectors exceed the limit of {LATTICE_LIMIT}; use fewer units or the greedy search")
    left = F.lit(units)
    for m in range(members - 1):
        df = df.withColumn(f"{prefix}{m}", F.explode(F.sequence(F.lit(0), left)))
        left = left - F.col(f"{prefix}{m}")
    return df.withColumn(f"{prefix}{members - 1}", left)


def lattice_blend(members: list[str], units: int, prefix: str = "u") -> Column:
    total = F.col(f"{prefix}0") * F.col(members[0])
    for i, m in enumerate(members[1:], 1):
        total = total + F.col(f"{prefix}{i}") * F.col(m)
    return total / units


def distance_to_even(members: int, units: int, prefix: str = "u") -> Column:
    """Squared distance to equal weights, as an integer: sum of (M u - units)^2."""
    return sum(((F.col(f"{prefix}{i}") * members - units) * (F.col(f"{prefix}{i}") * members - units) for i in range(members)), F.lit(0))


def fold_auroc(df: DataFrame, keys: list[str], score: str, y: str, fold: str, folds: int, weight: str | None = None, **kw) -> DataFrame:
    """Training-side AUROC per (group, fold) where fold f trains on all other folds.

    One histogram and one order serve all folds: per distinct score there are counts per fold.
    Undefined scores (NULL, NaN) are left out, as in ranking_metrics. ``weight`` holds row counts.
    """
    counts = df.groupBy(*keys, score).agg(*_fold_counts(weight, y, fold, folds)).filter(F.col(score).isNotNull() & ~F.isnan(score))
    seen = running(settled(counts, "scores"), keys, score, {f"_b{f}": ("sum", f"_n{f}") for f in range(folds)}, stored=True, **kw)
    aggs = []
    for f in range(folds):
        p, n, below = (_others(c, f, folds) for c in ("_p", "_n", "_b"))
        ps, ns = F.sum(p), F.sum(n)
        aggs.append(F.when((ps > 0) & (ns > 0), F.sum(p * (below + n / 2)) / (ps * ns)).alias(f"_a{f}"))
    wide = seen.groupBy(*keys).agg(*aggs)
    return wide.select(*keys, F.inline(F.array(*[F.struct(F.lit(f).alias("fold"), F.col(f"_a{f}").alias("auroc")) for f in range(folds)])))


def _fold_counts(weight: str | None, y: str, fold: str, folds: int) -> list[Column]:
    w = F.col(weight) if weight else F.lit(1)
    each = [F.when(F.col(fold) == f, w).otherwise(0).cast("double") for f in range(folds)]
    return [*[F.sum(e * F.col(y)).alias(f"_p{f}") for f, e in enumerate(each)], *[F.sum(e * (1 - F.col(y))).alias(f"_n{f}") for f, e in enumerate(each)]]


def _others(prefix: str, fold: int, folds: int) -> Column:
    return sum((F.col(f"{prefix}{g}") for g in range(folds) if g != fold), F.lit(0.0))


def score_span(wide: DataFrame, members: list[str]) -> tuple[float, float]:
    """Least and greatest defined member score: every blend with weights that sum to 1 lies between them."""
    defined = [F.when(F.abs(F.col(m)) < float("inf"), F.col(m).cast("double")) for m in members]  # neither NaN nor infinite
    ends = [v for v in wide.agg(*[F.min(d) for d in defined], *[F.max(d) for d in defined]).first() if v is not None]
    return (min(ends), max(ends)) if ends else (0.0, 0.0)


def fold_bounds(df: DataFrame, keys: list[str], score: str, y: str, fold: str, folds: int, span: tuple[float, float], weight: str | None = None) -> DataFrame:
    """(keys, fold, least, most): bounds of fold_auroc from BINS equal bins of the score.

    Pairs in different bins are ordered as their scores are; a pair inside one bin may count for nothing or
    whole. Counts combine map-side, so a task sends at most BINS rows per group, and no score is sorted.
    """
    low, high = span
    scale = min(BINS / (high - low), 1e300) if high > low else 1.0  # infinite scores fall into the outer bins
    bin_no = F.floor(F.least(F.greatest((F.col(score) - low) * scale, F.lit(0.0)), F.lit(BINS - 1.0))).cast("int")
    defined = df.filter(F.col(score).isNotNull() & ~F.isnan(score))
    counts = defined.groupBy(*keys, bin_no.alias("_bin")).agg(*_fold_counts(weight, y, fold, folds))
    w = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # at most BINS rows
    seen = counts.select("*", *[F.coalesce(F.sum(f"_n{f}").over(w), F.lit(0.0)).alias(f"_b{f}") for f in range(folds)])
    aggs = []
    for f in range(folds):
        p, n, below = (_others(c, f, folds) for c in ("_p", "_n", "_b"))
        pairs = F.sum(p) * F.sum(n)
        aggs += [F.when(pairs > 0, F.sum(p * below) / pairs).alias(f"_l{f}"), F.when(pairs > 0, F.sum(p * (below + n)) / pairs).alias(f"_m{f}")]
    each = [F.struct(F.lit(f).alias("fold"), F.col(f"_l{f}").alias("least"), F.col(f"_m{f}").alias("most")) for f in range(folds)]
    return seen.groupBy(*keys).agg(*aggs).select(*keys, F.inline(F.array(*each)))


def counted_rows(wide: DataFrame, members: list[str], fold: str, y: str) -> DataFrame:
    """Equal rows of a search as one row with their number: what every weight vector would repeat is done once.

    They are written, so that the search and what is scored after it need neither align nor fold the rows again.
    """
    return settled(wide.groupBy("task", fold, y, *members).agg(F.count(F.lit(1)).alias("_rows")), "search")


def grid_search(wide: DataFrame, members: list[str], units: int, fold: str, folds: int, y: str = "y", counted: bool = False, **kw) -> DataFrame:
    """Best lattice vector per (task, fold); within 1e-9 of the best the most even vector wins.

    Histograms bound every vector's AUROC first. Only vectors that can reach the best lower bound of some fold
    are scored on ordered scores, so only those are shuffled row by row; the result is that of scoring all.
    ``counted`` says that wide comes from counted_rows.
    """
    us = [f"u{i}" for i in range(len(members))]
    base = wide if counted else counted_rows(wide, members, fold, y)
    every = each_lattice_vector(base, len(members), units).withColumn("_score", lattice_blend(members, units))
    bounds = settled(fold_bounds(every, ["task", *us], "_score", y, fold, folds, score_span(base, members), "_rows"), "bounds")
    reach = bounds.groupBy("task", "fold").agg(F.max("least").alias("_reach"))
    worth = bounds.join(reach, ["task", "fold"]).filter(F.col("most") >= F.col("_reach") - 2 * TIE)
    left = settled(worth.groupBy("task").agg(F.collect_set(F.struct(*us)).alias("_left")), "left")  # at most the lattice
    scored = base.join(left, "task").select(*base.columns, F.inline("_left")).withColumn("_score", lattice_blend(members, units))
    aucs = fold_auroc(scored, ["task", *us], "_score", y, fold, folds, "_rows", **kw)
    w = Window.partitionBy("task", "fold")  # one row per lattice vector, bounded by LATTICE_LIMIT
    near = aucs.withColumn("_max", F.max("auroc").over(w)).filter(F.col("auroc") >= F.col("_max") - TIE)
    order = F.struct(distance_to_even(len(members), units).alias("d"), *us)
    best = near.groupBy("task", "fold").agg(F.min_by(F.struct("auroc", *us), order).alias("_b"))
    return best.select("task", "fold", "_b.auroc", *[(F.col(f"_b.{u}") / units).alias(m) for u, m in zip(us, members)])


def greedy_search(wide: DataFrame, members: list[str], rounds: int, fold: str, folds: int, tasks: list[str], y: str = "y", **kw) -> DataFrame:
    """Forward selection per (task, fold): each round adds the member that lifts the AUROC most.

    Folds that hold the same counts share their candidates, and one score table per candidate serves all
    folds. In each round histograms bound the candidates first; scores are ordered only of candidates that can
    be the best of a fold that has several such, and in the last round. The driver keeps only the counts: tasks x folds x members integers.
    """
    spark, size = wide.sparkSession, len(members)
    counts = {(t, f): (0,) * size for t in tasks for f in range(folds)}
    last: dict = dict.fromkeys(counts)
    base = counted_rows(wide, members, fold, y)  # read once per round

    def plus(c, i):
        return c[:i] + (c[i] + 1,) + c[i + 1:]

    span = score_span(base, members)

    def tries(wanted, total):
        options = F.create_map(*[x for t in tasks for x in (F.lit(t), F.array(*[F.array(*[F.lit(u) for u in v]) for v in wanted[t]]).cast("array<array<int>>"))])
        rows = base.withColumn("vec", F.explode(options[F.col("task")]))
        score = F.col("vec")[0] * F.col(members[0])
        for i, m in enumerate(members[1:], 1):
            score = score + F.col("vec")[i] * F.col(m)
        return rows.withColumn("_score", score / total) if total else rows.withColumn("_score", score)

    for done in range(rounds):
        every = {t: sorted({plus(counts[(t, f)], i) for f in range(folds) for i in range(size)}) for t in tasks}
        bounds = fold_bounds(tries(every, done + 1), ["task", "vec"], "_score", y, fold, folds, span, "_rows")
        known = {(r["task"], r["fold"], tuple(r["vec"])): r for r in bounds.collect()}  # one row per candidate and fold
        chances, wanted = {}, {t: set() for t in tasks}
        for (t, f), c in counts.items():
            own = [(i, r) for i in range(size) if (r := known.get((t, f, plus(c, i)))) is not None and r["least"] is not None]
            reach = max((r["least"] for _, r in own), default=0.0)
            chances[(t, f)] = [i for i, r in own if r["most"] >= reach - 2 * TIE]
            # A sole candidate is the best whatever it scores; the last round reports its score.
            if len(chances[(t, f)]) > 1 or done == rounds - 1:
                wanted[t].update(plus(c, i) for i in chances[(t, f)])
        seen = {}
        if any(wanted.values()):
            aucs = fold_auroc(tries({t: sorted(v) for t, v in wanted.items()}, None), ["task", "vec"], "_score", y, fold, folds, "_rows", **kw)
            seen = {(r["task"], r["fold"], tuple(r["vec"])): r["auroc"] for r in aucs.collect()}
        for (t, f), c in counts.items():
            left = chances[(t, f)]
            if not left:
                continue
            if len(left) > 1 or done == rounds - 1:
                scored = [(i, seen[(t, f, plus(c, i))]) for i in left]
                last[(t, f)] = max(a for _, a in scored)
                left = [i for i, a in scored if a >= last[(t, f)] - TIE]
            counts[(t, f)] = plus(c, min((c[i], i) for i in left)[1])
    out = [(t, f, last[(t, f)], *([x / rounds for x in c] if sum(c) else [1 / size] * size)) for (t, f), c in counts.items()]
    return small_table(spark, out, "task string, fold int, auroc double, " + ", ".join(f"{m} double" for m in members))


def _weighted_columns(members: list[str]) -> Column:
    total = F.col(f"_w_{members[0]}") * F.col(members[0])
    for m in members[1:]:
        total = total + F.col(f"_w_{m}") * F.col(m)
    return total


def out_of_fold(wide: DataFrame, fold_weights: DataFrame, members: list[str], fold: str, y: str = "y", weight: str | None = None) -> DataFrame:
    """AUROC of each fold's weights on its held-out rows, averaged per task over defined folds. ``weight`` holds row counts."""
    w = fold_weights.select("task", F.col("fold").alias(fold), *[F.col(m).alias(f"_w_{m}") for m in members])
    scored = wide.join(settled(w, "weights"), ["task", fold]).withColumn("_score", _weighted_columns(members))
    per = ranking_metrics(scored, ["task", fold], "_score", y, weight)
    return per.groupBy("task").agg(F.avg("auroc").alias("oof_auroc"))


def fold_average(fold_weights: DataFrame, members: list[str]) -> DataFrame:
    means = fold_weights.groupBy("task").agg(*[F.avg(m).alias(m) for m in members])
    return means.select("task", F.inline(F.array(*[F.struct(F.lit(m).alias("member"), F.col(m).alias("w")) for m in members])))


def search_summary(wide: DataFrame, fold_weights: DataFrame, members: list[str], fold: str, y: str = "y", weight: str | None = None) -> DataFrame:
    """Out-of-fold, in-sample and flat AUROC per task, with the gain of the search over flat. ``weight`` holds row counts."""
    mean_w = fold_weights.groupBy("task").agg(*[F.avg(m).alias(f"_w_{m}") for m in members])
    fitted = ranking_metrics(wide.join(settled(mean_w, "weights"), "task").withColumn("_score", _weighted_columns(members)), ["task"], "_score", y, weight)
    flat = ranking_metrics(wide.withColumn("_score", mean_of(members)), ["task"], "_score", y, weight)
    return (
        out_of_fold(wide, fold_weights, members, fold, y, weight)
        .join(fitted.select("task", F.col("auroc").alias("in_sample")), "task")
        .join(flat.select("task", F.col("auroc").alias("flat")), "task")
        .withColumn("gain", F.col("oof_auroc") - F.col("flat"))
    )


def evaluate_blend(blends: DataFrame, cuts: DataFrame, members: DataFrame, space: str, keys: list[str] = ("task",)) -> DataFrame:
    """Report of a blend (keys, y, prob) at frozen cuts per task, with the mean AUROC of its members beside.

    ``members`` holds their long predictions. In rank space, cut-dependent metrics are NULL.
    """
    rep = null_threshold_metrics(report(with_threshold(blends, cuts, ["task"]), list(keys)), F.lit(space))
    own = ranking_metrics(members, ["member", *keys]).groupBy(*keys).agg(F.avg("auroc").alias("members_auroc"))
    return rep.join(own, list(keys))


def null_threshold_metrics(report: DataFrame, space: Column) -> DataFrame:
    """Cut-dependent metrics do not exist in rank space: the cuts were set on probabilities."""
    return report.withColumns({m: F.when(space != "rank", F.col(m)) for m in MACRO[2:]})


def topk_sweep(wide: DataFrame, ordered: list[str], y: str = "y", **kw) -> DataFrame:
    """Macro AUROC of the best K members for every K and space, scored in one job."""
    ranks = {m: f"_r_{m}" for m in ordered}
    df = with_ranks(wide, ["task"], ranks, share=True, **kw)
    cells = []
    for k in range(1, len(ordered) + 1):
        top = ordered[:k]
        forms = {"prob": [F.col(m) for m in top], "logit": [logit(F.col(m)) for m in top], "rank": [F.col(ranks[m]) for m in top]}
        for space, cols in forms.items():
            total = cols[0]
            for c in cols[1:]:
                total = total + c
            cells.append(F.struct(F.lit(k).alias("k"), F.lit(space).alias("space"), (total / k).alias("score")))
    long = df.select("task", y, F.inline(F.array(*cells)))
    per = ranking_metrics(long, ["k", "space", "task"], "score", y, **kw)
    macro = per.groupBy("k", "space").agg(F.avg("auroc").alias("mean_auroc"))
    best = macro.agg(F.max(F.struct(F.round("mean_auroc", 9).alias("v"), (-F.col("k")).alias("k"), "space"))).scalar()
    return macro.withColumn("is_best", (F.col("k") == -best["k"]) & (F.col("space") == best["space"]))


def member_correlation(wide: DataFrame, members: list[str], **kw) -> DataFrame:
    """Spearman correlation of every pair of members, averaged over tasks."""
    ranks = rank_columns(wide.select("task", *members), ["task"], members, **kw)
    return correlations(ranks, ["task"], members).groupBy("a", "b").agg(F.avg("corr").alias("corr"))


def mean_correlation(pairs: DataFrame) -> DataFrame:
    both = pairs.select(F.col("a").alias("member"), "corr").unionByName(pairs.select(F.col("b").alias("member"), "corr"))
    return both.groupBy("member").agg(F.avg("corr").alias("mean_corr"))


def view_average(df: DataFrame, cell: list[str], score: str = "prob", carry: list[str] = ("y",), together: list[str] = ()) -> DataFrame:
    """Mean over the views of an item, before any blending.

    ``together`` names the part of ``cell`` that a later blend groups by: rows are spread by it alone, so that one shuffle
    serves both means. Cells are about as many as rows, so counting them before the shuffle would save little and hold much.
    """
    rows = df.select(*dict.fromkeys([*cell, score, *carry])).repartition(*together) if together else df
    return flat_blend(rows, cell, score, carry)


def promotions(history: DataFrame, split: str, order: str, score: str, reusable: Column, **kw) -> DataFrame:
    """Runs that were strictly better than everything before them on their split."""
    from assay.operators.windows import best_so_far
    b = best_so_far(history.filter(reusable), [split], order, score, **kw)
    return b.filter("improved")
