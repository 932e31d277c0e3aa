"""AGG queries."""

from pyspark.sql import functions as F

from assay.operators import labels as L
from assay.operators import profile as P
from assay.plans import sqltext as Q
from assay.plans.registry import query
from assay.plans.views import MEMBERS, TASKS, finding_sets, image_sizes, items, label_cells, predictions, soft_labels, wide_labels, wide_predictions
from assay.session import fresh_path


def rounded(df, *keep):
    """Round every double to 9 places so that engines that add in another order agree."""
    return df.select(*[F.round(c, 9).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


COUNTS = "count(*) as n, count(*) filter (where raw = 1) as pos, count(*) filter (where raw = 0) as neg, count(*) filter (where raw = -1) as unc, count(*) filter (where raw is null) as blank"
SHARES = ", ".join(f"round(coalesce(100.0::double * {k} / nullif(n, 0), 0), 9) as {k}_of_all, round(coalesce(100.0::double * {k} / nullif(pos + neg + unc, 0), 0), 9) as {k}_of_mentioned" for k in ("pos", "neg", "unc"))
SHARES += ", pos + neg + unc as mentioned, round(coalesce(100.0::double * blank / nullif(n, 0), 0), 9) as blank_of_all"


@query("agg_1_label_states", f"select *, {SHARES} from (select task, {COUNTS} from label_cells group by task)")
def agg_1(spark, sf):
    return rounded(P.label_states(label_cells(spark, sf), ["task"]))


@query("agg_2_states_total", f"select *, {SHARES} from (select case when grouping(task) = 1 then 'ALL TASKS' else task end as task, {COUNTS} from label_cells group by rollup(task))")
def agg_2(spark, sf):
    return rounded(P.label_states_total(label_cells(spark, sf), "task"))


@query("agg_3_cell_tally", f"select *, {SHARES} from (select {COUNTS} from label_cells)")
def agg_3(spark, sf):
    return rounded(P.label_states(label_cells(spark, sf), []))


@query("agg_4_row_any", """select count(*) as n, count(*) filter (where t0=1 or t1=1 or t2=1 or t3=1 or t4=1) as any_pos, count(*) filter (where t0=0 or t1=0 or t2=0 or t3=0 or t4=0) as any_neg,
 count(*) filter (where t0=-1 or t1=-1 or t2=-1 or t3=-1 or t4=-1) as any_unc, count(*) filter (where t0 is null and t1 is null and t2 is null and t3 is null and t4 is null) as all_blank,
 count(*) filter (where t0=0 and t1=0 and t2=0 and t3=0 and t4=0) as all_neg from wide_labels""")
def agg_4(spark, sf):
    return P.row_any(wide_labels(spark, sf), TASKS)


@query("agg_5_policy_prevalence", "select task, round(100 * avg((coalesce(raw, 0) in (1, -1))::int), 9) as pct_ones, round(100 * avg((coalesce(raw, 0) = 1)::int), 9) as pct_zeros from label_cells group by task")
def agg_5(spark, sf):
    return rounded(P.policy_prevalence(label_cells(spark, sf), ["task"]))


@query("agg_6_split_drift", """
with s as (select task, count(*) filter (where split='train' and raw=1) as pos_train, count(*) filter (where split='train') as n_a, count(*) filter (where split='val19k' and raw=1) as pos_val19k, count(*) filter (where split='val19k') as n_b from label_cells group by task)
select task, pos_train, n_a - pos_train as neg_train, round(100.0::double*pos_train/n_a, 9) as pct_train, pos_val19k, n_b - pos_val19k as neg_val19k, round(100.0::double*pos_val19k/n_b, 9) as pct_val19k,
 round(abs(100.0::double*pos_train/n_a - 100.0::double*pos_val19k/n_b), 9) as gap from s""")
def agg_6(spark, sf):
    return rounded(P.split_drift(label_cells(spark, sf), "task", "split", "train", "val19k", "raw"))


@query("agg_7_value_counts", "select view, count(*) as n, round(100.0::double * count(*) / sum(count(*)) over (), 9) as pct from (select case when item_id % 20 < 3 then null when item_id % 20 < 9 then 'AP' else 'PA' end as view from items) group by view")
def agg_7(spark, sf):
    df = items(spark, sf).selectExpr("case when item_id % 20 < 3 then null when item_id % 20 < 9 then 'AP' else 'PA' end as view")
    return rounded(P.value_counts(df, "view"))


@query("agg_8_structure", """
with s as (select group_id, item_id % 7 as study, count(*) as items from items group by 1, 2), g as (select group_id, count(*) as subs from s group by 1)
select sum(items)::bigint as n_items, count(distinct group_id) as n_groups, count(*) as n_subs, round(count(*)::double / count(distinct group_id), 9) as subs_per_group, (select max(subs) from g) as max_subs,
 round(sum(items)::double / count(*), 9) as items_per_sub, max(items) as max_items, count(*) filter (where items > 1) as n_multi, round(100.0::double * count(*) filter (where items > 1) / count(*), 9) as pct_multi from s""")
def agg_8(spark, sf):
    return rounded(P.structure_stats(items(spark, sf).selectExpr("group_id", "item_id % 7 as study"), "group_id", "study"))


@query("agg_9_numeric_summary", "select min(a) as min, max(a) as max, round(avg(a), 9) as mean, round(median(a), 9) as median, count(*) filter (where a = 0) as n_zero, count(*) filter (where a > 80) as n_above, count(*) filter (where a is null) as n_missing from (select case when item_id % 17 = 0 then null else age end as a from items)")
def agg_9(spark, sf):
    df = items(spark, sf).selectExpr("case when item_id % 17 = 0 then null else age end as a")
    return rounded(P.numeric_summary(df, "a", 80))


@query("agg_10_histogram", """
with h as (select least(floor((prob - 0.0::double) / 0.025::double), 39)::int as bin, count(*) as n from soft_labels where prob between 0 and 1 group by 1)
select bin, round(bin * 0.025::double, 9) as left_edge, coalesce(n, 0) as n from (select unnest(range(40))::int as bin) left join h using (bin)""")
def agg_10(spark, sf):
    return rounded(P.histogram(soft_labels(spark, sf), "prob", 0.0, 1.0, 40))


@query("agg_11_grid_density", "select floor(w / 40.0::double)::bigint as gx, floor(h / 40.0::double)::bigint as gy, count(*) as n from image_sizes group by 1, 2")
def agg_11(spark, sf):
    return P.grid_density(image_sizes(spark, sf), "w", "h", 40.0)


@query("agg_12_top_values", """
with c as (select w, h, count(*) as n, sum(count(*)) over () as total from image_sizes group by 1, 2), t as (select *, row_number() over (order by n desc, w, h) as rn from c)
select w, h, n, round_even(n * 100.0::double / total::double, 2) as pct, rn::int as rank, round(sum(round_even(n * 100.0::double / total::double, 2)) over (order by rn), 9) as cum_pct from t where rn <= 10""")
def agg_12(spark, sf):
    return rounded(P.top_values(image_sizes(spark, sf), ["w", "h"], 10))


@query("agg_13_extremes", """
with m as (select *, w * h as area from image_sizes), c as (select w, h, count(*) as n from image_sizes group by 1, 2)
select (select min(area) from m) as min_measure, (select arg_min(image_id, (area, image_id)) from m) as min_image_id, (select arg_min(w, (area, image_id)) from m) as min_w,
 (select max(area) from m) as max_measure, (select arg_min(image_id, (-area, image_id)) from m) as max_image_id, (select arg_min(w, (-area, image_id)) from m) as max_w,
 (select arg_min(w, (n, w, h)) from c) as rarest_w, (select arg_min(h, (n, w, h)) from c) as rarest_h""")
def agg_13(spark, sf):
    df = image_sizes(spark, sf)
    counts = df.groupBy("w", "h").agg(F.count(F.lit(1)).alias("n"))
    rare = F.min(F.struct("n", "w", "h"))
    ends = P.arg_extremes(df, F.col("w") * F.col("h"), "image_id", ["image_id", "w"])
    return ends.select("*", counts.agg(rare["w"]).scalar().alias("rarest_w"), counts.agg(rare["h"]).scalar().alias("rarest_h"))


@query("agg_14_shares", "select avg((abs(w::double / h - 1) < 0.02::double)::int) as square, avg((w > h)::int) as landscape, avg((h > w)::int) as portrait from image_sizes")
def agg_14(spark, sf):
    w, h = F.col("w"), F.col("h")
    return P.share(image_sizes(spark, sf), {"square": F.abs(w / h - 1) < 0.02, "landscape": w > h, "portrait": h > w})


@query("agg_15_cooccurrence", """
with p as (select item_id, task, (raw is not null and raw = 1)::int as y from label_cells),
j as (select a.task as a, b.task as b, sum(a.y * b.y)::bigint as n_both, sum(a.y)::bigint as sa, corr(a.y, b.y) as phi from p a join p b using (item_id) group by 1, 2)
select a, b, n_both, round_even(100.0::double * n_both / sa, 1) as pct_b_given_a, round(phi, 9) as phi from j""")
def agg_15(spark, sf):
    wide = wide_labels(spark, sf).fillna(0, TASKS)
    return rounded(P.pair_counts(wide, TASKS))


@query("agg_16_cardinality", """
with k as (select *, (labels like '%A%')::int + (labels like '%B%')::int + (labels like '%C%')::int as k from (select item_id, case when labels = 'No Finding' then '' else labels end as labels from finding_sets))
select min(k) as min_labels, max(k) as max_labels, round(avg(k), 9) as mean_labels, count(*) filter (where k > 0) as any_pos, count(*) filter (where k = 0) as all_neg,
 count(*) filter (where k = 0 and item_id % 2 = 0) as all_neg_normal, count(*) filter (where k = 0 and item_id % 2 <> 0) as other_only from k""")
def agg_16(spark, sf):
    hot = L.one_hot(finding_sets(spark, sf), "labels", ["A", "B", "C"])
    return rounded(P.cardinality(hot, ["A", "B", "C"], F.col("item_id") % 2 == 0))


PS = [(1, "p1"), (5, "p5"), (25, "p25"), (50, "p50"), (75, "p75"), (95, "p95"), (99, "p99")]


@query("agg_17_distribution", "select task, count(prob) as n, round(avg(prob), 9) as mean, round(stddev_samp(prob), 9) as std, min(prob) as min, max(prob) as max, round(skewness(prob), 9) as skew, round(avg((prob < 0.5)::int), 9) as below_half, "
       + ", ".join(f"round(quantile_cont(prob, {p / 100}), 9) as {name}" for p, name in PS) + " from soft_labels group by task")
def agg_17(spark, sf):
    return rounded(P.distribution(soft_labels(spark, sf), ["task"], "prob"))


@query("agg_18_ecdf", "select task, prob, round(max(c), 9) as ecdf from (select task, prob, cume_dist() over (partition by task order by prob) as c from soft_labels) group by 1, 2")
def agg_18(spark, sf):
    return rounded(P.ecdf(soft_labels(spark, sf), ["task"], "prob"))


@query("agg_19_positives_at", f"""
with c as (select * from {Q.best_f1('predictions', ['task'])} where task <> 't4')
select task, count(*) as n, count(*) filter (where prob >= 0.5::double) as n_half, round(100.0::double * count(*) filter (where prob >= 0.5::double) / count(*), 9) as pct_half,
 case when max(threshold) is not null then count(*) filter (where prob >= threshold) end as n_calibrated, case when max(threshold) is not null then round(100.0::double * count(*) filter (where prob >= threshold) / count(*), 9) end as pct_calibrated
from soft_labels left join c using (task) group by task""")
def agg_19(spark, sf):
    from assay.operators.metrics import best_f1
    cuts = best_f1(predictions(spark, sf), ["task"]).filter(F.col("task") != "t4")
    return rounded(P.positives_at(soft_labels(spark, sf), ["task"], "prob", cuts, ["task"]))


RANKS = ", ".join(f"rank() over (partition by task order by {m}) + (count(*) over (partition by task, {m}) - 1) / 2.0::double as {m}" for m in MEMBERS)


@query("agg_20_spearman", f"with r as (select task, {RANKS} from wide_predictions) " + " union all ".join(f"select task, '{a}' as a, '{b}' as b, round(corr({a}, {b}), 9) as corr from r group by task" for i, a in enumerate(MEMBERS) for b in MEMBERS[i + 1:]))
def agg_20(spark, sf):
    ranks = P.rank_columns(wide_predictions(spark, sf).select("task", *MEMBERS), ["task"], MEMBERS)
    return rounded(P.correlations(ranks, ["task"], MEMBERS))


RANK_SQL = "select item_id, task, member, round(avg_rank, 9) as avg_rank, round(avg_rank / n, 9) as norm_rank from (select item_id, task, member, rank() over (partition by member, task order by prob) + (count(*) over (partition by member, task, prob) - 1) / 2.0::double as avg_rank, count(*) over (partition by member, task) as n from predictions)"


def _average_rank(spark, sf, **kw):
    from assay.functions.ordered import ranked
    df = predictions(spark, sf).select("item_id", "task", "member", "prob")
    r = ranked(df, ["member", "task"], "prob", **kw)
    return rounded(r.select("item_id", "task", "member", "avg_rank", (F.col("avg_rank") / F.col("group_rows")).alias("norm_rank")))


@query("agg_21_average_rank", RANK_SQL)
def agg_21(spark, sf):
    return _average_rank(spark, sf)


@query("agg_21_average_rank_ranged", RANK_SQL)
def agg_21_ranged(spark, sf):
    """The same ranks through ranges of about 100 distinct scores."""
    return _average_rank(spark, sf, rows_per_range=100)


@query("agg_22_weighted_percentiles", "select h, " + ", ".join(f"quantile_disc(w, {p / 100}) as p{p}" for p in (0, 5, 25, 50, 75, 95, 100)) + " from image_sizes group by h")
def agg_22(spark, sf):
    return P.weighted_percentiles(image_sizes(spark, sf), ["h"], "w", [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0])


@query("agg_23_weighted_mean", "select h, round(sum(w * kib)::double / sum(kib), 9) as mean_w from image_sizes group by h")
def agg_23(spark, sf):
    return rounded(image_sizes(spark, sf).groupBy("h").agg(P.weighted_mean(F.col("w"), F.col("kib")).alias("mean_w")))


@query("agg_24_shard_profile", """
with m as (select h as split, w as mode, count(*) as n, sum(kib) as size, count(*) filter (where image_id % 50 = 0) as bad from image_sizes group by 1, 2)
select split, sum(n)::bigint as n, sum(size)::bigint as total_size, sum(bad)::bigint as n_bad, count(*) as n_modes, arg_max(mode, (n, mode)) as top_mode from m group by split""")
def agg_24(spark, sf):
    df = image_sizes(spark, sf).selectExpr("h as split", "w as mode", "kib", "image_id")
    return P.shard_profile(df, ["split"], "kib", "mode", F.col("image_id") % 50 == 0)


@query("agg_24_incremental_profile", """
with m as (select h as split, w as mode, count(*) as n, sum(kib) as size, min(kib) as least, max(kib) as most, count(*) filter (where image_id % 50 = 0) as bad from image_sizes group by 1, 2)
select split, sum(n)::bigint as n, sum(size)::bigint as total_size, min(least) as least, max(most) as most, sum(bad)::bigint as n_bad, count(*) as n_modes, arg_max(mode, (n, mode)) as top_mode from m group by split""")
def agg_24_incremental(spark, sf):
    """Shards arrive in three steps, one of them first with wrong sizes; the stored states give the profile of all."""
    path = fresh_path(spark, "profile")
    df = image_sizes(spark, sf).selectExpr("h as split", "w as mode", "kib", "image_id", "cast(image_id % 6 as int) as shard")
    steps = [df.where("shard < 3").withColumn("kib", F.when(F.col("shard") == 1, 0).otherwise(F.col("kib"))), df.where("shard in (3, 4)"), df.where("shard in (1, 5)")]
    for step in steps:
        state = P.profile_state(step, "shard", ["split"], "kib", "mode", F.col("image_id") % 50 == 0)
        P.store_profile(state, path, "shard")
    stored = spark.read.schema(state.schema).parquet(path)
    return P.merged_profile(stored, ["split"]).withColumn("total_size", F.col("total_size").cast("bigint"))


@query("agg_25_table_health", "select count(*) as n, count(*) filter (where item_id is null) as null_item_id, count(*) filter (where path is null) as null_path, "
       + ", ".join(f"count(*) filter (where {t} is null) as null_{t}" for t in TASKS) + ", count(*) - count(distinct path) as n_duplicates from wide_labels")
def agg_25(spark, sf):
    return P.table_health(wide_labels(spark, sf).select("item_id", "path", *TASKS), "path")


@query("agg_26_tree_totals", r"select nullif(regexp_extract(path, '^ds/train/([^/]+)/', 1), '') as top, count(*) as n_files, sum(age)::bigint as bytes from items group by 1")
def agg_26(spark, sf):
    return P.tree_totals(items(spark, sf).selectExpr("path", "age as length"), pattern=r"^ds/train/([^/]+)/")
