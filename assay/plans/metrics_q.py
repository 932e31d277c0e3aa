"""MET queries."""

from pyspark.sql import functions as F

from assay.operators import metrics as M
from assay.plans import sqltext as Q
from assay.plans.registry import query
from assay.plans.views import label_cells, predictions, run_scores, table, wide_predictions

MT = ["member", "task"]


def r9(*cols):
    return [F.round(c, 9).alias(c) for c in cols]


@query("met_1_auroc", f"select member, task, round(auroc, 9) as auroc, n_pos, n_neg from {Q.ranking('predictions', MT)}")
def met_1(spark, sf):
    return M.ranking_metrics(predictions(spark, sf), MT).select(*MT, *r9("auroc"), "n_pos", "n_neg")


@query("met_1_auroc_ranged", f"select member, task, round(auroc, 9) as auroc, round(auprc, 9) as auprc from {Q.ranking('predictions', MT)}")
def met_1_ranged(spark, sf):
    """The same scores through ranges of about 100 distinct scores: the plan used for large inputs."""
    return M.ranking_metrics(predictions(spark, sf), MT, rows_per_range=100).select(*MT, *r9("auroc", "auprc"))


REAL_TRUTH = """(select n_chars, 'quality' as target, quality as y from documents join labels using (doc_id)
 union all select n_chars, 'toxic', toxic from documents join labels using (doc_id))"""


@query("met_1_auroc_quality", f"select target, round(auroc, 9) as auroc, n_pos, n_neg from {Q.ranking(REAL_TRUTH, ['target'], 'n_chars')}")
def met_1_quality(spark, sf):
    """Real truth: does document length separate the labelled classes?"""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    long = docs.select("n_chars", F.inline(F.array(F.struct(F.lit("quality").alias("target"), F.col("quality").alias("y")), F.struct(F.lit("toxic").alias("target"), F.col("toxic").alias("y")))))
    return M.ranking_metrics(long, ["target"], "n_chars").select("target", *r9("auroc"), "n_pos", "n_neg")


@query("met_2_average_precision", f"select member, task, round(auprc, 9) as auprc, n_pos from {Q.ranking('predictions', MT)}")
def met_2(spark, sf):
    return M.ranking_metrics(predictions(spark, sf), MT).select(*MT, *r9("auprc"), "n_pos")


@query("met_3_pr_curve", f"select member, task, {Q.r9('threshold', 'precision', 'recall')} from {Q.curve('predictions', MT)}")
def met_3(spark, sf):
    return M.curve(predictions(spark, sf), MT).select(*MT, *r9("threshold", "precision", "recall"))


@query("met_4_roc_curve", f"select member, task, round(threshold, 9) as threshold, round(fpr, 9) as fpr, round(recall, 9) as tpr from {Q.curve('predictions', MT)}")
def met_4(spark, sf):
    return M.curve(predictions(spark, sf), MT).select(*MT, *r9("threshold", "fpr"), F.round("recall", 9).alias("tpr"))


@query("met_5_confusion", f"select member, task, tp, fp, tn, fn from {Q.confusion('(select *, 0.5::double as threshold from predictions)', MT)}")
def met_5(spark, sf):
    return M.confusion(M.with_threshold(predictions(spark, sf), 0.5, []), MT).select(*MT, "tp", "fp", "tn", "fn")


@query("met_6_point_metrics", f"select member, task, {Q.r9('precision', 'recall', 'specificity', 'f1')} from {Q.points(Q.confusion('(select *, 0.5::double as threshold from predictions)', MT))}")
def met_6(spark, sf):
    counts = M.confusion(M.with_threshold(predictions(spark, sf), 0.5, []), MT)
    return M.point_metrics(counts).select(*MT, *r9("precision", "recall", "specificity", "f1"))


REPORT = ["auroc", "auprc", "f1", "precision", "recall", "specificity", "threshold"]
HALF = "(select *, 0.5::double as threshold from predictions)"


@query("met_7_excluding_report", f"select member, task, {Q.r9(*REPORT)}, n_pos, n_excluded from {Q.report(HALF, MT, keep='not uncertain')}")
def met_7(spark, sf):
    df = M.with_threshold(predictions(spark, sf), 0.5, [])
    return M.report(df, MT, excluded="uncertain").select(*MT, *r9(*REPORT), "n_pos", "n_excluded")


MEANS = [f"mean_{m}" for m in M.MACRO]
MEANS_SQL = ", ".join(f"round(avg({m}), 9) as mean_{m}" for m in M.MACRO)


@query("met_8_macro", f"select member, {MEANS_SQL} from {Q.report(HALF, MT)} group by member")
def met_8(spark, sf):
    df = M.with_threshold(predictions(spark, sf), 0.5, [])
    return M.macro(M.report(df, MT), ["member"]).select("member", *r9(*MEANS))


@query("met_9_best_f1", f"select member, task, {Q.r9('threshold', 'best_f1')} from {Q.best_f1('predictions', MT)}")
def met_9(spark, sf):
    return M.best_f1(predictions(spark, sf), MT).select(*MT, *r9("threshold", "best_f1"))


VAL = "(select * from predictions where split = 'val19k')"
CUT_VAL = f"(select p.*, c.threshold from {VAL} p join {Q.best_f1(VAL, MT)} c using (member, task))"


@query("met_10_calibrate_freeze", f"select member, task, {Q.r9(*REPORT)}, n_pos from {Q.report(CUT_VAL, MT)}")
def met_10(spark, sf):
    val = predictions(spark, sf).filter(F.col("split") == "val19k")
    return M.calibrate(val, MT).select(*MT, *r9(*REPORT), "n_pos")


CERTAIN = "(select * from predictions where split = 'val19k' and not uncertain)"
CUT_CERTAIN = f"(select p.*, c.threshold from {CERTAIN} p join {Q.best_f1(CERTAIN, MT)} c using (member, task))"


@query("met_11_calibrate_certain", f"select member, task, {Q.r9(*REPORT)}, n_pos from {Q.report(CUT_CERTAIN, MT)}")
def met_11(spark, sf):
    val = predictions(spark, sf).filter((F.col("split") == "val19k") & ~F.col("uncertain"))
    return M.calibrate(val, MT).select(*MT, *r9(*REPORT), "n_pos")


FROZEN = f"(select * from {Q.best_f1(VAL, MT)} where not (member = 'm3' and task = 't4'))"
TEST = f"(select p.*, coalesce(c.threshold, 0.5::double) as threshold, case when c.threshold is null then 'default' else 'frozen' end as source from (select * from predictions where split = 'test500') p left join {FROZEN} c using (member, task))"


@query("met_12_apply_frozen", f"select member, task, source, {Q.r9(*REPORT)}, n_pos from {Q.report(TEST, MT + ['source'])}")
def met_12(spark, sf):
    p = predictions(spark, sf)
    cuts = M.best_f1(p.filter(F.col("split") == "val19k"), MT).filter(~((F.col("member") == "m3") & (F.col("task") == "t4")))
    test = M.with_threshold(p.filter(F.col("split") == "test500"), cuts, MT)
    test = test.withColumn("source", F.when(F.col("threshold").isNull(), "default").otherwise("frozen")).fillna({"threshold": 0.5})
    return M.report(test, MT + ["source"]).select(*MT, "source", *r9(*REPORT), "n_pos")


@query("met_13_log_loss", """
select member, task, round(coalesce(avg(case when not uncertain then -(2.0::double*goal*ln(p) + (1-goal)*ln(1-p)) end), 0), 9) as loss from
 (select *, y*0.95::double + 0.025::double as goal, least(greatest(prob, 1e-7::double), 1 - 1e-7::double) as p from predictions) group by member, task""")
def met_13(spark, sf):
    y = F.when(~F.col("uncertain"), F.col("y"))
    return predictions(spark, sf).groupBy(*MT).agg(F.round(M.log_loss(y, F.col("prob"), 2.0, 0.05), 9).alias("loss"))


@query("met_14_mixed_log_loss", """
with cell as (select w.task, c.raw, w.m0, w.m1*4-2 as z0, w.m2*4-2 as z1, w.m3*4-2 as z2 from wide_predictions w join label_cells c using (item_id, task)),
per as (select task, case when task in ('t3', 't4')
  then avg(-((case when raw = 1 then z1 when raw = -1 then z2 else z0 end) - ln(exp(z0)+exp(z1)+exp(z2))))
  else coalesce(avg(case when raw is null or raw <> -1 then -((case when raw=1 then 1 else 0 end)*ln(m0c) + (case when raw=1 then 0 else 1 end)*ln(1-m0c)) end), 0) end as loss
  from (select *, least(greatest(m0, 1e-7::double), 1-1e-7::double) as m0c from cell) group by task)
select round(sum(loss), 9) as loss, count(*) as n_tasks from per""")
def met_14(spark, sf):
    """Masked BCE on three tasks, 3-class cross-entropy on two, summed over tasks."""
    raw = label_cells(spark, sf).select("item_id", "task", "raw")
    cell = wide_predictions(spark, sf).join(raw, ["item_id", "task"])
    y = F.when(F.coalesce(F.col("raw"), F.lit(0)) != -1, F.when(F.col("raw") == 1, 1).otherwise(0))
    label = F.when(F.col("raw") == 1, 1).when(F.col("raw") == -1, 2).otherwise(0)
    ce = F.avg(M.cross_entropy(label, [F.col(m) * 4 - 2 for m in ("m1", "m2", "m3")]))
    per = cell.groupBy("task").agg(F.when(F.col("task").isin("t3", "t4"), ce).otherwise(M.log_loss(y, F.col("m0"))).alias("loss"))
    return per.agg(F.round(F.sum("loss"), 9).alias("loss"), F.count(F.lit(1)).alias("n_tasks"))


MST = ["member", "split", "task"]


@query("met_15_multi_set", f"select member, split, task, {Q.r9(*REPORT)}, n_pos, n_excluded from {Q.report(HALF, MST, keep='not uncertain')}")
def met_15(spark, sf):
    df = M.with_threshold(predictions(spark, sf), 0.5, [])
    return M.report(df, MST, excluded="uncertain").select(*MST, *r9(*REPORT), "n_pos", "n_excluded")


@query("met_16_subset_rescore", f"""
select s.member, s.split, s.n_all, s.n_used, {Q.r9('mean_auroc', 'mean_auprc')} from
 (select member, split, count(distinct item_id) as n_all, count(distinct case when lower(path) like '%frontal%' then item_id end) as n_used from predictions group by 1, 2) s
 join (select member, split, avg(auroc) as mean_auroc, avg(auprc) as mean_auprc from {Q.ranking("(select * from predictions where lower(path) like '%frontal%')", MST)} group by 1, 2) r using (member, split)""")
def met_16(spark, sf):
    p = predictions(spark, sf)
    frontal = F.lower("path").contains("frontal")
    ranks = M.macro(M.ranking_metrics(p.filter(frontal), MST), ["member", "split"], ["auroc", "auprc"])
    each = p.groupBy("member", "split", "item_id").agg(F.max(frontal).alias("used"))
    sizes = each.groupBy("member", "split").agg(F.count(F.lit(1)).alias("n_all"), F.count_if("used").alias("n_used"))
    return sizes.join(ranks, ["member", "split"]).select("member", "split", "n_all", "n_used", *r9("mean_auroc", "mean_auprc"))


@query("met_17_two_scorings", """
with a as (select run, avg(score) as s from run_scores group by run), b as (select run, score as s from run_scores where split = 'click'),
j as (select a.run, round(a.s, 9) as score_a, round(b.s, 9) as score_b from a join b using (run)),
r as (select *, score_b - score_a as delta, row_number() over (order by score_a desc, run) as ra, row_number() over (order by score_b desc, run) as rb from j)
select count(*) as n_runs, round(avg(delta), 9) as delta_mean, round(min(delta), 9) as delta_min, round(max(delta), 9) as delta_max,
 count(*) filter (where ra <> rb) as moved, max(run) filter (where ra = 1) as top_a, max(run) filter (where rb = 1) as top_b from r""")
def met_17(spark, sf):
    s = run_scores(spark, sf)
    a = s.groupBy("run").agg(F.round(F.avg("score"), 9).alias("score"))
    b = s.filter(F.col("split") == "click").select("run", F.round("score", 9).alias("score"))
    c = M.compare_scorings(a, b, "run", "score")
    return c.agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.round(F.avg("delta"), 9).alias("delta_mean"),
        F.round(F.min("delta"), 9).alias("delta_min"),
        F.round(F.max("delta"), 9).alias("delta_max"),
        F.count_if(F.col("rank_a") != F.col("rank_b")).alias("moved"),
        F.max(F.when(F.col("rank_a") == 1, F.col("run"))).alias("top_a"),
        F.max(F.when(F.col("rank_b") == 1, F.col("run"))).alias("top_b"),
    )


WIDE_SQL = ", ".join(f'round(max(case when task = \'t{i}\' then auroc end), 9) as "auroc/t{i}", round(max(case when task = \'t{i}\' then auprc end), 9) as "auprc/t{i}"' for i in range(5))


@query("met_18_wide_row", f"select member, round(avg(auroc), 9) as mean_auroc, round(avg(auprc), 9) as mean_auprc, {WIDE_SQL} from {Q.ranking('predictions', MT)} group by member")
def met_18(spark, sf):
    per = M.ranking_metrics(predictions(spark, sf), MT)
    tasks = ["t0", "t1", "t2", "t3", "t4"]
    cells = [F.round(F.max(F.when(F.col("task") == t, F.col(m))), 9).alias(f"{m}/{t}") for t in tasks for m in ("auroc", "auprc")]
    return per.groupBy("member").agg(F.round(F.avg("auroc"), 9).alias("mean_auroc"), F.round(F.avg("auprc"), 9).alias("mean_auprc"), *cells)


@query("met_19_size_label", """
select split, count(*) as n, case when count(*) >= 1000 then concat('val', cast(cast(round_even(count(*)::double/1000, 0) as bigint) as varchar), 'k') else concat('val', cast(count(*) as varchar)) end as name
from items group by split""")
def met_19(spark, sf):
    from assay.plans.views import items
    n = items(spark, sf).groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("name", M.size_label(F.col("n")))


SPECIALIST = {"t0": "m0", "t1": "m1", "t2": "m2", "t3": "m3", "t4": "m0"}
SPECIALIST_SQL = "(case task when 't0' then 'm0' when 't1' then 'm1' when 't2' then 'm2' when 't3' then 'm3' else 'm0' end)"


@query("met_20_specialists", f"select split, {MEANS_SQL}, count(*) as n_tasks from {Q.report(f'(select * from {HALF} where member = {SPECIALIST_SQL})', ['split', 'task'])} group by split")
def met_20(spark, sf):
    df = M.with_threshold(predictions(spark, sf), 0.5, [])
    pick = F.create_map(*[F.lit(x) for kv in SPECIALIST.items() for x in kv])[F.col("task")]
    per = M.report(df.filter(F.col("member") == pick), ["split", "task"])
    return per.groupBy("split").agg(*[F.round(F.avg(m), 9).alias(f"mean_{m}") for m in M.MACRO], F.count(F.lit(1)).alias("n_tasks"))
