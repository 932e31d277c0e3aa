"""RUN queries."""

from pyspark.sql import functions as F

from assay.operators import runs as R
from assay.plans.profile_q import rounded
from assay.plans.registry import query
from assay.plans.views import items, label_cells, metric_log, run_scores, table

POST = "(select run, split, score from run_scores where n % 4 <> 0)"
LOGGED = "(select run, split, score * 0.99::double as score from run_scores)"


@query("run_1_board", f"""
with v as (select run, l.split, coalesce(p.score, l.score) as value, p.score is null as fell_back from {LOGGED} l left join {POST} p using (run, split)),
w as (select run, """ + ", ".join(f"max(case when split = '{s}' then value end) as \"{s}\", coalesce(max(case when split = '{s}' and fell_back then '*' end), '') as {s}_mark" for s in ("click", "view", "error")) + """ from v group by run)
select run, round("click", 9) as "click", click_mark, round("view", 9) as "view", view_mark, round("error", 9) as "error", error_mark, row_number() over (order by "click" desc nulls last, run)::int as rank from w""")
def run_1(spark, sf):
    s = run_scores(spark, sf)
    post, logged = s.where("n % 4 <> 0"), s.selectExpr("run", "split", "score * 0.99D as score")
    return rounded(R.board([("post", post), ("log", logged)], ["click", "view", "error"], "click"))


ABC = "(select run, coalesce(max(case when split='click' then score end), 0.5::double) as a, coalesce(max(case when split='view' then score end), 0.25::double) as b, coalesce(max(case when split='error' then score end), 0.125::double) as c from run_scores group by run)"


def _docs(spark, sf):
    """Summaries of both schemas, single-stage and staged, made from each run's scores."""
    def pick(split, default):
        return F.coalesce(F.max(F.when(F.col("split") == split, F.col("score"))), F.lit(default)).cast("string")

    s = run_scores(spark, sf).groupBy("run").agg(pick("click", 0.5).alias("a"), pick("view", 0.25).alias("b"), pick("error", 0.125).alias("c"))
    flat = "concat('{\"monitor\": \"val_mean_auroc\", \"best_value\": ', a, ', \"best_metrics\": {\"mean_auroc\": ', b, '}}')"
    new = ("concat('{\"best_metrics\": {\"monitored\": \"x\", \"val500\": {\"mean_auroc\": ', c, '}, \"val19k\": {\"mean_auroc\": ', a, '}, \"val234\": {\"mean_auroc\": ', b,"
           " '}, \"extra\": {\"mean_auroc\": ', c, '}}}')")
    staged = f"case when run % 2 = 1 then concat('{{\"stages\": {{\"finetune_all\": ', {new}, ', \"last\": ', {flat}, '}}}}') else concat('{{\"stages\": {{\"first\": ', {new}, ', \"last\": ', {flat}, '}}}}') end"
    return s.selectExpr("run", f"case run % 3 when 0 then {flat} when 1 then {new} else {staged} end as doc")


IS_NEW = "(run % 3 = 1 or (run % 3 = 2 and run % 2 = 1))"


@query("run_2_summaries", f"with s as (select * from {ABC}) select run, 'val19k' as split, case when {IS_NEW} then a else b end as auroc from s union all select run, 'val200', case when {IS_NEW} then b else a end from s where {IS_NEW} or abs(a - b) > 1e-9 union all select run, 'extra', c from s where {IS_NEW}")
def run_2(spark, sf):
    return R.summary_scores(_docs(spark, sf), "run", "doc")


@query("run_2_primary", f"select run, case when run % 5 = 0 or {IS_NEW} then a else b end as auroc, run % 5 = 0 as fell_back from {ABC}")
def run_2_primary(spark, sf):
    """Summaries of which every fifth lacks its metrics and keeps only the best value."""
    docs = _docs(spark, sf).join(run_scores(spark, sf).groupBy("run").agg(F.coalesce(F.max(F.when(F.col("split") == "click", F.col("score"))), F.lit(0.5)).alias("a")), "run")
    bare = docs.selectExpr("run", "case when run % 5 = 0 then concat('{\"best_value\": ', cast(a as string), '}') else doc end as doc")
    return R.primary_scores(bare, "run", "doc")


@query("run_1_mean_board", """with m as (select run, count(distinct split) as n_tasks, avg(score) as s from run_scores group by run),
r as (select *, row_number() over (order by case when n_tasks > 1 then s end desc nulls last, run) as rn from (select run, n_tasks, round(s, 9) as s from m))
select run, n_tasks, case when n_tasks > 1 then s end as mean_score, n_tasks < 2 as omitted, case when n_tasks > 1 then rn::int end as rank from r""")
def run_1_mean(spark, sf):
    """Splits stand for tasks; runs with one of them are omitted."""
    s = run_scores(spark, sf)
    rounded_scores = s.groupBy("run").agg(F.round(F.avg("score"), 9).alias("score"), F.collect_set("split").alias("split")).select("run", "score", F.explode("split").alias("split"))
    return R.mean_board(rounded_scores, "run", "split", "score").withColumn("mean_score", F.round("mean_score", 9))


@query("run_3_stage_pick", f"select run, {IS_NEW} as keyed_by_set from {ABC}")
def run_3(spark, sf):
    return _docs(spark, sf).select("run", R.pick_stage(F.col("doc")).contains("monitored").alias("keyed_by_set"))


@query("run_4_consistency", """with t as (select run, step, metric from (select *, row_number() over (partition by run order by metric desc, step) as rn from metric_log) where rn = 1),
r as (select run, case when run % 3 = 0 then step + 1 else step end as best_step, case when run % 3 = 1 then metric + 0.5 else metric end as best_value from t)
select run, step, metric, best_step, best_value, case when step <> best_step then 'step differs' when abs(metric - best_value) > 1e-6 then 'value differs' else 'ok' end as warning from t join r using (run)""")
def run_4(spark, sf):
    from assay.operators.windows import top_n
    top = top_n(metric_log(spark, sf).select("run", "step", "metric"), ["run"], "metric", "step", 1)
    recorded = top.selectExpr("run", "case when run % 3 = 0 then step + 1 else step end as best_step", "case when run % 3 = 1 then metric + 0.5D else metric end as best_value")
    return R.consistency(top, recorded)


@query("run_5_first_match", "select p_partkey as run, case when p_size > 40 then 'high resolution' when p_name like '%1%' then 'uncertainty' when p_retailprice is null then 'unknown' else 'comparison' end as family from part")
def run_5(spark, sf):
    groups = [("high resolution", F.col("p_size") > 40), ("uncertainty", F.col("p_name").contains("1")), ("unknown", F.col("p_retailprice").isNull()), ("comparison", F.lit(True))]
    return table(spark, sf, "part").select(F.col("p_partkey").alias("run"), R.first_match(groups).alias("family"))


@query("run_6_merge_settings", """with b as (select concat('s', c_nationkey, '.k', c_custkey % 40) as path, max(c_mktsegment) as value from customer group by 1),
o as (select concat('s', s_nationkey, '.k', s_suppkey % 40) as path, max(s_name) as value from supplier where s_nationkey % 5 <> 0 and s_nationkey % 7 <> 3 group by 1
 union all select distinct concat('s', s_nationkey), null from supplier where s_nationkey % 5 = 0 union all select distinct concat('s', s_nationkey), 'off' from supplier where s_nationkey % 7 = 3 and s_nationkey % 5 <> 0),
sections as (select distinct split_part(path, '.', 1) as path from b), kept as (select * from o where value is not null or path not in (select path from sections))
select path, value from kept union all select path, value from b where path not in (select path from kept) and split_part(path, '.', 1) not in (select path from kept where value is not null)""")
def run_6(spark, sf):
    base = table(spark, sf, "customer").groupBy(F.expr("concat('s', c_nationkey, '.k', c_custkey % 40) as path")).agg(F.max("c_mktsegment").alias("value"))
    sup = table(spark, sf, "supplier")
    leaves = sup.where("s_nationkey % 5 <> 0 and s_nationkey % 7 <> 3").groupBy(F.expr("concat('s', s_nationkey, '.k', s_suppkey % 40) as path")).agg(F.max("s_name").alias("value"))
    nulls = sup.where("s_nationkey % 5 = 0").selectExpr("concat('s', s_nationkey) as path", "cast(null as string) as value").distinct()
    offs = sup.where("s_nationkey % 7 = 3 and s_nationkey % 5 <> 0").selectExpr("concat('s', s_nationkey) as path", "'off' as value").distinct()
    return R.merge_settings(base, leaves.unionByName(nulls).unionByName(offs))


@query("run_7_upsert", "with o as (select run, score from run_scores where split = 'click'), n as (select run, score as s from run_scores where split = 'view' and n % 2 = 0) select run, coalesce(s, score) as score, s is not null as refreshed from o left join n using (run)")
def run_7(spark, sf):
    s = run_scores(spark, sf)
    return R.upsert_scores(s.where("split = 'click'").select("run", "score"), s.where("split = 'view' and n % 2 = 0").select("run", "score"), "run", "score")


@query("run_8_layout", """with p as (select group_id as run, task, case when t = 2 and group_id % 2 = 0 then 'multiclass' else 'ones' end as policy, case when group_id % 3 = 0 then 5 else 7 end as n_logits from label_cells group by 1, 2, 3, 4),
g as (select run, sum(case when policy = 'multiclass' then 3 else 1 end)::bigint as width, count(*) as n_tasks, max(n_logits) as n_logits from p group by run)
select *, case when width <> n_logits then 'unknown' when n_logits = n_tasks then 'one per task' else 'mixed' end as layout from g""")
def run_8(spark, sf):
    p = label_cells(spark, sf).selectExpr("group_id as run", "task", "case when t = 2 and group_id % 2 = 0 then 'multiclass' else 'ones' end as policy", "case when group_id % 3 = 0 then 5 else 7 end as n_logits").distinct()
    return R.infer_layout(p, "run", "policy", "n_logits")


@query("run_9_alias", "select item_id, split as resolved from items")
def run_9(spark, sf):
    alias = F.when(F.col("split") == "val200", "valid200").when(F.col("split") == "test500", "t500").otherwise(F.col("split"))
    return items(spark, sf).select("item_id", R.resolve_alias(alias, ["train", "val19k", "val200", "test500"]).alias("resolved"))
