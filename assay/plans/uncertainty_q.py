"""STA queries."""

from pyspark.sql import functions as F

from assay.functions.hashing import mix_sql, poisson_weight_sql, unit_key_sql
from assay.operators import ensemble as E
from assay.operators import metrics as M
from assay.operators import uncertainty as U
from assay.plans import sqltext as Q
from assay.plans.ensemble_q import FLAT
from assay.plans.profile_q import rounded
from assay.plans.registry import query
from assay.plans.views import MEMBERS, run_scores, wide_predictions

REPS = 40


def _boot_sql(src, unit, extra, reps=REPS):
    """src has task, y, prob, ``unit`` and the columns in extra."""
    keys = ", ".join(extra + ["task", "rep"])
    return f"""wts as materialized (select u, rep, {poisson_weight_sql('h')} as w from (select u, rep, {mix_sql('uh', 'ul', 'rep', 'h')} from (select u, {unit_key_sql('u', 'uh', 'ul')} from (select distinct {unit} as u from items)), (select unnest(range({reps}))::int as rep))),
h as (select {keys}, prob, sum(w * y)::double as pos, sum(w * (1 - y))::double as neg from {src} s join (select * from wts where w > 0) d on s.{unit} = d.u group by {keys}, prob),
c as (select *, coalesce(sum(neg) over (partition by {keys} order by prob rows between unbounded preceding and 1 preceding), 0) as below from h),
boot as materialized (select {keys}, case when sum(pos) > 0 and sum(neg) > 0 then sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) end as auroc from c group by {keys})"""


BLEND = f"(select item_id, group_id, task, y, {FLAT} as prob from wide_predictions)"


def _blend(spark, sf):
    return wide_predictions(spark, sf).select("item_id", "group_id", "task", "y", E.mean_of(MEMBERS).alias("prob"))


BOOT = f"with {_boot_sql(BLEND, 'item_id', [])}"


@query("sta_1_bootstrap", BOOT + " select task, rep, round(auroc, 9) as auroc from boot")
def sta_1(spark, sf):
    return rounded(U.bootstrap_auroc(_blend(spark, sf), ["task"], "item_id", REPS))


@query("sta_1_bootstrap_chunked", BOOT + " select task, rep, round(auroc, 9) as auroc from boot")
def sta_1_chunked(spark, sf):
    """The same draws with chunks of about 2000 rows, hot scores salted: the plan for large inputs."""
    return rounded(U.bootstrap_auroc(_blend(spark, sf), ["task"], "item_id", REPS, chunk_rows=2000))


@query("sta_1_bootstrap_exact", f"""
with p as (select item_id, row_number() over (order by item_id) - 1 as pos, count(*) over () as n from items),
d as (select rep, h % n as pos, count(*) as w from (select rep, n, {mix_sql('uh', 'ul', 'rep', 'h')} from (select n, {unit_key_sql('pos', 'uh', 'ul')} from p), (select unnest(range(5))::int as rep)) group by 1, 2),
h as (select task, rep, prob, sum(w * y)::double as pos, sum(w * (1 - y))::double as neg from {BLEND} s join p using (item_id) join d using (pos) group by 1, 2, 3),
c as (select *, coalesce(sum(neg) over (partition by task, rep order by prob rows between unbounded preceding and 1 preceding), 0) as below from h)
select task, rep, round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 9) as auroc from c group by 1, 2""")
def sta_1_exact(spark, sf):
    return rounded(U.bootstrap_exact(_blend(spark, sf), ["task"], "item_id", 5))


MACRO = "m as (select rep, avg(auroc) as auroc from boot group by rep)"


@query("sta_2_percentile_ci", f"""{BOOT}, {MACRO}
select round((select avg(auroc) from {Q.ranking(BLEND, ['task'])}), 9) as macro_auroc, round(quantile_cont(auroc, 0.025), 9) as low, round(quantile_cont(auroc, 0.975), 9) as high, 4::bigint as n_members from m""")
def sta_2(spark, sf):
    """Macro AUROC of the flat blend and its 95 % bootstrap interval."""
    blend = _blend(spark, sf)
    point = M.ranking_metrics(blend, ["task"]).agg(F.avg("auroc")).scalar()
    ci = U.interval(U.macro_by_rep(U.bootstrap_auroc(blend, ["task"], "item_id", REPS), []), [])
    return rounded(ci.select(point.alias("macro_auroc"), "low", "high", F.lit(len(MEMBERS)).cast("bigint").alias("n_members")))


BLOCK = f"""{BOOT}, {MACRO}, pt as (select task, auroc as point from {Q.ranking(BLEND, ['task'])}),
b as (select task, rep, auroc from boot union all select 'mean', rep, auroc from m),
p as (select * from pt union all select 'mean', avg(point) from pt), n as (select count(*) as n_units from items)
select task, n_units, round(any_value(point), 9) as point, round(quantile_cont(auroc, 0.025), 9) as low, round(quantile_cont(auroc, 0.975), 9) as high, round(stddev_samp(auroc), 9) as sd
from b join p using (task), n group by task, n_units"""


@query("sta_2_result_block", BLOCK)
def sta_2_block(spark, sf):
    """Point, interval and number of items per task and for their mean."""
    return rounded(U.result_block(_blend(spark, sf), "item_id", REPS))


@query("sta_3_spread", BOOT + " select task, round(quantile_cont(auroc, 0.025), 9) as low, round(quantile_cont(auroc, 0.975), 9) as high, round(median(auroc), 9) as median, round(stddev_samp(auroc), 9) as sd, count(*) filter (where auroc is null) as n_undefined from boot group by task")
def sta_3(spark, sf):
    return rounded(U.interval(U.bootstrap_auroc(_blend(spark, sf), ["task"], "item_id", REPS), ["task"]))


PAIRED_SRC = f"(select item_id, task, y, member, case member when 'blend' then {FLAT} else m3 end as prob from wide_predictions, (values ('blend'), ('m3')) v(member))"
PAIRED = f"""with {_boot_sql(PAIRED_SRC, 'item_id', ['member'])},
d as (select task, rep, max(case when member = 'blend' then auroc end) - max(case when member = 'm3' then auroc end) as diff from boot group by 1, 2)"""


def _paired(spark, sf):
    wide = wide_predictions(spark, sf)
    both = F.inline(F.array(F.struct(F.lit("blend").alias("member"), E.mean_of(MEMBERS).alias("prob")), F.struct(F.lit("m3").alias("member"), F.col("m3").alias("prob"))))
    boot = U.bootstrap_auroc(wide.select("item_id", "task", "y", both), ["member", "task"], "item_id", REPS)
    return U.paired_difference(boot, "member", "blend", "m3", ["task"])


@query("sta_4_paired_difference", PAIRED + " select task, round(avg(diff), 9) as mean_diff, round(quantile_cont(diff, 0.025), 9) as low, round(quantile_cont(diff, 0.975), 9) as high, avg((diff > 0)::int) as p_better, case when quantile_cont(diff, 0.025) > 0 then 'better' when quantile_cont(diff, 0.975) < 0 then 'worse' else 'within noise' end as verdict from d group by task")
def sta_4(spark, sf):
    return rounded(U.paired_summary(_paired(spark, sf), ["task"]))


@query("sta_5_verdict", PAIRED + ", m as (select rep, avg(diff) as diff from d group by rep) select case when quantile_cont(diff, 0.025) > 0 then 'better' when quantile_cont(diff, 0.975) < 0 then 'worse' else 'within noise' end as verdict, round(avg(diff), 9) as mean_diff from m")
def sta_5(spark, sf):
    macro = _paired(spark, sf).groupBy("rep").agg(F.avg("diff").alias("diff"))
    return rounded(U.paired_summary(macro, []).select("verdict", "mean_diff"))


@query("sta_6_seed_noise", "select run % 40 as config, split, count(score) as n_seeds, round(avg(score), 9) as mean, round(stddev_samp(score), 9) as sd from run_scores group by 1, 2")
def sta_6(spark, sf):
    return rounded(U.seed_noise(run_scores(spark, sf).selectExpr("run % 40 as config", "split", "score"), ["config", "split"], "score"))


SPREAD = "with s as (select run % 40 as config, split, count(score) as n, max(score) - min(score) as spread from run_scores group by 1, 2 having count(score) >= 2)"


def _spread(spark, sf):
    return U.seed_spread(run_scores(spark, sf).selectExpr("run % 40 as config", "split", "score"), ["config", "split"], "score")


@query("sta_7_noise_floor", SPREAD + " select split, count(*) as n_configs, round(min(spread), 9) as min_spread, round(max(spread), 9) as max_spread, round(avg(spread), 9) as mean_spread from s group by split")
def sta_7(spark, sf):
    return rounded(U.noise_floor(_spread(spark, sf), ["split"]))


@query("sta_8_tie_call", "with p as (select run, max(case when split = 'click' then score end) - max(case when split = 'view' then score end) as diff from run_scores group by run) select run, round(diff, 9) as diff, case when abs(diff) < 0.015 then 'tie' when diff > 0 then 'better' else 'worse' end as call from p where diff is not null")
def sta_8(spark, sf):
    side = lambda s: F.max(F.when(F.col("split") == s, F.col("score")))
    p = run_scores(spark, sf).groupBy("run").agg((side("click") - side("view")).alias("diff")).filter("diff is not null")
    return rounded(p.withColumn("call", U.tie_call(F.col("diff"), 0.015)))


@query("sta_9_group_bootstrap", f"with {_boot_sql(BLEND, 'group_id', [])}" + " select task, round(quantile_cont(auroc, 0.025), 9) as low, round(quantile_cont(auroc, 0.975), 9) as high, round(stddev_samp(auroc), 9) as sd from boot group by task")
def sta_9(spark, sf):
    """Whole groups are drawn, not rows."""
    boot = U.bootstrap_auroc(_blend(spark, sf), ["task"], "group_id", REPS)
    return rounded(U.interval(boot, ["task"]).select("task", "low", "high", "sd"))
