"""WIN queries."""

from pyspark.sql import functions as F

from assay.functions.durations import duration_text, iso_text
from assay.functions.ordered import running, settled
from assay.operators import windows as W
from assay.plans.profile_q import rounded
from assay.plans.registry import query
from assay.plans.views import metric_log, run_scores, soft_labels

ROLL = "select run, step, round(avg(metric) over (partition by run order by step rows between 49 preceding and current row), 9) as rolling from metric_log"


@query("win_1_rolling_mean", ROLL)
def win_1(spark, sf):
    return rounded(W.rolling_mean(metric_log(spark, sf).select("run", "step", "metric"), ["run"], "step", "metric", 50).drop("metric"))


@query("win_1_rolling_mean_ranged", ROLL)
def win_1_ranged(spark, sf):
    """The same means over blocks of 60 rows with a halo: the plan used for large inputs."""
    log = metric_log(spark, sf).select("run", "step", "metric")
    return rounded(W.rolling_mean(log, ["run"], "step", "metric", 50, rows_per_range=60).drop("metric"))


@query("win_2_changes", "select * from (select run, step, stage, lag(stage) over (partition by run order by step) as previous_stage from metric_log) where stage <> previous_stage")
def win_2(spark, sf):
    return W.changes(metric_log(spark, sf).select("run", "step", "stage"), ["run"], "step", "stage")


SCORED = "(select run, step, case when step % 3 <> 0 then metric end as metric from metric_log)"


@query("win_3_delta", f"select run, step, round(metric - last_value(metric ignore nulls) over (partition by run order by step rows between unbounded preceding and 1 preceding), 9) as delta from {SCORED}")
def win_3(spark, sf):
    log = metric_log(spark, sf).selectExpr("run", "step", "case when step % 3 <> 0 then metric end as metric")
    return rounded(W.delta_to_last(log, ["run"], "step", "metric").drop("metric"))


@query("win_4_extremes", f"""with m as (select * from {SCORED} where metric is not null), r as (select *, row_number() over (partition by run order by metric desc, step) as hi, row_number() over (partition by run order by metric, step) as lo from m)
select 'max' as mode, run, step, metric from r where hi = 1 union all select 'min', run, step, metric from r where lo = 1""")
def win_4(spark, sf):
    log = metric_log(spark, sf).selectExpr("run", "step", "case when step % 3 <> 0 then metric end as metric")
    ends = [W.extreme_step(log, ["run"], "step", "metric", mode).withColumn("mode", F.lit(mode)) for mode in ("max", "min")]
    return ends[0].unionByName(ends[1])


@query("win_5_throughput", """select run, step, round(sum(images) over w / sum(wall) over w, 9) as imgs_per_s, round(100.0::double * sum(wait) over w / sum(wall) over w, 9) as wait_pct
 from (select run, step, 32.0::double as images, metric + 1 as wall, metric / 10 as wait from metric_log) window w as (partition by run order by step rows between 19 preceding and current row)""")
def win_5(spark, sf):
    log = metric_log(spark, sf).selectExpr("run", "step", "32.0D as images", "metric + 1 as wall", "metric / 10 as wait")
    return rounded(W.rolling_throughput(log, ["run"], "step", "images", "wall", "wait").select("run", "step", "imgs_per_s", "wait_pct"))


@query("win_6_top_n", """with r as (select run, step, metric, row_number() over (partition by run order by metric desc, step) as rank from metric_log)
select run, step, metric, rank::int as rank, round(metric - max(metric) over (partition by run), 9) as delta from r where rank <= 10""")
def win_6(spark, sf):
    return rounded(W.top_n(metric_log(spark, sf).select("run", "step", "metric"), ["run"], "metric", "step", 10))


@query("win_7_step_spacing", """with g as (select run, stage, step - lag(step) over (partition by run, stage order by step) as gap from metric_log), p as (select run, stage, gap, count(*) as n from g where gap is not null group by 1, 2, 3)
select run, stage, sum(n)::bigint as n_gaps, min(gap) as min_gap, arg_max(gap, (n, -gap)) as mode_gap, count(*) as n_distinct from p group by run, stage""")
def win_7(spark, sf):
    return W.step_spacing(metric_log(spark, sf).select("run", "stage", "step"), ["run", "stage"], "step")


@query("win_8_leaderboard", "select split, run, score, row_number() over (partition by split order by score desc nulls last, run)::int as rank from (select split, run, case when n % 3 = 0 then null else score end as score from run_scores)")
def win_8(spark, sf):
    return W.leaderboard(run_scores(spark, sf).selectExpr("split", "run", "case when n % 3 = 0 then null else score end as score"), "split", "run", "score")


@query("win_9_both_ends", """with r as (select task, item_id, prob, row_number() over (partition by task order by prob desc, item_id) as hi, row_number() over (partition by task order by prob, item_id) as lo from soft_labels)
select task, item_id, prob, hi::int as rank, 'top' as side from r where hi <= 3 union all select task, item_id, prob, lo::int, 'bottom' from r where lo <= 3""")
def win_9(spark, sf):
    return W.both_ends(soft_labels(spark, sf).select("task", "item_id", "prob"), ["task"], "prob", "item_id", 3).drop("delta")


BEST = """with b as (select run, step, metric, max(metric) over (partition by run order by step rows between unbounded preceding and 1 preceding) as prev from metric_log),
i as (select *, prev is null or metric > prev as improved from b), l as (select *, max(case when improved then step end) over (partition by run order by step) as best_step from i)"""
BEST_ROWS = BEST + " select run, step, improved, greatest(metric, coalesce(prev, metric)) as best, best_step, step - best_step as no_improve from l"


def _best(spark, sf, **kw):
    b = W.best_so_far(metric_log(spark, sf).select("run", "step", "metric"), ["run"], "step", "metric", **kw)
    return b.select("run", "step", "improved", "best", "best_step", "no_improve")


@query("win_10_best_so_far", BEST_ROWS)
def win_10(spark, sf):
    return _best(spark, sf)


@query("win_10_best_so_far_ranged", BEST_ROWS)
def win_10_ranged(spark, sf):
    """The same tracker with runs cut into ranges of about 20 steps: the plan used for large inputs."""
    return _best(spark, sf, rows_per_range=20)


@query("win_10_early_stop", BEST + """, s as (select run, min(case when step - best_step >= 15 then step end) as stop_step from l group by run)
select run, arg_max(greatest(metric, coalesce(prev, metric)), step) as best, arg_max(best_step, step) as best_step, max(stop_step) as stop_step from l join s using (run) where stop_step is null or step <= stop_step group by run""")
def win_10_stop(spark, sf):
    return W.early_stop(metric_log(spark, sf).select("run", "step", "metric"), ["run"], "step", "metric", 15)


@query("win_11_top_board", """with l as (select run, step // 2 as slot, arg_max(metric, step) as metric from metric_log group by 1, 2), r as (select *, row_number() over (partition by run order by metric desc, slot) as rank from l)
select run, slot, metric, rank::int as rank from r where rank <= 5""")
def win_11(spark, sf):
    log = metric_log(spark, sf).selectExpr("run", "step", "step div 2 as slot", "metric")
    return W.top_board(log, ["run"], "step", "slot", "metric", 5).drop("delta")


@query("win_12_cadence", "select run, count(*) filter (where step % 20 = 0) as n_scored, count(*) as n_all from metric_log group by run")
def win_12(spark, sf):
    return metric_log(spark, sf).groupBy("run").agg(F.count_if(W.cadence(F.col("step"), 20, 5)).alias("n_scored"), F.count(F.lit(1)).alias("n_all"))


@query("win_13_phased_cadence", "select run, step, step // 10 + 1 as epoch, case when step // 10 + 1 >= 4 then 2 else 5 end as every from metric_log where step % (case when step // 10 + 1 >= 4 then 2 else 5 end) = 0")
def win_13(spark, sf):
    log = metric_log(spark, sf).selectExpr("run", "step", "step div 10 + 1 as epoch")
    log = log.withColumn("every", W.phased_cadence(F.col("epoch"), 4, 5, 2))
    return log.filter(F.pmod("step", "every") == 0)


@query("win_14_stage_order", """select stage, first_seen, n, row_number() over (order by case stage when 'view' then 1 when 'purchase' then 2 else 3 end, first_seen, stage)::int as position
 from (select event_type as stage, min(event_id) as first_seen, count(*) as n from events group by 1)""")
def win_14(spark, sf):
    log = metric_log(spark, sf).select("stage", "event_id")
    return W.stage_order(log, "stage", "event_id", ["view", "purchase"])


@query("win_15_eta", "select run, step, round(((step - 1) * 1.5::double) / nullif(step - 1, 0) * greatest(0, 100 - (step - 1)), 9) as eta from metric_log")
def win_15(spark, sf):
    log = metric_log(spark, sf).selectExpr("run", "step", "step - 1 as done")
    return log.select("run", "step", F.round(W.eta(F.col("done") * 1.5, F.col("done"), F.lit(100)), 9).alias("eta"))


def _duration_sql(c):
    return (f"case when {c} is null then '?' when {c} < 60 then {c} || 's' when {c} < 3600 then ({c} // 60) || 'm ' || lpad(({c} % 60)::varchar, 2, '0') || 's'"
            f" when {c} < 86400 then ({c} // 3600) || 'h ' || lpad(({c} % 3600 // 60)::varchar, 2, '0') || 'm' else ({c} // 86400) || 'd ' || lpad(({c} % 86400 // 3600)::varchar, 2, '0') || 'h' end")


@query("win_15_eta_text", f"""with timed as (select run, step, ts, (epoch_us(ts) - epoch_us(min(ts) over (partition by run))) / 1e6::double as elapsed from metric_log),
 due as (select *, case when step > 1 then elapsed / (step - 1) * greatest(0, 100 - (step - 1)) end as eta from timed),
 whole as (select run, step, ts, round_even(elapsed, 0)::bigint as gone, round_even(eta, 0)::bigint as due from due)
select run, step, strftime(ts, '%Y-%m-%dT%H:%M:%S') as logged_at, {_duration_sql('gone')} as elapsed_text, {_duration_sql('due')} as eta_text from whole""")
def win_15_text(spark, sf):
    """Time since a run's first row and time left to its 100th, as text; the first step has no pace yet."""
    log = metric_log(spark, sf).select("run", "step", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("_at"))
    begins = settled(log.groupBy("run").agg(F.min("_at").alias("_begin")), "begins")
    timed = log.join(begins, "run").withColumn("elapsed", (F.col("_at") - F.col("_begin")) / F.lit(1e6))
    left = W.eta(F.col("elapsed"), F.col("step") - 1, F.lit(100))
    return timed.select("run", "step", iso_text(F.col("ts")).alias("logged_at"), duration_text(F.col("elapsed")).alias("elapsed_text"), duration_text(left).alias("eta_text"))


COUNTERS = """(select run, step, sum(32) over w as images, sum(1000000 + event_id % 7919) over w as bytes, sum(event_id % 31 + 1) over w * 1000000 as busy, sum(1 + event_id % 4) over w as elapsed
 from (select *, (step - 1) // 37 as job from metric_log) window w as (partition by run, job order by step))"""


def counter_log(spark, sf):
    """Cumulative counters of each run's jobs: every 37 steps a job ends and the next one counts from zero again."""
    log = metric_log(spark, sf).selectExpr("run", "(step - 1) div 37 as job", "step", "32L as images", "1000000 + event_id % 7919 as bytes", "(event_id % 31 + 1) * 1000000 as busy", "1 + event_id % 4 as elapsed")
    names = ["images", "bytes", "busy", "elapsed"]
    before = running(log, ["run", "job"], "step", {f"_b_{c}": ("sum", c) for c in names})
    return before.select("run", "step", *[(F.col(f"_b_{c}") + F.col(c)).cast("double").alias(c) for c in names])


GAINS = f"""with p as (select *, lag(images) over w as pi, lag(bytes) over w as pb, lag(busy) over w as pn, lag(elapsed) over w as pe from {COUNTERS} window w as (partition by run order by step)),
g as (select run, step, case when images < pi then images else images - coalesce(pi, 0) end::double as i, case when bytes < pb then bytes else bytes - coalesce(pb, 0) end::double as b,
 case when busy < pn then busy else busy - coalesce(pn, 0) end::double as n, case when elapsed < pe then elapsed else elapsed - coalesce(pe, 0) end::double as e from p)
select run, step, round(i / nullif(e, 0), 9) as images_per_s, round(b / 1e6::double / nullif(e, 0), 9) as mb_per_s, round(n / 1e6::double / nullif(i, 0), 9) as ms_per_image from g"""


def rates(gains):
    named = W.retrieval_rates(gains, "images", "bytes", "busy", "elapsed")
    return named.select("run", "step", *[F.round(c, 9).alias(c) for c in ("images_per_s", "mb_per_s", "ms_per_image")])


@query("win_5_counter_rates", GAINS)
def win_5_counters(spark, sf):
    """Counters differenced over the whole log, across restarts."""
    return rates(W.counter_gains(counter_log(spark, sf), ["run"], "step", ["images", "bytes", "busy", "elapsed"]))


PHASED_COLUMNS = ["run", "step", "metric", "case when step <= 20 then 0 else 1 end as phase", "case when step % 3 <> 0 then metric / 2 end as val19k", "case when step % 4 = 0 then metric / 4 end as val200"]
PATIENCE = 15
PHASED = f"""with p as (select {', '.join(PHASED_COLUMNS)} from metric_log),
b as (select *, max(metric) over (partition by run order by step rows between unbounded preceding and 1 preceding) as prev from p),
l as (select *, max(case when prev is null or metric > prev then step end) over w as best_step, greatest(metric, coalesce(prev, metric)) as best, min(step) over (partition by run, phase) as begun,
 max(case when val19k is not null then step end) over w as s19, max(case when val200 is not null then step end) over w as s200 from b window w as (partition by run order by step)),
s as (select run, min(case when phase >= 1 and step - greatest(best_step, begun - 1) >= {PATIENCE} then step end) as stop_step, max(step) as last_step from l group by run),
e as (select l.run, best, l.best_step, stop_step from l join s on l.run = s.run and step = coalesce(stop_step, last_step))
select e.run, e.best, e.best_step, stop_step, val19k, s19 as val19k_last_step, val200, s200 as val200_last_step from e join l on l.run = e.run and l.step = e.best_step"""


@query("win_10_phased_tracker", PHASED)
def win_10_phased(spark, sf):
    """Warm-up steps cannot stop a run, patience begins anew after them, and the sets' values at the best step are kept."""
    log = metric_log(spark, sf).selectExpr(*PHASED_COLUMNS)
    return W.phased_tracker(log, ["run"], "step", "metric", PATIENCE, "phase", 1, ["val19k", "val200"])
