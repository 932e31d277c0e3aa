"""ENS queries."""

from pyspark.sql import functions as F

from assay.functions.hashing import md5_key_sql
from assay.functions.ordered import settled
from assay.operators import ensemble as E
from assay.operators import metrics as M
from assay.operators.splits import kfold
from assay.plans import sqltext as Q
from assay.plans.metrics_q import REPORT, SPECIALIST, SPECIALIST_SQL
from assay.plans.profile_q import rounded
from assay.plans.registry import query
from assay.plans.views import MEMBERS, TASKS, predictions, table, wide_predictions
from assay.session import small_table

CELL = ["item_id", "task"]
FLAT = "((m0 + m1 + m2 + m3) / 4)"


@query("ens_1_flat_blend", "select item_id, task, y, round(avg(prob), 9) as prob from predictions group by all")
def ens_1(spark, sf):
    return rounded(E.flat_blend(predictions(spark, sf), CELL))


LOGIT = "ln(least(greatest({0}, 1e-6::double), 1 - 1e-6::double) / (1 - least(greatest({0}, 1e-6::double), 1 - 1e-6::double)))"
RANK = "(rank() over (partition by member, task order by prob) + (count(*) over (partition by member, task, prob) - 1) / 2.0::double) / count(*) over (partition by member, task)"


@query("ens_2_spaces", f"select item_id, task, member, round({LOGIT.format('prob')}, 9) as x_logit, round({RANK}, 9) as x_rank from predictions")
def ens_2(spark, sf):
    p = predictions(spark, sf).select("item_id", "task", "member", "prob", F.col("prob").alias("x_rank"))
    x = E.to_space(E.to_space(p, "rank", ["member", "task"], "x_rank"), "logit", ["member", "task"])
    return rounded(x.select("item_id", "task", "member", F.col("prob").alias("x_logit"), "x_rank"))


@query("ens_3_back_to_prob", f"select item_id, task, round(1 / (1 + exp(-avg({LOGIT.format('prob')}))), 9) as prob from predictions group by 1, 2")
def ens_3(spark, sf):
    x = E.flat_blend(E.to_space(predictions(spark, sf), "logit", ["member", "task"]), CELL)
    return rounded(x.select("item_id", "task", E.from_space(F.col("prob"), "logit").alias("prob")))


# Blending weights of the example; task t4 has none above zero.
WEIGHTS = {t: ([0.0] * 4 if t == "t4" else [1.0 + i, 2.0, 0.5 * i, 1.0]) for i, t in enumerate(TASKS)}
WEIGHT_ROWS = ", ".join(f"('{t}', '{m}', {w}::double)" for t, ws in WEIGHTS.items() for m, w in zip(MEMBERS, ws))


@query("ens_4_weighted_blend", f"""select item_id, task, y, round(case when sum(w) > 0 then sum(w * prob) / sum(w) else avg(prob) end, 9) as prob from predictions join (select * from (values {WEIGHT_ROWS}) x(task, member, w)) using (task, member) group by all""".replace("group by all", "group by item_id, task, y"))
def ens_4(spark, sf):
    rows = [(t, m, w) for t, ws in WEIGHTS.items() for m, w in zip(MEMBERS, ws)]
    weights = small_table(spark, rows, "task string, member string, w double")
    return rounded(E.weighted_blend(predictions(spark, sf), weights, CELL))


def _aligned(spark, sf):
    """One row per cell with a column per member, out of the long predictions."""
    return E.aligned(predictions(spark, sf).select(*CELL, "member", "y", "prob"), CELL, MEMBERS)


@query("ens_0_aligned_members", "select item_id, task, y, m0, m1, case when item_id % 1000 <> 7 then m2 end as m2, m3, item_id % 1000 <> 7 as aligned from wide_predictions")
def ens_0(spark, sf):
    """Long predictions made wide; cells that a member misses are told apart."""
    p = predictions(spark, sf).where("not (member = 'm2' and item_id % 1000 = 7)")
    return E.aligned(p, CELL, MEMBERS, strict=False)


TREE = ("prob", [("logit", ["m0", "m1"]), ("rank", ["m2", "m3"]), "m1"])
NESTED = f"""
with g as (select item_id, task, y, m1, 1 / (1 + exp(-(({LOGIT.format('m0')} + {LOGIT.format('m1')}) / 2))) as a,
 (((rank() over (partition by task order by m2) + (count(*) over (partition by task, m2) - 1) / 2.0::double) / count(*) over (partition by task))
 + ((rank() over (partition by task order by m3) + (count(*) over (partition by task, m3) - 1) / 2.0::double) / count(*) over (partition by task))) / 2 as b from wide_predictions)
select item_id, task, y, round((a + b + m1) / 3, 9) as prob from g"""


@query("ens_5_nested_blend", NESTED)
def ens_5(spark, sf):
    wide = _aligned(spark, sf)
    return rounded(E.nested_blend(wide, TREE, ["task"], "prob").select("item_id", "task", "y", "prob"))


@query("ens_6_labels", """select r_regionkey as node, case when r_regionkey % 2 = 0 then 'avg(' else 'avg-logit(' end || string_agg(n_name, ' + ' order by n_nationkey) || ')' as label, count(*) - count(distinct n_name) as n_twice
 from nation join region on n_regionkey = r_regionkey group by r_regionkey""")
def ens_6(spark, sf):
    """Labels of the groups in a member table: children in order, and repeated members counted."""
    tree = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    space = F.when(F.col("r_regionkey") % 2 == 0, "prob").otherwise("logit")
    return E.label_groups(tree.withColumn("space", space), "r_regionkey", "space", "n_name", "n_nationkey").withColumnRenamed("r_regionkey", "node")


@query("ens_7_specialist_member", f"select item_id, task, 'specialists' as member, y, prob from predictions where member = {SPECIALIST_SQL}")
def ens_7(spark, sf):
    return E.specialist_member(predictions(spark, sf), SPECIALIST, "specialists").select("item_id", "task", "member", "y", "prob")


UNITS = 4
LATTICE = "(select a.u as u0, b.u as u1, c.u as u2, 4 - a.u - b.u - c.u as u3 from (select unnest(range(5))::int as u) a, (select unnest(range(5))::int as u) b, (select unnest(range(5))::int as u) c where a.u + b.u + c.u <= 4)"
SCORE = "((u0 * m0 + u1 * m1 + u2 * m2 + u3 * m3) / 4)"


@query("ens_8_weight_lattice", f"select u0, u1, u2, u3, count(*) as n_cells, round(avg({SCORE}), 9) as mean_blend from wide_predictions, {LATTICE} group by 1, 2, 3, 4")
def ens_8(spark, sf):
    """Every weight vector, with the mean blend it gives over all cells."""
    each = E.each_lattice_vector(wide_predictions(spark, sf).select(*MEMBERS), 4, UNITS)
    return rounded(each.groupBy("u0", "u1", "u2", "u3").agg(F.count(F.lit(1)).alias("n_cells"), F.avg(E.lattice_blend(MEMBERS, UNITS)).alias("mean_blend")))


FOLDS = 5
FOLD_SQL = f"(select item_id, cast(floor((row_number() over (order by {md5_key_sql(42, 'item_id')}) - 1) * 5.0::double / count(*) over ()) as int) as fold from items)"


def _search_sql():
    per = ", ".join(f"sum((fold <> {f})::int * y)::double as p{f}, sum((fold <> {f})::int * (1 - y))::double as n{f}" for f in range(FOLDS))
    below = ", ".join(f"coalesce(sum(n{f}) over w, 0) as b{f}" for f in range(FOLDS))
    aucs = " union all ".join(f"select task, {f} as fold, u0, u1, u2, u3, sum(p{f} * (b{f} + n{f} / 2)) / (sum(p{f}) * sum(n{f})) as auroc from s group by task, u0, u1, u2, u3" for f in range(FOLDS))
    dist = "+".join(f"(4*u{i}-4)*(4*u{i}-4)" for i in range(4))
    return f"""with f as (select task, y, fold, m0, m1, m2, m3 from wide_predictions join {FOLD_SQL} using (item_id)),
h as (select task, u0, u1, u2, u3, {SCORE} as score, {per} from f, {LATTICE} group by 1, 2, 3, 4, 5, 6),
s as materialized (select *, {below} from h window w as (partition by task, u0, u1, u2, u3 order by score rows between unbounded preceding and 1 preceding)),
a as ({aucs}), near as (select *, max(auroc) over (partition by task, fold) as top from a),
best as (select *, row_number() over (partition by task, fold order by {dist}, u0, u1, u2, u3) as rn from near where auroc >= top - 1e-9::double)
"""


def _folded(spark, sf):
    return kfold(settled(_aligned(spark, sf), "aligned"), "item_id", FOLDS, 42)


@query("ens_9_grid_search", _search_sql() + "select task, fold, round(auroc, 9) as auroc, u0 / 4.0::double as m0, u1 / 4.0::double as m1, u2 / 4.0::double as m2, u3 / 4.0::double as m3 from best where rn = 1")
def ens_9(spark, sf):
    return rounded(E.grid_search(_folded(spark, sf), MEMBERS, UNITS, "fold", FOLDS))


def _greedy_sql(rounds=4):
    """The rounds unrolled: candidates, their distinct vectors, scores per fold, and the pick."""
    per = ", ".join(f"sum((fold <> {f})::int * y)::double as p{f}, sum((fold <> {f})::int * (1 - y))::double as n{f}" for f in range(FOLDS))
    below = ", ".join(f"coalesce(sum(n{f}) over w, 0) as b{f}" for f in range(FOLDS))
    vec, parts = "c0, c1, c2, c3", []
    for r in range(1, rounds + 1):
        plus = ", ".join(f"c{i} + (i = {i})::int as c{i}" for i in range(4))
        aucs = " union all ".join(f"select task, {f} as fold, {vec}, case when sum(p{f}) > 0 and sum(n{f}) > 0 then sum(p{f} * (b{f} + n{f} / 2)) / (sum(p{f}) * sum(n{f})) end as auroc from s{r} group by task, {vec}" for f in range(FOLDS))
        parts.append(f"""k{r} as (select task, fold, i, {plus}, case i when 0 then c0 when 1 then c1 when 2 then c2 else c3 end as own from r{r - 1}, (select unnest(range(4))::int as i)),
h{r} as (select f.task, {vec}, c0 * m0 + c1 * m1 + c2 * m2 + c3 * m3 as score, {per} from f join (select distinct task, {vec} from k{r}) using (task) group by 1, 2, 3, 4, 5, 6),
s{r} as materialized (select *, {below} from h{r} window w as (partition by task, {vec} order by score rows between unbounded preceding and 1 preceding)),
p{r} as (select k.*, a.auroc, max(a.auroc) over (partition by k.task, k.fold) as top from k{r} k join ({aucs}) a using (task, fold, {vec})),
r{r} as materialized (select task, fold, {vec}, top from (select *, row_number() over (partition by task, fold order by own, i) as rn from p{r} where auroc >= top - 1e-9::double) where rn = 1)""")
    return f"""with f as materialized (select task, y, fold, m0, m1, m2, m3 from wide_predictions join {FOLD_SQL} using (item_id)),
r0 as (select distinct task, fold, 0 as c0, 0 as c1, 0 as c2, 0 as c3 from f),
{', '.join(parts)}
select task, fold, round(top, 9) as auroc, {', '.join(f'c{i} / {rounds}.0::double as m{i}' for i in range(4))} from r{rounds}"""


@query("ens_10_greedy", _greedy_sql())
def ens_10(spark, sf):
    return rounded(E.greedy_search(_folded(spark, sf), MEMBERS, 4, "fold", FOLDS, TASKS))


# Weights per task and fold as the search finds them.
FOUND = _search_sql() + f"""select * from (select task, fold, {', '.join(f'u{i} / 4.0::double as w{i}' for i in range(4))} from best where rn = 1)"""
WITH_FOUND = f"with fw as materialized ({FOUND})"
BLENDED = f"(select task, fold, y, w0 * m0 + w1 * m1 + w2 * m2 + w3 * m3 as prob from wide_predictions join {FOLD_SQL} using (item_id) join fw using (task, fold))"
MEAN_W = "(select task, avg(w0) as a0, avg(w1) as a1, avg(w2) as a2, avg(w3) as a3 from fw group by task)"


def _searched(spark, sf):
    """Folded rows, equal ones counted, and the weights that the grid search finds on them."""
    rows = E.counted_rows(_folded(spark, sf), MEMBERS, "fold", "y")
    return rows, settled(E.grid_search(rows, MEMBERS, UNITS, "fold", FOLDS, counted=True).select("task", "fold", *MEMBERS), "weights")


@query("ens_11_out_of_fold", f"{WITH_FOUND} select task, round(avg(auroc), 9) as oof_auroc from {Q.ranking(BLENDED, ['task', 'fold'])} group by task")
def ens_11(spark, sf):
    rows, found = _searched(spark, sf)
    return rounded(E.out_of_fold(rows, found, MEMBERS, "fold", weight="_rows"))


@query("ens_12_fold_average", f"{WITH_FOUND} " + " union all ".join(f"select task, 'm{i}' as member, round(a{i}, 9) as w from {MEAN_W}" for i in range(4)))
def ens_12(spark, sf):
    return rounded(E.fold_average(_searched(spark, sf)[1], MEMBERS))


MEAN_BLEND = f"(select p.task, p.y, a0 * m0 + a1 * m1 + a2 * m2 + a3 * m3 as prob from wide_predictions p join {MEAN_W} using (task))"


@query("ens_13_search_summary", f"""{WITH_FOUND} select task, round(oof, 9) as oof_auroc, round(i.auroc, 9) as in_sample, round(f.auroc, 9) as flat, round(oof - f.auroc, 9) as gain
 from (select task, avg(auroc) as oof from {Q.ranking(BLENDED, ['task', 'fold'])} group by task) join {Q.ranking(MEAN_BLEND, ['task'])} i using (task) join {Q.ranking(f'(select task, y, {FLAT} as prob from wide_predictions)', ['task'])} f using (task)""")
def ens_13(spark, sf):
    rows, found = _searched(spark, sf)
    return rounded(E.search_summary(rows, found, MEMBERS, "fold", weight="_rows"))


CUT = [m for m in REPORT if m in ("f1", "precision", "recall", "specificity")]


@query("ens_14_rank_nulling", "select member, task, case when member in ('m0', 'm2') then 'rank' else 'prob' end as space, round(auroc, 9) as auroc, round(auprc, 9) as auprc, "
       + ", ".join(f"case when member not in ('m0', 'm2') then round({m}, 9) end as {m}" for m in CUT) + f" from {Q.report('(select *, 0.5::double as threshold from predictions)', ['member', 'task'])}")
def ens_14(spark, sf):
    rep = M.report(M.with_threshold(predictions(spark, sf), 0.5, []), ["member", "task"])
    rep = rep.withColumn("space", F.when(F.col("member").isin("m0", "m2"), "rank").otherwise("prob"))
    return rounded(E.null_threshold_metrics(rep, F.col("space")).select("member", "task", "space", "auroc", "auprc", *CUT))


VAL_FLAT = f"(select task, y, {FLAT} as prob from wide_predictions where split = 'val19k')"
TEST_FLAT = f"(select b.task, b.y, {FLAT} as prob, c.threshold from wide_predictions b join {Q.best_f1(VAL_FLAT, ['task'])} c using (task) where b.split = 'test500')"


@query("ens_14_blend_evaluation", f"""select task, {', '.join(f'round({m}, 9) as {m}' for m in ('auroc', 'auprc', 'f1', 'precision', 'recall', 'specificity', 'threshold'))}, n_pos, round(members_auroc, 9) as members_auroc
 from {Q.report(TEST_FLAT, ['task'])} join (select task, avg(auroc) as members_auroc from {Q.ranking("(select * from predictions where split = 'test500')", ['member', 'task'])} group by task) using (task)""")
def ens_14_blend(spark, sf):
    """A flat blend with cuts frozen on the validation split, scored on the test split."""
    p = predictions(spark, sf)
    flat = E.flat_blend(p, ["item_id", "task", "split"])
    cuts = M.best_f1(flat.where("split = 'val19k'"), ["task"])
    out = E.evaluate_blend(flat.where("split = 'test500'"), cuts, p.where("split = 'test500'"), "prob")
    return rounded(out.select("task", "auroc", "auprc", "f1", "precision", "recall", "specificity", "threshold", "n_pos", "members_auroc"))


ORDERED = f"(select member, row_number() over (order by avg(auroc) desc, member) as rk from {Q.ranking('predictions', ['member', 'task'])} group by member)"


def _sweep_sql():
    # Members are ranked m3 > m2 > m1 > m0 only if the data say so: the order is joined in.
    ranks = ", ".join(f"(rank() over (partition by task order by {m}) + (count(*) over (partition by task, {m}) - 1) / 2.0::double) / count(*) over (partition by task) as r{m[1]}" for m in MEMBERS)
    def pick(kind, pos):
        forms = {"prob": "m{0}", "logit": LOGIT.format("m{0}"), "rank": "r{0}"}[kind]
        return "(case (select member from ordered where rk = %d) " % pos + " ".join(f"when 'm{i}' then {forms.replace('{0}', str(i))}" for i in range(4)) + " end)"
    cells = " union all ".join(f"select {k} as k, '{s}' as space, task, y, ({' + '.join(pick(s, p) for p in range(1, k + 1))}) / {k} as prob from r" for k in range(1, 5) for s in E.SPACES)
    return f"""with ordered as materialized (select * from {ORDERED}), r as materialized (select task, y, m0, m1, m2, m3, {ranks} from wide_predictions), c as ({cells}),
 m as (select k, space, avg(auroc) as a from {Q.ranking('c', ['k', 'space', 'task'])} group by 1, 2)
select k, space, round(a, 9) as mean_auroc, row_number() over (order by round(a, 9) desc, k, space desc) = 1 as is_best from m"""


@query("ens_15_topk_sweep", _sweep_sql())
def ens_15(spark, sf):
    per = M.macro(M.ranking_metrics(predictions(spark, sf), ["member", "task"]), ["member"], ["auroc"])
    ordered = [r["member"] for r in per.orderBy(F.desc("mean_auroc"), "member").collect()]  # one row per member
    return rounded(E.topk_sweep(_aligned(spark, sf), ordered))


R4 = ", ".join(f"rank() over (partition by task order by {m}) + (count(*) over (partition by task, {m}) - 1) / 2.0::double as {m}" for m in MEMBERS)
PAIRS = f"with r as (select task, {R4} from wide_predictions), p as (" + " union all ".join(f"select '{a}' as a, '{b}' as b, avg(c) as corr from (select task, corr({a}, {b}) as c from r group by task)" for i, a in enumerate(MEMBERS) for b in MEMBERS[i + 1:]) + ")"


@query("ens_16_member_correlation", PAIRS + ", o as (select *, row_number() over (order by round(corr, 9) desc, a, b) as hi, row_number() over (order by round(corr, 9), a, b) as lo from p) select a, b, round(corr, 9) as corr, case when hi <= 2 then 'closest' else 'most different' end as side from o where hi <= 2 or lo <= 2")
def ens_16(spark, sf):
    pairs = rounded(E.member_correlation(_aligned(spark, sf), MEMBERS))
    close = pairs.orderBy(F.desc("corr"), "a", "b").limit(2).withColumn("side", F.lit("closest"))
    far = pairs.orderBy("corr", "a", "b").limit(2).withColumn("side", F.lit("most different"))
    return close.unionByName(far)


@query("ens_16_mean_correlation", PAIRS + " select member, round(avg(corr), 9) as mean_corr from (select a as member, corr from p union all select b, corr from p) group by member")
def ens_16_mean(spark, sf):
    return rounded(E.mean_correlation(E.member_correlation(_aligned(spark, sf), MEMBERS)))


@query("ens_17_view_average", """with v as (select item_id, task, member, y, prob * (1 - 0.01::double * v) as prob from predictions, (select unnest(range(3))::int as v)),
a as (select item_id, task, member, avg(prob) as prob from v group by 1, 2, 3) select item_id, task, round(avg(prob), 9) as prob from a group by 1, 2""")
def ens_17(spark, sf):
    views = predictions(spark, sf).select("item_id", "task", "member", "y", F.explode(F.array(*[F.col("prob") * (1 - F.lit(0.01) * v) for v in range(3)])).alias("prob"))
    per_member = E.view_average(views, ["item_id", "task", "member"], together=CELL)
    return rounded(E.flat_blend(per_member, CELL, carry=[]))


@query("ens_18_promotions", """with h as (select event_type as split, row_number() over (partition by event_type order by ts, event_id) as run_no, event_id, value from events),
w as (select *, max(value) over (partition by split order by run_no rows between unbounded preceding and 1 preceding) as prev from h where event_id % 3 <> 0)
select split, run_no, value as best from w where prev is null or value > prev""")
def ens_18(spark, sf):
    from assay.functions.ordered import row_index
    h = table(spark, sf, "events").selectExpr("event_type as split", "struct(ts, event_id) as at", "event_id", "value")
    h = row_index(h, ["split"], "at", "i").selectExpr("split", "i + 1 as run_no", "event_id", "value")
    return E.promotions(h, "split", "run_no", "value", F.col("event_id") % 3 != 0).select("split", "run_no", "best")
