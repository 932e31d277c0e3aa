"""SPL and JN queries."""

from pyspark.sql import functions as F

from assay.functions.hashing import md5_key_sql, mix_sql, poisson_weight_sql, unit_key_sql
from assay.operators import joins as J
from assay.operators import splits as S
from assay.plans.profile_q import rounded
from assay.plans.registry import query
from assay.plans.views import MEMBERS, SPLITS, TASKS, image_sizes, items, label_cells, metric_log, predictions, run_scores, soft_labels, table, wide_labels, wide_predictions

HELD = f"""with g as (select group_id, row_number() over (order by {md5_key_sql(42, 'group_id')}) as rn, count(*) over () as n from (select distinct group_id from items)),
held as (select group_id from g where rn <= ceil(n * 0.1::double))"""
HELD_SQL = HELD + " select item_id, group_id, group_id in (select group_id from held) as held_out from items"


@query("spl_1_group_split", HELD_SQL)
def spl_1(spark, sf):
    return S.group_holdout(items(spark, sf).select("item_id", "group_id"), "group_id", 0.1, 42)


@query("spl_1_group_split_ranged", HELD_SQL)
def spl_1_ranged(spark, sf):
    """The same split with the keys ranked in ranges of about 64: the plan used for large inputs."""
    return S.group_holdout(items(spark, sf).select("item_id", "group_id"), "group_id", 0.1, 42, rows_per_range=64)


@query("spl_2_leakage", """select a.split as a, b.split as b, coalesce((select count(*) from (select distinct group_id from m where split = a.split intersect select distinct group_id from m where split = b.split)), 0) as shared
 from (values (0,'train'),(1,'val19k'),(2,'val200'),(3,'test500')) a(i, split), (values (0,'train'),(1,'val19k'),(2,'val200'),(3,'test500')) b(i, split) where a.i < b.i""".replace("select a.split as a", "with m as (select group_id, case when item_id % 50 = 0 then 'val200' else split end as split from items) select a.split as a", 1))
def spl_2(spark, sf):
    mixed = items(spark, sf).selectExpr("group_id", "case when item_id % 50 = 0 then 'val200' else split end as split")
    return S.leakage(mixed, "group_id", "split", SPLITS)


@query("spl_3_official_tag", "select item_id, case when item_id % 3 = 0 then 'train_val' when item_id % 5 = 0 then 'test' else 'MISSING' end as split from items")
def spl_3(spark, sf):
    ids = items(spark, sf).select("item_id")
    return S.tag_membership(ids, "item_id", [("train_val", ids.where("item_id % 3 = 0")), ("test", ids.where("item_id % 5 = 0"))])


@query("spl_4_split_audit", """select split, count(*) as n_rows, count(distinct group_id) as n_groups, count(*) filter (where age < 30) as n_positive, round(100.0::double * count(*) / (select count(*) from items), 9) as pct_rows,
 round(count(*) filter (where age < 30)::double / count(*), 9) as prevalence from (select split, group_id, age from items union all select 'ALL', group_id, age from items) group by split""")
def spl_4(spark, sf):
    return rounded(S.split_audit(items(spark, sf), "split", "group_id", F.col("age") < 30))


@query("spl_5_kfold", f"select item_id, cast(floor((row_number() over (order by {md5_key_sql(42, 'item_id')}) - 1) * 5.0::double / count(*) over ()) as int) as fold from items")
def spl_5(spark, sf):
    return S.kfold(items(spark, sf).select("item_id"), "item_id", 5, 42)


def _group_folds_sql(k=5, size=256, n=5):
    """The deal, one group of every bucket a step; ``have`` lists k folds of n labels and the rows."""
    counts = ", ".join(f"count(*) filter (where t{i} = 1) as c{i}" for i in range(n))
    totals = " union all ".join(f"select {i} as i, sum(c{i}) as total from h" for i in range(n))
    cell = "case l.i " + " ".join(f"when {i} then c{i}" for i in range(n)) + " end"
    return f"""with recursive h as materialized (select group_id, {md5_key_sql(42, 'group_id')} as key, count(*) as n_rows, {counts} from wide_labels group by group_id),
l as materialized (select i, row_number() over (order by total, i) - 1 as place from ({totals})),
c as (select h.group_id, min(key) as key, min(n_rows) as n_rows, coalesce(min(place) filter (where {cell} > 0), {n}) as own, list_append(list({cell} order by place), min(n_rows)) as cnt from h, l group by h.group_id),
g as materialized (select *, row_number() over (partition by bucket order by own, cnt[own + 1] desc, n_rows desc, key) as pos
 from (select *, (('0x' || substr(key, 1, 8))::bigint % ceil((select count(*) from h) / {size}.0)::bigint)::int as bucket from c)),
r(bucket, pos, group_id, fold, have) as (
 select distinct bucket, 0::bigint, null::bigint, 0, list_transform(range({k * (n + 1)}), lambda x: 0::bigint) from g
 union all
 select bucket, pos, group_id, fold, list_transform(have, lambda x, i: x + case when (i - 1) // {n + 1} = fold then cnt[(i - 1) % {n + 1} + 1] else 0 end) from (
  select g.bucket, g.pos, g.group_id, g.cnt, r.have,
   list_sort(list_transform(range({k}), lambda f: {{'a': r.have[f * {n + 1} + g.own + 1], 'b': r.have[f * {n + 1} + {n + 1}], 'c': (f + g.bucket) % {k}, 'f': f::int}}))[1].f as fold
  from r join g on g.bucket = r.bucket and g.pos = r.pos + 1))
select group_id, fold from r where pos > 0"""


def _balanced(spark, sf):
    return S.balanced_group_folds(wide_labels(spark, sf).select("item_id", "group_id", *TASKS), "group_id", TASKS, 5, 42, groups_per_bucket=256)


@query("spl_5_group_folds", f"select w.item_id, w.group_id, d.fold from wide_labels w join ({_group_folds_sql()}) d using (group_id)")
def spl_5_group_folds(spark, sf):
    """Folds of whole groups with like shares of every label."""
    return _balanced(spark, sf).select("item_id", "group_id", "fold")


@query("spl_5_fold_balance", f"select d.fold, count(*) as n_rows, count(distinct group_id) as n_groups, {', '.join(f'count(*) filter (where {t} = 1) as {t}' for t in TASKS)} from wide_labels join ({_group_folds_sql()}) d using (group_id) group by d.fold")
def spl_5_balance(spark, sf):
    """Rows, groups and positives per fold of the folds above."""
    per = _balanced(spark, sf).groupBy("fold", "group_id").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(t) == 1).alias(t) for t in TASKS])
    return per.groupBy("fold").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_groups"), *[F.sum(t).alias(t) for t in TASKS])


@query("spl_6_epoch_order", f"select item_id, position from (select item_id, row_number() over (order by {md5_key_sql(45, 'item_id')}, item_id) - 1 as position from items) where position >= 1000")
def spl_6(spark, sf):
    return S.epoch_order(items(spark, sf).select("item_id"), "item_id", 42, 3, skip=1000)


@query("spl_7_simple_sample", f"select item_id, path from items order by {md5_key_sql(42, 'item_id')} limit 200")
def spl_7(spark, sf):
    return S.simple_sample(items(spark, sf), "item_id", 200, 42).select("item_id", "path")


@query("spl_8_exact_draws", f"""
with p as (select item_id, row_number() over (order by item_id) - 1 as pos, count(*) over () as n from items),
d as (select rep, h % n as pos, count(*) as weight from (select rep, n, {mix_sql('uh', 'ul', 'rep', 'h')} from (select n, {unit_key_sql('pos', 'uh', 'ul')} from p), (select unnest(range(5))::int as rep)) group by 1, 2)
select rep, item_id, weight from d join p using (pos)""")
def spl_8(spark, sf):
    return S.exact_draws(items(spark, sf), "item_id", 5)


@query("spl_8_poisson_draws", f"select rep, count(*) as n_drawn, sum(w)::bigint as total, sum(w * w)::bigint as squares from (select rep, {poisson_weight_sql('h')} as w from (select rep, {mix_sql('uh', 'ul', 'rep', 'h')} from (select {unit_key_sql('item_id', 'uh', 'ul')} from items), (select unnest(range(20))::int as rep))) where w > 0 group by rep")
def spl_8_poisson(spark, sf):
    d = S.poisson_draws(items(spark, sf).select("item_id"), "item_id", 20)
    return d.groupBy("rep").agg(F.count(F.lit(1)).alias("n_drawn"), F.sum("weight").alias("total"), F.sum(F.col("weight") * F.col("weight")).alias("squares"))


@query("spl_8_tree_draws")
def spl_8_tree(spark, sf):
    """(rep, item_id, weight): N draws handed down a tree of ranges; tested against the moments of the multinomial."""
    return S.each_draw(S.tree_draws(items(spark, sf).select("item_id"), "item_id", 20), "item_id")


@query("spl_9_round_robin", "select item_id, (row_number() over (order by item_id) - 1) % 7 as shard from items")
def spl_9(spark, sf):
    return S.round_robin(items(spark, sf).select("item_id"), "item_id", 7)


@query("spl_10_chunks", "select item_id, (row_number() over (order by item_id) - 1) // 128 as shard from items")
def spl_10(spark, sf):
    return S.chunks(items(spark, sf).select("item_id"), "item_id", 128)


@query("spl_11_size_tier", "select image_id, case when w*h >= 150000 then 'large' when w*h >= 120000 then 'medium' else 'small' end as tier from image_sizes")
def spl_11(spark, sf):
    tiers = [(0, "small"), (120000, "medium"), (150000, "large")]
    return image_sizes(spark, sf).select("image_id", S.size_tier(F.col("w") * F.col("h"), tiers).alias("tier"))


@query("spl_12_group_sample", f"select item_id, group_id from items where group_id in (select group_id from (select distinct group_id from items) order by {md5_key_sql(42, 'group_id')} limit 50)")
def spl_12(spark, sf):
    return S.group_sample(items(spark, sf).select("item_id", "group_id"), "group_id", 50, 42)


@query("jn_1_left_first", """with d as (select path, task, prob, item_id as o from soft_labels union all select path, task, 1 - prob, item_id + 1 from soft_labels),
f as (select path, task, arg_min(prob, o) as prob from d group by 1, 2) select item_id, task, prob from label_cells left join f using (path, task)""")
def jn_1(spark, sf):
    soft = soft_labels(spark, sf).selectExpr("path", "task", "inline(array(struct(prob as prob, item_id as o), struct(1 - prob as prob, item_id + 1 as o)))")
    return J.left_first(label_cells(spark, sf), soft, ["path", "task"], "o").select("item_id", "task", "prob")


@query("jn_2_membership", "select c_custkey, c_custkey in (select o_custkey from orders where o_totalprice > 250000) as big_spender from customer")
def jn_2(spark, sf):
    big = table(spark, sf, "orders").filter("o_totalprice > 250000").selectExpr("o_custkey as c_custkey")
    return J.flag_members(table(spark, sf, "customer").select("c_custkey"), big, "c_custkey", "big_spender")


@query("jn_2_semi", "select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders)")
def jn_2_semi(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_name").join(table(spark, sf, "orders").selectExpr("o_custkey as c_custkey"), "c_custkey", "left_semi")


@query("jn_3_anti", "select doc_id, source from documents where doc_id not in (select doc_id from labels)")
def jn_3(spark, sf):
    return J.work_list(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels"), "doc_id")


@query("jn_4_manifest", "select k, case when b.k2 is null then 'missing' when a.k1 is null then 'orphan' else 'present' end as status from (select coalesce(k1, k2) as k, k1, k2 from (select distinct o_custkey as k1 from orders) a full join (select distinct c_custkey + 100 as k2 from customer) b on k1 = k2) ab left join (select distinct o_custkey as k1 from orders) a on ab.k = a.k1 left join (select distinct c_custkey + 100 as k2 from customer) b on ab.k = b.k2")
def jn_4(spark, sf):
    return J.manifest_status(table(spark, sf, "orders").selectExpr("o_custkey as k"), table(spark, sf, "customer").selectExpr("c_custkey + 100 as k"), "k")


@query("jn_5_work_list", "select count(*) as n_files, sum(kib)::bigint as total_kib from image_sizes where image_id not in (select l_partkey from lineitem where l_quantity > 49)")
def jn_5(spark, sf):
    done = table(spark, sf, "lineitem").filter("l_quantity > 49").selectExpr("l_partkey as image_id")
    return J.work_list(image_sizes(spark, sf), done, "image_id").agg(F.count(F.lit(1)).alias("n_files"), F.sum("kib").alias("total_kib"))


@query("jn_6_intersection", "select c_nationkey as nationkey from customer intersect select s_nationkey from supplier")
def jn_6(spark, sf):
    return table(spark, sf, "customer").selectExpr("c_nationkey as nationkey").intersect(table(spark, sf, "supplier").selectExpr("s_nationkey as nationkey"))


@query("jn_7_collisions", """with u as (select 'a' as source, 0 as p, l_partkey as name from lineitem where l_returnflag = 'A' union all select 'n', 1, l_partkey from lineitem where l_returnflag = 'N' union all select 'r', 2, l_partkey from lineitem where l_returnflag = 'R'),
f as (select name, source, p, count(*) as c, min(p) over (partition by name) as fp from u group by 1, 2, 3)
select source, sum(c)::bigint as n_seen, sum((p = fp)::int)::bigint as n_kept, sum(c)::bigint - sum((p = fp)::int)::bigint as n_skipped from f group by source""")
def jn_7(spark, sf):
    lines = table(spark, sf, "lineitem").selectExpr("l_partkey as name", "l_returnflag as flag")
    return J.collision_audit([(f.lower(), lines.where(f"flag = '{f}'").select("name")) for f in "ANR"], "name")


@query("jn_8_disjoint_union", "with u as (select item_id from items where split = 'train' union all select item_id from items where split in ('val19k', 'val200') union all select item_id from items where split = 'test500'), c as (select item_id, count(*) as c from u group by 1) select sum(c)::bigint as n_rows, count(*) as n_names, count(*) filter (where c > 1) as n_repeated from c")
def jn_8(spark, sf):
    i = items(spark, sf).select("item_id", "split")
    return J.duplicate_audit(i.where("split = 'train'").unionByName(i.where("split in ('val19k', 'val200')")).unionByName(i.where("split = 'test500'")), "item_id")


@query("jn_9_alignment", "select count(*) as n_cells, min(m) as least, max(m) as most, sum(c)::bigint as n_rows, sum(c) = count(*) * max(m) and min(m) = max(m) as aligned from (select item_id, task, count(distinct member) as m, count(*) as c from predictions where not (member = 'm2' and item_id % 1000 = 7) group by 1, 2)")
def jn_9(spark, sf):
    p = predictions(spark, sf).where("not (member = 'm2' and item_id % 1000 = 7)")
    return J.alignment_audit(p, "member", ["item_id", "task"])


@query("jn_10_fallback", """with s as (select run, max(case when split='click' then score end) as a, max(case when split='view' then score end) as b, max(case when split='error' then score end) as c from (select run, split, case when n % 2 = 0 or split = 'error' then score end as score from run_scores) group by run)
select run, round(coalesce(a, b, c), 9) as value, case when a is not null then 'click' when b is not null then 'view' when c is not null then 'error' end as source, case when coalesce(a, b, c) is not null then a is null end as fell_back from s where run in (select run from run_scores where split in ('click', 'view', 'error'))""")
def jn_10(spark, sf):
    s = run_scores(spark, sf).selectExpr("run", "split", "case when n % 2 = 0 or split = 'error' then score end as score")
    return rounded(J.fallback([(k, s.where(f"split = '{k}'")) for k in ("click", "view", "error")], "run", "score"))


NEAREST = """with t as (select run, step as target, event_id as id from metric_log where stage = 'purchase'), c as (select distinct run, step as s from metric_log where stage = 'view'),
r as (select t.run, t.id, t.target, c.s, row_number() over (partition by t.run, t.id order by abs(c.s - t.target), c.s) as rn from t left join c on t.run = c.run)
select run, cast(id as varchar) as id, target, s::double as chosen, (s - target)::double as gap from r where rn = 1"""


def _nearest(spark, sf, **kw):
    log = metric_log(spark, sf).selectExpr("run", "step as target", "event_id as id", "stage")
    return J.nearest(log.where("stage = 'purchase'"), log.where("stage = 'view'"), ["run"], "target", "id", **kw)


@query("jn_11_nearest", NEAREST)
def jn_11(spark, sf):
    return _nearest(spark, sf)


@query("jn_11_nearest_ranged", NEAREST)
def jn_11_ranged(spark, sf):
    """The same join with each run cut into ranges of about 20 rows: the plan used for large inputs."""
    return _nearest(spark, sf, rows_per_range=20)


@query("jn_12_distinct_nearest", """select run, rank, target, chosen, chosen - target as gap from (
with recursive t as materialized (select run, step as target, rank from (select *, row_number() over (partition by run order by metric desc, step)::int as rank from metric_log where stage <> 'view') where rank <= 5),
c as materialized (select run, list(distinct step) as steps from metric_log where stage = 'view' group by run),
r(run, rank, target, taken, chosen) as (
 select distinct run, 0, null::bigint, []::bigint[], null::bigint from t
 union all
 select run, rank, target, case when chosen is null then taken else list_append(taken, chosen) end, chosen from (
  select n.run, n.rank, n.target, n.taken, list_sort(list_transform(list_filter(coalesce(c.steps, []::bigint[]), lambda s: not list_contains(n.taken, s)), lambda s: {'d': abs(s - n.target), 's': s}))[1].s as chosen
  from (select t.run, t.rank, t.target, r.taken from r join t on t.run = r.run and t.rank = r.rank + 1) n left join c on c.run = n.run))
select * from r where rank > 0)""")
def jn_12(spark, sf):
    from assay.operators.windows import top_n
    log = metric_log(spark, sf).select("run", "step", "metric", "stage")
    best = top_n(log.where("stage <> 'view'"), ["run"], "metric", "step", 5)
    return J.assign_distinct(best.select("run", "step", "rank"), log.where("stage = 'view'"), "run", "step", "rank")


@query("jn_13_all_pairs", "with w as (select * from wide_predictions) " + " union all ".join(f"select task, '{a}' as a, '{b}' as b, round(avg(abs({a} - {b})), 9) as mean_diff from w group by task" for i, a in enumerate(MEMBERS) for b in MEMBERS[i + 1:]))
def jn_13(spark, sf):
    return rounded(J.pair_differences(wide_predictions(spark, sf), ["task"], MEMBERS))


@query("jn_14_each_view", "select item_id, view from items, (values ('v0'), ('v1'), ('v2')) v(view)")
def jn_14(spark, sf):
    return J.each_value(items(spark, sf).select("item_id"), ["v0", "v1", "v2"], "view")


@query("jn_15_step_sets", "with g as (select distinct step from metric_log where step % 5 = 0), f as (select distinct step from metric_log where stage = 'click' and step % 3 = 0) select step, step in (select step from f) as found, step in (select step from f) and step not in (select step from g) as extra from (select step from g union select step from f)")
def jn_15(spark, sf):
    log = metric_log(spark, sf).select("step", "stage")
    return J.step_sets(log.where("step % 5 = 0"), log.where("stage = 'click' and step % 3 = 0"), "step")
