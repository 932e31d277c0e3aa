"""PRJ, FLT and LAB queries."""

from pyspark.sql import functions as F

from assay.operators import labels as L
from assay.plans.registry import query
from assay.plans.views import MEMBERS, TASKS, finding_sets, items, label_cells, soft_labels, table, wide_labels, wide_predictions

POLICY = {"t0": "ones", "t1": "zeros", "t2": "multiclass", "t3": "mask", "t4": "selftrained"}
POLICY_SQL = "(case task when 't0' then 'ones' when 't1' then 'zeros' when 't2' then 'multiclass' when 't3' then 'mask' else 'selftrained' end)"


def encode_sql(policy):
    return (f"(case {policy} when 'ones' then case when raw = -1 then 1 else coalesce(raw, 0) end when 'zeros' then case when raw = -1 then 0 else coalesce(raw, 0) end"
            f" when 'multiclass' then case when raw = -1 then 2 else coalesce(raw, 0) end else nullif(coalesce(raw, 0), -1) end)")


@query("prj_1_clean_columns", "select o_orderkey as item, o_custkey as owner, o_orderstatus as status, o_totalprice as price from orders")
def prj_1(spark, sf):
    df = table(spark, sf, "orders")
    return L.clean_columns(df, {"o_orderkey": "item", "o_custkey": "owner", "o_orderstatus": "status", "o_totalprice": "price"}, ["o_orderdate", "o_orderpriority"])


@query("prj_2_group_keys", r"""select item_id, nullif(regexp_extract(path, '(patient\d+)', 1), '') as patient, nullif(regexp_extract(path, '(patient\d+/study\d+)', 1), '') as study,
 nullif(regexp_extract(path, '(series\d+)', 1), '') as series from items""")
def prj_2(spark, sf):
    p = F.col("path")
    return items(spark, sf).select("item_id", L.patient_key(p).alias("patient"), L.study_key(p).alias("study"), L.extract_key(p, r"(series\d+)").alias("series"))


@query("prj_3_view", "select item_id, coalesce(case when item_id % 4 = 0 then 'Given' end, case when lower(path) like '%frontal%' then 'Frontal' when lower(path) like '%lateral%' then 'Lateral' else 'Unknown' end) as view from items")
def prj_3(spark, sf):
    given = F.when(F.col("item_id") % 4 == 0, "Given")
    return items(spark, sf).select("item_id", L.derive_view(F.col("path"), given).alias("view"))


@query("prj_4_path_remap", "select path, case when starts_with(path, 'ds/train/patient000') then concat('mnt/a', substr(path, 20)) else path end as local_path from items")
def prj_4(spark, sf):
    return items(spark, sf).select("path", L.remap_prefix(F.col("path"), "ds/train/patient000", "mnt/a").alias("local_path"))


@query("prj_5_first_base", """
with listing as (select concat('b1/', path) as file from items where item_id % 3 = 0 union all select concat('b2/', path) from items where item_id % 2 = 0),
tries as (select item_id, ord, concat(base, path) as file from items, (values (0, 'b1/'), (1, 'b2/')) b(ord, base)),
hit as (select item_id, arg_min(file, ord) as resolved from tries join listing using (file) group by 1)
select item_id, resolved from items left join hit using (item_id)""")
def prj_5(spark, sf):
    df = items(spark, sf).select("item_id", "path")
    listing = df.selectExpr("inline(array(struct(concat('b1/', path) as file, item_id % 3 = 0 as there), struct(concat('b2/', path) as file, item_id % 2 = 0 as there)))").where("there")
    return L.resolve_base(df, "item_id", "path", ["b1/", "b2/"], listing, "file").select("item_id", "resolved")


@query("prj_6_one_hot", "select item_id, " + ", ".join(f"list_contains(string_split(labels, '|'), '{c}')::int as \"{c}\"" for c in ("A", "B", "C", "No Finding")) + " from finding_sets")
def prj_6(spark, sf):
    return L.one_hot(finding_sets(spark, sf), "labels", ["A", "B", "C", "No Finding"]).drop("labels")


@query("prj_7_taxonomy", "select item_id, case label when 'A' then 'Alpha' when 'B' then 'Beta' else label end as label from (select item_id, unnest(string_split(labels, '|')) as label from finding_sets)")
def prj_7(spark, sf):
    long = finding_sets(spark, sf).select("item_id", F.explode(F.split("labels", "[|]")).alias("label"))
    return L.map_taxonomy(long, "label", {"A": "Alpha", "B": "Beta"})


@query("prj_8_finalize", "select 'official' as split, concat('images/', cast(item_id as varchar), '.png') as path, item_id, age, sex from items")
def prj_8(spark, sf):
    path = F.concat(F.lit("images/"), F.col("item_id").cast("string"), F.lit(".png"))
    return L.finalize(items(spark, sf), "official", path, ["split", "path", "item_id", "age", "sex"])


@query("prj_9_positive_list", """select item_id, coalesce(nullif(concat_ws(', ', case when t0=1 then 't0' end, case when t1=1 then 't1' end, case when t2=1 then 't2' end, case when t3=1 then 't3' end, case when t4=1 then 't4' end), ''), 'none') as positives from wide_labels""")
def prj_9(spark, sf):
    return wide_labels(spark, sf).select("item_id", L.positive_list(TASKS, "none").alias("positives"))


@query("flt_1_view_filter", "select item_id, path from items where lower(path) like '%frontal%'")
def flt_1(spark, sf):
    return items(spark, sf).filter(L.name_contains(F.col("path"), "Frontal")).select("item_id", "path")


UNSURE = "(coalesce(t0=-1,false) or coalesce(t1=-1,false) or coalesce(t2=-1,false) or coalesce(t3=-1,false) or coalesce(t4=-1,false))"


@query("flt_2_any_uncertain", f"select item_id from wide_labels where {UNSURE}")
def flt_2(spark, sf):
    return wide_labels(spark, sf).filter(L.any_uncertain(TASKS)).select("item_id")


@query("flt_3_curriculum", f"select count(*) as n, count(*) filter (where {UNSURE}) as n_uncertain, count(*) filter (where not {UNSURE}) as n_certain, true as complete from wide_labels")
def flt_3(spark, sf):
    flag = L.any_uncertain(TASKS)
    n = wide_labels(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.count_if(flag).alias("n_uncertain"), F.count_if(~flag).alias("n_certain"))
    return n.withColumn("complete", F.col("n") == F.col("n_uncertain") + F.col("n_certain"))


@query("flt_4_ranges", """select avg((w > 400 or h > 400)::int) as any_above, avg((w < 330 or h < 330)::int) as any_below, avg((w < 330 or h < 330 or w > 400 or h > 400)::int) as outside,
 avg((w between 330 and 400 and h between 330 and 400)::int) as inside from image_sizes""")
def flt_4(spark, sf):
    from assay.operators.profile import share
    from assay.plans.views import image_sizes
    w, h = F.col("w"), F.col("h")
    above, below = (w > 400) | (h > 400), (w < 330) | (h < 330)
    return share(image_sizes(spark, sf), {"any_above": above, "any_below": below, "outside": above | below, "inside": ~(above | below)})


@query("lab_1_task_layout", f"""
select k.t as pos, k.task, {POLICY_SQL} as policy, case when k.task = 't2' then 3 else 1 end as width, case when k.t > 2 then k.t + 2 else k.t end as start, count(raw) as n_labelled, count(*) filter (where raw = -1) as n_unsure
from tasks k join label_cells c using (task) group by all""")
def lab_1(spark, sf):
    return L.layout_of(label_cells(spark, sf), "mixed", POLICY)


def _encoded(name, policy):
    @query(name, f"select item_id, task, {encode_sql(repr(policy))} as y from label_cells")
    def fn(spark, sf):
        return label_cells(spark, sf).select("item_id", "task", L.encode(F.col("raw"), F.lit(policy)).alias("y"))
    return fn


for _name, _policy in (("lab_2_ones", "ones"), ("lab_3_zeros", "zeros"), ("lab_4_multiclass", "multiclass"), ("lab_5_mask", "mask")):
    _encoded(_name, _policy)


@query("lab_6_mixed", f"select item_id, {', '.join(f'max(case when task = {chr(39)}{t}{chr(39)} then y end) as {t}' for t in TASKS)} from (select item_id, task, {encode_sql(POLICY_SQL)} as y from label_cells) group by item_id")
def lab_6(spark, sf):
    # Wide in, wide out: one expression per column, so no unpivot, pivot or shuffle is needed.
    wide = wide_labels(spark, sf)
    return wide.select("item_id", *[L.encode(F.col(t), F.lit(POLICY[t])).alias(t) for t in TASKS])


SOFT2 = "(select path, task, prob, item_id as ordinal from soft_labels union all select path, task, 1 - prob, item_id + 1 from soft_labels where item_id % 5 = 0)"


def _soft_with_duplicates(spark, sf):
    soft = soft_labels(spark, sf).selectExpr("path", "task", "prob", "item_id as ordinal")
    return soft.unionByName(soft.where("ordinal % 5 = 0").selectExpr("path", "task", "1 - prob as prob", "ordinal + 1 as ordinal"))


@query("lab_7_soft_fill", f"""
with first as (select path, task, arg_min(prob, ordinal) as prob from {SOFT2} group by 1, 2),
cell as (select item_id, path, task, nullif(coalesce(raw, 0), -1) as y from label_cells where split = 'train')
select item_id, task, y is null as filled, y is null and prob is null as no_soft, coalesce(y::double, coalesce(prob, 1.0::double)) as y from cell left join first using (path, task)""")
def lab_7(spark, sf):
    cells = label_cells(spark, sf).filter(F.col("split") == "train").select("item_id", "path", "task", L.encode(F.col("raw"), F.lit("selftrained")).alias("y"))
    return L.soft_fill(cells, _soft_with_duplicates(spark, sf), ["path", "task"], "y", "ordinal").select("item_id", "task", "filled", "no_soft", "y")


@query("lab_7_soft_fill_cut", f"""
with first as (select path, task, arg_min(prob, ordinal) as prob from {SOFT2} group by 1, 2),
cell as (select item_id, path, task, nullif(coalesce(raw, 0), -1) as y from label_cells where split = 'train')
select task, count(*) filter (where y is null) as n_filled, count(*) filter (where y is null and prob is null) as n_missing,
 sum(coalesce(y::double, (coalesce(prob, 1.0::double) >= 0.6::double)::int::double)) as n_positive from cell left join first using (path, task) group by task""")
def lab_7_cut(spark, sf):
    cells = label_cells(spark, sf).filter(F.col("split") == "train").select("item_id", "path", "task", L.encode(F.col("raw"), F.lit("selftrained")).alias("y"))
    filled = L.soft_fill(cells, _soft_with_duplicates(spark, sf), ["path", "task"], "y", "ordinal", threshold=0.6)
    return filled.groupBy("task").agg(F.count_if("filled").alias("n_filled"), F.count_if("no_soft").alias("n_missing"), F.sum("y").alias("n_positive"))


OFFICIAL = {t: "mask" for t in TASKS}
TRAIN_SQL = f"(case when split = 'train' then {POLICY_SQL} else 'mask' end)"


@query("lab_8_split_policy", f"select item_id, split, task, {encode_sql(TRAIN_SQL)} as y from label_cells")
def lab_8(spark, sf):
    policy = L.split_policy(F.col("split"), F.col("task"), POLICY, OFFICIAL)
    return label_cells(spark, sf).select("item_id", "split", "task", L.encode(F.col("raw"), policy).alias("y"))


@query("lab_9_binarize", f"""select item_id, task, case when unsure then 1 else (y = 1)::int end as y, false as excluded, unsure as excluded_strict from
 (select *, case when task = 't2' then coalesce(y = 2, true) else y is null end as unsure from (select item_id, task, {encode_sql(POLICY_SQL)} as y from label_cells))""")
def lab_9(spark, sf):
    policy = L.policy_of(POLICY, F.col("task"))
    cells = label_cells(spark, sf).select("item_id", "task", policy.alias("policy"), L.encode(F.col("raw"), policy).alias("e"))
    y, excluded = L.binarize(F.col("e"), F.col("policy"))
    _, strict = L.binarize(F.col("e"), F.col("policy"), exclude_uncertain=True)
    return cells.select("item_id", "task", y.alias("y"), excluded.alias("excluded"), strict.alias("excluded_strict"))


@query("lab_10_probabilities", """
with z as (select item_id, task, m0*6-3 as z0, m1*6-3 as z1, m2*6-3 as z2 from wide_predictions),
e as (select *, exp(z0 - greatest(z0,z1,z2)) as e0, exp(z1 - greatest(z0,z1,z2)) as e1, exp(z2 - greatest(z0,z1,z2)) as e2 from z)
select item_id, task, round(1/(1+exp(-z0)), 9) as p_binary, round((e1/(e0+e1+e2)) / greatest(e1/(e0+e1+e2) + e0/(e0+e1+e2), 1e-12::double), 9) as p_three from e""")
def lab_10(spark, sf):
    z = [F.col(m) * 6 - 3 for m in MEMBERS[:3]]
    return wide_predictions(spark, sf).select("item_id", "task", F.round(L.sigmoid(z[0]), 9).alias("p_binary"), F.round(L.positive_share(*z), 9).alias("p_three"))


@query("lab_11_smoothing", f"select item_id, task, round(y * 0.95::double + 0.025::double, 9) as y from (select item_id, task, {encode_sql(repr('mask'))} as y from label_cells)")
def lab_11(spark, sf):
    y = L.encode(F.col("raw"), F.lit("mask"))
    return label_cells(spark, sf).select("item_id", "task", F.round(L.smooth(y, 0.05), 9).alias("y"))


@query("lab_13_contradictions", """select count(*) as n_normal, count(*) filter (where t1=1 or t2=1 or t3=1 or t4=1) as n_with_positive, count(*) filter (where t1=-1 or t2=-1 or t3=-1 or t4=-1) as n_with_uncertain,
 count(*) filter (where t1=1) as pos_t1, count(*) filter (where t2=1) as pos_t2, count(*) filter (where t3=1) as pos_t3, count(*) filter (where t4=1) as pos_t4 from wide_labels where t0 = 1""")
def lab_13(spark, sf):
    return L.contradictions(wide_labels(spark, sf), F.col("t0") == 1, TASKS[1:])
