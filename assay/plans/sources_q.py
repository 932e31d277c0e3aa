"""SRC and SNK queries: tables are written to the shared folder and read back."""

from pyspark.sql import functions as F

from assay.operators import metrics as M
from assay.plans import sqltext as Q
from assay.plans.metrics_q import HALF, MST, REPORT
from assay.plans.profile_q import rounded
from assay.plans.registry import query
from assay.plans.views import MEMBERS, TASKS, items, metric_log, predictions, table, wide_labels
from assay.session import fresh_path
from assay.sources import readers as S
from assay.sources import sinks as K

LABEL_SCHEMA = "item_id bigint, path string, t0 int, t1 int, t2 int, t3 int, t4 int"


@query("src_1_label_table", "select item_id, path, t0, t1, t2, t3, t4 from wide_labels")
def src_1(spark, sf):
    path = fresh_path(spark, "labels")
    wide_labels(spark, sf).select("item_id", "path", *TASKS).write.csv(path, header=True, nullValue="")
    return S.read_label_table(spark, path, LABEL_SCHEMA)


@query("src_2_optional", "select 'orders' as name, count(*) as n from orders union all select 'absent', 0")
def src_2(spark, sf):
    schema = "o_orderkey bigint, o_custkey bigint"
    here = S.read_optional(spark, f"{sf}/orders.parquet", schema)
    gone = S.read_optional(spark, f"{sf}/absent.parquet", schema)
    n = F.count(F.lit(1)).alias("n")
    return here.agg(n).select(F.lit("orders").alias("name"), "n").unionByName(gone.agg(n).select(F.lit("absent").alias("name"), "n"))


@query("src_3_tokens", "select distinct o_orderpriority_word as token from (select unnest(string_split(regexp_replace(o_orderpriority, '\\s+', ' ', 'g'), ' ')) as o_orderpriority_word from orders) where o_orderpriority_word <> ''")
def src_3(spark, sf):
    path = fresh_path(spark, "tokens")
    table(spark, sf, "orders").select(F.concat(F.lit("  "), F.regexp_replace("o_orderpriority", " ", "  "), F.lit("\t"))).write.text(path)
    return S.read_tokens(spark, path)


def _reports(spark, sf):
    path = fresh_path(spark, "reports")
    df = M.with_threshold(predictions(spark, sf), 0.5, [])
    per = M.report(df, MST, excluded="uncertain").withColumnRenamed("member", "run")
    K.write_reports(per, M.macro(per, ["run", "split"]), path, [*REPORT, "n_pos", "n_excluded"])
    return path


@query("src_4_reports", f"select member as run, split, task, {Q.r9(*REPORT)}, n_pos, n_excluded from {Q.report(HALF, MST, keep='not uncertain')}")
def src_4(spark, sf):
    return rounded(S.read_reports(spark, _reports(spark, sf)))


@query("src_4_macro", f"select member as run, split, round(avg(auroc), 9) as mean_auroc from {Q.report(HALF, MST, keep='not uncertain')} group by 1, 2")
def src_4_macro(spark, sf):
    return rounded(S.read_macro(spark, _reports(spark, sf), "mean_auroc"))


@query("src_5_thresholds", f"select member as run, task, round(threshold, 9) as threshold from {Q.best_f1('predictions', ['member', 'task'])} where member <> 'm3'")
def src_5(spark, sf):
    path = fresh_path(spark, "thresholds")
    cuts = M.best_f1(predictions(spark, sf), ["member", "task"]).where("not (member = 'm3' and task = 't4')")
    docs = cuts.groupBy(F.col("member").alias("run")).agg(F.map_from_entries(F.collect_list(F.struct("task", "threshold"))).alias("thresholds"))
    docs.write.partitionBy("run").json(path)
    return rounded(S.read_thresholds(spark, path, TASKS))


@query("src_6_weights", """with w as (select split as run, task, member, avg(prob) as w from predictions group by 1, 2, 3)
select run, task, member, round(case when run = 'test500' then 0.25::double else w end, 9) as w from w""")
def src_6(spark, sf):
    path = fresh_path(spark, "weights")
    p = predictions(spark, sf).groupBy(F.col("split").alias("run"), "task", "member").agg(F.avg("prob").alias("w"))
    per = p.groupBy("run", "task").agg(F.map_from_entries(F.collect_list(F.struct("member", "w"))).alias("m"))
    maps = per.groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("task", "m"))).alias("w"))
    docs = maps.select(
        "run", F.lit("prob").alias("combine_space"), F.array(*[F.lit(m) for m in MEMBERS]).alias("members"),
        F.when(F.col("run").isin("train", "val19k"), F.col("w")).alias("weights_per_class"), F.when(F.col("run") == "val200", F.col("w")).alias("class_weights"),
    )
    docs.write.partitionBy("run").json(path)
    return rounded(S.read_weights(spark, path, TASKS, space="prob"))


LOG_SCHEMA = "run bigint, step bigint, epoch bigint, mean_auroc double, val_loss double"


@query("src_7_metric_log", "select run, step, step // 10 as epoch, metric as mean_auroc from metric_log where step % 4 <> 0")
def src_7(spark, sf):
    path = fresh_path(spark, "val_log")
    metric_log(spark, sf).selectExpr("run", "step", "step div 10 as epoch", "case when step % 4 <> 0 then metric end as mean_auroc", "metric as val_loss").write.csv(path, header=True)
    return S.read_metric_log(spark, path, LOG_SCHEMA, "mean_auroc")


@query("src_8_file_tree", "select p_brand as brand, count(*) as n_parts, true as has_files, true as sized from part group by p_brand")
def src_8(spark, sf):
    """A tree with a folder per brand, written from the parts; its entries (names and sizes, contents unread) meet the parts by brand."""
    path = fresh_path(spark, "tree")
    parts = table(spark, sf, "part")
    parts.select("p_brand", "p_partkey", "p_name").write.partitionBy("p_brand").parquet(path)
    files = S.list_files(spark, path, "*.parquet").select(F.url_decode(F.regexp_extract("path", r"p_brand=([^/]+)/", 1)).alias("brand"), "length")
    tree = files.groupBy("brand").agg(F.count(F.lit(1)).alias("n_files"), F.min("length").alias("least"))
    listed = parts.groupBy(F.col("p_brand").alias("brand")).agg(F.count(F.lit(1)).alias("n_parts")).join(tree, "brand", "full")
    return listed.select("brand", "n_parts", (F.coalesce("n_files", F.lit(0)) > 0).alias("has_files"), F.coalesce(F.col("least") > 0, F.lit(False)).alias("sized"))


@query("src_9_cache_misses", "select distinct split, member from predictions where not (split in ('train', 'val19k') and member in ('m0', 'm1'))")
def src_9(spark, sf):
    p = predictions(spark, sf).select("split", "member")
    return S.missing_predictions(p, p.where("split in ('train', 'val19k') and member in ('m0', 'm1')"), ["split", "member"])


@query("src_9_cache_fill", "select split, member, count(*) as n, round(sum(prob), 6) as total from predictions group by 1, 2")
def src_9_fill(spark, sf):
    """Two partitions are cached beforehand; only the others are scored."""
    path = fresh_path(spark, "cache")
    p = predictions(spark, sf).select("item_id", "task", "prob", "split", "member")
    p.where("split = 'train' and member in ('m0', 'm1')").write.partitionBy("split", "member").parquet(path)
    schema = "item_id bigint, task string, prob double, split string, member string"
    full = S.fill_predictions(spark, path, p, lambda todo: todo, schema)
    return full.groupBy("split", "member").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("prob"), 6).alias("total"))


@query("snk_1_split_audit", "select split, count(*) as rows_in, count(distinct path) as keys_in, count(*) as rows_out, count(distinct path) as keys_out, true as matches, 0::bigint as n_shared_groups from items group by split")
def snk_1(spark, sf):
    return K.write_splits(items(spark, sf).select("item_id", "group_id", "path", "split"), fresh_path(spark, "splits"), "split", "group_id", "path")


@query("snk_2_append", "select run, count(*) as n, max(step) as last_step from metric_log group by run")
def snk_2(spark, sf):
    path = fresh_path(spark, "log")
    log = metric_log(spark, sf).select("run", "step", "metric")
    K.append_metrics(log.where("step <= 20"), path)
    K.append_metrics(log.where("step > 20"), path)
    return spark.read.schema(log.schema).parquet(path).groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.max("step").alias("last_step"))


@query("snk_3_report_text", f"select member, string_agg(printf('%s auroc %.4f auprc %.4f n_pos %d', task, auroc, auprc, n_pos), chr(10) order by task) as text from {Q.ranking('predictions', ['member', 'task'])} group by member")
def snk_3(spark, sf):
    per = M.ranking_metrics(predictions(spark, sf), ["member", "task"])
    line = F.format_string("%s auroc %.4f auprc %.4f n_pos %d", "task", "auroc", "auprc", "n_pos")
    return K.text_table(per, ["member"], line, "task")


@query("snk_4_latest_version", "select run, max(metric) as best from metric_log group by run")
def snk_4(spark, sf):
    path = fresh_path(spark, "versions")
    log = metric_log(spark, sf).groupBy("run")
    K.write_version(log.agg(F.min("metric").alias("best")), path, "2024-01-01_00-00-00")
    K.write_version(log.agg(F.max("metric").alias("best")), path, "2024-01-02_00-00-00")
    return K.latest_version(spark.read.schema("run bigint, best double, run_ts string").parquet(path)).select("run", "best")
