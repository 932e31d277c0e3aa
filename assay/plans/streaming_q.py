"""STR queries: the log arrives in three parts, the stream is restarted after each."""

import pyarrow as pa
import pyarrow.fs as pfs
from pyspark.sql import functions as F

from assay.plans.profile_q import rounded
from assay.plans.registry import query
from assay.plans.views import metric_log, table
from assay.plans.windows_q import BEST, GAINS, PATIENCE, PHASED, PHASED_COLUMNS, counter_log, rates
from assay.session import fresh_path, staged
from assay.streaming import jobs as J

SLICES = ["step <= 20", "step > 20 and step <= 40", "step > 40"]
LOG = "run bigint, step bigint, metric double"


def _feed(spark, sf, start, columns=("run", "step", "metric"), schema=LOG, fmt="parquet", log=None):
    """Append one slice of the log at a time and let the stream catch up after each."""
    folder, out = fresh_path(spark, "log"), fresh_path(spark, "stream")
    log = staged(log if log is not None else metric_log(spark, sf).selectExpr("*", "case when step % 3 <> 0 then metric end as scored"), "log")
    for part in SLICES:
        writer = log.where(part).selectExpr(*columns).write.mode("append").format(fmt)
        (writer.option("header", "true") if fmt == "csv" else writer).save(folder)
        start(J.read_log_stream(spark, folder, schema, fmt), out)
    return out


@query("str_1_log_ingest", "select run, step, metric from metric_log")
def str_1(spark, sf):
    out = _feed(spark, sf, J.run_to_end, fmt="csv")
    return spark.read.schema(LOG).parquet(out)


def _grown(log, folder, upto, cut):
    """Files of lines as they stand after some slices: the same lines in front, so a file seen before has grown.

    ``cut`` leaves out the end of the last line. A file is written aside and put in its place, so that a task that is
    run again leaves the same bytes.
    """
    fs, path = pfs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    fs.create_dir(path)
    rows = log.where(F.col("slice") <= upto).repartition("shard").sortWithinPartitions("shard", "slice", "run", "step").select("shard", F.concat_ws(",", "run", "step", "metric").alias("line"))

    def write(batches):
        where, _ = pfs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        files, last = {}, {}
        for batch in batches:
            for shard, line in zip(*(c.to_pylist() for c in batch.columns)):
                if shard not in files:
                    files[shard] = where.open_output_stream(f"{path}/{shard}.part")
                    last[shard] = "run,step,metric\n"
                files[shard].write(last[shard].encode())
                last[shard] = line + "\n"
        for shard, file in files.items():
            file.write(last[shard].encode()[: -cut or None])
            file.close()
            where.move(f"{path}/{shard}.part", f"{path}/{shard}.csv")
        yield pa.RecordBatch.from_pydict({"n": pa.array([len(files)], pa.int64())})

    return rows.mapInArrow(write, "n long").agg(F.sum("n")).first()[0]


@query("str_1_growing_log", "select run, step, metric from metric_log")
def str_1_growing(spark, sf):
    """Files that grow while a stream follows them; after the first part each ends in the middle of a line."""
    folder, out = fresh_path(spark, "growing"), fresh_path(spark, "stream")
    number = " ".join(f"when {part} then {i}" for i, part in enumerate(SLICES))
    log = staged(metric_log(spark, sf).selectExpr("run", "step", "metric", f"case {number} end as slice", "pmod(xxhash64(run, step), 16) as shard"), "log")
    for i in range(len(SLICES)):
        _grown(log, folder, i, 3 if i == 0 else 0)
        J.run_to_end(J.read_growing_log(spark, folder, LOG, 1 << 14), out)
    return spark.read.schema(LOG).parquet(out)


@query("str_2_best_tracker", BEST + """, s as (select run, min(case when step - best_step >= 15 then step end) as stop_step from l group by run)
select run, arg_max(greatest(metric, coalesce(prev, metric)), step) as best, arg_max(best_step, step) as best_step, max(stop_step) as stop_step from l join s using (run) where stop_step is null or step <= stop_step group by run""")
def str_2(spark, sf):
    out = _feed(spark, sf, lambda s, o: J.track_best(s, o, "run", "step", "metric", 15))
    return J.latest_state(spark, out).drop("last_step")


@query("str_3_top_board", "select run, step, metric as score, rank::int as rank from (select *, row_number() over (partition by run order by metric desc, step) as rank from metric_log) where rank <= 5")
def str_3(spark, sf):
    out = _feed(spark, sf, lambda s, o: J.board_stream(s, o, "run", "step", "metric", 5))
    return J.merged_board(spark, out, 5)


@query("str_2_phased_tracker", PHASED)
def str_2_phased(spark, sf):
    """The batch tracker's rows from a stream that is restarted twice."""
    sets = ["val19k", "val200"]
    out = _feed(spark, sf, lambda s, o: J.track_best(s, o, "run", "step", "metric", PATIENCE, phase="phase", stops_from=1, sets=sets),
                PHASED_COLUMNS, LOG + ", phase int, val19k double, val200 double")
    return J.latest_state(spark, out, sets).drop("last_step")


@query("str_4_rolling_throughput", """select run, step, round(sum(32.0::double) over w / sum(metric + 1) over w, 9) as imgs_per_s from metric_log window w as (partition by run order by step rows between 19 preceding and current row)""")
def str_4(spark, sf):
    out = _feed(spark, sf, lambda s, o: J.rolling_stream(s, o, "run", "step", ["images", "wall"], 20),
                ("run", "step", "32.0D as images", "metric + 1 as wall"), "run bigint, step bigint, images double, wall double")
    return rounded(spark.read.parquet(out).select("run", "step", F.try_divide("sum_images", "sum_wall").alias("imgs_per_s")))


@query("str_4_counter_rates", GAINS)
def str_4_counters(spark, sf):
    """Gains of counters that restart from zero, within and between the parts of the log."""
    names = ["images", "bytes", "busy", "elapsed"]
    out = _feed(spark, sf, lambda s, o: J.counter_stream(s, o, "run", "step", names), ("run", "step", *names), "run bigint, step bigint, images double, bytes double, busy double, elapsed double", log=counter_log(spark, sf))
    return rates(spark.read.parquet(out))


def _events_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf).withColumn("ts", F.col("ts").cast("timestamp"))


def _closed(spark, out):
    return spark.read.parquet(out).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


CLOSED = "(select max(ts) - interval 10 minutes from events)"


@query("str_5_tumbling", f'select start::timestamp as start, start + interval 1 hour as "end", event_type, n, total from (select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, round(sum(value), 6) as total from events group by 1, 2) where start + interval 1 hour <= {CLOSED}')
def str_5(spark, sf):
    out = fresh_path(spark, "windows")
    J.run_to_end(J.windowed(_events_stream(spark, sf), "ts", "event_type", "value", "1 hour"), out)
    return _closed(spark, out).withColumn("total", F.round("total", 6))


@query("str_5_sliding", f"""select start, start + interval 1 hour as "end", event_type, count(*) as n, round(sum(value), 6) as total from
 (select time_bucket(interval 30 minutes, ts) - interval (30 * k) minutes as start, event_type, value from events, (values (0), (1)) s(k)) where start + interval 1 hour <= {CLOSED} group by 1, 2, 3""")
def str_5_sliding(spark, sf):
    out = fresh_path(spark, "windows")
    J.run_to_end(J.windowed(_events_stream(spark, sf), "ts", "event_type", "value", "1 hour", "30 minutes"), out)
    return _closed(spark, out).withColumn("total", F.round("total", 6))


@query("str_5_sessions", f"""with s as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as first from events),
g as (select user_id, ts, sum(first) over (partition by user_id order by ts) as sid from s)
select min(ts) as start, max(ts) + interval 30 minutes as "end", user_id, count(*) as n from g group by user_id, sid having max(ts) + interval 30 minutes <= {CLOSED}""")
def str_5_sessions(spark, sf):
    out = fresh_path(spark, "sessions")
    J.run_to_end(J.sessions(_events_stream(spark, sf), "ts", "user_id", "30 minutes"), out)
    return _closed(spark, out)


@query("str_6_delta", "select run, step, round(metric - last_value(metric ignore nulls) over (partition by run order by step rows between unbounded preceding and 1 preceding), 9) as delta from (select run, step, case when step % 3 <> 0 then metric end as metric from metric_log)")
def str_6(spark, sf):
    out = _feed(spark, sf, lambda s, o: J.delta_stream(s, o, "run", "step", "metric"), ("run", "step", "scored as metric"))
    return rounded(spark.read.parquet(out).select("run", "step", "delta"))
