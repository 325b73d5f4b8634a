"""Structured Streaming forms of the batch operators.

Every job reads a file source with a fixed schema, keeps its progress in a
checkpoint folder under the cluster's checkpoint directory, or in ``at`` = (table, checkpoint) that a
schedule passes each time so that a run goes on where the last one stopped (restart = resume,
exactly-once sink writes per batch id), and writes through ``foreachBatch`` to a
parquet table. ``trigger(availableNow=True)`` processes everything present and
stops, which is how a scheduled extraction runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import scratch_path


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).format(fmt)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(path)


def event_time(df: DataFrame, ts: str) -> DataFrame:
    """Watermarks need TIMESTAMP; wall-clock (NTZ) event times are read in the session time zone."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def run_to_table(stream: DataFrame, out_path: str, checkpoint: str, mode: str = "append",
                 on_batch: Callable[[DataFrame, int], None] | None = None) -> None:
    """Run until the available input is consumed; each micro-batch is written once under its batch id."""
    def sink(batch: DataFrame, batch_id: int):
        (batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite")
         .parquet(f"{out_path}/_batch={batch_id}"))
        if on_batch is not None:
            on_batch(batch, batch_id)
    q = (stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def read_table(spark: SparkSession, out_path: str, keys: list[str] | None = None) -> DataFrame:
    """The sink table; with ``keys`` (update mode) only the latest emitted row per key is kept."""
    t = spark.read.option("basePath", out_path).parquet(f"{out_path}/_batch=*")
    cols = [c for c in t.columns if c != "_batch"]
    if not keys:
        return t.select(*cols)
    rest = [c for c in cols if c not in keys]
    latest = t.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("_batch")).alias("_r"))
    return latest.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def scratch(spark: SparkSession, name: str) -> tuple[str, str]:
    base = scratch_path(spark, name)
    return f"{base}/table", f"{base}/checkpoint"


# ---------------------------------------------------------------- jobs
def extract_job(spark: SparkSession, src: str, schema, columns: list[str], where: str | None = None,
                name: str = "extract", at: tuple[str, str] | None = None) -> DataFrame:
    """ST1: incremental extraction (projection + predicate) of newly arrived files."""
    s = file_stream(spark, src, schema)
    if where:
        s = s.where(F.expr(where))
    out, ck = at or scratch(spark, name)
    run_to_table(s.select(*columns), out, ck)
    return read_table(spark, out)


def windowed_stats_job(spark: SparkSession, src: str, schema, ts: str, key: str, value: str,
                       window: str = "1 hour", slide: str | None = None, watermark: str = "10 minutes",
                       name: str = "windows", at: tuple[str, str] | None = None) -> DataFrame:
    """ST2: tumbling or sliding event-time windows with a watermark (late rows are dropped)."""
    s = event_time(file_stream(spark, src, schema), ts).withWatermark(ts, watermark)
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    agg = s.groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("avg_value"),
                                          F.max(value).alias("max_value"))
    agg = agg.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                     F.col("w.end").cast("timestamp_ntz").alias("window_end"), key, "n",
                     "avg_value", "max_value")
    out, ck = at or scratch(spark, name)
    run_to_table(agg, out, ck, mode="update")
    return read_table(spark, out, ["window_start", "window_end", key])


def session_job(spark: SparkSession, src: str, schema, ts: str, key: str, gap: str = "30 minutes",
                watermark: str = "1 hour", name: str = "sessions", at: tuple[str, str] | None = None) -> DataFrame:
    """ST3: session windows per key (a session ends after ``gap`` without events).

    The stream emits a session once the watermark has passed its end; the sessions still open when the
    available input ends are read off the events after each key's last emitted session.
    """
    s = event_time(file_stream(spark, src, schema), ts).withWatermark(ts, watermark)
    agg = s.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n_events"))
    agg = agg.select(key, F.col("w.start").cast("timestamp_ntz").alias("session_start"),
                     F.col("w.end").cast("timestamp_ntz").alias("session_end"), "n_events")
    out, ck = at or scratch(spark, name)
    run_to_table(agg, out, ck, mode="append")
    closed = read_table(spark, out)
    last = closed.groupBy(F.col(key).alias("_k")).agg(F.max("session_end").cast("timestamp").alias("_upto"))
    events = event_time(spark.read.schema(schema).parquet(src), ts)
    rest = (events.join(last, F.col(key).eqNullSafe(F.col("_k")), "left")
            .where(F.col("_upto").isNull() | (F.col(ts) >= F.col("_upto"))))
    still = rest.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n_events")).select(
        key, F.col("w.start").cast("timestamp_ntz").alias("session_start"), F.col("w.end").cast("timestamp_ntz").alias("session_end"), "n_events")
    return closed.unionByName(still)


def zscore_job(spark: SparkSession, src: str, schema, baseline: DataFrame, key: str, value: str,
               threshold: float = 3.0, name: str = "zscore", at: tuple[str, str] | None = None) -> DataFrame:
    """ST4: score each arriving row against baseline mean / std (ddof 1) fitted once on static data."""
    m, sd = baseline.agg(F.avg(value), F.stddev_samp(value)).first()
    s = file_stream(spark, src, schema)
    z = F.abs((F.col(value) - F.lit(m)) / F.lit(sd)) if sd else F.lit(None).cast("double")
    scored = s.select(key, value, z.alias("z"), F.coalesce(z > threshold, F.lit(False)).alias("is_anomaly"))
    out, ck = at or scratch(spark, name)
    run_to_table(scored, out, ck)
    return read_table(spark, out)


def predictions_job(spark: SparkSession, src: str, schema, columns: list[str], out_path: str | None = None,
                    checkpoint: str | None = None, name: str = "predictions") -> DataFrame:
    """ST9: append a prediction log; re-running with the same checkpoint adds nothing twice."""
    out, ck = (out_path, checkpoint) if out_path else scratch(spark, name)
    run_to_table(file_stream(spark, src, schema).select(*columns), out, ck)
    return read_table(spark, out)


def running_stats_job(spark: SparkSession, src: str, schema, key: str, ts: str, value: str, tie: str,
                      name: str = "running_z", at: tuple[str, str] | None = None) -> DataFrame:
    """ST5: |x - mean| / std of each row against the rows of its key before it (by ``ts``, then ``tie``).

    Each micro-batch is numbered and summed up over ranges (a key with a third of the rows spans several),
    on top of three sums for each key from the batches before; those are written as one small table for
    each batch, so a batch that is run again starts from the same sums.
    """
    from ..functions.ranking import global_prefix_sums
    out, ck = at or scratch(spark, name)
    x = F.col(value).cast("double")

    def score(batch: DataFrame, batch_id: int):
        if batch_id:
            state = spark.read.parquet(f"{out}-state/{batch_id - 1}")
        else:
            state = spark.createDataFrame([], f"{key} {dict(batch.dtypes)[key]}, n long, s double, q double")
        old = state.select(F.col(key).alias("_k"), F.col("n").alias("_n"), F.col("s").alias("_s"), F.col("q").alias("_q"))
        rows = batch.select(key, ts, tie, x.alias("_x")).where(F.col("_x").isNotNull())
        run = global_prefix_sums(rows, [F.col(ts), F.col(tie)], {"n": F.lit(1), "s": F.col("_x"), "q": F.col("_x") * F.col("_x")}, partition_by=[key])
        run = run.join(old, F.col(key).eqNullSafe(F.col("_k")), "left")
        n = F.col("n") - 1 + F.coalesce("_n", F.lit(0))
        s = F.col("s") - F.col("_x") + F.coalesce("_s", F.lit(0.0))
        q = F.col("q") - F.col("_x") * F.col("_x") + F.coalesce("_q", F.lit(0.0))
        var = F.when(n > 1, (q - s * s / n) / (n - 1))
        z = F.when(var > 1e-12, F.abs(F.col("_x") - s / n) / F.sqrt(var))
        run.select(key, ts, tie, z.alias("z")).withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/_batch={batch_id}")
        new = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum("_x").alias("s"), F.sum(F.col("_x") * F.col("_x")).alias("q"))
        (state.select(key, "n", "s", "q").unionByName(new).groupBy(key).agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")])
         .write.mode("overwrite").parquet(f"{out}-state/{batch_id}"))

    q = (file_stream(spark, src, schema).writeStream.foreachBatch(score).option("checkpointLocation", ck).trigger(availableNow=True).start())
    q.awaitTermination()
    return read_table(spark, out)


def alerts_job(spark: SparkSession, src: str, schema, rules: DataFrame, ts: str, metric: str, value: str, entity: str,
               bucket: str = "hour", watermark: str = "1 day", name: str = "alerts", at: tuple[str, str] | None = None) -> DataFrame:
    """ST6: alert rules on a metric stream, one alert for each rule, entity and ``bucket`` of event time.

    ``rules`` is (rule_id, metric_name, operator, threshold, severity, enabled). Repeats inside the watermark are
    dropped by streaming state; rows later than the watermark raise no alert.
    """
    from ..operators.monitor import rule_condition
    s = event_time(file_stream(spark, src, schema), ts).withWatermark(ts, watermark)
    active = rules.where(F.col("enabled")).select("rule_id", F.col("metric_name").alias("_m"), "operator", "threshold", "severity")
    hits = (s.join(active, F.col(metric) == F.col("_m")).where(rule_condition(F.col(value), F.col("operator"), F.col("threshold")))
            .select("rule_id", "severity", entity, F.date_trunc(bucket, ts).alias("bucket"), ts))
    once = hits.dropDuplicatesWithinWatermark(["rule_id", entity, "bucket"])
    out, ck = at or scratch(spark, name)
    run_to_table(once.select("rule_id", "severity", entity, F.col("bucket").cast("timestamp_ntz").alias("bucket")), out, ck)
    return read_table(spark, out)


def drift_job(stream: DataFrame, baseline, out: str, checkpoint: str, threshold: float = 0.05) -> None:
    """ST7: the drift report (O3) of each micro-batch against a ``DriftBaseline``, as a table of reports with the batch's number.

    A batch is one pass for its counts and one for its moments; a batch that is run again overwrites its own report.
    """
    def judge(batch: DataFrame, batch_id: int):
        batch.persist()
        try:
            report = baseline.report(batch, threshold)
            report.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/_batch={batch_id}")
        finally:
            batch.unpersist()

    q = stream.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def read_batches(spark: SparkSession, out: str, name: str = "batch") -> DataFrame:
    """All rows of a sink table with the number of their micro-batch."""
    t = spark.read.option("basePath", out).parquet(f"{out}/_batch=*")
    return t.withColumn(name, F.col("_batch").cast("long")).drop("_batch")


def retrain_job(stream: DataFrame, jobs: list, root: str, checkpoint: str) -> None:
    """ST8: every micro-batch of an extraction starts a run of each linked job (``retrain.Job``, where enabled).

    A run is named after job and batch, so a batch that is run again finds its finished steps in the ledger and changes nothing. A run that
    fails is recorded there and holds up neither the other jobs nor the stream.
    """
    from ..operators.retrain import run

    def trigger(batch: DataFrame, batch_id: int):
        for job in jobs:
            if job.enabled:
                run(batch, job, f"{job.name}-{batch_id:08d}", root)

    q = stream.writeStream.foreachBatch(trigger).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
