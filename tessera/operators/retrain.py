"""Retraining runs as ledgers of steps: each step's table and record are written once, a rerun goes on after the last finished step.

Below ``root``: ``runs/<run>/<step>`` is the table that a step made, ``ledger/<run>/<step>`` its record (one row), ``models/<job>/<run>``
the fitted model and ``registry/<job>/<run>`` its metrics. Everything is named by run and step, so repeating a step overwrites its own output and
nothing else. The production model of a job is the promoted run of largest name.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import numeric_columns

STEPS = ["load_data", "data_cleaning", "feature_engineering", "preprocessing", "split_data", "train_model", "evaluate", "register_model", "promote"]
RECORD = "run string, job string, position int, step string, status string, n_rows long, detail string"
LEAST_ROWS = 10


@dataclass(frozen=True)
class Job:
    """What to train: ``key`` names the rows for the split; ``metric`` decides on promotion, by more than ``threshold`` over production."""
    name: str
    target: str
    key: list[str]
    model: str = "linear_regression"
    task: str = "regression"
    features: list[str] | None = None
    engineer: bool = False
    metric: str = "r2"
    threshold: float = 0.0
    enabled: bool = True
    options: dict = field(default_factory=dict)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def ledger(spark: SparkSession, root: str, run_name: str | None = None) -> DataFrame:
    """Records of a run, or of all runs; in order of run and position."""
    try:
        records = spark.read.schema(RECORD).parquet(f"{root}/ledger/{run_name or '*'}/*")
    except Exception as gone:
        if "PATH_NOT_FOUND" not in str(gone):
            raise
        return spark.createDataFrame([], RECORD)
    return records


def registry(spark: SparkSession, root: str, job: str) -> DataFrame:
    """(run, metric, value, promoted) of a job's registered models."""
    schema = "run string, metric string, value double, promoted boolean"
    try:
        return spark.read.schema(schema).parquet(f"{root}/registry/{job}/*")
    except Exception as gone:
        if "PATH_NOT_FOUND" not in str(gone):
            raise
        return spark.createDataFrame([], schema)


def _scores(model, df: DataFrame, job: Job) -> dict[str, float]:
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
    predicted = model.transform(df)
    if job.task == "classification":
        names = {"accuracy": "accuracy", "f1": "f1", "precision": "weightedPrecision", "recall": "weightedRecall"}
        return {n: float(MulticlassClassificationEvaluator(labelCol=job.target, metricName=m).evaluate(predicted)) for n, m in names.items()}
    return {n: float(RegressionEvaluator(labelCol=job.target, metricName=n).evaluate(predicted)) for n in ("r2", "rmse", "mae")}


def _regression_scores(model, df: DataFrame, job: Job) -> dict[str, dict[str, float]]:
    """r2, rmse and mae of every split, as RegressionEvaluator has them, in one pass over the rows."""
    y, p = F.col(job.target).cast("double"), F.col("prediction").cast("double")
    sums = model.transform(df).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.avg((y - p) * (y - p)).alias("mse"), F.avg(F.abs(y - p)).alias("mae"), F.var_pop(y).alias("var")).collect()  # a row for each split

    def r2(s) -> float:
        return 1 - s["mse"] / s["var"] if s["var"] else (-math.inf if s["mse"] else math.nan)

    return {s["split"]: {"r2": r2(s), "rmse": math.sqrt(s["mse"]), "mae": s["mae"]} for s in sums}


def run(df: DataFrame, job: Job, run_name: str, root: str, on_step: Callable[[str], None] | None = None) -> DataFrame:
    """All steps of a run over ``df``; returns the run's ledger. Finished steps are not repeated; the first failed step is recorded with
    its error and ends the run, which a later call resumes there. ``on_step`` is called before each step that is done."""
    from pyspark.ml import PipelineModel

    from .clean import drop_duplicates, drop_missing, impute
    from .features import polynomial
    from .ml import fit, hash_split, promotion_decision, retrain_prep
    spark = df.sparkSession
    base, model_path, entry = f"{root}/runs/{run_name}", f"{root}/models/{job.name}/{run_name}", f"{root}/registry/{job.name}/{run_name}"
    done = {r.step: r for r in ledger(spark, root, run_name).where("status in ('done', 'skipped')").collect()}  # a row for each step

    def record(step: str, status: str, rows: int | None = None, **detail) -> None:
        row = [(run_name, job.name, STEPS.index(step), step, status, rows, json.dumps(detail, sort_keys=True))]
        spark.createDataFrame(row, RECORD).coalesce(1).write.mode("overwrite").parquet(f"{root}/ledger/{run_name}/{step}")

    def keep(step: str, frame: DataFrame) -> DataFrame:
        frame.write.mode("overwrite").parquet(f"{base}/{step}")
        return table(step)

    def table(step: str) -> DataFrame:
        return spark.read.parquet(f"{base}/{step}")

    def inputs(data: DataFrame) -> list[str]:
        wanted = job.features or [c for c in numeric_columns(data) if c not in job.key]
        return [c for c in wanted if c in data.columns and c not in (job.target, "split")]

    def load():
        if job.target not in df.columns:
            raise ValueError(f"target column {job.target!r} not found in {df.columns}")
        data = keep("load_data", df)
        rows = data.count()
        if not rows:
            raise ValueError("no data to train on")
        return rows, {"columns": len(data.columns)}

    def clean():
        data = drop_missing(table("load_data").distinct(), how="all").persist()  # the medians go over these rows several times
        try:
            filled = impute(data, "median", [c for c in numeric_columns(data) if c not in (job.target, *job.key)])
            return keep("data_cleaning", filled).count(), {}
        finally:
            data.unpersist()

    def engineer():
        data = table("data_cleaning")
        if job.engineer:
            data = keep("feature_engineering", polynomial(data, inputs(data), degree=2))
        return data.count(), {"columns": len(data.columns)}

    def prepare():
        data = table("feature_engineering" if job.engineer else "data_cleaning")  # a skipped step makes no table
        rest = [c for c in data.columns if c not in job.key]
        made = retrain_prep(data.select(*[F.col(c) for c in data.columns]), job.target) if any(data.schema[c].dataType.simpleString() == "string" for c in rest) else data
        made = keep("preprocessing", made.where(F.col(job.target).isNotNull()))
        rows = made.count()
        if rows < LEAST_ROWS:
            raise ValueError(f"only {rows} rows remain")
        return rows, {}

    def split():
        data = keep("split_data", hash_split(table("preprocessing"), job.key))
        sizes = {r["split"]: r["count"] for r in data.groupBy("split").count().collect()}  # three rows
        return sum(sizes.values()), sizes

    def train():
        data = table("split_data").where("split = 'train'")
        names = inputs(data)
        fit(data, names, job.target if job.task != "unsupervised" else None, job.model, job.task, **job.options).write().overwrite().save(model_path)
        return data.count(), {"features": names}

    def evaluate():
        model, data = PipelineModel.load(model_path), table("split_data")
        if job.task == "classification":
            by_part = {part: _scores(model, data.where(F.col("split") == part), job) for part in ("test", "validation", "train")}
        else:
            by_part = _regression_scores(model, data, job)
        if empty := {"test", "validation", "train"} - set(by_part):
            raise ValueError(f"no rows to score in {sorted(empty)}")
        scores = dict(by_part["test"])
        for part, name in (("validation", "val_score"), ("train", "train_score")):
            scores[name] = by_part[part][job.metric]
        rows = [(run_name, k, v) for k, v in scores.items()]
        keep("evaluate", spark.createDataFrame(rows, "run string, metric string, value double"))
        return len(rows), {k: round(v, 6) for k, v in scores.items()}

    def register():
        found = registry(spark, root, job.name).where(F.col("run") != run_name).select("run").distinct().count()
        return None, {"version": found + 1}

    def promote():
        scores, others = table("evaluate"), registry(spark, root, job.name).where(F.col("promoted") & (F.col("run") < run_name))
        last = others.agg(F.max("run")).first()[0]
        decision = promotion_decision(scores, others.where(F.col("run") == last).select("metric", "value"), job.metric, job.threshold).first()
        scores.select("run", "metric", "value", F.lit(bool(decision.promote)).alias("promoted")).write.mode("overwrite").parquet(entry)
        return None, {"promoted": bool(decision.promote), "production": last}

    work = {"load_data": load, "data_cleaning": clean, "feature_engineering": engineer, "preprocessing": prepare, "split_data": split,
            "train_model": train, "evaluate": evaluate, "register_model": register, "promote": promote}
    for step in STEPS:
        if step in done:
            continue
        if on_step is not None:
            on_step(step)
        try:
            rows, detail = work[step]()
        except Exception as error:  # recorded, and met again by the next call
            record(step, "failed", None, error=f"{type(error).__name__}: {str(error)[:500]}")
            break
        record(step, "skipped" if step == "feature_engineering" and not job.engineer else "done", rows, **detail)
    return ledger(spark, root, run_name)
