"""Runs that fail, resume and repeat; drift of micro-batches against the batch report."""

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from tessera.operators import monitor as M
from tessera.operators import retrain as R
from tessera.streaming import jobs as S


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(i, float(i % 17), f"g{i % 3}", 3.0 * (i % 17) + i % 5) for i in range(400)] + [(7, 7.0, "g1", 23.0), (401, None, None, 5.0), (402, 3.0, "g0", None)]
    return spark.createDataFrame(rows, "id long, x double, g string, y double")


JOB = R.Job("price", "y", ["id"], features=["x", "g"])


def listed(df):
    return [(r.step, r.status, r.n_rows, r.detail) for r in df.orderBy("run", "position").collect()]


def test_run_rerun_and_promotion(spark, frame, tmp_path):
    root = str(tmp_path)
    first = listed(R.run(frame, JOB, "a-1", root))
    assert [s for s, *_ in first] == R.STEPS and {st for _, st, *_ in first} == {"done", "skipped"}
    rows = {s: n for s, _, n, _ in first}
    assert (rows["load_data"], rows["data_cleaning"], rows["preprocessing"]) == (403, 402, 401)
    seen = []
    assert listed(R.run(frame.limit(0), JOB, "a-1", root, seen.append)) == first and not seen
    again = dict((s, d) for s, _, _, d in listed(R.run(frame, JOB, "a-2", root)))
    assert '"version": 2' in again["register_model"] and '"promoted": false' in again["promote"] and '"production": "a-1"' in again["promote"]
    models = R.registry(spark, root, "price").where("metric = 'r2'").orderBy("run").collect()
    assert [(m.run, m.promoted) for m in models] == [("a-1", True), ("a-2", False)] and models[0].value > 0.9


def test_failed_step_is_recorded_and_resumed(spark, frame, tmp_path):
    root = str(tmp_path)
    broken = R.Job("price", "y", ["id"], features=["x"], model="no such model")
    out = listed(R.run(frame, broken, "b-1", root))
    assert out[-1][0] == "train_model" and out[-1][1] == "failed" and "no such model" in out[-1][3] and len(out) == 6
    seen = []
    assert listed(R.run(frame, JOB, "b-1", root, seen.append))[-1][:2] == ("promote", "done")
    assert seen == R.STEPS[R.STEPS.index("train_model"):]
    assert listed(R.run(frame, R.Job("other", "nothing", ["id"]), "b-2", root)) [-1][:2] == ("load_data", "failed")
    assert listed(R.run(frame.limit(0), JOB, "b-3", root))[-1][:2] == ("load_data", "failed")


def test_stream_starts_a_run_for_each_batch_once(spark, frame, tmp_path):
    src, root = f"{tmp_path}/in", f"{tmp_path}/models"
    for i in range(2):
        frame.where(F.col("id") % 2 == i).write.mode("append").parquet(src)
        S.retrain_job(S.file_stream(spark, src, frame.schema), [JOB], root, f"{tmp_path}/checkpoint")
    before = listed(R.ledger(spark, root))
    assert len(before) == 2 * len(R.STEPS)
    S.retrain_job(S.file_stream(spark, src, frame.schema), [JOB], root, f"{tmp_path}/other-checkpoint")  # replay: batch 0 has other rows now
    assert listed(R.ledger(spark, root)) == before


def test_drift_of_three_batches_is_that_of_the_report(spark, tmp_path):
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet").select("value", "user_id", "event_type")
    part = F.pmod(F.col("user_id"), F.lit(3))
    base = M.DriftBaseline(events, f"{tmp_path}/base")
    for i in range(3):
        current = events.where(part == i).withColumn("value", F.col("value") + i * 10)
        current.write.mode("append").parquet(f"{tmp_path}/in")
        S.drift_job(S.file_stream(spark, f"{tmp_path}/in", events.schema), base, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    got = S.read_batches(spark, f"{tmp_path}/out")
    names = ["feature", "method", "statistic", "p_value", "is_drifted"]
    for i in range(3):
        want = M.drift_report(events, events.where(part == i).withColumn("value", F.col("value") + i * 10)).select(*names)
        assert sorted(map(tuple, got.where(f"batch = {i}").select(*names).collect())) == sorted(map(tuple, want.collect()))
    assert got.select("batch").distinct().count() == 3
