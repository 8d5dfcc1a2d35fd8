"""Times of steps are measured."""

import time

from pyspark.sql import functions as F

from quadrille.operators.steps import Steps
from quadrille.plans import engine
from quadrille.sources import grids


def slowed(df, seconds):
    """The same rows, of which each task takes longer."""

    def run(parts):
        for p in parts:
            time.sleep(seconds)
            yield p

    return df.coalesce(1).mapInPandas(run, df.schema)


def test_steps_outside_the_plan_take_no_share(spark):
    took = Steps(planned=["step_cva"])
    took.written(spark.range(5), "rows", "step_cva", "step_ndvi_delta")
    assert set(took.ms) == {"step_cva"} and took.rows == {"step_cva": 5} and took.summary("step_cva") == "5 rows"


def test_slow_tables_take_longer(spark):
    rows, took = spark.range(100), Steps()
    took.written(rows, "warm", "step_other")
    assert took.written(rows, "fast", "step_ndvi").count() == 100
    took.written(slowed(rows, 3.0), "slow", "step_cva", "step_ndwi")
    assert took.ms["step_cva"] > 1500 and took.ms["step_cva"] > took.ms["step_ndvi"]
    assert took.rows == dict.fromkeys(("step_other", "step_ndvi", "step_cva", "step_ndwi"), 100)
    assert took.summary("step_cva") == "100 rows; in one job with ndwi" and took.summary("step_ndvi") == "100 rows" and took.summary("step_none") == ""


def test_an_empty_table_and_a_step_in_parts(spark):
    took = Steps()
    took.written(spark.range(0), "none", "step_ndvi")
    first = took.ms["step_ndvi"]
    with took.timed("step_ndvi"):
        pass
    assert took.rows["step_ndvi"] == 0 and took.ms["step_ndvi"] >= first


def test_trace_of_change(spark):
    a, b = (grids.synthetic(spark, n, 48, 48) for n in ("before", "after"))
    began = time.time()
    r = engine.detect_change(spark, a, b).first()
    wall = (time.time() - began) * 1000
    times = {s["step_id"]: s["duration_ms"] for s in r["trace"]}
    known = [t for t in times.values() if t is not None]
    assert times["step_vlm_synthesis"] is None and all(t is not None for s, t in times.items() if s != "step_vlm_synthesis")
    assert len(set(known)) > 3 and sum(known) <= r["execution_time_ms"] + 1 <= wall + 1
    told = {s["step_id"]: s["summary"] for s in r["trace"]}
    assert told["step_cva"] == "1 rows; in one job with temporal align" and told["step_temporal_align"].startswith("2304 rows; in one job")


def test_a_slow_source_shows_in_its_own_steps(spark):
    o = grids.synthetic(spark, "coast", 32, 32).withColumn("scene_id", F.lit("radar"))
    r = grids.synthetic(spark, "radar", 32, 32)
    took = [{s["step_id"]: s["duration_ms"] or 0 for s in engine.fuse(spark, o, slowed(r, s)).first()["trace"]} for s in (0.0, 4.0)]
    more = {s: took[1][s] - took[0][s] for s in took[0]}
    assert max(more, key=more.get) == "step_sar_speckle" and more["step_sar_speckle"] > 2000
