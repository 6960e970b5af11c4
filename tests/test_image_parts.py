"""Images that come by parts: no task holds a whole one, and only pixels that there are count."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tintloom.plans import catalogue
from tintloom.sources import pixels as px

from .test_queries import FOLDER, pytestmark, rows_of  # noqa: F401


@pytest.fixture(scope="module")
def cut(spark, tmp_path_factory):
    """Slides whose last line isn't full, with a few pixels missing elsewhere."""
    d = str(tmp_path_factory.mktemp("cut"))
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    events.where(f"event_id < {events.count() - 130} and event_id % 97 <> 5").write.parquet(f"{d}/events.parquet")
    return d


@pytest.mark.parametrize("kind", ["histogram", "reinhard"])
def test_images_with_missing_pixels_equal_sql(spark, cut, kind):
    duck = pytest.importorskip("duckdb").connect()
    duck.execute(f"create view events as select * from '{cut}/events.parquet/*.parquet'")
    df, name = entry.queries()[f"image_batch_{kind}"](spark, cut), f"image_batch_{kind}"
    got = duck.execute(entry.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in got.description], got.fetchall())


def test_no_part_is_larger_than_a_batch(spark):
    p = catalogue.view(spark, FOLDER)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "100")
    try:
        parts = px.strips(p).collect()
        found = {r["slide_id"]: r for r in entry.queries()["image_batch_reinhard"](spark, FOLDER).where("ch = 'L'").collect()}
    finally:
        spark.conf.set(key, before)
    assert max(r["w"] for r in parts) <= 100 and sum(r["w"] for r in parts) == p.count()
    want = entry.queries()["lab_stats_slide"](spark, FOLDER).count()
    assert len(found) == want
    whole = {r["slide_id"]: r["n"] for r in p.groupBy("slide_id").agg(F.count("*").alias("n")).collect()}
    assert {s: sum(r["w"] for r in parts if r["slide_id"] == s) for s in whole} == whole and np.isfinite([r["norm_std_lab"] for r in found.values()]).all()
