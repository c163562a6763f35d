"""A catalogue service as a data source: pages, and filters that reach the service."""

import json
import sys
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan

from strandline.sources import catalogue, service

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture
def asked(tmp_path, monkeypatch):
    log = tmp_path / "log"
    monkeypatch.setenv("FAKE_SERVICE_LOG", str(log))
    return lambda: [json.loads(x) for x in log.read_text().splitlines()] if log.exists() else []


@pytest.fixture(autouse=True)
def shipped(spark):
    spark.sparkContext.addPyFile(str(Path(__file__).resolve().parent / "fake_service.py"))


def test_filters_reach_the_service(asked):
    reader = service.SceneReader({"service": "fake_service:service", "start": "2020-01-01", "end": "2020-12-31", "limit": "10"})
    filters = [In(("satname",), ("L8", "S2")), GreaterThanOrEqual(("acq_ts",), datetime(2020, 1, 10)), LessThan(("acq_ts",), datetime(2020, 2, 20)), GreaterThan(("x_max",), -20.0), LessThan(("x_min",), 90.0), EqualTo(("tier",), "T1")]
    assert list(reader.pushFilters(filters)) == filters
    pages = reader.partitions()
    got = [row for p in pages for row in reader.read(p)]
    seen = asked()
    assert {s[1] for s in seen} == {"L8", "S2"} and {tuple(s[4]) for s in seen} == {(-20.0, -90.0, 90.0, 90.0)}
    assert min(s[2] for s in seen) == "2020-01-10T00:00:00" and max(s[3] for s in seen) == "2020-02-20T00:00:00"
    assert len(pages) > 2 and len({r[2] for r in got}) == len(got) > 20 and [s for s in seen if s[0] == "fetch"]


@pytest.mark.parametrize("limit", [1, 7, 5000])
def test_pages_give_each_entry_once(spark, limit):
    import fake_service

    scenes = service.catalogue(spark, "fake_service:service", "2020-01-01", "2020-03-15", ["L8", "L9", "S2"], limit)
    rows = scenes.collect()
    assert sorted(r.id for r in rows) == sorted(e["id"] for at, e in fake_service.service.all if at <= datetime(2020, 3, 15))
    assert all(r.acq_ts == at for r in rows for at, e in [fake_service.service.all[int(r.id[5:])]])


def test_what_is_asked_equals_a_search(spark):
    scenes = service.catalogue(spark, "fake_service:service", "2019-01-01", "2021-01-01", limit=20)
    some = scenes.where("satname IN ('L8', 'S2') AND acq_ts >= '2020-01-05' AND acq_ts < '2020-02-25' AND x_max > -60 AND x_min < 60 AND tier = 'T1'")
    plain = scenes.cache().where("satname IN ('L8', 'S2') AND acq_ts >= '2020-01-05' AND acq_ts < '2020-02-25' AND x_max > -60 AND x_min < 60 AND tier = 'T1'")
    assert sorted(r.id for r in some.collect()) == sorted(r.id for r in plain.collect()) != []
    found = catalogue.searched(catalogue.scenes_of(some), ["L8", "S2"], "2020-01-05", "2020-02-25", "T1")
    want = catalogue.searched(catalogue.scenes_of(scenes.where("x_max > -60 AND x_min < 60")), ["L8", "S2"], "2020-01-05", "2020-02-25", "T1")
    assert sorted(r.scene_id for r in found.collect()) == sorted(r.scene_id for r in want.collect()) != []
    assert scenes.where("acq_ts > '2030-01-01'").count() == scenes.where(F.col("satname") == "L4").count() == 0
    scenes.unpersist()
