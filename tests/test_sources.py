"""Landed files: unreadable times, empty pages, pinning folder."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from hazeframe import session
from hazeframe.operators.anomaly import anomaly_rates, zscore_flag
from hazeframe.operators.sequence import index_rows
from hazeframe.sources import files, landing


def test_unreadable_time(spark):
    d = spark.createDataFrame([("2023-01-01 00:00:00", "1", "a"), ("not a time", "2", "a"), (None, "3", "a")], "utc string, value string, city_name string")
    with pytest.raises(Exception, match="time can't be read"):
        files.standardize(d).collect()
    kept = files.standardize(d, strict=False)
    assert files.time_rejects(kept).first().asDict() == {"n_rows": 3, "n_without_time": 2}
    pos = index_rows(kept, "city", ["datetime", "pm25"], bucket=F.date_trunc("day", F.col("datetime")))
    assert sorted((r._rn, r.pm25) for r in pos.collect()) == [(1, 1.0), (2, 2.0), (3, 3.0)]


def test_empty_pages_are_reported(spark, tmp_path):
    hour = {"value": 1.5, "period": {"datetimeFrom": {"utc": "2023-01-01T00:00:00Z"}}}
    for sensor, pages in {1: [[hour, hour], []], 2: [[]]}.items():
        (tmp_path / f"sensor_id={sensor}").mkdir()
        for i, rows in enumerate(pages):
            (tmp_path / f"sensor_id={sensor}" / f"{i}.json").write_text(json.dumps({"results": rows, "meta": {"found": ">1000"}}))
    full = landing.read_pages(spark, str(tmp_path), keep_empty=True)
    got = {r.sensor_id: (r.rows, r.pages) for r in landing.page_completeness(full).collect()}
    assert got == {1: (2, 2), 2: (0, 1)}
    assert landing.read_pages(spark, str(tmp_path)).count() == 2


def test_z_score_is_taken_over_the_imputed_column(spark):
    v = [1.0, 2.0, 2.0, 3.0, 9.0, None, None, None]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "id long, pm25 double")
    full = [2.0 if x is None else x for x in v]  # the median of the known values is 2
    mu = sum(full) / len(full)
    sd = (sum((x - mu) ** 2 for x in full) / len(full)) ** 0.5
    got = {r.id: r.anomaly_zscore for r in zscore_flag(d, threshold=2.0).collect()}
    assert got == {i: abs(x - mu) / sd > 2.0 for i, x in enumerate(full)} and any(got.values())


def test_anomaly_rates_by_hand(spark):
    d = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("b", 1, False), (None, 1, True)], "city string, hour int, f boolean")
    got = {(r.dim, r.value): r.rate_pct for r in anomaly_rates(d, ["f"], ["city", "hour"]).collect()}
    assert got[("all", "all")] == 50 and got[("city", "a")] == 50 and got[("city", None)] == 100
    assert got[("hour", "1")] == pytest.approx(200 / 3) and got[("hour", "2")] == 0


def test_no_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

        def getConf(self):  # noqa: N802
            return {}

    class Conf:
        def get(self, *_):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_header_pass_reads_the_first_lines_only(spark, tmp_path):
    """Bytes read do not grow with the files."""
    for i in range(3):
        (tmp_path / f"{i} x.csv").write_text(f"utc,value,h{i % 2}\r\n" + "2023-01-01 00:00:00,1.25,x\n" * 200_000)  # 5 MB
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "long.csv").write_text("n" * 100_000)  # a line beyond one block, without an end
    stats = lambda: sum(s.getBytesRead() for s in spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics())
    before = stats()
    got = files.first_lines(spark, str(tmp_path / "*.csv"))
    assert stats() - before < 1_000_000  # Spark itself opens no contents
    assert sorted(line for _, line in got) == ["n" * 100_000, "utc,value,h0", "utc,value,h0", "utc,value,h1"]
    assert files.first_line(f"file:{tmp_path}/0 x.csv") == ("utc,value,h0", files.HEAD_BYTES)
    fam = files.header_families(spark, str(tmp_path / "? x.csv"))
    assert {k: len(v) for k, v in fam.items()} == {"utc,value,h0": 2, "utc,value,h1": 1}
    assert files.read_raw_csv(spark, str(tmp_path / "? x.csv")).count() == 600_000
    with pytest.raises(FileNotFoundError):
        files.header_families(spark, str(tmp_path / "empty.csv"))


def test_sinks_give_back_their_rows(spark, tmp_path):
    d = spark.createDataFrame([("a", 1, 0.5, True), ("b c", 2, None, False)], "city string, n int, v double, f boolean")
    for fmt in ("csv", "parquet"):
        for _ in range(2):  # overwritten
            back = files.through_sink(d, str(tmp_path / fmt), fmt)
        assert back.schema == d.schema and sorted(map(tuple, back.collect())) == sorted(map(tuple, d.collect()))
