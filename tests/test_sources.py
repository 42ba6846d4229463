import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyward.functions.times import parse_login_time, parse_offset_time
from tallyward.sources import daily_cache
from tallyward.sources import logins as src
from tallyward.sources import sinks
from tallyward.plans.detect import result_order
from tallyward.sources.files import changed_groups, nearest_marked_folder, marked_folders, read_files


def test_detect_source():
    assert src.detect_source(["EVENT_TYPE", "TIMESTAMP"]).startswith("Event Monitoring")
    assert src.detect_source(["USER_ID", "x"]).startswith("Event Monitoring")
    assert src.detect_source(["UserId", "LoginTime"]).startswith("SOQL")
    assert src.detect_source(["Login Time", "z"]).startswith("Setup UI")
    assert src.detect_source(["a", "b"]).startswith("Unknown")


def test_csv_quotes_line_breaks_and_broken_rows(spark, tmp_path):
    path = tmp_path / "logins.csv"
    path.write_text('USER_ID,TIMESTAMP,TIMESTAMP_DERIVED,LOGIN_STATUS,OTHER\n'
                    'u1,2026-04-22T09:15:33.000Z,x,"Invalid ""Pass"",\nword",a\n'
                    'u2,04/22/2026 09:15 AM,x,,b\n'
                    'u3,nonsense,x,Success,c\n'
                    'too,short\n')
    raw = src.read_login_csv(spark, str(path))
    rows = {r.userId: r for r in src.normalize_columns(raw).collect()}
    assert set(rows) == {"u1", "u2", "u3"}
    assert rows["u1"].status == 'Invalid "Pass",\nword' and rows["u1"].loginTime == dt.datetime(2026, 4, 22, 9, 15, 33)
    assert rows["u2"].status is None and rows["u2"].loginTime == dt.datetime(2026, 4, 22, 9, 15)
    assert rows["u3"].loginTime is None
    assert src.normalize_columns(raw).columns == ["userId", "status", "loginTime"]


def test_first_header_wins_and_unknown_headers_fail(spark):
    df = spark.createDataFrame([("a", "b")], "TIMESTAMP_DERIVED string, `TIMESTAMP` string")
    assert src.rename_known(df).first().loginTime == "a"
    with pytest.raises(ValueError):
        src.rename_known(spark.createDataFrame([("a",)], "nothing string"))


def test_login_time_formats(spark):
    texts = {
        "2026-04-22T09:15:33.000Z": (9, 15, 33), "2026-04-22T09:15:33Z": (9, 15, 33), "2026-04-22 09:15:33": (9, 15, 33),
        "04/22/2026 09:15 AM": (9, 15, 0), "04/22/2026 09:15 PM": (21, 15, 0), "04/22/2026 21:15": (21, 15, 0),
        "2026-04-22": (0, 0, 0), "2026-04-22T09:15:33+02:00": (7, 15, 33), "2026": None, "12:30": None, "": None, "x": None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.p for r in df.select("t", parse_login_time(F.col("t")).alias("p")).collect()}
    assert got == {t: v and dt.datetime(2026, 4, 22, *v) for t, v in texts.items()}
    local = df.filter("t LIKE '04/22%AM'").select(parse_login_time(F.col("t"), "America/New_York").alias("p")).first().p
    assert local == dt.datetime(2026, 4, 22, 13, 15)


def test_offset_times(spark):
    texts = {"2024-01-05T10:00:00.000+0000": dt.datetime(2024, 1, 5, 10), "2024-01-05T10:00:00-0700": dt.datetime(2024, 1, 5, 17),
             "2024-01-05T10:00:00Z": dt.datetime(2024, 1, 5, 10), " 2024-01-05T10:00:00.5+01:00 ": dt.datetime(2024, 1, 5, 9, 0, 0, 500000),
             "2024-01-05T10:00:00": None, "2024-13-05T10:00:00Z": None, "": None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.p for r in df.select("t", parse_offset_time(F.col("t")).alias("p")).collect()} == texts


def test_cache_is_written_once(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("UserId,LoginTime\na,b\n")
    assert sinks.cached_logins(spark, str(path)).count() == 1
    assert not (tmp_path / "x.csv.parquet").exists()
    assert sinks.cached_logins(spark, str(path), threshold_mb=0).count() == 1
    written = (tmp_path / "x.csv.parquet" / "_SUCCESS").stat().st_mtime_ns
    assert sinks.cached_logins(spark, str(path), threshold_mb=0).count() == 1
    assert (tmp_path / "x.csv.parquet" / "_SUCCESS").stat().st_mtime_ns == written


def test_truncation(spark):
    assert src.is_truncated(spark.range(5), 5)
    assert not src.is_truncated(spark.range(4), 5) and not src.is_truncated(spark.range(6), 5)


def test_read_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / ".git").mkdir()
    (tmp_path / "a" / ".git" / "config").write_text("x")
    (tmp_path / "a" / "SKILL.md").write_bytes(b"ok \xff end")
    (tmp_path / "big.txt").write_text("y" * 1_000_001)
    (tmp_path / "fits.txt").write_text("y" * 1_000_000)
    rows = {r.path: r.text for r in read_files(spark, str(tmp_path), 1_000_000).collect()}
    assert set(rows) == {"a/SKILL.md", "fits.txt"} and rows["a/SKILL.md"] == "ok � end"


def test_nearest_marked_folder(spark):
    files = spark.createDataFrame([("SKILL.md",), ("a/SKILL.md",), ("a/b/SKILL.md",), ("a/b/c/d.py",)], "path string")
    changed = spark.createDataFrame([("a/b/c/d.py",), ("a/x.py",), ("z.py",), ("a/x.py",)], "path string")
    got = {r.path: r.grp for r in nearest_marked_folder(changed.distinct(), marked_folders(files)).collect()}
    assert got == {"a/b/c/d.py": "a/b", "a/x.py": "a", "z.py": ""}
    assert {r.grp for r in changed_groups(changed, files).collect()} == {"a/b", "a", ""}


def test_an_unfinished_or_older_cache_is_written_anew(spark, tmp_path):
    import os

    path = tmp_path / "logins.csv"
    path.write_text("UserId,LoginTime\n1,2024-01-01T00:00:00Z\n")
    cache = f"{path}.parquet"
    os.makedirs(cache)  # what a crashed write leaves
    assert sinks.cached_logins(spark, str(path), threshold_mb=0).count() == 1
    path.write_text("UserId,LoginTime\n1,2024-01-01T00:00:00Z\n2,2024-01-01T00:00:00Z\n")
    later = os.stat(f"{cache}/_SUCCESS").st_mtime + 60
    os.utime(path, (later, later))
    assert sinks.cached_logins(spark, str(path), threshold_mb=0).count() == 2


def test_rejected_rows_are_listed(spark, tmp_path):
    path = tmp_path / "broken.csv"
    path.write_text("UserId,LoginTime\n1,2024-01-01T00:00:00Z\n2,x,y,z\n")
    assert src.read_login_csv(spark, str(path)).count() + src.rejected_login_rows(spark, str(path)).count() == 2
    assert [r.raw for r in src.rejected_login_rows(spark, str(path)).collect()] == ["2,x,y,z"]


def test_findings_are_written_in_order(spark, tmp_path):
    rows = spark.createDataFrame([(f"u{i}", float(i % 37)) for i in range(500)], "userId string, gapDays double").repartition(5)
    sinks.write_findings("stale", rows, str(tmp_path), result_order("stale-reactivation", rows))
    parts = sorted((tmp_path / "stale").glob("part-*.csv"))
    days = [float(line.split(",")[1]) for p in parts for line in p.read_text().splitlines()[1:]]
    assert days == sorted(days, reverse=True) and len(days) == 500


def export_file(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("UserId,LoginTime,SourceIp\n" + "".join(f"{u},{t},1.1.1.1\n" for u, t in rows))


def days_written(cache):
    return {p.name: max(f.stat().st_mtime_ns for f in p.glob("*.parquet")) for p in cache.glob("loginDate=*")}


def cached_rows(spark, cache):
    return sorted((r.userId, str(r.loginTime), str(r.loginDate)) for r in spark.read.parquet(str(cache)).collect())


def test_daily_cache_writes_touched_days_only(spark, tmp_path):
    source, cache = tmp_path / "exports", tmp_path / "cache"
    export_file(source / "a.csv", [("u1", "2024-01-01T00:00:00Z"), ("u2", "2024-01-02T10:00:00Z"), ("u3", "no time")])
    export_file(source / "deep" / "er" / "b.csv", [("u4", "2024-01-02T11:00:00Z"), ("u5", "2024-01-03T00:00:00Z")])
    first = daily_cache.refresh_daily_cache(spark, str(source), str(cache))
    assert len(first.files) == 2 and set(first.days) == {"2024-01-01", "2024-01-02", "2024-01-03", "none"}
    before, rows = days_written(cache), cached_rows(spark, cache)
    assert len(rows) == 5 and daily_cache.refresh_daily_cache(spark, str(source), str(cache)) == daily_cache.Refresh((), (), ())

    export_file(source / "c.csv", [("u6", "2024-01-02T12:00:00Z")])
    second = daily_cache.refresh_daily_cache(spark, str(source), str(cache))
    after = days_written(cache)
    assert second.days == ("2024-01-02",) and [f.rsplit("/", 1)[1] for f in second.files] == ["c.csv"]
    assert {d for d in after if after[d] != before[d]} == {"loginDate=2024-01-02"}
    assert cached_rows(spark, cache) == sorted([*rows, ("u6", "2024-01-02 12:00:00", "2024-01-02")])


def test_daily_cache_follows_changed_and_lost_files(spark, tmp_path):
    import os

    source, cache = tmp_path / "exports", tmp_path / "cache"
    export_file(source / "a.csv", [("u1", "2024-01-01T00:00:00Z"), ("u2", "2024-01-02T10:00:00Z")])
    export_file(source / "b.csv", [("u3", "2024-01-02T11:00:00Z"), ("u4", "2024-01-03T00:00:00Z")])
    daily_cache.refresh_daily_cache(spark, str(source), str(cache))
    export_file(source / "a.csv", [("u1", "2024-01-05T00:00:00Z")])
    os.utime(source / "a.csv", (2e9, 2e9))
    done = daily_cache.refresh_daily_cache(spark, str(source), str(cache))
    assert done.removed == ("2024-01-01",) and set(done.days) == {"2024-01-02", "2024-01-05"}
    assert [r[0] for r in cached_rows(spark, cache)] == ["u1", "u3", "u4"]
    os.remove(source / "b.csv")
    assert daily_cache.refresh_daily_cache(spark, str(source), str(cache)).removed == ("2024-01-02", "2024-01-03")
    assert [r[0] for r in daily_cache.daily_logins(spark, str(source), str(cache), days=["2024-01-05"]).collect()] == ["u1"]


def test_daily_cache_mends_a_refresh_that_broke_off(spark, tmp_path):
    import shutil

    source, cache = tmp_path / "exports", tmp_path / "cache"
    export_file(source / "a.csv", [("u1", "2024-01-01T00:00:00Z"), ("u2", "2024-01-02T10:00:00Z")])
    export_file(source / "b.csv", [("u3", "2024-01-02T11:00:00Z"), ("u4", "2024-01-03T00:00:00Z")])
    daily_cache.refresh_daily_cache(spark, str(source), str(cache))
    rows = cached_rows(spark, cache)
    export_file(source / "c.csv", [("u5", "2024-01-02T12:00:00Z")])
    shutil.rmtree(cache / "loginDate=2024-01-02")  # the old day is gone, the new one not there yet
    (cache / "_touched").mkdir()
    (cache / "_touched" / "part-0.json").write_text('{"day":"2024-01-02"}\n')
    done = daily_cache.refresh_daily_cache(spark, str(source), str(cache))
    assert len(done.files) == 3 and not (cache / "_touched").exists()
    assert cached_rows(spark, cache) == sorted([*rows, ("u5", "2024-01-02 12:00:00", "2024-01-02")])
