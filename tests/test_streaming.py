import datetime as dt
import random

from tallyward.operators.detectors import failed_then_success, status_spikes
from tallyward.sources.logins import normalize_columns
from tallyward.streaming.rolling import append_to, failures_per_address, hourly_status_counts, stream_logins
from tallyward.streaming.stateful import failures_before_success, running_spikes, use_state_store

HEADER = "UserId,LoginTime,SourceIp,Status\n"


def test_hours_are_appended_once_finished(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text(HEADER + "".join(f"u,2026-04-22T09:{m:02}:00.000Z,1.1.1.1,Success\n" for m in range(5)))
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        logins = stream_logins(spark, str(folder), ["UserId", "LoginTime", "SourceIp", "Status"])
        append_to(hourly_status_counts(logins), out, checkpoint).awaitTermination()
        return [(r.hourBucket.hour, r.status, r.cnt) for r in spark.read.parquet(out).collect()]

    assert run() == []
    (folder / "b.csv").write_text(HEADER + "u,2026-04-22T09:59:00.000Z,1.1.1.1,Success\nu,2026-04-22T13:00:00.000Z,1.1.1.1,Success\n")
    assert run() == [(9, "Success", 6)]


def test_failures_per_address(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text(HEADER + "".join(f"u,2026-04-22T09:0{m}:30.000Z,1.1.1.1,Invalid Password\n" for m in range(4))
                                  + "u,2026-04-22T12:00:00.000Z,2.2.2.2,Invalid Password\n")
    logins = stream_logins(spark, str(folder), ["UserId", "LoginTime", "SourceIp", "Status"])
    query = failures_per_address(logins, "4 minutes", "1 minute", 4, "1 minute")
    append_to(query, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.sourceIp, r.windowStart.minute, r.failures) for r in rows] == [("1.1.1.1", 0, 4)]


def login_chunks(folder, chunks):
    import os

    folder.mkdir()
    for number, rows in enumerate(chunks):
        path = folder / f"{number:03}.csv"
        path.write_text(HEADER + "".join(f"{u},{t.isoformat(timespec='milliseconds')}Z,{ip},{s}\n" for u, t, ip, s in rows))
        os.utime(path, (1e9 + number, 1e9 + number))


def streamed(spark, folder, make, out, state):
    """One file per batch."""
    use_state_store(spark)
    columns = ["UserId", "LoginTime", "SourceIp", "Status"]
    schema = ", ".join(f"{c} string" for c in columns)
    raw = spark.readStream.options(header=True, maxFilesPerTrigger=1).schema(schema).csv(str(folder))
    append_to(make(normalize_columns(raw)), str(out), str(state)).awaitTermination()
    return spark.read.parquet(str(out))


def test_failures_before_success_equal_the_batch_detector(spark, tmp_path):
    rng = random.Random(2)
    start = dt.datetime(2026, 4, 22, 9, 0)
    rows = []
    for _ in range(400):
        at = start + dt.timedelta(milliseconds=rng.choice([0, 500, 1000, rng.randrange(9_000_000)]) + 1_800_000 * rng.randrange(3))
        rows.append((rng.choice(["hot", "hot", "u1", "u2"]), at, f"1.1.1.{rng.randrange(3)}", rng.choice(["Success", "Bad", "Bad"])))
    rows += rows[:30]  # equal logins stay rows
    rows.sort(key=lambda r: r[1] + dt.timedelta(minutes=rng.uniform(0, 9)))  # out of order within the lateness
    flush = [[("other", start + dt.timedelta(days=n), "9.9.9.9", "Success")] for n in (2, 3)]
    login_chunks(tmp_path / "in", [rows[i:i + 80] for i in range(0, len(rows), 80)] + flush)
    got = streamed(spark, tmp_path / "in", lambda l: failures_before_success(l, 2, 30, "10 minutes"), tmp_path / "out", tmp_path / "state")
    table = spark.createDataFrame(rows, "userId string, loginTime timestamp, sourceIp string, status string")
    want = failed_then_success(table, 2, 30)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 50


def test_running_spikes_equal_the_batch_detector_up_to_each_hour(spark, tmp_path):
    rng = random.Random(3)
    start = dt.datetime(2026, 4, 22, 0, 0)
    rows = [("u", start + dt.timedelta(hours=h, milliseconds=rng.randrange(3_600_000)), "1.1.1.1", status)
            for h in range(20) for status, usual in (("Success", 3), ("Bad", 2)) for _ in range(rng.randrange(1, usual + 1) * (6 if h in (9, 17) else 1))]
    flush = [[("u", start + dt.timedelta(days=n), "1.1.1.1", "Other")] for n in (4, 5)]
    login_chunks(tmp_path / "in", [rows[i:i + 30] for i in range(0, len(rows), 30)] + flush)
    got = streamed(spark, tmp_path / "in", lambda l: running_spikes(l, 1.5, "2 hours"), tmp_path / "out", tmp_path / "state")
    want = []
    for h in range(20):
        sofar = spark.createDataFrame([(t, s) for _, t, _, s in rows if t < start + dt.timedelta(hours=h + 1)], "loginTime timestamp, status string")
        want += [(r.hourBucket, r.status, r.cnt, round(r.zscore, 9)) for r in status_spikes(sofar, 1.5).collect() if r.hourBucket == start + dt.timedelta(hours=h)]
    assert sorted((r.hourBucket, r.status, r.cnt, round(r.zscore, 9)) for r in got.collect()) == sorted(want) and len(want) >= 2
