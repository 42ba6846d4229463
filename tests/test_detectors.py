"""Detectors with their default limits on small tables, and even work on lopsided ones."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallyward.operators import detectors as d, ordered
from tallyward.operators import hunts as h
from tallyward.operators.ordered import numbered_within, running_peak, running_totals, with_previous
from tallyward.operators.timeline import scan, timeline
from tallyward.plans.detect import run_detectors, write_all

T0 = dt.datetime(2026, 4, 22, 9, 0)
SCHEMA = ("userId string, username string, loginTime timestamp, sourceIp string, status string, "
          "countryIso string, loginSubType string, tlsProtocol string, cipherSuite string")


def at(minutes=0.0, seconds=0.0, days=0.0):
    return T0 + dt.timedelta(days=days, minutes=minutes, seconds=seconds)


def row(user="u1", time=T0, ip="1.1.1.1", status="Success", country="US", name="ada.lane@x", subtype="Application",
        tls="TLSv1.2", cipher="AES"):
    return (user, name, time, ip, status, country, subtype, tls, cipher)


@pytest.fixture
def table(spark):
    return lambda rows: spark.createDataFrame(rows, SCHEMA)


def test_impossible_travel_limits(table):
    rows = [
        row(time=at(0)), row(time=at(120), country="SG", ip="2.2.2.2"),         # exactly two hours: kept
        row("u2", at(0)), row("u2", at(120, 0.001), country="SG"),              # a little later: not
        row("u3", at(0)), row("u3", at(5), country="XX"), row("u3", at(6)),     # no centroid: dropped
        row("u4", at(0)), row("u4", at(1), country=None), row("u4", at(2), country="SG"),  # NULL is skipped
        row("u5", at(0), country="NL"), row("u5", at(1), country="BE"),         # near countries
        row("u6", at(0)), row("u6", at(1), status="Invalid Password", country="SG"),
        row("u7", None, country="SG"), row("u7", at(1)),
    ]
    found = {(r.userId, r.prevCountry, r.countryIso) for r in d.impossible_travel(table(rows)).collect()}
    assert found == {("u1", "US", "SG"), ("u4", "US", "SG")}


def test_concurrent_countries_keeps_unknown_in_sequence(table):
    rows = [
        row("u1", at(0)), row("u1", at(5), country="DE"),
        row("u2", at(0)), row("u2", at(1), country=None), row("u2", at(2), country="DE"),
        row(None, at(0)), row(None, at(1), country="DE"),
    ]
    found = {(r.userId, r.minutesDelta) for r in d.concurrent_countries(table(rows)).collect()}
    assert found == {("u1", 5.0), (None, 1.0)}


def test_brute_force_window_and_users(table):
    burst = [row(f"u{i % 3}", at(i), status="Invalid Password") for i in range(10)]
    edge = [row(f"v{i % 3}", at(i * 10 / 9), ip="3.3.3.3", status="Restricted IP") for i in range(10)]  # last at +10 min
    spread = [row(f"w{i % 3}", at(i * 2), ip="4.4.4.4", status="Invalid Password") for i in range(10)]
    few = [row(f"x{i % 2}", at(i / 10), ip="5.5.5.5", status="Invalid Password") for i in range(20)]
    no_ip = [row(f"y{i % 3}", at(i / 10), ip=None, status="Invalid Password") for i in range(20)]
    found = {r.sourceIp: r for r in d.brute_force(table(burst + edge + spread + few + no_ip)).collect()}
    assert set(found) == {"1.1.1.1", "3.3.3.3"}
    assert found["1.1.1.1"].peakFailuresInWindow == 10 and found["1.1.1.1"].uniqueUsersTargeted == 3
    assert found["1.1.1.1"].firstSeen == at(0) and found["1.1.1.1"].lastSeen == at(9)


def test_brute_force_by_user(table):
    rows = [row("u1", at(i / 10), ip=f"9.9.9.{i % 4}", status="Invalid Password") for i in range(12)]
    found = d.brute_force(table(rows), group_by="userId", member="sourceIp").collect()
    assert [(r.userId, r.uniqueUsersTargeted) for r in found] == [("u1", 4)]


def test_failed_then_success_edges(table):
    fails = [row("u1", at(i), status="Invalid Password", ip="6.6.6.6") for i in range(3)]
    rows = fails + [
        row("u1", at(3)), row("u1", at(3)),                     # equal successes stay two rows
        row("u1", at(30)),                                      # first failure still inside
        row("u1", at(30, 0.001)),                               # first failure just out
        row("u2", at(0), status="Invalid Password"), row("u2", at(0, 0.2), status="Invalid Password"),
        row("u2", at(0, 0.4), status="Invalid Password"), row("u2", at(0, 1.2)),   # two at least one second before
        row("u3", at(0), status=None), row("u3", at(1), status=None), row("u3", at(2), status=None), row("u3", at(3)),
    ]
    found = sorted((r.userId, r.successTime, r.priorFailures) for r in d.failed_then_success(table(rows)).collect())
    assert found == [("u1", at(3), 3), ("u1", at(3), 3), ("u1", at(30), 3)]
    assert d.failed_then_success(table(rows), 2).filter("userId = 'u2'").count() == 1
    assert h.failed_then_success_new_ip(table(rows)).count() == 3
    new_ip = h.failed_then_success_new_ip(table(rows)).filter(F.col("successTime") == F.lit(at(30))).collect()
    assert [r.newIp for r in new_ip] == [True]


def test_failed_then_success_without_minimum(table):
    rows = [row("u1", at(0)), row("u1", at(5)), row("u2", at(0))]
    found = d.failed_then_success(table(rows), 0).collect()
    assert [(r.userId, r.priorFailures) for r in found] == [("u1", 0)]


def test_new_country(table):
    rows = [
        row("u1", at(days=-200), country="US"), row("u1", at(days=-100), country="DE"),
        row("u1", at(days=-5), country="SG", ip="2.2.2.2"), row("u1", at(days=-4), country="SG", ip="1.2.2.2"),
        row("u1", at(days=-3), country="US"), row("u2", at(days=-1), country="SG"), row("u3", at(0)),
    ]
    found = d.new_country(table(rows)).collect()
    assert [(r.userId, r.newCountry, r.knownCountries, r.loginTime, r.sourceIp) for r in found] == [
        ("u1", "SG", "DE,US", at(days=-5), "1.2.2.2")]
    assert h.new_country_rows(table(rows)).count() == 2


def test_stale_reactivation(table):
    rows = [row("u1", at(days=-90)), row("u1", at(0)), row("u2", at(days=-89.9)), row("u2", at(0)),
            row("u3", at(days=-400)), row("u3", at(days=-200)), row("u3", at(0))]
    found = sorted((r.userId, r.gapDays) for r in d.stale_reactivation(table(rows)).collect())
    assert found == [("u1", 90.0), ("u3", 200.0), ("u3", 200.0)]
    assert d.stale_reactivation(table(rows), 0).count() == 4


def test_weak_tls_and_missing_columns(table):
    rows = [row(tls="TLSv1"), row(tls="TLSv1.2", cipher="DES-CBC3-SHA"), row(tls=None, cipher="RC4-MD5"), row(tls=None, cipher=None)]
    assert d.weak_tls_logins(table(rows)).count() == 3
    assert d.weak_tls_logins(table(rows).drop("cipherSuite")).count() == 1
    assert d.weak_tls_logins(table(rows).select("userId")).count() == 0
    assert d.impossible_travel(table(rows).drop("countryIso")).count() == 0
    assert d.brute_force(table(rows).drop("sourceIp")).count() == 0


def test_status_spikes_ignore_flat_hours(table):
    flat = [row("u", at(60 * i)) for i in range(30)]
    assert d.status_spikes(table(flat)).count() == 0
    peak = flat + [row("u", at(0, i)) for i in range(50)]
    assert [(r.hourBucket, r.cnt) for r in d.status_spikes(table(peak)).collect()] == [(T0, 51)]


def test_human_api_logins(table):
    rows = [row(subtype="SOAP API"), row(subtype="SOAP API", name="svc.load@x"), row(subtype="REST API"),
            row(subtype="Bulk API", name=None), row(subtype="Bulk API", name="Jitterbit.Job@x")]
    assert [(r.username, r.logins) for r in d.human_api_logins(table(rows)).collect()] == [("ada.lane@x", 1)]


def test_session_overlap(spark):
    schema = "userId string, sessionKey string, loginTime timestamp, sourceIp string"
    rows = [("u", "a", at(0), "1"), ("u", "a", at(10), "1"), ("u", "b", at(5), "2"), ("u", "c", at(6), "1"),
            ("u", "d", at(20), "3"), ("v", "e", at(5), "9")]
    found = {(r.sessionKey, r.otherSessions) for r in h.session_overlap(spark.createDataFrame(rows, schema)).collect()}
    assert found == {("b", 1)}


def test_overlapping_sessions_against_every_pair(spark):
    rng = random.Random(4)
    rows = []
    for i in range(260):
        user, start = rng.choice(["hot", "hot", "u", "v"]), rng.choice([0.0, 0.0, rng.uniform(0, 5000), -1e6])
        length = rng.choice([0, 0, 1 / 60, 1, 1, 7, 64, 3000, 2e6])
        rows += [(user, f"s{i}", at(start), f"ip{rng.randrange(4)}"), (user, f"s{i}", at(start + length), "later")]
    rows += [("hot", "open", None, "x"), ("hot", None, at(0), "x"), (None, "n1", at(0), "a"), (None, "n2", at(0), "b")]
    logins = spark.createDataFrame(rows, "userId string, sessionKey string, loginTime timestamp, sourceIp string")
    got = h.overlapping_sessions(logins).collect()
    spans = {}
    for user, session, time, ip in rows:
        if None not in (user, session, time, ip):
            first, last = spans.get((user, session), ((time, ip), time))
            spans[user, session] = (min(first, (time, ip)), max(last, time))
    want = sorted((u, s, o) for (u, s), ((t, ip), _) in spans.items() for (u2, o), ((t2, ip2), e2) in spans.items()
                  if u == u2 and ip != ip2 and t2 <= t <= e2)
    assert sorted((r.userId, r.sessionKey, r.otherSession) for r in got) == want and len(want) > 1000
    counts = {(r.userId, r.sessionKey): r.otherSessions for r in h.session_overlap(logins).collect() if r.userId}
    assert counts == {(u, s): n for u, s, n in [(u, s, sum(w[:2] == (u, s) for w in want)) for u, s in spans] if n}


def test_parameters_are_checked(table):
    with pytest.raises(ValueError):
        d.impossible_travel(table([row()]), max_hours=-1)
    with pytest.raises(TypeError):
        d.brute_force(table([row()]), min_failures="10")


def test_runner(table, tmp_path):
    results = run_detectors(table([row(tls="TLSv1")]))
    assert len(results) == 9
    counts = write_all({k: results[k] for k in ("weak-tls", "status-spikes")}, str(tmp_path))
    assert counts == {"weak-tls": 1, "status-spikes": 0}
    assert (tmp_path / "weak-tls").exists() and not (tmp_path / "status-spikes").exists()
    with pytest.raises(ValueError):
        run_detectors(table([row()]), ["nothing"])


def lopsided(n=3000, seed=5):
    """Half the rows belong to one user and address, many at one instant, some without a time."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        hot = rng.random() < 0.5
        user = "hot" if hot else f"u{rng.randrange(20)}"
        time = None if rng.random() < 0.02 else at(seconds=0 if rng.random() < 0.1 else rng.randrange(0, 90_000) / 10)
        rows.append(row(user, time, "7.7.7.7" if hot else f"8.8.8.{rng.randrange(9)}",
                        rng.choice(["Success", "Invalid Password", "Invalid Password", None]), rng.choice(["US", "DE", "SG", None])))
    return rows


def key(r):
    return tuple((v is not None, v) for v in r)


def test_lopsided_previous_row(spark, small_parts):
    rows = [(u, int(t.timestamp() * 1e6), i) for i, (u, _, t, *_rest) in enumerate(lopsided()) if t is not None]
    df = spark.createDataFrame(rows, "k string, at long, i int").repartition(7)
    got = {r.i: r.previous and r.previous.i for r in with_previous(df, ["k"], ["at", "i"], ["i"]).collect()}
    want, last = {}, {}
    for k, _, i in sorted(rows, key=lambda r: (r[1], r[2])):
        want[i] = last.get(k)
        last[k] = i
    assert got == want


def test_lopsided_running_totals_and_peak(spark, small_parts):
    rng = random.Random(3)
    steps = [("hot" if rng.random() < 0.7 else "b", rng.randrange(0, 10 ** 9), rng.choice([1, -1, 2])) for _ in range(2000)]
    probes = [(rng.choice(["hot", "b", "c"]), rng.randrange(0, 10 ** 9), i) for i in range(300)]
    df = spark.createDataFrame(steps, "k string, at long, n long")
    asked = spark.createDataFrame(probes, "k string, at long, i int")
    got = {r.i: r.running_n for r in running_totals(asked, df, ["k"], ["n"]).collect()}
    assert got == {i: sum(n for k2, t2, n in steps if k2 == k and t2 <= t) for k, t, i in probes}
    peaks = {r.k: r.peak for r in running_peak(df, ["k"], "n", "peak").collect()}
    for k in ("hot", "b"):
        total, best, seen = 0, None, {}
        for _, t, n in [s for s in steps if s[0] == k]:
            seen[t] = seen.get(t, 0) + n
        for t in sorted(seen):
            total += seen[t]
            best = total if best is None else max(best, total)
        assert peaks[k] == best


@pytest.fixture
def small_parts(spark):
    """Small tables keep the parts that large ones have."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, before)


def test_one_busy_second_is_split_evenly(spark, small_parts):
    """One user has most rows, all in one second and thousands at one instant: parts and tasks stay even."""
    rows = spark.range(200_000).select(
        F.when(F.col("id") % 10 == 0, F.concat(F.lit("u"), F.col("id") % 700)).otherwise(F.lit("hot")).alias("k"),
        F.when(F.col("id") % 3 == 0, F.lit(77)).otherwise(F.col("id") * 7919 % 1_000_000).cast("long").alias("at"),
        F.col("id").alias("i"))
    line = timeline(rows, ["k"], ["at"])
    sizes = sorted(r["count"] for r in line.rows.groupBy("part").count().collect())
    assert len(sizes) == line.parts > 2 and sizes[-1] < 2 * sizes[len(sizes) // 2]
    tasks = [n for n in line.by_part().rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect() if n]
    assert max(tasks) == sizes[-1]
    found = scan(line, sums={"n": F.lit(1).cast("long")}, lasts={"before": F.struct("at", "i")})
    assert found.groupBy("k").agg(F.max("n").alias("n"), F.countDistinct("n").alias("d")).filter("n <> d").count() == 0
    wrong = found.filter((F.col("before").isNull() != (F.col("n") == 1)) | (F.struct("at", "i") <= F.col("before")))
    assert found.filter("k = 'hot'").count() == 180_000 and wrong.count() == 0


def test_parts_carry_over_whole_parts_of_one_key(spark, small_parts):
    """A key over many parts, null keys, and a value that is missing in whole parts."""
    rows = [("a", i, 1) for i in range(40)] + [("b", i, i % 2) for i in range(400)] + [(None, i, 3) for i in range(60)] + [("c", 0, 5)]
    line = timeline(spark.createDataFrame(rows, "k string, at long, n long").repartition(5), ["k"], ["at"])
    assert line.parts >= 6
    early = F.when(F.col("at") < 3, F.col("at"))
    got = {(r.k, r.at): (r.total, r.early) for r in scan(line, {"total": F.col("n")}, {"early": early}).collect()}
    want = {}
    for k in ("a", "b", "c", None):
        total, last = 0, None
        for _, t, n in sorted(r for r in rows if r[0] == k):
            total += n
            want[k, t] = (total, last)
            last = t if t < 3 else last
    assert got == want


def test_equal_rows_stay_rows(spark, small_parts):
    rows = [("u", 5)] * 4 + [("u", 9)] * 2 + [("v", 1)]
    df = spark.createDataFrame(rows, "k string, at long")
    got = sorted((r.k, r.at, r.previous.at if r.previous else -1) for r in with_previous(df, ["k"], ["at"], ["at"]).collect())
    assert got == [("u", 5, -1), ("u", 5, 5), ("u", 5, 5), ("u", 5, 5), ("u", 9, 5), ("u", 9, 9), ("v", 1, -1)]
    probes = spark.createDataFrame(rows, "k string, at long")
    assert sorted((r.k, r.at, r.running_n) for r in running_totals(probes, df.withColumn("n", F.lit(1)), ["k"], ["n"]).collect()) == [
        ("u", 5, 4)] * 4 + [("u", 9, 6)] * 2 + [("v", 1, 1)]


def test_timelines_without_rows(spark):
    none = spark.createDataFrame([], "k string, at long, n long")
    assert with_previous(none, ["k"], ["at"], ["at"]).collect() == []
    assert running_totals(none.drop("n"), none, ["k"], ["n"]).collect() == [] == running_peak(none, ["k"], "n", "p").collect()


def test_lopsided_numbering(spark, small_parts):
    rows = [("hot" if i % 3 else f"g{i % 5}", (i * 7919) % 5003) for i in range(5000)]
    got = sorted((r.g, r.v, r.seq) for r in numbered_within(spark.createDataFrame(rows, "g string, v long").repartition(9), ["g"], ["v"]).collect())
    want, seen = [], {}
    for g, v in sorted(rows):
        seen[g] = seen.get(g, 0) + 1
        want.append((g, v, seen[g]))
    assert got == want


def test_lopsided_brute_force_against_counting(table, small_parts):
    rows = lopsided()
    window = 10 * 60
    got = {r.sourceIp: (r.peakFailuresInWindow, r.uniqueUsersTargeted, r.totalFailures)
           for r in d.brute_force(table(rows), 1, 10, 1).collect()}
    want = {}
    for ip in {r[3] for r in rows}:
        failed = [(r[2], r[0]) for r in rows if r[3] == ip and r[4] not in (None, "Success")]
        peak = members = 0
        for time, _ in failed:
            inside = [(t, u) for t, u in failed
                      if (t is None and time is None) or (t and time and 0 <= (time - t).total_seconds() <= window)]
            peak, members = max(peak, len(inside)), max(members, len({u for _, u in inside}))
        if failed:
            want[ip] = (peak, members, len(failed))
    assert got == want


def test_partition_count_does_not_change_results(spark, table, small_parts):
    df = table(lopsided(800))
    one = sorted(map(key, d.failed_then_success(df.coalesce(1), 2).collect()))
    many = sorted(map(key, d.failed_then_success(df.repartition(13), 2).collect()))
    assert one == many and one


def test_every_copy_of_a_login_counts_at_no_pause(table):
    rows = [row("u", at(seconds=s)) for s in (0, 0, 0, 5, 5, 90)] + [row("v", at(seconds=1))]
    assert d.stale_reactivation(table(rows), 0).count() == 5


def scans_and_shuffles(plan):
    """Table scans and shuffles of a plan; a shuffle that is read again counts once."""
    text = plan._jdf.queryExecution().executedPlan().toString()
    return text.count("FileScan"), sum(text.count(f"Exchange {kind}") for kind in (
        "hashpartitioning", "rangepartitioning", "shufflepartitionid", "SinglePartition", "RoundRobin"))


@pytest.fixture
def whole_work(monkeypatch):
    """Adds up scans and shuffles of a result's plan and of all tables that are written on the way."""
    from tallyward import session
    from tallyward.operators import detectors, hunts, timeline as lines
    from tallyward.plans import shared

    written, work = session.written, []

    def counted(df, name="stage"):
        work.append(scans_and_shuffles(df))
        return written(df, name)

    for module in (session, lines, detectors, hunts, shared):
        monkeypatch.setattr(module, "written", counted)

    def total(*results):
        counts = [*work, *(scans_and_shuffles(r) for r in results)]
        return sum(c[0] for c in counts), sum(c[1] for c in counts)

    return total


@pytest.mark.parametrize("name, most", [
    ("i01_impossible_travel", 3), ("i02_brute_force", 5), ("i03_failed_then_success", 3),
    ("i15_failed_then_success_new_ip", 6), ("i20_login_after_failed_mfa", 3), ("i24_overlapping_sessions", 3),
    ("i24_session_overlap", 9)])
def test_scans_with_those_of_written_tables(spark, sf_dir, whole_work, name, most):
    import __spark_entry__ as entry_point

    scans, _ = whole_work(entry_point.queries()[name](spark, sf_dir))
    assert scans <= most


def test_all_detectors_share_their_passes(spark, sf_dir, whole_work, small_parts):
    """Of the logins and of all tables written on the way; each detector on its own takes more."""
    from tallyward.checks.tables import logins

    table = logins(spark, sf_dir)
    results = run_detectors(table)
    scans, shuffles = whole_work(*results.values())
    assert len(results) == 9 and scans <= 20 and shuffles <= 27
    finish = [scans_and_shuffles(r) for r in results.values()]
    assert sum(f[0] for f in finish) <= 12 and sum(f[1] for f in finish) <= 14


def test_shared_results_are_those_of_single_detectors(table):
    rows = lopsided(900) + [row("u1", at(days=-200), country="US"), row("u1", at(days=-1), country="SG", subtype="SOAP API", tls="TLSv1")]
    logins = table(rows)
    parameters = {"new-country": {"lookback_days": 30}, "status-spikes": {"zscore_threshold": 0.5}, "stale-reactivation": {"min_dormant_days": 5},
                  "brute-force": {"min_failures": 3, "min_unique_users": 1}}
    together = run_detectors(logins, parameters=parameters)
    for name, result in together.items():
        alone = run_detectors(logins, [name], parameters)[name]
        assert result.columns == alone.columns and sorted(map(key, result.collect())) == sorted(map(key, alone.collect())), name
    assert sum(r.count() > 0 for r in together.values()) >= 7
