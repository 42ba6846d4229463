"""Times detectors and the profile on replicated logins, a third of them of one user and address.

``SCALE_ROWS`` rows (default 15 million) are derived from the events table, written once as
Parquet below the shared folder and read from there.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from tallyward.checks.tables import logins  # noqa: E402
from tallyward.operators import detectors as d  # noqa: E402
from tallyward.operators import hunts as h  # noqa: E402
from tallyward.operators import profile as p  # noqa: E402
from tallyward.operators import subtypes as s  # noqa: E402
from tallyward.session import build_session, new_path  # noqa: E402

COLUMNS = ["userId", "username", "loginTime", "sourceIp", "status", "loginSubType", "loginType", "countryIso",
           "tlsProtocol", "cipherSuite", "browser", "platform", "application"]


def replicated(spark, sf_dir: str, rows: int):
    base = logins(spark, sf_dir).select(*COLUMNS)
    copies = max(1, rows // base.count())
    wide = base.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    hot = F.col("copy") % 3 == 0
    moved = F.timestamp_micros(F.unix_micros("loginTime") + F.col("copy") * 7_919_000)
    return wide.withColumns({
        "loginTime": F.timestamp_millis(F.unix_millis(moved)),
        "userId": F.when(hot, "005hot").otherwise(F.concat("userId", F.lit("-"), F.col("copy") % 50)),
        "sourceIp": F.when(hot, "10.9.9.9").otherwise(F.concat("sourceIp", F.lit("-"), F.col("copy") % 50))}).drop("copy")


def main() -> None:
    spark = build_session("scale", "local[8]", 32)
    spark.sparkContext.setLogLevel("ERROR")
    path = new_path(spark, "scale-logins")
    replicated(spark, os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"),
               int(os.environ.get("SCALE_ROWS", "15000000"))).repartition(32).write.parquet(path)
    table = spark.read.parquet(path)
    print(json.dumps({"rows": table.count(), "hottest_user": table.filter("userId = '005hot'").count()}), flush=True)
    runs = {
        "profile_all_distributions": lambda: p.distributions(p.value_counts(table)),
        "profile_scale": lambda: p.scale(p.value_counts(table)),
        "profile_hints": lambda: p.hints(table),
        "status_spikes": lambda: d.status_spikes(table),
        "impossible_travel": lambda: d.impossible_travel(table),
        "brute_force": lambda: d.brute_force(table),
        "failed_then_success": lambda: d.failed_then_success(table),
        "new_country": lambda: d.new_country(table, 14),
        "stale_reactivation": lambda: d.stale_reactivation(table, 2),
        "human_api_logins": lambda: d.human_api_logins(table),
        "weak_tls": lambda: d.weak_tls_logins(table),
        "off_hours": lambda: h.off_hours(table, 1.5),
        "user_summary": lambda: s.user_summary(table, ["SOAP API", "Bulk API"]),
    }
    only = sys.argv[1:]
    for name, build in runs.items():
        if only and name not in only:
            continue
        started = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        print(json.dumps({name: round(time.perf_counter() - started, 1)}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
