"""Helpers that pair a query with its SQL."""

from __future__ import annotations

from tallyward.checks.tables import LOGINS_CTE, USERS_CTE, logins, plain_times, users


def registry():
    calls: dict = {}
    sqls: dict = {}

    def over_logins(name, build, sql, ctes=()):
        calls[name] = lambda spark, sf_dir: plain_times(build(logins(spark, sf_dir)))
        if sql is not None:
            sqls[name] = f"WITH {', '.join([LOGINS_CTE, *ctes])} {sql}"

    def over_users(name, build, sql, ctes=()):
        calls[name] = lambda spark, sf_dir: plain_times(build(logins(spark, sf_dir), users(spark, sf_dir)))
        if sql is not None:
            sqls[name] = f"WITH {', '.join([LOGINS_CTE, USERS_CTE, *ctes])} {sql}"

    return calls, sqls, over_logins, over_users
