"""Predicates and small expressions over login columns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.fixed import API_SUBTYPES, INTEGRATION_WORDS, WEAK_CIPHER_PARTS, WEAK_TLS


def is_success(status: Column | None = None) -> Column:
    return (F.col("status") if status is None else status) == "Success"


def is_failure(status: Column | None = None) -> Column:
    """A NULL status is neither a success nor a failure."""
    return (F.col("status") if status is None else status) != "Success"


def is_integration(username: Column, words: Sequence[str] = INTEGRATION_WORDS) -> Column:
    return F.lower(username).rlike("|".join(re.escape(w) for w in words))


def likely_human(username: Column, words: Sequence[str] = INTEGRATION_WORDS) -> Column:
    """NULL for a NULL username."""
    return ~is_integration(username, words)


def human_address(username: Column) -> Column:
    """``first.last@`` form."""
    return username.rlike(r"^[a-z]+\.[a-z]+@")


def is_api_subtype(subtype: Column, subtypes: Sequence[str] = API_SUBTYPES) -> Column:
    return subtype.isin(list(subtypes))


def mentions_api(subtype: Column) -> Column:
    return subtype.rlike("(?i)(API|Metadata|Bulk)")


def weak_tls(columns: Sequence[str]) -> Column | None:
    """Outdated protocol or weak cipher, over those of the two columns that are present."""
    tests = []
    if "tlsProtocol" in columns:
        tests.append(F.col("tlsProtocol").isin(list(WEAK_TLS)))
    if "cipherSuite" in columns:
        tests.extend(F.col("cipherSuite").contains(part) for part in WEAK_CIPHER_PARTS)
    if not tests:
        return None
    condition = tests[0]
    for test in tests[1:]:
        condition = condition | test
    return condition


def mask_ip(ip: Column) -> Column:
    return F.regexp_replace(ip, r"\.\d+$", ".xxx")


def distinct_list(column: str, separator: str) -> Column:
    """Sorted distinct values joined by a separator; NULL where there are none."""
    values = F.collect_set(column)
    return F.when(F.size(values) > 0, F.array_join(F.array_sort(values), separator))


def has_columns(df: DataFrame, *names: str) -> bool:
    return set(names) <= set(df.columns)


def user_column(df: DataFrame) -> str | None:
    """``userId`` if present, else ``username``."""
    for name in ("userId", "username"):
        if name in df.columns:
            return name
    return None
