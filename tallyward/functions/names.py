"""File and folder names of an export, ids and error report fields."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyward.fixed import INVALID_NAME_CHARS, MISSING_ID, NAME_LIMIT

WHITE = r"[\s\x1C-\x1F\u1680\u2000-\u2006\u2008-\u200A\u2028\u2029\u205F\u3000]"


@F.pandas_udf(T.StringType())
def _composed(names: pd.Series) -> pd.Series:
    return names.map(lambda n: unicodedata.normalize("NFC", n) if n else None)


def first_match(value: Column, pattern: str, group: int = 0) -> Column:
    """First match (or group of it), NULL where there is none."""
    return F.get(F.regexp_extract_all(value, F.lit(pattern), F.lit(group)), F.lit(0))


def composed(name: Column) -> Column:
    """Unicode NFC form. Names in ASCII need none and go to Python as NULLs."""
    return F.coalesce(_composed(first_match(name, r"(?s)^.*[^\x00-\x7F].*\z")), name)


def as_it_is(name: Column) -> Column:
    """For names that are known to be in NFC, as those in ASCII are: no Python worker is needed."""
    return name


def is_ascii(*values: Column) -> Column:
    """All of the values are in ASCII or NULL."""
    return F.concat_ws("", *values).rlike(r"^[\x00-\x7F]*\z")


def is_blank(value: Column) -> Column:
    return F.coalesce(value.rlike(rf"^{WHITE}*\z"), F.lit(True))


def trimmed(value: Column) -> Column:
    """Without control characters and spaces at both ends."""
    return F.regexp_replace(value, r"^[\x00-\x20]+|[\x00-\x20]+\z", "")


def filled(value: Column) -> Column:
    """The value, or NULL if it is blank."""
    return first_match(value, rf"(?s)^{WHITE}*+.+\z")


def normalized_id(value: Column) -> Column:
    return first_match(F.upper(trimmed(value)), r"(?s)^.+\z")


def bracket_text(value: Column) -> Column:
    """Trimmed text between the last ``[`` and the last ``]`` after it, else NULL."""
    return trimmed(first_match(value, r"(?s)\[([^\[]*)\][^\[\]]*\z", 1))


def bracket_id(value: Column) -> Column:
    return normalized_id(bracket_text(value))


def sanitized(value: Column, nfc: Callable[[Column], Column] = composed) -> Column:
    """NFC, forbidden characters to ``_``, single blanks, trimmed; empty for NULL."""
    name = F.regexp_replace(nfc(value), INVALID_NAME_CHARS, "_")
    return F.coalesce(trimmed(F.regexp_replace(name, r"\s+", " ")), F.lit(""))


def sanitized_id(value: Column) -> Column:
    clean = F.regexp_replace(trimmed(filled(value)), INVALID_NAME_CHARS, "_")
    return F.coalesce(F.regexp_replace(clean, r"^\z", MISSING_ID), F.lit(MISSING_ID))


def sanitized_extension(value: Column, nfc: Callable[[Column], Column] = composed) -> Column:
    bare = F.replace(sanitized(F.regexp_replace(filled(value), r"^\.", ""), nfc), F.lit(" "), F.lit(""))
    return F.regexp_replace(bare, r"(?s)^(?=.)", ".")


def _with_id(name: Column, id_: Column, extension: Column) -> Column:
    """The parts are bound once, so the expression stays small when names are nested in paths."""
    tail = F.concat(F.lit("["), id_, F.lit("]"), extension)

    def joined(p: Column) -> Column:
        room = F.greatest(F.lit(0), F.lit(NAME_LIMIT - 1) - F.length(p["tail"]))
        return F.when(p["name"] == "", p["tail"]).otherwise(
            F.concat(F.substring(p["name"], F.lit(1), room), F.lit(" "), p["tail"]))

    return F.get(F.transform(F.array(F.struct(name.alias("name"), tail.alias("tail"))), joined), F.lit(0))


def folder_name(name: Column, id_: Column, nfc: Callable[[Column], Column] = composed) -> Column:
    """``Name [Id]`` of at most 255 characters, or ``[Id]``."""
    return _with_id(sanitized(name, nfc), sanitized_id(id_), F.lit(""))


def target_file_name(base: Column, id_: Column, extension: Column, nfc: Callable[[Column], Column] = composed) -> Column:
    """``Base [Id].ext`` of at most 255 characters, or ``[Id].ext``."""
    return _with_id(sanitized(base, nfc), sanitized_id(id_), sanitized_extension(extension, nfc))


def base_and_extension(name: Column) -> tuple[Column, Column]:
    """Split at the last dot unless it comes first or last."""
    pattern = r"(?s)^(.+)(\.[^.]+)\z"
    return F.regexp_replace(name, pattern, "$1"), F.regexp_extract(name, pattern, 2)


def path_key(path: Column) -> Column:
    """Path in which a segment with an id counts by that id, so that a rename keeps the key."""
    return F.array_join(F.transform(F.split(path, "/"), segment_key), "/")


def segment_key(segment: Column) -> Column:
    return F.coalesce(F.concat(F.lit("#"), bracket_text(segment)), segment)


def instant_text(time: Column) -> Column:
    """ISO instant with as few fraction digits as needed (0, 3 or 6); empty for NULL."""
    micros = F.pmod(F.unix_micros(time), F.lit(1_000_000))
    return F.when(time.isNull(), "").when(micros == 0, F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(
        micros % 1000 == 0, F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).otherwise(
        F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
