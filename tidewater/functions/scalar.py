"""Scalar functions, ``Column`` to ``Column``, without UDFs."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Accented letters and their bare ones, for ``translate``.
ACCENTED = "".join(c for c in map(chr, range(0xC0, 0x180)) if len(unicodedata.normalize("NFD", c)) == 2)
BARE = "".join(unicodedata.normalize("NFD", c)[0] for c in ACCENTED)


def parse_utc_ts(c: Column) -> Column:
    """Text to a UTC timestamp without zone: 13-digit epoch milliseconds, ISO with T and Z, or plain; else null."""
    t = F.trim(c)
    millis = F.when(t.rlike(r"\A[0-9]{13}\z"), t).try_cast("bigint")
    iso = F.regexp_replace(F.regexp_replace(t, "T", " "), "Z$", "")
    plain = r"[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?"
    return (
        F.when(millis.isNotNull(), F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.timestamp_millis(millis).cast("timestamp_ntz")))
        .when(t.rlike(r"\A" + plain.replace(" ", "T") + r"Z\z"), iso.try_cast("timestamp_ntz"))
        .when(t.rlike(r"\A" + plain + r"\z"), t.try_cast("timestamp_ntz"))
    )


def business_date(ts: Column, tz: str) -> Column:
    """Calendar day of a UTC timestamp in the business zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), ts).cast("date")


def clean_text(c: Column) -> Column:
    """White space collapsed and trimmed; nothing left is null."""
    return F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))


def strip_accents(c: Column) -> Column:
    return F.translate(c, ACCENTED, BARE)


def normalize_key(c: Column) -> Column:
    """Accents off, upper case, A-Z and 0-9 only; nothing left is null."""
    return F.nullif(F.regexp_replace(F.upper(strip_accents(c)), "[^A-Z0-9]", ""), F.lit(""))


def parse_number(c: Column, precision: int = 18, scale: int = 2) -> Column:
    """Thousands commas dropped, cast to decimal; null where it is no number."""
    return F.trim(F.replace(c, F.lit(","), F.lit(""))).try_cast(f"decimal({precision},{scale})")


def trailing_id(c: Column) -> Column:
    """The digits that end a reference."""
    return F.nullif(F.regexp_extract(c, r"([0-9]+)$", 1), F.lit("")).cast("bigint")


def scale_minor_units(amount: Column, source: Column, legacy: str = "legacy_v1") -> Column:
    return F.when(source == legacy, amount / 100).otherwise(amount).cast("decimal(18,2)")


def op_rank(op: Column) -> Column:
    return F.when(op == "I", 1).when(op == "U", 2).when(op == "D", 3)


def surrogate_key(*columns: Column) -> Column:
    return F.md5(F.concat_ws("-", *[F.coalesce(c.cast("string"), F.lit("_null_")) for c in columns]))


def dpd_bucket(days: Column) -> Column:
    return F.when(days <= 0, "0").when(days <= 30, "1-30").when(days <= 60, "31-60").when(days <= 90, "61-90").otherwise("90+")


def value_shape(c: Column) -> Column:
    """Each digit as 9."""
    return F.regexp_replace(c, "[0-9]", "9")


def message_time(c: Column, offset: str = "-05:00") -> Column:
    """ISO text to UTC; without an offset of its own it stands in ``offset``."""
    t = F.regexp_replace(F.trim(c), "T", " ")
    zoned = t.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})\z")
    local = F.convert_timezone(F.lit(offset), F.lit("UTC"), t.try_cast("timestamp_ntz"))
    return F.when(zoned, F.convert_timezone(F.current_timezone(), F.lit("UTC"), t.try_cast("timestamp").cast("timestamp_ntz"))).otherwise(local)


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def message_text(c: Column) -> Column:
    """Unicode NFC with white space collapsed; the only scalar function that needs Python."""
    return F.trim(F.regexp_replace(nfc(c), r"\s+", " "))


def canonical_tokens(c: Column) -> Column:
    """Lower case, accents off, runs of a-z and 0-9."""
    return F.regexp_extract_all(strip_accents(F.lower(c)), F.lit("([a-z0-9]+)"), F.lit(1))


def content_hash(tokens: Column) -> Column:
    return F.substring(F.sha1(F.array_join(tokens, " ")), 1, 16)
