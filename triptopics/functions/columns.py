"""Scalar column expressions (P-xx operators); all JVM-side built-ins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_FIRST_FORMAT = "dd/MM/yyyy HH:mm:ss"


def parse_day_first(col: str | Column, fmt: str = DAY_FIRST_FORMAT) -> Column:
    """Day-first timestamp text -> timestamp; impossible dates become NULL (P-02)."""
    return F.try_to_timestamp(F.col(col) if isinstance(col, str) else col, F.lit(fmt))


def hour_bucket(ts: str | Column) -> Column:
    """Truncate a wall-clock timestamp to the hour (P-04: strftime('%Y-%m-%d %H')).

    Built field by field as TIMESTAMP_NTZ: ``date_trunc`` would go through the
    session time zone and move buckets inside a daylight-saving gap."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.make_timestamp_ntz(F.year(c), F.month(c), F.dayofmonth(c), F.hour(c), F.lit(0), F.lit(0))


def token(prefix: str, value: str | Column) -> Column:
    """``'O' + str(int(x))`` (P-05)."""
    v = F.col(value) if isinstance(value, str) else value
    return F.concat(F.lit(prefix), v.cast("bigint").cast("string"))


def triple_token(o: str | Column, d: str | Column, t: str | Column) -> Column:
    """``O#_D#_T#`` (P-06)."""
    return F.concat_ws("_", token("O", o), token("D", d), token("T", t))


def token_digits(col: str | Column) -> Column:
    """Integer carried by a token such as ``O12`` (P-07)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_extract(c, r"(\d+)", 1).cast("int")


def repeat_tokens(tok: str | Column, count: str | Column) -> Column:
    """``int(count) * [word]`` (P-10)."""
    t = F.col(tok) if isinstance(tok, str) else tok
    c = F.col(count) if isinstance(count, str) else count
    return F.array_repeat(t, c.cast("int"))


def clamp_positive(col: str | Column, floor: float = 1e-2) -> Column:
    """``x <= 0 -> floor`` (P-12)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c <= 0, F.lit(floor)).otherwise(c)


def l1_normalise(df: DataFrame, value: str, by: list[str], out: str | None = None) -> DataFrame:
    """Row-wise L1 normalisation of a long table (P-13); an all-zero row stays zero."""
    total = F.sum(F.abs(F.col(value))).over(Window.partitionBy(*by))
    return df.withColumn(out or value, F.when(total == 0, F.col(value)).otherwise(F.col(value) / total))


def minutes(seconds: str | Column) -> Column:
    """Whole minutes of a seconds count (P-16)."""
    c = F.col(seconds) if isinstance(seconds, str) else seconds
    return (c / 60).cast("int")
