"""Column-level rules shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that may surround a code: blanks, tabs and line ends.
CODE_BLANKS = " \t\r\n"


def clean_code(code: Column) -> Column:
    """A code without surrounding white space, in upper case; null stays null."""
    return F.upper(F.btrim(code, F.lit(CODE_BLANKS)))


def finite(value: Column) -> Column:
    """The value as double; NaN and the infinities are read as null."""
    v = value.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def to_units(value: Column, scale: int) -> Column:
    """The value in whole units of 10**-scale, for sums that don't depend on the order of rows.

    Exact for values with at most ``scale`` decimals and below 2**53 units.
    """
    return F.round(value * F.lit(float(10**scale))).cast("long")


def from_units(units: Column, scale: int) -> Column:
    """Units back to an exact decimal."""
    return (units.cast("decimal(28,0)") * F.lit("1").cast("decimal(1,0)") / F.lit(str(10**scale)).cast(f"decimal({scale + 1},0)")).cast(
        f"decimal(28,{scale})"
    )


def day_number(time: Column) -> Column:
    """Days since 1970-01-01, of the calendar date of a timestamp."""
    return F.datediff(F.to_date(time), F.lit("1970-01-01").cast("date"))


def micros(time: Column) -> Column:
    """Microseconds since 1970-01-01 of a timestamp without time zone, whatever the session's zone."""
    local = time.cast("timestamp_ntz")
    if SparkSession.active().conf.get("spark.sql.session.timeZone") in ("UTC", "Etc/UTC", "GMT", "Z"):
        # Here the number is there already; elsewhere it takes calendar arithmetic.
        return F.unix_micros(local.cast("timestamp"))
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), local)


def stretch_number(number: Column, length: int) -> Column:
    """Which stretch of ``length`` a whole number lies in, exact beyond the precision of doubles."""
    return F.round((number - F.pmod(number, F.lit(length))) / length).cast("long")


def live_rows(
    df: DataFrame, subject: str = "subject_id", code: str = "code", time: str = "time", value: str = "numeric_value"
) -> DataFrame:
    """Distinct (subject_id, code, time, numeric_value) of rows with subject and code.

    Codes are cleaned and NaN is null before rows are compared; nulls compare equal. Other
    columns, whatever their names, are dropped. An empty table gives an empty table.
    Repeated rows are first merged inside each task, so a hot subject costs one hash table entry
    per distinct row and its rows are spread over all partitions by the hash of all four columns.
    """
    return (
        df.select(
            F.col(subject).cast("long").alias("subject_id"),
            clean_code(F.col(code)).alias("code"),
            F.col(time).alias("time"),
            finite(F.col(value)).alias("numeric_value"),
        )
        .where(F.col("subject_id").isNotNull() & F.col("code").isNotNull())
        .distinct()
    )
