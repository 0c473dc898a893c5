"""Strict parsing of option columns: a default for nulls and blanks, an error for anything out of range.

Each rule comes in two forms. ``boolean``, ``number`` and ``positive_int`` fail the job where a value
is bad. ``checked_*`` give the value with its error, a struct (value, error: field, type, message), so
that one bad setting costs its own row alone; :func:`settings` parts a table of settings by them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip

TRUE, FALSE = ("true", "1", "yes", "y", "on"), ("false", "0", "no", "n", "off")
ERROR = "struct<field: string, type: string, message: string>"


def blank_to_null(value: Column) -> Column:
    return F.nullif(strip(value), F.lit(""))


def _checked(given: Column, default, parsed: Column, ok: Column, kind: str, field: str, what: str) -> Column:
    """(value, error): the default where nothing is given, the parsed value where it is ok, else an error."""
    bad = given.isNotNull() & ~F.coalesce(ok, F.lit(False))
    error = F.struct(F.lit(field).alias("field"), F.lit("ValueError").alias("type"), F.concat(F.lit(f"{field} must be {what}: "), given).alias("message"))
    value = F.when(given.isNull(), F.lit(default).cast(kind)).when(~bad, parsed.cast(kind))
    return F.struct(value.alias("value"), F.when(bad, error).otherwise(F.lit(None).cast(ERROR)).alias("error"))


def _or_fail(checked: Column, kind: str) -> Column:
    return F.when(checked["error"].isNotNull(), F.raise_error(checked["error"]["message"]).cast(kind)).otherwise(checked["value"])


def checked_boolean(value: Column, default: bool | None, field: str) -> Column:
    v = blank_to_null(value)
    low = F.lower(v)
    return _checked(v, default, low.isin(*TRUE), low.isin(*TRUE, *FALSE), "boolean", field, "a boolean")


def checked_number(value: Column, default: float | None, field: str, least: float | None = None, above: float | None = None) -> Column:
    """A double of at least ``least``, or over ``above``."""
    v = blank_to_null(value)
    n = v.try_cast("double")
    ok = n.isNotNull() & ~F.isnan(n)
    if least is not None:
        ok = ok & (n >= least)
    if above is not None:
        ok = ok & (n > above)
    return _checked(v, default, n, ok, "double", field, "a number in range")


def checked_positive_int(value: Column, default: int | None, field: str) -> Column:
    v = blank_to_null(value)
    n = v.try_cast("int")
    return _checked(v, default, n, n.isNotNull() & (n > 0) & v.rlike(r"^[+-]?\d+$"), "int", field, "a positive whole number")


def boolean(value: Column, default: bool, field: str) -> Column:
    return _or_fail(checked_boolean(value, default, field), "boolean")


def number(value: Column, default: float | None, field: str, least: float | None = None, above: float | None = None) -> Column:
    """A double of at least ``least``, or over ``above``."""
    return _or_fail(checked_number(value, default, field, least, above), "double")


def positive_int(value: Column, default: int, field: str) -> Column:
    return _or_fail(checked_positive_int(value, default, field), "int")


def settings(rows: DataFrame, rules: dict[str, Callable[[Column], Column]]) -> tuple[DataFrame, DataFrame]:
    """rows (run_id, and a text a setting) parted: runs with all settings parsed, and (run_id, errors) of those with a bad one.

    rules: for each setting what gives its (value, error) from its text, one of the checked rules."""
    names = list(rules)
    held = rows.select("run_id", *[rules[c](F.col(f"`{c}`")).alias(c) for c in names])
    errors = F.array_compact(F.array(*[F.col(f"`{c}`.error") for c in names]))
    held = held.withColumn("__errors", errors)
    good = held.where(F.size("__errors") == 0).select("run_id", *[F.col(f"`{c}`.value").alias(c) for c in names])
    return good, held.where(F.size("__errors") > 0).select("run_id", F.col("__errors").alias("errors"))


def string_list(value: Column, default: list[str]) -> Column:
    items = F.filter(F.transform(F.split(value, ","), strip), lambda x: x != "")
    return F.when(value.isNull() | (F.size(items) == 0), F.array(*[F.lit(x) for x in default]).cast("array<string>")).otherwise(items)


def duration(value: Column) -> Column:
    n = value.try_cast("double")
    return F.when(n >= 0, n)


def resolution(width: Column, height: Column) -> Column:
    return F.when(width.isNotNull() & height.isNotNull(), F.concat(width.cast("string"), F.lit("x"), height.cast("string")))
