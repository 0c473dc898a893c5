"""Text expressions: Unicode-aware white space, clipping, containment, timestamps, markup."""

from __future__ import annotations

import html

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def norm_ws(text: Column) -> Column:
    """Runs of any Unicode white space become one space; none at the ends."""
    return F.btrim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+$", "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def clip(text: Column, most: int | Column) -> Column:
    """Normalised text of at most ``most`` characters, the last three dots where it was cut; under three, the dots stay."""
    most = F.lit(most) if isinstance(most, int) else most
    whole = norm_ws(text)
    return F.when(F.char_length(whole) <= most, whole).otherwise(F.concat(rstrip(F.substring(whole, F.lit(1), F.greatest(most - 3, F.lit(0)))), F.lit("...")))


def cut(text: Column, most: int) -> Column:
    """Normalised text cut without dots, for recognised text."""
    return rstrip(F.substring(norm_ws(text), 1, most))


def contained(inner: Column, outer: Column) -> Column:
    """Whether inner is part of outer, by normalised lower case; an empty inner never is."""
    a, b = F.lower(norm_ws(inner)), F.lower(norm_ws(outer))
    return (F.char_length(a) > 0) & F.contains(b, a)


def title_hint(text: Column, least: int) -> Column:
    """The first line long enough, else the whole text if that is, else null."""
    lines = F.filter(F.transform(F.split(text, "\n"), norm_ws), lambda x: F.char_length(x) >= least)
    whole = norm_ws(text)
    return F.coalesce(F.get(lines, F.lit(0)), F.when(F.char_length(whole) >= least, whole))


def parse_timestamp(value: Column) -> Column:
    """Seconds of [HH:]MM:SS[.,]mmm; null for any other number of parts."""
    parts = F.split(F.translate(value, ",", "."), ":")
    number = lambda k: F.element_at(parts, k).try_cast("double")
    hours = F.when(F.size(parts) == 3, F.get(parts, F.lit(0)).try_cast("int"))
    return F.when(F.size(parts) == 3, hours * 3600 + F.get(parts, F.lit(1)).try_cast("int") * 60 + number(-1)).when(F.size(parts) == 2, F.get(parts, F.lit(0)).try_cast("int") * 60 + number(-1))


def format_timestamp(seconds: Column) -> Column:
    """HH:MM:SS of whole seconds, none below zero."""
    s = F.greatest(F.floor(seconds), F.lit(0)).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(F.pmod(s, F.lit(3600)) / 60).cast("long"), F.pmod(s, F.lit(60)))


def time_token(seconds: Column) -> Column:
    return F.format_string("%010.3f", seconds.cast("double"))


@F.arrow_udf(StringType())
def _unescaped(text: pa.Array) -> pa.Array:
    return pa.array([None if x is None else html.unescape(x) for x in text.to_pylist()], pa.string())


def without_tags(text: Column) -> Column:
    return norm_ws(F.regexp_replace(text, "<[^>]+>", ""))


def strip_markup(text: Column) -> Column:
    """Without tags and with all HTML entities decoded last, so that an escaped tag stays text; only texts with & go to Python."""
    plain = without_tags(text)
    return strip(F.coalesce(_unescaped(F.when(F.contains(plain, F.lit("&")), plain)), plain))


def image_path(path: Column) -> Column:
    return F.concat(F.lit("assets/keyframes/"), F.element_at(F.split(path, "/"), -1))
