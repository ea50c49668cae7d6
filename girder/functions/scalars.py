"""Scalar rules of the scene model, as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def first_nonblank(*columns: Column) -> Column:
    """The first trimmed value that is not empty."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def stable_id(global_id: Column, step_id: Column) -> Column:
    """guid:<global id>, or step:<step id> where there is none."""
    return F.coalesce(F.concat(F.lit("guid:"), F.nullif(F.trim(global_id), F.lit(""))), F.concat(F.lit("step:"), step_id.cast("string")))


def rounded(x: Column) -> Column:
    """A property's number as text: nine decimals half-even, minus zero as zero, non-finite numbers by name."""
    value = F.bround(x, 9)
    return F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").otherwise((value + F.lit(0.0)).cast("string"))


def slug(text: Column) -> Column:
    """Lower-case runs of letters and digits joined by hyphens, or 'unnamed' (P05)."""
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-")), F.lit("")), F.lit("unnamed"))


def metres(x: Column, scale: Column) -> Column:
    """A scaled translation: in single precision unless that is off by more than 1e-8."""
    value = x * scale
    single = value.cast("float").cast("double")
    return F.when(F.abs(value - single) <= 1e-8, single).otherwise(value)


def high_low(x: Column) -> tuple[Column, Column]:
    """A number as the sum of two in single precision."""
    high = x.cast("float")
    return high, (x - high.cast("double")).cast("float")


def identity_state(value: Column, derived: Column) -> Column:
    """0: explicitly nothing, 1: omitted as it equals the derived value, 2: explicit."""
    return F.when(value.isNull(), 0).when(value == derived, 1).otherwise(2)


def identity_value(state: Column, explicit: Column, derived: Column) -> Column:
    """The inverse of identity_state."""
    return F.when(state == 1, derived).when(state == 2, explicit)


def transform_kind(m: Column) -> Column:
    """'identity', 'translation' or 'matrix' for a column-major 4x4 array."""
    unit = [1.0 if i % 5 == 0 else 0.0 for i in range(16)]
    same = lambda i: F.element_at(m, i + 1) == F.lit(unit[i])
    frame = same(0)
    for i in range(1, 16):
        if i not in (12, 13, 14):
            frame = frame & same(i)
    return F.when(frame & same(12) & same(13) & same(14), "identity").when(frame, "translation").otherwise("matrix")


def finite_matrix(m: Column) -> Column:
    """The array, or the identity where a number is not finite."""
    unit = F.array(*[F.lit(1.0 if i % 5 == 0 else 0.0) for i in range(16)])
    return F.when(F.exists(m, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), unit).otherwise(m)


def normal_error(text: Column) -> Column:
    """Digits as N, 160 characters."""
    return F.substring(F.regexp_replace(text, "[0-9]+", "N"), 1, 160)


# fixed values: what an absolute path looks like on a network share, on a drive, and with two segments or more below the root
PATHS = (
    r"\\\\[^\p{IsWhite_Space}\"',;)\]]+",
    r"[A-Za-z]:[\\/][^\p{IsWhite_Space}\"',;)\]]*",
    r"(?<![\w:/])/(?:[\w.@+-]+/)+[\w.@+-]*",
)


def redacted(text: Column, known: list[str]) -> Column:
    """Known paths, longest first, each also with its backslashes as slashes, then what looks like an absolute path."""
    for k in sorted({k for k in known if k}, key=lambda k: (-len(k), k)):
        for form in (k, k.replace("\\", "/")):
            text = F.replace(text, F.lit(form), F.lit("<path>"))
    for pattern in PATHS:
        text = F.regexp_replace(text, pattern, "<path>")
    return text


def basename(path: Column) -> Column:
    """What follows the last slash of either kind."""
    return F.element_at(F.split(path, r"[/\\]"), -1)


def visible(node: Column, hidden: Column, isolated: Column) -> Column:
    """Isolation beats hiding (P10). hidden: whether the node is in the hidden set; isolated: the isolated id or null."""
    return F.when(isolated.isNotNull(), node == isolated).otherwise(~hidden)


def within_section(x: Column, y: Column, z: Column, plane: tuple[float, float, float, float]) -> Column:
    """Whether a point is kept by the plane: normal . point <= offset."""
    a, b, c, d = plane
    return a * x + b * y + c * z <= d


def sphere_in_planes(x: Column, y: Column, z: Column, radius: Column, planes: list[tuple[float, float, float, float]]) -> Column:
    """Whether a sphere is not wholly behind one of the unit planes."""
    inside = F.lit(True)
    for a, b, c, d in planes:
        inside = inside & (a * x + b * y + c * z + d >= -radius)
    return inside


@F.pandas_udf(StringType())
def nfkc_lower(text: pd.Series) -> pd.Series:
    """NFKC and lower case: Spark has no built-in for the former."""
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s).lower())


def has_all_tokens(haystack: Column, query: str) -> Column:
    """Whether every blank-separated token of the query is in the haystack; no token: nowhere."""
    tokens = unicodedata.normalize("NFKC", query).lower().split()
    found = F.lit(bool(tokens))
    for t in tokens:
        found = found & F.contains(haystack, F.lit(t))
    return found
