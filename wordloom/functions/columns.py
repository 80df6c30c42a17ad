"""Column functions shared by the operators."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int | str, *keys: Column | str) -> Column:
    """A number in [0, 1) that depends on the seed and the keys only, not on partitions.

    Keys are joined as text, so the same draw can be made in other engines.
    """
    parts = [F.lit(str(seed)), *((F.col(k) if isinstance(k, str) else k).cast("string") for k in keys)]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def word_of(key: Column) -> Column:
    """The part before the last slash; the whole key if it has none."""
    return F.when(F.instr(key, "/") > 0, F.regexp_extract(key, r"^(.*)/([^/]*)$", 1)).otherwise(key)


def pos_of(key: Column) -> Column:
    """The part after the last slash; empty if there is none."""
    return F.when(F.instr(key, "/") > 0, F.regexp_extract(key, r"^(.*)/([^/]*)$", 2)).otherwise(F.lit(""))


def wrap(value: Column, low: int = 1, size: int = 7) -> Column:
    """The value moved into low .. low + size - 1 by whole turns."""
    return F.pmod(value - low, F.lit(size)) + low


def safe_log2(value: Column) -> Column:
    """Base-2 logarithm, null for values that have none."""
    return F.when(value > 0, F.log2(value))


def divide(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0.0))


def mass_outside(z: float) -> float:
    """Share of a normal distribution beyond z standard deviations on either side."""
    return math.erfc(abs(z) / math.sqrt(2))


def steps(start: float, stop: float, step: float) -> list[float]:
    """Start, start + step, ... up to stop, by repeated addition."""
    out, x = [], start
    while (x <= stop) if step > 0 else (x >= stop):
        out.append(x)
        x += step
    return out


def norm_of(vector: Column) -> Column:
    """Euclidean length of an array of doubles."""
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, null if either is zero."""
    return divide(dot(a, b), norm_of(a) * norm_of(b))


def unit(vector: Column, power: int = 2) -> Column:
    """The vector divided by its L1 or L2 norm; power 0 leaves it as it is."""
    if power == 0:
        return vector
    size = norm_of(vector) if power == 2 else F.aggregate(vector, F.lit(0.0), lambda a, x: a + F.abs(x))
    return F.transform(F.arrays_zip(vector.alias("v"), F.array_repeat(size, F.size(vector)).alias("n")), lambda p: divide(p["v"], p["n"]))


def matching(**conditions: object) -> Column:
    """True for the rows of a slice of results: a value is equal, a list holds it, None means null, and ``...`` not null."""

    def one(name: str, wanted: object) -> Column:
        column = F.col(f"`{name}`")
        if wanted is None:
            return column.isNull()
        if wanted is ...:
            return column.isNotNull()
        return F.coalesce(column.isin(list(wanted)) if isinstance(wanted, (list, tuple, set)) else column == wanted, F.lit(False))

    return reduce(lambda a, b: a & b, (one(k, v) for k, v in conditions.items()), F.lit(True))


def relabelled(value: Column, labels: dict) -> Column:
    """Values by their labels; others stay as text."""
    if not labels:
        return value.cast("string")
    table = F.create_map(*(F.lit(x) for kv in labels.items() for x in map(str, kv)))
    return F.coalesce(F.element_at(table, value.cast("string")), value.cast("string"))


def pasted(*values: Column | str, sep: str = " ") -> Column:
    """Values as one text, nulls as NA."""
    text = lambda v: F.coalesce((F.col(v) if isinstance(v, str) else v).cast("string"), F.lit("NA"))
    return F.concat_ws(sep, *map(text, values))


def decode_entities(text: Column) -> Column:
    """German letters written as entities, with the misspelt sharp s that occurs in such tables."""
    # Fixed values.
    for a, b in (("&uuml;", "ü"), ("&ouml;", "ö"), ("&auml;", "ä"), ("&Uuml;", "Ü"), ("&Ouml;", "Ö"), ("&Auml;", "Ä"), ("%szlig;", "ß")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def download_name(url: Column) -> Column:
    """File name of a downloaded url: md5 of the url, then its last part without the query."""
    return F.concat_ws("-", F.md5(url), F.regexp_extract(F.regexp_replace(url, r"\?.*$", ""), r"([^/]*)$", 1))


def url_escape(text: Column) -> Column:
    """Percent-encoded UTF-8; a blank is %20."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def json_strings(text: Column, *path: str) -> Column:
    """The strings at a path of keys, through every array on the way: an array, empty where there are none."""
    found = F.get_json_object(text, "$" + "".join(f"[*].{k}" if k and at else f".{k}" for at, k in enumerate(path)))
    many = F.from_json(found, "array<string>")
    return F.when(found.isNull(), F.array().cast("array<string>")).otherwise(F.coalesce(many, F.array(found)))


def _shifted(x: Column, term: Callable[[Column], Column], steps: int = 8) -> Column:
    """The sum of ``term`` at x, x + 1, ... x + steps - 1, by which asymptotic series are brought to small x."""
    return reduce(add, (term(x + k) for k in range(steps)))


def lgamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0."""
    y = x + 8
    series = (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, 5))
    return series - _shifted(x, F.ln)


def digamma(x: Column) -> Column:
    """Derivative of lgamma for x > 0."""
    y = x + 8
    return F.ln(y) - 1 / (2 * y) - 1 / (12 * y * y) + 1 / (120 * F.pow(y, 4)) - 1 / (252 * F.pow(y, 6)) - _shifted(x, lambda v: 1 / v)


def trigamma(x: Column) -> Column:
    """Derivative of digamma for x > 0."""
    y = x + 8
    return 1 / y + 1 / (2 * y * y) + 1 / (6 * y * y * y) - 1 / (30 * F.pow(y, 5)) + 1 / (42 * F.pow(y, 7)) + _shifted(x, lambda v: 1 / (v * v))


def in_order(value: Column, levels: list[str]) -> Column:
    """A sort key: nulls first, then ``levels`` as listed, then all others."""
    return F.when(value.isNull(), 0).otherwise(F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, levels)), value), F.lit(0)), F.lit(len(levels) + 1)))
