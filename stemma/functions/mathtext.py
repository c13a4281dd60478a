"""Mathematics in plain text: numbers, powers, choices, features and what two readings disagree on."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_POWER = r"([A-Za-z0-9)]+)\^\{?([0-9A-Za-z]+)\}?"
_INDEX = r"([A-Za-z]+)_\{?([0-9A-Za-z]+)\}?"


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([0-9]+(?:\.[0-9]+)?)"), F.lit(1))


def operators(text: Column) -> Column:
    """Signs of relation and calculation, in order, as one string."""
    return F.array_join(F.regexp_extract_all(text, F.lit(r"([+*/=<>≤≥≠-])"), F.lit(1)), "")


def powers(text: Column) -> Column:
    """Bases and exponents written with a caret, as "base^exponent" in order."""
    bases, tops = (F.regexp_extract_all(text, F.lit(_POWER), F.lit(k)) for k in (1, 2))
    return F.zip_with(bases, tops, lambda b, t: F.concat(b, F.lit("^"), t))


def signature(text: Column, pattern: str = _POWER) -> Column:
    """Map of base to exponent (or index); the last one of a base counts."""
    bases, tops = (F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in (1, 2))
    pairs = F.arrays_zip(bases.alias("b"), tops.alias("t"))
    # map keys must be distinct: keep each base's last pair
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.lit(0), F.size(pairs) - i - 1)), lambda q: q["b"] == p["b"]))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["b"], p["t"])))


def conflicts(a: Column, b: Column, pattern: str = _POWER) -> Column:
    """Bases that both have with another exponent, sorted."""
    both = F.map_zip_with(signature(a, pattern), signature(b, pattern), lambda k, x, y: x.isNotNull() & y.isNotNull() & (x != y))
    return F.array_sort(F.map_keys(F.map_filter(both, lambda k, v: v)))


def index_conflicts(a: Column, b: Column) -> Column:
    return conflicts(a, b, _INDEX)


def reading_diff(baseline: Column, other: Column) -> Column:
    """struct(worst, codes): what two readings of one text disagree on, white space and case of no account."""
    plain = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")
    x, y = plain(baseline), plain(other)
    codes = F.array_compact(F.array(F.when(numbers(x) != numbers(y), "NUMBERS"), F.when(powers(x) != powers(y), "EXPONENTS"), F.when(operators(x) != operators(y), "OPERATORS")))
    worst = F.when(F.size(codes) > 0, "CRITICAL").when(F.lower(x) != F.lower(y), "COSMETIC").otherwise("SAME")
    return F.struct(worst.alias("worst"), codes.alias("codes"))


def choices(text: Column) -> Column:
    """Answers after (1), (2), ... or 1), 2), ... at the start of a line, as array of struct(label, text)."""
    lines = F.split(text, "\n")
    own = F.filter(lines, lambda s: s.rlike(r"^\s*\(?[0-9]{1,2}\)"))
    return F.transform(own, lambda s: F.struct(F.regexp_extract(s, r"^\s*\(?([0-9]{1,2})\)", 1).cast("int").alias("label"), F.trim(F.regexp_replace(s, r"^\s*\(?[0-9]{1,2}\)", "")).alias("text")))


def in_sequence(labels: Column) -> Column:
    """Labels are 1, 2, 3, ... without a gap."""
    return (F.size(labels) > 0) & F.forall(F.transform(labels, lambda v, i: v == i + 1), lambda ok: ok)


def features(text: Column, patterns: Mapping[str, str]) -> Column:
    """One struct of counts by pattern, and of length, lines and longest line, so that all are worked out together."""
    found = [F.regexp_count(text, F.lit(p)).cast("long").alias(n) for n, p in patterns.items()]
    lines = F.split(text, "\n")
    return F.struct(F.length(text).cast("long").alias("chars"), F.size(lines).cast("long").alias("lines"), F.array_max(F.transform(lines, F.length)).cast("long").alias("longest"), *found)


def agreement(features_of: Column, rules: Sequence[tuple[str, Sequence[str], Sequence[str]]]) -> Column:
    """struct(supported, inferred): types whose wanted features are all there and whose forbidden ones are not; inferred only if exactly one."""
    fits = lambda need, never: F.forall(F.array(*[features_of[n] > 0 for n in need], *[features_of[n] == 0 for n in never]), lambda ok: ok)
    supported = F.array_compact(F.array(*[F.when(fits(need, never), F.lit(key)) for key, need, never in rules]))
    return F.struct(supported.alias("supported"), F.when(F.size(supported) == 1, supported[0]).alias("inferred"))


def field_diffs(pairs: Mapping[str, tuple[Column, Column]]) -> Column:
    """Names of the fields where what was planned and what was stored differ; arrays of the caller are sorted where order is of no account."""
    return F.array_compact(F.array(*[F.when(~a.eqNullSafe(b), F.lit(n)) for n, (a, b) in pairs.items()]))
