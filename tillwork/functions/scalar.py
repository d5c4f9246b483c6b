"""Column helpers: numbers, durations, buckets, labels, classifiers. All built from native functions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from . import rules


def strip(c: Column) -> Column:
    """Trim every kind of white space at both ends."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def parse_number(c: Column) -> Column:
    """Number with thousands commas or quotes; '-' and junk give NULL."""
    cleaned = strip(F.translate(c, '",', ""))
    return F.when(cleaned.rlike(rules.NUMBER), cleaned.try_cast("double"))


def duration_hours(c: Column) -> Column:
    """``HH.MM.SS`` or ``HH:MM:SS`` as decimal hours, NULL if malformed."""
    text = strip(c)
    part = F.split(text, r"[.:]")
    return F.when(
        text.rlike(r"^\d+([.:])\d+\1\d+$"),
        part[0].try_cast("int") + part[1].try_cast("int") / F.lit(60.0) + part[2].try_cast("int") / F.lit(3600.0),
    )


def ratio(x: Column, y: Column) -> Column:
    """x / y, NULL where y is 0 or NULL."""
    return F.try_divide(x.cast("double"), y.cast("double"))


def ratio_or_value(x: Column, y: Column) -> Column:
    """x / y with a zero denominator replaced by 1."""
    d = y.cast("double")
    return x.cast("double") / F.when(d == 0, F.lit(1.0)).otherwise(d)


def round_to(c: Column | str, digits: int) -> Column:
    """Round a double to a number of digits the way NumPy does: scale, round half to even, scale back."""
    c = F.col(c) if isinstance(c, str) else c
    scale = F.lit(float(10 ** digits))
    return F.rint(c.cast("double") * scale) / scale


def money(c: Column) -> Column:
    """Exact money for sums, independent of task order."""
    return c.cast("decimal(18,2)")


def elapsed_days(later: Column, earlier: Column) -> Column:
    """Whole elapsed days between two timestamps (not calendar boundaries), floored."""
    seconds = F.unix_timestamp(later.cast("timestamp")) - F.unix_timestamp(earlier.cast("timestamp"))
    return F.floor(seconds / F.lit(86400.0)).cast("int")


def month_number(name: Column) -> Column:
    """English month name in any case to 1..12, NULL otherwise."""
    index = F.array_position(F.array(*[F.lit(m) for m in rules.MONTHS]), F.lower(name))
    return F.when(index > 0, index.cast("int"))


def weekday_number(name: Column) -> Column:
    """Weekday name to 0 (Monday) .. 6, the sort key of day columns."""
    return (F.array_position(F.array(*[F.lit(d) for d in rules.WEEKDAYS]), name) - 1).cast("int")


def day_name(ts: Column) -> Column:
    return F.date_format(ts, "EEEE")


def is_weekend(day: Column) -> Column:
    return day.isin("Saturday", "Sunday")


def punch_shift(hour: Column) -> Column:
    """Shift of a punch-in hour: before 12, before 17, later."""
    return F.when(hour < 12, "morning").when(hour < 17, "afternoon").otherwise("evening")


def hour_shift(hour: Column) -> Column:
    """Shift of a clock hour: 6-11, 12-16, 17-23, else overnight."""
    return (F.when(hour.between(6, 11), "morning").when(hour.between(12, 16), "afternoon")
            .when(hour.between(17, 23), "evening").otherwise("overnight"))


def is_anomalous_shift(hours: Column, short: float = rules.SHIFT_TOO_SHORT, long: float = rules.SHIFT_TOO_LONG) -> Column:
    return F.coalesce((hours < short) | (hours > long), F.lit(False))


def clamp_share(c: Column, low: float = rules.SHARE_MIN, high: float = rules.SHARE_MAX) -> Column:
    """Clamp to [low, high]; NULL stays NULL."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def text_bool(c: Column) -> Column:
    """Boolean written as text or 0/1; anything else is false."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1"), F.lit(False))


def tier(score: Column, high: float = 0.65, medium: float = 0.45) -> Column:
    return F.when(score >= high, "High").when(score >= medium, "Medium").otherwise("Low")


def canonical_name(raw: Column, mapping: Sequence[tuple[str, str]]) -> Column:
    """First entry of ``mapping`` whose text occurs in the name (prefix such as ``Branch Name:`` removed)."""
    text = strip(F.regexp_replace(strip(F.lower(raw)), r"^branch\s*(name\s*)?:\s*", ""))
    name = F.lit(None).cast("string")
    for part, canonical in reversed(list(mapping)):
        name = F.when(text.contains(part), F.lit(canonical)).otherwise(name)
    return name


def lookup(key: Column, mapping: Mapping[str, str], default: str | None = None) -> Column:
    """Small constant mapping as an expression; unknown keys give ``default``."""
    if not mapping:
        return F.lit(default).cast("string")
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default).cast("string"))


def item_category(division: Column, is_modifier: Column) -> Column:
    """Category of an item from its division text; modifiers and food only where no beverage pattern fits."""
    category = F.when(is_modifier, "modifier").otherwise("core_food")
    for name, pattern in reversed(rules.CATEGORY_PATTERNS):
        category = F.when(F.coalesce(division.rlike(pattern), F.lit(False)), name).otherwise(category)
    return category


def keyword_class(item: Column, keywords: Mapping[str, Sequence[str]] = rules.ITEM_KEYWORDS,
                  exclusions: Sequence[str] = tuple(rules.ITEM_EXCLUSIONS)) -> Column:
    """Class of a normalised item name: NULL if an exclusion word occurs, else the first class with a keyword
    standing between spaces, hyphens or the ends of the text."""
    padded = F.concat(F.lit(" "), item, F.lit(" "))
    label = F.lit(None).cast("string")
    for name, words in reversed(list(keywords.items())):
        body = "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))
        label = F.when(padded.rlike(rf"(?:^|[\s\-])(?:{body})(?:[\s\-]|$)"), F.lit(name)).otherwise(label)
    if exclusions:
        banned = "|".join(rf"\b{re.escape(w)}\b" for w in exclusions)
        label = F.when(~item.rlike(banned), label)
    return label


def is_target(item: Column, keywords: Mapping[str, Sequence[str]] = rules.ITEM_KEYWORDS,
              exclusions: Sequence[str] = tuple(rules.ITEM_EXCLUSIONS),
              targets: Sequence[str] = tuple(rules.TARGET_CLASSES)) -> Column:
    """Does the item belong to a target class; never NULL for a non-NULL item."""
    return F.coalesce(keyword_class(item, keywords, exclusions).isin(*targets), F.lit(False))


def parse_items(raw: Column) -> Column:
    """List text (JSON or Python literal, else comma separated) to an array of normalised item names."""
    text = strip(raw)
    bare = F.regexp_replace(text, r"^[\[\](){} ]+|[\[\](){} ]+$", "")
    loose = F.transform(F.split(bare, r",\s*"), lambda x: F.regexp_replace(strip(x), "^['\"]+|['\"]+$", ""))
    items = F.coalesce(F.from_json(F.when(text.startswith("["), text), "array<string>"), loose)
    named = F.transform(items, lambda x: F.regexp_replace(strip(F.lower(x)), r"\s+", " "))
    kept = F.filter(named, lambda x: x.isNotNull() & (x != ""))
    empty = F.array().cast("array<string>")
    absent = text.isNull() | F.lower(text).isin("", "nan", "none", "[]")
    return F.when(absent, empty).otherwise(F.coalesce(kept, empty))
