"""Dates as Ukrainian pages write them, as column expressions that yield UTC timestamps."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip

KYIV = "Europe/Kyiv"
# Names of months by number.
MONTHS = {
    1: ("січня", "січ"), 2: ("лютого", "лют"), 3: ("березня", "берез", "бер"), 4: ("квітня", "квіт"), 5: ("травня", "трав"), 6: ("червня", "черв"),
    7: ("липня", "лип"), 8: ("серпня", "серп"), 9: ("вересня", "верес", "вер"), 10: ("жовтня", "жовт", "жов"), 11: ("листопада", "листоп", "лист"), 12: ("грудня", "груд"),
}
# What is taken out of a date's text, in this order, as an earlier one lays bare a later one.
NOISE = (("сьогодні", ""), (r"\s+вчора", ""), (r"\s+р(\.|оку)?$", ""), (" о |,", " "), (r"\s+", " "))
_ISO = r"\d{4}-\d{2}-\d{2}t\d{2}:\d{2}(?::\d{2})?(?:[+\-]\d{2}:?\d{2}|z)?"
_DOTTED = r"\d{1,2}[./-]\d{1,2}[./-]\d{4}"
_NAMED = r"\d{1,2}\s+[а-яіїєґ.]+\s+\d{4}"
_CLOCK = r"\d{1,2}:\d{2}"
_ALONE = r"^\d{1,2}:\d{2}(?:\s*год\.?)?$"


def _found(x: Column, pattern: str) -> Column:
    """The first match, null where there is none."""
    return F.nullif(F.regexp_extract(x, "(?U)" + pattern, 0), F.lit(""))


def _moment(year: Column, month: Column, day: Column, hour: Column, minute: Column) -> Column:
    """A Kyiv wall-clock time as an instant; null where it is no time."""
    own = F.try_make_timestamp(year.cast("int"), month.cast("int"), day.cast("int"), F.coalesce(hour, F.lit("0")).cast("int"), F.coalesce(minute, F.lit("0")).cast("int"), F.lit(0).cast("decimal(8,6)"))
    return F.to_utc_timestamp(own, KYIV)


def _iso(found: Column) -> Column:
    """Of a match of _ISO: sixteen characters, or nineteen with seconds, and a zone."""

    def stamp(n: Column) -> Column:
        time = F.concat(F.replace(F.substr(found, F.lit(1), n), F.lit("t"), F.lit("T")), F.when(n == 16, ":00").otherwise(""))
        zone = F.substr(found, n + 1)
        own = F.when(zone == "z", "+00:00").otherwise(F.regexp_replace(zone, r"^([+\-]\d{2})(\d{2})$", "$1:$2"))
        return F.when(zone == "", F.to_utc_timestamp(F.try_to_timestamp(time), KYIV)).otherwise(F.try_to_timestamp(F.concat(time, own)))

    seconds = (F.length(found) > 18) & (F.substr(found, F.lit(17), F.lit(1)) == ":")
    return let(F.when(seconds, 19).otherwise(16), stamp)


def _at(day: Column, month: Column, year: Column, clock: Column) -> Column:
    return let(F.split(clock, ":"), lambda c: _moment(year, month, day, F.get(c, F.lit(0)), F.get(c, F.lit(1))))


def _dotted(found: Column) -> Column:
    """Of a dotted date and all behind it: the date, at the first clock time behind."""
    whole = lambda date: let(F.split(date, "[./-]"), lambda d: _at(*(F.get(d, F.lit(i)) for i in range(3)), _found(F.substr(found, F.length(date) + 1), _CLOCK)))
    return let(_found(found, _DOTTED), whole)


def _named(found: Column, text: Column) -> Column:
    months = F.create_map(*[F.lit(v) for v in chain.from_iterable((name, m) for m, names in MONTHS.items() for name in names)])
    month = lambda d: F.try_element_at(months, F.replace(F.get(d, F.lit(1)), F.lit("."), F.lit("")))
    return let(F.split(found, " "), lambda d: _at(F.get(d, F.lit(0)), month(d), F.get(d, F.lit(2)), _found(text, _CLOCK)))


def parse_ukrainian(x: Column, now: Column) -> Column:
    """The first that fits: an ISO date and time; d.m.yyyy with a time after it; a time alone, of today; d month yyyy with
    a time anywhere. A dotted date that is no date, and an unknown month, give null. `now` is an instant in UTC.

    Each form is looked for once, and only where those before it were not found."""
    text = strip(reduce(lambda t, rule: F.regexp_replace(t, "(?U)" + rule[0], rule[1]), NOISE, F.lower(x)))
    today = F.from_utc_timestamp(now, KYIV)
    by_clock = lambda found: _at(F.dayofmonth(today), F.month(today), F.year(today), _found(found, _CLOCK))
    by_name = lambda own: let(_found(own, _NAMED), lambda f: _named(f, own))
    undotted = lambda own: let(_found(own, _ALONE), lambda f: F.when(f.isNotNull(), by_clock(f)).otherwise(by_name(own)))
    worded = lambda own: let(_found(own, f"(?s){_DOTTED}.*$"), lambda f: F.when(f.isNotNull(), _dotted(f)).otherwise(undotted(own)))
    return let(text, lambda own: F.coalesce(let(_found(own, _ISO), lambda f: F.when(f.isNotNull(), _iso(f))), worded(own)))


def coerce(x: Column, now: Column) -> Column:
    """parse_ukrainian, else an ISO date or time of Kyiv."""
    own = strip(x)
    bare = F.rlike(own, F.lit(r"[zZ]$|[+\-]\d{2}:?\d{2}$"))
    iso = F.try_to_timestamp(own)
    return F.coalesce(parse_ukrainian(x, now), F.when(bare, iso).otherwise(F.to_utc_timestamp(iso, KYIV)))
