"""Time expressions and temporal relations as columns."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.prims import case_map

# Temporal relation types, their aliases, inverses and contradictions.
CANONICAL = ("BEFORE", "AFTER", "INCLUDES", "IS_INCLUDED", "SIMULTANEOUS", "IBEFORE", "IAFTER", "BEGINS", "BEGUN_BY", "ENDS", "ENDED_BY", "DURING", "DURING_INV", "IDENTITY", "VAGUE")
ALIASES = {"INCLUDE": "INCLUDES", "INCLUDED": "IS_INCLUDED", "SIMULTANEOUSLY": "SIMULTANEOUS", "OVERLAP": "SIMULTANEOUS", "EQUAL": "IDENTITY", "SAMEAS": "IDENTITY", "MEASURE": "DURING"}
CONTRADICTS = {"BEFORE": "AFTER", "AFTER": "BEFORE", "INCLUDES": "IS_INCLUDED", "IS_INCLUDED": "INCLUDES", "BEGINS": "BEGUN_BY", "BEGUN_BY": "BEGINS", "ENDS": "ENDED_BY", "ENDED_BY": "ENDS"}
SWEEP_INVERSES = {"IS_INCLUDED": "INCLUDES", "INCLUDES": "IS_INCLUDED", "BEGUN_BY": "BEGINS", "BEGINS": "BEGUN_BY", "ENDED_BY": "ENDS", "ENDS": "ENDED_BY", "IAFTER": "IBEFORE", "IBEFORE": "IAFTER"}
SOLVER_INVERSES = CONTRADICTS | {"IDENTITY": "IDENTITY"}
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def relation_type(raw: Column) -> Column:
    """The canonical relation; an unknown or empty one is VAGUE."""
    name = F.upper(F.trim(F.coalesce(raw, F.lit(""))))
    return case_map(name, {c: c for c in CANONICAL} | ALIASES, F.lit("VAGUE"))


def opposite(relation: Column) -> Column:
    return case_map(relation, CONTRADICTS)


def duration(value: Column) -> Column:
    """``PY5`` becomes ``P5Y``; other values stay."""
    return F.regexp_replace(value, "^P([YMDWH])([0-9]+)$", "P$2$1")


def iso_date(value: Column) -> Column:
    """Spellings of a date as ISO, anything else as it is; null is empty.

    20240105, 202401, 2024011 (the last digit on its own), January 5 2024, 5 Jan 2024, January 2024,
    2024 January; commas count as blanks, months may be shortened to three letters or ``sept``.
    """
    v = F.trim(F.coalesce(value, F.lit("")))
    compact = F.trim(F.regexp_replace(F.regexp_replace(v, ",", " "), r"\s+", " "))
    short = {m[:3]: i + 1 for i, m in enumerate(MONTHS)} | {"sept": 9}
    numbers = {m: f"{i + 1:02d}" for i, m in enumerate(MONTHS)} | {m: f"{i:02d}" for m, i in short.items()}
    month = lambda p, i: case_map(F.lower(F.regexp_extract(compact, p, i)), numbers)
    part = lambda p, i: F.regexp_extract(compact, p, i)
    day = lambda p, i: F.lpad(part(p, i), 2, "0")
    mdy, dmy, my, ym = r"^([A-Za-z]+) ([0-9]{1,2}) ([0-9]{4})$", r"^([0-9]{1,2}) ([A-Za-z]+) ([0-9]{4})$", r"^([A-Za-z]+) ([0-9]{4})$", r"^([0-9]{4}) ([A-Za-z]+)$"
    dash = F.lit("-")
    return F.coalesce(
        F.when(v.rlike("^[0-9]{8}$"), F.regexp_replace(v, "^(....)(..)(..)$", "$1-$2-$3")),
        F.when(v.rlike("^[0-9]{6}$"), F.regexp_replace(v, "^(....)(..)$", "$1-$2")),
        F.when(v.rlike("^[0-9]{7}$"), F.regexp_replace(v, "^(....)(..)(.)$", "$1-$2-$3")),
        F.when(compact.rlike(mdy), F.concat(part(mdy, 3), dash, month(mdy, 1), dash, day(mdy, 2))),
        F.when(compact.rlike(dmy), F.concat(part(dmy, 3), dash, month(dmy, 2), dash, day(dmy, 1))),
        F.when(compact.rlike(my), F.concat(part(my, 2), dash, month(my, 1))),
        F.when(compact.rlike(ym), F.concat(part(ym, 1), dash, month(ym, 2))), v)
