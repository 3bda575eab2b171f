"""Dates, numbers and enumerated values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyfold.config import Field, Policy
from tallyfold.functions.text import clean_string

#: Fixed value: a regular expression for each date pattern, since Spark's parser takes more than it should.
_GUARDS = {
    "yyyy-M-d": r"^\d{4}-\d{1,2}-\d{1,2}$",
    "d-M-yyyy": r"^\d{1,2}-\d{1,2}-\d{4}$",
    "d/M/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "d-MMM-yyyy": r"^\d{1,2}-[A-Z][a-z]{2}-\d{4}$",
    "d MMM yyyy": r"^\d{1,2} [A-Z][a-z]{2} \d{4}$",
    "yyyy/M/d": r"^\d{4}/\d{1,2}/\d{1,2}$",
}


def _plausible(day: Column) -> Column:
    return F.when(day.between(F.lit("1920-01-01").cast("date"), F.lit("2100-01-01").cast("date")), day)


def parse_date(value: Column, formats: tuple[str, ...] = Policy.date_formats) -> Column:
    """struct(value date, ambiguous boolean). A slash date that is a date either way round, with day and month unequal, is ambiguous and null."""
    raw = F.trim(F.regexp_replace(value, r"\s+", " "))
    named = F.replace(F.initcap(F.replace(F.lower(raw), F.lit("-"), F.lit(" - "))), F.lit(" - "), F.lit("-"))  # month names in any case
    read = lambda text, p: F.when(text.rlike(_GUARDS[p]), F.try_to_date(text, p))
    day_first, month_first = read(raw, "d/M/yyyy"), F.when(raw.rlike(_GUARDS["d/M/yyyy"]), F.try_to_date(raw, "M/d/yyyy"))
    ambiguous = F.coalesce(day_first.isNotNull() & month_first.isNotNull() & (day_first != month_first), F.lit(False))
    serial = _plausible(F.date_add(F.lit("1899-12-30").cast("date"), F.when(raw.rlike(r"^\d{4,6}$"), raw).try_cast("int")))
    epoch = _plausible(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.when(raw.rlike(r"^\d{9,10}$"), raw).try_cast("long") / 86400).cast("int")))
    day = F.when(~ambiguous, F.coalesce(serial, epoch, *[read(named, p) for p in formats]))
    return F.struct(day.alias("value"), ambiguous.alias("ambiguous"))


def native_date(number: Column) -> Column:
    """The date of a native number cell of a workbook: a serial, with no window and no doubt."""
    return F.date_add(F.lit("1899-12-30").cast("date"), number.cast("int"))


def date_readings(value: Column) -> Column:
    """struct(day_first, month_first): a slash date's two readings in words, or null if either is no date."""
    raw = F.trim(value)
    told = lambda p: F.date_format(F.when(raw.rlike(_GUARDS["d/M/yyyy"]), F.try_to_date(raw, p)), "d MMMM yyyy")
    day, month = told("d/M/yyyy"), told("M/d/yyyy")
    return F.when(day.isNotNull() & month.isNotNull(), F.struct(day.alias("day_first"), month.alias("month_first")))


def clean_number(value: Column) -> Column:
    """struct(amount decimal, currency). Detection ignores case, stripping doesn't; a null or empty text has neither."""
    filled = F.nullif(value, F.lit(""))
    upper = F.upper(filled)
    currency = F.when(filled.isNull(), F.lit(None).cast("string")).when(upper.contains("USD"), "USD").when(upper.contains("EUR"), "EUR").otherwise("INR")
    bare = F.regexp_replace(filled, r"₹|\$|,|\s|INR|USD|EUR", "")
    return F.struct(bare.try_cast("decimal(38,10)").alias("amount"), currency.alias("currency"))


def native_number(number: Column) -> Column:
    """struct(amount, currency) of a native number cell, which is in the schema's own currency."""
    return F.struct(number.cast("decimal(38,10)").alias("amount"), F.when(number.isNotNull(), "INR").alias("currency"))


def coerce_enum(value: Column, allowed: tuple[str, ...], most: int = Policy.enum_distance) -> Column:
    """struct(value, distance, nearest): cleaned, then exact but for case, else the nearest by edits (ties: schema order), taken if near enough. Empty: null, 0, null."""
    text = F.lower(clean_string(value))
    near = F.array_min(F.array(*[F.struct(F.levenshtein(text, F.lit(a.lower())).alias("d"), F.lit(k).alias("k"), F.lit(a).alias("v")) for k, a in enumerate(allowed)]))
    empty = text.isNull()
    return F.struct(
        F.when(~empty & (near["d"] <= most), near["v"]).alias("value"),
        F.when(empty, 0).otherwise(near["d"]).alias("distance"),
        F.when(~empty, near["v"]).alias("nearest"),
    )


def coerce_user_value(value: Column, field: Field, formats: tuple[str, ...] = Policy.date_formats) -> Column:
    """struct(value, why): what a person typed, in the form that the field stores, or why it can't be."""
    text = F.coalesce(F.trim(value), F.lit(""))
    why = F.when(text == "", "no value given")
    kept = text
    if field.kind == "date":
        parsed = parse_date(text, formats)
        kept = parsed["value"].cast("string")
        why = why.when(parsed["ambiguous"], "two different dates").when(kept.isNull(), "not a date")
    if field.values:
        why = why.when(~text.isin(*field.values), "not an allowed value")
    why = why.otherwise("")
    return F.struct(F.when(why == "", kept).alias("value"), why.alias("why"))
