"""String, e-mail and phone cleaning."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.arrow_udf(StringType())
def _nfkc(values: pa.Array) -> pa.Array:
    return pc.utf8_normalize(values, form="NFKC")


def squeeze(value: Column) -> Column:
    """White space of any kind to single spaces, trimmed; nothing left: null."""
    return F.nullif(F.trim(F.regexp_replace(value, r"(?U)\s+", " ")), F.lit(""))


def clean_string(value: Column, normalize: bool = True) -> Column:
    """Compatibility-normalised (only where the text isn't ASCII, which normalisation leaves alone), then squeezed."""
    if not normalize:
        return squeeze(value)
    return squeeze(F.when(value.rlike(r"[^\x00-\x7F]"), _nfkc(value)).otherwise(value))


def clean_email(value: Column, normalize: bool = True) -> Column:
    return F.lower(clean_string(value, normalize))


def norm(value: Column) -> Column:
    """Lower-cased and trimmed; null: empty."""
    return F.coalesce(F.lower(F.trim(value)), F.lit(""))


def local_part(email: Column) -> Column:
    return F.split_part(email, F.lit("@"), F.lit(1))


#: Calling code, national number. Further regions can be added by rule; others give null.
REGIONS = {"IN": ("91", r"[6-9]\d{9}"), "US": ("1", r"[2-9]\d{2}[2-9]\d{6}"), "GB": ("44", r"[1-9]\d{9}")}


def clean_phone(value: Column, region: str = "IN") -> Column:
    """E.164, or null where the number is not valid: +code, 00code, trunk 0, or the national number alone."""
    code, national = REGIONS[region]
    digits = F.regexp_replace(value, r"[\s().-]", "")
    local = F.regexp_extract(digits, rf"^(?:\+{code}|00{code}|0|)({national})$", 1)
    out = F.when(local != "", F.concat(F.lit(f"+{code}"), local))
    for other, (c, n) in REGIONS.items():
        if other != region:
            abroad = F.regexp_extract(digits, rf"^(?:\+|00){c}({n})$", 1)
            out = out.when(abroad != "", F.concat(F.lit(f"+{c}"), abroad))
    return out


def target_error(message: Column) -> Column:
    """A target's error message without its quoted values, so that like errors group."""
    return F.lower(F.trim(F.regexp_replace(message, "'[^']*'", "'?'")))


def header(name: Column) -> Column:
    return F.trim(F.translate(F.lower(name), "_-", "  "))


def mentioned_fields(error: Column, fields: list[str]) -> Column:
    return F.array_intersect(F.regexp_extract_all(F.lower(error), F.lit("[a-z_][a-z0-9_]*"), 0), F.array(*map(F.lit, fields)))


def as_text(value: Column) -> Column:
    """A value as the store keeps it."""
    return value.cast("string")


def local_time(moment: Column) -> Column:
    """An ISO moment as `dd MMM yyyy, HH:mm` in India; without a zone it is UTC, unreadable text passes, null is empty."""
    zoned = F.when(moment.rlike(r"(Z|[+-]\d\d:?\d\d)$"), moment).when(moment.rlike(r"^\d{4}-\d\d-\d\d$"), F.concat(moment, F.lit("T00:00:00Z"))).otherwise(F.concat(moment, F.lit("Z")))
    minutes = F.floor(F.unix_seconds(F.try_to_timestamp(zoned)) / 60).cast("int") + 330
    told = F.date_format(F.timestamp_add("MINUTE", minutes, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")), "dd MMM yyyy, HH:mm")
    return F.when(moment.rlike(r"^\d{4}-\d\d-\d\d"), F.coalesce(told, moment)).otherwise(F.coalesce(moment, F.lit("")))


def pair_label(email: Column, key: Column, first: Column, last: Column) -> Column:
    """What a record of a pair is called: its e-mail, its key, its name, or `a record`."""
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(filled(F.lower(email)), filled(key), filled(F.concat_ws(" ", filled(first), filled(last))), F.lit("a record"))
