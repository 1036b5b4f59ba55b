"""Value transforms: from a source's spelling to the shared schema's. Each is Column -> Column; null and unusable values give null."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MAKES = {"maruti": "Maruti Suzuki", "maruti suzuki": "Maruti Suzuki", "hundai": "Hyundai", "hyundai": "Hyundai", "tata motors": "Tata", "tata": "Tata", "honda": "Honda", "toyota": "Toyota", "mahindra": "Mahindra", "kia": "Kia"}
STATUSES = {"ACT": "ACTIVE", "SUSP": "SUSPENDED", "CANC": "CANCELLED"}
TIME_FORMATS = {"%d/%m/%Y %H:%M:%S": "d/M/yyyy H:m:s", "%d/%m/%Y %H:%M": "d/M/yyyy H:m", "%d-%m-%Y %H:%M:%S": "d-M-yyyy H:m:s", "%d-%m-%Y %H:%M": "d-M-yyyy H:m", "%Y/%m/%d %H:%M:%S": "yyyy/M/d H:m:s", "%Y-%m-%d %H:%M": "yyyy-M-d H:m"}
EARTH_KM = 6371.0088


def norm_plate(c: Column) -> Column:
    """Letters and digits alone, upper case; may be empty."""
    return F.upper(F.regexp_replace(c, "[^A-Za-z0-9]", ""))


def canonical_plate(c: Column) -> Column:
    """norm_plate, but an empty key is an error."""
    key = norm_plate(F.upper(c))
    return F.when(c.isNotNull() & (key == ""), F.raise_error(F.lit("empty key"))).otherwise(key)


def ocr_key(c: Column) -> Column:
    """The key with letters that cameras take for digits folded onto them."""
    return F.translate(norm_plate(c), "OI", "01")


def render_plate(c: Column, groups: tuple[int, ...] = (2, 2, 2, 4), separator: str = "", lower: bool = False) -> Column:
    """A key in a source's own spelling: groups of characters, the rest kept as a last one."""
    parts, at = [], 1
    for n in groups:
        parts.append(F.substring(c, at, n))
        at += n
    parts.append(F.substring(c, at, 1_000))
    out = F.array_join(F.filter(F.array(*parts), lambda p: p != ""), separator)
    return F.lower(out) if lower else F.upper(out)


def _has_form(c: Column, form: str) -> Column:
    """Whether a text has a time format's separators with signs and digits between: no other can be read by it, and to try costs an exception each. True of what is no text."""
    return (F.typeof(c) != "string") | c.cast("string").rlike("^" + re.sub("[A-Za-z]+", "[-+0-9]+", form) + "$")


def parse_ddmmyyyy(c: Column) -> Column:
    return F.coalesce(*(F.when(_has_form(c, f), F.try_to_date(c, f)) for f in ("d/M/yyyy", "yyyy-M-d")))


def epoch_to_date(c: Column) -> Column:
    """UTC date of epoch seconds."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(c.try_cast("bigint") / 86_400).cast("int"))


def yn_to_bool(c: Column) -> Column:
    t = F.upper(F.trim(c.cast("string")))
    return F.when(t.isin("Y", "YES", "TRUE", "1"), True).when(t.isin("N", "NO", "FALSE", "0"), False)


def tinyint_to_bool(c: Column) -> Column:
    return c.try_cast("int") == 1


def status_map(c: Column) -> Column:
    t = F.upper(F.trim(c))
    out = t
    for short, full in STATUSES.items():
        out = F.when(t == short, full).otherwise(out)
    return out


def title_case(c: Column) -> Column:
    """A capital after anything that is no letter, unlike initcap()."""
    runs = F.regexp_extract_all(c, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 10_000)))), "")


def fix_make(c: Column) -> Column:
    t, out = F.lower(F.trim(c)), title_case(F.trim(c))
    for key, value in MAKES.items():
        out = F.when(t == key, value).otherwise(out)
    return out


def iso_moment(c: Column) -> Column:
    """A timestamp without zone; an offset in the text is dropped, not applied."""
    return F.regexp_replace(F.trim(c), r"(Z|[+-]\d\d:?\d\d)$", "").try_cast("timestamp_ntz")


def parse_ts(c: Column) -> Column:
    """struct(moment, format): the first of eight formats that reads the text, by name; both null if none does."""
    t = F.trim(c.cast("string"))
    epoch = F.when(t.rlike(r"^\d{9,10}$"), F.timestamp_seconds(t.try_cast("bigint")).cast("timestamp_ntz"))
    iso = F.when(t.rlike(r"^\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d(\.\d+)?)?)?(Z|[+-]\d\d:?\d\d)?$"), iso_moment(t))
    tried = [("epoch", epoch), ("iso", iso)] + [(name, F.when(_has_form(t, f), F.try_to_timestamp(t, F.lit(f)).cast("timestamp_ntz"))) for name, f in TIME_FORMATS.items()]
    name = F.coalesce(*(F.when(v.isNotNull(), F.lit(n)) for n, v in tried))
    return F.struct(F.coalesce(*(v for _, v in tried)).alias("moment"), name.alias("format"))


def norm_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")


def shape(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}0-9]", "?"), r"\p{L}", "L"), "[0-9]", "D")


def pattern(c: Column, states) -> Column:
    """One sign a token: S a known state code at the start, ^ digits, + other letters."""
    runs = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[A-Za-z]+|[0-9]+"), F.lit(0))
    sign = lambda r, i: F.when(r.rlike("^[0-9]"), "^").when((i == 0) & F.upper(r).isin(*states), "S").otherwise("+")
    return F.array_join(F.transform(runs, sign), "")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(a))


def mask_plate(c: Column) -> Column:
    """First and last two characters, stars between."""
    stars = F.lpad(F.lit(""), F.greatest(F.length(c) - 4, F.lit(0)), F.lit("*"))
    return F.when(F.length(c) <= 4, "****").otherwise(F.concat(F.substring(c, 1, 2), stars, F.right(c, F.lit(2))))


def extract_key(c: Column, expr: str = r"'([A-Za-z0-9 -]{4,16})'") -> Column:
    return F.nullif(norm_plate(F.regexp_extract(c, expr, 1)), F.lit(""))


TRANSFORMS: dict[str, Callable[[Column], Column]] = {f.__name__: f for f in (norm_plate, parse_ddmmyyyy, epoch_to_date, yn_to_bool, tinyint_to_bool, status_map, title_case, fix_make, iso_moment)}


def transform(name: str | None) -> Callable[[Column], Column]:
    """An unknown name changes nothing."""
    return TRANSFORMS.get(name or "", lambda c: c)
