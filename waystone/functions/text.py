"""Names, labels, units and preset codes as column functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waystone import constants as K
from waystone.functions.geo import let

# The enums of a preset, in the order of their codes.
PRESET_FORMAT = 0xA1
PRESET_FIELDS = {
    "movement": ("fixed", "steady", "dynamic", "close_up"),
    "aspect": ("square", "portrait", "landscape"),
    "detection": ("conservative", "balanced", "sensitive"),
    "framing": ("off", "balanced", "close"),
    "pacing": ("off", "balanced", "strong", "stronger"),
}
MILE_REGIONS = ("GB", "LR", "MM", "US")


def km_to_unit(km: Column, unit: Column) -> Column:
    """Kilometres, or miles where unit is mi."""
    return F.when(unit == "mi", km * K.MILE).otherwise(km)


def unit_of_region(region: Column) -> Column:
    """Mi or km by region code."""
    return F.when(F.upper(region).isin(*MILE_REGIONS), "mi").otherwise("km")


def format_distance(km: Column, unit: Column) -> Column:
    """Whole, grouped, with its unit."""
    return F.concat(F.format_number(km_to_unit(km, unit), 0), F.lit(" "), unit)


def period_label(start_year: Column, end_year: Column) -> Column:
    """X11: 2024, or 2024–2025."""
    return F.when(start_year == end_year, start_year.cast("string")).otherwise(F.concat_ws("–", start_year, end_year))


def title_from_template(template: Column, year: Column, name: Column, fallback: Column) -> Column:
    """{year} and {name}, in any case, filled in; the fallback for blank templates."""
    safe = lambda c: F.regexp_replace(c.cast("string"), r"([\\$])", r"\\$1")
    t = F.regexp_replace(F.regexp_replace(template, F.lit(r"(?i)\{year\}"), safe(year)), F.lit(r"(?i)\{name\}"), safe(name))
    return F.coalesce(F.nullif(F.trim(t), F.lit("")), fallback)


def parse_duration(s: Column) -> Column:
    """Digits only, 10 to 300 seconds."""
    t = F.trim(s)
    n = F.when(t.rlike(r"^\d{1,6}$"), t.try_cast("int"))
    return F.when(n.between(10, 300), n)


def _code(field: str, value: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, PRESET_FIELDS[field])), value).cast("int") - 1


def encode_preset(movement: Column, aspect: Column, detection: Column, framing: Column, pacing: Column) -> Column:
    """Three bytes, the format, four two-bit codes and the pacing, as URL-safe base64 without padding."""
    packed = _code("movement", movement).bitwiseOR(F.shiftleft(_code("aspect", aspect), 2)).bitwiseOR(F.shiftleft(_code("detection", detection), 4)).bitwiseOR(F.shiftleft(_code("framing", framing), 6))
    raw = F.concat(F.lit(f"{PRESET_FORMAT:02X}"), F.lpad(F.hex(packed), 2, "0"), F.lpad(F.hex(_code("pacing", pacing)), 2, "0"))
    return F.rtrim(F.translate(F.base64(F.unhex(raw)), "+/", "-_"), F.lit("="))


def decode_preset(token: Column) -> Column:
    """struct(status, movement, aspect, detection, framing, pacing); status ok, invalid or unsupported."""
    named = lambda **d: F.struct(*[c.alias(n) for n, c in d.items()])

    def content(t: Column) -> Column:
        ok = F.coalesce(t.rlike(r"^[A-Za-z0-9_-]{1,16}$") & (F.char_length(t) % 4 != 1), F.lit(False))
        padded = lambda t: F.rpad(F.translate(t, "-_", "+/"), F.char_length(t) + F.pmod(-F.char_length(t), F.lit(4)), "=")
        return named(ok=ok, h=F.hex(F.unbase64(let(F.when(ok, t).otherwise("AAAA"), padded))))

    def numbers(x: Column) -> Column:
        byte = lambda i: F.conv(F.substr(x["h"], F.lit(2 * i + 1), F.lit(2)), 16, 10).cast("int")
        return named(ok=x["ok"], size=(F.char_length(x["h"]) / 2).cast("int"), form=byte(0), packed=byte(1), pacing=byte(2))

    def values(x: Column) -> Column:
        code = {f: F.shiftright(x["packed"], 2 * i).bitwiseAND(3) for i, f in enumerate(("movement", "aspect", "detection", "framing"))}
        code["pacing"] = x["pacing"].bitwiseAND(3)
        return named(x=x, **{f: F.get(F.array(*map(F.lit, PRESET_FIELDS[f])), c) for f, c in code.items()})

    def checked(v: Column) -> Column:
        x, known = v["x"], F.lit(True)
        for f in PRESET_FIELDS:
            known = known & v[f].isNotNull()
        status = F.when(~x["ok"] | ~x["size"].between(3, 8), "invalid").when(x["form"] != PRESET_FORMAT, "unsupported").when(known, "ok").otherwise("invalid")
        return named(v=v, status=status)

    last = lambda y: F.struct(y["status"].alias("status"), *[F.when(y["status"] == "ok", y["v"][f]).alias(f) for f in PRESET_FIELDS])
    return let(let(let(let(let(token, content), numbers), values), checked), last)


def preset_link_token(link: Column) -> Column:
    """The token of a link with exactly one preset parameter; null for others."""
    query = F.split(F.regexp_extract(link, r"\?([^#]*)", 1), "&")
    found = F.filter(query, lambda x: x.startswith("preset="))
    return let(found, lambda f: F.when(F.size(f) == 1, F.nullif(F.substr(F.get(f, F.lit(0)), F.lit(8)), F.lit(""))))


def normalise_preset_name(name: Column) -> Column:
    """Single spaces, no ends, null if blank or over 40 characters."""
    t = F.trim(F.regexp_replace(name, r"\s+", " "))
    return F.when((t != "") & (F.char_length(t) <= 40), t)


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def sanitize_filename(title: Column, compose: bool = False) -> Column:
    """Without control and reserved characters, single spaces, no blanks or dots at the ends, 80 characters.

    compose puts accents together first (NFC), which Spark can't without a UDF.
    """
    t = _nfc(title) if compose else title
    t = F.regexp_replace(F.regexp_replace(t, r'[\p{Cntrl}\\/:*?"<>|]+', " "), r"\s+", " ")
    return F.substr(F.btrim(t, F.lit(" .")), F.lit(1), F.lit(80))


def file_base_name(title: Column, first_month: Column, last_month: Column) -> Column:
    """K6: the sanitized title and the period."""
    return F.concat(sanitize_filename(title), F.lit("-"), first_month, F.lit("_"), last_month)


def uri_key(uri: Column) -> Column:
    """X21."""
    return F.sha2(uri.cast("binary"), 256)


def is_mp4(content: Column) -> Column:
    """Whether bytes carry the file type mark."""
    return F.coalesce(F.decode(F.substr(content, F.lit(5), F.lit(4)), "ISO-8859-1") == "ftyp", F.lit(False))


def create_preset_link(base: str, token: Column) -> Column:
    """The link under base (its address without parameters) that carries a preset's token."""
    return F.concat(F.lit(f"{base}?preset="), token)


def interpolate_message(template: Column, params: dict[str, Column]) -> Column:
    """The template with {name} replaced for the given names; other braces stay.

    All places are found in the template itself, so a value that looks like a placeholder stays as it is.
    """
    parts = F.split(template, r"(?=\{[a-zA-Z][a-zA-Z0-9_]*\})|(?<=\})")
    value = lambda part: F.coalesce(*[F.when(part == F.lit("{" + n + "}"), v.cast("string")) for n, v in params.items()], part)
    return F.array_join(F.transform(parts, value), "")


def plural_form(forms: Column, category: Column) -> Column:
    """Of a map of forms the category's, else that of other."""
    return F.coalesce(F.try_element_at(forms, category), F.try_element_at(forms, F.lit("other")))
