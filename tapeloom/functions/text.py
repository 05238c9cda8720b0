"""Text column functions for disclosure entries."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tapeloom.constants import ATTACHMENT_EXTENSIONS, MARKET_ZONE
from tapeloom.functions.numeric import py_round, round_at


def blank_to_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def content_hash(*parts: Column) -> Column:
    """sha256 over the parts joined with the unit separator, null read as empty."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def _group(x: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(x, pattern, group), F.lit(""))


def symbol_from_link(link: Column) -> Column:
    return _group(link, r"/corporate/([A-Z0-9&\-]{1,20})_\d{8,}", 1)


def _market_time(text: Column, fmt: str) -> Column:
    """Market wall-clock text to an instant; null when the text does not parse."""
    return F.to_utc_timestamp(F.try_to_timestamp(text, F.lit(fmt)), MARKET_ZONE)


def published_at(text: Column) -> Column:
    """``dd-MMM-yyyy[ HH:mm[:ss]]`` in market time to an instant."""
    t = F.initcap(F.trim(text))
    return F.coalesce(
        _market_time(t, "d-MMM-yyyy HH:mm:ss"),
        _market_time(t, "d-MMM-yyyy HH:mm"),
        _market_time(t, "d-MMM-yyyy"),
    )


def time_from_link(link: Column) -> Column:
    """Timestamp carried by the file name: year-first form, then day-first form."""
    name = F.substring_index(link, "/", -1)
    ymd = F.concat(_group(name, r"_(20\d{6})_(\d{6})", 1), _group(name, r"_(20\d{6})_(\d{6})", 2))
    dmy = F.concat(
        _group(name, r"_(\d{8})(\d{6})(?:\D|$)", 1), _group(name, r"_(\d{8})(\d{6})(?:\D|$)", 2)
    )
    return F.coalesce(_market_time(ymd, "yyyyMMddHHmmss"), _market_time(dmy, "ddMMyyyyHHmmss"))


def _labelled(part: Column) -> Column:
    """True for 'KEY: value' parts whose key is a short upper-case label."""
    key = F.upper(F.trim(F.substring_index(part, ":", 1)))
    return part.contains(":") & (F.length(key) <= 40) & key.rlike(r"^[A-Z0-9 /&()\-.]+$")


def summary_fields(summary: Column) -> Column:
    """Pipe-separated 'KEY: value' text to a map; free parts join under ``_text``.

    A repeated key keeps its last value. The reversed array is deduplicated by position, so
    the result does not depend on the session's map-key policy.
    """
    parts = F.filter(
        F.transform(F.split(F.coalesce(summary, F.lit("")), r"\|"), lambda p: F.trim(p)),
        lambda p: p != "",
    )
    entries = F.transform(
        F.filter(parts, _labelled),
        lambda p: F.struct(
            F.upper(F.trim(F.substring_index(p, ":", 1))).alias("key"),
            F.trim(F.substring(p, F.locate(":", p) + 1, F.length(p))).alias("value"),
        ),
    )
    keys = F.transform(entries, lambda e: e["key"])
    last = F.filter(
        entries,
        lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.greatest(F.size(keys), F.lit(1))), e["key"]),
    )
    free = F.array_join(F.filter(parts, lambda p: ~_labelled(p)), " | ")
    text = F.when(free != "", F.array(F.struct(F.lit("_text").alias("key"), free.alias("value"))))
    return F.map_from_entries(
        F.concat(last, F.coalesce(text, F.slice(entries, 1, 0)))
    )


def attachment_url(link: Column) -> Column:
    pattern = r"\.(" + "|".join(ATTACHMENT_EXTENSIONS) + r")$"
    return F.when(F.lower(link).rlike(pattern), link)


def labelled_number(text: Column, label: str) -> Column:
    """Number after ``label:`` in free text, null when absent or malformed."""
    return _group(text, label + r":\s*([\d.]+)", 1).try_cast("double")


def listing_date(x: Column) -> Column:
    t = F.initcap(F.trim(x))
    return F.coalesce(
        F.try_to_timestamp(t, F.lit("d-MMM-yyyy")),
        F.try_to_timestamp(t, F.lit("d-MMM-yy")),
        F.try_to_timestamp(t, F.lit("d-M-yyyy")),
    ).cast("date")


def collapse_spaces(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def html_escape(x: Column) -> Column:
    out = F.replace(F.coalesce(x, F.lit("")), F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    return F.replace(out, F.lit(">"), F.lit("&gt;"))


def fixed(x: Column, digits: int, plus: bool = False) -> Column:
    """``digits`` decimals, rounded half to even on the exact binary value; null stays null."""
    if digits == 0:
        r = F.rint(x)  # half to even, and keeps the sign of a zero
    else:
        r = py_round(x, digits)
        r = F.when((r == 0) & (x < 0), F.lit(-0.0)).otherwise(r)
    return F.when(x.isNotNull(), F.format_string(f"%{'+' if plus else ''}.{digits}f", r))


def shortest(x: Column) -> Column:
    """The shortest decimal text that reads back as the same double, without an exponent."""
    small = (F.abs(x) >= 1e-3) & (F.abs(x) < 1e7) | (x == 0)
    wide = F.regexp_replace(x.cast("decimal(38,12)").cast("string"), r"0+$", "")
    return F.when(small, x.cast("string")).otherwise(F.regexp_replace(wide, r"\.$", ".0"))


def general(x: Column) -> Column:
    """Six significant digits without trailing zeros; an exponent from one million up and below 0.0001."""
    scale = F.lit(1e9)
    for k in range(-3, 6):
        # a value that rounds up to the next power of ten takes one digit less
        scale = F.when(F.abs(x) >= 10.0**k * (1 - 0.5e-6), 10.0 ** (5 - k)).otherwise(scale)
    out = F.format_string("%.9f", round_at(x, scale))
    plain = F.regexp_replace(F.regexp_replace(out, r"0+$", ""), r"\.$", "")
    power = F.regexp_replace(F.regexp_replace(F.format_string("%.5e", x), r"0+e", "e"), r"\.e", "e")
    return F.when(x == 0, "0").when((F.abs(x) >= 1e6 * (1 - 0.5e-6)) | (F.abs(x) < 1e-4), power).otherwise(plain)


def value_range(lo: Column, hi: Column) -> Column:
    return (
        F.when(lo.isNull(), F.lit("–"))
        .when(hi.isNull(), general(lo))
        .otherwise(F.concat(general(lo), F.lit(" – "), general(hi)))
    )


def direction(sentiment: Column) -> Column:
    return F.when(sentiment > 0.15, "+").when(sentiment < -0.15, "-").otherwise("=")
