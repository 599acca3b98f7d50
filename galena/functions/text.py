"""Cleaning and parsing of text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: texts that mean that a value is missing, after trimming and lower-casing.
MISSING = ("", "nan", "не определено", "null")


def cleaned(c: Column) -> Column:
    """Trimmed; null where the text says that there is none."""
    return F.when(F.lower(F.trim(c)).isin(*MISSING), None).otherwise(F.trim(c))


def strict_number(c: Column, maximum: float) -> Column:
    """The number that the whole text is (with comma or point, perhaps a percent sign), if it lies in [0, maximum]."""
    value = F.when(F.trim(c).rlike(r"^\d+(?:[.,]\d+)?%?$"), F.translate(F.trim(c), ",%", ".").cast("double"))
    return F.when((value >= 0) & (value <= maximum), value)


def loose_number(c: Column) -> Column:
    """The first number in the text."""
    return F.nullif(F.regexp_extract(F.replace(c, F.lit(","), F.lit(".")), r"\d+(?:\.\d+)?", 0), F.lit("")).cast("double")


def folded(c: Column) -> Column:
    """For comparison: trimmed, lower-cased, ё as е."""
    return F.translate(F.lower(F.trim(c)), "ё", "е")


def safe_name(c: Column, length: int = 80) -> Column:
    """Fit for a file name."""
    return F.substring(F.regexp_replace(c, r"(?U)[^\w.-]+", "_"), 1, length)


def all_words_in(query: Column, text: Column) -> Column:
    """Does the text contain every word of the query? An empty query matches all."""
    words = F.filter(F.split(folded(query), r"\s+"), lambda w: w != "")
    return F.forall(words, lambda w: F.contains(folded(text), w))


def url_quoted(c: Column) -> Column:
    """Percent-encoded; a blank is %20."""
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))


def list_of(c: Column, pattern: str = "[,;]") -> Column:
    """The non-empty trimmed items of a delimited text."""
    return F.filter(F.transform(F.split(c, pattern), lambda x: F.trim(x)), lambda x: x != "")


def media_type(hexed: Column) -> Column:
    """Image type by the first bytes, given in hexadecimal."""
    return (
        F.when(F.startswith(hexed, F.lit("FFD8FF")), "image/jpeg")
        .when(F.startswith(hexed, F.lit("89504E470D0A1A0A")), "image/png")
        .when(F.startswith(hexed, F.lit("52494646")) & (F.substring(hexed, 17, 8) == "57454250"), "image/webp")
        .when(F.startswith(hexed, F.lit("474946383761")) | F.startswith(hexed, F.lit("474946383961")), "image/gif")
    )


def uuid5(namespace_hex: str, name: Column) -> Column:
    """Name-based UUID: SHA-1 of namespace and name, with version and variant bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def hash_fraction(c: Column) -> Column:
    """A number in [0, 1) that depends on the text alone: the first 32 bits of its SHA-256."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def retry_delay(attempt: Column, jitter: Column, hint: Column, initial: float = 0.5, maximum: float = 4.0) -> Column:
    """Seconds before the next attempt: initial, doubled for each attempt after the first, plus jitter, at most maximum; a longer hint of the
    server in plain seconds wins, and one in another form (a date) counts as none."""
    text = F.trim(hint)
    hinted = F.when(text.rlike(r"^(\d+\.?\d*|\.\d+)$"), text.cast("double"))
    backoff = F.least(initial * F.pow(F.lit(2.0), attempt - 1) + jitter, F.lit(maximum))
    return F.greatest(backoff, F.coalesce(hinted, F.lit(0.0)))
