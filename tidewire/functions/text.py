"""Text expressions; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-cased words of a text: all but the letters a to z, $, yen, euro, + and white space is deleted, then it is split at white space. Empty ones are dropped."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^a-z$¥€\s+]", ""), r"\s+"), lambda x: x != "")


def strip_token(word: Column) -> Column:
    """A word without all that isn't an ASCII letter or digit."""
    return F.regexp_replace(word, "[^A-Za-z0-9]", "")


def trim_label(label: Column) -> Column:
    """A label as a file name: runs of commas, plus signs and white space are one underscore."""
    return F.regexp_replace(label, r"[,\s+]+", "_")


def safe_string(text: Column) -> Column:
    """A text without the signs that the line format uses: line ends, brackets and tildes are spaces, runs of white space one space."""
    return F.regexp_replace(F.regexp_replace(text, r"[\n\[\]~]", " "), r"\s+", " ")


def resource_id(iri: Column) -> Column:
    """What follows an IRI's last slash, without the closing sign."""
    last = F.substring_index(iri, "/", -1)
    return F.substring(last, F.lit(1), F.greatest(F.length(last) - 1, F.lit(0)))


def last_segment(path: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(path, "/", -1)


def word_total(text: Column) -> Column:
    """Words between white space; null and blank texts have 0."""
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", 0).otherwise(F.size(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")))


def is_ordinary(text: Column) -> Column:
    """Whether a text has only letters a to z, digits and white space."""
    return text.rlike(r"^[A-Za-z0-9\s]*$")


def pretty_time(ms: Column, short: bool = False) -> Column:
    """Milliseconds as days, hours, minutes and seconds; short: from the greatest that isn't 0 on."""
    total = F.floor(ms / 1000)
    d, h, m, s = F.floor(total / 86400), F.floor(total / 3600) % 24, F.floor(total / 60) % 60, total % 60
    part = lambda n, u: F.concat(n.cast("bigint").cast("string"), F.lit(u))
    whole = F.concat_ws(" ", part(d, "d"), part(h, "h"), part(m, "m"), part(s, "s"))
    if not short:
        return whole
    return F.when(d > 0, whole).when(h > 0, F.concat_ws(" ", part(h, "h"), part(m, "m"), part(s, "s"))).when(m > 0, F.concat_ws(" ", part(m, "m"), part(s, "s"))).otherwise(part(s, "s"))


def nitf_date(text: Column) -> Column:
    """A news markup date such as 20070115T000000 as a timestamp; other forms are null."""
    return F.try_to_timestamp(text, F.lit("yyyyMMdd'T'HHmmss"))


def epoch_millis(time: Column) -> Column:
    """A timestamp as text of milliseconds since 1970."""
    return F.unix_millis(time).cast("string")


def from_epoch_millis(text: Column) -> Column:
    """Text of milliseconds since 1970 as a timestamp; other forms are null."""
    return F.when(text.rlike("^-?[0-9]{1,15}$"), F.timestamp_millis(F.try_to_number(text, F.lit("S999999999999999")).cast("bigint")))
