"""Text functions as column expressions; nothing here runs Python per row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words of the language vote, and the letters that only one side writes.
STOP_ES = ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al", "lo"]
STOP_EN = ["the", "of", "and", "to", "in", "is", "that", "it", "was", "for", "on", "are", "with", "as", "be", "at", "this", "have", "from", "or"]
ACCENTS_ES = "[áéíóúüñ¿¡]"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def squeezed(text: Column) -> Column:
    """Runs of spaces, tabs and line ends become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, "[ \t\n\r\f]+", " "))


def masked(line: Column) -> Column:
    """Key of a running head: digits as #, white space squeezed, lower case."""
    return F.lower(squeezed(F.regexp_replace(line, "[0-9]+", "#")))


def clean_lines(text: Column) -> Column:
    """Soft hyphens and byte order marks go, lines are squeezed, a line equal to the one before goes."""
    plain = F.regexp_replace(text, "[­﻿]", "")
    lines = F.transform(F.split(plain, "\n", -1), lambda x: F.trim(F.regexp_replace(x, "[ \t]+", " ")))
    # each line beside the one before it: one pass, whatever the number of lines
    pairs = F.zip_with(lines, F.array_prepend(lines, F.lit(None)), lambda x, before: F.struct(x.alias("x"), before.alias("before")))
    kept = F.filter(pairs, lambda p: p["x"].isNotNull() & ~p["x"].eqNullSafe(p["before"]))
    return F.array_join(F.transform(kept, lambda p: p["x"]), "\n")


def dehyphenated(text: Column) -> Column:
    """Undoes line-end hyphens before a lower-case letter; other line ends become spaces."""
    joined = F.regexp_replace(text, r"(?U)(?<=\p{L})-[ \t]*\n[ \t]*(?=\p{Ll})", "")
    return squeezed(joined)


def unit_id(*parts: Column) -> Column:
    """Stable id of a unit: the first 24 hex digits of the hash of its joined parts."""
    return F.left(F.sha2(F.concat_ws(":", *parts).cast("binary"), 256), F.lit(24))


def take_seed(text: Column, take: Column) -> Column:
    digest = F.sha2(F.concat(text, F.lit("\0take="), take.cast("string")).cast("binary"), 256)
    return F.conv(F.left(digest, F.lit(8)), 16, 10).cast("bigint")


def redacted(text: Column) -> Column:
    """Bearer tokens, API keys and long hexadecimal strings."""
    out = F.regexp_replace(text, r"(?i)bearer [A-Za-z0-9._\-]+", "Bearer <redacted>")
    out = F.regexp_replace(out, r"(?i)(sk|key|api|tok)[-_][A-Za-z0-9]{16,}", "<redacted>")
    return F.regexp_replace(out, r"[0-9a-fA-F]{32,}", "<redacted>")


def suspects(text: Column) -> tuple[Column, Column]:
    """Words that mix letters and digits, and words cut by a hyphen and a space."""
    mixed = F.regexp_extract_all(text, F.lit(r"([\p{L}]+[0-9]+[\p{L}]+)"), F.lit(1))
    broken = F.regexp_extract_all(text, F.lit(r"([\p{Ll}]{2,}- [\p{Ll}]{2,})"), F.lit(1))
    return mixed, broken


#: Ordered rewrites of the Peninsular phonetic key.
PHONETIC = [
    ("ch", "\u0001"), ("ll", "y"), ("qu", "k"), ("gue", "ge\u0002"), ("gui", "gi\u0002"), ("ge", "je"), ("gi", "ji"), ("je\u0002", "ge"), ("ji\u0002", "gi"),
    ("ce", "ze"), ("ci", "zi"), ("c", "k"), ("v", "b"), ("x", "j"), ("h", ""), ("\u0001", "ch"),
]


def phonetic_key(word: Column) -> Column:
    plain = F.translate(F.lower(word), "áéíóúü", "aeiouu")
    return reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), PHONETIC, plain)


#: How a word sounds in Peninsular Spanish, as ordered patterns over plain lower-case letters: words with one key are said alike.
SOUNDS = [
    ("ch", "ç"), ("ll", "y"), ("v", "b"), ("h", ""), ("w", "u"), ("qu(?=[ei])", "k"), ("c(?=[aou]|$|[^eiç])|q", "k"), ("gu(?=[ei])", "g"), ("g(?=[ei])", "j"), ("c(?=[ei])|z", "θ"), ("x", "j"),
]


def sound_key(word: Column) -> Column:
    from .numbers import folded

    return reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), SOUNDS, folded(word))


def clock_text(seconds: Column) -> Column:
    """h:mm:ss.t of a number of seconds."""
    tenths = F.floor(seconds * 10 + 0.5).cast("bigint")
    hours, rest = F.floor(tenths / 36000).cast("bigint"), F.pmod(tenths, F.lit(36000))
    return F.format_string("%d:%02d:%02d.%d", hours, F.floor(rest / 600).cast("bigint"), F.floor(F.pmod(rest, F.lit(600)) / 10).cast("bigint"), F.pmod(rest, F.lit(10)))


def clock_seconds(text: Column) -> Column:
    """Seconds of a full (h:mm:ss), partial (mm:ss) or counted (5s, 1500ms, 2min, 1h) clock value; else null."""
    t = F.trim(text)
    part = lambda p, i: F.regexp_extract(t, p, i).try_cast("double")
    whole = r"^(\d+):([0-5]\d):([0-5]\d(?:\.\d+)?)$"
    partial = r"^([0-5]\d):([0-5]\d(?:\.\d+)?)$"
    counted = r"^(\d+(?:\.\d+)?)(h|min|ms|s)?$"
    unit = F.regexp_extract(t, counted, 2)
    scale = F.when(unit == "h", 3600.0).when(unit == "min", 60.0).when(unit == "ms", 0.001).otherwise(1.0)
    return F.when(t.rlike(whole), part(whole, 1) * 3600 + part(whole, 2) * 60 + part(whole, 3)).when(t.rlike(partial), part(partial, 1) * 60 + part(partial, 2)).when(t.rlike(counted), part(counted, 1) * scale)


def retry_after(header: Column) -> Column:
    """Seconds of a header in [0, 600], else null."""
    n = F.trim(header).try_cast("double")
    return F.when(n.between(0, 600), n)


def safe_name(text: Column) -> Column:
    """A file name: unsafe characters become _, at most 80 characters."""
    plain = F.translate(text, "áéíóúüñÁÉÍÓÚÜÑ", "aeiouunAEIOUUN")
    return F.left(F.regexp_replace(F.regexp_replace(plain, "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", ""), F.lit(80))


# Month names.
MONTHS = ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"]


def month_of(date: Column) -> Column:
    """"octubre de 2026"."""
    return F.concat(F.get(F.array(*map(F.lit, MONTHS)), F.month(date) - 1), F.lit(" de "), F.year(date))


def contents_row(line: Column) -> tuple[Column, Column]:
    """(label, page) of a contents row: by leaders or a wide gap, else the last number after one space."""
    leaders = r"^(.*?\S)\s*(?:\.{2,}|…+|\s{3,})[\s.…]*([0-9]{1,4}|[ivxlcdmIVXLCDM]+)\s*$"
    single = r"^(.*\S)\s([0-9]{1,4})\s*$"
    # what matches has a label that is not empty: one match tells both, and a row without one is searched once
    wide, near = F.regexp_extract(line, leaders, 1), F.regexp_extract(line, single, 1)
    by_space = (near != "") & ~F.lower(near).rlike(r"(cap[ií]tulo|parte|libro|secci[oó]n)$")
    label = F.when(wide != "", wide).when(by_space, near).otherwise(F.trim(line))
    page = F.when(wide != "", F.regexp_extract(line, leaders, 2)).when(by_space, F.regexp_extract(line, single, 2)).otherwise("")
    return label, page
