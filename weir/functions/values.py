"""Column functions over cells, numbers, times and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, casefold, collapse, strip


def typed(c: Column | str, comma_decimal: bool = False) -> Column:
    """struct(kind, i, f, t): a text cell as the number it clearly is. Numbers with leading zeros stay text."""
    c = _col(c)
    s = strip(c)
    float_ = r"^-?\d+,\d+$" if comma_decimal else r"^-?\d+\.\d+$"
    whole = s.rlike(r"^-?\d{1,15}$") & ~s.rlike(r"^-*0\d")
    kind = F.when(s.isNull() | (s == ""), "null").when(whole, "int").when(s.rlike(float_), "float").otherwise("text")
    return F.struct(
        kind.alias("kind"),
        F.when(kind == "int", s.try_cast("bigint")).alias("i"),
        F.when(kind == "float", F.replace(s, F.lit(","), F.lit(".")).try_cast("double")).alias("f"),
        F.when(kind == "text", c).alias("t"),
    )


def _float_text(c: Column) -> Column:
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    return F.when(whole, F.format_string("%d", F.when(whole, c).cast("bigint"))).otherwise(c.cast("string"))


def cell_text(c: Column | str, kind: str, comma_decimal: bool = False) -> Column:
    """The canonical text of a cell of SQL type ``kind``; null as ''."""
    c = _col(c)
    if kind == "boolean":
        out = F.when(c, "TRUE").otherwise("FALSE")
    elif kind in ("double", "float"):
        out = _float_text(c.cast("double"))
        out = F.replace(out, F.lit("."), F.lit(",")) if comma_decimal else out
    elif kind.startswith("timestamp"):
        out = F.when(F.date_format(c, "HH:mm:ss") == "00:00:00", F.date_format(c, "yyyy-MM-dd")).otherwise(F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    else:
        out = c.cast("string")
    return F.when(c.isNull(), "").otherwise(out)


def column_key(c: Column | str) -> Column:
    return casefold(collapse(c))


def formula_guard(c: Column | str) -> Column:
    """A text that begins with = gets an apostrophe before it."""
    c = _col(c)
    return F.when(c.startswith("="), F.concat(F.lit("'"), c)).otherwise(c)


def human_size(c: Column | str, units: tuple[str, ...] = ("B", "KB", "MB", "GB")) -> Column:
    """'1.4 MB' for 1468006 bytes; below 0 as 0. Halves round to even, in whole numbers."""
    v = F.greatest(_col(c).cast("bigint"), F.lit(0).cast("bigint"))

    def said(k: int) -> Column:
        if not k:
            return F.format_string("%d B", v)
        size = F.lit(1 << 10 * k).cast("bigint")
        rest = (v * 10) % size
        down = ((v * 10 - rest) / size).cast("bigint")
        up = (rest * 2 > size) | ((rest * 2 == size) & (down % 2 == 1))
        n = F.when(up, down + 1).otherwise(down)
        return F.concat(F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"), F.lit(" " + units[k]))

    out = said(len(units) - 1)
    for k in range(len(units) - 2, -1, -1):
        out = F.when(v < F.lit(1 << 10 * (k + 1)).cast("bigint"), said(k)).otherwise(out)
    return out


def saving_percent(before: Column, after: Column) -> Column:
    return F.when(before <= 0, 0.0).otherwise((before - after) * 100.0 / before)


def describe_seconds(c: Column | str) -> Column:
    """Time left as people say it; halves round to even."""
    s = F.bround(_col(c).cast("double"), 0).cast("bigint")
    five, minutes = F.bround(s / 5.0, 0).cast("bigint") * 5, F.bround(s / 60.0, 0).cast("bigint")
    return (
        F.when(s.isNull(), "estimating time left")
        .when(s < 10, "a few seconds left")
        .when(s < 60, F.format_string("about %d s left", five))
        .when(minutes < 60, F.format_string("about %d min left", minutes))
        .otherwise(F.format_string("about %d h %02d min left", F.floor(minutes / 60), minutes % 60))
    )


def clock(c: Column | str) -> Column:
    """m:ss, or h:mm:ss from an hour on."""
    s = F.greatest(_col(c).cast("bigint"), F.lit(0))
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s % 60)).otherwise(F.format_string("%d:%02d", m, s % 60))


def srt_time(c: Column | str) -> Column:
    """hh:mm:ss,mmm"""
    ms = F.bround(_col(c) * 1000, 0).cast("bigint")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000), F.floor(ms % 3600000 / 60000), F.floor(ms % 60000 / 1000), ms % 1000)


def parse_time(c: Column | str) -> Column:
    """'1:30,5' as seconds; null for '' and for what isn't a time."""
    s = F.replace(strip(c), F.lit(","), F.lit("."))
    good = s.rlike(r"^\s*\d+(\.\d+)?\s*(:\s*\d+(\.\d+)?\s*){0,2}$")
    parts = F.transform(F.split(F.when(good, s), ":"), lambda p: F.trim(p).try_cast("double"))
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a * 60 + x)


def new_size(width: Column, height: Column, mode: str, value: int, enlarge: bool = False) -> Column:
    """struct(width, height) with proportions kept; ``mode``: longest, width, height or percent."""
    value = max(1, int(value))
    ratio = {"longest": F.lit(float(value)) / F.greatest(width, height), "width": F.lit(float(value)) / width, "height": F.lit(float(value)) / height, "percent": F.lit(value / 100.0)}[mode]
    same = (ratio > 1.0) & F.lit(not enlarge)
    side = lambda x: F.when(same, x).otherwise(F.greatest(F.lit(1), F.bround(x * ratio, 0).cast("int")))
    return F.struct(side(width).cast("int").alias("width"), side(height).cast("int").alias("height"))


def target_kbps(megabytes: Column, seconds: Column, sound_kbps: int = 128) -> Column:
    """The video bit rate that makes a file fit; null below 80 or for an unknown length."""
    video = megabytes * 8 * 1024 * 0.95 / seconds - sound_kbps
    return F.when((seconds > 0) & (video >= 80), video.cast("int"))


def max_distance(similarity: int) -> int:
    """How many of 64 bits may differ at a similarity in percent."""
    return max(0, round((100 - similarity) * 64 / 100))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def letters(c: Column | str) -> Column:
    """1 as A, 26 as Z, 27 as AA, like spreadsheet columns; below 1 the number itself."""
    n = _col(c).cast("bigint")
    # shorter names come first; the whole range of a bigint needs no more than 14 letters
    shorter = [sum(26**i for i in range(1, k + 1)) for k in range(14)]
    said = (F.chr(F.lit(65) + F.call_function("div", n - 1 - less, F.lit(26**k)) % 26) for k, less in enumerate(shorter))
    out = [F.when(n > less, letter).otherwise("") for less, letter in zip(shorter, said, strict=True)]
    return F.when(n < 1, n.cast("string")).otherwise(F.concat(*reversed(out)))


#: The numerals and what they stand for.
ROMAN = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))


def roman(c: Column | str) -> Column:
    """1 to 3999; others as the number itself."""
    n = _col(c).cast("bigint")
    out, rest = [], n
    for amount, letter in ROMAN:
        out.append(F.repeat(F.lit(letter), F.floor(rest / amount).cast("int")))
        rest = rest % amount
    return F.when((n > 0) & (n < 4000), F.concat(*out)).otherwise(n.cast("string"))


def number_text(c: Column | str, digits: Column | int) -> Column:
    """Filled with zeros to ``digits``, the sign before them."""
    n = _col(c).cast("bigint")
    s = F.abs(n).cast("string")
    d = F.lit(digits) if isinstance(digits, int) else digits
    return F.concat(F.when(n < 0, "-").otherwise(""), F.lpad(s, F.greatest(d, F.length(s)), F.lit("0")))


def exif_date(c: Column | str) -> Column:
    """A picture's date in one of four formats, what stands behind it ignored; null for year 0000 and for what isn't a date."""
    s = F.regexp_replace(strip(c), "\u0000", "")
    s = F.when(~s.startswith("0000"), s)
    formats = (("yyyy:MM:dd HH:mm:ss", 19), ("yyyy-MM-dd HH:mm:ss", 19), ("yyyy:MM:dd HH:mm", 16), ("yyyy:MM:dd", 10))
    return F.coalesce(*(F.try_to_timestamp(F.substring(s, 1, n), F.lit(f)) for f, n in formats))


def newer(left: Column, right: Column, dead: float = 2.0) -> Column:
    """Which side is newer; '' within ``dead`` seconds."""
    return F.when(F.abs(left - right) < dead, "").when(left > right, "left is newer").otherwise("right is newer")


def trimmed(start: Column, end: Column, duration: Column) -> Column:
    """How long a part from start to end is that can't go beyond the duration."""
    return F.least(end, duration) - start


def even(c: Column) -> Column:
    return c - F.pmod(c, F.lit(2))
