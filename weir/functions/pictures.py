"""What a picture's header says: size as shown and date taken, from the bytes of JPEG, PNG, GIF, BMP, WebP and TIFF files.

Everything is an expression over the beginning of a file: JPEG segments and PNG chunks
are walked by a fold whose state is a position, directories of tags are filtered.
Whatever doesn't fit (a header cut short, a tag that points nowhere) is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound
from .values import exif_date

#: Bytes of a file that are looked at, and segments or chunks that are walked.
HEAD, STEPS = 1 << 18, 1024

#: Tags of directories, and JPEG segments with the size.
ORIENTATION, SAVED, DETAILS, TAKEN, DIGITISED, WIDTH, HEIGHT = 0x0112, 0x0132, 0x8769, 0x9003, 0x9004, 0x0100, 0x0101
SIZE_SEGMENTS = [0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF]


def _hex(c: Column, at: Column | int, n: int) -> Column:
    """Of n bytes from ``at``, counted from 0, or of those that are there; none for a null or a place far behind."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.hex(F.substring(c, F.least(at, F.lit(HEAD)).cast("int") + 1, F.lit(n)))


def number(c: Column, at: Column | int, n: int, little: Column | bool = False) -> Column:
    """An unsigned number of n bytes; null if they aren't all there. What it is made from stands in it once, so that numbers may be places of numbers."""
    forth, back = "".join(f"${k + 1}" for k in range(n)), "".join(f"${n - k}" for k in range(n))
    order = F.lit(back if little else forth) if isinstance(little, bool) else F.when(little, back).otherwise(forth)
    whole = F.regexp_extract(_hex(c, at, n), f"^.{{{2 * n}}}$", 0)
    return F.conv(F.regexp_replace(whole, F.lit("^" + "(..)" * n + "$"), order), 16, 10).cast("long")


def _value(c: Column, entry: Column, little: Column) -> Column:
    """The number of a directory entry, of two or four bytes by its kind."""
    return bound(entry, lambda e: F.when(number(c, e + 2, 2, little) == 3, number(c, e + 8, 2, little)).otherwise(number(c, e + 8, 4, little)))


def _said(c: Column, base: Column, entry: Column, little: Column) -> Column:
    """The text of a directory entry; null for an empty one."""

    def text(e: Column, size: Column) -> Column:
        at = F.when(size > 4, base + number(c, e + 8, 4, little)).otherwise(e + 8)
        raw = F.decode(F.substring(c, F.least(at, F.lit(HEAD)).cast("int") + 1, F.least(size, F.lit(64)).cast("int")), "ISO-8859-1")
        return F.regexp_extract(raw, "^([^\\x00]*)", 1)

    said = bound(entry, lambda e: bound(number(c, e + 4, 4, little), lambda size: F.when(size.isNotNull(), text(e, size))))
    return bound(said, lambda x: F.when(x != "", x))


def directory(c: Column, base: Column) -> Column:
    """struct(width, height, orientation, taken) of the directories of tags that begin at ``base``."""

    def entries(at: Column, little: Column) -> Column:
        """Where each entry of the directory at a position is, by tag; of a tag that is there twice the last."""

        def every(at: Column) -> Column:
            n = F.least(number(c, at, 2, little), F.lit(512)).cast("int")
            numbers = F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: i < n)
            return F.transform(F.transform(numbers, lambda i: at + 2 + i * 12), lambda e: F.struct(number(c, e, 2, little).alias("tag"), e.alias("entry")))

        return bound(at, lambda at: F.when(number(c, at, 2, little).isNotNull(), every(at)))

    def entry(all_: Column, tag: int) -> Column:
        return F.get(F.reverse(F.filter(all_, lambda e: e["tag"] == tag)), 0)["entry"]

    def facts(base: Column, little: Column, main: Column) -> Column:
        details = base + number(c, entry(main, DETAILS) + 8, 4, little)
        date = lambda all_, tag: _said(c, base, entry(all_, tag), little)
        taken = bound(entries(details, little), lambda sub: F.coalesce(date(sub, TAKEN), date(sub, DIGITISED)))
        value = lambda tag: _value(c, entry(main, tag), little)
        when = F.coalesce(bound(taken, exif_date), bound(date(main, SAVED), exif_date))
        return F.struct(value(WIDTH).alias("width"), value(HEIGHT).alias("height"), value(ORIENTATION).alias("orientation"), when.alias("taken"))

    def found(base: Column, mark: Column) -> Column:
        little = mark == "49492A00"
        first = base + number(c, base + 4, 4, little)
        return F.when(mark.isin("49492A00", "4D4D002A"), bound(little, lambda little: bound(entries(first, little), lambda main: facts(base, little, main))))

    return bound(base, lambda base: F.when(base.isNotNull(), bound(_hex(c, base, 4), lambda mark: found(base, mark))))


def _walk(c: Column, start: int, step) -> Column:
    """A fold of struct(at, size, tags): where it is, where the size and the directories of tags were found; ``at`` is null at the end."""
    none = F.struct(F.lit(start).cast("long").alias("at"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("long").alias("tags"))
    return F.aggregate(F.sequence(F.lit(1), F.least(F.lit(STEPS), F.floor(F.length(c) / 4).cast("int") + 1)), none, lambda a, _: F.when(a["at"].isNull(), a).otherwise(step(a)))


def _jpeg(c: Column) -> Column:
    def step(a: Column) -> Column:
        at = a["at"]
        kind, size = number(c, at + 1, 1), number(c, at + 2, 2)
        there = (_hex(c, at, 1) == "FF") & kind.isNotNull()
        filler = kind == 0xFF
        sized, tags = kind.isin(SIZE_SEGMENTS), (kind == 0xE1) & (_hex(c, at + 4, 6) == "457869660000") & a["tags"].isNull()
        then = F.when(~F.coalesce(there, F.lit(False)) | kind.isin(0xD9, 0xDA) | sized, F.lit(None)).when(filler, at + 1).when((kind == 0x01) | kind.between(0xD0, 0xD8), at + 2).otherwise(at + 2 + size)
        return F.struct(then.cast("long").alias("at"), F.when(there & sized, at + 5).otherwise(a["size"]).cast("long").alias("size"), F.when(there & tags, at + 10).otherwise(a["tags"]).cast("long").alias("tags"))

    found = _walk(c, 2, step)
    return bound(found, lambda x: F.struct(number(c, x["size"] + 2, 2).alias("width"), number(c, x["size"], 2).alias("height"), directory(c, x["tags"]).alias("tags")))


def _png(c: Column) -> Column:
    def step(a: Column) -> Column:
        at = a["at"]
        size, kind = number(c, at, 4), _hex(c, at + 4, 4)
        tags = F.when(kind == "65584966", at + 8).otherwise(a["tags"])
        then = F.when(size.isNull() | kind.isNull() | (kind == "49454E44") | tags.isNotNull(), F.lit(None)).otherwise(at + 12 + size)
        return F.struct(then.cast("long").alias("at"), a["size"].alias("size"), tags.cast("long").alias("tags"))

    return F.struct(number(c, 16, 4).alias("width"), number(c, 20, 4).alias("height"), bound(_walk(c, 8, step), lambda x: directory(c, x["tags"])).alias("tags"))


def _webp(c: Column) -> Column:
    kind = F.decode(F.substring(c, 13, 4), "ISO-8859-1")
    bits = number(c, 21, 4, True)
    plain = lambda w, h: F.struct(w.alias("width"), h.alias("height"), F.lit(None).cast("struct<width:long,height:long,orientation:long,taken:timestamp>").alias("tags"))
    wide = plain(number(c, 24, 3, True) + 1, number(c, 27, 3, True) + 1)
    lossless = plain(bits.bitwiseAND(0x3FFF) + 1, F.shiftright(bits, 14).bitwiseAND(0x3FFF) + 1)
    return F.when(kind == "VP8X", wide).when(kind == "VP8L", lossless).when(kind == "VP8 ", plain(number(c, 26, 2, True).bitwiseAND(0x3FFF), number(c, 28, 2, True).bitwiseAND(0x3FFF)))


def picture_facts(content: Column | str) -> Column:
    """struct(kind, width, height, taken) of a picture file's bytes; null for what isn't one of these kinds.

    Width and height are those of the picture as it is shown: a picture that is stored
    lying on its side is turned. ``taken``: when the camera says it was taken, or
    digitised, or else last saved.
    """
    c = F.substring(F.col(content) if isinstance(content, str) else content, 1, HEAD)

    def facts(c: Column) -> Column:
        mark = _hex(c, 0, 4)
        none = F.lit(None).cast("struct<width:long,height:long,orientation:long,taken:timestamp>")
        sized = lambda w, h: F.struct(w.alias("width"), h.alias("height"), none.alias("tags"))
        high = number(c, 22, 4, True)
        tiff = bound(directory(c, F.lit(0)), lambda d: F.struct(d["width"].alias("width"), d["height"].alias("height"), d.alias("tags")))
        kinds = {
            "jpeg": (mark.startswith("FFD8FF"), _jpeg(c)), "png": (_hex(c, 0, 8) == "89504E470D0A1A0A", _png(c)),
            "gif": (_hex(c, 0, 6).isin("474946383761", "474946383961"), sized(number(c, 6, 2, True), number(c, 8, 2, True))),
            "bmp": (mark.startswith("424D"), sized(number(c, 18, 4, True), F.when(high >= 1 << 31, F.lit(1 << 32) - high).otherwise(high))),
            "webp": ((mark == "52494646") & (_hex(c, 8, 4) == "57454250"), _webp(c)), "tiff": (mark.isin("49492A00", "4D4D002A"), tiff),
        }
        kind, found = F.lit(None).cast("string"), F.lit(None)
        for name, (is_, said) in reversed(kinds.items()):
            kind, found = F.when(is_, name).otherwise(kind), F.when(is_, said).otherwise(found)

        def shown(x: Column) -> Column:
            lying = F.coalesce(x["tags"]["orientation"].between(5, 8), F.lit(False))
            side = lambda a, b: F.when(lying, x[b]).otherwise(x[a])
            return F.struct(kind.alias("kind"), side("width", "height").alias("width"), side("height", "width").alias("height"), x["tags"]["taken"].alias("taken"))

        return F.when(kind.isNotNull(), bound(found, shown))

    return bound(c, facts)
