"""Column functions over facts about pictures, recordings and their metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import safe_filename
from .text import _col, strip

#: Codecs that play badly, endings and the sound format of each.
FRAGILE = ["vp9", "vp09", "av1", "av01"]
SOUND_FORMATS = {".mp3": "mp3", ".m4a": "m4a", ".aac": "m4a", ".wav": "wav", ".flac": "flac", ".ogg": "ogg", ".oga": "ogg", ".opus": "opus"}
LIGHTER = ["JPEG", "PNG", "WEBP", "TIFF"]


def picture_format(c: Column | str) -> Column:
    """JPG and TIF by their full names, upper case."""
    name = F.upper(F.coalesce(_col(c), F.lit("")))
    return F.when(name.isin("JPG", "JPE"), "JPEG").when(name == "TIF", "TIFF").otherwise(name)


def cannot_shrink(c: Column | str, refused: dict[str, str]) -> Column:
    """Why a picture can't be made lighter in its own format; '' if it can. ``refused``: formats with a reason of their own."""
    name = picture_format(c)
    out = F.when(name.isin(LIGHTER), "")
    for other, why in refused.items():
        out = F.when(name == other, why).otherwise(out) if out is None else out.when(name == other, why)
    return out.otherwise(F.concat(F.when(name == "", "This kind of file").otherwise(name), F.lit(" cannot be made lighter without changing its format.")))


def looks_like_photo(flat_share: Column) -> Column:
    """Whether few of the pixels lie in the 16 most frequent colours."""
    return flat_share < 0.35


def plays_everywhere(codec: Column | str) -> Column:
    return ~F.lower(_col(codec)).rlike("^(" + "|".join(FRAGILE) + ")")


def sound_format(suffix: Column, wanted: str = "keep") -> Column:
    if wanted != "keep":
        return F.lit(wanted)
    known = F.create_map(*(F.lit(x) for pair in SOUND_FORMATS.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.lower(suffix)), F.lit("mp3"))


def layout_mode(c: Column | str) -> Column:
    """One of sorted, per_video, flat, whatever an old setting says."""
    c = F.coalesce(_col(c), F.lit(""))
    return F.when(c.isin("sorted", "per_video", "flat"), c).when(c.isin("true", "True", "1"), "per_video").otherwise("sorted")


def layout(destination: Column, title: Column, mode: Column, *, video: str = "Video", audio: str = "Audio", text: str = "Text") -> Column:
    """struct(root, video, audio, text): the folders of one video."""
    own = F.concat(destination, F.lit("/"), safe_filename(F.when(title == "", "video").otherwise(title), "video", 80, normal=False))
    root = F.when(mode == "flat", destination).otherwise(own)
    sub = lambda name: F.when(mode == "sorted", F.concat(root, F.lit("/" + name))).otherwise(root)
    return F.struct(root.alias("root"), sub(video).alias("video"), sub(audio).alias("audio"), sub(text).alias("text"))


def base_name(title: Column, video_id: Column) -> Column:
    """'title [id]', the name that all files of a video share."""
    name = safe_filename(F.when(F.coalesce(title, F.lit("")) == "", "video").otherwise(title), normal=False)
    return F.when(F.coalesce(video_id, F.lit("")) == "", name).otherwise(F.concat(name, F.lit(" ["), video_id, F.lit("]")))


def fitting(destination: Column, name: Column, most: int = 235, least: int = 24) -> Column:
    """A name cut so that the whole path (with a slash and a four-character ending) stays short enough."""
    room = F.lit(most) - F.length(destination) - 5
    cut = F.regexp_replace(F.substring(name, F.lit(1), F.greatest(room, F.lit(least))), "[ .]+$", "")
    return F.when(room >= F.length(name), name).otherwise(F.when(cut == "", "video").otherwise(cut))


def height_limit(quality: Column | str) -> Column:
    """'up to 720p' as 720; null for the best there is."""
    q = _col(quality)
    return F.when(~F.lower(q).startswith("best"), F.nullif(F.regexp_replace(q, "[^0-9]", ""), F.lit("")).try_cast("int"))


def clamped(c: Column, low: int, high: int, other: int) -> Column:
    # greatest and least pass over a null
    return F.when(c.try_cast("int").isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c.try_cast("int")))).otherwise(other)


def target_bytes(kilobytes: Column) -> Column:
    return F.when(kilobytes.try_cast("long").isNotNull(), F.greatest(F.lit(1), kilobytes.try_cast("long"))).otherwise(500) * 1024


def limited(width: Column, height: Column, most: int) -> Column:
    """struct(width, height) with the longest side at most ``most``; sides are cut off, not rounded."""
    ratio = F.lit(float(most)) / F.greatest(width, height)
    fits = (F.lit(most) <= 0) | (F.greatest(width, height) <= most)
    side = lambda x: F.when(fits, x).otherwise(F.greatest(F.lit(1), F.floor(x * ratio).cast("int")))
    return F.struct(side(width).cast("int").alias("width"), side(height).cast("int").alias("height"))


def fitted(width: Column, height: Column, box: tuple[int, int], fill: bool = False) -> Column:
    """struct(width, height, x, y): a picture whole and centred on a canvas, or filling it."""
    a, b = F.lit(float(box[0])) / width, F.lit(float(box[1])) / height
    scale = F.greatest(a, b) if fill else F.least(a, b)
    w, h = (F.greatest(F.lit(1), F.bround(x * scale, 0).cast("int")) for x in (width, height))
    return F.struct(w.alias("width"), h.alias("height"), F.floor((F.lit(box[0]) - w) / 2).cast("int").alias("x"), F.floor((F.lit(box[1]) - h) / 2).cast("int").alias("y"))


def grid_size(count: Column, columns: Column) -> Column:
    """struct(columns, rows); columns worked out when 0."""
    n = F.when(columns > 0, columns).otherwise(F.greatest(F.lit(1), F.ceil(F.sqrt(count)))).cast("int")
    return F.when(count > 0, F.struct(n.alias("columns"), F.ceil(count / n).cast("int").alias("rows"))).otherwise(F.struct(F.lit(0).alias("columns"), F.lit(0).alias("rows")))


def subtitle_colour(c: Column | str, alpha: int = 0) -> Column:
    """#RRGGBB as &HAABBGGRR."""
    c = _col(c)
    return F.upper(F.concat(F.lit(f"&H{alpha:02X}"), F.substring(c, 6, 2), F.substring(c, 4, 2), F.substring(c, 2, 2)))


def colour(c: Column | str) -> Column:
    """#RRGGBB as struct(r, g, b); null for anything else."""
    c = _col(c)
    part = lambda at: F.conv(F.substring(c, at, 2), 16, 10).cast("int")
    return F.when(c.rlike("^#[0-9A-Fa-f]{6}$"), F.struct(part(2).alias("r"), part(4).alias("g"), part(6).alias("b")))


def region(c: Column | str) -> Column:
    """'100,200 1280x720' as struct(x, y, width, height); null for anything else."""
    s, form = strip(c), r"^([0-9]+)\s*,\s*([0-9]+)\s+([0-9]+)\s*x\s*([0-9]+)$"
    return F.when(s.rlike(form), F.struct(*(F.regexp_extract(s, form, k + 1).cast("int").alias(n) for k, n in enumerate(("x", "y", "width", "height")))))


def pdf_date(c: Column | str) -> Column:
    """'D:20260712103000' as '2026-07-12 10:30'; other texts as they are."""
    c = _col(c)
    form = r"^D:([0-9]{4})([0-9]{2})?([0-9]{2})?([0-9]{2})?([0-9]{2})?"
    part = lambda k: F.regexp_extract(c, form, k)
    day = F.concat(part(1), F.when(part(2) != "", F.concat(F.lit("-"), part(2))).otherwise(""), F.when(part(3) != "", F.concat(F.lit("-"), part(3))).otherwise(""))
    time = F.when(part(4) != "", F.concat(F.lit(" "), part(4), F.lit(":"), F.when(part(5) == "", "00").otherwise(part(5)))).otherwise("")
    return F.when(c.rlike(form), F.concat(day, time)).otherwise(c)


def gps_text(latitude: Column, north: Column, longitude: Column, east: Column) -> Column:
    """Arrays of degrees, minutes, seconds and the letters as 'lat, lon' with five places; 'present' if either is missing."""

    def degrees(values: Column, letter: Column) -> Column:
        d = F.get(values, 0) + F.get(values, 1) / 60 + F.get(values, 2) / 3600
        return F.when(F.size(values) == 3, F.when(F.upper(letter).isin("S", "W"), -d).otherwise(d))

    lat, lon = degrees(latitude, north), degrees(longitude, east)
    return F.when(lat.isNull() | lon.isNull(), "present").otherwise(F.format_string("%.5f, %.5f", lat, lon))


def creation_time(text: Column | str, zone: str = "UTC") -> Column:
    """When a recording began, from what a media tool prints: UTC turned into ``zone``, a time with an offset as written; null before 1971."""
    form = r"creation_time\s*:\s*(\d{4}-\d\d-\d\d)[T ](\d\d:\d\d:\d\d)(\.\d+)?(Z|[+-]\d\d:?\d\d)?"
    text = _col(text)
    part = lambda k: F.regexp_extract(text, form, k)
    when = F.try_to_timestamp(F.concat_ws(" ", part(1), part(2)), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    local = F.when(part(4).isin("", "Z"), F.convert_timezone(F.lit("UTC"), F.lit(zone), when)).otherwise(when)
    return F.when(F.year(when) >= 1971, local)


#: Tags of Office properties, their labels and whether they tell about a person.
CORE = {
    "creator": ("Author", True), "lastModifiedBy": ("Last edited by", True), "title": ("Title", False), "subject": ("Subject", False), "keywords": ("Keywords", False),
    "description": ("Description", False), "category": ("Category", False), "created": ("Date created", False), "modified": ("Date changed", False),
    "lastPrinted": ("Last printed", False), "revision": ("Revision", False), "contentStatus": ("Status", False),
}
APP = {
    "Company": ("Company", True), "Manager": ("Manager", True), "Template": ("Template", False), "TotalTime": ("Editing time (minutes)", False),
    "Application": ("Program", False), "HyperlinkBase": ("Link base", False),
}


def office_findings(xml: Column | str, known: dict[str, tuple[str, bool]], longest: int = 120) -> Column:
    """Array of struct(label, value, sensitive) of a properties part's known tags."""
    xml = _col(xml)
    form = r"<(?:\w+:)?(\w+)(?:\s[^>]*)?>([^<]+)</"
    labels = F.create_map(*(F.lit(x) for tag, (label, _) in known.items() for x in (tag, label)))
    secret = F.array(*(F.lit(tag) for tag, (_, sensitive) in known.items() if sensitive))
    pairs = F.zip_with(F.regexp_extract_all(xml, F.lit(form), 1), F.regexp_extract_all(xml, F.lit(form), 2), lambda t, v: F.struct(t.alias("t"), F.trim(v).alias("v")))
    good = F.filter(pairs, lambda p: F.array_contains(F.map_keys(labels), p["t"]) & (p["v"] != ""))
    return F.transform(good, lambda p: F.struct(F.try_element_at(labels, p["t"]).alias("label"), F.substring(p["v"], 1, longest).alias("value"), F.array_contains(secret, p["t"]).alias("sensitive")))


def without_app_tags(xml: Column | str) -> Column:
    """A properties part without the tags that name people and programs."""
    names = "|".join(APP)
    return F.regexp_replace(_col(xml), rf"<({names})>[^<]*</\1>|<({names})\s*/>", "")


def merge_problem(message: Column) -> Column:
    low = F.lower(message)
    return low.rlike("merging of multiple formats|postprocessing") | (low.contains("ffmpeg") & low.contains("not installed"))


def cookie_problem(message: Column) -> Column:
    return F.lower(message).rlike("cookie|could not copy|keyring")


def gpu_problem(message: Column) -> Column:
    return F.lower(F.coalesce(message, F.lit(""))).rlike("cuda|cudnn|cublas|gpu|device|nvidia")


def web_address(c: Column | str) -> Column:
    return strip(F.coalesce(_col(c), F.lit(""))).rlike(r"^(?i:https?)://[^\s<>\"']+$")


def write_problem(code: Column, path: Column, other: Column) -> Column:
    """What a system's error name (EACCES, ENOSPC, ENAMETOOLONG, EINVAL, ENOENT) means for a path."""
    long = (code == "ENAMETOOLONG") | ((code == "EINVAL") & (F.length(path) > 240))
    return (
        F.when(code == "EACCES", F.concat(F.lit("No access to '"), path, F.lit("'. The file may be open in another program, or the folder may be read-only.")))
        .when(code == "ENOSPC", F.concat(F.lit("There is no free space left on the disk holding '"), path, F.lit("'.")))
        .when(long, "The full path of the new file is too long.")
        .when(code == "ENOENT", F.concat(F.lit("This path does not exist any more: "), path))
        .otherwise(F.concat(F.lit("The file could not be written: "), other))
    )


def shapes(svg: Column | str) -> Column:
    """struct(shapes, curves) of a drawing's text."""
    svg = _col(svg)
    return F.struct(F.regexp_count(svg, F.lit(r"(?i)<path\b")).cast("long").alias("shapes"), F.regexp_count(svg, F.lit("[CcQqSsAa]")).cast("long").alias("curves"))


def download_format(keep_video: Column, limit: Column, merge: Column, compatible: Column) -> Column:
    """What streams to ask a download engine for."""
    cap = F.when(limit.isNotNull(), F.concat(F.lit("[height<="), limit.cast("string"), F.lit("]"))).otherwise("")
    say = lambda *parts: F.concat(*(cap if p is None else F.lit(p) for p in parts))
    safe = say("bestvideo[vcodec^=avc1]", None, "+bestaudio[acodec^=mp4a]/bestvideo[ext=mp4]", None, "+bestaudio[ext=m4a]/best[ext=mp4]", None, "/bestvideo", None, "+bestaudio/best", None, "/best")
    return F.when(~keep_video, "bestaudio/best").when(~merge, say("best[ext=mp4]", None, "/best", None, "/best")).when(compatible, safe).otherwise(say("bestvideo", None, "+bestaudio/best", None, "/best"))
