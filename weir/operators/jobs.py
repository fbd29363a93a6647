"""Queues of jobs: totals, progress, time left, what went wrong; picture histograms and layouts."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STAGES = ["queued", "working", "done", "skipped", "failed", "cancelled"]
FINAL = ["done", "skipped", "failed", "cancelled"]


def batch_summary(jobs: DataFrame) -> DataFrame:
    """One row over ``stage``: done, failed, cancelled, skipped, total."""
    return jobs.agg(*(F.count_if(F.col("stage") == s).alias(s) for s in ("done", "failed", "cancelled", "skipped")), F.count("*").alias("total"))


def queue_progress(jobs: DataFrame, key: list[str] = ()) -> DataFrame:
    """Mean progress; a final job counts 100."""
    done = F.when(F.col("stage").isin(FINAL), 100.0).otherwise(F.col("progress"))
    return jobs.groupBy(*key).agg(F.round(F.avg(done), 6).alias("percent"))


def combined(inputs: DataFrame, key: list[str]) -> DataFrame:
    """One result of many inputs (seq, name, error): the good ones' names in order, how many failed."""
    good = F.array_sort(F.collect_list(F.when(F.col("error").isNull(), F.struct("seq", "name"))))
    return inputs.groupBy(*key).agg(F.transform(good, lambda s: s["name"]).alias("names"), F.count("error").alias("failed"))


def time_left(ticks: DataFrame, *, key: str = "key", least_seconds: float = 3.0, least_share: float = 0.02) -> DataFrame:
    """``key``, ``seq``, ``left`` of (key, seq, elapsed, fraction): smoothed 0.7 / 0.3, null while it is too early, 0 at the end.

    Each value rests on the one before: a fold over a key's ticks in order.
    """
    rows = ticks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "elapsed", "fraction"))).alias("t"))
    out = F.array().cast("array<struct<seq:bigint,left:double>>")
    zero = F.struct(F.lit(None).cast("double").alias("s"), out.alias("out"))

    def step(a: Column, x: Column) -> Column:
        f = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x["fraction"]))
        early = (x["elapsed"] < least_seconds) | (f < least_share)
        raw = x["elapsed"] * (1.0 - f) / f
        s = F.when((f >= 1.0) | early, a["s"]).otherwise(F.when(a["s"].isNull(), raw).otherwise(a["s"] * 0.7 + raw * 0.3))
        left = F.when(f >= 1.0, F.lit(0.0)).when(~early, s)
        return F.struct(s.alias("s"), F.concat(a["out"], F.array(F.struct(x["seq"].cast("long").alias("seq"), left.alias("left")))).alias("out"))

    return rows.select(key, F.inline(F.aggregate("t", zero, step, lambda a: a["out"])))


#: The first rule decides one of whose texts is found; texts in a tuple must all be there.
DOWNLOAD_ERRORS = [
    (["private video"], "This video is private."),
    (["video unavailable", "not available"], "This video is unavailable (removed, region-locked or age-restricted)."),
    ([("age", "restricted"), ("age", "confirm your age")], 'This video is age-restricted. Set "Use cookies from" to the browser where you are logged in to that site.'),
    (["unsupported url"], "This link is not supported."),
    (["http error 429", "too many requests"], "The site is rate-limiting this computer. Wait a few minutes and retry."),
    (["not a bot", "sign in to confirm"], 'The site took the run for a robot and asks for a sign-in. Waiting a while usually clears it; setting "Use cookies from" to the browser where you are logged in to that site avoids it.'),
    (["urlopen error", "getaddrinfo", "proxy", "unable to connect", "connection reset", "connection aborted", "timed out", "temporary failure", "unable to download api page", "ssl"], "The site could not be reached. Check the internet connection, a VPN, or a firewall."),
    (["confirm you are on the latest version", "extractor"], 'The download engine does not understand what the site answered. Press "Update the download engine" and try again.'),
    (["requested format is not available"], "The requested quality is not available for this video."),
    (["merging of multiple formats", ("ffmpeg", "not installed")], "FFmpeg is missing, so the video and audio streams cannot be joined. Install it with:  pip install -U imageio-ffmpeg"),
]
#: Fixed values, as above.
MEDIA_ERRORS = [
    (["permission denied"], "The file or the destination folder cannot be written (is it open in another program?)."),
    (["no space left"], "There is no free space left on the disk."),
    (["invalid data"], "The file seems damaged or is not a sound or video file."),
    (["does not contain any stream", "matches no streams"], "The file has no part of the kind asked for (for example no sound)."),
]


def explained(message: Column, rules: list[tuple[list[str | tuple[str, ...]], str]], other: Column) -> Column:
    """What a message means, by the first rule one of whose texts it has."""
    low = F.lower(message)
    has = lambda texts: reduce(and_, [F.contains(low, F.lit(t)) for t in ([texts] if isinstance(texts, str) else texts)])
    return F.coalesce(*(F.when(reduce(or_, map(has, texts)), meaning) for texts, meaning in rules), other)


def download_error(message: Column) -> Column:
    """What a download's error means; else its first line, named as FFmpeg's if it is."""
    said = F.regexp_replace(F.replace(message, F.lit("ERROR: "), F.lit("")), r"^\s+|\s+$", "")
    first = F.substring_index(F.regexp_replace(said, "\r\n?", "\n"), "\n", 1)
    other = F.when(F.lower(said).contains("ffmpeg"), F.concat(F.lit("FFmpeg reported a problem: "), first)).when(said == "", "Unknown download error.").otherwise(first)
    return explained(said, DOWNLOAD_ERRORS, other)


def is_block(message: Column) -> Column:
    """Whether a site refuses automated traffic."""
    low = F.lower(message)
    return low.rlike("not a bot|http error 429|too many requests") | (low.contains("sign in to confirm") & ~low.contains("your age"))


def postponed(jobs: DataFrame) -> DataFrame:
    """Jobs that failed because a site blocks are queued again; the rest stays as it is."""
    again = (F.col("stage") == "failed") & is_block(F.col("error"))
    return jobs.withColumn("stage", F.when(again, "queued").otherwise(F.col("stage"))).withColumn("progress", F.when(again, 0.0).otherwise(F.col("progress")))


def download_problem(size: Column, duration: Column, expected: Column, has_picture: Column, has_sound: Column) -> Column:
    """Why a finished download can't be played; '' if it can."""
    return (
        F.when(size <= 0, "empty").when(~has_picture, "no picture").when(~has_sound, "no sound")
        .when((expected > 5) & (duration < 0.9 * expected), "too short").otherwise("")
    )


def otsu(histogram: DataFrame) -> DataFrame:
    """One row, ``threshold``: the level (of level, n; 0 to 255) that parts the counts best; 128 for none.

    The levels are few, whatever the picture, so their running sums are one task's.
    """
    w = Window.orderBy("level")
    h = histogram.groupBy("level").agg(F.sum("n").cast("double").alias("n"))
    total, weighted = F.sum("n").over(Window.partitionBy()), F.sum(F.col("level") * F.col("n")).over(Window.partitionBy())
    h = h.withColumn("t", total).withColumn("s", weighted).withColumn("wb", F.sum("n").over(w)).withColumn("sb", F.sum(F.col("level") * F.col("n")).over(w))
    h = h.withColumn("wf", F.col("t") - F.col("wb")).where("wb > 0 and wf > 0")
    between = F.col("wb") * F.col("wf") * F.pow(F.col("sb") / F.col("wb") - (F.col("s") - F.col("sb")) / F.col("wf"), F.lit(2))
    best = h.withColumn("between", between).where("between > 0").orderBy(F.desc("between"), "level").limit(1).agg(F.max("level").alias("threshold"))
    return best.select(F.coalesce("threshold", F.lit(128)).cast("long").alias("threshold"))


def top_share(histogram: DataFrame, k: int = 16) -> DataFrame:
    """One row, ``share``: how much of the counts the k most frequent colours (colour, n) hold."""
    total = histogram.agg(F.sum("n").alias("t"))
    top = histogram.orderBy(F.desc("n"), "colour").limit(k).agg(F.sum("n").alias("s"))
    return top.crossJoin(total).select(F.round(F.coalesce(F.col("s") / F.col("t"), F.lit(0.0)), 9).alias("share"))


def dark_border(pixels: DataFrame, key: str, limit: int = 60) -> DataFrame:
    """``key``, ``dark``: whether more than 0.6 of the border's grey values lie below ``limit``."""
    return pixels.groupBy(key).agg((F.avg((F.col("grey") < limit).cast("double")) > 0.6).alias("dark"))


def grid(rows: DataFrame, columns: int, width: int, height: int, gap: int, *, key: str, order: str) -> DataFrame:
    """With ``x`` and ``y`` of each row of a key, left to right and top to bottom."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    return rows.withColumn("x", (at % columns * (width + gap)).cast("long")).withColumn("y", (F.floor(at / columns) * (height + gap)).cast("long"))


def stage_weights(stages: DataFrame) -> DataFrame:
    """With ``percent`` and ``offset`` of (key, seq, weight), the percents of a key adding up to 100."""
    whole, w = Window.partitionBy("key"), Window.partitionBy("key").orderBy("seq")
    percent = F.col("weight") * 100.0 / F.sum("weight").over(whole)
    return stages.withColumn("percent", percent).withColumn("offset", F.sum("percent").over(w) - F.col("percent"))


def best_quality(tries: DataFrame, target: int) -> DataFrame:
    """``key``, ``quality``, ``reached``: the highest quality whose size is small enough, else the lowest."""
    fits = F.max(F.when(F.col("size") <= target, F.col("quality")))
    out = tries.groupBy("key").agg(fits.alias("fit"), F.min("quality").alias("low"))
    return out.select("key", F.coalesce("fit", "low").alias("quality"), F.col("fit").isNotNull().alias("reached"))


def routes(pairs: DataFrame, via: str = "en") -> DataFrame:
    """``source``, ``target``, ``route`` of languages that (source, target) pairs connect, directly or through one."""
    direct = pairs.select("source", "target").distinct()
    a, b = direct.where(F.col("target") == via).select("source"), direct.where(F.col("source") == via).select("target")
    # languages are a small fixed vocabulary: one row for each that reaches or leaves the bridge
    both = a.crossJoin(b).where("source <> target").join(direct, ["source", "target"], "left_anti")
    said = lambda d, *mid: d.select("source", "target", F.concat_ws(">", "source", *(F.lit(m) for m in mid), "target").alias("route"))
    return said(direct).unionByName(said(both.where((F.col("source") != via) & (F.col("target") != via)), via))


def findings_summary(findings: DataFrame, key: str) -> DataFrame:
    """``key``, ``summary``: up to three distinct labels, sensitive and removable ones first, then how many more."""
    one = findings.groupBy(key, "label").agg(F.max("sensitive").alias("s"), F.max("removed").alias("r"))
    ranked = one.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((~F.col("s")).alias("s"), (~F.col("r")).alias("r"), "label"))).alias("f"))
    names = F.transform("f", lambda x: x["label"])
    more = F.when(F.size(names) > 3, F.concat(F.lit(", "), (F.size(names) - 3).cast("string"), F.lit(" more"))).otherwise("")
    return ranked.select(key, F.concat(F.array_join(F.slice(names, 1, 3), ", "), more).alias("summary"))


def labelled(findings: DataFrame, known: DataFrame, longest: int = 120) -> DataFrame:
    """Findings (key, tag, value) with the label and sensitivity of a small dimension (tag, label, sensitive); unknown tags as 'other'."""
    out = findings.join(known, "tag", "left")
    return out.select("key", F.coalesce("label", F.lit("other")).alias("label"), F.substring("value", 1, longest).alias("value"), F.coalesce("sensitive", F.lit(False)).alias("sensitive"))


def subtitles_for(videos: DataFrame, subtitles: DataFrame) -> DataFrame:
    """The best subtitle of each video (folder, stem): the same stem, else one that begins 'stem.', in its own folder before a sister folder.

    Joined by folder, then by stem: an equi-join on the parent folder and the stem's beginning up to its first point.
    """
    head = lambda c: F.substring_index(c, ".", 1)
    parent = lambda c: F.regexp_replace(c, r"/[^/]*$", "")
    v = videos.select(F.col("folder").alias("vf"), F.col("stem").alias("vs")).withColumn("p", parent(F.col("vf"))).withColumn("h", head(F.col("vs")))
    sides = subtitles.select("folder", "stem").withColumn("p", F.explode(F.array(F.col("folder"), parent(F.col("folder"))))).withColumn("h", head(F.col("stem")))
    own = v.withColumn("p", F.col("vf")).unionByName(v).distinct()
    near = own.join(sides, ["p", "h"]).where((F.col("stem") == F.col("vs")) | F.col("stem").startswith(F.concat(F.col("vs"), F.lit("."))))
    rank = F.row_number().over(Window.partitionBy("vf", "vs").orderBy((F.col("folder") != F.col("vf")).cast("int"), (F.col("stem") != F.col("vs")).cast("int"), "folder", "stem"))
    return near.withColumn("rank", rank).where("rank = 1").select(F.col("vf").alias("folder"), F.col("vs").alias("stem"), F.col("folder").alias("subtitle_folder"), F.col("stem").alias("subtitle"))


def existing_media(wanted: DataFrame, files: DataFrame, videos: list[str]) -> DataFrame:
    """For each wanted stem the file there is (stem, suffix, size > 0): videos first, then the largest."""
    rank = F.row_number().over(Window.partitionBy("stem").orderBy((~F.lower("suffix").isin(videos)).cast("int"), F.desc("size"), "suffix"))
    return wanted.join(files.where("size > 0"), "stem").withColumn("rank", rank).where("rank = 1").drop("rank")


def newest(files: DataFrame, key: str, without: list[str]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("modified"), "name"))
    return files.where(~F.lower("suffix").isin(without)).withColumn("rank", rank).where("rank = 1").drop("rank")


def settings(stored: DataFrame, defaults: DataFrame) -> DataFrame:
    """Each default (name, value) with the stored value where there is one; unknown stored names go."""
    return defaults.join(stored.withColumnRenamed("value", "own"), "name", "left").select("name", F.coalesce("own", "value").alias("value"))


#: Numbers of colours tried one after the other.
COLOUR_LADDER = [256, 192, 128, 96, 64, 48, 32, 24, 16, 8, 4]


def fewest_lost_colours(tries: DataFrame, target: int) -> DataFrame:
    """``key``, ``colours``, ``size``, ``tries``, ``reached`` from sizes by number of colours; 0 stands for all colours.

    All colours, then steps of the ladder from the most colours down, until one is small enough; the last step if none is.
    ``colours`` is null for all colours, ``tries`` counts steps up to the one chosen.
    """
    step = F.when(F.col("colours") == 0, 0).otherwise(F.array_position(F.array(*map(F.lit, COLOUR_LADDER)), F.col("colours")))
    steps = tries.withColumn("step", step).where("colours = 0 or step > 0")
    said = F.struct("step", "colours", "size")
    fit = F.min(F.when(F.col("size") <= target, said))
    out = steps.groupBy("key").agg(fit.alias("fit"), F.max(said).alias("last")).withColumn("one", F.coalesce("fit", "last"))
    return out.select("key", F.nullif("one.colours", F.lit(0)).alias("colours"), F.col("one.size").alias("size"), (F.col("one.step") + 1).alias("tries"), F.col("fit").isNotNull().alias("reached"))


def cell_sizes(pictures: DataFrame, key: str, size: int) -> DataFrame:
    """``key``, ``cell_width``, ``cell_height``: cells with the mean shape of the pictures (width, height), the longer side ``size``."""
    ratio = pictures.groupBy(key).agg(F.avg(F.col("width") / F.col("height")).alias("r"))
    side = lambda x: F.greatest(F.bround(x).cast("int"), F.lit(1))
    wide = F.col("r") >= 1
    return ratio.select(key, F.when(wide, size).otherwise(side(size * F.col("r"))).alias("cell_width"), F.when(wide, side(size / F.col("r"))).otherwise(size).alias("cell_height"))


def in_order(tools: DataFrame) -> DataFrame:
    """Tools that are enabled (null: they are) by ``order``, then by their name in small letters."""
    return tools.where(F.coalesce("enabled", F.lit(True))).orderBy("order", F.lower("name"))


#: What a job starts again with.
FRESH = {"stage": "queued", "progress": 0.0, "message": "", "error": "", "output": "", "output_bytes": 0}


def reset(jobs: DataFrame, which: Column) -> DataFrame:
    """The jobs of ``which`` as if they had never run; their ``info`` is emptied."""
    kinds = {f.name: f.dataType for f in jobs.schema}
    fresh = {c: F.lit(v).cast(kinds[c]) for c, v in FRESH.items()} | {"info": F.create_map().cast(kinds["info"])}
    return jobs.withColumns({c: F.when(which, v).otherwise(F.col(c)) for c, v in fresh.items()})


def snapshots(jobs: DataFrame) -> DataFrame:
    """``id``, ``snapshot``: a job as JSON that ``applied`` reads."""
    return jobs.select("id", F.to_json(F.struct(*(c for c in jobs.columns if c != "id")), {"ignoreNullFields": "true"}).alias("snapshot"))


def applied(jobs: DataFrame, taken: DataFrame) -> DataFrame:
    """The jobs as their snapshots (id, snapshot) say; what a snapshot lacks is fresh, but sizes of sources and destinations stay.

    A job without a snapshot stays as it is. An id has at most one snapshot.
    """
    kinds = {f.name: f.dataType for f in jobs.schema}
    fields = [f for f in jobs.schema if f.name in {*FRESH, "info", "source_bytes", "destination"}]
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    said = taken.select("id", F.from_json("snapshot", shape).alias("_said")).where("_said is not null")
    fresh = lambda c: F.lit(FRESH[c]).cast(kinds[c]) if c in FRESH else F.create_map().cast(kinds[c]) if c == "info" else F.col(c)
    found = F.col("_said").isNotNull()
    there = lambda c: F.nullif(F.col("_said")[c], F.lit("")) if c == "destination" else F.col("_said")[c]
    out = jobs.join(said, "id", "left").withColumns({f.name: F.when(found, F.coalesce(there(f.name), fresh(f.name))).otherwise(F.col(f.name)) for f in fields})
    return out.select(*jobs.columns)


def queue_weight(jobs: DataFrame) -> DataFrame:
    """One row: ``files``, ``bytes`` of the queue."""
    return jobs.agg(F.count("*").alias("files"), F.coalesce(F.sum("source_bytes"), F.lit(0)).alias("bytes"))
