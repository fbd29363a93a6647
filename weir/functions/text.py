"""Column functions over text. Null in, null out unless said otherwise."""

from __future__ import annotations

import html
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What clean-up deletes, and what straight quotes replace, one for one.
INVISIBLE = "​‌‍⁠﻿­"
QUOTES, STRAIGHT = "“”„‘’«»–—", "\"\"\"''\"\"--"
SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"
LETTER = r"[\p{L}\p{Nl}\p{No}]"
#: Words that say nothing about the subject.
STOP_WORDS = """
a an the and or but if then else of to in on at by for with from as is are was were be been being
it its this that these those there here i you he she we they me him her us them my your his our their
not no yes so do does did done have has had will would can could should may might must shall about
into over under than too very just also more most such only own same other some any each few all
il lo la i gli le un uno una di da in con su per tra fra e ed o ma se che chi cui non si ci vi ne
del dello della dei degli delle al allo alla ai agli alle dal dallo dalla dai dagli dalle nel nello
nella nei negli nelle sul sullo sulla sui sugli sulle è sono era erano essere stato stata ho hai ha
abbiamo avete hanno anche come più molto questo questa questi queste quello quella quelli quelle
el los las uno unos unas de del y o pero que en con por para es son fue como más muy este esta
le les des du et ou mais qui que dans avec pour par est sont été comme plus très ce cette ces
der die das ein eine und oder aber wer was in mit für von ist sind war wie mehr sehr dieser diese
""".split()


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(F.regexp_replace(_col(c), f"^{SPACE}+", ""), f"{SPACE}+$", "")


def casefold(c: Column | str) -> Column:
    """Lower case, with ß as ss."""
    return F.replace(F.lower(_col(c)), F.lit("ß"), F.lit("ss"))


def collapse(c: Column | str) -> Column:
    """Every run of white space as one space, none at the ends. Single spaces, so most of what lies between words, are not replaced."""
    return F.trim(F.regexp_replace(_col(c), rf" {SPACE}+|[\t-\r\x1c-\x1f\x85\p{{Z}}&&[^ ]]{SPACE}*", " "))


@F.pandas_udf(StringType())
def nfc(c: pd.Series) -> pd.Series:
    """Unicode normal form C."""
    import unicodedata

    return c.map(lambda x: None if x is None else x if x.isascii() else unicodedata.normalize("NFC", x))


def without_invisible(c: Column | str) -> Column:
    return F.translate(_col(c), INVISIBLE, "")


def plain_newlines(c: Column | str) -> Column:
    """CRLF and CR as LF, a tab as four spaces."""
    c = F.replace(F.replace(_col(c), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.replace(c, F.lit("\t"), F.lit("    "))


def straight_quotes(c: Column | str) -> Column:
    return F.replace(F.translate(_col(c), QUOTES, STRAIGHT), F.lit("…"), F.lit("..."))


def tidy_line(c: Column | str) -> Column:
    """Runs of two or more spaces as one, none at the ends."""
    return strip(F.regexp_replace(_col(c), "[  ]{2,}", " "))


def sentences(c: Column | str, openers: str = "\"'«“(") -> Column:
    """Array of sentences: cut at white space behind . ! ? … and before a capital or digit, maybe behind an opening mark."""
    marked = F.regexp_replace(collapse(c), rf"([.!?…]) +([{openers}]?[A-ZÀ-ÖØ-Þ0-9])".replace("[\"'«([]", r"[\"'«(\[]"), "$1\u0001$2")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.trim(s)), lambda s: F.length(s) > 0)  # no white space but spaces is left


def words(c: Column | str) -> Column:
    """Array of the words of three letters or more, in lower case."""
    return F.transform(F.regexp_extract_all(_col(c), F.lit(f"({LETTER}{{3,}})"), 1), F.lower)


def word_count(c: Column | str) -> Column:
    return F.regexp_count(_col(c), F.lit(r"[\p{L}\p{N}_]+"))


#: Bytes of text that are looked at together.
_CHUNK = 1 << 20


def _pairs_told(pieces: list[str]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Codes of texts (their bytes, and where each begins and the last one ends): of ``pieces`` of two ASCII characters, all counted in one pass."""
    single = sorted({ord(x) for piece in pieces for x in piece})
    of = np.zeros(256, np.uint16)
    of[single] = np.arange(1, len(single) + 1)
    wide = len(single) + 1
    kind = np.full(wide * wide, 64, np.uint8)
    for k, piece in enumerate(pieces):
        if piece:
            kind[of[ord(piece[0])] * wide + of[ord(piece[1])]] = k
    twins = [k for k, piece in enumerate(pieces) if piece and piece[0] == piece[1]]

    def told(data: np.ndarray, at: np.ndarray) -> np.ndarray:
        low = of[data]
        said = np.append(kind[low[:-1] * wide + low[1:]], np.uint8(64)) if len(data) else np.empty(0, np.uint8)
        said[at[1:][at[1:] > 0] - 1] = 64  # what begins at a text's last byte goes on in the next text
        for k in twins:  # of a run of one character every other pair counts
            met = np.flatnonzero(said == k)
            first = np.maximum.accumulate(np.where(np.diff(met, prepend=-2) > 1, met, 0))
            said[met[(met - first) % 2 == 1]] = 64
        met = np.flatnonzero(said < 64)
        text = np.repeat(np.arange(len(at) - 1), np.diff(np.searchsorted(met, at)))
        odd = np.bincount(text * 64 + said[met], minlength=64 * (len(at) - 1)).astype(np.uint64).reshape(-1, 64) & np.uint64(1)
        return np.bitwise_or.reduce(odd << np.arange(64, dtype=np.uint64), axis=1)

    return told


def odd_counts(c: Column | str, pieces: list[str]) -> Column:
    """A 64-bit code: bit k says whether the text has piece k (one that has passed isn't counted again) an odd number of times.

    Pieces of two ASCII characters are told from the bytes in one pass; others are counted one by one.
    """
    slow = [k for k, piece in enumerate(pieces) if len(piece) != 2 or not piece.isascii() or piece in pieces[:k]]
    told = _pairs_told(["" if k in slow else piece for k, piece in enumerate(pieces)])

    @F.arrow_udf("long")
    def code(texts: pa.Array) -> pa.Array:
        held = texts.cast(pa.large_binary())
        at = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1] if len(held) else np.zeros(1, np.int64)
        data = np.frombuffer(held.buffers()[2] or b"", np.uint8)
        out = np.zeros(len(held), np.uint64)
        x = 0
        while x < len(held):
            y = max(int(np.searchsorted(at, at[x] + _CHUNK, "right")) - 1, x + 1)
            out[x:y] = told(data[at[x] : at[y]], at[x : y + 1] - at[x])
            x = y
        for n, text in enumerate(texts.to_pylist() if slow else []):
            if text is not None:
                out[n] |= np.uint64(sum((text.count(pieces[k]) & 1) << k for k in slow))
        return pa.array(out.view(np.int64), mask=texts.is_null().to_numpy(zero_copy_only=False))

    return code(_col(c))


def text_stats(c: Column | str) -> Column:
    """'1.234 words. 6 min read' at 220 words a minute; every comma becomes a point, the separating one too."""
    n = word_count(c)
    minutes = F.greatest(F.lit(1), F.bround(n / 220, 0).cast("int"))
    return F.replace(F.concat(F.format_number(n, 0), F.lit(" words, "), minutes.cast("string"), F.lit(" min read")), F.lit(","), F.lit("."))


@F.pandas_udf(StringType())
def unescape(c: pd.Series) -> pd.Series:
    """Character references as the characters."""
    return c.map(lambda x: None if x is None else html.unescape(x) if "&" in x else x)


def html_to_text(c: Column | str) -> Column:
    """Without scripts, styles and tags; ends of blocks are line feeds; references last."""
    c = F.regexp_replace(_col(c), r"(?is)<script.*?</script>", "")
    c = F.regexp_replace(c, r"(?is)<style.*?</style>", "")
    c = F.regexp_replace(c, r"(?i)<br\s*/?>|</p>|</h[0-9]>|</li>|</div>", "\n")
    return unescape(F.regexp_replace(c, r"<[^>]+>", ""))


def escape(c: Column | str) -> Column:
    """& < > " ' as references."""
    c = _col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def urls(c: Column | str) -> Column:
    """Ordered distinct web addresses, without punctuation behind them."""
    found = F.regexp_extract_all(_col(c), F.lit(r"((?i:https?)://[^\s<>\"']+)"), 1)
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;)\]}\"']+$", "")))


def paragraphs(c: Column | str) -> Column:
    """Array of blocks between blank lines, the lines of each joined by spaces."""
    parts = F.split(strip(c), r"\n\s*\n")
    return F.filter(F.transform(parts, lambda p: strip(F.regexp_replace(p, r"\s*\n\s*", " "))), lambda p: F.length(p) > 0)


def rendered(c: Column | str, title: Column, fmt: str) -> Column:
    """Text as txt, md or html (one <p> a block, title as heading)."""
    blocks = F.filter(F.split(strip(c), "\n\n"), lambda p: F.length(strip(p)) > 0)
    if fmt == "md":
        return F.concat(F.lit("# "), title, F.lit("\n\n"), F.array_join(blocks, "\n\n"), F.lit("\n"))
    if fmt == "html":
        body = F.array_join(F.transform(blocks, lambda p: F.concat(F.lit("<p>"), F.replace(escape(p), F.lit("\n"), F.lit("<br>\n")), F.lit("</p>"))), "\n")
        return F.concat(F.lit("<h1>"), escape(title), F.lit("</h1>\n"), body, F.lit("\n"))
    if fmt != "txt":
        raise ValueError(f"unknown format {fmt!r}")
    return F.concat(F.array_join(blocks, "\n\n"), F.lit("\n"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used in lambdas."""
    return F.get(F.transform(F.array(value), use), 0)


#: A text below this many characters that ends a sentence is a heading of its own.
_HEADING = 40
_ITEM, _LOWER = r"^([-*•]|[0-9]+[.)])\s", r"^\p{Ll}"


def joined_lines(lines: Column) -> Column:
    """Broken lines joined, list items and lines behind a colon kept apart, a cut word put together. Lines aren't empty.

    What stands between two lines follows from these two, but for a short beginning,
    which is looked at alone, and for a dash that is a line of its own, which needs the
    decision before it. So the text is put together once.
    """

    def begun(a: Column, line: Column) -> Column:
        """A short text as it grows, and how many lines were joined while it was short."""
        out = a["out"]
        apart = line.rlike(_ITEM) | out.endswith(":") | out.rlike("[.!?]$")
        gone = out.endswith("-") & ~out.endswith(" -") & line.rlike(_LOWER)
        now = F.when(out == "", line).when(apart, F.concat(out, F.lit("\n"), line)).when(gone, F.concat(F.substring(out, F.lit(1), F.length(out) - 1), line)).otherwise(F.concat(out, F.lit(" "), line))
        return F.when(F.length(out) >= _HEADING, a).otherwise(F.struct(now.alias("out"), (a["n"] + (F.length(now) < _HEADING).cast("int")).alias("n")))

    # a line adds a character at least, but for one in two that completes a word
    short = F.aggregate(F.slice(lines, 1, 2 * _HEADING), F.struct(F.lit("").alias("out"), F.lit(0).alias("n")), begun)["n"]

    def put(x: Column, few: Column) -> Column:
        before = lambda i: F.get(x, i - 1)
        apart = F.transform(x, lambda line, i: (i > 0) & (line.rlike(_ITEM) | before(i).endswith(":") | ((i <= few) & before(i).rlike("[.!?]$"))))

        def cut(ap: Column) -> Column:
            spaced = lambda i: before(i).endswith(" -") | ((before(i) == "-") & (i > 1) & ~F.get(ap, i - 1))
            return F.transform(x, lambda line, i: (i > 0) & ~F.get(ap, i) & before(i).endswith("-") & ~spaced(i) & line.rlike(_LOWER))

        def text(ap: Column, gone: Column) -> Column:
            mark = lambda i: F.when(i == 0, "").when(F.get(ap, i), "\n").when(F.get(gone, i), "").otherwise(" ")
            own = lambda line, i: F.when(F.coalesce(F.get(gone, i + 1), F.lit(False)), F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line)
            return F.array_join(F.transform(x, lambda line, i: F.concat(mark(i), own(line, i))), "")

        return bound(apart, lambda ap: bound(cut(ap), lambda gone: text(ap, gone)))

    return bound(lines, lambda x: bound(short, lambda few: put(x, few)))


def clean(c: Column | str, *, quotes: bool = True, join_broken: bool = True, unique_lines: bool = False) -> Column:
    """The whole clean-up of one text: characters, spaces, paragraphs; ends in one line feed."""
    c = plain_newlines(without_invisible(nfc(_col(c))))
    if quotes:
        c = straight_quotes(c)
    lines = F.transform(F.split(c, "\n"), tidy_line)
    if unique_lines:
        lines = first_lines(lines)
    blocks = F.split(F.regexp_replace(F.array_join(lines, "\n"), r"\n{2,}", "\u0001"), "\u0001")
    blocks = F.filter(F.transform(blocks, lambda b: F.filter(F.split(b, "\n"), lambda x: x != "")), lambda b: F.size(b) > 0)
    done = F.transform(blocks, joined_lines if join_broken else lambda b: F.array_join(b, "\n"))
    return F.concat(strip(F.array_join(done, "\n\n")), F.lit("\n"))


def first_lines(lines: Column) -> Column:
    """Lines without those that stood before, whatever their case; blank lines all stay."""
    none = F.array().cast("array<string>")

    def step(a: Column, x: Column) -> Column:
        again = (x != "") & F.array_contains(a["seen"], casefold(x))
        return F.struct(F.when(again, a["seen"]).otherwise(F.array_append(a["seen"], casefold(x))).alias("seen"), F.when(again, a["kept"]).otherwise(F.array_append(a["kept"], x)).alias("kept"))

    return F.aggregate(lines, F.struct(none.alias("seen"), none.alias("kept")), step, lambda a: a["kept"])


def subtitles_to_text(c: Column | str) -> Column:
    """SRT or VTT as paragraphs of five sentences, without numbers, times and tags."""
    lines = F.transform(F.split(plain_newlines(c), "\n"), strip)
    time = r"^\d{1,2}:\d{2}(:\d{2})?[.,]\d{1,3}\s*-->\s*\d{1,2}:\d{2}(:\d{2})?[.,]\d{1,3}.*$"
    said = F.filter(lines, lambda x: (x != "") & ~F.upper(x).startswith("WEBVTT") & ~x.rlike(r"^\p{Nd}+$") & ~x.rlike(time) & ~x.rlike("^(NOTE |STYLE|REGION)"))
    spoken = sentences(F.array_join(F.filter(F.transform(said, lambda x: F.regexp_replace(x, "<[^>]+>", "")), lambda x: x != ""), " "))
    starts = F.when(F.size(spoken) > 0, F.sequence(F.lit(0), F.size(spoken) - 1, F.lit(5))).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(starts, lambda i: F.array_join(F.slice(spoken, i + 1, 5), " ")), "\n\n")
