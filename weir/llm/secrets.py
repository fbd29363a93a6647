"""Secret scans (operator 7).

An Aho-Corasick automaton runs once over the text with A-Z in lower case and finds
where a keyword stands; the regular expressions are then matched only there,
anchored at the keyword. Runs of hexadecimal digits have no keyword and are found
by their own expression. Tokens that carry a checksum are kept only if it is right.

A map over slices of bounded size: no shuffle, nothing is broadcast.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: The order of kinds among spans that start at the same place.
KINDS = ("assign", "access", "hex", "github", "npm")
BASE = KINDS[:3]
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
WORDS = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("akia",), "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "npm": ("npm_",)}
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


@functools.cache
def keywords() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for kind, words in WORDS.items():
        for word in words:
            out.add_word(word, (kind, len(word)))
    out.make_automaton()
    return out


def checksum(body: str) -> str:
    """The last six characters of a GitHub or npm token: CRC-32 of the 30 before, in base 62."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, digit = divmod(n, 62)
        out = DIGITS[digit] + out
    return out


def lowered(text: str) -> str:
    """A-Z in lower case; no other character changes, so places stay."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    points[(points >= 65) & (points <= 90)] += 32
    return points.tobytes().decode("utf-32-le", "surrogatepass")


def found(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), for each kind leftmost and without overlaps; not sorted."""
    hits = sorted((end + 1 - n, kind) for end, (kind, n) in keywords().iter(lowered(text)))
    out, after = [], {"assign": 0, "access": 0, "checked": 0}
    for at, kind in hits:
        if kind == "assign":
            if at >= after[kind] and (m := ASSIGN.match(text, at)):
                after[kind] = m.end()  # a match that fails the length still takes its characters
                if m.end(1) - m.start(1) >= 12:
                    out.append((at, m.end(), kind))
        elif kind == "access":
            if at >= after[kind] and (m := ACCESS.match(text, at)):
                after[kind] = m.end()
                if m.end() - at >= 18:
                    out.append((at, m.end(), kind))
        elif at >= after["checked"] and (m := CHECKED.match(text, at)) and checksum(m[1]) == m[2]:
            after["checked"] = m.end()
            out.append((at, m.end(), kind))
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def spans_of(texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """Of each text, sorted by start and kind. One scan: no expression crosses a line feed."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    heads = [0]
    for text in texts:
        heads.append(heads[-1] + len(text) + 1)
    for a, b, kind in found("\n".join(texts)):
        k = bisect.bisect_right(heads, a) - 1
        out[k].append((a - heads[k], b - heads[k], kind))
    for x in out:
        x.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return out


def _said(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def masked(text: str, spans: list[tuple[int, int, str]], mask: str) -> str:
    """Each run of characters that spans cover becomes one ``mask``."""
    out, at = [], 0
    for a, b, _ in sorted(spans):
        if a > at or not out:
            out += [text[at:a], mask] if a >= at else []
        at = max(at, b)
    return "".join([*out, text[at:]])


def _scanned(batches: Iterator[pa.RecordBatch], digests: bool, mask: str) -> Iterator[pa.RecordBatch]:
    for part in shared.sliced(batches, "text"):
        texts = shared.strings(part.column("text")).to_pylist()
        spans = spans_of(texts)
        counts = [pa.array([sum(s[2] == kind for s in x) for x in spans], pa.int64()) for kind in BASE]
        said = pa.array([_said(x) for x in spans], pa.string())
        if digests:
            base = pa.array([hashlib.sha256(_said([s for s in x if s[2] in BASE]).encode()).hexdigest() for x in spans])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *counts, base, said], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])
        else:
            clean = pa.array([masked(t, x, mask) if x else t for t, x in zip(texts, spans, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *counts, said, clean], ["doc_id", "n_assign", "n_access", "n_hex", "spans", "masked"])


def scanned(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, mask: str = "[SECRET]") -> DataFrame:
    """``doc_id``, ``n_assign``, ``n_access``, ``n_hex``, ``spans`` and ``masked`` text (or ``base_sha256``) for each row.

    ``spans``: kind:start:end in code points, end exclusive, by start and then kind,
    joined by commas; besides the base kinds GitHub and npm tokens with a right
    checksum. ``masked``: covered runs replaced by ``mask``. Null text counts as
    empty: no spans. Null and repeated ids are passed on; other columns are ignored.
    """
    out = "doc_id long, n_assign long, n_access long, n_hex long, " + ("base_sha256 string, spans string" if digests else "spans string, masked string")
    return shared.texts(docs, id_col, text_col).mapInArrow(functools.partial(_scanned, digests=digests, mask=mask), out)


def _masked_rows(batches: Iterator[pa.RecordBatch], mask: str) -> Iterator[pa.RecordBatch]:
    for part in shared.sliced(batches, "text"):
        null = part.column("text").is_null().to_pylist()
        texts = shared.strings(part.column("text")).to_pylist()
        new = [None if n else masked(t, x, mask) if x else t for n, t, x in zip(null, texts, spans_of(texts), strict=True)]
        k = part.schema.get_field_index("text")
        yield part.set_column(k, part.schema.field(k).name, pa.array(new, pa.string()))


def without_secrets(docs: DataFrame, *, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with secrets in ``text`` masked, ``n_chars`` (if there) counted anew, all else as it was.

    Null text stays null; rows without a secret stay as they were.
    """
    out = docs.mapInArrow(functools.partial(_masked_rows, mask=mask), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(shared.table(spark, sf_dir, "documents"), digests=True)
