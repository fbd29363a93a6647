"""Sum-of-squares packing (operator 10).

Every task packs the documents of its own partition, in the order it reads them.
A document's whole windows stand alone; what is left over is placed whole, into
the fill level that makes the sum of the squared counts of partly filled windows,
tracked in an array by level, smallest. At the end of a partition the partly filled
ones are joined by cutting: the emptiest fill up the fullest. The one that is left is
cut into windows of powers of two, which need no padding. So padding doesn't grow with
the number of partitions. A task holds the pieces of the open windows only, whose number
the rule keeps small: never more than a partition's ids, 4 bytes each.

A lost task is run again over the same partition and gives the same sequences;
its number is the high part of ``sequence_id``. No shuffle.
"""

from __future__ import annotations

import functools
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from . import shared
from .bpe import CONTRACTIONS, LETTER, NUMBER, SPACE, Memo, byte_chars, code_points, distinct_words, kinds

END = b"\x01\0\0\0"


class WordIds:
    """The ids of texts by the tokenizers library, which is asked once for each word seen lately.

    The library puts a text in NFC and in lower case and splits it by one
    expression; this does the same over many texts at a time and gives the model
    the distinct words.
    """

    def __init__(self, path: str, words: int = 200_000):
        from tokenizers import Tokenizer

        tool = Tokenizer.from_file(path)
        self.model = tool.model
        self.special = {str(t.content): np.uint32(k).astype("<u4").tobytes() for k, t in tool.get_added_tokens_decoder().items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.memo = Memo(words)
        self.char = {b: c for c, b in byte_chars().items()}

    def word(self, word: str) -> bytes:
        held = self.memo.get(word)
        if held is None:
            char = self.char
            ids = [t.id for t in self.model.tokenize("".join([char[b] for b in word.encode("utf-8")]))]
            held = np.array(ids, "<u4").tobytes()
            self.memo.put(word, held)
        return held

    def ids(self, texts: list[str]) -> list[bytes]:
        """Of each text, as little-endian unsigned 32-bit numbers."""
        parts, owner = [], []
        for k, text in enumerate(texts):
            pieces = self.split.split(text) if self.split is not None and any(s in text for s in self.special) else [text]
            for q, piece in enumerate(pieces):
                if not q % 2:
                    if not piece.isascii() and not unicodedata.is_normalized("NFC", piece):
                        piece = unicodedata.normalize("NFC", piece)
                    piece = piece.replace("Σ", "σ").lower()  # no final sigma: the library lowers character by character
                parts.append((piece, q % 2))
                owner.append(k)
        plain = [p for p, special in parts if not special]
        whole = "".join(plain)
        points = code_points(whole)
        sizes = np.array([len(p) for p in plain])
        heads = np.concatenate([[0], np.cumsum(sizes)])
        start, end = self.words(points, heads)
        first, inverse = distinct_words(points, start, end)
        held = [self.word(whole[a:b]) for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        said = list(map(held.__getitem__, inverse.tolist()))
        cut = np.searchsorted(start, heads)
        out: list[list[bytes]] = [[] for _ in texts]
        k = 0
        for (piece, special), text in zip(parts, owner, strict=True):
            if special:
                out[text].append(self.special[piece])
            else:
                out[text] += said[cut[k] : cut[k + 1]]
                k += 1
        return [b"".join(x) for x in out]

    @staticmethod
    def words(points: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Contractions, runs of letters, single numbers and runs of others; white space goes."""
        n = len(points)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        kind = kinds()[points]
        edge = np.zeros(n + 1, bool)
        edge[heads] = True
        edge[n] = True
        head = edge.copy()
        edge[1:n] |= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        mark = np.flatnonzero((points == 0x27) & edge[:n])
        mark = mark[mark + 1 < n]
        mark = mark[(kind[mark + 1] == LETTER) & ~head[mark + 1]]
        for p in mark.tolist():
            for tail in CONTRACTIONS:
                stop = p + 1 + len(tail)
                if stop <= n and not head[p + 2 : stop].any() and all(points[p + 1 + k] == ord(c) for k, c in enumerate(tail)):
                    edge[p + 1] = False
                    edge[stop] = True
                    break
        bounds = np.flatnonzero(edge)
        start, end = bounds[:-1], bounds[1:]
        word = kind[start] != SPACE
        return start[word], end[word]


@functools.cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)


class Packer:
    """The windows of one partition. A piece: (doc_id, start, ids, tokens of the document)."""

    def __init__(self, window: int, first: int):
        self.window, self.next = window, first
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[list[list[tuple]]] = [[] for _ in range(window)]
        self.rows: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, zlib.crc32(ids), total, self.next, offset))
            offset += n
        self.next += 1

    def add(self, doc_id: int | None, ids: bytes) -> None:
        w, total = self.window, len(ids) // 4
        whole = total // w * w
        for at in range(0, whole, w):
            self.emit([(doc_id, at, ids[at * 4 : (at + w) * 4], total)])
        size = total - whole
        if size:
            self.place((doc_id, whole, ids[whole * 4 :], total), size)

    def place(self, piece: tuple, size: int) -> None:
        w, count = self.window, self.count
        # by how much the sum of squares changes if the piece goes to level h: 0 is a new window, window - size fills one
        change = 2 * (count[size : w + 1] - count[: w - size + 1]) + 2
        change[0] = 2 * count[size] + 1
        change[w - size] = 1 - 2 * count[w - size]
        change[1:][count[1 : w - size + 1] == 0] = 1 << 60
        level = w - size - int(np.argmin(change[::-1]))  # of equals the fullest
        if level:
            held = self.open[level].pop()
            count[level] -= 1
        else:
            held = []
        held.append(piece)
        if level + size == w:
            self.emit(held)
        else:
            self.open[level + size].append(held)
            count[level + size] += 1

    def drain(self) -> None:
        """Join the partly filled windows by cutting the emptiest; the one that is left is cut into powers of two."""
        w = self.window
        held = [(level, x) for level in range(w - 1, 0, -1) for x in self.open[level]]
        self.open = [[] for _ in range(w)]
        self.count[:] = 0
        lo, hi = 0, len(held) - 1
        while lo < hi:
            level, pieces = held[lo]
            pieces = list(pieces)
            while level < w and lo < hi:
                other, source = held[hi]
                doc_id, start, ids, total = source[-1]
                n = min(len(ids) // 4, w - level)
                cut = len(ids) - 4 * n
                pieces.append((doc_id, start + cut // 4, ids[cut:], total))
                source = source[:-1] + ([(doc_id, start, ids[:cut], total)] if cut else [])
                level, other = level + n, other - n
                held[hi] = (other, source)
                if not other:
                    hi -= 1
            held[lo] = (level, pieces)
            if level == w:
                self.emit(pieces)
                lo += 1
        if lo == hi:
            level, pieces = held[lo]
            bit = 1 << (w.bit_length() - 1)
            while level:
                if bit > level:
                    bit >>= 1
                    continue
                now, need = [], bit
                while need:
                    doc_id, start, ids, total = pieces[0]
                    n = min(len(ids) // 4, need)
                    now.append((doc_id, start, ids[: 4 * n], total))
                    pieces = [(doc_id, start + n, ids[4 * n :], total)] * (len(ids) > 4 * n) + pieces[1:]
                    need -= n
                self.emit(now)
                level -= bit

    def taken(self) -> list[tuple]:
        out, self.rows = self.rows, []
        return out


def _schema() -> pa.Schema:
    return pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def _packed(batches: Iterator[pa.RecordBatch], path: str, window: int) -> Iterator[pa.RecordBatch]:
    tool, context = word_ids(path), TaskContext.get()
    packer = Packer(window, (context.partitionId() if context else 0) << 40)
    schema = _schema()

    def rows() -> pa.RecordBatch:
        columns = list(zip(*packer.taken(), strict=True)) or [[]] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    # larger slices: a word is looked up once a slice
    for part in shared.sliced(batches, "text", 2 * shared.SLICE_BYTES):
        for doc_id, ids in zip(part.column("doc_id").to_pylist(), tool.ids(shared.strings(part.column("text")).to_pylist()), strict=True):
            packer.add(doc_id, ids + END)
        yield rows()
    packer.drain()
    yield rows()


def packed(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", window: int = 2048) -> DataFrame:
    """A row for each piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    A document's ids end with id 1; null or empty text has that one only. Each id
    lies in exactly one piece; the pieces of a sequence follow each other from
    offset 0 up to ``window`` (a power of two) ids, or to a smaller power of two.
    Null and repeated ids are passed on: each row is a document of its own. Other
    columns are ignored; an empty table gives no rows.
    """
    if window < 2 or window & (window - 1):
        raise ValueError("window must be a power of two")
    return shared.texts(docs, id_col, text_col).mapInArrow(functools.partial(_packed, path=vocabulary, window=window), ", ".join(f"{f.name} long" for f in _schema()))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(shared.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
