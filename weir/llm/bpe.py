"""BPE encoding and decoding (operator 2).

A merge list is compiled into a deterministic automaton over token labels. It
starts as one state with a loop for every byte, which accepts any byte string.
The gadget for a merge (u, v) -> w then, in the order of the list, splits the
state entered by u off from the states that other labels enter, takes the arc v
out of it, and adds an arc w around it wherever u and then v could be walked. What
the finished automaton accepts are the merge list's tokenizations and nothing
else, one for each byte string. Copies that a split would make of arc tables
aren't written out: a state holds the state it was split from and the rank of the
split, and an arc is looked up along that line (and kept in a table). The state
after a label is thus numbered by the label, and w shares v's until it is split.

Encoding reads the bytes of a pre-split word through the transition table of the
labels' trie: from each place of the word, the labels that start there and are arcs
from the state reached there lead on. Each place is reached by exactly one label,
the last of its prefix's tokenization, so the path back from the end is the
encoding. Decoding emits the bytes of the arc labels.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from . import shared

NEVER = 1 << 60
#: Words of more bytes are encoded one by one, by the same walk: only how many words go through the tables at a time differs.
SHORT = 48


@functools.cache
def byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(c): b for c, b in [*((b, b) for b in plain), *((256 + k, b) for k, b in enumerate(rest))]}


class MergeAutomaton:
    def __init__(self, vocabulary: dict[str, int], merges: Iterable[tuple[str, str]]):
        code = byte_chars()
        self.bytes = {label: bytes(code[c] for c in name) for name, label in vocabulary.items() if all(c in code for c in name)}
        self.born = {label: -1 for name, label in vocabulary.items() if name in code}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.gone: dict[int, int] = {}
        self.arcs: dict[int, bool] = {}
        for rank, (u, v) in enumerate(merges):
            self._gadget(rank, vocabulary[u], vocabulary[v], vocabulary[u + v])
        self.arcs.clear()
        self._table()
        self._arrays()

    def _gadget(self, rank: int, u: int, v: int, w: int) -> None:
        if u not in self.born or v not in self.born or w in self.born or not self.arc(u, v):
            return
        self.gone[(u << 32) | v] = rank
        self.arcs.pop((u << 32) | v, None)
        self.born[w], self.left[w], self.right[w] = rank, u, v

    def arc(self, x: int, y: int) -> bool:
        """Whether the state after ``x`` has the arc ``y``.

        The state after x was, before x was born, the state after x's right part,
        and so on; the arc y stands, before y was born, for an arc y's left part. The
        pair of these lines is walked in the order of the ranks: y is no arc if at
        any time the pair that then held was taken out.
        """
        key = (x << 32) | y
        held = self.arcs.get(key)
        if held is None:
            born, gone = self.born, self.gone
            state, label = [x], [y]
            while state[-1] in self.right:
                state.append(self.right[state[-1]])
            while label[-1] in self.left:
                label.append(self.left[label[-1]])
            i, j, held = len(state) - 1, len(label) - 1, True
            while True:
                split = born[state[i - 1]] if i else NEVER
                grown = born[label[j - 1]] if j else NEVER
                rank = gone.get((state[i] << 32) | label[j], NEVER)
                # of two merges by one rule the one further left comes first
                if rank < NEVER and rank < split and rank <= grown:
                    held = False
                    break
                if not i and not j:
                    break
                then = min(split, grown)
                i -= split == then
                j -= grown == then
            if len(self.arcs) > 400_000:
                self.arcs.clear()
            self.arcs[key] = held
        return held

    def _table(self) -> None:
        """The trie of the labels' bytes as transitions (node * 256 + byte -> node) and the label that ends at each node."""
        self.step: dict[int, int] = {}
        self.ends = [-1]
        for label in self.born:
            node = 0
            for b in self.bytes[label]:
                key = node << 8 | b
                node = self.step.get(key, 0)
                if not node:
                    node = self.step[key] = len(self.ends)
                    self.ends.append(-1)
            self.ends[node] = label

    def _arrays(self) -> None:
        """The trie as a dense table over inner nodes (1 is the root, 0 is dead, leaves come last), and a cache of arcs."""
        inner = sorted({key >> 8 for key in self.step})
        leaves = sorted(set(range(len(self.ends))) - set(inner))
        number = {node: k + 1 for k, node in enumerate([*inner, *leaves])}
        self.inner = len(inner)
        self.table = np.zeros((self.inner + 1, 256), np.int32)
        for key, node in self.step.items():
            self.table[number[key >> 8], key & 255] = number[node]
        self.end_of = np.full(len(number) + 1, -1, np.int32)
        for node, k in number.items():
            self.end_of[k] = self.ends[node]
        self.size_of = np.zeros(max(self.bytes) + 1, np.int32)
        for label, b in self.bytes.items():
            self.size_of[label] = len(b)
        self.slots = np.full(1 << 20, -1, np.int64)
        self.found = np.zeros(1 << 20, bool)

    def are_arcs(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """``arc`` of many pairs: those not in the cache are looked up once each."""
        pairs = (x.astype(np.int64) << 32) | y
        slot = (shared.mix(pairs.view(np.uint64)) >> np.uint64(44)).astype(np.int64)
        out = self.found[slot]
        miss = np.flatnonzero(self.slots[slot] != pairs)
        if len(miss):
            new, back = np.unique(pairs[miss], return_inverse=True)
            held = np.array([self.arc(p >> 32, p & 0xFFFFFFFF) for p in new.tolist()])
            out[miss] = held[back]
            self.slots[slot[miss]] = pairs[miss]
            self.found[slot[miss]] = held[back]
        return out

    def encode_many(self, words: list[bytes]) -> list[list[int]]:
        """``encode`` of many short words, all a place at a time through the tables."""
        sizes = np.array([len(w) for w in words])
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        data = np.frombuffer(b"".join([words[k] for k in order.tolist()]), np.uint8)
        width = int(sizes[0])
        at = np.cumsum(sizes) - sizes
        text = np.zeros((len(words), width), np.uint8)
        row = np.repeat(np.arange(len(words)), sizes)
        text[row, np.arange(len(data)) - at[row]] = data
        last = np.full((len(words), width + 1), -1, np.int32)
        for start in range(width):
            m = int(np.searchsorted(-sizes, -start, side="left"))  # words longer than start
            rows, node, here = np.arange(m), self.table[1, text[:m, start]], start
            while True:
                live = node > 0
                rows, node = rows[live], node[live]
                if not len(rows):
                    break
                label = self.end_of[node]
                ends = np.flatnonzero((label >= 0) & (last[rows, here + 1] < 0))
                if len(ends):
                    mine, label = rows[ends], label[ends]
                    if start:
                        good = self.are_arcs(last[mine, start], label)
                        mine, label = mine[good], label[good]
                    last[mine, here + 1] = label
                here += 1
                on = (sizes[rows] > here) & (node <= self.inner)
                rows, node = rows[on], node[on]
                if not len(rows):
                    break
                node = self.table[node, text[rows, here]]
        # back from the ends
        columns, left, every = [], sizes.copy(), np.arange(len(words))
        while left.any():
            label = np.where(left > 0, last[every, left], -1)
            columns.append(label)
            left = left - np.where(label >= 0, self.size_of[label], 0)
        out: list[list[int]] = [[]] * len(words)
        for k, labels in zip(order.tolist(), np.stack(columns[::-1], 1).tolist(), strict=True):
            out[k] = [x for x in labels if x >= 0]
        return out

    def encode(self, word: bytes) -> list[int]:
        """The labels of the one path of arcs that spells ``word``."""
        n = len(word)
        step, ends, arcs, arc = self.step, self.ends, self.arcs, self.arc
        last = [-1] * (n + 1)
        for start in range(n):
            before, node = last[start] << 32, 0
            for at in range(start, n):
                node = step.get(node << 8 | word[at])
                if node is None:
                    break
                label = ends[node]
                if label >= 0 and last[at + 1] < 0:
                    if start:
                        held = arcs.get(before | label)
                        if held is None:
                            held = arc(before >> 32, label)
                        if not held:
                            continue
                    last[at + 1] = label
        out = []
        while n:
            out.append(last[n])
            n -= len(self.bytes[last[n]])
        return out[::-1]


def white_space() -> list[int]:
    return [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3


@functools.cache
def kinds() -> np.ndarray:
    """For each code point: white space, letter, number or other."""
    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, of in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(of, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            out[a : b + 1] = kind
    out[white_space()] = SPACE
    out[0xD800:0xE000] = OTHER
    return out


CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def token_starts(points: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Where the pre-split words of texts laid end to end start.

    The rule: a contraction; else an optional space and a run of letters, of numbers
    or of others; white space before a word stays apart from its last character.
    ``heads``: where each text that isn't empty starts.
    """
    n = len(points)
    kind = kinds()[points]
    head = np.zeros(n + 1, bool)
    head[heads] = True
    head[n] = True
    run = head[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    blank = points == 0x20
    after_blank = np.zeros(n, bool)
    after_blank[1:] = blank[:-1]
    after_blank &= ~head[:n]
    out = run & (space | ~after_blank)
    # the last character of white space before a word
    edge = np.zeros(n, bool)
    edge[:-1] = space[:-1] & ~space[1:]
    edge &= ~head[1:]
    out |= edge
    mark = np.flatnonzero((points == 0x27) & out)
    mark = mark[mark + 1 < n]
    mark = mark[(kind[mark + 1] == LETTER) & ~head[mark + 1]]
    for p in mark.tolist():
        for tail in CONTRACTIONS:
            stop = p + 1 + len(tail)
            if stop <= n and not head[p + 2 : stop].any() and all(points[p + 1 + k] == ord(c) for k, c in enumerate(tail)):
                out[p + 1] = False
                if stop < n:
                    out[stop] = True
                break
    return out


class Memo:
    """Two generations of a dict: what neither the last nor this one asked for goes."""

    def __init__(self, most: int):
        self.young: dict = {}
        self.old: dict = {}
        self.most = most

    def get(self, key):
        held = self.young.get(key)
        if held is None:
            held = self.old.get(key)
            if held is not None:
                self.put(key, held)
        return held

    def put(self, key, value) -> None:
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young[key] = value


def distinct_words(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the first place of each distinct word, for each word the number of its like)."""
    _, first, inverse = np.unique(shared.span_hashes(points, start, end), return_index=True, return_inverse=True)
    return first, inverse


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Codec:
    """One for a worker: the compiled automaton and what it has encoded lately."""

    def __init__(self, path: str, words: int = 120_000):
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        self.automaton = MergeAutomaton(held["model"]["vocab"], (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in held["model"]["merges"]))
        self.special = {x["content"]: x["id"] for x in held["added_tokens"]}
        self.memo = Memo(words)
        self.emit = {str(k): v for k, v in self.automaton.bytes.items()} | {str(v): k.encode() for k, v in self.special.items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def pieces(self, text: str) -> list[str]:
        """Alternately ordinary text and a special token."""
        if self.split is None or not any(s in text for s in self.special):
            return [text]
        return self.split.split(text)

    def words(self, words: list[str]) -> list[str]:
        """The decimal ids of each word, joined by commas; those not encoded lately all at once."""
        out = [self.memo.get(w) for w in words]
        new = [k for k, held in enumerate(out) if held is None]
        data = [words[k].encode("utf-8") for k in new]
        short = [k for k, b in enumerate(data) if len(b) <= SHORT]
        ids = dict(zip(short, self.automaton.encode_many([data[k] for k in short]), strict=True)) if short else {}
        for j, k in enumerate(new):
            out[k] = ",".join(map(str, ids[j] if j in ids else self.automaton.encode(data[j])))
            self.memo.put(words[k], out[k])
        return out

    def encode(self, texts: list[str]) -> list[str]:
        """The decimal ids of each text, joined by commas."""
        parts, owner = [], []
        for k, text in enumerate(texts):
            for q, piece in enumerate(self.pieces(text)):
                parts.append((piece, q % 2))
                owner.append(k)
        plain = [p for p, special in parts if not special]
        whole = "".join(plain)
        points = code_points(whole)
        sizes = np.array([len(p) for p in plain])
        heads = np.concatenate([[0], np.cumsum(sizes)])
        start = np.flatnonzero(token_starts(points, heads[:-1][sizes > 0])) if len(points) else np.zeros(0, np.int64)
        end = np.append(start[1:], len(points)) if len(start) else start
        first, inverse = distinct_words(points, start, end)
        ids = self.words([whole[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)])
        said = list(map(ids.__getitem__, inverse.tolist()))
        cut = np.searchsorted(start, heads)
        out: list[list[str]] = [[] for _ in texts]
        k = 0
        for (piece, special), text in zip(parts, owner, strict=True):
            if special:
                out[text].append(str(self.special[piece]))
            else:
                out[text] += said[cut[k] : cut[k + 1]]
                k += 1
        return [",".join(x) for x in out]

    def decode(self, ids: str) -> str:
        """Emit the arc labels; bytes that aren't UTF-8 become U+FFFD."""
        if not ids:
            return ""
        return b"".join(map(self.emit.__getitem__, ids.split(","))).decode("utf-8", "replace")


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


def _coded(batches: Iterator[pa.RecordBatch], path: str, keep: bool) -> Iterator[pa.RecordBatch]:
    tool = codec(path)
    for part in shared.sliced(batches, "text"):
        texts = shared.strings(part.column("text")).to_pylist()
        ids = tool.encode(texts)
        back = [tool.decode(x) for x in ids]
        counts = pa.array([x.count(",") + 1 if x else 0 for x in ids], pa.int64())
        more = [pa.array([[int(i) for i in x.split(",")] if x else [] for x in ids], pa.list_(pa.int32())), pa.array(back)] if keep else [pa.array([hashlib.sha256(x.encode()).hexdigest() for x in y]) for y in (ids, back)]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), counts, *more], ["doc_id", "n_tokens", *(["ids", "decoded"] if keep else ["ids_sha256", "decoded_sha256"])])


def encoded(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` and ``decoded`` (or the SHA-256 of either) for each row.

    ``vocabulary``: path of a byte-level vocabulary file that every executor can
    read. Special tokens in a text are single ids. Null text counts as empty: no
    ids. Rows keep their order and number; repeated and null ids are passed on;
    other columns are ignored. No shuffle: a map over slices of bounded size.
    """
    out = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")
    return shared.texts(docs, id_col, text_col).mapInArrow(functools.partial(_coded, path=vocabulary, keep=not digests), out)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoded(shared.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), digests=True)
