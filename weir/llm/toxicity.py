"""Toxicity (operator 8).

A lexicon of terms and stems (open at the end) stands in a trie. The Levenshtein
automaton of a word's distance from a term is run over the trie: a state of the
intersection is the set of (trie node, edits so far) that the characters read can
lead to, made when it is first met and kept in a transition table; a word that no
term is near falls into the empty state after a few letters. Terms and stems of five
letters or more may be misspelled by one edit, and so may a term that a stem begins,
whatever follows it; what follows an open end is only read after a letter that fits.
Two runs of letters with one digit or symbol between them are also read as one word.

A hit's context decides what it counts for: hits inside quotation marks and hits
outside, near misses, and how dense hits are within a window of words, are counted
apart, and a logistic regression weighs them. Quotation marks count in pairs only, of
one line and a window of words. Lexicon and weights are learnt from
bounded samples of labelled rows; scoring is a map over slices of bounded size.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .bpe import LETTER, SPACE, Memo, code_points, distinct_words, kinds
from .quality import held_out, labelled_sample

STEM = range(4, 7)
WINDOW = 12
EXACT, FUZZY = 2, 1
#: Stands for a node: an open end was reached with an edit, and any letters may follow.
PAST = -1


@dataclass
class Lexicon:
    """``innocent``: words one edit from a term that clean texts use."""

    terms: list[str]
    stems: list[str]
    innocent: list[str] = field(default_factory=list)


class Matcher:
    """The lexicon's trie under Levenshtein automata, determinised as words are read."""

    def __init__(self, lexicon: Lexicon, least: int = 5):
        self.children: list[dict[str, int]] = [{}]
        self.term: dict[int, bool] = {}
        self.stem: dict[int, bool] = {}
        self.fuzzy: set[int] = set()
        self.near: set[int] = set()
        self.open: set[int] = set()
        for word, ends in [*((t, self.stem) for t in lexicon.stems), *((t, self.term) for t in lexicon.terms)]:
            node, path = 0, [0]
            for c in word:
                node = self.children[node].setdefault(c, len(self.children))
                if node == len(self.children):
                    self.children.append({})
                path.append(node)
            ends[node] = True
            if len(word) >= least:
                self.fuzzy.update(path)
                if ends is self.term:
                    self.near.add(node)
                if ends is self.stem or any(at in self.stem for at in path):
                    self.open.add(node)
        self.innocent = set(lexicon.innocent)
        self.states: list[frozenset] = []
        self.known: dict[frozenset, int] = {}
        self.steps: dict[tuple[int, str], int] = {}
        self.verdicts: list[int] = []
        self.rest: list[bool] = []
        self.start = self._state(self._closed({(0, 0)}))

    def _closed(self, held: set[tuple[int, int]]) -> frozenset:
        """With the states that skipping a term's letter leads to."""
        out = set(held)
        for node, edits in held:
            if not edits and node in self.fuzzy:
                out.update((child, 1) for child in self.children[node].values() if child in self.fuzzy)
        return frozenset((node, edits) for node, edits in out if not edits or (node, 0) not in out)

    def _state(self, held: frozenset) -> int:
        k = self.known.get(held)
        if k is None:
            k = self.known[held] = len(self.states)
            self.states.append(held)
            self.rest.append(any(not edits and node in self.stem for node, edits in held))
            exact = any(not edits and node in self.term for node, edits in held)
            self.verdicts.append(EXACT if exact else FUZZY if any(node == PAST or node in self.near for node, _ in held) else 0)
        return k

    def _step(self, state: int, c: str) -> int:
        out = set()
        for node, edits in self.states[state]:
            if node == PAST:
                out.add((PAST, 1))
                continue
            child = self.children[node].get(c)
            if child is not None and (not edits or child in self.fuzzy):
                out.add((child, edits))
                if edits and child in self.open:
                    out.add((PAST, 1))
            if not edits and node in self.fuzzy:
                out.add((node, 1))  # a letter too many
                out.update((x, 1) for x in self.children[node].values() if x in self.fuzzy)  # another letter
        k = self._state(self._closed(out))
        if len(self.steps) > 500_000:
            self.steps.clear()
        self.steps[state, c] = k
        return k

    def match(self, word: str) -> int:
        """EXACT for a term or a word that begins with a stem, FUZZY for one edit from either, else 0."""
        state, steps = self.start, self.steps
        for c in word:
            then = steps.get((state, c))
            state = self._step(state, c) if then is None else then
            if self.rest[state]:
                return EXACT
            if not self.states[state]:
                return 0
        found = self.verdicts[state]
        return 0 if found == FUZZY and word in self.innocent else found


def letter_runs(points: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words: runs of letters, never across texts."""
    n = len(points)
    letter = kinds()[points] == LETTER
    head = np.zeros(n + 1, bool)
    head[heads] = True
    head[n] = True
    first = letter.copy()
    first[1:] &= ~letter[:-1] | head[1:n]
    last = letter.copy()
    last[:-1] &= ~letter[1:] | head[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def joined(points: np.ndarray, start: np.ndarray, end: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """The numbers of the words that one character other than white space parts from the next word of the same text."""
    k = np.flatnonzero(start[1:] - end[:-1] == 1)
    k = k[kinds()[points[end[k]]] != SPACE]
    return k[np.searchsorted(heads, start[k], side="right") == np.searchsorted(heads, start[k + 1], side="right")]


def _verdicts(whole: str, points: np.ndarray, start: np.ndarray, end: np.ndarray, matcher: Matcher, memo: Memo) -> np.ndarray:
    """The verdict of each span; each distinct word is matched once."""
    first, inverse = distinct_words(points, start, end)
    out = np.empty(len(first), np.int8)
    for k, (a, b) in enumerate(zip(start[first].tolist(), end[first].tolist(), strict=True)):
        word = whole[a:b]
        held = memo.get(word)
        if held is None:
            held = matcher.match(word)
            memo.put(word, held)
        out[k] = held
    return out[inverse]


#: Marks that open a quotation, and those that close it: English, German, French either way, single ones.
CLOSES = {'"': '"', "'": "'", "“": "”", "”": "”", "„": "“”", "«": "»", "»": "«", "‘": "’", "‚": "‘’", "‹": "›", "›": "‹"}
_MARKS = sorted(ord(c) for c in {*CLOSES, *"".join(CLOSES.values())})
#: Words that a quotation may have.
QUOTED = 40


def quotations(whole: str, marks: list[int], head: int, tail: int, words: np.ndarray) -> Iterator[tuple[int, int]]:
    """(opening mark, closing mark) of the quotations of a text, which is ``whole[head:tail]``; ``words``: where words start.

    A mark opens a quotation if no letter, digit or mark stands before it and something
    other than white space behind it, and if a mark that closes this kind follows in the
    same line and within ``QUOTED`` words, with white space neither before it nor a letter
    or digit behind it. What doesn't open is passed over: an inch mark, an apostrophe, or
    a mark without its fellow quotes nothing. Quotations don't overlap.
    """
    beside = lambda at: whole[at] if head <= at < tail else " "
    k = 0
    while k < len(marks):
        at, k = marks[k], k + 1
        closers = CLOSES.get(whole[at])
        if closers is None or beside(at - 1).isalnum() or beside(at - 1) in CLOSES or beside(at + 1).isspace():
            continue
        line = whole.find("\n", at, tail)
        last = min(tail if line < 0 else line, *words[np.searchsorted(words, at) + QUOTED :][:1].tolist() or [tail])
        for n in range(k, len(marks)):
            other = marks[n]
            if other >= last:
                break
            if whole[other] in closers and other > at + 1 and not beside(other - 1).isspace() and not beside(other + 1).isalnum():
                yield at, other
                k = n + 1
                break


def features(texts: list[str], matcher: Matcher, memo: Memo) -> np.ndarray:
    """A row a text: log counts of hits outside and inside quotation marks and of near misses, their density, the densest window."""
    low = [t.lower() for t in texts]
    whole = "".join(low)
    heads = np.concatenate([[0], np.cumsum([len(t) for t in low])])
    out = np.zeros((len(texts), 5))
    points = code_points(whole)
    if not len(points):
        return out
    start, end = letter_runs(points, heads[:-1])
    if not len(start):
        return out
    found = _verdicts(whole, points, start, end, matcher, memo)
    pair = joined(points, start, end, heads[:-1])
    pair = pair[(found[pair] == 0) & (found[pair + 1] == 0)]
    if len(pair):
        found[pair] = _verdicts(whole, points, start[pair], end[pair + 1], matcher, memo)
    hits = np.flatnonzero(found)
    owner = np.searchsorted(heads, start[hits], side="right") - 1
    quoted = np.zeros(len(hits), bool)
    marks = np.flatnonzero(np.isin(points, _MARKS))
    for k in np.unique(owner).tolist() if len(marks) else []:
        for opens, closes in quotations(whole, marks[np.searchsorted(marks, heads[k]) : np.searchsorted(marks, heads[k + 1])].tolist(), int(heads[k]), int(heads[k + 1]), start):
            quoted[np.searchsorted(start[hits], opens) : np.searchsorted(start[hits], closes)] = True
    cuts = np.searchsorted(start, heads)
    for k in np.unique(owner).tolist():
        mine = owner == k if len(hits) < 64 else slice(np.searchsorted(owner, k), np.searchsorted(owner, k, side="right"))
        kind, inside, place = found[hits[mine]], quoted[mine], hits[mine]
        sure = place[kind == EXACT]
        plain = (kind == EXACT) & ~inside
        dense = (np.searchsorted(sure, sure + WINDOW) - np.arange(len(sure))).max() if len(sure) else 0
        out[k] = np.log1p(plain.sum()), np.log1p((kind == EXACT).sum() - plain.sum()), np.log1p((kind == FUZZY).sum()), 100 * plain.sum() / (cuts[k + 1] - cuts[k]), dense
    return out


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.minimum(x, 5) @ self.weights + self.bias, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.05, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton's method, classes weighed alike; weights below 0 only for quoted hits and near misses."""
    if not len(y) or y.min() == y.max():
        return np.array([3.0, 0.5, 0.2, 0.1, 0.1]), -2.0
    x = np.minimum(x, 5)
    z = np.hstack([x, np.ones((len(x), 1))])
    weigh = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (weigh * (y - p)) / len(y) - penalty * np.append(w[:-1], 0) * 0.02
        hess = (z * (weigh * p * (1 - p))[:, None]).T @ z / len(y) + np.diag([penalty * 0.02] * x.shape[1] + [1e-9])
        step = np.linalg.solve(hess, grad)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def units(text: str) -> set[str]:
    """The words of a text and, marked by a following hyphen, what they begin with."""
    low = text.lower()
    points = code_points(low)
    words = {low[a:b] for a, b in zip(*(x.tolist() for x in letter_runs(points, np.zeros(1, int))), strict=True)} if len(points) else set()
    return words | {w[:n] + "-" for w in words for n in STEM if len(w) > n}


def pairs(text: str) -> set[str]:
    """Two words of a text that one character other than white space parts, with it."""
    low = text.lower()
    points = code_points(low)
    if not len(points):
        return set()
    start, end = letter_runs(points, np.zeros(1, int))
    pair = joined(points, start, end, np.zeros(1, int))
    return {low[a:b] for a, b in zip(start[pair].tolist(), end[pair + 1].tolist(), strict=True)}


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each unit with the words around it, once a text, and whether it is the unit's first place there."""
    # small slices: a text's places take far more room than the text
    for part in shared.sliced(batches, "text", 1 << 17):
        found: list[tuple[str, str, bool]] = []
        for text in shared.strings(part.column("text")).to_pylist():
            low = text.lower()
            points = code_points(low)
            words = [low[a:b] for a, b in zip(*(x.tolist() for x in letter_runs(points, np.zeros(1, int))), strict=True)] if len(points) else []
            seen: set[tuple[str, str]] = set()
            met: set[str] = set()
            for before, w, after in zip(["", *words], words, [*words[1:], ""], strict=False):
                around = f"{before} {after}"
                for unit in (w, *(w[:n] + "-" for n in STEM if len(w) > n)):
                    if (unit, around) not in seen:
                        seen.add((unit, around))
                        found.append((unit, around, unit not in met))
                        met.add(unit)
        columns = list(zip(*found, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.bool_()), strict=True)], ["unit", "around", "first"])


def _counted(batches: Iterator[pa.RecordBatch], wanted: frozenset[str]) -> Iterator[pa.RecordBatch]:
    """In how many texts each wanted unit stands, summed within a slice."""
    for part in shared.sliced(batches, "text"):
        count: Counter[str] = Counter()
        for text in shared.strings(part.column("text")).to_pylist():
            count.update(units(text) & wanted)
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["unit", "n"])


def one_edit(word: str, term: str) -> bool:
    """Whether the distance is exactly one."""
    if word == term or abs(len(word) - len(term)) > 1:
        return False
    a = 0
    while a < min(len(word), len(term)) and word[a] == term[a]:
        a += 1
    return word[a + 1 :] == term[a + 1 :] or word[a:] == term[a + 1 :] or word[a + 1 :] == term[a:]


def choose(pos: dict[str, int], neg: dict[str, int], n_pos: int, n_neg: int, *, least: int, odds: float) -> Lexicon:
    """Every unit that stands in at least ``least`` toxic texts (``pos``) and far more often there than in clean ones (``neg``).

    A stem replaces the longer stems that it begins; the whole words that it begins
    stay beside it, so that they can be misspelt.
    """

    def ratio(u: str) -> float:
        return float(np.log((pos[u] + 0.5) / (n_pos + 1)) - np.log((neg.get(u, 0) + 0.5) / (n_neg + 1)))

    good = sorted((u for u, n in pos.items() if n >= least and ratio(u) >= odds), key=lambda u: (-pos[u], len(u), u))
    whole = {u for u in good if not u.endswith("-")}
    # a stem that hardly stands for more than one word is that word
    single = {u for u in good if u.endswith("-") and any(w.startswith(u[:-1]) and pos[w] >= 0.9 * pos[u] for w in whole)}
    stems: list[str] = []
    for u in sorted((u for u in good if u.endswith("-") and u not in single), key=lambda u: (len(u), -pos[u], u)):
        if not any(u.startswith(s) for s in stems):
            stems.append(u[:-1])
    return Lexicon(sorted(whole), sorted(stems))


def fit(
    docs: DataFrame, labels: DataFrame, *, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
    most_toxic: int = 3_000, most_clean: int = 6_000, least: int = 5, odds: float = 3.5,
) -> Model:
    """Bounds: how many labelled rows of either kind are learnt from; what the driver holds of them is counts of their units.

    A text counts once, however many rows have it. A unit counts for as many toxic texts as
    have it, but for no more than the different pairs of words it stands between: near copies
    of a text, of which there may be many, add little, and so does one long text.
    """
    plain = shared.texts(docs, id_col, text_col)
    toxic = labelled_sample(labels.where(F.col(label) == 1), id_col, label, most_toxic)
    clean = labelled_sample(labels.where(F.col(label) == 0), id_col, label, most_clean)
    sample = plain.join(F.broadcast(toxic.unionByName(clean)), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    table = shared.Kept(sample.select("text", "label").distinct(), "toxicity")
    sample = table.df
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    pos = sample.where("label = 1").mapInArrow(_places, "unit string, around string, first boolean").groupBy("unit").agg(F.count_distinct("around").alias("places"), F.sum(F.col("first").cast("int")).alias("texts"))
    pos = {r["unit"]: r["n"] for r in pos.select("unit", F.least("places", "texts").alias("n")).where(F.col("n") >= least).collect()}
    neg = sample.where("label = 0").mapInArrow(functools.partial(_counted, wanted=frozenset(pos)), "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    neg = {r["unit"]: r["n"] for r in neg.collect()}
    lexicon = choose(pos, neg, sizes.get(1, 0), sizes.get(0, 0), least=least, odds=odds)
    near = sample.where("label = 0").mapInArrow(functools.partial(_near, lexicon=lexicon), "unit string").distinct()
    lexicon.innocent = sorted(r["unit"] for r in near.collect())
    rows = sample.mapInArrow(functools.partial(_measured, lexicon=lexicon), "label int, x array<double>").collect()
    table.drop()
    rows = sorted((r["label"], *r["x"]) for r in rows)
    held = np.array(rows) if rows else np.zeros((0, 6))
    return Model(lexicon, *logistic(held[:, 1:], held[:, 0]))


def _near(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    """Words and pairs of words of clean texts that are one edit from a term or stem."""
    matcher = Matcher(lexicon)
    for part in shared.sliced(batches, "text"):
        found: set[str] = set()
        for text in shared.strings(part.column("text")).to_pylist():
            found.update(w for w in units(text) | pairs(text) if not w.endswith("-") and matcher.match(w) == FUZZY)
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["unit"])


def _measured(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    matcher, memo = Matcher(lexicon), Memo(60_000)
    for part in shared.sliced(batches, "text"):
        x = features(shared.strings(part.column("text")).to_pylist(), matcher, memo)
        yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["label", "x"])


def _scored(batches: Iterable[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    matcher, memo = Matcher(model.lexicon), Memo(60_000)
    for part in shared.sliced(batches, "text"):
        x = features(shared.strings(part.column("text")).to_pylist(), matcher, memo)
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.scores(x))], ["doc_id", "score"])


def _clean(batches: Iterable[pa.RecordBatch], model: Model, threshold: float) -> Iterator[pa.RecordBatch]:
    matcher, memo = Matcher(model.lexicon), Memo(60_000)
    for part in shared.sliced(batches, "text"):
        x = features(shared.strings(part.column("text")).to_pylist(), matcher, memo)
        yield part.filter(pa.array(model.scores(x) < threshold))


def scored(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` for each row.

    The score depends on the text alone. Null text counts as empty; a text without
    words has the score of no hits. Null ids are passed on, held out. Repeated rows
    each get a row. Other columns are ignored.
    """
    out = shared.texts(docs, id_col, text_col).mapInArrow(functools.partial(_scored, model=model), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model, *, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` (with a column ``text``) that score below ``threshold``, with all their columns."""
    return docs.mapInArrow(functools.partial(_clean, model=model, threshold=threshold), docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, shared.table(spark, sf_dir, "labels")))
