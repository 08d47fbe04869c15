"""Toxicity: Levenshtein automata over a lexicon trie, with context windows.

The lexicon is a short list of abusive words and what the labelled rows teach:
words and word beginnings that are far commoner in toxic documents, weighted by
their log ratio. It is a trie; each word is run through the product of the trie
and an automaton of bounded edit distance, made deterministic as states are
met, so a word costs a few table steps and misspelled terms are found.

Each hit is weighed by the words around it: one inside quotation marks, or
beside some with a verb of speaking, is talk about the term and does not count
as use; address in the second person adds weight. A boosted
tree model over a document's sums gives the score; lexicon and model learn from
two halves of the labelled rows, so the model sees how the lexicon does on rows
that it was not made from.

What is learned from is bounded: ``TRAIN_ROWS`` labelled rows, by hash, and
``TERMS`` terms beside the seeds: those that gain most, so a term beyond them
adds less than each that is in. Every document is scored. Defined cases: null
and empty texts have no hits and get the score of such texts; very long texts
are scored whole, and very long words looked up without being remembered;
repeated rows are scored each; without labelled rows the score is a fixed
function of the hits; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm import common, gbdt, quality_model
from pointloom.llm.word_bpe import Memo

TRAIN_ROWS = 12_000
TERMS = 400
CUT = 0.3
WINDOW = 6
SEEDS = (
    "asshole", "bastard", "bitch", "clown", "cretin", "degenerate", "despicable", "dimwit", "disgusting", "dumbass", "filthy", "garbage", "idiot",
    "idiotic", "imbecile", "loser", "lowlife", "maggot", "moron", "moronic", "parasite", "pathetic", "retard", "scum", "scumbag", "stupid", "subhuman", "trash", "vermin", "worthless",
)
SEED_WEIGHT = 3.0
#: Digits and signs that stand for letters in disguised words.
DISGUISE = str.maketrans("013457@$!|", "oieastasii")
QUOTES = "\"“”«»„‟‹›"
SPEECH = {"said", "says", "say", "called", "calls", "wrote", "writes", "quoted", "quote", "word", "term", "dit", "écrit", "mot", "sagte", "sagt", "schrieb", "wort", "dijo", "dice", "escribió", "palabra"}
ADDRESS = {"you", "your", "youre", "yourself", "u", "tu", "toi", "vous", "du", "dich", "dir", "ihr", "eres", "tú", "vosotros", "ustedes"}
N_FEATURES = 12
#: States of the automaton after which it is built anew, and steps after which it is.
MOST_STATES, MOST_STEPS = 20_000, 400_000
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
#: What the lexicon learns from: runs of letters and digits.
_RUN = re.compile(r"[^\W_]{3,}")
_MARKS = re.compile(r"[\W_]+")


@dataclass
class Lexicon:
    """term -> (weight, whether the term is only a word's beginning)."""

    terms: dict[str, tuple[float, bool]]
    _steps: list = field(default_factory=list, repr=False)

    def edits(self, term: str) -> int:
        return 0 if len(term) < 5 else 1 if len(term) < 9 else 2

    def compile(self) -> None:
        """The trie, as rows of (children, term, most edits below), and the first state."""
        self.nodes: list[list] = [[{}, None, 0]]
        for term in sorted(self.terms):
            at, most = 0, self.edits(term)
            for letter in term:
                self.nodes[at][2] = max(self.nodes[at][2], most)
                at = self.nodes[at][0].setdefault(letter, len(self.nodes))
                if at == len(self.nodes):
                    self.nodes.append([{}, None, 0])
            self.nodes[at][1], self.nodes[at][2] = term, max(self.nodes[at][2], most)
        self._begin()

    def _begin(self) -> None:
        """The automaton with its first state alone; what words need is added as they come."""
        self.steps = 0
        self.ids: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.table: list[dict[str, int]] = []
        self.ends: list = []
        self.first = self._state(self._skip({0: 0}))

    def _skip(self, cost: dict[int, int]) -> dict[int, int]:
        """Also reach what leaving out letters of a term reaches."""
        todo = list(cost)
        while todo:
            at = todo.pop()
            if cost[at] < self.nodes[at][2]:
                for child in self.nodes[at][0].values():
                    if cost.get(child, 9) > cost[at] + 1 <= self.nodes[child][2]:
                        cost[child] = cost[at] + 1
                        todo.append(child)
        return cost

    def _state(self, cost: dict[int, int]) -> int:
        key = frozenset(cost.items())
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.table.append({})
            best = {False: None, True: None}
            for at, c in cost.items():
                term = self.nodes[at][1]
                if term is not None and c <= self.edits(term):
                    weight, begins = self.terms[term]
                    for kind in (False, True)[: 2 if begins else 1]:
                        found = (-c, weight, term)
                        best[kind] = max(best[kind], found) if best[kind] else found
            self.ends.append((best[False], best[True]))
        return self.ids[key]

    def _step(self, state: int, letter: str) -> int:
        cost: dict[int, int] = {}
        for at, c in self.states[state]:
            children, _, most = self.nodes[at]
            for given, child in children.items():
                new = c + (given != letter)
                if new <= self.nodes[child][2] and cost.get(child, 9) > new:
                    cost[child] = new
            if c + 1 <= most and cost.get(at, 9) > c + 1:
                cost[at] = c + 1
        to = self._state(self._skip(cost)) if cost else -1
        self.table[state][letter] = to
        self.steps += 1
        return to

    def find(self, word: str):
        """The best term for a lower-case word: (edits, weight, term), or None.

        Fewer edits come first, then weight. A term that is a word's beginning
        is found in any word that begins like it.
        """
        if len(self.states) > MOST_STATES or self.steps > MOST_STEPS:
            self._begin()  # a word adds a few states at most, as none goes on beyond the terms
        state, best = self.first, None
        for letter in word:
            to = self.table[state].get(letter)
            state = self._step(state, letter) if to is None else to
            if state < 0:
                return best
            begun = self.ends[state][1]
            if begun is not None and (best is None or begun > best):
                best = begun
        whole = self.ends[state][0]
        return max(best, whole) if best and whole else best or whole

    def __getstate__(self):
        return self.terms

    def __setstate__(self, terms):
        self.terms = terms


def learn_lexicon(rows: DataFrame, terms: int = TERMS, seeds: tuple[str, ...] = SEEDS) -> Lexicon:
    """Terms from ``rows`` (y, text) and the seeds. Rows with one text count once."""
    d = rows.groupBy("text").agg(F.max("y").alias("y"))
    # each row's distinct lower-case words, whole ("=word") and by their beginnings
    words = r"array_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]{3,}', 0))"
    begun = "transform(filter(sequence(3, 7), k -> k <= char_length(w)), k -> substring(w, 1, k))"
    d = d.select("y", F.expr(f"explode(array_distinct(flatten(transform({words}, w -> concat(array(concat('=', w)), {begun})))))").alias("term"))
    total = rows.groupBy("text").agg(F.max("y").alias("y")).agg(F.sum("y"), F.sum(1 - F.col("y"))).first()
    n1, n0 = (int(v or 0) for v in total)
    found: dict[str, tuple[float, bool]] = {}
    if n1 and n0:
        counts = d.groupBy("term").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
        ratio = F.log((F.col("a") + 0.5) / (n1 + 1)) - F.log((F.col("b") + 0.5) / (n0 + 1))
        best = counts.withColumn("w", ratio).filter((F.col("a") >= max(3, math.ceil(0.015 * n1))) & (F.col("w") > 1.5))
        gain = (F.col("a") / n1 - F.col("b") / n0) * F.col("w")
        for r in best.orderBy(gain.desc(), "term").limit(terms).collect():
            whole = r["term"].startswith("=")
            term = r["term"].lstrip("=")
            if term not in found or whole < found[term][1]:
                found[term] = (max(float(r["w"]), found.get(term, (0.0,))[0]), not whole)
    for s in seeds:
        found[s] = (max(SEED_WEIGHT, found.get(s, (0.0,))[0]), found.get(s, (0, False))[1])
    return Lexicon(found)


def _quoted(around: list[str], at: int, spoken: bool) -> bool:
    """Whether the chunk at ``at`` stands inside quotation marks, or beside some where someone speaks."""
    here = around[at]
    word = _EDGE.sub("", here)
    head, _, tail = here.partition(word)
    before, after = " ".join(around[:at]) + head, tail + " ".join(around[at + 1 :])
    marks = [sum(part.count(q) for q in QUOTES) for part in (before, after)]
    return (marks[0] % 2 == 1 and marks[1] > 0) or (spoken and sum(marks) > 0)


class Matcher:
    def __init__(self, lexicon: Lexicon):
        lexicon.compile()
        self.lexicon = lexicon
        self.memo = Memo(self._hit)

    def _hit(self, chunk: bytes):
        """() for no hit, else (term, edits, weight).

        Each run of letters and digits is looked up; if none is a term and the
        chunk holds signs or digits, so is the whole with disguises undone and
        marks left out, which counts as one edit at least.
        """
        word = chunk.decode().lower()
        found = None
        for run in _RUN.findall(word):
            hit = self.lexicon.find(run)
            if hit is not None and (found is None or hit > found):
                found = hit
        if found is None and not word.isalpha():
            bare = _MARKS.sub("", word.translate(DISGUISE))
            found = self.lexicon.find(bare) if len(bare) >= 4 else None
            if found is not None:
                found = (min(found[0], -1), *found[1:])
        return () if found is None else (found[2], -found[0], found[1])

    def features(self, text: bytes) -> list[float]:
        chunks = text.split()
        hits = list(map(self.memo.__getitem__, chunks))
        if not any(hits):
            return [0.0] * N_FEATURES
        n, places = len(chunks), [i for i, h in enumerate(hits) if h]
        exact = fuzzy = quoted = direct = 0.0
        total = top = strong = weighed = 0.0
        terms: set[str] = set()
        for i in places:
            term, edits, weight = hits[i]
            around = [c.decode().lower() for c in chunks[max(0, i - WINDOW) : i + WINDOW + 1]]
            at = min(i, WINDOW)
            words = {_EDGE.sub("", a) for a in around}
            if _quoted(around, at, bool(words & SPEECH)):
                # talk about a term is no use of it: it counts among the quoted alone
                quoted += 1
                continue
            is_direct = bool(words & ADDRESS)
            factor = (0.4 if edits else 1.0) * (1.15 if is_direct else 1.0)
            exact, fuzzy, direct = exact + (edits == 0), fuzzy + (edits > 0), direct + is_direct
            total, weighed, top = total + weight, weighed + factor * weight, max(top, factor * weight)
            strong += factor * weight >= 2.5
            terms.add(term)
        used = max(1.0, exact + fuzzy)
        return [weighed, top, strong, exact, fuzzy, quoted, direct, float(len(terms)), weighed / n, strong / n, total / used, (exact + fuzzy) / n]


_held: dict[tuple, Matcher] = {}


def _matcher(lexicon: Lexicon) -> Matcher:
    key = tuple(sorted(lexicon.terms.items()))
    if key not in _held:
        _held.clear()
        _held[key] = Matcher(Lexicon(lexicon.terms))
    return _held[key]


def matrix(lexicon: Lexicon):
    def run(batch: pa.RecordBatch, column: int) -> np.ndarray:
        m = _matcher(lexicon)
        texts = batch.column(column).cast(pa.binary())
        return np.array([m.features(t.as_py()) for t in texts], dtype=np.float64).reshape(len(texts), N_FEATURES)

    return run


def _rows(lexicon: Lexicon):
    features = matrix(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(features(batch, 1)), pa.list_(pa.float64()))], names=["y", "x"])

    return run


@dataclass
class Model:
    lexicon: Lexicon
    forest: gbdt.Forest | None


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit to ``labels.toxic`` of rows outside the held-out fold."""
    picked = docs.select(F.col(id_col).alias("id"), common.whole_text(F.col(text_col)).alias("text"))
    chosen = quality_model.chosen(labels, "toxic", 4, 2, rows)
    # at most ``rows`` pairs of numbers are broadcast
    d = picked.join(F.broadcast(chosen), F.col("id") == F.col("train_id"))
    d = quality_model.one_of_each(d).select(F.pmod(F.xxhash64("train_id"), F.lit(2)).alias("half"), F.col("y").cast("int").alias("y"), "text")
    d = common.staged(d, "toxic-training")
    lexicon = learn_lexicon(d.filter("half = 0"))
    found = d.filter("half = 1").select("y", "text").mapInArrow(_rows(lexicon), "y int, x array<double>").toArrow()
    x = np.array(found.column("x").to_pylist(), dtype=np.float64).reshape(found.num_rows, N_FEATURES)
    y = np.array(found.column("y").to_pylist(), dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return Model(lexicon, None)
    order = np.lexsort((*x.T, y))
    return Model(lexicon, gbdt.fit(x[order], y[order], trees=60, depth=3, least=4))


class _ByWeight:
    """Without labels: the weighed hits alone."""

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(3.0 - x[:, 0]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.whole_text(F.col(text_col)).alias("text"))
    d = picked.mapInArrow(quality_model.scorer(model.forest or _ByWeight(), matrix(model.lexicon)), "doc_id long, score double")
    return d.select("doc_id", quality_model.fold("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
