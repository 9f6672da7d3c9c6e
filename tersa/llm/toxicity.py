"""Toxicity by a learnt lexicon, matched with Levenshtein automata, and a classifier on where the matches stand.

From a bounded sample of labelled documents, words and word beginnings are counted in toxic and in clean ones. Those that
stand out beyond chance form a lexicon: whole words, or stems where many endings follow. It is kept as a trie, and the trie
is intersected with the Levenshtein automaton of each word of a text: states are sets of (trie node, errors) that are
reached together, found once and kept, so that a word costs one step a character. Matches are told apart as exact or
misspelt, and by their window: within quotation marks or after a verb of reporting they count as quotation, else as use. A
logistic regression on the weights of those matches gives the score, as a probability at the corpus's share of toxic labels.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tersa.llm.common import crc_fold, map_columns, materialize

TRAIN_TOXIC, TRAIN_CLEAN, LONGEST = 2000, 4000, 64
MIN_STEM, MAX_STEM, FUZZY_LEAST, FEW = 4, 10, 5, 3
PURITY, COVER, THRESHOLD = 0.9, 0.9, 0.7
WORD = re.compile(r"[^\W_]+")
#: Window before a match, in characters, in which a word of reporting makes it quotation; the words, unless others are given.
BEFORE = 60
REPORTS = ("said", "says", "quote", "quoted", "wrote", "called", "citation", "cited", "reported", "sagte", "schrieb", "zitat", "dit", "écrit", "dijo", "escribió", "cita")
QUOTES = re.compile("[\"“”„«»]")
#: With wide matches: words with symbols inside; least letters for an error. Short entries that are misspelt weigh less.
MASKED = re.compile(r"[^\W_]+(?:[*@$!#+_.-]{1,3}[^\W_]+)+")
WIDE_LEAST, SHORT_WEIGHT = 4, 0.5
KINDS = ("used", "used misspelt", "quoted", "quoted misspelt")


class Lexicon:
    """Entries (text, whole word or stem, weight) in a trie, and its intersection with Levenshtein automata of words."""

    def __init__(self, entries: list[tuple[str, bool, float]], wide: bool = False):
        """wide: errors at the first character too, swapped neighbours as one error, and errors in entries of WIDE_LEAST letters."""
        self.entries, self.wide = entries, wide
        least = WIDE_LEAST if wide else FUZZY_LEAST
        self.edges: list[dict[str, int]] = [{}]
        self.whole: list[float] = [0.0]
        self.stem: list[float] = [0.0]
        self.fuzzy: list[bool] = [wide and any(len(text) >= least for text, _, _ in entries)]  # a node at or above which an entry long enough for one error stands
        for text, whole, weight in entries:
            at = 0
            for c in text:
                if c not in self.edges[at]:
                    self.edges[at][c] = len(self.whole)
                    self.edges.append({})
                    self.whole.append(0.0)
                    self.stem.append(0.0)
                    self.fuzzy.append(False)
                at = self.edges[at][c]
                self.fuzzy[at] |= len(text) >= least
            kind = self.whole if whole else self.stem
            kind[at] = max(kind[at], weight)
        self.long = {text for text, _, _ in entries if len(text) >= least}
        self.names = {0: ""}
        for n, edges in enumerate(self.edges):
            for c, to in edges.items():
                self.names[to] = self.names[n] + c
        self.alphabet = {c for edges in self.edges for c in edges}
        self.states: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.found: list[tuple[float, float, float, float]] = []  # whole exact, whole misspelt, stem exact, stem misspelt
        self.number: dict[frozenset, int] = {}
        self.start = self._state(frozenset({(0, 0)}))

    def _state(self, pairs: frozenset) -> int:
        """The number of a state, closed under characters that the word leaves out."""
        closed = set(pairs)
        for node, errors, *swapped in pairs:
            if errors == 0 and (node or self.wide):
                closed |= {(to, 1) for to in self.edges[node].values() if self.fuzzy[to]}
        key = frozenset(p for p in closed if not (len(p) == 2 and p[1] and (p[0], 0) in closed))
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
            best = [0.0] * 4  # a misspelt entry of fewer than FUZZY_LEAST letters weighs SHORT_WEIGHT of its own
            for node, errors, *swapped in key:
                if swapped:
                    continue
                if not errors or self.names[node] in self.long:
                    w = SHORT_WEIGHT if errors and len(self.names[node]) < FUZZY_LEAST else 1.0
                    best[errors] = max(best[errors], w * self.whole[node])
                    best[2 + errors] = max(best[2 + errors], w * self.stem[node])
            self.found.append(tuple(best))
        return self.number[key]

    def _step(self, state: int, c: str) -> int:
        """From a state by a character; unless wide, errors need the first character of an entry right. -1: no entry is near any more."""
        out = set()
        for node, errors, *swapped in self.states[state]:
            if swapped:
                if c == swapped[0]:
                    out.add((node, 1))
                continue
            if (to := self.edges[node].get(c)) is not None:
                out.add((to, errors))
            if errors == 0 and self.wide:  # c stands before its neighbour, which is to follow
                out |= {(at, 1, d) for d, to in self.edges[node].items() if (at := self.edges[to].get(c)) is not None and self.fuzzy[at]}
            if errors == 0 and (node or self.wide):
                if self.fuzzy[node]:
                    out.add((node, 1))  # c is one too many
                out |= {(to, 1) for to in self.edges[node].values() if self.fuzzy[to]}  # c stands for another
        return self._state(frozenset(out)) if out else -1

    def match(self, word: str) -> tuple[float, bool]:
        """Weight of the best entry within one error of the word, or of its beginning for stems, and whether there was an error."""
        state, exact, near = self.start, 0.0, 0.0
        for c in word:
            c = c if c in self.alphabet else "\0"
            to = self.steps[state].get(c)
            if to is None:
                to = self.steps[state][c] = self._step(state, c)
            if to < 0:
                break
            state = to
            stem = self.found[state]
            exact, near = max(exact, stem[2]), max(near, stem[3])
        else:
            whole = self.found[state]
            exact, near = max(exact, whole[0]), max(near, whole[1])
        return (exact, False) if exact else (near, True)


class _Weights(dict):
    """Word -> match; forgets all when full."""

    def __init__(self, lexicon: Lexicon, reports: tuple[str, ...] = REPORTS):
        super().__init__()
        self.lexicon = lexicon
        self.reports = re.compile(rf"\b(?:{'|'.join(map(re.escape, reports))})\b" if reports else r"(?!)")

    def __missing__(self, word: str):
        if len(self) > 200_000:
            self.clear()
        weight, misspelt = self.lexicon.match(word)
        self[word] = out = (weight, misspelt) if weight else None
        return out


def features(text: str | None, weights: _Weights) -> list[float]:
    """Per kind of match the weights of the words found, each once; then the share of matches among the words."""
    low = (text or "").lower()
    words = WORD.findall(low)
    hits = {w for w in set(words) if weights[w]}
    masked = [m for m in MASKED.finditer(low) if weights[m[0]]] if weights.lexicon.wide else []
    hits |= {m[0] for m in masked}
    sums = [0.0] * len(KINDS)
    if not hits:
        return [*sums, 0.0]
    kinds: dict[str, int] = {}
    n, quotes, at = 0, 0, 0
    every = WORD.finditer(low)
    for m in sorted([*every, *masked], key=lambda m: m.start()) if masked else every:
        if m[0] in hits:
            n += 1
            quotes += len(QUOTES.findall(low, at, m.start()))
            at = m.start()
            quoted = quotes % 2 == 1 or weights.reports.search(low, max(0, m.start() - BEFORE), m.start()) is not None
            kind = 2 * quoted + weights[m[0]][1]
            kinds[m[0]] = min(kinds.get(m[0], kind), kind)  # used once is used
    for w, kind in kinds.items():
        sums[kind] += weights[w][0]
    return [*map(math.log1p, sums), math.log1p(100.0 * n / len(words))]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Coefficients, the intercept last, by Newton's method on the penalised likelihood (no penalty on the intercept)."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bounds: dict[int, int]) -> tuple[DataFrame, dict[int, int]]:
    """Texts with their label outside the held-out fold: of each label at most bounds[label] documents, the first by a hash of the id.

    Also how many labels of each kind there are outside the fold. Ids with contrary labels are left out.
    """
    seen = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(*bounds) & (crc_fold(F.col("doc_id")) != 1))
    seen = seen.groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("most")).filter("y = most").select(F.col("doc_id").alias("id"), F.col("y").cast("int"))
    counts = dict(seen.groupBy("y").count().collect())
    spark = docs.sparkSession
    ids = [r for y, most in bounds.items() for r in seen.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most).collect()]
    sample = spark.createDataFrame(ids, "id long, y int")  # bounded by the sum of bounds
    return docs.join(F.broadcast(sample), F.col("doc_id") == F.col("id")).select(F.col("text"), F.col("y")), counts


def terms(word: str) -> list[str]:
    """The word, marked as whole unless it has more than LONGEST letters, and its beginnings."""
    return [*([word + "$"] if len(word) <= LONGEST else []), *(word[:k] for k in range(MIN_STEM, min(len(word), MAX_STEM) + 1))]


def learn_lexicon(sample: DataFrame) -> list[tuple[str, bool, float]]:
    """Entries from counts of documents per term, summed over the sample's partitions; see the module."""

    def make():
        def step(texts, ys):
            count = {0: Counter(), 1: Counter()}
            for text, y in zip(texts, ys):
                count[y].update({t for w in set(WORD.findall((text or "").lower())) for t in terms(w)})
            every = list(count[0].keys() | count[1].keys())
            return [every, [count[1][t] for t in every], [count[0][t] for t in every]]

        return step

    n = dict(sample.groupBy("y").count().collect())
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    if not n_toxic or not n_clean:
        return []
    counted = map_columns(sample.select("text", "y"), make, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counted = materialize(counted, "toxicity-terms")
    share = n_toxic / (n_toxic + n_clean)
    t, c = F.col("toxic"), F.col("clean")
    pure = (t / n_toxic) / (t / n_toxic + c / n_clean) >= PURITY
    # log likelihood ratio of the term's share of toxic documents against the sample's; by chance one term or so of those tried is as surprising
    surprise = t * F.log(t / (t + c) / share) + F.when(c > 0, c * F.log(c / (t + c) / (1 - share))).otherwise(0.0)
    found = counted.filter((t >= 3) & pure & (surprise >= math.log(max(2, counted.count())))).collect()  # bounded by the sample
    good = {r["term"]: r["toxic"] for r in found}
    clean = {r["term"]: r["clean"] for r in found}
    children: dict[str, list[str]] = {}
    for t in good:
        children.setdefault(t[:-1], []).append(t)
    entries: dict[tuple[str, bool], int] = {}

    def settle(t: str) -> None:
        """A term gives way to its continuations if few of them cover it, else it is an entry."""
        below = children.get(t, [])
        if not t.endswith("$") and below and len(below) <= FEW and sum(good[b] for b in below) >= COVER * good[t]:
            for b in below:
                settle(b)
        else:
            entries[t.removesuffix("$"), t.endswith("$")] = good[t]

    for t in sorted(good):
        if t[:-1] not in good:
            settle(t)
    out = []
    for (text, whole), toxic in sorted(entries.items()):
        c = clean.get(text + "$" * whole, 0)
        out.append((text, whole, math.log(((toxic + 0.5) / (n_toxic + 1)) / ((c + 0.5) / (n_clean + 1)))))
    return [e for e in out if e[2] > 0]


class Model:
    def __init__(self, entries: list[tuple[str, bool, float]], coefficients: np.ndarray, reports: tuple[str, ...] = REPORTS):
        self.entries, self.coefficients, self.reports = entries, coefficients, reports

    def scorer(self):
        weights = _Weights(Lexicon(self.entries, True), self.reports)
        w = self.coefficients

        def score(texts: list[str | None]) -> list[float]:
            x = np.array([features(t, weights) for t in texts])
            return (1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))).tolist()

        return score


def fit(docs: DataFrame, labels: DataFrame, toxic: int = TRAIN_TOXIC, clean: int = TRAIN_CLEAN, reports: tuple[str, ...] = REPORTS) -> Model:
    """Learn lexicon and coefficients from at most toxic + clean labelled documents outside the held-out fold."""
    sample, counts = labelled_sample(docs, labels, "toxic", {1: toxic, 0: clean})
    sample = materialize(sample, "toxicity-sample")
    entries = learn_lexicon(sample)
    shared = docs.sparkSession.sparkContext.broadcast(entries)

    def make():
        weights = _Weights(Lexicon(shared.value, True), reports)

        def step(texts, ys):
            return [[features(t, weights) for t in texts], ys]

        return step

    rows = map_columns(sample.select("text", "y"), make, "x array<double>, y int").collect()  # bounded: a few numbers for each sampled document
    x, y = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows], float)
    if len(set(y)) < 2:
        return Model(entries, np.array([0.0] * (len(KINDS) + 1) + [-3.0]), reports)
    w = fit_logistic(x, y)
    w[:-1] = np.maximum(w[:-1], 0)  # no match may speak for a text
    w[2:4] = np.minimum(w[2:4], w[0:2] / 2)  # a quotation weighs half of use at most
    taken = Counter(y.astype(int).tolist())
    w[-1] += math.log((counts[1] / counts[0]) / (taken[1] / taken[0]))
    return Model(entries, w, reports)


def score_documents(docs: DataFrame, labels: DataFrame, model: Model | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted: a row per row of docs.

    Null and empty texts have no matches and get the score of a text without any. Without labels of both kinds no text is
    predicted toxic. Labels outside 0 and 1, and of ids that are null, are ignored. Repeated rows score alike.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs, labels))

    def make():
        score = shared.value.scorer()

        def step(ids, texts):
            return [ids, score(texts)]

        return step

    scored = map_columns(docs, make, "doc_id long, score double")
    return scored.select("doc_id", (crc_fold(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
