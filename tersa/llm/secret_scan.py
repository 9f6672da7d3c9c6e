"""Secret scans by patterns and by inferred grammars.

Base patterns find credentials that say what they are. Their values are the labelled credentials, of which a bounded sample
is drawn by a hash of the value, from all documents. A value is read as symbols: beginnings that many labelled values share
stay as they are, separators stay, and each character of the runs between them stands as the class of its run (hex digits,
lower-case letters and digits, ...), so that a format is its beginning, its layout, its alphabets and its lengths. For each
kind a prefix tree of the sample is reduced by merging states (red and blue ones, as in ALERGIA) whose ends and continuations,
here and below, differ no more than chance explains; a state that few values reach is never merged, so that what was seen
too seldom is not generalised. That leaves a probabilistic automaton of the kind's formats, in which lengths and layout survive.

Ordinary long tokens of the sample, without those that look like a format's own and unlike the others, as bare credentials
do, give a background automaton. Every long token of every document, and such values after a ``=`` in it, is then scored. It
becomes a span of kind ``grammar``, unless a base span covers part of it, if a format makes it as likely as all but FLOOR of
its own labelled values, and the formats make it more likely than the background does by the factor 1 / FALSE_ALARMS: under the
background's own distribution such a token has at most that probability (Markov's inequality on the likelihood ratio).
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tersa.llm.common import map_columns, materialize

#: The base patterns (fixed values); least length of what must be long enough.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX, CANDIDATE = r"AKIA[A-Z0-9]+", r"[0-9a-f]+", r"[A-Za-z0-9+/_.=-]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX, MIN_CANDIDATE = 12, 18, 16, 16
KINDS = ("assign", "access", "hex", "grammar")
HINTS = (b"passw", b"secret", b"token", b"api_key", b"apikey")

#: Values learnt from, of each kind at most; of a longer value the rest is not learnt.
TRAIN_TOKENS, TRAIN_CHARS = 400, 1024
#: Chance of a false alarm under the background; share of a format's values that may score below its floor, and what a little less than a floor still is.
FALSE_ALARMS, FLOOR, SLACK = 1e-4, 0.02, 1.0
#: Standard errors by which merged states' shares may differ; fewest values that reach a state to be merged, or share a beginning.
APART, LEAST_VISITS, LEAST_KIND = 2.5, 8, 5

_assign, _access, _hex, _candidate = re.compile(ASSIGN, re.I | re.A), re.compile(ACCESS), re.compile(r"[0-9a-f]{16,}"), re.compile(CANDIDATE)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns' matches, in that order."""
    found = []
    low = text.encode("utf-8", "replace").lower()
    if any(h in low for h in HINTS):
        found += [(m.start(), 0, m.end()) for m in _assign.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _access.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    # a run of fewer characters cannot match from any of its places, so the bound can stand in the pattern
    found += [(m.start(), 2, m.end()) for m in _hex.finditer(text)]
    return sorted(found)


def credential(text: str, span: tuple[int, int, int]) -> str:
    """The credential itself: for an assignment, what is assigned."""
    value = text[span[0] : span[2]]
    return _assign.match(value)[2] if span[1] == 0 else value


def long_tokens(text: str) -> set[str]:
    return {t for w in text.split() if len(w) >= MIN_CANDIDATE for t in _candidate.findall(w) if len(t) >= MIN_CANDIDATE}


def candidates(token: str) -> list[str]:
    """A long token and, as it may be a name with its value, what follows each '=' in it, the longest first."""
    ends = [m.end() for m in re.finditer("=", token)] if "=" in token else []
    return [token, *(token[k:] for k in ends if len(token) - k >= MIN_CANDIDATE)]


_RUNS = re.compile(r"[A-Za-z0-9]+|[+/_.=-]")
#: Classes of a run, the first that holds all its characters.
ALPHABETS = tuple((name, re.compile(f"[{chars}]+").fullmatch) for name, chars in (("d", "0-9"), ("x", "0-9a-f"), ("X", "0-9A-F"), ("l", "a-z"), ("U", "A-Z"), ("a", "0-9a-z"), ("A", "0-9A-Z"), ("m", "a-zA-Z"), ("M", "0-9a-zA-Z")))
#: Each character of a run stands for itself up to this length; from there, a symbol for each sixteenth of a doubling.
PLAIN_RUN = 256


class Beginnings:
    """Beginnings that many values share: at each place a character stays while far more values have it than any would by chance."""

    def __init__(self, values: dict[str, list[str]]):
        self.known: set[str] = set()
        for of in values.values():
            level = {"": sorted(set(of))}
            while level:
                deeper = {}
                for start, some in level.items():
                    following: dict[str, list[str]] = {}
                    for v in some:
                        if len(v) > len(start):
                            following.setdefault(v[len(start)], []).append(v)
                    for c, those in following.items():
                        # a character of sixteen, by chance, within a bound that fails once in a thousand
                        if len(those) >= LEAST_VISITS and len(those) / len(some) > 1 / 16 + math.sqrt(math.log(1000) / (2 * len(some))):
                            self.known.add(start + c)
                            deeper[start + c] = those
                level = deeper

    def __call__(self, value: str) -> list[str]:
        """The symbols of a value."""
        n = 0
        while n < len(value) and value[: n + 1] in self.known:
            n += 1
        out = [f"'{c}" for c in value[:n]]
        for run in _RUNS.findall(value, n):
            name = next((k for k, holds in ALPHABETS if holds(run)), run)
            long = len(run) - PLAIN_RUN
            out += [name] * (min(len(run), PLAIN_RUN) + (round(16 * math.log2(len(run) / PLAIN_RUN)) if long > 0 else 0))
        return out


class Automaton:
    """A probabilistic automaton: per state its visits, its ends and per symbol [times, next state]."""

    SMOOTH, WIDTH = 0.1, 32

    def __init__(self, words: list[list[str]]):
        self.visits, self.ends, self.next = [0], [0], [{}]
        for word in sorted(words):
            self._add(word)
        self._merge_states()
        self._compact()

    def _add(self, word: list[str]) -> None:
        at = 0
        for s in word:
            self.visits[at] += 1
            if s not in self.next[at]:
                self.next[at][s] = [0, len(self.visits)]
                self.visits.append(0)
                self.ends.append(0)
                self.next.append({})
            self.next[at][s][0] += 1
            at = self.next[at][s][1]
        self.visits[at] += 1
        self.ends[at] += 1

    @staticmethod
    def _differ(a: int, n: int, b: int, m: int) -> bool:
        """Whether the shares a of n and b of m are more than APART standard errors apart, the pooled share being both's."""
        share = (a + b) / (n + m)
        return (a / n - b / m) ** 2 > APART**2 * share * (1 - share) * (1 / n + 1 / m)

    def _compatible(self, p: int, q: int) -> bool:
        """Whether ends and symbols, here and below, could come from one state."""
        stack, seen = [(p, q)], set()
        while stack:
            p, q = stack.pop()
            if (p, q) in seen:
                continue
            seen.add((p, q))
            n, m = self.visits[p], self.visits[q]
            if not n or not m:
                continue
            if self._differ(self.ends[p], n, self.ends[q], m):
                return False
            a, b = self.next[p], self.next[q]
            for s in a.keys() | b.keys():
                x, y = a.get(s), b.get(s)
                if self._differ(x[0] if x else 0, n, y[0] if y else 0, m):
                    return False
                if x and y and x[1] != y[1]:
                    stack.append((x[1], y[1]))
        return True

    def _fold(self, p: int, q: int) -> None:
        """Add the tree below q to p."""
        stack = [(p, q)]
        while stack:
            p, q = stack.pop()
            self.visits[p] += self.visits[q]
            self.ends[p] += self.ends[q]
            for s, (times, to) in self.next[q].items():
                if s in self.next[p]:
                    self.next[p][s][0] += times
                    stack.append((self.next[p][s][1], to))
                else:
                    self.next[p][s] = [times, to]

    def _merge_states(self) -> None:
        """Red states stay; each state next to them is merged into the first red one that it is compatible with, or turns red."""
        red, inside = [0], {0}
        edge = [(-self.visits[to], 0, s, to) for s, (_, to) in self.next[0].items()]
        heapq.heapify(edge)
        while edge:
            _, p, s, blue = heapq.heappop(edge)
            if self.next[p][s][1] != blue or blue in inside:
                continue
            # what few values reach says too little to be one with another state
            into = next((r for r in red if self.visits[r] >= LEAST_VISITS and self._compatible(r, blue)), None) if self.visits[blue] >= LEAST_VISITS else None
            if into is None:
                red.append(blue)
                inside.add(blue)
                for t, (_, to) in self.next[blue].items():
                    heapq.heappush(edge, (-self.visits[to], blue, t, to))
                continue
            self.next[p][s][1] = into
            self._fold(into, blue)
            for r in red:  # folding may have put new states next to red ones
                for t, (_, to) in self.next[r].items():
                    if to not in inside:
                        heapq.heappush(edge, (-self.visits[to], r, t, to))

    def _compact(self) -> None:
        """Drop the states that merging left behind."""
        number, queue = {0: 0}, [0]
        for p in queue:
            for _, to in self.next[p].values():
                if to not in number:
                    number[to] = len(number)
                    queue.append(to)
        self.visits, self.ends = [self.visits[p] for p in queue], [self.ends[p] for p in queue]
        self.next = [{s: [n, number[to]] for s, (n, to) in self.next[p].items()} for p in queue]

    def score(self, word: list[str]) -> float:
        """Log likelihood; a symbol that a state never met leaves the state as it is."""
        at, total = 0, 0.0
        for s in word:
            edge = self.next[at].get(s)
            total += math.log(((edge[0] if edge else 0) + self.SMOOTH) / (self.visits[at] + self.SMOOTH * self.WIDTH))
            at = edge[1] if edge else at
        return total + math.log((self.ends[at] + self.SMOOTH) / (self.visits[at] + self.SMOOTH * self.WIDTH))


class Grammars:
    """Format automata of the kinds and one of ordinary tokens."""

    def __init__(self, labelled: dict[str, list[str]], ordinary: list[str]):
        labelled = {k: v for k, v in sorted(labelled.items()) if len(v) >= LEAST_KIND}
        self.read = Beginnings(labelled)
        words = {k: [self.read(t[:TRAIN_CHARS]) for t in v] for k, v in labelled.items()}
        self.formats = {k: Automaton(w) for k, w in words.items()}
        self.floors = {}
        for k, w in words.items():
            scores = sorted(map(self.formats[k].score, w))
            self.floors[k] = scores[int(FLOOR * len(scores))] - SLACK
        # bare credentials are among the ordinary tokens: what a format makes as likely as its own is left out of the
        # background, but for what the others explain nearly as well
        every = [self.read(t[:TRAIN_CHARS]) for t in ordinary]
        others = [w for w in every if self.likely(w) == -math.inf]
        alike = [w for w in every if self.likely(w) > -math.inf]
        self.background = Automaton(others)
        back = [w for w in alike if not self.passes(w)]
        if back:
            self.background = Automaton(others + back)

    def likely(self, word: list[str]) -> float:
        """Log likelihood of the formats that take the word for their own, all formats being equally likely; -inf if none does."""
        scores = {k: a.score(word) for k, a in self.formats.items()}
        best = max((x for k, x in scores.items() if x >= self.floors[k]), default=-math.inf)
        return best - math.log(len(self.formats)) if self.formats else -math.inf

    def passes(self, word: list[str]) -> bool:
        found = self.likely(word)
        return found > -math.inf and found - self.background.score(word) > -math.log(FALSE_ALARMS)

    def accepts(self, token: str) -> bool:
        return self.passes(self.read(token))


def rank(value: str) -> int:
    """A hash by which values are drawn, whatever their document."""
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "replace"), digest_size=7).digest())


class Least:
    """Of each kind the distinct values of least rank, in order of first sight; what is offered and is among them is new."""

    def __init__(self, most: int):
        self.most, self.heaps, self.held = most, {}, {}

    def add(self, kind: str, value: str) -> int | None:
        """The value's rank if it is new and among the least so far, else None."""
        heap, held = self.heaps.setdefault(kind, []), self.held.setdefault(kind, set())
        if value in held:
            return None
        n = rank(value)
        if len(heap) < self.most:
            heapq.heappush(heap, (-n, value))
        elif n < -heap[0][0]:
            held.discard(heapq.heappushpop(heap, (-n, value))[1])
        else:
            return None
        held.add(value)
        return n


def infer_grammars(docs: DataFrame, train_tokens: int = TRAIN_TOKENS) -> Grammars:
    """Fit on at most train_tokens distinct values of each kind, of all documents, those of least rank. Values are read up to TRAIN_CHARS."""

    def make():
        least = Least(train_tokens)

        def step(texts):
            out = []
            for text in texts:
                text = text or ""
                values = {(KINDS[s[1]], credential(text, s)) for s in base_spans(text)}
                taken = {v for _, v in values}
                values |= {("ordinary", t) for t in long_tokens(text) if t not in taken and not any(v in t for v in taken)}
                for kind, value in values:
                    value = value[:TRAIN_CHARS]
                    if (n := least.add(kind, value)) is not None:
                        out.append((kind, value, n))
            return [list(c) for c in zip(*out)] or [[], [], []]

        return step

    # a task gives train_tokens values of a kind and, by the logarithm of its rows, some that later ones displace
    found = materialize(map_columns(docs.select("text"), make, "kind string, value string, rank long"), "secret-values")
    # a rank's power of two below which there are enough values: no kind's values are ever brought together but the least
    counted = found.groupBy("kind", F.length(F.bin("rank")).alias("bits")).agg(F.approx_count_distinct("rank", 0.02).alias("n")).collect()  # at most 4 x 57 rows
    upto: dict[str, int] = {}
    for kind in {r["kind"] for r in counted}:
        n = 0
        for r in sorted((r for r in counted if r["kind"] == kind), key=lambda r: r["bits"]):
            upto[kind], n = r["bits"], n + r["n"]
            if n >= 1.2 * train_tokens:
                break
    low = [(F.col("kind") == k) & (F.length(F.bin("rank")) <= bits) for k, bits in upto.items()]
    values: dict[str, list[str]] = {}
    if low:
        some = found.filter(functools.reduce(lambda a, b: a | b, low)).select("kind", "rank", "value").distinct()
        # about 2.4 x train_tokens values a kind, each of TRAIN_CHARS characters at most, as every bit more doubles their number
        for kind, n, value in sorted(map(tuple, some.collect())):
            if len(values.setdefault(kind, [])) < train_tokens:
                values[kind].append(value)
    ordinary = values.pop("ordinary", [])
    return Grammars(values, ordinary)


class Scanner:
    """All spans of a text; one per task. Verdicts on tokens are remembered, at most CACHE of them."""

    CACHE = 100_000

    def __init__(self, grammars: Grammars):
        self.grammars, self.known = grammars, {}

    def suspicious(self, token: str) -> int:
        """The length of the longest candidate in the token that looks like a credential, 0 if none does."""
        if token not in self.known:
            if len(self.known) >= self.CACHE:
                self.known.clear()
            self.known[token] = next((len(c) for c in candidates(token) if self.grammars.accepts(c)), 0)
        return self.known[token]

    def spans(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """Base spans, and all spans, as (start, kind number, end)."""
        base = base_spans(text)
        hot = {t: n for t in long_tokens(text) if (n := self.suspicious(t))}
        if not hot:
            return base, base
        more, k = [], 0
        ends = sorted((s, e) for s, _, e in base)
        for m in _candidate.finditer(text):
            if m[0] in hot:
                start = m.end() - hot[m[0]]
                while k < len(ends) and ends[k][1] <= start:
                    k += 1
                # an assignment may hold a run of hex digits, so look a little further than the next span
                if not any(s < m.end() and start < e for s, e in ends[k : k + 4]):
                    more.append((start, 3, m.end()))
        return base, sorted(base + more)


def said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, grammars: Grammars | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: a row per row of docs.

    Null and empty texts have no spans. Without credentials or ordinary tokens to learn from, there are only base spans.
    Repeated rows are scanned alike, texts whole. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(grammars or infer_grammars(docs))  # bounded by the training bounds

    def make():
        scanner = Scanner(shared.value)

        def step(ids, texts):
            found = [scanner.spans(t or "") for t in texts]
            counts = [[sum(s[1] == k for s in base) for base, _ in found] for k in range(3)]
            return [ids, *counts, [hashlib.sha256(said(b).encode()).hexdigest() for b, _ in found], [said(every) for _, every in found]]

        return step

    return map_columns(docs, make, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs, all columns, with each run of overlapping spans of ``text`` replaced by mark, and ``n_chars`` counted anew if there is one.

    Null and empty texts stay as they are, repeated rows are redacted alike, and no rows give none. Other columns are untouched.
    """
    shared = docs.sparkSession.sparkContext.broadcast(infer_grammars(docs))

    def clean(scanner: Scanner, text: str | None) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for s, _, e in scanner.spans(text)[1]:
            if s >= at:
                out += [text[at:s], mark]
            at = max(at, e)
        return "".join(out) + text[at:]

    @F.pandas_udf("string")
    def cleaned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(shared.value)
        for texts in batches:
            yield texts.map(lambda t: clean(scanner, t))

    out = docs.withColumn("text", cleaned("text"))
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out
