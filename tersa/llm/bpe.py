"""BPE encoding and decoding with a memory-mapped lexicon of frequent words.

Words are counted over all documents; the frequent ones, and those that the tokenizer knows whole, are compiled with their
ids into a minimal acyclic transducer: states with equal continuations are shared (Daciuk's construction over sorted words),
and each arc carries the number of words that sort before it, so that the sum along a word is its rank, and the rank finds
its ids. These arrays, the merges and the tokens' bytes are one file, which SparkFiles brings to each executor, where it is
mapped, not loaded. Words outside the lexicon are merged exactly, pair by pair. What a worker remembers of words met before
is bounded by CACHE entries beside those of the batch at hand.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tersa.llm.common import map_columns, materialize, shared_dir
from tersa.llm.store import place

#: The pre-tokenizer's pattern (fixed values); L and N stand for the Unicode classes of letters and numbers.
PIECES = r"'(?:s|t|re|ve|m|ll|d)| ?[{L}]+| ?[{N}]+| ?[^\s{L}{N}]+|\s+(?!\S)|\s+"
CACHE, WIDE = 300_000, 32
#: Pairs of long words that a worker remembers, and ids that are decoded at once.
PAIRS_MET, DECODED = 16_384, 65_536
#: Frequent words of a corpus that are compiled, at most; longer words, in bytes, are always merged.
FREQUENT, LONGEST = 65_536, 64


def pieces_pattern(end: int) -> str:
    """PIECES for Python's re, which has no Unicode classes: they are spelt out as ranges of code points below end.

    Below 0x10000 re tests a class by a bitmap; ranges beyond it are tried one by one.
    """
    import regex

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, end))))
    spelt = {k: "".join(f"{re.escape(m[0])}-{re.escape(m[-1])}" for m in regex.findall(p, every)) for k, p in (("L", r"\p{L}+"), ("N", r"\p{N}+"), ("S", r"\s+"))}
    return PIECES.replace(r"[^\s{L}{N}]", "[^{S}{L}{N}]").replace(r"\S", "[^{S}]").replace(r"\s", "[{S}]").format(**spelt)


def byte_chars() -> dict[int, str]:
    """Byte -> the printable character that stands for it in byte-level vocabularies: itself, or the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def packed(arrays: dict[str, np.ndarray]) -> bytes:
    """One file: a JSON line with the arrays' places, then the arrays, each at a multiple of 8 bytes."""
    at, head = 0, {}
    for name, a in arrays.items():
        head[name] = [a.dtype.str, len(a), at]
        at += -(-a.nbytes // 8) * 8
    line = json.dumps(head).encode().ljust(1023) + b"\n"
    return line + b"".join(a.tobytes().ljust(-(-a.nbytes // 8) * 8, b"\0") for a in arrays.values())


def mapped(path: str) -> dict[str, np.ndarray]:
    """The arrays of such a file; their pages stay the file's."""
    with open(path, "rb") as f:
        head = json.loads(f.read(1024))
    whole = np.memmap(path, dtype=np.uint8, mode="r").view(np.ndarray)
    return {n: whole[1024 + at : 1024 + at + size * np.dtype(kind).itemsize].view(kind) for n, (kind, size, at) in head.items()}


class Transducer:
    """A minimal acyclic automaton over bytes in arrays: arcs sorted by (state, byte), each with a target and a skip count."""

    FIELDS = ("keys", "targets", "skips", "final", "starts", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]):
        for name in self.FIELDS:
            setattr(self, name, arrays[name])

    @classmethod
    def build(cls, words: dict[bytes, list[int]]) -> Transducer:
        order = sorted(words)
        register: dict[tuple, int] = {}
        arcs: list[dict[int, int]] = [{}]
        final = [False]
        path: list[tuple[int, int]] = []  # (parent, byte) of the last word's states that may still grow

        def settle(depth: int) -> None:
            while len(path) > depth:
                parent, byte = path.pop()
                child = arcs[parent][byte]
                shape = (final[child], tuple(arcs[child].items()))
                arcs[parent][byte] = register.setdefault(shape, child)

        last = b""
        for word in order:
            common = len(os.path.commonprefix([last, word]))
            settle(common)
            at = arcs[path[-1][0]][path[-1][1]] if path else 0
            for byte in word[common:]:
                arcs.append({})
                final.append(False)
                arcs[at][byte] = len(arcs) - 1
                path.append((at, byte))
                at = len(arcs) - 1
            final[at] = True
            last = word
        settle(0)
        number = {0: 0}
        for state in register.values():
            number.setdefault(state, len(number))
        below: dict[int, int] = {}

        def count(state: int) -> int:
            stack = [state]
            while stack:
                s = stack[-1]
                open_ = [t for t in arcs[s].values() if t not in below]
                if open_:
                    stack += open_
                else:
                    below[s] = final[s] + sum(below[t] for t in arcs[s].values())
                    stack.pop()
            return below[state]

        count(0)
        rows, ends = [], np.zeros(len(number), bool)
        for state, k in number.items():
            ends[k], skip = final[state], int(final[state])
            for byte, target in arcs[state].items():
                rows.append((k << 8 | byte, number[target], skip))
                skip += below[target]
        rows.sort()
        table = np.array(rows, np.int64).reshape(-1, 3)
        counts = [len(words[w]) for w in order]
        return cls(
            {
                "keys": table[:, 0].copy(),
                "targets": table[:, 1].astype(np.int32),
                "skips": table[:, 2].astype(np.int32),
                "final": ends,
                "starts": np.concatenate([[0], np.cumsum(counts)]).astype(np.int32),
                "ids": np.array([i for w in order for i in words[w]], np.int32),
            }
        )

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word, -1 for those outside; all words walk the automaton side by side, a byte at a time."""
        out = np.full(len(words), -1, np.int64)
        if not len(self.keys) or not words:
            return out
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        data = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        alive = np.flatnonzero(lengths > 0)
        state, rank = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        depth = 0
        while len(alive):
            key = state[alive] << 8 | data[offsets[alive] + depth]
            found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[found] == key
            alive, found = alive[hit], found[hit]
            rank[alive] += self.skips[found]
            state[alive] = self.targets[found]
            depth += 1
            ended = lengths[alive] == depth
            done = alive[ended]
            done = done[self.final[state[done]]]
            out[done] = rank[done]
            alive = alive[~ended]
        return out


class Pairs:
    """Merges in arrays, which may be mapped: a << 32 | b of each pair, ascending, with rank << 32 | id of what it becomes."""

    FIELDS = ("merges", "results")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.merges, self.results = (arrays[n] for n in self.FIELDS)
        self.met: dict[tuple[int, int], tuple[int, int, int, int] | None] = {}

    @classmethod
    def of(cls, pairs: dict[tuple[int, int], tuple[int, int, int, int]]) -> Pairs:
        rows = sorted((a << 32 | b, p[0] << 32 | p[1]) for (a, b), p in pairs.items())
        table = np.array([*rows, (np.iinfo(np.int64).max, 0)], np.int64)  # the last is found for all that are beyond
        return cls({"merges": table[:, 0].copy(), "results": table[:, 1].copy()})

    def get(self, pair: tuple[int, int]) -> tuple[int, int, int, int] | None:
        """(rank, id, a, b) of one pair, None if it is no merge."""
        if pair not in self.met:
            if len(self.met) >= PAIRS_MET:
                self.met.clear()
            key = pair[0] << 32 | pair[1]
            at = self.merges.searchsorted(key)
            value = int(self.results[at])
            self.met[pair] = (value >> 32, value & 0xFFFFFFFF, *pair) if self.merges[at] == key else None
        return self.met[pair]


class Merger:
    """Byte-pair merges of one word, lowest rank first, leftmost first among equals."""

    def __init__(self, singles: list[int], pairs: dict[tuple[int, int], tuple[int, int, int, int]] | Pairs):
        self.singles, self.pairs = singles, pairs

    def __call__(self, word: bytes) -> list[int]:
        parts = [self.singles[b] for b in word]
        if len(parts) > 48:
            return self._long(parts)
        get = self.pairs.get
        while len(parts) > 1:
            best = min(filter(None, map(get, zip(parts, parts[1:]))), default=None)
            if best is None:
                break
            new, out, k, n = best[1], [], 0, len(parts)
            a, b = best[2], best[3]
            while k < n:
                if parts[k] == a and k + 1 < n and parts[k + 1] == b:
                    out.append(new)
                    k += 2
                else:
                    out.append(parts[k])
                    k += 1
            parts = out
        return parts

    def _long(self, parts: list[int]) -> list[int]:
        """The same through a heap of pairs and a linked list: n log n for words of any length."""
        n, get = len(parts), self.pairs.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(p[0], k, parts[k], parts[k + 1], p[1]) for k in range(n - 1) if (p := get((parts[k], parts[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, a, b, new = heapq.heappop(heap)
            j = after[k] if parts[k] == a else -1
            if j < 0 or parts[j] != b:
                continue
            parts[k], parts[j] = new, -1
            after[k] = after[j]
            if after[k] >= 0:
                before[after[k]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y >= 0 and (p := get((parts[x], parts[y]))):
                    heapq.heappush(heap, (p[0], x, parts[x], parts[y], p[1]))
        return [p for p in parts if p >= 0]


class ManyMerger:
    """Merger for many short words side by side, a merge of each word per round."""

    def __init__(self, singles: list[int], pairs: dict[tuple[int, int], tuple[int, int, int, int]] | Pairs):
        self.singles = np.array(singles, np.int64)
        self.pairs = pairs if isinstance(pairs, Pairs) else Pairs.of(pairs)
        self.none = np.iinfo(np.int64).max

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """rank << 32 | new id of each pair, or `none`."""
        key = np.where((a >= 0) & (b >= 0), a << 32 | (b & 0xFFFFFFFF), -1)
        at = np.searchsorted(self.pairs.merges, key)
        return np.where(self.pairs.merges[at] == key, self.pairs.results[at], self.none)

    def __call__(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word; words of like length go together."""
        out: list[list[int]] = [[]] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        for start in range(0, len(order), 4096):
            some = order[start : start + 4096]
            for k, ids in zip(some.tolist(), self._block([words[k] for k in some.tolist()], lengths[some])):
                out[k] = ids
        return out

    def _block(self, words: list[bytes], lengths: np.ndarray) -> list[list[int]]:
        wide = max(2, int(lengths.max()))
        raw = np.frombuffer(b"".join(w.ljust(wide, b"\0") for w in words), np.uint8).reshape(len(words), wide)
        column = np.arange(wide)
        ids = np.where(column < lengths[:, None], self.singles[raw], -1)
        ranks = np.full((len(words), wide), self.none)
        ranks[:, :-1] = self._ranks(ids[:, :-1], ids[:, 1:])
        rows = np.arange(len(words))
        while len(rows):
            best = ranks[rows].argmin(1)
            value = ranks[rows, best]
            on = value != self.none
            rows, best, value = rows[on], best[on], value[on]
            if not len(rows):
                break
            # the right half of each pair goes, what follows moves up
            take = np.minimum(column + (column > best[:, None]), wide - 1)
            moved = np.take_along_axis(ids[rows], take, 1)
            moved[:, -1] = -1
            moved[np.arange(len(rows)), best] = value & 0xFFFFFFFF
            ids[rows] = moved
            moved_ranks = np.take_along_axis(ranks[rows], take, 1)
            moved_ranks[:, -1] = self.none
            ranks[rows] = moved_ranks
            k = np.arange(len(rows))
            right = np.minimum(best + 1, wide - 1)
            ranks[rows, best] = np.where(best < wide - 1, self._ranks(moved[k, best], moved[k, right]), self.none)
            left = np.maximum(best - 1, 0)
            ranks[rows, left] = np.where(best > 0, self._ranks(moved[k, left], moved[k, best]), ranks[rows, left])
        return [r[: n].tolist() for r, n in zip(ids, (ids >= 0).sum(1).tolist())]


class Vocabulary:
    """What a tokenizer file says, bounded by that file: merges, token bytes, special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        of = {c: b for b, c in byte_chars().items()}
        vocab = model["model"]["vocab"]
        self.added = model.get("added_tokens", [])
        self.special = {t["content"]: t["id"] for t in self.added}
        self.bytes: dict[int, bytes] = {i: bytes(of[c] for c in t) for t, i in vocab.items() if t not in self.special}
        self.singles = [vocab[c] for _, c in sorted(byte_chars().items())]
        self.pairs = {}
        for rank, pair in enumerate(model["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            if a in vocab and b in vocab and a + b in vocab:
                self.pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b], vocab[a], vocab[b]))

    def lexicon(self, pieces: set[str] = frozenset()) -> dict[bytes, list[int]]:
        """Ids of the words with an id of their own, which merge into one token, and of the given pieces."""
        merge = Merger(self.singles, self.pairs)
        known = {w: [i] for i, w in self.bytes.items() if merge(w) == [i]}
        return known | {w: merge(w) for w in (p.encode() for p in pieces) if w not in known}

    def tokens(self) -> dict[str, np.ndarray]:
        """The bytes of all tokens, by id, and where each begins; special tokens stand for their own strings."""
        of = self.bytes | {i: t.encode() for t, i in self.special.items()}
        every = [of.get(i, b"") for i in range(max(of, default=-1) + 1)]
        return {"token_data": np.frombuffer(b"".join(every), np.uint8), "token_starts": np.cumsum([0, *map(len, every)]).astype(np.int64)}

    def added_pattern(self) -> str | None:
        """The added tokens' strings, the longest first, with the white space or the bounds that their flags ask for."""

        def one(t: dict) -> str:
            p = re.escape(t["content"])
            p = rf"(?<!\w){p}(?!\w)" if t.get("single_word") else p
            return r"\s*" * bool(t.get("lstrip")) + p + r"\s*" * bool(t.get("rstrip"))

        return "|".join(map(one, sorted(self.added, key=lambda t: -len(t["content"])))) or None


class Encoder:
    """Encodes and decodes texts by the arrays of a lexicon's file; one per task."""

    def __init__(self, arrays: dict[str, np.ndarray], vocabulary: dict, cache: int = CACHE):
        self.lexicon, self.cache_size = Transducer(arrays), cache
        pairs = Pairs(arrays)
        self.merge = Merger(vocabulary["singles"], pairs)
        self.merge_many = ManyMerger(vocabulary["singles"], pairs)
        self.special = vocabulary["special"]
        self.token_data, self.token_starts = arrays["token_data"], arrays["token_starts"]
        self.narrow, self.wide = (re.compile(p).findall for p in vocabulary["patterns"])
        self.beyond = re.compile("[\U00010000-\U0010ffff]").search
        self.cut = re.compile(f"({vocabulary['added']})").split if vocabulary["added"] else None
        self.known: dict[str, str] = {}

    def pieces(self, text: str) -> list[str]:
        return self.wide(text) if self.beyond(text) else self.narrow(text)

    def learn(self, pieces: list[str]) -> None:
        """Ids, as text, of pieces not met before: from the lexicon, or merged."""
        words = [p.encode("utf-8", "replace") for p in pieces]
        ranks = self.lexicon.ranks(words)
        starts, ids = self.lexicon.starts, self.lexicon.ids
        rest = []
        for k, r in enumerate(ranks.tolist()):
            if r >= 0:
                self.known[pieces[k]] = ",".join(map(str, ids[starts[r] : starts[r + 1]].tolist()))
            elif len(words[k]) > WIDE:
                self.known[pieces[k]] = ",".join(map(str, self.merge(words[k])))
            else:
                rest.append(k)
        for k, found in zip(rest, self.merge_many([words[k] for k in rest])):
            self.known[pieces[k]] = ",".join(map(str, found))

    def encode(self, texts: list[str]) -> list[str]:
        """The ids of each text, in decimal, joined by commas."""
        out = []
        cut_texts = [self.cut(t) if self.cut else [t] for t in texts]
        pieces = [[p if k % 2 else self.pieces(p) for k, p in enumerate(parts)] for parts in cut_texts]
        new = {p for parts in pieces for some in parts[::2] for p in some if p not in self.known}
        if len(self.known) + len(new) > self.cache_size:
            self.known.clear()
            new = {p for parts in pieces for some in parts[::2] for p in some}
        self.learn(list(new))
        known = self.known
        for parts in pieces:
            out.append(",".join([s for k, some in enumerate(parts) if some for s in ([str(self.special[some] if some in self.special else self.special[some.strip()])] if k % 2 else [known[p] for p in some])]))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        out = []
        for k in range(0, len(ids), DECODED):
            some = ids[k : k + DECODED]
            starts = self.token_starts[some]
            lengths = self.token_starts[some + 1] - starts
            ends = lengths.cumsum()
            out.append(self.token_data[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1])].tobytes())
        return b"".join(out).decode("utf-8", "replace")


def frequent_words(docs: DataFrame, most: int = FREQUENT) -> list[str]:
    """At most ``most`` words, cut at white space, that occur often in all documents: all that occur 2^k times, for the least such k."""
    words = docs.select(F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("word")).filter((F.col("word") != "") & (F.octet_length("word") <= LONGEST))
    counted = materialize(words.groupBy("word").agg(F.count("*").alias("n")).filter("n > 1"), "bpe-words")
    bits = F.length(F.bin("n"))
    least, taken = 64, 0
    for r in sorted(counted.groupBy(bits.alias("bits")).agg(F.count("*").alias("words")).collect(), reverse=True):  # a row per power of two
        if (taken := taken + r["words"]) > most:
            break
        least = r["bits"]
    return [r["word"] for r in counted.filter(bits >= least).select("word").collect()]  # `most` words of LONGEST bytes at most


def prepare(spark: SparkSession, vocabulary_path: str, words: list[str] = ()):
    """Compile the lexicon on the driver, add its file with the vocabulary's arrays to SparkFiles and broadcast the patterns.

    All are bounded by the vocabulary file and the number of frequent words.
    """
    v = Vocabulary(vocabulary_path)
    narrow, wide = pieces_pattern(0x10000), pieces_pattern(0x110000)
    find, beyond = (re.compile(narrow).findall, re.compile(wide).findall), re.compile("[\U00010000-\U0010ffff]").search
    pieces = {p for w in words for p in find[bool(beyond(w))](f" {w}")}
    transducer = Transducer.build(v.lexicon(pieces))
    # a name per content, so that a worker that has the file never gets another under its name
    pairs = Pairs.of(v.pairs)
    data = packed({n: getattr(x, n) for x in (transducer, pairs) for n in x.FIELDS} | v.tokens())
    name = f"tersa-lexicon-{hashlib.sha256(data).hexdigest()[:24]}.bin"
    if name not in getattr(spark, "_tersa_lexicons", set()):
        uri = f"{shared_dir(spark)}/{name}"
        system, path = place(uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        with system.open_output_stream(path, compression=None) as f:
            f.write(data)
        spark.sparkContext.addFile(uri)
        spark._tersa_lexicons = getattr(spark, "_tersa_lexicons", set()) | {name}
    shared = spark.sparkContext.broadcast({"patterns": [narrow, wide], "singles": v.singles, "special": v.special, "added": v.added_pattern()})
    return name, shared


def encode_documents(docs: DataFrame, vocabulary_path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, an array, if asked for): a row per row of docs.

    Null and empty texts have no ids and decode to the empty text; an empty table gives no rows. Added tokens' strings in a text become those
    tokens. Texts are encoded whole, of any length. Repeated rows are encoded alike. Other columns are ignored.
    """
    name, shared = prepare(docs.sparkSession, vocabulary_path, frequent_words(docs))

    def make():
        encoder = Encoder(mapped(SparkFiles.get(name)), shared.value)

        def step(doc_ids, texts):
            said = encoder.encode([t or "" for t in texts])
            ids = [np.fromstring(s, np.int32, sep=",") for s in said]
            columns = [
                doc_ids,
                list(map(len, ids)),
                [hashlib.sha256(s.encode()).hexdigest() for s in said],
                [hashlib.sha256(encoder.decode(i).encode()).hexdigest() for i in ids],
            ]
            return [*columns, ids] if with_ids else columns

        return step

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return map_columns(docs.select(F.col("doc_id").cast("long"), "text"), make, schema)
