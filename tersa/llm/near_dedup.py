"""Near-duplicate classes by banded MinHash with sequential Bayesian verification.

Documents with equal shingle sets are one class from the start. Each class has HASHES minhashes, cut into bands; classes
that share a band are candidates. Candidates are compared by their signatures batch by batch, and dropped as soon as the
posterior probability of the wanted similarity falls below EPSILON; survivors are verified on the full shingle sets.

A band's bucket never turns into all its pairs. In each of ROUNDS rounds every bucket that still spans several components
compares one centre with its members of other components; centres that are done leave it. What is left after these rounds
(members of the lesser components of a bucket against those of others) is compared exhaustively, so no candidate link
between different components is lost; the join's own condition compares parity maps of the sets, so that it makes no rows
for pairs that cannot be alike enough. Links that cannot change a component are not looked for; ``links`` counts those verified.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tersa.llm.common import discard, map_columns, materialize, salted_join

#: 30 bands of 5 rows miss a pair of similarity 0.8 with probability (1 - 0.8^5)^30 < 1e-5.
BANDS, ROWS = 30, 5
HASHES = BANDS * ROWS
BATCH, EPSILON, ROUNDS, MAP_BITS, BLOCK = 30, 1e-6, 2, 1024, 512
SHINGLE, PERCENT = 2, 80
PRIME_SEED = 20_240_501


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, size: int, words: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; of all its words, if they are fewer than size."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower() lowers A-Z only
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter((words[w] for w in found), np.uint64, len(found))
    n = len(h) - size + 1
    if n < 1:
        n, size = 1, len(h)
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[k : k + n]
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return np.unique(out ^ (out >> np.uint64(32)))


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(PRIME_SEED)
    return random.integers(1, 1 << 63, HASHES, np.uint64) | np.uint64(1), random.integers(0, 1 << 63, HASHES, np.uint64)


def signature(items: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """HASHES minima of 32 bits, over items of any number, a block at a time."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(items), 512):
        block = items[at : at + 512, None] * a
        block += b
        low = np.minimum(low, block.min(0))
    return (low >> np.uint64(32)).astype(np.uint32)


def classes(docs: DataFrame, size: int = SHINGLE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows: doc_id, n_shingles, digest; classes: node, digest, cid, n, sig, bands per distinct non-empty set; repeated: ids of several rows).

    node is a number of the class's own, cid its least document.
    """

    def make():
        words, (a, b) = _Words(), _multipliers()

        def step(ids, texts):
            counts, digests, sigs, bands = [], [], [], []
            for text in texts:
                items = shingles(text, size, words)
                counts.append(len(items))
                digests.append(digest_of(items))
                if len(items):
                    s = signature(items, a, b)
                    sigs.append((s & np.uint32(0xFF)).astype(np.uint8).tobytes())
                    bands.append([xxhash.xxh3_64_intdigest(row.tobytes(), k) - (1 << 63) for k, row in enumerate(s.reshape(BANDS, ROWS))])
                else:
                    sigs.append(None)
                    bands.append(None)
            return [ids, counts, digests, sigs, bands]

        return step

    schema = "doc_id long, n_shingles long, digest binary, sig binary, bands array<long>"
    # one pass over the texts; what it found is read again several times
    found = materialize(map_columns(docs.select(F.col("doc_id").cast("long"), "text"), make, schema), "dedup-signatures")
    named = found.filter("digest IS NOT NULL AND doc_id IS NOT NULL")
    # aggregated before the shuffle, so that a set of many rows is no heavy group; rows of a set have equal signatures
    per = named.groupBy("digest").agg(F.min("doc_id").alias("cid"), F.count("*").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    per = materialize(per.withColumn("node", F.monotonically_increasing_id()), "dedup-classes")
    repeated = materialize(found.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "dedup-repeated")
    return found.select("doc_id", "n_shingles", "digest"), per, repeated


def digest_of(items: np.ndarray) -> bytes | None:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest() if len(items) else None


def same_document(rows: DataFrame, per: DataFrame, repeated: DataFrame) -> DataFrame:
    """Links a, b between the classes of each id that has several texts: of the least of them to the others."""
    sets = salted_join(rows.filter("digest IS NOT NULL"), repeated, "doc_id", F.col("digest")).select("doc_id", "digest").distinct()
    nodes = sets.join(per.select("digest", "node"), "digest").select("doc_id", "node")
    nodes = materialize(nodes, "dedup-same")
    least = nodes.groupBy("doc_id").agg(F.min("node").alias("a"))
    return salted_join(nodes, least, "doc_id", F.col("node")).select("a", F.col("node").alias("b")).filter("a < b")


def class_texts(docs: DataFrame, near: DataFrame, repeated: DataFrame, size: int) -> DataFrame:
    """node, text: a text of each class of near (node, cid, digest), from the rows of its least document."""
    found = docs.select(F.col("doc_id").cast("long").alias("cid"), "text").filter("cid IS NOT NULL")
    if not repeated.head(1):
        # texts are moved by id at every size of the corpus
        return found.join(near.select("cid", "node").hint("shuffle_merge"), "cid").select("node", "text")
    again = repeated.withColumnRenamed("doc_id", "cid").withColumn("again", F.lit(True))
    once = found.join(near.select("cid", "node").hint("shuffle_merge"), "cid").join(again, "cid", "left_anti").select("node", "text")

    def make():
        words = _Words()
        return lambda ids, texts: [ids, [digest_of(shingles(t, size, words)) for t in texts], texts]

    # an id with several texts may be the least document of several classes, so its texts are told apart by their sets
    told = map_columns(salted_join(found, again, "cid", F.col("text")).select("cid", "text"), make, "cid long, digest binary, text string")
    several = told.groupBy("cid", "digest").agg(F.min("text").alias("text")).join(near, ["cid", "digest"]).select("node", "text")
    return once.unionByName(several)


def least_matches(percent: int = PERCENT, epsilon: float = EPSILON) -> list[int]:
    """Per number of batches compared: the fewest equal signature bytes at which the similarity may still reach percent.

    Signatures keep 8 bits a hash, so hashes of unequal items agree with probability 1/256. The prior of the similarity is
    uniform; P(s >= percent | k of n equal) is taken by numeric integration of the binomial likelihood.
    """
    s = (np.arange(4000) + 0.5) / 4000
    p = s + (1 - s) / 256
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        k = np.arange(n + 1)[:, None]
        like = k * np.log(p) + (n - k) * np.log1p(-p + 1e-15)
        like = np.exp(like - like.max(1, keepdims=True))
        tail = like[:, s * 100 >= percent].sum(1) / like.sum(1)
        out.append(int(np.argmax(tail >= epsilon)))
    return out


def prune(pairs: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b (a written table) whose signatures leave the wanted similarity possible; batches are compared until one rules a pair out."""
    least = least_matches(percent)
    both = with_ends(pairs, signatures, "sig")

    def make():
        def step(a, b, x, y):
            same = np.frombuffer(b"".join(x), np.uint8).reshape(-1, HASHES), np.frombuffer(b"".join(y), np.uint8).reshape(-1, HASHES)
            alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
            for k, bound in enumerate(least):
                part = slice(k * BATCH, (k + 1) * BATCH)
                matches[alive] += (same[0][alive, part] == same[1][alive, part]).sum(1)
                alive = alive[matches[alive] >= bound]
            return [[a[k] for k in alive], [b[k] for k in alive]]

        return step

    return map_columns(both.select("a", "b", "sig_a", "sig_b"), make, "a long, b long", rows=4096)


def with_ends(pairs: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """pairs a, b with the column of that name of either node; a centre may stand in very many pairs."""
    total = pairs.count()
    one = salted_join(pairs, found.select(F.col("node").alias("a"), F.col(name).alias(f"{name}_a")), "a", F.col("b"), total=total)
    per = pairs.groupBy("b").agg(F.count("*").alias("n"))
    return salted_join(one, found.select(F.col("node").alias("b"), F.col(name).alias(f"{name}_b")), "b", F.col("a"), counts=per, total=total)


def verify(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs a, b (a written table) whose full shingle sets are similar enough: 100 * intersection >= percent * union."""
    both = with_ends(pairs, texts, "text")

    def make():
        words = _Words()

        def step(a, b, x, y):
            sets: dict[tuple, np.ndarray] = {}  # of this batch: many pairs share a centre

            def of(i, text):
                if (i, len(text or "")) not in sets:
                    sets[i, len(text or "")] = shingles(text, size, words)
                return sets[i, len(text or "")]

            keep = []
            for k in range(len(a)):
                u, v = of(a[k], x[k]), of(b[k], y[k])
                common = len(np.intersect1d(u, v, assume_unique=True))
                if common and 100 * common >= percent * (len(u) + len(v) - common):
                    keep.append(k)
            return [[a[k] for k in keep], [b[k] for k in keep]]

        return step

    return map_columns(both.select("a", "b", "text_a", "text_b"), make, "a long, b long").distinct()


def components(links: DataFrame, label: str) -> DataFrame:
    """node, comp: the least node reachable, for each node of links a, b.

    Every round maps nodes to the least neighbour, doubles the jump, and contracts the links to those between different
    labels; chains halve at least, so rounds grow with the logarithm of the longest chain. A round's tables are deleted
    when the next has been written.
    """
    labels = None
    edges = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), f"{label}-edges")
    while True:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).union(edges.select(F.col("b"), F.col("a")))
        parent = materialize(both.groupBy("node").agg(F.least(F.min("to"), F.first("node")).alias("comp")), f"{label}-parents")
        if labels is not None and not parent.head(1):
            discard(edges, parent)
            return labels
        up = parent.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
        jumped = materialize(salted_join(parent, up, "comp", F.col("node"), "left").select("node", F.coalesce("top", "comp").alias("comp")), f"{label}-jumps")
        if labels is None:
            if not jumped.head(1):
                return jumped
            labels = jumped
        else:
            move = jumped.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
            old = labels
            labels = materialize(salted_join(old, move, "comp", F.col("node"), "left").select("node", F.coalesce("top", "comp").alias("comp")), f"{label}-labels")
            discard(old)
        to = jumped.select(F.col("node").alias("a"), F.col("comp").alias("x"))
        other = jumped.select(F.col("node").alias("b"), F.col("comp").alias("y"))
        total = edges.count()
        ends = salted_join(edges, to, "a", F.col("b"), total=total)
        ends = salted_join(ends, other, "b", F.col("a"), counts=edges.groupBy("b").agg(F.count("*").alias("n")), total=total)
        now = materialize(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a < b").distinct(), f"{label}-edges")
        discard(edges, parent, *([jumped] if jumped is not labels else []))
        edges = now


def parity_maps(texts: DataFrame, size: int) -> DataFrame:
    """node, n and m0, m1, ...: a class's shingles, and the parity of how many of them fall on each of MAP_BITS bits.

    A shingle that only one of two sets has changes one bit, so maps differ in at most as many bits as the sets have
    shingles not in common: a bound on the similarity that never rules out a pair which reaches it.
    """
    longs = MAP_BITS // 64

    def make():
        words = _Words()

        def step(ids, found):
            sets = [shingles(t, size, words) for t in found]
            shift = np.uint64(64 - MAP_BITS.bit_length() + 1)
            maps = [np.packbits((np.bincount((x >> shift).astype(np.int64), minlength=MAP_BITS) & 1).astype(np.uint8)).view(np.int64) for x in sets]
            return [ids, [len(x) for x in sets], *np.array(maps).reshape(-1, longs).T]

        return step

    return map_columns(texts.select("node", "text"), make, "node long, n long, " + ", ".join(f"m{k} long" for k in range(longs)))


def link_classes(docs: DataFrame, per: DataFrame, repeated: DataFrame, same: DataFrame | None, size: int, percent: int, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(links a, b between classes; node, comp). same: links between classes that are known from the start."""
    spark = docs.sparkSession
    banded = per.select("node", F.explode("bands").alias("bucket"))
    # a bucket of one class has no pairs; the centre is the least class of the others
    shared = banded.groupBy("bucket").agg(F.min("node").alias("centre"), F.max("node").alias("last"), F.count("*").alias("n")).filter("centre < last").select("bucket", "centre", "n")
    shared = materialize(shared, "dedup-shared")
    members = materialize(salted_join(banded, shared.drop("n"), "bucket", F.col("node"), counts=shared), "dedup-buckets")
    near = members.select("node").distinct()
    of_near = materialize(per.join(near, "node").select("node", "cid", "digest", "sig"), "dedup-near")
    signatures = of_near.select("node", "sig")
    texts = materialize(class_texts(docs, of_near.select("node", "cid", "digest"), repeated, size), "dedup-near-texts")
    tried = spark.createDataFrame([], "a long, b long")
    links = spark.createDataFrame([], "a long, b long")
    comps = components(same, "dedup") if same is not None else spark.createDataFrame([], "node long, comp long")

    def test(pairs: DataFrame, name: str) -> None:
        """Prune and verify pairs not tried before; new links may join components."""
        nonlocal tried, links, comps
        fresh = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"), f"dedup-pairs-{name}")
        likely = materialize(prune(fresh, signatures, percent), f"dedup-likely-{name}")
        found = materialize(verify(likely, texts, size, percent), f"dedup-links-{name}")
        discard(likely)
        tried = tried.union(fresh)
        if found.head(1):
            links = links.union(found)
            comps = components(links if same is None else links.union(same), "dedup")

    def with_components(left: DataFrame) -> DataFrame:
        # a class stands in at most BANDS buckets, so no key is hot
        return left.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))

    test(members.select(F.col("centre").alias("a"), F.col("node").alias("b")).filter("a <> b"), "0")
    left = members.filter("node <> centre").select("bucket", "node")
    for k in range(1, rounds):
        now = materialize(with_components(left), f"dedup-now-{k}")
        best = F.max(F.struct(F.xxhash64("node", F.lit(k)), F.col("node"), F.col("comp"))).alias("c")
        spans = now.groupBy("bucket").agg(best, F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).filter("lo < hi")
        spans = materialize(spans.select("bucket", "n", F.col("c.node").alias("centre"), F.col("c.comp").alias("centre_comp")), f"dedup-spans-{k}")
        open_ = materialize(salted_join(now, spans.drop("n"), "bucket", F.col("node"), counts=spans), f"dedup-open-{k}")
        discard(now)
        if not open_.head(1):
            return links, comps
        test(open_.filter("comp <> centre_comp").select(F.col("centre").alias("a"), F.col("node").alias("b")), str(k))
        left = open_.filter("node <> centre").select("bucket", "node")
    now = materialize(with_components(left), "dedup-rest-now")
    most = now.groupBy("bucket", "comp").count().groupBy("bucket").agg(F.max_by("comp", F.struct("count", "comp")).alias("most"), F.count("*").alias("spans"), F.sum("count").alias("n")).filter("spans > 1")
    most = materialize(most.select("bucket", "most", "n"), "dedup-most")
    open_ = materialize(salted_join(now, most.withColumnRenamed("n", "size"), "bucket", F.col("node"), counts=most), "dedup-rest")
    if open_.head(1):
        maps = materialize(parity_maps(texts.join(open_.select("node").distinct(), "node"), size), "dedup-maps")
        # a bucket's members are dealt to blocks, each of which the members of lesser components meet in a task of its own
        blocks = F.ceil(F.col("size") / BLOCK).cast("long")
        every = open_.withColumn("block", F.pmod(F.xxhash64("node"), blocks)).join(maps, "node").select("bucket", "block", "comp", F.col("node").alias("b"), *maps.columns[1:])
        lesser = open_.filter("comp <> most").join(maps, "node").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        lesser = lesser.select("bucket", "block", "comp", F.col("node").alias("a"), *maps.columns[1:])
        x, y = lesser.alias("x"), every.alias("y")
        apart = sum((F.bit_count(F.col(f"x.{m}").bitwiseXOR(F.col(f"y.{m}"))) for m in maps.columns if m.startswith("m")), F.lit(0))
        near_enough = apart * (100 + percent) <= (F.col("x.n") + F.col("y.n")) * (100 - percent)
        met = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.block") == F.col("y.block"))
        test(x.join(y, met & (F.col("x.comp") != F.col("y.comp")) & near_enough).select("a", "b"), "rest")
    return links, comps


def deduplicate(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, links, kept: a row per row of docs.

    Null texts and texts without words have no shingles and are linked with nothing. Rows that share an id are one
    document: what any of its texts is linked with is in its component, and all its rows have that component. links counts
    the verified links of a row's text with other texts. Rows without an id are linked with nothing: their component is
    null and they are not kept by id. kept is true for every row whose id is its component's. Other columns are ignored.
    """
    rows, per, repeated = classes(docs, size)
    several = bool(repeated.head(1))
    same = materialize(same_document(rows, per, repeated), "dedup-same-links") if several else None
    links, comps = link_classes(docs, per, repeated, same, size, percent)
    per = per.select("node", "digest", "cid", "n")
    # a component's id is its least document's; class by class, then one join of all rows by digest
    own = materialize(comps.join(per.select("node", "cid"), "node"), "dedup-comps")
    least = own.groupBy("comp").agg(F.min("cid").alias("least"))
    named = salted_join(own, least, "comp", F.col("node")).select("node", "least")
    ends = links.select(F.col("a").alias("node")).union(links.select(F.col("b"))).groupBy("node").agg(F.count("*").alias("links"))
    known = materialize(per.join(named, "node", "left").join(ends, "node", "left").select("digest", "n", F.coalesce("least", "cid").alias("component_id"), "links"), "dedup-known")
    out = salted_join(rows, known.drop("n"), "digest", F.col("doc_id"), "left", counts=known.select("digest", "n"))
    if several:
        # an id's texts are in one component; its rows without words are told by the id
        ids = salted_join(rows.filter("digest IS NOT NULL"), repeated, "doc_id", F.col("digest")).select("doc_id", "digest").distinct()
        told = ids.join(known.select("digest", "component_id"), "digest").groupBy("doc_id").agg(F.min("component_id").alias("told"))
        out = salted_join(materialize(out, "dedup-rows"), told, "doc_id", F.xxhash64("digest", "n_shingles"), "left").withColumn("component_id", F.coalesce("told", "component_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns, of which one document of each component stays, and one row of each id that repeats.

    That row is the one of the least hash of its text, any of those alike. Rows without an id stay, as nothing links
    them. Rows travel as structs, so columns may have any names. No rows give none.
    """
    kept = deduplicate(docs, size, percent).filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("hash"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    # aggregated before the shuffle: the rows of one id may be very many
    one = rows.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min_by("row", "hash").alias("row"))
    return one.join(kept, "doc_id").select("row.*").unionByName(rows.filter("doc_id IS NULL").select("row.*"))
