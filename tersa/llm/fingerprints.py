"""Document fingerprints by order MinHash, in DataFrame functions only.

A text is read as units, runs of at most UNIT characters without white space, and as k-mers of K units, of which the n-th
occurrence of each is told apart by its number. One hash of (k-mer, number) deals them into BINS bins and ranks them there;
of each bin the PICK least k-mers stay, in the order of the text, and the hash of this tuple is the bin's part of the
fingerprint. In short texts many bins have one k-mer, whose tuple knows no order; with ``borrow``, as the query has it, such
a bin takes its other k-mers from the bins after it. Two fingerprints are as like as the share of their bins with equal parts, so order counts as content does.

Occurrence numbers need no shuffle: a text's k-mers are sorted within its row, and lengths of runs of equal ones are found
by doubling steps, as many as the logarithm of the longest run. The next document by id is found within buckets of ids,
whose bounds are quantiles of all ids; each bucket also gets a copy of the next bucket's first row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, UNIT, BINS_LOG, PICK = 3, 16, 6, 2
PLACE = 28  # bits of a long for a unit's place in its text; a text has fewer units
PART = 26  # bits of a bin's part
BUCKET_ROWS, MAX_BUCKETS, COARSE = 1024, 20_000, 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _place(x: Column) -> Column:
    return x.bitwiseAND(F.lit((1 << PLACE) - 1).cast("long"))


def _pack(hash_: Column, place: Column) -> Column:
    """The hash's upper bits, then the place: sorts as the hash does."""
    return hash_.bitwiseAND(F.lit(-(1 << PLACE)).cast("long")).bitwiseOR(place.cast("long"))


def _key(x: Column) -> Column:
    return F.shiftright(x, PLACE)


def _bin(x: Column) -> Column:
    return F.shiftrightunsigned(x, 64 - BINS_LOG)


def kmer(units: Column, at: Column) -> Column:
    """Hash of K units from a place on; of those there are, in a text of fewer."""
    return F.xxhash64(*(F.get(units, at + k) for k in range(K)))


def occurrences(repeats: Column) -> Column:
    """For sorted packed k-mers, how many equal ones stand right before each."""
    first = F.transform(repeats, lambda x, j: F.when((j > 0) & (_key(x) == _key(F.get(repeats, j - 1))), 1).otherwise(0))

    def double(lengths: Column, k: Column) -> Column:
        reach = F.expr("1").cast("int") * F.pow(F.lit(2.0), k).cast("int")
        longer = F.transform(lengths, lambda n, j: F.when(n == reach, n + F.get(lengths, (j - reach).cast("int"))).otherwise(n))
        return F.when(F.array_contains(lengths, reach), longer).otherwise(lengths)

    return F.when(F.size(repeats) < 2, F.transform(repeats, lambda x: F.lit(0))).otherwise(F.aggregate(F.sequence(F.lit(0), F.lit(PLACE - 1)), first, double))


def ranked(kmers: Column) -> Column:
    """Sorted packed hashes of (k-mer, occurrence number), from sorted packed k-mers."""
    head = F.filter(kmers, lambda x, j: (j == 0) | (_key(x) != _key(F.get(kmers, j - 1))))
    tail = F.filter(kmers, lambda x, j: (j > 0) & (_key(x) == _key(F.get(kmers, j - 1))))
    heads = F.transform(head, lambda x: _pack(F.xxhash64(_key(x), F.lit(0)), _place(x)))
    tails = let(tail, lambda t: F.zip_with(t, occurrences(t), lambda x, n: _pack(F.xxhash64(_key(x), n + 1), _place(x))))
    return F.sort_array(F.concat(heads, tails))


def parts(units: Column, order: Column) -> Column:
    """The bins' parts, bin in the upper bits, from sorted packed ranks."""
    least = F.filter(order, lambda x, j: (j < PICK) | (_bin(F.get(order, j - PICK)) != _bin(x)))
    # by bin, and by place within a bin
    placed = F.sort_array(F.transform(least, lambda x: F.shiftleft(_bin(x), PLACE).bitwiseOR(_place(x))))

    def part(p: Column) -> Column:
        def one(x: Column, j: Column) -> Column:
            at = _key(x)
            again = [F.when(_key(F.get(p, j + k)) == at, kmer(units, _place(F.get(p, j + k)).cast("int"))) for k in range(1, PICK)]
            hash_ = F.xxhash64(kmer(units, _place(x).cast("int")), *again).bitwiseAND(F.lit((1 << PART) - 1).cast("long"))
            return F.when((j == 0) | (_key(F.get(p, j - 1)) != at), F.shiftleft(at, PART).bitwiseOR(hash_))

        return F.filter(F.transform(p, one), lambda x: x.isNotNull())

    return let(placed, part)


def borrowing_parts(units: Column, order: Column) -> Column:
    """As parts, but a bin with fewer than PICK k-mers takes the least of the bins after it, the last ones of the first, if the text has as many."""
    n = F.size(order)

    def one(x: Column, j: Column) -> Column:
        places = F.sort_array(F.transform(F.sequence(F.lit(0), F.least(n, F.lit(PICK)) - 1), lambda k: _place(F.get(order, ((j + k) % n).cast("int"))).cast("int")))
        hashes = let(places, lambda at: F.xxhash64(*(F.when(F.get(at, F.lit(k)).isNotNull(), kmer(units, F.get(at, F.lit(k)))) for k in range(PICK))))
        return F.when((j == 0) | (_bin(F.get(order, j - 1)) != _bin(x)), F.shiftleft(_bin(x), PART).bitwiseOR(hashes.bitwiseAND(F.lit((1 << PART) - 1).cast("long"))))

    return F.sort_array(F.filter(F.transform(order, one), lambda x: x.isNotNull()))


def fingerprint(text: Column, borrow: bool = False) -> Column:
    """At most 2^BINS_LOG longs of BINS_LOG + PART bits, one per bin that has k-mers; none for a text without units. borrow: see borrowing_parts."""
    take = borrowing_parts if borrow else parts

    def of(units: Column) -> Column:
        last = F.greatest(F.size(units) - K, F.lit(0))
        kmers = F.sort_array(F.transform(F.sequence(F.lit(0), last), lambda i: _pack(kmer(units, i), i)))
        return let(let(kmers, ranked), lambda order: take(units, order))

    cut = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([^\x20\x09-\x0D]{1,%d})" % UNIT), F.lit(1))
    return let(cut, lambda units: F.when(F.size(units) > 0, of(units)).otherwise(F.array().cast("array<bigint>")))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal parts among the bins that either has; 1 for two empty fingerprints."""
    bins = F.size(F.array_union(F.transform(a, lambda x: F.shiftright(x, PART)), F.transform(b, lambda x: F.shiftright(x, PART))))
    return F.when(bins == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / bins)


def as_text(parts_: Column) -> Column:
    return F.array_join(F.transform(parts_, lambda x: F.lpad(F.lower(F.hex(x)), (BINS_LOG + PART) // 4, "0")), "")


def with_next(docs: DataFrame, columns: list[str], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """docs with a struct ``next`` of the columns of the next row by (doc_id, text), of the first row for the last. Null ids come first."""
    n = docs.count()
    buckets = min(MAX_BUCKETS, max(1, n // bucket_rows))
    quantiles = [k / buckets for k in range(1, buckets)]
    # at most MAX_BUCKETS ids come to the driver
    found = docs.agg(F.min("doc_id").alias("lo"), F.bool_or(F.col("doc_id").isNull()).alias("nulls"), F.percentile_approx("doc_id", quantiles or [0.5], 50 * buckets).alias("q")).first()
    first = None if found["nulls"] else found["lo"]
    bounds = sorted({q for q in found["q"] or [] if q > found["lo"]}) if quantiles else []
    if found["nulls"] and found["lo"] is not None and bounds:
        bounds = [b for b in bounds if b > found["lo"]]
    every = F.array(*map(F.lit, bounds)).cast("array<bigint>") if bounds else F.array().cast("array<bigint>")
    coarse = F.array(*map(F.lit, bounds[::COARSE])).cast("array<bigint>") if bounds else every
    base = F.greatest(F.size(F.filter(coarse, lambda b: b <= F.col("doc_id"))) - 1, F.lit(0)) * COARSE
    bucket = F.when(F.col("doc_id").isNull(), 0).otherwise(let(base, lambda at: at + F.size(F.filter(F.slice(every, at + 1, COARSE), lambda b: b <= F.col("doc_id")))))
    starts = F.when(F.col("bucket") > 0, F.col("doc_id") == F.get(every, F.col("bucket") - 1)).otherwise(F.col("doc_id").eqNullSafe(F.lit(first).cast("bigint")))
    home = F.struct(F.col("bucket").alias("b"), F.lit(False).alias("ghost"))
    ghost = F.struct(F.pmod(F.col("bucket") - 1, F.lit(len(bounds) + 1)).alias("b"), F.lit(True).alias("ghost"))
    dealt = docs.withColumn("bucket", bucket).withColumn("to", F.explode(F.when(starts, F.array(home, ghost)).otherwise(F.array(home))))
    order = Window.partitionBy("to.b").orderBy("to.ghost", F.col("doc_id").asc_nulls_first(), "text")
    return dealt.withColumn("next", F.lead(F.struct(*columns)).over(order)).filter("NOT to.ghost").drop("to", "bucket")


def fingerprint_documents(docs: DataFrame, borrow: bool = False) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: a row per row of docs.

    Null texts count as empty. Empty fingerprints are like each other and unlike any other. Rows of one id follow each
    other by text; rows alike are each other's next. A single row is its own next. Other columns are ignored. With borrow,
    the order of short texts counts too.
    """
    base = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    own = with_next(base.withColumn("parts", fingerprint(F.col("text"), borrow)), ["text", "parts"])
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = own.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        "parts",
        F.col("next.parts").alias("next_parts"),
        F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half)).alias("edited"),
    ).withColumn("edited_parts", fingerprint(F.col("edited"), borrow))
    return edited.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("parts")).alias("fingerprint"),
        as_text(F.col("edited_parts")).alias("edited_fingerprint"),
        likeness(F.col("parts"), F.col("edited_parts")).alias("near_edited"),
        likeness(F.col("parts"), F.col("next_parts")).alias("near_next"),
    )
