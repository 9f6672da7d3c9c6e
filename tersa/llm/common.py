"""Shared helpers of the training-data operators.

Inputs are read with Spark's readers only, so any store Spark can read will do. Tables that several jobs need are written
to the shared folder (``tersa.storage``); lineage never depends on one executor's disk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tersa.storage import discard, fresh_path, materialize, scratch, shared_dir  # noqa: F401

#: A word: a run of anything but ASCII white space. ``bytes.split()`` cuts at exactly these bytes.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: A step takes at most so many rows and, unless one row has more, so many bytes. Spark bounds the batches it sends in bytes.
STEP_ROWS, STEP_BYTES = 256, 8 << 20
#: A key of more than 1 / HOT_SHARE of all rows is hot, if that is more than LEAST_HOT rows: there are less than HOT_SHARE of them.
HOT_SHARE, LEAST_HOT = 1024, 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, rows: int = STEP_ROWS, size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most that many rows, each halved while it has more bytes; views, not copies."""
    stack = [batch.slice(k, rows) for k in range(0, batch.num_rows, rows)][::-1]
    while stack:
        part = stack.pop()
        if part.num_rows > 1 and part.nbytes > size:
            half = part.num_rows // 2
            stack += [part.slice(half), part.slice(0, half)]
        elif part.num_rows:
            yield part


def map_columns(df: DataFrame, make: Callable[[], Callable[..., list]], schema: str, rows: int = STEP_ROWS) -> DataFrame:
    """Run ``make()`` once per task; its result maps the columns of a few rows, as lists, to output columns (lists or arrays)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        step = make()
        for batch in batches:
            for part in slices(batch, rows):
                columns = step(*(c.to_pylist() for c in part.columns))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, target)], schema=target)

    return df.mapInArrow(run, schema)


def append_columns(df: DataFrame, on: Column, make: Callable[[], Callable[[list], list]], schema: str, carry: tuple[Column, ...] = ()) -> DataFrame:
    """row (a struct of all columns of df), the columns of ``carry``, and those of ``schema`` that ``make()``'s result makes of ``on``.

    Rows pass through Arrow unread. The first list that ``make()``'s result gives says which rows stay; of others row is null.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType

    sent = df.select(on.alias("on"), F.struct(*(df[c] for c in df.columns)).alias("row"), *carry)
    target = StructType([StructField("row", sent.schema["row"].dataType), *sent.schema.fields[2:], *StructType.fromDDL(schema).fields])
    new = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        step = make()
        for batch in batches:
            for part in slices(batch):
                stay, *columns = step(part.column(0).to_pylist())
                row = part.column(1)
                if not all(stay):
                    row = pa.StructArray.from_arrays(row.flatten(), fields=list(row.type), mask=pa.array([not x for x in stay]))
                yield pa.RecordBatch.from_arrays([row, *part.columns[2:], *(pa.array(c, type=f.type) for c, f in zip(columns, new))], names=["row", *part.schema.names[2:], *new.names])

    return sent.mapInArrow(run, target)


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: Column, how: str = "inner", counts: DataFrame | None = None, total: int | None = None) -> DataFrame:
    """left join right on key, where right has few rows a key (null keys none) and keys of left may be hot.

    Hot keys are found by a count with partial aggregation (``counts``: key and n, ``total``: all rows, where they are known).
    Their rows of left are dealt by the hash of ``spread`` to a power of two of tasks, in proportion to their number, and
    right's rows of these keys are repeated as often: less than 4 * HOT_SHARE copies, whatever the input. With ``how``
    left, rows without a key are dealt out too.
    """
    least = (left.count() if total is None else total) // HOT_SHARE
    hot = []
    if least >= LEAST_HOT:  # below, any task can take what a key has
        per = counts if counts is not None else left.groupBy(key).agg(F.count("*").alias("n"))
        hot = per.filter(F.col(key).isNotNull() & (F.col("n") > least)).select(key, "n").collect()  # less than HOT_SHARE rows
    # the plan is the same whether or not there are such keys
    levels: dict[int, list] = {}
    for k, n in hot:
        levels.setdefault(1 << (-(-n // least) - 1).bit_length(), []).append(bytes(k) if isinstance(k, bytearray) else k)
    copies = F.lit(1)
    for c, keys in levels.items():
        copies = F.when(F.col(key).isin(keys), F.lit(c)).otherwise(copies)
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.when(F.col(key).isNull(), F.lit(HOT_SHARE)).otherwise(copies)))
    copied = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), copies.cast("long") - 1)))
    return dealt.join(copied, [key, "_salt"], how).drop("_salt")


def crc_fold(doc_id: Column) -> Column:
    """0, 1 or 2 by the id alone; fold 1 is held out. Null ids count as the text 'null'."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % 3


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")
