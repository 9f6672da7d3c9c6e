"""Folders as items: scan, decode, deduplicate, freeze to a manifest and verify against it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tersa.functions.classify import content_type
from tersa.functions.text import content_hash, extension, language_content_type, normalize_language

#: File extensions that are read, and folders that are not entered.
EXTENSIONS = "ts tsx js jsx cjs mjs py go rs java c cpp h hpp sh ps1 css scss sql json yaml yml md txt".split()
SKIPPED = "node_modules .git dist build coverage __pycache__ .venv venv".split()


def scan(spark: SparkSession, *folders: str) -> DataFrame:
    """arg_no, path, bytes of the files below folders, in order of arguments and paths; a path given twice counts for its first argument."""
    found = None
    for n, folder in enumerate(folders):
        one = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.lit(n).alias("arg_no"), "path", F.col("content").alias("bytes"))
        found = one if found is None else found.unionByName(one)
    named = found.filter(extension(F.element_at(F.split("path", "/"), -1)).isin(*EXTENSIONS) & ~F.exists(F.split("path", "/"), lambda p: p.isin(*SKIPPED)))
    first = F.row_number().over(Window.partitionBy("path").orderBy("arg_no"))
    return named.withColumn("nth", first).filter("nth = 1").drop("nth")


def as_items(files: DataFrame, bundle_id: int = 0) -> DataFrame:
    """Items of the files' texts; representable says whether the bytes are UTF-8. Others decode with replacement and must fall back."""
    ok = F.try_validate_utf8(F.col("bytes").cast("string")).isNotNull()
    text = F.when(ok, F.col("bytes").cast("string")).otherwise(F.make_valid_utf8(F.col("bytes").cast("string")))
    language = normalize_language(extension(F.element_at(F.split("path", "/"), -1)))
    items = files.withColumn("content", text).withColumn("representable", ok).withColumn("language", language)
    kind = F.coalesce(language_content_type(F.col("language")), content_type(F.col("content")))
    # the path is part of the id: equal files are different items
    return items.select(
        F.lit(bundle_id).cast("long").alias("bundle_id"), "arg_no", "path", F.sha2(F.concat_ws("\x01", "path", "content"), 256).alias("item_id"),
        F.lit("file").alias("kind"), kind.alias("content_type"), "language", F.lit(None).cast("string").alias("role"), "content", content_hash(F.col("content")).alias("content_hash"), "representable", "bytes",
    )


def write_files(files: DataFrame, folder: str) -> None:
    """Write each row's bytes to its path below folder, as they are; a task that runs again writes the same files again."""

    def run(batches):
        from pyarrow import fs

        uri = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
        system, root = fs.FileSystem.from_uri(uri if not uri.startswith("file:/") or uri.startswith("file:///") else uri.replace("file:/", "file:///", 1))
        for batch in batches:
            for path, data in zip(*(c.to_pylist() for c in batch.columns)):
                system.create_dir(f"{root}/{path}".rpartition("/")[0], recursive=True)
                with system.open_output_stream(f"{root}/{path}", compression=None) as f:
                    f.write(data or b"")
            yield batch.slice(0, 0).select([0])

    files.select("path", "bytes").mapInArrow(run, "path string").count()


def manifest(files: DataFrame) -> DataFrame:
    """path, size, sha256 (and bucket, if files have one) of all files."""
    bucket = [c for c in files.columns if c == "bucket"]
    return files.select(*bucket, "path", F.octet_length("bytes").cast("long").alias("size"), F.sha2("bytes", 256).alias("sha256"))


def freeze(files: DataFrame, limit: int, least: int = 0, most: int = 1 << 30, expect: int | None = None) -> DataFrame:
    """Manifest of the first `limit` files by path of each bucket, within the sizes; ValueError if they are not as many as expected."""
    nth = F.row_number().over(Window.partitionBy("bucket").orderBy("path"))
    found = manifest(files).filter(F.col("size").between(least, most)).withColumn("nth", nth).filter(F.col("nth") <= limit).drop("nth")
    if expect is not None and (n := found.count()) != expect:
        raise ValueError(f"{n} files, not {expect}")
    return found


def verify(manifest_: DataFrame, files: DataFrame) -> DataFrame:
    """path, problem of files that differ from the manifest, are gone, or are not in it."""
    now = files.select("path", F.sha2("bytes", 256).alias("now"))
    joined = manifest_.select("path", "sha256").join(now, "path", "full")
    problem = F.when(F.col("now").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted").when(F.col("now") != F.col("sha256"), "changed")
    return joined.select("path", problem.alias("problem")).filter("problem IS NOT NULL")
