"""WARC archives with a two-level capture index.

Pages are written as WARC records, one gzip member each, to archives in the shared folder; one task writes one archive,
under a name that no other attempt uses, so that a task that is run again leaves at worst a file that nothing refers to.
Every record has an index line: its URL with the host reversed, the page, archive, offset and length. Lines are sorted
by that key and page over the cluster, at most FILES index files of consecutive keys, each of compressed blocks of BLOCK
lines (first level) and, at its end, a sparse directory of its blocks: first key, offset and length of each (second level).
Where a file begins is kept in a table of a row a file. A look-up finds its file and, in that file's directory, its block by
bisection, reads the block by range, finds its lines by bisection, and reads their records by range. Looking up many keys
at once sorts them, so that a task meets few files and each block once. Reading all archives back is such a look-up.

Of the pages with equal payloads of at least LEAST bytes the one with the largest id is stored; the others become revisit
records, which carry the payload's digest and length and the id of the page they refer to.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import math
import re
import uuid
import zlib
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tersa.llm.common import fresh_path, map_columns, materialize, slices
from tersa.llm.store import Ranges, place

LEAST, BLOCK, FILES, LEVEL, DATE = 1000, 1000, 4096, 6, "2024-01-01T00:00:00Z"
RECORD = "key string, page_id long, record_type string, refers_to long, file string, offset long, length long"


def surt(url: str | None) -> str:
    """The URL's sort key: host labels in reverse, without www or scheme, then port, path and query; the fragment goes."""
    url = (url or "").strip()
    try:
        parts = urlsplit(url if "://" in url else f"http://{url}")
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.lower() + ")"
    labels = re.sub(r"^www\d*\.", "", host.lower()).split(".")
    return ",".join(reversed(labels)) + (f":{port}" if port and port not in (80, 443) else "") + ")" + (parts.path or "/").lower() + (f"?{parts.query.lower()}" if parts.query else "")


def _line(text: object) -> str:
    """A header's value: one line, whatever was in it."""
    return re.sub(r"[\x00-\x1f\x7f]+", " ", str(text))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 response, or a revisit if it refers to another page, as one gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_line(url or '')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    raw = "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def parse(data: bytes) -> dict:
    """Headers, HTTP headers and payload of one record; ValueError if lengths or a response's digest don't fit."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    n = int(fields["Content-Length"])
    block = rest[:n]
    if not lines[0].startswith("WARC/") or len(block) != n or rest[n:] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?im)^content-length: (\d+)", http)[1])
    if fields["WARC-Type"] == "response":
        if len(payload) != length or f"sha1:{hashlib.sha1(payload).hexdigest()}" != fields["WARC-Payload-Digest"]:
            raise ValueError("the payload differs from its digest")
    return {"fields": fields, "payload": payload, "payload_bytes": length}


def plan(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html, digest, refers_to per row of pages. The pages of a payload are counted before anything is shuffled."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    base = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"), F.sha1(payload).alias("digest"), (F.octet_length(payload) >= least).alias("long_enough"))
    first = base.filter("long_enough").groupBy(F.col("digest").alias("of")).agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("of", "first")
    first = materialize(first, "warc-first")
    # the digests that occur more than once; the pages' own rows are never grouped
    return base.join(first, F.col("long_enough") & (F.col("digest") == F.col("of")), "left").select(
        "page_id", "url", "html", "digest", F.when(F.col("page_id") < F.col("first"), F.col("first")).alias("refers_to")
    )


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write the records of plan() to archives in folder; the index line of each, in the columns of RECORD."""

    def run(batches):
        import pyarrow as pa

        out, uri, at = None, f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
        for batch in (part for whole in batches for part in slices(whole)):
            lines = {name: [] for name in ("key", "page_id", "record_type", "refers_to", "file", "offset", "length")}
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    system, path = place(uri)
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(path, compression=None)
                data = record(page_id, url, html.encode("utf-8"), digest, refers_to)
                out.write(data)
                for name, value in zip(lines, (surt(url), page_id, "response" if refers_to is None else "revisit", refers_to, uri, at, len(data))):
                    lines[name].append(value)
                at += len(data)
            if lines["key"]:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(lines.values(), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=list(lines))
        if out is not None:
            out.close()

    # written once: what reads the index later never makes a task write its archive again
    return materialize(pages.mapInArrow(run, RECORD), "warc-records")


ROOT = "file string, first_key string, first_page long, directory long, length long, lines long"


def order_of(key: str, page_id: int | None) -> tuple:
    """Index lines sort by this, as Spark sorts them: by code points, pages without an id first."""
    return key.encode("utf-8", "surrogatepass"), page_id is not None, page_id or 0


def build_index(records: DataFrame, folder: str, block: int = BLOCK, files: int = FILES) -> DataFrame:
    """Sort index lines by key and page into at most ``files`` index files in folder; a row per file: ROOT."""
    n = min(files, max(1, -(-records.count() // (block * 8))))
    columns = ("key", "page_id", "record_type", "refers_to", "file", "offset", "length")
    ordered = records.select(*columns).repartitionByRange(n, "key", "page_id").sortWithinPartitions("key", "page_id", "file", "offset")

    def run(batches):
        import pyarrow as pa

        out, uri, at, held, directory = None, f"{folder}/{uuid.uuid4().hex}.cdx.gz", 0, [], []
        first, lines = None, 0

        def put(data: bytes) -> tuple[int, int]:
            nonlocal out, at
            if out is None:
                system, path = place(uri)
                system.create_dir(path.rpartition("/")[0], recursive=True)
                out = system.open_output_stream(path, compression=None)
            out.write(data)
            at += len(data)
            return at - len(data), len(data)

        def pack(some):
            directory.append([some[0][0], some[0][1], *put(_packed(some))])

        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns))
            if held and first is None:
                first = held[0][:2]
            while len(held) >= block:
                pack(held[:block])
                lines += block
                del held[:block]
        if held:
            pack(held)
            lines += len(held)
        if out is not None:
            where = put(_packed(directory))
            out.close()
            row = [uri, *first, *where, lines]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], names=[x.split()[0] for x in ROOT.split(", ")])

    return materialize(ordered.mapInArrow(run, ROOT), "warc-root")


def _packed(lines: list) -> bytes:
    return zlib.compress("\n".join(json.dumps(x, ensure_ascii=False) for x in lines).encode("utf-8", "surrogatepass"), LEVEL)


def block_lines(ranges: Ranges, file: str, offset: int, length: int) -> list[list]:
    return [json.loads(x) for x in zlib.decompress(ranges.read(file, offset, length)).decode("utf-8", "surrogatepass").split("\n")]


class Index:
    """Look-ups by bisection: of the file in the root, of the block in the file's directory, of the lines in the block.

    The root has a row per index file, at most FILES. Of directories and blocks the last read is kept.
    """

    def __init__(self, root: list):
        self.root = sorted(root, key=lambda r: order_of(r["first_key"], r["first_page"]))
        self.firsts = [order_of(r["first_key"], r["first_page"]) for r in self.root]
        self.ranges, self.last = Ranges(), {}

    def _read(self, level: str, file: str, offset: int, length: int) -> tuple[list, list[tuple]]:
        """Lines at a place, and what they sort by."""
        if self.last.get(level, (None,))[0] != (file, offset):
            lines = block_lines(self.ranges, file, offset, length)
            self.last[level] = (file, offset), lines, [order_of(x[0], x[1]) for x in lines]
        return self.last[level][1:]

    def lines(self, low: tuple, high: tuple) -> list[list]:
        """Index lines from low to high, in order."""
        found = []
        k = max(0, bisect.bisect_left(self.firsts, low) - 1)
        while k < len(self.root) and self.firsts[k] <= high:
            r = self.root[k]
            blocks, starts = self._read("directory", r["file"], r["directory"], r["length"])
            j = max(0, bisect.bisect_left(starts, low) - 1)
            while j < len(blocks) and starts[j] <= high:
                lines, places = self._read("block", r["file"], *blocks[j][2:])
                found += lines[bisect.bisect_left(places, low) : bisect.bisect_right(places, high)]
                j += 1
            k += 1
        return found

    def record(self, line: list) -> dict:
        """The record of an index line: page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to; ValueError if it is another."""
        key, page_id, kind, refers_to, file, offset, length = line
        r = parse(self.ranges.read(file, offset, length))
        f = r["fields"]
        said = int(f["X-Page-ID"]) if f["X-Page-ID"] else None
        to = int(f["X-Refers-To-Page-ID"]) if "X-Refers-To-Page-ID" in f else None
        if (said, f["WARC-Type"], to) != (page_id, kind, refers_to):
            raise ValueError(f"{file} at {offset}: not the record of its index line")
        return {"page_id": said, "url": f["WARC-Target-URI"], "payload": r["payload"], "payload_bytes": r["payload_bytes"], "payload_digest": f["WARC-Payload-Digest"].removeprefix("sha1:"), "record_type": kind, "refers_to": to}

    def captures(self, url: str) -> list[dict]:
        """All records of the URL, in order of page ids; a key may run over several blocks and files."""
        key = surt(url)
        return [self.record(x) for x in self.lines(order_of(key, None), (order_of(key, None)[0], True, math.inf))]


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def look_up(wanted: DataFrame, root: DataFrame, with_payload: bool = False) -> DataFrame:
    """READ (and payload) of all records of the keys and page ids of wanted: columns key, page_id, each pair once.

    Pairs are sorted over the cluster as the index is, so that a task's look-ups meet consecutive blocks.
    """
    spark = wanted.sparkSession
    shared = spark.sparkContext.broadcast([r.asDict() for r in root.collect()])  # a row per index file, FILES at most
    n = max(1, min(sum(r["lines"] for r in shared.value) // BLOCK, spark.sparkContext.defaultParallelism * 16))
    ordered = wanted.select("key", "page_id").repartitionByRange(n, "key", "page_id").sortWithinPartitions("key", "page_id")

    def make():
        index = Index(shared.value)

        def step(keys, pages):
            lines = [x for k, p in zip(keys, pages) for x in index.lines(order_of(k, p), order_of(k, p))]
            # neighbours in an archive are read one after the other
            rows = [index.record(x) for x in sorted(lines, key=lambda x: (x[4], x[5]))]
            names = [x.split()[0] for x in READ.split(", ")] + ["payload"] * with_payload
            return [[r[name] for r in rows] for name in names]

        return step

    return map_columns(ordered, make, READ + ", payload binary" * with_payload)


def archive(spark: SparkSession, pages: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Write archives and index; (index lines, root)."""
    folder = fresh_path(spark, "warc")
    records = write_archives(plan(pages, least), folder)
    return records, build_index(records, f"{folder}/index")


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: a row per row of pages, looked up in the archives.

    Null HTML has an empty payload, a null URL an empty one. Rows that repeat the largest page of a payload are responses
    each, as none is larger; a page without an id is a response and nothing refers to it. No pages make no archives.
    """
    lines, root = archive(pages.sparkSession, pages, least)
    return look_up(lines.select("key", "page_id").distinct(), root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
