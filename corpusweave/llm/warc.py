"""WARC archives with a two-level capture index.

Pages are written as WARC records into plain files: Spark's text writer ends each row with the two line
breaks that end a record. The index sorts reversed-host URL keys into compressed blocks; a sparse directory
holds the first and last key of each block. A look-up searches the directory, then the block, by bisection
and reads the ranges found.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.llm.tables import MAX_SENT_IDS

MIN_REVISIT_BYTES = 100
#: Records of one file, and entries of one block of the index.
ARCHIVE_RECORDS = 2000
BLOCK_ENTRIES = 2000
DATE = "2024-01-01T00:00:00Z"
_BREAK = "\r\n"
_END = "\r\n\r\n"


def _record(kind: Column, refers_to: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace("_url", "\r", "%0D"), "\n", "%0A")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("_bytes").cast("string"),
        F.lit(_END),
    )
    block = F.when(kind == "response", F.concat(http, "_html")).otherwise(http)
    field = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    header = F.concat_ws(
        _BREAK,
        F.lit("WARC/1.1"),
        field("WARC-Type", kind),
        field("WARC-Record-ID", urn(F.coalesce(F.col("_page").cast("string"), F.lit("none")))),
        field("WARC-Target-URI", clean),
        F.lit(f"WARC-Date: {DATE}"),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "_digest")),
        field("WARC-Refers-To", urn(refers_to)),
        F.when(kind == "revisit", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return F.concat(header, F.lit(_END), block)


def write_archives(
    pages: DataFrame,
    path: str,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    records: int = ARCHIVE_RECORDS,
) -> None:
    """Write a record per row of ``pages`` into the new folder ``path``.

    Of records with equal payloads of at least 100 bytes the one of least key is a response and the others
    revisit it (all rows of the least key are responses). A null html is an empty payload, a null url leaves the field
    out, line breaks in a url are escaped; a null key is written as ``none`` and never referred to. Other columns are
    left out.
    """
    rows = (
        pages.select(
            F.col(key).cast("long").alias("_page"),
            F.col(url).cast("string").alias("_url"),
            F.coalesce(F.col(html).cast("string"), F.lit("")).alias("_html"),
        )
        .withColumn("_digest", F.sha2("_html", 256))
        .withColumn("_bytes", F.octet_length("_html"))
    )
    repeated = (
        rows.where(F.col("_bytes") >= MIN_REVISIT_BYTES)
        .groupBy("_digest")
        .agg(F.count("*").alias("_n"), F.min("_page").alias("_first"))
        .where("_n > 1")
        .select("_digest", "_first")
    )
    if repeated.count() <= MAX_SENT_IDS // 4:
        repeated = F.broadcast(repeated)
    rows = rows.join(repeated, "_digest", "left")
    again = F.col("_first").isNotNull() & ~F.col("_page").eqNullSafe(F.col("_first"))
    kind = F.when(again, F.lit("revisit")).otherwise(F.lit("response"))
    (
        rows.select(_record(kind, F.when(again, F.col("_first"))).alias("value"))
        .write.option("lineSep", _END)
        .option("maxRecordsPerFile", records)
        .option("compression", "none")
        .text(path)
    )


def surt(url: str | None) -> str:
    """Key of a URL: its host reversed, then its path and query: ``com,example,www)/path?q``."""
    if not url:
        return ")"
    try:
        parts = urlsplit(url)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return f"){url}"
    key = ",".join(reversed(host.split(".")))
    if port and (parts.scheme, port) not in (("http", 80), ("https", 443)):
        key += f":{port}"
    return f"{key}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def _headers(data: memoryview | bytes, at: int) -> tuple[dict[str, str], int]:
    """Fields of a record and where its block begins."""
    end = data.find(b"\r\n\r\n", at)
    fields = {}
    for line in data[at:end].decode().split(_BREAK)[1:]:
        name, _, value = line.partition(": ")
        fields[name.lower()] = value
    return fields, end + 4


def _page(urn: str | None) -> int | None:
    value = (urn or "")[len("<urn:page:") : -1]
    return int(value) if value.lstrip("-").isdigit() else None


_ENTRY = pa.schema(
    [("surt", pa.string()), ("page", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            path, data = batch.column("path")[row].as_py(), batch.column("content")[row].as_py()
            at, out = 0, []
            while at < len(data):
                fields, block = _headers(data, at)
                end = block + int(fields["content-length"])
                out.append((surt(fields.get("warc-target-uri")), _page(fields["warc-record-id"]), path, at, end - at))
                at = end + 4
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), f.type) for c, f in zip(zip(*out), _ENTRY)], schema=_ENTRY
                )


def _block(rows: list[tuple]) -> tuple:
    lines = "\n".join(json.dumps(r, ensure_ascii=False) for r in rows)
    return rows[0][0], rows[-1][0], len(rows), zlib.compress(lines.encode())


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def cut() -> Iterator[list[tuple]]:
        held: list[tuple] = []
        for batch in batches:
            held.extend(zip(*(c.to_pylist() for c in batch.columns)))
            while len(held) >= BLOCK_ENTRIES:
                yield held[:BLOCK_ENTRIES]
                held = held[BLOCK_ENTRIES:]
        if held:
            yield held

    for rows in cut():
        first, last, n, data = _block(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array([first]), pa.array([last]), pa.array([n], pa.int64()), pa.array([data], pa.binary())],
            names=["first", "last", "n", "data"],
        )


def _archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")


def write_index(spark: SparkSession, archives: str, index: str) -> None:
    """Read the archives once and write ``index``/blocks and ``index``/directory.

    Keys are range-partitioned together with page and place, so one host or one URL of very many captures
    is cut into many blocks.
    """
    order = ["surt", "page", "file", "offset"]
    entries = _archives(spark, archives).mapInArrow(
        _entries, "surt string, page long, file string, offset long, length long"
    )
    (
        entries.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(_pack, "first string, last string, n long, data binary")
        .withColumn("block", F.monotonically_increasing_id())
        .write.parquet(f"{index}/blocks")
    )
    blocks = spark.read.parquet(f"{index}/blocks")
    blocks.select("block", "first", "last", "n").sort("first", "block").write.parquet(f"{index}/directory")


def _bisect_directory(keys: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, last = batch.column("first").to_pylist(), batch.column("last").to_pylist()
            found = [i for i in range(len(first)) if bisect_left(keys, first[i]) < bisect_right(keys, last[i])]
            yield batch.select(["block"]).take(pa.array(found, pa.int64()))

    return run


def _unpack(keys: Sequence[str] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data").to_pylist():
                rows = [json.loads(line) for line in zlib.decompress(data).decode().split("\n")]
                if keys is not None:
                    names = [r[0] for r in rows]
                    some = keys[bisect_left(keys, names[0]) : bisect_right(keys, names[-1])]
                    rows = [r for k in some for r in rows[bisect_left(names, k) : bisect_right(names, k)]]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(c), f.type) for c, f in zip(zip(*rows), _ENTRY)], schema=_ENTRY
                    )

    return run


_RECORD = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("refers_to", pa.int64()),
        ("payload", pa.string()),
    ]
)


def _read(payload: bool):
    def record(data: bytes) -> tuple:
        fields, block = _headers(data, 0)
        http = data.find(b"\r\n\r\n", block) + 4
        sizes = dict(line.lower().split(b": ", 1) for line in data[block:http].strip().split(b"\r\n")[1:])
        body, kind = data[http:], fields["warc-type"]
        digest, size = fields["warc-payload-digest"].removeprefix("sha256:"), int(sizes[b"content-length"])
        if kind == "response" and (hashlib.sha256(body).hexdigest() != digest or len(body) != size):
            raise ValueError(f"record {fields['warc-record-id']} is damaged")
        return (
            _page(fields["warc-record-id"]),
            fields.get("warc-target-uri"),
            kind,
            size,
            digest,
            _page(fields.get("warc-refers-to")),
            body.decode() if payload and kind == "response" else None,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                data = batch.column("content")[row].as_py()
                out = [record(data[r["offset"] : r["offset"] + r["length"]]) for r in batch.column("ranges")[row].as_py()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), f.type) for c, f in zip(zip(*out), _RECORD)], schema=_RECORD
                )

    return run


def _read_ranges(spark: SparkSession, archives: str, entries: DataFrame, payload: bool) -> DataFrame:
    ranges = entries.groupBy(F.col("file").alias("path")).agg(
        F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("ranges")  # of one file, so bounded
    )
    if entries.count() <= MAX_SENT_IDS:
        ranges = F.broadcast(ranges)
    return (
        _archives(spark, archives)
        .join(ranges, "path")
        .mapInArrow(
            _read(payload),
            "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload string",
        )
    )


_ENTRY_DDL = "surt string, page long, file string, offset long, length long"


def read_records(spark: SparkSession, archives: str, index: str, payload: bool = True) -> DataFrame:
    """All records of the index, read by their ranges; digests of responses are checked.

    ``page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload``; a revisit has the size and digest of
    the payload it refers to and a null payload, as has everything without ``payload``.
    """
    entries = spark.read.parquet(f"{index}/blocks").select("data").mapInArrow(_unpack(None), _ENTRY_DDL)
    return _read_ranges(spark, archives, entries, payload)


def look_up(spark: SparkSession, archives: str, index: str, urls: Sequence[str], payload: bool = True) -> DataFrame:
    """The records of a stated list of URLs (it goes to every task); URLs without a capture give no row."""
    keys = sorted({surt(u) for u in urls})
    blocks = spark.read.parquet(f"{index}/directory").mapInArrow(_bisect_directory(keys), "block long")
    data = spark.read.parquet(f"{index}/blocks").select("block", "data").join(blocks, "block").select("data")
    return _read_ranges(spark, archives, data.mapInArrow(_unpack(keys), _ENTRY_DDL), payload)
