"""WARC archives with a two-level capture index.

Pages become WARC records in files of bounded size that Spark's text writer makes: a record ends with two line ends, so
they serve as its separator. Reading goes by the records' lengths. The capture index sorts the captures by their
URL with the host reversed and packs neighbours into compressed blocks; a sparse directory holds the first and last key of
every block. A lookup finds the parts that can hold a key in the short list of all parts, searches the part's directory
for the blocks by halving, unpacks those, and searches their lines alike. What it returns are places in the archives,
read as ranges.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dealwright.llm.common import stored

#: Payloads from so many bytes on are written once.
REVISIT_FROM = 100
#: Bytes of an archive file, about; a larger record has a file of its own size.
FILE_BYTES = 32 << 20
#: Captures of an index block.
BLOCK_CAPTURES = 512
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = (
    "key string, page_id long, url string, file string, offset long, length long, record_type string, "
    "payload_bytes long, payload_digest string, refers_to long"
)
FIELDS = [part.split()[0] for part in CAPTURE.split(", ")]


def url_key(url: Column) -> Column:
    """The URL with its host reversed, in lower case and without scheme: neighbours in order are neighbours on the web.
    A null URL has the key ``-``."""
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(.*)$", 1)
    return F.coalesce(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path), F.lit("-"))


def _header_value(text: Column) -> Column:
    """A URL that fits in a header line."""
    for char, code in (("\r", "%0D"), ("\n", "%0A"), (" ", "%20"), ("\t", "%09")):
        text = F.replace(text, F.lit(char), F.lit(code))
    return text


def _page_name(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def write_archives(pages: DataFrame, path: str, captured: str = "2024-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> None:
    """A record per row of ``pages`` (page_id, url, html) in new files under ``path``.

    Of equal payloads of ``REVISIT_FROM`` bytes or more that with the smallest page_id is a response and the others
    revisit it; others are responses. Null html is an empty payload. Rows that repeat the smallest page_id with the same
    payload are responses too, as there is no other page to refer to; so are copies whose ids are all null.
    """
    html = F.coalesce("html", F.lit(""))
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html")).select(
        "*", F.sha2(F.col("html").cast("binary"), 256).alias("digest"), F.octet_length("html").cast("long").alias("bytes")
    )
    copied = F.col("bytes") >= REVISIT_FROM
    firsts = stored(
        named.where(copied)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("digest", "first")
    )
    total = named.agg(F.count(F.lit(1)), F.sum(F.col("bytes") + 600)).first()
    per_file = max(1, int(file_bytes * (total[0] or 0) / (total[1] or 1)))
    later = copied & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("bytes").cast("string"),
        F.lit("\r\n\r\n"),
    )
    block = F.when(later, http).otherwise(F.concat(http, "html"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(later, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), _page_name(F.col("page_id")),
        F.lit(f"\r\nWARC-Date: {captured}"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), _header_value(F.col("url"))), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(later, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), _page_name(F.col("first")))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"), F.lit("\r\n\r\n"),
    )
    records = named.join(firsts, "digest", "left").select(F.concat(head, block).alias("value"))
    records.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", per_file).text(path)


def _headers(raw: bytes) -> dict[str, str]:
    pairs = (line.split(": ", 1) for line in raw.decode("utf-8", "replace").split("\r\n")[1:])
    return {p[0].lower(): p[1] for p in pairs if len(p) == 2}


def _page_of(name: str | None) -> int | None:
    number = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


def _record(content: memoryview, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at ``at``."""
    raw = content.obj
    split = raw.find(b"\r\n\r\n", at)
    if raw[at : at + 5] != b"WARC/" or split < 0:
        raise ValueError(f"no record at byte {at}")
    headers = _headers(raw[at:split])
    end = split + 4 + int(headers["content-length"])
    return headers, raw[split + 4 : end], end


def payload_of(block: bytes) -> bytes:
    return block[block.find(b"\r\n\r\n") + 4 :]


def captures(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the archives under ``path``, read record by record; digests are those of what is stored.

    A revisit has no payload; its digest is the one it names, its size is found at the response it refers to.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                file, raw = batch.column("path")[i].as_py(), batch.column("content")[i].as_py()
                view, at, rows = memoryview(raw), 0, []
                while at < len(raw):
                    headers, block, end = _record(view, at)
                    kind, payload = headers["warc-type"], payload_of(block)
                    digest = hashlib.sha256(payload).hexdigest() if kind == "response" else headers["warc-payload-digest"][7:]
                    rows.append(
                        {"page_id": _page_of(headers["warc-record-id"]), "url": headers.get("warc-target-uri"), "file": file,
                         "offset": at, "length": end - at, "record_type": kind, "payload_digest": digest,
                         "payload_bytes": len(payload) if kind == "response" else None,
                         "refers_to": _page_of(headers.get("warc-refers-to"))}
                    )
                    at = end + 4
                yield pa.RecordBatch.from_pylist(rows, schema)

    names = [f for f in FIELDS if f != "key"]
    kinds = dict(part.split() for part in CAPTURE.split(", "))
    schema = pa.schema([(n, pa.string() if kinds[n] == "string" else pa.int64()) for n in names])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path", "content")
    found = files.mapInArrow(scan, ", ".join(f"{n} {kinds[n]}" for n in names))
    return found.select(url_key(F.col("url")).alias("key"), *names)


def _packed(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of sorted captures: part, number, first and last key, compressed lines."""
    part, number, held = TaskContext.get().partitionId(), 0, []

    def block(lines):
        data = zlib.compress("\n".join(json.dumps([x[f] for f in FIELDS]) for x in lines).encode())
        return pa.RecordBatch.from_arrays(
            [pa.array([part]), pa.array([number]), pa.array([lines[0]["key"]]), pa.array([lines[-1]["key"]]), pa.array([data])],
            ["part", "number", "first_key", "last_key", "data"],
        )

    for batch in batches:
        held += batch.to_pylist()
        while len(held) >= size:
            yield block(held[:size])
            held, number = held[size:], number + 1
    if held:
        yield block(held)


def build_index(found: DataFrame, path: str, size: int = BLOCK_CAPTURES) -> None:
    """The capture index of ``found`` under ``path``: blocks sorted by key over all parts.

    Sorted by range, ties by page and place, so captures of one URL may fill many parts.
    """
    order = ["key", "page_id", "file", "offset"]
    blocks = found.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        lambda it: _packed(size, it), "part long, number long, first_key string, last_key string, data binary"
    )
    blocks.write.parquet(path)


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """The captures of every distinct ``key`` of ``keys``, from the index under ``path``.

    The list of parts has a row for each partition that wrote the index, whatever its size; it alone comes to the
    driver. Requests then meet the blocks of their parts: a part's directory is searched by halving, and only blocks
    that can hold a key are unpacked.
    """
    blocks = spark.read.schema("part long, number long, first_key string, last_key string, data binary").parquet(path)
    parts = blocks.groupBy("part").agg(F.min("first_key").alias("low"), F.max("last_key").alias("high")).collect()
    parts = sorted((r["low"].encode(), r["high"].encode(), r["part"]) for r in parts)
    lows, highs = [p[0] for p in parts], [p[1] for p in parts]

    def find_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named, numbers = [], []
            for key in batch.column("key").to_pylist():
                wanted = key.encode()
                for i in range(bisect_left(highs, wanted), bisect_right(lows, wanted)):
                    named.append(key)
                    numbers.append(parts[i][2])
            yield pa.RecordBatch.from_arrays([pa.array(named, pa.string()), pa.array(numbers, pa.int64())], ["key", "part"])

    wanted = keys.select("key").where("key IS NOT NULL").distinct().mapInArrow(find_parts, "key string, part long")
    kinds = dict(part.split() for part in CAPTURE.split(", "))
    schema = pa.schema([(n, pa.string() if kinds[n] == "string" else pa.int64()) for n in FIELDS])

    def search(requests: pa.Table, held: pa.Table) -> pa.Table:
        held = held.sort_by("number")
        first, last = ([k.encode() for k in held[c].to_pylist()] for c in ("first_key", "last_key"))
        needed: dict[int, list[str]] = {}
        for key in requests["key"].to_pylist():
            for i in range(bisect_left(last, key.encode()), bisect_right(first, key.encode())):
                needed.setdefault(i, []).append(key)
        columns: list[list] = [[] for _ in FIELDS]
        for i, sought in needed.items():
            lines = [json.loads(x) for x in zlib.decompress(held["data"][i].as_py()).decode().split("\n")]
            ordered = [x[0].encode() for x in lines]
            for key in sought:
                for line in lines[bisect_left(ordered, key.encode()) : bisect_right(ordered, key.encode())]:
                    for column, value in zip(columns, line, strict=True):
                        column.append(value)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return wanted.groupBy("part").cogroup(blocks.groupBy("part")).applyInArrow(search, CAPTURE)


def read_payloads(spark: SparkSession, path: str, found: DataFrame) -> DataFrame:
    """``found`` captures (file, offset, length) of responses with their ``payload``, read as ranges of their files."""
    places = found.where("record_type = 'response'").groupBy("file").agg(
        F.collect_list(F.struct("page_id", "offset", "length")).alias("places")
    )
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    both = files.select(F.col("path").alias("file"), "content").join(places, "file")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw = batch.column("content")[i].as_py()
                for place in batch.column("places")[i].as_py():
                    record = raw[place["offset"] : place["offset"] + place["length"]]
                    _, block, _ = _record(memoryview(record), 0)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([place["page_id"]], pa.int64()), pa.array([payload_of(block)], pa.binary())],
                        ["page_id", "payload"],
                    )

    return both.select("content", "places").mapInArrow(cut, "page_id long, payload binary")


def archived(pages: DataFrame, path: str) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) to archives under the folder ``path``, indexes them and looks every URL up.

    One row per page: page_id, payload_bytes, payload_digest, record_type, refers_to, url, file, offset, length. Empty
    tables, null ids, URLs and html and repeated rows are fine (see ``write_archives``); extra columns play no part.
    """
    spark = pages.sparkSession
    write_archives(pages, f"{path}/warc")
    build_index(captures(spark, f"{path}/warc"), f"{path}/index")
    asked = pages.select(url_key(_header_value(F.col("url"))).alias("key"))
    found = stored(lookup(spark, f"{path}/index", asked))
    sizes = found.where("record_type = 'response'").groupBy(
        F.col("page_id").alias("refers_to"), "payload_digest"
    ).agg(F.max("payload_bytes").alias("_there"))
    return found.join(sizes, ["refers_to", "payload_digest"], "left").select(
        "page_id", F.coalesce("payload_bytes", "_there").alias("payload_bytes"), "payload_digest", "record_type",
        "refers_to", "url", "file", "offset", "length",
    )
