"""WARC archives with a two-level capture index.

Archives: one gzip member for each record, so that an offset and a length reach it. Equal payloads are
stored once: the capture with the largest page_id is the response, the others are revisit records,
whose HTTP head still tells the length. Index: lines sorted by reversed-host URL key and page_id, cut
into compressed blocks; a sparse directory has the first line of each block. A lookup is a binary
search in the directory, a range read of one block, a binary search in it, and a range read of one
record. Reading is dealt out by bytes of the archives, and a revisit gets its payload's length and digest
from the response that it refers to, which is read and checked. The directory is bounded: blocks grow with the input so that it stays under MAX_DIRECTORY rows.

Defined cases: null html is an empty payload; a null url has the empty key; equal urls are told apart
by page_id; repeated rows with the largest page_id are all responses, and each keeps a row, as the index
finds all captures of an id and url; a null page_id is a capture of its own kind; an empty table gives no archive
and no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import Scratch, slices, small_batches, table
from holdfast.llm.files import Writer, reading

BLOCK_LINES = 1000
MAX_DIRECTORY = 200_000
ROLL_BYTES = 256 << 20
#: Bytes of the archives that a task reads, about.
READ_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "key string, page_id {id}, file string, offset long, length long, type string"


def url_key(url: str | None) -> str:
    """Host labels reversed, then the path: http://a.example.org:80/x?q -> org,example,a)/x?q"""
    if not url:
        return ""
    rest = url.partition("://")[2] or url
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, path = rest[:cut].rpartition("@")[2].lower(), rest[cut:]
    name, _, port = host.partition(":")
    key = ",".join(reversed(name.split("."))) + (f":{port}" if port not in ("", "80", "443") else "")
    return f"{key}){path if path.startswith('/') else '/' + path}"


def record(page_id, url: str | None, html: str | None, refers: int | None) -> bytes:
    payload = (html or "").encode("utf-8", "surrogatepass")
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers is not None else head + payload
    uri = "" if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of one record."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = lambda x: {k.lower(): v for k, _, v in (y.partition(": ") for y in x.decode("utf-8", "surrogatepass").split("\r\n")[1:])}
    warc = fields(head)
    block = rest[: int(warc["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http), payload


def _page(urn: str) -> int | None:
    name = urn.strip("<>").rpartition(":")[2]
    return None if name == "None" else int(name)


def _mark(key: str, page: int | None) -> tuple[bytes, bool, int]:
    """Sorts like the index does: by key, then by page_id with nulls first."""
    return key.encode("utf-8", "surrogatepass"), page is not None, page or 0


def write(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """pages (page_id, url, html) -> index entries; archives go to the scratch folder `warc`."""
    pages = small_batches(pages).select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    first = scratch.save(pages.groupBy("digest").agg(F.max("page_id").alias("first")), "first")
    folder = scratch.path("warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in slices(batches, "html"):
            rows = []
            for page, url, html, top in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "first")), strict=True):
                if out is None or out.offset > ROLL_BYTES:
                    if out is not None:
                        out.close()
                    out = Writer(folder, "part", ".warc.gz")
                refers = None if top == page else top
                rows.append((url_key(url), page, out.name, *out.write(record(page, url, html, refers)), "response" if refers is None else "revisit"))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), batch.schema.field("page_id").type, pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["key", "page_id", "file", "offset", "length", "type"])
        if out is not None:
            out.close()

    kind = pages.schema["page_id"].dataType.simpleString()
    joined = pages.join(first, "digest").select("page_id", "url", "html", "first")
    return scratch.save(joined.mapInArrow(run, INDEX.format(id=kind)), "entries")


def index(entries: DataFrame, scratch: Scratch) -> DataFrame:
    """Write the sorted, compressed blocks; -> the sparse directory: key, page_id, file, offset, length."""
    lines = max(BLOCK_LINES, -(-entries.count() // MAX_DIRECTORY))
    folder = scratch.path("index")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, found = None, [], []

        def flush():
            nonlocal out
            out = out or Writer(folder, "block", ".idx")
            found.append((held[0][0], held[0][1], out.name, *out.write(zlib.compress("\n".join(json.dumps(x) for x in held).encode()))))
            held.clear()

        kind = None
        for batch in batches:
            kind = batch.schema.field("page_id").type
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                if len(held) >= lines:
                    flush()
        if held:
            flush()
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.string(), kind, pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "page_id", "file", "offset", "length"])

    kind = entries.schema["page_id"].dataType.simpleString()
    ordered = entries.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    return scratch.save(ordered.mapInArrow(run, f"key string, page_id {kind}, file string, offset long, length long"), "directory")


def lookup(wanted: DataFrame, directory: DataFrame, scratch: Scratch) -> DataFrame:
    """wanted (key, page_id) -> page_id, file, offset, length of all captures of each, through both levels.

    Keys come in ranges, so that a task reads neighbouring blocks, each of them once.
    """
    # bounded by MAX_DIRECTORY rows, whatever the input
    rows = sorted((_mark(r["key"], r["page_id"]), r["file"], r["offset"], r["length"]) for r in directory.collect())
    sent = directory.sparkSession.sparkContext.broadcast(([r[0] for r in rows], [r[1:] for r in rows]))
    folder = scratch.path("index")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, places = sent.value
        at, lines, marks = -1, [], []
        with reading(folder) as files:
            for batch in batches:
                kinds = (batch.schema.field("page_id").type, pa.string(), pa.int64(), pa.int64())

                def out(found: list, kinds=kinds) -> pa.RecordBatch:
                    cols = list(zip(*found, strict=True)) or [[], [], [], []]
                    found.clear()
                    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], ["page_id", "file", "offset", "length"])

                found: list = []
                for key, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    mark = _mark(key, page)
                    # captures of one mark may start in the block before the first one that it heads, and go on over others
                    for block in range(max(0, bisect.bisect_left(heads, mark) - 1), bisect.bisect_right(heads, mark)):
                        if block != at:
                            at, lines = block, [json.loads(x) for x in zlib.decompress(files.read(*places[block])).decode().split("\n")]
                            marks = [_mark(x[0], x[1]) for x in lines]
                        found += [x[1:5] for x in lines[bisect.bisect_left(marks, mark) : bisect.bisect_right(marks, mark)]]
                        if len(found) > BLOCK_LINES * 10:
                            yield out(found)
                yield out(found)

    kind = wanted.schema["page_id"].dataType.simpleString()
    return wanted.select("key", "page_id").repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id").mapInArrow(run, f"page_id {kind}, file string, offset long, length long")


def read(places: DataFrame, scratch: Scratch) -> DataFrame:
    """Places of records -> page_id, url, payload and what the records say; ordered range reads."""
    folder = scratch.path("warc")
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with reading(folder) as files:
            for batch in batches:
                rows = []
                for page, *place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    warc, http, payload = parse(files.read(*place))
                    digest = warc["warc-payload-digest"].removeprefix("sha1:")
                    size = int(http["content-length"])
                    if _page(warc["warc-record-id"]) != page:
                        raise ValueError(f"the index leads to another record than page {page}")
                    if warc["warc-type"] == "response" and (size != len(payload) or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"payload of page {page} is damaged")
                    refers = warc.get("warc-refers-to")
                    rows.append((page, warc["warc-target-uri"], size, digest, warc["warc-type"], refers and _page(refers)))
                kinds = (batch.schema.field("page_id").type, pa.string(), pa.int64(), pa.string(), pa.string(), batch.schema.field("page_id").type)
                cols = list(zip(*rows, strict=True)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], names)

    kind = places.schema["page_id"].dataType.simpleString()
    # a number of our own, and a place's stretch of its file as the key: the rows are few and small, and would be put together into one task
    total = places.agg(F.sum("length").alias("n")).first()["n"] or 0
    stretch = F.floor(F.col("offset") / READ_BYTES).alias("stretch")
    ordered = places.repartition(max(1, -(-total // READ_BYTES)), "file", stretch).sortWithinPartitions("file", "offset")
    records = scratch.save(ordered.mapInArrow(run, f"page_id {kind}, url string, payload_bytes long, payload_digest string, record_type string, refers_to {kind}"), "records")
    return resolved(records)


def resolved(records: DataFrame) -> DataFrame:
    """records with the length and digest of what revisits refer to; one without its response, or with another digest, is an error."""
    whole = records.filter("record_type = 'response'")
    found = whole.filter("page_id is not null").select(F.col("page_id").alias("_page"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest")).distinct()
    # with the digest, as a page_id may come twice with different payloads
    revisits = records.filter("record_type = 'revisit'").join(found, (F.col("refers_to") == F.col("_page")) & (F.col("payload_digest") == F.col("_digest")), "left")
    wrong = F.concat(F.lit("page "), F.col("page_id").cast("string"), F.lit(" revisits a response that does not have its payload"))
    fits = F.coalesce(F.col("payload_bytes") == F.col("_bytes"), F.lit(False))
    digest = F.when(fits, F.col("_digest")).otherwise(F.raise_error(wrong))
    return whole.unionByName(revisits.select("page_id", "url", F.col("_bytes").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to"))


def archive(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """Write, index, look every page up by its key, and read the records back."""
    entries = write(pages, scratch)
    directory = index(entries, scratch)
    places = scratch.save(lookup(entries.select("key", "page_id").distinct(), directory, scratch), "places")
    found = read(places, scratch)
    scratch.drop("first", "entries", "directory", "places")
    return found


def query(spark, sf_dir: str) -> DataFrame:
    found = archive(table(spark, sf_dir, "pages"), Scratch(spark, "warc"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
