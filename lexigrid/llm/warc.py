"""WARC archives: writing captures, reading records back, and assembling transactions.

Each capture is written as a request, a response (or a revisit of an equal payload) and a metadata record; request and
metadata name the response through WARC-Concurrent-To. Archives are gzip files with a member for each record, written
wherever Spark writes: its text writer ends each row with the byte 0, with which every gzip member of under 16 MiB ends.

Archives of other writers are read too: plain or gzip, with any number of records in a member. They are inflated in small
parts and cut by Content-Length alone, so payloads may hold anything and memory follows the largest record. Every record
gives a row, of unknown kinds too; header fields that it lacks are null.

Nulls: a null payload is empty and a null url becomes 'about:blank'; rows without an id get none back and are responses.
Rows with repeated or null ids are captures of their own, with record ids of their own. Of equal payloads of at least
`least_bytes`, the captures with the largest id are responses and those with smaller ids are revisits of one of them.
Empty tables give empty archives and results.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm.common import hot_salts, salted_join, scratch, written

RECORD = "record_id string, type string, concurrent_to array<string>, refers_to string, uri string, date string, payload_digest string, n_bytes bigint, verified boolean, capture string, payload binary"
DATE = "2024-01-01T00:00:00Z"
RECORDS_A_FILE = 3000


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(kind: str, name: str, uri: str, body: str, more: str = "", media: str = "application/http") -> str:
    size = len(body.encode())
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{name}>\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: {uri}\r\n{more}Content-Type: {media}\r\nContent-Length: {size}\r\n\r\n{body}\r\n\r\n"


def _member(record: str) -> bytes:
    """The record as a gzip member without its last byte, which is 0 (the size's highest byte); where it isn't, an empty
    member is added, which ends so."""
    data = zlib.compress(record.encode(), 6, 31)
    return (data if not data[-1] else data + zlib.compress(b"", 6, 31))[:-1]


def captures(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html, name, and refers: the name of the capture that this one revisits, or null.

    A name is the page_id, if any, and the row's place in a written table of the pages (file and row number), so it is
    unique whatever the ids, and the same when a task runs again. The largest id of each payload and its revisits are
    found from digests alone, with a very common payload's dealt over several tasks; pages meet them by name.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("about:blank")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = written(rows.withColumn("sha1", F.unhex(F.sha1(F.col("html").cast("binary")))).withColumn("n_bytes", F.octet_length("html")), "pages")
    file = lambda k: F.regexp_extract("_metadata.file_name", r"^part-(\d+)-.*-c(\d+)\.", k).cast("long")
    name = F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(":"), F.concat_ws("-", file(1), file(2), F.col("_metadata.row_index")))
    rows = rows.withColumn("name", name)
    known = rows.select("page_id", "name", "sha1").filter((F.col("n_bytes") >= least_bytes) & F.col("page_id").isNotNull())
    first = known.groupBy("sha1").agg(F.max(F.struct("page_id", "name")).alias("last"), F.min("page_id").alias("other"), F.count("*").alias("n"))
    copied = written(first.filter(F.col("last.page_id") > F.col("other")).select("sha1", "last", "n"), "copied")
    hot, _ = hot_salts(copied, "sha1", "n")
    revisits = salted_join(known, copied.select("sha1", "last"), hot, "sha1", F.col("name")).filter(F.col("page_id") < F.col("last.page_id"))
    # Names are the smaller side, which Spark broadcasts up to its own size limit; beyond it, names are unique, so no task is hot.
    revisits = written(revisits.select("name", F.col("last.name").alias("refers")), "revisits")
    return rows.join(revisits, "name", "left").select("page_id", "url", "html", "name", "refers")


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                out = []
                for page, url, html, own, refers in zip(*(c.to_pylist() for c in batch.slice(at, 500).columns)):
                    uri = " ".join(url.split()) or "about:blank"
                    name = f"urn:capture:{own}:response"
                    tied = f"WARC-Concurrent-To: <{name}>\r\n"
                    data = html.encode()
                    length = f"WARC-Payload-Digest: sha1:{digest32(data)}\r\n"
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(data)}\r\n\r\n"
                    if refers is None:
                        main = _record("response", name, uri, head + html, length, "application/http; msgtype=response")
                    else:
                        more = f"{length}WARC-Refers-To: <urn:capture:{refers}:response>\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"
                        main = _record("revisit", name, uri, head, more, "application/http; msgtype=response")
                    ask = _record("request", name.replace(":response", ":request"), uri, f"GET {uri} HTTP/1.1\r\n\r\n", tied, "application/http; msgtype=request")
                    about = _record("metadata", name.replace(":response", ":metadata"), uri, f"capture: {'' if page is None else page}\r\n", tied, "application/warc-fields")
                    out += [_member(ask), _member(main), _member(about)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    with scratch(pages.sparkSession):  # the written pages go when the archives are there
        rows = captures(pages, least_bytes).mapInArrow(records, "value binary").select(F.col("value").cast("string"))
        rows.write.option("maxRecordsPerFile", RECORDS_A_FILE).option("lineSep", "\0").text(path)


def inflated(data: memoryview, step: int = 1 << 14) -> Iterator[bytes]:
    """The bytes of a plain file or of all members of a gzip file, in parts of about `step` bytes."""
    at = 0
    if bytes(data[:2]) != b"\x1f\x8b":
        while at < len(data):
            yield bytes(data[at : at + step])
            at += step
        return
    while at < len(data):
        if data[at] == 0:  # padding after a member
            at += 1
            continue
        tool = zlib.decompressobj(31)
        while not tool.eof and at < len(data):
            given = data[at : at + step]
            out = tool.decompress(given, 64 * step)
            at += len(given) - len(tool.unused_data if tool.eof else tool.unconsumed_tail)
            yield out
        if not tool.eof:
            yield tool.flush()
        if not tool.eof:
            raise ValueError("a gzip member is cut off")


def parse(parts: Iterable[bytes]) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """Header fields (names in lower case, with all their values) and block of each record."""
    held, source = bytearray(), iter(parts)
    while True:
        while held[:1] in (b"\r", b"\n"):
            del held[:1]
        end = held.find(b"\r\n\r\n")
        size, fields = 0, {}
        if end >= 0:
            name = ""
            for line in bytes(held[:end]).decode("utf-8", "replace").split("\r\n")[1:]:
                if line[:1] in (" ", "\t") and name:  # a folded line goes on with the one before
                    fields[name][-1] = f"{fields[name][-1]} {line.strip()}".strip()
                    continue
                name, _, value = line.partition(":")
                name = name.strip().lower()
                fields.setdefault(name, []).append(value.strip())
            size = int(fields["content-length"][0])
        if end < 0 or len(held) < end + 4 + size:
            more = next(source, None)
            if more is not None:
                wanted = end + 4 + size
                held += more
                while end >= 0 and len(held) < wanted and (more := next(source, None)) is not None:
                    held += more
                continue
            if not held:
                return
            raise ValueError("an archive ends inside a record")
        yield fields, bytes(held[end + 4 : end + 4 + size])
        del held[: end + 4 + size]


def _row(fields: dict[str, list[str]], block: bytes) -> tuple:
    """A record as a row. The payload is the block after its HTTP head, for responses; of a revisit, its size is that
    which the HTTP head states. verified: whether the payload has the SHA-1 that the record states, if it does."""
    one = lambda name: fields.get(name, [None])[0]
    bare = lambda x: x.strip("<>") if x else None
    kind, stated = (one("warc-type") or "").lower() or None, one("warc-payload-digest")
    sha1 = stated.partition(":")[2] if stated and stated.lower().startswith("sha1:") else None
    payload, size, digest, verified, capture = None, None, None, None, None
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        size, digest = len(payload), digest32(payload)
        verified = None if sha1 is None else sha1.upper() == digest or sha1.lower() == hashlib.sha1(payload).hexdigest()
    elif kind == "revisit":
        digest = sha1
        for line in block.partition(b"\r\n\r\n")[0].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length" and value.strip().isdigit():
                size = int(value)
    elif kind == "metadata":
        for line in block.decode("utf-8", "replace").split("\r\n"):
            if line.startswith("capture:"):
                capture = line[8:].strip()
    tied = [bare(x) for x in dict.fromkeys(fields.get("warc-concurrent-to", [])) if bare(x)]
    return bare(one("warc-record-id")), kind, tied, bare(one("warc-refers-to")), bare(one("warc-target-uri")), one("warc-date"), digest, size, verified, capture, payload


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of plain or gzip archives."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for fields, block in parse(inflated(memoryview(content.as_buffer()))):
                    rows.append(_row(fields, block))
                    size += len(block)
                    if len(rows) == 300 or size > 8 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(cut, RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}
    names, types = zip(*(x.split() for x in RECORD.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, k in zip(zip(*rows), types)], names)


def _main(records: DataFrame) -> DataFrame:
    return records.filter(F.col("type").isin("response", "revisit"))


def parts(records: DataFrame, kind: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """record_id (of a response or revisit) and part, a struct of part_id, uri, date and columns, for each record of that kind
    which names it as concurrent or which it names."""
    own = records.filter(F.col("type") == kind)
    part = F.struct(F.col("record_id").alias("part_id"), "uri", "date", *columns).alias("part")
    names_it = own.select(F.explode("concurrent_to").alias("record_id"), part)
    named = _main(records).select("record_id", F.explode("concurrent_to").alias("named"))
    named = named.join(own.select(F.col("record_id").alias("named"), part), "named").select("record_id", "part")
    return names_it.unionByName(named)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: the response or revisit with its request and metadata, joined by concurrent-to.

    records: a written table of read_archives(), without payload where it isn't wanted. Either record may name the other. Of several requests or metadata records
    of a capture, which are counted, the row has that with the least id; parts() gives them all. A response that nothing
    names has null request and metadata; a request without its response gives no row, nor do records of other kinds.
    """
    payload = [c for c in records.columns if c == "payload"]
    out = _main(records).select("record_id", F.struct("type", "uri", "date", "payload_digest", "n_bytes", "verified", "refers_to", *payload).alias("response"))
    for kind, columns in (("request", ()), ("metadata", ("capture",))):
        found = parts(records, kind, columns).groupBy("record_id", "part.part_id").agg(F.min("part").alias("part"))
        found = found.groupBy("record_id").agg(F.min("part").alias(kind), F.count("*").alias(f"n_{kind}"))
        out = out.join(found, "record_id", "left")
    return out


def report(captures: DataFrame) -> DataFrame:
    return captures.select(
        F.expr("cast(nullif(metadata.capture, '') as bigint)").alias("page_id"),
        F.col("response.n_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.expr("cast(regexp_extract(response.refers_to, 'urn:capture:([0-9-]+):', 1) as bigint)").alias("refers_to"),
    )
