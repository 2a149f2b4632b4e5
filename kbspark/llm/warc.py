"""WARC archives of fetched pages: writing, reading, and assembly of transactions.

Writing gives three records per page, in this order: the request, the response (or a revisit of
an equal payload) and the metadata; request and metadata name the response's record in
WARC-Concurrent-To. Pages whose payloads have the same SHA-1 and at least ``MIN_REVISIT`` bytes
have one response, that of the largest page id; the others are revisits that refer to it. Spark's
text writer writes the files: a record is one value, and the two line ends that close a record are
the line separator, so any store that Spark reaches will do. Files are gzip members of
at most ``RECORDS_PER_FILE`` records, ``.txt.gz`` by name.

Reading parses whole files by their Content-Length headers, one file in memory at a time.

Assembly joins records through their concurrent-to identifiers, also through one more record (a
metadata record concurrent to a request), and gives one nested row per capture. Records with the
same id are one record.

A null html is an empty payload, a null url an absent target, a null page id an absent field; a
repeated page row gives the same record ids and so one capture. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MIN_REVISIT = 1000
RECORDS_PER_FILE = 3000
BROADCAST_GROUPS = 200_000   # of a 40-character digest and an id each

RECORDS = ("record_id string, type string, target_uri string, concurrent_to array<string>, refers_to string, payload_digest string, "
           "payload_bytes long, page_id long, digest_ok boolean, payload string")


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _record(kind: Column, record_id: Column, block: Column, content_type: str, *headers: tuple[str, Column]) -> Column:
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in (
        ("WARC-Type", kind), ("WARC-Record-ID", record_id), *headers, ("Content-Type", F.lit(content_type)), ("Content-Length", F.octet_length(block).cast("string")))]
    return F.concat(F.concat_ws("\r\n", F.lit("WARC/1.0"), *lines), F.lit("\r\n\r\n"), block)


def write_warc(pages: DataFrame, path: str, date: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               min_revisit: int = MIN_REVISIT, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write ``pages`` as archives under ``path``; ``date`` goes into WARC-Date."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"), html.alias("html"),
                        F.sha1(F.encode(html, "UTF-8")).alias("digest"), F.octet_length(html).alias("size"))
    # one row per payload that occurs more than once: broadcast if few, else both sides are shuffled
    groups = rows.where(F.col("size") >= min_revisit).groupBy(F.col("digest").alias("of")).agg(
        F.max("page").alias("last"), F.min("page").alias("first"), F.max_by(F.col("url"), F.col("page")).alias("last_url"))
    groups = groups.where("first < last").select("of", "last", "last_url")
    few = groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    rows = rows.join(F.broadcast(groups) if few else groups, (F.col("of") == F.col("digest")) & (F.col("size") >= min_revisit), "left")
    revisit = F.col("last").isNotNull() & (F.col("page").isNull() | (F.col("page") < F.col("last")))
    clean = lambda c: F.regexp_replace(c, r"[\r\n]", "%0A")
    uri = ("WARC-Target-URI", clean(F.col("url")))
    when = ("WARC-Date", F.lit(date))
    own = _uuid(F.lit("response"), F.col("page"), F.col("digest"), F.col("url"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    with_own = ("WARC-Concurrent-To", own)
    request = _record(F.lit("request"), _uuid(F.lit("request"), F.col("page"), F.col("digest"), F.col("url")),
                      F.concat(F.lit("GET "), F.coalesce(clean(F.col("url")), F.lit("/")), F.lit(" HTTP/1.1\r\n\r\n")),
                      "application/http; msgtype=request", uri, when, with_own)
    first = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    refers = F.when(revisit, _uuid(F.lit("response"), F.col("last"), F.col("digest"), F.col("last_url")))
    profile = F.when(revisit, F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))
    response = _record(first, own, F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html"))), "application/http; msgtype=response",
                       uri, when, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), ("WARC-Profile", profile), ("WARC-Refers-To", refers))
    metadata = _record(F.lit("metadata"), _uuid(F.lit("metadata"), F.col("page"), F.col("digest"), F.col("url")),
                       F.concat_ws("\r\n", F.concat(F.lit("pageId: "), F.col("page").cast("string")), F.lit("")), "application/warc-fields", uri, when, with_own)
    out = rows.select(F.explode(F.array(request, response, metadata)).alias("value"))
    out.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def _unzip(raw: bytes) -> bytes:
    """A file's bytes, of all gzip members if it is compressed."""
    if raw[:2] != b"\x1f\x8b":
        return raw
    out = []
    while raw:
        z = zlib.decompressobj(31)
        out.append(z.decompress(raw))
        raw = z.unused_data
    return b"".join(out)


def parse_records(data: bytes):
    """(headers by lower-case name, with lists of values; block) of each record of an archive."""
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        stop = data.index(b"\r\n\r\n", at)
        headers: dict[str, list[str]] = {}
        for line in data[at:stop].split(b"\r\n")[1:]:
            name, _, value = line.decode().partition(":")
            headers.setdefault(name.strip().lower(), []).append(value.strip())
        size = int(headers["content-length"][0])
        yield headers, data[stop + 4: stop + 4 + size]
        at = stop + 4 + size


def _row(headers: dict[str, list[str]], block: bytes, with_payload: bool) -> dict:
    one = lambda name: (headers.get(name) or [None])[0]
    kind = one("warc-type")
    digest = (one("warc-payload-digest") or "").removeprefix("sha1:") or None
    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
    page = None
    if kind == "metadata":
        fields = dict(x.partition(": ")[::2] for x in block.decode().split("\r\n") if x)
        page = int(fields["pageId"]) if "pageId" in fields else None
    found = hashlib.sha1(payload).hexdigest() if payload is not None else None
    return {"record_id": one("warc-record-id"), "type": kind, "target_uri": one("warc-target-uri"), "concurrent_to": headers.get("warc-concurrent-to", []),
            "refers_to": one("warc-refers-to"), "payload_digest": found or digest, "payload_bytes": None if payload is None else len(payload), "page_id": page,
            "digest_ok": None if payload is None else found == digest, "payload": payload.decode("utf-8", "replace") if with_payload and payload is not None else None}


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of the archives under ``path``; payload digests are computed from the payloads."""
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in RECORDS.split(", "))])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rows = []
                for headers, block in parse_records(_unzip(batch.column("content")[i].as_py())):
                    rows.append(_row(headers, block, with_payload))
                    if len(rows) >= 500:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: capture_id (the response's or revisit's record id), response, requests
    and metadata (structs of the records' columns). Records that lead to no response stand under
    the id they are concurrent to, with a null response."""
    whole = F.struct(*records.columns).alias("record")
    main = records.where("type IN ('response', 'revisit')").select(F.col("record_id").alias("capture_id"), whole)
    side = records.where("type NOT IN ('response', 'revisit')").select("record_id", F.explode_outer("concurrent_to").alias("target"), whole)
    via = side.select(F.col("record_id").alias("target"), F.col("target").alias("further")).where("further IS NOT NULL").distinct()
    side = side.join(via, "target", "left").select(F.coalesce("further", "target", "record_id").alias("capture_id"), "record")
    kind = F.col("record.type")
    return main.unionByName(side).groupBy("capture_id").agg(
        F.max(F.when(kind.isin("response", "revisit"), F.col("record"))).alias("response"),
        F.sort_array(F.collect_set(F.when(kind == "request", F.col("record")))).alias("requests"),
        F.sort_array(F.collect_set(F.when(~kind.isin("response", "revisit", "request"), F.col("record")))).alias("metadata"))


def captures_with_origin(captures: DataFrame) -> DataFrame:
    """Captures with origin: (capture_id, page_id, payload_bytes) of the response a revisit refers to."""
    of = captures.where("response.type = 'response'").select(
        F.col("capture_id").alias("_of"), F.struct("capture_id", F.col("metadata")[0]["page_id"].alias("page_id"), "response.payload_bytes").alias("origin"))
    # only payloads that some revisit names are wanted on the right
    named = captures.where("response.type = 'revisit'").select(F.col("response.refers_to").alias("_of")).distinct()
    return captures.join(of.join(named, "_of", "left_semi"), F.col("response.refers_to") == F.col("_of"), "left").drop("_of")
