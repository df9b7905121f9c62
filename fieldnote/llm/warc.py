"""WARC archives: written from a table of pages, read back, and assembled to one row per capture.

Writing.  A page becomes a transaction of three records: a request, a response or revisit, and a
metadata record that holds the page's key; request and metadata name the response as
concurrent.  Of pages with equal payloads of ``least`` bytes or more the one with the largest key
is the response, and the others are revisits that refer to it and hold no payload.  Payloads are
equal if their SHA-1, length and XXH64 are.  Records are strings that the JVM builds and Spark's
text writer puts down, ``CR LF CR LF`` between them, in gzip files of about ``volume_bytes``.

Reading.  Every file is one task's stream of records, cut by Content-Length, so that a
payload may hold anything; several gzip members, one for each record, are read as well.  What
can't be parsed is a row with ``error`` and ends its file.

Assembly.  ``captures`` joins the request and metadata records to responses, revisits and
resources through their concurrent-to identifiers, whichever side names the other, and nests them: one
row per capture.  ``unplaced`` returns the records that no capture holds.

Scale: payloads are never shuffled while the payloads that occur twice fit a broadcast of checked
size; beyond it they are joined by a salted key, so that a payload of a third of all pages spreads over
``SALTS`` tasks.  Assembly moves identifiers, digests and fields, and payloads only if asked for.  A file
is read whole by one task (Spark's binary files end at 2 GB).

Defined results: a null payload is empty; a null url is a record without target; a null key has no
``page-id`` field, counts as the least and comes back as null; of equal payloads under one key that with the largest url is
the response, and of rows alike in all three one is, whichever order they come in; blanks and line ends within a url or key are percent-encoded; records of one
id are one record, as the standard says; a capture of more than ``PER_ROW`` requests and metadata
records gets further rows (``part`` 1 and on); a revisit whose response is in no archive keeps the digest that it
claims and has a null ``referred``; very long payloads get a file of their own; an empty table writes no record
and reads as none; other columns are ignored, so that no name can clash.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from fieldnote.llm.workers import ready
from fieldnote.session import cut_lineage, small

LEAST, VOLUME_BYTES, PER_ROW, SALTS = 1000, 32 << 20, 1000, 32
# Fixed values of the standard.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ANCHORS, ATTACHED = ("response", "revisit", "resource"), ("request", "metadata")
END = "\r\n"

RECORD = pa.schema(
    [
        ("record_id", pa.string()),
        ("type", pa.string()),
        ("concurrent_to", pa.list_(pa.string())),
        ("refers_to", pa.string()),
        ("target_uri", pa.string()),
        ("date", pa.string()),
        ("status", pa.int32()),
        ("fields", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("claimed_digest", pa.string()),
        ("payload", pa.binary()),
        ("path", pa.string()),
        ("error", pa.string()),
    ]
)
RECORD_DDL = (
    "record_id string, type string, concurrent_to array<string>, refers_to string, target_uri string, date string, status int, "
    "fields array<struct<name: string, value: string>>, payload_bytes long, payload_digest string, claimed_digest string, "
    "payload binary, path string, error string"
)


def lookup(rows: DataFrame, table: DataFrame, on: list[str], spread: Column) -> DataFrame:
    """``rows`` left-joined with a ``table`` of unique keys: broadcast if its counted size allows, otherwise by
    a key salted with ``spread``, so that no key of ``rows`` lands in one task."""
    found = small(table)
    if found is not table:
        return rows.join(found, on, "left")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, [*on, "_salt"], "left").drop("_salt")


# ---- writing


def _one_line(value: Column) -> Column:
    for raw, code in (("\r", "%0D"), ("\n", "%0A"), (" ", "%20"), ("\t", "%09")):
        value = F.replace(value, F.lit(raw), F.lit(code))
    return value


def _id(kind: str, place: Column) -> Column:
    h = F.md5(F.concat_ws("/", F.lit(kind), place))
    part = lambda i, n: F.substring(h, i, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-8"), part(18, 3), F.lit("-"), part(21, 12), F.lit(">"))


def _base32(digest: Column) -> Column:
    """40 hex digits as 32 letters, the form in which archives keep SHA-1."""
    digits = [F.lpad(F.conv(F.substring(digest, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record(kind: Column | str, record_id: Column, block: Column, content: str, date: str, *headers: tuple[str, Column]) -> Column:
    """Headers with null values are left out."""
    lines = [("WARC-Type", F.lit(kind) if isinstance(kind, str) else kind), ("WARC-Record-ID", record_id), ("WARC-Date", F.lit(date)), *headers]
    lines += [("Content-Type", F.lit(content)), ("Content-Length", F.octet_length(block).cast("string"))]
    named = [F.concat(F.lit(f"{name}: "), value, F.lit(END)) for name, value in lines]
    return F.concat(F.lit(f"WARC/1.1{END}"), *[F.coalesce(x, F.lit("")) for x in named], F.lit(END), block)


@F.pandas_udf(LongType())
def _volumes(sizes: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Number of the volume of each row of a task, given sizes in units of a volume."""
    held = 0.0
    for batch in sizes:
        upto = batch.cumsum() + held
        held = float(upto.iloc[-1]) if len(upto) else held
        yield upto.floordiv(1).astype("int64")


def _judged(rows: DataFrame, least: int) -> DataFrame:
    """``rows`` (key, url, payload, digest, size, sum64) with ``again`` (a revisit), ``mark`` (tells a response that is referred
    to) and ``refers`` (the mark that a revisit refers to)."""
    same = ["digest", "size", "sum64"]
    alike = rows.filter(F.col("size") >= least).groupBy(*same, "key", "url").agg(F.count(F.lit(1)).alias("c"))
    first = alike.groupBy(*same).agg(F.max(F.struct("key", "url", "c")).alias("kept"), F.sum("c").alias("n"))
    first = cut_lineage(first.filter("n > 1").select(*same, "kept"))
    joined = lookup(rows, first, same, F.monotonically_increasing_id())
    is_first = F.col("key").eqNullSafe(F.col("kept.key")) & F.col("url").eqNullSafe(F.col("kept.url"))
    referred = F.concat_ws("/", "digest", F.col("size").cast("string"), F.col("sum64").cast("string"))
    joined = joined.select(
        "key", "url", "payload", *same, "kept",
        F.when(F.col("kept").isNull(), False).otherwise(~is_first).alias("again"),
        F.when(F.col("kept").isNotNull(), referred).alias("refers"),
    )
    several = F.coalesce(~F.col("again") & (F.col("kept.c") > 1), F.lit(False))
    out = joined.filter(~several)
    if not first.filter("kept.c > 1").isEmpty():  # rows alike in key, url and payload: one of them is the response
        one = joined.filter(several).dropDuplicates([*same, "key", "url"])
        copies = one.withColumn("again", F.explode(F.expr("transform(sequence(1, kept.c), i -> i > 1)")))
        out = out.unionByName(copies.withColumn("payload", F.when(~F.col("again"), F.col("payload"))))
    return out.withColumn("mark", F.when(F.col("refers").isNotNull() & ~F.col("again"), F.col("refers"))).drop("kept")


def transactions(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """transaction (the three records as one string) and size of every page."""
    rows = pages.select(
        F.col(f"`{key}`").alias("key"), _one_line(F.col(f"`{url}`")).alias("url"), F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit("")).alias("payload")
    )
    rows = rows.withColumn("digest", F.sha1(F.col("payload"))).withColumn("size", F.octet_length("payload").cast("long"))
    rows = _judged(rows.withColumn("sum64", F.xxhash64("payload")), least)
    rows = rows.withColumn("place", F.coalesce("mark", F.monotonically_increasing_id().cast("string")))
    again, place = F.col("again"), F.col("place")

    own = _id("response", place)
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("size").cast("string"), F.lit(END * 2))
    target, concurrent = ("WARC-Target-URI", F.col("url")), ("WARC-Concurrent-To", own)
    path = F.regexp_extract("url", r"^[^:/?#]*://[^/?#]*([^#]*)", 1)
    host = F.regexp_extract("url", r"^[^:/?#]*://([^/?#]*)", 1)
    request = F.concat(F.lit("GET "), F.when(path != "", path).otherwise("/"), F.lit(f" HTTP/1.1{END}Host: "), host, F.lit(END * 2))
    page = F.coalesce(F.concat(F.lit("page-id: "), _one_line(F.col("key").cast("string")), F.lit(END)), F.lit(""))
    records = [
        _record("request", _id("request", place), F.coalesce(request, F.lit(f"GET / HTTP/1.1{END * 2}")), "application/http; msgtype=request", date, concurrent, target),
        _record(
            F.when(again, "revisit").otherwise("response"), own, F.when(again, head).otherwise(F.concat(head, F.col("payload"))), "application/http; msgtype=response", date,
            target, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), _base32(F.col("digest")))),
            ("WARC-Profile", F.when(again, PROFILE)), ("WARC-Refers-To", F.when(again, _id("response", F.col("refers")))),
        ),
        _record("metadata", _id("metadata", place), page, "application/warc-fields", date, concurrent, target),
    ]
    return rows.select(F.concat_ws(END * 2, *records).alias("transaction"), F.when(again, 0).otherwise(F.col("size")).alias("size"))


def write(pages: DataFrame, path: str, volume_bytes: int = VOLUME_BYTES, **more) -> None:
    """Archives of all pages below ``path``, a folder that every executor reaches."""
    rows = transactions(ready(pages), **more)
    volume = _volumes((F.col("size") + 1000).cast("double") / float(volume_bytes))
    rows.select("transaction", volume.alias("volume")).write.partitionBy("volume").option("compression", "gzip").option("lineSep", END * 2).text(path)


# ---- reading


def _digest(value: str | None) -> str | None:
    """Labelled SHA-1 in base 32 or hex as lower-case hex."""
    label, _, digest = (value or "").partition(":")
    if label.lower() != "sha1" or not digest:
        return None
    try:
        return digest.lower() if len(digest) == 40 else base64.b32decode(digest.upper()).hex()
    except ValueError:
        return None


def _headers(stream) -> list[tuple[str, str]]:
    out = []
    while True:
        line = stream.readline()
        if not line:
            raise ValueError("the file ends within a header")
        text = line.rstrip(b"\r\n").decode("utf-8", "replace")
        if not text:
            return out
        if text[0] in " \t" and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {text.strip()}")
        else:
            name, colon, value = text.partition(":")
            if not colon:
                raise ValueError(f"no header: {text[:80]}")
            out.append((name.strip().lower(), value.strip()))


def parse(stream, payloads: bool = False) -> Iterator[dict]:
    """The records of an uncompressed binary stream."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no record where one should begin")
        headers = _headers(stream)
        named = dict(reversed(headers))
        length = int(named["content-length"])
        block = stream.read(length)
        if len(block) < length:
            raise ValueError("the file ends within a record")
        kind, content = named.get("warc-type", ""), named.get("content-type", "")
        body, status, fields = block, None, None
        if content.startswith("application/http"):
            head, _, body = block.partition(b"\r\n\r\n")
            words = head.split(b"\r\n", 1)[0].split(None, 2)
            status = int(words[1]) if kind != "request" and len(words) > 1 and words[1].isdigit() else None
        elif content.startswith("application/warc-fields"):
            fields = [{"name": n, "value": v} for n, v in _headers(io.BytesIO(block + b"\r\n\r\n"))]
        claimed = _digest(named.get("warc-payload-digest"))
        real = kind != "revisit"
        yield {
            "record_id": named.get("warc-record-id"),
            "type": kind,
            "concurrent_to": [v for n, v in headers if n == "warc-concurrent-to"],
            "refers_to": named.get("warc-refers-to"),
            "target_uri": named.get("warc-target-uri"),
            "date": named.get("warc-date"),
            "status": status,
            "fields": fields,
            "payload_bytes": len(body) if real else None,
            "payload_digest": hashlib.sha1(body).hexdigest() if real else claimed,
            "claimed_digest": claimed,
            "payload": body if payloads and real else None,
        }


def _files(content: pa.Array, path: pa.Array, payloads: bool) -> Iterator[pa.RecordBatch]:
    for raw, name in zip(content, path):
        data, rows, held = pa.py_buffer(raw.as_buffer()), [], 0
        source = io.BytesIO(data)
        if data.size > 1 and bytes(data[:2]) == b"\x1f\x8b":
            source = gzip.GzipFile(fileobj=source)
        error = None
        found = parse(io.BufferedReader(source) if isinstance(source, gzip.GzipFile) else source, payloads)
        while error is None:
            try:
                row = next(found, None)
            except (ValueError, KeyError, EOFError, OSError) as e:
                row, error = {}, f"{type(e).__name__}: {e}"
            if row is None:
                break
            rows.append({**row, "path": name.as_py(), "error": error})
            held += len(row.get("payload") or b"") + 500
            if held > 8 << 20:
                yield pa.RecordBatch.from_pylist(rows, RECORD)
                rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, RECORD)


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Every record of the archives below ``path``; the payload itself only where asked for."""

    def run(batches):
        for b in batches:
            yield from _files(b.column("content"), b.column("path"), payloads)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return ready(files).mapInArrow(run, RECORD_DDL)


# ---- assembly


def _links(records: DataFrame) -> DataFrame:
    """anchor and the request or metadata record that goes with it."""
    others = records.filter(F.col("type").isin(*ATTACHED)).dropDuplicates(["record_id"])
    anchors = records.filter(F.col("type").isin(*ANCHORS) & (F.size("concurrent_to") > 0))
    named = anchors.select(F.col("record_id").alias("anchor"), F.explode("concurrent_to").alias("record_id")).distinct()
    one = F.struct("record_id", "type", "target_uri", "date", "fields", "payload").alias("one")
    return others.select(F.explode(F.array_distinct("concurrent_to")).alias("anchor"), one).unionByName(
        others.join(named, "record_id").select("anchor", one)
    )


def captures(records: DataFrame) -> DataFrame:
    """One row per capture: its record, and nested in it ``requests`` and ``metadata``.  The records are cut off in the shared
    folder, so that the archives are parsed once."""
    records = cut_lineage(records)
    links = _links(records)
    many = links.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > PER_ROW)
    parts = F.ceil(F.coalesce(F.col("n"), F.lit(1)) / PER_ROW)
    dealt = lookup(links, cut_lineage(many), ["anchor"], F.col("one.record_id")).withColumn("part", F.pmod(F.xxhash64("one.record_id"), parts))
    of = lambda kind: F.sort_array(F.collect_set(F.when(F.col("one.type") == kind, F.col("one"))))
    nested = dealt.groupBy("anchor", "part").agg(of("request").alias("requests"), of("metadata").alias("metadata"))
    anchors = records.filter(F.col("type").isin(*ANCHORS)).dropDuplicates(["record_id"]).drop("concurrent_to", "fields", "error")
    none = F.array().cast(nested.schema["requests"].dataType)
    joined = anchors.join(nested.withColumnRenamed("anchor", "record_id"), "record_id", "left")
    return joined.withColumns({"part": F.coalesce("part", F.lit(0).cast("long"))} | {c: F.coalesce(c, none) for c in ("requests", "metadata")})


def unplaced(records: DataFrame) -> DataFrame:
    """Requests and metadata records that no capture names or is named by."""
    anchors = records.filter(F.col("type").isin(*ANCHORS)).select(F.col("record_id").alias("anchor")).distinct()
    placed = _links(records).join(anchors, "anchor", "left_semi").select("one.record_id").distinct()
    return records.filter(F.col("type").isin(*ATTACHED)).join(placed, "record_id", "left_anti")


def field(metadata: Column, name: str) -> Column:
    """The first value of a field of a capture's metadata."""
    fields = F.flatten(F.transform(metadata, lambda m: F.coalesce(m["fields"], F.array().cast("array<struct<name: string, value: string>>"))))
    return F.get(F.transform(F.filter(fields, lambda f: f["name"] == name), lambda f: f["value"]), F.lit(0))


def resolved(found: DataFrame) -> DataFrame:
    """Captures with ``page`` (the key that their metadata holds) and for revisits ``referred`` (that of the response) and the
    bytes of the full payload.  The input is cut off in the shared folder."""
    rows = cut_lineage(found.withColumn("page", field(F.col("metadata"), "page-id")))
    again = rows.filter("type = 'revisit'").drop("payload_bytes")
    wanted = again.select(F.col("refers_to").alias("record_id")).distinct()
    responses = rows.filter("type = 'response' and part = 0").join(wanted, "record_id", "left_semi").select(
        F.col("record_id").alias("refers_to"), F.col("page").alias("referred"), "payload_bytes"
    )
    whole = lookup(again, responses, ["refers_to"], F.col("record_id"))
    return rows.filter("type != 'revisit'").withColumn("referred", F.lit(None).cast("string")).unionByName(whole.select(*rows.columns, "referred"))
