"""Content-addressed WARC archive.

Payload bytes are stored once under their SHA-256 digest, exact record headers apart from them; records come back by a
join of the two tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.plans.scratch import discard, materialise

#: Payloads below this size are always written as responses.
MIN_REVISIT_BYTES = 100
CRLF = "\r\n"
#: Fixed by the WARC 1.1 specification.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Archive:
    """``headers``: (header BINARY), one exact header a record; ``payloads``: (digest, payload BINARY), one a digest."""

    headers: DataFrame
    payloads: DataFrame


#: Capture date where the pages bring none; fixed, so that the same pages always give the same bytes.
NO_DATE = "1970-01-01T00:00:00Z"
#: Marks a record whose URL holds line breaks: there %, CR and LF are percent-encoded, and reading undoes it.
ESCAPED = "X-Target-URI-Escaped"


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing if the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def _escaped(url: Column) -> Column:
    for plain, code in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A")):
        url = F.replace(url, F.lit(plain), F.lit(code))
    return url


def _unescaped(url: Column) -> Column:
    for plain, code in (("\n", "%0A"), ("\r", "%0D"), ("%", "%25")):
        url = F.replace(url, F.lit(code), F.lit(plain))
    return url


def _urn(page_id: Column, row: Column) -> Column:
    """A record's id: the page's, empty if null, and the number of the row, which tells repeated rows apart."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), row.cast("string"), F.lit(">"))


def header_of(page_id: Column, row: Column, url: Column, digest: Column, n_bytes: Column, first: Column, date: str) -> Column:
    """The exact header of a record; ``first`` is the (page_id, row) that a revisit refers to, null for a response."""
    revisit, broken = first.isNotNull(), F.coalesce(url.rlike("[\r\n]"), F.lit(False))
    text = F.concat(
        F.lit("WARC/1.1" + CRLF),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", _urn(page_id, row)),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.when(broken, _escaped(url)).otherwise(url)),
        _line(ESCAPED, F.when(broken, F.lit("1"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        _line("WARC-Refers-To", F.when(revisit, _urn(first["page_id"], first["row"]))),
        _line("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(revisit, F.lit(0).cast("long")).otherwise(n_bytes).cast("string")),
        F.lit(CRLF),
    )
    return F.encode(text, "UTF-8")


def write_archive(pages: DataFrame, date: str = NO_DATE) -> Archive:
    """Archive all rows of ``pages`` (page_id, url, html), captured at ``date``.

    A null html has an empty payload, a null url no line. Among payloads of at least MIN_REVISIT_BYTES with one digest,
    the record with the smallest page_id is the response and the others revisit it; repeated rows of that page_id are
    responses too, and so are rows without a page_id. Each record has an id of its own. That digests stand for the same
    bytes is checked by length and a second hash over all rows of a digest; a clash is an error. A digest that very
    many pages share meets only in partial aggregates and in a join whose large partitions Spark splits. An empty table
    gives an empty archive; other columns are ignored.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    digested = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    digested = digested.withColumn("n_bytes", F.octet_length("payload").cast("long"))
    once = digested.groupBy("digest").agg(
        F.any_value("payload").alias("payload"), F.min(F.xxhash64("payload")).alias("h0"),
        F.max(F.xxhash64("payload")).alias("h1"), F.min("n_bytes").alias("n0"), F.max("n_bytes").alias("n1"),
    )
    clash = F.raise_error(F.concat(F.lit("different payloads under digest "), F.col("digest")))
    checked = F.when((F.col("h0") == F.col("h1")) & (F.col("n0") == F.col("n1")), F.col("payload")).otherwise(clash.cast("binary"))
    payloads = materialise(once.select("digest", checked.alias("payload")), "warc-payloads")
    numbered = digested.select("page_id", "url", "digest", "n_bytes", F.monotonically_increasing_id().alias("row"))
    rows = materialise(numbered, "warc-rows")
    large = rows.where((F.col("n_bytes") >= MIN_REVISIT_BYTES) & F.col("page_id").isNotNull()).groupBy("digest")
    least = large.agg(F.min(F.struct("page_id", "row")).alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = least.where("n > 1").select("digest", "first")
    later = (F.col("n_bytes") >= MIN_REVISIT_BYTES) & (F.col("page_id") > F.col("first.page_id"))
    cols = [F.col(c) for c in ("page_id", "row", "url", "digest", "n_bytes")]
    header = header_of(*cols, F.when(later, F.col("first")), date)
    headers = materialise(rows.join(firsts, "digest", "left").select(header.alias("header")), "warc-headers")
    discard(rows)
    return Archive(headers, payloads)


def _field(header: Column, name: str) -> Column:
    """A header line's value; null without such a line."""
    found = F.regexp_extract(header, rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(F.contains(header, F.lit(f"{CRLF}{name}: ")), found)


def _page_id(urn: Column) -> Column:
    return F.nullif(F.regexp_extract(urn, r"^<urn:page:(-?\d*):\d+>$", 1), F.lit("")).cast("long")


def parsed_headers(archive: Archive) -> DataFrame:
    field = lambda name: _field(F.col("text"), name)
    url = F.when(field(ESCAPED).isNotNull(), _unescaped(field("WARC-Target-URI"))).otherwise(field("WARC-Target-URI"))
    return archive.headers.select("header", F.decode("header", "UTF-8").alias("text")).select(
        "header", _page_id(field("WARC-Record-ID")).alias("page_id"), field("WARC-Record-ID").alias("record_id"),
        field("WARC-Type").alias("record_type"), url.alias("url"), field("WARC-Date").alias("date"),
        F.regexp_extract(field("WARC-Payload-Digest"), "^sha256:([0-9a-f]{64})$", 1).alias("digest"),
        _page_id(field("WARC-Refers-To")).alias("refers_to"), field("WARC-Refers-To").alias("refers_to_record"),
    )


def read_records(archive: Archive) -> DataFrame:
    """Original records: parsed header fields, ``payload`` by digest, and the exact bytes of the ``record``.

    A revisit's own block is empty; its payload is the one it refers to.
    """
    end = F.encode(F.lit(CRLF * 2), "UTF-8")
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return parsed_headers(archive).join(archive.payloads, "digest").withColumn("record", F.concat("header", block, end))


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write the archive and read its records back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Length and digest are of the payload as it comes back: cut from the rebuilt record, or for a revisit joined to it.
    """
    own = F.substring("record", F.octet_length("header") + 1, F.octet_length("record") - F.octet_length("header") - 2 * len(CRLF))
    back = F.when(F.col("record_type") == "response", own).otherwise(F.col("payload"))
    records = read_records(write_archive(pages)).withColumn("back", back)
    return records.select("page_id", F.octet_length("back").cast("long").alias("payload_bytes"), F.sha2("back", 256).alias("payload_digest"), "record_type", "refers_to")
