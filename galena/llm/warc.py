"""A content-addressed WARC archive: every payload is stored once under its SHA-256, the exact header block of every
record is kept apart, and records are reconstructed by a join of the two.

Layout of an archive folder, both parts Parquet: ``payloads`` (digest, payload) with one row per distinct payload, and
``records`` (digest, header), the header block byte for byte. A payload is verified against its digest whenever it
is read. The block of a revisit is empty, as its payload stands in the record that it refers to, and its header says so.
``export`` writes plain WARC files, with the same headers: a record ends in CRLF CRLF, which Spark's text writer takes as its line end.

Defined cases: a null html is an empty payload; empty payloads are payloads like others; repeated rows of one page_id
and payload give a record each, all of the type that this page_id has and each with a record id of its own; revisits refer to the first of
the smallest page_id's responses, by url; payloads are of any length that a string can have; a null url gives an empty
WARC-Target-URI; a null page_id sorts after all others; other columns are ignored; an empty table gives an archive without records.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 in upper-case base32: 40 hexadecimal digits are four groups of 40 bits, of 8 base32 digits each."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(page: Column, url: Column, nth: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("/", page.cast("string"), digest, nth.cast("string"), url))
    return F.concat(F.lit("<urn:uuid:"), *[x for i, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ([F.lit("-")] if i else []) + [F.substring(h, a, n)]], F.lit(">"))


def header(date: str) -> Column:
    """The header block of a record (page, url, nth, digest, sha1, n_bytes, owner). Header values hold no line ends: those of a URL are percent-encoded."""
    page, owner = F.col("page"), F.col("owner.page")
    kind = F.when(page.eqNullSafe(owner), "response").otherwise("revisit")
    uri = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    revisit = F.concat(
        F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}WARC-Refers-To: "),
        record_id(owner, F.col("owner.url"), F.lit(1), F.col("digest")), F.lit(f"{CRLF}X-Refers-To-Page: "), F.coalesce(owner.cast("string"), F.lit("")), F.lit(CRLF),
    )
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), kind, F.lit(f"{CRLF}WARC-Record-ID: "), record_id(page, F.col("url"), F.col("nth"), F.col("digest")),
        F.lit(f"{CRLF}WARC-Date: {date}{CRLF}WARC-Target-URI: "), uri, F.lit(f"{CRLF}X-Page: "), F.coalesce(page.cast("string"), F.lit("")), F.lit(CRLF),
        F.when(kind == "revisit", revisit).otherwise(F.lit("")),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1"), F.lit(f"{CRLF}Content-Type: text/html{CRLF}Content-Length: "),
        F.when(kind == "revisit", 0).otherwise(F.col("n_bytes")).cast("string"), F.lit(CRLF),
    )


def write_archive(pages: DataFrame, path: str, page: str = "page_id", url: str = "url", html: str = "html", date: str | None = None) -> None:
    """Write the archive, dated now unless told otherwise. The payload is shuffled once, after copies within a task have been put together."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    own = pages.select(F.col(page).alias("page"), F.col(url).alias("url"), F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"))
    own = own.withColumn("digest", F.sha2("payload", 256))
    first = F.min(F.struct(F.col("page").isNull().alias("none"), "page", "url"))
    own.groupBy("digest").agg(F.first("payload").alias("payload"), first.alias("owner")).write.option("compression", "zstd").parquet(f"{path}/payloads")
    owners = pages.sparkSession.read.parquet(f"{path}/payloads").select(F.col("digest").alias("stored"), "owner")
    facts = own.select("page", "url", "digest", F.octet_length("payload").alias("n_bytes"), base32_sha1(F.col("payload")).alias("sha1"))
    # equal rows are counted, and numbered by the count
    facts = facts.groupBy("digest", "page", "url", "n_bytes", "sha1").agg(F.count("*").alias("n")).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    joined = facts.join(owners, F.col("digest") == F.col("stored"))
    joined.select("digest", header(date).alias("header")).write.option("compression", "zstd").parquet(f"{path}/records")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record whole: header and the payload of its digest, verified."""
    payloads = spark.read.parquet(f"{path}/payloads").select("digest", "payload")
    intact = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest "), F.col("digest"))))
    payloads = payloads.select(F.col("digest").alias("stored"), intact.alias("payload"))
    records = spark.read.parquet(f"{path}/records")
    return records.join(payloads, F.col("digest") == F.col("stored")).select("header", "payload")


def field(block: Column, name: str) -> Column:
    return F.regexp_extract(block, rf"(?:^|\n){name}: ([^\r\n]*)\r\n", 1)


def parse(records: DataFrame) -> DataFrame:
    """The contract's columns of reconstructed records, the payload's facts taken from the payload itself."""
    block = F.col("header")
    return records.select(
        F.nullif(field(block, "X-Page"), F.lit("")).cast("long").alias("page_id"),
        F.nullif(field(block, "WARC-Target-URI"), F.lit("")).alias("url"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
        field(block, "WARC-Type").alias("record_type"),
        F.nullif(field(block, "X-Refers-To-Page"), F.lit("")).cast("long").alias("refers_to"),
        (field(block, "Content-Length").cast("long") == F.when(field(block, "WARC-Type") == "revisit", 0).otherwise(F.octet_length("payload"))).alias("length_agrees"),
        (field(block, "WARC-Payload-Digest") == F.concat(F.lit("sha1:"), base32_sha1(F.col("payload")))).alias("digest_agrees"),
    )


def export(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Plain WARC files."""
    revisit = field(F.col("header"), "WARC-Type") == "revisit"
    whole = F.concat(F.encode("header", "UTF-8"), F.encode(F.lit(CRLF), "UTF-8"), F.when(revisit, F.lit(b"")).otherwise(F.col("payload")))
    records.select(whole.cast("string").alias("value")).write.option("lineSep", CRLF * 2).option("compression", compression).text(path)
