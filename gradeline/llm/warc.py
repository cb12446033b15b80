"""Content-addressed WARC archive.

Payload bytes are stored once for each SHA-256 digest; the exact header bytes of every record (WARC
and HTTP) are a table of their own that names the digest. Reading joins the two again: header bytes,
payload bytes and record end give back the original record, whose fields are then read from these
bytes. Stored bytes are hashed again when they are read, and a record whose payload does not have
the digest that its header names raises an error. When a store is written, payloads that share a
digest are compared on full bytes.

Of records with equal payloads of at least 100 bytes, that of the smallest page_id is a response
and the others are revisits of it. Defined results: null html is an empty payload, a null url an
empty target; carriage returns and line feeds in a url become %0D and %0A, all its other characters
stay, and header lines are told apart by CR LF alone, so no url can pass for another field; null
page_ids come first; of rows that repeat page_id and payload one is the response; other columns
don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeline.llm.shared import HEAVY_PARTS, join_by_key, new_dir, write

#: Smaller payloads are never revisited.
LEAST_REVISITED = 100
_EOL = "\r\n"


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("/", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.concat_ws("-", F.substr(h, F.lit(1), F.lit(8)), F.substr(h, F.lit(9), F.lit(4)), F.substr(h, F.lit(13), F.lit(4)), F.substr(h, F.lit(17), F.lit(4)), F.substr(h, F.lit(21), F.lit(12)))


def _lines(*fields: tuple[str, Column]) -> Column:
    """Header lines; fields with a null value are left out."""
    return F.concat_ws("", *[F.concat(F.lit(name), value.cast("string"), F.lit(_EOL)) for name, value in fields])


def write_archive(pages: DataFrame, path: str | None = None, date: str = "2025-01-01T00:00:00Z") -> str:
    """Write the archive of ``pages`` (page_id, url, html) and return its folder."""
    spark = pages.sparkSession
    path = path or new_dir(spark, "warc")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    digested = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"),
        F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("size"),
    ).withColumn("locator", F.monotonically_increasing_id())
    write(digested, f"{path}/landing")
    rows = spark.read.schema(digested.schema).parquet(f"{path}/landing")

    # Copies collapse in the scanning tasks already; what is left differs in digest or bytes.
    store = pages.select(F.sha2(payload, 256).alias("digest"), payload.alias("payload")).distinct()
    write(store, f"{path}/payloads")

    groups = rows.groupBy("digest").agg(F.min(F.struct("page_id", "locator", "url")).alias("first"), F.count(F.lit(1)).alias("group_size"))
    write(groups, f"{path}/digests")
    groups = spark.read.schema(groups.schema).parquet(f"{path}/digests")
    stored, distinct = spark.read.parquet(f"{path}/payloads").count(), groups.count()
    if stored != distinct:
        raise ValueError(f"{stored} payloads have {distinct} digests")

    joined = join_by_key(rows, groups.select("digest", "first"), "digest", groups.select("digest", "group_size"), rows.count())
    own = F.col("page_id").eqNullSafe(F.col("first.page_id")) & (F.col("locator") == F.col("first.locator"))
    revisit = (F.col("size") >= LEAST_REVISITED) & ~own
    only = lambda c: F.when(revisit, c)
    http = _lines(("HTTP/1.1 ", F.lit("200 OK")), ("Content-Type: ", F.lit("text/html; charset=utf-8")), ("Content-Length: ", F.col("size")), ("", F.lit("")))
    uri = lambda c: F.replace(F.replace(c, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    warc = _lines(
        ("WARC/", F.lit("1.1")),
        ("WARC-Type: ", F.when(revisit, "revisit").otherwise("response")),
        ("WARC-Record-ID: <urn:uuid:", F.concat(_uuid(F.col("page_id"), F.col("locator")), F.lit(">"))),
        ("WARC-Date: ", F.lit(date)),
        ("WARC-Target-URI: ", uri(F.col("url"))),
        ("WARC-Payload-Digest: sha256:", F.col("digest")),
        ("WARC-Profile: ", only(F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        ("WARC-Refers-To: <urn:uuid:", only(F.concat(_uuid(F.col("first.page_id"), F.col("first.locator")), F.lit(">")))),
        ("WARC-Refers-To-Target-URI: ", only(uri(F.col("first.url")))),
        ("Page-Id: ", F.col("page_id")),
        ("Refers-To-Page-Id: ", only(F.col("first.page_id"))),
        ("Content-Type: ", F.lit("application/http; msgtype=response")),
        ("Content-Length: ", F.octet_length("http") + F.when(revisit, 0).otherwise(F.col("size"))),
        ("", F.lit("")),
    )
    headers = joined.withColumn("http", http).select("digest", "locator", warc.cast("binary").alias("warc_header"), F.col("http").cast("binary").alias("http_header"))
    write(headers, f"{path}/headers")
    return path


def field(name: str) -> Column:
    """The value of the first header line with this name; null if there is none or it is empty."""
    start = f"{name}: "
    line = F.get(F.filter("lines", lambda x: x.startswith(start)), F.lit(0))
    return F.nullif(F.substring(line, len(start) + 1, 1 << 30), F.lit(""))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record again: warc_header, http_header, payload, record (the original bytes) and the fields in its header.

    ``payload`` is the full payload, for revisits too; ``record`` has it for responses only.
    """
    headers = spark.read.parquet(f"{path}/headers")
    store = spark.read.parquet(f"{path}/payloads")
    sizes = spark.read.parquet(f"{path}/digests").select("digest", "group_size")
    total = headers.count()
    # A payload with very many records goes to several tasks: fewer than 1000 digests are that heavy.
    least = max(total // HEAVY_PARTS, 1)
    heavy = F.broadcast(sizes.where(F.col("group_size") > least).select("digest", (F.col("group_size") / least).cast("int").alias("salts")))
    salts = F.coalesce("salts", F.lit(1))
    left = headers.join(heavy, "digest", "left").withColumn("salt", F.pmod(F.col("locator"), salts).cast("int")).drop("salts")
    right = store.join(heavy, "digest", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    rows = left.join(right, ["digest", "salt"], "left")
    rows = rows.withColumn("lines", F.split(F.col("warc_header").cast("string"), _EOL))
    actual = F.sha2("payload", 256)
    named = F.replace(field("WARC-Payload-Digest"), F.lit("sha256:"))
    verified = F.when(named == actual, actual).otherwise(F.raise_error(F.concat(F.lit("payload does not have the digest "), F.coalesce(named, F.lit("")))))
    kind = field("WARC-Type")
    body = F.when(kind == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return rows.select(
        field("Page-Id").cast("long").alias("page_id"),
        field("WARC-Target-URI").alias("url"),
        kind.alias("record_type"),
        field("Refers-To-Page-Id").cast("long").alias("refers_to"),
        verified.alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        "payload",
        F.concat("warc_header", "http_header", body, F.lit(b"\r\n\r\n")).alias("record"),
    )
