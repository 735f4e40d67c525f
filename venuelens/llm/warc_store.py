"""Content-addressed WARC archive: payloads once by digest, exact record headers beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from venuelens.llm.common import stored

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"  # a fixed date, so that reruns write the same bytes
CRLF = "\r\n"


def base32(hexadecimal: Column) -> Column:
    """Upper-case base 32 of a hex string whose length is a multiple of 5: each 5 hex digits are 4 letters."""
    def letters(i: int) -> list[Column]:
        value = F.conv(F.substring(hexadecimal, 5 * i + 1, 5), 16, 10).cast("int")
        return [F.substring(F.lit(ALPHABET), F.shiftright(value, s).bitwiseAND(31) + 1, 1) for s in (15, 10, 5, 0)]
    return F.concat(*[x for i in range(8) for x in letters(i)])


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Writes ``pages`` (page_id, url, html) as WARC records below ``path``: ``payloads`` (sha256, payload), each
    payload once, and ``headers`` (page_id, sha256, header) with the exact header block of every record.

    Of records with equal payloads of at least ``min_bytes`` that with the smallest page_id is a response, the others
    are revisits of it; smaller ones are all responses. Null html is an empty payload, a null url is left out of the
    header. A null page_id is never the one referred to while another has the payload; a group of null ids only is all
    responses; of repeated rows of the response's id one is the response, the others revisit it. Other columns are not
    read; an empty table gives an archive without records. Only digests are shuffled to find equal payloads (written
    first, so that a row keeps its number); the bytes move once, those of responses, to their store."""
    raw = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    marked = stored(raw.select(F.monotonically_increasing_id().alias("row"), "page_id", "url",
                               F.length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("sha256"),
                               F.sha1("payload").alias("sha1")), "page-digests")
    smallest = F.min(F.struct(F.col("page_id").isNull(), "page_id", "row"))
    first = marked.groupBy("sha256").agg(smallest.alias("m")).select(
        "sha256", F.col("m.page_id").alias("first_id"), F.col("m.row").alias("first_row"))
    known = marked.join(first, "sha256")
    revisit = (F.col("bytes") >= min_bytes) & F.col("first_id").isNotNull() & (F.col("row") != F.col("first_row"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    name = lambda i, s: F.concat(F.lit("<urn:venuelens:"), F.coalesce(i.cast("string"), F.lit("none")), F.lit(":"), s, F.lit(">"))
    digest = F.concat(F.lit("sha1:"), base32(F.col("sha1")))
    header = F.concat(
        F.lit("WARC/1.1" + CRLF), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", name(F.col("page_id"), F.substring("sha256", 1, 32))), line("WARC-Date", F.lit(DATE)),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")), F.lit("")),
        line("WARC-Payload-Digest", digest),
        F.when(revisit, F.concat(
            line("WARC-Refers-To", name(F.col("first_id"), F.substring("sha256", 1, 32))),
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        line("Content-Length", F.when(revisit, "0").otherwise(F.col("bytes").cast("string"))), F.lit(CRLF))
    known.select("page_id", "sha256", header.alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")
    owners = first.select(F.col("first_id").alias("page_id"), "sha256")
    hashed = raw.select("page_id", F.sha2("payload", 256).alias("sha256"), "payload")
    named = hashed.join(owners, ["page_id", "sha256"], "left_semi").dropDuplicates(["page_id", "sha256"])
    nameless = (hashed.filter("page_id is null").join(owners.filter("page_id is null").select("sha256"), "sha256", "left_semi")
                .dropDuplicates(["sha256"]))
    named.unionByName(nameless).select("sha256", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, header, payload (of the record's content; a revisit's is joined from the
    response), payload_bytes, payload_digest, record_type, refers_to, verified. Length and digests are made anew
    from the stored bytes, once per payload; verified holds them against the store's key and the header. A null
    page_id stays null, repeated records give repeated rows, an empty archive gives none."""
    payloads = spark.read.schema("sha256 string, payload binary").parquet(f"{path}/payloads").select(
        "sha256", "payload", F.length("payload").cast("long").alias("payload_bytes"), base32(F.sha1("payload")).alias("payload_digest"),
        (F.sha2("payload", 256) == F.col("sha256")).alias("intact"))
    headers = spark.read.schema("page_id long, sha256 string, header string").parquet(f"{path}/headers")
    field = lambda name, what: F.nullif(F.regexp_extract("header", rf"\r\n{name}: {what}\r\n", 1), F.lit(""))
    rows = headers.join(payloads, "sha256")
    kind = field("WARC-Type", r"(\w+)")
    length_ok = field("Content-Length", r"(\d+)").cast("long") == F.when(kind == "response", F.col("payload_bytes")).otherwise(0)
    return rows.select("page_id", "header", "payload", "payload_bytes", "payload_digest", kind.alias("record_type"),
                       field("WARC-Refers-To", r"<urn:venuelens:(-?\d+):\w+>").cast("long").alias("refers_to"),
                       (F.col("intact") & length_ok & (field("WARC-Payload-Digest", r"sha1:(\w+)") == F.col("payload_digest"))).alias("verified"))


def record_bytes(rows: DataFrame) -> DataFrame:
    """The original records of ``read_archive``'s rows, one each: header block, content (none in a revisit) and the two
    closing line ends."""
    content = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return rows.select("page_id", F.concat(F.encode("header", "UTF-8"), content, F.lit(b"\r\n\r\n")).alias("record"))
