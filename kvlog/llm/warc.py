"""Content-addressed WARC archive.

``write_archive`` stores every distinct payload once under its SHA-256 (``payloads``) and the exact header block of every
record separately (``headers``).  ``records`` rebuilds each record's bytes by joining both and verifies every stored payload
against its digest; ``read_archive`` reads pages back from the rebuilt records.  Records with equal payloads of at least
``MIN_REVISIT`` bytes: that of the smallest page id is the response, the others revisit it.  Payloads that a filter of all
digests proves unique are stored as they come; only those that may repeat are shuffled to be stored once.

Defined cases: null html is an empty payload; null urls give an empty target, and line breaks in urls are percent-encoded; a
null page id has no X-Page-ID field, reads back as null and comes last in its group; of repeated rows one is the response and
the others revisit it; every record has an id of its own, whatever the page ids; ids are read back as ``page_type``; very
long pages are one record each; an empty table gives an empty archive; extra columns are not archived.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlog.llm import exact_dedup as exact
from kvlog.llm.common import SALTS, cut, shared_dir, smallest_of_group, table

MIN_REVISIT = 100
EOL = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The pages table has no crawl time; a caller that has one gives it.
DATE = "1970-01-01T00:00:00Z"


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(EOL))


def _record_id(page_id: Column, row: Column) -> Column:
    h = F.md5(F.concat_ws("#", row.cast("string"), page_id.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.lit("-" if a > 1 else ""), F.substring(h, a, n))], F.lit(">"))


def _header(date: str) -> Column:
    """The header block of one record, up to and with the empty line."""
    revisit = F.col("kind") == "revisit"
    page = lambda name, value: F.coalesce(_line(name, F.url_encode(value.cast("string"))), F.lit(""))
    refers = F.concat(_line("WARC-Profile", F.lit(PROFILE)), _line("WARC-Refers-To", _record_id(F.col("first.page_id"), F.col("first.row"))), page("X-Refers-To-Page-ID", F.col("first.page_id")))
    return F.concat(
        F.lit("WARC/1.1" + EOL),
        _line("WARC-Type", F.col("kind")),
        _line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("_row"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, refers).otherwise(""),
        page("X-Page-ID", F.col("page_id")),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("bytes")).cast("string")),
        F.lit(EOL),
    )


def write_archive(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = DATE) -> None:
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), payload.alias("payload"), F.monotonically_increasing_id().alias("_row"))
    narrow = cut(rows.select("page_id", "url", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("bytes"), "_row"))
    order = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("page_id"), F.col("_row").alias("row"))
    # Hot payloads: one merged row per digest, given back to salted shares of the records.
    judged = smallest_of_group(narrow, "digest", order)
    first = F.col("first.row") == F.col("_row")
    kind = F.when((F.col("bytes") < MIN_REVISIT) | first, "response").otherwise("revisit")
    judged.withColumn("kind", kind).select(_header(date).alias("header"), "digest").write.parquet(f"{path}/headers")
    # Each payload once: unique ones aren't shuffled, and map-side aggregation drops copies of the others before the shuffle.
    tested = exact.Filter(narrow, "digest").test(rows.select(F.sha2("payload", 256).alias("digest"), "payload"), "digest")
    unique = tested.where(~F.col("_maybe")).select("digest", "payload")
    stored = unique.unionByName(tested.where("_maybe").select("digest", "payload").dropDuplicates(["digest"]))
    stored.withColumn("small", F.octet_length("payload") < MIN_REVISIT).write.partitionBy("small").parquet(f"{path}/payloads")


def _field(name: str, header: str = "header") -> Column:
    """A header field's value; null where the header has no such field."""
    at = F.instr(header, f"\n{name}: ")
    return F.when(at > 0, F.regexp_extract(header, f"\n{name}: ([^\r]*)\r", 1))


def _stored(payload: Column, digest: Column) -> Column:
    return F.when(F.sha2(payload, 256) == digest, payload).otherwise(F.raise_error(F.concat(F.lit("payload fails its digest: "), digest)))


def _present(value: Column) -> Column:
    return F.coalesce(value, F.raise_error(F.concat(F.lit("no stored payload: "), F.col("digest"))))


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.pmod(F.xxhash64("header"), F.lit(SALTS)).cast("int"))


def _headers(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.parquet(f"{path}/headers").where(_field("WARC-Type") == kind)


def _responses(spark: SparkSession, path: str) -> DataFrame:
    """header, digest, record, payload_bytes, payload_digest of the responses; each stored payload is read once."""
    payloads = spark.read.schema("digest string, payload binary, small boolean").parquet(f"{path}/payloads")
    checked = payloads.select("digest", _stored(F.col("payload"), F.col("digest")).alias("payload"), "small")
    headers = _headers(spark, path, "response").withColumn("large", _field("Content-Length").cast("long") >= MIN_REVISIT)
    # a large payload has one response; a small one may have any number, which are dealt over salts
    large = headers.where("large").join(checked.where("NOT small").drop("small"), "digest", "left").select("header", "digest", _present(F.col("payload")).alias("payload"))
    small = _salted(headers.where("NOT large"))
    dealt = small.select("digest", "salt").distinct().join(checked.where("small").drop("small"), "digest")
    small = small.join(dealt, ["digest", "salt"], "left").select("header", "digest", _present(F.col("payload")).alias("payload"))
    whole = F.concat(F.encode("header", "UTF-8"), "payload", F.lit((EOL * 2).encode()))
    return large.unionByName(small).select("header", "digest", whole.alias("record"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))


def _revisits(spark: SparkSession, path: str, responses: DataFrame) -> DataFrame:
    """The same of the revisits, whose record has no payload; the payload's size and digest are those of the response."""
    rows = _salted(_headers(spark, path, "revisit"))
    known = responses.where(F.col("payload_bytes") >= MIN_REVISIT).select("digest", "payload_bytes", "payload_digest")
    dealt = rows.select("digest", "salt").distinct().join(known, "digest")
    joined = rows.join(dealt, ["digest", "salt"], "left")
    return joined.select("header", "digest", F.concat(F.encode("header", "UTF-8"), F.lit((EOL * 2).encode())).alias("record"), _present(F.col("payload_bytes")).alias("payload_bytes"), "payload_digest")


def records(spark: SparkSession, path: str) -> DataFrame:
    """header, record (exact bytes: header block, payload unless a revisit, two line ends), payload_bytes, payload_digest.

    Raises where a stored payload fails its digest or is missing.
    """
    responses = _responses(spark, path)
    return responses.unionByName(_revisits(spark, path, responses)).drop("digest")


def read_archive(spark: SparkSession, path: str, page_type: str = "long") -> DataFrame:
    """page_id, record_type, refers_to, payload_digest, payload_bytes of the rebuilt records."""
    head = F.concat(F.substring_index(F.col("record").cast("string"), EOL * 2, 1), F.lit(EOL)).alias("head")
    narrow = ["digest", head, "payload_bytes", "payload_digest"]
    responses = cut(_responses(spark, path).select(*narrow))
    parsed = responses.unionByName(_revisits(spark, path, responses).select(*narrow))
    own = lambda name: F.url_decode(_field(name, "head")).cast(page_type)
    return parsed.select(own("X-Page-ID").alias("page_id"), _field("WARC-Type", "head").alias("record_type"), own("X-Refers-To-Page-ID").alias("refers_to"), "payload_digest", "payload_bytes")


def op5_warc(spark, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS d, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n < 100 OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN n < 100 OR page_id = first THEN NULL ELSE first END AS refers_to
FROM f
"""
