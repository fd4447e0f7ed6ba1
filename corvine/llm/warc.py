"""A content-addressed WARC archive.

The archive is two tables in shared storage.  ``payloads`` holds every distinct payload
once, under its SHA-256 digest; ``headers`` holds the exact header bytes of every record
and the digest of its payload.  Records are rebuilt by joining the two.  Copies of a payload
are combined before its one shuffle, so a page that fills a third of a crawl moves once per
task; only ids, digests and headers meet per digest.  Payloads are written in buckets of the
digest, so the join moves the headers of responses to them and no payload again.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NAMED, shared_dir

#: RFC 4648 alphabet.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Records carry this date: the crawl tables have none.
DATE = "1970-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """The bare upper-case base32 SHA-1 of a binary column."""
    digest = F.sha1(payload)
    letters = []
    for i in range(0, 40, 5):  # 5 hexadecimal digits are 4 base32 letters
        part = F.conv(F.substring(digest, i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(part, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


@dataclass(frozen=True)
class Archive:
    """Where an archive's two tables are.

    ``bucketed`` is the name by which the session that wrote the archive knows the payloads' buckets;
    without it the files are read by their path, and a join shuffles them.
    """

    path: str
    bucketed: str | None = None

    def payloads(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.bucketed) if self.bucketed else self.unbucketed(spark)

    def unbucketed(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("digest binary, payload binary, response_id bigint").parquet(f"{self.path}/payloads")

    def headers(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/headers")


def write_archive(pages: DataFrame, path: str, *, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> Archive:
    """Archive every row of ``pages`` under ``path``.

    Of rows with equal payloads of at least ``least_bytes`` bytes, the one with the largest
    id becomes a ``response`` record and the others ``revisit`` records that name it;
    smaller payloads are all responses.  Null payloads count as empty, null URLs as the empty
    URI.  Rows that repeat an id become equal records; a null id loses to any other and is
    written as an empty name.
    """
    body = F.encode(F.coalesce(F.col(body_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("bigint").alias("record_id"), F.coalesce(F.col(url_col), F.lit("")).alias("uri"), body.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    # as many buckets as a shuffle has partitions: the task of a partition writes its own bucket alone
    name, buckets = f"payloads_{uuid.uuid4().hex}", int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (
        rows.groupBy("digest")
        .agg(F.max("payload").alias("payload"), F.max("record_id").alias("response_id"))
        .write.bucketBy(buckets, "digest").option("path", f"{path}/payloads").format("parquet").saveAsTable(name)
    )
    NAMED.setdefault(pages.sparkSession.sparkContext.applicationId, []).append(name)  # for ``cleanup``
    stored = Archive(path).unbucketed(pages.sparkSession).select(
        "digest", "response_id", F.octet_length("payload").cast("bigint").alias("size"), base32_sha1(F.col("payload")).alias("sha1")
    )
    first = F.col("size") < least_bytes
    kind = F.when(first | F.col("record_id").eqNullSafe(F.col("response_id")), "response").otherwise("revisit")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    revisit = F.col("kind") == "revisit"
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("kind"),
        F.lit("\r\nWARC-Record-ID: "), urn(F.col("record_id")),
        F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), F.regexp_replace("uri", r"[\r\n]+", " "),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("sha1"),
        F.when(revisit, F.concat(
            F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), urn(F.col("response_id"))
        )).otherwise(F.lit("")),
        F.lit("\r\nContent-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("size")).cast("string"),
        F.lit("\r\n\r\n"),
    )
    (
        rows.select("record_id", "uri", "digest")
        .join(stored, "digest")
        .withColumn("kind", kind)
        .select("record_id", "digest", F.encode(header, "UTF-8").alias("header"))
        .write.parquet(f"{path}/headers")
    )
    return Archive(path, name)


def read_records(spark: SparkSession, archive: Archive) -> DataFrame:
    """Every record, rebuilt: its fields, exact bytes and full payload.

    ``(record_id, record_type, refers_to, payload_bytes, payload_digest, payload, record)``.
    The fields are parsed from the stored header; size and digest are taken anew from the
    stored payload, and a stored payload that doesn't match its address is an error.  A
    revisit's ``record`` has no body, yet its ``payload`` is the full one it refers to.
    """
    sound = F.unhex(F.sha2("payload", 256)) == F.col("digest")
    checked = F.when(sound, F.col("payload")).otherwise(F.raise_error(F.lit("a payload differs from its address")).cast("binary"))
    facts = F.octet_length("payload").cast("bigint").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest")
    stored = archive.payloads(spark).select("digest", checked.alias("payload")).select("digest", "payload", *facts)
    text = F.decode("header", "UTF-8")
    field = lambda name, value: F.regexp_extract(text, rf"\r\n{name}: {value}\r\n", 1)
    heads = archive.headers(spark).select(
        "digest", "header",
        F.nullif(field("WARC-Record-ID", r"<urn:page:(-?\d*)>"), F.lit("")).cast("bigint").alias("record_id"),
        field("WARC-Type", r"(\w+)").alias("record_type"),
        F.nullif(field("WARC-Refers-To", r"<urn:page:(-?\d+)>"), F.lit("")).cast("bigint").alias("refers_to"),
    )
    fields = ["record_id", "record_type", "refers_to", "payload_bytes", "payload_digest"]
    end = F.lit(b"\r\n\r\n")
    first = heads.where("record_type = 'response'").join(stored.hint("merge"), "digest")
    # a page that many revisits name: a shuffled join, which AQE may split; payloads take part only if they are asked for
    known = archive.unbucketed(spark).select("digest", checked.alias("payload")).select("digest", "payload", *facts)
    again = heads.where("record_type <> 'response'").join(known, "digest")
    return first.select(*fields, "payload", F.concat("header", "payload", end).alias("record")).unionByName(
        again.select(*fields, "payload", F.concat("header", end).alias("record"))
    )


def new_archive_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/corvine/{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex}"


ORACLE = """
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT *, octet_length(payload) AS n, sha1(payload) AS h, max(page_id) OVER (PARTITION BY sha256(payload)) AS first_id FROM p),
e AS (
  SELECT *, page_id <> first_id AS again,
    list_aggregate(list_transform(range(0, 32), lambda i:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        ((('0x' || substr(h, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::BIGINT + 1, 1)), 'string_agg', '') AS digest
  FROM d
)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first_id END AS refers_to,
  sha256('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: ' || CASE WHEN again THEN 'revisit' ELSE 'response' END
    || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Date: 1970-01-01T00:00:00Z'
    || chr(13) || chr(10) || 'WARC-Target-URI: ' || regexp_replace(url, '[\\r\\n]+', ' ', 'g') || chr(13) || chr(10) || 'WARC-Payload-Digest: sha1:' || digest
    || CASE WHEN again THEN chr(13) || chr(10) || 'WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest'
       || chr(13) || chr(10) || 'WARC-Refers-To: <urn:page:' || first_id || '>' ELSE '' END
    || chr(13) || chr(10) || 'Content-Length: ' || CASE WHEN again THEN 0 ELSE n END || chr(13) || chr(10) || chr(13) || chr(10)
    || CASE WHEN again THEN '' ELSE html END || chr(13) || chr(10) || chr(13) || chr(10)) AS record_sha256
FROM e
"""
