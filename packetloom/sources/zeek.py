"""Tab-separated logs of the protocol analyser, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def parse_tsv(lines: DataFrame, value: str = "value", by: list[str] = ()) -> DataFrame:
    """Rows as maps of field to value, from lines of log files.

    ``#fields`` names the columns (of its file: ``by`` names the columns that tell files apart); other
    ``#`` lines are skipped; a ragged row keeps the fields it has; '-' and '(empty)' are null.
    """
    head = lines.filter(F.col(value).startswith("#fields")).select(*by, F.slice(F.split(F.col(value), "\t", -1), F.lit(2), F.greatest(F.size(F.split(F.col(value), "\t", -1)) - 1, F.lit(0))).alias("_names"))
    head = head.groupBy(*by).agg(F.first("_names").alias("_names")) if by else head.limit(1)
    row = lines.filter(~F.col(value).startswith("#") & (F.trim(F.col(value)) != ""))
    row = row.join(head, list(by)) if by else row.crossJoin(F.broadcast(head))
    cells = F.split(F.col(value), "\t", -1)
    n = F.least(F.size(cells), F.size("_names"))
    clean = F.transform(F.slice(cells, F.lit(1), n), lambda c: F.when(~c.isin("-", "(empty)"), c))
    return row.withColumn("fields", F.map_from_arrays(F.slice("_names", F.lit(1), n), clean)).drop("_names")


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path).withColumn("file", F.input_file_name())
    return parse_tsv(rows, by=["file"])


def field(name: str) -> Column:
    return F.try_element_at(F.col("fields"), F.lit(name))


def counter(rows: DataFrame, name: str) -> DataFrame:
    """Counts by one field's values, nulls as 'unknown'."""
    return rows.groupBy(F.coalesce(field(name), F.lit("unknown")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def summary(rows: DataFrame, kind: str) -> DataFrame:
    """One row of figures for a log of a kind: conn, ssl, x509, dns, http, kerberos, files, ssh or notice."""
    n = F.count(F.lit(1)).alias("n")
    distinct = lambda f: F.count_distinct(field(f))
    has = {
        "conn": [n, F.sum(field("orig_bytes").try_cast("long")).alias("orig_bytes"), F.sum(field("resp_bytes").try_cast("long")).alias("resp_bytes"), distinct("id.resp_h").alias("n_dst")],
        "ssl": [n, distinct("server_name").alias("n_sni"), F.count_if(field("validation_status").isNotNull() & (field("validation_status") != "ok")).alias("n_invalid"), distinct("ja3").alias("n_ja3")],
        "x509": [n, F.count_if(field("certificate.subject") == field("certificate.issuer")).alias("n_self_signed")],
        "dns": [n, distinct("query").alias("n_names"), F.count_if(field("rcode_name") == "NXDOMAIN").alias("n_nxdomain")],
        "http": [n, distinct("host").alias("n_hosts"), distinct("user_agent").alias("n_agents")],
        "kerberos": [n, distinct("service").alias("n_services"), F.coalesce(F.bool_or(F.lower(field("cipher")).contains("rc4")), F.lit(False)).alias("weak")],
        "files": [n, distinct("sha256").alias("n_digests"), distinct("mime_type").alias("n_types")],
        "ssh": [n, F.count_if(field("auth_success") == "F").alias("n_failed"), distinct("client").alias("n_clients")],
        "notice": [n, distinct("note").alias("n_notes")],
    }
    return rows.agg(*has[kind])


def details(rows: DataFrame, order: str, most: int = 50) -> DataFrame:
    """The first rows by a field: what a report shows."""
    return rows.orderBy(field(order), F.to_json("fields")).limit(most)
