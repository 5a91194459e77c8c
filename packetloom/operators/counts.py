"""Detections that count or count distinct things per source and window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import rules, stats, text


def distinct_counts(df: DataFrame, key: list[str], **members: Column) -> DataFrame:
    """Per key: number of distinct non-null, non-empty values of each named expression.

    One aggregate for one member; for several, Spark expands the rows once and still aggregates
    before the shuffle.
    """
    clean = {n: F.when(c.cast("string") != "", c) for n, c in members.items()}
    return df.groupBy(*key).agg(*[F.countDistinct(c).alias(n) for n, c in clean.items()])


def fanout(df: DataFrame, key: list[str], member: Column, least: int, where: Column | None = None) -> DataFrame:
    """Keys with at least ``least`` distinct members among the rows that meet ``where``: n."""
    rows = df if where is None else df.filter(where)
    return distinct_counts(rows, key, n=member).filter(F.col("n") >= least)


def lateral_fanout(flows: DataFrame, key: list[str], dst: str, port: str, least: int = 5) -> DataFrame:
    """Distinct destinations on administration ports."""
    return fanout(flows, key, F.col(dst), least, F.col(port).isin(*rules.ADMIN_PORTS))


def rdp_fanout(flows: DataFrame, key: list[str], dst: str, port: str, least: int = 3) -> DataFrame:
    return fanout(flows, key, F.col(dst), least, F.col(port) == 3389)


def internal_scans(flows: DataFrame, key: list[str], dst: str, port: str, min_dsts: int = 25, min_ports: int = 15) -> DataFrame:
    """horizontal: many destinations; else vertical: many ports on one destination. n is the count that decided."""
    pair = flows.groupBy(*key, dst).agg(F.countDistinct(port).alias("_ports"))
    one = pair.groupBy(*key).agg(F.count(dst).alias("_dsts"), F.max("_ports").alias("_most"))
    wide, deep = F.col("_dsts") >= min_dsts, F.col("_most") >= min_ports
    out = one.withColumn("kind", F.when(wide, F.lit("horizontal")).when(deep, F.lit("vertical")))
    return out.withColumn("n", F.when(wide, F.col("_dsts")).otherwise(F.col("_most"))).filter("kind IS NOT NULL").drop("_dsts", "_most")


def kerberoasting(requests: DataFrame, key: list[str], service: str, encryption: str, min_services: int = 8, min_weak: int = 3) -> DataFrame:
    """Ticket requests for many services, or for a few with RC4 (etype 23) among them."""
    weak = F.lower(F.col(encryption).cast("string")).isin("23", "0x17", "rc4-hmac", "rc4")
    one = requests.groupBy(*key).agg(F.countDistinct(F.when(F.col(service) != "", F.col(service))).alias("n"), F.coalesce(F.bool_or(weak), F.lit(False)).alias("weak"))
    return one.filter((F.col("n") >= min_services) | (F.col("weak") & (F.col("n") >= min_weak)))


def smb_ransomware(files: DataFrame, key: list[str], name: str, is_write: Column, min_files: int = 100, min_writes: int = 100, min_share: float = 0.7) -> DataFrame:
    """Many distinct files, many of them written, mostly writes; shares are of set sizes, not of events."""
    one = distinct_counts(files, key, n_files=F.col(name), n_writes=F.when(is_write, F.col(name)), n_reads=F.when(~is_write, F.col(name)))
    share = F.try_divide(F.col("n_writes"), F.col("n_writes") + F.col("n_reads"))
    return one.withColumn("write_share", share).filter((F.col("n_files") >= min_files) & (F.col("n_writes") >= min_writes) & (share >= min_share))


def dns_tunnels(queries: DataFrame, key: list[str], name: str, least: int = 50, min_length: float = 40.0, min_entropy: float = 3.5) -> DataFrame:
    """Keys with many queries whose names are long or random on average: n, mean_length, mean_entropy, score.

    Entropy is computed once per distinct name and weighted by its count.
    """
    name_of = F.coalesce(F.col(name), F.lit(""))
    each = queries.groupBy(*key, name_of.alias("_name")).agg(F.count(F.lit(1)).alias("_c"))
    each = each.withColumn("_e", text.entropy(F.col("_name")) * F.col("_c")).withColumn("_l", F.length("_name") * F.col("_c"))
    one = each.groupBy(*key).agg(F.sum("_c").alias("n"), (F.sum("_l") / F.sum("_c")).alias("mean_length"), (F.sum("_e") / F.sum("_c")).alias("mean_entropy"))
    score = F.round(F.least(F.lit(1.0), F.col("mean_length") / 60.0 * 0.5 + F.col("mean_entropy") / 4.5 * 0.5), 3)
    return one.filter((F.col("n") >= least) & ((F.col("mean_length") > min_length) | (F.col("mean_entropy") > min_entropy))).withColumn("score", score)


def dns_exploded(queries: DataFrame, key: list[str], name: str, least: int = 30) -> DataFrame:
    """Per key the registered parent with the most distinct subdomains (ties: the smallest), if there are enough: parent, n, score."""
    full = F.lower(F.rtrim(F.coalesce(F.col(name), F.lit("")), F.lit(".")))
    row = queries.select(*key, text.registered_parent(F.col(name)).alias("parent"), full.alias("_full")).filter((F.col("parent") != "") & (F.col("parent") != F.col("_full")))
    per = row.groupBy(*key, "parent").agg(F.countDistinct("_full").alias("n"))
    worst = per.groupBy(*key).agg(F.min(F.struct((-F.col("n")).alias("_n"), F.col("parent"))).alias("_w"))
    out = worst.select(*key, F.col("_w.parent").alias("parent"), (-F.col("_w._n")).alias("n")).filter(F.col("n") >= least)
    return out.withColumn("score", stats.capped(F.col("n"), least * 4.0))


def dga_domains(queries: DataFrame, name: str, threshold: float = 0.72) -> DataFrame:
    """Queries whose registered label looks generated: label and score."""
    q = queries.withColumn("label", text.registered_label(F.lower(F.col(name)))).withColumn("score", text.dga_score(F.lower(F.col(name))))
    return q.filter(F.col("score") >= threshold)


def modbus_enumeration(df: DataFrame, key: list[str], code: str, unit: str, min_codes: int = 6, min_units: int = 4) -> DataFrame:
    """Sources that use many function codes or address many units: n_codes, n_units, why."""
    one = distinct_counts(df, key, n_codes=F.col(code), n_units=F.col(unit))
    why = F.when(F.col("n_codes") >= min_codes, F.concat(F.lit("fc enumeration: "), F.col("n_codes").cast("string"), F.lit(" distinct function codes"))).when(
        F.col("n_units") >= min_units, F.concat(F.lit("unit enumeration: "), F.col("n_units").cast("string"), F.lit(" distinct unit IDs"))
    )
    return one.withColumn("why", why).filter("why IS NOT NULL")


def event_bursts(df: DataFrame, key: list[str], where: Column, least: int) -> DataFrame:
    """Keys with at least ``least`` rows that meet ``where``: n. (SSH sessions, NXDOMAIN answers, Modbus errors.)"""
    return df.filter(where).groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def icmp_exfil(flows: DataFrame, key: list[str], proto: str, n_bytes: Column, threshold: float = 1e6) -> DataFrame:
    """Pairs with ICMP whose flows, of any protocol, add up to the threshold: total."""
    icmp = F.upper(F.col(proto)).isin("ICMP", "IPV6-ICMP", "ICMPV6")
    one = flows.groupBy(*key).agg(F.sum(n_bytes).alias("total"), F.coalesce(F.bool_or(icmp), F.lit(False)).alias("_icmp"))
    return one.filter(F.col("_icmp") & (F.col("total") >= threshold)).drop("_icmp")


def emit_once(findings: DataFrame, identity: list[str], bucket: str) -> DataFrame:
    """The first finding of each identity in each time bucket, by first_seen and then by content."""
    rest = [c for c in findings.columns if c not in identity and c not in (bucket, "first_seen")]
    w = Window.partitionBy(*identity, bucket).orderBy("first_seen", *[c for c in rest if dict(findings.dtypes)[c] != "map"])
    return findings.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
