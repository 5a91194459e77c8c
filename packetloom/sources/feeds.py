"""Intelligence feeds in their formats, as indicator rows (kind, indicator, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import ip as ips, rules, time
from ..operators.intel import tlp_name, tlp_rank

HEX = {32: "md5", 40: "sha1", 64: "sha256"}


def _lines(lines: DataFrame, value: str) -> DataFrame:
    return lines.select(F.trim(F.col(value)).alias("line")).filter((F.col("line") != "") & ~F.col("line").startswith("#"))


def _first(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.get(F.split(line, ","), F.lit(0)), '^"|"$', ""))


def address_list(lines: DataFrame, value: str = "value") -> DataFrame:
    """IPv4 addresses: the first CSV field of each line, comments left out."""
    return _lines(lines, value).select(F.lit("ip").alias("kind"), _first(F.col("line")).alias("indicator")).filter(ips.is_v4(F.col("indicator"))).distinct()


def hash_list(lines: DataFrame, value: str = "value", kind: str = "hash", least: int = 32, most: int = 64) -> DataFrame:
    """The first field of each line that is a hexadecimal digest of an allowed length."""
    cells = F.transform(F.split(F.col("line"), ","), lambda c: F.lower(F.trim(F.replace(c, F.lit('"'), F.lit("")))))
    hit = F.get(F.filter(cells, lambda c: c.rlike(f"^[0-9a-f]{{{least},{most}}}$")), F.lit(0))
    return _lines(lines, value).select(F.lit(kind).alias("kind"), hit.alias("indicator")).filter("indicator IS NOT NULL").distinct()


def malware_hashes(lines: DataFrame, value: str = "value") -> DataFrame:
    return _lines(lines, value).select(F.lit("hash").alias("kind"), F.lower("line").alias("indicator")).filter(F.col("indicator").rlike("^[0-9a-f]{64}$")).distinct()


def fingerprint_list(lines: DataFrame, kind: str = "ja3", value: str = "value") -> DataFrame:
    """Fingerprints: the first field of each line, in lower case."""
    return _lines(lines, value).select(F.lit(kind).alias("kind"), F.lower(_first(F.col("line"))).alias("indicator")).filter("indicator <> ''").distinct()


def inferred_kind(value: Column) -> Column:
    """ip, url, hash, ja4 or domain, by how a value looks; null if it looks like none."""
    base = F.get(F.split(value, "/"), F.lit(0))
    return (
        F.when(value.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), F.lit("url")).when(ips.key(base).isNotNull(), F.lit("ip"))
        .when(value.rlike("^([0-9A-Fa-f]{32}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{64})$"), F.lit("hash")).when(rules.ja4_valid(value), F.lit("ja4"))
        .when(value.rlike("^[A-Za-z0-9_-]+(\\.[A-Za-z0-9_-]+)+$"), F.lit("domain"))
    )


def generic(lines: DataFrame, value: str = "value") -> DataFrame:
    """value[,type[,score]] lines: the type is inferred where it is missing; score null or 0 to 100."""
    part = lambda i: F.nullif(F.trim(F.get(F.split(F.col("line"), ","), F.lit(i))), F.lit(""))
    out = _lines(lines, value).select(F.coalesce(F.lower(part(1)), inferred_kind(part(0))).alias("kind"), part(0).alias("indicator"), part(2).try_cast("double").alias("score"))
    return out.filter("kind IS NOT NULL AND indicator IS NOT NULL AND (score IS NULL OR score BETWEEN 0 AND 100)")


VARIANTS = {
    "feodo": lambda df: address_list(df), "sslbl_ja3": lambda df: fingerprint_list(df, "ja3"), "sslbl_cert": lambda df: hash_list(df, kind="cert", least=40, most=40),
    "malwarebazaar": lambda df: malware_hashes(df),
}


def variant(lines: DataFrame, name: str) -> DataFrame:
    """One of the named list feeds."""
    if name not in VARIANTS:
        raise ValueError(f"unknown feed {name}: one of {sorted(VARIANTS)}")
    return VARIANTS[name](lines)


OBJECT = (
    "type:string,id:string,name:string,pattern:string,pattern_type:string,valid_from:string,valid_until:string,revoked:boolean,confidence:int,"
    "object_marking_refs:array<string>,definition:struct<tlp:string>"
)
BUNDLE = f"objects array<struct<{OBJECT}>>, more boolean"
STIX_KINDS = {
    "ipv4-addr:value": "ip", "ipv6-addr:value": "ip", "domain-name:value": "domain", "url:value": "url",
    "file:hashes.MD5": "hash", "file:hashes.'SHA-1'": "hash", "file:hashes.'SHA-256'": "hash", "file:hashes.SHA-1": "hash", "file:hashes.SHA-256": "hash",
}


def stix(spark: SparkSession, path: str) -> DataFrame:
    """Indicators of STIX 2.1 bundles: patterns of one equality; kind, indicator, valid_from, valid_until, revoked, tlp.

    Patterns of another form are left out. Sharing is the most restrictive of the markings; a marking that
    is not in the bundles counts as red. A bundle that says there is more must be followed by its next page
    in the same path: the last page of a collection says more = false.
    """
    doc = spark.read.schema(BUNDLE).json(path, multiLine=True)
    return _indicators(doc.select(F.explode("objects").alias("o")).select("o.*"))


def stix_indicators(objects: DataFrame, value: str = "object") -> DataFrame:
    """As ``stix``, of rows that hold an object each as JSON (``taxii.objects``). Of rows that repeat an object one counts."""
    return _indicators(objects.select(F.from_json(value, f"struct<{OBJECT}>").alias("o")).select("o.*").distinct())


def _indicators(obj: DataFrame) -> DataFrame:
    marks = obj.filter(F.col("type") == "marking-definition").select(F.col("id").alias("_mark"), tlp_rank(F.lower("definition.tlp")).alias("_rank"))
    marks = marks.groupBy("_mark").agg(F.max("_rank").alias("_rank"))
    ind = obj.filter(F.col("type") == "indicator")
    form = "^\\[\\s*([a-z0-9-]+:[A-Za-z0-9_.'-]+)\\s*=\\s*'((?:[^'\\\\]|\\\\.)*)'\\s*\\]$"
    kind = rules.lookup(STIX_KINDS, F.regexp_extract("pattern", form, 1))
    ind = ind.withColumn("kind", kind).withColumn("indicator", F.regexp_replace(F.regexp_extract("pattern", form, 2), "\\\\(.)", "$1")).filter("kind IS NOT NULL")
    refs = ind.select("id", F.explode("object_marking_refs").alias("_mark")).join(marks, "_mark", "left")
    shared = refs.groupBy("id").agg(F.max(F.coalesce("_rank", F.lit(4))).alias("_tlp"))
    out = ind.join(shared, "id", "left")
    return out.select("id", "kind", "indicator", time.event_time(F.col("valid_from")).alias("valid_from"), time.event_time(F.col("valid_until")).alias("valid_until"), F.coalesce("revoked", F.lit(False)).alias("revoked"), F.col("confidence").cast("double").alias("score"), tlp_name(F.col("_tlp")).alias("tlp"))


MISP = (
    "Event struct<id:string,Tag:array<struct<name:string>>,Attribute:array<struct<uuid:string,type:string,value:string,to_ids:boolean,timestamp:string,Tag:array<struct<name:string>>>>>"
)
MISP_KINDS = {"ip-src": "ip", "ip-dst": "ip", "domain": "domain", "hostname": "domain", "url": "url", "md5": "hash", "sha1": "hash", "sha256": "hash", "ja3-fingerprint-md5": "ja3"}


def misp(spark: SparkSession, path: str) -> DataFrame:
    """Attributes of MISP events that are meant for detection, with the most restrictive of event and attribute sharing."""
    doc = spark.read.schema(MISP).json(path, multiLine=True)
    row = doc.select(F.col("Event.Tag").alias("_t"), F.explode("Event.Attribute").alias("a"))
    rank = lambda tags: F.array_max(F.transform(tags, lambda t: tlp_rank(F.regexp_extract(F.lower(t["name"]), "^tlp:(.*)$", 1))))
    row = row.withColumn("kind", rules.lookup(MISP_KINDS, F.col("a.type"))).filter("kind IS NOT NULL AND coalesce(a.to_ids, true)")
    return row.select("kind", F.col("a.value").alias("indicator"), tlp_name(F.greatest(rank(F.col("_t")), rank(F.col("a.Tag")))).alias("tlp"), F.timestamp_seconds(F.col("a.timestamp").try_cast("long")).alias("last_seen"))


def netbox_devices(spark: SparkSession, path: str, tenant: str) -> DataFrame:
    """Devices of an inventory export as rows for directory facts: entity is the primary address without its prefix length."""
    shape = "results array<struct<name:string,primary_ip:struct<address:string>,tenant:struct<name:string>,custom_fields:struct<owner:string,criticality:string>>>"
    d = spark.read.schema(shape).json(path, multiLine=True).select(F.explode("results").alias("d"))
    address = F.get(F.split("d.primary_ip.address", "/"), F.lit(0))
    return d.select(F.lit(tenant).alias("tenant"), F.when(address != "", F.concat(F.lit("ip:"), address)).alias("entity"), F.coalesce("d.custom_fields.owner", "d.tenant.name").alias("owner"), F.col("d.custom_fields.criticality").alias("criticality"))


def geo_join(df: DataFrame, address: str, networks: DataFrame, network: str, values: list[str]) -> DataFrame:
    """``df`` with the values of the narrowest network that holds its address; only global addresses are looked up."""
    from ..operators.joins import cidr_join

    ask = df.select(address).distinct().filter(ips.is_global(F.col(address)))
    hit = cidr_join(ask, address, networks.select(network, *values), network)
    best = hit.groupBy(address).agg(F.max_by(F.struct(*values), F.struct(ips.net_length(F.col(network)), F.col(network))).alias("_g"))
    return df.join(best, address, "left").select(*df.columns, *[F.col(f"_g.{v}").alias(v) for v in values])
