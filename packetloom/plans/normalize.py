"""Event records to typed tables and canonical observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import ids, rules

DNS_VERSION = 3


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _number(c: Column) -> Column:
    return F.coalesce(c.cast("long"), F.lit(0).cast("long"))


def _hash(c: Column) -> Column:
    """A fingerprint that is either a string or an object with a hash."""
    return F.coalesce(F.get_json_object(c, "$.hash"), F.when(~c.startswith("{"), c), F.lit(""))


def _envelope(eve: DataFrame) -> list[Column]:
    return [
        F.col("event_time"), _text(F.col("tenant")).alias("tenant"), _text(F.col("sensor_id")).alias("sensor_id"), _text(F.col("src_ip")).alias("src_ip"), _text(F.col("dest_ip")).alias("dest_ip"),
        F.coalesce("src_port", F.lit(0)).alias("src_port"), F.coalesce("dest_port", F.lit(0)).alias("dest_port"), _text(F.col("proto")).alias("proto"), _text(F.col("community_id")).alias("community_id"),
        _text(F.col("flow_id")).alias("flow_id"),
    ]


def flows(eve: DataFrame) -> DataFrame:
    """network_flow rows; absent numbers are 0, absent strings ''."""
    f = eve.filter(F.col("event_type") == "flow")
    return f.select(
        *_envelope(f), _text(F.col("app_proto")).alias("app_proto"), *[_number(F.col(f"flow.{c}")).alias(c) for c in ("bytes_toserver", "bytes_toclient", "pkts_toserver", "pkts_toclient")],
        F.coalesce(F.col("flow.age"), F.lit(0.0)).alias("age"), _text(F.col("flow.state")).alias("state"), F.col("alert").isNotNull().alias("alerted"), "ndpi",
    )


def tls(eve: DataFrame) -> DataFrame:
    """tls_observation rows."""
    f = eve.filter(F.col("event_type") == "tls")
    plain = ("sni", "version", "ja4", "ja4s", "subject", "notbefore", "notafter", "fingerprint")
    return f.select(
        *_envelope(f), *[_text(F.col(f"tls.{c}")).alias(c) for c in plain], _hash(F.col("tls.ja3")).alias("ja3"), _hash(F.col("tls.ja3s")).alias("ja3s"),
        _text(F.coalesce("tls.issuer", "tls.issuerdn")).alias("issuer"), rules.ech_present(F.get_json_object("raw", "$.tls")).alias("ech"),
    )


def dns(eve: DataFrame, version: int = DNS_VERSION) -> tuple[DataFrame, DataFrame]:
    """dns_transaction rows, and quarantined records that declare another version than the pinned one."""
    f = eve.filter(F.col("event_type") == "dns")
    ok = F.coalesce(F.col("dns.version") == version, F.lit(True))
    first = F.get(F.col("dns.queries"), F.lit(0))
    rows = f.filter(ok).select(
        *_envelope(f), _text(F.col("dns.type")).alias("type"), F.lower(_text(F.coalesce(first["rrname"], F.col("dns.rrname")))).alias("rrname"), _text(F.coalesce(first["rrtype"], F.col("dns.rrtype"))).alias("rrtype"),
        F.upper(_text(F.col("dns.rcode"))).alias("rcode"), F.coalesce(F.transform("dns.answers", lambda a: a["rdata"]), F.array().cast("array<string>")).alias("answers"),
    )
    return rows, f.filter(~ok).select("raw", F.lit("dns version").alias("reason"))


def http(eve: DataFrame) -> DataFrame:
    f = eve.filter(F.col("event_type") == "http")
    names = {"http_method": "method", "url": "url", "hostname": "hostname", "http_user_agent": "user_agent", "http_content_type": "content_type"}
    return f.select(*_envelope(f), *[F.col(f"http.{k}").alias(v) for k, v in names.items()])


def typed(eve: DataFrame) -> dict[str, DataFrame]:
    """The typed tables of one scan of records, and quarantine (malformed lines and wrong versions)."""
    good = eve.filter("_corrupt_record IS NULL") if "_corrupt_record" in eve.columns else eve
    rows, odd = dns(good)
    out = {"flow": flows(good), "tls": tls(good), "dns": rows, "http": http(good), "file": files(good)[0], "quarantine": odd.unionByName(files(good)[1])}
    if "_corrupt_record" in eve.columns:
        out["quarantine"] = out["quarantine"].unionByName(eve.filter("_corrupt_record IS NOT NULL").select("raw", F.lit("malformed").alias("reason")))
    return out


def files(eve: DataFrame) -> tuple[DataFrame, DataFrame]:
    """file_observation rows, and records with a malformed digest; mode tells whether the digest covers the whole file."""
    f = eve.filter(F.col("event_type") == "fileinfo")
    i = F.col("fileinfo")
    bad = F.lit(False)
    for name, n in (("md5", 32), ("sha1", 40), ("sha256", 64)):
        bad = bad | F.coalesce((i[name] != "") & ~F.lower(i[name]).rlike(f"^[0-9a-f]{{{n}}}$"), F.lit(False))
    whole = rules.hash_is_complete(i["sha256"], i["state"], i["gaps"], i["start"])
    row = f.filter(~bad).select(*_envelope(f), *[F.lower(_text(i[c])).alias(c) for c in ("md5", "sha1", "sha256")], _text(i["filename"]).alias("filename"), _text(i["mime_type"]).alias("mime_type"), _number(i["size"]).alias("size"), F.when(whole, "hashes_only").otherwise("metadata_only").alias("mode"))
    return row, f.filter(bad).select("raw", F.lit("malformed digest").alias("reason"))


CAPABILITIES = {"flow": "flow", "dns": "dns", "tls": "tls", "http": "http", "arp": "identity", "dhcp": "identity", "fileinfo": "file"}


def observations(eve: DataFrame, topic: Column, partition: Column, offset: Column, ingested: Column, clock_offset_ms: Column | None = None) -> DataFrame:
    """Canonical observations: obs_id from the record's place in the log, normalised time, entities, raw digest.

    The normalised time is the sensor's, corrected by its measured clock offset; without a sensor time it is the time of
    ingestion. entity_values lists the values of the entities, for lookups.
    """
    shift = F.coalesce(clock_offset_ms, F.lit(0)) if clock_offset_ms is not None else F.lit(0)
    corrected = F.timestamp_micros(F.unix_micros(F.col("event_time")) - shift * 1000)
    method = F.when(F.col("event_time").isNull(), "ingest_time").when(shift != 0, "clock_offset").otherwise("sensor_time")
    one = lambda kind, role, value: F.struct(F.lit(kind).alias("type"), F.lit(role).alias("role"), value.alias("value"))
    entities = F.filter(F.array(one("ip", "src", F.col("src_ip")), one("ip", "dst", F.col("dest_ip")), one("domain", "name", F.coalesce("dns.rrname", "tls.sni", "http.hostname"))), lambda e: F.coalesce(e["value"], F.lit("")) != "")
    out = eve.select(
        ids.observation_id(F.col("tenant"), F.col("sensor_id"), topic, partition, offset).alias("obs_id"), "tenant", "sensor_id", F.col("event_type").alias("type"),
        F.coalesce(corrected, ingested.cast("timestamp")).alias("ts"), method.alias("time_method"), entities.alias("entities"),
        F.array_compact(F.array(rules.lookup(CAPABILITIES, F.col("event_type")))).alias("capabilities"), F.sha2("raw", 256).alias("raw_sha256"),
        *[F.lower(F.col(f"fileinfo.{c}")).alias(c) for c in ("sha256", "sha1", "md5")],
    )
    return out.withColumn("entity_values", F.array_distinct(F.transform("entities", lambda e: e["value"])))
