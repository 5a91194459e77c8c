"""Event records of the sensor: schemas, file and Kafka readers, routing to topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import rules, time

#: Event types and the topic each is routed to; anything else goes to OTHER_TOPIC.
TOPICS = {t: f"suricata.{t}.v1" for t in ("flow", "dns", "tls", "quic", "http", "ssh", "krb5", "smb", "dcerpc", "modbus", "fileinfo", "anomaly", "alert", "stats", "arp", "dhcp")}
OTHER_TOPIC = "suricata.raw.v1"
OFFSETS = ("earliest", "latest")

ENVELOPE = (
    "timestamp string, event_type string, src_ip string, dest_ip string, src_port int, dest_port int, proto string, app_proto string, "
    "flow_id string, community_id string, host string, sensor_id string, tenant string, site string"
)
PAYLOADS = {
    "flow": "struct<start:string,bytes_toserver:long,bytes_toclient:long,pkts_toserver:long,pkts_toclient:long,age:double,state:string>",
    "dns": "struct<type:string,rrname:string,rrtype:string,rcode:string,version:int,queries:array<struct<rrname:string,rrtype:string>>,answers:array<struct<rrname:string,rrtype:string,rdata:string>>>",
    "tls": "struct<sni:string,version:string,ja3:string,ja3s:string,ja4:string,ja4s:string,subject:string,issuer:string,issuerdn:string,notbefore:string,notafter:string,fingerprint:string>",
    "http": "struct<http_method:string,url:string,hostname:string,http_user_agent:string,http_content_type:string>",
    "krb5": "struct<msg_type:string,sname:string,cname:string,encryption:string,weak_encryption:boolean,error_code:string,preauth:string>",
    "smb": "struct<command:string,status:string,filename:string,named_pipe:string,user:string,dcerpc:string>",
    "anomaly": "struct<type:string,event:string>",
    "alert": "struct<signature:string,signature_id:long,category:string,severity:string,metadata:string>",
    "fileinfo": "struct<filename:string,mime_type:string,size:long,state:string,gaps:boolean,start:long,md5:string,sha1:string,sha256:string,tx_id:long>",
    "arp": "struct<src_ip:string,src_mac:string>",
    "dhcp": "struct<assigned_ip:string,client_ip:string,client_mac:string,hostname:string,lease_time:long>",
}
#: Records of many shapes are kept as JSON and read by functions that know the shapes.
RAW = ("ndpi", "modbus", "dcerpc", "stats", "quic")


def schema() -> T.StructType:
    """The pinned schema of event records; it is never inferred."""
    parts = [ENVELOPE, *(f"{k} {v}" for k, v in PAYLOADS.items()), *(f"{k} string" for k in RAW), "_corrupt_record string"]
    return T.StructType.fromDDL(", ".join(parts))


def staged(events: DataFrame, path: str) -> DataFrame:
    """Parsed records written once, in a folder for each event type, and read again: plans of many branches then read their types only."""
    events.write.mode("overwrite").partitionBy("event_type").parquet(path)
    return events.sparkSession.read.schema(events.schema).parquet(path).select(events.columns)


def parse(lines: DataFrame, value: str = "value") -> DataFrame:
    """Event records of a column of JSON lines, with event_time and raw (the line).

    event_time is the flow's start where there is one, else the record's timestamp. Objects where a
    string is expected come as JSON text, so fingerprints of either shape survive. Lines that are no
    JSON have a _corrupt_record.
    """
    out = lines.withColumn("_e", F.from_json(F.col(value).cast("string"), schema(), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    out = out.select("_e.*", F.col(value).cast("string").alias("raw"), *[c for c in lines.columns if c != value])
    return out.withColumn("event_time", F.coalesce(time.event_time(F.col("flow.start")), time.event_time(F.col("timestamp"))))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path))


def stream_jsonl(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """New files of a folder; a rotating log shows as new files."""
    return parse(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path))


def kafka_options(servers: str, topics: list[str], offsets: str = "latest", per_batch: int = 100_000) -> dict[str, str]:
    """Options of the Kafka source; offsets other than earliest and latest fail here, not at run time."""
    if offsets not in OFFSETS:
        raise ValueError(f"offsets must be one of {OFFSETS}")
    return {"kafka.bootstrap.servers": servers, "subscribe": ",".join(topics), "startingOffsets": offsets, "maxOffsetsPerTrigger": str(per_batch), "failOnDataLoss": "true"}


def stream_kafka(spark: SparkSession, servers: str, topics: list[str], **how) -> DataFrame:
    """Event records of Kafka topics, with topic, partition and offset."""
    rows = spark.readStream.format("kafka").options(**kafka_options(servers, topics, **how)).load()
    return parse(rows.select("value", "topic", "partition", "offset"))


def routed(events: DataFrame, tenant: str, sensor: str) -> DataFrame:
    """Records with topic, key and trusted tenant and sensor: what an ingress writes to the bus.

    Keyed by source address; statistics by 'stats', records without a source by 'unkeyed'.
    """
    topic = rules.lookup(TOPICS, F.col("event_type"), F.lit(OTHER_TOPIC))
    key = F.when(F.col("event_type") == "stats", F.lit("stats")).otherwise(F.coalesce(F.nullif(F.col("src_ip"), F.lit("")), F.lit("unkeyed")))
    return events.withColumns({"topic": topic, "key": key, "tenant": F.lit(tenant), "sensor_id": F.lit(sensor)})


def reanchored(events: DataFrame, now: Column) -> DataFrame:
    """Event times shifted by one constant so that the latest is ``now``: gaps stay as they were."""
    last = events.agg(F.max("event_time").alias("_last"))
    return events.join(F.broadcast(last)).withColumn("event_time", F.col("event_time") + (now.cast("timestamp") - F.col("_last"))).drop("_last")
