"""The read API: parameterised queries over the evidence tables of granted tenants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import evidence, intel, scoring


class Engine:
    """Queries over a folder of Parquet tables; every query is limited to the granted tenants at the scan."""

    def __init__(self, spark: SparkSession, folder: str, tenants: list[str]):
        if not tenants:
            raise ValueError("no tenant is granted")
        self.spark, self.folder, self.tenants = spark, folder, list(tenants)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}").filter(F.col("tenant").isin(*self.tenants))

    def observations(self, entity: str, start: float, end: float, kind: str | None = None, file_hash: str | None = None, page: int = 100, after: tuple | None = None) -> DataFrame:
        """A page of observations of an entity (or digest) in [start, end), and one row more if there are more."""
        evidence.checked_request(entity, file_hash, page, start, end)
        rows = evidence.observations(self.table("observations"), self.tenants, entity, kind, file_hash)
        rows = rows.filter((F.col("ts") >= F.timestamp_seconds(F.lit(start))) & (F.col("ts") < F.timestamp_seconds(F.lit(end))))
        return evidence.page_after(rows, "ts", "obs_id", after, page)

    def entity_timeline(self, entity: str) -> DataFrame:
        evidence.checked_request(entity)
        obs = self.table("observations").filter(F.array_contains("entity_values", entity)).select("tenant", "ts", F.col("obs_id").alias("id"), F.col("type").alias("label"))
        facts = self.table("facts").filter(F.col("subject") == entity).select("tenant", F.col("valid_from").alias("ts"), F.col("predicate").alias("id"), F.col("value").alias("label"))
        return evidence.timeline(observation=obs, fact=facts).orderBy("ts", F.col("kind").desc(), "id")

    def relationships(self, entity: str) -> DataFrame:
        evidence.checked_request(entity)
        return self.table("relations").filter((F.col("from") == entity) | (F.col("to") == entity)).orderBy(F.col("last_seen").desc(), "from", "to")

    def findings(self, entity: str, start: float, end: float, most: int = 10_000) -> DataFrame:
        evidence.checked_request(entity)
        f = self.table("findings").withColumn("entities", F.array(F.struct(F.col("src_ip").alias("value")), F.struct(F.col("dest_ip").alias("value"))))
        return evidence.findings_of(f, ["tenant", "finding_id"], ["revision", "ingested_at"], entity, F.timestamp_seconds(F.lit(start)), F.timestamp_seconds(F.lit(end))).orderBy("first_seen", "finding_id").limit(most + 1)

    def reconstruct(self, asset: str, most: int = 500) -> DataFrame:
        """Flows, sessions and findings that mention an asset, by time."""
        evidence.checked_request(asset)
        hit = lambda df, *cs: df.filter(F.exists(F.array(*[F.col(c) for c in cs]), lambda v: v == asset))
        flows = hit(self.table("flows"), "src_ip", "dest_ip").select("tenant", F.col("event_time").alias("ts"), F.concat_ws(" -> ", "src_ip", "dest_ip").alias("label")).orderBy("ts", "label").limit(most)
        found = hit(self.table("findings"), "src_ip", "dest_ip").select("tenant", F.col("first_seen").alias("ts"), F.col("detector_id").alias("label")).orderBy("ts", "label").limit(most)
        return evidence.timeline(flow=flows, finding=found).orderBy("ts", "kind", "label")

    def attack_coverage(self, catalog: DataFrame, detectors: DataFrame) -> DataFrame:
        observed = self.table("findings").select(F.explode("mitre").alias("technique"))
        return evidence.attack_coverage(catalog, detectors, observed)

    def detector_quality(self) -> DataFrame:
        return scoring.detector_quality(self.table("dispositions"), self.table("findings"))

    def hunt(self, start: float, end: float) -> DataFrame:
        at = lambda s: F.timestamp_seconds(F.lit(s))
        return intel.hunt(self.table("indicators_seen"), self.table("intel"), at(start), at(end))

    def triage(self, entity: str, start: float, end: float) -> DataFrame:
        """One row: how many current findings of each step of a command-and-control triage, and a verdict (suspicious if all steps have support)."""
        f = self.findings(entity, start, end)
        steps = {"beaconing": ("beacon", "beacon_fqdn", "strobe"), "reputation": ("threat_intel", "ids_signature"), "naming": ("dga_domain", "dns_tunnel", "dns_exploded"), "transfer": ("exfil", "low_slow_exfil")}
        one = f.agg(*[F.count_if(F.col("detector_id").isin(*v)).alias(k) for k, v in steps.items()])
        every = F.lit(True)
        for k in steps:
            every = every & (F.col(k) > 0)
        return one.withColumn("verdict", F.when(every, "suspicious").otherwise("undetermined")).withColumn("confidence", F.when(every, 0.75).otherwise(0.0))

    def sensors(self, now: float, skew_ms: float = 100, stale: float = 90) -> DataFrame:
        t = self.table("sensors")
        return t.withColumn("skewed", F.coalesce(F.abs("clock_offset_ms") > skew_ms, F.lit(False))).withColumn("offline", F.coalesce(F.unix_seconds("received_at") < now - stale, F.lit(True)))

    def groups(self) -> DataFrame:
        return self.table("sensors").select("tenant", "sensor_id", F.explode("groups").alias("group")).groupBy("tenant", "group").agg(F.array_sort(F.collect_set("sensor_id")).alias("sensors"))
