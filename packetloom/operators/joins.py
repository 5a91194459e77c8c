"""Joins that Spark SQL has no syntax for: as-of, interval, CIDR, with equi-join plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import ip as ips


def asof_join(
    left: DataFrame, right: DataFrame, on: list[str], ts: str, right_ts: str, values: list[str], within: int | None = None, strict: bool = False, block: int | None = None
) -> DataFrame:
    """``left`` with the ``values`` of the latest right row of its key at or before its ``ts``.

    ``within``: seconds after which a right row is stale. ``strict``: only rows before ``ts``. Of
    right rows with one time, the largest values win; those without a time match nothing. Rows
    without a match get nulls.

    One union and one window sorted by time: a shuffle of both sides, and no left row is ever
    multiplied, however many right rows a key has. A key is divided by time, so a hot one is spread
    over tasks: with ``within`` into blocks of that length, where a right row also shows in the block
    after its own; else, with ``block`` (seconds), into such blocks, each of which begins with the
    last right row of those before it. That row is found among one row a key and block.
    """
    packed = F.struct(F.col(right_ts).alias("_t"), *[F.col(v) for v in values])
    kind, width = 1 if strict else -1, within or block
    nth = (lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (width * 1_000_000))) if width else (lambda c: F.lit(0).cast("long"))
    full = left.select(F.struct("*").alias("x")).schema["x"].dataType
    r = right.filter(F.col(right_ts).isNotNull()).select(*on, nth(right_ts).alias("_block"), F.col(right_ts).alias("_at"), F.lit(0).alias("_kind"), packed.alias("_right"), F.lit(None).cast(full).alias("_left"))
    all_left = left.select(*on, nth(ts).alias("_block"), F.col(ts).alias("_at"), F.lit(-kind).alias("_kind"), F.lit(None).cast(r.schema["_right"].dataType).alias("_right"), F.struct("*").alias("_left"))
    if within:
        r = r.withColumn("_block", F.explode(F.array("_block", F.col("_block") + 1)))
    elif block:
        last = r.groupBy(*on, "_block").agg(F.max("_right").alias("_right"))
        asked = all_left.select(*on, "_block").distinct().withColumn("_right", F.lit(None).cast(r.schema["_right"].dataType))
        each = last.unionByName(asked).groupBy(*on, "_block").agg(F.max("_right").alias("_right"))
        before = Window.partitionBy(*on).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        carried = each.withColumn("_right", F.last("_right", ignorenulls=True).over(before)).filter("_right IS NOT NULL")
        r = r.unionByName(carried.select(*on, "_block", F.col("_right._t").alias("_at"), F.lit(0).alias("_kind"), "_right", F.lit(None).cast(full).alias("_left")))
    w = Window.partitionBy(*on, "_block").orderBy("_at", "_kind", "_right").rowsBetween(Window.unboundedPreceding, 0)
    out = r.unionByName(all_left).withColumn("_last", F.last("_right", ignorenulls=True).over(w)).filter("_left IS NOT NULL")
    if within is not None:
        fresh = F.col("_at").cast("timestamp") - F.col("_last._t").cast("timestamp") <= F.make_dt_interval(secs=F.lit(within))
        out = out.withColumn("_last", F.when(fresh, F.col("_last")))
    return out.select("_left.*", *[F.col(f"_last.{v}").alias(v) for v in values])


def interval_join(left: DataFrame, right: DataFrame, on: list[str], ts: str, start: str, end: str, how: str = "inner") -> DataFrame:
    """Rows of ``left`` with the right rows of their key whose [start, end) holds ``ts``; a null end is open."""
    r = right.select([F.col(c).alias(f"_{c}") for c in on] + [c for c in right.columns if c not in on])
    same = [F.col(c) == F.col(f"_{c}") for c in on]
    cond = (F.col(start) <= F.col(ts)) & (F.col(end).isNull() | (F.col(ts) < F.col(end)))
    for c in same:
        cond = cond & c
    return left.join(r, cond, how).drop(*[f"_{c}" for c in on])


def masked_join(left: DataFrame, nets: DataFrame, length: str, left_key: Column, net_key: Column, on: list[str] = (), how: str = "inner") -> DataFrame:
    """Containment join on masked keys: the few distinct prefix lengths are exploded, the rest is an equi-join.

    ``length`` is the column of ``nets`` with the prefix length; ``left_key`` and ``net_key`` are key
    expressions of either side (see functions.ip.key). At most 129 lengths exist.
    """
    lengths = nets.select(F.col(length).alias("_n")).distinct().agg(F.array_sort(F.collect_set("_n")).alias("_lengths"))
    row = left.withColumn("_key", left_key).join(F.broadcast(lengths)).withColumn("_n", F.explode("_lengths"))
    row = row.withColumn("_mask", ips.mask(F.col("_key"), F.col("_n"))).drop("_lengths", "_key")
    net = nets.select([F.col(c).alias(f"_net_{c}") for c in on] + [c for c in nets.columns if c not in on] + [net_key.alias("_net_key")])
    net = net.withColumn("_net_mask", ips.mask(F.col("_net_key"), F.col(length))).drop("_net_key")
    cond = (F.col("_mask") == F.col("_net_mask")) & (F.col("_n") == F.col(length))
    for c in on:
        cond = cond & (F.col(c) == F.col(f"_net_{c}"))
    return row.join(net, cond, how).drop("_n", "_mask", "_net_mask", *[f"_net_{c}" for c in on])


def cidr_join(left: DataFrame, address: str, nets: DataFrame, cidr: str, on: list[str] = ()) -> DataFrame:
    """Rows of ``left`` with every network of ``nets`` that contains their address (IPv4 and IPv6)."""
    n = nets.withColumn("_length", ips.net_length(F.col(cidr))).filter("_length IS NOT NULL")
    base = ips.key(F.get(F.split(F.col(cidr), "/"), F.lit(0)))
    return masked_join(left, n, "_length", ips.key(F.col(address)), base, on).drop("_length")


def _pieces(items: str, most: int) -> Column:
    """The list in pieces of at most so many."""
    return F.explode(F.transform(F.sequence(F.lit(1), F.size(items), F.lit(most)), lambda i: F.slice(items, i, most)))


def cidr_members(left: DataFrame, id: str, address: str, nets: DataFrame, member: str, cidr: str, span: int = 65_536) -> DataFrame:
    """Pairs (id of ``left``, member of ``nets``) of every network that contains the address, where many members share a network.

    Addresses that no network tells apart are one list of ids, the members (whole numbers) of equal networks another; lists meet, and
    are unfolded last, so a pair costs no lookup. A list holds at most 1,024 ids, or the members of one range of ``span`` numbers. A
    small table can have very many pairs: what has met is dealt out over all cores before. Rows without id or member have no pairs.

    Pairs come in blocks of 64 members by 128 ids, the few ids of a task side by side: a columnar file holds them as runs of a member
    and a short list of ids that repeats, at about a seventh of a byte a pair, and no task has more than a block's rows at once.
    """
    deal = 8 * left.sparkSession.sparkContext.defaultParallelism
    n = nets.withColumn("_length", ips.net_length(F.col(cidr))).filter("_length IS NOT NULL")
    n = n.withColumn("_base", ips.key(F.get(F.split(F.col(cidr), "/"), F.lit(0))))
    same = [ips.mask(F.col("_base"), F.col("_length")).alias("_mask"), F.floor(F.col(member) / span).alias("_span")]
    held = n.groupBy("_length", *same).agg(F.min("_base").alias("_base"), F.sort_array(F.collect_list(member)).alias("_members")).drop("_mask", "_span")
    lengths = n.select("_length").distinct().agg(F.array_sort(F.collect_set("_length")).alias("_lengths"))
    row = left.select(id, ips.key(F.col(address)).alias("_at")).filter("_at IS NOT NULL").join(F.broadcast(lengths))
    row = row.withColumn("_masks", F.transform("_lengths", lambda x: ips.mask(F.col("_at"), x)))
    # sorted, so that a task that runs again cuts the same pieces
    asked = row.groupBy("_masks", F.pmod(F.xxhash64(id), F.lit(64)).alias("_part")).agg(F.min("_at").alias("_at"), F.sort_array(F.collect_list(id)).alias("_all"))
    asked = asked.select("_at", _pieces("_all", 1_024).alias("_ids"))
    met = masked_join(asked, held, "_length", F.col("_at"), F.col("_base")).select("_ids", "_members")
    first = [F.get(c, F.lit(0)) for c in ("_ids", "_members")]
    block = met.repartition(deal, first[0]).sortWithinPartitions(*first)
    block = block.select("_members", _pieces("_ids", 128).alias("_ids")).select("_ids", _pieces("_members", 64).alias("_members"))
    return block.select("_ids", F.explode("_members").alias(member)).select(F.explode("_ids").alias(id), member)


def reconcile(before: DataFrame, now: DataFrame, key: list[str]) -> DataFrame:
    """Keys of ``before`` that ``now`` no longer has: the tombstones to write."""
    return before.select(*key).distinct().join(now.select(*key).distinct(), key, "left_anti")
