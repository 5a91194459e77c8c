"""N-gram Jaccard join by PartEnum signatures.

Linked documents are those whose sets of k-word shingles have Jaccard similarity of at least
``percent`` / 100. Sets are put into bands of sizes. Within a band, linked sets differ in at
most d elements (their Hamming distance), so after splitting the hashed feature domain into n1
partitions of n2 parts, some partition has at most k2 differing elements, and there the sets
agree on some n2 - k2 parts. A signature is the content of such a subset of parts; linked sets
share one for certain. Every pair that the signatures bring together is then checked exactly.

Empty subsets, and subsets that very many sets share, would bring unrelated sets together. n1 is
therefore larger than needed by t, so that t + 1 partitions must be good, and linked sets share at
least t + 1 subsets of different partitions. Each set may then leave out as many as t partitions:
those that are *weak* (have an empty subset) if there are no more, and beside them its most frequent
signatures, up to t in all. No link is lost: all sets rank signatures alike (empty ones first, then
by how many sets share them, then by value), so a set that leaves out the least frequent one of the
t + 1 that it shares with another would have to leave out all of them.

Equal sets are one *node*, named by a 64-bit hash of the set (another seed is taken if two sets
ever share one). For components, pairs are formed without listing all pairs of a signature's group:
each member meets the group's two smallest nodes; where a group is then still in several components,
its members meet one more of them; only members that are in different components after that meet
each other, block by block, so that no task gets a whole large group. Links inside a component cannot
change it. Pairs whose parity sketches already prove that the two sets differ too much go unverified.
``jaccard_links`` gives the links themselves, between all candidates of every group.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from . import _text
from ._store import Workspace, small_batches
from .components import components

WORDS = 4
PERCENT = 85
BAND = 1.4
#: Words of a parity sketch (64 bits each).
SKETCH_LONGS = 16
#: Longs of it that are compared first.
SHORT_SKETCH = 4
#: Rounds in which members of open groups meet one member that a hash picks.
ROUNDS = 1
#: Members of a group that meet in one task.
BLOCK = 512
#: Low bits of a signature that hold its band.
TAG_BITS = 8
#: Signatures that more rows than this share, as a sample of one row in SAMPLE estimates it, are grouped by aggregates instead of in one task.
HEAVY_ROWS, SAMPLE = 1_000_000, 100
#: Heavy signatures up to which their table is broadcast (24 bytes each).
BROADCAST_SIGNATURES = 1_000_000
#: Chance that a set of a band's smallest size has too many weak partitions.
RARE = 1e-3
#: Bits of the filter that picks the documents to read again, 2 MB whatever the input.
FILTER_BITS = 24
_PART = np.uint64(0xA24BAED4963EE407)
_SIDE = np.uint64(0x9FB21C651E98DF25)


def band_bounds(most: int, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Bands (least, most) of set sizes, up to the one that holds ``most``; linked sets are one band apart at most."""
    out, low = [], 1
    while not out or out[-1][1] < most:
        high = max(low, int(low * BAND), low * 100 // percent)
        out.append((low, high))
        low = high + 1
    return out


def _more_than(k: int, n: int, p: float) -> float:
    """Chance of more than k hits in n tries of chance p each."""
    if not 0 < p < 1:
        return float(p >= 1 and k < n)
    log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    return max(0.0, 1 - sum(map(math.exp, log)))


class Scheme:
    """PartEnum parameters of the pairs that meet in one band: one set in it, the other in it or just above."""

    def __init__(self, tag: int, low: int, high: int, percent: int = PERCENT):
        self.tag, self.low, self.high = tag, low, high
        over = high * 100 // percent
        #: |A xor B| <= (|A| + |B|) (1 - s) / (1 + s) for linked sets
        self.distance = (high + over) * (100 - percent) // (100 + percent)
        self.k2, self.n2 = (1, 3) if high <= 64 else (0, 1)
        best = (2.0, 0)
        for spare in range(self.distance + 2):
            n1 = self.distance // (self.k2 + 1) + 1 + spare
            empty = math.exp(-low / (n1 * self.n2))
            weak = empty if self.n2 == 1 else 3 * empty**2 - 2 * empty**3
            best = min(best, (max(RARE, _more_than(spare, n1, weak)), spare))
            if best[0] == RARE:
                break
        self.spare = best[1]
        self.n1 = self.distance // (self.k2 + 1) + 1 + self.spare
        self.subsets = list(combinations(range(self.n2), self.n2 - self.k2))

    def signatures(self, elements: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Signatures of sets that lie one after another in ``elements``, with offsets, and how many more each set may leave out."""
        sets, parts = len(off) - 1, self.n1 * self.n2
        h = _text.mix64(elements ^ _PART)
        where = ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        where = where.astype(np.int64) + np.repeat(np.arange(sets) * parts, np.diff(off))
        sums = np.zeros(sets * parts, np.uint64)
        np.add.at(sums, where, _text.mix64(elements ^ _SIDE))
        sums = sums.reshape(sets, self.n1, self.n2)
        empty = sums == 0
        void = np.stack([empty[:, :, list(c)].all(axis=2) for c in self.subsets], axis=2)
        weak = void.any(axis=2).sum(axis=1)
        rare = weak > self.spare
        sigs = np.empty((sets, self.n1, len(self.subsets)), np.uint64)
        for j, c in enumerate(self.subsets):
            v = np.zeros((sets, self.n1), np.uint64)
            for m, p in enumerate(c):
                v += sums[:, :, p] * np.uint64(2 * m + 1)
            salt = (self.tag << 40) + np.arange(self.n1) * 8 + j
            sigs[:, :, j] = _text.mix64(v ^ _text.mix64(salt.astype(np.uint64)))
        sigs = sigs >> np.uint64(TAG_BITS) << np.uint64(TAG_BITS) | np.uint64(self.tag)
        keep = (~void | rare[:, None, None]).reshape(sets, -1)
        return sigs.reshape(sets, -1)[keep], np.concatenate([[0], np.cumsum(keep.sum(axis=1))]), np.where(rare, 0, self.spare - weak)


def sketches(elements: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Parity sketches: bit i tells whether an odd number of elements hash to i. They differ in |A xor B| bits at most."""
    bits = SKETCH_LONGS * 64
    at = (_text.mix64(elements ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(bits)).astype(np.int64)
    count = np.bincount(at + np.repeat(np.arange(len(off) - 1) * bits, np.diff(off)), minlength=(len(off) - 1) * bits)
    return np.packbits((count & 1).astype(np.uint8).reshape(-1, bits), axis=1, bitorder="little").view(np.uint64)


def distinct_sets(texts: list[bytes | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's sorted distinct shingle hashes, one after another, with offsets."""
    s, off = _text.shingles(*_text.word_hashes(texts), words)
    parts = []
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        x = np.sort(s[a:b])
        if len(x) > 1:
            x = x[np.concatenate([[True], x[1:] != x[:-1]])]
        parts.append(x)
    return np.concatenate([np.empty(0, np.uint64), *parts]), np.cumsum([0] + [len(p) for p in parts])


def _fingerprints(elements: np.ndarray, off: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for salt in (0x1B873593CC9E2D51 + seed, 0x85EBCA6BC2B2AE35):
        run = np.concatenate([[np.uint64(0)], np.cumsum(_text.mix64(elements ^ np.uint64(salt)))])
        out.append(run[off[1:]] - run[off[:-1]])
    return out[0], out[1]


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _lists(values: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), _longs(values))


def _batches(batches, slab: int = _text.SLAB):
    for batch in batches:
        text = batch.column("text").cast(pa.binary())
        for a, b in _text.groups_of(pc.fill_null(pc.binary_length(text), 0).to_pylist(), slab):
            yield batch.slice(a, b - a), text.slice(a, b - a).to_pylist()


SETS = "n int, node long, hi long, sketch array<long>, tag int, spare int, spare_below int, sigs array<long>"


def _scan(words: int, percent: int, seed: int):
    def run(batches):
        seen: set[tuple[int, int]] = set()  # 16 bytes of content for each distinct text of this partition
        schemes: list[Scheme] = []
        for batch, texts in _batches(batches):
            el, off = distinct_sets(texts, words)
            n = np.diff(off)
            lo, hi = _fingerprints(el, off, seed)
            new = []
            for i, key in enumerate(zip(lo.tolist(), hi.tolist(), strict=True)):
                if n[i] and key not in seen:
                    seen.add(key)
                    new.append(i)
            sigs: list[list[np.ndarray]] = [[] for _ in texts]
            own, spare = np.zeros(len(texts), np.int64), np.full((2, len(texts)), -1, np.int64)
            if new:
                if not schemes or schemes[-1].high < n.max():
                    schemes = [Scheme(i, a, b, percent) for i, (a, b) in enumerate(band_bounds(int(n.max()), percent))]
                own = np.searchsorted([s.high for s in schemes], n)
                for tag in range(max(0, own[new].min() - 1), own[new].max() + 1):
                    s = schemes[tag]
                    if not s.distance:
                        continue
                    # the band's own sets, and those of the next band that may link into this one
                    in_it = [i for i in new if own[i] == tag or own[i] == tag + 1 and -(-int(n[i]) * percent // 100) <= s.high]
                    for a, b in _text.groups_of([int(n[i]) for i in in_it], _text.SLAB >> 3):
                        some = in_it[a:b]
                        got, cut, left = s.signatures(np.concatenate([el[off[i] : off[i + 1]] for i in some]), np.cumsum([0] + [int(n[i]) for i in some]))
                        for j, i in enumerate(some):
                            sigs[i].append(got[cut[j] : cut[j + 1]])
                            spare[own[i] - tag, i] = left[j]
            flat = [x for own_sigs in sigs for x in own_sigs]
            counts = np.cumsum([0] + [sum(map(len, x)) for x in sigs])
            # a text seen before in this partition has its sketch there
            sketch = sketches(el, off)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("v"), pa.array(n.astype(np.int32)), _longs(lo), _longs(hi),
                    _lists(sketch.reshape(-1), np.arange(len(texts) + 1) * SKETCH_LONGS),
                    pa.array(own.astype(np.int32)), pa.array(spare[0].astype(np.int32)), pa.array(spare[1].astype(np.int32)),
                    _lists(np.concatenate([np.empty(0, np.uint64), *flat]), counts),
                ],
                ["doc_id", "v", "n", "node", "hi", "sketch", "tag", "spare", "spare_below", "sigs"],
            )

    return run


def _reread(words: int, seed: int, wanted):
    """Sets of the documents whose slot is in the filter; slot is a hash of doc_id."""

    def run(batches):
        for batch in batches:
            slot = batch.column("slot").to_numpy()
            some = (wanted.value[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1)
            batch = batch.filter(pa.array(some.astype(bool)))
            for _, texts in _batches([batch]):
                el, off = distinct_sets(texts, words)
                lo, hi = _fingerprints(el, off, seed)
                yield pa.RecordBatch.from_arrays([_longs(lo), _longs(hi), _lists(el, off)], ["node", "hi", "elements"])

    return run


def _counted_in_tasks(row: DataFrame) -> DataFrame:
    """(sig, node, c) of signatures that several nodes share; c is how often they occur."""
    w = Window.partitionBy("sig")
    row = row.withColumn("c", F.count(F.lit(1)).over(w)).withColumn("p", F.min("node").over(w)).withColumn("q", F.max("node").over(w))
    return row.filter("p <> q").select("sig", "node", "c")


def _counted_by_aggregates(row: DataFrame, small) -> DataFrame:
    count = row.groupBy("sig").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("p"), F.max("node").alias("q"))
    return row.join(small(count.filter("p <> q").select("sig", "c")), "sig").select("sig", "node", "c")


def _in_tasks(row: DataFrame) -> DataFrame:
    """Groups of signatures that fit a task each."""
    w = Window.partitionBy("sig")
    row = row.withColumn("h1", F.min("node").over(w)).filter("node <> h1")
    row = row.withColumn("h2", F.min("node").over(w))
    rest = F.when(F.col("node") != F.col("h2"), F.col("node"))
    return row.withColumn("more", F.min(rest).over(w) < F.max(rest).over(w)).select("sig", "node", "h1", "h2", "more")


def _by_aggregates(row: DataFrame, small) -> DataFrame:
    """The same for heavy signatures: what a group needs comes from aggregates with map-side combining."""
    first = row.groupBy("sig").agg(F.min("node").alias("h1"))
    row = row.join(small(first), "sig").filter("node <> h1")
    second = row.groupBy("sig").agg(F.min("node").alias("h2"))
    row = row.join(small(second), "sig")
    rest = F.when(F.col("node") != F.col("h2"), F.col("node"))
    more = row.groupBy("sig").agg((F.min(rest) < F.max(rest)).alias("more"))
    return row.join(small(more), "sig").select("sig", "node", "h1", "h2", "more")


class JaccardJoin:
    """The steps of the join, over one table of documents."""

    def __init__(self, docs: DataFrame, words: int = WORDS, percent: int = PERCENT):
        self.words, self.percent, self.seed = words, percent, 0
        self.ws = Workspace(docs.sparkSession, "jaccard-join")
        small_batches(docs.sparkSession)
        self.docs = docs.select("doc_id", variant(F.col("text")).alias("v"), "text")

    def run(self) -> DataFrame:
        """doc_id, n_shingles and component_id of every row."""
        self.prepare()
        rows = self.ws.save(self.named(), "named")
        name = rows.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id")).withColumnRenamed("root", "_root")
        out = rows.join(name, F.col("root") == F.col("_root"), "left")
        return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))

    def prepare(self) -> None:
        """Scans the texts: ``rows`` (doc_id, v, n, node), ``nodes`` with sketches, and ``groups`` of nodes by signature."""
        ws = self.ws
        schema = T.StructType([*self.docs.schema.fields[:2], *T._parse_datatype_string(SETS).fields])
        while True:
            scanned = ws.save(self.docs.mapInArrow(_scan(self.words, self.percent, self.seed), schema), "scan")
            some = scanned.filter("n > 0")
            key = some.groupBy("node").agg(
                F.min("doc_id").alias("least"), F.min("n").alias("n"), F.max("n").alias("n2"), F.min("hi").alias("hi"), F.max("hi").alias("hi2"),
                F.max("tag").alias("tag"), F.max("spare").alias("spare"), F.max("spare_below").alias("spare_below"),
            )
            key = ws.save(key, "keys")
            if key.filter("n <> n2 OR hi <> hi2").isEmpty():
                break
            self.seed += 1  # two sets share a name
        self.rows = ws.save(scanned.select("doc_id", "v", "n", "node"), "rows")
        sketch = some.select("node", "sketch").dropDuplicates(["node"])
        self.nodes = ws.save(key.select("node", "n", "hi", "least").join(sketch, "node"), "nodes")
        self.groups = self._groups(scanned, key.select("node", "tag", "spare", "spare_below"))
        ws.drop("scan", "keys", "shared")

    def _groups(self, scanned: DataFrame, spare: DataFrame) -> DataFrame:
        """Members (sig, node) of signatures that several nodes share, but for the smallest node h1; with h1, the
        second smallest h2, and whether at least two more nodes share the signature."""
        row = scanned.select(F.explode("sigs").alias("sig"), "node")
        often = row.sample(1 / SAMPLE, seed=1).groupBy("sig").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > HEAVY_ROWS / SAMPLE)
        often = self.ws.save(often.select("sig"), "heavy")
        n = often.count()
        small = (lambda df: F.broadcast(df)) if n <= BROADCAST_SIGNATURES else (lambda df: df)

        def split(rows, light, heavy):
            if not n:
                return light(rows)
            return light(rows.join(small(often), "sig", "left_anti")).unionByName(heavy(rows.join(small(often), "sig", "left_semi"), small))

        shared = self.ws.save(split(row, _counted_in_tasks, _counted_by_aggregates), "shared")
        # each set leaves out its most frequent signatures, as many as it may
        tag = F.col("sig").bitwiseAND(F.lit((1 << TAG_BITS) - 1))
        row = shared.join(spare, "node").withColumn("band", tag)
        order = Window.partitionBy("node", "band").orderBy(F.col("c").desc(), "sig")
        row = row.withColumn("rank", F.dense_rank().over(order))
        row = row.filter(F.col("rank") > F.when(F.col("band") == F.col("tag"), F.col("spare")).otherwise(F.col("spare_below")))
        return self.ws.save(split(row.select("sig", "node").distinct(), _in_tasks, _by_aggregates), "groups")

    def _stars(self) -> DataFrame:
        """Pairs (a < b) of each signature's two smallest nodes with all its others, each once."""
        hubs = F.array(F.col("h1"), F.when(F.col("h2") != F.col("node"), F.col("h2")))
        pair = self.groups.select("node", F.explode(hubs).alias("hub")).filter("hub IS NOT NULL")
        return pair.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()

    def _open(self, roots: DataFrame | None, name: str) -> DataFrame:
        """(sig, node, root, c) of groups whose c members, other than those two, are in several components."""
        row = self.groups.filter("more AND node <> h2").select("sig", "node")
        row = row.join(roots, "node", "left") if roots is not None else row.withColumn("root", F.col("node"))
        row = row.withColumn("root", F.coalesce("root", "node"))
        apart = row.groupBy("sig").agg(F.min("root").alias("p"), F.max("root").alias("q"), F.count(F.lit(1)).alias("c")).filter("p <> q")
        return self.ws.save(row.join(apart.select("sig", "c"), "sig"), name)

    def _round(self, rows: DataFrame, i: int) -> DataFrame:
        """Pairs (a < b) of the members of each open group with one of them, picked by a hash, in other components."""
        order = F.struct(F.xxhash64("node", F.lit(i)), F.col("node"))
        hub = rows.groupBy("sig").agg(F.min(F.struct(order.alias("o"), F.col("root"))).alias("h")).select("sig", F.col("h.o.node").alias("hub"), F.col("h.root").alias("hub_root"))
        pair = rows.join(hub, "sig").filter("root <> hub_root")
        return pair.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()

    def _meet(self, rows: DataFrame) -> DataFrame:
        """Pairs (a < b) of members of a group (sig, node, root, c) that have different roots and that sketches leave possible.

        A group of more than BLOCK members is dealt into blocks, and each pair of blocks meets by itself.
        """
        k = F.ceil(F.col("c") / BLOCK)
        row = rows.join(self.nodes.select("node", "n", "sketch"), "node").withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), k))
        row = row.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), k - 1)))
        row = row.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("c", "other")
        x, y = row.alias("x"), row.alias("y")
        cond = (F.col("x.sig") == F.col("y.sig")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
        cond &= (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root"))
        cond &= (F.col("x.i") == F.col("x.j")) | (F.col("x.block") != F.col("y.block"))
        pair = x.join(y, cond & self._may_link("x", "y", SHORT_SKETCH) & self._may_link("x", "y", SKETCH_LONGS))
        return pair.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()

    def _may_link(self, x: str, y: str, longs: int):
        a, b = F.col(f"{x}.n"), F.col(f"{y}.n")
        sizes = F.least(a, b) * 100 >= F.greatest(a, b) * self.percent
        bits = [F.bit_count(F.col(f"{x}.sketch")[i].bitwiseXOR(F.col(f"{y}.sketch")[i])) for i in range(longs)]
        return sizes & (sum(bits[1:], bits[0]) * (100 + self.percent) <= (a + b) * (100 - self.percent))

    def _possible(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose sketches leave a link possible."""
        info = self.nodes.select("node", "n", "sketch")
        pair = pairs.join(info.toDF("a", "n", "sketch").alias("x"), "a").join(info.toDF("b", "n", "sketch").alias("y"), "b")
        return pair.filter(self._may_link("x", "y", SKETCH_LONGS)).select("a", "b")

    def _filter(self, ids: DataFrame) -> np.ndarray:
        """A bit for the hash of each doc_id: gathered as at most 2 ** FILTER_BITS / 64 words."""
        slot = ids.select(_slot(F.col("doc_id")).alias("slot"))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("slot") % 64).cast("int"))
        words = slot.groupBy(F.floor(F.col("slot") / 64).cast("long").alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
        out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
        out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
        return out

    def _sets(self, pairs: DataFrame, name: str) -> DataFrame:
        """(node, elements) of the nodes of some pairs, made again from the texts of one document each."""
        ws = self.ws
        ids = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        key = ws.save(self.nodes.join(ids, "node", "left_semi").select("node", "hi", F.col("least").alias("doc_id")), f"{name}-keys")
        wanted = self.docs.sparkSession.sparkContext.broadcast(self._filter(key))
        texts = self.docs.select("text", _slot(F.col("doc_id")).alias("slot"))
        got = texts.mapInArrow(_reread(self.words, self.seed, wanted), "node long, hi long, elements array<long>")
        return ws.save(got.join(key.select("node", "hi"), ["node", "hi"]).dropDuplicates(["node", "hi"]).select("node", "elements"), name)

    def _verify(self, pairs: DataFrame, i: int) -> DataFrame:
        """(a, b, same, similarity) of the pairs that are linked, by exact intersection of their sets."""
        s, sets = F.col("same"), self._sets(pairs, f"sets-{i}")
        both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
        both = both.select("a", "b", F.size("x").alias("p"), F.size("y").alias("q"), F.size(F.array_intersect("x", "y")).alias("same"))
        linked = both.filter(s * 100 >= (F.col("p") + F.col("q") - s) * self.percent)
        out = self.ws.save(linked.select("a", "b", (s / (F.col("p") + F.col("q") - s)).alias("similarity")), f"links-{i}")
        self.ws.drop(f"sets-{i}", f"sets-{i}-keys")
        return out

    def named(self) -> DataFrame:
        """``rows`` with the root of their component; null for rows without shingles."""
        ws, roots, links = self.ws, None, None
        tested = ws.save(self._possible(self._stars()), "pairs-0")
        if not tested.isEmpty():
            links = self._verify(tested, 0).select("a", "b")
            roots = components(links, ws, "cc-0")
        rows = self._open(roots, "open-0")
        for i in range(1, ROUNDS + 2):
            if rows.isEmpty():
                break
            pairs = self._possible(self._round(rows, i)) if i <= ROUNDS else self._meet(rows)
            pairs = ws.save(pairs.join(tested, ["a", "b"], "left_anti"), f"pairs-{i}")
            if pairs.isEmpty():
                continue
            tested = tested.unionByName(pairs)
            found = self._verify(pairs, i).select("a", "b")
            if not found.isEmpty():
                links = links.unionByName(found) if links is not None else found
                roots = components(links, ws, f"cc-{i}")
                rows = self._open(roots, f"open-{i}") if i <= ROUNDS else rows
        ws.drop("groups", *(f"{kind}-{j}" for kind in ("pairs", "links", "open") for j in range(ROUNDS + 2)))
        out = self.nodes.select(F.col("node").alias("_node"), "least")
        out = out.join(roots.withColumnRenamed("node", "_node"), "_node", "left") if roots is not None else out.withColumn("root", F.col("_node"))
        out = out.withColumn("root", F.coalesce("root", "_node"))
        return self.rows.join(out.select("_node", "root"), (self.rows["node"] == F.col("_node")) & (self.rows["n"] > 0), "left").drop("_node")

    def links(self) -> DataFrame:
        """(a, b, similarity) of all linked pairs of nodes."""
        members = self.groups.select("sig", F.explode(F.array("node", "h1")).alias("node")).distinct()
        count = members.groupBy("sig").agg(F.count(F.lit(1)).alias("c"))
        rows = self.ws.save(members.join(count, "sig").withColumn("root", F.col("node")), "members")
        return self._verify(self.ws.save(self._meet(rows), "pairs"), 0)


def _slot(doc_id):
    return F.pmod(F.xxhash64(doc_id), F.lit(1 << FILTER_BITS))


def variant(text):
    """Tells texts under one doc_id apart."""
    return F.xxhash64(text)


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    component_id is the smallest doc_id that links reach. A null or empty text, or one without
    words, has no shingles and no link. Rows with one doc_id but different texts are different
    sets; each row gets its own set's component. A null doc_id never names a component unless it
    has no other. doc_id may be of any type that has an order. Texts are compared as bytes, so
    bytes that are no UTF-8 are parts of words like any others.
    """
    return JaccardJoin(docs, words, percent).run()


def jaccard_links(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(links, members). links: (a, b, similarity) of all linked pairs of different sets, a set being
    named by a number; members: doc_id, n_shingles and set of every row of ``docs`` (null without shingles).

    Copies of one set are not expanded into pairs: they are linked by having the same set.
    """
    join = JaccardJoin(docs, words, percent)
    join.prepare()
    return join.links(), join.rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("node")).alias("set"))


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each component does: the one of the smallest doc_id.

    Of several texts under that doc_id one stays; rows that repeat both are one document, and all stay.
    Rows without shingles stay. A null doc_id is larger than any other.
    """
    join = JaccardJoin(docs, words, percent)
    join.prepare()
    rows = join.ws.save(join.named(), "named")
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("v"))
    best = rows.filter("root IS NOT NULL").groupBy("root").agg(F.min(place).alias("k")).select(F.col("k.doc_id").alias("__pl_id"), F.col("k.v").alias("__pl_v"))
    keep = best.unionByName(rows.filter("root IS NULL").select(F.col("doc_id").alias("__pl_id"), F.col("v").alias("__pl_v"))).distinct()
    return docs.join(keep, docs["doc_id"].eqNullSafe(keep["__pl_id"]) & variant(docs["text"]).eqNullSafe(keep["__pl_v"]), "left_semi")


def op9(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


#: All pairs that share a shingle, and who is reached from whom.
ORACLE = f"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents),
 l AS (SELECT r, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [hash(array_to_string(w, ' '))]
         ELSE list_transform(range(1, len(w) - {WORDS - 2}), lambda i: hash(array_to_string(w[i:i + {WORDS - 1}], ' '))) END) AS l FROM w),
 s AS (SELECT r, len(l) AS n, unnest(l) AS h FROM l),
 p AS (SELECT a.r AS a, b.r AS b, count(*) AS same, a.n + b.n AS total FROM s a JOIN s b ON a.h = b.h AND a.r <> b.r GROUP BY a.r, b.r, a.n, b.n),
 k AS (SELECT a, b FROM p WHERE 100 * same >= {PERCENT} * (total - same)),
 c AS (SELECT r AS a, r AS b FROM l UNION SELECT c.a, k.b FROM c JOIN k ON c.b = k.a)
SELECT any_value(x.doc_id) AS doc_id, any_value(len(x.l))::INT AS n_shingles, coalesce(min(y.doc_id), any_value(x.doc_id)) AS component_id FROM l x JOIN c ON c.a = x.r JOIN l y ON y.r = c.b GROUP BY x.r
"""
