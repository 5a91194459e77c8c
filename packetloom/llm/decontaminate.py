"""Benchmark decontamination by SimHash windows and exact verification.

Words are runs of ASCII letters and digits and of non-ASCII characters, lower-cased; shingles
are five words. Each benchmark item has a 64-bit SimHash of its weighted shingles (weight: how
often it has them). Against it stand all windows of a document that have the item's size.
Fingerprints within ``RADIUS`` bits are found through a multi-index: of the ``BLOCKS`` equal
blocks of bits, one must differ in at most RADIUS // BLOCKS bits, so probing each block's
neighbours of that radius misses none. A candidate is then verified exactly: the weighted
Jaccard similarity (sum of smaller over sum of larger weights) must reach the threshold.

A window that reaches the threshold with an item has most of its shingles in the benchmark, so
windows are fingerprinted only where enough consecutive shingles are benchmark shingles; this
loses nothing that the verification would accept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import _text
from ._store import small_batches

WORDS = 5
SIMILARITY = 0.8
#: The widest that blocks of 8 bits, each probed to a distance of 2, hold for certain.
RADIUS = 23
BLOCKS = 8
#: Items that are held in memory and broadcast at once (about 10 kB each); more are searched block by block.
BLOCK_ITEMS = 20_000
#: Bytes of such a block's texts, but for a single longer item.
BLOCK_BYTES = 64 << 20
#: Windows of one text and size that are remembered, so that a text that goes on repeating itself is verified once.
SEEN = 100_000


def prepare(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "replace")


def simhash(bits: np.ndarray, weights: np.ndarray) -> int:
    """Weighted majority of each of 64 bits, over rows of 64 values of -1 and 1."""
    return int(np.packbits(weights @ bits > 0, bitorder="little").view(np.uint64)[0])


def spread(h: np.ndarray) -> np.ndarray:
    """The bits of 64-bit hashes as rows of -1 and 1."""
    return np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1


class Index:
    """Benchmark items: shingles with weights, fingerprints, and the multi-index by window size."""

    def __init__(self, items: list[tuple[int, str | None]], words: int = WORDS, similarity: float = SIMILARITY, radius: int = RADIUS):
        self.words, self.similarity, self.radius = words, similarity, radius
        sh, off = _text.shingles(*_text.word_hashes([prepare(t) for _, t in items], _text.ALNUM), words)
        self.ids, self.sizes, self.weights, prints = [], [], [], []
        pairs = []
        for i, (item, _) in enumerate(items):
            own = sh[off[i] : off[i + 1]]
            if len(own):
                u, c = np.unique(own, return_counts=True)
                pairs.append((u, np.full(len(u), len(self.ids))))
                self.ids.append(item)
                self.sizes.append(len(own))
                self.weights.append(dict(zip(u.tolist(), c.tolist(), strict=True)))
                prints.append(simhash(spread(u), c))
        self.prints = np.array(prints, np.uint64)
        self.sizes = np.array(self.sizes, np.int64)
        every = np.concatenate([np.empty(0, np.uint64), *(u for u, _ in pairs)])
        owner = np.concatenate([np.empty(0, np.int64), *(o for _, o in pairs)])
        order = np.argsort(every, kind="stable")
        self.shingles, self.owner = every[order], owner[order]
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.shingles >> np.uint64(44)).astype(np.int64)] = True
        width = 64 // BLOCKS
        self.near = np.array([sum(1 << b for b in c) for r in range(radius // BLOCKS + 1) for c in combinations(range(width), r)], np.int64)
        self.buckets: dict[tuple[int, int, int], list[int]] = {}
        for i, p in enumerate(prints):
            for b in range(BLOCKS):
                self.buckets.setdefault((int(self.sizes[i]), b, p >> (b * width) & ((1 << width) - 1)), []).append(i)

    def within(self, size: int, prints: np.ndarray) -> list[np.ndarray]:
        """For each fingerprint, the items of that window size within the radius."""
        return list(self._within(size, prints))

    def _within(self, size: int, prints: np.ndarray) -> Iterator[np.ndarray]:
        width = 64 // BLOCKS
        for p in prints.tolist():
            found: set[int] = set()
            for b in range(BLOCKS):
                own = p >> (b * width) & ((1 << width) - 1)
                for n in (self.near ^ own).tolist():
                    found.update(self.buckets.get((size, b, n), ()))
            c = np.array(sorted(found), np.int64)
            yield c[np.bitwise_count(self.prints[c] ^ np.uint64(p)) <= self.radius]

    def sizes_of(self, shingles: np.ndarray) -> list[int]:
        """The sizes of all items that have one of these shingles. A mark an item, whatever the postings' total length."""
        marked = np.zeros(len(self.sizes), bool)
        for a, b in zip(np.searchsorted(self.shingles, shingles, "left").tolist(), np.searchsorted(self.shingles, shingles, "right").tolist(), strict=True):
            marked[self.owner[a:b]] = True
        return np.unique(self.sizes[marked]).tolist()

    def hits(self, sh: np.ndarray) -> np.ndarray:
        """Whether each shingle is one of the benchmark's."""
        out = self.sieve[(sh >> np.uint64(44)).astype(np.int64)] if len(sh) else np.zeros(0, bool)
        at = np.flatnonzero(out)
        place = np.searchsorted(self.shingles, sh[at])
        out[at] = self.shingles[np.minimum(place, len(self.shingles) - 1)] == sh[at] if len(self.shingles) else False
        return out

    def search(self, own: np.ndarray, hit: np.ndarray) -> list[tuple[int, float, int, int]]:
        """(item, similarity, first shingle, shingles) of the best window for each item found in one text."""
        run = np.concatenate([[0], np.cumsum(hit)])
        best: dict[int, tuple[int, float, int, int]] = {}
        for size in self.sizes_of(np.unique(own[hit])):
            seen: set[bytes] = set()  # windows of the same shingles, found before: of equal values the first counts
            length = min(size, len(own))
            start = np.arange(len(own) - length + 1)
            # the shared weight must reach similarity * (larger side), which is at least the item's size
            start = start[run[start + length] - run[start] >= np.ceil(self.similarity * size - 1e-9)]
            if not len(start):
                continue
            for s, found in self._candidates(own, start, length, size):
                if not len(found):
                    continue
                u, c = np.unique(own[s : s + length], return_counts=True)
                name = hashlib.sha256(u.tobytes() + c.tobytes()).digest()
                if name in seen:
                    continue
                if len(seen) < SEEN:
                    seen.add(name)
                u, c = u.tolist(), c.tolist()
                for i in found.tolist():
                    w = self.weights[i]
                    same = sum(min(n, w.get(x, 0)) for x, n in zip(u, c, strict=True))
                    value = same / (length + size - same)
                    if value >= self.similarity and (i not in best or value > best[i][1]):
                        best[i] = (self.ids[i], value, s, length)
        return [best[i] for i in sorted(best)]

    def _candidates(self, own: np.ndarray, start: np.ndarray, length: int, size: int) -> Iterator[tuple[int, np.ndarray]]:
        """Each window's start with the items near its fingerprint; weights add up, so sums of bits over a window come from running sums."""
        first = 0
        while first < len(start):
            # few starts that lie near each other at a time, which bounds the running sums
            part = start[first : min(first + 4096, int(np.searchsorted(start, start[first] + 16384)))]
            first += len(part)
            a, b = int(part[0]), int(part[-1]) + length
            run = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(spread(own[a:b]), axis=0, dtype=np.int32)])
            sums = run[part - a + length] - run[part - a]
            prints = np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64).reshape(-1)
            yield from zip(part.tolist(), self._within(size, prints), strict=True)


FOUND = "similarity double, start_word long, n_words long"


def _indexes(benchmark: DataFrame, words: int, similarity: float, radius: int, block_items: int, block_bytes: int):
    """Broadcast indexes of the benchmark's blocks; each is gathered only when it is asked for."""
    bench = benchmark.select("item_id", "text").distinct()
    n, size = bench.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    blocks = max(1, -(-n // block_items), -(-(size or 0) // block_bytes))
    for block in range(blocks):
        part = bench if blocks == 1 else bench.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        got = part.orderBy("item_id", "text").select("item_id", F.col("text").cast("binary")).collect()
        items = [(r[0], None if r[1] is None else bytes(r[1]).decode("utf-8", "replace")) for r in got]
        yield benchmark.sparkSession.sparkContext.broadcast(Index(items, words, similarity, radius))


def contamination(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, radius: int = RADIUS, block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words): each item that a document contains, at its best window.

    Of equally similar windows the first counts. Items and documents without words match nothing;
    an item of fewer than five words is one shingle, and so matches only a document that is the
    same few words. Items with one text are all reported. Repeated rows of ``docs`` give repeated
    rows. Both ids keep their types. Bytes that are no UTF-8 count as replacement characters. The
    benchmark is searched in blocks of ``block_items`` items and ``block_bytes`` bytes at most, each
    against all documents.
    """
    small_batches(docs.sparkSession)
    own = docs.select("doc_id", "text")
    schema = T.StructType([docs.schema["doc_id"], benchmark.schema["item_id"], *T._parse_datatype_string(FOUND).fields])
    out = None
    for index in _indexes(benchmark, words, similarity, radius, block_items, block_bytes):
        found = own.mapInArrow(_report(index, words, to_arrow_schema(schema)), schema)
        out = found if out is None else out.unionByName(found)
    return out


def _matches(text: pa.Array, index: Index, words: int):
    """(row, item, similarity, first word, words) of what each text of a column contains."""
    sizes = pc.fill_null(pc.binary_length(text.cast(pa.binary())), 0).to_pylist()
    for a, b in _text.groups_of(sizes, _text.SLAB):
        h, at = _text.word_hashes([prepare(t) for t in _text.strings(text.slice(a, b - a))], _text.ALNUM)
        sh, off = _text.shingles(h, at, words)
        hit = index.hits(sh)
        count = np.concatenate([[0], np.cumsum(hit)])[off]
        for i in np.flatnonzero(np.diff(count)).tolist():
            for item, value, s, n in index.search(sh[off[i] : off[i + 1]], hit[off[i] : off[i + 1]]):
                yield a + i, item, value, s, min(n + words - 1, int(at[i + 1] - at[i]))


def _report(index, words: int, schema: pa.Schema):
    def run(batches):
        for batch in batches:
            found = list(zip(*_matches(batch.column("text"), index.value, words), strict=True)) or [[]] * 5
            ids = batch.column("doc_id").take(pa.array(found[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, f.type) for c, f in zip(found[1:], list(schema)[1:], strict=True))], schema.names)

    return run


def _clean(index, words: int):
    def run(batches):
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[i for i, *_ in _matches(batch.column("text"), index.value, words)]] = False
            yield batch.filter(pa.array(keep))

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, radius: int = RADIUS, block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` whose texts contain no benchmark item, by the same search; each row is judged by its own text.

    Rows go where they are read: no text is shuffled.
    """
    small_batches(docs.sparkSession)
    for index in _indexes(benchmark, words, similarity, radius, block_items, block_bytes):
        docs = docs.mapInArrow(_clean(index, words), docs.schema)
    return docs


def op2(spark, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, bench)


#: Exact search: every window of an item's size, in every document that shares a shingle with the item.
ORACLE = f"""
WITH w AS (SELECT 0 AS item, doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents
           UNION ALL SELECT 1, item_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') FROM benchmark),
 l AS (SELECT item, id, len(w) AS words, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [hash(array_to_string(w, ' '))]
         ELSE list_transform(range(1, len(w) - {WORDS - 2}), lambda i: hash(array_to_string(w[i:i + {WORDS - 1}], ' '))) END AS l FROM w),
 s AS (SELECT item, id, words, len(l) AS n, unnest(l) AS h, generate_subscripts(l, 1) - 1 AS pos FROM l),
 b AS (SELECT id, n, h, count(*) AS weight FROM s WHERE item = 1 GROUP BY ALL),
 hit AS (SELECT s.id AS doc_id, b.id AS item_id, s.words, b.n AS size, least(b.n, s.n) AS wide, s.n, s.pos, s.h, b.weight FROM s JOIN b USING (h) WHERE s.item = 0),
 near AS (SELECT doc_id, item_id, min(pos) AS a, max(pos) AS z, any_value(wide) AS wide, any_value(n) AS n FROM hit GROUP BY ALL HAVING count(*) >= {SIMILARITY} * any_value(size)),
 start AS (SELECT doc_id, item_id, unnest(range(greatest(0, a - wide + 1), least(n - wide, z) + 1)) AS start FROM near),
 one AS (SELECT doc_id, item_id, start, size, wide, words, h, least(count(*), any_value(weight)) AS same FROM start JOIN hit USING (doc_id, item_id) WHERE pos BETWEEN start AND start + wide - 1 GROUP BY ALL),
 v AS (SELECT doc_id, item_id, start, words, wide, sum(same)::DOUBLE / (wide + size - sum(same)) AS similarity FROM one GROUP BY doc_id, item_id, start, words, wide, size HAVING sum(same)::DOUBLE / (wide + size - sum(same)) >= {SIMILARITY})
SELECT doc_id, item_id, max(similarity) AS similarity, arg_max(start, (similarity, -start))::BIGINT AS start_word, arg_max(least(wide + {WORDS - 1}, words), (similarity, -start))::BIGINT AS n_words FROM v GROUP BY ALL
"""
