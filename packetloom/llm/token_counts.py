"""Token counts without token ids: pieces are counted once per distinct pre-token.

A tokenizer cuts a text into pre-tokens and splits each of these into pieces on its own, so a
text's count is the sum over its pre-tokens. Three steps: (1) the distinct pre-tokens of the
corpus with their frequencies; (2) the number of pieces of each, once; (3) every text's
pre-token frequencies joined to these numbers, and summed. The numbers of the most frequent
pre-tokens (fewer than HOT) are broadcast, as two sorted arrays by hash, and summed where the text is
read; the other pre-tokens leave as (row, pre-token, frequency) and meet their numbers by shuffle. None of these
has more than one occurrence in HOT of all, so no key is hot. A pre-token whose hash another
one has is never broadcast, so the hashes are exact.

Pre-tokens are the library's own. As a byte-level pattern never looks past a run of white
space, texts of letters whose kind has long been settled are cut by an equal pattern here, and
the library cuts the stretches between white space that hold any other.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from ._store import Workspace, small_batches

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
#: Pre-tokens with more than one in HOT of all occurrences are fewer than that; their numbers are broadcast, 12 bytes each.
HOT = 4_000_000
#: Bytes of a pre-token that is its own key; a longer one has its digest as key where it is shuffled by documents.
WIDE = 64
#: Distinct pre-tokens that a task holds before it hands them on, and pre-tokens of texts that it looks up at once.
ROOM = 100_000
BATCH = 50_000

#: Code points with the Unicode property White_Space (fixed values).
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Code points that were letters, numbers or neither in every version of Unicode that a library may have.
SETTLED = [*range(0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F), 0x20AC]
SLAB = 4 << 20
END = re.compile(f"[^{WHITE}](?=[{WHITE}])")
STRETCH = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]")


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in SETTLED if unicodedata.category(chr(c))[0] == kind)


UNSETTLED = re.compile(f"[^{''.join(f'{chr(a)}-{chr(b)}' for a, b in ((0, 0x24F), (0x2010, 0x2027), (0x2030, 0x205E)))}\u20ac]")
#: The pattern of byte-level pre-tokens (fixed), over settled code points.
_L, _N = _class("L"), _class("N")
PRE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{WHITE}{_L}{_N}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; a path stays as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class PreTokens:
    """Pre-tokens of texts, and their pieces, as the tokenizers library gives them for a vocabulary file. Not to be pickled: made in each task."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        if not path.endswith(".json"):
            raise ValueError("pre-tokens are those of tokenizers' .json files")
        self.tool = Tokenizer.from_file(path)
        added = list(self.tool.get_added_tokens_decoder().values())
        if any(a.single_word or a.lstrip or a.rstrip or a.normalized for a in added):
            raise ValueError("added tokens are matched as plain strings only")
        # the longest first: of two that begin at one place the longer is the token
        self.special = re.compile("|".join(re.escape(a.content) for a in sorted(added, key=lambda a: -len(a.content)))) if added else None
        pre = self.tool.pre_tokenizer
        # texts are cut here only where nothing but the byte-level pattern cuts
        self.plain = self.tool.normalizer is None and isinstance(pre, ByteLevel) and pre.use_regex and not pre.add_prefix_space

    def cut(self, part: str) -> list[str]:
        """The library's pre-tokens: stretches of the text where it is cut as it is, or else what the rules make of it."""
        if self.plain:
            return [part[a:b] for _, (a, b) in self.tool.pre_tokenizer.pre_tokenize_str(part)]
        if self.tool.normalizer is not None:
            part = self.tool.normalizer.normalize_str(part)
        return [p for p, _ in self.tool.pre_tokenizer.pre_tokenize_str(part)] if self.tool.pre_tokenizer else [part] * bool(part)

    def lists(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text, slab by slab."""
        for part in self.special.split(text) if self.special is not None else [text]:
            for slab in _slabs(part) if self.plain else [part]:
                if not self.plain:
                    yield self.cut(slab)
                elif UNSETTLED.search(slab) is None:
                    yield PRE.findall(slab)
                else:
                    yield [p for s in STRETCH.findall(slab) for p in (self.cut(s) if UNSETTLED.search(s) else PRE.findall(s))]

    def added(self, text: str) -> int:
        """How many added tokens are in a text."""
        return len(self.special.findall(text)) if self.special is not None else 0

    def count(self, text: str) -> tuple[Counter, int]:
        """How often each pre-token is in a text, and how many added tokens are."""
        out: Counter = Counter()
        for pre in self.lists(text):
            out.update(pre)
        return out, self.added(text)

    def pieces(self, pre: str) -> int:
        parts = [p for p, _ in self.tool.pre_tokenizer.pre_tokenize_str(pre)] if self.plain else [pre]
        return sum(len(self.tool.model.tokenize(p)) for p in parts)


@lru_cache(1)
def _tool(path: str) -> PreTokens:
    """A worker's tokenizer, made once."""
    return PreTokens(path)


def _key(raw: bytes) -> bytes:
    """A pre-token's bytes; of a long one, a mark and its digest, which is longer than any short one's."""
    return raw if len(raw) <= WIDE else b"#" * (WIDE + 1 - 32) + hashlib.sha256(raw).digest()


def _slabs(part: str) -> Iterator[str]:
    """A text in slices of about SLAB characters, cut where white space begins; no pre-token spans such a place."""
    at = 0
    while len(part) - at > SLAB and (m := END.search(part, at + SLAB)):
        yield part[at : m.end()]
        at = m.end()
    yield part[at:]


def _texts(batch: pa.RecordBatch) -> Iterator[str]:
    """The texts of a batch, one decoded at a time."""
    for raw in batch.column("text").cast(pa.binary()):
        raw = raw.as_py()
        yield raw.decode("utf-8", "replace") if raw else ""


def dictionary(docs: DataFrame, path: str) -> DataFrame:
    """One row per distinct pre-token of the column text: key, hash (64 bits), frequency n, pieces. A null text has none."""
    small_batches(docs.sparkSession)

    def run(batches):
        tool, seen, held = _tool(path), Counter(), 0

        def flush():
            keys, counts = iter(seen), iter(seen.values())
            while part := [p.encode() for p in islice(keys, BATCH)]:
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array(list(islice(counts, BATCH)), pa.int64())], ["pre", "n"])

        for batch in batches:
            for text in _texts(batch):
                for pre in tool.lists(text):
                    seen.update(pre)
                held += len(text)
                if len(seen) > ROOM or (held > 64 << 20 and sum(map(len, seen)) > 16 << 20):
                    yield from flush()
                    seen.clear()
                    held = 0
                    pa.default_memory_pool().release_unused()
        yield from flush()

    def split(batches):
        tool = _tool(path)
        for b in batches:
            raw = b.column("pre").to_pylist()
            pieces = [tool.pieces(p.decode()) for p in raw]
            print64 = np.fromiter(map(xxhash.xxh64_intdigest, raw), np.uint64, len(raw)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([_key(p) for p in raw], pa.binary()), pa.array(print64), b.column("n"), pa.array(pieces, pa.int64())], ["key", "hash", "n", "pieces"])

    seen = docs.select("text").mapInArrow(run, "pre binary, n long").groupBy("pre").agg(F.sum("n").alias("n"))
    return seen.mapInArrow(split, "key binary, hash long, n long, pieces long")


def _numbers(words: DataFrame, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and pieces of the pre-tokens with more than one in ``hot`` of all occurrences, where no other pre-token has the hash."""
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    twice = words.groupBy("hash").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    often = words.filter(F.col("n") * hot > total).join(twice, "hash", "left_anti").select("hash", F.col("pieces").cast("int").alias("pieces")).toArrow()  # fewer than ``hot`` rows
    prints, pieces = (often.column(c).to_numpy() for c in ("hash", "pieces"))
    order = np.argsort(prints.view(np.uint64))
    return prints.view(np.uint64)[order], pieces[order]


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT, hot: int = HOT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Added tokens (begin, end) are not counted, but where their string stands in a text it is one token, as the
    library has it. A null text is the empty one, with no tokens. Bytes that are no UTF-8 are tokenized as replacement
    characters; n_bytes counts them as they are. Repeated rows, and rows with a null doc_id, are counted each by itself.
    """
    path = path or tokenizer_path(TOKENIZER)
    spark = docs.sparkSession
    ws = Workspace(spark, "token-counts")
    words = ws.save(dictionary(docs, path), "dictionary")
    shared = spark.sparkContext.broadcast(_numbers(words, hot))
    names = ["row", "doc_id", "n_bytes", "key", "n"]
    kind = to_arrow_type(docs.schema["doc_id"].dataType)

    def run(batches):
        tool, (prints, pieces) = _tool(path), shared.value
        for batch in batches:
            ids, total = batch.column("row").to_numpy(), np.zeros(batch.num_rows, np.int64)
            pre, freq, owner = [], [], []

            def look(ids=ids, total=total):
                """Sums what is known, and yields the rest."""
                h = np.fromiter(map(xxhash.xxh64_intdigest, pre), np.uint64, len(pre))
                at = np.searchsorted(prints, h)
                at[at == len(prints)] = 0
                known = prints[at] == h if len(prints) else np.zeros(len(h), bool)
                count, row = np.array(freq, np.int64), np.array(owner, np.int64)
                np.add.at(total, row[known], count[known] * pieces[at[known]])
                rest = np.flatnonzero(~known)
                if len(rest):
                    keys = pa.array([_key(pre[i].encode()) for i in rest.tolist()], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(ids[row[rest]]), pa.nulls(len(rest), kind), pa.nulls(len(rest), pa.int64()), keys, pa.array(count[rest])], names)

            for i, text in enumerate(_texts(batch)):
                found, n = tool.count(text)
                total[i] += n
                pre.extend(found)
                freq.extend(found.values())
                owner.extend([i] * len(found))
                if len(pre) >= BATCH:
                    yield from look()
                    pre, freq, owner = [], [], []
            yield from look()
            yield pa.RecordBatch.from_arrays([pa.array(ids), batch.column("doc_id"), batch.column("n_bytes"), pa.nulls(len(ids), pa.binary()), pa.array(total)], names)

    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", docs.schema["doc_id"].dataType), *T._parse_datatype_string("n_bytes long, key binary, n long").fields])
    text = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    found = ws.save(text.mapInArrow(run, schema), "rows")  # written once, so row numbers stay what they are
    base, rare = found.filter(F.col("key").isNull()).drop("key"), found.filter(F.col("key").isNotNull())
    if not rare.isEmpty():
        more = rare.join(words.select("key", "pieces"), "key").groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("more"))
        base = base.join(more, "row", "left").withColumn("n", F.col("n") + F.coalesce("more", F.lit(0)))
    return base.select("doc_id", "n_bytes", F.col("n").alias("n_tokens"), (F.col("n") > limit).alias("over_limit"))


def op12(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
