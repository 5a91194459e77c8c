"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of its labelled text. A
text is parsed greedily into the longest phrases that occur in that sample; a symbol that never
occurs in it is a phrase of its own. With c phrases over n symbols and a sample of N symbols,
c * log2(N) / n estimates the bits a symbol costs in that language; the cheapest language wins.

Symbols are lower-cased letters; a run of anything else is one separator. The samples' most frequent
letters are a symbol each, and each of their other letters is spelt with a few digits, so that the
tables stay narrow whatever the scripts and no two letters of a sample become one. A letter that no
sample has is a phrase of its own in every language. Texts are parsed in
blocks of ``BLOCK`` symbols (a phrase ends where its block does), so that all blocks of a batch
step through the automata together and memory does not depend on a text's length.
"""

from __future__ import annotations

import math
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import _text
from ._store import Workspace, small_batches

#: Labelled rows a language's sample is drawn from, and the symbols it holds at most, however many languages
#: there are. The tables that a task holds are of TOTAL_SYMBOLS symbols at most (about 300 bytes each); more languages
#: are parsed with in groups. All three are parameters of ``train``.
TRAIN_ROWS = 64
TRAIN_SYMBOLS = 40_000
TOTAL_SYMBOLS = 200_000
#: Symbols besides digits, and digits that spell the letters for which there is no symbol.
ALPHABET = 48
DIGITS = 16
#: Places of a long training text that its share of symbols is taken from.
WINDOWS = 4
BLOCK = 1024
SHARPNESS = 4.0
UND = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() if not 0xD800 <= i < 0xE000 else False for i in range(0x110000)), bool, 0x110000)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def symbols(points: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Symbols of code points: 0 for each run of non-letters, 1 for a letter that no sample has."""
    s = table[points]
    return s[(s != 0) | np.concatenate([[True], s[:-1] != 0])] if len(s) else s


def spread(s: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` symbols of a text: windows at equal distances from its start to its end."""
    k = min(WINDOWS, most // 2)
    if len(s) <= most or k < 2:
        return s[:most]
    wide = most // k - 1
    starts = [i * (len(s) - wide) // (k - 1) for i in range(k)]
    return np.concatenate([x for a in starts for x in (s[a : a + wide], s[:0] if a == starts[-1] else np.zeros(1, s.dtype))])


def suffix_automaton(text: list[int], size: int) -> np.ndarray:
    """Transitions of the suffix automaton of a symbol list, -1 where there is none; state 0 is the root."""
    # one flat table, as an automaton of n symbols has at most 2n states
    none = array("i", [-1]) * size
    nxt, link, length, last = none[:], array("i", [-1]), array("i", [0]), 0
    for c in text:
        cur = len(link)
        nxt.extend(none)
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and nxt[p * size + c] < 0:
            nxt[p * size + c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p * size + c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                copy = len(link)
                nxt.extend(nxt[q * size : (q + 1) * size])
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p * size + c] == q:
                    nxt[p * size + c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return np.frombuffer(nxt, np.int32).reshape(-1, size)


def parsing_table(trans: np.ndarray) -> np.ndarray:
    """Entry (state, symbol): twice the next state, plus 1 if a new phrase starts with that symbol."""
    root = np.where(trans[0] < 0, 0, trans[0])
    out = np.where(trans < 0, 2 * root + 1, 2 * trans).astype(np.int32)
    out[0] = 2 * root + 1
    return out


def ordered_letters(samples: dict[str, list[str]]) -> np.ndarray:
    """The letters of all samples, the most frequent first."""
    total = np.zeros(0x110000, np.int64)
    for texts in samples.values():
        for t in texts:
            found, count = np.unique(code_points(t), return_counts=True)
            total[found] += count
    found = np.flatnonzero((total > 0) & _letters()).astype(np.uint32)
    return found[np.argsort(-total[found], kind="stable")]


class Model:
    """Languages, their samples' sizes, and one stacked parsing table with each language's root.

    ``order``: the letters of all languages' samples, the most frequent first, where these are only some of them.
    """

    def __init__(self, samples: dict[str, list[str]], most: int = TRAIN_SYMBOLS, alphabet: int = ALPHABET, order: np.ndarray | None = None):
        self.languages = sorted(samples)
        points = {k: [code_points(t) for t in v] for k, v in samples.items()}
        order = ordered_letters(samples) if order is None else order
        best, rare = order[: alphabet - 2], np.sort(order[alphabet - 2 :])  # letters of one script share leading digits
        self.alphabet, self.places = alphabet, 1
        while DIGITS**self.places < len(rare):
            self.places += 1
        self.size = alphabet + (DIGITS if len(rare) else 0)
        self.table = _letters().astype(np.uint32)
        self.table[best] = np.arange(2, 2 + len(best))
        self.table[rare] = self.size + np.arange(len(rare))
        self.steps, self.roots, self.bits, at = np.empty(0, np.int32), [], [], 0
        for k in self.languages:
            share = max(1, most // max(1, len(points[k]) // 2))
            flat = np.concatenate([np.zeros(1, np.uint8), *(np.concatenate([spread(self.symbols(p), share), [0]]) for p in points[k])])[:most]
            t = parsing_table(suffix_automaton(flat.tolist(), self.size))
            t += np.int32(2 * at)
            self.steps.resize(self.steps.size + t.size, refcheck=False)
            self.steps[-t.size :] = t.reshape(-1)
            self.roots.append(at)
            self.bits.append(math.log2(max(2, len(flat))))
            at += len(t)
        self.roots, self.bits = np.array(self.roots, np.int64), np.array(self.bits)

    def symbols(self, points: np.ndarray) -> np.ndarray:
        """Symbols of code points, with rare letters spelt."""
        s = symbols(points, self.table)
        spelt = s >= self.size
        if not spelt.any():
            return s.astype(np.uint8)
        width = np.where(spelt, self.places, 1)
        nth = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
        code = np.repeat(s, width)
        digit = (code - self.size) // DIGITS ** (self.places - 1 - nth) % DIGITS + self.alphabet
        return np.where(code >= self.size, digit, code).astype(np.uint8)

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each symbol array (rows) in each language (columns)."""
        flat = np.concatenate([np.empty(0, np.uint8), *texts])
        sizes = np.array([len(t) for t in texts], np.int64)
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = (np.cumsum(sizes) - sizes)[owner] + nth * BLOCK
        length = np.minimum(BLOCK, sizes[owner] - nth * BLOCK)
        order = np.argsort(-length, kind="stable")
        start, length, owner = start[order], length[order], owner[order]
        active = np.searchsorted(-length, -np.arange(1, BLOCK + 1), side="right")
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        for j, root in enumerate(self.roots):
            state = np.full(len(start), root, np.int64)
            count = np.zeros(len(start), np.int32)
            for t in range(int(length[0]) if len(length) else 0):
                m = active[t]
                v = self.steps[state[:m] * self.size + flat[start[:m] + t]]
                count[:m] += v & 1
                state[:m] = v >> 1
            np.add.at(out[:, j], owner, count)
        return out

    def best(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of each text, the place of its cheapest language, that one's cost, and the sum of all languages' shares against it."""
        symbol = []
        for t in texts:
            s = self.symbols(code_points(t or ""))
            symbol.append(s if s.any() else s[:0])
        n = np.array([len(s) for s in symbol])
        cost = self.phrases(symbol) * self.bits / np.maximum(n, 1)[:, None]
        least = cost.min(axis=1)
        return n, cost.argmin(axis=1), least, np.exp2(-SHARPNESS * (cost - least[:, None])).sum(axis=1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return [UND] * len(texts), [0.0] * len(texts)
        n, best, _, share = self.best(texts)
        return [self.languages[b] if k else UND for b, k in zip(best, n, strict=True)], np.where(n > 0, 1 / share, 0.0).tolist()


class Models:
    """More languages than one task's tables hold: samples, and the models of groups of them, made one after another.

    All groups spell letters alike, so what a language costs does not depend on its group.
    """

    def __init__(self, samples: dict[str, list[str]], most: int, group: int):
        self.samples, self.most, self.group = samples, most, group
        self.languages, self.order = sorted(samples), ordered_letters(samples)

    def groups(self):
        for at in range(0, len(self.languages), self.group):
            yield Model({k: self.samples[k] for k in self.languages[at : at + self.group]}, self.most, order=self.order)


def held_out(doc_id="doc_id"):
    """Whether a document is kept out of training: crc32 of its id as text, modulo 3, is 1."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _windows(text: str, wide):
    """A text of up to WINDOWS * wide characters, or as many of a longer one, from start to end."""
    n, apart = F.length(text), (F.length(text) - wide) / (WINDOWS - 1)
    parts = [F.substring(F.col(text), (1 + F.floor(apart * i)).cast("int"), wide) for i in range(WINDOWS)]
    return F.when(n > WINDOWS * wide, F.concat_ws(" ", *parts)).otherwise(F.col(text))


def train(docs: DataFrame, rows: int = TRAIN_ROWS, most: int = TRAIN_SYMBOLS, total: int = TOTAL_SYMBOLS) -> Model | Models:
    """A model of every value of lang, from at most ``rows`` labelled rows of each that are not held out.

    The rows are those whose ids hash lowest; of several texts under an id and language one counts. A text
    adds at most a share of ``most`` symbols, so that a few long texts do not fill a language's sample; of
    longer ones, windows from start to end. More than ``total`` / ``most`` languages are parsed with in groups of so many;
    a language's sample does not depend on how many others there are. The driver gathers about 8 * ``most`` characters a language.
    """
    from pyspark.sql import Window

    key = F.struct(F.xxhash64(F.col("doc_id"), F.lit(5)), F.col("doc_id"))
    pool = docs.filter(F.col("lang").isNotNull() & ~held_out()).select("doc_id", "lang", key.alias("k"))
    w = Window.partitionBy("lang").orderBy("k")
    ids = pool.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= rows).select("doc_id", "lang").distinct()  # at most so many a language
    ids = ids.select(F.col("doc_id").alias("__pl_id"), F.col("lang").alias("__pl_lang"), F.count(F.lit(1)).over(Window.partitionBy("lang")).alias("__pl_n"))
    take = docs.join(F.broadcast(ids), F.col("doc_id").eqNullSafe(F.col("__pl_id")) & (F.col("lang") == F.col("__pl_lang")))
    wide = F.ceil(F.lit(2 * most) / F.col("__pl_n")).cast("int")
    part = take.select("doc_id", "lang", _windows("text", wide).alias("text")).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    samples: dict[str, list[str]] = {}
    for r in part.orderBy("lang", "doc_id").select("lang", F.col("text").cast("binary").alias("text")).collect():
        if r["text"]:
            samples.setdefault(r["lang"], []).append(bytes(r["text"]).decode("utf-8", "replace"))
    group = max(1, total // most)
    return Model(samples, most) if len(samples) <= group else Models(samples, most, group)


def _by_groups(kept: DataFrame, models: Models) -> DataFrame:
    """``kept`` with lang_pred and score; each group of languages reads the texts in tasks of its own, and the cheapest of all groups wins."""
    spark = kept.sparkSession
    ws = Workspace(spark, "languages")
    kept = ws.save(kept.withColumn("__pl_row", F.monotonically_increasing_id()), "rows")
    found = None
    for k, model in enumerate(models.groups()):
        shared = spark.sparkContext.broadcast(model)

        def run(batches, shared=shared):
            for batch in batches:
                text = _text.strings(batch.column("text"))
                for a, b in _text.groups_of([len(t or "") for t in text], 2 * _text.SLAB):
                    n, best, cost, share = shared.value.best(text[a:b])
                    names = [shared.value.languages[i] if k else UND for i, k in zip(best, n, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column("__pl_row").slice(a, b - a), pa.array(names, pa.string()), pa.array(cost), pa.array(share)], ["__pl_row", "lang_pred", "cost", "share"])

        part = ws.save(kept.select("__pl_row", "text").mapInArrow(run, "__pl_row long, lang_pred string, cost double, share double"), f"group-{k}")
        shared.destroy()
        found = part if found is None else found.unionByName(part)
    each = F.collect_list(F.struct("cost", "lang_pred", "share"))  # one of each group of languages
    found = found.groupBy("__pl_row").agg(F.array_min(each).alias("best"), each.alias("each"))
    total = F.aggregate("each", F.lit(0.0), lambda s, e: s + e["share"] * F.pow(F.lit(2.0), -SHARPNESS * (e["cost"] - F.col("best.cost"))))
    found = found.select("__pl_row", F.col("best.lang_pred").alias("lang_pred"), F.when(F.col("best.lang_pred") == UND, 0.0).otherwise(1 / total).alias("score"))
    return kept.join(found, "__pl_row").drop("__pl_row")


def identify(docs: DataFrame, model: Model | Models) -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1), from the column text alone.

    A null text, or one without letters, is ``und`` with score 0. Ties go to the language whose
    name sorts first. Bytes that are no UTF-8 are no letters. Columns of ``docs`` named lang_pred or score are replaced.
    """
    kept = docs.select([c for c in docs.columns if c not in ("lang_pred", "score")])
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    small_batches(docs.sparkSession)
    if isinstance(model, Models):
        return _by_groups(kept, model)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            text = _text.strings(batch.column("text"))
            for a, b in _text.groups_of([len(t or "") for t in text], 2 * _text.SLAB):
                lang, score = shared.value.predict(text[a:b])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*part.schema.names, "lang_pred", "score"])

    return kept.mapInArrow(run, schema)


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs.select("doc_id", "text"), train(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
