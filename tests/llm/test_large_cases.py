"""Cases that are large in one dimension: many shards, long documents, tiny sources, many languages."""

import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.llm import decontaminate, langid, line_dedup, mixing, warc


def test_shard_bounds_of_very_many_heavy_ranges(spark):
    # 20,000 clusters of page_ids, each over the limit, so that more ranges are heavy than one pass looks at
    rows = spark.range(60_000).select((F.col("id") % 20_000 * 1_000_003 + F.floor(F.col("id") / 20_000)).alias("page_id"), F.lit(400).cast("long").alias("bytes"))
    began = time.time()
    ends = warc.shard_bounds(rows, 1_000)
    assert time.time() - began < 60
    ids = np.array(sorted(r.page_id for r in rows.collect()))
    filled = np.bincount(np.searchsorted(ends, ids)) * 400
    assert filled.max() <= 1_000 and len(filled) >= 60_000 * 400 / 1_000


def test_shard_bounds_over_all_of_a_long(spark):
    rows = [(-(1 << 63) + i, 10) for i in range(5)] + [((1 << 63) - 1 - i, 10) for i in range(5)] + [(0, 10)]
    ends = warc.shard_bounds(spark.createDataFrame(rows, "page_id long, bytes long"), 25, ranges=32)
    ids = np.array(sorted(i for i, _ in rows), dtype=object)
    assert max(sum(10 for i in ids if sum(e < i for e in ends) == s) for s in range(len(ends) + 1)) <= 25


def test_warc_of_very_many_heavy_pages(spark, tmp_path):
    # 3,000 page_ids over the limit: the plan has one search, not a branch each
    pages = spark.range(9_000).select(F.floor(F.col("id") / 3).alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("x" * 60), F.col("id").cast("string")).alias("html"))
    plans = []

    class Stop(Exception):
        pass

    def seen(self, n, *cols):
        plans.append((n, self))
        raise Stop

    with pytest.MonkeyPatch.context() as m:
        m.setattr(type(pages), "repartitionById", seen)
        with pytest.raises(Stop):
            warc.write_warc(pages, str(tmp_path / "a"), shard_bytes=100)
    shards, dealt = plans[0]
    got = dealt.groupBy("page_id", "shard").agg(F.sum(F.octet_length("html")).alias("n")).collect()
    assert len({r.page_id for r in got}) == 3000 and max(r.shard for r in got) < shards
    own = {}
    for r in got:
        assert own.setdefault(r.shard, r.page_id) == r.page_id  # a heavy page_id's shards hold nothing else
    assert len(own) > 4500  # each is dealt to two by digest
    pages = pages.filter("page_id < 40")
    warc.write_warc(pages, str(tmp_path / "b"), shard_bytes=100)
    back = warc.read_warc(spark, str(tmp_path / "b"))
    assert sorted((r.page_id, bytes(r.payload).decode()) for r in back.collect()) == sorted((r.page_id, r.html) for r in pages.collect())


def test_line_dedup_of_a_very_long_document(spark):
    # 300,000 lines that all repeat, in two copies
    text = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(300_000)), lambda i: F.concat(F.lit("a line with eight words in it number "), i.cast("string"))), "\n").alias("text"))
    docs = text.crossJoin(spark.createDataFrame([(1,), (2,)], "doc_id long"))
    began = time.time()
    got = {r.doc_id: (r.n_lines, r.n_removed, r.size) for r in line_dedup.line_dedup(docs).select("doc_id", "n_lines", "n_removed", F.length("text").alias("size")).collect()}
    assert got[1][:2] == (300_000, 0) and got[2] == (300_000, 300_000, 0)
    assert time.time() - began < 100


def test_line_dedup_of_very_many_runs_in_one_document(spark):
    # every second line of a document is the copy of a long line
    line = " ".join(f"w{i}" for i in range(60))
    n = 4_000
    rows = [(1, "\n".join(f"{line} {i}" for i in range(n))), (2, "\n".join(f"own {i}\n{line} {i}" for i in range(n)) + "\nend")]
    began = time.time()
    got = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2].text == "\n".join(f"own {i}" for i in range(n)) + "\nend" and got[2].n_removed == n and got[1].n_removed == 0
    assert time.time() - began < 60


def test_mixing_a_two_byte_source_with_a_terabyte(spark):
    docs = spark.createDataFrame([(1, "ab", "tiny"), (2, "x" * 1000, "large")], "doc_id long, text string, source string")
    table = {r.src: r for r in mixing.rates(docs, total_bytes=10**12).collect()}
    assert table["tiny"].parts > 1 << 32 and table["tiny"].rate == 10**12 / 4
    # the whole mix is planned; a terabyte of copies is not made here
    out = mixing.mix(docs, total_bytes=10**12)
    assert dict(out.dtypes)["copy"] == dict(out.dtypes)["n_copies"] == "bigint"


def test_mixing_draws_parts_in_blocks(spark, monkeypatch):
    """However parts are dealt out, the draws are the same and copies are numbered without gaps."""
    rows = [(i, "t", "rare") for i in range(3)] + [(None, "t", "rare"), (2, "t", "rare"), (50, "u", None), *((100 + i, "t" * 700, "big") for i in range(20))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(map(tuple, mixing.mix(docs).select("doc_id", F.coalesce("source", F.lit("")), "n_copies", "copy", "shuffle_key").collect()), key=str)
    monkeypatch.setattr(mixing, "BLOCK_PARTS", 3)
    monkeypatch.setattr(mixing, "BLOCK_COPIES", 7)
    got = sorted(map(tuple, mixing.mix(docs).select("doc_id", F.coalesce("source", F.lit("")), "n_copies", "copy", "shuffle_key").collect()), key=str)
    assert got == want and len(want) > 5000
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    got = sorted(map(tuple, mixing.mix(docs).select("doc_id", F.coalesce("source", F.lit("")), "n_copies", "copy", "shuffle_key").collect()), key=str)
    assert got == want


def test_a_text_of_one_shared_phrase_is_searched_in_little_memory():
    """Items that all share a phrase, and a text that repeats it: neither postings nor candidates are held for every place."""
    import tracemalloc

    phrase = "one two three four five"
    items = [(i, f"{phrase} item number {i} {' '.join(f'w{i}x{j}' for j in range(8))}") for i in range(3000)]
    index = decontaminate.Index([*items, (9999, " ".join([phrase] * 6))])
    words = [decontaminate.prepare(" ".join([phrase] * 4000))]
    own, off = decontaminate._text.shingles(*decontaminate._text.word_hashes(words, decontaminate._text.ALNUM), 5)
    hit = index.hits(own)
    tracemalloc.start()
    found = index.search(own, hit)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(i, s) for i, _, s, _ in found] == [(9999, 0)] and found[0][1] == 1.0
    assert peak < 60e6


def brute_language(text, samples, most, alphabet=langid.ALPHABET):
    """The decision from the samples, by longest substrings and nothing else."""
    model = langid.Model(samples, most)  # for the spelling of letters only
    s = model.symbols(langid.code_points(text))
    costs = {}
    for lang in sorted(samples):
        texts = [langid.code_points(t) for t in samples[lang]]
        share = max(1, most // max(1, len(texts) // 2))
        flat = [0]
        for p in texts:
            flat += [*langid.spread(model.symbols(p), share).tolist(), 0]
        flat = flat[:most]
        sample, n = "".join(map(chr, flat)), 0
        for at in range(0, len(s), langid.BLOCK):
            block, i = "".join(map(chr, s[at : at + langid.BLOCK].tolist())), 0
            while i < len(block):
                k = 1
                while i + k < len(block) and block[i : i + k + 1] in sample:
                    k += 1
                i, n = i + k, n + 1
        costs[lang] = n * np.log2(max(2, len(flat))) / max(1, len(s))
    return min(costs, key=lambda k: (costs[k], k)), 1 / sum(2 ** (-langid.SHARPNESS * (c - min(costs.values()))) for c in costs.values())


def language_rows(languages, each, words=12, seed=7):
    r = random.Random(seed)
    speech = {k: ["".join(r.choice("aeiounrstlmk") for _ in range(r.randrange(2, 7))) for _ in range(60)] for k in languages}
    return [(i * len(languages) + j, " ".join(r.choice(speech[k]) for _ in range(r.randrange(1, words))), k) for i in range(each) for j, k in enumerate(languages)]


def test_language_decisions_equal_longest_substrings(spark):
    rows = language_rows(["da", "is", "no", "sv"], 25)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, most=2_000)
    samples = {}
    for i, t, k in rows:
        if zlib.crc32(str(i).encode()) % 3 != 1:
            samples.setdefault(k, []).append((i, t))
    samples = {k: [t for _, t in sorted(v)] for k, v in samples.items()}
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, model).collect()}
    for i, t, _ in rows[:60]:
        lang, score = brute_language(t, samples, 2_000)
        assert got[i][0] == lang and got[i][1] == pytest.approx(score)


def test_every_language_is_learned_and_groups_do_not_change_a_decision(spark):
    languages = [f"l{i:03d}" for i in range(230)]
    docs = spark.createDataFrame(language_rows(languages, 6, 40), "doc_id long, text string, lang string").withColumn("cost", F.lit("clash"))
    one, many = langid.train(docs, most=600, total=600 * 230), langid.train(docs, most=600, total=600 * 60)
    assert isinstance(one, langid.Model) and isinstance(many, langid.Models) and one.languages == many.languages == languages
    odd = spark.createDataFrame([(-1, None, None), (-2, "12 !", None), (-2, "12 !", None)], "doc_id long, text string, lang string").withColumn("cost", F.lit("x"))
    rows = docs.unionByName(odd)
    a, b = langid.identify(rows, one), langid.identify(rows, many)
    assert a.columns == b.columns
    left, right = (sorted((r.doc_id, r.lang_pred, round(r.score, 9)) for r in x.collect()) for x in (a, b))
    assert left == right
    asked = [r for r in b.filter("doc_id >= 0").collect()]
    assert sum(r.lang_pred == r.lang for r in asked) > 0.8 * len(asked)
