"""N-gram Jaccard join, decontamination and license scans against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.llm import _text, components, decontaminate, jaccard_join, license_scan
from packetloom.llm._store import Workspace

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(text, k=4):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset() if not w else frozenset([tuple(w)]) if len(w) < k else frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute_components(rows, percent, k=4):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    sets = {i: sets_of(t, k) for i, (_, t) in enumerate(rows)}
    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j]:
                same = len(sets[i] & sets[j])
                if 100 * same >= percent * (len(sets[i]) + len(sets[j]) - same):
                    root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return [(d, len(sets[i]), low[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)]


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
    return words


def corpus(seed):
    """Copies, chains of near copies of many lengths, shared passages, and short or odd texts."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, passage = [], [r.choice(vocabulary) for _ in range(40)]
    for size in (5, 8, 12, 20, 33, 60, 90, 150, 260, 400):
        for _ in range(3):
            words = [r.choice(vocabulary) for _ in range(size)]
            for step in range(6):
                rows.append(" ".join(words))
                words = edited(r, words, max(0, int(size * r.choice([0, 0.004, 0.01, 0.02, 0.04]))))
                if step == 3:
                    words = words + passage
    rows += ["", "  \t ", "one", "One", "one two", "one two three", "ONE TWO three", "a\x0bb\x0cc d e", "é É ß straße x", "x " * 50]
    out = [(i * 3 % 1009, t) for i, t in enumerate(rows)]
    return [*out, (2000, None), out[4], out[4]]


@pytest.mark.parametrize(("percent", "seed"), [(85, 1), (85, 2), (70, 3)])
def test_join_equals_brute_force(spark, percent, seed):
    rows = corpus(seed)
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash")).withColumn("n", F.lit(0)).repartition(3)
    got = sorted(tuple(r) for r in jaccard_join.jaccard_components(frame, percent=percent).collect())
    want = brute_components(rows, percent)
    assert got == sorted(want)
    assert 20 < sum(c != d for d, _, c in want) < len(want) - 20


def test_join_of_one_large_group(spark):
    r = random.Random(9)
    base = [f"w{r.randrange(500)}" for _ in range(200)]
    rows = [(i, " ".join(edited(r, base, r.randrange(6)))) for i in range(150)]
    got = sorted(tuple(x) for x in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(brute_components(rows, 85))


def test_heavy_signatures_give_the_same_groups(spark, monkeypatch):
    r = random.Random(9)
    base = [f"w{r.randrange(500)}" for _ in range(150)]
    rows = [(i, " ".join(edited(r, base, r.randrange(9)))) for i in range(70)] + [(100 + i, t) for i, (_, t) in enumerate(corpus(5)[:60])]
    monkeypatch.setattr(jaccard_join, "HEAVY_ROWS", 4)
    monkeypatch.setattr(jaccard_join, "SAMPLE", 1)
    got = sorted(tuple(x) for x in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(brute_components(rows, 85))


def test_join_takes_another_seed_when_two_sets_share_a_name(spark, monkeypatch):
    real = jaccard_join._fingerprints

    def clash(elements, off, seed):
        lo, hi = real(elements, off, seed)
        return (lo if seed else lo % np.uint64(3)), hi

    monkeypatch.setattr(jaccard_join, "_fingerprints", clash)
    rows = [(i, f"only words of {i} text number {i}") for i in range(9)] + [(20, "only words of 3 text number 3")]
    join = jaccard_join.JaccardJoin(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r.component_id for r in join.run().collect()}
    assert got == {i: 3 if i == 20 else i for i, _ in rows}


def test_links_and_classes_equal_brute_force(spark):
    rows = [(i, t) for i, (_, t) in enumerate(corpus(4))]
    links, members = jaccard_join.jaccard_links(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    named = {r.set: r.doc_id for r in members.collect() if r.set is not None}
    assert {r.doc_id for r in members.filter("set IS NULL").collect()} == {i for i, t in rows if not sets_of(t)}
    got = {tuple(sorted((named[r.a], named[r.b]))): r.similarity for r in links.collect()}
    one = {sets_of(t): named_id for named_id in named.values() for i, t in rows if i == named_id}
    want = {}
    for a, i in one.items():
        for b, j in one.items():
            if i < j and 100 * len(a & b) >= 85 * len(a | b):
                want[i, j] = len(a & b) / len(a | b)
    assert len(want) > 20 and got.keys() == want.keys() and all(abs(got[k] - v) < 1e-12 for k, v in want.items())


def test_keep_one_decides_by_row(spark):
    near = " ".join(f"w{i}" for i in range(80))
    rows = [(1, near), (2, near), (2, "other words stand under this same identity"), (None, near + " x"), (None, "own words of nobody in particular here"), (3, None), (4, ""), (1, near), (5, near + " y")]
    for t in ("string", "long"):
        got = jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(t)))
        assert sorted((int(r.doc_id or 0), r.text or "") for r in got.collect()) == sorted((d or 0, t or "") for d, t in [rows[0], rows[7], rows[2], rows[4], rows[5], rows[6]])


def test_blocks_of_a_group_meet_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    rows = corpus(6)
    got = sorted(tuple(r) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(brute_components(rows, 85))


def test_join_of_empty_table_and_null_ids(spark):
    assert jaccard_join.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(None, "a b c d e"), (4, "a b c d e"), (None, None)]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(None, 2, 4), (4, 2, 4), (None, 0, None)}


def test_signatures_are_shared_by_all_linked_sets():
    r = np.random.default_rng(0)
    schemes = [jaccard_join.Scheme(i, a, b) for i, (a, b) in enumerate(jaccard_join.band_bounds(3000))]
    for size in (7, 11, 13, 30, 64, 65, 70, 200, 900):
        for _ in range(60):
            a = r.integers(0, 2**63, size, dtype=np.uint64)
            most = int(size * 2 * 15 / 185)
            cut, add = (0, 0) if not most else (lambda c: (c, int(r.integers(0, most - c + 1))))(int(r.integers(0, most + 1)))
            b = np.concatenate([a[cut:], r.integers(0, 2**63, add, dtype=np.uint64)])
            union = len(a) + add
            if 100 * (len(a) - cut) < 85 * union or not (cut or add):
                continue
            shared = set()
            tag = [next(s.tag for s in schemes if s.high >= len(x)) for x in (a, b)]
            for t in {max(0, min(tag) - 1), *tag}:
                s = schemes[t]
                if s.distance:
                    got = [set(s.signatures(x, np.array([0, len(x)]))[0].tolist()) for x in (a, b)]
                    spare = [int(s.signatures(x, np.array([0, len(x)]))[2][0]) for x in (a, b)]
                    assert all(0 <= k <= s.spare for k in spare)
                    shared |= got[0] & got[1]
            assert shared, (size, cut, add)


def test_sketches_bound_the_difference():
    r = np.random.default_rng(1)
    a = r.integers(0, 2**63, 500, dtype=np.uint64)
    b = np.concatenate([a[30:], r.integers(0, 2**63, 20, dtype=np.uint64)])
    s = jaccard_join.sketches(np.concatenate([a, b]), np.array([0, 500, 990]))
    assert 0 < int(np.bitwise_count(s[0] ^ s[1]).sum()) <= 50


def test_word_hashes_do_not_depend_on_slabs(monkeypatch):
    texts = [b"Alpha beta\tGAMMA", b"", None, b"beta " * 3000 + b"x" * 9000, b" lead and trail ", "ünï côdé".encode()]
    h, off = _text.word_hashes(texts)
    monkeypatch.setattr(_text, "SLAB", 4096)
    h2, off2 = _text.word_hashes(texts)
    assert (h == h2).all() and (off == off2).all()
    assert off.tolist() == [0, 3, 3, 3, 3004, 3007, 3009] and h[1] == h[3]


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 5001 + i) for i in range(200)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = components.components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "test"))
    assert {x.node: x.root for x in got.collect()} == {x: find(x) for x in root}
    assert components.components(spark.createDataFrame([], "a long, b long"), Workspace(spark, "test")).count() == 0


TOKEN = re.compile(r"[a-z0-9\x80-\U0010ffff]+")


def bag(words, k=5):
    return [tuple(words)] if 0 < len(words) < k else [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]


def brute_contamination(docs, items, least=0.8):
    out = {}
    for d, t in docs:
        own = bag(TOKEN.findall((t or "").lower()))
        for i, b in items:
            want = bag(TOKEN.findall((b or "").lower()))
            if not own or not want:
                continue
            n, c = min(len(want), len(own)), Counter(want)
            for s in range(len(own) - n + 1):
                same = sum((Counter(own[s : s + n]) & c).values())
                v = same / (n + len(want) - same)
                if v >= least and v > out.get((d, i), (0,))[0]:
                    out[d, i] = (v, s)
    return out


def test_decontamination_equals_brute_force(spark):
    r = random.Random(5)
    vocabulary = [f"t{i}" for i in range(80)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([3, 6, 20, 45, 70])))) for i in range(14)] + [(90, None), (91, ""), (92, "Odd, one. Two!")]
    docs = []
    for d in range(120):
        words = [r.choice(vocabulary) for _ in range(r.choice([0, 4, 60, 300]))]
        if d % 2:
            item = edited(r, r.choice(items[:14])[1].split(), r.choice([0, 0, 1, 2, 4]))
            at = r.randrange(len(words) + 1)
            words[at:at] = [w.upper() + "," for w in item]
        docs.append((d, " ".join(words)))
    docs += [(500, None), (501, ""), (502, "odd one two"), (1, docs[1][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_contamination(dict(docs).items(), items)
    got = {}
    for x in decontaminate.contamination(frame, bench).collect():
        got[x.doc_id, x.item_id] = (x.similarity, x.start_word)
    assert got == want and len(want) > 10
    blocks = decontaminate.contamination(frame, bench, block_items=4).select("doc_id", "item_id").distinct().count()
    assert blocks == len(want)
    left = decontaminate.decontaminate(frame, bench, block_items=5)
    assert "Exchange" not in left._jdf.queryExecution().executedPlan().toString().replace("Exchange RoundRobin", "")
    assert {x.doc_id for x in left.collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert left.columns == frame.columns


def test_decontamination_without_items_or_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert decontaminate.contamination(docs, none).count() == 0
    assert decontaminate.contamination(docs.limit(0), docs.select(F.col("doc_id").alias("item_id"), "text")).count() == 0


def test_multi_index_finds_all_within_the_radius():
    r = np.random.default_rng(2)
    index = decontaminate.Index([(i, " ".join(f"x{i}y{j}" for j in range(20))) for i in range(200)])
    for p in index.prints[:50]:
        for flips in (0, 5, 12, 20):
            q = int(p)
            for b in r.choice(64, flips, replace=False).tolist():
                q ^= 1 << b
            want = np.flatnonzero(np.bitwise_count(index.prints ^ np.uint64(q)) <= index.radius)
            assert index.within(16, np.array([q], np.uint64))[0].tolist() == want.tolist()


def brute_licenses(text, templates):
    own = bag(TOKEN.findall((text or "").lower()))
    out = {}
    for k, t in templates.items():
        want = set(bag(TOKEN.findall(t.lower())))
        for s in range(max(0, len(own) - len(want)) + 1):
            v = len(want & set(own[s : s + len(want)])) / len(want)
            if own and v >= 0.8:
                out[k] = max(v, out.get(k, 0))
    return out


def test_license_scan_finds_templates(spark):
    r = random.Random(6)
    rows = []
    for i, (k, t) in enumerate(sorted(license_scan.TEMPLATES.items()) * 4):
        words = [f"f{r.randrange(900)}" for _ in range(r.choice([0, 3, 50, 700]))]
        at = r.randrange(len(words) + 1)
        own = t.split()
        if i % 3 == 2 and len(own) > 60:
            own[len(own) // 2] = "changed"
        words[at:at] = own
        rows.append((i, " ".join(words), k))
    rows += [(900, None, None), (901, "", None), (902, "nothing here at all to see", None), (903, "License. Version 2.0. The MIT License", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = {}
    for x in license_scan.license_scan(frame).collect():
        got.setdefault(x.doc_id, {})[x.license] = x.containment
    for d, t, k in rows:
        want = brute_licenses(t, license_scan.TEMPLATES)
        assert set(want) <= set(got.get(d, {})), d
        assert all(got[d][n] >= v for n, v in want.items())
        assert k is None or k in got[d]
    assert not any(d >= 900 for d in got)
    assert license_scan.license_scan(frame.limit(0)).count() == 0


@pytest.mark.parametrize("percent", [50, 60, 70, 71, 85])
def test_linked_sets_are_one_band_apart_at_most(percent):
    bands = jaccard_join.band_bounds(5000, percent)
    assert all(high * 100 // percent <= after for (_, high), (_, after) in zip(bands, bands[1:], strict=False))
    assert percent < 85 or bands == jaccard_join.band_bounds(5000)


def test_join_links_sets_at_band_edges(spark):
    words = [f"w{i}" for i in range(138)]
    rows = [(1, " ".join(words[:98])), (2, " ".join(words))]  # 95 of 135 shingles
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.component_id for r in jaccard_join.jaccard_components(frame, percent=70).collect()] == [1, 1]
