"""Filter interaction audit, token counts and centroid clustering against plain Python."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from packetloom.llm import centroids, filter_audit, token_counts

PATH = token_counts.tokenizer_path(token_counts.TOKENIZER)


# --- filter interaction audit -------------------------------------------------------------------------------------------------

LONG = " ".join(f"w{i}" for i in range(150))
TEXTS = [
    LONG, LONG + " $", "a " * 150, "AB cd " * 60, LONG.upper(), "", None, "x\x0by\x0cz q", "\t lead and trail \n", "#", LONG, LONG, "a " * 150,
    "ÄÖÜ " * 120, "word " * 99, " ".join(f"z{i}" for i in range(100)), None, "",
]


def plain_audit(rows, labels):
    words = lambda t: [w for w in __import__("re").split("[\x20\x09-\x0d]+", t) if w]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    marked = []
    for i, t, lang in rows:
        t = t or ""
        w = words(t)
        same = [j for j, u, _ in rows if (u or "") == t and j is not None]
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": i is not None and any(j < i for j in same),
        }
        marked.append((i, lang or "", {k for k, v in fails.items() if v}))
    out = {}
    for part in {p for _, p, _ in marked}:
        own = [(i, f) for i, p, f in marked if p == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                fails = [f for _, f in own if x in f]
                out[part, "".join(order), step] = [len(left), len(gone), len(fails) - len(gone), sum(f == {x} for f in fails), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for x in "ABCDE":
            at = [(part, "".join(o), o.index(x) + 1) for o in itertools.permutations("ABCDE")]
            total = sum(out[k][1] for k in at)
            for k in at:
                out[k].append(total)
    return out


COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_equals_walking_through_every_order(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice([None, *range(40)]), r.choice(TEXTS), r.choice(["en", "fr", None, ""])) for _ in range(120)]
    labels = [(r.choice([None, *range(50)]), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("part", F.lit("clash")).withColumn("n", F.lit(9)).withColumn("A", F.lit(True))
    got = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("lang", F.lit("clash")))
    want = plain_audit(rows, labels)
    assert {(x.part, x.filter_order, x.step): [x[c] for c in COUNTS] for x in got.collect()} == want
    assert got.count() == len(want) == 3 * 120 * 5
    assert dict(got.dtypes)["shapley"] == "bigint" and dict(got.dtypes)["step"] == "int"


def test_audit_without_documents_or_labels(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).collect() == []
    got = filter_audit.audit(spark.createDataFrame([(1, "a", "en")], docs.schema), labels).collect()
    assert len(got) == 600 and all(x.good_lost == x.toxic_lost == 0 for x in got)
    assert {(x.kept, x.removed) for x in got if x.filter_order[0] == "A" and x.step == 1} == {(0, 1)}


def test_audit_keeps_hot_copies_apart(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "HOT_SHARE", 3)
    rows = [(i, "same", "en") for i in range(30)] + [(100 + i, f"own {i // 2}", "en") for i in range(20)]
    found = filter_audit.flags(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {x.doc_id for x in found.filter("E").collect()} == {*range(1, 30), *range(101, 120, 2)}


def test_audit_with_other_filters(spark):
    docs = spark.createDataFrame([(1, "aa", "en"), (2, "b", "en"), (3, "aa", "en")], "doc_id long, text string, lang string")
    got = filter_audit.audit(docs, spark.createDataFrame([(3, 1, 1)], "doc_id long, quality int, toxic int"), {"L": lambda text, words: F.length(text) > 1}, copy="Z")
    assert {(x.filter_order, x.step): (x.kept, x.removed, x.redundant, x.good_lost) for x in got.collect()} == {("LZ", 1): (1, 2, 0, 1), ("LZ", 2): (1, 0, 1, 0), ("ZL", 1): (2, 1, 0, 1), ("ZL", 2): (1, 1, 1, 0)}
    with pytest.raises(ValueError):
        filter_audit.audit(docs, docs, {x: filter_audit.symbols for x in "ABCDFGH"})


# --- token counts ---------------------------------------------------------------------------------------------------------------


def library(text):
    from tokenizers import Tokenizer

    tool = library.tool = getattr(library, "tool", None) or Tokenizer.from_file(PATH)
    return len(tool.encode(text, add_special_tokens=False).ids)


BLANKS = [chr(c) for c in range(0x3001) if chr(c).isspace() or c in (0x0B, 0x0C, 0x1C, 0x1F, 0x85, 0x180E, 0x200B, 0x2060)]
MIXED = ["a", "the", "'s", "'ll", "'", " ", "  ", "\n", "\t", "1", "23", "!", "--", "é", "ß", "中", "﻿", "\U0001f600", "́", "<|endoftext|>", "<|endof", *BLANKS]


def counted(tool, text):
    found, added = tool.count(text)
    return added + sum(n * tool.pieces(p) for p, n in found.items())


TOOL = token_counts.PreTokens(PATH)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(MIXED), max_size=30).map("".join))
def test_pieces_of_pretokens_are_the_librarys_tokens(text):
    assert counted(TOOL, text) == library(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_pieces_of_any_text(text):
    assert counted(TOOL, text) == library(text)


def test_pretokens_are_those_of_the_library_around_every_white_space():
    for c in BLANKS:
        for text in (f"a{c}b", f"a{c}{c}b", f"a {c}b", f"a{c} b", f"{c}a", f"a{c}", f"{c}{c}", f"a \n{c} \t b"):
            want = [p for p, _ in TOOL.tool.pre_tokenizer.pre_tokenize_str(text)]
            found = [p for part in TOOL.lists(text) for p in part]
            assert "".join(found) == text
            assert [p for s in found for p, _ in TOOL.tool.pre_tokenizer.pre_tokenize_str(s)] == want, (hex(ord(c)), text)


def test_settled_letters_are_cut_as_the_library_cuts():
    for c in map(chr, token_counts.SETTLED):
        text = f"a{c}b {c}{c} 1{c}2 '{c} ...{c} {c}"
        assert token_counts.UNSETTLED.search(c) is None and token_counts.PRE.findall(text) == TOOL.cut(text), hex(ord(c))
    assert token_counts.UNSETTLED.search(chr(0x250)) and token_counts.UNSETTLED.search("中") and token_counts.UNSETTLED.search(chr(0x200B))


def test_long_texts_are_cut_between_pretokens(monkeypatch):
    r = random.Random(3)
    text = "".join(r.choice(MIXED) for _ in range(3000))
    monkeypatch.setattr(token_counts, "SLAB", 50)
    assert counted(TOOL, text) == library(text)


def test_pretokens_that_share_a_hash_are_not_broadcast(spark, monkeypatch):
    words = spark.createDataFrame([(b"a", 1, 50, 1), (b"b", -2, 40, 2), (b"c", -2, 1, 3), (b"d", 3, 1, 4)], "key binary, hash long, n long, pieces long")
    prints, pieces = token_counts._numbers(words, 10)
    assert prints.tolist() == [1] and pieces.tolist() == [1]


@pytest.mark.parametrize("hot", [100_000, 20, 1])
def test_token_counts_equal_the_librarys(spark, hot):
    r = random.Random(hot)
    rows = [(r.choice([None, 1, 2, i]), "".join(r.choice(MIXED) for _ in range(r.randint(0, 60)))) for i in range(60)]
    rows += [(7, None), (8, ""), (9, "x" * 5000), (9, "x" * 5000), (10, ("y" * 200 + " ") * 50), *[(11, "common " * 300)] * 20]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("clash")).withColumn("key", F.lit(1)).withColumn("n", F.lit(1))
    got = token_counts.token_counts(docs, limit=20, hot=hot).collect()
    want = [(i, len((t or "").encode()), library(t or ""), library(t or "") > 20) for i, t in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_token_counts_of_other_rules(spark):
    """A file with its own normalizer and patterns goes through the library text by text."""
    from tokenizers import Tokenizer

    path = token_counts.tokenizer_path("word_bpe_49k.json")
    tool, texts = Tokenizer.from_file(path), ["The QUICK  brown fox's 12 tails", "", "Été <|endoftext|> fin", "a\nb"]
    got = token_counts.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), path).collect()
    assert {x.doc_id: x.n_tokens for x in got} == {i: len(tool.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_token_counts_edges(spark):
    assert token_counts.token_counts(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    raw = spark.createDataFrame([("a", bytearray(b"ab\xff cd"))], "doc_id string, raw binary").selectExpr("doc_id", "cast(raw as string) as text")
    got = token_counts.token_counts(raw).collect()
    assert [tuple(x) for x in got] == [("a", 6, library("ab� cd"), False)]


# --- centroid clustering ----------------------------------------------------------------------------------------------------------


def plain_clusters(rows, k, rounds, size):
    kept = [(i, [math.floor(64.0 * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]

    def nearest():
        return [min((sum((a - b) ** 2 for a, b in zip(v, w)), j) for j, w in enumerate(c)) for _, v in kept]

    for _ in range(rounds):
        at = nearest()
        for j in range(len(c)):
            own = [v for (_, v), (_, a) in zip(kept, at) if a == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own)]
    at = nearest()
    names = [hashlib.sha256(",".join(map(str, w)).encode()).hexdigest() for w in c]
    return sorted(repr((i, j, d, sum(e for e, b in at if b == j), sum(e for e, _ in at), names[j])) for (i, _), (d, j) in zip(kept, at))


def vectors(r, n, size, k=6):
    middle = [[r.gauss(0, 1) for _ in range(size)] for _ in range(k)]
    return [(i, [float(np.float32(x + r.gauss(0, 0.4))) for x in r.choice(middle)]) for i in range(n)]


@pytest.mark.parametrize(("k", "rounds", "size"), [(16, 3, 64), (8, 6, 4), (1, 2, 3), (40, 5, 2), (2, 4, 2)])
def test_clusters_equal_measuring_every_distance(spark, k, rounds, size):
    r = random.Random(k)
    rows = vectors(r, 300, size)
    rows += [(i, v) for i, v in rows[:40]] + [(1000 + i, rows[0][1]) for i in range(60)]  # repeated rows; one common vector
    rows += [(None, rows[1][1]), (2000, None), (2001, []), (2002, rows[2][1][:-1]), (2003, [*rows[2][1][:-1], None]), (2004, [*rows[2][1][:-1], float("nan")]), (2005, [float("inf")] * size)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cluster", F.lit("clash")).withColumn("x", F.lit(0)).repartition(3)
    seen = []
    got = centroids.cluster(frame, k, rounds, size, watch=lambda t: seen.append((t.count(), t.agg(F.sum("seen")).first()[0], t.select(F.size("near")).first()[0])))
    assert sorted(repr(tuple(x)) for x in got.collect()) == plain_clusters(rows, k, rounds, size)
    assert len(seen) == rounds + 1 and seen[0][1] == seen[0][0] * (k - 1)
    if k == 16:
        assert seen[-1][1] < seen[0][1] / 4  # most orderings are certified by bounds
        assert max(2, k // 8) + 1 <= seen[-1][2] <= k // 4 + 1


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(i % 3), 0.0]) for i in range(30)]
    got = centroids.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 16, 3, 2)
    assert sorted(repr(tuple(x)) for x in got.collect()) == plain_clusters(rows, 16, 3, 2)


def test_few_or_no_vectors_and_large_components(spark):
    schema = "vec_id long, embedding array<double>"
    assert centroids.cluster(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, [3e5] * 64), (2, [-3e5] * 64), (3, [0.5] * 64)]
    got = centroids.cluster(spark.createDataFrame(rows, schema)).collect()
    assert sorted(repr(tuple(x)) for x in got) == plain_clusters(rows, 16, 3, 64)
    got = centroids.cluster(spark.createDataFrame([(1, [1e300] * 64), (2, [-1e300] * 64), (3, [0.0] * 64)], schema), 1, 1).collect()
    assert len(got) == 3 and all(0 <= x.distance < 1 << 63 for x in got)


def test_bounds_hold_when_centroids_move(spark):
    r = np.random.default_rng(5)
    x = r.integers(-40, 40, (2000, 8))
    c = x[:12].copy()
    own, b = centroids.scan(x, c, 3)
    keep = 3
    for step in range(6):
        new = c + r.integers(-6, 7, c.shape)
        moved = np.sqrt(((new - c) ** 2).sum(axis=1)) * (1 + centroids.OUT)
        c, keep = new, max(1, keep - step % 2)
        own, b, seen = centroids.assign(x, c, moved, b, keep)
        d = ((x[:, None, :] - c) ** 2).sum(axis=2)
        assert (own == d.min(axis=1)).all() and (b.near[:, 0] == d.argmin(axis=1)).all()
        listed = np.take_along_axis(d, b.near.astype(int), axis=1)[:, 1:]
        assert (b.low[:, 1:] <= np.sqrt(listed)).all()
        others = np.ones(d.shape, bool)
        np.put_along_axis(others, b.near.astype(int), False, axis=1)
        assert (b.rest <= np.sqrt(np.where(others, d, np.iinfo(np.int64).max).min(axis=1))).all()
        assert b.near.shape[1] == keep + 1
