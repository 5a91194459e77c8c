"""Language ID and toxicity by held-out accuracy, WARC by round trip, and the pipeline's stages."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow.fs as fs
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import test_native as native
import test_similarity as similarity
from packetloom.llm import decontaminate, langid, license_scan, registry, toxicity, warc
from packetloom.llm._store import Workspace

SMALL = "/root/testdata/sf0.001"


def brute_phrases(text, sample):
    n, i = 0, 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in sample:
            j += 1
        i = max(i + 1, j - 1)
        n += 1
    return n


def test_phrases_equal_brute_force():
    r = random.Random(1)
    draw = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    model = langid.Model({"x": [draw("abc ", 300)], "y": [draw("bcd ", 300), draw("bde ", 200)]}, most=400)
    assert model.languages == ["x", "y"]
    texts = [draw("abcde ", n) for n in (1, 2, 17, 80, 500)]
    symbols = [langid.symbols(langid.code_points(t), model.table) for t in texts]
    got = model.phrases(symbols)
    for j in range(len(model.languages)):
        table = model.steps.reshape(-1, model.size)
        for i, s in enumerate(symbols):
            # walk the table one symbol at a time
            state, n = model.roots[j], 0
            for c in s.tolist():
                v = int(table[state, c])
                n, state = n + (v & 1), v >> 1
            assert got[i, j] == n


def test_suffix_automaton_parses_like_substring_search():
    r = random.Random(2)
    sample = [r.randrange(4) for _ in range(200)]
    text = [r.randrange(5) for _ in range(300)]
    table = langid.parsing_table(langid.suffix_automaton(sample, 5))
    state = n = 0
    for c in text:
        v = int(table[state, c])
        n, state = n + (v & 1), v >> 1
    assert n == brute_phrases("".join(map(str, text)), "".join(map(str, sample)))


def test_language_id_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = langid.identify(docs.withColumn("score", F.lit("clash")), langid.train(docs)).withColumn("held", langid.held_out())
    rows = out.filter("held").collect()
    assert rows and sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_id_of_odd_texts(spark):
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1]
    held = next(i for i in range(40) if i not in ids)
    texts = [("hello there world", "en"), ("guten tag welt", "de"), (None, "fr"), ("x", None)]
    train = spark.createDataFrame([(i, *t) for i, t in zip(ids, texts)] + [(held, "bonjour", "it")], "doc_id long, text string, lang string")
    model = langid.train(train)
    assert model.languages == ["de", "en"]
    rows = [(1, None), (2, ""), (3, "123 !!"), (4, "hello world " * 50000), (None, "tag"), (5, "日本語")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [got[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3
    assert got[4][0] in model.languages and got[5][0] in model.languages
    none = langid.train(train.limit(0))
    assert {r.lang_pred for r in langid.identify(train, none).collect()} == {"und"}
    assert langid.identify(train.limit(0), model).count() == 0


def test_toxicity_on_rows_left_out_of_training(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    out = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    model = toxicity.train(docs, labels.filter(~out).select("doc_id", F.col("toxic").alias("grade")))
    scored = toxicity.score(docs.select("doc_id", "text"), model).join(labels.filter(out).select("doc_id", F.col("toxic").alias("truth")), "doc_id").collect()
    assert len(scored) > 500
    right = sum(r.toxic == bool(r.truth) for r in scored)
    assert right >= 0.97 * len(scored)
    high, low = [[r.severity for r in scored if r.truth == k] for k in (1, 0)]
    assert np.mean(high) > np.mean(low) + 0.5


def test_toxicity_shares_weights_over_ordered_thresholds():
    r = np.random.default_rng(0)
    texts, grade = [], []
    for _ in range(600):
        g = int(r.integers(0, 3))
        texts.append(" ".join([f"w{r.integers(0, 50)}" for _ in range(20)] + ["bad"] * (g > 0) + ["worse"] * (g > 1)))
        grade.append(g)
    model = toxicity.CumulativeLink.fit(*toxicity.features(texts), np.array(grade), 3)
    assert (np.diff(model.thresholds) > 0).all()
    s, p = model.severity(["w1 w2 w3", "w1 bad", "w1 bad worse", None, ""])
    assert s[0] < s[1] < s[2] and s[2] > 1.5 and s[0] < 0.5 and (p >= 0).all() and abs(s[3] - s[4]) < 1e-12


def test_toxicity_equals_brute_force_and_is_a_maximum():
    r = np.random.default_rng(1)
    texts, grade = [], []
    for _ in range(300):
        g = int(r.integers(0, 3))
        texts.append(" ".join([f"w{r.integers(0, 30)}" for _ in range(12)] + ["bad"] * (r.random() < 0.2 + 0.3 * g) + ["worse"] * (r.random() < 0.4 * (g > 1))))
        grade.append(g)
    places, off = toxicity.features(texts)
    model = toxicity.CumulativeLink.fit(places, off, np.array(grade), 3, steps=2000)

    def loss(weights, t):
        total = toxicity.PENALTY / 2 * float((weights.astype(float) ** 2).sum())
        for i, g in enumerate(grade):
            z = sum(float(weights[p]) for p in places[off[i] : off[i + 1]])
            below = [0.0, *(1 / (1 + np.exp(z - x)) for x in t), 1.0]
            total -= np.log(below[g + 1] - below[g]) / len(grade)
        return total

    best, used = loss(model.weights, model.thresholds), np.flatnonzero(model.weights)
    assert 1 <= len(used) <= 10
    for _ in range(20):
        w = model.weights.copy()
        w[used] += r.normal(0, 0.05, len(used)).astype(np.float32)
        assert loss(w, model.thresholds + r.normal(0, 0.05, 2)) > best - 1e-5
    s, p = model.severity(texts[:20])
    for i in range(20):
        z = sum(float(model.weights[q]) for q in places[off[i] : off[i + 1]])
        above = [1 / (1 + np.exp(x - z)) for x in model.thresholds]
        assert abs(s[i] - sum(above)) < 1e-9 and abs(p[i] - above[0]) < 1e-9


def test_texts_that_are_no_utf8_stop_nothing(spark):
    rows = [(1, b"\xff\xfe broken \x80 words of some text here"), (2, "Released under the MIT License \u00e9".encode()), (2, b"Released under the MIT License \xff")]
    frame = spark.createDataFrame(rows, "doc_id long, b binary").select("doc_id", F.col("b").cast("string").alias("text"), F.lit("en").alias("lang"))
    bench = frame.filter("doc_id = 1").select(F.col("doc_id").cast("string").alias("item_id"), "text")
    assert [(r.doc_id, r.item_id, r.similarity) for r in decontaminate.contamination(frame, bench).collect()] == [(1, "1", 1.0)]
    assert decontaminate.decontaminate(frame, bench).count() == 2
    assert [r.doc_id for r in license_scan.license_scan(frame).collect()] == [2, 2]
    model = langid.train(frame)
    assert langid.identify(frame, model).count() == 3
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, grade int")
    assert toxicity.score(frame, toxicity.train(frame, labels)).count() == 3
    folder = f"{Workspace(spark, 'warc-bytes').path}/archive"
    warc.write_warc(frame.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), F.col("text").alias("html")), folder)
    assert sorted(bytes(r.payload) for r in warc.read_warc(spark, folder).collect()) == sorted(b for _, b in rows)


def test_warc_revisits_name_the_record_that_holds_the_payload(spark):
    rows = [(i, f"http://a/{i}", ["same " * 50, "other " * 60][i % 2]) for i in range(6)] + [(None, f"n{i}", f"nobody's {i} " * 40) for i in range(40)] + [(9, f"http://b/{i}", f"<{i}>" * 80) for i in range(60)]
    folder, manifest = archive(spark, rows, shard_bytes=2_000)
    per = {}
    store, at = warc._open(folder)
    ids, refers = {}, []
    for f in manifest.collect():
        per[f.shard] = per.get(f.shard, 0) + f.records
        with store.open_input_stream(f"{at}/{f.file}", compression=None) as stream:
            records = list(warc._records(stream))
        assert records[0][0]["WARC-Type"] == "warcinfo" and len(records) == f.records + 1
        for fields, block in records[1:]:
            assert fields["Content-Type"].startswith("application/http") and block.startswith(b"HTTP/1.1 200 OK")
            ids[fields["WARC-Record-ID"]] = fields["WARC-Target-URI"]
            if fields["WARC-Type"] == "revisit":
                refers.append((fields["WARC-Refers-To"], fields["WARC-Refers-To-Target-URI"]))
    assert len(refers) == 4 and all(ids[a] == b for a, b in refers)
    assert max(per.values()) < 30 and sum(per.values()) == len(rows)  # neither page 9 nor rows without an id fill a shard
    assert warc.read_warc(spark, folder).count() == len(rows)


def test_license_scan_of_several_hundred_templates(spark):
    r = random.Random(8)
    known = [(f"L{i}", " ".join(f"t{r.randrange(400)}" for _ in range(r.choice([4, 12, 40, 150])))) for i in range(400)] + [(None, "x"), ("empty", None)]
    rows = [(i, " ".join([f"f{r.randrange(900)}" for _ in range(60)] + known[i * 7 % 400][1].split() + ["end"] * 9)) for i in range(50)]
    found = license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(known, "name string, text string")).collect()
    got = {(f.doc_id, f.license) for f in found}
    assert {(i, f"L{i * 7 % 400}") for i in range(50) if len(known[i * 7 % 400][1].split()) >= 5} <= got
    text = dict(rows)
    for f in found:  # what is found is there
        want, own = ([tuple(w[i : i + 5]) for i in range(len(w) - 4)] for w in (dict(known)[f.license].split(), text[f.doc_id].split()[f.start_word : f.start_word + f.n_words]))
        assert abs(len(set(want) & set(own)) / len(set(want)) - f.containment) < 1e-9


def test_pipeline_equals_brute_force(spark):
    r = random.Random(12)
    items = [tuple(x) for x in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [(i * 3 % 1009, t) for i, (_, t) in enumerate(similarity.corpus(7)) if t != "x " * 50]
    rows += [(2000 + i, f"start {i} of its own {r.random()} " + t + f" end {i} {r.random()}") for i, (_, t) in enumerate(items[:6])] + [(3000, "12 -- 34"), (3001, None)]
    docs = [(d, t, "en" if d % 2 else None, "ab"[d % 5 == 0], len(t or "")) for d, t in rows]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    now, ws, kept = frame, Workspace(spark, "brute"), docs
    got = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = ws.save(stage(spark, now, SMALL), str(i))
        got.append(now.collect())
    ids = lambda rs: sorted(x[0] for x in rs)
    kept = [x for x in kept if any(c.isalpha() for c in x[1] or "")]
    assert ids(got[0]) == ids(kept)
    root = similarity.brute_components([x[:2] for x in kept], 80, 5)
    kept = [x for x, (d, _, c) in zip(kept, root, strict=True) if d == c]
    assert ids(got[1]) == ids(kept)
    bad = {d for d, _ in similarity.brute_contamination([x[:2] for x in kept], items)}
    kept = [x for x in kept if x[0] not in bad]
    assert len(bad) >= 6 and ids(got[2]) == ids(kept)
    size = {s: sum(len(x[1].encode()) for x in kept if x[3] == s) for s in "ab"}
    want = []
    for x in kept:
        u = (int(hashlib.md5(f"mix-1:{x[0]}:1".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        want += [x[0]] * native.poisson(sum(size.values()) / 2 / size[x[3]], u)
    assert ids(got[3]) == sorted(want) and ids(got[4]) == sorted(want)


def test_toxicity_with_one_grade_or_none(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    for rows, want in (([], 0.0), ([(1, 0), (2, None)], 0.0), ([(1, 1)], 1.0)):
        model = toxicity.train(docs, spark.createDataFrame(rows, "doc_id long, grade int"))
        assert all(abs(r.severity - want) < 1e-6 for r in toxicity.score(docs, model).collect())


PAGES = [
    (5, "http://a/5", "x" * 500), (3, "http://a/3", "x" * 500), (9, "http://a/9", "x" * 500), (4, None, None), (6, "u\r\nX: 1", ""), (7, "http://a/7", "s" * 99),
    (8, "http://a/8", "s" * 99), (1, "http://é", "päge " * 40), (2, "http://a/2", "päge " * 40), (None, "n", "x" * 500), (3, "http://a/3", "x" * 500),
    *[(100 + i, f"http://b/{i}", f"<p>{i}</p>" * 60) for i in range(300)],
]


def archive(spark, rows, **how):
    folder = f"{Workspace(spark, 'warc-test').path}/archive"
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("shard", F.lit("clash"))
    return folder, warc.write_warc(frame.repartition(5), folder, **how)


def test_warc_round_trip(spark):
    folder, manifest = archive(spark, PAGES, shard_bytes=40_000, roll_bytes=2_000)
    files = manifest.collect()
    assert len({f.shard for f in files}) > 3 and len(files) > len({f.shard for f in files})
    got = warc.read_warc(spark, folder).collect()
    assert len(got) == len(PAGES)
    first = {}
    for i, _, h in PAGES:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    seen = set()
    for r in sorted(got, key=lambda r: (r.page_id is None, r.page_id, r.record_type)):
        sources = {(u or "").replace("\r\n", ""): h or "" for i, u, h in PAGES if i == r.page_id}
        html = sources[r.url]
        assert (r.payload_bytes, r.payload_digest) == (len(html.encode()), hashlib.sha256(html.encode()).hexdigest())
        if len(html.encode()) >= 100 and (r.page_id != first[html] or (r.page_id, html) in seen):
            assert (r.record_type, r.refers_to, r.payload) == ("revisit", first[html], None)
        else:
            assert (r.record_type, r.refers_to, bytes(r.payload).decode()) == ("response", None, html)
        seen.add((r.page_id, html))


def test_warc_files_are_deterministic_and_committed_by_the_manifest(spark):
    (a, m), (b, n) = archive(spark, PAGES, shard_bytes=30_000), archive(spark, PAGES[::-1], shard_bytes=30_000)
    key = lambda m: sorted(map(tuple, m.collect()))
    assert key(m) == key(n)
    store, at = warc._open(a)
    assert not [f for f in store.get_file_info(fs.FileSelector(at)) if f.base_name.endswith(".tmp")]
    with store.open_output_stream(f"{at}/shard-999999-0000.warc.gz") as f:
        f.write(b"left by a lost task")
    assert warc.read_warc(spark, a).count() == len(PAGES)
    name = key(m)[0][1]
    with store.open_output_stream(f"{at}/{name}") as f:
        f.write(b"short")
    with pytest.raises(Exception, match="manifest"):
        warc.read_warc(spark, a).collect()


def test_warc_of_nothing(spark):
    folder, _ = archive(spark, PAGES[:0])
    assert warc.read_warc(spark, folder).collect() == []


def test_warc_shard_bounds_refine_heavy_ranges(spark):
    rows = [(i, 10) for i in range(1000)] + [(10**12, 500)] + [(10**12 + i, 10) for i in range(1, 200)]
    ends = warc.shard_bounds(spark.createDataFrame(rows, "page_id long, bytes long"), 600, ranges=16)
    sizes = [0] * (len(ends) + 1)
    for i, n in rows:
        sizes[sum(e < i for e in ends)] += n
    assert max(sizes) <= 1100 and len(sizes) > 15


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    ws, sizes = Workspace(spark, "stages"), [docs.count()]
    now = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = ws.save(stage(spark, now, SMALL), str(i))
        assert i == len(corpus_pipeline.STAGES) - 1 or now.columns == docs.columns, name
        sizes.append(now.count())
    assert sizes[1] >= 0.97 * sizes[0] and sizes[2] < sizes[1] and sizes[3] < sizes[2] and sizes[4] == sizes[5] > 0
    again = corpus_pipeline.run(spark, SMALL)
    pick = ["doc_id", "shard_id"]
    assert sorted(map(tuple, again.select(pick).collect())) == sorted(map(tuple, now.select(pick).collect()))


def test_registry_names():
    assert sorted(int(k[2:].split("_")[0]) for k in registry.QUERIES) == list(range(1, 14))
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


ODD = [
    (1, "plain words of a text that has some length to it", "en", "a", 5), (2, None, None, None, None), (None, "words without an identity", "en", None, 3), (3, "", "de", "a", 0), (4, "42 -- !", None, "b", 9),
    (5, "plain words of a text that has some length to it", "en", "b", 5), (5, "plain words of a text that has some length to it", "en", "b", 5), (6, "long " * 60_000, "en", "a", 1), (6, "other text under one identity", "xx", "a", 1),
]


@pytest.mark.parametrize("rows", [ODD, []], ids=["odd", "empty"])
def test_pipeline_stages_take_odd_documents(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("node", "n", "d", "v", "sig", "_bits", "item_id", "src", "rate2"):
        docs = docs.withColumn(name, F.lit("extra"))
    ws, now = Workspace(spark, "odd"), docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = ws.save(stage(spark, now, SMALL), str(i))
        assert i == len(corpus_pipeline.STAGES) - 1 or now.columns == docs.columns, name
        texts = [r.text for r in now.collect()]
        if i == 0:
            assert None not in texts and "" not in texts and "42 -- !" not in texts and len(texts) == (6 if rows else 0)
        if i == 1 and rows:
            assert sorted(r.doc_id or 0 for r in now.collect() if (r.text or "").startswith("plain")) == [1]
    assert set(now.columns) == {*docs.columns, "shard_id", "shard_depth", "shard_prefix", "shard_bytes"}


def test_pipeline_takes_near_copies_from_80_percent(spark):
    words = [f"w{i}" for i in range(1000)]
    edited = ["new" if i % 50 == 0 else w for i, w in enumerate(words)]  # 20 edits, Jaccard 0.82
    apart = ["new" if i % 40 == 0 else w for i, w in enumerate(words)]  # 25 edits, Jaccard below 0.8
    rows = [(1, words), (2, words + [f"x{i}" for i in range(200)]), (3, edited), (4, [f"v{i}" for i in range(300)]), (5, apart)]
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in rows], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.ngram_jaccard_join(spark, docs, SMALL).collect()) == [1, 4, 5]


def test_language_id_of_many_scripts():
    r = random.Random(4)
    first = {"el": (0x3B1, 24), "ru": (0x430, 32), "ar": (0x627, 20), "hi": (0x915, 36), "zh": (0x4E00, 600), "zz": (0x6E00, 600), "ja": (0x3041, 80), "ko": (0xAC00, 600), "en": (0x61, 26), "fr": (0x61, 26)}
    words = {k: ["".join(chr(a + r.randrange(n)) for _ in range(r.randrange(2, 7))) for _ in range(150)] for k, (a, n) in first.items()}
    draw = lambda k, n: " ".join(r.choice(words[k]) for _ in range(n))
    model = langid.Model({k: [draw(k, 400) for _ in range(10)] for k in first}, langid.TOTAL_SYMBOLS // len(first))
    asked = [(k, draw(k, 30)) for k in first for _ in range(10)]
    assert model.predict([t for _, t in asked])[0] == [k for k, _ in asked]
    letters = sorted({c for v in words.values() for w in v for c in w if c.isalpha()})
    assert len({tuple(model.symbols(langid.code_points(c)).tolist()) for c in letters}) == len(letters)


def test_language_samples_come_from_whole_texts(spark):
    kept = next(i for i in range(9) if zlib.crc32(str(i).encode()) % 3 != 1)
    text = "abc " * 3000 + "def " * 3000 + "xyz " * 3000
    model = langid.train(spark.createDataFrame([(kept, text, "en")], "doc_id long, text string, lang string"), most=300)
    assert all(model.table[ord(c)] > 1 for c in "abcxyz")
    assert model.phrases([model.symbols(langid.code_points("xyz xyz"))]).tolist() == [[1]]
    assert len(langid.spread(np.arange(1000), 100)) <= 100 and langid.spread(np.arange(1000), 100)[-1] == 999
