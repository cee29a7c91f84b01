"""The operators against plain versions, and what they do with nulls, empty and long texts, ties, repeats, empty tables and other columns."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.llm import bpe, common, exact_dedup, jaccard_join, language_id, packing, quality, queries, sharding, token_counts, topk, url_filter

PATH = queries.tokenizer_path()
DOCS = "doc_id long, text string, lang string, n_tokens long, host string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, rows):
    """Documents with two columns whose names are those of results."""
    return spark.createDataFrame([(i, t, "en", 7, "x") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


ODD = [
    "", " ", "a<|endoftext|>b <|ENDOFTEXT|> ΣΑΣ İstanbul ß\x1cfoo\x85bar x  don't DON'T we'll ́ é '''sb''re 12345 ５６ 漢字かな 👍🏽 \x00 ​ zz", "x" * 5000,
    "<|startoftext|><|endoftext|>", "aaaaaaaaaaaaaaaaab" * 50, "é" * 300, "a" * 47 + " " + "a" * 48 + " " + "ab" * 24, "word " * 3000,
]


def test_bpe_is_exact(spark, library):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("abcdeinthersot  '.,!?0é漢\n") for _ in range(rng.randint(1, 300))) for _ in range(300)]
    df = docs(spark, [*enumerate(texts), (None, None), (1, texts[1])])
    rows = bpe.decode(bpe.encode(df, PATH), PATH, text="again").collect()
    assert len(rows) == len(texts) + 2 and rows[0]["host"] == "x"
    for r in bpe.encode(df, PATH, decoded="again").join(df.select("doc_id", "text").distinct(), "doc_id").collect():
        want = library.encode(r["text"], add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == want, r["text"][:50]
        assert r["again"] == library.decode(want, skip_special_tokens=False)
    assert bpe.encode(df.limit(0), PATH).count() == 0
    null = [r for r in rows if r["doc_id"] is None]
    assert null[0]["again"] == ""


def test_bpe_encodes_a_word_before_punctuation_once(library):
    encoder, words = bpe.Bpe(PATH), []
    word = encoder.word
    encoder.word = lambda s: words.append(s) or word(s)
    text = "thouonin, thouonin. thouonin... éliànou?! thouonin!\"'$ éliànou 'éliànou' thouonin_ 7, don't, élià́nou, ¿éliànou¡ -, thouonin's."
    ids = np.frombuffer(encoder.encode(text), "<u4").tolist()
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert words.count("thouonin") == 2 and words.count("éliànou") == 3  # again where something else is joined to them


def plain_groups(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").translate(LOWER).encode().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    a, b = top(i), top(j)
                    up[max(a, b)] = min(a, b)
    return {i: (len(s), top(i)) for i, s in sets.items()}


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80)])
def test_jaccard_groups(spark, words, percent):
    rng = random.Random(words)
    vocabulary = [f"W{i}" for i in range(300)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    common_part = [rng.choice(vocabulary) for _ in range(60)]
    rows, i = [], 100
    for edits in [0, 0, 0, 1, 1, 1, 1, 2, 2, 2, 3, 3, 4, 5, 6, 8] * 3:  # a large group of near copies
        w = list(base)
        for _ in range(edits):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((i := i + 1, " ".join(w)))
    for n in range(40):  # a passage that many share, and chains of edits
        w = common_part + [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        rows.append((i := i + 1, " \t".join(w)))
        if n % 4 == 0:
            for step in range(4):
                w = w[:-1] if step % 2 else w + [f"t{n}{step}"]
                rows.append((i := i + 1, " ".join(w).lower()))
    rows += [(1, ""), (2, None), (3, "one"), (4, "One"), (5, "two words"), (6, " \n"), (7, "one  ")]
    rows.append((8, " ".join(rng.choice(vocabulary) for _ in range(20000))))
    rng.shuffle(rows)
    got = jaccard_join.groups(docs(spark, [*rows, (None, "null id"), rows[0]]), words, percent).collect()
    want = plain_groups(rows, words, percent)
    assert len(got) == len(rows) + 2
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["class_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]], r
    left = {r["doc_id"] for r in jaccard_join.keep_one(docs(spark, rows), words, percent).collect()}
    assert left == {c for _, c in want.values()}
    assert jaccard_join.groups(docs(spark, [])).count() == 0


@pytest.mark.parametrize("words, percent, block", [(3, 90, 256), (2, 60, 3)])
def test_jaccard_links(spark, monkeypatch, words, percent, block):
    """n_links against all pairs: a triangle, whose B-C link joins no components, a large group, copies, repeated rows."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "COLUMNS", 64)
    rng = random.Random(percent)
    base = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(base)), (2, " ".join([*base, "b"])), (3, " ".join([*base, "c"])), (4, " ".join(base).upper()), (5, ""), (6, None), (7, "alone")]
    other = [f"v{i}" for i in range(80)]
    for i in range(100, 140):
        w = list(other)
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = f"e{i}"
        rows.append((i, " ".join(w)))
    sets = {}
    for i, t in rows:
        w = (t or "").translate(LOWER).split()
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    similar = lambda x, y: bool(x) and 100 * len(x & y) >= percent * len(x | y)
    want = {i: sum(i != j and similar(x, y) for j, y in sets.items()) for i, x in sets.items()}
    got = jaccard_join.groups(docs(spark, [*rows, (None, "null id"), rows[0], rows[20]]), words, percent, links=True).collect()
    assert len(got) == len(rows) + 3 and want[2] == 3
    for r in got:
        assert r["n_links"] == want.get(r["doc_id"]), r


def test_prefix_lemma():
    """Similar sets share at least the smaller m within their prefixes."""
    rng = np.random.default_rng(1)
    df = {int(v): int(n) for v, n in zip(range(4000), rng.integers(0, 3, 4000) * rng.integers(0, 500, 4000))}
    for _ in range(300):
        n = int(rng.integers(5, 200))
        x = np.sort(rng.choice(4000, n, replace=False)).astype(np.uint64)
        y = np.union1d(np.delete(x, rng.integers(0, n, max(0, n // 30))), rng.integers(0, 4000, max(0, n // 40)).astype(np.uint64)).astype(np.uint64)
        both = len(np.intersect1d(x, y))
        if 100 * both >= 90 * (len(x) + len(y) - both):
            (px, mx), (py, my) = (jaccard_join.prefix(s, np.array([df[int(v)] for v in s]), 90) for s in (x, y))
            assert len(np.intersect1d(x[px], y[py])) >= min(mx, my)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 102), (100, 102), (200, 200), (300, 50), (None, 3)]
    got = dict(common.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100, 102: 100, 300: 1}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


URLS = [
    ("http://www.Example.NET/en/x", "www.example.net", "/en/x", "example.net/en/", "allow"), ("http://example.net/de/", "example.net", "/de/", "net/", "block"),
    ("http://net/", "net", "/", "net/", "block"), ("http://fishnet/", "fishnet", "/", None, "allow"), ("http://a.example.com/de", "a.example.com", "/de", None, "allow"),
    ("http://a.example.com/de/1?x#y", "a.example.com", "/de/1", "example.com/de/", "block"), ("x://a.org/fr/?q", "a.org", "/fr/", "org/fr/", "allow"),
    ("http://example.net", "example.net", "", None, "allow"), ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("://", "", "", None, "allow"),
    ("http://a.net?x=://b.org/fr/", "a.net", "", None, "allow"), ("http://..net//en/", "..net", "//en/", "net/", "block"),
    ("h://x.net/\n/en", "x.net", "/\n/en", "net/", "block"),
]


def test_url_filter(spark):
    pages = spark.createDataFrame([(i, u[0], "k") for i, u in enumerate(URLS)] + [(0, URLS[0][0], "k")], "page_id long, url string, rule string")
    got = url_filter.judge(pages, url_filter.rules_frame(spark, queries.URL_RULES)).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == URLS[r["page_id"]][1:], r
    assert url_filter.judge(pages, spark.createDataFrame([], "entry string, action string"), "block").where("verdict = 'block'").count() == len(got)
    assert url_filter.judge(pages.limit(0), url_filter.rules_frame(spark, queries.URL_RULES)).count() == 0
    many = [(f"h{i}.example.org/a{i % 7}", "block") for i in range(3000)] + [("example.org/a1/b", "allow"), ("h5.example.org/a5", "allow")]
    asked = [(i, f"http://x.h{i}.example.org/a{i % 7}b/c") for i in range(2000, 4000)] + [(-1, "http://h1.example.org/a1/bc"), (-5, "http://h5.example.org/a5")]
    rows = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(asked, "page_id long, url string"), spark.createDataFrame(many, "entry string, action string")).collect()}
    assert all((rows[i]["verdict"] == "block") == (i < 3000) for i in range(2000, 4000))
    assert rows[-1]["rule"] == "h1.example.org/a1" and rows[-5]["verdict"] == "block"


def test_packing(spark, library):
    rng = random.Random(2)
    words = ["the", "house", "sitting", "zq", "on"]
    texts = ODD + [" ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 50, 400]))) for _ in range(120)] + ["same text"] * 300
    rows = [*enumerate(texts), (None, None), (0, texts[0])]
    got = packing.pack(docs(spark, rows), PATH, tokens=256).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r["length"] for r in got)
    assert len(by) <= -(-total // 256) + 2
    ids = np.array(library.encode(texts[8], add_special_tokens=False).ids + [1], "<u4")
    mine = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == 8)
    assert mine == [(k, 256 * k, len(ids[256 * k : 256 * k + 256]), zlib.crc32(ids[256 * k : 256 * k + 256].tobytes())) for k in range(-(-len(ids) // 256))]
    assert packing.pack(docs(spark, []), PATH).count() == 0


def test_packing_plan_keeps_every_capacity():
    histogram = {1000: 50, 700: 41, 300: 77, 20: 900, 1: 5}
    for rule in ("norm", "dot"):
        rows, bins = packing.plan(histogram, 4096, documents=9, attention=3_000_000, rule=rule)
        held = collections.defaultdict(list)
        for length, a, b, start, per, offset in rows:
            for r in range(a, b):
                held[start + (r - a) // per].append((offset + (r - a) % per * length, length))
        assert sum(map(len, held.values())) == sum(histogram.values()) and len(held) == bins
        for parts in held.values():
            ends = np.cumsum([n for _, n in sorted(parts)])
            assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 4096 and len(parts) <= 9 and sum(n * n for _, n in parts) <= 3_000_000


def test_language_id(spark):
    words = {"en": "the and of that with house", "de": "der und die nicht schön haus", "fr": "le et de être avec maison"}
    rng = random.Random(4)
    texts, langs = [], []
    for lang, w in words.items():
        for _ in range(60):
            texts.append(" ".join(rng.choice(w.split()) for _ in range(rng.randint(2, 60))))
            langs.append(lang)
    model = language_id.fit(texts, langs)
    got = {r["doc_id"]: r for r in language_id.identify(docs(spark, [(1, "the house of"), (2, None), (3, "123 ?!"), (4, "DIE UND DER " * 200000), (5, ""), (6, "maison avec")]), model).collect()}
    assert [got[i]["lang_pred"] for i in range(1, 7)] == ["en", "und", "und", "de", "und", "fr"]
    assert [got[i]["rejected"] for i in range(1, 7)] == [False, True, True, False, True, False] and all(0 <= r["lang_score"] <= 1 for r in got.values())
    a, b, c = model.predict(["der the", "le", "12"]), model.predict(["der the"]), model.predict(["le"])
    assert a[1][0] == b[1][0] and a[1][1] == c[1][0] and a[0][2] == "und"
    for some in (["en"], ["de", "en"], ["de", "en", "fr"]):  # texts in no language that was learned go, with few languages too
        own = [(t, lang) for t, lang in zip(texts, langs) if lang in some]
        few = language_id.fit([t for t, _ in own], [lang for _, lang in own])
        junk = ["".join(rng.choice("qxzjkvwpy ") for _ in range(200)) for _ in range(50)] + ["".join(rng.choice("абвгдежзик ") for _ in range(200)) for _ in range(50)]
        assert few.predict(junk)[2].mean() > 0.9 and few.predict([t for t, _ in own])[2].mean() < 0.02
    empty = language_id.train(docs(spark, []))
    assert language_id.identify(docs(spark, [(1, "the")]), empty).first()["lang_pred"] == "und"


def test_quality(spark):
    rng = random.Random(6)
    good = [" ".join(rng.choice(["thread", "oner", "and", "it.", "was,"]) for _ in range(rng.randint(5, 80))) for _ in range(150)]
    bad = ["Thr%%% " * rng.randint(5, 40) for _ in range(30)]
    x = np.array([quality.features(t) for t in good + bad])
    y = np.array([1] * 150 + [0] * 30)
    model = quality.fit(x, y, 150 / 180)
    s = model.score(x)
    assert ((s >= quality.CUT) == (y == 1)).mean() > 0.98
    got = quality.score(docs(spark, [(1, None), (2, ""), (3, good[0]), (4, bad[0]), (5, "x" * 3_000_000), (3, good[0])]), model).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 6 and by[1]["quality_score"] == by[2]["quality_score"] and not by[3]["rejected"] and by[4]["rejected"] and 0 <= by[5]["quality_score"] <= 1
    assert quality.score(docs(spark, []), model).count() == 0
    none = quality.train(docs(spark, []), spark.createDataFrame([], "doc_id long, quality int"))
    assert 0 <= quality.score(docs(spark, [(1, "a")]), none).first()["quality_score"] <= 1


def test_quality_learns_from_all(spark):
    """No labelled document, no pair and no long text is left out: the loss over all pairs has no slope left, and the threshold is that of all scores."""
    rng = random.Random(8)
    rows = [(i, "" if i % 200 == 0 else " ".join(rng.choice(["stone", "and", "it.", "Was", "%%", "3"][: 4 + (rng.random() < 0.3)]) for _ in range(rng.randint(3, 30))), 1) for i in range(3600)]
    rows += [(4000 + i, "" if i % 60 == 0 else " ".join(rng.choice(["stone", "and", "%%", "%%", "Was"]) for _ in range(rng.randint(1, 20))), 0) for i in range(600)]
    rows += [(5000 + i, "stone and it. " * (14_300 + i), i % 2) for i in range(4)]  # beyond 200,000 characters
    rows += [(7, rows[7][1], 1)]
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 0), (1, None), (9999, 0)], "doc_id long, quality int")
    model = quality.train(docs(spark, [r[:2] for r in rows] + [(8888, "no label"), (None, "x")]), labels)
    x, y = np.array([quality.features(t) for _, t, _ in rows]), np.array([r[2] for r in rows])
    assert np.allclose(model.mean, x.mean(0), rtol=1e-6, atol=1e-9) and np.allclose(model.scale, x.std(0), rtol=1e-5, atol=2e-6)
    z = np.clip((x - model.mean) / model.scale, -6, 6)
    f = np.hstack([z, z * z])
    s = f @ model.weights
    other = 1 / (1 + np.exp(s[y == 1][:, None] - s[y == 0]))
    slope = (other.sum(0) @ f[y == 0] - other.sum(1) @ f[y == 1]) / other.size + 1e-3 * model.weights
    assert np.abs(slope).max() < 1e-4 and 0.001 < other.mean() < 0.4
    values, counts = np.unique(np.round(s, 9), return_counts=True)
    below, share = np.cumsum(counts)[:-1] / len(s), (y == 0).mean()
    gaps = np.where(np.abs(below - share) <= 0.01, np.diff(values), 0)
    assert gaps.max() > 0 and abs(model.threshold - (values[gaps.argmax()] + values[gaps.argmax() + 1]) / 2) < 1e-6
    here = quality.fit(x, y, (y == 1).mean())
    assert np.allclose(here.weights, model.weights, atol=1e-4) and abs(here.threshold - model.threshold) < 1e-3


@pytest.mark.parametrize("good,bad", [(["a b c"] * 30, ["a b c"] * 10), (["", "a b", "Thr %% %%"] * 5 + ["x"], [""] * 12), (["a b"], ["%"]), (["a b"], []), ([], ["%"])])
def test_quality_ties(spark, good, bad):
    """Equal scores around the quantile, few rows, one label: the tables' way and that in memory find the same threshold."""
    rows = [(i, t, int(i < len(good))) for i, t in enumerate(good + bad)]
    model = quality.train(docs(spark, [r[:2] for r in rows]), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int"))
    x, y = np.array([quality.features(t) for _, t, _ in rows]), np.array([r[2] for r in rows])
    here = quality.fit(x, y, (y == 1).mean())
    assert np.allclose(here.weights, model.weights, atol=1e-4) and abs(here.threshold - model.threshold) < 1e-3
    assert ((model.score(x) >= quality.CUT) == (here.score(x) >= quality.CUT)).all()
    described = quality.describe(docs(spark, [r[:2] for r in rows]))
    told = sorted(quality.score_described(described, model).select("doc_id", "quality_score", "rejected").collect())
    assert told == sorted(quality.score(docs(spark, [r[:2] for r in rows]), model).select("doc_id", "quality_score", "rejected").collect())


@pytest.mark.parametrize("limit", [10, 200, 100000])
def test_sharding(spark, limit):
    rng = random.Random(limit)
    rows = [(i, "x" * rng.choice([0, 1, 5, 50, 300])) for i in range(300)] + [(7, "y" * 40)] * 60 + [(None, "z"), (1000, None)]
    got = sharding.shard(docs(spark, rows), limit).collect()
    assert len(got) == len(rows)
    held = collections.defaultdict(list)
    for r in got:
        held[r["shard"]].append(r["n_bytes"])
        assert len(r["shard"]) == r["depth"] and r["fits"] == (r["shard_bytes"] <= limit)
    for shard, sizes in held.items():
        assert sum(sizes) <= limit or len(sizes) == 1
        assert not any(other != shard and other.startswith(shard) for other in held)
    for r in got:  # no shorter prefix would have done
        if r["depth"]:
            up = r["shard"][:-1]
            near = [n for s, v in held.items() if s.startswith(up) for n in v]
            assert sum(near) > limit and len(near) > 1
    assert sharding.shard(docs(spark, []), limit).count() == 0


def test_exact_dedup_goes_through_the_index(spark, monkeypatch):
    """A new index is anti-joined too, and keepers are what the index holds."""
    calls, read = [], exact_dedup.DigestIndex.read

    def noted(self):
        calls.append(read(self).count())
        return read(self).withColumn("keep_id", F.col("keep_id") + 1000)

    monkeypatch.setattr(exact_dedup.DigestIndex, "read", noted)
    index = exact_dedup.DigestIndex(spark)
    fates = exact_dedup.resolve(docs(spark, [(1, "a"), (2, "A"), (3, "b")]), index)
    index.drop()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in fates.collect()) == [(1, 1002, 2), (2, 1002, 2), (3, 1003, 1)]
    assert calls == [0, 2]


def test_exact_dedup(spark):
    rows = [(1, "Abc"), (2, "aBC"), (3, "abd"), (4, None), (5, ""), (6, "É"), (7, "é"), (2, "aBC"), (None, "abd"), (9, "x" * 2_000_000), (10, "X" * 2_000_000)]
    df = docs(spark, rows)
    index = exact_dedup.DigestIndex(spark)
    got = exact_dedup.resolve(df, index).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[bytes(r["digest"])].append(r)
    abc = by[hashlib.sha256(b"abc").digest()]
    assert {(r["keep_id"], r["group_size"]) for r in abc} == {(2, 3)} and [r["doc_id"] for r in abc if r["kept"]] == [2]
    assert all(sum(r["kept"] for r in g) == 1 for g in by.values()) and len(by) == 6
    again = exact_dedup.resolve(docs(spark, [(1, "abc"), (2, "aBC"), (50, "new")]), index).collect()
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in again} == {(1, 2, False), (2, 2, False), (50, 50, True)}
    index.drop()
    left = exact_dedup.dedup(df).collect()
    assert sorted(r["doc_id"] for r in left) == [2, 3, 5, 6, 7, 10] and left[0]["host"] == "x"
    assert exact_dedup.dedup(docs(spark, [])).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(0, 1, (400, 12))
    v[50:120] = v[50]  # ties
    v[200] = 0
    rows = [(i, [float(x) for x in a], 1) for i, a in enumerate(v)]
    rows += [(1000, None, 1), (1001, [None] * 12, 1), (1002, [float("nan")] * 12, 1), (1003, [float("inf")] * 12, 1), (1004, [1.0], 1), (None, [1.0] * 12, 1), (1100, [], 1), (1200, [1e17] * 12, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = collections.defaultdict(list)
    for r in topk.top_k(df, F.col("vec_id") % 100 == 0, 10).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    ints = {i: [int(np.floor(1024 * x)) for x in a] for i, a in enumerate(v)}
    ints[1200] = [1024 * 10**17] * 12
    for q in (0, 100, 200, 300):
        want = sorted(((-sum(a * b for a, b in zip(ints[q], w)), i) for i, w in ints.items() if i != q))[:10]
        assert [g[0] for g in got[q]] == [i for _, i in want], q
    assert set(got) == {0, 100, 200, 300, 1200}
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    few = topk.top_k(df.where("vec_id in (0, 3, 4)"), F.col("vec_id") == 0).collect()
    assert len(few) == 2


def test_token_counts_follow_edits(spark, library):
    rng = random.Random(9)
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    encoder = bpe.model(PATH)
    for n in (0, 3, 400, 6000):
        text = "".join(rng.choice("abc de'st f.\n") for _ in range(n))
        tree = token_counts.TokenTree(text, encoder)
        assert tree.n_tokens == count(text)
        for _ in range(25):
            at, gone = rng.randint(0, len(text) + 2), rng.choice([0, 0, 1, 5, 400])
            new = rng.choice(["", "x", " ", "'s", "<|endoftext|>", "two words", "y" * 700, "long text " * 300])
            before = tree.encoded_chars
            tree.edit(at, gone, new)
            text = text[:at] + new + text[at + gone :] if at <= len(text) else text + new
            assert tree.text() == text and tree.n_tokens == count(text)
            assert tree.encoded_chars - before <= len(new) + gone + 9 * token_counts.LEAF_CHARS or " " not in text
    df = docs(spark, [(1, "one two three"), (2, None), (3, "word " * 100000)]).withColumn("edits", F.expr("array(named_struct('at', 0, 'remove', 3, 'insert', 'eleven'), null, named_struct('at', null, 'remove', null, 'insert', null))"))
    got = {r["doc_id"]: r for r in token_counts.count(df, PATH, edits="edits").collect()}
    assert got[1]["n_tokens"] == 3 and got[1]["n_tokens_after"] == count("eleven two three") and got[2]["n_tokens_after"] == count("eleven")
    assert got[3]["n_tokens"] == 100000 and got[3]["edit_chars"] < 2000 and got[3]["host"] == "x"
    assert token_counts.count(df.limit(0), PATH).count() == 0
