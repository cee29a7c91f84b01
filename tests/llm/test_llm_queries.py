"""The queries with SQL against DuckDB, and the pipeline stage by stage."""

import collections
import glob
import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from test_operators import LOWER, plain_groups

import corpus_pipeline
from pixelloom.llm import exact_dedup, jaccard_join, packing, token_counts, url_filter
from pixelloom.llm.queries import ORACLES, QUERIES, URL_RULES, tokenizer_path

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, SF)
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r)) for r in got.select(*columns).collect())


@pytest.mark.parametrize("name", ["op5_language_id", "op7_quality"])
def test_held_out(spark, name):
    rows = QUERIES[name](spark, SF).where("held_out")
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    if name == "op5_language_id":
        right = rows.join(docs.select("doc_id", "lang"), "doc_id").selectExpr("avg(int(lang = lang_pred))").first()[0]
    else:
        right = rows.join(labels, "doc_id").selectExpr("avg(int(quality = predicted))").first()[0]
    assert right > 0.9


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == columns and docs.count() <= n and docs.exceptAll(before).count() == 0
            n = docs.count()
        if name == "exact_dedup":
            assert docs.selectExpr("count(distinct lower(text))", "count(*)").first()[0] == n
    assert docs.select("doc_id").distinct().count() == n


#: Documents with columns named like results and like names used within, in several cases.
CLASHING = "doc_id long, text string, lang string, source string, rejected string, LANG_PRED int, lang_score int, quality_score string, __text int, text_read int, __held int, __gone int, gone_id int, gone_key int, digest int, version int, host string"
WORDS = {"en": "the and of that with house over there was it", "de": "der und die nicht schön haus auch wenn über sie", "fr": "le et de être avec maison pour dans une elle"}


def rows_of(spark, texts):
    """(doc_id, text, lang) with a value in each of the other columns."""
    rest = ("r", 1, 2, "q", 3, 4, 5, 6, 7, 8, 9, 10, "h")
    return spark.createDataFrame([(i, t, lang, "web", *rest) for i, t, lang in texts], CLASHING)


def corpus():
    """Clean texts of three languages with copies, near copies, junk, nulls, empty and long texts, repeated rows."""
    rng = random.Random(12)
    rows = []
    for i in range(150):
        lang = "en de fr".split()[i % 3]
        rows.append((i, " ".join(rng.choice(WORDS[lang].split()) + rng.choice(["", "", "s", "en"]) for _ in range(rng.randint(20, 60))), lang))
    rows += [(200 + i, rows[i][1].upper(), rows[i][2]) for i in range(10)]
    rows += [(300 + i, rows[i][1] + " the end", rows[i][2]) for i in range(0, 30, 3)]
    rows += [(400, None, None), (401, "", "en"), (402, " 12 \n", None), (403, " ".join(rows[3][1].split() * 4000), "en"), rows[7], rows[7], (None, "the house of that and there", "en")]
    return rows


def tables(spark, tmp_path, rows, labels):
    rows_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_pipeline_against_plain(spark, tmp_path):
    """Each stage on all that the one before kept, recomputed row by row."""
    from pixelloom.llm import language_id, quality

    rows = corpus()
    sf = tables(spark, tmp_path, rows, [(i, int(i % 5 > 0), 0) for i in range(0, 150, 2)])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "")
    stages = dict(corpus_pipeline.STAGES)
    for name in ("language_id", "quality", "exact_dedup", "jaccard_join"):
        before, after = sorted(docs.collect(), key=key), stages[name](spark, docs, sf)
        after.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        got = sorted(docs.collect(), key=key)
        assert all(tuple(r)[4:] == ("r", 1, 2, "q", 3, 4, 5, 6, 7, 8, 9, 10, "h") for r in got)
        if name == "language_id":
            model = language_id.train(spark.read.parquet(f"{sf}/documents.parquet"))
            want = [r for r, gone in zip(before, model.predict([r["text"] for r in before])[2]) if not gone]
            assert len(got) >= 160
        elif name == "quality":
            model = quality.train(spark.read.parquet(f"{tmp_path}/language_id"), spark.read.parquet(f"{sf}/labels.parquet"))
            want = [r for r in before if model.score(np.array([quality.features(r["text"])]))[0] >= quality.CUT]
        elif name == "exact_dedup":
            best = {}
            for r in before:
                t = (r["text"] or "").translate(LOWER)
                if t not in best or (r["doc_id"] is not None and (best[t]["doc_id"] is None or r["doc_id"] > best[t]["doc_id"])):
                    best[t] = r
            want = sorted(best.values(), key=key)
        else:
            groups = plain_groups([(r["doc_id"], r["text"]) for r in before if r["doc_id"] is not None], 5, 80)
            want = [r for r in before if r["doc_id"] is None or groups[r["doc_id"]][1] == r["doc_id"]]
        assert got == want, name
    out = corpus_pipeline.run(spark, sf)
    assert out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_pipeline_hands_texts_to_the_classifiers_once(spark, tmp_path):
    rows = [(i, "Lang" if i % 2 else "en", ("the cat and the dog %d " if i % 2 else "der Hund und die Katze %d ") * 5 % ((i,) * 5), "own") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, Text string, rejected string")
    spark.createDataFrame([(i, i % 3 % 2) for i in range(60)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for stage in (corpus_pipeline.language, corpus_pipeline.good_quality):
        out = stage(spark, docs, str(tmp_path))
        node = out._jdf.queryExecution().analyzed()
        while node.nodeName() != "MapInArrow":
            node = node.children().apply(0)
        read = node.children().apply(0).output()
        assert [read.apply(k).name() for k in range(read.size())] == docs.columns
        got = out.collect()
        assert out.columns == docs.columns and got and {tuple(r) for r in got} <= set(rows)


def test_pipeline_on_empty_tables(spark, tmp_path):
    sf = tables(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_nothing_to_learn_from(spark, tmp_path):
    """Without languages and labels the classifiers keep all rows."""
    sf = tables(spark, tmp_path, [(i, t, None) for i, t, _ in corpus()], [])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert corpus_pipeline.language(spark, docs, sf).count() == docs.count() == corpus_pipeline.good_quality(spark, docs, sf).count()


def test_encoding_queries_against_the_library(spark, tmp_path):
    """op1, op4 and op10 on a small table, row by row."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    library.no_truncation()
    library.no_padding()
    rows = corpus()
    sf = tables(spark, tmp_path, rows, [])
    ids = lambda t: library.encode(t or "", add_special_tokens=False).ids
    raw = lambda x: np.array(x, "<u4").tobytes()
    want = sorted((r[0] or -1, len(ids(r[1])), hashlib.sha256(raw(ids(r[1]))).hexdigest(), hashlib.sha256(library.decode(ids(r[1]), skip_special_tokens=False).encode()).hexdigest()) for r in rows)
    assert sorted((r[0] or -1, *r[1:4]) for r in QUERIES["op1_bpe"](spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == want
    got = QUERIES["op4_packing"](spark, sf).collect()
    pieces = []
    for i, t, _ in rows:
        x = [*ids(t), 1]
        pieces += [(i or -1, k, 4096 * k, len(x[4096 * k : 4096 * k + 4096]), zlib.crc32(raw(x[4096 * k : 4096 * k + 4096]))) for k in range(-(-len(x) // 4096))]
    assert sorted((r["doc_id"] or -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(pieces)
    held = collections.defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        assert [o for o, _ in sorted(parts)] == [0, *np.cumsum([n for _, n in sorted(parts)])[:-1].tolist()] and sum(n for _, n in parts) <= 4096
    assert len(held) <= -(-sum(p[3] for p in pieces) // 4096) + 1
    counts = QUERIES["op10_token_counts"](spark, sf).collect()
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in counts) == sorted((r[0] or -1, len(ids(r[1]))) for r in rows)
    text = {r[0]: r[1] or "" for r in rows}
    for r in counts:
        t = text[r["doc_id"]]
        first = len(re.match(r"\S*", t)[0])
        t2 = t[first:]
        at = len(t) // 2
        t2 = t2[:at] + "[see note]" + t2[at:]
        t2 = t2[: len(t)] + "\nEnd of text." + t2[len(t) :]
        assert r["n_tokens_after"] == len(ids(t2)) and r["first_chars"] == 0


def test_jaccard_query_against_all_pairs(spark, tmp_path):
    rows = corpus()
    sf = tables(spark, tmp_path, rows, [])
    want = plain_groups([(i, t) for i, t, _ in rows if i is not None], 3, 90)
    got = [r for r in QUERIES["op2_jaccard_join"](spark, sf).collect() if r["doc_id"] is not None]
    assert len(got) == len(rows) - 1 and all((r["n_shingles"], r["component_id"]) == want[r["doc_id"]] for r in got)


def test_packing_under_all_capacities(spark):
    """Documents and attention cost bind in pack() too, under both rules."""
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, "the house " * rng.choice([1] * 12 + [40, 90])) for i in range(150)], "doc_id long, text string")
    for rule in ("norm", "dot"):
        for documents, attention in ((5, 20_000), (None, None)):
            held = collections.defaultdict(list)
            for r in packing.pack(docs, tokenizer_path(), 256, documents, attention, rule).collect():
                held[r["sequence_id"]].append(r["length"])
            most, cost = max(map(len, held.values())), max(sum(n * n for n in v) for v in held.values() if len(v) > 1)
            assert sum(map(len, held.values())) == 150
            assert (most <= 5 and cost <= 20_000) if documents else (most > 5), (rule, most, cost)


def test_exact_dedup_again_with_the_same_batch(spark):
    """A call made again keeps the same rows and appends nothing; a later batch loses to it; the index isn't shuffled."""
    index = exact_dedup.DigestIndex(spark)
    docs = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b"), (None, "c")], "doc_id long, text string")
    key = lambda r: str(tuple(r))
    once = sorted(exact_dedup.resolve(docs, index, batch="x").collect(), key=key)
    assert sorted(exact_dedup.resolve(docs, index, batch="x").collect(), key=key) == once and index.read().count() == 3
    assert [r["kept"] for r in exact_dedup.resolve(docs, index, batch="y").collect()] == [False] * 4
    entries = exact_dedup.store(docs.select(exact_dedup.digest_of(docs.text).alias("digest")), "entries")
    plan = index.unseen(entries)._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "SortMergeJoin" in plan and plan.count("Exchange") == 1  # that of the new digests
    index.compact()
    assert index.read().count() == 3 and sorted(exact_dedup.resolve(docs, index, batch="x").collect(), key=key) == once
    index.drop()


def test_texts_of_one_id_are_told_apart(spark):
    """A text that resembles nothing isn't lost with its namesake; columns keep their names."""
    long = " ".join(f"w{i}" for i in range(60))
    docs = rows_of(spark, [(5, long, "en"), (5, "quite another text that stands alone here", "en"), (3, long + " x", "en"), (5, long + " y", "en"), (9, "alone", "en"), (9, "ALONE", "en")])
    left = jaccard_join.keep_one(docs)
    assert left.columns == docs.columns and sorted((r["doc_id"], len(r["text"])) for r in left.collect()) == sorted([(5, 41), (3, len(long) + 2), (9, 5)])
    with pytest.raises(TypeError):
        jaccard_join.groups(docs.withColumn("doc_id", docs.host))


def test_trees_are_kept(spark):
    """Stored trees take edits without the text being encoded again."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    docs = spark.createDataFrame([(1, "word " * 5000, "x"), (2, None, "y"), (3, "", "z")], "doc_id long, text string, TREE string")
    planted = exact_dedup.store(token_counts.plant(docs, tokenizer_path(), tree="tree"), "trees")
    change = "array(named_struct('at', 7, 'remove', 2, 'insert', 'new words'))"
    edited = exact_dedup.store(token_counts.edit(planted.selectExpr("*", f"{change} AS edits"), tokenizer_path(), "edits"), "edited")
    for r in edited.collect():
        assert r["n_tokens"] == len(library.encode(r["text"], add_special_tokens=False).ids) and r["encoded_chars"] < 1000
    again = token_counts.count(edited, tokenizer_path(), tree="tree").collect()
    assert [r["n_tokens"] for r in sorted(again, key=lambda r: r["doc_id"])] == [r["n_tokens"] for r in sorted(edited.collect(), key=lambda r: r["doc_id"])] and all(r["first_chars"] == 0 for r in again)


def test_url_column_named_like_a_result(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x", "r"), (2, None, "r")], "page_id long, path string, RULE string")
    got = url_filter.judge(pages, url_filter.rules_frame(spark, URL_RULES), url="path").orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"]) for r in got] == [("a.net", "/x", "net/"), ("", "", None)]
