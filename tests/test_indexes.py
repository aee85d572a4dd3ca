"""Phrases, bounded searches, bands, label lists, cached scores, batched models, sinks and packs against brute force."""

import dataclasses
import hashlib
import json
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from casemill.functions import predicates as P
from casemill.functions import text as X
from casemill.operators import batched, blocks, ivf, labels, pairs, phrases, postings, sparse, vectors
from casemill.plans import more
from casemill.plans import queries as Q
from casemill.sources import files, matrix, packs
from casemill.streaming.score_cache import ScoreCache
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"

# --- phrases


def slow_phrases(text, keywords):
    """Leftmost, then longest, none overlapping, by trying every keyword at every place."""
    text, known, out, at = phrases.normal(text), {phrases.normal(k) for k in keywords} - {""}, [], 0
    word = lambda i: 0 <= i < len(text) and re.fullmatch("[a-z0-9_]", text[i])
    inner = lambda i: word(i - 1) and word(i)
    while at < len(text):
        fits = [k for k in known if text.startswith(k, at) and not inner(at) and not inner(at + len(k))]
        if fits:
            best = max(fits, key=len)
            out.append((at, at + len(best), best))
            at += len(best)
        else:
            at += 1
    return out


@pytest.mark.parametrize("chars", [7, 1 << 20])
def test_phrases_equal_brute_force(spark, monkeypatch, chars):
    monkeypatch.setattr(phrases, "CHARS", chars)
    rng = random.Random(3)
    keywords = ["a", "a b", "a b c", "b c d", "c", "盗窃", "盗窃罪", "罪", "été", "ét", "x_1", "ab", " ", "B  C", "ß", "é b"]
    alphabet = ["a", "b", "c", "d", " ", "  ", "\n", "盗窃", "罪", "盗", "été", "é", "x_1", "_", "ß", "A", "C", ".", "🙂"]
    texts = [None, "", " \n", "a", "盗窃罪a盗窃", "a b c d", "a b b c d", "xab ab", *("".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(150))]
    rows = spark.createDataFrame(list(enumerate(texts)), "case_id long, fact string")
    got = phrases.phrase_matches(rows, keywords).collect()
    want = {i: slow_phrases(t, keywords) for i, t in enumerate(texts)}
    for i in want:
        own = sorted((r["place"], r["start"], r["end"], r["keyword"]) for r in got if r["case_id"] == i)
        assert [(s, e, k) for _, s, e, k in own] == want[i] and [p for p, *_ in own] == list(range(len(own)))
    counts = Counter({(r["case_id"], r["keyword"]): r["n"] for r in phrases.phrase_counts(rows, keywords).collect()})
    assert counts == Counter((i, k) for i, ms in want.items() for _, _, k in ms) and sum(counts.values()) > 300


def test_phrases_of_empty_lexicons_and_tables(spark):
    rows = spark.createDataFrame([(1, "a b")], "case_id long, fact string")
    assert phrases.phrase_counts(rows, []).count() == 0 and phrases.phrase_counts(rows.limit(0), ["a"]).count() == 0
    long = spark.createDataFrame([(1, "x y " * 100_000)], "case_id long, fact string")
    assert [(r["keyword"], r["n"]) for r in phrases.phrase_counts(long, ["y x", "x"]).collect()] == [("x", 1), ("y x", 99_999)]
    made = phrases.by_class(phrases.phrase_counts(rows, ["a", "B"]), {"one": ["a"], "two": ["A", "b"]}).first()
    assert (made["crime_counts"], made["details"]["two"], made["keyword_counts"]) == ({"one": 1, "two": 2}, {"a": 1, "b": 1}, {"a": 1, "b": 1})


# --- sparse search with bounds


@pytest.mark.parametrize("shard", [100, 8192])
def test_sparse_search_equals_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(postings, "SHARD", shard)
    rng = np.random.default_rng(2)
    data = [(i, (d := rng.choice(60, size=rng.integers(0, 9), replace=False)).tolist(), rng.random(len(d)).round(3).tolist()) for i in range(700)]
    data += [(1000 + i, [3, 4], [0.5, 0.5]) for i in range(200)]  # ties
    rows = spark.createDataFrame(data, "case_id long, dims array<long>, weights array<double>")
    m = np.zeros((len(data), 60))
    for k, (_, d, w) in enumerate(data):
        m[k, d] = w
    ids = np.array([i for i, *_ in data])
    want = set()
    for k in np.flatnonzero(ids % 20 == 0):
        score = np.round(m @ m[k], 6)
        score[k] = 0
        best = [j for j in np.lexsort((ids, -score))[:5] if score[j] > 0]
        want |= {(int(ids[k]), int(ids[j]), round(float(score[j]), 5), r) for r, j in enumerate(best, 1)}
    got = postings.search(postings.build(rows), rows.filter("case_id % 20 = 0"), 5).collect()
    assert {(r["query_id"], r["case_id"], round(r["score"], 5), r["rank"]) for r in got} == want
    assert postings.search(postings.build(rows), rows.limit(0), 5).count() == 0


def test_sparse_search_skips_blocks(spark):
    data = [(i, [i % 50, 100 + i % 7], [0.99, 0.1]) for i in range(8000)]
    rows = spark.createDataFrame(data, "case_id long, dims array<long>, weights array<double>")
    got = postings.search(postings.build(rows), rows.filter("case_id < 20"), 5).agg(F.max("scored")).first()[0]
    assert got < 2000


def test_searches_make_no_cartesian_product(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for made in (Q.dense_topk(spark, DATA), Q.sparse_topk(spark, DATA)):
            made.collect()
            assert "Cartesian" not in made._jdf.queryExecution().toString() and "NestedLoop" not in made._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_searches_broadcast_no_copies_of_the_queries(spark):
    """Blocks go to each part or shard, which their estimated size doesn't tell: broadcast, all copies met in the driver."""
    for made in (Q.dense_topk(spark, DATA), Q.sparse_topk(spark, DATA)):
        made.collect()
        assert "BroadcastHashJoin" not in made._jdf.queryExecution().toString()


@pytest.mark.parametrize("cells", [0, 1 << 23])
def test_matrices_and_postings_find_the_same(monkeypatch, cells):
    """Shards as a matrix and as postings: brute force, ties by id, whatever the blocks, and rows left out by bounds."""
    monkeypatch.setattr(postings, "BLOCK", 8)
    monkeypatch.setattr(postings, "CELLS", cells)
    rng = np.random.default_rng(6)
    m = np.where(rng.random((330, 30)) < 0.15, rng.random((330, 30)).round(2), 0)
    m[40:60] = m[20:40]
    ids = rng.permutation(1000)[:330]
    t = pa.table({"part": [0] * 330, "case_id": ids, "dims": [np.flatnonzero(r).tolist() for r in m], "weights": [r[r > 0].tolist() for r in m]}, pa.schema({"part": pa.int32(), "case_id": pa.int64(), "dims": pa.list_(pa.int64()), "weights": pa.list_(pa.float64())}))
    one = postings.shard_index(t)
    shard = postings.Shard(*(one[f.name].combine_chunks().flatten().to_numpy() for f in dataclasses.fields(postings.Shard)))
    assert postings.Cells.fits(shard) == (cells > 0)
    asked = [*range(0, 330, 5)]
    q = [(np.flatnonzero(m[i]), m[i][m[i] > 0]) for i in asked]
    if cells:
        ends = np.cumsum([0, *(len(d) for d, _ in q)])
        found, scored = postings.Cells(shard).search(ids[asked], ends, np.concatenate([d for d, _ in q]), np.concatenate([w for _, w in q]), 4)
        got = sorted(zip(*(found[c].to_pylist() for c in ("query_id", "case_id", "score")), strict=True))
    else:
        made = [(ids[i], *shard.search(d, w, ids[i], 4)) for i, (d, w) in zip(asked, q, strict=True)]
        got, scored = sorted((int(o), int(c), float(s)) for o, cs, ss, _ in made for c, s in zip(cs, ss, strict=True)), np.array([n for *_, n in made])
    want = []
    for i in asked:
        score = np.round(m @ m[i], 6)
        score[i] = 0
        want += [(int(ids[i]), int(ids[j]), float(score[j])) for j in np.lexsort((ids, -score))[:4] if score[j] > 0]
    assert [x[:2] for x in got] == [x[:2] for x in sorted(want)] and np.allclose([x[2] for x in got], [x[2] for x in sorted(want)])
    assert scored.max() <= 330 and scored.mean() < 300


@pytest.mark.parametrize("part", [200, 1 << 21])
def test_dense_search_keeps_k_rows_of_a_part(spark, monkeypatch, part):
    """Equal to brute force with ties, over parts and groups; and no more than k rows of a part leave its task."""
    monkeypatch.setattr(blocks, "PART", part)
    monkeypatch.setattr(blocks, "LEAST_PART", part)
    monkeypatch.setattr(blocks, "GROUP", 7)
    monkeypatch.setattr(blocks, "SLICE", 16)
    rng = np.random.default_rng(4)
    v = rng.normal(size=(300, 4)).round(1)
    v[100:150] = v[50:100]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "case_id long, v array<double>").repartition(5)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = set()
    for q in range(0, 300, 20):
        score = np.round(u @ u[q], 6)
        score[q] = -np.inf
        want |= {(q, int(j), r) for r, j in enumerate(np.lexsort((np.arange(300), -score))[:6], 1)}
    got = blocks.exact_top_k(rows, rows.filter("case_id % 20 = 0"), 6)
    assert {(r["query_id"], r["case_id"], r["rank"]) for r in got.collect()} == want
    assert blocks.exact_top_k(rows, rows.limit(0), 6).count() == blocks.exact_top_k(rows.limit(0), rows.limit(3), 6).count() == 0
    best = blocks.Best(np.array([0, 20]), 6, -np.inf)
    for at in range(0, 300, 16):
        best.add(np.round(u[[0, 20]] @ u[at : at + 16].T, 6), np.arange(at, min(at + 16, 300)))
    assert best.rows().num_rows == 12


def test_matrix_rows_are_of_length_one(spark):
    rows = spark.createDataFrame([(1, "the the and 123"), (2, None), (3, "")], "case_id long, fact string")
    got = {r["case_id"]: {x["dim"]: x["weight"] for x in r["cells"]} for r in sparse.matrix_rows(rows).collect()}
    assert set(got) == {1} and got[1]["kw:the"] == pytest.approx(2 * got[1]["kw:and"]) and sum(w * w for w in got[1].values()) == pytest.approx(1)


# --- cells


def clustered(spark, n=20_000, d=32, groups=60):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(groups, d))
    v = centres[rng.integers(groups, size=n)] + 0.25 * rng.normal(size=(n, d))
    return spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "case_id long, v array<double>")


def test_coded_search_of_clustered_vectors(spark, tmp_path):
    """About sqrt(n) cells, a tenth of the rows at most, recall of 0.9, and far fewer cells searched exactly."""
    clustered(spark).write.parquet(str(tmp_path / "v"))
    e = spark.read.parquet(str(tmp_path / "v"))
    q = e.filter("case_id % 400 = 0")
    index = ivf.load_or_build(e, str(tmp_path / "index"))
    told = index.cells.agg(F.count("*"), F.sum("n"), F.max("probes")).first()
    assert 100 <= told[0] <= 160 and told[1] == 20_000
    exact = {tuple(r) for r in blocks.exact_top_k(e, q, 10).collect()}
    true = {x[:2] for x in exact}
    began = time.perf_counter()
    found = {(r["query_id"], r["case_id"]) for r in ivf.search(index, q, 10).collect()}
    print("search", time.perf_counter() - began)
    share = ivf.nearest_cells(index, q, told[2]).join(index.cells, "cell").agg(F.sum("n")).first()[0] / 20_000 / 50
    print("recall", len(found & true) / len(true), "rows scored", share, "probes", told[2])
    assert len(found & true) >= 0.9 * len(true) and share <= 0.1
    same, cells = ivf.search_exactly(index, q, 10)
    assert {tuple(r) for r in same.collect()} == exact
    assert cells.count() < 0.5 * 50 * told[0]


def test_cells_of_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(ivf, "PART_ROWS", 10)
    rows = [(i, [float(i % 5), 1.0, 0.0]) for i in range(90)] + [(100, [0.0, 0.0, 0.0]), (120, None), (140, [0.0, 0.0, 0.0])]
    e = spark.createDataFrame(rows, "case_id long, v array<double>")
    q = e.filter("case_id % 20 = 0 and v is not null")
    index = ivf.build(e)
    exact = {tuple(r) for r in vectors.exact_top_k(e.filter("v is not null"), q, 6).collect()}
    assert {tuple(r) for r in ivf.search_exactly(index, q, 6)[0].collect()} == exact
    assert index.cells.agg(F.max("parts")).first()[0] > 1
    none = ivf.build(e.limit(0))
    assert ivf.search(none, q, 3).count() == 0 and ivf.search_exactly(none, q, 3)[0].count() == 0


# --- bands and label lists


def test_band_join_makes_no_pair_outside_the_band(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([["a"], ["a", "b"], ["b"]]), ["r"], rng.random() < 0.1, rng.random() < 0.1, rng.choice([0, 1, 2, 3, 7, 10, 36, 37, 120, 300, rng.randrange(400)])) for i in range(400)]
    cases = spark.createDataFrame(rows, "case_id long, accusation array<string>, articles array<string>, death boolean, life boolean, months long")
    every = pairs.profile_pairs(cases)
    free = ~(F.col("q_death") | F.col("q_life"))
    for band, keep in ((pairs.ratio_band, P.months_ratio("q", "c") <= 0.3), (pairs.tolerance_band, P.within_tolerance("q", "c"))):
        got = pairs.band_pairs(cases, band)
        made = sorted(tuple(r) for r in got.select("q_profile", "c_profile").collect())
        want = every.filter(P.flags_equal("q", "c") & (~free | keep))
        assert made == sorted(tuple(r) for r in want.select("q_profile", "c_profile").collect()) and made


def test_tolerance_differs_from_the_ratio(spark):
    """Terms of 100 and 125 months agree by three tenths and not by a fifth: imprisonment is judged by the latter."""
    rows = [(100, 125, False), (100, 120, True), (10, 16, True), (10, 17, False)]
    names = ", ".join(f"{s}_accusation array<string>, {s}_articles array<string>, {s}_death boolean, {s}_life boolean, {s}_months long" for s in "qc")
    for q, c, want in rows:
        one = spark.createDataFrame([([], [], False, False, q, [], [], False, False, c)], names)
        assert one.select(P.within_tolerance("q", "c")).first()[0] is want
    source = __import__("inspect").getsource(__import__("casemill.plans.more", fromlist=["x"]).imprisonment_metrics)
    assert "within_tolerance" in source


def test_encoded_ids():
    for ids in ([], [0], [5, 6, 300, 20_000, 65_535], list(range(0, 65_536, 2))):
        assert labels.decoded(labels.encoded(np.array(ids, np.int64))).tolist() == ids
    assert len(labels.encoded(np.arange(0, 65_536, 2))) == 32_768


def test_label_lists_are_merged(spark):
    rng = random.Random(6)
    rows = [(i * 997 - 50_000, rng.choices(["a", "b", "c", None], k=3)) for i in range(500)] + [(None, ["a"]), (70, []), (71, None)]
    cases = spark.createDataFrame(rows, "case_id long, accusation array<string>")
    sets = spark.createDataFrame([(1, ["a"]), (2, ["a", "b", "a"]), (3, ["a", "b", "c"]), (4, ["z"]), (5, []), (6, ["a", "z"])], "k long, l array<string>")
    got = labels.merged(sets, labels.postings(cases), "k", "l")
    for which, test in (("of_any", any), ("of_all", all)):
        made = {}
        for r in labels.listed(got, "k", which).collect():
            made.setdefault(r["k"], []).append(r["case_id"])
        want = {k: sorted(i for i, own in rows if i is not None and test(x in (own or []) for x in l)) for k, l in [(1, ["a"]), (2, ["a", "b"]), (3, ["a", "b", "c"]), (6, ["a", "z"])]}
        assert {k: sorted(v) for k, v in made.items()} == {k: v for k, v in want.items() if v}


# --- scores


def test_a_killed_batch_counts_once(spark, tmp_path, monkeypatch):
    """A batch that dies between write and commit is written anew when the stream starts again."""
    source, path = str(tmp_path / "in"), str(tmp_path / "cache")
    schema = "cache_key string, score double, order long"
    spark.createDataFrame([("a", 1.0, 1), ("a", 2.0, 2), ("b", 5.0, 1), (None, 9.0, 1)], schema).coalesce(1).write.parquet(source)
    cache, stream = ScoreCache(spark, path), lambda: spark.readStream.schema(schema).parquet(source)
    commit, died = ScoreCache._commit, []

    def dies(self, name):
        died.append(name)
        raise RuntimeError("killed before the commit")

    monkeypatch.setattr(ScoreCache, "_commit", dies)
    with pytest.raises(Exception, match="killed"):
        cache.follow(stream(), str(tmp_path / "ckpt")).awaitTermination()
    assert died == ["0"] and cache.read().count() == 0
    monkeypatch.setattr(ScoreCache, "_commit", commit)
    cache.follow(stream(), str(tmp_path / "ckpt")).awaitTermination()
    assert {tuple(r) for r in cache.read().collect()} == {("a", 2.0, 0), ("b", 5.0, 0)}
    spark.createDataFrame([("a", 0.5, 1), ("c", 1.0, 1)], schema).coalesce(1).write.mode("append").parquet(source)
    cache.follow(stream(), str(tmp_path / "ckpt")).awaitTermination()
    want = {("a", 0.5, 1), ("b", 5.0, 0), ("c", 1.0, 1)}
    assert {tuple(r) for r in cache.read().collect()} == want
    cache.compact()
    assert {tuple(r) for r in cache.read().collect()} == want and cache.committed() == []
    cache.upsert(spark.createDataFrame([("b", 0.0)], "cache_key string, score double"), 7)
    assert {tuple(r) for r in cache.read().collect()} == {("a", 0.5, 1), ("b", 0.0, 7), ("c", 1.0, 1)}
    asked = spark.createDataFrame([("a",), ("q",)], "cache_key string")
    assert [r["cache_key"] for r in cache.misses(asked).collect()] == ["q"]


def lengths():
    """A model made within a function, so that workers needn't import this file."""

    class Lengths:
        kind, default = "long", -1

        def load(self):
            self.loaded = True

        def run(self, inputs):
            assert self.loaded
            if any(t is None or "bad" in t for (t,) in inputs):
                raise ValueError
            return [len(t) for (t,) in inputs]

    return Lengths()


def test_models_in_batches(spark):
    assert list(batched.batches_of([3, 9, 1, 9], 2, 100)) == [[1, 3], [0, 2]] and list(batched.batches_of([50, 60, 1], 9, 60)) == [[1], [0], [2]]
    rows = spark.createDataFrame([(1, "abc"), (2, "a bad one"), (3, None), (4, ""), (5, "x" * 9)], "case_id long, fact string")
    got = {r["case_id"]: (r["n"], r["n_failed"]) for r in batched.apply(rows, lengths(), ["fact"], "n").collect()}
    assert got == {1: (3, False), 2: (-1, True), 3: (-1, True), 4: (0, False), 5: (9, False)}
    assert batched.apply(rows.limit(0), lengths(), ["fact"], "n").count() == 0


def test_prompts(spark):
    row = spark.range(1).select(batched.prompt(F.lit("x"), {"x": "A {text} {refs} {text}", "other": "B"}, text=F.lit("{refs}"), refs=F.lit(None).cast("string")).alias("p"), batched.prompt(F.lit("y"), {"x": "A", "other": "B {refs}"}, text=F.lit("t"), refs=F.lit("r")).alias("o")).first()
    assert (row["p"], row["o"]) == ("A {refs}  {refs}", "B r")


# --- sinks, packs, tokens


def test_matrix_blocks_are_pruned(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(matrix, "ROWS", 16)
    rows = spark.range(400).select(F.col("id").alias("case_id"), F.array(F.struct(F.lit("a").alias("dim"), F.col("id").cast("double").alias("weight")), F.struct(F.concat(F.lit("b"), F.col("id") % 3).alias("dim"), F.lit(1.0).alias("weight"))).alias("cells"))
    path = str(tmp_path / "m")
    matrix.write_matrix(rows, path)
    want = {(r["case_id"], x["dim"], x["weight"]) for r in rows.collect() for x in r["cells"]}
    assert {tuple(r) for r in matrix.read_matrix(spark, path).collect()} == want
    part = matrix.read_matrix(spark, path, 100, 120)
    assert {tuple(r) for r in part.collect()} == {x for x in want if 100 <= x[0] <= 120}
    assert "GreaterThanOrEqual(last,100)" in part._jdf.queryExecution().toString()
    matrix.write_matrix(rows.limit(0), str(tmp_path / "none"))
    assert matrix.read_matrix(spark, str(tmp_path / "none")).count() == 0


def test_packs_from_files(spark, tmp_path):
    good = {"g": {"a": {"type": "keyword", "keywords": ["x"]}, "b": {"deep": {"type": "mapping", "mappings": {"l": ["y"]}}}}}
    (tmp_path / "good.json").write_text(json.dumps(good))
    (tmp_path / "bad.json").write_text("{oops")
    pack = packs.read_pack(spark, str(tmp_path / "good.json"))
    assert set(pack.rules) == {"g_a", "g_b_deep"} and not pack.problems
    assert set(packs.read_pack(spark, str(tmp_path / "bad.json")).problems) == {"pack"}
    assert packs.compiled([1]).problems == {"pack": "not a map"}
    bad = packs.compiled({"r": {"type": "regex", "patterns": ["["]}, "m": {"type": "mapping", "mappings": {"l": []}}, "n": 5, "a b": {"type": "keyword", "keywords": ["k"]}})
    assert not bad.rules and set(bad.problems) == {"r", "m", "n", "a b"} and packs.problems(spark, bad).count() == 4
    got = sparse.features(spark.createDataFrame([(1, "x y")], "case_id long, fact string"), pack.rules).first()
    assert (got["g_a"], got["g_b_deep"]) == ("true", "l")


def test_tokens_have_offsets_and_cuts_are_prefixes(spark):
    texts = ["one two, three", "  lead", "盗窃罪 and 12", "", None, "!?", "ünï_x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", "text", X.token_spans()(F.col("text")).alias("s"), X.cut_at_token(F.col("text"), 2).alias("cut"))
    got = {r["id"]: r for r in rows.collect()}
    assert [[texts[i][s["start"] : s["end"]] for s in got[i]["s"]] for i in (0, 2, 6)] == [["one", "two", "three"], ["盗", "窃", "罪", "and", "12"], ["ünï", "x"]]
    assert [got[i]["cut"] for i in range(7)] == ["one two", "  lead", "盗窃", "[EMPTY]", "[EMPTY]", "[EMPTY]", "ünï_x"]
    assert all(got[i]["s"] == [] for i in (3, 4, 5))


def test_tokens_are_cut_from_a_text_at_once(spark):
    """As a substring for each span gives them, rows of one id merged by place; and no row for each token, which carried the whole text."""
    texts = [(1, "one two, three"), (2, "盗窃罪 and 𝒳𝒴 12"), (3, ""), (4, None), (5, "!?"), (6, "b c"), (6, "a d e")]
    spans = spark.createDataFrame(texts, "doc_id long, text string").select("doc_id", "text", X.token_spans()(F.col("text")).alias("spans"))
    got = {r["doc_id"]: r for r in more.joined_tokens(spans.select("doc_id", X.tokens_at(F.col("text"), F.col("spans")).alias("tokens"))).collect()}
    want = {1: ["one", "two", "three"], 2: ["盗", "窃", "罪", "and", "𝒳𝒴", "12"], 6: ["a", "b", "c", "d", "e"]}
    assert {k: (r["n_tokens"], r["n_chars"], r["tokens"]) for k, r in got.items()} == {k: (len(w), len("".join(w)), hashlib.md5(" ".join(w).encode()).hexdigest()) for k, w in want.items()}
    assert "posexplode" not in more.token_spans(spark, DATA)._jdf.queryExecution().toString()


def test_reports_and_splits(spark, tmp_path):
    files.write_report("title", spark.createDataFrame([(2, None), (1, 0.5)], "k int, p double"), str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r"), wholetext=True).first()["value"] == "title\nk: 1, p: 0.5\nk: 2, p: -\n"
    files.write_split(spark.range(5).select("id", F.rand().alias("x")), F.col("x") < 0.5, str(tmp_path / "y"), str(tmp_path / "n"))
    assert spark.read.parquet(str(tmp_path / "y")).count() + spark.read.parquet(str(tmp_path / "n")).count() == 5
