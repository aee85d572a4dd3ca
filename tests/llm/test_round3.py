"""Whitening, exact top-k, the Merkle manifest and joins of wide rows, against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from casemill.llm import lines, manifest, neardup, queries, rows, topk, whitening
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, path string, pos long"
NAN, INF = float("nan"), float("inf")


def vectors(spark, data):
    """embeddings with columns whose names operators use within."""
    return spark.createDataFrame([(k, v, 1, [1]) for k, v in data], "vec_id long, embedding array<double>, id int, x array<int>")


ODD = [(0, [0.5, -0.25, 0.1]), (50, [0.5, -0.25, 0.1]), (50, [0.1, 0.2, 0.3]), (100, None), (150, [None, 0.1, 0.2]), (200, [NAN, 0.0, 0.0]), (250, [INF, 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (7, [0.0, 0.0, 0.0]), (8, [-0.3, 0.4, 0.5]), (9, [0.5, -0.25, 0.1])]


# --- exact top-k


def slow_top_k(data, k, scale):
    taken = [(i, [int(np.floor(scale * c)) for c in v]) for i, v in data if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = Counter()
    for a, (i, v) in enumerate(taken):
        if i % 50 == 0:
            found = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), j) for b, (j, w) in enumerate(taken) if a != b)[:k]
            out.update((i, rank, j, -s) for rank, (s, j) in enumerate(found, 1))
    return out


def fast_top_k(spark, data, k, scale):
    got = topk.top_k(topk.integers(vectors(spark, data), "vec_id", "embedding", scale), F.col("id") % 50 == 0, k)
    return Counter((r["query_id"], r["rank"], r["id"], r["score"]) for r in got.collect())


def sparse_rows(n, seed=3):
    rng = random.Random(seed)
    return [(i, [rng.choice([0.0, 0.0, 0.0, rng.gauss(0, 1)]) for _ in range(rng.choice([0, 5, 12, 12]))]) for i in range(n)]


@pytest.mark.parametrize("shard", [40, 4096])
def test_top_k_equals_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(topk, "SHARD", shard)
    dense = [(i, np.random.default_rng(i % 40).normal(size=16).tolist()) for i in range(300)]  # with copies, so with ties
    for data in (dense, sparse_rows(400), ODD):
        assert fast_top_k(spark, data, 5, 256) == slow_top_k(data, 5, 256)


def test_top_k_of_few_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 4)
    for data in (ODD[:1], [], [(0, [0.0] * 4)] * 3 + [(i, [0.0] * 4) for i in range(1, 9)]):
        assert fast_top_k(spark, data, 5, 256) == slow_top_k(data, 5, 256)


def test_max_score_skips_rows_and_loses_none(monkeypatch):
    """With a k-th score known, most rows are neither added up nor probed to the end."""
    rng = np.random.default_rng(5)
    x = np.where(rng.random((2000, 40)) < 0.1, rng.integers(1, 90, (2000, 40)), 0)
    doc, term = np.nonzero(x)
    order = np.lexsort((doc, term))
    starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=40))])
    shard = topk.Shard(np.arange(2000), np.arange(2000), starts, doc[order], x[doc, term][order])
    q = np.where(rng.random(40) < 0.3, rng.integers(1, 90, 40), 0)
    q[np.flatnonzero(q)[:3]] = 1  # terms that add little
    scores = x @ q
    best = np.lexsort((np.arange(2000), -scores))[:5]
    touched = []
    probe = topk.Shard.probe
    monkeypatch.setattr(topk.Shard, "probe", lambda self, q, t, at, p: touched.append(len(at)) or probe(self, q, t, at, p))
    at, found = shard.search(q, -1, 5, int(scores[best[-1]]))
    assert dict(zip(at.tolist(), found.tolist(), strict=True)) == dict(zip(best.tolist(), scores[best].tolist(), strict=True))
    assert touched and max(touched) < 400
    assert shard.search(q, -1, 5, int(scores.max()) + 1)[0].size == 0


def test_a_score_that_fits_no_long_is_an_error():
    shard = topk.Shard(np.arange(1), np.arange(1), np.array([0, 1]), np.array([0]), np.array([1 << 40]))
    with pytest.raises(ValueError):
        shard.search(np.array([1 << 40]), -1, 5, None)


def test_top_k_broadcasts_no_copies_of_the_queries(spark):
    """A block goes to each shard, which its estimated size doesn't tell: broadcast, all copies met in the driver."""
    index = topk.stash(spark.createDataFrame([(0, [1], [1], [0, 1], [0], [1])], topk.POSTINGS), "index")
    asked = topk.stash(spark.createDataFrame([(1, 50, [1], None)], "uid long, id long, x array<long>, floor long"), "asked")
    assert "Broadcast" not in topk.searched(index, asked, 0, 99, 5)._jdf.queryExecution().executedPlan().toString()


# --- whitening


def test_whitening_equals_an_eigendecomposition(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(400, 12)) * np.arange(1, 13) @ np.linalg.qr(rng.normal(size=(12, 12)))[0]
    made = whitening.fit(whitening.integers(vectors(spark, list(enumerate(v.tolist()))), "vec_id", "embedding", 64, 1_000_000), 5)
    got = {r["id"]: r for r in made.apply().collect()}
    x = np.floor(64 * v).astype(np.int64) + 1_000_000
    c = x - x.mean(axis=0)
    e, u = np.linalg.eigh(c.T @ c / len(c))
    white = c @ u[:, ::-1][:, :5] / np.sqrt(e[::-1][:5])
    own = np.array([got[i]["whitened"] for i in range(400)])
    assert np.allclose(own * np.sign((own * white).sum(axis=0)), white, atol=1e-9)
    assert np.allclose(made.explained, e[::-1][:5] / e.sum()) and made.error < 1e-10
    assert [got[i]["deviation"] for i in range(400)] == ((400 * x - x.sum(axis=0)) ** 2).sum(axis=1).tolist()


def test_lobpcg_certifies_components_of_a_large_matrix():
    """More dimensions than the basis has columns, so it must iterate."""
    rng = np.random.default_rng(2)
    u = np.linalg.qr(rng.normal(size=(400, 400)))[0]
    values = np.concatenate([np.linspace(50, 10, 40), rng.random(360)])
    a, n = (u * values) @ u.T, []
    got = whitening.lobpcg(lambda block: n.append(block.shape[1]) or a @ block, 400, 16)
    assert np.allclose(got.values, np.sort(values)[::-1][:16], rtol=1e-12)
    assert np.linalg.norm(a @ got.vectors - got.vectors * got.values, axis=0).max() < 1e-10
    assert 3 < got.passes < 200 and max(n) <= 3 * (16 + whitening.GUARD)


def test_whitening_of_odd_rows(spark):
    def run(data, k=32):
        made = whitening.fit(whitening.integers(vectors(spark, data), "vec_id", "embedding", 64, 1_000_000), k)
        return made, made.apply().collect()

    made, got = run([*ODD, (11, [0.1]), (12, [])])
    assert Counter(r["id"] for r in got) == Counter([0, 50, 50, None, 7, 8, 9]) and made.n == 7
    assert all(len(r["whitened"]) == 3 for r in got) and made.error < 1e-10
    made, got = run([(1, [1.0, 2.0]), (2, [1.0, 3.0]), (3, [1.0, 4.0])])  # a dimension without variance
    assert [len(r["whitened"]) for r in got] == [1, 1, 1] and made.explained.tolist() == pytest.approx([1])
    made, got = run([(1, [1.0, 2.0])] * 4)
    assert [(r["deviation"], r["whitened"]) for r in got] == [(0, [])] * 4
    assert run([])[1] == [] and run([(1, None)])[1] == []
    made, got = run([(1, [1e9, 0.0]), (2, [-1e9, 1.0])])
    assert [r["deviation"] for r in got] == [None, None]


def test_whitening_query_on_given_rows(spark):
    got = queries.op11_whitening(spark, DATA).collect()
    assert len(got) == 32 * spark.read.parquet(f"{DATA}/embeddings.parquet").count() and got[0]["identity_error"] < 1e-4


# --- manifest


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def slow_leaf(r, text):
    return h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def slow_tree(nodes, paths):
    """nodes: (hash, leaves below); paths: leaf -> [(place, hashes of the run)]."""
    while len(nodes) > 1:
        above = []
        for i in range(0, len(nodes), 3):
            run = nodes[i : i + 3]
            for j, (_, below) in enumerate(run):
                for x in below:
                    paths[x].append((j, [a for a, _ in run]))
            above.append((h("".join(a for a, _ in run)), [x for _, below in run for x in below]))
        nodes = above
    return nodes[0]


def slow_manifest(docs):
    """The multiset of (doc_id, leaf, subroot, root, proof, folded root, verified)."""
    docs = [r.asDict() for r in docs]
    first = lambda x: (x is not None, x.encode() if isinstance(x, str) else x or 0)
    for k, r in enumerate(docs):
        r |= {"k": k, "leaf": slow_leaf(r, r["text"])}
        tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None
        r["claim"] = slow_leaf(r, r["text"].replace("\n", "")) if tampered else r["leaf"]
    paths, tops = {r["k"]: [] for r in docs}, []
    for s in sorted({r["source"] for r in docs}, key=first):
        own = sorted((r for r in docs if r["source"] == s), key=lambda r: (first(r["doc_id"]), r["leaf"]))
        top = slow_tree([(r["leaf"], [r["k"]]) for r in own], paths)
        tops.append(top)
        for r in own:
            r["subroot"] = top[0]
    root = slow_tree(tops, paths)[0] if tops else None
    out = Counter()
    for r in docs:
        f, others = r["claim"], []
        for j, run in paths[r["k"]]:
            f = h("".join(run[:j] + [f] + run[j + 1 :]))
            others += run[:j] + run[j + 1 :]
        out[r["doc_id"], r["leaf"], r["subroot"], root, h("".join(others)), f, f == root] += 1
    return out


def fast_manifest(docs):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    got = manifest.prove(manifest.manifest(docs, {"text": F.replace("text", F.lit("\n"), F.lit(""))}, tampered))
    cols = ("doc_id", "leaf", "subroot", "root", "folded_root", "verified")
    got = got.select(*cols, manifest.digest(F.array_join("siblings", "")).alias("proof")).collect()
    return Counter((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof"], r["folded_root"], r["verified"]) for r in got)


def test_manifest_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert fast_manifest(docs) == slow_manifest(docs.collect())


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_manifest_of_odd_rows_and_deep_trees(spark, monkeypatch, levels):
    monkeypatch.setattr(manifest, "LEVELS", levels)
    monkeypatch.setattr(manifest, "SPAN", 3**levels)
    rng = random.Random(4)
    data = [(None if i % 17 == 0 else i % 60, rng.choice([None, "", "a\nb", "ü\n", "x" * 5000]), rng.choice(["en", None]), rng.choice([None, "", "a", "ä", "big", "big", "big"]), rng.choice([None, 5]), "h", "p", i) for i in range(170)]
    data += [(5, "same\nrow", "en", "big", 1, "h", "p", 1)] * 40 + [(6, "alone", "en", "z", 1, "h", "p", 1)]
    docs = spark.createDataFrame(data, SCHEMA)
    got = fast_manifest(docs)
    assert got == slow_manifest(docs.collect()) and sum(got.values()) == 211
    assert fast_manifest(docs.limit(0)) == Counter()
    assert fast_manifest(docs.filter("source = 'z'")) == slow_manifest([r for r in docs.collect() if r["source"] == "z"])


# --- joins of wide rows


def test_without_equals_an_anti_join(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 700 if i % 9 else None, "t", i) for i in range(2000)], "doc_id long, block string, w0 long").withColumns({"__k": F.lit(1), "k": F.lit(2), "__row": F.lit(3)})
    keys = spark.range(0, 700, 3).withColumnRenamed("id", "k")
    want = sorted(docs.join(keys, docs.doc_id == keys["k"], "left_anti").collect(), key=str)
    for most in (rows.MOST_KEYS, 20):  # 20: a filter that nearly all rows pass
        monkeypatch.setattr(rows, "MOST_KEYS", most)
        assert sorted(rows.without(docs, {"k": F.col("doc_id")}, keys).collect(), key=str) == want
    assert rows.without(docs, {"k": F.col("doc_id")}, keys.limit(0)).count() == 2000


def test_numbers_of_a_hot_id(spark):
    """One id on a third of the rows, some of them equal: numbers are gapless, follow the texts, and no window holds the texts."""
    data = [(7 if i % 3 == 0 else i, f"text {i % 50}", i) for i in range(900)] + [(None, "a", 1), (None, "b", 2)]
    docs = spark.createDataFrame(data, "doc_id long, text string, __row long")
    made = rows.numbered(docs)
    got = made.collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((a, b) for a, b, _ in data)
    assert sorted(r["__row"] for r in got if r["doc_id"] == 7) == list(range(301 if any(i == 7 and i % 3 for i in range(900)) else 300))
    assert {r["__row"] for r in got if r["doc_id"] != 7} == {0}
    again = Counter((r["doc_id"], r["__row"], r["text"]) for r in rows.numbered(docs.repartition(5)).collect())
    assert again == Counter((r["doc_id"], r["__row"], r["text"]) for r in got)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_line_and_copy_removal_with_a_hot_id(spark):
    data = [(7 if i % 3 == 0 else i, f"alpha beta gamma delta number {i % 40}\nown line of row {i} and words {i * 7} {i * 11}") for i in range(120)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    made = lines.remove_lines(docs).collect()
    assert len(made) == 120 and sum("alpha" in r["text"] for r in made) == 40
    copies = spark.createDataFrame([(7, f"a b c d e f g {i % 5}") for i in range(50)] + [(i, f"h i j k l m {i}") for i in range(60, 90)], "doc_id long, text string")
    assert neardup.keep_one(copies).count() == 35


def test_removal_shuffles_no_whole_texts(spark):
    """What can't match goes by the sieve: the join sees the rows that lose a line only."""
    data = [(i, f"row {i} has words {i * 3} {i * 5} {i * 7} of its own") for i in range(300)] + [(300, "row 5 has words 15 25 35 of its own")]
    made = lines.remove_lines(spark.createDataFrame(data, "doc_id long, text string"))
    assert made.filter("text = ''").count() == 1 and made.count() == 301
    plan = made._jdf.queryExecution().toString()
    assert plan.count("Union") and "LeftAnti" in plan


def test_operators_restore_the_callers_settings(spark):
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    lines.remove_lines(spark.createDataFrame([(1, "a b c")], "doc_id long, text string")).count()
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == before
