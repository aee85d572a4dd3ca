"""Edge semantics of predicates, scores, text functions, sources and sinks."""

import hashlib
import json

import pytest
from casemill.functions import predicates as P
from casemill.functions import scoring as S
from casemill.functions import text as X
from casemill.operators import ivf, metrics, models, pairs, vectors
from casemill.schema import normalize_cases
from casemill.sources import files
from casemill.streaming.incremental import append_available
from pyspark.sql import functions as F


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def arr(*xs):
    return F.array(*map(F.lit, xs)).cast("array<string>")


def pair(spark, q=0, c=0, qa=("a",), ca=("a",), qr=("r",), cr=("r",), qd=False, cd=False, ql=False, cl=False):
    row = (list(qa), list(qr), qd, ql, q, list(ca), list(cr), cd, cl, c)
    names = ", ".join(f"{s}_accusation array<string>, {s}_articles array<string>, {s}_death boolean, {s}_life boolean, {s}_months long" for s in "qc")
    return spark.createDataFrame([row], names)


def test_sets(spark):
    assert one(spark, P.same_set(arr("a", "b"), arr("b", "a", "a"))) and one(spark, P.same_set(arr(), arr()))
    assert not one(spark, P.overlap(arr(), arr()))


@pytest.mark.parametrize(("q", "c", "want"), [(0, 6, True), (0, 7, False), (60, 72, True), (60, 73, False)])
def test_tolerance(spark, q, c, want):
    assert pair(spark, q, c).select(P.within_tolerance("q", "c")).first()[0] is want


def test_flags_outweigh_months(spark):
    assert pair(spark, 0, 99, qd=True, cd=True).select(P.within_tolerance("q", "c")).first()[0]


@pytest.mark.parametrize(("kw", "want"), [({}, 1), ({"q": 10, "c": 11}, 2), ({"q": 10, "c": 13}, 3), ({"q": 10, "c": 13, "cr": ("r", "s")}, 4), ({"q": 10, "c": 13, "ca": ("a", "z"), "cr": ("r", "s")}, 5), ({"cd": True}, 0)])
def test_levels(spark, kw, want):
    assert pair(spark, **kw).select(P.similarity_level("q", "c")).first()[0] == want


@pytest.mark.parametrize(("s", "want"), [(0.55, 0), (0.65, 5), (0.7, 5), (0.75, 10), (0.8, 15), (0.9, 25), (0.95, 30), (0.699, 9.9)])
def test_ramp(spark, s, want):
    assert one(spark, S.embedding_ramp(F.lit(s))) == pytest.approx(want)


@pytest.mark.parametrize(("q", "c", "want"), [(0, 12, 5), (0, 13, 0), (10, 9, 10), (10, 7, 7), (10, 5, 4), (10, 4, 1)])
def test_terms(spark, q, c, want):
    assert pair(spark, q, c).select(S.term_score("q", "c")).first()[0] == want


def test_scores(spark):
    assert one(spark, S.keyword_score(arr("a", "b"), arr("b", "c"), arr("x"), arr("x"))) == 20
    assert one(spark, S.keyword_score(arr(), arr("b"), arr(), arr())) == 0
    assert one(spark, S.label_score(arr(), arr())) == 15 and one(spark, S.label_score(arr(), arr("a"))) == 0
    assert pair(spark, qd=True, cd=True, ql=True).select(S.term_score("q", "c")).first()[0] == 10


def test_text(spark):
    assert one(spark, X.text_hash(F.lit("　ab　"))) == one(spark, X.text_hash(F.lit("ab")))
    assert one(spark, X.parsed_prediction(F.lit("so\nlabel：theft \nmore"), "label")) == "theft"
    assert one(spark, X.parsed_prediction(F.lit(" none "), "label")) == "none"
    assert one(spark, X.first_filled(F.lit(""), F.lit(None).cast("string"), F.lit("c"))) == "c"
    rule = X.Rule("m", "mapping", labels={"first": ["b"], "second": ["a"]})
    assert one(spark, rule.column(F.lit("a b"))) == "first" and one(spark, rule.column(F.lit("z"))) is None
    assert one(spark, X.Rule("d", "regex", [r"\d+"]).column(F.lit("１"))) == "true"


def test_fuzzy_names():
    names = ["theft", "robbery by force", "fraud"]
    assert [models.best_name(x, names) for x in ("theft", "thefft", "robbery", "zzz", None)] == ["theft", "theft", "robbery by force", "zzz", None]


def test_first_wins_and_ranks(spark):
    rows = spark.createDataFrame([(1, "x ", 0, 1), (1, "x", 1, 1), (1, " ", 0, 2), (1, "y", 1, 2)], "q long, t string, src int, r int")
    got = pairs.first_wins(rows, "q", F.trim("t"), F.col("src"), F.col("r")).collect()
    assert {(r["t"], r["src"]) for r in got} == {("x ", 0), ("y", 1)}


def test_metrics_skip_short_queries(spark):
    hits = spark.createDataFrame([(1, r, 1, 2) for r in range(1, 5)], "query_id long, rank int, hit int, n_positive long")
    got = {r["k"]: r for r in metrics.retrieval_metrics(hits, [3, 5, 10]).collect()}
    assert set(got) == {3} and got[3]["recall"] == 1.5
    f = spark.createDataFrame([("a", "a"), ("a", "b")], "truth string, predicted string")
    r = metrics.accuracy_and_macro_f1(f).first()
    assert (r["accuracy"], r["macro_f1"], r["macro_f1_true"]) == (0.5, pytest.approx(1 / 3), pytest.approx(2 / 3))


def test_clustered_search_with_all_cells_is_exact(spark):
    e = vectors.as_double(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"))
    q = pairs.queries_of(e)
    exact = {tuple(r) for r in vectors.exact_top_k(e, q, 5).collect()}
    index = ivf.build(e, cells=8)
    assert {tuple(r) for r in ivf.search_exactly(index, q, 5)[0].collect()} == exact
    assert len({tuple(r) for r in ivf.search(index, q, 5, probes=8).collect()} & exact) > 0.95 * len(exact)
    some = {tuple(r) for r in ivf.search(index, q, 5, probes=4).collect()}
    assert len(some & exact) > 0.5 * len(exact)


def test_saved_index_with_split_cells(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ivf, "PART_ROWS", 10)
    e = vectors.as_double(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"))
    same = e.unionByName(e.filter("case_id = 7").select(F.explode(F.sequence(F.lit(100_001).cast("long"), F.lit(100_060).cast("long"))).alias("case_id"), "v"))
    q = pairs.queries_of(e)
    made = ivf.load_or_build(same, str(tmp_path / "model-v1"), cells=4)
    again = ivf.load_or_build(same.limit(0), str(tmp_path / "model-v1"), cells=4)
    assert made.cells.agg(F.max("parts")).first()[0] > 5 and again.cells.count() == 4
    exact = {tuple(r) for r in vectors.exact_top_k(same, q, 5).collect()}
    assert {tuple(r) for r in ivf.search_exactly(again, q, 5)[0].collect()} == exact
    assert ivf.search(again, q.limit(0), 5).count() == 0


def test_clustered_search_reaches_recall(spark):
    e = vectors.as_double(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"))
    q = pairs.queries_of(e)
    exact = {(r["query_id"], r["case_id"]) for r in vectors.exact_top_k(e, q, 10).collect()}
    found = {(r["query_id"], r["case_id"]) for r in ivf.top_k(e, q, 10).collect()}
    print("recall@10", len(found & exact) / len(exact))
    assert len(found & exact) >= 0.9 * len(exact)


def test_sources_and_sinks(spark, tmp_path):
    good = [json.dumps({"case_id": i, "fact": "f", "meta": {"accusation": ["b", "a", None, "a"]}}) for i in (1, 2)]
    (tmp_path / "bad.jsonl").write_text("\n".join([good[0], "", "{oops", good[1]]))
    got = normalize_cases(files.read_cases(spark, str(tmp_path / "bad.jsonl"), lenient=True)).collect()
    assert [(r["case_id"], r["accusation"], r["months"], r["death"]) for r in got] == [(1, ["a", "b"], 0, False), (2, ["a", "b"], 0, False)]
    (tmp_path / "all.json").write_text("[" + ",".join(good) + "]")
    assert files.read_records(spark, str(tmp_path / "all.json")).count() == 2
    (tmp_path / "lex.json").write_text('{"c": ["k", "l"],\n "d": ["k"]}')
    assert files.read_lexicon(spark, str(tmp_path / "lex.json")).count() == 3
    (tmp_path / "list.txt").write_text(" a \n\nb\n")
    assert [r["value"] for r in files.read_list(spark, str(tmp_path / "list.txt")).collect()] == ["a", "b"]
    sink = str(tmp_path / "sink")
    assert [files.append_new(spark.range(n), "id", sink) for n in (3, 5, 5)] == [3, 2, 0]
    files.write_split(spark.range(5), F.col("id") > 2, str(tmp_path / "yes"), str(tmp_path / "no"))
    assert spark.read.parquet(str(tmp_path / "no")).count() == 3
    for n in (1, 2):
        append_available(spark, sink, spark.range(1).schema, str(tmp_path / "out"), str(tmp_path / "ckpt"), "id")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def crowded(spark, n=300):
    """Cases of few profiles: one label in all of them."""
    rows = [(i, ["a", "b"] if i % 7 == 0 else ["a"], ["r"] if i % 5 else ["r", "s"], False, i % 11 == 0, 10 + i % 3) for i in range(n)]
    return rows, spark.createDataFrame(rows, "case_id long, accusation array<string>, articles array<string>, death boolean, life boolean, months long")


def turn(i):
    return hashlib.md5(f"7:{i}".encode()).hexdigest()


def test_candidates_are_capped_for_each_label(spark):
    rows, cases = crowded(spark)
    want = set()
    for q in rows[::20]:
        for label in q[1]:
            others = sorted((c[0] for c in rows if label in c[1] and c[0] != q[0]), key=turn)
            want |= {(q[0], c) for c in others[:9]}
    got = [tuple(r) for r in pairs.label_pairs(cases, 9).select("q_id", "c_id").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_closest_by_profiles_equal_all_pairs(spark):
    rows, cases = crowded(spark)
    level = P.similarity_level("q", "c").alias("level")
    near = pairs.profile_pairs(cases).select("q_profile", "c_profile", level).filter("level > 0")
    got = [tuple(r) for r in pairs.level_top(near, cases, 12).collect()]
    q, c = pairs.side(pairs.queries_of(cases), "q"), pairs.side(cases, "c")
    every = [tuple(r) for r in q.join(c, F.col("q_id") != F.col("c_id")).select("q_id", "c_id", level).filter("level > 0").collect()]
    want = []
    for i in range(0, 300, 20):
        best = sorted((x for x in every if x[0] == i), key=lambda x: (x[2], turn(x[1])))[:12]
        want += [(*x, k + 1) for k, x in enumerate(best)]
    assert sorted(got) == sorted(want)
    assert pairs.level_top(near.limit(0), cases, 12).count() == 0 and pairs.label_pairs(cases.limit(0), 3).count() == 0
