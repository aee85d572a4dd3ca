"""Queries over the driver's tables, one for each operator or composed pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import scoring as S
from ..functions import text as X
from ..operators import ivf, metrics, mining, models, pairs, sparse, vectors
from ..schema import cases, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def embeddings(spark, d):
    return vectors.as_double(table(spark, d, "embeddings"))


def labelled(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("case_id"), "label", F.col("embedding").cast("array<double>").alias("v"))


@query
def dense_topk(spark, d):
    e = embeddings(spark, d)
    return vectors.exact_top_k(e, pairs.queries_of(e), 10)


@query
def dense_topk_dedup(spark, d):
    """Over-fetch min(3k, 100), first wins by text, cut at k."""
    texts = cases(spark, d).select(F.col("case_id").alias("id"), "fact")
    e = embeddings(spark, d)
    found = vectors.exact_top_k(e, pairs.queries_of(e), 30).join(texts, F.col("case_id") == F.col("id"))
    kept = pairs.first_wins(found, "query_id", F.md5("fact"), F.col("rank"))
    return pairs.top(kept.drop("rank"), "query_id", 10, F.desc("score"), F.col("case_id")).select("query_id", "case_id", "score", "rank")


def sparse_search(spark, d, k):
    """The results, and how many rows were scored for each query."""
    return sparse.sparse_top_k(sparse.indexed_rows(sparse.matrix_rows(cases(spark, d))), F.col("case_id") % 20 == 0, k)


def sparse_results(spark, d, k):
    return sparse_search(spark, d, k).drop("scored")


@query
def sparse_topk(spark, d):
    return sparse_results(spark, d, 5)


def merged(spark, d):
    """Dense then sparse results, first wins by stripped text; empty texts are dropped."""
    e = embeddings(spark, d)
    dense = vectors.exact_top_k(e, pairs.queries_of(e), 10).withColumn("src_order", F.lit(0))
    both = dense.unionByName(sparse_results(spark, d, 10).withColumn("src_order", F.lit(1)))
    texts = cases(spark, d).select(F.col("case_id").alias("id"), "fact")
    found = both.join(texts, F.col("case_id") == F.col("id")).drop("id")
    return pairs.first_wins(found, "query_id", X.text_hash(F.col("fact")), F.col("src_order"), F.col("rank"))


@query
def hybrid_merge(spark, d):
    m = merged(spark, d).drop("fact").withColumnRenamed("rank", "src_rank")
    return pairs.ranked(m, "query_id", F.col("src_order"), F.col("src_rank"))


@query
def hybrid_rerank(spark, d):
    q = cases(spark, d).select(F.col("case_id").alias("qid"), F.col("fact").alias("q_fact"))
    m = merged(spark, d).join(q, F.col("query_id") == F.col("qid"))
    scored = m.withColumn("rerank_score", F.round(models.token_overlap(F.col("q_fact"), F.col("fact")), 6))
    best = F.coalesce(F.nullif("rerank_score", F.lit(0.0)), "score")
    return pairs.top(scored.withColumn("final_score", best).drop("rank"), "query_id", 5, F.desc("final_score"), F.col("case_id")).select("query_id", "case_id", "final_score", "rank")


@query
def rule_features(spark, d):
    return sparse.features(cases(spark, d))


@query
def rule_feature_stats(spark, d):
    f = sparse.features(cases(spark, d))
    one = f.agg(F.count("*").alias("total"), *(F.count(n).alias(n) for n in X.FIELDS))
    return one.unpivot("total", list(X.FIELDS), "field", "hits").select("field", "hits", F.round(F.col("hits") * 100 / F.col("total"), 6).alias("rate"))


@query
def rule_value_distribution(spark, d):
    return sparse.long_features(sparse.features(cases(spark, d))).groupBy("field", "value").agg(F.count("*").alias("n"))


@query
def keyword_counts(spark, d):
    return sparse.keyword_counts(cases(spark, d))


@query
def class_counts(spark, d):
    return sparse.class_counts(sparse.keyword_counts(cases(spark, d)), sparse.lexicon(spark))


@query
def keyword_totals(spark, d):
    """Corpus totals and documents by keyword."""
    return sparse.keyword_counts(cases(spark, d)).groupBy("keyword").agg(F.sum("n").alias("total"), F.count("*").alias("docs"))


@query
def matched_documents(spark, d):
    """Documents, and documents with a keyword."""
    c = cases(spark, d)
    hit = sparse.keyword_counts(c).select("case_id").distinct().agg(F.count("*").alias("docs_matched"))
    return c.agg(F.count("*").alias("docs")).join(F.broadcast(hit))


@query
def onehot_domain(spark, d):
    return sparse.one_hot_domain(sparse.long_features(sparse.features(cases(spark, d))))


@query
def sparse_matrix(spark, d):
    return sparse.sparse_matrix(sparse.matrix_rows(cases(spark, d))).withColumn("weight", F.round("weight", 6))


@query
def hydrate(spark, d):
    """Vector ids to cases; a missing text is a placeholder, missing lists stay null."""
    e = table(spark, d, "embeddings").select("vec_id", "label")
    c = cases(spark, d)
    return e.join(c, F.col("vec_id") == F.col("case_id"), "left").select("vec_id", "label", F.coalesce(F.md5("fact"), F.lit("missing")).alias("fact_md5"), F.array_join("accusation", "|").alias("accusation"), "months")


@query
def paired_lookup(spark, d):
    """Features and keywords of a case, all or nothing."""
    c = cases(spark, d).select("case_id")
    f = sparse.long_features(sparse.features(cases(spark, d))).groupBy("case_id").agg(F.count("*").alias("n_features"))
    k = sparse.keyword_counts(cases(spark, d)).groupBy("case_id").agg(F.sum("n").alias("n_keywords"))
    both = F.col("n_features").isNotNull() & F.col("n_keywords").isNotNull()
    j = c.join(f, "case_id", "left").join(k, "case_id", "left")
    return j.select("case_id", F.when(both, F.col("n_features")).alias("n_features"), F.when(both, F.col("n_keywords")).alias("n_keywords"))


#: Candidates of a query for each of its labels, for gold sets and for the cascade.
GOLD_CAP, POOL_CAP = 2_500, 10_000


def judged(spark, d, **columns):
    """Columns of each pair of cases that share a label, made once for each pair of profiles."""
    c = cases(spark, d)
    return pairs.expand(pairs.profile_pairs(c).select("q_profile", "c_profile", *(x.alias(n) for n, x in columns.items())), c)


@query
def set_equal_join(spark, d):
    """An equi-join on the label set; each pair comes out, so the rows grow with the square of a set's cases."""
    c = cases(spark, d).filter(F.size("accusation") > 0).select("case_id", F.array_join("accusation", "|").alias("label_set"))
    q = pairs.queries_of(c).withColumnRenamed("case_id", "q_id")
    return q.join(c.withColumnRenamed("case_id", "c_id"), "label_set").filter("q_id <> c_id").select("q_id", "c_id")


@query
def legal_filter(spark, d):
    c = cases(spark, d)
    return pairs.expand(pairs.band_pairs(c, pairs.ratio_band).filter(P.comparable("q", "c")).select("q_profile", "c_profile"), c)


def levels(spark, d):
    """q_profile, c_profile, n, level of the pairs of profiles that have a level."""
    p = pairs.band_pairs(cases(spark, d), pairs.ratio_band)
    return p.select("q_profile", "c_profile", "n", P.similarity_level("q", "c").alias("level")).filter("level > 0")


@query
def similarity_level(spark, d):
    return judged(spark, d, level=P.similarity_level("q", "c"))


@query
def level_distribution(spark, d):
    """Counted over pairs of profiles, less the query itself, which is of level 1."""
    q = pairs.queries_of(pairs.with_profile(cases(spark, d))).select(F.col("case_id").alias("q_id"), "profile")
    n = levels(spark, d).groupBy("q_profile").agg(*(F.sum(F.when(F.col("level") == k, F.col("n")).otherwise(0)).alias(f"level{k}") for k in range(1, 6)))
    n = n.withColumn("level1", F.col("level1") - 1).filter(" + ".join(f"level{k}" for k in range(1, 6)) + " > 0")
    return q.join(n, F.col("profile") == F.col("q_profile")).drop("profile", "q_profile")


@query
def imprisonment_tolerance(spark, d):
    return judged(spark, d, within=P.within_tolerance("q", "c"))


def vector_pairs(spark, d, cap=GOLD_CAP, asked=None):
    """Capped label pairs that both have vectors, with their cosine."""
    e = embeddings(spark, d)
    q, c = e.select(F.col("case_id").alias("qv_id"), F.col("v").alias("qv")), e.select(F.col("case_id").alias("cv_id"), F.col("v").alias("cv"))
    p = pairs.label_pairs(cases(spark, d), cap, asked).join(q, F.col("q_id") == F.col("qv_id")).join(c, F.col("c_id") == F.col("cv_id"))
    return p.withColumn("cos", F.round(vectors.cosine(F.col("qv"), F.col("cv")), 6)).drop("qv", "cv", "qv_id", "cv_id")


def found_pairs(spark, d):
    """The pairs that are scored: each query with its 100 nearest cases, their cosine and both sides' fields."""
    e, c = embeddings(spark, d), cases(spark, d)
    found = vectors.exact_top_k(e, pairs.queries_of(e), 100).withColumnRenamed("score", "cos").drop("rank")
    both = found.join(pairs.side(c, "q"), F.col("query_id") == F.col("q_id")).join(pairs.side(c, "c"), F.col("case_id") == F.col("c_id"))
    return both.drop("query_id", "case_id")


@query
def embedding_ramp(spark, d):
    return found_pairs(spark, d).select("q_id", "c_id", F.round(S.embedding_ramp(F.col("cos")), 6).alias("score"))


def keyword_sets(spark, d):
    k = sparse.keyword_counts(cases(spark, d))
    lex = F.broadcast(sparse.lexicon(spark))
    return k.join(lex, "keyword").groupBy("case_id").agg(F.array_sort(F.collect_set("keyword")).alias("kws"), F.array_sort(F.collect_set("class")).alias("classes"))


def with_keywords(p, spark, d):
    k, none = keyword_sets(spark, d), F.array().cast("array<string>")
    for s in "qc":
        p = p.join(k.select(F.col("case_id").alias(f"{s}k_id"), F.col("kws").alias(f"{s}_kws"), F.col("classes").alias(f"{s}_classes")), F.col(f"{s}_id") == F.col(f"{s}k_id"), "left").drop(f"{s}k_id")
        p = p.withColumns({f"{s}_{n}": F.coalesce(f"{s}_{n}", none) for n in ("kws", "classes")})
    return p


def keyword_part():
    return S.keyword_score(*(F.col(n) for n in ("q_kws", "c_kws", "q_classes", "c_classes")))


@query
def jaccard_score(spark, d):
    return with_keywords(found_pairs(spark, d), spark, d).select("q_id", "c_id", F.round(keyword_part(), 6).alias("score"))


@query
def legal_score(spark, d):
    return judged(spark, d, score=F.round(S.law_score("q", "c"), 6))


def scored_pairs(spark, d, cap=GOLD_CAP):
    return with_total(vector_pairs(spark, d, cap), spark, d)


def with_total(p, spark, d):
    return with_keywords(p, spark, d).withColumn("total", F.round(S.embedding_ramp(F.col("cos")) + keyword_part() + S.law_score("q", "c"), 6))


@query
def total_score(spark, d):
    return with_total(found_pairs(spark, d), spark, d).select("q_id", "c_id", "total")


@query
def tiered_gold(spark, d):
    """Waterfall: the closest levels first, seeded order within a level, full groups of 12."""
    t = pairs.level_top(levels(spark, d).drop("n"), cases(spark, d), 12)
    return pairs.full_groups(t, "q_id", 12).select("q_id", "c_id", "level", "rank")


@query
def capped_candidates(spark, d):
    """At most 40 candidates for each query and label, in seeded order."""
    return pairs.label_pairs(cases(spark, d), 40).select("q_id", "c_id")


@query
def gold_candidates(spark, d):
    """The candidates of gold sets: at most 2,500 for each query and label, in seeded order."""
    return pairs.label_pairs(cases(spark, d), GOLD_CAP).select("q_id", "c_id")


@query
def scored_gold(spark, d):
    t = pairs.top(scored_pairs(spark, d), "q_id", 5, F.desc("total"), F.col("c_id"))
    return pairs.full_groups(t, "q_id", 5).select("q_id", "c_id", "total", "rank")


@query
def label_set_sample(spark, d):
    """Cases of 300 to 700 characters, one for each label set, in seeded order; the first 100."""
    c = cases(spark, d).filter(F.length("fact").between(300, 700) & (F.size("accusation") > 0)).withColumn("label_set", F.array_join("accusation", "|"))
    w = Window.partitionBy("label_set").orderBy(pairs.seeded("case_id"), "case_id")
    one = c.withColumn("n", F.row_number().over(w)).filter("n = 1")
    return one.orderBy(pairs.seeded("case_id"), "case_id").limit(100).select("case_id", "label_set")


@query
def recall_filter_rank(spark, d):
    """Dense recall of 100, hard filter, 3/2/1 rule rank with retrieval order on ties, 10 best."""
    e, c = embeddings(spark, d), cases(spark, d)
    found = vectors.exact_top_k(e, pairs.queries_of(e), 100).withColumnRenamed("rank", "found_rank")
    q, s = pairs.side(c, "q"), pairs.side(c, "c")
    p = found.join(q, F.col("query_id") == F.col("q_id")).join(s, F.col("case_id") == F.col("c_id")).filter(P.comparable("q", "c"))
    rule = F.when(P.same_set(F.col("q_accusation"), F.col("c_accusation")), 3).otherwise(0) + F.when(P.same_set(F.col("q_articles"), F.col("c_articles")), 2).otherwise(0) + F.when(P.overlap(F.col("q_articles"), F.col("c_articles")), 1).otherwise(0)
    return pairs.top(p.withColumn("rule_score", rule), "q_id", 10, F.desc("rule_score"), F.col("found_rank")).select("q_id", "c_id", "rule_score", "rank")


@query
def cascade_sample(spark, d):
    """Single-label queries: best 50 by cosine, then best 5 by total, quality, 20 best queries."""
    p = scored_pairs(spark, d, POOL_CAP).filter(F.size("q_accusation") == 1)
    coarse = pairs.top(p, "q_id", 50, F.desc("cos"), F.col("c_id")).drop("rank")
    fine = pairs.full_groups(pairs.top(coarse, "q_id", 5, F.desc("total"), F.col("c_id")), "q_id", 5)
    quality = fine.groupBy("q_id").agg(F.round(F.avg("total"), 6).alias("quality"))
    best = quality.orderBy(F.desc("quality"), "q_id").limit(20)
    return fine.join(F.broadcast(best), "q_id").select("q_id", "c_id", "total", "rank", "quality")


@query
def coverage_sample(spark, d):
    """One case of each class first, then other single-label ones, then the rest; the first 60."""
    c = cases(spark, d).filter(F.size("accusation") > 0).withColumns({"single": F.size("accusation") == 1, "first": F.element_at("accusation", 1)})
    heads = c.filter("single").groupBy("first").agg(F.min(F.struct(pairs.seeded("case_id").alias("turn"), "case_id"))["case_id"].alias("head"))
    tier = F.when(~F.col("single"), 2).when(F.col("head").isNotNull(), 0).otherwise(1)
    tiers = c.join(heads.select("head"), F.col("case_id") == F.col("head"), "left").withColumn("tier", tier)
    return tiers.orderBy("tier", pairs.seeded("case_id"), "case_id").limit(60).select("case_id", "tier")


@query
def diverse_sample(spark, d):
    """The coverage sample's queries with vectors: dense recall of 30, total score, 8 best."""
    e = embeddings(spark, d)
    ids = coverage_sample(spark, d).select(F.col("case_id").alias("id"))
    found = vectors.exact_top_k(e, e.join(F.broadcast(ids), F.col("case_id") == F.col("id"), "left_semi"), 30).withColumnRenamed("score", "cos").drop("rank")
    c = cases(spark, d)
    p = found.join(pairs.side(c, "q"), F.col("query_id") == F.col("q_id")).join(pairs.side(c, "c"), F.col("case_id") == F.col("c_id"))
    p = with_keywords(p, spark, d).withColumn("total", F.round(S.embedding_ramp(F.col("cos")) + keyword_part() + S.law_score("q", "c"), 6))
    return pairs.full_groups(pairs.top(p, "q_id", 8, F.desc("total"), F.col("c_id")), "q_id", 8).select("q_id", "c_id", "total", "rank")


def gold_hits(spark, d):
    """Dense results against tiered gold: hit, and the positives of a query, at most 10."""
    e = embeddings(spark, d)
    gold = tiered_gold(spark, d).filter("rank <= 10").select(F.col("q_id").alias("g_q"), F.col("c_id").alias("g_c"))
    n = gold.groupBy("g_q").agg(F.count("*").alias("n_positive"))
    found = vectors.exact_top_k(e, pairs.queries_of(e), 10).join(n, F.col("query_id") == F.col("g_q")).drop("g_q")
    hit = gold.withColumn("hit", F.lit(1))
    return found.join(hit, (F.col("query_id") == F.col("g_q")) & (F.col("case_id") == F.col("g_c")), "left").select("query_id", "case_id", "rank", F.coalesce("hit", F.lit(0)).alias("hit"), "n_positive")


@query
def retrieval_metrics(spark, d):
    return metrics.retrieval_metrics(gold_hits(spark, d), [3, 5, 10])


@query
def attribute_metrics(spark, d):
    """A hit is an equal label set, whatever the gold; recall may exceed 1, as specified."""
    c = cases(spark, d).select(F.col("case_id").alias("id"), "accusation")
    h = gold_hits(spark, d).join(c.select(F.col("id").alias("a"), F.col("accusation").alias("qa")), F.col("query_id") == F.col("a")).join(c, F.col("case_id") == F.col("id"))
    return metrics.retrieval_metrics(h.withColumn("hit", P.same_set(F.col("qa"), F.col("accusation")).cast("int")), [3, 5, 10])


@query
def hit_rate(spark, d):
    k = spark.createDataFrame([(x,) for x in (1, 3, 5)], "k int")
    h = gold_hits(spark, d).join(F.broadcast(k), F.col("rank") <= F.col("k")).groupBy("query_id", "k").agg(F.max("hit").alias("hit"))
    return h.groupBy("k").agg(F.round(F.avg("hit"), 6).alias("hit_rate"), F.count("*").alias("n_queries"))


def class_predictions(spark, d):
    """Truth: the language. Predicted: the lexicon class with most votes, ties by name."""
    votes = sparse.class_counts(sparse.keyword_counts(cases(spark, d)), sparse.lexicon(spark)).filter("class <> 'place'")
    best = pairs.top(votes, "case_id", 1, F.desc("n"), F.col("class")).select(F.col("case_id").alias("id"), "class")
    short = F.substring("class", 1, 2)
    code = F.when(short == "ge", "de").when(short == "sp", "es").otherwise(short)
    return cases(spark, d).join(best, F.col("case_id") == F.col("id"), "left").select("case_id", F.col("lang").alias("truth"), F.coalesce(code, F.lit("none")).alias("predicted"))


@query
def keyword_vote(spark, d):
    votes = sparse.class_counts(sparse.keyword_counts(cases(spark, d)), sparse.lexicon(spark))
    return pairs.top(votes, "case_id", 3, F.desc("n"), F.col("class")).select("case_id", "class", "n", "rank")


@query
def accuracy_macro_f1(spark, d):
    return metrics.accuracy_and_macro_f1(class_predictions(spark, d))


@query
def label_mapping_stats(spark, d):
    return class_predictions(spark, d).filter("truth <> predicted").groupBy("truth", "predicted").agg(F.count("*").alias("n"))


@query
def keyword_lift(spark, d):
    return mining.mine(cases(spark, d), "lang", 30, 5)


@query
def target_keyword_lift(spark, d):
    """Over the target classes only; a case counts once for each of its labels."""
    rows = cases(spark, d).select("case_id", "fact", F.explode("accusation").alias("target")).filter(F.col("target").isin("src1", "src2", "src3"))
    return mining.mine(rows, "target", 25, 1)


@query
def centroids(spark, d):
    return vectors.centroids(labelled(spark, d)).select("label", "dim", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query
def centroid_spread(spark, d):
    return vectors.spread(labelled(spark, d)).select("label", "n", *(F.round(c, 6).alias(c) for c in ("avg_std", "min_dist", "max_dist", "mean_dist")))


@query
def nearest_centroid(spark, d):
    return vectors.nearest_centroids(labelled(spark, d)).filter("rank = 1").select("case_id", "label", "predicted", "score")


@query
def recall_at_k(spark, d):
    r = vectors.nearest_centroids(labelled(spark, d)).filter("label = predicted")
    return r.agg(*(F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_{k}") for k in (1, 3, 5)), F.count("*").alias("n"))


@query
def topbottom_classes(spark, d):
    """The most and least frequent classes, 5 of each, fewer if there are fewer than 10."""
    n = cases(spark, d).select(F.explode("accusation").alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    c = n.withColumns({"up": F.row_number().over(Window.orderBy("n", "label")), "down": F.row_number().over(Window.orderBy(F.desc("n"), "label")), "classes": F.count("*").over(Window.partitionBy())})
    k = F.least(F.lit(5), F.greatest(F.lit(1), F.floor(F.col("classes") / 2)))
    side = F.when(F.col("down") <= k, "top").when(F.col("up") <= k, "bottom")
    return c.withColumn("side", side).filter("side is not null").select("label", "n", "side")


@query
def round_robin_pool(spark, d):
    c = cases(spark, d).filter((F.length("fact") >= 100) & (F.size("accusation") > 0)).withColumn("label", F.element_at("accusation", 1))
    return pairs.round_robin(c, "label", 50).select("case_id", "label", "turn")


@query
def stratified_sample(spark, d):
    c = cases(spark, d).filter(F.size("accusation") > 0).withColumn("label", F.element_at("accusation", 1))
    return pairs.top(c, "label", 10, pairs.seeded("case_id"), F.col("case_id")).select("label", "case_id", "rank")


@query
def category_map(spark, d):
    """Class to category with a default."""
    m = spark.createDataFrame([("src0", "large"), ("src1", "odd"), ("src2", "even")], "label string, category string")
    c = cases(spark, d).select("case_id", F.element_at(F.col("accusation"), F.when(F.size("accusation") > 0, 1)).alias("first"))
    return c.join(F.broadcast(m), F.col("first") == F.col("label"), "left").select("case_id", F.coalesce("category", F.lit("other")).alias("category"))


@query
def resume_antijoin(spark, d):
    """Documents that have no label row yet."""
    return pairs.resume(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), "doc_id")


@query
def score_cache_misses(spark, d):
    """Pairs of question and text, as keys, that aren't in the cache (the even conversations')."""
    c = table(spark, d, "conversations").select("conv_id", "turn", X.cache_key(F.col("role"), F.col("text")).alias("cache_key"))
    return pairs.resume(c, c.filter("conv_id % 2 = 0"), "cache_key")


@query
def history_tail(spark, d):
    """The last 3 turns of each conversation."""
    c = table(spark, d, "conversations")
    return pairs.top(c, "conv_id", 3, F.desc("turn")).select("conv_id", "turn", "role", "rank")


@query
def field_diff(spark, d):
    """Fields, of all, that one of two extractions of whole texts has and the other hasn't: the rules on a
    text, and on what its last line break leaves of it."""
    c = cases(spark, d).select("case_id", X.one_line(F.col("fact")).alias("line"), X.one_line(X.without_last_line(F.col("fact"))).alias("rest"))
    has = lambda r, text: X.meaningful(r.column(F.col(text)))
    diff = F.array_compact(F.array(*(F.when(has(r, "line") != has(r, "rest"), F.lit(n)) for n, r in X.FIELDS.items())))
    return c.select("case_id", diff.alias("diff")).select("case_id", F.array_join("diff", ",").alias("diff_fields"), F.size("diff").cast("long").alias("n_diff"))


@query
def text_functions(spark, d):
    """Length, hash, first filled field, word and label clean-up of every document."""
    t = table(spark, d, "documents")
    return t.select("doc_id", F.length("text").cast("long").alias("n"), X.text_hash(F.col("text")).alias("hash"), X.first_filled(F.lit(""), F.col("source"), F.col("lang")).alias("filled"), F.size(X.content_words(F.col("text"), X.STOP_WORDS)).cast("long").alias("n_words"), X.cleaned_label(F.col("source"), "s").alias("label"), X.parsed_prediction(F.concat(F.lit("label: "), F.col("source"), F.lit("\nrest")), "label").alias("parsed"))


@query
def self_exclusion(spark, d):
    """Results whose stripped text isn't the query's own."""
    c = cases(spark, d).select(F.col("case_id").alias("id"), X.text_hash(F.col("fact")).alias("h"))
    e = embeddings(spark, d)
    found = vectors.exact_top_k(e, pairs.queries_of(e), 10)
    j = found.join(c.select(F.col("id").alias("a"), F.col("h").alias("qh")), F.col("query_id") == F.col("a")).join(c, F.col("case_id") == F.col("id"))
    return j.filter("h <> qh").select("query_id", "case_id", "score")


@query
def prompt_context(spark, d):
    """The three best references of each query as one text, in rank order."""
    g = tiered_gold(spark, d).filter("rank <= 3").join(cases(spark, d).select("case_id", "accusation", "months"), F.col("c_id") == F.col("case_id"))
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), F.array_join("accusation", ","), F.lit(" "), F.col("months").cast("string"))
    return g.groupBy("q_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))["line"], "\n").alias("context"))


@query
def inverted_index(spark, d):
    """label -> how many cases and the least and greatest id; the index itself stays exploded."""
    return cases(spark, d).select("case_id", F.explode("accusation").alias("label")).groupBy("label").agg(F.count("*").alias("n"), F.min("case_id").alias("first_id"), F.max("case_id").alias("last_id"))


@query
def fuzzy_label_map(spark, d):
    raw = table(spark, d, "documents").select("doc_id", F.concat(F.lit("source "), F.regexp_replace("source", "src", "sr")).alias("raw"))
    return models.fuzzy_names(raw, "raw", [f"source src{i}" for i in range(20)])


@query
def ivf_topk(spark, d):
    e = embeddings(spark, d)
    return ivf.top_k(e, pairs.queries_of(e), 10)


@query
def model_extract(spark, d):
    return models.extract(cases(spark, d), models.first_words, ["subject", "action", "result"])


@query
def model_embed(spark, d):
    c = cases(spark, d).select("case_id", models.hashed_embedding()(F.col("fact")).alias("v"))
    return c.select("case_id", F.round(vectors.norm(F.col("v")), 6).alias("length"), F.size("v").alias("dims"))
