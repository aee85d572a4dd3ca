"""Queries over indexes: phrases, postings with bounds, cells with bounds, bands and label lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators import ivf, labels, pairs, phrases, sparse, vectors
from ..schema import cases
from ..session import new_folder, stash
from . import oracles as O
from . import queries as Q
from .more import Query

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Our phrases: class -> keywords of one to three words, with ones that overlap and begin alike.
PHRASES = {
    "english": ["of the", "the the", "the", "of the and", "and the", "IN THE", "the and of"],
    "french": ["de la", "de", "la de", "de de la"],
    "german": ["der der", "der", "und  die"],
    "pairs": ["of the", "de la", "der der", "to the", "hehely hehely"],
}
KEYS = sorted({phrases.normal(k) for ks in PHRASES.values() for k in ks}, key=lambda k: (-len(k), k))
PHRASE_SQL = f"""found AS (SELECT case_id, unnest(regexp_extract_all(regexp_replace(lower(fact), '\\s+', ' ', 'g'), '\\b(?:{'|'.join(KEYS)})\\b')) AS keyword FROM cases),
pcounts AS (SELECT case_id, keyword, count(*) AS n FROM found GROUP BY ALL),
plex AS (SELECT * FROM (VALUES {', '.join(f"('{c}', '{phrases.normal(k)}')" for c, ks in PHRASES.items() for k in ks)}) AS t(class, keyword))"""


def counted(spark, d):
    return phrases.phrase_counts(cases(spark, d), [k for ks in PHRASES.values() for k in ks])


@query(f"WITH {O.CASES}, {PHRASE_SQL} SELECT case_id, keyword, n FROM pcounts")
def phrase_counts(spark, d):
    """Keywords of several words in whole texts: leftmost, longest, none overlapping."""
    return counted(spark, d)


@query(f"""WITH {O.CASES}, {PHRASE_SQL}, cls AS (SELECT case_id, class, sum(n)::BIGINT AS total, string_agg(keyword || '=' || n, ';' ORDER BY keyword) AS own FROM pcounts JOIN plex USING (keyword) GROUP BY ALL)
SELECT case_id, string_agg(class, ',' ORDER BY class) AS matched_crimes, string_agg(class || ':' || total, ',' ORDER BY class) AS crime_counts, string_agg(class || ':' || own, ',' ORDER BY class) AS details FROM cls GROUP BY case_id""")
def phrase_classes(spark, d):
    """The whole extraction of each case: classes, their counts, and each class's keywords."""
    made = phrases.by_class(counted(spark, d), PHRASES)
    entry = lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))
    inner = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")
    return made.select(
        "case_id",
        F.array_join("matched_crimes", ",").alias("matched_crimes"),
        F.array_join(F.transform(F.map_entries("crime_counts"), entry), ",").alias("crime_counts"),
        F.array_join(F.transform(F.map_entries("details"), lambda e: F.concat(e["key"], F.lit(":"), inner(e["value"]))), ",").alias("details"),
    )


@query(f"WITH {O.CASES}, {PHRASE_SQL} SELECT keyword, sum(n)::BIGINT AS total, count(*) AS docs FROM pcounts GROUP BY keyword")
def phrase_totals(spark, d):
    """Corpus totals and documents by phrase."""
    return counted(spark, d).groupBy("keyword").agg(F.sum("n").alias("total"), F.count("*").alias("docs"))


@query()
def sparse_rows_scored(spark, d):
    """For each query of sparse_topk, how many of the corpus's rows its bounds let through."""
    c = cases(spark, d)
    rows = sparse.indexed_rows(sparse.matrix_rows(c))
    found = sparse.sparse_top_k(rows, F.col("case_id") % 20 == 0, 5)
    return found.groupBy("query_id").agg(F.max("scored").alias("scored")).withColumn("corpus", F.lit(rows.count()))


@query(f"WITH {O.EMB}, {O.dense(10)} SELECT * FROM dense")
def bounded_topk(spark, d):
    """Exact search that skips cells which can't beat a query's tenth score."""
    e = Q.embeddings(spark, d)
    return ivf.search_exactly(ivf.build(e), pairs.queries_of(e), 10)[0]


@query()
def bounded_cells(spark, d):
    """For each query of bounded_topk, the cells and rows that were searched, of how many."""
    e = Q.embeddings(spark, d)
    index = ivf.build(e)
    _, searched = ivf.search_exactly(index, pairs.queries_of(e), 10)
    sizes = index.cells.select("cell", "n")
    all_of = sizes.agg(F.count("*").alias("cells"), F.sum("n").alias("corpus"))
    return searched.join(F.broadcast(sizes), "cell").groupBy(F.col("q_id").alias("query_id")).agg(F.count("*").alias("searched"), F.sum("n").alias("scored")).join(F.broadcast(all_of))


@query(f"WITH {O.EMB}, {O.dense(10)} SELECT * FROM dense")
def saved_index_search(spark, d):
    """An index built, saved, loaded again and searched exactly."""
    e = Q.embeddings(spark, d)
    return ivf.search_exactly(ivf.load_or_build(e, new_folder(spark, "index")), pairs.queries_of(e), 10)[0]


@query()
def ivf_recall(spark, d):
    """The share of the true ten nearest that ivf_topk's search of 8-bit codes finds, the cells that it
    probes (measured when the index is built), and the share of the rows in them."""
    e = Q.embeddings(spark, d)
    q, index = stash(pairs.queries_of(e), "queries"), ivf.build(e)
    exact = vectors.exact_top_k(e, q, 10).select("query_id", "case_id")
    found = ivf.search(index, q, 10).select("query_id", "case_id", F.lit(1).alias("hit"))
    hits = exact.join(found, ["query_id", "case_id"], "left").agg(F.lit(10).alias("k"), F.count_distinct("query_id").alias("n_queries"), F.round(F.count("hit") / F.count("*"), 4).alias("recall"))
    sizes = index.cells.select("cell", "n", "probes")
    n, asked = e.count(), q.count()
    told = sizes.agg(F.count("*").alias("cells"), F.max("probes").alias("probes")).first()
    near = ivf.nearest_cells(index, q, told["probes"]).join(F.broadcast(sizes), "cell").agg(F.round(F.sum("n") / (n * max(asked, 1)), 4).alias("scored"))
    return hits.join(F.broadcast(near)).withColumns({"cells": F.lit(told["cells"]), "probes": F.lit(told["probes"])})


@query(f"WITH {O.CASES}, {O.PAIRS} SELECT q_id, c_id FROM pairs WHERE {O.FLAGS} AND (q_death OR q_life OR abs(q_months - c_months) <= greatest(6.0, q_months * 0.2))")
def tolerance_matches(spark, d):
    """The pairs of a shared label whose terms agree, by a band join."""
    c = cases(spark, d)
    near = pairs.band_pairs(c, pairs.tolerance_band).filter(P.within_tolerance("q", "c"))
    return pairs.expand(near.select("q_profile", "c_profile"), c)


@query(f"""WITH {O.CASES}, {O.PAIRS}, sets AS (SELECT case_id AS query_id, accusation FROM cases WHERE case_id % 20 = 0 AND len(accusation) > 0)
SELECT query_id, count(*) AS n_any, count(*) FILTER (list_has_all(c.accusation, s.accusation)) AS n_all, min(c.case_id) AS first_id, max(c.case_id) AS last_id
FROM sets s JOIN cases c ON list_has_any(s.accusation, c.accusation) GROUP BY query_id""")
def label_candidates(spark, d):
    """Each query's candidates by merging the lists of its labels: with any, with all of them."""
    c = cases(spark, d)
    asked = pairs.queries_of(c).select(F.col("case_id").alias("query_id"), F.array_join("accusation", "|").alias("set"), "accusation").filter(F.size("accusation") > 0)
    sets = asked.groupBy("set").agg(F.first("accusation").alias("accusation"))
    lists = stash(labels.merged(sets, stash(labels.postings(c), "label-postings"), "set", "accusation"), "merged")
    counts = lists.groupBy("set").agg(F.sum("n_any").alias("n_any"), F.sum("n_all").alias("n_all"))
    ends = labels.listed(lists, "set").groupBy("set").agg(F.min("case_id").alias("first_id"), F.max("case_id").alias("last_id"))
    return asked.drop("accusation").join(counts, "set").join(ends, "set").drop("set")

