"""Keyword counts, one-hot features and sparse cosine retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import FIELDS, LEXICON, Rule, ascii_tokens, one_line
from ..session import stash
from . import postings


def lexicon(spark, classes: dict[str, list[str]] | None = None) -> DataFrame:
    rows = [(c, k) for c, ks in (classes or LEXICON).items() for k in ks]
    return spark.createDataFrame(rows, "class string, keyword string")


def keyword_counts(cases: DataFrame, words: list[str] | None = None) -> DataFrame:
    """case_id, keyword, n: whole ASCII tokens, case aside. A text's tokens are filtered before
    they are exploded, so only keywords become rows."""
    known = words or sorted({k for ks in LEXICON.values() for k in ks})
    hits = F.filter(ascii_tokens(F.col("fact")), lambda w: w.isin(*known))
    return cases.select("case_id", F.explode(hits).alias("keyword")).groupBy("case_id", "keyword").agg(F.count("*").alias("n"))


def class_counts(counts: DataFrame, lex: DataFrame) -> DataFrame:
    return counts.join(F.broadcast(lex), "keyword").groupBy("case_id", "class").agg(F.sum("n").alias("n"))


def features(cases: DataFrame, pack: dict[str, Rule] | None = None) -> DataFrame:
    """case_id and the fields of a rule pack (the default one's 27), each a nullable string."""
    line = cases.select("case_id", one_line(F.col("fact")).alias("fact"))
    return line.select("case_id", *(r.column(F.col("fact")).alias(name) for name, r in (pack or FIELDS).items()))


def long_features(wide: DataFrame) -> DataFrame:
    """case_id, field, value for the values that are present."""
    names = list(FIELDS)
    return wide.unpivot("case_id", names, "field", "value").filter("value is not null")


def one_hot_domain(long: DataFrame) -> DataFrame:
    """field, value, dim: the distinct values in order, numbered from 0 over all fields."""
    values = long.groupBy("field", "value").agg(F.count("*").alias("n"))  # at most a few for each field
    return values.select("field", "value", (F.row_number().over(Window.orderBy("field", "value")) - 1).alias("dim"))


def matrix_rows(cases: DataFrame, pack: dict[str, Rule] | None = None, words: list[str] | None = None) -> DataFrame:
    """case_id, cells (array of dim and weight) of the cases that have any: 1 for a feature's value, the
    count for a keyword, of length 1 in all. Each row is made from its text alone, without a shuffle."""
    pack = pack or FIELDS
    known = words or sorted({k for ks in LEXICON.values() for k in ks})
    hits = F.filter(ascii_tokens(F.col("fact")), lambda w: w.isin(*known))
    c = cases.select("case_id", held(line=one_line(F.col("fact")), hits=hits))
    cell = lambda dim, w: F.struct(dim.alias("dim"), w.cast("double").alias("weight"))
    values = F.array_compact(F.array(*(F.concat(F.lit(f"{n}="), r.column(F.col("line"))) for n, r in pack.items())))
    features = F.transform(values, lambda v: cell(v, F.lit(1)))
    counts = F.transform(F.array_distinct("hits"), lambda w: cell(F.concat(F.lit("kw:"), w), F.size(F.filter("hits", lambda x: x == w))))
    both = c.select("case_id", held(cells=F.concat(features, counts))).filter(F.size("cells") > 0)
    length = F.sqrt(F.aggregate("cells", F.lit(0.0), lambda s, x: s + x["weight"] * x["weight"]))
    both = both.select("case_id", held(cells=F.col("cells"), length=length))
    return both.select("case_id", F.transform("cells", lambda x: F.struct(x["dim"].alias("dim"), (x["weight"] / F.col("length")).alias("weight"))).alias("cells"))


def held(**columns: Column) -> Column:
    """The columns, made once: a generator of one row keeps their expressions from being copied into
    every lambda that reads them."""
    return F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items()))))


def sparse_matrix(rows: DataFrame) -> DataFrame:
    """case_id, dim, weight of matrix_rows."""
    return rows.select("case_id", F.inline("cells"))


def indexed_rows(rows: DataFrame) -> DataFrame:
    """case_id, dims, weights of matrix_rows, written once: what an index is made of and searched with."""
    hashed = F.transform("cells", lambda x: F.xxhash64(x["dim"]))
    return stash(rows.select("case_id", hashed.alias("dims"), F.col("cells.weight").alias("weights")), "sparse-rows")


def sparse_top_k(rows: DataFrame, is_query: Column, k: int) -> DataFrame:
    """query_id, case_id, score, rank, scored of indexed_rows by sparse dot product, over an index in postings."""
    return postings.search(stash(postings.build(rows), "postings"), rows.filter(is_query), k)
