"""Pluggable models, with deterministic defaults: they take and give Columns or batches."""

from __future__ import annotations

import difflib
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_tokens


def token_overlap(query: Column, text: Column) -> Column:
    """The default pair scorer: Jaccard of token sets."""
    a, b = F.array_distinct(ascii_tokens(query)), F.array_distinct(ascii_tokens(text))
    n = F.size(F.array_union(a, b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(F.lit(0.0))


def hashed_embedding(dim: int = 64) -> Callable:
    """The default text embedder: signed hashed token counts of length 1."""

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[float]:
            v = np.zeros(dim)
            for w in (text or "").lower().split():
                h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big")
                v[h % dim] += 1 if h >> 63 else -1
            return (v / (np.linalg.norm(v) or 1)).tolist()

        return pd.Series([one(t) for t in texts], dtype=object)

    return embed


def best_name(name: str | None, names: list[str], cutoff: float = 0.5) -> str | None:
    """The name itself, else the closest, else the first that contains it or is contained, else itself."""
    if name is None or name in names:
        return name
    if near := difflib.get_close_matches(name, names, n=1, cutoff=cutoff):
        return near[0]
    return next((x for x in names if x in name or name in x), name)


def fuzzy_names(rows: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Adds `mapped`; each distinct value is matched once."""

    @F.pandas_udf("string")
    def match(values: pd.Series) -> pd.Series:
        return values.map(lambda v: best_name(v, names))

    mapped = rows.select(F.col(column).alias("__raw")).distinct().withColumn("mapped", match("__raw"))
    return rows.join(mapped, F.col(column).eqNullSafe(F.col("__raw"))).drop("__raw")


def extract(rows: DataFrame, model: Callable[[str], dict], fields: list[str]) -> DataFrame:
    """case_id and a struct of the fields that `model` gives for each fact; null ones if it fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(text: str) -> list:
            try:
                found = model(text)
            except Exception:  # a model's failure gives the default, as specified
                found = {}
            return [found.get(f) for f in fields]

        for b in batches:
            out = pd.DataFrame([one(t) for t in b["fact"]], columns=fields, dtype=object)
            out.insert(0, "case_id", b["case_id"])
            yield out

    return rows.select("case_id", "fact").mapInPandas(run, "case_id long, " + ", ".join(f"{f} string" for f in fields))


def first_words(text: str) -> dict:
    """The default extractor: subject, action and result are a text's first three words."""
    return dict(zip(("subject", "action", "result"), text.split(), strict=False))
