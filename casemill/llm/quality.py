"""Quality classifier (operator 4) by Bradley-Terry pairwise ranking.

A document's worth is linear in its features, and the log-odds that document a is preferred
to b are worth(a) - worth(b). So a logistic regression without intercept on the differences
of the features of preferred and other labelled documents learns the weights. All labelled
documents that aren't held out are learnt from, each in at least one pair. The threshold
is the exact quantile of all their worths: the share of documents labelled 0.

score = sigmoid(worth - threshold + log-odds of CUT), so a score of CUT is the threshold.

Defined results: a null text is empty and is scored like any; rows with a null doc_id are
never learnt from; repeated labels of a document count once, the higher quality holds; without labels
of both kinds every score is 0.5; no rows give no rows. labels, lang, source and doc_id are
never inputs of a score.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, ready, small, stash, utf8
from .rows import Sieve, placed

CUT = 0.3
#: Rows of one kind that are told to all tasks, else they meet the other kind by a shuffle.
FEW = 10_000
#: Preferred partners of each document labelled 0.
PARTNERS = 8
SYMBOL_BYTES = b"#*$%&|<>!@^~_=+{}[]\\"
FEATURES = ["log_words", "word_chars", "symbols", "odd_ends", "upper_words", "upper", "digits", "marks", "shouts", "bars", "dup_lines", "line_words", "distinct", "commonest", "packed", "non_ascii", "repeated", "repeat_any", "long_words", "short"]


def features(raw: bytes) -> list[float]:
    """Figures of the whole text, each of a bounded size."""
    words = raw.split()
    n, size = max(1, len(words)), max(1, len(raw))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    counts = Counter(words)
    grams = Counter(zip(words, words[1:], words[2:], words[3:], strict=False))
    repeated = sum(c for c in grams.values() if c > 1) / max(1, len(words) - 3)
    share = lambda chars, unit: sum(raw.count(c) for c in chars) / unit
    return [
        math.log1p(len(words)),
        min(30.0, sum(map(len, words)) / n),
        min(3.0, share(SYMBOL_BYTES, n)),
        sum(w[-1] in SYMBOL_BYTES for w in words) / n,
        sum(w.isupper() for w in words) / n,
        sum(map(raw.count, (bytes([c]) for c in range(65, 91)))) / size,
        share(b"0123456789", size) * 10,
        min(3.0, share(b".,;:?", n)),
        min(3.0, share(b"!", n)),
        min(3.0, share(b"|", n)),
        1 - len(set(lines)) / max(1, len(lines)),
        math.log1p(n / max(1, len(lines))),
        len(counts) / n,
        max(counts.values(), default=0) / n,
        len(zlib.compress(raw, 1)) / size,
        sum(map(raw.count, (b"\xc3", b"\xc2"))) / size,
        repeated,
        float(repeated > 0),
        sum(len(w) > 20 for w in words) / n,
        float(len(words) < 20),
    ]


@dataclass(frozen=True)
class Ranker:
    centre: list[float]
    weights: list[float]  # of centred features
    threshold: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        z = (x - np.array(self.centre)) @ np.array(self.weights) - self.threshold + math.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


#: With no labels to learn from.
UNDECIDED = Ranker([0.0] * len(FEATURES), [0.0] * len(FEATURES), math.log(CUT / (1 - CUT)))


def held_out(col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """label, features of all labelled documents that aren't held out. Only features meet labels, no texts."""
    own = F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("__id")
    known = labels.filter("doc_id is not null and quality in (0, 1)").groupBy(own).agg(F.max("quality").cast("double").alias("label"))
    known = stash(known.filter(~held_out("__id")), "quality-labels")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "x": pd.Series([features(bytes(t)) for t in b["text"]], dtype=object)})

    rows = Sieve(known.select("__id")).passing(docs.select("doc_id", utf8().alias("text")), F.col("doc_id"))
    made = rows.mapInPandas(run, T.StructType([docs.schema["doc_id"], T.StructField("x", T.ArrayType(T.DoubleType()))]))
    return made.join(known, F.col("doc_id") == F.col("__id")).select("label", "x")


def quantile(values: DataFrame, share: float, n: int, keep: Scratch) -> float:
    """The exact quantile of the n values of the column `value`, between two of them in proportion. They are sorted over
    ranges, so no task has all."""
    at = share * (n - 1)
    low, high = math.floor(at), math.ceil(at)
    found = placed(values.withColumn("grp", F.lit(0)), keep, "value").filter(F.col("pos").isin(low, high)).select("pos", "value")
    value = {r["pos"]: r["value"] for r in found.collect()}
    return value[low] + (at - low) * (value[high] - value[low])


def preferences(rows: DataFrame, zeros: int, ones: int, partners: int) -> DataFrame:
    """x1, x0 and a number k of pairs of documents labelled 1 and 0, of rows(label, x, pos), pos being from 0 on in each label.
    Each document labelled 0 has `partners` preferred ones; if that leaves out some of these, each of these has one instead."""
    low, high = rows.filter("label = 0").select(F.col("pos").alias("i"), F.col("x").alias("x0")), rows.filter("label = 1").select(F.col("pos").alias("j"), F.col("x").alias("x1"))
    if ones > zeros * partners:
        high = high.select(F.pmod("j", F.lit(zeros)).alias("i"), F.floor(F.col("j") / zeros).alias("k"), "x1")
        return high.join(small(low, zeros, FEW), "i").select("x1", "x0", "k")
    low = low.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(partners - 1))))
    low = low.withColumn("j", F.pmod(F.col("i") * partners + F.col("k"), F.lit(ones)))
    return low.join(small(high, ones, FEW), "j").select("x1", "x0", "k")


def fit(rows: DataFrame, partners: int = PARTNERS, ridge: float = 1e-3) -> Ranker:
    """Learn from all of (label, x) by logistic loss on differences of features."""
    with Scratch(rows.sparkSession) as keep:
        return _fit(keep(rows, "quality-rows"), partners, ridge, keep)


def _fit(rows: DataFrame, partners: int, ridge: float, keep: Scratch) -> Ranker:
    size = len(FEATURES)
    each = [F.col("x")[i] for i in range(size)]
    stats = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0)), *(F.avg(c) for c in each), *(F.stddev_pop(c) for c in each)).first()
    n, ones = stats[0], int(stats[1])
    if not 0 < ones < n:
        return UNDECIDED
    centre, spread = list(stats[2 : 2 + size]), [s or 1.0 for s in stats[2 + size :]]
    scaled = F.array(*((F.col("x")[i] - centre[i]) / spread[i] for i in range(size)))

    # in the order of a hash, so which documents are paired doesn't hang on the files
    numbers = placed(rows.select(F.col("label").alias("grp"), scaled.alias("x"), F.xxhash64("x").alias("h")), keep, "h")
    pairs = preferences(numbers.select(F.col("grp").alias("label"), "x", "pos"), n - ones, ones, partners)
    sign = F.when(F.col("k") % 2 == 0, 1.0).otherwise(-1.0)
    pairs = pairs.withColumn("sign", sign).select(F.when(F.col("sign") > 0, 1.0).otherwise(0.0).alias("label"), F.transform(F.zip_with("x1", "x0", lambda a, b: a - b), lambda d: d * F.col("sign")).alias("d"))

    pairs = keep(pairs, "quality-pairs").select("label", array_to_vector("d").alias("features"))
    model = LogisticRegression(fitIntercept=False, standardization=False, regParam=ridge, maxIter=60, tol=1e-6).fit(pairs)
    weights = [w / s for w, s in zip(model.coefficients.toArray().tolist(), spread, strict=True)]
    worth = sum(((F.col("x")[i] - centre[i]) * weights[i] for i in range(size)), F.lit(0.0))
    return Ranker(centre, weights, quantile(rows.select(worth.alias("value")), 1 - ones / n, n, keep))


def score(docs: DataFrame, ranker: Ranker, keep: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; with keep, the columns of the
    documents that are predicted 1 instead."""
    ready(docs.sparkSession)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(ranker.scores(np.array([features(bytes(t)) for t in texts]).reshape(len(texts), len(FEATURES))))

    if keep:
        return docs.filter(scored(utf8()) >= CUT)
    made = docs.select("doc_id", held_out().alias("held_out"), scored(utf8()).alias("score"))
    return made.withColumn("predicted", F.when(F.col("score") >= CUT, 1).otherwise(0).cast("int"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    ready(docs.sparkSession)
    return score(docs, fit(training_rows(docs, labels)))
