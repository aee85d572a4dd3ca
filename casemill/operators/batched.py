"""Models in tasks: set up once a worker, fed by length, with a default for what fails.

A model is anything with `load()`, called once in each worker before its first batch, and `run(inputs)`,
which takes a list of tuples and gives as many results. Its inputs are dealt to batches of at most `rows`
rows and `size` characters, the longest first, so a batch holds texts of like length and little padding.
A batch that fails is tried row by row; a row that fails alone gets the model's default and is marked, so
that failures are never kept as if they were results.

Three kinds share this: scorers of pairs, classifiers (a probability for each class) and extractors.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Model(Protocol):
    """kind: the type of a result in SQL; default: what a failed row gets."""

    kind: str
    default: Any

    def load(self) -> None: ...

    def run(self, inputs: list[tuple]) -> Sequence: ...


def batches_of(lengths: Sequence[int], rows: int, size: int) -> Iterator[list[int]]:
    """Places in batches of at most `rows` rows and, beyond one row, `size` characters counted as the longest's."""
    held: list[int] = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        if held and (len(held) == rows or lengths[held[0]] * (len(held) + 1) > size):
            yield held
            held = []
        held.append(i)
    if held:
        yield held


def results(model: Model, inputs: list[tuple], rows: int, size: int) -> tuple[list, list[bool]]:
    """(results in the order of inputs, whether each failed)."""
    out, failed = [model.default] * len(inputs), [False] * len(inputs)
    for places in batches_of([sum(len(x) for x in t if isinstance(x, str)) for t in inputs], rows, size):
        try:
            got = list(model.run([inputs[i] for i in places]))
            if len(got) != len(places):
                raise ValueError("a result for each input is asked for")
            for i, x in zip(places, got, strict=True):
                out[i] = x
        except Exception:  # a model may fail on any input: each is tried alone
            for i in places:
                try:
                    (out[i],) = model.run([inputs[i]])
                except Exception:
                    out[i], failed[i] = model.default, True
    return out, failed


#: The model that this worker has loaded last, under its call's name: a worker serves many tasks.
_LOADED: dict[str, Model] = {}


def loaded(name: str, model: Model) -> Model:
    if name not in _LOADED:
        _LOADED.clear()
        model.load()
        _LOADED[name] = model
    return _LOADED[name]


def apply(rows: DataFrame, model: Model, inputs: list[str | Column], name: str = "result", batch_rows: int = 64, batch_size: int = 1 << 17) -> DataFrame:
    """rows with `name`, the model's result for the input columns, and `name`_failed."""

    own = uuid.uuid4().hex

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready = loaded(own, model)
        for b in batches:
            out, failed = results(ready, list(b.itertuples(index=False, name=None)), batch_rows, batch_size)
            yield pd.DataFrame({"result": pd.Series(out, dtype=object), "failed": failed})

    udf = F.pandas_udf(one, f"result {model.kind}, failed boolean")
    made = rows.withColumn("__made", udf(F.struct(*(F.col(c) if isinstance(c, str) else c for c in inputs))))
    return made.withColumn(name, F.col("__made.result")).withColumn(f"{name}_failed", F.col("__made.failed")).drop("__made")


class TokenOverlap:
    """The default scorer of pairs: Jaccard similarity of their sets of ASCII words."""

    kind, default = "double", 0.0

    def load(self) -> None:
        import re

        self.words = lambda text: set(re.findall("[a-z0-9]+", (text or "").lower()))

    def run(self, inputs: list[tuple]) -> list[float]:
        sets = [(self.words(a), self.words(b)) for a, b in inputs]
        return [len(a & b) / len(a | b) if a | b else 0.0 for a, b in sets]


class LexiconClassifier:
    """The default classifier: the share of each class in the words of its lexicon."""

    default: dict[str, float] = {}
    kind = "map<string, double>"

    def __init__(self, lexicon: dict[str, list[str]]):
        self.lexicon = lexicon

    def load(self) -> None:
        import re

        self.find = re.compile("[a-z0-9]+").findall
        self.classes = {k: [c for c, ks in self.lexicon.items() if k in ks] for ks in self.lexicon.values() for k in ks}

    def run(self, inputs: list[tuple]) -> list[dict[str, float]]:
        out = []
        for (text,) in inputs:
            votes: dict[str, int] = {}
            for w in self.find((text or "").lower()):
                for c in self.classes.get(w, ()):
                    votes[c] = votes.get(c, 0) + 1
            n = sum(votes.values())
            out.append({c: v / n for c, v in votes.items()})
        return out


def confident_mismatch(rows: DataFrame, classifier: Model, text: str, truth: str, at_least: float = 0.5, sure: float = 0.85) -> DataFrame:
    """rows with top_conf and dirty: a class of a probability above `sure`, and none of the true labels
    (a string or an array of them) among those above `at_least`. A failed row is never dirty."""
    made = apply(rows, classifier, [text], "classes")
    labels = F.array(truth) if dict(rows.dtypes)[truth] == "string" else F.col(truth)
    likely = F.map_keys(F.map_filter("classes", lambda _, p: p > at_least))
    top = F.coalesce(F.array_max(F.map_values("classes")), F.lit(0.0))
    dirty = ~F.coalesce(F.arrays_overlap(likely, labels), F.lit(False)) & (top > sure) & ~F.col("classes_failed")
    return made.withColumn("top_conf", top).withColumn("dirty", dirty).drop("classes", "classes_failed")


class MajorityReader:
    """The default answerer: the label that most references name, the first in order among equals, in
    the form that prompts ask for."""

    kind, default = "string", ""

    def load(self) -> None: ...

    def run(self, inputs: list[tuple]) -> list[str]:
        out = []
        for (prompt,) in inputs:
            names = [x for line in prompt.split("\n") if line.startswith("- ") for x in line[2:].split(" (")[0].split("|") if x]
            best = min(names, key=lambda x: (-names.count(x), x)) if names else ""
            out.append(f"I read {len(names)} labels.\nlabel: {best}\nend")
        return out


#: Our prompts by category; `other` is for those that have none.
TEMPLATES = {
    "large": "Of a frequent class. Name the label that fits the case best.\nReferences:\n{references}\nCase: {text}",
    "other": "Name the label that fits the case best.\nReferences:\n{references}\nCase: {text}",
}


def prompt(category: Column, templates: dict[str, str] | None = None, **parts: Column) -> Column:
    """The template of each row's category with its parts filled in, in one pass: what a part holds is never filled."""
    templates = templates or TEMPLATES
    out = None
    for name, template in sorted(templates.items(), key=lambda t: t[0] != "other"):
        pieces, rest = [], template
        while rest:
            at = min((rest.find(f"{{{p}}}") for p in parts if f"{{{p}}}" in rest), default=-1)
            if at < 0:
                pieces.append(F.lit(rest))
                break
            part = next(p for p in parts if rest.startswith(f"{{{p}}}", at))
            pieces += [F.lit(rest[:at]), F.coalesce(parts[part], F.lit(""))]
            rest = rest[at + len(part) + 2 :]
        filled = F.concat(*pieces)
        out = filled if out is None else F.when(category == name, filled).otherwise(out)
    return out
