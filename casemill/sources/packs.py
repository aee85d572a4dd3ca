"""Rule packs from files: read from any store, checked field by field, compiled to one projection.

A pack is a map of fields, or of groups of fields, to rules: {type: keyword, keywords: [...]},
{type: regex, patterns: [...]} or {type: mapping, mappings: {label: [words]}}, as JSON, or as YAML where
its reader is installed. Fields of a group are named group_field. A rule that can't be used is
reported and left out; the others are compiled.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import Rule

VALUES = {"keyword": "keywords", "regex": "patterns", "mapping": "mappings"}
#: Characters of a pack's file: it's read on the driver, since it becomes the plan.
MOST = 1 << 20


@dataclass(frozen=True)
class Pack:
    """rules by field; problems: field -> why its rule was left out."""

    rules: dict[str, Rule]
    problems: dict[str, str]


def _words(x: object, what: str) -> list[str]:
    if not isinstance(x, list) or not x or not all(isinstance(w, str) and w for w in x):
        raise ValueError(f"{what} must be a list of texts")
    return x


def rule(name: str, told: dict) -> Rule:
    kind = told.get("type")
    if kind not in VALUES:
        raise ValueError(f"unknown type {kind!r}")
    values = told.get(VALUES[kind])
    if kind == "mapping":
        if not isinstance(values, dict) or not values:
            raise ValueError("mappings must be a map of labels")
        return Rule(name, kind, labels={str(label): _words(w, f"label {label!r}") for label, w in values.items()})
    words = _words(values, VALUES[kind])
    for w in words if kind == "regex" else []:
        re.compile(re.sub(r"\\p\{\w+\}", ".", w))
    return Rule(name, kind, words)


def compiled(told: object, prefix: str = "") -> Pack:
    """The pack of a map of fields or groups, at any depth."""
    if not isinstance(told, dict):
        return Pack({}, {prefix or "pack": "not a map"})
    rules, problems = {}, {}
    for name, value in told.items():
        full = f"{prefix}_{name}" if prefix else str(name)
        if isinstance(value, dict) and "type" not in value and any(isinstance(v, dict) for v in value.values()):
            inner = compiled(value, full)
            rules, problems = rules | inner.rules, problems | inner.problems
            continue
        try:
            if not isinstance(value, dict):
                raise ValueError("not a rule")
            if not re.fullmatch(r"\w+", full):
                raise ValueError("not a name for a column")
            rules[full] = rule(full, value)
        except (ValueError, re.error) as why:
            problems[full] = str(why)
    return Pack(rules, problems)


def read_pack(spark: SparkSession, path: str) -> Pack:
    """The pack of a file; a file that can't be read as a whole has one problem and no rules."""
    size = spark.read.format("binaryFile").load(path).select("length").first()["length"]
    if size > MOST:
        return Pack({}, {"pack": f"{size} bytes are more than {MOST}"})
    text = spark.read.text(path, wholetext=True).first()
    try:
        return compiled(parsed(text["value"] if text else "", path.endswith((".yaml", ".yml"))))
    except ValueError as why:
        return Pack({}, {"pack": str(why)})


def parsed(text: str, yaml: bool) -> object:
    if not yaml:
        return json.loads(text)
    try:
        from yaml import YAMLError, safe_load
    except ImportError:
        raise ValueError("no reader for YAML is installed") from None
    try:
        return safe_load(text)
    except YAMLError as why:
        raise ValueError(str(why)) from None


def problems(spark: SparkSession, pack: Pack) -> DataFrame:
    """field, problem of the rules that were left out."""
    return spark.createDataFrame(sorted(pack.problems.items()), "field string, problem string")
