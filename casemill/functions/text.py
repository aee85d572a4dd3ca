"""Text functions and declarative rules as Columns."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space of all scripts.
SPACE = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space of any script at either end."""
    return F.btrim(text, F.lit(SPACE))


def text_hash(text: Column) -> Column:
    """md5 of the stripped text; empty for an empty or missing one."""
    s = strip(F.coalesce(text, F.lit("")))
    return F.when(s == "", F.lit("")).otherwise(F.md5(s))


def one_line(text: Column) -> Column:
    return strip(F.translate(text, "\n\r", " "))


def without_last_line(text: Column) -> Column:
    """What stands before the last line break; all of it, if there is none."""
    return F.regexp_replace(text, r"\n[^\n]*\z", "")


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty, else empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))


def ascii_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


#: A token: a Han character, or a run of other letters and digits of any script.
TOKEN = r"(?:\p{IsHan}|[\p{L}\p{N}&&[^\p{IsHan}]]++)"


def cut_at_token(text: Column, n: int, empty: str = "[EMPTY]") -> Column:
    """The start of a text to the end of its n-th token, or `empty` for a text without tokens."""
    start = F.regexp_extract(text, rf"^(?:[^\p{{L}}\p{{N}}]*+{TOKEN}){{0,{n}}}+", 0)
    return F.coalesce(F.nullif(start, F.lit("")), F.lit(empty))


def token_spans() -> Callable[[Column], Column]:
    """A function of texts: array of (start, end), in characters, of the tokens; empty for a null text."""

    @F.arrow_udf("array<struct<start: int, end: int>>")
    def spans(texts: pa.Array) -> pa.Array:
        find = re.compile(r"[一-鿿㐀-䶿豈-﫿]|[^\W_一-鿿㐀-䶿豈-﫿]+").finditer
        made, ends = [], [0]
        for t in texts.to_pylist():
            made += [m.span() for m in find(t or "")]
            ends.append(len(made))
        flat = np.array(made, np.int32).reshape(-1, 2)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([flat[:, 0].copy(), flat[:, 1].copy()], ["start", "end"]))

    return spans


def tokens_at(text: Column, spans: Column) -> Column:
    """What stands between the spans' ends in the text, in their order. Each text is cut in one pass: a substring
    by characters starts over at the text's beginning, so one for each token would take the square of its length."""

    @F.arrow_udf("array<string>")
    def tokens(texts: pa.Array, spans: pa.Array) -> pa.Array:
        each = spans.flatten()
        starts, ends, made, at = each.field("start").to_pylist(), each.field("end").to_pylist(), [], 0
        for t, n in zip(texts.to_pylist(), spans.value_lengths().to_pylist(), strict=True):
            made += [t[a:e] for a, e in zip(starts[at : at + n], ends[at : at + n], strict=True)] if n else []
            at += n or 0
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([n or 0 for n in spans.value_lengths().to_pylist()])].astype(np.int32)), pa.array(made, pa.string()))

    return tokens(text, spans)


def content_words(text: Column, stop: list[str]) -> Column:
    """Tokens of two characters or more that are neither stop words nor codes with digits."""
    keep = lambda w: (F.length(w) >= 2) & ~w.isin(*stop) & ~w.rlike("^[a-z]*[0-9]+[a-z]*$")
    return F.filter(ascii_tokens(text), keep)


def cleaned_label(label: Column, suffix: str) -> Column:
    return strip(F.replace(label, F.lit(suffix), F.lit("")))


def parsed_prediction(output: Column, marker: str) -> Column:
    """Text after `marker:` (half- or full-width colon) up to the line's end, else the whole output."""
    found = F.regexp_extract(output, f"{marker}[:：]([^\n]*)", 1)
    return F.when(output.rlike(f"{marker}[:：]"), strip(found)).otherwise(strip(output))


def cache_key(query: Column, text: Column) -> Column:
    return F.concat_ws(":", F.md5(query), F.md5(text))


def meaningful(value: Column) -> Column:
    return F.coalesce(F.trim(value) != "", F.lit(False))


@dataclass(frozen=True)
class Rule:
    """kind keyword or regex: true if any of `values` is found, else null; mapping: the first
    label, in declaration order, with a keyword in the text."""

    name: str
    kind: str
    values: list[str] = field(default_factory=list)
    labels: dict[str, list[str]] = field(default_factory=dict)

    def column(self, text: Column) -> Column:
        hit = F.lit(False)
        if self.kind == "mapping":
            out = F.lit(None).cast("string")
            for label, words in reversed(self.labels.items()):
                any_word = F.lit(False)
                for w in words:
                    any_word = any_word | text.contains(w)
                out = F.when(any_word, F.lit(label)).otherwise(out)
            return out
        for v in self.values:
            hit = hit | (text.contains(v) if self.kind == "keyword" else text.rlike("(?sU)" + v))
        return F.when(hit, F.lit("true"))

    def sql(self, text: str) -> str:
        """The same for an SQL engine with contains() and RE2 patterns."""
        q = lambda s: "'" + s.replace("'", "''") + "'"
        any_of = lambda words: " OR ".join(f"contains({text}, {q(w)})" for w in words)
        if self.kind == "mapping":
            return "CASE " + " ".join(f"WHEN {any_of(w)} THEN {q(k)}" for k, w in self.labels.items()) + " END"
        hits = any_of(self.values) if self.kind == "keyword" else " OR ".join(f"regexp_matches({text}, {q(v)})" for v in self.values)
        return f"CASE WHEN {hits} THEN 'true' END"


def rules_from_json(text: str) -> dict[str, Rule]:
    """A rule pack: field -> {type: keyword, regex or mapping, and keywords, patterns or mappings}."""
    out = {}
    for name, told in json.loads(text).items():
        kind = told["type"]
        if kind not in ("keyword", "regex", "mapping"):
            raise ValueError(f"{name} has no known type: {kind}")
        out[name] = Rule(name, kind, told.get("keywords") or told.get("patterns") or [], told.get("mappings") or {})
    return out


def _k(name: str, *values: str) -> Rule:
    return Rule(name, "keyword", list(values))


def _r(name: str, *values: str) -> Rule:
    return Rule(name, "regex", list(values))


def _m(name: str, **labels: list[str]) -> Rule:
    return Rule(name, "mapping", labels=labels)


#: Our rule pack for invented prose in four languages: 27 fields in five groups.
RULES = {
    "sound": [_k("hard", "strike", "thst"), _m("suffix", verbal=["ering"], abstract=["tion"], state=["ment"]), _k("nasal", "ndth"), _r("adverb", "[a-z]+ly "), _k("cluster", "entst", "ouer"), _r("linked_article", "(and|und|et) the"), _k("ornament", "###", "***")],
    "noun": [_k("pronoun", " he ", " il "), _k("able_or_eau", "able", "eau"), _r("three_digits", "[0-9]{3}"), _k("quality", "heit"), _m("kind", money=["$"], collective=["ung", "eaux"], land=["land"])],
    "ending": [_k("erth", "erth"), _m("letters", sh=["sh "], le=["le "], er=["er "]), _k("mort", "death", "mort"), _r("from_to", "(of|de|der) [a-z]+ (to|a|zu)"), _r("digits", "[0-9]+"), _k("restored", "restor"), _k("echo", "onon"), _k("pointing", "This", "this")],
    "joint": [_k("and_word", " and ", " und ", " et "), _k("organ", "org"), _m("turn", first=["erst"], helping=["help", "reed"])],
    "setting": [_k("inside", " in "), _k("beside", " at "), _k("night", "nacht", "nuit"), _r("address", "https?://", "@[a-z]+")],
}
FIELDS = {f"{group}_{r.name}": r for group, rules in RULES.items() for r in rules}

#: Our lexicon: class -> keywords; a keyword may stand in several classes.
LEXICON = {
    "english": ["the", "and", "that", "with", "this", "for"],
    "french": ["le", "la", "les", "des", "par", "un"],
    "german": ["der", "die", "und", "ein", "das", "nicht"],
    "spanish": ["el", "la", "los", "que", "del", "un"],
    "place": ["in", "at", "on", "en", "par"],
}
STOP_WORDS = ["the", "and", "of", "to", "in", "is", "it", "le", "la", "de", "et", "der", "die", "und", "el", "que"]
