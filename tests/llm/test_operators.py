"""Each operator against a brute-force version, a round trip or held-out accuracy."""

import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import xxhash
from casemill.llm import decontaminate, hashing, interleave, licenses, lines, neardup, packing, quality, quality_rules, queries, simhash, tokens, url_filter
from tokenizers import Tokenizer

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, line string"


def frame(spark, texts, sources=None):
    """documents with extra columns whose names operators use within."""
    rows = [(i if not isinstance(t, tuple) else t[0], t if not isinstance(t, tuple) else t[1], "en", sources[i] if sources else "s", 0, 1, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def documents(spark, n=10**9):
    return spark.read.parquet(f"{DATA}/documents.parquet")


ODD = [None, "", " \n\t", "a", "a b c", "Ünï çödé 🙂 text", "x" * 60_000, "one two three " * 3000, (7, None), (4, "a b c"), (4, "a b c"), (None, "null id"), (None, None)]


@pytest.mark.parametrize("make", [
    interleave.interleave and (lambda d: interleave.interleave(d, 5)),
    tokens.count_tokens, licenses.scan, quality_rules.apply_rules, lines.dedup_lines, simhash.near_duplicates, packing.pack_documents,
    lambda d: decontaminate.judge(d, d.sparkSession.createDataFrame([(1, "one two three one two three"), (2, None), (None, "x y z")], "item_id long, text string")),
    lambda d: quality.classify(d, d.sparkSession.createDataFrame([(0, 1), (1, 0), (5, 1), (6, 0), (7, None)], "doc_id long, quality int")),
    neardup.keep_one, lines.remove_lines,
])
def test_odd_rows_and_empty_tables(spark, make):
    given = frame(spark, ODD)
    every = Counter(r["doc_id"] for r in given.collect())
    made = make(given).collect()
    ids = Counter((r["doc_id"], r["sequence_id"]) if "sequence_id" in r else r["doc_id"] for r in made)
    if "sequence_id" in (made[0] if made else ()):  # packing: each row's pieces, whose tokens add up
        first = Counter(r["doc_id"] for r in made if r["piece"] == 0)
        assert first == every
    elif make is neardup.keep_one:  # without words: 0, 1, 2 and 7's null; of `a b c` one; null ids stay
        assert ids == Counter({0: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, None: 2})
    else:
        assert ids == every
    assert make(given.limit(0)).count() == 0


def test_odd_rows_of_filters(spark):
    """Rows that a filter keeps keep all their columns, repeated ones their number."""
    given = frame(spark, ODD)
    benchmark = spark.createDataFrame([(1, "one two three one two three"), (2, None)], "item_id long, text string")
    kept = decontaminate.clean(given, benchmark)
    assert Counter(kept.collect()) == Counter(r for r in given.collect() if not (r["text"] or "").startswith("one two three")) and kept.columns == given.columns
    labels = spark.createDataFrame([(0, 1), (1, 0), (5, 1), (6, 0), (7, None)], "doc_id long, quality int")
    scored = Counter((r["doc_id"], r["predicted"]) for r in quality.classify(given, labels).collect())
    ranker = quality.fit(quality.training_rows(given, labels))
    good = quality.score(given, ranker, keep=True)
    assert Counter(good.collect()) - Counter(given.collect()) == Counter() and good.columns == given.columns
    assert good.count() == sum(n for (_, p), n in scored.items() if p == 1)
    assert quality.score(given.limit(0), ranker, keep=True).count() == 0 == decontaminate.clean(given.limit(0), benchmark).count()


def test_odd_pages(spark):
    urls = [None, "", "://", "http://", "http://A.b/x", "http://A.b/x", "u" * 50_000, "http://ünï.de/ä?q#f"]
    pages = spark.createDataFrame([(i, u, "h", "b", 1, True) for i, u in enumerate(urls)] + [(4, "http://A.b/x", "h", "b", 1, True), (None, "http://a.b/x", "h", "b", 1, True)], "page_id long, url string, host string, block string, w0 long, listed boolean")
    listed = spark.createDataFrame([("a.b/x",), (None,)], "canonical string")
    got = url_filter.judge(pages, listed, queries.URL_RULES).collect()
    assert Counter(r["page_id"] for r in got) == Counter([0, 1, 2, 3, 4, 4, 5, 6, 7, None])
    assert {r["page_id"]: r["listed"] for r in got} == {0: False, 1: False, 2: False, 3: False, 4: True, 5: True, 6: False, 7: False, None: True}
    assert url_filter.judge(pages, listed.limit(0), queries.URL_RULES).filter("listed").count() == 0 == url_filter.judge(pages.limit(0), listed, queries.URL_RULES).count()


def test_url_rules_and_list(spark):
    urls = ["https://A.Example.com/en/7", "http://x.com/en/1", "http://net/de/", "http://b.example.net/de/81?x", "http://notnet/de/", "http://www.spam-farm.example.org/fr/1/?utm_source=a#t", "http://spam-farm.example.org/fr/1", None, "no scheme", "http://h?q/en/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    listed = spark.createDataFrame([("spam-farm.example.org/fr/1",), (None,)], "canonical string")
    got = {r["page_id"]: r for r in url_filter.judge(pages, listed, queries.URL_RULES).collect()}
    assert [got[i]["rule"] for i in range(5)] == ["example.com/en/7", "com/en/", "net/de/", "example.net/de/8", None]
    assert [got[i]["verdict"] for i in range(10)] == ["allow", "block", "allow", "block", "allow", "block", "block", "allow", "allow", "allow"]
    assert (got[9]["host"], got[9]["path"], got[7]["host"]) == ("h", "", "")


def test_bloom_filter_has_no_false_negative_and_few_false_positives(spark):
    keys = spark.range(3000).selectExpr("concat('u', id) key")
    blocks, n = url_filter.bloom_blocks(keys, "key", 3000)
    assert url_filter.possible_hits(keys, "key", blocks, n).count() == 3000
    assert url_filter.possible_hits(spark.range(3000).selectExpr("concat('v', id) key"), "key", blocks, n).count() < 90


@pytest.mark.parametrize("cell", [7, 50_000])
def test_shards_follow_the_mixture(spark, cell):
    docs = documents(spark)
    rows = interleave.interleave(docs, 6, cell_rows=cell).collect()
    n, by = len(rows), defaultdict(list)
    assert n == docs.count() and Counter(r["doc_id"] for r in rows).most_common(1)[0][1] == 1
    for r in rows:
        by[r["shard"]].append(r)
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    share = Counter(r["source"] for r in rows)
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        for s, c in Counter(r["source"] for r in own).items():
            assert abs(c - share[s] * len(own) / n) <= 2
    order = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    assert [r["fraction"] for r in order] == sorted(r["fraction"] for r in rows)
    texts = {r["doc_id"]: r["text"].encode() for r in docs.collect()}
    assert all(r["text_crc32"] == zlib.crc32(texts[r["doc_id"]]) and r["size"] == len(texts[r["doc_id"]]) + 8 for r in rows)


def test_quality_ranks_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op4_quality_ranker(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    good, bad = ([r["score"] for r in rows if labels[r["doc_id"]] == k] for k in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    right = np.mean([r["predicted"] == labels[r["doc_id"]] for r in rows])
    print("AUC", auc, "accuracy", right)
    assert auc > 0.9 and right > 0.9


def test_token_counts_equal_the_library(spark):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [r["text"] for r in documents(spark).collect()]
    rng = random.Random(1)
    texts += ["".join(rng.choice("aeiou tnrs'lld\n\t  .,09é🙂中　\x85") for _ in range(rng.randint(0, 300))) for _ in range(300)]
    texts += ["a<|endoftext|>b<|endoftext|>", "<|endoftext|>", "<|endoftext|", "ab" * 5000, "   \n\n  x", None]
    got = {r["doc_id"]: r for r in tokens.count_tokens(frame(spark, texts)).collect()}
    for i, x in enumerate(texts):
        n = len(t.encode(x or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["over_limit"], got[i]["n_bytes"]) == (n, n > 1024, len((x or "").encode()))


def test_license_alignment(spark):
    mit = licenses.TEMPLATES["MIT-text"]
    texts = ["intro words here " + licenses.TEMPLATES["Apache-2.0"] + " and more", "/* " + mit.replace("free of charge", "at no cost") + " */", "version the license under licensed apache", "plain text", licenses.TEMPLATES["GPL-3.0"] + "\n" + licenses.TEMPLATES["MIT"]]
    rows = {r["doc_id"]: r for r in licenses.scan(frame(spark, texts)).collect()}
    assert [rows[i]["license"] for i in range(4)] == ["Apache-2.0", "MIT-text", None, None]
    assert sorted(rows[4]["licenses"]) == ["GPL-3.0", "MIT"] and (rows[0]["first_word"], rows[0]["end_word"]) == (3, 10)
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("abcdefghij") for _ in range(rng.randint(0, 14))] for _ in "ab")
        pairs = licenses.align(a, b)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:])) and all(a[i] == b[j] for i, j in pairs)
        assert len(pairs) <= decontaminate.lcs(a, b)
    found = {r["doc_id"] for r in queries.op6_license_scan(spark, DATA).collect() if r["license"]}
    assert found == {r["doc_id"] for r in documents(spark).collect() if any(licenses.TEMPLATES[k] in r["text"] for k in ("Apache-2.0", "MIT", "GPL-3.0", "CC-BY-NC-4.0"))}


def test_full_license_texts(spark):
    t = licenses.TEMPLATES
    long = ["BSD-2-Clause", "BSD-3-Clause", "ISC", "MIT-full", "Apache-2.0-header", *(f"{k}-notice" for k in licenses.KINDS)]
    edited = [" ".join(w for i, w in enumerate(("Copyright 2020 Someone. " + t[k]).split()) if i % 23 != 20) for k in long]
    texts = [f"first words\n{t[k]}\nlast words" for k in long] + edited
    texts += ["This work is licensed under the GNU Lesser General Public License, version 3.", t["MIT-text"] + " something else", "x " * 5000 + t["ISC"] + " y" * 5000]
    got = {r["doc_id"]: (r["license"], r["first_word"], r["licenses"]) for r in licenses.scan(frame(spark, texts)).collect()}
    n = len(long)
    assert [got[i][:2] for i in range(n)] == [(k, 2) for k in long]
    for i, k in enumerate(long):  # a shorter template of the same license may be covered better than the full text
        assert k in got[n + i][2] and got[n + i][0][:3] == k[:3]
    assert got[2 * n][0] is None and got[2 * n + 1][0] == "MIT-text" and got[2 * n + 2][:2] == ("ISC", 5000)


def test_licenses_of_kin_are_told_apart(spark):
    texts = ["Licensed under CC BY 4.0.", "Licensed under CC BY-NC 3.0.", "Released under the BSD License.", "Released under the GPL License.", "This work is licensed under the GNU General Public License, version 2.",
             "Licensed under the Apache License, Version 1.1.", "Licensed under CC BY-NC 4.0.", "Released under the MIT License.", licenses.TEMPLATES["BSD"] + " 1. keep 2. keep 3. no endorsement"]
    got = {r["doc_id"]: r["license"] for r in licenses.scan(frame(spark, texts)).collect()}
    assert [got[i] for i in range(9)] == [None] * 6 + ["CC-BY-NC-4.0", "MIT", "BSD"]
    mit = licenses.TEMPLATES["MIT-full"]
    free = mit.replace(", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "")
    texts = [free, licenses.TEMPLATES["BSD-4-Clause"], "This is not released under the MIT License.", "We are not sure. What follows is clear to all: Released under the MIT License.", licenses.TEMPLATES["LGPL-2.1-notice"].replace("This program", "This library"), "Licensed under the GNU GPL v3.", mit]
    got = {r["doc_id"]: r["license"] for r in licenses.scan(frame(spark, texts)).collect()}
    assert [got[i] for i in range(7)] == [None, "BSD-4-Clause", None, "MIT", "LGPL-2.1-notice", "GPL-3.0-short", "MIT-full"]


def slow_pack(lengths, capacity):
    waiting, bins = sorted(lengths, reverse=True), []
    while waiting:
        room, inside = capacity, []
        while fits := [x for x in waiting if x <= room]:
            inside.append(max(fits))
            waiting.remove(inside[-1])
            room -= inside[-1]
        if room and waiting:
            smallest = inside[-1]
            best, pair = smallest, None
            for i, a in enumerate(waiting):
                for b in waiting[i + 1 :]:
                    if best < a + b <= room + smallest:
                        best, pair = a + b, (a, b)
            if pair:
                inside.remove(smallest)
                for x in pair:
                    waiting.remove(x)
                waiting = sorted([*waiting, smallest], reverse=True)
                inside += pair
        bins.append(sorted(inside))
    return bins


def test_pack_equals_slow_best_two_fit():
    rng = random.Random(17)
    for _ in range(200):
        n = sorted((rng.randint(1, 60) for _ in range(rng.randint(0, 30))), reverse=True)
        assert [sorted(n[i] for i in b) for b in packing.pack(n, 60)] == slow_pack(n, 60)


def test_ids_equal_the_library():
    own, rng = tokens.Ids("byte_bpe_50k.json"), random.Random(18)
    texts = ["", "<|endoftext|> x", "a" * 3000, " " * 3000, *("".join(rng.choice("aeiou tnrs'lld\n\t  .,09\u00e9\U0001f642\u4e2d\u3000\x85\u00b2\u00bd\x1c\xa0\u0301A_'S") for _ in range(rng.randint(0, 300))) for _ in range(500))]
    assert own.fast and all(own.encode(x).tolist() == own.library.encode(x, add_special_tokens=False).ids for x in texts)


def test_rules_in_any_order_give_one_verdict(spark):
    docs = documents(spark)
    rules = quality_rules.RULES
    one = {r["doc_id"]: r["kept"] for r in quality_rules.apply_rules(docs).collect()}
    two = {r["doc_id"]: r["kept"] for r in quality_rules.apply_rules(docs, rules[::-1], {}).collect()}
    assert one == two and 0.7 < np.mean(list(one.values()))
    costs = {"symbols": (1.0, 0.1), "shouting": (0.1, 0.1), "exclamations": (1.0, 0.0)}
    assert [r.name for r in quality_rules.ordered(rules[:3], costs)] == ["shouting", "symbols", "exclamations"]


def test_rules_are_estimated_on_what_passes_the_base(spark):
    plain = " ".join(f"word{i}" for i in range(30))
    texts = [plain] * 3 + [plain + " " + "#" * 20] + ["too short"] * 6 + ["again and again " * 20, "", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    figures = quality_rules.estimate(docs, quality_rules.RULES)
    assert {name: share for name, (_, share) in figures.items()} == {r.name: 0 for r in quality_rules.RULES} | {"symbols": 0.25}
    assert all(cost >= 0 for cost, _ in figures.values())
    assert quality_rules.estimate(docs.limit(0), quality_rules.RULES) == {}
    assert [r["kept"] for r in quality_rules.apply_rules(docs).orderBy("doc_id").collect()] == [True] * 3 + [False] * 10


def test_costly_rules(spark):
    """What only counting words, runs of words and paragraphs can tell; plain texts pass."""
    plain = [f"word{i}" for i in range(400)]
    texts = {
        None: " ".join(plain), "one_word": " ".join(x if i % 3 else "same" for i, x in enumerate(plain)),
        "repeated_trigrams": " ".join(f"{'p q r s t'.split()[i % 5]} {'u v w'.split()[i % 3]}" for i in range(60)),
        "repeated_paragraphs": "\n\n".join([" ".join(plain[:3])] * 5 + [" ".join(plain)]),
    }
    for name, text in texts.items():
        t = quality_rules.measured(text.encode())
        hits = [r.name for r in quality_rules.RULES if r.rejects(t)]
        assert (name in hits) if name else not hits
    few = quality_rules.measured(" ".join(f"v{i % 9}" for i in range(900)).encode())
    assert "few_words" in [r.name for r in quality_rules.RULES if r.rejects(few)]


def slow_repeats(words, size=8):
    grams = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]
    c = Counter(grams)
    return len({p for i, g in enumerate(grams) if c[g] > 1 for p in range(i, i + size)})


def test_repeated_words():
    rng = random.Random(3)
    for _ in range(200):
        w = [rng.choice([b"a", b"b"]) for _ in range(rng.randint(0, 60))]
        assert quality_rules.repeated_words(w) == slow_repeats(w)


def slow_line_dedup(rows, t):
    seen, out = [], {}
    for doc, text in sorted((d, x) for d, x in rows if d is not None and x is not None):
        for k, line in enumerate(text.encode().lower().split(b"\n")):
            s = frozenset(line.split())
            if s:
                out[doc, k] = any(len(s & o) * t.denominator >= len(s | o) * t.numerator for o in seen)
                seen.append(s)
    return {k for k, gone in out.items() if gone}


def removed(df):
    return {(r["doc_id"], k) for r in df.collect() for k in r["removed"]}


@pytest.mark.parametrize("cell", [3, 20_000])
def test_line_dedup_equals_brute_force(spark, cell):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 25))] for _ in range(12)]

    def varied():
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        return " ".join(w)

    rows = [(d, "\n".join(varied() for _ in range(rng.randint(0, 6)))) for d in range(80)] + [(None, varied()), (99, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = slow_line_dedup(rows, Fraction(4, 5))
    assert removed(lines.removed_lines(df, cell_rows=cell)) == want and want
    got = {r["doc_id"]: r["text"] for r in lines.remove_lines(df).collect()}
    for d, x in rows:
        assert got[d] == (x if x is None or d is None else "\n".join(y for k, y in enumerate(x.split("\n")) if (d, k) not in want))


def test_line_dedup_with_a_hot_word_and_failing_partners(spark):
    """A word that fills several cells beside rare words, and lines whose nearest partners aren't true ones."""
    rng = random.Random(15)
    rows = []
    for d in range(60):
        own = [f"hot {rng.choice('abcdef')} {rng.choice('ghij')}" for _ in range(3)]
        own.append(" ".join(["rare", f"r{rng.randrange(20)}", *rng.sample([f"x{k}" for k in range(14)], 11)]))
        rows.append((d, "\n".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = slow_line_dedup(rows, Fraction(4, 5))
    assert removed(lines.removed_lines(df, cell_rows=8)) == want and len(want) > 60


def test_words_of_pieces_and_lines(monkeypatch):
    rng = random.Random(16)
    texts = [b"", b"\n\n", b" a\x0bB\n c ", b"x" * 3000, *("".join(rng.choice("abAB \n\t\x1c\xa0\u00e9") for _ in range(rng.randint(0, 4000))).encode() for _ in range(30))]
    want = [(i, k, w) for i, x in enumerate(texts) for k, y in enumerate(x.lower().split(b"\n")) for w in y.split()]
    for size in (64, 1000, 1 << 18):
        monkeypatch.setattr(hashing, "PIECE", size)
        hashing._tables.cache_clear()
        got = [x for b in hashing.words_of(texts) for x in zip(*(a.tolist() for a in b), strict=True)]
        whole = [x for b in lines.whole_lines(texts) for x in zip(*(a.tolist() for a in b), strict=True)]
        assert got == whole and [x[:2] for x in got] == [x[:2] for x in want]
        assert len(set(zip((x[2] for x in got), (x[2] for x in want), strict=True))) == len({x[2] for x in got}) == len({x[2] for x in want})
    hashing._tables.cache_clear()


def test_line_dedup_of_rows_that_share_an_id(spark):
    line = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    df = spark.createDataFrame([(1, "one two three"), (1, f"four five six\n{line}"), (2, f"{line} other")], "doc_id long, text string")
    assert removed(lines.removed_lines(df)) == {(2, 0)}


@pytest.mark.parametrize("parts", [1, 2])
def test_line_dedup_keeps_one_of_equal_rows(spark, parts):
    """In one batch and in two; later rows of the id lose only their own lines."""
    text = "alpha beta gamma\n\ndelta epsilon zeta eta"
    rows = [(1, text, 0), (1, "theta iota\nkappa lambda\nalpha beta gamma", 0), (1, text, parts - 1), (2, "mu nu xi\nkappa lambda", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part int").repartitionByRange(parts, "part")
    assert df.rdd.getNumPartitions() == parts
    got = sorted((r["doc_id"], r["text"], r["n_removed"]) for r in lines.dedup_lines(df).collect())
    assert got[-1] == (2, "mu nu xi", 1)
    kept = Counter(x for _, one, _ in got for x in one.split("\n") if x)
    assert kept == Counter(["alpha beta gamma", "delta epsilon zeta eta", "theta iota", "kappa lambda", "mu nu xi"])
    assert sorted(n for _, _, n in got) in ([0, 1, 1, 2], [0, 1, 1, 3])


def test_line_dedup_on_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    assert removed(lines.removed_lines(documents(spark))) == slow_line_dedup(rows, Fraction(4, 5))


def slow_fingerprint(text):
    w = text.encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(ids, linked):
    least = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(least[a], least[b])
            if least[a] != m or least[b] != m:
                least[a] = least[b] = m
                changed = True
    return least


def test_simhash_equals_brute_force(spark):
    texts = [r["text"] for r in documents(spark).collect()]
    rng = random.Random(5)
    for _ in range(60):
        w = rng.choice(texts[:40]).split(" ")
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += ["", "  ", "a", "A b"]
    fp = [slow_fingerprint(t) for t in texts]
    pairs = [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 2]
    want = slow_components(range(len(fp)), pairs)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(frame(spark, texts)).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(got[i]["fingerprint"] == f"{fp[i]:016x}" for i in got)
    assert any(i != c for i, c in want.items())


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_near_duplicates_reach_recall(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.collect()
    s = {r["doc_id"]: shingles(r["text"]) for r in rows}
    most = sorted(s, key=lambda i: len(s[i]))
    pairs = {(min(a, b), max(a, b)) for k, a in enumerate(most) for b in most[k + 1 :] if len(s[b]) * 4 <= len(s[a]) * 5 and not s[a].isdisjoint(s[b])}
    true = [(a, b) for a, b in pairs if len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b])]
    want = slow_components(s, true)
    each, texts = neardup.groups(docs)
    got = {r["doc_id"]: r["component"] for r in each.join(texts, "key").collect()}
    found = np.mean([got[a] == got[b] for a, b in true])
    print("recall", found, "of", len(true))
    assert found >= 0.9
    assert all(want[i] == want[c] for i, c in got.items())  # no link that brute force lacks
    assert sorted(r["doc_id"] for r in neardup.keep_one(docs).collect()) == sorted(set(got.values()))


def test_near_duplicates_with_added_blocks_meet():
    """Recall of candidates by band of similarity, kind of edit and length, over texts of sf0.1."""
    import pyarrow.parquet as pq

    rng = random.Random(10)
    texts = [w for x in pq.read_table("/root/testdata/sf0.1/documents.parquet")["text"].to_pylist() if x and len(w := x.split()) >= 40]
    pool = [w for x in texts[:300] for w in x]
    for least, most in ((40, 150), (150, 600), (600, 2500), (2500, 10**9)):
        own = [x for x in texts if least <= len(x) < most]
        for kind in ("appended", "prepended", "scattered"):
            met = defaultdict(list)
            for _ in range(4000):
                if min(len(met[0.80]), len(met[0.85])) >= 60:
                    break
                w = rng.choice(own)[: 2 * least + 2000]
                share = rng.uniform(0.12, 0.25)
                at = rng.randrange(len(pool) - len(w))
                block = pool[at : at + int(share * len(w))]
                v = w + block if kind == "appended" else block + w
                if kind == "scattered":
                    v = list(w)
                    for _ in range(max(1, int(share * len(w) / 11))):
                        v[rng.randrange(len(v))] = rng.choice(pool)
                a, b = (" ".join(x).encode() for x in (w, v))
                (_, wa), (_, wb) = neardup.word_hashes([a, b])
                sa, sb = neardup.shingled(wa), neardup.shingled(wb)
                ha, hb = neardup.distinct(sa), neardup.distinct(sb)
                n = len(np.intersect1d(ha, hb))
                near = n / (len(ha) + len(hb) - n)
                band = 0.80 if 0.80 <= near < 0.85 else 0.85 if 0.85 <= near < 0.9 else None
                if band is None or len(met[band]) >= 60:
                    continue
                words = any((x ^ y).bit_count() <= 2 for x, y in zip(neardup.word_fingerprints(wa), neardup.word_fingerprints(wb)))
                shingled = any(x == y for x, y in zip(neardup.bands(ha), neardup.bands(hb)))
                close = (simhash.majority(sa) ^ simhash.majority(sb)).bit_count() <= neardup.NEAR
                met[band].append((close and (words or shingled), close and words))
            for band, found in sorted((k, v) for k, v in met.items() if k):
                print(least, kind, band, len(found), "found", np.mean([x for x, _ in found]), "by words only", np.mean([x for _, x in found]))
                assert len(found) >= 20 and np.mean([x for x, _ in found]) >= 0.9


def drifting(rng, n):
    """Texts of 200 words; each has two words of the one before replaced by others of the text."""
    vocabulary = [f"w{i}" for i in range(120)]
    w, out = [rng.choice(vocabulary) for _ in range(200)], []
    for _ in range(n):
        out.append(" ".join(w))
        w = list(w)
        for _ in range(2):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
    return out


@pytest.mark.parametrize("cell", [3, 2000])
def test_near_duplicates_of_drifting_and_reordered_texts(spark, cell, monkeypatch):
    monkeypatch.setattr(neardup, "CELL_ROWS", cell)
    rng = random.Random(9)
    texts = drifting(rng, 30)
    w = texts[0].split(" ")
    for _ in range(15):  # pairs of copies among texts of the same words
        rng.shuffle(w)
        copy = list(w)
        copy[100], copy[101] = copy[101], copy[100]
        texts += [" ".join(w), " ".join(copy)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    texts = [texts[i] for i in order]
    s = [shingles(x) for x in texts]
    codes = [neardup.word_fingerprints(h) for _, h in neardup.word_hashes([x.encode() for x in texts])]
    true = [(i, j) for j in range(len(texts)) for i in range(j) if len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j]) and any((x ^ y).bit_count() <= 2 for x, y in zip(codes[i], codes[j]))]
    each, found = neardup.groups(frame(spark, texts))
    got = {r["doc_id"]: r["component"] for r in each.join(found, "key").collect()}
    assert got == slow_components(range(len(texts)), true) and len(set(got.values())) < 20


def test_decontamination_finds_items_and_paraphrases(spark):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    plain = [r["text"] for r in documents(spark).collect()][:60]
    rng = random.Random(6)
    texts, want = [], {}
    for i, t in enumerate(plain):
        w = t.split(" ")
        if i % 2:
            k, passage = items[i % len(items)]
            p = passage.split(" ")
            if i % 4 == 1:  # one word in eight is another
                p = [rng.choice(["Other", "thing"]) if j % 8 == 3 else x for j, x in enumerate(p)]
            at = rng.randrange(len(w))
            w[at:at] = p
            want[i] = k
        texts.append(" ".join(w))
    got = {r["doc_id"]: r for r in decontaminate.judge(frame(spark, texts), spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
    assert all(want[i] in got[i]["item_ids"] for i in want)
    full = {}
    for i, t in enumerate(texts):
        w = decontaminate.tokens(t)
        full[i] = any(decontaminate.lcs(w[max(0, s - 10) : s + 90], decontaminate.tokens(x)) >= 0.6 * len(decontaminate.tokens(x)) for _, x in items for s in range(0, len(w), 40))
    assert all(full[i] for i in got if got[i]["contaminated"])


@pytest.mark.parametrize("n_items", [40, 200, 2000])
def test_decontamination_reaches_recall_by_item_length(spark, n_items):
    """Items whole, or with an eighth of the words changed, within real text, against brute force."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rng = random.Random(12)
    texts = [w for r in docs.select("text").limit(6000).collect() if len(w := decontaminate.tokens(r["text"])) >= 250]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").orderBy("item_id").collect()][:n_items]
    own, others = texts[::2], texts[1::2]
    while len(items) < n_items:
        w, n = rng.choice(own), rng.randint(15, 59)
        at = rng.randrange(len(w) - n)
        items.append((10**6 + len(items), " ".join(w[at : at + n])))
    index = decontaminate.build_index(docs, items)
    found = defaultdict(list)
    for k in [k % n_items for k in range(max(1200, n_items))]:
        item, w = index.items[k][1], rng.choice(others)
        at = rng.randrange(len(w) - 220)
        for kind in ("whole", "edited"):
            p = [rng.choice(w) if kind == "edited" and rng.random() < 0.12 else x for x in item]
            text = w[at : at + 100] + p + w[at + 100 : at + 200]
            if decontaminate.lcs(text, item) >= decontaminate.SURE * len(item):
                found[kind, min(4, (len(item) - 1) // 10)].append(k in decontaminate.hits(text, index, decontaminate.COSINE))
    for key, hit in sorted(found.items()):
        print(n_items, "items, rank", index.latent.shape[1], key[0], f"{10 * key[1] + 1}+ words", np.mean(hit), "of", len(hit))
    assert all(np.mean(hit) >= 0.97 for hit in found.values())


def test_rows_that_share_an_id_or_have_none_are_filtered_by_their_own_text(spark):
    rng = random.Random(14)
    leak, other, third = (" ".join(f"{c}{rng.randrange(10**6)}" for _ in range(20)) for c in "abc")
    plain = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(80)) for _ in range(3)]
    benchmark = spark.createDataFrame([(1, leak), (1, third), (2, other)], "item_id long, text string")
    docs = frame(spark, [(None, f"{plain[0]} {leak}"), (None, plain[0]), (5, f"{plain[1]} {third}"), (5, plain[1]), (6, plain[2]), (6, f"{other} {plain[0]}")])
    got = Counter((r["doc_id"], r["contaminated"], tuple(r["item_ids"])) for r in decontaminate.judge(docs, benchmark).collect())
    assert got == Counter([(None, True, (1,)), (None, False, ()), (5, True, (1,)), (5, False, ()), (6, False, ()), (6, True, (2,))])
    assert sorted(r["text"] for r in decontaminate.clean(docs, benchmark).collect()) == sorted(plain)
    docs = frame(spark, [(1, plain[0]), (1, plain[1]), (1, plain[0]), (2, plain[1] + " x"), (3, plain[2]), (None, plain[2])])
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in neardup.keep_one(docs).collect())
    assert kept == sorted([(1, plain[0]), (1, plain[1]), (3, plain[2]), (0, plain[2])])


def test_lcs():
    rng = random.Random(7)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in "ab")
        d = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1, j + 1] = d[i, j] + 1 if x == y else max(d[i, j + 1], d[i + 1, j])
        assert decontaminate.lcs(a, b) == d[-1, -1]


def test_packing_round_trip(spark):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [r["text"] for r in documents(spark).collect()] + ["", None, "<|endoftext|> x", "word " * 9000]
    rows = packing.pack_documents(frame(spark, texts), group_pieces=60).collect()
    by, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append(r)
    for i, x in enumerate(texts):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        own = sorted(by[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(ids)
        assert all(r["length"] == 2048 for r in own[1:]) and (len(own) == 1) == (len(ids) <= 2048)
        at = 0
        for r in own:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
    for own in seqs.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    total = sum(r["length"] for r in rows)
    assert len(seqs) <= 1.05 * -(-total // 2048) + 8


def test_pack_uses_each_piece_once():
    rng = random.Random(8)
    for _ in range(100):
        n = [rng.randint(1, 100) for _ in range(rng.randint(0, 80))]
        bins = packing.pack(n, 100)
        assert sorted(i for b in bins for i in b) == list(range(len(n))) and all(sum(n[i] for i in b) <= 100 for b in bins)


def test_pipeline(spark):
    import corpus_pipeline
    from casemill.llm.common import stash, table

    docs = table(spark, DATA, "documents")
    n = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stash(stage(spark, docs, DATA), name)
        if name != "packing":
            assert docs.columns == table(spark, DATA, "documents").columns
            n.append(docs.count())
    assert n == sorted(n, reverse=True) and n[-1] > 0.5 * n[0]
    assert docs.count() == corpus_pipeline.run(spark, DATA).count()
