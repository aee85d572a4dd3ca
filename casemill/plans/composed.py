"""Composed pipelines, each as one query: sinks read back, packs from files, mining, comparison, evaluation."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import batched, metrics, mining, pairs, sparse, vectors
from ..schema import cases
from ..session import new_folder, stash
from ..sources import files, matrix, packs
from ..streaming.score_cache import ScoreCache
from . import more as M
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


# --- sinks


@query(f"WITH {O.SPARSE_BASE} SELECT case_id, dim, round(weight, 6) AS weight FROM matrix")
def matrix_roundtrip(spark, d):
    """The sparse matrix written in blocks and read back."""
    path = new_folder(spark, "matrix")
    matrix.write_matrix(sparse.matrix_rows(cases(spark, d)), path)
    return matrix.read_matrix(spark, path).withColumn("weight", F.round("weight", 6))


@query(f"WITH {O.SPARSE_BASE} SELECT case_id, dim, round(weight, 6) AS weight FROM matrix WHERE case_id BETWEEN 100 AND 180")
def matrix_rows_between(spark, d):
    """A range of its rows, read from the blocks that hold it."""
    path = new_folder(spark, "matrix")
    matrix.write_matrix(sparse.matrix_rows(cases(spark, d)), path)
    return matrix.read_matrix(spark, path, 100, 180).withColumn("weight", F.round("weight", 6))


@query(f"WITH {O.CASES}, {O.EMB} SELECT e.case_id, round(v[1], 5) AS first_value, round(v[64], 5) AS last_value, len(v) AS dims, array_to_string(articles, '|') AS articles FROM emb e JOIN cases USING (case_id)")
def embedding_table(spark, d):
    """Vectors and articles written as one table and read back."""
    path = new_folder(spark, "embeddings")
    rows = Q.embeddings(spark, d).join(cases(spark, d).select("case_id", "articles"), "case_id")
    files.write_embeddings(rows, path)
    got = spark.read.parquet(path)
    value = lambda i: F.round(F.element_at("embedding", i).cast("double"), 5)
    return got.select("case_id", value(1).alias("first_value"), value(-1).alias("last_value"), F.size("embedding").cast("long").alias("dims"), F.array_join("articles", "|").alias("articles"))


@query(f"WITH {O.EMB}, {O.CENT} SELECT label, count(*) AS n, round(any_value(avg_std), 6) AS avg_std, round(min(d), 6) AS min_dist, round(max(d), 6) AS max_dist FROM (SELECT label, avg_std, list_distance(v, c) AS d FROM emb JOIN cvec ON label = predicted) GROUP BY label")
def centroid_summary(spark, d):
    """Centroids written with their figures; the figures read back."""
    path, rows = new_folder(spark, "centroids"), Q.labelled(spark, d)
    files.write_centroids(vectors.centroid_vectors(rows), vectors.spread(rows), path)
    got = spark.read.schema("label int, n long, avg_std double, min_dist double, max_dist double").json(f"{path}/summary")
    return got.select("label", "n", *(F.round(c, 6).alias(c) for c in ("avg_std", "min_dist", "max_dist")))


@query(f"WITH {O.HITS}, m AS ({O.metric_rows('hits')}) SELECT 0::INTEGER AS place, 'retrieval' AS line UNION ALL SELECT (row_number() OVER (ORDER BY k))::INTEGER, 'k: ' || k || ', n_queries: ' || n_queries FROM m")
def report_text(spark, d):
    """A text report of the retrieval metrics, written and read back as lines."""
    path = new_folder(spark, "report")
    files.write_report("retrieval", Q.retrieval_metrics(spark, d).select("k", "n_queries"), path)
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.rtrim(F.col("value"), F.lit("\n")), "\n")).alias("place", "line"))
    return lines.filter("line <> ''")


# --- rule packs from files


GOOD_PACK = {"mark": {"loud": {"type": "regex", "patterns": ["!{2,}", "[A-Z]{4,}"]}, "money": {"type": "keyword", "keywords": ["$", "€"]}}, "tone": {"type": "mapping", "mappings": {"asking": ["?"], "telling": ["."]}}}
BAD_PACK = {"mark": {"digits": {"type": "regex", "patterns": ["[0-9]{3}"]}, "open": {"type": "regex", "patterns": ["("]}, "none": {"type": "keyword", "keywords": []}}, "odd": {"type": "guess"}, "flat": {"type": "keyword", "keywords": ["er "]}}


def written_packs(spark) -> list[packs.Pack]:
    """Both packs, written to files and read from them."""
    out = []
    for told in (GOOD_PACK, BAD_PACK):
        path = new_folder(spark, "pack")
        spark.createDataFrame([(json.dumps(told),)], "value string").coalesce(1).write.text(path)
        out.append(packs.read_pack(spark, path))
    return out


PACK_RULES = packs.compiled(GOOD_PACK).rules | packs.compiled(BAD_PACK).rules


@query(f"WITH {O.CASES} SELECT case_id, " + ", ".join(f"{r.sql('line')} AS {n}" for n, r in PACK_RULES.items()) + f" FROM (SELECT case_id, {O.LINE} AS line FROM cases)")
def file_packs(spark, d):
    """The fields of two packs from files, one of them with rules that can't be used, in one projection."""
    good, bad = written_packs(spark)
    return sparse.features(cases(spark, d), good.rules | bad.rules)


@query(f"WITH {O.CASES} SELECT field, problem, (SELECT count(*) FROM cases) AS cases FROM (VALUES ('mark_none', 'keywords must be a list of texts'), ('mark_open', 'missing ), unterminated subpattern at position 0'), ('odd', 'unknown type ''guess''')) AS t(field, problem)")
def pack_problems(spark, d):
    """The rules that were left out, with the number of cases that go without them."""
    bad = packs.problems(spark, written_packs(spark)[1])
    return bad.join(F.broadcast(cases(spark, d).agg(F.count("*").alias("cases"))))


# --- mining


def lifted(rows, label: str, top_k: int, least: int):
    """class, words: the top_k words by lift of each class of `least` texts or more, in order."""
    best = mining.mine(rows, label, top_k, least)
    return best.groupBy(F.col("label").alias("class")).agg(F.sort_array(F.collect_list(F.struct("rank", "word")))["word"].alias("words"))


def named_fields(words):
    """class, keywords, fields: M.WHITELIST words first where none of them was mined; fields by M.TRIGGERS."""
    white = F.lit(None).cast("array<string>")
    for name, own in M.WHITELIST.items():
        white = F.when(F.col("class") == name, F.array(*map(F.lit, own))).otherwise(white)
    has = F.coalesce(F.arrays_overlap(white, F.col("words")), F.lit(False))
    first = F.coalesce(white, F.array().cast("array<string>"))
    out = words.select("class", F.when(has, F.col("words")).otherwise(F.array_distinct(F.concat(first, "words"))).alias("keywords"))
    fields = F.array_compact(F.array(*(F.when(F.arrays_overlap("keywords", F.array(*map(F.lit, w))), F.lit(f)) for f, w in M.TRIGGERS.items())))
    return out.select("class", F.array_join("keywords", ",").alias("keywords"), F.array_join(fields, ",").alias("fields"))


def lift_words(rows: str, k: int, least: int) -> str:
    return f"lifted AS (SELECT label AS class, list(word ORDER BY rank) AS words FROM ({O.mined(rows, k, least)}) GROUP BY label)"


def named_sql(source: str) -> str:
    white = "CASE class " + " ".join(f"WHEN '{c}' THEN {w}" for c, w in M.WHITELIST.items()) + " END"
    fields = ", ".join(f"CASE WHEN list_has_any(keywords, {w}) THEN '{f}' END" for f, w in M.TRIGGERS.items())
    return f"""joined AS (SELECT class, words, {white} AS white, list_concat(coalesce({white}, []::VARCHAR[]), words) AS l FROM {source}),
kw AS (SELECT class, CASE WHEN coalesce(list_has_any(white, words), false) THEN words ELSE list_filter(l, lambda x, i: list_position(l, x) = i) END AS keywords FROM joined)
SELECT class, array_to_string(keywords, ',') AS keywords, array_to_string(list_filter([{fields}], lambda x: x IS NOT NULL), ',') AS fields FROM kw"""


@query(f"WITH {lift_words('SELECT lang AS label, fact FROM cases', 30, 5)}, {named_sql('lifted')}")
def keyword_pipeline(spark, d):
    """Words by lift of every class, the whitelist before them, and the fields that they suggest."""
    return named_fields(lifted(cases(spark, d), "lang", 30, 5))


TARGETS = ["src1", "src2", "src19", "none-such/of-all, x"]


@query(f"""WITH {lift_words("SELECT * FROM (SELECT unnest(accusation) AS label, fact FROM cases) WHERE label IN ('src1', 'src2', 'src19')", 25, 1)},
targets AS (SELECT unnest({TARGETS}) AS class), every AS (SELECT class, coalesce(words, list_filter(string_split_regex(class, '[-/,、\\s]+'), lambda w: length(w) >= 2)) AS words FROM targets LEFT JOIN lifted USING (class)), {named_sql('every')}""")
def target_keyword_pipeline(spark, d):
    """The same for target classes; a class without enough texts has the parts of its name instead."""
    rows = cases(spark, d).select("case_id", "fact", F.explode("accusation").alias("target")).filter(F.col("target").isin(TARGETS))
    found = lifted(rows, "target", 25, 1).withColumnRenamed("class", "found")
    targets = spark.createDataFrame([(t,) for t in TARGETS], "class string")
    parts = F.filter(F.split("class", r"[-/,、\s]+"), lambda w: F.length(w) >= 2)
    return named_fields(targets.join(found, F.col("class") == F.col("found"), "left").select("class", F.coalesce("words", parts).alias("words")))


# --- rules against a second extraction


def sampled(spark, d, n: int = 200):
    return cases(spark, d).orderBy(pairs.seeded("case_id"), "case_id").limit(n)


class FirstSentenceRules:
    """A stand-in for a model that extracts fields: the pack's plain keywords, looked for in a text's first
    200 words only, as a reader with a short window would."""

    kind, default = "array<string>", []

    def __init__(self):
        self.rules = {n: r.values for n, r in X.FIELDS.items() if r.kind == "keyword"}

    def load(self) -> None: ...

    def run(self, inputs: list[tuple]) -> list[list[str]]:
        heads = [" ".join(t.split(" ")[:200]) for (t,) in inputs]
        return [[n for n, words in self.rules.items() if any(w in h for w in words)] for h in heads]


KEYWORD_FIELDS = [n for n, r in X.FIELDS.items() if r.kind == "keyword"]


@query(f"""WITH {O.CASES}, s AS (SELECT case_id, fact FROM cases ORDER BY {O.seeded('case_id')}, case_id LIMIT 200), l AS (SELECT case_id, {O.LINE} AS line FROM s), h AS (SELECT *, array_to_string(string_split(line, ' ')[1:200], ' ') AS head FROM l),
x AS (SELECT case_id, unnest({KEYWORD_FIELDS}) AS field, unnest([{', '.join(f'({X.FIELDS[n].sql("line")}) IS NOT NULL' for n in KEYWORD_FIELDS)}]) AS by_rule, unnest([{', '.join(f'({X.FIELDS[n].sql("head")}) IS NOT NULL' for n in KEYWORD_FIELDS)}]) AS by_model FROM h)
SELECT field, count(*) FILTER (by_rule AND by_model) AS both, count(*) FILTER (by_rule AND NOT by_model) AS rule_only, count(*) FILTER (by_model AND NOT by_rule) AS model_only, round(100.0 * avg((by_rule <> by_model)::INTEGER), 6)::DOUBLE AS diff_ratio FROM x GROUP BY field""")
def rules_against_model(spark, d):
    """Rules and a model's extraction on a sample of 200, field by field."""
    line = sampled(spark, d).select("case_id", X.one_line(F.col("fact")).alias("line"))
    made = batched.apply(line, FirstSentenceRules(), ["line"], "by_model")
    rules = F.array(*(F.struct(F.lit(n).alias("field"), X.FIELDS[n].column(F.col("line")).isNotNull().alias("by_rule")) for n in KEYWORD_FIELDS))
    each = made.select(F.inline(rules), "by_model").withColumn("by_model", F.array_contains("by_model", F.col("field")))
    differs = F.when(F.col("by_rule") != F.col("by_model"), 1.0).otherwise(0.0)
    return each.groupBy("field").agg(F.count_if(F.col("by_rule") & F.col("by_model")).alias("both"), F.count_if(F.col("by_rule") & ~F.col("by_model")).alias("rule_only"), F.count_if(F.col("by_model") & ~F.col("by_rule")).alias("model_only"), F.round(100.0 * F.avg(differs), 6).alias("diff_ratio"))


# --- end-to-end evaluation


class Answers:
    """Prompts of the gold set's three best references, with what is answered already left out."""

    GOLD_REFS = 3


def prompts(spark, d):
    """q_id, truth, prompt for each query with gold references."""
    refs = Q.tiered_gold(spark, d).filter(F.col("rank") <= Answers.GOLD_REFS)
    c = cases(spark, d).select("case_id", "accusation", "articles", "fact")
    line = F.concat(F.lit("- "), F.array_join("accusation", "|"), F.lit(" ("), F.array_join("articles", "|"), F.lit(")"))
    listed = refs.join(c, F.col("c_id") == F.col("case_id")).groupBy("q_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("rank", line.alias("line"))))["line"], "\n").alias("references"))
    q = listed.join(c, F.col("q_id") == F.col("case_id"))
    category = F.when(F.array_contains("accusation", "src0"), "large").otherwise("other")
    return q.select("q_id", F.get("accusation", F.lit(0)).alias("truth"), batched.prompt(category, references=F.col("references"), text=X.cut_at_token(F.col("fact"), 50)).alias("prompt"))


def answered(spark, d):
    """The whole run, in two goes: the second finds in the sink what the first has done, and does the rest."""
    path, asked = new_folder(spark, "answers"), stash(prompts(spark, d), "prompts")
    for part in (asked.filter("q_id % 40 = 0"), asked):
        left = pairs.resume(part, spark.read.parquet(path), "q_id") if files.exists(spark, path) else part
        out = batched.apply(left, batched.MajorityReader(), ["prompt"], "output").filter("not output_failed")
        files.append_new(out.select("q_id", "truth", "output", X.parsed_prediction(F.col("output"), "label").alias("predicted")), "q_id", path)
    return spark.read.parquet(path)


ANSWERS = f"""{O.CASES}, {O.PAIRS}, {O.GOLD}, names AS (SELECT q_id, unnest(accusation) AS name FROM gold JOIN cases ON c_id = case_id WHERE rank <= 3),
counted AS (SELECT q_id, name, count(*) AS n FROM names GROUP BY ALL),
votes AS (SELECT q_id, name, row_number() OVER (PARTITION BY q_id ORDER BY n DESC, name) AS nth FROM counted),
answers AS (SELECT g.q_id, accusation[1] AS truth, coalesce(name, '') AS predicted FROM (SELECT DISTINCT q_id FROM gold) g JOIN cases ON case_id = g.q_id LEFT JOIN votes v ON v.q_id = g.q_id AND nth = 1)"""


@query(f"WITH {ANSWERS} SELECT q_id, truth, predicted FROM answers")
def answered_cases(spark, d):
    """References, prompt, model, parsing: a label for each query, resumed once on the way."""
    return answered(spark, d).select("q_id", "truth", "predicted")


@query(f"WITH {ANSWERS} SELECT count(*) AS n, round(avg((truth = predicted)::INTEGER), 6) AS accuracy FROM answers")
def end_to_end_accuracy(spark, d):
    return answered(spark, d).agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("truth") == F.col("predicted"), 1.0).otherwise(0.0)), 6).alias("accuracy"))


@query(f"WITH {M.VOTED} SELECT case_id, round(top_conf, 6) AS top_conf, dirty FROM judged JOIN flags USING (case_id)")
def classifier_mismatch(spark, d):
    """confident_mismatch by a classifier in batches instead of joins."""
    classes = {"en": Q.X.LEXICON["english"], "fr": Q.X.LEXICON["french"], "de": Q.X.LEXICON["german"], "es": Q.X.LEXICON["spanish"]}
    made = batched.confident_mismatch(cases(spark, d), batched.LexiconClassifier(classes), "fact", "lang")
    return made.select("case_id", F.round("top_conf", 6).alias("top_conf"), "dirty")


@query("WITH k AS (SELECT DISTINCT md5(role) || ':' || md5(text) AS cache_key, length(text)::DOUBLE AS score FROM conversations WHERE role IS NOT NULL AND text IS NOT NULL) SELECT cache_key, max(score) AS score FROM k GROUP BY cache_key")
def cached_scores(spark, d):
    """Scores of texts by key, through the cache: half are scored first, then the misses only."""
    c = Q.table(spark, d, "conversations").filter("role is not null and text is not null")
    keyed = c.select("conv_id", X.cache_key(F.col("role"), F.col("text")).alias("cache_key"), F.length("text").cast("double").alias("n"))
    cache = ScoreCache(spark, new_folder(spark, "cache"))
    score = lambda rows: rows.select("cache_key", F.col("n").alias("score"))
    cache.fill(keyed.filter("conv_id % 2 = 0").drop("conv_id"), score, 0)
    cache.fill(keyed.drop("conv_id"), score, 1)
    cache.compact()
    return cache.read().select("cache_key", "score")


# --- centroid evaluation


def centroid_ranks(rows):
    """case_id, label, rank of the true class among all centroids."""
    return vectors.nearest_centroids(rows).filter("label = predicted").select("case_id", "label", "rank")


MACRO = f"""{O.CASES}, emb0 AS (SELECT vec_id AS case_id, label, embedding::DOUBLE[] AS v FROM embeddings), emb AS (SELECT e.* FROM emb0 e SEMI JOIN (SELECT case_id FROM cases WHERE len(accusation) = 1) o ON e.case_id = o.case_id), {O.CENT},
sizes AS (SELECT label, count(*) AS n FROM emb GROUP BY label), places AS (SELECT *, row_number() OVER (ORDER BY n, label) AS up, row_number() OVER (ORDER BY n DESC, label) AS down, least(5, greatest(1, count(*) OVER () // 2)) AS k FROM sizes),
grp AS (SELECT label, CASE WHEN down <= k THEN 'top' WHEN up <= k THEN 'bottom' ELSE 'middle' END AS side FROM places),
picked AS (SELECT case_id FROM (SELECT case_id, row_number() OVER (PARTITION BY label ORDER BY {O.seeded('case_id')}, case_id) AS nth FROM emb) WHERE nth <= 20),
per AS (SELECT near.label, side, count(*) AS n, {', '.join(f'avg((rank <= {k})::INTEGER) AS r{k}' for k in (1, 3, 5, 10))} FROM near JOIN picked USING (case_id) JOIN grp ON grp.label = near.label WHERE near.label = predicted GROUP BY ALL)"""


@query(f"WITH {MACRO} SELECT side, count(*) AS classes, sum(n)::BIGINT AS cases, {', '.join(f'round(avg(r{k}), 6) AS recall_{k}' for k in (1, 3, 5, 10))} FROM per GROUP BY side UNION ALL SELECT 'all', count(*), sum(n)::BIGINT, {', '.join(f'round(avg(r{k}), 6)' for k in (1, 3, 5, 10))} FROM per")
def centroid_macro_recall(spark, d):
    """Recall of single-label cases against centroids, at most 20 of each class, averaged over the classes, in
    all and for the most and the least frequent ones."""
    rows = stash(M.single_label(spark, d), "single-label")
    sizes = rows.groupBy("label").agg(F.count("*").alias("n"))  # a row a class
    s = sizes.withColumns({"up": F.row_number().over(Window.orderBy("n", "label")), "down": F.row_number().over(Window.orderBy(F.desc("n"), "label")), "classes": F.count("*").over(Window.partitionBy())})
    k = F.least(F.lit(5), F.greatest(F.lit(1), F.floor(F.col("classes") / 2)))
    side = s.select(F.col("label").alias("g"), F.when(F.col("down") <= k, "top").when(F.col("up") <= k, "bottom").otherwise("middle").alias("side"))
    picked = pairs.seeded_caps(rows, "label", 20).select(F.col("case_id").alias("p"))
    ranks = centroid_ranks(rows).join(picked, F.col("case_id") == F.col("p"), "left_semi")
    hit = lambda n: F.avg(F.when(F.col("rank") <= n, 1.0).otherwise(0.0)).alias(f"r{n}")
    per = ranks.groupBy("label").agg(F.count("*").alias("n"), *map(hit, (1, 3, 5, 10))).join(side, F.col("label") == F.col("g"))
    both = per.select("*", F.explode(F.array("side", F.lit("all"))).alias("part")).drop("side")
    return both.groupBy(F.col("part").alias("side")).agg(F.count("*").alias("classes"), F.sum("n").alias("cases"), *(F.round(F.avg(f"r{n}"), 6).alias(f"recall_{n}") for n in (1, 3, 5, 10)))


@query(f"WITH {M.SINGLE}, {O.CENT} SELECT " + ", ".join(f"round(avg((rank <= {k})::INTEGER), 6) AS recall_{k}" for k in (1, 3, 5, 10)) + ", count(*) AS n FROM (SELECT case_id, label, rank FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, predicted) AS rank FROM (SELECT s.case_id, s.label, predicted, round(list_cosine_similarity(s.v, c), 6) AS score FROM single s CROSS JOIN (SELECT label AS predicted, list(mean ORDER BY dim) AS c FROM (SELECT label, dim, avg(x) AS mean FROM (SELECT label, unnest(range(64)) AS dim, unnest(v) AS x FROM single) GROUP BY label, dim) GROUP BY label))) WHERE label = predicted)")
def single_label_recall(spark, d):
    """Recall of single-label cases against the centroids of single-label cases."""
    ranks = centroid_ranks(M.single_label(spark, d))
    return ranks.agg(*(F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_{k}") for k in (1, 3, 5, 10)), F.count("*").alias("n"))


# --- gold sets on samples, cleaned samples, factor discovery


SAMPLE = f"""sample AS (SELECT case_id FROM (SELECT *, row_number() OVER (PARTITION BY label_set ORDER BY {O.seeded('case_id')}, case_id) AS n FROM (SELECT case_id, array_to_string(accusation, '|') AS label_set FROM cases
  WHERE length(fact) BETWEEN 300 AND 700 AND len(accusation) > 0)) WHERE n = 1 ORDER BY {O.seeded('case_id')}, case_id LIMIT 100)"""


@query(f"""WITH {O.CASES}, {SAMPLE}, {O.EMB}, {O.COUNTS}, {O.LEX}, {O.KSETS}, {O.capped(2500, 'q.case_id IN (SELECT case_id FROM sample)')}, {O.VPAIRS}, {O.with_kw('vpairs', 'kpairs')}, scored AS (SELECT *, {O.TOTAL} AS total FROM kpairs),
t AS ({O.topk('scored', 'q_id', 10, 'total DESC, c_id', 'q_id, c_id, total::DOUBLE AS total')}) {O.full('t', 'q_id', 10, 'q_id, c_id, total, rank')}""")
def sampled_gold(spark, d):
    """A gold set for the sample of distinct label sets: the ten best by total score, full groups only."""
    c = cases(spark, d)
    asked = c.join(F.broadcast(stash(Q.label_set_sample(spark, d).select("case_id"), "sample")), "case_id", "left_semi")  # 100 rows at most
    p = Q.with_total(Q.vector_pairs(spark, d, asked=asked), spark, d)
    return pairs.full_groups(pairs.top(p, "q_id", 10, F.desc("total"), F.col("c_id")), "q_id", 10).select("q_id", "c_id", "total", "rank")


@query(f"WITH diverse AS ({O.oracles()['diverse_sample']}), {M.VOTED} SELECT q_id, c_id, total, rank FROM diverse JOIN flags q ON q.case_id = q_id JOIN flags p ON p.case_id = c_id WHERE NOT q.dirty AND NOT p.dirty")
def diverse_clean(spark, d):
    """The diverse sample without groups of dirty queries and without dirty positives."""
    flag = stash(M.mismatches(spark, d).select("case_id", "dirty"), "flags")
    rows = Q.diverse_sample(spark, d).join(flag.select(F.col("case_id").alias("a"), F.col("dirty").alias("q_dirty")), F.col("q_id") == F.col("a"))
    rows = rows.join(flag.select(F.col("case_id").alias("b"), "dirty"), F.col("c_id") == F.col("b"))
    return rows.filter("not q_dirty and not dirty").select("q_id", "c_id", "total", "rank")


class FirstWords:
    """The default extractor of factors: a prompt's case by its first three words."""

    kind, default = "struct<subject: string, action: string, result: string>", {"subject": None, "action": None, "result": None}

    def load(self) -> None: ...

    def run(self, inputs: list[tuple]) -> list[dict]:
        words = [p.rpartition("Case: ")[2].split() + [None] * 3 for (p,) in inputs]
        return [dict(zip(("subject", "action", "result"), w, strict=False)) for w in words]


def discovered(spark, d, group: str, most: int):
    """At most `most` cases of each category or class, with the factors that a model finds in them, written by
    group and read back."""
    c = cases(spark, d).withColumn("class", F.get("accusation", F.lit(0))).filter("class is not null")
    c = c.withColumn("category", F.when(F.col("class") == "src0", "large").when(F.col("class") == "src1", "odd").when(F.col("class") == "src2", "even").otherwise("other"))
    picked = pairs.seeded_caps(c, group, most)
    asked = picked.select("case_id", group, batched.prompt(F.col("category"), references=F.lit(""), text=X.cut_at_token(F.col("fact"), 50)).alias("prompt"))
    made = batched.apply(asked, FirstWords(), ["prompt"], "factors")
    path = new_folder(spark, "factors")
    files.write_by(made.select("case_id", group, "factors.*", "factors_failed"), group, path)
    return spark.read.schema(f"case_id long, subject string, action string, result string, factors_failed boolean, {group} string").parquet(path)


def discovered_sql(group: str, most: int) -> str:
    category = "CASE accusation[1] WHEN 'src0' THEN 'large' WHEN 'src1' THEN 'odd' WHEN 'src2' THEN 'even' ELSE 'other' END"
    return f"""WITH {O.CASES}, g AS (SELECT case_id, {'accusation[1]' if group == 'class' else category} AS {group} FROM cases WHERE len(accusation) > 0),
picked AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {O.seeded('case_id')}, case_id) AS nth FROM g)
SELECT {group}, count(*) AS n, count(*) AS n_found, md5(string_agg(case_id::VARCHAR, ',' ORDER BY case_id)) AS ids FROM picked WHERE nth <= {most} GROUP BY {group}"""


def discovery_summary(rows, group: str):
    ids = F.md5(F.array_join(F.sort_array(F.collect_list("case_id")).cast("array<string>"), ","))
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.count_if(~F.col("factors_failed")).alias("n_found"), ids.alias("ids"))


@query(discovered_sql("category", 100))
def factors_by_category(spark, d):
    return discovery_summary(discovered(spark, d, "category", 100), "category")


@query(discovered_sql("class", 20))
def factors_by_class(spark, d):
    return discovery_summary(discovered(spark, d, "class", 20), "class")
