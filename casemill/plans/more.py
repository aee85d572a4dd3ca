"""Further queries, each beside its SQL: search with its arguments, cleaning, evaluation tasks, rule packs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as X
from ..operators import batched, metrics, models, pairs, sparse, vectors
from ..schema import cases, table
from . import oracles as O
from . import queries as Q

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


#: Results that a rerank looks at, at most.
RERANK_TOP_K = 100


def fetch_k(top_k: int, rerank: bool) -> int:
    """Results that each source is asked for: twice as many, if they are reranked."""
    return min(RERANK_TOP_K, 2 * top_k) if rerank else top_k


def hybrid_search(spark, d, mode: str = "hybrid", top_k: int | None = None, rerank: bool = True, scorer: batched.Model | None = None) -> DataFrame:
    """query_id, case_id, score, rank and the case's fields, for every query of the search set.

    scorer: a model of pairs of texts; without one the default score is computed in the plan.

    mode: dense, sparse or hybrid. Dense results come before sparse ones; the first of equal
    texts wins. Without rerank that order stays and the scores aren't comparable.
    """
    top_k = top_k or 5
    n, e = fetch_k(top_k, rerank), Q.embeddings(spark, d)
    found = []
    if mode in ("dense", "hybrid"):
        found.append(vectors.exact_top_k(e, pairs.queries_of(e), n).withColumn("src_order", F.lit(0)))
    if mode in ("sparse", "hybrid"):
        found.append(Q.sparse_results(spark, d, n).withColumn("src_order", F.lit(1)))
    rows = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    c = cases(spark, d)
    rows = rows.join(c.withColumnRenamed("case_id", "id"), F.col("case_id") == F.col("id"))
    rows = pairs.first_wins(rows, "query_id", X.text_hash(F.col("fact")), F.col("src_order"), F.col("rank")).withColumnRenamed("rank", "src_rank")
    order = [F.col("src_order"), F.col("src_rank")]
    if rerank:
        q = c.select(F.col("case_id").alias("qid"), F.col("fact").alias("q_fact"))
        rows = rows.join(q, F.col("query_id") == F.col("qid"))
        rows = batched.apply(rows, scorer, ["q_fact", "fact"], "raw") if scorer else rows.withColumn("raw", models.token_overlap(F.col("q_fact"), F.col("fact")))
        rows = rows.withColumn("rerank_score", F.round("raw", 6))
        rows = rows.withColumn("score", F.coalesce(F.nullif("rerank_score", F.lit(0.0)), "score"))
        order = [F.desc("score"), F.col("case_id")]
    words = sparse.keyword_counts(c).groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_list("keyword")), " ").alias("matched_keywords"))
    best = pairs.top(rows, "query_id", top_k, *order).join(words.withColumnRenamed("case_id", "wid"), F.col("case_id") == F.col("wid"), "left")
    return best.select("query_id", "case_id", F.round("score", 6).alias("score"), "rank", F.md5("fact").alias("fact_md5"), F.array_join("accusation", "|").alias("accusation"), F.array_join("articles", "|").alias("articles"), "months", "matched_keywords")


def search_sql(mode: str, top_k: int, rerank: bool) -> str:
    n = fetch_k(top_k, rerank)
    parts = [f"SELECT *, {i} AS src_order FROM {m}" for i, m in enumerate(("dense", "sparse")) if mode in (m, "hybrid")]
    tokens = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+'))"
    score = f"coalesce(nullif(round({O.jac(tokens.format('q.fact'), tokens.format('f.fact'))}, 6), 0.0), f.score)" if rerank else "f.score"
    order = "score DESC, case_id" if rerank else "src_order, src_rank"
    return f"""WITH {O.SPARSE_BASE}, {O.EMB}, {O.dense(n)}, {O.sparse(n)},
found AS (SELECT f.query_id, f.case_id, f.score, f.rank AS src_rank, src_order, c.fact, c.accusation, c.articles, c.months, {O.hashed('c.fact')} AS h FROM ({' UNION ALL '.join(parts)}) f JOIN cases c USING (case_id)),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, h ORDER BY src_order, src_rank) AS nth FROM found WHERE h <> '') WHERE nth = 1),
scored AS (SELECT f.query_id, f.case_id, {score} AS score, f.src_order, f.src_rank, f.fact, f.accusation, f.articles, f.months FROM one f {'JOIN' if rerank else 'LEFT JOIN'} cases q ON q.case_id = f.query_id),
words AS (SELECT case_id, string_agg(keyword, ' ' ORDER BY keyword) AS matched_keywords FROM counts GROUP BY case_id)
SELECT query_id, case_id, round(score, 6) AS score, rank, md5(fact) AS fact_md5, array_to_string(accusation, '|') AS accusation, array_to_string(articles, '|') AS articles, months, matched_keywords
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order})::INTEGER AS rank FROM scored) LEFT JOIN words USING (case_id) WHERE rank <= {top_k}"""


@query(search_sql("dense", 5, True))
def search_dense(spark, d):
    return hybrid_search(spark, d, "dense")


@query(search_sql("sparse", 4, True))
def search_sparse(spark, d):
    return hybrid_search(spark, d, "sparse", 4)


@query(search_sql("hybrid", 8, True))
def search_hybrid(spark, d):
    return hybrid_search(spark, d, "hybrid", 8)


@query(search_sql("hybrid", 8, True))
def search_with_model(spark, d):
    """search_hybrid with the pairs scored by a model in batches."""
    return hybrid_search(spark, d, "hybrid", 8, scorer=batched.TokenOverlap())


@query(search_sql("hybrid", 6, False))
def search_no_rerank(spark, d):
    return hybrid_search(spark, d, "hybrid", 6, rerank=False)


@query(f"WITH {O.CASES}, {O.COUNTS} SELECT keyword, sum(n)::BIGINT AS total FROM counts GROUP BY keyword ORDER BY total DESC, keyword LIMIT 50")
def top_keywords(spark, d):
    """The 50 most frequent keywords of the corpus."""
    return Q.keyword_totals(spark, d).select("keyword", "total").orderBy(F.desc("total"), "keyword").limit(50)


@query(f"WITH {O.CASES} SELECT case_id FROM cases ORDER BY {O.seeded('case_id')}, case_id LIMIT 150")
def uniform_sample(spark, d):
    """150 cases without replacement, in seeded order."""
    return cases(spark, d).select("case_id").orderBy(pairs.seeded("case_id"), "case_id").limit(150)


@query("SELECT coalesce(nullif(CAST(doc_id AS VARCHAR), ''), '') AS fact_id, coalesce(text, '') AS fact, source AS accusation, lang AS law, n_chars AS months FROM documents")
def unified_metadata(spark, d):
    """Source fields under the names of search results; a missing id or text is empty."""
    t = table(spark, d, "documents")
    return t.select(X.first_filled(F.col("doc_id").cast("string")).alias("fact_id"), F.coalesce("text", F.lit("")).alias("fact"), F.col("source").alias("accusation"), F.col("lang").alias("law"), F.col("n_chars").alias("months"))


FLAT = f"{O.CASES}, {O.PAIRS}, {O.GOLD}, flat AS (SELECT q_id, c_id AS case_id, rank - 1 AS pos FROM gold UNION ALL SELECT DISTINCT q_id, q_id, -1 FROM gold)"


@query(f"WITH {FLAT} SELECT q_id, case_id, pos::INTEGER AS pos FROM flat")
def flattened_groups(spark, d):
    """A row for each query (place -1) and each of its positives (places from 0)."""
    g = Q.tiered_gold(spark, d)
    return g.select("q_id", F.col("c_id").alias("case_id"), (F.col("rank") - 1).alias("pos")).unionByName(g.select("q_id", F.col("q_id").alias("case_id"), F.lit(-1).alias("pos")).distinct())


VOTED = f"""{O.CASES}, {O.COUNTS}, {O.LEX}, {O.VOTES}, shares AS (SELECT case_id, CASE substr(class, 1, 2) WHEN 'ge' THEN 'de' WHEN 'sp' THEN 'es' ELSE substr(class, 1, 2) END AS class,
  n / sum(n) OVER (PARTITION BY case_id) AS p FROM votes WHERE class <> 'place'),
judged AS (SELECT c.case_id, coalesce(max(p), 0.0) AS top_conf, coalesce(bool_or(p > 0.5 AND class = lang), false) AS agrees FROM cases c LEFT JOIN shares s USING (case_id) GROUP BY c.case_id),
flags AS (SELECT case_id, NOT agrees AND top_conf > 0.85 AS dirty FROM judged)"""


def mismatches(spark, d) -> DataFrame:
    """case_id, top_conf, dirty: a class probability above 0.85 and none of the true labels among
    those above 0.5. The default classifier's probabilities are the shares of lexicon votes."""
    votes = sparse.class_counts(sparse.keyword_counts(cases(spark, d)), sparse.lexicon(spark)).filter("class <> 'place'")
    short = F.substring("class", 1, 2)
    code = F.when(short == "ge", "de").when(short == "sp", "es").otherwise(short)
    shares = votes.select("case_id", code.alias("class"), (F.col("n") / F.sum("n").over(Window.partitionBy("case_id"))).alias("p"))
    truth = cases(spark, d).select("case_id", "lang")
    judged = truth.join(shares, "case_id", "left").groupBy("case_id").agg(F.coalesce(F.max("p"), F.lit(0.0)).alias("top_conf"), F.coalesce(F.bool_or((F.col("p") > 0.5) & (F.col("class") == F.col("lang"))), F.lit(False)).alias("agrees"))
    return judged.select("case_id", "top_conf", (~F.col("agrees") & (F.col("top_conf") > 0.85)).alias("dirty"))


@query(f"WITH {VOTED} SELECT case_id, round(top_conf, 6) AS top_conf, dirty FROM judged JOIN flags USING (case_id)")
def confident_mismatch(spark, d):
    return mismatches(spark, d).select("case_id", F.round("top_conf", 6).alias("top_conf"), "dirty")


def cleaned(spark, d) -> DataFrame:
    """q_id, case_id, pos, q_dirty, dirty of the flattened groups."""
    flag = mismatches(spark, d)
    rows = flattened_groups(spark, d)
    rows = rows.join(flag.select(F.col("case_id").alias("a"), F.col("dirty").alias("q_dirty")), F.col("q_id") == F.col("a"))
    return rows.join(flag.select(F.col("case_id").alias("b"), "dirty"), F.col("case_id") == F.col("b")).drop("a", "b")


CLEANED = f"{VOTED}, {O.PAIRS}, {O.GOLD}, flat AS (SELECT q_id, c_id AS case_id, rank - 1 AS pos FROM gold UNION ALL SELECT DISTINCT q_id, q_id, -1 FROM gold), cleaned AS (SELECT f.*, q.dirty AS q_dirty, p.dirty FROM flat f JOIN flags q ON q.case_id = q_id JOIN flags p ON p.case_id = f.case_id)"


@query(f"WITH {CLEANED} SELECT q_id, case_id, pos::INTEGER AS pos FROM cleaned WHERE NOT q_dirty AND NOT dirty")
def cleaned_groups(spark, d):
    """A dirty query drops its group, a dirty positive its row."""
    return cleaned(spark, d).filter("not q_dirty and not dirty").select("q_id", "case_id", "pos")


@query(f"WITH {CLEANED} SELECT count(DISTINCT q_id) AS total, count(DISTINCT CASE WHEN q_dirty THEN q_id END) AS discarded, count(DISTINCT CASE WHEN NOT q_dirty THEN q_id END) AS kept FROM cleaned")
def discard_rollup(spark, d):
    one = cleaned(spark, d).filter("pos = -1")
    return one.agg(F.count("*").alias("total"), F.count_if("q_dirty").alias("discarded"), F.count_if(~F.col("q_dirty")).alias("kept"))


REQUIRED = ["sound_hard", "noun_pronoun", "ending_erth", "setting_inside", "ending_digits"]


@query(f"WITH {O.CASES}, {O.FEATURES}, {O.LONG}, have AS (SELECT case_id, list(field) AS fields FROM long GROUP BY case_id), every AS (SELECT case_id, coalesce(fields, []::VARCHAR[]) AS fields FROM cases LEFT JOIN have USING (case_id)) SELECT case_id, array_to_string(list_sort(list_filter({REQUIRED}, lambda f: NOT list_contains(fields, f))), ',') AS missing, array_to_string(list_sort(list_filter(fields, lambda f: NOT list_contains({REQUIRED}, f))), ',') AS extra FROM every")
def required_keys(spark, d):
    """Required fields that an extraction lacks, and fields that it has beside them."""
    f = sparse.features(cases(spark, d))
    have = F.array_compact(F.array(*(F.when(F.col(n).isNotNull(), F.lit(n)) for n in X.FIELDS)))
    need = F.array(*map(F.lit, REQUIRED))
    return f.select("case_id", F.array_join(F.array_sort(F.array_except(need, have)), ",").alias("missing"), F.array_join(F.array_sort(F.array_except(have, need)), ",").alias("extra"))


def single_label(spark, d) -> DataFrame:
    one = cases(spark, d).filter(F.size("accusation") == 1).select("case_id")
    return Q.labelled(spark, d).join(one, "case_id", "left_semi")


SINGLE = f"{O.CASES}, {O.EMB}, single AS (SELECT e.* FROM emb e SEMI JOIN (SELECT case_id FROM cases WHERE len(accusation) = 1) o ON e.case_id = o.case_id)"


@query(f"WITH {SINGLE}, each AS (SELECT label, generate_subscripts(v, 1) - 1 AS dim, unnest(v) AS x FROM single) SELECT label, dim::INTEGER AS dim, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM each GROUP BY label, dim")
def single_label_centroids(spark, d):
    """Centroids and deviations over the cases of one label."""
    return vectors.centroids(single_label(spark, d)).select("label", "dim", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def other_fields(spark, d) -> DataFrame:
    """case_id, diff: the fields, of all, in which the rules differ between a text and its lower-case form."""
    c = cases(spark, d).select("case_id", X.one_line(F.col("fact")).alias("line"))
    differs = lambda r: ~r.column(F.col("line")).eqNullSafe(r.column(F.lower("line")))
    return c.select("case_id", F.array_compact(F.array(*(F.when(differs(r), F.lit(n)) for n, r in X.FIELDS.items()))).alias("diff"))


DIFFS = f"{O.CASES}, lines AS (SELECT case_id, {O.LINE} AS line FROM cases), diffs AS (SELECT case_id, list_filter([" + ", ".join(f"CASE WHEN ({r.sql('line')}) IS DISTINCT FROM ({r.sql('lower(line)')}) THEN '{n}' END" for n, r in X.FIELDS.items()) + "], lambda x: x IS NOT NULL) AS diff FROM lines)"


@query(f"WITH {DIFFS} SELECT case_id, array_to_string(diff, ',') AS diff_fields, len(diff)::BIGINT AS n_diff FROM diffs")
def extraction_diff(spark, d):
    """All fields of two extractions of whole texts, compared."""
    return other_fields(spark, d).select("case_id", F.array_join("diff", ",").alias("diff_fields"), F.size("diff").cast("long").alias("n_diff"))


@query(f"WITH {DIFFS} SELECT count(*) AS n, round(100.0 * avg(CASE WHEN len(diff) > 0 THEN 1.0 ELSE 0.0 END), 6) AS diff_ratio FROM diffs")
def diff_ratio(spark, d):
    """Percentage of records with a field that differs."""
    return other_fields(spark, d).agg(F.count("*").alias("n"), F.round(100.0 * F.avg(F.when(F.size("diff") > 0, 1.0).otherwise(0.0)), 6).alias("diff_ratio"))


#: Our whitelist: class -> words; classes without one get their own name first.
WHITELIST = {"en": ["the", "law"], "fr": ["cour", "droit"]}
#: Our triggers: field -> words that suggest it.
TRIGGERS = {"setting_inside": ["in"], "noun_pronoun": ["der", "die", "la", "el"], "sound_nasal": ["that", "cour"]}


def mined(spark, d) -> DataFrame:
    """class, keywords: the five most frequent lexicon words of each language, in order."""
    k = sparse.keyword_counts(cases(spark, d)).join(cases(spark, d).select("case_id", "lang"), "case_id").groupBy("lang", "keyword").agg(F.sum("n").alias("n"))
    five = pairs.top(k, "lang", 5, F.desc("n"), F.col("keyword"))
    return five.groupBy(F.col("lang").alias("class")).agg(F.array_sort(F.collect_list(F.struct("rank", "keyword")))["keyword"].alias("keywords"))


def enhanced(spark, d) -> DataFrame:
    """class, keywords: the whitelist first, or the class's own name, where no mined word is on it; at most six."""
    white = F.lit(None).cast("array<string>")
    for name, words in WHITELIST.items():
        white = F.when(F.col("class") == name, F.array(*map(F.lit, words))).otherwise(white)
    first = F.coalesce(white, F.array("class"))
    both = F.slice(F.array_distinct(F.concat(first, "keywords")), 1, 6)
    return mined(spark, d).select("class", F.when(F.coalesce(F.arrays_overlap(white, F.col("keywords")), F.lit(False)), F.col("keywords")).otherwise(both).alias("keywords"))


WHITE = "CASE class " + " ".join(f"WHEN '{c}' THEN {w}" for c, w in WHITELIST.items()) + " END"
ENHANCED = f"""{O.CASES}, {O.COUNTS}, words AS (SELECT lang AS class, keyword, sum(n) AS n FROM counts JOIN cases USING (case_id) GROUP BY ALL),
mined AS (SELECT class, list(keyword ORDER BY n DESC, keyword)[1:5] AS keywords FROM words GROUP BY class),
joined AS (SELECT *, {WHITE} AS white, list_concat(coalesce({WHITE}, [class]), keywords) AS l FROM mined),
enhanced AS (SELECT class, CASE WHEN coalesce(list_has_any(white, keywords), false) THEN keywords ELSE list_filter(l, lambda x, i: list_position(l, x) = i)[1:6] END AS keywords FROM joined)"""


@query(f"WITH {ENHANCED} SELECT class, array_to_string(keywords, ',') AS keywords FROM enhanced")
def whitelist_enhance(spark, d):
    return enhanced(spark, d).select("class", F.array_join("keywords", ",").alias("keywords"))


@query(f"WITH {ENHANCED} SELECT class, field, array_to_string(list_filter(keywords, lambda k: list_contains(words, k)), ',') AS found FROM enhanced, (VALUES " + ", ".join(f"('{f}', {w})" for f, w in TRIGGERS.items()) + ") AS t(field, words) WHERE list_has_any(keywords, words)")
def suggested_fields(spark, d):
    """Fields suggested by a class's keywords, with the words that did it."""
    made = F.array(*(F.struct(F.lit(f).alias("field"), F.array_intersect("keywords", F.array(*map(F.lit, w))).alias("found")) for f, w in TRIGGERS.items()))
    rows = enhanced(spark, d).select("class", F.explode(made).alias("x")).filter(F.size("x.found") > 0)
    return rows.select("class", "x.field", F.array_join("x.found", ",").alias("found"))


@query("SELECT DISTINCT source || '/' || lang || '-x, word' AS name, array_to_string(list_filter(string_split_regex(source || '/' || lang || '-x, word', '[-/,、\\s]+'), lambda w: length(w) >= 2), ' ') AS words FROM documents")
def class_name_words(spark, d):
    """Class names split at separators; parts of two characters or more."""
    name = F.concat("source", F.lit("/"), "lang", F.lit("-x, word"))
    words = F.filter(F.split(name, r"[-/,、\s]+"), lambda w: F.length(w) >= 2)
    return table(spark, d, "documents").select(name.alias("name"), F.array_join(words, " ").alias("words")).distinct()


@query(r"SELECT doc_id, coalesce(nullif(array_to_string(regexp_extract_all(text, '[^\pL\pN]*[\pL\pN]+')[1:254], ''), ''), '[EMPTY]') AS cut FROM documents")
def truncated_text(spark, d):
    """What a reranker of 512 tokens gets: the text's own start, to the end of its 254th token, or a mark for a text without any."""
    return table(spark, d, "documents").select("doc_id", X.cut_at_token(F.col("text"), 512 // 2 - 2).alias("cut"))


@query(r"WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\pL\pN]+')) AS token, generate_subscripts(regexp_extract_all(text, '[\pL\pN]+'), 1) AS place FROM documents) SELECT doc_id, count(*) AS n_tokens, sum(length(token))::BIGINT AS n_chars, md5(string_agg(token, ' ' ORDER BY place)) AS tokens FROM t GROUP BY doc_id")
def token_spans(spark, d):
    """Tokens by their spans: what stands between a span's ends is the token, in texts of any script."""
    t = table(spark, d, "documents").select("doc_id", "text", X.token_spans()(F.col("text")).alias("spans"))
    return joined_tokens(t.select("doc_id", X.tokens_at(F.col("text"), F.col("spans")).alias("tokens")))


def joined_tokens(rows: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_chars, tokens (their hash) of rows(doc_id, tokens). Rows of one doc_id are one text: their
    tokens stand by place. Rows without tokens give nothing."""
    lists = rows.groupBy("doc_id").agg(F.collect_list("tokens").alias("lists"))
    placed = F.transform("lists", lambda a: F.transform(a, lambda w, i: F.struct(i.alias("place"), w.alias("token"))))
    tokens = F.when(F.size("lists") == 1, F.get("lists", F.lit(0))).otherwise(F.sort_array(F.flatten(placed))["token"])
    n_chars = F.aggregate("tokens", F.lit(0).cast("long"), lambda n, w: n + F.length(w))
    some = lists.select("doc_id", sparse.held(tokens=tokens)).filter(F.size("tokens") > 0)  # not before: the models would run twice
    return some.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), n_chars.alias("n_chars"), F.md5(F.array_join("tokens", " ")).alias("tokens"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source ELSE 'label: ' || source END AS label FROM documents""")
def parsed_with_fallback(spark, d):
    """A model's output as JSON; what can't be parsed stays as it is."""
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('{"label": "'), "source", F.lit('"}'))).otherwise(F.concat(F.lit("label: "), "source"))
    out = table(spark, d, "documents").select("doc_id", raw.alias("raw"))
    return out.select("doc_id", F.coalesce(F.from_json("raw", "label string")["label"], "raw").alias("label"))


PACK = '{"loud": {"type": "regex", "patterns": ["!{2,}", "[A-Z]{5,}"]}, "money": {"type": "keyword", "keywords": ["$", "€"]}, "tone": {"type": "mapping", "mappings": {"asking": ["?"], "telling": ["."]}}}'


@query(f"WITH {O.CASES} SELECT case_id, " + ", ".join(f"{r.sql('line')} AS {n}" for n, r in X.rules_from_json(PACK).items()) + f" FROM (SELECT case_id, {O.LINE} AS line FROM cases)")
def pack_features(spark, d):
    """The fields of a rule pack that isn't the default one."""
    return sparse.features(cases(spark, d), X.rules_from_json(PACK))


def task_metrics(spark, d, hit: Callable[[], object]) -> DataFrame:
    c = cases(spark, d)
    h = Q.gold_hits(spark, d).join(pairs.side(c, "q"), F.col("query_id") == F.col("q_id")).join(pairs.side(c, "c"), F.col("case_id") == F.col("c_id"))
    return metrics.retrieval_metrics(h.withColumn("hit", F.coalesce(hit(), F.lit(False)).cast("int")), [3, 5, 10])


def task_sql(hit: str) -> str:
    cols = ", ".join(f"{t}.{n} AS {t}_{n}" for t in "qc" for n in ("accusation", "articles", "death", "life", "months"))
    return f"WITH {O.HITS}, tasks AS (SELECT query_id, rank, n_positive, CASE WHEN {hit} THEN 1 ELSE 0 END AS hit FROM (SELECT h.query_id, h.rank, h.n_positive, {cols} FROM hits h JOIN cases q ON q.case_id = h.query_id JOIN cases c ON c.case_id = h.case_id)) {O.metric_rows('tasks')}"


@query(task_sql("q_articles = c_articles"))
def article_metrics(spark, d):
    """A hit has the query's set of articles."""
    return task_metrics(spark, d, lambda: P.same_set(F.col("q_articles"), F.col("c_articles")))


@query(task_sql(f"{O.FLAGS} AND (q_death OR q_life OR abs(q_months - c_months) <= greatest(6, 0.2 * q_months))"))
def imprisonment_metrics(spark, d):
    """A hit has the query's flags and, without them, a term within six months or a fifth of the query's."""
    return task_metrics(spark, d, lambda: P.within_tolerance("q", "c"))


@query(f"WITH {O.CASES}, {O.EMB}, {O.dense(10)}, lists AS (SELECT query_id, list(case_id ORDER BY rank)[1:5] AS ids FROM dense GROUP BY query_id), each AS (SELECT query_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM lists) SELECT query_id, id AS case_id, pos::INTEGER AS pos, array_to_string(accusation, '|') AS accusation FROM each JOIN cases ON case_id = id")
def details_by_id(spark, d):
    """Details of the first five ids of each query's list, in its order; missing ones are skipped."""
    e = Q.embeddings(spark, d)
    found = vectors.exact_top_k(e, pairs.queries_of(e), 10).groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("rank", "case_id")))["case_id"], 1, 5).alias("ids"))
    each = found.select("query_id", F.posexplode("ids").alias("at", "id"))
    c = cases(spark, d)
    return each.join(c, F.col("id") == F.col("case_id")).select("query_id", "case_id", (F.col("at") + 1).alias("pos"), F.array_join("accusation", "|").alias("accusation"))


@query(f"WITH {O.CASES}, each AS (SELECT case_id, unnest(accusation) AS label FROM cases), per AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {O.seeded('case_id')}, case_id) AS n FROM each), picked AS (SELECT DISTINCT case_id FROM per WHERE n <= 10000) SELECT case_id FROM picked ORDER BY {O.seeded('case_id')}, case_id LIMIT 30000")
def capped_pool(spark, d):
    """At most 10,000 cases of each label and 30,000 in all, in seeded order."""
    rows = cases(spark, d).select("case_id", F.explode("accusation").alias("label"))
    return pairs.seeded_caps(rows, "label", 10_000).select("case_id").distinct().orderBy(pairs.seeded("case_id"), "case_id").limit(30_000)
