"""The same queries in DuckDB SQL."""

from __future__ import annotations

from ..functions.text import FIELDS, LEXICON, STOP_WORDS

CASES = """cases AS (
  SELECT doc_id AS case_id, text AS fact, lang, doc_id % 97 = 0 AS death, doc_id % 53 = 0 AS life, n_chars % 61 AS months,
    CASE WHEN doc_id % 43 = 0 THEN []::VARCHAR[] WHEN doc_id % 3 = 0 THEN list_sort(list_distinct([source, 'src' || ((doc_id * 7 + 3) % 20)])) ELSE [source] END AS accusation,
    CASE WHEN doc_id % 41 = 0 THEN []::VARCHAR[] WHEN doc_id % 2 = 0 THEN list_sort(list_distinct([lang, 'art' || (doc_id % 3)])) ELSE [lang] END AS articles
  FROM documents)"""
EMB = "emb AS (SELECT vec_id AS case_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
STRIP = r"regexp_replace(regexp_replace({0}, '^[\s\x0B]+', ''), '[\s\x0B]+$', '')"
LINE = STRIP.format("replace(replace(fact, chr(13), ''), chr(10), ' ')")


#: What stands before a text's last line break; all of it, if there is none.
REST = "coalesce(regexp_extract(fact, '^(.*)\\n', 1, 's'), '') || CASE WHEN contains(fact, chr(10)) THEN '' ELSE fact END"


def hashed(text: str) -> str:
    s = STRIP.format(text)
    return f"CASE WHEN {s} = '' THEN '' ELSE md5({s}) END"


def dense(k: int, name: str = "dense", where: str = "q.case_id % 20 = 0") -> str:
    return f"""{name} AS (SELECT query_id, case_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, case_id)::INTEGER AS rank FROM (
    SELECT q.case_id AS query_id, c.case_id, round(list_cosine_similarity(q.v, c.v), 6) + 0.0 AS score
    FROM emb q JOIN emb c ON {where} AND q.case_id <> c.case_id)) WHERE rank <= {k})"""


FEATURES = "features AS (SELECT case_id, " + ", ".join(f"{r.sql('line')} AS {n}" for n, r in FIELDS.items()) + f" FROM (SELECT case_id, {LINE} AS line FROM cases))"
LONG = "long AS (" + " UNION ALL ".join(f"SELECT case_id, '{n}' AS field, {n} AS value FROM features WHERE {n} IS NOT NULL" for n in FIELDS) + ")"
WORDS = sorted({k for ks in LEXICON.values() for k in ks})
LEX = "lex AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{k}')" for c, ks in LEXICON.items() for k in ks) + ") AS t(class, keyword))"
COUNTS = f"""counts AS (SELECT case_id, keyword, count(*) AS n FROM (SELECT case_id, unnest(regexp_extract_all(lower(fact), '[a-z0-9]+')) AS keyword FROM cases)
  WHERE keyword IN ({', '.join(f"'{w}'" for w in WORDS)}) GROUP BY ALL)"""
VOTES = "votes AS (SELECT case_id, class, sum(n)::BIGINT AS n FROM counts JOIN lex USING (keyword) GROUP BY ALL)"
DOMAIN = "domain AS (SELECT field, value, (row_number() OVER (ORDER BY field, value) - 1)::INTEGER AS dim FROM (SELECT DISTINCT field, value FROM long))"
MATRIX = """cells AS (SELECT case_id, field || '=' || value AS dim, 1.0::DOUBLE AS w FROM long UNION ALL SELECT case_id, 'kw:' || keyword, n::DOUBLE FROM counts),
matrix AS (SELECT case_id, dim, w / sqrt(sum(w * w) OVER (PARTITION BY case_id)) AS weight FROM cells)"""
SPARSE_BASE = f"{CASES}, {FEATURES}, {LONG}, {COUNTS}, {MATRIX}"


def sparse(k: int) -> str:
    return f"""sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, case_id)::INTEGER AS rank FROM (
    SELECT q.case_id AS query_id, c.case_id, round(sum(q.weight * c.weight), 6) AS score FROM matrix q JOIN matrix c ON q.dim = c.dim AND q.case_id <> c.case_id
    WHERE q.case_id % 20 = 0 GROUP BY ALL)) WHERE rank <= {k} AND score > 0)"""


def sides(source: str) -> str:
    cols = ", ".join(f"{t}.{n} AS {t}_{n}" for t in "qc" for n in ("accusation", "articles", "death", "life", "months"))
    return f"SELECT q.case_id AS q_id, c.case_id AS c_id, {cols} {source}"


def seeded(c: str) -> str:
    return f"md5('7:' || {c})"


PAIRS = f"pairs AS ({sides('FROM cases q JOIN cases c ON q.case_id % 20 = 0 AND q.case_id <> c.case_id AND list_has_any(q.accusation, c.accusation)')})"


def capped(cap: int, where: str = "q.case_id % 20 = 0") -> str:
    """pairs() with at most cap candidates for each query and label."""
    return f"""labelled AS (SELECT case_id, unnest(accusation) AS label FROM cases),
met AS (SELECT DISTINCT q_id, c_id FROM (SELECT q.case_id AS q_id, c.case_id AS c_id, row_number() OVER (PARTITION BY q.case_id, label ORDER BY {seeded('c.case_id')}, c.case_id) AS n
  FROM labelled q JOIN labelled c USING (label) WHERE {where} AND q.case_id <> c.case_id) WHERE n <= {cap}),
pairs AS ({sides('FROM met JOIN cases q ON q.case_id = q_id JOIN cases c ON c.case_id = c_id')})"""


FLAGS = "(q_death = c_death AND q_life = c_life)"
RATIO = "(abs(q_months - c_months) / greatest(q_months, 1))"
SAME_ACC, SAME_ART, OVER_ACC, OVER_ART = "(q_accusation = c_accusation)", "(q_articles = c_articles)", "list_has_any(q_accusation, c_accusation)", "list_has_any(q_articles, c_articles)"
COMPARABLE = f"({FLAGS} AND ({SAME_ACC} OR ({OVER_ACC} AND {OVER_ART})) AND (q_death OR q_life OR {RATIO} <= 0.3))"
LEVEL = f"""CASE WHEN NOT {FLAGS} THEN 0 WHEN {SAME_ACC} AND {SAME_ART} AND q_months = c_months THEN 1 WHEN {SAME_ACC} AND {SAME_ART} AND {RATIO} <= 0.1 THEN 2
  WHEN {SAME_ACC} AND {SAME_ART} AND {RATIO} <= 0.3 THEN 3 WHEN {SAME_ACC} AND {OVER_ART} AND {RATIO} <= 0.3 THEN 4 WHEN {OVER_ACC} AND {OVER_ART} AND {RATIO} <= 0.3 THEN 5 ELSE 0 END"""
RAMP = "CASE WHEN cos >= 0.95 THEN 30.0 WHEN cos >= 0.9 THEN 25 + (cos - 0.9) * 100 WHEN cos >= 0.8 THEN 15 + (cos - 0.8) * 100 WHEN cos >= 0.7 THEN 5 + (cos - 0.7) * 100 WHEN cos >= 0.6 THEN (cos - 0.6) * 100 ELSE 0.0 END"


def jac(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) ELSE 0.0 END)"


KW = f"least(30.0, {jac('q_kws', 'c_kws')} * 15 + {jac('q_classes', 'c_classes')} * 15)"
DIFF, REL = "abs(q_months - c_months)", "(abs(q_months - c_months) / greatest(q_months, c_months))"
TERM = f"""CASE WHEN q_death AND c_death THEN 10 WHEN q_life AND c_life THEN 10 WHEN NOT {FLAGS} THEN 0 WHEN q_months = c_months THEN 10
  WHEN q_months = 0 OR c_months = 0 THEN CASE WHEN {DIFF} > 12 THEN 0 ELSE 5 END WHEN {REL} <= 0.1 THEN 10 WHEN {REL} <= 0.3 THEN 7 WHEN {REL} <= 0.5 THEN 4 ELSE 1 END"""


def lab(n: str) -> str:
    return f"(CASE WHEN q_{n} = c_{n} THEN 15.0 ELSE {jac(f'q_{n}', f'c_{n}')} * 15 END)"


LAW = f"({lab('accusation')} + {lab('articles')} + ({TERM}))"
KSETS = "ksets AS (SELECT case_id, list_sort(list_distinct(list(keyword))) AS kws, list_sort(list_distinct(list(class))) AS classes FROM counts JOIN lex USING (keyword) GROUP BY case_id)"


def with_kw(source: str, name: str) -> str:
    e = "[]::VARCHAR[]"
    return f"{name} AS (SELECT p.*, coalesce(a.kws, {e}) AS q_kws, coalesce(a.classes, {e}) AS q_classes, coalesce(b.kws, {e}) AS c_kws, coalesce(b.classes, {e}) AS c_classes FROM {source} p LEFT JOIN ksets a ON a.case_id = q_id LEFT JOIN ksets b ON b.case_id = c_id)"


VPAIRS = "vpairs AS (SELECT p.*, round(list_cosine_similarity(a.v, b.v), 6) AS cos FROM pairs p JOIN emb a ON a.case_id = q_id JOIN emb b ON b.case_id = c_id)"
TOTAL = f"round(({RAMP}) + {KW} + {LAW}, 6)"


def scored(cap: int) -> str:
    return f"{CASES}, {EMB}, {COUNTS}, {LEX}, {KSETS}, {capped(cap)}, {VPAIRS}, {with_kw('vpairs', 'kpairs')}, scored AS (SELECT *, {TOTAL} AS total FROM kpairs)"


SCORED = scored(2500)
FOUND_PAIRS = f"{dense(100)}, fpairs AS ({sides(', d.score AS cos FROM dense d JOIN cases q ON q.case_id = d.query_id JOIN cases c ON c.case_id = d.case_id')})"


def topk(source: str, group: str, k: int, order: str, cols: str) -> str:
    return f"SELECT {cols}, rank FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {order})::INTEGER AS rank FROM {source}) WHERE rank <= {k}"


def full(source: str, group: str, n: int, cols: str) -> str:
    return f"SELECT {cols} FROM (SELECT *, count(*) OVER (PARTITION BY {group}) AS members FROM {source}) WHERE members >= {n}"


LEVELS = f"levels AS (SELECT q_id, c_id, {LEVEL} AS level FROM pairs)"
GOLD = f"{LEVELS}, gold0 AS ({topk('(SELECT * FROM levels WHERE level > 0)', 'q_id', 12, f'level, {seeded("c_id")}', 'q_id, c_id, level')}), gold AS ({full('gold0', 'q_id', 12, 'q_id, c_id, level, rank')})"
MERGED = f"""{SPARSE_BASE}, {EMB}, {dense(10)}, {sparse(10)},
found AS (SELECT f.*, fact, {hashed('fact')} AS h FROM (SELECT *, 0 AS src_order FROM dense UNION ALL SELECT query_id, case_id, score, rank, 1 FROM sparse) f JOIN cases USING (case_id)),
merged AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, h ORDER BY src_order, rank) AS nth FROM found WHERE h <> '') WHERE nth = 1)"""
HITS = f"""{CASES}, {EMB}, {PAIRS}, {GOLD}, {dense(10)}, g10 AS (SELECT * FROM gold WHERE rank <= 10), npos AS (SELECT q_id, count(*) AS n_positive FROM g10 GROUP BY q_id),
hits AS (SELECT d.query_id, d.case_id, d.rank, CASE WHEN g.c_id IS NULL THEN 0 ELSE 1 END AS hit, n_positive FROM dense d JOIN npos ON d.query_id = npos.q_id LEFT JOIN g10 g ON g.q_id = d.query_id AND g.c_id = d.case_id)"""


def metric_rows(source: str) -> str:
    return f"""SELECT k::INTEGER AS k, count(*) AS n_queries, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS f1, round(avg(CASE WHEN h > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate
  FROM (SELECT query_id, k, count(*) AS n, sum(hit) AS h, sum(hit) / k AS p, sum(hit) / max(n_positive) AS r FROM {source} JOIN (VALUES (3), (5), (10)) AS t(k) ON rank <= k GROUP BY query_id, k) WHERE n = k GROUP BY k"""


PRED = f"""{CASES}, {COUNTS}, {LEX}, {VOTES}, best AS ({topk("(SELECT * FROM votes WHERE class <> 'place')", 'case_id', 1, 'n DESC, class', 'case_id, class')}),
pred AS (SELECT case_id, lang AS truth, coalesce(CASE substr(class, 1, 2) WHEN 'ge' THEN 'de' WHEN 'sp' THEN 'es' ELSE substr(class, 1, 2) END, 'none') AS predicted FROM cases LEFT JOIN best USING (case_id))"""


def content(text: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"list_filter(regexp_extract_all(lower({text}), '[a-z0-9]+'), lambda w: length(w) >= 2 AND w NOT IN ({stop}) AND NOT regexp_matches(w, '^[a-z]*[0-9]+[a-z]*$'))"


def mined(rows: str, k: int, least: int) -> str:
    return f"""WITH {CASES}, base AS ({rows}), sizes AS (SELECT label, count(*) AS n_class FROM base GROUP BY label),
  bc AS (SELECT label, word, count(*) AS df_class FROM (SELECT label, unnest(list_distinct({content('fact')})) AS word FROM base) GROUP BY ALL),
  bw AS (SELECT word, sum(df_class)::BIGINT AS df_all FROM bc GROUP BY word),
  sc AS (SELECT label, word, df_class, df_all, round((df_class / n_class) / (df_all / (SELECT sum(n_class) FROM sizes) + 1e-9), 6) AS lift FROM bc JOIN bw USING (word) JOIN sizes USING (label) WHERE df_class >= 2 AND n_class >= {least})
  {topk('sc', 'label', k, 'lift DESC, df_class DESC, word', 'label, word, lift, df_class, df_all')}"""


CENT = """cell AS (SELECT label, unnest(range(64)) AS dim, unnest(v) AS x FROM emb), cent AS (SELECT label, dim::INTEGER AS dim, avg(x) AS mean, stddev_pop(x) AS std FROM cell GROUP BY label, dim),
cvec AS (SELECT label AS predicted, list(mean ORDER BY dim) AS c, avg(std) AS avg_std FROM cent GROUP BY label),
near AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, predicted) AS rank FROM (SELECT case_id, label, predicted, round(list_cosine_similarity(v, c), 6) AS score FROM emb CROSS JOIN cvec))"""
COVER = f"""cover AS (SELECT case_id, tier FROM (SELECT *, CASE WHEN NOT single THEN 2 WHEN nth = 1 THEN 0 ELSE 1 END AS tier FROM (
  SELECT case_id, len(accusation) = 1 AS single, row_number() OVER (PARTITION BY len(accusation) = 1, accusation[1] ORDER BY {seeded('case_id')}, case_id) AS nth FROM cases WHERE len(accusation) > 0))
  ORDER BY tier, {seeded('case_id')}, case_id LIMIT 60)"""


def oracles() -> dict[str, str]:
    w = f"WITH {CASES}, "
    pw = w + PAIRS
    return {
        "dense_topk": f"WITH {EMB}, {dense(10)} SELECT * FROM dense",
        "dense_topk_dedup": f"""{w}{EMB}, {dense(30)}, f AS (SELECT * FROM (SELECT d.*, row_number() OVER (PARTITION BY query_id, md5(fact) ORDER BY rank) AS nth FROM dense d JOIN cases USING (case_id)) WHERE nth = 1)
          {topk('(SELECT query_id, case_id, score FROM f)', 'query_id', 10, 'score DESC, case_id', 'query_id, case_id, score')}""",
        "sparse_topk": f"WITH {SPARSE_BASE}, {sparse(5)} SELECT query_id, case_id, score, rank FROM sparse",
        "hybrid_merge": f"WITH {MERGED} SELECT query_id, case_id, score, rank AS src_rank, src_order, row_number() OVER (PARTITION BY query_id ORDER BY src_order, rank)::INTEGER AS rank FROM merged",
        "hybrid_rerank": f"""WITH {MERGED}, tok AS (SELECT case_id, list_distinct(regexp_extract_all(lower(fact), '[a-z0-9]+')) AS t FROM cases),
          sc AS (SELECT m.query_id, m.case_id, m.score, round(CASE WHEN len(a.t) + len(b.t) > 0 THEN len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) ELSE 0.0 END, 6) AS rr FROM merged m JOIN tok a ON a.case_id = m.query_id JOIN tok b ON b.case_id = m.case_id),
          fin AS (SELECT query_id, case_id, coalesce(nullif(rr, 0.0), score) AS final_score FROM sc)
          {topk('fin', 'query_id', 5, 'final_score DESC, case_id', 'query_id, case_id, final_score')}""",
        "rule_features": f"{w}{FEATURES} SELECT * FROM features",
        "rule_feature_stats": f"{w}{FEATURES} " + " UNION ALL ".join(f"SELECT '{n}' AS field, count({n}) AS hits, round(count({n}) * 100.0 / count(*), 6)::DOUBLE AS rate FROM features" for n in FIELDS),
        "rule_value_distribution": f"{w}{FEATURES}, {LONG} SELECT field, value, count(*) AS n FROM long GROUP BY ALL",
        "keyword_counts": f"{w}{COUNTS} SELECT * FROM counts",
        "class_counts": f"{w}{COUNTS}, {LEX}, {VOTES} SELECT * FROM votes",
        "keyword_totals": f"{w}{COUNTS} SELECT keyword, sum(n)::BIGINT AS total, count(*) AS docs FROM counts GROUP BY keyword",
        "matched_documents": f"{w}{COUNTS} SELECT (SELECT count(*) FROM cases) AS docs, (SELECT count(DISTINCT case_id) FROM counts) AS docs_matched",
        "onehot_domain": f"{w}{FEATURES}, {LONG}, {DOMAIN} SELECT * FROM domain",
        "sparse_matrix": f"WITH {SPARSE_BASE} SELECT case_id, dim, round(weight, 6) AS weight FROM matrix",
        "hydrate": f"{w}e AS (SELECT vec_id, label FROM embeddings) SELECT vec_id, label, coalesce(md5(fact), 'missing') AS fact_md5, CASE WHEN accusation IS NULL THEN NULL ELSE array_to_string(accusation, '|') END AS accusation, months FROM e LEFT JOIN cases ON vec_id = case_id",
        "paired_lookup": f"""{w}{FEATURES}, {LONG}, {COUNTS}, f AS (SELECT case_id, count(*) AS nf FROM long GROUP BY 1), k AS (SELECT case_id, sum(n)::BIGINT AS nk FROM counts GROUP BY 1)
          SELECT case_id, CASE WHEN nk IS NOT NULL THEN nf END AS n_features, CASE WHEN nf IS NOT NULL THEN nk END AS n_keywords FROM cases LEFT JOIN f USING (case_id) LEFT JOIN k USING (case_id)""",
        "set_equal_join": f"{pw} SELECT q_id, c_id FROM pairs WHERE {SAME_ACC}",
        "legal_filter": f"{pw} SELECT q_id, c_id FROM pairs WHERE {COMPARABLE}",
        "similarity_level": f"{pw}, {LEVELS} SELECT * FROM levels",
        "level_distribution": f"{pw}, {LEVELS} SELECT q_id, " + ", ".join(f"count(*) FILTER (level = {k}) AS level{k}" for k in range(1, 6)) + " FROM levels WHERE level > 0 GROUP BY q_id",
        "imprisonment_tolerance": f"{pw} SELECT q_id, c_id, {FLAGS} AND (q_death OR q_life OR abs(q_months - c_months) <= greatest(6.0, q_months * 0.2)) AS within FROM pairs",
        "embedding_ramp": f"{w}{EMB}, {FOUND_PAIRS} SELECT q_id, c_id, round({RAMP}, 6)::DOUBLE AS score FROM fpairs",
        "jaccard_score": f"{w}{EMB}, {FOUND_PAIRS}, {COUNTS}, {LEX}, {KSETS}, {with_kw('fpairs', 'kp')} SELECT q_id, c_id, round({KW}, 6)::DOUBLE AS score FROM kp",
        "legal_score": f"{pw} SELECT q_id, c_id, round({LAW}, 6)::DOUBLE AS score FROM pairs",
        "total_score": f"{w}{EMB}, {FOUND_PAIRS}, {COUNTS}, {LEX}, {KSETS}, {with_kw('fpairs', 'kp')} SELECT q_id, c_id, {TOTAL}::DOUBLE AS total FROM kp",
        "tiered_gold": f"{pw}, {GOLD} SELECT * FROM gold",
        "capped_candidates": f"{w}{capped(40)} SELECT q_id, c_id FROM pairs",
        "gold_candidates": f"{w}{capped(2500)} SELECT q_id, c_id FROM pairs",
        "scored_gold": f"WITH {SCORED}, t AS ({topk('scored', 'q_id', 5, 'total DESC, c_id', 'q_id, c_id, total::DOUBLE AS total')}) {full('t', 'q_id', 5, 'q_id, c_id, total, rank')}",
        "label_set_sample": f"""{w}s AS (SELECT case_id, array_to_string(accusation, '|') AS label_set FROM cases WHERE length(fact) BETWEEN 300 AND 700 AND len(accusation) > 0)
          SELECT case_id, label_set FROM (SELECT *, row_number() OVER (PARTITION BY label_set ORDER BY {seeded('case_id')}, case_id) AS n FROM s) WHERE n = 1 ORDER BY {seeded('case_id')}, case_id LIMIT 100""",
        "recall_filter_rank": f"""{w}{EMB}, {dense(100)}, p AS ({sides(', d.rank AS found_rank FROM dense d JOIN cases q ON q.case_id = d.query_id JOIN cases c ON c.case_id = d.case_id')}),
          s AS (SELECT *, CASE WHEN {SAME_ACC} THEN 3 ELSE 0 END + CASE WHEN {SAME_ART} THEN 2 ELSE 0 END + CASE WHEN {OVER_ART} THEN 1 ELSE 0 END AS rule_score FROM p WHERE {COMPARABLE})
          {topk('s', 'q_id', 10, 'rule_score DESC, found_rank', 'q_id, c_id, rule_score::INTEGER AS rule_score')}""",
        "cascade_sample": f"""WITH {scored(10_000)}, co AS ({topk('(SELECT * FROM scored WHERE len(q_accusation) = 1)', 'q_id', 50, 'cos DESC, c_id', 'q_id, c_id, total')}),
          t AS ({topk('(SELECT q_id, c_id, total FROM co)', 'q_id', 5, 'total DESC, c_id', 'q_id, c_id, total')}), f AS ({full('t', 'q_id', 5, 'q_id, c_id, total, rank')}),
          b AS (SELECT q_id, round(avg(total), 6) AS quality FROM f GROUP BY q_id ORDER BY 2 DESC, q_id LIMIT 20)
          SELECT q_id, c_id, total::DOUBLE AS total, rank, quality::DOUBLE AS quality FROM f JOIN b USING (q_id)""",
        "coverage_sample": f"{w}{COVER} SELECT case_id, tier::INTEGER AS tier FROM cover",
        "diverse_sample": f"""{w}{COVER}, {EMB}, {dense(30, where='q.case_id IN (SELECT case_id FROM cover)')}, {COUNTS}, {LEX}, {KSETS},
          p AS ({sides(', d.score AS cos FROM dense d JOIN cases q ON q.case_id = d.query_id JOIN cases c ON c.case_id = d.case_id')}), {with_kw('p', 'kp')}, s AS (SELECT *, {TOTAL} AS total FROM kp),
          t AS ({topk('s', 'q_id', 8, 'total DESC, c_id', 'q_id, c_id, total::DOUBLE AS total')}) {full('t', 'q_id', 8, 'q_id, c_id, total, rank')}""",
        "retrieval_metrics": f"WITH {HITS} {metric_rows('hits')}",
        "attribute_metrics": f"WITH {HITS}, ah AS (SELECT query_id, rank, n_positive, (a.accusation = b.accusation)::INTEGER AS hit FROM hits JOIN cases a ON a.case_id = query_id JOIN cases b ON b.case_id = hits.case_id) {metric_rows('ah')}",
        "hit_rate": f"WITH {HITS} SELECT k::INTEGER AS k, round(avg(hit), 6) AS hit_rate, count(*) AS n_queries FROM (SELECT query_id, k, max(hit) AS hit FROM hits JOIN (VALUES (1), (3), (5)) AS t(k) ON rank <= k GROUP BY query_id, k) GROUP BY k",
        "keyword_vote": f"{w}{COUNTS}, {LEX}, {VOTES} {topk('votes', 'case_id', 3, 'n DESC, class', 'case_id, class, n')}",
        "accuracy_macro_f1": f"""WITH {PRED}, s AS (SELECT label, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (SELECT truth AS label, (truth = predicted)::INTEGER AS tp, 0 AS fp, (truth <> predicted)::INTEGER AS fn FROM pred UNION ALL SELECT predicted, 0, 1, 0 FROM pred WHERE truth <> predicted) GROUP BY label),
          f AS (SELECT *, 2 * tp / (2 * tp + fp + fn) AS f1 FROM s) SELECT round(sum(tp) / sum(tp + fn), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(avg(f1) FILTER (tp + fn > 0), 6) AS macro_f1_true, count(*) AS n_labels FROM f""",
        "label_mapping_stats": f"WITH {PRED} SELECT truth, predicted, count(*) AS n FROM pred WHERE truth <> predicted GROUP BY ALL",
        "keyword_lift": mined("SELECT lang AS label, fact FROM cases", 30, 5),
        "target_keyword_lift": mined("SELECT * FROM (SELECT unnest(accusation) AS label, fact FROM cases) WHERE label IN ('src1', 'src2', 'src3')", 25, 1),
        "centroids": f"WITH {EMB}, {CENT} SELECT label, dim, round(mean, 6) AS mean, round(std, 6) AS std FROM cent",
        "centroid_spread": f"WITH {EMB}, {CENT} SELECT label, count(*) AS n, round(any_value(avg_std), 6) AS avg_std, round(min(d), 6) AS min_dist, round(max(d), 6) AS max_dist, round(avg(d), 6) AS mean_dist FROM (SELECT label, avg_std, list_distance(v, c) AS d FROM emb JOIN cvec ON label = predicted) GROUP BY label",
        "nearest_centroid": f"WITH {EMB}, {CENT} SELECT case_id, label, predicted, score FROM near WHERE rank = 1",
        "recall_at_k": f"WITH {EMB}, {CENT} SELECT " + ", ".join(f"round(avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS recall_{k}" for k in (1, 3, 5)) + ", count(*) AS n FROM near WHERE label = predicted",
        "topbottom_classes": f"""{w}n AS (SELECT label, count(*) AS n FROM (SELECT unnest(accusation) AS label FROM cases) GROUP BY label), r AS (SELECT *, row_number() OVER (ORDER BY n, label) AS up, row_number() OVER (ORDER BY n DESC, label) AS down, least(5, greatest(1, count(*) OVER () // 2)) AS k FROM n)
          SELECT label, n, CASE WHEN down <= k THEN 'top' ELSE 'bottom' END AS side FROM r WHERE down <= k OR up <= k""",
        "round_robin_pool": f"""{w}t AS (SELECT case_id, accusation[1] AS label, row_number() OVER (PARTITION BY accusation[1] ORDER BY {seeded('case_id')})::INTEGER AS turn FROM cases WHERE length(fact) >= 100 AND len(accusation) > 0)
          SELECT case_id, label, turn FROM t ORDER BY turn, {seeded('label')}, label LIMIT 50""",
        "stratified_sample": f"{w}t AS (SELECT case_id, accusation[1] AS label FROM cases WHERE len(accusation) > 0) {topk('t', 'label', 10, f'{seeded("case_id")}, case_id', 'label, case_id')}",
        "category_map": f"{w}x AS (SELECT case_id, accusation[1] AS first FROM cases) SELECT case_id, CASE first WHEN 'src0' THEN 'large' WHEN 'src1' THEN 'odd' WHEN 'src2' THEN 'even' ELSE 'other' END AS category FROM x",
        "resume_antijoin": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
        "score_cache_misses": "WITH k AS (SELECT conv_id, turn, md5(role) || ':' || md5(text) AS cache_key FROM conversations) SELECT * FROM k WHERE cache_key NOT IN (SELECT cache_key FROM k WHERE conv_id % 2 = 0)",
        "history_tail": topk("conversations", "conv_id", 3, "turn DESC", "conv_id, turn, role"),
        "field_diff": f"{w}l AS (SELECT case_id, {LINE} AS line, {LINE.replace('fact', f'({REST})')} AS rest FROM cases), x AS (SELECT case_id, list_filter([" + ", ".join(f"CASE WHEN (({r.sql('line')}) IS NULL) <> (({r.sql('rest')}) IS NULL) THEN '{n}' END" for n, r in FIELDS.items()) + "], lambda f: f IS NOT NULL) AS df FROM l) SELECT case_id, array_to_string(df, ',') AS diff_fields, len(df) AS n_diff FROM x",
        "text_functions": f"SELECT doc_id, length(text) AS n, {hashed('text')} AS hash, source AS filled, len({content('text')}) AS n_words, replace(source, 's', '') AS label, source AS parsed FROM documents",
        "self_exclusion": f"{w}{EMB}, {dense(10)}, h AS (SELECT case_id, {hashed('fact')} AS h FROM cases) SELECT d.query_id, d.case_id, d.score FROM dense d JOIN h a ON a.case_id = d.query_id JOIN h b ON b.case_id = d.case_id WHERE a.h <> b.h",
        "prompt_context": f"{pw}, {GOLD} SELECT q_id, string_agg(rank || '. ' || array_to_string(accusation, ',') || ' ' || months, chr(10) ORDER BY rank) AS context FROM gold JOIN cases ON c_id = case_id WHERE rank <= 3 GROUP BY q_id",
        "inverted_index": f"{w}x AS (SELECT case_id, unnest(accusation) AS label FROM cases) SELECT label, count(*) AS n, min(case_id) AS first_id, max(case_id) AS last_id FROM x GROUP BY label",
    }
