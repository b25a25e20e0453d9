"""Contexts, messages, response fields, query understanding, assessment, memory, extraction."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.catalog.base import (
    SQL_CLINICAL, SQL_MESSAGES, SQL_QUERIES, clinical_documents, derived_messages, derived_queries, pick, query,
    sql_list, sql_pick, sql_str, sql_strip, table,
)
from corpusloom.catalog.retrieval import K, SQL_BENCH, SQL_BM25, benchmark_queries, corpus_chunks, document_index
from corpusloom.functions import lexicon as L
from corpusloom.functions import text as T
from corpusloom.operators import conversation as C
from corpusloom.operators import extraction as X
from corpusloom.operators import hits as H
from corpusloom.operators import responses as R
from corpusloom.operators import understanding as U
from corpusloom.operators.assessment import assess
from corpusloom.operators.context import build_messages, format_context, format_results
from corpusloom.operators.sparse import bm25_search

md5 = F.md5


# ---- contexts -----------------------------------------------------------
def sql_ellipsis(x: str, n: str) -> str:
    return (
        f"CASE WHEN length({x}) <= {n} THEN {x} WHEN {n} <= 1 THEN substr({x}, 1, {n}) "
        rf"ELSE regexp_replace(substr({x}, 1, {n} - 1), '\s+$', '') || '…' END"
    )


@query("truncate_ellipsis", f"SELECT doc_id, md5({sql_ellipsis('text', '(doc_id % 500)')}) AS text_md5 FROM documents")
def truncate_ellipsis(spark: SparkSession, sf: str) -> DataFrame:
    n = (F.col("doc_id") % 500).cast("int")
    return table(spark, sf, "documents").select("doc_id", md5(T.truncate_ellipsis(F.col("text"), n)).alias("text_md5"))


def asked_queries(spark: SparkSession, sf: str) -> DataFrame:
    """The benchmark's texts and, for each, a query that no document answers."""
    q = benchmark_queries(spark, sf)
    return q.unionAll(q.select((-F.col("query_id") - 1).alias("query_id"), md5("query").alias("query")))


SQL_ASKED = "q AS (SELECT item_id AS query_id, text AS query FROM benchmark UNION ALL SELECT -item_id - 1, md5(text) FROM benchmark)"


def bench_hits(spark: SparkSession, sf: str) -> DataFrame:
    """query_id, rank, score in [0,1], text, source of the term search."""
    hits = bm25_search(document_index(spark, sf), asked_queries(spark, sf), K, "query")
    return hits.join(corpus_chunks(spark, sf), "chunk_id").select(
        "query_id", "chunk_id", "rank", F.round(F.col("score") / (F.col("score") + 60), 4).alias("score"), "text", "source"
    )


SQL_HITS = f"""hits AS (SELECT query_id, chunk_id, rank, round(score / (score + 60), 4) AS score, d.text, d.source
  FROM sparse JOIN documents d ON d.doc_id = chunk_id WHERE rank <= {K})"""
_HEAD = "'[文献' || rank || '] 来源: ' || source || ' (相关度: ' || printf('%.4f', score) || ')' || chr(10)"


@query(
    "format_context",
    f"""WITH {SQL_ASKED}, {SQL_BM25}, {SQL_HITS},
 p AS (SELECT query_id, rank, {_HEAD} AS head, {sql_ellipsis('text', '2000')} AS body FROM hits),
 r AS (SELECT *, 12000 - coalesce(sum(length(head) + length(body) + 7) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM p),
 k AS (SELECT query_id, rank, head, CASE WHEN length(head) + length(body) <= room THEN body ELSE {sql_ellipsis('body', '(room - length(head))::BIGINT')} END AS body
   FROM r WHERE room > 0 AND (length(head) + length(body) <= room OR room > length(head)))
SELECT query_id, md5(string_agg(head || body, {sql_str(L.PART_SEPARATOR)} ORDER BY rank)) AS context_md5, count(*) AS n_docs FROM k GROUP BY query_id""",
)
def format_context_q(spark: SparkSession, sf: str) -> DataFrame:
    out = format_context(bench_hits(spark, sf))
    return out.select("query_id", md5("context").alias("context_md5"), "n_docs")


@query(
    "build_messages",
    f"""WITH {SQL_ASKED}, {SQL_BM25}, {SQL_HITS},
 c AS (SELECT query_id, string_agg(head || {sql_ellipsis('text', '900')}, {sql_str(L.PART_SEPARATOR)} ORDER BY rank) AS ctx
   FROM (SELECT *, {_HEAD} AS head FROM hits) GROUP BY 1)
SELECT query_id, CASE WHEN ctx IS NULL THEN NULL ELSE md5({sql_str(L.SYSTEM_PROMPT)}) END AS system_md5,
  md5(replace(replace({sql_str(L.USER_PROMPT)}, '{{query}}', query), '{{context}}', ctx)) AS user_md5,
  CASE WHEN ctx IS NULL THEN {sql_str(L.NO_ANSWER)} END AS answer FROM q LEFT JOIN c USING (query_id)""",
)
def build_messages_q(spark: SparkSession, sf: str) -> DataFrame:
    contexts = format_context(bench_hits(spark, sf), None, 900)
    m = build_messages(asked_queries(spark, sf), contexts)
    return m.select(
        "query_id", md5(F.get("messages", F.lit(0))["content"]).alias("system_md5"),
        md5(F.get("messages", F.lit(1))["content"]).alias("user_md5"), "answer",
    )


@query(
    "format_results_text",
    f"""WITH {SQL_ASKED}, {SQL_BM25}, {SQL_HITS},
 f AS (SELECT query_id, string_agg('[文献' || rank || ']' || CASE WHEN chunk_id % 2 = 0 THEN ' T' || chunk_id ELSE '' END || ' (来源: ' || source
   || ', 相关度: ' || printf('%.4f', score) || ')' || chr(10) || text, {sql_str(L.PART_SEPARATOR)} ORDER BY rank) AS x FROM hits GROUP BY 1)
SELECT query_id, md5(coalesce(x, {sql_str(L.NO_RESULTS)})) AS formatted_md5 FROM q LEFT JOIN f USING (query_id)""",
)
def format_results_text_q(spark: SparkSession, sf: str) -> DataFrame:
    h = bench_hits(spark, sf).withColumn("original_text", F.lit(None).cast("string"))
    h = h.withColumn("title", F.when(F.col("chunk_id") % 2 == 0, F.concat(F.lit("T"), F.col("chunk_id").cast("string"))))
    out = format_results(asked_queries(spark, sf), H.format_results_text(h))
    return out.select("query_id", md5("formatted").alias("formatted_md5"))


# ---- generated responses: text built from the conversations -------------
STRATEGY_FORMS = ["VECTOR", "bm25 检索", "Hybrid", "DIRECT", "web", "UNKNOWN"]
DECISION_FORMS = ["SUFFICIENT", "partial", "INSUFFICIENT", "nothing"]


def route_responses(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    i = F.col("conv_id") * 1000 + F.col("turn")
    first = F.get(F.split("text", "\n"), F.lit(0))
    return c.select(
        i.alias("query_id"),
        "text",
        F.concat(F.lit("\n分析\n策略："), pick(STRATEGY_FORMS, i), F.when(i % 4 == 0, "").otherwise(F.concat(F.lit("\n原因： "), first)), F.lit("\n")).alias("route"),
        F.concat(F.when(i % 5 == 0, "").otherwise(F.concat(F.lit("优化查询："), first, F.lit(" ext"))), F.lit("\n原因：同义：扩展")).alias("rewrite"),
        F.concat(
            F.lit("相关性："), F.when(i % 3 == 0, "高").otherwise(F.concat(F.lit("0."), (i % 10).cast("string"))),
            F.lit("\n充分性：0.25\n决策："), pick(DECISION_FORMS, i), F.lit("\n原因："), first,
        ).alias("evaluation"),
    )


_FIRST = "string_split(text, chr(10))[1]"
_RESP = f"""i AS (SELECT conv_id * 1000 + turn AS query_id, text, {_FIRST} AS f FROM conversations),
 resp AS (SELECT query_id, text, f, {sql_pick(STRATEGY_FORMS, 'query_id')} AS st, {sql_pick(DECISION_FORMS, 'query_id')} AS de FROM i)"""


@query(
    "parse_llm_fields",
    f"""WITH {_RESP}, r AS (SELECT *, CASE st WHEN 'VECTOR' THEN 'vector' WHEN 'bm25 检索' THEN 'bm25' WHEN 'DIRECT' THEN 'direct' WHEN 'web' THEN 'web' ELSE 'hybrid' END AS kind FROM resp)
SELECT query_id, kind AS query_type, 0.85::DOUBLE AS confidence, CASE WHEN query_id % 4 = 0 THEN 'LLM 决策' ELSE {sql_strip('f')} END AS route_reason,
  CASE kind WHEN 'vector' THEN 0.9::DOUBLE WHEN 'bm25' THEN 0.3::DOUBLE WHEN 'hybrid' THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS alpha,
  md5(CASE WHEN query_id % 5 = 0 THEN text ELSE f || ' ext' END) AS rewritten_md5, query_id % 5 <> 0 AS is_modified, '同义：扩展' AS rewrite_reason,
  CASE WHEN query_id % 3 = 0 THEN 0.5::DOUBLE ELSE ('0.' || (query_id % 10))::DOUBLE END AS relevance, 0.25::DOUBLE AS sufficiency,
  CASE WHEN de IN ('SUFFICIENT', 'INSUFFICIENT') THEN 'sufficient' ELSE 'partial' END AS decision, {sql_strip('f')} AS evaluation_reason FROM r""",
)
def parse_llm_fields_q(spark: SparkSession, sf: str) -> DataFrame:
    r = route_responses(spark, sf).select(
        "query_id", R.route_fields(F.col("route")).alias("r"), R.rewrite_fields(F.col("text"), F.col("rewrite")).alias("w"),
        R.evaluation_fields(F.col("evaluation")).alias("e"),
    )
    return r.select(
        "query_id", "r.query_type", "r.confidence", F.col("r.reason").alias("route_reason"), "r.alpha",
        md5("w.rewritten").alias("rewritten_md5"), "w.is_modified", F.col("w.reason").alias("rewrite_reason"),
        "e.relevance", "e.sufficiency", "e.decision", F.col("e.reason").alias("evaluation_reason"),
    )


def entity_responses(spark: SparkSession, sf: str) -> DataFrame:
    d = clinical_documents(spark, sf)
    word = F.regexp_extract("text", "[A-Za-z]+", 0)
    good = F.concat(F.lit('回答：\n{"diseases": ["'), word, F.lit('", "糖尿病"],\n "medications": ["M'), F.col("doc_id").cast("string"), F.lit('"]}\n完'))
    kind = F.col("doc_id") % 3
    return d.select("doc_id", F.when(kind == 0, good).when(kind == 1, "no json here").otherwise('{"diseases": [broken').alias("response"))


def sql_entities(source: str) -> str:
    """Rows of the whole pattern table, offsets from the text between the matches."""
    rows = ", ".join(
        f"('{kind}', {sql_str(name)}, {sql_str('(?i)' + p)})" for kind, ps in L.ENTITY_PATTERNS.items() for p, name in ps
    )
    return f"""pats(entity_type, normalized, pat) AS (VALUES {rows}),
 m AS (SELECT doc_id, entity_type, normalized, regexp_extract_all(text, pat) AS hs, regexp_split_to_array(text, pat) AS gs
   FROM {source} CROSS JOIN pats WHERE regexp_matches(text, pat)),
 e AS (SELECT doc_id, entity_type, normalized, hs, gs, unnest(range(1, len(hs) + 1)) AS i FROM m),
 ents AS (SELECT doc_id, entity_type, normalized, hs[i] AS text,
   (list_sum(list_transform(gs[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hs[1:i-1], lambda h: length(h))), 0))::BIGINT AS start_pos FROM e)"""


@query(
    "parse_llm_json",
    f"""WITH {SQL_CLINICAL}, {sql_entities('clinical')}
SELECT doc_id, 'disease' AS entity_type, regexp_extract(text, '[A-Za-z]+') AS text, regexp_extract(text, '[A-Za-z]+') AS normalized FROM clinical WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, 'disease', '糖尿病', '糖尿病' FROM clinical WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, 'medication', 'M' || doc_id, 'M' || doc_id FROM clinical WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, entity_type, text, normalized FROM ents WHERE doc_id % 3 <> 0""",
)
def parse_llm_json_q(spark: SparkSession, sf: str) -> DataFrame:
    ruled = X.extract_entities(clinical_documents(spark, sf))
    return R.parse_entity_json(entity_responses(spark, sf), ruled)


@query(
    "parse_score_fields",
    """WITH m AS (SELECT doc_id, coalesce(try_cast(trim(source, 'src') AS INT), 3) AS a, coalesce(try_cast(lang AS INT), 3) AS b,
  CASE WHEN doc_id % 2 = 0 THEN (doc_id % 5)::INT ELSE 3 END AS c FROM documents)
SELECT doc_id, a AS accuracy, b AS completeness, c AS clarity, round((a + b + c) / 3.0::DOUBLE, 6) AS overall FROM m""",
)
def parse_score_fields_q(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    clarity = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" "), (F.col("doc_id") % 5).cast("string"))).otherwise("4.5")
    s = R.score_fields(F.regexp_replace("source", "^src", ""), F.col("lang"), clarity)
    return d.select("doc_id", s.alias("s")).select("doc_id", "s.accuracy", "s.completeness", "s.clarity", F.round("s.overall", 6).alias("overall"))


# ---- query understanding ------------------------------------------------
def _sql_any(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {sql_str(w)})" for w in words) + ")"


def _sql_rx(x: str, patterns: list[str]) -> str:
    return f"regexp_matches({x}, {sql_str('|'.join(f'(?:{p})' for p in patterns))})"


_EXACT = f"""round(least(1.0::DOUBLE,
   CASE len(list_intersect(list_distinct(regexp_extract_all(l, '[A-Za-z0-9]+')), {sql_list(L.ABBREVIATIONS)})) WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 0.3::DOUBLE ELSE 0.6::DOUBLE END
   + CASE WHEN {_sql_rx('l', L.EXACT_TOPIC_PATTERNS)} THEN 0.3::DOUBLE ELSE 0 END
   + CASE WHEN regexp_matches(l, '(^|[^a-z0-9])({L.UNITS})([^a-z0-9]|$)') THEN 0.3::DOUBLE ELSE 0 END
   + CASE WHEN regexp_matches(l, '\\d+\\s*(?:{L.UNITS})') THEN 0.2::DOUBLE ELSE 0 END), 6)"""
_SEM_SUM = " + ".join(["0.5::DOUBLE"] + [f"CASE WHEN contains(l, {sql_str(w)}) THEN 0.15::DOUBLE ELSE 0 END" for w in L.SEMANTIC_WORDS])
_SEMANTIC = f"""round(least(1.0::DOUBLE, {_SEM_SUM} + CASE WHEN length(l) > 30 THEN 0.1::DOUBLE ELSE 0 END
   + CASE WHEN NOT regexp_matches(l, '\\d') AND len(list_intersect(regexp_extract_all(l, '[\\p{{L}}\\p{{N}}_]+'), {sql_list(L.ABBREVIATIONS)})) = 0 THEN 0.1::DOUBLE ELSE 0 END), 6)"""


def sql_scored(queries: str) -> str:
    return f"""low AS (SELECT *, {sql_strip('lower(query)')} AS l FROM {queries}),
 sc AS (SELECT *, {_EXACT} AS exact, {_SEMANTIC} AS semantic FROM low)"""


SQL_TYPED = f"""typed AS (SELECT *, CASE WHEN {_sql_any('l', L.RECENCY_WORDS)} THEN 'web'
   WHEN {_sql_rx('query', L.GENERAL_QUESTION_PATTERNS)} AND length(query) < 20 THEN 'direct'
   WHEN exact >= 0.6::DOUBLE THEN 'bm25' WHEN semantic > 0.7::DOUBLE THEN 'vector' ELSE 'hybrid' END AS query_type FROM sc)"""
SQL_CONFIDENCE = "CASE query_type WHEN 'direct' THEN 0.7::DOUBLE WHEN 'bm25' THEN exact WHEN 'vector' THEN semantic ELSE 0.8::DOUBLE END"
_SCORED = f"{SQL_QUERIES}, {sql_scored('queries')}"
_TYPED = f"{_SCORED}, {SQL_TYPED}"


@query(
    "route_queries",
    f"""WITH {_TYPED} SELECT query_id, query_type, {SQL_CONFIDENCE} AS confidence,
  CASE query_type {' '.join(f"WHEN '{k}' THEN {sql_str(v)}" for k, v in L.ROUTE_REASON.items())} END AS reason,
  CASE query_type {' '.join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in L.ROUTE_ALPHA.items())} END AS alpha FROM typed""",
)
def route_queries_q(spark: SparkSession, sf: str) -> DataFrame:
    r = U.route_queries(derived_queries(spark, sf))
    return r.select("query_id", "query_type", F.round("confidence", 6).alias("confidence"), "reason", "alpha")


@query("exact_match_score", f"WITH {_SCORED} SELECT query_id, exact AS score FROM sc")
def exact_match_score_q(spark: SparkSession, sf: str) -> DataFrame:
    low = T.strip(F.lower("query"))
    return derived_queries(spark, sf).select("query_id", F.round(U.exact_match_score(low), 6).alias("score"))


@query("semantic_score", f"WITH {_SCORED} SELECT query_id, semantic AS score FROM sc")
def semantic_score_q(spark: SparkSession, sf: str) -> DataFrame:
    low = T.strip(F.lower("query"))
    return derived_queries(spark, sf).select("query_id", F.round(U.semantic_score(low), 6).alias("score"))


_FOLLOW = f"({_sql_rx('query', L.FOLLOW_UP_PATTERNS)} OR (length(query) < 10 AND {_sql_any('query', L.FOLLOW_UP_WORDS)}))"
_TOPIC = f"""coalesce(nullif(regexp_extract(previous_query, '^(.{{2,10}})的', 1), ''),
   list_filter({sql_list(list(L.TERM_SYNONYMS))}, lambda t: contains(previous_query, t))[1])"""
_DONE = " ".join(f"WHEN contains(query, {sql_str(k)}) THEN topic || {sql_str(v)}" for k, v in L.FOLLOW_UP_COMPLETIONS.items())
_COMPLETED = f"""{SQL_QUERIES}, tp AS (SELECT *, {_FOLLOW} AS follows, {_TOPIC} AS topic FROM queries),
 comp AS (SELECT *, CASE WHEN topic IS NULL THEN query {_DONE} WHEN contains(query, '那呢') THEN previous_query
   WHEN contains(query, '呢') THEN topic || replace(query, '呢', '') ELSE topic || ' ' || query END AS completed FROM tp)"""


@query("is_follow_up", f"WITH {SQL_QUERIES} SELECT query_id, {_FOLLOW} AS follow_up FROM queries")
def is_follow_up_q(spark: SparkSession, sf: str) -> DataFrame:
    return derived_queries(spark, sf).select("query_id", U.is_follow_up(F.col("query")).alias("follow_up"))


@query("complete_follow_up", f"WITH {_COMPLETED} SELECT query_id, topic, md5(completed) AS completed_md5 FROM comp WHERE previous_query IS NOT NULL")
def complete_follow_up_q(spark: SparkSession, sf: str) -> DataFrame:
    q = derived_queries(spark, sf).filter("previous_query is not null")
    prev = F.col("previous_query")
    return q.select("query_id", U.topic_of(prev).alias("topic"), md5(U.complete_follow_up(F.col("query"), prev)).alias("completed_md5"))


def _sql_standard_ctes(source: str, given: str) -> str:
    """CTEs st0..stN, one replacement each, so that the statement stays linear."""
    ctes = [f"st0 AS (SELECT *, {given} AS given, {given} AS std, []::VARCHAR[] AS applied FROM {source})"]
    for n, (syn, std) in enumerate(U.synonym_pairs(L.TERM_SYNONYMS).items(), 1):
        cond = f"(contains(lower(given), {sql_str(syn)}) AND NOT contains(given, {sql_str(std)}))"
        ctes.append(
            f"st{n} AS (SELECT * EXCLUDE (std, applied), CASE WHEN {cond} THEN regexp_replace(std, {sql_str('(?i)' + re.escape(syn))}, {sql_str(std)}, 'g') ELSE std END AS std,"
            f" CASE WHEN {cond} THEN list_append(applied, {sql_str(syn + ' → ' + std)}) ELSE applied END AS applied FROM st{n - 1})"
        )
    last = len(ctes) - 1
    return ", ".join(ctes) + f", stded AS (SELECT * FROM st{last})"


@query(
    "standardize_terms",
    f"WITH {SQL_QUERIES}, {_sql_standard_ctes('queries', 'query')} SELECT query_id, md5(std) AS text_md5, array_to_string(applied, '|') AS applied FROM stded",
)
def standardize_terms_q(spark: SparkSession, sf: str) -> DataFrame:
    s = derived_queries(spark, sf).select("query_id", U.standardize_terms(F.col("query")).alias("s"))
    return s.select("query_id", md5("s.text").alias("text_md5"), F.array_join("s.applied", "|").alias("applied"))


_SYN_ROWS = ", ".join(
    f"({sql_str(t)}, {o}, {sql_str(s)})" for t, syns in L.TERM_SYNONYMS.items() for o, s in enumerate(syns, 1)
)


def _sql_expanded(x: str) -> str:
    parts = [
        f"CASE WHEN contains({x}, {sql_str(t)}) THEN list_filter({sql_list(s[:2])}, lambda w: NOT contains(lower({x}), lower(w))) ELSE []::VARCHAR[] END"
        for t, s in L.TERM_SYNONYMS.items()
    ]
    return f"list_sort(list_distinct(flatten([{', '.join(parts)}])))"


@query(
    "expand_synonyms",
    f"""WITH {SQL_QUERIES}, terms(term, syn_ord, synonym) AS (VALUES {_SYN_ROWS})
SELECT DISTINCT query_id, synonym FROM queries JOIN terms ON contains(query, term)
WHERE syn_ord <= 2 AND NOT contains(lower(query), lower(synonym))""",
)
def expand_synonyms_q(spark: SparkSession, sf: str) -> DataFrame:
    q = derived_queries(spark, sf)
    return q.select("query_id", F.explode(U.expand_synonyms(F.col("query"))).alias("synonym"))


@query(
    "expand_synonyms_table",
    r"""WITH words AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[^ \n]+')) AS term FROM benchmark),
 terms AS (SELECT term, 1 AS syn_ord, term || '-syn' AS synonym FROM words)
SELECT DISTINCT doc_id AS query_id, synonym FROM documents JOIN terms ON contains(text, term) WHERE NOT contains(lower(text), lower(synonym))""",
)
def expand_synonyms_table_q(spark: SparkSession, sf: str) -> DataFrame:
    """A term table of any size: every word of the benchmark texts, looked up in all documents."""
    words = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"[^ \n]+"), F.lit(0))).alias("term")).distinct()
    terms = words.select("term", F.lit(1).alias("syn_ord"), F.concat("term", F.lit("-syn")).alias("synonym"))
    q = table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    return U.expand_synonyms_table(q, terms)


def _sql_ambiguity(x: str) -> str:
    out = []
    for term, options in L.AMBIGUOUS_TERMS.items():
        text = f"'{term}'可能指: {', '.join(list(options.values())[:3])}"
        out.append(f"WHEN contains({x}, {sql_str(term)}) AND NOT {_sql_any(x, list(options))} THEN {sql_str(text)}")
    return f"CASE {' '.join(out)} END"


@query("check_ambiguity", f"WITH {SQL_QUERIES} SELECT query_id, {_sql_ambiguity('query')} AS hint FROM queries")
def check_ambiguity_q(spark: SparkSession, sf: str) -> DataFrame:
    return derived_queries(spark, sf).select("query_id", U.check_ambiguity(F.col("query")).alias("hint"))


SQL_REWRITTEN = f"""{_COMPLETED},
 st AS (SELECT query_id, {sql_strip('query')} AS original, CASE WHEN follows AND previous_query IS NOT NULL AND previous_query <> '' THEN completed ELSE {sql_strip('query')} END AS c FROM comp),
 {_sql_standard_ctes('st', 'c')}"""


@query(
    "rewrite_queries",
    f"""WITH {SQL_REWRITTEN},
 ex AS (SELECT query_id, original, c, std, applied, {_sql_expanded('std')} AS words FROM stded)
SELECT query_id, md5(std) AS rewritten_md5, array_to_string(words, '|') AS expanded_terms, std <> original OR len(words) > 0 AS is_modified,
  coalesce(nullif(concat_ws('; ', CASE WHEN c <> original THEN '追问补全' END, CASE WHEN std <> c THEN '术语标准化: ' || array_to_string(applied, ', ') END,
    CASE WHEN len(words) > 0 THEN '同义词扩展: ' || array_to_string(words[1:3], ', ') END, '建议明确: ' || {_sql_ambiguity('std')}), ''), '无需改写') AS reason FROM ex""",
)
def rewrite_queries_q(spark: SparkSession, sf: str) -> DataFrame:
    r = U.rewrite_queries(derived_queries(spark, sf))
    return r.select(
        "query_id", md5("rewritten").alias("rewritten_md5"), F.array_join("expanded_terms", "|").alias("expanded_terms"),
        "is_modified", F.col("rewrite_reason").alias("reason"),
    )


# ---- assessment: queries without hits included ---------------------------
def sql_assess(hits: str, queries: str, tag: str = "") -> str:
    """CTEs ending in ``a{tag}``: n, relevance, sufficiency, best per query, and ``d{tag}`` with the decision."""
    return f"""w{tag} AS (SELECT h.*, list_distinct(list_filter(regexp_split_to_array(lower(q.query), '\\s+'), lambda x: x <> '')) AS ws FROM {hits} h JOIN {queries} q USING (query_id)),
 cv{tag} AS (SELECT *, len(list_filter(ws, lambda x: contains(lower(text), x))) / greatest(len(ws), 1)::DOUBLE AS cov FROM w{tag}),
 g{tag} AS (SELECT query_id, count(*) AS n, sum(score / rank) / sum(1.0::DOUBLE / rank) AS wavg, avg(CASE WHEN score > 0.5::DOUBLE THEN 1.0::DOUBLE ELSE 0 END) AS high,
   max(CASE WHEN rank <= 3 THEN cov END) AS cov, count(*) FILTER (score > 0.5::DOUBLE) AS nrel, sum(CASE WHEN rank <= 5 THEN length(text) END)::DOUBLE AS chars,
   count(DISTINCT CASE WHEN rank <= 5 AND source <> '' THEN source END) AS srcs, list_sort(list(rank - 1) FILTER (score >= 0.5::DOUBLE)) AS good FROM cv{tag} GROUP BY 1),
 a{tag} AS (SELECT q.query_id, coalesce(n, 0) AS n,
   CASE WHEN n > 0 THEN least(0.5::DOUBLE * wavg + 0.3::DOUBLE * high + 0.2::DOUBLE * cov, 1) ELSE 0 END AS relevance,
   CASE WHEN n > 0 THEN 0.4::DOUBLE * least(nrel / 2.0::DOUBLE, 1) + 0.4::DOUBLE * least(chars / 1000, 1) + 0.2::DOUBLE * least(srcs / 3.0::DOUBLE, 1) ELSE 0 END AS sufficiency,
   CASE WHEN n IS NULL THEN [] WHEN len(coalesce(good, [])) < 3 THEN list_sort(list_distinct(list_concat(coalesce(good, []), range(0, least(n, 3))))) ELSE good END AS best
   FROM {queries} q LEFT JOIN g{tag} USING (query_id)),
 d{tag} AS (SELECT *, CASE WHEN n = 0 THEN 'insufficient' WHEN relevance >= 0.7::DOUBLE AND sufficiency >= 0.5::DOUBLE THEN 'sufficient'
   WHEN relevance >= 0.4::DOUBLE THEN 'partial' ELSE 'insufficient' END AS decision FROM a{tag})"""


_ASSESS = f"""{SQL_ASKED}, {SQL_BM25}, {SQL_HITS}, {sql_assess('hits', 'q')}"""


def _assessed(spark: SparkSession, sf: str) -> DataFrame:
    return assess(asked_queries(spark, sf), bench_hits(spark, sf))


@query("evaluate_relevance", f"WITH {_ASSESS} SELECT query_id, round(relevance, 6) AS relevance FROM a")
def evaluate_relevance_q(spark: SparkSession, sf: str) -> DataFrame:
    return _assessed(spark, sf).select("query_id", F.round("relevance", 6).alias("relevance"))


@query("evaluate_sufficiency", f"WITH {_ASSESS} SELECT query_id, round(sufficiency, 6) AS sufficiency FROM a")
def evaluate_sufficiency_q(spark: SparkSession, sf: str) -> DataFrame:
    return _assessed(spark, sf).select("query_id", F.round("sufficiency", 6).alias("sufficiency"))


@query("best_docs", f"WITH {_ASSESS} SELECT query_id, array_to_string(best[1:5], '|') AS best_docs FROM a")
def best_docs_q(spark: SparkSession, sf: str) -> DataFrame:
    return _assessed(spark, sf).select("query_id", F.array_join(F.transform("best_docs", lambda i: i.cast("string")), "|").alias("best_docs"))


@query(
    "decide",
    f"""WITH {_ASSESS} SELECT query_id, n AS n_hits, decision, array_to_string(CASE WHEN n = 0 THEN {sql_list(L.SUGGEST_EMPTY)} WHEN decision = 'sufficient' THEN []
  WHEN decision = 'insufficient' THEN {sql_list(L.SUGGEST_INSUFFICIENT)} WHEN sufficiency < 0.5::DOUBLE THEN {sql_list([*L.SUGGEST_PARTIAL, L.SUGGEST_MORE])}
  ELSE {sql_list(L.SUGGEST_PARTIAL)} END, '|') AS suggestions FROM d""",
)
def decide_q(spark: SparkSession, sf: str) -> DataFrame:
    return _assessed(spark, sf).select("query_id", "n_hits", "decision", F.array_join("suggestions", "|").alias("suggestions"))


# ---- conversations ------------------------------------------------------
@query(
    "last_n_messages",
    f"""WITH {SQL_MESSAGES} SELECT session_id, turn, role, md5(content) AS content_md5 FROM
 (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS r FROM messages) WHERE r <= 3""",
)
def last_n_messages_q(spark: SparkSession, sf: str) -> DataFrame:
    return C.last_n_messages(derived_messages(spark, sf), 3).select("session_id", "turn", "role", md5("content").alias("content_md5"))


@query(
    "history_text",
    f"""WITH {SQL_MESSAGES} SELECT session_id, md5(string_agg(CASE WHEN role = 'user' THEN '用户' ELSE '助手' END || ': ' || content, chr(10) ORDER BY turn)) AS history_md5
FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS r FROM messages) WHERE r <= 20 GROUP BY session_id""",
)
def history_text_q(spark: SparkSession, sf: str) -> DataFrame:
    return C.history_text(derived_messages(spark, sf)).select("session_id", md5("history").alias("history_md5"))


@query(
    "last_user_query",
    f"""WITH {SQL_MESSAGES}, u AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS r FROM messages WHERE role = 'user')
SELECT session_id, md5(max(CASE WHEN r = 1 THEN content END)) AS last_md5, md5(max(CASE WHEN r = 2 THEN content END)) AS previous_md5 FROM u GROUP BY 1""",
)
def last_user_query_q(spark: SparkSession, sf: str) -> DataFrame:
    return C.last_user_queries(derived_messages(spark, sf)).select(
        "session_id", md5("last_query").alias("last_md5"), md5("previous_query").alias("previous_md5")
    )


@query("previous_user_query", f"WITH {SQL_QUERIES} SELECT query_id, md5(query) AS query_md5, md5(previous_query) AS previous_md5 FROM queries")
def previous_user_query_q(spark: SparkSession, sf: str) -> DataFrame:
    p = C.previous_user_query(derived_messages(spark, sf))
    return p.select(
        (F.col("session_id") * 1000 + F.col("turn")).alias("query_id"), md5("content").alias("query_md5"), md5("previous_query").alias("previous_md5")
    )


@query(
    "summarize_sessions",
    f"""WITH {SQL_MESSAGES}, n AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS n, row_number() OVER (PARTITION BY session_id ORDER BY turn) AS p FROM messages),
 f AS (SELECT *, CASE WHEN n > 3 THEN (n - 4) // 2 + 1 ELSE 0 END AS k FROM n), l AS (SELECT *, CASE WHEN k > 0 THEN 4 + (k - 1) * 2 END AS last FROM f),
 a AS (SELECT session_id, any_value(n) AS n, any_value(k) AS k, any_value(last) AS last, count(*) FILTER (p <= last AND p > last - 4) AS seen,
   {', '.join(f"bool_or(p <= last AND p > last - 4 AND role = 'user' AND contains(content, '{t}')) AS t{i}" for i, t in enumerate(L.SUMMARY_TOPICS))},
   min(turn) FILTER (last IS NULL OR p > last - 2) AS kept_from_turn FROM l GROUP BY 1),
 t AS (SELECT *, concat_ws(', ', {', '.join(f"CASE WHEN t{i} THEN '{t}' END" for i, t in enumerate(L.SUMMARY_TOPICS))}) AS topics FROM a)
SELECT session_id, n AS n_messages, k AS n_summaries, CASE WHEN k > 0 THEN CASE WHEN topics <> '' THEN '讨论主题: ' || topics ELSE '对话包含 ' || seen || ' 条消息' END END AS summary,
  kept_from_turn, CASE WHEN last IS NULL THEN n ELSE n - last + 2 END AS kept FROM t""",
)
def summarize_sessions_q(spark: SparkSession, sf: str) -> DataFrame:
    """Short sessions: summaries start after three messages and keep two."""
    return C.summarize_sessions(derived_messages(spark, sf), threshold=3, max_history=4)


# ---- extraction ---------------------------------------------------------
@query(
    "extract_entities",
    f"WITH {SQL_CLINICAL}, {sql_entities('clinical')} SELECT doc_id, entity_type, normalized, text, start_pos, start_pos + length(text) AS end_pos, 0.9::DOUBLE AS confidence FROM ents",
)
def extract_entities_q(spark: SparkSession, sf: str) -> DataFrame:
    e = X.extract_entities(clinical_documents(spark, sf))
    return e.withColumns({c: F.col(c).cast("bigint") for c in ("start_pos", "end_pos")})


@query(
    "entity_summary",
    f"""WITH {SQL_CLINICAL}, {sql_entities('clinical')} SELECT c.doc_id, {', '.join(f"count(*) FILTER (entity_type = '{k}') AS n_{k}" for k in L.ENTITY_PATTERNS)},
  count(entity_type) AS total FROM clinical c LEFT JOIN ents e USING (doc_id) GROUP BY 1""",
)
def entity_summary_q(spark: SparkSession, sf: str) -> DataFrame:
    return X.entity_summary(clinical_documents(spark, sf))


@query(
    "extract_dosages",
    rf"""WITH {SQL_CLINICAL}, p AS (SELECT doc_id, regexp_extract_all(text, '(?i){L.DOSAGE_PATTERN}', 1) AS a, regexp_extract_all(text, '(?i){L.DOSAGE_PATTERN}', 2) AS u FROM clinical)
SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a)::DOUBLE AS amount, unnest(u) AS unit FROM p""",
)
def extract_dosages_q(spark: SparkSession, sf: str) -> DataFrame:
    return X.extract_dosages(clinical_documents(spark, sf)).withColumn("pos", F.col("pos").cast("bigint"))


@query("entities_json", f"""WITH {SQL_CLINICAL}, {sql_entities('clinical')}
SELECT c.doc_id, count(entity_type) AS n, md5(coalesce(string_agg(entity_type || ':' || e.text || ':' || normalized, '|' ORDER BY entity_type || ':' || e.text || ':' || normalized), '')) AS entities_md5
FROM clinical c LEFT JOIN ents e USING (doc_id) GROUP BY 1""")
def entities_json_q(spark: SparkSession, sf: str) -> DataFrame:
    """The JSON is read back, so that the result does not depend on its spelling."""
    kinds = list(L.ENTITY_PATTERNS)
    schema = "struct<" + ",".join(f"{k}:array<struct<text:string,normalized:string>>" for k in kinds) + ">"
    j = X.entities_json(clinical_documents(spark, sf)).select("doc_id", F.from_json("entities", schema).alias("j"))
    spelled = lambda k: F.transform(F.col(f"j.{k}"), lambda e: F.concat(F.lit(f"{k}:"), e["text"], F.lit(":"), e["normalized"]))
    every = F.array_sort(F.flatten(F.array(*[spelled(k) for k in kinds])))
    return j.select("doc_id", F.size(every).cast("bigint").alias("n"), md5(F.array_join(every, "|")).alias("entities_md5"))


def sql_keywords(x: str) -> str:
    runs = f"list_concat({', '.join(f'regexp_extract_all({x}, {sql_str(p)})' for p in L.KEYWORD_RUNS)})"
    return (
        f"list_distinct(list_concat({runs}, regexp_extract_all({x}, {sql_str(L.KEYWORD_UNIT)}, 1), "
        f"list_filter({sql_list(L.KEYWORD_TERMS)}, lambda t: contains({x}, t))))"
    )


@query("medical_keywords", f"WITH {SQL_CLINICAL} SELECT doc_id, array_to_string(list_sort({sql_keywords('text')}), '|') AS keywords FROM clinical")
def medical_keywords_q(spark: SparkSession, sf: str) -> DataFrame:
    k = F.array_sort(X.medical_keywords(F.col("text")))
    return clinical_documents(spark, sf).select("doc_id", F.array_join(k, "|").alias("keywords"))
