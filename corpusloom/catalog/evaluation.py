"""Ranking metrics, answer metrics, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.catalog.answering import SQL_ASKED, asked_queries, sql_keywords
from corpusloom.catalog.base import SQL_ANSWERS, answers_table, query, sql_str, sql_tokens, table
from corpusloom.catalog.ingest import sql_hashed
from corpusloom.catalog.retrieval import K, SQL_BENCH, SQL_BM25, SQL_VECTORS, benchmark_queries, corpus_chunks, document_index, vector_tables
from corpusloom.functions import lexicon as L
from corpusloom.operators import answer_metrics as A
from corpusloom.operators import ranking_metrics as M
from corpusloom.operators.dense import dense_search
from corpusloom.operators.embedding import embed
from corpusloom.operators.sparse import bm25_search
from corpusloom.session import materialize

KS = [1, 5, 10]


# ---- ranking: vectors of the same label are relevant to each other -------
def judged_run(spark: SparkSession, sf: str, hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    v = table(spark, sf, "embeddings")
    return M.judge_by_labels(
        hits, v.select(F.col("vec_id").alias("query_id"), "label"), v.select(F.col("vec_id").alias("item"), "label")
    )


def vector_run(spark: SparkSession, sf: str) -> DataFrame:
    queries, corpus = vector_tables(spark, sf)
    return dense_search(queries, corpus, K).select("query_id", F.col("chunk_id").alias("item"), "rank")


def labelled_run(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The judged vector run."""
    return judged_run(spark, sf, vector_run(spark, sf))


def sql_metrics(knn: str, ks: list[int]) -> str:
    per = []
    for k in ks:
        per.append(
            f"""SELECT {k} AS k, l.vec_id AS query_id, coalesce(1.0::DOUBLE / min(CASE WHEN rel AND rank <= {k} THEN rank END), 0) AS mrr,
   count(DISTINCT CASE WHEN rel AND rank <= {k} THEN chunk_id END) / any_value(n_rel)::DOUBLE AS recall,
   coalesce(sum(CASE WHEN rel AND rank <= {k} THEN 1.0::DOUBLE / log2(rank + 1) END), 0)
     / any_value(list_sum(list_transform(range(1, least(n_rel, {k}) + 1), lambda i: 1.0::DOUBLE / log2(i + 1)))) AS ndcg
  FROM (SELECT vec_id, label, count(*) OVER (PARTITION BY label) AS n_rel FROM embeddings) l
  LEFT JOIN (SELECT *, q_label = c_label AS rel FROM {knn}) h ON h.query_id = l.vec_id GROUP BY l.vec_id"""
        )
    return "per AS (" + "\n UNION ALL ".join(per) + ")"


_PER = f"WITH {SQL_VECTORS}, {sql_metrics('knn', KS)}"


def _one(metric: str, k: int = 10) -> str:
    return f"{_PER} SELECT round(avg({metric}), 6) AS {metric}, count(*) AS n_queries FROM per WHERE k = {k}"


@query("mrr_at_k", _one("mrr"))
def mrr_q(spark: SparkSession, sf: str) -> DataFrame:
    return M.mrr_at_k(labelled_run(spark, sf))


@query("recall_at_k", _one("recall"))
def recall_q(spark: SparkSession, sf: str) -> DataFrame:
    return M.recall_at_k(labelled_run(spark, sf))


@query("ndcg_at_k", _one("ndcg"))
def ndcg_q(spark: SparkSession, sf: str) -> DataFrame:
    return M.ndcg_at_k(labelled_run(spark, sf))


_LONG = " UNION ALL ".join(f"SELECT '{m}' AS metric, k, round(avg({m}), 6) AS value FROM per GROUP BY k" for m in M.METRICS)


@query("evaluate_run", f"{_PER} {_LONG}")
def evaluate_run_q(spark: SparkSession, sf: str) -> DataFrame:
    return M.evaluate_run(labelled_run(spark, sf), KS)


@query(
    "compare_runs",
    f"""WITH {SQL_VECTORS}, {sql_metrics('knn', KS)},
 back AS (SELECT query_id, chunk_id, q_label, c_label, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC) AS rank FROM knn WHERE rank <= 10),
 {sql_metrics('back', KS).replace('per AS (', 'per2 AS (', 1)},
 a AS ({_LONG}), b AS ({_LONG.replace('FROM per ', 'FROM per2 ')})
SELECT metric, k, a.value AS first, b.value AS second, round(b.value - a.value, 6) AS difference FROM a JOIN b USING (metric, k)""",
)
def compare_runs_q(spark: SparkSession, sf: str) -> DataFrame:
    """The run against its own top ten in reverse order."""
    run = materialize(vector_run(spark, sf), "vector-run")  # searched once
    back = run.withColumn("rank", K + 1 - F.col("rank"))
    return M.compare_runs(*(M.evaluate_run(judged_run(spark, sf, hits), KS) for hits in (run, back)))


# each benchmark text with its first half as positive, the next text's half as negative
def training_items(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "benchmark")
    half = F.expr("left(text, cast(length(text) / 2 as int))")
    nxt = b.select((F.col("item_id") - 1).alias("item_id"), half.alias("other"))
    return b.join(nxt, "item_id", "left").select(
        F.col("item_id").alias("query_id"), F.expr("substring(text, cast(length(text) / 2 as int) + 1)").alias("query"),
        F.array(half, F.left("text", F.lit(40))).alias("pos"),
        F.when(F.col("other").isNotNull(), F.array("other")).otherwise(F.array().cast("array<string>")).alias("neg"),
    )


SQL_ITEMS = """halves AS (SELECT item_id, substr(text, 1, floor(length(text) / 2)::INT) AS h, substr(text, floor(length(text) / 2)::INT + 1) AS q, substr(text, 1, 40) AS f FROM benchmark),
 items AS (SELECT a.item_id AS query_id, a.q AS query, [a.h, a.f] AS pos, CASE WHEN b.h IS NULL THEN []::VARCHAR[] ELSE [b.h] END AS neg
   FROM halves a LEFT JOIN halves b ON b.item_id = a.item_id + 1)"""


@query(
    "evaluate_dense_corpus",
    f"""WITH {SQL_ITEMS},
 corp AS (SELECT query_id || '-p-' || i AS chunk_id, pos[i + 1] AS text, query_id AS own FROM items, unnest(range(2)) t(i)
   UNION ALL SELECT query_id || '-n-0', neg[1], NULL FROM items WHERE len(neg) > 0),
 dv AS ({sql_hashed('corp', 'chunk_id', 'text')}), qv AS ({sql_hashed('items', 'query_id', 'query')}),
 dn AS (SELECT chunk_id, sqrt(sum(weight::DOUBLE * weight::DOUBLE)) AS nd FROM dv GROUP BY 1),
 qn AS (SELECT query_id, sqrt(sum(weight::DOUBLE * weight::DOUBLE)) AS nq FROM qv GROUP BY 1),
 raw AS (SELECT query_id, chunk_id, sum(qv.weight::DOUBLE * dv.weight::DOUBLE) AS dot FROM qv JOIN dv USING (bucket) GROUP BY ALL),
 cos AS (SELECT i.query_id, c.chunk_id, c.own, round(coalesce(dot / (nq * nd), 0), 6) AS score FROM items i CROSS JOIN corp c
   LEFT JOIN raw r ON r.query_id = i.query_id AND r.chunk_id = c.chunk_id LEFT JOIN dn ON dn.chunk_id = c.chunk_id LEFT JOIN qn ON qn.query_id = i.query_id),
 knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM cos) WHERE rank <= 10),
 per AS ({' UNION ALL '.join(f'''SELECT {k} AS k, query_id, coalesce(1.0::DOUBLE / min(CASE WHEN own = query_id AND rank <= {k} THEN rank END), 0) AS mrr,
   count(CASE WHEN own = query_id AND rank <= {k} THEN 1 END) / 2.0::DOUBLE AS recall,
   coalesce(sum(CASE WHEN own = query_id AND rank <= {k} THEN 1.0::DOUBLE / log2(rank + 1) END), 0) / (CASE WHEN {k} = 1 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE + 1.0::DOUBLE / log2(3) END) AS ndcg
   FROM knn GROUP BY query_id''' for k in KS)})
{_LONG}""",
)
def evaluate_dense_corpus_q(spark: SparkSession, sf: str) -> DataFrame:
    queries, corpus, qrels = M.corpus_from_items(training_items(spark, sf))
    hits = dense_search(
        embed(queries, "query").select("query_id", "embedding"), embed(corpus).select("chunk_id", "embedding"), K
    )
    run = hits.select("query_id", F.col("chunk_id").alias("item"), "rank")
    return M.evaluate_run(M.judge_by_qrels(run, queries, qrels), KS)


# ---- multiple choice: items derived from the benchmark -------------------
def choice_items(spark: SparkSession, sf: str) -> DataFrame:
    """Three items per document: answered by its whole text, by the letter in brackets, and not at all."""
    d = table(spark, sf, "documents")
    i = F.col("doc_id")
    word = F.regexp_extract("text", "[A-Za-z]+", 0)
    options = F.array(*[F.struct(F.lit(k).alias("key"), F.concat(F.lit(v), F.lit(" "), word).alias("value")) for k, v in zip("ABCD", ["alpha", "beta", "gamma", "delta"])])
    letter = F.get(F.array(*[F.lit(x) for x in "ABCD"]), (i % 4).cast("int"))
    said = F.array(F.col("text"), F.concat(F.lit("("), letter, F.lit(")")), F.lit(None).cast("string"))
    return d.select(
        i, F.when(i % 7 != 0, F.get(F.array(*[F.lit(n) for n in L.MIRAGE_DATASETS]), (i % 5).cast("int"))).alias("dataset"),
        options.alias("options"), letter.alias("answer"), F.posexplode(said).alias("form", "response"),
    ).select((i * 3 + F.col("form")).alias("query_id"), "dataset", "options", "answer", "response")


_SETS = "[" + ", ".join(f"'{n}'" for n in L.MIRAGE_DATASETS) + "]"
_CHOICE = f"""ch AS (SELECT CASE WHEN doc_id % 7 <> 0 THEN {_SETS}[doc_id % 5 + 1] ELSE 'unknown' END AS dataset, ['A','B','C','D'][doc_id % 4 + 1] AS answer,
   coalesce(unnest([text, '(' || ['A','B','C','D'][doc_id % 4 + 1] || ')', NULL]), '') AS response FROM documents)"""


@query(
    "mirage_accuracy",
    f"""WITH {_CHOICE}, p AS (SELECT *, coalesce(list_filter(['A','B','C','D'], lambda o: contains(upper(response), o))[1], '') = answer AS ok FROM ch)
SELECT CASE WHEN grouping(dataset) = 1 THEN 'overall' ELSE dataset END AS dataset, count(*) FILTER (ok) AS correct, count(*) AS total,
  round(avg(ok::INT::DOUBLE), 6) AS accuracy FROM p GROUP BY ROLLUP (dataset)""",
)
def mirage_accuracy_q(spark: SparkSession, sf: str) -> DataFrame:
    return M.mirage_accuracy(choice_items(spark, sf))


@query(
    "context_hit_rate",
    f"""WITH {SQL_BENCH}, {SQL_BM25}, h AS (SELECT query_id, d.text FROM sparse JOIN documents d ON d.doc_id = chunk_id WHERE rank <= {K}),
 i AS (SELECT query_id, list_filter(regexp_split_to_array(trim(query), '\\s+')[1:3], lambda w: length(w) > 3) AS ws FROM q),
 s AS (SELECT query_id, bool_or(len(list_filter(ws, lambda w: contains(lower(text), lower(w)))) > 0) AS hit, count(*) AS n FROM h JOIN i USING (query_id) GROUP BY 1)
SELECT count(*) AS total, count(*) FILTER (hit) AS hits, round(avg(CASE WHEN hit THEN 1.0::DOUBLE ELSE 0 END), 6) AS context_hit_rate,
  round(avg(coalesce(n, 0)::DOUBLE), 6) AS avg_retrieved FROM i LEFT JOIN s USING (query_id)""",
)
def context_hit_rate_q(spark: SparkSession, sf: str) -> DataFrame:
    q = benchmark_queries(spark, sf)
    hits = bm25_search(document_index(spark, sf), q, K, "query").join(corpus_chunks(spark, sf), "chunk_id")
    return M.context_hit_rate(q.select("query_id", F.col("query").alias("option_text")), hits)


@query("sample_questions", "SELECT doc_id AS query_id FROM documents ORDER BY md5(doc_id || '|42'), doc_id LIMIT 100")
def sample_questions_q(spark: SparkSession, sf: str) -> DataFrame:
    """A sampling operator: the limit is the feature."""
    return M.sample_questions(table(spark, sf, "documents").select(F.col("doc_id").alias("query_id")), 100)


@query(
    "metric_summary",
    """WITH c AS (SELECT 'quality' AS metric, quality::DOUBLE AS score, CASE WHEN doc_id % 11 = 0 THEN 'timeout' END AS error FROM labels
  UNION ALL SELECT 'safety', 1.0::DOUBLE - toxic, NULL FROM labels), s AS (SELECT *, CASE WHEN error IS NOT NULL THEN 0 ELSE coalesce(score, 0) END AS v FROM c)
SELECT metric, round(avg(v), 6) AS mean_score, round(avg(CASE WHEN v >= 0.5::DOUBLE THEN 1.0::DOUBLE ELSE 0 END), 6) AS pass_rate, count(*) AS cases, count(error) AS failures FROM s GROUP BY metric""",
)
def metric_summary_q(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "labels")
    failed = F.when(F.col("doc_id") % 11 == 0, "timeout")
    cases = x.select(
        F.inline(
            F.array(
                F.struct(F.lit("quality").alias("metric"), F.col("quality").cast("double").alias("score"), failed.alias("error")),
                F.struct(F.lit("safety").alias("metric"), (1.0 - F.col("toxic")).alias("score"), F.lit(None).cast("string").alias("error")),
            )
        )
    )
    return M.metric_summary(cases)


@query(
    "build_eval_cases",
    f"""WITH {SQL_ASKED}, {SQL_BM25}, c AS (SELECT query_id, string_agg(d.text, '|' ORDER BY rank) AS ctx, count(*) AS n FROM sparse JOIN documents d ON d.doc_id = chunk_id
   WHERE rank <= {K} AND d.text <> '' GROUP BY 1)
SELECT query_id, md5(query) AS question_md5, '' AS expected, CASE WHEN query_id % 2 = 0 THEN 'answer ' || query_id ELSE '' END AS answer,
  md5(coalesce(ctx, '')) AS contexts_md5, coalesce(n, 0) AS n_contexts FROM q LEFT JOIN c USING (query_id)""",
)
def build_eval_cases_q(spark: SparkSession, sf: str) -> DataFrame:
    q = asked_queries(spark, sf)
    hits = bm25_search(document_index(spark, sf), q, K, "query").join(corpus_chunks(spark, sf), "chunk_id")
    answers = q.filter("query_id % 2 = 0").select("query_id", F.concat(F.lit("answer "), F.col("query_id").cast("string")).alias("answer"))
    items = q.select("query_id", F.col("query").alias("question"), F.lit(None).cast("string").alias("expected"))
    c = M.build_eval_cases(items, hits, answers)
    return c.select(
        "query_id", F.md5("question").alias("question_md5"), "expected", "answer",
        F.md5(F.array_join("contexts", "|")).alias("contexts_md5"), F.size("contexts").cast("bigint").alias("n_contexts"),
    )


@query(
    "run_report",
    """SELECT user_id % 10 AS run, round(coalesce(avg(CASE WHEN event_type <> 'error' THEN value END), 0), 6) AS mean_score, count(*) AS samples,
  count(*) FILTER (event_type = 'error') AS errors, round(avg((event_type <> 'error')::INT::DOUBLE), 6) AS success_rate FROM events GROUP BY 1""",
)
def run_report_q(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(
        (F.col("user_id") % 10).alias("run"), F.col("value").alias("score"), F.when(F.col("event_type") == "error", "error").alias("error")
    )
    return M.run_report(e, ["run"])


# ---- answer metrics -----------------------------------------------------
_CHARS = "list_distinct(list_filter(string_split(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]', '', 'g'), ''), lambda c: c <> ''))"


def _sql_f1(a: str, b: str) -> str:
    inter = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN {inter} = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * {inter} / (len({a}) + len({b})) END"


_F1 = f"""f AS (SELECT *, {_CHARS.format('answer')} AS ca, {_CHARS.format('ground_truth')} AS cg FROM answers),
 sf AS (SELECT *, CASE WHEN answer = '' OR ground_truth IS NULL THEN 0 ELSE {_sql_f1('ca', 'cg')} END AS f1 FROM f)"""
_CITE = """ci AS (SELECT *, regexp_extract_all(answer, '\\[(\\d+)\\]', 1) AS cs FROM sf),
 cc AS (SELECT *, len(list_filter(cs, lambda x: x::HUGEINT BETWEEN 1 AND n_documents)) AS okc, len(cs) AS nc FROM ci),
 cd AS (SELECT *, CASE WHEN nc = 0 THEN 0.5::DOUBLE ELSE okc / nc::DOUBLE END AS cite FROM cc)"""
_OPPOSED = " + ".join(
    f"CASE WHEN (regexp_matches(answer, '{a}') AND regexp_matches(context, '{b}')) OR (regexp_matches(answer, '{b}') AND regexp_matches(context, '{a}')) THEN 1 ELSE 0 END"
    for a, b in L.OPPOSED_PAIRS
)
_FACT = f"""fa AS (SELECT *, {sql_keywords('answer')} AS ka, {sql_keywords("coalesce(context, '')")} AS kc FROM cd),
 fb AS (SELECT *, len(list_intersect(ka, kc)) AS matched, CASE WHEN context IS NULL THEN NULL ELSE {_OPPOSED} END AS opposed FROM fa),
 fc AS (SELECT *, CASE WHEN answer = '' OR context IS NULL THEN 0 WHEN len(ka) = 0 THEN 0.5::DOUBLE ELSE matched / len(ka)::DOUBLE * CASE WHEN opposed > 0 THEN 0.5::DOUBLE ELSE 1 END END AS fact FROM fb)"""


@query("semantic_f1", f"WITH {SQL_ANSWERS}, {_F1} SELECT query_id, round(f1, 6) AS score, f1 >= 0.7::DOUBLE AS passed FROM sf")
def semantic_f1_q(spark: SparkSession, sf: str) -> DataFrame:
    s = A.semantic_f1(F.col("answer"), F.col("ground_truth"))
    return answers_table(spark, sf).select("query_id", s.alias("s")).select("query_id", F.round("s.score", 6).alias("score"), "s.passed")


@query(
    "semantic_f1_words",
    f"""WITH {SQL_ANSWERS}, w AS (SELECT *, list_distinct({sql_tokens('answer')}) AS a, list_distinct({sql_tokens('ground_truth')}) AS b FROM answers)
SELECT query_id, round(CASE WHEN answer = '' OR ground_truth IS NULL THEN 0 ELSE {_sql_f1('a', 'b')} END, 6) AS score FROM w""",
)
def semantic_f1_words_q(spark: SparkSession, sf: str) -> DataFrame:
    s = A.semantic_f1(F.col("answer"), F.col("ground_truth"), unit="word")
    return answers_table(spark, sf).select("query_id", F.round(s["score"], 6).alias("score"))


@query(
    "semantic_similarity",
    """WITH n AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(list_inner_product(x, y) / (sqrt(list_inner_product(x, x)) * sqrt(list_inner_product(y, y))), 6) AS score FROM n""",
)
def semantic_similarity_q(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings")
    pairs = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    return pairs.select("vec_id", F.round(A.semantic_similarity(F.col("embedding"), F.col("other"))["score"], 6).alias("score"))


@query(
    "citation_accuracy",
    f"WITH {SQL_ANSWERS}, {_F1}, {_CITE} SELECT query_id, round(cite, 6) AS score, nc = 0 OR cite >= 0.5::DOUBLE AS passed, nc AS total, okc AS valid FROM cd",
)
def citation_accuracy_q(spark: SparkSession, sf: str) -> DataFrame:
    c = A.citation_accuracy(F.col("answer"), F.col("n_documents"))
    return answers_table(spark, sf).select("query_id", c.alias("c")).select(
        "query_id", F.round("c.score", 6).alias("score"), "c.passed", F.col("c.total").cast("bigint").alias("total"),
        F.col("c.valid").cast("bigint").alias("valid"),
    )


@query(
    "factual_consistency",
    f"""WITH {SQL_ANSWERS}, {_F1}, {_CITE}, {_FACT} SELECT query_id, round(fact, 6) AS score,
  fact >= 0.7::DOUBLE OR (answer <> '' AND context IS NOT NULL AND len(ka) = 0) AS passed, len(ka) AS keywords FROM fc""",
)
def factual_consistency_q(spark: SparkSession, sf: str) -> DataFrame:
    c = A.factual_consistency(F.col("answer"), F.col("context"))
    return answers_table(spark, sf).select("query_id", c.alias("c")).select(
        "query_id", F.round("c.score", 6).alias("score"), "c.passed", F.col("c.keywords").cast("bigint").alias("keywords")
    )


@query(
    "qa_overall",
    f"""WITH {SQL_ANSWERS}, {_F1}, {_CITE}, {_FACT},
 g AS (SELECT *, CASE WHEN ground_truth IS NOT NULL THEN 0.4::DOUBLE ELSE 0 END AS w1, CASE WHEN n_documents > 0 THEN 0.3::DOUBLE ELSE 0 END AS w2, CASE WHEN context IS NOT NULL THEN 0.3::DOUBLE ELSE 0 END AS w3 FROM fc),
 o AS (SELECT query_id, CASE WHEN w1 + w2 + w3 > 0 THEN (f1 * w1 + cite * w2 + fact * w3) / (w1 + w2 + w3) ELSE 0 END AS v FROM g)
SELECT query_id, round(v, 6) AS overall FROM o""",
)
def qa_overall_q(spark: SparkSession, sf: str) -> DataFrame:
    return A.evaluate_answers(answers_table(spark, sf)).select("query_id", F.round("overall", 6).alias("overall"))
