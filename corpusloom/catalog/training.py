"""Contrastive pairs, negatives, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.catalog.base import SQL_MARKED, marked_documents, query, sql_clean, sql_strip, table
from corpusloom.catalog.evaluation import SQL_ITEMS, training_items
from corpusloom.operators import contrastive as N

md5 = F.md5


def title_body_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as pairs: the first 40 characters against the rest."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("pair_id"), "source", F.left("text", F.lit(40)).alias("query"), F.expr("substring(text, 41)").alias("positive")
    )


SQL_PAIRS = """raw AS (SELECT doc_id AS pair_id, source, substr(text, 1, 40) AS query, substr(text, 41) AS positive FROM documents),
 pairs AS (SELECT * FROM raw WHERE length(query) >= 10 AND length(positive) >= 50)"""


def _valid(spark: SparkSession, sf: str) -> DataFrame:
    return N.valid_pairs(title_body_pairs(spark, sf))


@query(
    "pairs_from_pubmedqa",
    r"""WITH p AS (SELECT doc_id, text AS q, string_agg(x, ' ' ORDER BY i) AS c FROM (
   SELECT doc_id, text, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents) GROUP BY doc_id, text)
SELECT doc_id AS pair_id, md5(q) AS query_md5, md5(substr(c, 1, 2000)) AS positive_md5 FROM p WHERE length(q) >= 10 AND length(c) >= 50""",
)
def pairs_from_pubmedqa_q(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "documents").select(
        F.col("doc_id").alias("pair_id"), F.col("text").alias("question"), F.split("text", "\n").alias("contexts")
    )
    return N.pairs_from_pubmedqa(items).select("pair_id", md5("query").alias("query_md5"), md5("positive").alias("positive_md5"))


@query(
    "pairs_from_medqa",
    """WITH m AS (SELECT doc_id, text AS q, 'a ' || lang AS oa, 'b ' || source AS ob FROM documents),
 p AS (SELECT doc_id, q || ' A: ' || oa || ' B: ' || ob AS query, CASE doc_id % 3 WHEN 0 THEN q || ' 答案是: ' || oa WHEN 1 THEN q || ' 答案是: ' || ob ELSE q END AS positive FROM m)
SELECT doc_id AS pair_id, md5(substr(query, 1, 500)) AS query_md5, md5(positive) AS positive_md5 FROM p WHERE length(query) >= 10 AND length(positive) >= 50""",
)
def pairs_from_medqa_q(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id") % 3
    options = F.array(
        F.struct(F.lit("A").alias("key"), F.concat(F.lit("a "), "lang").alias("value")),
        F.struct(F.lit("B").alias("key"), F.concat(F.lit("b "), "source").alias("value")),
    )
    items = table(spark, sf, "documents").select(
        F.col("doc_id").alias("pair_id"), F.col("text").alias("question"), options.alias("options"),
        F.when(i == 0, "A").when(i == 1, "B").otherwise("Z").alias("answer_idx"),
    )
    return N.pairs_from_medqa(items).select("pair_id", md5("query").alias("query_md5"), md5("positive").alias("positive_md5"))


@query(
    "pairs_from_medmcqa",
    """WITH p AS (SELECT doc_id, text AS q, text AS e FROM documents)
SELECT doc_id AS pair_id, md5(q) AS query_md5, md5(substr(e, 1, 2000)) AS positive_md5 FROM p WHERE length(q) >= 10 AND length(e) >= 50""",
)
def pairs_from_medmcqa_q(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "documents").select(
        F.col("doc_id").alias("pair_id"), F.col("text").alias("question"), F.col("text").alias("explanation"),
    )
    return N.pairs_from_medmcqa(items).select("pair_id", md5("query").alias("query_md5"), md5("positive").alias("positive_md5"))


@query(
    "pairs_from_sections",
    rf"""WITH {SQL_MARKED}, s AS (SELECT doc_id, string_split(regexp_replace(text, '\n(#{{1,3}})\s+(.+)\n', chr(1) || '\2' || chr(3), 'g'), chr(1)) AS ps FROM marked),
 u AS (SELECT doc_id, list_filter(ps, lambda p: contains(p, chr(3))) AS ps FROM s),
 r AS (SELECT doc_id, unnest(range(len(ps))) AS i, unnest(ps) AS p FROM u),
 b AS (SELECT doc_id || '-' || i AS pair_id, split_part(p, chr(3), 1) AS query, {sql_strip("split_part(p, chr(3), 2)")} AS body, split_part(p, chr(3), 2) AS raw FROM r)
SELECT pair_id, query, md5(substr(body, 1, 2000)) AS positive_md5 FROM b WHERE NOT starts_with(raw, '#') AND length(query) >= 10 AND length(body) >= 50""",
)
def pairs_from_sections_q(spark: SparkSession, sf: str) -> DataFrame:
    return N.pairs_from_sections(marked_documents(spark, sf)).select("pair_id", "query", md5("positive").alias("positive_md5"))


@query("valid_pairs", f"WITH {SQL_PAIRS} SELECT pair_id, source, query, md5(positive) AS positive_md5 FROM pairs")
def valid_pairs_q(spark: SparkSession, sf: str) -> DataFrame:
    return _valid(spark, sf).select("pair_id", "source", "query", md5("positive").alias("positive_md5"))


@query(
    "cap_per_source",
    f"WITH {SQL_PAIRS} SELECT pair_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pair_id) AS r FROM pairs) WHERE r <= 20",
)
def cap_per_source_q(spark: SparkSession, sf: str) -> DataFrame:
    return N.cap_per_source(_valid(spark, sf), 20).select("pair_id", "source")


_NEG = f"""{SQL_PAIRS}, t AS (SELECT DISTINCT positive FROM pairs), h AS (SELECT positive, md5(positive) AS h FROM t),
 o AS (SELECT positive, row_number() OVER (ORDER BY md5(h || '|42'), h) - 1 AS pos, count(*) OVER () AS m FROM h),
 w AS (SELECT a.positive, string_agg(b.positive, '|' ORDER BY s) AS negs, count(*) AS n FROM o a CROSS JOIN range(1, 4) g(s) JOIN o b ON b.pos = (a.pos + s) % a.m WHERE s < a.m GROUP BY 1)"""


@query("add_random_negatives", f"WITH {_NEG} SELECT pair_id, md5(positive) AS positive_md5, n AS n_negatives, md5(negs) AS negatives_md5 FROM pairs JOIN w USING (positive)")
def add_random_negatives_q(spark: SparkSession, sf: str) -> DataFrame:
    n = N.add_random_negatives(_valid(spark, sf))
    return n.select(
        "pair_id", md5("positive").alias("positive_md5"), F.size("negatives").cast("bigint").alias("n_negatives"),
        md5(F.array_join("negatives", "|")).alias("negatives_md5"),
    )


@query(
    "shuffle_split",
    f"""WITH {SQL_PAIRS}, o AS (SELECT pair_id, row_number() OVER (ORDER BY md5(pair_id || '|42'), pair_id) - 1 AS p, count(*) OVER () AS n FROM pairs)
SELECT pair_id, CASE WHEN p < floor(n * 0.9::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM o""",
)
def shuffle_split_q(spark: SparkSession, sf: str) -> DataFrame:
    return N.shuffle_split(_valid(spark, sf), 0.9).select("pair_id", "split")


@query(
    "ordered_split",
    f"""WITH {SQL_PAIRS}, o AS (SELECT pair_id, row_number() OVER (ORDER BY pair_id) - 1 AS p, count(*) OVER () AS n FROM pairs)
SELECT pair_id, CASE WHEN p < floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM o""",
)
def ordered_split_q(spark: SparkSession, sf: str) -> DataFrame:
    return N.ordered_split(_valid(spark, sf), 0.8).select("pair_id", "split")


_ALL = f"""{SQL_PAIRS}, mc AS (SELECT doc_id, text AS q, text AS e FROM documents),
 u AS (SELECT 'local' AS source, 'local:' || pair_id AS pair_id, query, positive FROM pairs
   UNION ALL SELECT 'medmcqa', 'medmcqa:' || doc_id, q, substr(e, 1, 2000) FROM mc WHERE length(q) >= 10 AND length(e) >= 50)"""


@query(
    "build_all",
    f"""WITH {_ALL}, h AS (SELECT positive, md5(positive) AS h FROM (SELECT DISTINCT positive FROM u)),
 o AS (SELECT positive, row_number() OVER (ORDER BY md5(h || '|42'), h) - 1 AS pos, count(*) OVER () AS m FROM h),
 w AS (SELECT a.positive, string_agg(b.positive, '|' ORDER BY s) AS negs FROM o a CROSS JOIN range(1, 4) g(s) JOIN o b ON b.pos = (a.pos + s) % a.m GROUP BY 1)
SELECT source, pair_id, md5(query) AS query_md5, md5(positive) AS positive_md5, md5(negs) AS negatives_md5, md5(pair_id || '|42') AS shuffle_key FROM u JOIN w USING (positive)""",
)
def build_all_q(spark: SparkSession, sf: str) -> DataFrame:
    explained = table(spark, sf, "documents").select(
        F.col("doc_id").alias("pair_id"), F.col("text").alias("question"), F.col("text").alias("explanation"),
    )
    sources = {"local": _valid(spark, sf), "medmcqa": N.pairs_from_medmcqa(explained)}
    b = N.build_all(sources)
    return b.select(
        "source", "pair_id", md5("query").alias("query_md5"), md5("positive").alias("positive_md5"),
        md5(F.array_join("negatives", "|")).alias("negatives_md5"), "shuffle_key",
    )


@query("mnrl_pairs", f"WITH {SQL_ITEMS} SELECT query AS anchor, unnest(pos) AS positive FROM items")
def mnrl_pairs_q(spark: SparkSession, sf: str) -> DataFrame:
    return N.mnrl_pairs(training_items(spark, sf))


@query(
    "triplets",
    f"WITH {SQL_ITEMS}, p AS (SELECT query AS anchor, unnest(pos) AS positive, neg FROM items) SELECT anchor, positive, unnest(neg) AS negative FROM p",
)
def triplets_q(spark: SparkSession, sf: str) -> DataFrame:
    return N.triplets(training_items(spark, sf))
