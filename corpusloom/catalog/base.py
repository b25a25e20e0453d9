"""Registered queries: each is a whole-table run of one operator.

A query reads the given tables (or data Spark derives from them) and returns
flat columns, long texts as md5. The SQL beside it is an independent statement
of the same result for another engine; it is left out where plain SQL cannot
express the operator at table scale.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import lexicon as L
from corpusloom.functions.ranking import previous_in_group
from corpusloom.sources.readers import read_documents

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    path = f"{sf}/{name}.parquet"
    return read_documents(spark, path) if name == "documents" else spark.read.parquet(path)


# ---- SQL fragments ------------------------------------------------------
def sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def sql_clean(x: str) -> str:
    return sql_strip(rf"regexp_replace(regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g'), ' {{2,}}', ' ', 'g')")


def sql_tokens(x: str) -> str:
    runs = r"""regexp_extract_all(lower(%s), '[一-鿿]+|[^\s\-_.,;:!?()\[\]{}"''/一-鿿]+')""" % x
    return (
        f"flatten(list_transform({runs}, lambda r: CASE WHEN regexp_matches(r, '^[一-鿿]') AND length(r) > 1 "
        "THEN list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) ELSE [r] END))"
    )


def sql_list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def sql_str(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_sentences(x: str) -> str:
    marked = rf"""regexp_replace({x}, '([。！？.!?]+["''）)」』]?)\s*', '\1' || chr(1), 'g')"""
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {sql_strip('s')}), lambda s: s <> '')"


# ---- derived tables -----------------------------------------------------
# Forms are made of the words in ``lexicon``: one per rule that the operators know, in frames without a meaning of
# their own. {w} is the first word of a message, {t} its whole text.
def _question_forms() -> list[str]:
    unit, abbreviation = L.UNITS.split("|")[0], L.ABBREVIATIONS[1].upper()
    synonyms = [s for words in L.TERM_SYNONYMS.values() for s in words[:1]]
    led = [L.RECENCY_WORDS[0], f"20{unit}", abbreviation, *L.SEMANTIC_WORDS[:2], *list(L.TERM_SYNONYMS)[::6], *synonyms[::5], *L.AMBIGUOUS_TERMS]
    typed = [f"{kind}{term}" for term, kinds in L.AMBIGUOUS_TERMS.items() for kind in list(kinds)[-1:]]
    alone = [*L.FOLLOW_UP_COMPLETIONS, L.REPEAT_QUESTION]
    return ["{t}", "什么是{w}？", "那{w}呢", *(f"{word} {{t}}" for word in [*led, *typed]), *alone]


def _clinical_forms() -> list[str]:
    listed = ["、".join(name for _, name in patterns[::4]) for patterns in L.ENTITY_PATTERNS.values()]
    doses = [f"{name} {n}0mg {n}次/日" for n, (_, name) in enumerate(L.ENTITY_PATTERNS["medication"][:4], 1)]
    return [*listed, *doses, ""]


def _answer_forms() -> tuple[list[str], list[str]]:
    """Answers cite documents and use one side of an opposed pair, contexts the other."""
    said = [f"{denied}{term}[{n}][{n + 2}]" for n, ((denied, _), term) in enumerate(zip(L.OPPOSED_PAIRS, L.KEYWORD_TERMS), 1)]
    held = [f"{agreed.rstrip('?')}{term}" for (_, agreed), term in zip(L.OPPOSED_PAIRS, L.KEYWORD_TERMS)]
    return [*said, *(f"{term}[7]" for term in L.KEYWORD_TERMS[3:5]), L.KEYWORD_TERMS[5], ""], held


QUESTION_FORMS = _question_forms()
CLINICAL_FORMS = _clinical_forms()
ANSWER_FORMS, CONTEXT_FORMS = _answer_forms()


def pick(forms: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(f) for f in forms]), F.pmod(index, F.lit(len(forms))).cast("int"))


def sql_pick(forms: list[str], index: str) -> str:
    return f"{sql_list(forms)}[({index}) % {len(forms)} + 1]"


def derived_messages(spark: SparkSession, sf: str) -> DataFrame:
    """session_id, turn, role, content: the conversations with formed questions for user turns."""
    c = table(spark, sf, "conversations")
    word = F.regexp_extract("text", "[A-Za-zÀ-ÿ]+", 0)
    form = pick(QUESTION_FORMS, F.col("conv_id") + F.col("turn") * 7)
    asked = F.replace(F.replace(form, F.lit("{w}"), word), F.lit("{t}"), F.col("text"))
    return c.select(
        F.col("conv_id").alias("session_id"), "turn", "role",
        F.when(F.col("role") == "user", asked).otherwise(F.col("text")).alias("content"),
    )


def derived_queries(spark: SparkSession, sf: str) -> DataFrame:
    """query_id, query, previous_query: every user message as a query."""
    users = derived_messages(spark, sf).filter("role = 'user'")
    return previous_in_group(users, "session_id", "turn", "content", "previous_query").select(
        (F.col("session_id") * 1000 + F.col("turn")).alias("query_id"), F.col("content").alias("query"), "previous_query"
    )


SQL_MESSAGES = f"""messages AS (
  SELECT conv_id AS session_id, turn, role,
    CASE WHEN role = 'user' THEN replace(replace({sql_pick(QUESTION_FORMS, 'conv_id + turn * 7')},
      '{{w}}', regexp_extract(text, '[A-Za-zÀ-ÿ]+')), '{{t}}', text) ELSE text END AS content
  FROM conversations)"""
SQL_QUERIES = f"""{SQL_MESSAGES}, queries AS (
  SELECT session_id * 1000 + turn AS query_id, content AS query,
    lag(content) OVER (PARTITION BY session_id ORDER BY turn) AS previous_query
  FROM messages WHERE role = 'user')"""


def clinical_documents(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, text: every document followed by a clinical sentence."""
    return table(spark, sf, "documents").select(
        "doc_id", F.concat("text", F.lit("\n"), pick(CLINICAL_FORMS, F.col("doc_id"))).alias("text")
    )


SQL_CLINICAL = f"""clinical AS (
  SELECT doc_id, text || chr(10) || {sql_pick(CLINICAL_FORMS, 'doc_id')} AS text FROM documents)"""


def marked_documents(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, source, text: lines become paragraphs, those opening with A-E headings."""
    c = F.regexp_replace("text", "\n([A-E])", "\n## $1")
    return table(spark, sf, "documents").select(
        "doc_id", "source", F.regexp_replace(c, "\n([^#])", "\n\n$1").alias("text")
    )


SQL_MARKED = r"""marked AS (
  SELECT doc_id, source, regexp_replace(regexp_replace(text, '\n([A-E])', chr(10) || '## \1', 'g'),
    '\n([^#])', chr(10) || chr(10) || '\1', 'g') AS text FROM documents)"""


def answers_table(spark: SparkSession, sf: str) -> DataFrame:
    """query_id, answer, ground_truth, context, n_documents derived from the benchmark pairs."""
    d = table(spark, sf, "documents")
    return d.select(
        F.col("doc_id").alias("query_id"),
        F.concat(pick(ANSWER_FORMS, F.col("doc_id")), "text").alias("answer"),
        F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit(L.KEYWORD_TERMS[0]), F.col("text"))).alias("ground_truth"),
        F.when(F.col("doc_id") % 5 != 0, F.concat(pick(CONTEXT_FORMS, F.col("doc_id")), F.col("text"))).alias("context"),
        (F.col("doc_id") % 4).cast("int").alias("n_documents"),
    )


SQL_ANSWERS = f"""answers AS (
  SELECT doc_id AS query_id,
    {sql_pick(ANSWER_FORMS, 'doc_id')} || text AS answer,
    CASE WHEN doc_id % 4 <> 0 THEN '{L.KEYWORD_TERMS[0]}' || text END AS ground_truth,
    CASE WHEN doc_id % 5 <> 0 THEN {sql_pick(CONTEXT_FORMS, 'doc_id')} || text END AS context,
    (doc_id % 4)::INT AS n_documents
  FROM documents)"""
