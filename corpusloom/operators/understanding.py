"""Route and rewrite a table of queries with small constant dictionaries.

Everything here is a projection: the dictionaries have a fixed, small size and
become literals of the expression, so there is neither a join nor a shuffle.
``expand_synonyms_table`` is the form for a term table that grows.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import lexicon as L
from corpusloom.functions import text as T
from corpusloom.session import materialize


def _any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def _any_pattern(c: Column, patterns: list[str]) -> Column:
    return c.rlike("(?d)" + "|".join(f"(?:{p})" for p in patterns))  # dots stop at newlines only


def exact_match_score(q: Column) -> Column:
    """Evidence that wording matters: abbreviations, exact topics, units (lower-case input)."""
    words = F.regexp_extract_all(q, F.lit("[A-Za-z0-9]+"), F.lit(0))
    known = F.size(F.array_intersect(words, F.array(*[F.lit(a) for a in L.ABBREVIATIONS])))
    score = (
        F.when(known > 0, F.lit(0.3) * F.least(known, F.lit(2))).otherwise(0.0)
        + F.when(_any_pattern(q, L.EXACT_TOPIC_PATTERNS), 0.3).otherwise(0.0)
        + F.when(q.rlike(f"(?<![A-Za-z0-9])({L.UNITS})(?![A-Za-z0-9])"), 0.3).otherwise(0.0)
        + F.when(q.rlike(rf"(?U:\d+\s*)(?:{L.UNITS})"), 0.2).otherwise(0.0)
    )
    return F.least(score, F.lit(1.0))


def semantic_score(q: Column) -> Column:
    """Evidence that meaning matters: question words, length, no figures (lower-case input)."""
    score = F.lit(0.5)
    for word in L.SEMANTIC_WORDS:
        score = score + F.when(F.contains(q, F.lit(word)), 0.15).otherwise(0.0)
    score = score + F.when(F.length(q) > 30, 0.1).otherwise(0.0)
    words = F.regexp_extract_all(q, F.lit(r"(?U)\b\w+\b"), F.lit(0))
    plain = ~q.rlike(r"(?U)\d") & ~F.arrays_overlap(words, F.array(*[F.lit(a) for a in L.ABBREVIATIONS]))
    return F.least(score + F.when(plain, 0.1).otherwise(0.0), F.lit(1.0))


def route(query: Column, default_alpha: float = 0.7) -> Column:
    """STRUCT<query_type, confidence, reason, alpha>; the first rule that holds wins."""
    q = T.strip(F.lower(query))
    exact = F.round(exact_match_score(q), 10)
    semantic = F.round(semantic_score(q), 10)
    general = _any_pattern(query, L.GENERAL_QUESTION_PATTERNS) & (F.length(query) < 20)

    def decision(kind: str, confidence: Column | float, alpha: float) -> Column:
        value = confidence if isinstance(confidence, Column) else F.lit(confidence)
        return F.struct(
            F.lit(kind).alias("query_type"),
            value.alias("confidence"),
            F.lit(L.ROUTE_REASON[kind]).alias("reason"),
            F.lit(alpha).alias("alpha"),
        )

    return (
        F.when(_any(q, L.RECENCY_WORDS), decision("web", 0.8, L.ROUTE_ALPHA["web"]))
        .when(general, decision("direct", 0.7, L.ROUTE_ALPHA["direct"]))
        .when(exact >= 0.6, decision("bm25", exact, L.ROUTE_ALPHA["bm25"]))
        .when(semantic > 0.7, decision("vector", semantic, L.ROUTE_ALPHA["vector"]))
        .otherwise(decision("hybrid", 0.8, default_alpha))
    )


def route_queries(queries: DataFrame, default_alpha: float = 0.7, query_col: str = "query") -> DataFrame:
    return queries.withColumn("_r", route(F.col(query_col), default_alpha)).select(
        *queries.columns, "_r.query_type", "_r.confidence", "_r.reason", F.col("_r.alpha").alias("alpha")
    )


def is_follow_up(q: Column) -> Column:
    return _any_pattern(q, L.FOLLOW_UP_PATTERNS) | ((F.length(q) < 10) & _any(q, L.FOLLOW_UP_WORDS))


def topic_of(q: Column, terms: dict[str, list[str]] | None = None) -> Column:
    """What a query is about: the words before the first "的" rule, else a known term."""
    names = F.array(*[F.lit(t) for t in (terms or L.TERM_SYNONYMS)])
    named = F.get(F.filter(names, lambda t: F.contains(q, t)), F.lit(0))
    lead = F.get(F.regexp_extract_all(q, F.lit("(?d)^(.{2,10})的"), F.lit(1)), F.lit(0))
    return F.coalesce(lead, named)


def complete_follow_up(q: Column, previous: Column, terms: dict[str, list[str]] | None = None) -> Column:
    """Add the previous query's topic to a follow-up; no topic leaves it as it is."""

    def complete(topic: Column) -> Column:
        out = F.when(topic.isNull(), q)
        for asked, suffix in L.FOLLOW_UP_COMPLETIONS.items():
            out = out.when(F.contains(q, F.lit(asked)), F.concat(topic, F.lit(suffix)))
        out = out.when(F.contains(q, F.lit(L.REPEAT_QUESTION)), previous)
        out = out.when(F.contains(q, F.lit("呢")), F.concat(topic, F.replace(q, F.lit("呢"), F.lit(""))))
        return out.otherwise(F.concat(topic, F.lit(" "), q))

    return T.let(topic_of(previous, terms), complete)


def synonym_pairs(terms: dict[str, list[str]]) -> dict[str, str]:
    """Lower-cased synonym to standard term; a later entry takes over, in the first one's place."""
    pairs: dict[str, str] = {}
    for standard, synonyms in terms.items():
        pairs.update({s.lower(): standard for s in synonyms})
    return pairs


def standardize_terms(
    q: Column, terms: dict[str, list[str]] | None = None, word_boundary: bool = False
) -> Column:
    """STRUCT<text, applied ARRAY<STRING>>: synonyms replaced by standard terms.

    Conditions look at the original query, replacements run one after another.
    Matching is by substring unless ``word_boundary`` is set. The pairs are a
    constant array folded over the query, not a chain of nested expressions.
    """
    pairs = synonym_pairs(terms or L.TERM_SYNONYMS)
    table = F.array(
        *[
            F.struct(
                F.lit(syn).alias("syn"),
                F.lit(std).alias("std"),
                F.lit("(?iu)" + (rf"\b{re.escape(syn)}\b" if word_boundary else re.escape(syn))).alias("pattern"),
            )
            for syn, std in pairs.items()
        ]
    )

    def fold(given: Column) -> Column:
        low = F.lower(given)
        hit = F.filter(table, lambda p: F.contains(low, p["syn"]) & ~F.contains(given, p["std"]))
        if word_boundary:
            hit = F.filter(hit, lambda p: F.regexp_like(given, p["pattern"]))
        start = F.struct(given.alias("text"), F.array().cast("array<string>").alias("applied"))
        return F.aggregate(
            hit,
            start,
            lambda st, p: F.struct(
                F.regexp_replace(st["text"], p["pattern"], p["std"]).alias("text"),
                F.array_append(st["applied"], F.concat(p["syn"], F.lit(" → "), p["std"])).alias("applied"),
            ),
        )

    return T.let(q, fold)


def expand_synonyms(q: Column, terms: dict[str, list[str]] | None = None) -> Column:
    """Sorted array of the first two synonyms of each contained term that the query lacks."""
    table = F.array(
        *[
            F.struct(F.lit(t).alias("term"), F.array(*[F.lit(s) for s in syn[:2]]).alias("syn"))
            for t, syn in (terms or L.TERM_SYNONYMS).items()
        ]
    )

    def expand(given: Column) -> Column:
        low = F.lower(given)
        present = F.filter(table, lambda t: F.contains(given, t["term"]))
        words = F.flatten(F.transform(present, lambda t: t["syn"]))
        return F.array_sort(F.array_distinct(F.filter(words, lambda s: ~F.contains(low, F.lower(s)))))

    return T.let(q, expand)


#: Characters of the terms of one automaton; a larger term table is dealt into several by the terms' first characters.
AUTOMATON_CHARS = 1 << 22
_AUTOMATA: dict[str, tuple] = {}


def _automaton(key: str, shared) -> tuple:
    """The automaton of a broadcast term list and the synonyms of the empty term; built once per worker."""
    import ahocorasick

    if key not in _AUTOMATA:
        _AUTOMATA.clear()
        built, always = ahocorasick.Automaton(), []
        for term, synonyms in shared.value:
            if term:
                built.add_word(term, synonyms)
            else:
                always += synonyms
        built.make_automaton()
        _AUTOMATA[key] = built, always
    return _AUTOMATA[key]


def _contained(q: Column, shared) -> Column:
    """array<string>: the synonyms of every term of the broadcast list that the text holds, in one pass over it."""
    key = uuid.uuid4().hex

    @F.pandas_udf("array<string>")
    def match(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton, always = _automaton(key, shared)
        for texts in batches:
            rows = []
            for text in texts:
                found = dict.fromkeys(always) if text is not None else {}
                if text and len(automaton):
                    for _, synonyms in automaton.iter(text):
                        found.update(dict.fromkeys(synonyms))
                rows.append(list(found))
            yield pd.Series(rows)

    return match(q)


def expand_synonyms_table(queries: DataFrame, terms: DataFrame, query_col: str = "query") -> DataFrame:
    """query_id, synonym: the same rule for a term table ``(term, syn_ord, synonym)``.

    The terms are compiled into an automaton that finds all of them in one pass
    over a text; a row leaves per match, nothing is cut into substrings and
    nothing is shuffled but the matches. Term tables above AUTOMATON_CHARS are
    dealt by the terms' first characters, with a scan of the queries for each
    part. Null queries, terms and synonyms match nothing.
    """
    given = terms.filter("syn_ord <= 2 AND term IS NOT NULL AND synonym IS NOT NULL")
    listed = materialize(given.groupBy("term").agg(F.collect_set("synonym").alias("synonyms")), "terms")
    chars = listed.agg(F.sum(F.length("term") + F.aggregate("synonyms", F.lit(0), lambda n, s: n + F.length(s)))).first()[0]
    parts = max(1, -(-(chars or 0) // AUTOMATON_CHARS))
    q, found = F.col(query_col), None
    for part in range(parts):
        mine = listed.filter(F.pmod(F.xxhash64(F.left("term", F.lit(4))), F.lit(parts)) == part)
        shared = queries.sparkSession.sparkContext.broadcast([(r["term"], r["synonyms"]) for r in mine.toLocalIterator()])  # about AUTOMATON_CHARS
        matched = queries.select("query_id", F.lower(q).alias("low"), _contained(q, shared).alias("synonyms"))
        missing = F.filter("synonyms", lambda s: ~F.contains(F.col("low"), F.lower(s)))
        rows = matched.select("query_id", F.explode(missing).alias("synonym"))
        found = rows if found is None else found.unionAll(rows)
    return found.distinct()


def check_ambiguity(q: Column) -> Column:
    """Hint for the first ambiguous term without a type; NULL when there is none."""
    hint = F.lit(None).cast("string")
    for term, options in reversed(L.AMBIGUOUS_TERMS.items()):
        text = f"'{term}'可能指: {', '.join(list(options.values())[:3])}"
        unclear = F.contains(q, F.lit(term)) & ~_any(q, list(options))
        hint = F.when(unclear, text).otherwise(hint)
    return hint


def rewrite(query: Column, previous: Column, expand: bool = True, terms: dict[str, list[str]] | None = None) -> Column:
    """STRUCT<original, rewritten, expanded_terms, is_modified, reason>."""
    original = T.strip(query)
    completed = F.when(
        is_follow_up(query) & previous.isNotNull() & (previous != ""), complete_follow_up(query, previous, terms)
    ).otherwise(original)

    def finish(st: Column) -> Column:
        text = st["std"]["text"]
        extra = expand_synonyms(text, terms) if expand else F.array().cast("array<string>")

        def build(words: Column) -> Column:
            reasons = F.concat_ws(
                "; ",
                F.when(st["completed"] != original, "追问补全"),
                F.when(text != st["completed"], F.concat(F.lit("术语标准化: "), F.array_join(st["std"]["applied"], ", "))),
                F.when(F.size(words) > 0, F.concat(F.lit("同义词扩展: "), F.array_join(F.slice(words, 1, 3), ", "))),
                F.concat(F.lit("建议明确: "), check_ambiguity(text)),
            )
            return F.struct(
                original.alias("original"),
                text.alias("rewritten"),
                words.alias("expanded_terms"),
                ((text != original) | (F.size(words) > 0)).alias("is_modified"),
                F.when(reasons == "", L.NO_REWRITE).otherwise(reasons).alias("reason"),
            )

        return T.let(extra, build)

    staged = T.let(completed, lambda c: F.struct(c.alias("completed"), standardize_terms(c, terms).alias("std")))
    return T.let(staged, finish)


def rewrite_queries(
    queries: DataFrame, query_col: str = "query", previous_col: str = "previous_query", **options
) -> DataFrame:
    done = queries.withColumn("_w", rewrite(F.col(query_col), F.col(previous_col), **options))
    return done.select(
        *queries.columns, "_w.original", "_w.rewritten", "_w.expanded_terms", "_w.is_modified",
        F.col("_w.reason").alias("rewrite_reason"),
    )
