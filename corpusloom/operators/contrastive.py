"""(query, positive, negatives) sets from question sources and documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import lexicon as L
from corpusloom.functions import text as T
from corpusloom.functions.ranking import global_position, hash_edge, hash_order, top_per_group, value_at
from corpusloom.session import materialize


@dataclass(frozen=True)
class PairConfig:
    per_source: int | None = None
    min_query: int = 10
    min_passage: int = 50
    max_passage: int = 2000
    max_question: int = 500
    negatives: int = 3
    train_ratio: float = 0.9
    seed: int = 42


def is_valid_pair(query: Column, passage: Column, cfg: PairConfig = PairConfig()) -> Column:
    """Both long enough; NULL counts as invalid."""
    return F.coalesce(
        (F.length(query) >= max(1, cfg.min_query)) & (F.length(passage) >= max(1, cfg.min_passage)), F.lit(False)
    )


def valid_pairs(pairs: DataFrame, cfg: PairConfig = PairConfig()) -> DataFrame:
    return pairs.filter(is_valid_pair(F.col("query"), F.col("positive"), cfg))


def _shorten(valid: DataFrame, query: int | None, positive: int | None) -> DataFrame:
    if query:
        valid = valid.withColumn("query", F.left("query", F.lit(query)))
    return valid.withColumn("positive", F.left("positive", F.lit(positive))) if positive else valid


def pairs_from_pubmedqa(items: DataFrame, cfg: PairConfig = PairConfig()) -> DataFrame:
    """``items(pair_id, question, contexts[])``: question with its joined abstract."""
    pairs = items.select("pair_id", F.col("question").alias("query"), F.array_join("contexts", " ").alias("positive"))
    return _shorten(valid_pairs(pairs, cfg), None, cfg.max_passage)


def pairs_from_medqa(items: DataFrame, cfg: PairConfig = PairConfig()) -> DataFrame:
    """``items(pair_id, question, options ARRAY<STRUCT<key, value>>, answer_idx)``.

    Question with its options against question with the correct answer; lengths
    are checked before the query is cut.
    """
    listed = F.array_join(F.transform("options", lambda o: F.concat(o["key"], F.lit(": "), o["value"])), " ")
    answer = F.get(F.filter("options", lambda o: o["key"] == F.col("answer_idx")), F.lit(0))["value"]
    q = F.col("question")
    pairs = items.select(
        "pair_id",
        F.when(F.size("options") > 0, F.concat(q, F.lit(" "), listed)).otherwise(q).alias("query"),
        F.when(F.coalesce(answer, F.lit("")) != "", F.concat(q, F.lit(L.ANSWER_IS), answer)).otherwise(q).alias("positive"),
    )
    return _shorten(valid_pairs(pairs, cfg), cfg.max_question, None)


def pairs_from_medmcqa(items: DataFrame, cfg: PairConfig = PairConfig()) -> DataFrame:
    """``items(pair_id, question, explanation)``: only explained questions."""
    pairs = items.select("pair_id", F.col("question").alias("query"), F.col("explanation").alias("positive"))
    return _shorten(valid_pairs(pairs, cfg), None, cfg.max_passage)


# a heading of level 1-3 on a line of its own, the line breaks included
SECTION_LINE = r"(?d)\n(#{1,3})(?U:\s+)(.+)\n"


def pairs_from_sections(docs: DataFrame, cfg: PairConfig = PairConfig(), id_col: str = "doc_id") -> DataFrame:
    """Heading against the text below it; bodies that open with '#' are passed over.

    The heading's line breaks belong to the separator, so a heading right below
    another one stays part of the body and rules that body out.
    """
    marked = F.regexp_replace(T.escape(F.col("text")), SECTION_LINE, f"{T.MARK}$2{T.TITLE_CLOSE}")
    pieces = F.filter(F.split(marked, T.MARK), lambda p: F.contains(p, F.lit(T.TITLE_CLOSE)))
    rows = docs.select(id_col, F.posexplode(pieces).alias("_i", "_p")).select(
        F.concat_ws("-", F.col(id_col).cast("string"), F.col("_i").cast("string")).alias("pair_id"),
        T.unescape(F.substring_index("_p", T.TITLE_CLOSE, 1)).alias("query"),
        T.unescape(F.substring_index("_p", T.TITLE_CLOSE, -1)).alias("_body"),
    )
    bodies = rows.filter(~F.startswith("_body", F.lit("#"))).select("pair_id", "query", T.strip(F.col("_body")).alias("positive"))
    return _shorten(valid_pairs(bodies, cfg), None, cfg.max_passage)


def cap_per_source(pairs: DataFrame, n: int, order: str = "pair_id") -> DataFrame:
    """The first ``n`` pairs of each source."""
    return top_per_group(pairs, ["source"], [F.asc(order)], n, "_place", salt_on=[order]).drop("_place")


def add_random_negatives(pairs: DataFrame, cfg: PairConfig = PairConfig()) -> DataFrame:
    """Adds ``negatives``: other pairs' positives with a different text.

    Distinct passage hashes get a position in a seeded hash order; the next
    ``n`` (cyclically) name the negatives. All texts are different by
    construction, however often one repeats, and the work is linear: only
    hashes are ordered, texts move once per use. With m distinct passages each
    pair gets min(n, m-1) negatives.
    """
    keyed = pairs.withColumn("_h", F.md5("positive"))
    hashes = materialize(keyed.select("_h").distinct(), "passage-hashes")
    placed = materialize(
        global_position(hashes, hash_order("_h", seed=cfg.seed), ["_h"], "pos", "m"), "passage-order"
    )
    m = F.col("m")
    steps = F.sequence(F.lit(1), F.least(F.lit(max(1, cfg.negatives)).cast("bigint"), m - 1))
    wanted = (
        placed.filter(m > 1)
        .select("_h", "pos", "m", F.explode(steps).alias("_step"))
        .select(F.col("_h").alias("_for"), "_step", F.pmod(F.col("pos") + F.col("_step"), m).alias("pos"))
    )
    texts = keyed.groupBy("_h").agg(F.any_value("positive").alias("text"))
    chosen = (
        wanted.join(placed.select("pos", "_h"), "pos")
        .join(texts, "_h")
        .groupBy(F.col("_for").alias("_h"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_step", "text"))), lambda x: x["text"]).alias("negatives"))
    )
    none = F.array().cast("array<string>")
    return keyed.join(chosen, "_h", "left").withColumn("negatives", F.coalesce("negatives", none)).drop("_h")


def shuffle_split(pairs: DataFrame, ratio: float, seed: int = 42, id_col: str = "pair_id") -> DataFrame:
    """Adds ``split`` ('train'/'val'): exactly floor(N * ratio) rows train, in hash order.

    The row at the cut is looked up, then every row is compared with it in place.
    """
    key = hash_order(id_col, seed=seed)
    edge = hash_edge(pairs, key, id_col, ratio=ratio)
    if edge is None:
        return pairs.withColumn("split", F.lit("train"))
    before = (key < edge[0]) | ((key == edge[0]) & (F.col(id_col) < F.lit(edge[1])))
    return pairs.withColumn("split", F.when(before, "train").otherwise("val"))


def ordered_split(pairs: DataFrame, ratio: float, id_col: str = "pair_id") -> DataFrame:
    """Unshuffled prefix split in id order: only the id at the cut is looked up."""
    edge = value_at(pairs, id_col, int(pairs.count() * ratio))
    if edge is None:
        return pairs.withColumn("split", F.lit("train"))
    return pairs.withColumn("split", F.when(F.col(id_col) < F.lit(edge), "train").otherwise("val"))


def build_all(sources: dict[str, DataFrame], cfg: PairConfig = PairConfig()) -> DataFrame:
    """Union of the pair sources, with negatives; order is the hash order.

    Every pair is kept unless ``per_source`` asks for the first so many of each source.

    Rows: source, pair_id, query, positive, negatives, shuffle_key.
    """
    union = None
    for name, pairs in sources.items():
        part = pairs.select(
            F.lit(name).alias("source"), F.concat_ws(":", F.lit(name), F.col("pair_id").cast("string")).alias("pair_id"),
            "query", "positive",
        )
        union = part if union is None else union.unionByName(part)
    kept = cap_per_source(union, cfg.per_source) if cfg.per_source else union
    if cfg.negatives > 0:
        full = add_random_negatives(materialize(kept, "pairs"), cfg)  # read three times
    else:
        full = kept.withColumn("negatives", F.array().cast("array<string>"))
    return full.withColumn("shuffle_key", hash_order("pair_id", seed=cfg.seed))


def training_rows(pairs: DataFrame) -> DataFrame:
    """query, pos[], neg[]: the stored training layout."""
    return pairs.select("query", F.array("positive").alias("pos"), F.col("negatives").alias("neg"))


def mnrl_pairs(items: DataFrame) -> DataFrame:
    """One (anchor, positive) row per query and positive."""
    return items.select(F.col("query").alias("anchor"), F.explode("pos").alias("positive"))


def triplets(items: DataFrame) -> DataFrame:
    """Every (anchor, positive, negative); items without negatives drop out."""
    return items.select(F.col("query").alias("anchor"), F.explode("pos").alias("positive"), "neg").select(
        "anchor", "positive", F.explode("neg").alias("negative")
    )
