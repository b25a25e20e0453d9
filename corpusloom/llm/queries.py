"""One registered query per operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from corpusloom.llm import byte_bpe, chat_format, conversation_repair, decontamination, embedding_dedup, language_id, lexical_search, near_duplicates, sharding, suffix_dedup, token_output, url_filter, warc
from corpusloom.llm.registry import QUERIES, SQL, query, table  # noqa: F401
from corpusloom.session import materialize


@query("op1_language_id")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return language_id.identify(table(spark, sf, "documents"))


@query("op2_chosen_path_join")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates.near_duplicate_components(table(spark, sf, "documents"), near_duplicates.JoinSettings(words=2))


@query("op3_minimax_sharding")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf, "documents"))


@query("op4_token_files")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return token_output.token_round_trip(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_FOLD.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(
    "op5_decontamination",
    rf"""
    WITH item_words AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
    items AS (SELECT item_id, w, least(len(w), 13) AS k FROM item_words WHERE len(w) > 0),
    windows AS (
      SELECT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS win
      FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM items)),
    docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
    seen AS (
      SELECT r, i, k, array_to_string(w[i : i + k - 1], ' ') AS win
      FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM windows))),
    hits AS (SELECT s.r, s.i, s.k, w.item_id FROM seen s JOIN windows w ON s.k = w.k AND s.win = w.win),
    found AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY r),
    covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hits) GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
      sha256(coalesce(ids, '')) AS items_sha256, coalesce(n, 0) > 0 AND 20 * coalesce(n, 0) >= len(w) AS contaminated
    FROM docs LEFT JOIN found USING (r) LEFT JOIN covered USING (r)""",
)
def op5(spark: SparkSession, sf: str) -> DataFrame:
    found = decontamination.find_contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.encode(F.array_join(ids, ","), "UTF-8"), 256).alias("items_sha256"), "contaminated",
    )


# fixed values: the rules of the contract
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


@query(
    "op6_url_cascade",
    f"""
    WITH rules(h, p, v) AS (VALUES {', '.join(map(str, URL_RULES))}),
    rest AS (
      SELECT page_id, row_number() OVER () AS r,
        coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END, '') AS u FROM pages),
    host AS (SELECT page_id, r, u, regexp_extract(u, '^[^/?#]*') AS h FROM rest),
    parts AS (SELECT page_id, r, {_FOLD.format('h')} AS host, regexp_extract(substr(u, length(h) + 1), '^[^?#]*') AS path FROM host),
    best AS (
      SELECT r, arg_max(rules.h || p, length(rules.h || p)) AS rule, arg_max(v, length(rules.h || p)) AS v
      FROM parts JOIN rules ON (host = rules.h OR ends_with(host, '.' || rules.h)) AND starts_with(path, p) GROUP BY r)
    SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM parts LEFT JOIN best USING (r)""",
)
def op6(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(table(spark, sf, "pages"), rules)


@query("op7_byte_bpe_transducer")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return byte_bpe.encode_digests(
        table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    )


@query(
    "op9_warc_transactions",
    """
    WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
    tops AS (SELECT d, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY d)
    SELECT page_id, n::BIGINT AS payload_bytes, p.d AS payload_digest,
      CASE WHEN n >= 1000 AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN n >= 1000 AND top <> page_id THEN top END AS refers_to
    FROM p LEFT JOIN tops USING (d)""",
)
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf, "pages"))


@query("op8_itq_hamming")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(table(spark, sf, "embeddings"))


@query("op10_suffix_merge")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.repeat_digests(table(spark, sf, "documents"))


@query(
    "op12_fp_tree_search",
    rf"""
    WITH terms(side, r, id, t) AS (
      SELECT side, r, id, unnest(regexp_extract_all({_FOLD.format('text')}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))
      FROM (SELECT 'd' AS side, row_number() OVER () AS r, doc_id AS id, text FROM documents
            UNION ALL SELECT 'q', row_number() OVER (), item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark))),
    tf AS (SELECT r, id, t, count(*) AS tf FROM terms WHERE side = 'd' GROUP BY ALL),
    wanted AS (SELECT DISTINCT r AS q, id AS item_id, t FROM terms WHERE side = 'q'),
    total AS (SELECT count(DISTINCT r) AS n, count(*) AS l FROM terms WHERE side = 'd'),
    m AS (SELECT r, 50 + (50 * count(*) * any_value(total.n)) // any_value(total.l) AS m FROM terms, total WHERE side = 'd' GROUP BY r),
    w AS (SELECT t, floor(1000 * ln((2 * any_value(n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, total GROUP BY t),
    scores AS (
      SELECT q, item_id, r, tf.id AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
      FROM wanted JOIN tf USING (t) JOIN w USING (t) JOIN m USING (r) GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scores WHERE score > 0)
    SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 50""",
)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return lexical_search.ranked_search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


_LATE = "regexp_replace({}, '([\\[<])(\\\\*)(\\|(?:im_start|im_sep|im_end|part|image|audio|document)\\|>|/?s>|/?INST\\])', '\\1\\\\\\2\\3', 'g')"


@query(
    "op13_chat_format",
    rf"""
    WITH said AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
    SELECT conv_id, count(*)::BIGINT AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      sum(32 + length({_LATE.format('role')}) + length({_LATE.format('text')}))::BIGINT AS formatted_chars
    FROM said GROUP BY conv_id""",
)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    said = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))], said.schema)
    messages = said.unionAll(planted).withColumn("parts", chat_format.text_part(F.col("text")))
    formatted = materialize(chat_format.format_conversations(messages), "chat")
    return chat_format.turn_digests(formatted)


# states of the fold: z nothing yet, s after system, u after user, a after assistant; each holds cost c, audit e and repaired turns t
_GONE = "{'c': 1000000000::BIGINT, 'e': '', 't': []::VARCHAR[]}"


def _step(at: str, cost: str, letter: str, turn: str) -> str:
    """SQL: ``at`` after one more edit; ``turn`` is the repaired turn it leaves, if any."""
    turns = f"list_append({at}.t, {turn})" if turn else f"{at}.t"
    return f"{{'c': {at}.c + {cost}, 'e': {at}.e || '{letter}', 't': {turns}}}"


def _least(*options: str) -> str:
    return f"list_min([{', '.join(options)}])"


# turns may be inserted before a row; two of them at most make sense
_OPENED = {
    "z": "x.z", "s": "x.s",
    "u": _least("x.u", *[_step(f"x.{q}", "5", "I", "'user:'") for q in "zsa"]),
    "a": _least("x.a", _step("x.u", "5", "I", "'assistant:'"), *[_step(_step(f"x.{q}", "5", "I", "'user:'"), "5", "I", "'assistant:'") for q in "zs"]),
}  # fmt: skip


def _edited(after: str, before: str, initial: str, role: str | None) -> str:
    """SQL: least of all edits of row ``r`` that end in ``after``; ``o`` holds the states before it."""
    keep = [f"CASE WHEN r.i = '{initial}' AND r.f < 2 THEN {_step(f'o.{q}', '5 * r.f', 'K', 'r.said')} ELSE {_GONE} END" for q in before]
    turn = f"'{role}:' || r.text"
    rerole = [f"CASE WHEN r.f < 2 THEN {_step(f'o.{q}', '1 + 5 * r.f', 'R', turn)} ELSE {_GONE} END" for q in before if role]
    return _least(_step(f"o.{after}", "2", "D", ""), *keep, *rerole)


_ROWS_EDITED = f"""{{'z': {_step('o.z', '2', 'D', '')}, 's': {_edited('s', 'z', 's', None)}, 'u': {_edited('u', 'zsa', 'u', 'user')}, 'a': {_edited('a', 'u', 'a', 'assistant')}}}"""
_CRC = (
    "xor(list_reduce(list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i::INT, 1))::BIGINT), lambda c, b: "
    "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, n: xor(x >> 1, 3988292384 * (x & 1))), 4294967295::BIGINT), 4294967295)"
)
_BLANK = r"[^\x20\x09-\x0D]"


@query(
    "op11_lightest_repair",
    rf"""
    WITH given AS (
      SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
      FROM conversations),
    damaged AS (
      SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
        CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
      FROM (SELECT *, {_CRC} % 20 AS d FROM given)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS p FROM damaged),
    judged AS (
      SELECT *, CASE WHEN NOT regexp_matches(text, '{_BLANK}') THEN 3
          WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 THEN 2
          WHEN regexp_matches(text, '[.!?][ 	-]*\z') THEN 0 ELSE 1 END AS f,
        lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY p) || left(role, 1) AS pair FROM placed),
    counted AS (
      SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
        count(*) FILTER (f = 3) AS blank, count(*) FILTER (f = 2) AS duplicate, count(*) FILTER (f = 1) AS truncated,
        count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
        list({{'i': left(role, 1), 'f': f::BIGINT, 'said': role || ':' || text, 'text': text}} ORDER BY p) AS rows
      FROM judged GROUP BY conv_id),
    folded AS (
      SELECT *, list_reduce(rows, lambda x, r: list_transform(
          [{{{', '.join(f"'{q}': {how}" for q, how in _OPENED.items())}}}], lambda o: {_ROWS_EDITED})[1],
        {{'z': {{'c': 0::BIGINT, 'e': '', 't': []::VARCHAR[]}}, 's': {_GONE}, 'u': {_GONE}, 'a': {_GONE}}}) AS x FROM counted),
    best AS (SELECT *, {_least("x.z", _OPENED["a"])} AS b FROM folded)
    SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
      coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.c, 0)::BIGINT AS cost,
      coalesce(b.e, '') AS audit, sha256(coalesce(array_to_string(b.t, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN best ON o.conv_id IS NOT DISTINCT FROM best.conv_id""",
)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    given = table(spark, sf, "conversations")
    repaired = conversation_repair.repair_conversations(conversation_repair.damage(given))
    return conversation_repair.with_lost(given, repaired.summary)
