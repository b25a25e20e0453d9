"""SQL statements of the structural chunkers, as set-based folds over part numbers."""

from __future__ import annotations

from corpusloom.catalog.base import SQL_MARKED, sql_clean, sql_sentences, sql_strip, sql_tokens


def markdown_sql(size: int = 512, overlap: int = 64, minimum: int = 100, maximum: int = 1500) -> str:
    """Sections, paragraph packing, sentence packing of long paragraphs."""
    return rf"""WITH RECURSIVE {SQL_MARKED}, c AS (SELECT doc_id, {sql_clean('text')} AS t FROM marked),
 p AS (SELECT doc_id, t, string_split(regexp_replace(t, '(?m)^(#{{1,6}})\s+(.+)$', chr(1) || '\1' || chr(2) || '\2' || chr(3), 'g'), chr(1)) AS ps FROM c),
 u AS (SELECT doc_id, t, len(ps) AS n, unnest(ps) AS x, unnest(range(len(ps))) AS sec FROM p),
 s AS (SELECT doc_id, t, sec,
   CASE WHEN contains(x, chr(3)) THEN {sql_strip("split_part(split_part(x, chr(3), 1), chr(2), 2)")} ELSE '' END AS title,
   CASE WHEN contains(x, chr(3)) THEN {sql_strip("split_part(x, chr(3), 2)")} WHEN n = 1 THEN x ELSE {sql_strip('x')} END AS body FROM u),
 sec AS (SELECT doc_id, sec, title, CASE WHEN body = '' THEN 0 ELSE instr(t, body) - 1 END AS spot,
   CASE WHEN title <> '' THEN '## ' || title || chr(10) || chr(10) ELSE '' END AS pre,
   list_filter(list_transform(regexp_split_to_array(body, '\n\n+'), lambda x: {sql_strip('x')}), lambda x: x <> '') AS ps FROM s),
 par AS (SELECT doc_id, sec, length(pre) AS lp, unnest(ps) AS p, unnest(range(1, len(ps) + 1)) AS i FROM sec),
 lng AS (SELECT doc_id, sec, i, lp, {sql_sentences('p')} AS ss FROM par WHERE length(p) > {maximum}),
 sp AS (SELECT doc_id, sec, i, 0::BIGINT AS j, []::VARCHAR[] AS op, lp AS n, NULL::VARCHAR AS out FROM lng
   UNION ALL SELECT sp.doc_id, sp.sec, sp.i, sp.j + 1,
     CASE WHEN sp.n + length(l.ss[sp.j + 1]) > {size} AND len(sp.op) > 0 THEN [sp.op[-1], l.ss[sp.j + 1]] ELSE list_append(sp.op, l.ss[sp.j + 1]) END,
     CASE WHEN sp.n + length(l.ss[sp.j + 1]) > {size} AND len(sp.op) > 0 THEN l.lp + length(sp.op[-1]) ELSE sp.n END + length(l.ss[sp.j + 1]),
     CASE WHEN sp.n + length(l.ss[sp.j + 1]) > {size} AND len(sp.op) > 0 THEN array_to_string(sp.op, ' ') END
   FROM sp JOIN lng l ON l.doc_id = sp.doc_id AND l.sec = sp.sec AND l.i = sp.i WHERE sp.j < len(l.ss)),
 lout AS (SELECT doc_id, sec, i, j, out AS x FROM sp WHERE out IS NOT NULL
   UNION ALL SELECT sp.doc_id, sp.sec, sp.i, sp.j + 1, array_to_string(sp.op, ' ') FROM sp JOIN lng l ON l.doc_id = sp.doc_id AND l.sec = sp.sec AND l.i = sp.i WHERE sp.j = len(l.ss) AND len(sp.op) > 0),
 f AS (SELECT doc_id, sec, 0::BIGINT AS i, []::VARCHAR[] AS op, 0::BIGINT AS n, NULL::VARCHAR AS out FROM sec
   UNION ALL SELECT z.doc_id, z.sec, z.i, CASE WHEN z.long THEN []::VARCHAR[] ELSE list_append(z.kept, z.p) END,
     CASE WHEN z.long THEN 0 ELSE coalesce(list_sum(list_transform(z.kept, lambda y: length(y))), 0)::BIGINT + length(z.p) END, z.out
   FROM (SELECT y.*, CASE WHEN y.long THEN []::VARCHAR[] WHEN y.flush THEN list_filter(y.op, lambda v, q: coalesce(list_sum(list_transform(y.op[q:], lambda w: length(w))), 0) <= {overlap}) ELSE y.op END AS kept,
       CASE WHEN y.flush THEN array_to_string(y.op, chr(10) || chr(10)) END AS out
     FROM (SELECT f.doc_id, f.sec, f.i + 1 AS i, f.op, k.ps[f.i + 1] AS p, length(k.ps[f.i + 1]) > {maximum} AS long,
         len(f.op) > 0 AND (length(k.ps[f.i + 1]) > {maximum} OR f.n + length(k.ps[f.i + 1]) + length(k.pre) > {size}) AS flush
       FROM f JOIN sec k ON k.doc_id = f.doc_id AND k.sec = f.sec WHERE f.i < len(k.ps)) y) z),
 parts AS (SELECT doc_id, sec, i, 0 AS o, 0::BIGINT AS j, out AS x FROM f WHERE out IS NOT NULL
   UNION ALL SELECT doc_id, sec, i, 1, j, x FROM lout
   UNION ALL SELECT f.doc_id, f.sec, f.i + 1, 2, 0, array_to_string(f.op, chr(10) || chr(10)) FROM f JOIN sec k ON k.doc_id = f.doc_id AND k.sec = f.sec
     WHERE f.i = len(k.ps) AND len(f.op) > 0 AND length(k.pre || array_to_string(f.op, chr(10) || chr(10))) >= {minimum}),
 done AS (SELECT a.*, k.pre || a.x AS text, k.spot, k.title FROM parts a JOIN sec k ON k.doc_id = a.doc_id AND k.sec = a.sec)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sec, i, o, j) - 1 AS chunk_index, spot::BIGINT AS chunk_start,
  (spot + length(text))::BIGINT AS chunk_end, md5(text) AS text_md5, title AS section FROM done"""


# the separators of each level as a marking step: everything matched is dropped
_LEVELS = [
    r"regexp_replace(x, '\n#{1,6}\s+', chr(1), 'g')",
    r"regexp_replace(x, '\n\n+', chr(1), 'g')",
    r"regexp_replace(x, '([。！？.!?])\s*', '\1' || chr(1), 'g')",
    r"regexp_replace(x, '\n', chr(1), 'g')",
    r"regexp_replace(x, '\s+', chr(1), 'g')",
]


def recursive_sql(size: int = 512, overlap: int = 64, minimum: int = 100) -> str:
    """Level by level: split what is too long, merge greedily, pass on what stays too long."""
    step = size - overlap
    ctes = [SQL_MARKED, f"c AS (SELECT doc_id, {sql_clean('text')} AS t FROM marked)"]
    ctes.append(f"big0 AS (SELECT doc_id, []::BIGINT[] AS key, t AS x FROM c WHERE length(t) > {size})")
    ctes.append(f"out0 AS (SELECT doc_id, []::BIGINT[] AS key, t AS x FROM c WHERE length(t) <= {size} AND {sql_strip('t')} <> '')")
    for n, marked in enumerate(_LEVELS):
        ctes.append(
            f"cut{n} AS (SELECT doc_id, key, x, list_filter(string_split({marked}, chr(1)), lambda p: {sql_strip('p')} <> '') AS ps FROM big{n})"
        )
        ctes.append(f"prt{n} AS (SELECT doc_id, key, CASE WHEN len(ps) > 1 THEN ps ELSE [x] END AS ps FROM cut{n})")
        ctes.append(
            f"""fold{n} AS (SELECT doc_id, key, 0::BIGINT AS i, '' AS cur, NULL::VARCHAR AS flush, NULL::VARCHAR AS big FROM prt{n}
   UNION ALL SELECT f.doc_id, f.key, f.i + 1,
     CASE WHEN length(f.cur) + length(k.ps[f.i + 1]) <= {size} THEN f.cur || k.ps[f.i + 1] WHEN length(k.ps[f.i + 1]) > {size} THEN '' ELSE k.ps[f.i + 1] END,
     CASE WHEN length(f.cur) + length(k.ps[f.i + 1]) <= {size} THEN NULL ELSE nullif(f.cur, '') END,
     CASE WHEN length(k.ps[f.i + 1]) > {size} THEN k.ps[f.i + 1] END
   FROM fold{n} f JOIN prt{n} k ON k.doc_id = f.doc_id AND k.key = f.key WHERE f.i < len(k.ps))"""
        )
        ctes.append(f"big{n + 1} AS (SELECT doc_id, list_append(key, 2 * i + 1) AS key, big AS x FROM fold{n} WHERE big IS NOT NULL)")
        ctes.append(
            f"""out{n + 1} AS (SELECT doc_id, list_append(key, 2 * i) AS key, flush AS x FROM fold{n} WHERE flush IS NOT NULL
   UNION ALL SELECT f.doc_id, list_append(f.key, 2 * f.i + 2), f.cur FROM fold{n} f JOIN prt{n} k ON k.doc_id = f.doc_id AND k.key = f.key WHERE f.i = len(k.ps) AND f.cur <> '')"""
        )
    last = len(_LEVELS)
    ctes.append(
        f"forced AS (SELECT doc_id, list_append(key, g) AS key, substr(x, g * {step} + 1, {size}) AS x FROM (SELECT *, unnest(range(0, ((length(x) - 1) // {step}) + 1)) AS g FROM big{last}))"
    )
    union = " UNION ALL ".join(f"SELECT * FROM out{n}" for n in range(last + 1))
    ctes.append(f"raw AS ({union} UNION ALL SELECT * FROM forced WHERE {sql_strip('x')} <> '')")
    ctes.append("num AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY key) - 1 AS idx, x FROM raw)")
    ctes.append(
        f"kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS k FROM num WHERE length({sql_strip('x')}) >= {minimum})"
    )
    ctes.append(
        """pos AS (SELECT doc_id, 0::BIGINT AS k, 0::BIGINT AS a, 0::BIGINT AS b FROM c
   UNION ALL SELECT p.doc_id, p.k + 1, q.a, q.a + length(n.x) FROM pos p JOIN kept n ON n.doc_id = p.doc_id AND n.k = p.k + 1 JOIN c ON c.doc_id = p.doc_id,
     LATERAL (SELECT CASE WHEN instr(substr(c.t, p.b + 1), n.x) > 0 THEN p.b + instr(substr(c.t, p.b + 1), n.x) - 1 ELSE p.b END AS a) q)"""
    )
    return (
        "WITH RECURSIVE " + ",\n ".join(ctes) + f"\nSELECT n.doc_id, n.idx AS chunk_index, p.a AS chunk_start, p.b AS chunk_end, md5({sql_strip('n.x')}) AS text_md5 "
        "FROM kept n JOIN pos p ON p.doc_id = n.doc_id AND p.k = n.k"
    )


def semantic_sql(minimum: int = 100, maximum: int = 1500, threshold: float = 0.5, dim: int = 256) -> str:
    """Hashed sentence vectors, neighbour cosines, cuts in sentence order."""
    return f"""WITH RECURSIVE c AS (SELECT doc_id, {sql_clean('text')} AS t FROM documents),
 ss AS (SELECT doc_id, t, {sql_sentences('t')} AS ss FROM c),
 sen AS (SELECT doc_id, unnest(ss) AS s, unnest(range(1, len(ss) + 1)) AS i FROM ss WHERE len(ss) > 1),
 b AS (SELECT doc_id, i, ('0x' || substr(md5(w), 1, 8))::BIGINT % {dim} AS bucket, count(*)::DOUBLE AS n FROM (SELECT doc_id, i, unnest({sql_tokens('s')}) AS w FROM sen) GROUP BY ALL),
 nm AS (SELECT doc_id, i, sqrt(sum(n * n)) AS norm FROM b GROUP BY ALL),
 dots AS (SELECT a.doc_id, a.i, sum(a.n * z.n) AS dot FROM b a JOIN b z ON z.doc_id = a.doc_id AND z.i = a.i + 1 AND z.bucket = a.bucket GROUP BY ALL),
 sim AS (SELECT s.doc_id, s.i, round(coalesce(d.dot / (x.norm * y.norm), 0) / (1 + 1e-8::DOUBLE), 12) AS sim FROM sen s JOIN ss ON ss.doc_id = s.doc_id AND s.i < len(ss.ss)
   LEFT JOIN dots d ON d.doc_id = s.doc_id AND d.i = s.i LEFT JOIN nm x ON x.doc_id = s.doc_id AND x.i = s.i LEFT JOIN nm y ON y.doc_id = s.doc_id AND y.i = s.i + 1),
 lim AS (SELECT doc_id, greatest(quantile_cont(sim, 0.2), {threshold}::DOUBLE) AS lim FROM sim GROUP BY 1),
 steps AS (SELECT s.doc_id, s.i + 1 AS i, length(n.s) AS l, sim < lim AS low FROM sim s JOIN lim USING (doc_id) JOIN sen n ON n.doc_id = s.doc_id AND n.i = s.i + 1),
 f AS (SELECT doc_id, 1::BIGINT AS i, length(s)::BIGINT AS n, true AS cut FROM sen WHERE i = 1
   UNION ALL SELECT x.doc_id, x.i, CASE WHEN x.cut THEN 0 ELSE x.m END, x.cut FROM (SELECT f.doc_id, t.i, f.n + t.l AS m, (t.low AND f.n + t.l >= {minimum}) OR f.n + t.l >= {maximum} AS cut
     FROM f JOIN steps t ON t.doc_id = f.doc_id AND t.i = f.i + 1) x),
 g AS (SELECT doc_id, i, sum(cut::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM f),
 ch AS (SELECT g.doc_id, g.k::BIGINT AS k, string_agg(s, ' ' ORDER BY g.i) AS x, arg_min(s, g.i) AS head FROM g JOIN sen ON sen.doc_id = g.doc_id AND sen.i = g.i GROUP BY ALL),
 pos AS (SELECT doc_id, 0::BIGINT AS k, 0::BIGINT AS a, 0::BIGINT AS b FROM c
   UNION ALL SELECT p.doc_id, p.k + 1, q.a, q.a + length(n.x) FROM pos p JOIN ch n ON n.doc_id = p.doc_id AND n.k = p.k + 1 JOIN c ON c.doc_id = p.doc_id,
     LATERAL (SELECT CASE WHEN instr(substr(c.t, p.b + 1), n.head) > 0 THEN p.b + instr(substr(c.t, p.b + 1), n.head) - 1 ELSE p.b END AS a) q)
SELECT n.doc_id, n.k - 1 AS chunk_index, p.a AS chunk_start, p.b AS chunk_end, md5(x) AS text_md5 FROM ch n JOIN pos p ON p.doc_id = n.doc_id AND p.k = n.k
UNION ALL SELECT doc_id, 0, 0, length(t), md5(t) FROM ss WHERE len(ss) <= 1"""
