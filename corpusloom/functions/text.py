"""Character-level building blocks, all plain Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------
CJK = "一-鿿"
TOKEN_SEPARATORS = r"\s\-_.,;:!?()\[\]{}\"'/"
SENTENCE_END = r"([。！？.!?]+[\"'）\)」』]?)"
BLANK_LINES = r"\n\n+"
HEADING_LINE = r"(?md)^(#{1,6})(?U:\s+)(.+)$"
# -------------------------------------------------------------------------

TOKEN_PATTERN = rf"(?U)[{CJK}]+|[^{TOKEN_SEPARATORS}{CJK}]+"
# a CJK character with a successor gives a pair; the last one of a run goes
CJK_PAIRS = rf"([{CJK}])(?=([{CJK}]))|(?<=[{CJK}])[{CJK}](?![{CJK}])"
# marks are pairs that an escaped text cannot hold: there every U+0001 is followed by U+0002
ESCAPE, ESCAPED = "\u0001", "\u0001\u0002"
MARK = "\u0001\u0003"
TITLE_OPEN = "\u0001\u0004"
TITLE_CLOSE = "\u0001\u0005"


def escape(c: Column) -> Column:
    return F.replace(c, F.lit(ESCAPE), F.lit(ESCAPED))


def unescape(c: Column) -> Column:
    return F.replace(c, F.lit(ESCAPED), F.lit(ESCAPE))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside ``body``.

    Catalyst re-evaluates a subtree for every mention inside a lambda, so an
    expensive array is bound to a lambda variable instead.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Unicode whitespace strip (``trim`` removes blanks only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def clean_text(c: Column) -> Column:
    """Collapse 3+ newlines to two and runs of blanks to one, then strip."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), " {2,}", " "))


def _strip_and_drop_empty(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def paragraphs(c: Column) -> Column:
    """Blank-line separated pieces, stripped, empties dropped."""
    return _strip_and_drop_empty(F.split(c, BLANK_LINES))


def sentences(c: Column) -> Column:
    """Pieces ending in a run of sentence marks plus one closing quote."""
    marked = F.regexp_replace(escape(c), SENTENCE_END + r"(?U:\s*)", "$1" + MARK)
    return F.transform(_strip_and_drop_empty(F.split(marked, MARK)), unescape)


def sections(c: Column) -> Column:
    """ARRAY<STRUCT<title, body, level>> cut at ATX headings.

    A marker goes before each heading, one split yields a piece per section;
    the text before the first heading has an empty title and level 0.
    """
    marked = F.regexp_replace(escape(c), HEADING_LINE, f"{MARK}$1{TITLE_OPEN}$2{TITLE_CLOSE}")

    def piece(p: Column) -> Column:
        headed = F.contains(p, F.lit(TITLE_CLOSE))
        return F.struct(
            F.when(
                headed,
                unescape(strip(F.substring_index(F.substring_index(p, TITLE_CLOSE, 1), TITLE_OPEN, -1))),
            )
            .otherwise("")
            .alias("title"),
            unescape(F.when(headed, strip(F.substring_index(p, TITLE_CLOSE, -1))).otherwise(strip(p))).alias("body"),
            F.when(headed, F.length(F.substring_index(p, TITLE_OPEN, 1))).otherwise(0).alias("level"),
        )

    cut = F.filter(
        F.transform(F.split(marked, MARK), piece),
        lambda s: (s["title"] != "") | (s["body"] != ""),
    )
    whole = F.array(
        F.struct(F.lit("").alias("title"), c.alias("body"), F.lit(0).alias("level"))
    )
    return F.when(F.contains(marked, F.lit(MARK)), cut).otherwise(whole)


def tokens(c: Column) -> Column:
    """Lower-cased index terms in text order.

    Runs outside CJK split on blanks and punctuation. A CJK run becomes its
    overlapping character pairs (a single character stays alone): one regular
    expression spells the pairs out, the next one collects all terms.
    """
    paired = F.regexp_replace(F.lower(c), CJK_PAIRS, "$1$2 ")
    return F.regexp_extract_all(paired, F.lit(TOKEN_PATTERN), F.lit(0))


def term_counts(toks: Column) -> Column:
    """ARRAY<STRUCT<term, tf>> by sort and run lengths: no shuffle, n log n."""

    def runs(s: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)),
        )
        return let(
            starts,
            lambda st: F.transform(
                st,
                lambda b, j: F.struct(
                    F.get(s, b).alias("term"),
                    (F.coalesce(F.get(st, j + 1), F.size(s)) - b).cast("int").alias("tf"),
                ),
            ),
        )

    empty = F.array().cast("array<struct<term:string,tf:int>>")
    return F.when(F.size(toks) > 0, let(F.array_sort(toks), runs)).otherwise(empty)


def truncate_ellipsis(c: Column, limit: Column | int | None) -> Column:
    """At most ``limit`` characters; a cut text ends in an ellipsis."""
    if limit is None or (isinstance(limit, int) and limit <= 0):
        return c
    n = F.lit(limit) if isinstance(limit, int) else limit
    return (
        F.when(F.length(c) <= n, c)
        .when(n <= 1, F.left(c, n))
        .otherwise(F.concat(rstrip(F.left(c, n - 1)), F.lit("…")))
    )


def content_chars(c: Column) -> Column:
    """Distinct lower-cased letters/digits (CJK by character)."""
    only = F.regexp_replace(F.lower(c), r"(?U)[^\p{L}\p{N}]", "")
    return F.array_distinct(F.filter(F.split(only, ""), lambda ch: ch != ""))


def content_words(c: Column) -> Column:
    return F.array_distinct(tokens(c))
