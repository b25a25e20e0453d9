"""Chat formatting with typed content parts, in SQL functions only.

A message holds parts: text, image, audio or document. A visitor flattens them
in order: text is escaped, every other part leaves one placeholder and an
attachment with its reference and the number of tokens that the placeholder
expands to. Turns are marked by control strings; a control string inside a text
gets a backslash after its first character (one more where some stand there
already), so that texts read back exactly and no text can open or close a turn.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
KINDS = ("image", "audio", "document")


@dataclass(frozen=True)
class Template:
    """Control strings and the expansion of attachments.

    ``begin`` role ``head`` content ``end`` is a turn; ``between`` parts two
    texts that follow each other. ``reserved`` are strings that the texts must
    not hold either. An image expands to one token per started square of
    ``patch`` pixels, audio to ``tokens_a_second``, a document to
    ``tokens_a_page``.
    """

    begin: str = "<|im_start|>"
    head: str = "<|im_sep|>"
    end: str = "<|im_end|>"
    between: str = "<|part|>"
    image: str = "<|image|>"
    audio: str = "<|audio|>"
    document: str = "<|document|>"
    reserved: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]")
    learned_role: str = "assistant"
    patch: int = 28
    tokens_a_second: int = 25
    tokens_a_page: int = 256

    def __post_init__(self):
        first = {c[:1] for c in self.controls}
        if any(len(c) < 2 or "\\" in c or first & set(c[1:]) for c in self.controls):
            raise ValueError("a control string has at least two characters, no backslash, and no other one's first character inside")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.begin, self.head, self.end, self.between, self.image, self.audio, self.document, *self.reserved)

    def _pattern(self, backslashes: str) -> str:
        first = "".join(sorted({re.escape(c[0]) for c in self.controls}))
        rest = "|".join(sorted({re.escape(c[1:]) for c in self.controls}))
        return f"([{first}]){backslashes}({rest})"

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, self._pattern(r"(\\*)"), r"$1\\$2$3")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, self._pattern(r"\\(\\*)"), "$1$2$3")


def text_part(text: Column) -> Column:
    """The parts of a message that is one text (null: empty)."""
    part = F.struct(
        F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"),
        F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
        F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"),
    )
    return F.array(part)


def _visit(parts: Column, role: Column, template: Template) -> Column:
    """array<struct<type, ref, tokens, lead, body, trail>>: what each part adds to the formatted text."""
    given = F.filter(F.coalesce(parts, F.array().cast(PARTS)), lambda p: p.isNotNull())
    given = F.when(F.size(given) > 0, given).otherwise(text_part(F.lit("")).cast(PARTS))
    is_text = lambda p: ~F.coalesce(p.type, F.lit("text")).isin(*KINDS)

    def squares(length: Column) -> Column:
        return F.ceil(F.coalesce(length, F.lit(0)) / template.patch)

    def visit(part: Column, i: Column) -> Column:
        after = F.get(given, i + 1)
        tokens = (
            F.when(part.type == "image", squares(part.width) * squares(part.height))
            .when(part.type == "audio", F.ceil(F.coalesce(part.seconds, F.lit(0.0)) * template.tokens_a_second))
            .when(part.type == "document", F.coalesce(part.pages, F.lit(0)) * template.tokens_a_page)
        )
        marks = F.when(part.type == "image", template.image).when(part.type == "audio", template.audio).when(part.type == "document", template.document)
        lead = F.concat(F.lit(template.begin), template.escape(role), F.lit(template.head))
        return F.struct(
            F.when(is_text(part), "text").otherwise(part.type).alias("type"),
            part.ref.alias("ref"),
            tokens.cast("bigint").alias("tokens"),
            F.when(i == 0, lead).otherwise("").alias("lead"),
            F.when(is_text(part), template.escape(F.coalesce(part.text, F.lit("")))).otherwise(marks).alias("body"),
            F.when(after.isNull(), template.end).when(is_text(part) & is_text(after), template.between).otherwise("").alias("trail"),
        )

    return F.transform(given, visit)


def format_conversations(
    messages: DataFrame,
    template: Template = Template(),
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    parts_col: str = "parts",
) -> DataFrame:
    """conv_id, formatted, loss, attachments, n_tokens_attached: one row per conversation.

    ``parts_col`` has the type ``PARTS``. Messages stand by turn, null first;
    of one turn by role, then by their parts. ``loss`` lists what is learned,
    in order: (start, length) in characters of ``formatted`` and (byte_start,
    byte_length) in its UTF-8 bytes, one per text part of the learned role,
    empty ones left out. ``attachments`` holds (turn, part, type, ref, tokens)
    in the order of the placeholders; turn and part count from 0.

    A null role is empty, null or empty parts are one empty text, an unknown
    type counts as text, null parts inside the list are passed over; missing
    sizes expand to no tokens. Repeated rows are repeated turns, a null
    conversation is one of its own, other columns are left alone, an empty
    table gives no rows. A conversation becomes one row, so its text has to fit
    in one; offsets are running sums over sorted rows, linear in its length.
    """
    said = messages.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(role_col, F.lit("")).alias("role"), F.col(parts_col).cast(PARTS).alias("parts"),
    )
    by_turn = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", F.to_json("parts"))
    visited = said.withColumn("no", F.row_number().over(by_turn) - 1).withColumn("parts", _visit(F.col("parts"), F.col("role"), template))
    rows = visited.select("conv_id", "no", "role", F.posexplode("parts").alias("part", "p")).select("conv_id", "no", "role", "part", "p.*")
    before = Window.partitionBy("conv_id").orderBy("no", "part").rowsBetween(Window.unboundedPreceding, -1)
    piece = F.concat("lead", "body", "trail")
    placed = rows.select(
        "conv_id", "no", "part", "type", "ref", "tokens", piece.alias("piece"),
        (F.coalesce(F.sum(F.length(piece)).over(before), F.lit(0)) + F.length("lead")).cast("bigint").alias("start"),
        (F.coalesce(F.sum(F.octet_length(piece)).over(before), F.lit(0)) + F.octet_length("lead")).cast("bigint").alias("byte_start"),
        F.length("body").cast("bigint").alias("length"), F.octet_length("body").cast("bigint").alias("byte_length"),
        ((F.col("role") == template.learned_role) & (F.col("type") == "text") & (F.col("body") != "")).alias("learned"),
    )
    entry = F.struct("no", "part", "piece", "type", "ref", "tokens", "start", "length", "byte_start", "byte_length", "learned")
    whole = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    attached = F.filter("e", lambda x: x.type != "text")
    return whole.select(
        "conv_id",
        F.array_join(F.transform("e", lambda x: x.piece), "").alias("formatted"),
        F.transform(F.filter("e", lambda x: x.learned), lambda x: F.struct(x.start.alias("start"), x.length.alias("length"), x.byte_start.alias("byte_start"), x.byte_length.alias("byte_length"))).alias("loss"),
        F.transform(attached, lambda x: F.struct(x.no.alias("turn"), x.part.alias("part"), x.type.alias("type"), x.ref.alias("ref"), x.tokens.alias("tokens"))).alias("attachments"),
        F.aggregate(attached, F.lit(0).cast("bigint"), lambda n, x: n + x.tokens).alias("n_tokens_attached"),
    )


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """array<struct<role, parts: array<struct<type, text>>>> of a formatted conversation.

    Parts come back as they went in, but for empty texts next to other parts;
    a message of nothing but an empty text has no parts.
    """
    turns = F.split(formatted, re.escape(template.end))
    marks = {"image": template.image, "audio": template.audio, "document": template.document}
    cut = "|".join(f"(?={m})|(?<={m})" for m in map(re.escape, (*marks.values(), template.between)))

    def part(token: Column) -> Column:
        kind = F.lit("text")
        for name, mark in marks.items():
            kind = F.when(token == mark, name).otherwise(kind)
        return F.struct(kind.alias("type"), F.when(kind == "text", template.unescape(token)).alias("text"))

    def turn(raw: Column) -> Column:
        said = F.split(raw, re.escape(template.head), 2)
        tokens = F.filter(F.split(F.get(said, F.lit(1)), cut), lambda t: (t != "") & (t != template.between))
        role = template.unescape(F.substring(F.get(said, F.lit(0)), F.lit(len(template.begin) + 1), F.length(raw)))
        return F.struct(role.alias("role"), F.transform(tokens, part).alias("parts"))

    return F.transform(F.slice(turns, 1, F.size(turns) - 1), turn)


def read_loss(formatted: Column, loss: Column, template: Template = Template()) -> Column:
    """array<string>: the texts under the loss mask, unescaped."""
    raw = formatted.cast("binary")
    return F.transform(loss, lambda s: template.unescape(F.substring(raw, (s.byte_start + 1).cast("int"), s.byte_length.cast("int")).cast("string")))


def turn_digests(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from formatted conversations.

    The turns' digest is taken over role, newline, text, newline of every turn,
    a message's text being its text parts joined; the loss digest over all text
    under the mask.
    """
    read = formatted.select(
        "conv_id", F.length("formatted").cast("bigint").alias("formatted_chars"),
        read_turns(F.col("formatted"), template).alias("turns"),
        F.array_join(read_loss(F.col("formatted"), F.col("loss"), template), "").alias("learned"),
    )
    text = lambda t: F.array_join(F.transform(t.parts, lambda p: F.coalesce(p.text, F.lit(""))), "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), text(t), F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("bigint").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars",
    )
