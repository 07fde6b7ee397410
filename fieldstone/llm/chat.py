"""Chat formatting (op10): typed content parts flattened into one string per conversation, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A turn is OPEN role ] body CLOSE. Texts and roles are escaped so that none of `\ < > [ ]` but our own stands in the output.
OPEN, SHUT, CLOSE = "<s>[", "]", "</s>"
#: Each special character and the letter that stands for it behind a backslash; the backslash itself comes first.
ESCAPES = (("\\", "b"), ("<", "l"), (">", "g"), ("[", "o"), ("]", "c"))
#: Tokens that a placeholder of each kind stands for when the part doesn't say.
DEFAULT_TOKENS = {"image": 576, "audio": 1500, "document": 2048}
SPANS = "array<struct<start:bigint, length:bigint>>"
PARTS = "array<struct<type:string, text:string, ref:string, tokens:int>>"


def escape(x: Column) -> Column:
    for sign, letter in ESCAPES:
        x = F.replace(x, F.lit(sign), F.lit("\\" + letter))
    return x


def unescape(x: Column) -> Column:
    for sign, letter in reversed(ESCAPES):
        x = F.replace(x, F.lit("\\" + letter), F.lit(sign))
    return x


def _nothing(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def text_part(text: Column) -> Column:
    """The parts of a turn that has text alone."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("tokens")))


def _kind(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text"))


def _visit(part: Column) -> Column:
    """A part in the output: escaped text, or a placeholder of its kind; its number follows from its place among the attachments."""
    return F.when(_kind(part) == "text", escape(_nothing(part["text"]))).otherwise(F.concat(F.lit("<"), escape(_kind(part)), F.lit(":"), escape(_nothing(part["ref"])), F.lit(">")))


def _tokens(part: Column) -> Column:
    default = F.lit(0)
    for kind, n in DEFAULT_TOKENS.items():
        default = F.when(part["type"] == kind, n).otherwise(default)
    return F.coalesce(part["tokens"], default)


def _spans(parts: Column, head: Column, role: Column, of: str) -> Column:
    """(start, length) in code points, within a turn, of the text parts of a turn that the loss covers: those of the role `of`."""
    shown = F.transform(parts, _visit)
    before = lambda i: F.aggregate(F.slice(shown, 1, i), head.cast("long"), lambda n, x: n + F.char_length(x))
    spans = F.transform(parts, lambda p, i: F.struct(before(i).alias("start"), F.char_length(_visit(p)).cast("long").alias("length"), (_kind(p) == "text").alias("text")))
    kept = F.transform(F.filter(spans, lambda s: s["text"] & (s["length"] > 0)), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))
    return F.when(role == of, kept).otherwise(F.array().cast(SPANS))


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts", learned: str = "assistant") -> DataFrame:
    """One row per conversation: conv_col, n_turns, formatted, loss_mask (start, length in code points of formatted: the texts of the role
    `learned`), attachments (in order: turn, part, kind, ref, tokens), expanded_tokens.

    parts_col is an array of (type, text, ref, tokens): type text (or null) holds text, the types image, audio and document, or any other,
    are attachments: a placeholder `<kind:ref>` stands for each in its place, and its tokens (or the kind's default) are added up. Rows are
    taken by turn, ties by role, then by content; a null turn comes first, null roles, parts and texts count as empty; repeated rows are
    repeated turns; each row with a null id is a conversation by itself. A conversation, of texts of any length, is one string and so one
    task's work. Other columns are not read; an empty table gives no rows."""
    parts = F.coalesce(F.col(parts_col), F.array().cast(PARTS))
    files = F.filter(parts, lambda p: _kind(p) != "text")
    role = _nothing(F.col(role_col))
    head = F.concat(F.lit(OPEN), escape(role), F.lit(SHUT))
    one = turns.select(
        F.col(conv_col).alias("conv"), F.when(F.col(conv_col).isNull(), F.monotonically_increasing_id()).alias("lone"), F.col(turn_col).alias("turn"),
        F.concat(head, F.array_join(F.transform(parts, _visit), ""), F.lit(CLOSE)).alias("shown"), _spans(parts, F.char_length(head), role, learned).alias("spans"),
        F.transform(files, lambda p, i: F.struct(i.alias("part"), _kind(p).alias("kind"), p["ref"].alias("ref"), _tokens(p).alias("tokens"))).alias("files"),
    )
    before = Window.partitionBy("conv", "lone").orderBy("turn", "shown", "files").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = one.withColumn("at", F.sum(F.char_length("shown").cast("long")).over(before) - F.char_length("shown"))
    ordered = placed.groupBy("conv", "lone").agg(F.array_sort(F.collect_list(F.struct("at", "shown", "spans", "files"))).alias("all"))
    attachments = F.flatten(F.transform("all", lambda t, i: F.transform(t["files"], lambda f: F.struct(i.alias("turn"), f["part"].alias("part"), f["kind"].alias("kind"), f["ref"].alias("ref"), f["tokens"].alias("tokens")))))
    mask = F.flatten(F.transform("all", lambda t: F.transform(t["spans"], lambda s: F.struct((t["at"] + s["start"]).alias("start"), s["length"].alias("length")))))
    return ordered.select(
        F.col("conv").alias(conv_col), F.size("all").cast("long").alias("n_turns"), F.array_join(F.transform("all", lambda t: t["shown"]), "").alias("formatted"), mask.alias("loss_mask"),
        attachments.alias("attachments"), F.aggregate(attachments, F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("expanded_tokens"),
    )


def parse_turns(formatted: Column) -> Column:
    """Turns read back from a formatted string: array of (role, body); body is as it stands there, with escapes and placeholders."""
    pieces = F.filter(F.split(formatted, F.lit(CLOSE)), lambda x: x != "")
    inner = F.transform(pieces, lambda x: F.substr(x, F.lit(len(OPEN) + 1)))
    return F.transform(inner, lambda x: F.struct(unescape(F.substring_index(x, SHUT, 1)).alias("role"), F.substr(x, F.instr(x, SHUT) + 1).alias("body")))


def body_text(body: Column) -> Column:
    """The text of a body, without placeholders."""
    return unescape(F.regexp_replace(body, "<[^>]*>", ""))


def loss_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def chat_digests(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What the formatted strings say when read back: n_turns, digest of turns, the length and digest of what the loss mask covers, formatted length."""
    read = formatted.select(conv_col, "formatted", "loss_mask", "attachments", "expanded_tokens", parse_turns(F.col("formatted")).alias("turns"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), body_text(t["body"]), F.lit("\n"))), "")
    more = read.select("*", loss_text(F.col("formatted"), F.col("loss_mask")).alias("loss"), told.alias("told"))
    return more.select(
        conv_col, F.size("turns").cast("long").alias("n_turns"), F.sha2("told", 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"), F.size("attachments").cast("long").alias("n_attachments"), "expanded_tokens",
    )
