"""Chat formatting with typed content parts, in DataFrame operations only.

A turn's content is a list of parts: text, image, audio or document. A visitor turns each part into a
piece of the formatted text: texts with their control strings escaped, the others as placeholders in
order, with a record of the attachment they refer to and of the tokens they expand to. A conversation
becomes a list of segments, each with its loss flag; the segments in order are the formatted text.

Escapes put a backslash into control strings and double those that are there, so no control string
is left in a text, and taking each backslash off again restores it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

# What a content part holds; sizes are null where unknown.
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ATTACHMENTS = ("image", "audio", "document")


@dataclass(frozen=True)
class Template:
    """Marks of a turn: ``head`` role ``body`` content ``tail``; roles whose content is under the loss;
    other control strings that texts must not hold."""

    head: str = "[INST]"
    body: str = "[/INST]"
    tail: str = "</s>"
    loss_roles: tuple[str, ...] = ("assistant",)
    more: tuple[str, ...] = ("<s>", "<unk>", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")

    def placeholder(self, kind: str) -> str:
        return f"<|{kind}|>"

    @property
    def controls(self) -> list[str]:
        """All control strings. None holds a backslash, and none begins inside another."""
        return [self.head, self.body, self.tail, *self.more, *map(self.placeholder, ATTACHMENTS)]

    def escape(self, text: Column) -> Column:
        out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        for c in self.controls:
            out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
        return out

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, r"(?s)\\(.)", "$1")


class PartVisitor:
    """Turns a part into ``struct(piece, kind, ref, tokens)``; kind is null for texts.

    An image expands to a token for each patch of ``patch`` pixels a side, a recording to
    ``audio_rate`` tokens a second, a document to ``page_tokens`` a page, each at least one. A part of
    another kind counts as its text.
    """

    def __init__(self, template: Template, patch: int = 14, audio_rate: float = 25.0, page_tokens: int = 256):
        self.template, self.patch, self.audio_rate, self.page_tokens = template, patch, audio_rate, page_tokens

    def text(self, part: Column) -> Column:
        return self._piece(self.template.escape(F.coalesce(part["text"], F.lit(""))), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(0))

    def image(self, part: Column) -> Column:
        across, down = (F.ceil(part[c] / self.patch) for c in ("width", "height"))
        return self._attached("image", part, across * down)

    def audio(self, part: Column) -> Column:
        return self._attached("audio", part, F.ceil(part["seconds"] * self.audio_rate))

    def document(self, part: Column) -> Column:
        return self._attached("document", part, part["pages"] * self.page_tokens)

    def visit(self, part: Column) -> Column:
        out = F
        for kind in ATTACHMENTS:
            out = out.when(part["kind"] == kind, getattr(self, kind)(part))
        return out.otherwise(self.text(part))

    def _attached(self, kind: str, part: Column, tokens: Column) -> Column:
        return self._piece(F.lit(self.template.placeholder(kind)), F.lit(kind), part["ref"], F.greatest(F.coalesce(tokens, F.lit(1)), F.lit(1)))

    def _piece(self, piece: Column, kind: Column, ref: Column, tokens: Column) -> Column:
        return F.struct(piece.alias("piece"), kind.alias("kind"), ref.alias("ref"), tokens.cast("long").alias("tokens"))


def text_part(text: str = "text") -> Column:
    """A list with one text part, for turns that are plain texts."""
    none = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()]))


def format_chats(turns: DataFrame, template: Template = Template(), visitor: PartVisitor | None = None) -> DataFrame:
    """``conv_id, segments, attachments, expanded_tokens`` for each conversation of ``turns(conv_id, turn, role, parts)``.

    ``segments``: ``struct(text, loss)`` in order; ``attachments``: ``struct(turn_at, kind, ref, tokens)``
    in order of their placeholders, turns counted from 0.

    Turns are ordered by number (nulls first), equal ones by role and content; repeated rows are turns
    like others. Null roles and lists of parts count as empty; rows with a null ``conv_id`` are one
    conversation. A conversation is one training sample and thus one row, the only group that is
    gathered; other columns are not read.
    """
    visitor = visitor or PartVisitor(template)
    seen = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.transform(F.coalesce("parts", F.array().cast(f"array<{PART}>")), visitor.visit).alias("pieces"))
    content = F.array_join(F.transform("pieces", lambda p: p["piece"]), "")
    attached = F.transform(F.filter("pieces", lambda p: p["kind"].isNotNull()), lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens")))
    rows = seen.select("conv_id", F.struct("turn", "role", content.alias("content"), attached.alias("attached")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    in_loss = lambda t: t["role"].isin(*template.loss_roles) if template.loss_roles else F.lit(False)
    segments = F.flatten(F.transform("ts", lambda t: F.array(
        segment(F.concat(F.lit(template.head), template.escape(t["role"]), F.lit(template.body)), F.lit(False)),
        segment(t["content"], in_loss(t)),
        segment(F.lit(template.tail), F.lit(False)),
    )))
    attachments = F.flatten(F.transform("ts", lambda t, i: F.transform(t["attached"], lambda a: F.struct(i.cast("long").alias("turn_at"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    out = chats.select("conv_id", segments.alias("segments"), attachments.alias("attachments"))
    total = F.aggregate(F.transform("attachments", lambda a: a["tokens"]), F.lit(0).cast("long"), lambda x, y: x + y)
    return out.withColumn("expanded_tokens", total)


def formatted(segments: str = "segments") -> Column:
    """The formatted text of a conversation."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_turns(chats: DataFrame, template: Template = Template()) -> DataFrame:
    """``conv_id, turns``: lists of ``struct(role, content)`` parsed from the formatted texts, contents
    still escaped."""
    quote = lambda s: "".join("\\" + c if not c.isalnum() else c for c in s)
    ends = F.split(formatted(), quote(template.tail))
    pieces = F.slice(ends, F.lit(1), F.size(ends) - 1)  # what follows the last turn is empty
    halves = lambda p: F.split(F.substr(p, F.lit(len(template.head) + 1)), quote(template.body), 2)
    parse = lambda p: F.struct(template.unescape(F.get(halves(p), 0)).alias("role"), F.get(halves(p), 1).alias("content"))
    return chats.select("*", F.transform(pieces, parse).alias("turns"))


def read_parts(content: Column, template: Template = Template()) -> Column:
    """A turn's escaped content as a list of ``struct(kind, text)``; texts that stood side by side are one."""
    marks = "|".join(r"<\|" + k + r"\|>" for k in ATTACHMENTS)
    pieces = F.filter(F.split(content, f"(?<={marks})|(?={marks})"), lambda p: p != "")
    kind = lambda p: F.coalesce(*[F.when(p == template.placeholder(k), F.lit(k)) for k in ATTACHMENTS], F.lit("text"))
    return F.transform(pieces, lambda p: F.struct(kind(p).alias("kind"), F.when(kind(p) == "text", template.unescape(p)).alias("text")))


def report(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """Formats plain ``turns(conv_id, turn, role, text)``, writes the result, and tells what its files hold:
    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_attachments, expanded_tokens``.

    An empty table gives no rows. For odd rows see ``format_chats``.
    """
    typed = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", text_part().alias("parts"))
    chats = materialise(format_chats(typed, template), "chats")
    read = read_turns(chats, template)
    line = lambda t: F.concat(t["role"], F.lit("\n"), template.unescape(t["content"]), F.lit("\n"))
    loss = template.unescape(F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), ""))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", line), "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.char_length(formatted()).cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"),
        "expanded_tokens",
    )

