"""Chat formatting over typed content parts.

A visitor turns each part into text: text parts are escaped, image, audio and document parts become numbered
placeholders, and each attachment is recorded with its reference and the tokens its placeholder expands to. The
template marks turns; a reader restores turns and parts from the formatted text alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
#: Strings that mean something to a template or a tokenizer, this one's marks included through "<|".
CONTROL = ("<|", "</s>", "<s>", "<unk>", "<pad>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<bos>", "<eos>", "<start_of_turn>", "<end_of_turn>", "<|endoftext|>")
KINDS = ("image", "audio", "document")
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Pixels of a square patch, tokens a second, tokens a page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 512


def escaped(c):
    """Column expression: backslashes are doubled, then one is set after the first character of each control string."""
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for s in CONTROL[:-1]:
        c = F.replace(c, F.lit(s), F.lit(s[0] + "\\" + s[1:]))
    return c


def unescape(s: str) -> str:
    return re.sub(r"(?s)\\(.)", r"\1", s)


def expanded_tokens(p):
    """Tokens a placeholder stands for; unknown measures count as one unit, and the two marks are counted too."""
    one = lambda c: F.greatest(F.coalesce(c, F.lit(1)), F.lit(1))
    patches = F.ceil(one(p["width"]) / PATCH) * F.ceil(one(p["height"]) / PATCH)
    n = (F.when(p["kind"] == "image", patches).when(p["kind"] == "audio", F.ceil(F.greatest(F.coalesce(p["seconds"], F.lit(0.0)), F.lit(0.0)) * AUDIO_RATE))
         .otherwise(one(p["pages"]) * PAGE_TOKENS))
    return (n + 2).cast("long")


def format_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """One row per turn: conv_id, turn, role, segment, attachments; a conversation's text is its segments in order.

    ``parts`` is an array of ``PART``. A null role, null parts, a null part, a null text or an unknown kind without text
    count as empty; an unknown kind with text counts as text. ``attachments`` lists (number within the turn, kind, ref,
    tokens). The turn's segment is row-local, so a conversation of any size needs no group to be formatted.
    """
    kept = F.filter(F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    media = F.filter(kept, lambda p: p["kind"].isin(*KINDS))
    # a media part's number is how many media parts precede it, so parts are folded in order
    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("n"))
    flat = F.aggregate(
        kept, start,
        lambda a, p: F.when(
            p["kind"].isin(*KINDS),
            F.struct(F.concat(a["s"], F.lit("<|"), p["kind"], F.lit(":"), a["n"].cast("string"), F.lit("|>")).alias("s"), (a["n"] + 1).alias("n")),
        ).otherwise(F.struct(F.concat(a["s"], escaped(F.coalesce(p["text"], F.lit("")))).alias("s"), a["n"].alias("n"))))
    listed = F.transform(media, lambda p, i: F.struct(i.alias("number"), p["kind"].alias("kind"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens")))
    return turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.concat(F.lit(TURN), escaped(F.coalesce(F.col(role), F.lit(""))), F.lit(BODY), flat["s"], F.lit(END)).alias("segment"),
        listed.alias("attachments"))


_MARK = re.compile(r"<\|(" + "|".join(KINDS) + r"):(\d+)\|>")


def read_segment(segment: str) -> tuple[str, list[tuple[str, object]]]:
    """(role, parts) of one turn; parts are ("text", str) or (kind, number)."""
    if not (segment.startswith(TURN) and segment.endswith(END)):
        raise ValueError("not a turn")
    role, _, body = segment[len(TURN) : -len(END)].partition(BODY)
    parts, at = [], 0
    for m in _MARK.finditer(body):
        if m.start() > at:
            parts.append(("text", unescape(body[at : m.start()])))
        parts.append((m[1], int(m[2])))
        at = m.end()
    if at < len(body):
        parts.append(("text", unescape(body[at:])))
    return unescape(role), parts


def split_turns(formatted: str) -> list[str]:
    """The segments of a formatted conversation; an escaped text never holds the end mark."""
    out, at = [], 0
    while at < len(formatted):
        end = formatted.index(END, at) + len(END)
        out.append(formatted[at:end])
        at = end
    return out


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, loss_turns long"


class _Reader:
    """Reads one conversation back, turn by turn, in constant memory."""

    def __init__(self, conv) -> None:
        self.conv, self.turns, self.loss_turns, self.loss_chars, self.chars = conv, 0, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def take(self, segment: str) -> None:
        for one in split_turns(segment):
            role, parts = read_segment(one)
            text = "".join(x if kind == "text" else f"<{kind} {x}>" for kind, x in parts)
            self.turns += 1
            self.chars += len(one)
            self.all.update(f"{role}\n{text}\n".encode())
            if role == "assistant":
                self.loss_turns += 1
                self.loss_chars += len(text)
                self.loss.update(text.encode())

    def row(self) -> tuple:
        return (self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.loss_turns)


def _read_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in DIGEST.split(", ")]
    kinds = [pa.string() if x.endswith("string") else pa.int64() for x in DIGEST.split(", ")]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    now, rows = None, []
    for b in batches:
        for conv, segment in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if now is None or now.conv != conv:
                if now:
                    rows.append(now.row())
                now = _Reader(conv)
            now.take(segment)
        if len(rows) >= 10_000:
            yield batch(rows)
            rows = []
    if now:
        rows.append(now.row())
    if rows:
        yield batch(rows)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digest of each conversation, read from its segments in order of turn.

    Turns with equal numbers follow by role and segment; null numbers come first; rows without conv_id are one
    conversation. The digests are sequential, so a conversation is read by one task, as a stream of turns in constant
    memory; attachments read as ``<kind number>``.
    """
    rows = formatted.select("conv_id", "segment", "turn", "role").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "segment")
    return rows.select("conv_id", "segment").mapInArrow(_read_sorted, DIGEST)


def text_parts(text):
    """A plain text as an array of one text part."""
    null = F.lit(None)
    return F.array(F.struct(
        F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), null.cast("string").alias("ref"), null.cast("int").alias("width"),
        null.cast("int").alias("height"), null.cast("double").alias("seconds"), null.cast("int").alias("pages")))
