"""Chat formatting with typed content parts, by DataFrame functions only.

A conversation is a set of turns; a turn has a role and a list of parts (text, image, audio,
document). The visitor `visited` flattens the parts, in their order, into one text: text parts are
escaped, any other part becomes a placeholder numbered by turn and part, and is recorded as an
attachment with its reference and the tokens it will expand to. `formatted` puts the turns of a
conversation between markers, and records where each turn's text lies and whether loss is taken
there. `read_back` takes a formatted text apart again by these records.

Escapes: backslash, `<` and `#` become backslash and b, l or h (and a role's line feeds backslash
and n), so that no marker, header or placeholder can arise from a text, and every backslash begins
one escape. Unescaping replaces them in the reverse order.

A conversation's turns are first put together in blocks of BLOCK turn numbers, then the blocks, so
that a conversation with very many turns is formatted by several tasks; only its blocks meet at
last. A formatted conversation is one row, as a training example must be, so it must fit in one.

Turns are in the order of `turn` (null first), then role, then escaped content: repeated rows and ties stay,
one after the other. Null text, role or parts count as empty; a part of unknown type, or none,
becomes a placeholder of kind `part` without tokens. An empty table gives no conversation. Extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import require

PART = "struct<type string, text string, ref string, width int, height int, seconds double, pages int>"
#: Turn numbers whose turns are put together first.
BLOCK = 256
BEGIN, END = "<turn>", "</turn>"
#: Pixels across that one token of an image covers, and tokens of a second of audio and of a page.
PATCH, A_SECOND, A_PAGE = 28, 25, 512


def escaped(c: Column) -> Column:
    out = F.coalesce(c, F.lit(""))
    for sign, code in (("\\", "\\b"), ("<", "\\l"), ("#", "\\h")):
        out = F.replace(out, F.lit(sign), F.lit(code))
    return out


def unescaped(c: Column) -> Column:
    for sign, code in (("#", "\\h"), ("<", "\\l"), ("\\", "\\b")):
        c = F.replace(c, F.lit(code), F.lit(sign))
    return c


def tokens_of(part: Column) -> Column:
    """The tokens a part that is no text expands to; sizes that are null or not positive give none."""
    across = lambda c: F.ceil(F.greatest(F.coalesce(part[c], F.lit(0)), F.lit(0)) / PATCH)
    return (
        F.when(part["type"] == "image", across("width") * across("height"))
        .when(part["type"] == "audio", F.ceil(F.greatest(F.coalesce(part["seconds"], F.lit(0.0)), F.lit(0.0)) * A_SECOND))
        .when(part["type"] == "document", F.greatest(F.coalesce(part["pages"], F.lit(0)), F.lit(0)) * A_PAGE)
        .otherwise(0)
        .cast("long")
    )


def visited(df: DataFrame, parts: str = "parts") -> DataFrame:
    """Adds content (text of all parts, escaped, with placeholders `<kind k>`, k from 0 within the turn) and attachments (kind, ref, place: k, tokens)."""
    kind = lambda p: F.when(p["type"].isin("image", "audio", "document"), p["type"]).otherwise("part")
    is_text = lambda p: F.coalesce(p["type"] == "text", F.lit(False))
    listed = F.coalesce(F.col(parts), F.expr(f"CAST(array() AS array<{PART}>)"))
    others = F.filter(listed, lambda p: ~is_text(p))
    attachments = F.transform(others, lambda p, k: F.struct(kind(p).alias("kind"), p["ref"].alias("ref"), k.alias("place"), tokens_of(p).alias("tokens")))
    before = lambda k: F.size(F.filter(F.slice(listed, F.lit(1), k), lambda p: ~is_text(p)))
    content = F.transform(listed, lambda p, k: F.when(is_text(p), escaped(p["text"])).otherwise(F.concat(F.lit("<"), kind(p), F.lit(" "), before(k).cast("string"), F.lit(">"))))
    return df.withColumns({"content": F.array_join(content, ""), "attachments": attachments})


def text_part(text: Column) -> Column:
    """A turn's parts if it is nothing but text."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *(F.lit(None).cast(t).alias(c) for c, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int")))))


def parts_of_json(content: Column) -> Column:
    """A turn's parts from a JSON list of objects with PART's fields; null where it is none."""
    return F.from_json(content, f"array<{PART}>")


def _head(role: Column) -> Column:
    return F.concat(F.lit(f"{BEGIN}#"), F.replace(escaped(role), F.lit("\n"), F.lit("\\n")), F.lit("\n"))


def formatted(turns: DataFrame, loss: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, text, spans (of each turn the code points before its content, of it, and behind it, and whether loss is taken on it), attachments (turn: from 0, kind, ref, place, tokens), n_tokens_attached.

    turns: conv_id, turn, role, parts. A turn reads `<turn>#role`, line feed, content, `</turn>`, line feed; the spans together cover the text, so that they are its loss mask in run lengths."""
    require(turns, ("conv_id", "turn", "role", "parts"), "chat formatting")
    rows = visited(turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), "parts"))
    block = rows.groupBy("conv_id", F.floor(F.col("turn") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "content", "attachments"))).alias("pieces"))
    put = block.select(
        "conv_id",
        "block",
        F.array_join(F.transform("pieces", lambda p: F.concat(_head(p["role"]), p["content"], F.lit(f"{END}\n"))), "").alias("text"),
        F.transform("pieces", lambda p: F.struct(F.char_length(_head(p["role"])).alias("before"), F.char_length(p["content"]).alias("length"), F.lit(len(END) + 1).alias("behind"), p["role"].isin(*loss).alias("loss"))).alias("spans"),
        F.col("pieces.attachments").alias("attachments"),
    )
    one = put.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "text", "spans", "attachments"))).alias("blocks"))
    attached = F.transform(F.flatten("blocks.attachments"), lambda a, k: F.transform(a, lambda x: F.struct(k.alias("turn"), *(x[c].alias(c) for c in ("kind", "ref", "place", "tokens")))))
    whole = one.select("conv_id", F.array_join("blocks.text", "").alias("text"), F.flatten("blocks.spans").alias("spans"), F.flatten(attached).alias("attachments"))
    return whole.withColumn("n_tokens_attached", F.reduce("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def read_back(conversations: DataFrame) -> DataFrame:
    """Adds turns (role, text: unescaped, with its placeholders, loss), taken from text and spans alone. Null where they don't fit each other."""
    pieces = F.slice(F.split("text", BEGIN), 2, F.greatest(F.size("spans"), F.lit(1)))  # no text holds the marker

    def turn(piece: Column, k: Column) -> Column:
        span = F.get(F.col("spans"), k)
        content = F.substring(piece, span["before"] - len(BEGIN) + 1, span["length"])
        role = unescaped(F.replace(F.substring_index(F.substring(piece, 2, span["before"] - len(BEGIN)), "\n", 1), F.lit("\\n"), F.lit("\n")))
        return F.struct(role.alias("role"), unescaped(content).alias("text"), span["loss"].alias("loss"), (F.char_length(piece) + len(BEGIN) == span["before"] + span["length"] + span["behind"]).alias("fits"))

    read = conversations.withColumn("turns", F.transform(pieces, turn))
    fits = F.forall("turns", lambda t: t["fits"]) & (F.size("turns") == F.size("spans"))
    return read.withColumn("turns", F.when(fits, F.transform("turns", lambda t: t.dropFields("fits"))))


def digests(conversations: DataFrame) -> DataFrame:
    """Of what formatted returns, read back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    back = read_back(conversations)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = back.withColumn("__loss", F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), ""))
    return learnt.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("__loss").cast("long").alias("loss_chars"),
        F.sha2("__loss", 256).alias("loss_sha256"),
        F.char_length("text").cast("long").alias("formatted_chars"),
    )
