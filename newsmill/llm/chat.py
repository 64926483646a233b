"""Chat formatting of typed content parts, with DataFrame functions only.

Template: a turn is `### Role: ` + content + `</turn>` + newline; the roles user, assistant and system are written with a
capital, others as they are. Inside texts and roles a backslash goes before what could be taken for a control
string: `\\` itself, `#`, the `/` of `</` and the `|` of `<|` (in roles `:` too); dropping the backslashes gives the text back.
An image, audio or document part is visited as its placeholder `<|image|>`, `<|audio|>` or `<|document|>` (any other type:
`<|file|>`); the placeholders of a conversation and its attachments have the same order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
END = "</turn>\n"
#: Pixels of an image patch's side, audio tokens a second, tokens of a document's page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 256
_NAMES = {"user": "User", "assistant": "Assistant", "system": "System"}


def escaped(text: Column) -> Column:
    for plain, safe in (("\\", "\\\\"), ("#", "\\#"), ("</", "<\\/"), ("<|", "<\\|")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def role_header(role: Column) -> Column:
    own = F.replace(escaped(role), F.lit(":"), F.lit("\\:"))
    header = F.when(own.isin(*_NAMES.values()), F.concat(F.lit("\\"), own)).otherwise(own)
    for name, shown in _NAMES.items():
        header = F.when(role == name, shown).otherwise(header)
    return header


def role_of(header: Column) -> Column:
    found = unescaped(header)
    for name, shown in _NAMES.items():
        found = F.when(header == shown, name).otherwise(found)
    return found


def tokens_of(part: Column) -> Column:
    """Tokens that a placeholder stands for; one where the size is not known."""
    side = lambda x: F.ceil(part[x] / PATCH)
    count = (
        F.when(part["type"] == "image", side("width") * side("height"))
        .when(part["type"] == "audio", F.ceil(part["seconds"] * AUDIO_RATE))
        .when(part["type"] == "document", part["pages"].cast("long") * PAGE_TOKENS)
    )
    return F.greatest(F.coalesce(count, F.lit(1)).cast("long"), F.lit(1).cast("long"))


def visited(part: Column) -> Column:
    """A part flattened: escaped text, or a placeholder."""
    kind = F.when(part["type"].isin("image", "audio", "document"), part["type"]).otherwise("file")
    return F.when(F.coalesce(part["type"], F.lit("text")) == "text", escaped(F.coalesce(part["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), kind, F.lit("|>")))


def format_chats(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, n_turns, loss_spans, attachments, expanded_tokens) of messages(conv_id, turn, role, parts array<PART>).

    loss_spans: (start, length) in code points of each assistant content; attachments: (type, ref, tokens) in order.
    Rows go by turn, null first, then by role and parts as they are; repeated rows are turns of their own. A null conv_id is
    a conversation, a null role an empty one, null parts none. A part of null type is text.
    """
    parts = F.coalesce("parts", F.expr(f"cast(array() as array<{PART}>)"))
    said = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), parts.alias("parts"))
    chats = messages.select("conv_id", said.alias("said")).groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("said"))
    written_out = lambda t: F.struct(
        t["role"].alias("role"),
        F.concat(F.lit("### "), role_header(t["role"]), F.lit(": ")).alias("head"),
        F.array_join(F.transform(t["parts"], visited), "").alias("body"),
        F.transform(F.filter(t["parts"], lambda p: p["type"].isNotNull() & (p["type"] != "text")), lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), tokens_of(p).alias("tokens"))).alias("attached"),
    )
    sized = lambda t: F.struct(*(t[x].alias(x) for x in ("role", "head", "body", "attached")), (F.length(t["head"]) + F.length(t["body"]) + len(END)).cast("long").alias("size"))
    chats = chats.select("conv_id", F.transform("said", written_out).alias("turns")).select("conv_id", F.transform("turns", sized).alias("turns"))
    # a fold keeps the place at which each content begins
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:long,length:long>>)").alias("spans"))
    step = lambda acc, t: F.struct(
        (acc["at"] + t["size"]).alias("at"),
        F.when(t["role"] == "assistant", F.array_append(acc["spans"], F.struct((acc["at"] + F.length(t["head"])).alias("start"), F.length(t["body"]).cast("long").alias("length")))).otherwise(acc["spans"]).alias("spans"),
    )
    attached = F.flatten(F.transform("turns", lambda t: t["attached"]))
    return chats.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"),
        F.size("turns").cast("long").alias("n_turns"),
        F.aggregate("turns", zero, step)["spans"].alias("loss_spans"),
        attached.alias("attachments"),
        F.aggregate(attached, F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("expanded_tokens"),
    )


def read_chats(chats: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>, loss_text, formatted, attachments, expanded_tokens); turns and loss_text are read back from formatted and loss_spans alone."""
    pieces = F.split("formatted", END)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    # possessive: no way back is kept a character, so a header may be of any length
    pattern = r"(?s)^### ((?:[^:\\]++|\\.)*+): (.*+)$"
    turns = F.transform(pieces, lambda p: F.struct(role_of(F.regexp_extract(p, pattern, 1)).alias("role"), unescaped(F.regexp_extract(p, pattern, 2)).alias("text")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return chats.select("conv_id", turns.alias("turns"), loss.alias("loss_text"), "formatted", "attachments", "expanded_tokens")


def text_messages(rows: DataFrame) -> DataFrame:
    """Messages of one text part each from rows(conv_id, turn, role, text)."""
    part = F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), *(F.lit(None).cast(t).alias(n) for n, t in (("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))))
    return rows.select("conv_id", "turn", "role", F.array(part).alias("parts"))


CONTROL = "\\### Assistant: </turn> ok"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: all conversations and one of control strings, formatted, written, read back and digested."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(CONTROL).alias("text")) for i, r in enumerate(("user", "assistant"))])).alias("r")).select("r.*")
    chats = written(format_chats(text_messages(rows.unionByName(extra))), "chats")
    back = read_chats(chats)
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"),
        F.col("expanded_tokens"),
    )


SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(14 + length(role) + length(replace(replace(replace(replace(text, '\', '\\'), '#', '\#'), '</', '<\/'), '<|', '<\|')))::BIGINT AS formatted_chars,
  0::BIGINT AS n_attachments, 0::BIGINT AS expanded_tokens
FROM said GROUP BY conv_id
"""
