import hashlib

import duckdb
from pyspark.sql import functions as F

from newsmill.llm import chat

from .helpers import folder

ROWS = "conv_id long, turn long, role string, text string, formatted string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows):
    by = {}
    for conv, turn, role, text in [*rows, (-7, 0, "user", chat.CONTROL), (-7, 1, "assistant", chat.CONTROL)]:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        out[conv] = (len(turns), digest("".join(f"{r}\n{t}\n" for *_, r, t in turns)), len(loss), digest(loss))
    return out


def test_odd_rows(spark, tmp_path):
    rows = [
        (1, 0, "user", "### User: </turn>\n<|image|> \\ \\\\ <\\/turn>", "x"), (1, 1, "assistant", "</turn>\n### Assistant: hi\n", None), (1, 2, "Assistant", "not the role", None), (1, 3, "tool: a\\b", "<", None),
        (2, None, None, None, None), (2, 0, "assistant", "\\", None), (2, 0, "assistant", "\\", None), (2, 0, "assistant", "é🙂", None),
        (None, 1, "system", "", None), (3, 0, "</turn>\n", "### ", "y"), (3, 1, "", ": #", None),
    ]
    d = folder(tmp_path, conversations=spark.createDataFrame(rows, ROWS))
    found = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.query(spark, d).collect()}
    assert found == brute([r[:4] for r in rows])


def test_empty(spark, tmp_path):
    d = folder(tmp_path, conversations=spark.createDataFrame([], ROWS))
    assert [r.conv_id for r in chat.query(spark, d).collect()] == [-7]


def test_parts(spark):
    parts = "array(" + ", ".join([
        "named_struct('type','text','text','see <|image|>','ref',null,'width',null,'height',null,'seconds',null,'pages',null)",
        "named_struct('type','image','text',null,'ref','a.png','width',56,'height',29,'seconds',null,'pages',null)",
        "named_struct('type','audio','text',null,'ref','b.wav','width',null,'height',null,'seconds',1.5D,'pages',null)",
        "named_struct('type','document','text',null,'ref','c.pdf','width',null,'height',null,'seconds',null,'pages',2)",
        "named_struct('type','video','text',null,'ref','d','width',null,'height',null,'seconds',null,'pages',null)",
    ]) + ")"
    rows = spark.range(1).select(F.lit(1).cast("long").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), F.expr(parts).cast(f"array<{chat.PART}>").alias("parts"))
    row = chat.format_chats(rows).first()
    assert row.formatted == "### User: see <\\|image|><|image|><|audio|><|document|><|file|></turn>\n"
    assert [tuple(a) for a in row.attachments] == [("image", "a.png", 4), ("audio", "b.wav", 38), ("document", "c.pdf", 512), ("video", "d", 1)]
    assert row.expanded_tokens == 555 and row.loss_spans == []


def test_long_roles_and_texts_and_ties(spark, tmp_path):
    rows = [
        (1, 0, "r" * 1_000_000, "t" * 2_000_000, None), (2, 0, "\\:#</<|" * 100_000, "\\#</turn>\n<|x|>" * 100_000, None), (3, 0, "assistant", "#b", None), (3, 0, "assistant", "$a", None), (3, 0, "assistant", "[", None),
        (3, 0, "assistant", "\\", None), (3, 0, "assistant", "<|", None), (3, 0, "assistant", "<}", None),
    ]
    d = folder(tmp_path, conversations=spark.createDataFrame(rows, ROWS))
    found = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.query(spark, d).collect()}
    assert found == brute([r[:4] for r in rows])


def test_attachments_of_parts_are_read_back(spark):
    image = "named_struct('type','image','text',null,'ref',concat('p', id),'width',28,'height',56,'seconds',null,'pages',null)"
    text = "named_struct('type','text','text','# look: ','ref',null,'width',null,'height',null,'seconds',null,'pages',null)"
    rows = spark.range(3).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.expr(f"array({text}, {image}, {image})").cast(f"array<{chat.PART}>").alias("parts"))
    row = chat.read_chats(chat.format_chats(rows)).first()
    assert [a.ref for a in row.attachments] == ["p0", "p0", "p1", "p1", "p2", "p2"] and row.expanded_tokens == 12
    assert row.formatted.count("<|image|>") == 6 and row.loss_text == "# look: <|image|><|image|>" * 3


def test_sql_puts_rows_without_a_turn_first_too(spark, tmp_path):
    rows = [(1, 2, "user", "b # </x>", None), (1, None, "user", "a <| \\", None), (1, None, "assistant", "yes", None), (1, 0, "assistant", None, None), (None, 0, "system", "", None)]
    d = folder(tmp_path, conversations=spark.createDataFrame(rows, ROWS))
    found = sorted(map(tuple, chat.query(spark, d).collect()), key=str)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{d}/conversations.parquet')")
    assert found == sorted(con.execute(chat.SQL).fetchall(), key=str)
