"""Chat formatting: round trips of odd texts and typed parts, the loss mask, attachments."""

import hashlib

from pyspark.sql import functions as F

from alignkit.llm import chat_format
from alignkit.llm.chat_format import Template

ODD = [(1, 0, "user", None), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (2, 5, "system", "\\[INST]\\\\</s>\\"), (2, None, None, "[\\INST] <|image|>\n"), (2, 7, "assistant", ""), (2, 9, "as</s>[/INST]", "x" * 100000), (3, 1, "user", "é😀[INST"), (None, 1, "assistant", "lost <</SYS>>"), (None, 0, "user", "<s><s></s")]


def turns(spark):
    return spark.createDataFrame(ODD, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS segments", "'p' AS pieces", "2 AS t")


def test_report_reads_back_what_was_said(spark):
    chats = {}
    for c, t, role, text in ODD:
        chats.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    got = {r.conv_id: r for r in chat_format.report(turns(spark)).collect()}
    assert set(got) == set(chats)
    for c, rows in chats.items():
        rows, r = sorted(rows), got[c]
        said, loss = "".join(f"{x[2]}\n{x[3]}\n" for x in rows), "".join(x[3] for x in rows if x[2] == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(rows), digest(said), len(loss), digest(loss))
    assert chat_format.report(turns(spark).limit(0)).count() == 0


def test_no_control_string_is_left_in_a_text(spark):
    template = Template()
    chats = chat_format.format_chats(turns(spark).withColumn("parts", chat_format.text_part()), template)
    for r in chats.select(chat_format.formatted().alias("f"), F.size("segments").alias("n")).collect():
        marks = r.n // 3
        assert [r.f.count(c) for c in template.controls] == [marks, marks, marks] + [0] * (len(template.controls) - 3)


PARTS = [
    (1, 0, "user", [("text", "see <|image|> and", None, None, None, None, None), ("image", None, "a.png", 28, 15, None, None), ("audio", "ignored", "b.wav", None, None, 2.01, None), ("text", " here", None, None, None, None, None), ("text", "!", None, None, None, None, None)]),
    (1, 1, "assistant", [("document", None, "c.pdf", None, None, None, 3), ("image", None, None, None, None, None, None), ("odd", "kept", "r", None, None, None, None), (None, None, None, None, None, None, None)]),
    (2, 0, "user", []), (2, 1, "user", None),
]


def test_typed_parts_become_placeholders_in_order(spark):
    typed = spark.createDataFrame(PARTS, f"conv_id long, turn long, role string, parts array<{chat_format.PART}>")
    chats = chat_format.format_chats(typed)
    one, two = chats.orderBy("conv_id").collect()
    assert [tuple(a) for a in one.attachments] == [(0, "image", "a.png", 4), (0, "audio", "b.wav", 51), (1, "document", "c.pdf", 768), (1, "image", None, 1)]
    assert one.expanded_tokens == 824 and (two.attachments, two.expanded_tokens) == ([], 0)
    assert "".join(s.text for s in one.segments) == "[INST]user[/INST]see <\\|image|> and<|image|><|audio|> here!</s>[INST]assistant[/INST]<|document|><|image|>kept</s>"
    assert [s.text for s in one.segments if s.loss] == ["<|document|><|image|>kept"]
    parts = chat_format.read_turns(chats).select("conv_id", F.posexplode("turns")).select("conv_id", "pos", chat_format.read_parts(F.col("col.content")).alias("parts"))
    read = {(r.conv_id, r.pos): [tuple(p) for p in r.parts] for r in parts.collect()}
    assert read[1, 0] == [("text", "see <|image|> and"), ("image", None), ("audio", None), ("text", " here!")]
    assert read[1, 1] == [("document", None), ("image", None), ("text", "kept")] and read[2, 0] == read[2, 1] == []


def test_another_template(spark):
    template = Template(head="<|start|>", body="<|message|>", tail="<|end|>", loss_roles=("user", "assistant"), more=())
    rows = chat_format.report(spark.createDataFrame([(1, 0, "user", "<|end|>a"), (1, 1, "assistant", "b[INST]")], "conv_id long, turn long, role string, text string"), template).collect()
    assert rows[0].loss_sha256 == hashlib.sha256(b"<|end|>ab[INST]").hexdigest() and rows[0].n_turns == 2


def test_no_python_in_the_plan(spark):
    plan = chat_format.report(turns(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
