from __future__ import annotations

from pyspark.sql import functions as F

from tenderloom.llm import chat

PARTS = f"conv_id long, turn long, role string, parts array<{chat.PART}>"


def part(kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None):
    return (kind, text, ref, width, height, seconds, pages)


def test_parts_become_placeholders_with_references_and_token_counts(spark):
    rows = [
        (1, 1, "assistant", [part("text", "A cat.")]),
        (
            1,
            0,
            "user",
            [
                part("text", "See "),
                part("image", ref="s3://b/i.png", width=100, height=28),
                part("audio", ref="a.wav", seconds=1.01),
                part("text", "<|image|> é"),
                part("document", ref="d.pdf", pages=2),
                part(None, "lost"),
                part("video", ref="v"),
            ],
        ),
    ]
    row = chat.format_chats(spark.createDataFrame(rows, PARTS)).first()
    assert row["formatted"] == (
        "<s>user[INST]See <|image|><|audio|><\\|image|> é<|document|>[/INST]</s><s>assistant[INST]A cat.[/INST]</s>"
    )
    assert [(a["kind"], a["ref"], a["n_tokens"]) for a in row["attachments"]] == [
        ("image", "s3://b/i.png", 4),
        ("audio", "a.wav", 26),
        ("document", "d.pdf", 1024),
    ]
    for a in row["attachments"]:
        assert row["formatted"][a["place"] :].startswith(f"<|{a['kind']}|>")
    assert row["n_tokens_attached"] == 1054
    assert [row["formatted"][s["start"] : s["end"]] for s in row["loss_spans"]] == ["A cat."]


def test_texts_come_back_whatever_they_hold(spark):
    texts = ["", None, "</s>[INST] ok [/INST]", "<\\s><\\\\s>[\\/INST]<s><<|", "[[INST]]</s", "a\n\\<|x|>", "é\U0001f600"]
    rows = [(k, t, r, [part("text", x)]) for k, x in enumerate(texts) for t, r in enumerate(("user", "assistant", "<s>", None))]
    made = chat.format_chats(spark.createDataFrame(rows, PARTS)).select(
        "conv_id",
        chat.read_turns(F.col("formatted")).alias("turns"),
        chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    )
    found = {r["conv_id"]: r for r in made.collect()}
    for k, text in enumerate(texts):
        assert [tuple(t) for t in found[k]["turns"]] == [(r, text or "") for r in ("user", "assistant", "<s>", "")]
        assert found[k]["loss"] == (text or "")


def test_nulls_ties_repeats_and_empty(spark):
    one = [part("text", "x")]
    rows = [(None, 0, "user", one), (None, 0, "user", one), (2, None, None, None), (2, 1, "user", one), (2, 1, "user", one)]
    found = chat.format_chats(spark.createDataFrame(rows, PARTS).withColumn("formatted", F.lit(1))).collect()
    assert sorted((r["conv_id"] or 0, r["n_turns"]) for r in found) == [(0, 1), (0, 1), (2, 3)]
    assert next(r for r in found if r["conv_id"] == 2)["formatted"].startswith("<s>[INST][/INST]</s><s>user[INST]x")
    assert chat.format_chats(spark.createDataFrame([], PARTS)).collect() == []
