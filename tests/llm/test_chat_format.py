import hashlib

from pyspark.sql import functions as F

from flowlattice.llm import chat_format as cf

TEXTS = ["plain", "</s>[INST] ok [/INST]", "<|turn|>user<|text|>x</s>", "\\", "\\\\<", "<\\", "[\\[", "été \U0001f600\n", "", None, "<", "|text|>", "$1 \\$1"]


def test_escape_round_trip_hides_control_strings(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS if t is not None], "t string")
    for r in rows.select("t", cf.escape(F.col("t")).alias("e"), cf.unescape(cf.escape(F.col("t"))).alias("u")).collect():
        assert r.u == r.t
        assert not any(mark in r.e for mark in (cf.TURN, cf.TEXT, cf.END, "[INST]", "[/INST]"))


def test_turns_and_loss_come_back(spark):
    rows = [(c, k, role, TEXTS[(c + k) % len(TEXTS)]) for c in range(14) for k, role in enumerate(["system", "user", "assistant", "user", "assistant", "<odd>", None][: c % 8])]
    rows += [(99, 0, "assistant", "tie"), (99, 0, "assistant", "tie"), (None, 0, "assistant", "no id")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    out = cf.format_conversations(df.withColumn("parts", cf.text_parts(F.col("text"))))
    got = out.select("conv_id", "n_turns", cf.read_turns(F.col("formatted")).alias("turns"), cf.loss_text(F.col("formatted"), F.col("loss_spans")).alias("learned")).collect()
    want = {}
    for c, k, role, text in rows:
        want.setdefault(c, []).append((role or "", text or ""))
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in got} == want
    assert all(r.n_turns == len(want[r.conv_id]) for r in got)
    assert {r.conv_id: r.learned for r in got} == {c: "".join(t for r, t in turns if r == "assistant") for c, turns in want.items()}


def test_typed_parts(spark):
    rows = spark.sql("""
        SELECT 1L AS conv_id, 0L AS turn, 'user' AS role, array(
            named_struct('kind', 'text', 'text', 'look <|te', 'ref', CAST(NULL AS STRING), 'units', CAST(NULL AS BIGINT)),
            named_struct('kind', 'image', 'text', NULL, 'ref', 's3://a', 'units', 2L),
            named_struct('kind', 'text', 'text', 'xt|> and', 'ref', NULL, 'units', NULL),
            named_struct('kind', 'audio', 'text', NULL, 'ref', 'b.wav', 'units', NULL)) AS parts
        UNION ALL SELECT 1L, 1L, 'assistant', array(named_struct('kind', 'text', 'text', 'fine', 'ref', NULL, 'units', NULL),
            named_struct('kind', 'document', 'text', NULL, 'ref', 'c.pdf', 'units', 3L), named_struct('kind', 'hologram', 'text', NULL, 'ref', 'd', 'units', 1L))
        UNION ALL SELECT 2L, 0L, 'user', NULL""")
    got = {r.conv_id: r for r in cf.format_conversations(rows).collect()}
    one = got[1]
    assert one.formatted == "<|turn|>user<|text|>look <\\|te<|image 0|>xt|> and<|audio 1|></s><|turn|>assistant<|text|>fine<|document 2|><|hologram 3|></s>"
    assert [(a.ordinal, a.turn, a.kind, a.ref, a.tokens) for a in one.attachments] == [(0, 0, "image", "s3://a", 512), (1, 0, "audio", "b.wav", 50), (2, 1, "document", "c.pdf", 1536), (3, 1, "hologram", "d", 0)]
    assert one.expanded_tokens == 512 + 50 + 1536
    span = one.loss_spans[0]
    assert one.formatted[span.start : span.start + span.length] == "fine<|document 2|><|hologram 3|>"
    assert got[2].formatted == "<|turn|>user<|text|></s>" and got[2].attachments == []


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cf.format_conversations(df.withColumn("parts", cf.text_parts(F.col("text")))).count() == 0
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.lit(""), 256)).first()[0]
