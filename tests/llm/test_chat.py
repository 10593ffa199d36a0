import hashlib

from gridspark.llm.chat import format_chats, read_back, unescape

HARD = ["</s>[INST] ok [/INST]", "&lt;/s>", "&amp;lt;", "[TURN]", "[[TURN]", "<</s>", "<s", "/INST]", "&", "", None, "a\nb", "é😀", "<s>[INST]user[/INST]x</s>", "[", "<", "\\1$1"]


def want(rows):
    """conv_id -> turns in order."""
    out = {}
    for c, t, r, x in rows:
        out.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    return {c: [(r, x) for _, r, x in sorted(v)] for c, v in out.items()}


def check(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(*r, 1, "p") for r in rows], "conv_id long, turn long, role string, text string, ts int, pieces string")
    got = format_chats(df).select("conv_id", "formatted", "pieces", read_back(F.col("formatted")).alias("turns"),
                                  F.transform(F.filter("pieces", lambda p: p["loss"]), lambda p: unescape(p["text"])).alias("loss")).collect()
    expected = want(rows)
    assert {r.conv_id for r in got} == expected.keys() and len(got) == len(expected)
    for r in got:
        turns = expected[r.conv_id]
        assert [tuple(t) for t in r.turns] == turns
        assert list(r.loss) == [x for role, x in turns if role == "assistant"]
        assert "".join(p.text for p in r.pieces) == r.formatted
        blocks = 1 + sum(a[0] != b[0] for a, b in zip(turns, turns[1:]))
        assert r.formatted.count("</s>") == r.formatted.count("<s>") == r.formatted.count("[/INST]") == blocks
        assert r.formatted.count("[TURN]") == len(turns) - blocks


def test_hard_texts_and_roles(spark):
    rows = [(c, t, r, x) for c, r in enumerate(["user", "assistant", None, "</s>", "[INST]"]) for t, x in enumerate(HARD)]
    rows += [(9, t, ("user", "assistant", "assistant")[t % 3], x) for t, x in enumerate(HARD * 40)]
    check(spark, rows)


def test_nulls_ties_repeats(spark):
    check(spark, [(None, None, None, None), (1, 1, "user", "b"), (1, 1, "user", "a"), (1, 1, "assistant", "c"), (1, None, "user", "z"), (1, 1, "user", "a"), (2, 5, "assistant", "x" * 300000)])


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert format_chats(df).collect() == []


def test_query_digests_and_plan(spark, sf):
    from gridspark.llm.queries import QUERIES

    df = QUERIES["op1_chat_format"](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    turns = want([tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])
    hard = "</s>[INST] ok [/INST]"
    turns[-7] = [("user", hard), ("assistant", hard)]
    got = df.collect()
    assert len(got) == len(turns)
    for r in got:
        t = turns[r.conv_id]
        loss = "".join(x for role, x in t if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(t), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in t).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
