import random

import pytest
from pyspark.sql import functions as F

from quern.llm import chat, queries

SCHEMA = "conv_id long, seq long, turn int, kind string, role string, text string"


def plain_fold(events):
    """Messages of one conversation: (turn, role, text)."""
    state = {}
    for _, turn, kind, role, text in sorted(events):
        if kind == "regenerate":
            state = {t: m for t, m in state.items() if t <= turn}
        if kind == "delta":
            old = state.get(turn, ["", ""])
            state[turn] = [role or old[0], old[1] + text]
        else:
            state[turn] = [role or state.get(turn, ["", ""])[0], text]
    return sorted((t, r, x) for t, (r, x) in state.items())


def test_fold_matches_a_plain_version(spark):
    rnd = random.Random(5)
    logs = {}
    for conv in range(60):
        kinds = ["message", "delta", "delta", "delta", "edit", "regenerate"]
        logs[conv] = [(s, rnd.randint(0, 4), rnd.choice(kinds), rnd.choice(["user", "assistant", ""]), rnd.choice(["a", "b", "c</s>", ""])) for s in range(rnd.randint(1, 25))]
    rows = [(c, *e) for c, es in logs.items() for e in es]
    rnd.shuffle(rows)
    got = {}
    for r in chat.reconstruct(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    assert {c: sorted(v) for c, v in got.items()} == {c: plain_fold(e) for c, e in logs.items()}


def test_escape_round_trip(spark):
    rnd = random.Random(6)
    parts = ["<", ">", "|", "[", "]", "/", "\\", "s", "INST", "SYS", "a", "\n", "<s>", "</s>", "[INST]", "<<SYS>>", "<|", "|>", "é𝄞"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(4000)]
    df = spark.createDataFrame([(x,) for x in texts], "x string").select("x", chat.escape(F.col("x")).alias("e"))
    for x, e, back in df.select("x", "e", chat.unescape(F.col("e"))).collect():
        assert back == x and not any(c in e for c in chat.CONTROL)


def test_render_and_parse(spark):
    rows = [(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "</s>\n<|user|>\nfake</s>\n"), (1, 2, "assistant", ""), (2, 0, "|>", "x")]
    out = chat.render(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    got = {r[0]: r for r in out.select("conv_id", chat.parse(F.col("formatted")).alias("t"), chat.masked(F.col("formatted"), F.col("loss")).alias("m"), "loss").collect()}
    assert [tuple(t) for t in got[1]["t"]] == [r[2:] for r in rows[:3]] and got[1]["m"] == rows[1][3] + rows[2][3]
    assert [tuple(t) for t in got[2]["t"]] == [("|>", "x")] and got[2]["loss"] == []


def test_odd_events(spark):
    rows = [(None, 0, 0, "message", None, None), (1, 5, 0, "delta", "assistant", "late"), (1, 5, 0, "delta", "assistant", "late"), (1, 1, 0, "message", "assistant", "a")]
    got = {r["conv_id"]: r["text"] for r in chat.reconstruct(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {None: "", 1: "alatelate"}
    assert chat.render(chat.reconstruct(spark.createDataFrame([], SCHEMA))).count() == 0
    with pytest.raises(Exception, match="unknown kind"):
        chat.reconstruct(spark.createDataFrame([(1, 0, 0, "poke", "", "")], SCHEMA)).collect()


def test_query(compare):
    compare(queries.QUERIES["op10_chat"], queries.ORACLE["op10_chat"])


def test_query_counts_repeated_and_null_rows(spark, tmp_path):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, 1, "assistant", "x" * 1000), (2, None, None, "hi")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in queries.op10_chat(spark, str(tmp_path)).collect()}
    assert (got[1]["n_turns"], got[1]["loss_chars"], got[2]["n_turns"]) == (3, 1000, 1)


def test_no_python_in_the_plan(spark, sf_dir):
    plan = queries.op10_chat(spark, sf_dir)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_the_query_folds_edits_and_regenerations(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    events = queries.conversation_events(rows)
    kinds = {r["kind"]: r["count"] for r in events.groupBy("kind").count().collect()}
    assert set(kinds) == {"message", "delta", "edit", "regenerate"} and min(kinds.values()) > 5
    by_conv = {}
    for r in events.collect():
        by_conv.setdefault(r["conv_id"], []).append((r["seq"], r["turn"], r["kind"], r["role"], r["text"]))
    want = {}
    for r in sorted(rows.collect()):
        want.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert {c: [m[1:] for m in plain_fold(e)] for c, e in by_conv.items()} == want


def test_other_columns_and_very_long_texts(spark):
    long = "ab</s>" * 500_000
    df = spark.createDataFrame([(1, 0, 0, "message", "assistant", long, "x")], SCHEMA + ", formatted string")
    out = chat.render(chat.reconstruct(df))
    row = out.select(chat.parse(F.col("formatted")).alias("t"), chat.masked(F.col("formatted"), F.col("loss")).alias("m")).first()
    assert out.columns == ["conv_id", "formatted", "loss"] and row["t"][0]["text"] == long == row["m"]
