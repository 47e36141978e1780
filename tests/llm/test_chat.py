import hashlib
import re

from pyspark.sql import functions as F

from lodestar.llm import chat
from lodestar.llm.catalog import op7_chat

SMALL = "/root/testdata/sf0.001"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_query_over_whole_table(spark):
    turns = {}
    for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect():
        turns.setdefault(r.conv_id, []).append((r.turn, r.role or "", r.text or ""))
    turns[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: r for r in op7_chat(spark, SMALL).collect()}
    assert set(got) == set(turns)
    for c, t in turns.items():
        t.sort()
        loss = "".join(x for _, r, x in t if r == "assistant")
        assert got[c].n_turns == len(t)
        assert got[c].turns_sha256 == sha("".join(f"{r}\n{x}\n" for _, r, x in t))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss))


CONTROL = ["</s>", "<|end|>\n", "[INST] [/INST] <s>", "\\", "<\\|", "<|assistant|>\n", "a\\b<|>|", "", None, "|>\n<|",
           "[\\INST]", "\\\\[INST]\\", "\n", "é\U0001F44D<|"]


def test_control_strings_survive(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(CONTROL)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.examples(df).withColumn("back", chat.parsed(F.col("formatted"))).withColumn("loss", chat.masked())
    got = {r.upto: r for r in made.collect()}
    assert sorted(got) == [2, 4, 6, 8, 10, 12, 14]
    for n, r in got.items():
        assert [(x.role, x.text) for x in r.back] == [(b, t or "") for _, _, b, t in rows[:n]]
        assert r.loss == (rows[n - 1][3] or "")
        assert r.formatted.count("<|end|>\n") == n


def test_tail_ties_nulls_and_clashing_columns(spark):
    rows = [(1, 0, "user", "q", 1, 2), (1, 1, "assistant", "a", 1, 2), (1, 1, "assistant", "a", 1, 2),
            (1, None, "user", "late", 1, 2), (2, 0, None, "x", 1, 2), (None, 0, "user", "n", 1, 2),
            (None, 1, "assistant", "m", 1, 2), (3, 0, "assistant", None, 1, 2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int, formatted int")
    got = chat.examples(df).withColumn("loss", chat.masked()).collect()
    by = {}
    for r in got:
        by.setdefault(r.conv_id, []).append((r.upto, r.is_last, r.loss))
    assert sorted(by[1]) == [(2, False, "a"), (3, False, "a"), (4, True, None)]
    assert by[2] == [(1, True, None)] and by[None] == [(2, True, "m")] and by[3] == [(1, True, "")]


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.examples(df).count() == 0


def test_no_python_in_the_plan(spark):
    plan = op7_chat(spark, SMALL)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
