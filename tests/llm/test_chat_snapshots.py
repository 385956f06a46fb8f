import duckdb
from compare import differences
from conftest import SF

from surtido.llm import chat_snapshots

KINDS = "conv_id long, turn long, role string, text string"
ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello"),
    (2, 0, "user", "hi"),                                            # a prefix of 1
    (3, 0, "user", "hi"), (3, 1, "assistant", "hello"),              # equal to 1
    (4, 0, "user", "hi"), (4, 1, "assistant", "hello"), (4, 2, "user", "bye"), (4, 2, "user", "bye"),
    (5, 1, "assistant", "hello"), (5, 0, "user", "other"),
    (6, None, None, None), (7, 0, "", ""), (8, 3, "user", "hi"), (8, 3, "assistant", "hi"),
    (None, 0, "user", "no id"), (9, 0, "user", "h"), (9, 1, "user", "i"),
]


def test_odd_conversations(spark):
    log = spark.createDataFrame(ROWS, KINDS).selectExpr("*", "1 as at", "2 as h1", "3 as last", "4 as n_turns")
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", ROWS)
    found = chat_snapshots.render(log)
    assert differences(found, con, chat_snapshots.SQL) == []
    rows = {r.conv_id: r for r in found.collect()}
    assert set(rows) == {4, 5, 6, 8, 9, None} and rows[6].n_copies == 2
    assert rows[4].rendered == ("<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n"
                                "<|im_start|>user\nbye<|im_end|>\n")


def test_long_conversation_and_its_snapshots(spark):
    turns = 300
    rows = [(c, t, "user", f"turn {t}") for c in range(5) for t in range(turns - c)]
    found = chat_snapshots.render(spark.createDataFrame(rows, KINDS)).collect()
    assert [(r.conv_id, r.n_turns, r.n_copies) for r in found] == [(0, turns, 1)]


def test_repeated_turns_combine_before_the_window(spark):
    log = spark.range(0, 20_000, 1, 4).selectExpr(
        "cast(null as long) as conv_id", "id % 3 as turn", "'user' as role", "concat('t', id % 3) as text")
    rolled = chat_snapshots.rolling_hashes(log)
    assert sorted((r.at, r.text, r.last) for r in rolled.collect()) == [(1, "t0", False), (2, "t1", False), (3, "t2", True)]
    plan = rolled._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan and plan.rindex("Aggregate") > plan.rindex("Window")


def test_empty_table(spark):
    log = spark.read.parquet(f"{SF}/conversations.parquet").limit(0)
    assert chat_snapshots.render(log).collect() == []
