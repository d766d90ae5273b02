import random

import duckdb
import pandas as pd
import pytest

from plumbline.llm import quotation_linking as Q

SCHEMA = "conv_id long, turn long, role string, text string"


def made(seed):
    r = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "delta", "eta", "theta"]
    rows = []
    for conv in range(6):
        texts = []
        for turn in range(r.randint(1, 14)):
            own = "\n".join(" ".join(r.choice(words) for _ in range(r.randint(1, 5))) for _ in range(r.randint(1, 3)))
            body = own
            if texts and r.random() < 0.7:
                said = r.choice(texts).split("\n")
                part = said[: r.randint(1, len(said))]
                quoted = "\n".join(r.choice(["> ", ">", " > "]) + x for x in part)
                body = r.choice(["", "Ann wrote:\n", "hello\n"]) + quoted + "\n" + own
            texts.append(body)
            rows.append((conv, turn, r.choice(["user", "assistant"]), body))
    return rows


ODD = [(1, None, "user", "> x"), (None, 3, "user", "no conv"), (None, 3, "user", "> no conv"), (2, 0, None, None), (2, 0, "user", ""), (2, 1, "user", "\r\n> \r\n"), (90, 0, "a", "only one"), (90, 0, "a", "only one"), (90, 5, "a", ">> only   ONE\n>not said\nreply")]


def compare(spark, rows, bucket=1024):
    got = Q.reply_ordered(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as level", "'x' as lines")).collect()
    table = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    con = duckdb.connect()
    con.register("table_", table)
    con.execute("create view conversations as select conv_id::BIGINT conv_id, turn::BIGINT turn, role, text from table_")
    want = con.execute(Q.ORACLE_SQL).fetchall()
    key = lambda t: tuple(str(x) for x in t)
    assert sorted(map(key, map(tuple, got))) == sorted(map(key, want))
    return got


@pytest.mark.parametrize("seed", [1, 2])
def test_against_sql(spark, monkeypatch, seed):
    monkeypatch.setattr(Q.linked, "__defaults__", (4,))
    compare(spark, made(seed) + ODD)


def test_replies_follow_what_they_quote(spark):
    rows = [
        (1, 0, "user", "First question?"),
        (1, 1, "assistant", "Another topic."),
        (1, 2, "user", "On Monday Ann wrote:\n> first   QUESTION?\nAn answer."),
        (1, 3, "assistant", ">> First question?\n> An answer.\nThanks."),
        (1, 4, "user", "> never said\nWhat?"),
    ]
    got = sorted(compare(spark, rows), key=lambda r: r.position)
    assert [(r.turn, r.reply_to, r.root_turn, r.depth) for r in got] == [(0, None, 0, 0), (2, 0, 0, 1), (3, 2, 0, 2), (1, None, 1, 0), (4, None, 4, 0)]
    assert [r.text for r in got] == ["First question?", "An answer.", "Thanks.", "Another topic.", "What?"]


def test_long_chain_and_nothing(spark):
    rows = [(7, i, "user", (f"> line {i - 1}\n" if i else "") + f"line {i}") for i in range(70)]
    got = compare(spark, rows)
    assert max(r.depth for r in got) == 69 and {r.root_turn for r in got} == {0}
    assert Q.reply_ordered(spark.createDataFrame([], SCHEMA)).count() == 0


def test_very_long_lines(spark):
    rows = [(1, 0, "user", "said\n" + "x " * 200_000), (1, 1, "user", "> said\n" + ">" * 1_000_000 + " deep\n" + " \t" * 200_000 + "y" + " " * 200_000 + "z\n" + "> " * 300_000), (2, 0, "user", "\n".join(["> said"] * 20_000))]
    got = {(r.conv_id, r.turn): r for r in Q.reply_ordered(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1, 1].reply_to == 0 and got[1, 1].text.startswith("y ") and got[1, 1].text.endswith("z")
    # one unit of 20,000 lines put together, and the line itself
    assert (got[2, 0].n_quoted, got[2, 0].n_linked, got[2, 0].text) == (2, 0, "")
