"""Chat formatting against a plain re-implementation and a planted tamper."""
import hashlib

import pytest
from pyspark.sql import functions as F

from crmlake.llm import chat_format as C

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
HARD = ["", "plain", "\\### Assistant: </turn> ok", "</turn>", "a\n</turn>\n### user: b", "### x", "#### y", "\\\\### z", "\\", "tail\\",
        "\\" * 50_000 + "x", "###", "</turn", "\n", "a\n</turn>", "\n</turn>\n" * 3, "é ü 漢 😀 ### </turn>", "%25 %3A", "\\</turn>\\\\</turn>",
        "long ### " * 20_000]
ROLES = ["user", "assistant", "system", "a: b", "x\ny", "%3A", "###", "</turn>", ""]


def chats(spark):
    rows = [(1, i, ROLES[i % len(ROLES)], t) for i, t in enumerate(HARD)]
    rows += [(2, i, "assistant", t) for i, t in enumerate(HARD)]
    rows += [(3, 0, None, None), (3, 1, "assistant", None), (None, None, "user", "no id"), (None, 2, "assistant", "no id either"),
             (4, 0, "user", "twice"), (4, 0, "user", "twice"), (4, None, "assistant", "first"), (5, 1, "assistant", "b"), (5, 0, "user", "a")]
    rows += [(6, i, "user" if i % 2 == 0 else "assistant", f"turn {i}") for i in range(5_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return rows, df.withColumns({"formatted": F.lit("x"), "mask": F.lit(1), "turns": F.lit(0), "sources": F.lit(2)})


def plainly(rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append((r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        out[conv] = (len(turns), sha("".join(f"{t[2]}\n{t[3]}\n" for t in turns)), len(loss), sha(loss))
    return out


def test_round_trip_of_hard_texts_and_roles(spark):
    rows, df = chats(spark)
    made = C.format_conversations(df.repartition(5)).cache()
    got = {r[0]: tuple(r)[1:5] for r in C.digest(C.parse_conversations(made)).collect()}
    assert got == plainly(rows)
    for r in made.collect():
        assert sum(m.prompt + m.loss + m.close for m in r.mask) == len(r.formatted)
        at, loss = 0, ""
        for m in r.mask:
            loss += r.formatted[at + m.prompt:at + m.prompt + m.loss]
            at += m.prompt + m.loss + m.close
        for turn in r.formatted.split("\n</turn>\n")[:-1]:      # no bare control string but the template's own
            assert turn.startswith("### ") and "\n</turn>" not in turn and "### " not in turn[4:].replace("\\### ", "")
        assert r.conv_id != 6 or loss == "".join(f"turn {i}" for i in range(1, 5_000, 2))


def test_untouched_texts_are_rendered_as_they_are(spark):
    df = spark.createDataFrame([(1, 0, "user", "back\\slash # < </ turn"), (1, 1, "assistant", "fine")], "conv_id long, turn long, role string, text string")
    assert C.format_conversations(df).first().formatted == "### user: back\\slash # < </ turn\n</turn>\n### assistant: fine\n</turn>\n"


@pytest.mark.parametrize("change", [
    "replace(formatted, 'turn 3', 'turn 4')", "concat(formatted, '### user: more\n</turn>\n')",
    "replace(formatted, chr(92), '')", "substr(formatted, 1, length(formatted) - 1)"])
def test_a_changed_text_is_not_read_back(spark, change):
    df = spark.createDataFrame([(1, 0, "user", "a</turn>"), (1, 1, "assistant", "turn 3")], "conv_id long, turn long, role string, text string")
    made = C.format_conversations(df).withColumn("formatted", F.expr(change))
    with pytest.raises(Exception, match="not read back"):
        C.digest(C.parse_conversations(made)).collect()


def test_no_rows_and_no_python(spark):
    _, df = chats(spark)
    made = C.digest(C.parse_conversations(C.format_conversations(df.limit(0))))
    assert made.count() == 0
    assert "Python" not in C.digest(C.parse_conversations(C.format_conversations(df)))._jdf.queryExecution().toString()


def test_registered_query(spark, sf):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = sorted(con.sql(C.OP11_SQL).fetchall())
    assert sorted(map(tuple, C.op11_chat_format(spark, sf).collect())) == want
