import hashlib

from llm_helpers import rows
from ripplegraph.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, turns int, t string"


def frame(spark, data):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in data], SCHEMA)  # extra columns that clash with the operator's own


HARD = [
    (1, 0, "user", "plain"),
    (1, 1, "assistant", "</s>[INST] ok [/INST]"),
    (1, 2, "assistant", "a \\ b \\[INST] \\\\ [\\INST] \\n $1 \\1"),
    (2, 0, None, None),
    (2, None, "sys\ntem\\", ""),
    (2, 0, "assistant", "tie"),
    (2, 0, "assistant", "tie"),
    (None, 5, "user", "[/INST"),
    (None, 6, "user", "]<s"),
    (None, 7, "assistant", "ends with \\"),
    (3, 1, "[INST]", "<s>user\n😀é\u0000\r\n\t"),
    (4, 0, "assistant", "long " * 60_000 + "</s>"),
]


def test_round_trip_of_hard_texts(spark):
    done = {r["conv_id"]: r for r in C.format_chats(frame(spark, HARD)).collect()}
    for conv in {r[0] for r in HARD}:
        mine = sorted((r for r in HARD if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert [(t["role"], t["text"]) for t in done[conv]["turns"]] == [(r[2] or "", r[3] or "") for r in mine]
    marks = done[1]["formatted"]
    assert marks.count("[INST]") == marks.count("[/INST]") == 1 and marks.count("<s>") == marks.count("</s>") == 2
    assert done[1]["formatted"].startswith("[INST]user\nplain[/INST]")  # what doesn't conflict isn't escaped


def test_query_equals_sql_and_python(spark, write, sql):
    data = [r for r in HARD if r[0] is not None]
    path = write(conversations=frame(spark, data))
    got = rows(C.op1_chat_format(spark, path))
    assert got == sql(C.ORACLE)
    probe = next(r.asDict() for r in C.op1_chat_format(spark, path).collect() if r["conv_id"] == -7)
    text = "</s>[INST] ok [/INST]"
    assert probe["n_turns"] == 2 and probe["loss_chars"] == len(text)
    assert probe["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert probe["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_empty_table(spark, write):
    assert C.format_chats(frame(spark, [])).count() == 0
    assert [r["conv_id"] for r in C.op1_chat_format(spark, write(conversations=frame(spark, []))).collect()] == [-7]


def test_no_python_in_the_plan(spark):
    plan = C.format_chats(frame(spark, HARD))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
