"""Nulls and limits that must neither lose rows nor end the job."""

from textloom.functions import names
from textloom.operators import chat, ranking


def test_null_turns_and_zero_temperature(spark):
    said = spark.createDataFrame([(1, 0, "user", None), (1, 1, None, "hi")], "conv_id int, turn int, role string, text string")
    row = chat.render_conversations(said).first()
    head = lambda role: f"{chat.START_HEADER}{role}{chat.END_HEADER}\n\n"
    assert (row.n_turns, row.text) == (2, f"{head('user')}{chat.END_OF_TURN}{head(chat.USER_ROLE)}hi{chat.END_OF_TURN}")

    scored = spark.createDataFrame([(1, 1, 1.0), (1, 2, 2.0)], "g int, item int, score double")
    same = [sorted(ranking.softmax(scored, ["g"], temperature=t).collect()) for t in (0, 1.0)]
    assert same[0] == same[1]

    name = spark.createDataFrame([(f"model_pg_{'9' * 30}_steps.pth",), ("model_pg_7_steps.pth",)], "n string")
    assert [tuple(r) for r in name.select(names.captured_step("n"), names.split_step("n")).collect()] == [(None, None), (7, 7)]
