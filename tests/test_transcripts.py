import json

from brindle.sources import transcripts as S


def lines(spark, *rows):
    made = [("f", k + 1, r if isinstance(r, str) else json.dumps(r)) for k, r in enumerate(rows)]
    return spark.createDataFrame(made, "path string, line_no int, line string")


def texts(df):
    return [r["text"] for r in df.orderBy("line_no", "seq").collect()]


def user(content, **more):
    return {"type": "user", "message": {"content": content, **more}}


def test_typed_prompts(spark):
    rows = lines(
        spark, user("  keep spaces "), "{broken", user([{"type": "text", "text": "one"}, {"type": "image"}, {"type": "text", "text": " "}, {"type": "text", "text": "two"}]),
        {"type": "message", "message": {"role": "user", "content": "by role"}}, {"type": "message", "message": {"role": "user", "content": "x", "inputSource": "extension"}},
        {"type": "user", "message": {"content": "bad", "role": 5}}, {"type": "system", "message": {"content": "no"}}, user("\n "), user([{"type": "text", "text": 5}]), {"type": "user", "extra": 1, "message": {"content": "more fields"}},
    )
    assert texts(S.typed_prompts(rows, "path")) == ["User:   keep spaces ", "User: one", "User: two", "User: by role", "User: more fields"]


def test_typed_answers_come_from_blocks_only(spark):
    rows = lines(spark, {"type": "assistant", "message": {"content": "plain"}}, {"type": "assistant", "message": {"content": [{"type": "text", "text": " a "}, {"type": "tool_use", "name": "x"}]}})
    assert texts(S.typed_answers(rows, "path")) == ["Assistant:  a "]


def payload(role, *blocks, kind="message"):
    return {"type": "response_item", "payload": {"type": kind, "role": role, "content": [{"type": t, "text": x} for t, x in blocks]}}


def test_enveloped_messages(spark):
    rows = lines(
        spark, payload("user", ("input_text", " a "), ("input_text", "b"), ("output_text", "no")), payload("developer", ("input_text", "no")),
        payload("user", ("input_text", "  <environment_context>x")), payload("assistant", ("output_text", "# AGENTS.md instructions stay here")), {"type": "event", "payload": {"type": "message", "role": "user"}},
    )
    assert texts(S.enveloped_messages(rows, "user", "path")) == ["User: a\nb"]
    assert texts(S.enveloped_messages(rows, "assistant", "path")) == ["Assistant: # AGENTS.md instructions stay here"]


def test_turns(spark):
    rows = lines(
        spark, user("  as is "), user([{"type": "tool_result"}]), {"type": "assistant", "message": {"content": [{"type": "text", "text": " hi "}, {"type": "tool_use"}, {"type": "toolCall"}]}},
        {"type": "assistant", "message": {"content": [{"type": "tool_use"}]}}, {"type": "assistant", "message": {"content": "plain"}},
    )
    got = [(r["role"], r["text"], r["tool_call_count"], r["turn_index"]) for r in S.typed_turns(rows, "path").orderBy("turn_index").collect()]
    assert got == [("user", "  as is ", 0, 0), ("assistant", "hi", 2, 1), ("assistant", "", 1, 2), ("assistant", "plain", 0, 3)]
    env = lines(spark, payload("user", ("input_text", "q")), {"type": "response_item", "payload": {"type": "function_call", "name": "f"}}, payload("assistant", ("output_text", "a")))
    got = [(r["role"], r["text"], r["tool_call_count"]) for r in S.enveloped_turns(env, "path").orderBy("turn_index").collect()]
    assert got == [("user", "q", 0), ("assistant", "", 1), ("assistant", "a", 0)]


def test_formats(spark):
    typed = lines(spark, "x", {"type": "summary"}, {"type": "session"}, user("a"))
    assert [r["format"] for r in S.sniff(typed, "path").collect()] == ["typed"]
    assert [r["format"] for r in S.sniff(lines(spark, payload("user")), "path").collect()] == ["enveloped"]
    assert S.sniff(lines(spark, {"type": "summary"}), "path").collect() == []
    assert len(S.with_session_header(lines(spark, "junk", {"type": "session"}, user("a")), "path").collect()) == 1
    assert S.with_session_header(lines(spark, user("a"), {"type": "session"}), "path").collect() == []


def test_lines_end_at_newlines_only(spark):
    df = spark.createDataFrame([("f", "a\r\nb\rc\n\nd\n"), ("g", "")], "path string, text string")
    got = {}
    for r in S.lines_of(df, "path").orderBy("path", "line_no").collect():
        got.setdefault(r["path"], []).append(r["line"])
    assert got == {"f": ["a", "b\rc", "", "d"]}
