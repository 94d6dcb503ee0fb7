from colophon.llm.components import connected_components
from colophon.llm.conversations import rebuild_conversations

M = "id string, conversation_id string, role string, content string, metadata_json string, created_at string, turn_no int"


def run(spark, rows, conversations=("c",)):
    messages = spark.createDataFrame([(*r, None) for r in rows], M)
    got = rebuild_conversations(messages, spark.createDataFrame([(c,) for c in conversations], "id string")).collect()
    return sorted((r["conversation_id"], r["turn_no"], r["message_id"]) for r in got)


def test_order_speakers_and_repeats(spark):
    rows = [
        ("2", "c", "Bot", "Answer.", None, "2024-01-01T10:00:05Z"),
        ("1", "c", " human", "Question?", "{}", "2024-01-01 10:00:00"),
        ("1", "c", " human", "Question?", "{}", "2024-01-01 10:00:00"),  # the same row again
        ("9", "c", "user", "Question?", None, "1704103201"),  # saved again under another id
        ("0", "c", "SYSTEM", "Be kind.", None, "2024-01-01 09:59:59+00:00"),
        ("3", "c", "user", "More?", None, "2024-01-01T19:01:00+09:00"),
        ("4", "c", "ai", "<think>hm</think>\nYes.", None, "2024-01-01 10:01:00.500+00:00"),
    ]
    assert run(spark, rows) == [("c", 1, "1"), ("c", 2, "2"), ("c", 3, "3"), ("c", 4, "4")]


def test_what_breaks_a_conversation(spark):
    ok = [("1", "{c}", "user", "Q", None, "2024-01-01 10:00:00"), ("2", "{c}", "assistant", "A", None, "2024-01-01 10:00:01")]
    change = {
        "fine": {}, "no role": {1: ("role", "unknown")}, "no time": {1: ("at", "soon")}, "null time": {0: ("at", None)}, "blank": {1: ("content", "​ \n")},
        "only think": {1: ("content", "<th​ink>x</think> ")}, "null": {0: ("content", None)}, "two users": {1: ("role", "user")},
    }
    rows = []
    for name, edits in change.items():
        for i, r in enumerate(ok):
            r = dict(zip(("id", "c", "role", "content", "meta", "at"), r))
            r |= {"id": f"{name}{i}", "c": name} | dict([edits[i]] if i in edits else [])
            rows.append((r["id"], r["c"], r["role"], r["content"], r["meta"], r["at"]))
    rows += [("x", "half", "user", "Q", None, "2024-01-01 10:00:00"), (None, "lost id", "user", "Q", None, "2024-01-01 10:00:00"), ("y", "stray", "user", "Q", None, "2024-01-01 10:00:00")]
    assert {c for c, _, _ in run(spark, rows, [*change, "half", "lost id", "empty"])} == {"fine"}


def test_same_instant_user_first_and_empty_tables(spark):
    rows = [("a", "c", "assistant", "A", None, "2024-01-01 10:00:00"), ("b", "c", "user", "Q", None, "2024-01-01 10:00:00")]
    assert run(spark, rows) == [("c", 1, "b"), ("c", 2, "a")]
    assert run(spark, []) == [] and run(spark, rows, ()) == []


def test_long_conversation_over_several_ranges(spark):
    rows = [(f"m{i:05d}", "c", ("user", "assistant")[i % 2], f"text {i}", None, str(1700000000 + i)) for i in range(4000)]
    got = run(spark, rows[::-1])
    assert [g[1] for g in got] == list(range(1, 4001)) and [g[2] for g in got] == [r[0] for r in rows]


def test_identifiers_from_reply_and_quote_links(spark):
    rows = [
        ("1", "c", "user", "A question of some length", None, "2024-01-01 10:00:00"),
        ("2", None, "assistant", "An answer", '{"reply_to": "1"}', "2024-01-01 10:00:01"),
        ("3", None, "user", "> An answer\nAnd then?", None, "2024-01-01 10:00:02"),
        ("4", None, "assistant", "That is all", '{"parent_id": "3"}', "2024-01-01 10:00:03"),
        ("5", None, "user", "Nobody's", '{"reply_to": "404"}', "2024-01-01 10:00:03"),
    ]
    assert [g[2] for g in run(spark, rows)] == ["1", "2", "3", "4"]


def test_components(spark):
    edges = [("a", "b"), ("b", "c"), ("x", "y"), ("q", "q"), (None, "a"), ("c", "a"), ("a", "b")] + [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("hub", f"leaf{i}") for i in range(200)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got["c"] == got["b"] == "a" and got["y"] == "x" and "q" not in got
    assert {got[f"n{i:03d}"] for i in range(61)} == {"n000"} and len({got[f"leaf{i}"] for i in range(200)}) == 1
    assert connected_components(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_quotes_said_in_several_places_and_replies_to_two_conversations_tie_nothing(spark):
    t = "2024-01-01 10:00:0"
    rows = [
        ("1", "c", "user", "Yes.", None, t + "0"), ("2", "c", "assistant", "Fine.", None, t + "1"),
        ("3", "d", "user", "Yes.", None, t + "0"), ("4", "d", "assistant", "Only here.", None, t + "1"),
        ("5", None, "user", "> Yes.\nWhich?", None, t + "2"),  # said in two conversations
        ("6", None, "user", "x", '{"reply_to": "2", "quote_of": "4"}', t + "3"),  # two conversations
        ("7", None, "user", "> Only here.\nSure?", None, "2023-01-01 10:00:00"),  # before it was said
        ("8", None, "user", "> Only here.\nSure?", None, t + "4"), ("9", None, "assistant", "Sure.", '{"in_reply_to": "8"}', t + "5"),
    ]
    assert run(spark, rows, ("c", "d")) == [("c", 1, "1"), ("c", 2, "2"), ("d", 1, "3"), ("d", 2, "4"), ("d", 3, "8"), ("d", 4, "9")]


def test_a_text_quoted_by_very_many_rows(spark):
    rows = [(f"u{i}", f"c{i % 50}", "user", "Yes.", None, "2024-01-01 10:00:00") for i in range(1500)] + [(f"q{i}", None, "user", "> Yes.", None, "2024-01-01 10:00:01") for i in range(1500)]
    assert run(spark, rows, ("c1",)) == []
