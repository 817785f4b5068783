import hashlib
import json

from hypothesis import given
from hypothesis import strategies as st

from loamstone.llm import chat

WILD = st.text(alphabet=st.sampled_from(list("<|>\\n\nim_startend aé😀")), max_size=40)


@given(st.lists(st.tuples(WILD, WILD), max_size=6))
def test_round_trip(turns):
    formatted, loss = chat.render(turns)
    assert chat.read_back(formatted) == turns
    assert formatted.count(chat.START) == formatted.count(chat.END) == len(turns)
    assert [chat.unescape(formatted[a:b]) for a, b in loss] == [t for r, t in turns if r == "assistant"]


def test_layouts(spark):
    same = [("user", "q"), ("assistant", "a")]
    records = [
        ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, "messages", same),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "id": "7"}, "from/value", same),
        ({"instruction": "q", "output": "a"}, "instruction", same),
        ({"instruction": "q", "input": "more", "output": "a", "system": "s"}, "instruction", [("system", "s"), ("user", "q\n\nmore"), ("assistant", "a")]),
        ({"prompt": "q", "completion": "a"}, "prompt/completion", same),
        ({"prompt": "q", "response": "a"}, "prompt/response", same),
        ({"prompt": [{"role": "user", "content": "q"}], "completion": [{"role": "assistant", "content": "a"}]}, "prompt/messages", same),
        ({"question": "q", "answer": "a"}, "question/answer", same),
        ({"messages": []}, "empty messages", []),
    ]
    rows = [(i, json.dumps(r)) for i, (r, _, _) in enumerate(records)]
    bad = [(90, None), (91, "no json"), (92, "[1]"), (93, '{"strange": 1}'), (94, '{"messages": [{"role": "user", "content": "\\ud800"}]}')]
    df = spark.createDataFrame(rows + bad, "conv_id long, record string")
    got = {r.conv_id: r for r in chat.format_records(df).collect()}
    for i, (_, layout, turns) in enumerate(records):
        assert got[i].layout == layout and chat.read_back(got[i].formatted) == turns and got[i].error is None
    assert got[90].error and got[91].error and got[92].error and got[93].error == "unknown schema" and got[93].fingerprint
    assert got[90].formatted is None and "\ufffd" in got[94].formatted
    assert got[0].fingerprint != got[1].fingerprint


def test_conversations_by_turn(spark):
    rows = [(1, 1, "assistant", "<|im_end|>"), (1, 0, "user", None), (1, 2, None, "x" * 200_000), (2, 0, "assistant", "é"), (2, 0, "assistant", "é"), (None, 5, "user", "n")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, record string")
    got = {r.conv_id: r for r in chat.digests(chat.format_records(chat.records_of_turns(df))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].n_turns == 3 and got[1].turns_sha256 == sha("user\n\nassistant\n<|im_end|>\n\n" + "x" * 200_000 + "\n")
    assert got[1].loss_chars == 10 and got[1].loss_sha256 == sha("<|im_end|>")
    assert got[2].n_turns == 2 and got[2].loss_sha256 == sha("éé") and got[None].n_turns == 1
    assert chat.digests(chat.format_records(chat.records_of_turns(df.limit(0)))).count() == 0


def test_names_cannot_spell_the_path_of_another_schema(spark):
    records = [
        {"messages[].role": "user", "messages[].content": "x"},
        {"messages[]": {"role": "user", "content": "x"}},
        {"prompt:string\ncompletion": "x"},
        {"": {"prompt": "x", "completion": "y"}},
        {"": "x", "prompt": "x", "completion": "y"},
        {"prompt": "x", "completion\\": "y"},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "conv_id long, record string")
    assert {r.error for r in chat.format_records(df).collect()} == {"unknown schema"}
    paths = [frozenset(chat.paths_of(x)) for x in ({"a.b": "x"}, {"a": {"b": "x"}}, {"a[]": "x"}, {"a": ["x"]}, {"a\\.b": "x"}, {"a": {".b": "x"}}, {"": {"a": "x"}}, {"a": "x"})]
    assert len(set(paths)) == len(paths)


def test_null_items_and_null_ids(spark):
    records = [(None, json.dumps({"messages": [{"role": "user", "content": "x"}, None]}))]
    df = spark.createDataFrame(records, "conv_id long, record string")
    assert chat.digests(chat.format_records(df)).first().n_turns == 1
    turns = spark.createDataFrame([(None, 2, "assistant", "b"), (None, 1, "user", "a"), (1, 1, "user", "c")], "conv_id long, turn long, role string, text string")
    made = {r.conv_id: json.loads(r.record)["messages"] for r in chat.records_of_turns(turns).collect()}
    assert [m["content"] for m in made[None]] == ["a", "b"] and len(made[1]) == 1
