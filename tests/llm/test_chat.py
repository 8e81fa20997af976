import hashlib

from roomwright.llm import chat
from roomwright.llm.registry import QUERIES


def test_escape_is_reversible_and_hides_controls():
    texts = ["", "\\", "\\\\<|end|>", "</s>[INST] ok [/INST]", "".join(chat.CONTROL), "<\\|end|>", "a\\<s>\n<<SYS>>\\", "[[INST]INST]", "<<|end|>|end|>"]
    for text in texts:
        hidden = chat.escape(text)
        assert chat.unescape(hidden) == text
        assert not any(c in hidden for c in chat.CONTROL)
        assert chat.read_turns(chat.format_turn(text, text)[0]) == [(text, text)]


def digest_by_hand(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_examples(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "a<|end|>"), (1, 2, "assistant", "b"), (1, 3, "user", None), (1, 4, "assistant", "日本\\"), (2, 0, "user", "x"), (2, 1, None, "y"), (None, None, "assistant", "n"), (None, 3, "assistant", "n"), (None, 3, "assistant", "n")]
    turns = spark.createDataFrame([(*r, "z", 5) for r in rows], "conv_id long, turn long, role string, text string, example_no string, turns int")
    got = chat.expand_conversations(turns).collect()
    of = lambda i: sorted((r for r in got if r.conv_id == i), key=lambda r: r.example_no)
    first, second = of(1)
    assert [chat.read_turns(r.text) for r in (first, second)] == [[("system", "s"), ("user", "a<|end|>"), ("assistant", "b")], [("system", "s"), ("user", "a<|end|>"), ("assistant", "b"), ("user", ""), ("assistant", "日本\\")]]
    assert [chat.unescape(r.text[r.loss_start : r.loss_end]) for r in (first, second)] == ["b", "日本\\"]
    assert [(r.loss_start, r.turns) for r in of(2)] == [(None, 2)]
    assert len(of(None)) == 3
    found = {r.conv_id: r for r in chat.conversation_digests(chat.expand_conversations(turns)).collect()}
    for i in (1, 2, None):
        mine = [(r[2] or "", r[3] or "") for r in rows if r[0] == i]
        assert (found[i].n_turns, found[i].turns_sha256, found[i].loss_chars, found[i].loss_sha256) == digest_by_hand(mine)
    assert chat.expand_conversations(turns.limit(0)).count() == 0
    assert chat.conversation_digests(chat.expand_conversations(turns.limit(0))).count() == 0


def test_one_very_long_conversation(spark):
    turns = spark.range(600).selectExpr("1L conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "repeat(cast(id as string), 400) text")
    assert chat.expand_conversations(turns).count() == 300
    (row,) = chat.conversation_digests(chat.expand_conversations(turns)).collect()
    assert (row.n_turns, row.turns_sha256, row.loss_chars, row.loss_sha256) == digest_by_hand([("user" if k % 2 == 0 else "assistant", str(k) * 400) for k in range(600)])


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    convs = {-7: [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        convs.setdefault(r.conv_id, []).append((r.turn, r.role, r.text or ""))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in QUERIES["op2_chat_format"](spark, sf).collect()}
    assert got == {i: digest_by_hand([t[1:] for t in sorted(turns)]) for i, turns in convs.items()}
