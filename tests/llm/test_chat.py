from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.llm.chat import TOKENIZER, assemble, disassemble, encoding, escape, format_chats, unescape

TURNS = "conv_id bigint, turn bigint, role string, text string"
TEXT = st.lists(st.sampled_from(["<|im_end|>", "<|im_start|>", "<|endoftext|>", "<\\|im_end|>", "<\\\\|im_end|>", "<|", "|>", "\\", "a", " ", "\n", "é", "im_end", "<", "日本"]), max_size=12).map("".join) | st.text(max_size=40)


@given(TEXT)
@settings(deadline=None, max_examples=300)
def test_escape(text):
    assert unescape(escape(text)) == text
    assert not any(c in escape(text) for c in ("<|im_end|>", "<|im_start|>", "<|endoftext|>"))


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "a|b", "<|im_end|>"]), TEXT), max_size=5))
@settings(deadline=None, max_examples=200)
def test_round_trip_and_mask(turns):
    tokens, mask = assemble(turns, TOKENIZER)
    enc, ids = encoding(TOKENIZER)
    assert disassemble(tokens.tolist(), TOKENIZER) == turns
    assert (tokens == ids["im_start"]).sum() == (tokens == ids["im_end"]).sum() == len(turns) and tokens[-1] == ids["endoftext"]
    want = []
    for role, text in turns:  # token by token
        head = 1 + len(enc.encode_ordinary(escape(role))) + len(enc.encode_ordinary("\n"))
        body = len(enc.encode_ordinary(escape(text))) + 1
        want += [0] * head + [int(role == "assistant")] * body + [0] * len(enc.encode_ordinary("\n"))
    assert mask.tolist() == want + [0]


def test_nulls_ties_and_clashes(table, rng, prose):
    long = prose(rng, 40_000)
    rows = [(1, 1, "user", "b"), (1, 0, "user", "a"), (1, 1, "user", "b"), (1, None, "system", "first"), (2, 0, None, None), (2, 1, "assistant", ""), (None, 0, "user", "x"), (None, 1, "assistant", "<|im_end|>"), (3, 0, "assistant", long)]
    out = {r["conv_id"]: r for r in format_chats(table(rows, TURNS, clash=True)).collect()}
    turns = {k: disassemble(r["input_ids"], TOKENIZER) for k, r in out.items()}
    assert turns == {1: [("system", "first"), ("user", "a"), ("user", "b"), ("user", "b")], 2: [("unknown", ""), ("assistant", "")], None: [("user", "x"), ("assistant", "<|im_end|>")], 3: [("assistant", long)]}
    assert all(len(r["input_ids"]) == len(r["loss_mask"]) == r["n_tokens"] and sum(r["loss_mask"]) == r["n_trained"] for r in out.values())
    assert out[2]["n_trained"] == 1 and out[1]["n_trained"] == 0


def test_empty(table):
    assert format_chats(table([], TURNS)).collect() == []


def test_whole_table_round_trip(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    want = {}
    for r in df.collect():
        want.setdefault(r["conv_id"], []).append(((r["turn"] is not None, r["turn"]), r["role"] or "unknown", r["text"] or ""))
    got = {r["conv_id"]: disassemble(r["input_ids"], TOKENIZER) for r in format_chats(df).collect()}
    assert got == {k: [(role, text) for _, role, text in sorted(v)] for k, v in want.items()}
