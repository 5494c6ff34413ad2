import hashlib

from hypothesis import given
from hypothesis import strategies as st

from chronoweave.llm import chat

bits = st.lists(st.sampled_from(["</s>", "<s>", "[INST]", "[/INST]", "<|", "|>", "|", "<", ">", chat.MARK, "1", "0", "\n", "é", "x", "[", "/s>", "user"]), max_size=12).map("".join)


@given(st.lists(st.tuples(bits, bits), max_size=6))
def test_reversible(turns):
    out, spans = chat.format_turns([*turns, ("assistant", "a</s>")])
    assert chat.parse(out) == [*turns, ("assistant", "a</s>")]
    assert "".join(chat.unescape(out[s:e]) for s, e in zip(spans[::2], spans[1::2])) == "".join(t for r, t in [*turns, ("assistant", "a</s>")] if r == "assistant")
    assert not any(chat.CONTROL.search(chat.escape(t)) for _, t in turns)


def test_trees(spark):
    rows = [
        (1, 1, None, 0, "user", "q"), (1, 2, 1, 5, "assistant", "a"), (1, 3, 1, 7, "assistant", "b"), (1, 4, 2, 1, "user", "c"), (1, 5, 3, None, "user", None),
        (2, 1, 99, 1, None, "alone"), (3, 1, 2, 1, "user", "x"), (3, 2, 1, 1, "user", "y"), (None, 1, None, 1, "user", "z"), (None, 2, 1, 1, "assistant", "w"), (0, 1, None, 1, "user", "zero"),
    ]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, score int, role string, text string").selectExpr("*", "1 as leaf", "'q' as path")
    got = {(r.tree, r.path): (r.leaf, [t for _, t in chat.parse(r.formatted)]) for r in chat.format_trees(df, 2).collect()}
    assert got == {(1, 1): (5, ["q", "b", ""]), (1, 2): (4, ["q", "a", "c"]), (2, 1): (1, ["alone"]), (None, 1): (2, ["z", "w"]), (0, 1): (1, ["zero"])}
    assert chat.format_trees(df.limit(0)).count() == 0


def test_long_chain(spark):
    rows = [(4, t, "user" if t % 2 else "assistant", f"t{t}") for t in range(130)] + [(5, 1, "user", "b"), (5, 1, "user", "a"), (5, 1, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    trees = chat.chains(df)
    leaves = trees.join(trees.selectExpr("tree", "parent as node"), ["tree", "node"], "left_anti")
    assert leaves.where("tree = 4").count() == 2  # the last turn, or an end in its place; the ranking chooses
    assert [r.formatted for r in chat.format_trees(trees, 2).where("tree = 5 and path = 2").collect()] == [chat.format_turns([("assistant", ""), ("user", "a"), ("", "")])[0]]
    got = {r.conv_id: r for r in chat.digest(chat.format_trees(trees)).collect()}
    told = "".join(f"{r}\n{t}\n" for _, _, r, t in rows[:130])
    loss = "".join(t for _, _, r, t in rows[:130] if r == "assistant")
    assert (got[4].n_turns, got[4].turns_sha256, got[4].loss_chars, got[4].loss_sha256) == (130, hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[5].turns_sha256 == hashlib.sha256(b"assistant\n\nuser\na\nuser\nb\n").hexdigest()
