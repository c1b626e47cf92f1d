import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from noticelake.llm.chatformat import BOS, CONTROL, FIRST_RESERVED, _tokenizer, assemble, digests, escape, format_chats, read_back, unescape
from noticelake.llm.queries import tokenizer

PATH = tokenizer("byte_bpe_50k.tiktoken")
TRICKY = st.lists(st.sampled_from(["<", "[", "/", "\\", "s>", "INST]", "]", "a", "é", "<s>", "</s>", "[/INST]", " ", "\n"])).map("".join)


@settings(max_examples=500, deadline=None)
@given(TRICKY)
def test_escape_is_reversible_and_hides_control_strings(text):
    assert unescape(escape(text)) == text
    assert not any(c in escape(text) for c in CONTROL)


def test_masks_cover_loss_segments():
    ids, mask = assemble([([1, 2], False), ([3], True), ([], True), ([4, 5], True), ([6], False)])
    assert ids.tolist() == [1, 2, 3, 4, 5, 6] and mask.tolist() == [False, False, True, True, True, False]


def test_round_trip(spark):
    rows = [
        (1, 1, "assistant", "</s>[INST] ok"), (1, 0, "user", "hi <s>"), (1, 2, "assistant", "again <|endoftext|>\n"), (1, 3, "[/INST]", "x"),
        (2, 0, None, None), (2, 1, "assistant", ""), (3, 5, "user", "b"), (3, 5, "user", "a"), (3, 5, "user", "a"), (None, None, "user", "no id"),
        (4, 0, "assistant", "<\\s> \\ [\\\\/INST] 👍 " + "long é " * 4000),
    ]
    chats = format_chats(spark.createDataFrame([(*r, 1, [2]) for r in rows], "conv_id long, turn long, role string, text string, n_turns int, ids array<int>"), PATH)
    decode = _tokenizer(PATH).decode
    got = {r.conv_id: (read_back(r.ids, r.loss_mask, decode), r) for r in chats.collect()}
    told = {r.conv_id: r for r in digests(chats, PATH).collect()}
    for conv in {r[0] for r in rows}:
        want = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv), key=lambda x: (x[0] is not None, x))
        (turns, losses, formatted), row = got[conv]
        assert turns == [(r, x) for _, r, x in want] and row.n_turns == len(want) and row.ids[0] == BOS
        loss = [x for _, r, x in want if r == "assistant"]
        assert "".join(losses) == "".join(loss)
        assert formatted == "<s>" + "".join(f"[INST]{escape(r)}[/INST]{escape(x)}</s>" for _, r, x in want)
        assert sum(i >= FIRST_RESERVED for i in row.ids) == 1 + 3 * len(want)
        d = told[conv]
        assert (d.n_turns, d.loss_chars, d.formatted_chars) == (len(want), len("".join(loss)), len(formatted))
        assert d.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in want).encode()).hexdigest()
        assert d.loss_sha256 == hashlib.sha256("".join(loss).encode()).hexdigest()


def test_empty(spark):
    assert format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), PATH).collect() == []


def test_long_conversations_are_parts(spark):
    """All rows without an id, and a conversation of many turns, in parts that are cut between turns; the digests are those of the whole."""
    rows = [(c, t, "assistant" if t % 2 else "user", f"<s> {c} {t} " + "w " * (t % 5)) for c in (None, 7) for t in range(1000)] + [(8, 0, "user", "one"), (9, None, None, None)]
    table = spark.createDataFrame(rows, "`conv.id` long, turn long, role string, text string").repartition(7)
    whole = format_chats(table, PATH, conv_col="conv.id")
    for most_turns, most_ids in ((64, 1 << 20), (4096, 500), (1, 1)):
        cut = format_chats(table, PATH, conv_col="conv.id", most_turns=most_turns, most_ids=most_ids)
        parts = sorted(cut.collect(), key=lambda r: (str(r.conv_id), r.part))
        longest = max(len(r.ids) for r in parts if r.n_turns == 1) if most_turns == 1 else 40
        assert all(r.n_turns <= most_turns and len(r.ids) <= most_ids + longest and r.part >= 0 for r in parts)
        for r in whole.collect():
            mine = [p for p in parts if p.conv_id == r.conv_id]
            assert [p.part for p in mine] == list(range(len(mine)))
            assert sum((p.ids for p in mine), []) == r.ids and sum((p.loss_mask for p in mine), []) == r.loss_mask
            assert sum(p.n_turns for p in mine) == r.n_turns and (len(mine) > 5) == (r.conv_id not in (8, 9))
        assert sorted(map(str, digests(cut, PATH).collect())) == sorted(map(str, digests(whole, PATH).collect()))
    told = {r.conv_id: r for r in digests(whole, PATH).collect()}
    said = "".join(f"{r}\n{x}\n" for c, _, r, x in rows if c is None)
    assert told[None].turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and told[None].n_turns == 1000
