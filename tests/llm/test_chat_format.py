from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import chat_format
from ledgerline.llm.chat_format import CONTROLS, ESCAPE, Malformed, escape, format_digests, formatted_turns, parse, render_turn, unescape
from ledgerline.llm.queries import QUERIES
from tests.conftest import same_rows

PIECES = st.lists(st.sampled_from([*CONTROLS, ESCAPE, f"{ESCAPE}0", f"{ESCAPE}1", "<", "/", "s>", "[", "INST]", "]", "x", "é", "\n", " ", "assistant"]), max_size=8).map("".join)


def test_query_gives_the_rows_of_its_sql(spark, sf_dir, duck):
    same_rows(QUERIES["op7_chat_round_trip"](spark, sf_dir), duck, chat_format.ORACLE_SQL)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.just("user"), st.just("assistant"), PIECES), PIECES), max_size=4))
def test_conversations_are_read_back(turns):
    rendered = [render_turn(*t) for t in turns]
    assert list(parse("".join(r for r, _ in rendered))) == turns
    for (role, text), (whole, mask) in zip(turns, rendered, strict=True):
        assert (mask is not None) == (role == "assistant")
        if mask:
            assert unescape(whole[slice(*mask)]) == text


@settings(max_examples=400, deadline=None)
@given(PIECES)
def test_escapes_leave_no_control_string(text):
    assert unescape(escape(text)) == text and not any(c in escape(text) for c in CONTROLS)


def test_plain_texts_are_not_changed():
    assert render_turn("user", "2 < 3 [x]")[0] == "<s>user[INST]2 < 3 [x][/INST]</s>"
    assert render_turn("assistant", "yes")[0] == "<s>assistant[INST][/INST]yes</s>"


@pytest.mark.parametrize("bad", ["x", "<s>user[INST]a</s>", "<s>user[INST]a[/INST]b</s>", "<s>user[INST]a[/INST]</s>x", "<s><s>"])
def test_the_parser_rejects_what_is_not_in_the_grammar(bad):
    with pytest.raises(Malformed):
        list(parse(bad))


def test_odd_tables(spark):
    schema = "conv_id long, turn long, role string, text string, n string, rendered string"
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, None, None, None), (2, 1, "assistant", None), (None, 1, "user", "x"), (3, 1, "user", "t"), (3, 1, "user", "t"), (4, 1, "assistant", "long " * 100_000)]
    df = spark.createDataFrame([(*r, "c", "c") for r in rows], schema).repartition(3)
    found = {r["conv_id"]: r for r in format_digests(df).collect()}
    hex_ = lambda s: sha256(s.encode()).hexdigest()
    assert found[1]["turns_sha256"] == hex_("\n\nuser\na\nassistant\nb\n") and found[1]["loss_sha256"] == hex_("b")
    assert (found[3]["n_turns"], found[2]["loss_chars"], found[None]["n_turns"], found[4]["loss_chars"]) == (2, 0, 1, 500_000)
    assert format_digests(df.limit(0)).count() == 0
    assert [r["n"] for r in formatted_turns(df).where("conv_id = 1").collect()] == [0, 1, 2]
