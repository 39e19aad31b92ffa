"""Chat formatting with a grammar that is read back.

    conversation = turn*
    turn         = "<s>" role "[INST]" text "[/INST]</s>"   a turn to be read
                 | "<s>" role "[INST][/INST]" text "</s>"   a turn to be learnt

Every turn is rendered as it is and parsed again. If the parser does not give
back the same role and text, because they contain control strings or the
escape character, the conflicting parts are escaped and the turn is rendered and
parsed anew, until both are identical. The loss mask covers the texts to be
learnt, which are the assistant's.

Conversations stream through partitions sorted by (conv_id, turn); a task holds
one turn at a time, however long a conversation is. Turns go by turn (null
first), then role and text. Null roles and texts are empty, a null conv_id is
a conversation of its own, repeated rows are turns of their own, and an empty
table has no conversations. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import shuffle_partitions, slices

OPEN, CLOSE, BEGIN, END = "<s>", "</s>", "[INST]", "[/INST]"
#: Those of the grammar, and others that tokenizers take for control strings.
CONTROLS = [OPEN, CLOSE, BEGIN, END, "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<unk>"]
#: Escapes: the character with 0 is itself, with 1 it breaks a control string and is nothing.
ESCAPE = "␛"
LEARNT = "assistant"

_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(f"{ESCAPE}([01])")


class Malformed(ValueError):
    """The rendered text is not in the grammar."""


def escape(text: str) -> str:
    text = text.replace(ESCAPE, f"{ESCAPE}0")
    while _CONTROL.search(text):
        text = _CONTROL.sub(lambda m: f"{m[0][0]}{ESCAPE}1{m[0][1:]}", text)
    return text


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: ESCAPE if m[1] == "0" else "", text)


def _write(role: str, text: str, learnt: bool) -> tuple[str, tuple[int, int] | None]:
    """A turn, and where in it the loss mask is."""
    head = f"{OPEN}{role}{BEGIN}"
    if not learnt:
        return f"{head}{text}{END}{CLOSE}", None
    head += END
    return f"{head}{text}{CLOSE}", (len(head), len(head) + len(text))


def parse(rendered: str) -> Iterator[tuple[str, str]]:
    """The (role, text) of each turn. Reads control strings from left to right and never goes back."""
    marks = list(_CONTROL.finditer(rendered))
    at = end = 0

    def expect(what: str) -> str:
        """Text up to the next control string, which has to be `what`."""
        nonlocal at, end
        if at == len(marks) or marks[at][0] != what:
            raise Malformed(f"{what} expected after character {end}")
        between, end = rendered[end : marks[at].start()], marks[at].end()
        at += 1
        return between

    while end < len(rendered):
        if expect(OPEN):
            raise Malformed("text between turns")
        role, inner, tail = expect(BEGIN), expect(END), expect(CLOSE)
        if inner and tail:
            raise Malformed("text on both sides")
        yield unescape(role), unescape(inner or tail)


def render_turn(role: str, text: str) -> tuple[str, tuple[int, int] | None]:
    """A turn that the parser reads back as it is, and its loss mask."""
    learnt = role == LEARNT
    for change in (str, escape):
        rendered, mask = _write(change(role), change(text), learnt)
        try:
            if list(parse(rendered)) == [(role, text)]:
                return rendered, mask
        except Malformed:
            continue
    raise Malformed(f"no escape makes this turn readable: {role!r}")


def _sorted_turns(conversations: DataFrame) -> DataFrame:
    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return turns.repartition(shuffle_partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def formatted_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, n (the turn's place), rendered text and loss mask (mask_start, mask_end, null if none) of every turn, in order within partitions."""

    def render(batches):
        last, n = None, 0
        for batch in slices(batches):
            rows = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                n = n + 1 if last == (conv,) else 0
                last = (conv,)
                rendered, mask = render_turn(role, text)
                rows.append((conv, n, rendered, *(mask or (None, None))))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "n", "rendered", "mask_start", "mask_end"])

    return _sorted_turns(conversations).mapInArrow(render, "conv_id long, n long, rendered string, mask_start long, mask_end long")


def format_digests(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the rendered text."""

    def digest(batches):
        state, out = None, []
        for batch in slices(batches):
            for conv, rendered, start, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "rendered", "mask_start", "mask_end")), strict=True):
                if state is None or state[0] != conv:
                    if state is not None:
                        out.append(closed(state))
                    state = [conv, 0, sha256(), 0, sha256(), 0]
                for role, text in parse(rendered):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                if start is not None:
                    learnt = unescape(rendered[start:end])
                    state[3] += len(learnt)
                    state[4].update(learnt.encode())
                state[5] += len(rendered)
            if len(out) >= 1024:
                yield batch_of(out)
                out = []
        if state is not None:
            out.append(closed(state))
        if out:
            yield batch_of(out)

    def closed(s: list) -> tuple:
        return s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    # The rendered turns arrive in the order in which the partition was sorted.
    return formatted_turns(conversations).mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


PROBE = (-7, [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")])


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and one whose texts are control strings."""
    rows = [(PROBE[0], i, role, text) for i, (role, text) in enumerate(PROBE[1])]
    probe = conversations.sparkSession.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").union(probe)


_SQL_CONTROL = "|".join(re.sub(r"([\[\]|])", r"\\\1", c) for c in CONTROLS)

ORACLE_SQL = rf"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select {PROBE[0]}, 0, 'user', '{PROBE[1][0][1]}' union all select {PROBE[0]}, 1, 'assistant', '{PROBE[1][1][1]}'
), sized as (
  select *, {len(OPEN + BEGIN + END + CLOSE)} + length(role) + length(text)
    + 2 * (len(regexp_extract_all(text, '{_SQL_CONTROL}')) + length(text) - length(replace(text, '{ESCAPE}', ''))) as n
  from turns
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
  cast(sum(case when role = '{LEARNT}' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = '{LEARNT}' then text end, '' order by turn), '')) as loss_sha256, cast(sum(n) as bigint) as formatted_chars
from sized group by conv_id
"""
