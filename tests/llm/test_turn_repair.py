import random
import re
import zlib
from hashlib import sha256
from itertools import product

import pytest

from ledgerline.llm.queries import QUERIES
from ledgerline.llm.turn_repair import AT_END, ORACLE_SQL, damaged, edits, repair_digests, repaired_turns
from tests.conftest import same_rows

SCHEMA = "conv_id long, turn long, role string, text string"
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        out += [(conv, turn, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return out


def cheapest(rows):
    """Of all edits, by trying them: the least (cost, letters), and the repaired turns."""
    best = 2 * len(rows), "D" * len(rows), []

    def go(i, letters, cost, turns, in_a_row):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] or " " for r, _ in turns)):
            found = cost, letters, turns
            best = min(best, found, key=lambda x: x[:2])
        if in_a_row < 2:
            for role in ("user", "assistant"):
                go(i, letters + "I", cost + 5, [*turns, (role, "")], in_a_row + 1)
        if i < len(rows):
            fault, role, text = rows[i]
            go(i + 1, letters + "D", cost + 2, turns, 0)
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                go(i + 1, letters + "K", cost + more, [*turns, (role, text)], 0)
                for other in {"user", "assistant"} - {role}:
                    go(i + 1, letters + "R", cost + 1 + more, [*turns, (other, text)], 0)

    go(0, "", 0, [], 0)
    return best


def brute_report(rows, ids):
    out = {}
    for conv in ids:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        judged, before = [], set()
        for _, _, role, text in own:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in before else "truncated" if body[-1] not in ".!?" else None
            before.add((role, text))
            judged.append((fault, role, text))
        turns = [t for _, t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(judged, judged[1:])]
        cost, letters, repaired = cheapest(judged)
        counts = [sum(f == x for f, _, _ in judged) for x in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, letters, sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest())
    return out


def told(df):
    return {r["conv_id"]: (*(r[c] for c in COUNTS), r["audit"], r["repaired_sha256"]) for r in df.collect()}


def made(seed, n_convs=40, most=4):
    rng = random.Random(seed)
    texts = ["Fine.", "Good!", "cut off", "", " \n", "Why?", "Tail. \t", None, "Fine.", "ünï🙂."]
    rows = []
    for conv in range(n_convs):
        for turn in range(rng.randrange(0, most + 1)):
            rows.append((conv, rng.choice([turn, turn, turn + 1, None]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""]), rng.choice(texts)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_edits_by_trying_them_all(spark, seed):
    rows = made(seed)
    found = told(repair_digests(damaged(spark.createDataFrame(rows, SCHEMA))))
    assert found == brute_report(brute_damage(rows), {r[0] for r in rows})


def test_every_short_conversation(spark):
    """All orders of roles and faults, undamaged."""
    kinds = list(product(["system", "user", "assistant", "tool"], ["Whole {}.", "cut {}"]))
    rows = [(n, i, role, text.format(i)) for n, turns in enumerate(product(kinds, repeat=3)) for i, (role, text) in enumerate(turns)]
    assert told(repair_digests(spark.createDataFrame(rows, SCHEMA))) == brute_report(rows, {r[0] for r in rows})


def test_repaired_turns_are_in_the_grammar(spark):
    rows = made(7, 60, 9)
    turns: dict = {}
    for r in repaired_turns(damaged(spark.createDataFrame(rows, SCHEMA))).collect():
        turns.setdefault(r["conv_id"], []).append((r["place"], r["role"][:1]))
    assert turns and all(re.fullmatch("s?(ua)+", "".join(i for _, i in sorted(x))) for x in turns.values())


def test_a_conversation_with_a_third_of_all_rows_and_odd_ones(spark):
    rows = [(None, None, None, None), (None, 3, "user", "No id."), (5, None, "user", "x" * 300_000 + "."), (5, 0, "assistant", "Yes."), (5, 0, "assistant", "Yes.")]
    rows += [(6, i, "user" if i % 2 == 0 else "assistant", f"Turn {i}.") for i in range(2000)] + [(6, 5, "user", "Turn 4.")] * 50
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as gone_", "1 as place", "'y' as edit", "2 as number").repartition(5)
    found = {r["conv_id"]: r for r in repair_digests(df).collect()}
    assert set(found) == {None, 5, 6}
    assert found[6]["duplicate"] == 50 and found[6]["cost"] == 100 and found[6]["gaps"] == 0 and found[6]["audit"].count("K") == 2000
    assert found[5]["audit"] == "KKD" and found[5]["cost"] == 2 and found[None]["blank"] == 1


def test_nothing_and_what_is_all_gone(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair_digests(damaged(none)).count() == edits(none).count() == 0
    gone = next(c for c in range(200) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 == 0 for t in (0,)))
    (r,) = repair_digests(damaged(spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA))).collect()
    assert [r[c] for c in COUNTS] == [0] * 6 and r["audit"] == "" and r["repaired_sha256"] == sha256(b"").hexdigest()
    assert AT_END == (0, 10, 5, 0)


def test_query_gives_the_rows_of_its_sql(spark, sf_dir, duck):
    same_rows(QUERIES["op11_turn_repair"](spark, sf_dir), duck, ORACLE_SQL)
