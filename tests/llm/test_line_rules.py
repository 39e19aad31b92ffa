import random

from ledgerline.llm import line_rules
from ledgerline.llm.line_rules import line_frequency_rules, measures, repeated_words, without_lines
from ledgerline.llm.queries import QUERIES
from tests.conftest import same_rows
from tests.llm.conftest import odd_rows


def test_query_gives_the_rows_of_its_sql(spark, sf_dir, duck):
    same_rows(QUERIES["op2_line_frequency"](spark, sf_dir), duck, line_rules.ORACLE_SQL)


def test_repeated_words_by_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(0, 14))]
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
        assert repeated_words(words) == len(covered)


def test_measures():
    assert measures(None) == measures("") == (0, 0, 0, 0, 0)
    assert measures("a|b é#\n\n \na|b é#\x0bx\u00a0y") == (5, 13, 4, 0, 0)
    assert measures("x\nx\n \n \nx") == (3, 3, 0, 2, 0)


def page(i, boilerplate, own=60):
    return "\n".join([boilerplate, " ".join(f"w{i}x{j}" for j in range(own))])


def test_frequent_lines_go_and_depleted_documents_are_rejected(make_docs):
    banner = "Read our  TERMS of 2024 use"
    rows = [(i, page(i, banner), "h") for i in range(25)] + [(100 + i, page(i, banner.lower().replace("2024", "1999")), "other") for i in range(5)]
    hollow = "\n".join([banner] * 12 + ["few words left"])
    rows += [(200, hollow, "h"), (201, page(9, banner, 10), "h")]
    found = {r["doc_id"]: r for r in line_frequency_rules(make_docs(rows, clashing=True)).collect()}
    assert found[0]["kept"] and found[0]["n_left_words"] == 60 and len(found[0]["removed_lines"]) == 1
    assert found[100]["kept"] and found[100]["n_left_words"] == 66
    assert not found[200]["kept"] and found[201]["base_failed"]
    kept = {r["doc_id"]: r for r in without_lines(make_docs(rows, clashing=True)).collect()}
    assert set(kept) == set(range(25)) | set(range(100, 105))
    assert banner not in kept[3]["text"] and kept[3]["n_chars"] == len(kept[3]["text"])
    assert kept[101]["text"] == rows[26][1]


def test_the_verdict_of_the_method_decides(spark, make_docs, duck, tmp_path):
    """Documents made of a host's stock lines are rejected, its articles and copies of a whole document are not; as by the SQL."""
    letters = "abcdefghijklmnopqrst"
    stock = ["\n".join(" ".join(f"stock{c}{letters[k]}{letters[j]}" for j in range(9)) for k in range(12)) for c in "xyz"]
    own = lambda i, n: " ".join(f"own{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(n))
    rows = [(i, f"{stock[i % 3]}\n{own(i, 3)}", "h") for i in range(90)]  # near copies of one another: each of three counts once
    rows += [(100 + i, "\n".join([*(x for k, x in enumerate("\n".join(stock).split("\n")) if (k * 7 + i) % 5 == 0), own(i, 2)]), "h") for i in range(60)]
    rows += [(200 + i, f"{stock[0].split(chr(10))[i % 12]}\n{own(i, 70)}", "h") for i in range(300)]
    rows += [(600 + i, own(399, 80), "h") for i in range(50)] + [(700, stock[1], "other")]
    found = {r["doc_id"]: (r["kept"], r["base_failed"]) for r in line_frequency_rules(make_docs(rows)).collect()}
    assert all(found[i] == (True, False) for i in [*range(200, 500), *range(600, 650), 700])
    # The first stock's lines stand in articles too; the others' only in what counts as a copy of one document.
    assert {i for i, (kept, failed) in found.items() if not kept and not failed} == set(range(0, 90, 3))
    import duckdb

    make_docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    same_rows(QUERIES["op2_line_frequency"](spark, str(tmp_path)), con, line_rules.ORACLE_SQL)


def test_rows_that_stay_as_they_are_are_not_shuffled(spark, make_docs):
    plan = without_lines(make_docs([(i, page(i, "a banner of all"), "h") for i in range(30)]))._jdf.queryExecution().executedPlan().toString()
    kept = plan.split("Union")[1].split("MapInArrow")[0]
    # What is shuffled are the words of the filter over those that change.
    assert kept.count("Exchange hashpartitioning") == kept.count("Exchange hashpartitioning(_groupingexpression") and "SortMergeJoin" not in kept


def test_copies_make_no_boilerplate(make_docs):
    rows = [(i, page(1, "a line that is copied"), "h") for i in range(60)]
    assert all(r["kept"] for r in line_frequency_rules(make_docs(rows)).collect())
    assert without_lines(make_docs(rows)).count() == 60


def test_odd_tables(make_docs):
    rows = odd_rows()
    found = line_frequency_rules(make_docs(rows)).collect()
    assert len(found) == len(rows) and not any(r["kept"] for r in found if r["n_words"] == 0)
    assert line_frequency_rules(make_docs([])).count() == 0
    same = make_docs([(8, page(8, "x"), None)] * 2)
    assert [r["text"] for r in without_lines(same).collect()] == [page(8, "x")] * 2


def test_very_common_lines_and_others_are_told_alike(make_docs, monkeypatch):
    """With all lines taken for very common, none, and some."""
    rows = [(i, "\n".join(["a line of all of them", "a line of every third " + "abc"[i % 3], " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}w{j}" for j in range(60))]), "h") for i in range(90)]
    found = []
    for parts in (1, 50, 10**9):
        monkeypatch.setattr(line_rules, "HOT_LINES", parts)
        found.append(sorted((r["doc_id"], r["kept"], r["n_left_words"]) for r in line_frequency_rules(make_docs(rows)).collect()))
    assert found[0] == found[1] == found[2] == [(i, True, 60) for i in range(90)]


def test_one_text_in_two_hosts_is_cleaned_by_its_own_host(make_docs):
    banner = "the banner of one host alone"
    rows = [(i, page(i, banner), "h") for i in range(25)] + [(3, page(3, banner), "other")]
    found = sorted((r["source"], r["text"].startswith(banner)) for r in without_lines(make_docs(rows)).collect() if r["doc_id"] == 3)
    assert found == [("h", False), ("other", True)]
