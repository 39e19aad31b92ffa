import shutil
import subprocess
import sys

import pytest

from ledgerline.plans.queries import ORACLE_SQL, QUERIES
from tests.conftest import ROOT, same_rows


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, sf_dir, duck, name):
    same_rows(QUERIES[name](spark, sf_dir), duck, ORACLE_SQL[name])


def test_check_digits_pass_the_luhn_test(spark, sf_dir):
    for r in QUERIES["check_digits"](spark, sf_dir).limit(200).collect():
        digits = [int(c) for c in f"{r['o_orderkey']}{r['digit']}"][::-1]
        assert sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(digits)) % 10 == 0


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["record_id", "left_amount", "right_amount", "left_ts", "right_ts", "delta", "class", "flags"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_entry_imports_without_the_language_model_operators(tmp_path):
    shutil.copytree(ROOT / "ledgerline", tmp_path / "ledgerline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'reconcile_orders' in e.queries() and 'pipeline' not in e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_a_broken_dependency_of_the_operators_is_told(tmp_path):
    shutil.copytree(ROOT / "ledgerline", tmp_path / "ledgerline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import a_module_that_nobody_has")
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True)
    assert said.returncode and "a_module_that_nobody_has" in said.stderr


def test_the_console_lists_queries():
    said = subprocess.run([sys.executable, "-m", "ledgerline", "list"], cwd=ROOT, capture_output=True, text=True, check=True)
    assert "reconcile_orders" in said.stdout.split()
    assert subprocess.run([sys.executable, "-m", "ledgerline", "run", "nothing", "x"], cwd=ROOT, capture_output=True).returncode == 2


def test_the_console_stores_and_replays_evaluations(spark, sf_dir, tmp_path, capsys):
    from ledgerline.__main__ import main

    store = str(tmp_path / "store")
    assert main(["evaluate", sf_dir, store, "first"]) == 0 and main(["evaluations", store]) == 0
    assert main(["replay", sf_dir, store, "first"]) == 0 and main(["show", store, "first", "3"]) == 0
    assert "amount_mismatch" in capsys.readouterr().out
