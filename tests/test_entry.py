import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from ledgerline import catalog

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_its_sql(spark, sf, name):
    import duckdb

    rows = catalog.queries()[name](spark, sf).collect()
    sql = catalog.oracle_sql().get(name)
    if not sql:
        return
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    want = sorted(str([_plain(v) for _, v in sorted(zip(names, r, strict=True))]) for r in found.fetchall())
    got = sorted(str([_plain(v) for _, v in sorted(r.asDict().items())]) for r in rows)
    assert got == want


def _plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_training_data_package(tmp_path):
    """The entry and the rest of the library work when that package and its pipeline are gone."""
    code = "import sys; sys.modules['ledgerline.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert not any(q.startswith('op') and q[2].isdigit() for q in e.queries()); assert 'month_summary' in e.queries(); e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, env={"PYTHONPATH": str(ROOT), "PATH": "/usr/bin"}, check=False).returncode == 0


def test_nothing_else_imports_the_package():
    for p in (ROOT / "ledgerline").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "ledgerline").parts:
            assert "llm" not in p.read_text(), p
