"""The driver's contract: every registered query against its SQL, and the entry without the optional modules."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT, DATA = Path(__file__).resolve().parents[1], Path(os.environ.get("SF_DIR", "/root/testdata/sf0.001"))
sys.path.insert(0, str(ROOT))
import millrace.plans.control_queries  # noqa: E402,F401
import millrace.plans.governance_queries  # noqa: E402,F401
import millrace.plans.sync_queries  # noqa: E402,F401
from millrace.plans.edge_queries import ORACLE, QUERIES  # noqa: E402


def rows(df):
    return sorted(tuple(repr(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, str(DATA)).toPandas()
    if name in ORACLE:
        assert rows(got) == rows(duck.execute(ORACLE[name]).df())
    else:
        assert len(got)


def test_entry_without_the_optional_modules(tmp_path):
    """A copy of the repository without them still imports, and the engine never asks for them."""
    for p in ("__spark_entry__.py",):
        (tmp_path / p).write_text((ROOT / p).read_text())
    for f in (ROOT / "millrace").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            to = tmp_path / f.relative_to(ROOT)
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_text(f.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'flagship_weekly_signups' in q and not any(n.startswith('op1_') for n in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)
