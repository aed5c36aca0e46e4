"""The entry works with and without the optional text operators."""

import subprocess
import sys
import textwrap
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_registry():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert len(queries) > 50 and set(oracle) <= set(queries)


def test_entry_without_text_operators(tmp_path):
    for name in ("__spark_entry__.py", "bench.py"):
        (tmp_path / name).write_text((ROOT / name).read_text())
    for f in (ROOT / "readloom").rglob("*.py"):
        if "llm" not in f.parts:
            to = tmp_path / f.relative_to(ROOT)
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_text(f.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(k.startswith('op') for k in q) and len(q) > 40 and e.oracle_sql()"
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_flagship(spark):
    assert entry.entry(spark).columns == ["chrom", "pos", "ref", "alt", "allele_depth", "mapq_sum", "fwd", "rev"]
