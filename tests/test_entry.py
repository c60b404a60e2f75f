"""The driver contract, with and without the optional parts."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_runs(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 1 and 0 < rows[0]["mrr"] < 1


def test_oracles_have_queries():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_the_corpus_operators(tmp_path):
    """A copy that lacks the subpackage and the pipeline still offers all other queries."""
    for x in ("__spark_entry__.py", "quillon"):
        (tmp_path / x).symlink_to(ROOT / x) if x.endswith(".py") else (tmp_path / x).mkdir()
    for x in (ROOT / "quillon").iterdir():
        if x.name not in ("llm", "__pycache__"):
            (tmp_path / "quillon" / x.name).symlink_to(x)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(n.startswith('op') for n in q); e.oracle_sql(); print(len(q))"
    entry = tmp_path / "__spark_entry__.py"
    text = (ROOT / "__spark_entry__.py").read_text()
    entry.unlink()
    entry.write_text(text)
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
