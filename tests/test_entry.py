import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark, small):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_optional_subpackage():
    """Nothing outside the subpackage needs it."""
    code = "import sys; sys.modules['folioquarry.llm'] = None; import __spark_entry__ as e; assert e.queries() and not any(n[0] == 'p' and n[1].isdigit() for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
    for p in (ROOT / "folioquarry").rglob("*.py"):
        if "llm" not in p.parts:
            assert "import llm" not in p.read_text() and ".llm" not in p.read_text()
