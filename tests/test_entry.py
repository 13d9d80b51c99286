"""The registry, with and without the training-data subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent


def test_registry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert "page_links" in e.queries()


def test_without_the_subpackage():
    code = "import sys; sys.modules['pagewright.llm'] = None; import __spark_entry__ as e; assert 'page_links' in e.queries(); assert not any(k.startswith('op') for k in e.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_imports_the_subpackage():
    others = [p for p in (ROOT / "pagewright").rglob("*.py") if "llm" not in p.parts]
    assert others and not any("llm" in p.read_text() for p in others)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
