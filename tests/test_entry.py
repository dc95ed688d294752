import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_queries_can_be_read_without_a_session():
    code = "import __spark_entry__ as e; from pyspark.sql import SparkSession as S; q, s = e.queries(), e.oracle_sql(); assert 'tier_coverage' in q and set(s) <= set(q); assert S.getActiveSession() is None"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_the_rest_stands_without_the_training_data_package():
    code = "import sys; sys.modules['tarkib.llm'] = None; import __spark_entry__ as e; assert len(e.queries()) > 80 and not any(k[0] == 'p' and k[1].isdigit() for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_imports_it():
    others = [p for p in (ROOT / "tarkib").rglob("*.py") if "llm" not in p.parts]
    assert others and not any("import llm" in p.read_text() or ".llm" in p.read_text() for p in others if p.parent.name != "tarkib")
