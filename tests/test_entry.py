import subprocess
import sys


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    found = e.entry(spark).groupBy("q_id").count().collect()
    assert found and all(r["count"] == 10 for r in found)
    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_the_optional_parts():
    code = "import sys; sys.modules['lexiquarry.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(k.startswith('op') for k in q)"
    assert subprocess.run([sys.executable, "-c", code], check=False).returncode == 0
