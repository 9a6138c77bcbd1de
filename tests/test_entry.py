"""The driver entry must import anywhere: no jars beside pyspark, no session, no llm folder."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _run(code: str):
    return subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)


def test_entry_imports_without_jars_beside_pyspark():
    r = _run("import pyspark; pyspark.__file__ = '/nowhere/pyspark/__init__.py'\n"
             "import __spark_entry__ as e; assert e.queries() and e.oracle_sql(); print('fine')")
    assert r.stdout.strip().endswith("fine"), r.stderr


def test_entry_survives_a_missing_library():
    r = _run("import sys; sys.modules['zstandard'] = None\n"
             "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(k.startswith('op') and k[2].isdigit() for k in q)\n"
             "assert set(e.oracle_sql()) <= set(q); print('fine')")
    assert r.stdout.strip().endswith("fine") and "training-data queries are left out" in r.stderr, r.stderr


def test_stop_words_equal_spark_default(spark):
    from clauselens.plans.stopwords import english
    from pyspark.ml.feature import StopWordsRemover

    assert list(english()) == StopWordsRemover.loadDefaultStopWords("english")
