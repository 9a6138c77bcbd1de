import hashlib
import os
import shutil
import subprocess
import sys

import llm_fixtures as X
import numpy as np
import pytest
import test_decontam
import test_neardup
from llm_fixtures import docs, empty  # noqa: F401

import corpus_pipeline as C
from clauselens.llm import langid, pieces, quality_rules
from clauselens.llm.queries import ORACLE, QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{at}/documents.parquet")
    X.labels_df(spark).write.parquet(f"{at}/labels.parquet")
    X.benchmark_df(spark).write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages_and_names():
    assert [n for n, _ in C.STAGES] == ["language_id", "quality_rules", "near_dedup", "decontamination", "sentencepiece"]
    assert {k.split("_")[0] for k in QUERIES} == {f"op{i}" for i in range(1, 14)} and set(ORACLE) <= set(QUERIES)


def test_run_equals_brute_force(spark, docs, folder):
    rows = [(d, t) for d, t, _ in X.documents()]
    model = langid.Model(langid.learn(docs))
    left = [(d, t) for d, t in rows if (p := model.predict(t))[0] != "und" and p[1] >= langid.MIN_MARGIN]
    stage1 = X.documents_df(spark, [(d, t, next(z for x, y, z in X.documents() if (x, y) == (d, t))) for d, t in left])
    judge = quality_rules.fit(quality_rules.counted(stage1), X.labels_df(spark))
    left = [(d, t) for d, t in left if judge.judge(np.array([quality_rules.doc_counts(t.encode())]))[2][0]]
    comp = test_neardup.brute(left, 5, 80)
    one = {}
    for d, t in left:
        if d is None or comp[d] == d:
            one.setdefault((d, None if d is not None else t), t)
    left = [(d, t) for (d, _), t in one.items()]
    items = [tuple(r) for r in X.benchmark_df(spark).collect()]
    clean = {repr(r[0]) + str(r[1]) for r in test_decontam.brute([(d, t, None) for d, t in left], items) if not r[5]}
    bad = {r[0] for r in test_decontam.brute([(d, t, None) for d, t in left], items) if r[5]}
    assert clean and bad
    left = [(d, t) for d, t in left if d not in bad]
    enc = pieces.Encoder(pieces.read_model())
    want = sorted(((d, hashlib.sha256(enc.encode([t])[0][0]).hexdigest()) for d, t in left), key=repr)
    out = C.run(spark, folder).collect()
    assert sorted(((r["doc_id"], r["ids_sha256"]) for r in out), key=repr) == want
    for r in out:
        assert hashlib.sha256(np.array(r["ids"], np.int32).tobytes()).hexdigest() == r["ids_sha256"]


def test_stages_keep_the_columns_and_take_empty_tables(spark, docs, empty, folder):
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
        assert stage(spark, empty, folder).count() == 0
    assert C.STAGES[-1][1](spark, empty, folder).count() == 0


def test_entry_imports_without_these_folders(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = ("import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); "
            "assert not [k for k in q if k.startswith('op') and k[2].isdigit() or k == 'pipeline']; assert set(o) <= set(q); print('fine')")
    r = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=120)
    assert r.stdout.strip().endswith("fine"), r.stderr
