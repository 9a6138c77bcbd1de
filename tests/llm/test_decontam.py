import hashlib
import re

import pytest

from clauselens.llm import decontam
import llm_fixtures as X
from llm_fixtures import docs, empty  # noqa: F401

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(docs, items):
    out = []
    for d, t, _ in docs:
        w = WORD.findall(low(t))
        hit, found = set(), set()
        for item, text in items:
            v = WORD.findall(low(text))
            k = min(10, len(v))
            wins = {tuple(v[i:i + k]) for i in range(len(v) - k + 1)} if v else set()
            for i in range(len(w) - k + 1 if v else 0):
                if tuple(w[i:i + k]) in wins:
                    hit |= set(range(i, i + k))
                    if item is not None:
                        found.add(str(item))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_pairs", [decontam.BLOCK_PAIRS, 7])
def test_matches_brute_force_in_one_block_and_in_many(spark, docs, block_pairs):
    bench = X.benchmark_df(spark)
    got = decontam.decontaminate(docs, bench, block_pairs=block_pairs).collect()
    want = brute([r for r in X.documents() if len(r[1] or "") < 100_000 or r[0] != 1010] + [r for r in X.documents() if r[0] == 1010],
                 [tuple(r) for r in bench.collect()])
    assert sorted(map(tuple, got), key=repr) == want
    assert sum(r["contaminated"] for r in got) >= 4


def test_filter_keeps_the_clean_rows_whole(spark, docs):
    bench = X.benchmark_df(spark)
    bad = {r["doc_id"] for r in decontam.decontaminate(docs, bench).where("contaminated").collect()}
    for pairs in (decontam.BLOCK_PAIRS, 7):
        left = decontam.drop_contaminated(docs, bench, block_pairs=pairs)
        assert left.columns == docs.columns
        assert left.count() == docs.where(f"doc_id IS NULL OR doc_id NOT IN ({','.join(map(str, bad))})").count()


def test_empty_tables(spark, docs, empty):
    bench = X.benchmark_df(spark)
    assert decontam.decontaminate(empty, bench).count() == 0
    none = decontam.decontaminate(docs, bench.limit(0))
    assert none.count() == docs.count() and not none.where("contaminated").count()
    assert decontam.drop_contaminated(docs, bench.limit(0)).count() == docs.count()
