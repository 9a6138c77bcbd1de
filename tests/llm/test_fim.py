import hashlib
import random
import re

import numpy as np
import pytest
from llm_fixtures import docs, documents, documents_df, empty  # noqa: F401

from clauselens.llm import fim as M


def brute(text, doc_id, seed="1"):
    t = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in range(0, 32, 8))
    n = len(units)
    if not t or "<P>" in t or "<S>" in t or "<M>" in t or h3 % 100 >= 90:
        return n, "plain", None, None, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    if h4 % 100 < 20:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("n", [1, 63, 64, 65, 1000])
def test_rank_equals_counting(n):
    x = np.random.default_rng(n).integers(0, 4, n).astype(np.uint8)
    m = M.WaveletMatrix(x)
    for i in {0, 1, n // 2, n - 1, n}:
        for s in range(4):
            assert m.rank(s, i) == int((x[:i] == s).sum())


def test_cuts_equal_units():
    rng = random.Random(3)
    for _ in range(300):
        t = "".join(rng.choice("abZ 1é\U0001F642\n\x00<>P") for _ in range(rng.randint(1, 40)))
        u = M.Units(t.encode())
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
        assert u.n == len(units)
        for k in range(u.n + 1):
            head = "".join(units[:k])
            assert u.cut_after(k) == len(head.encode())
            assert u.points(u.cut_after(k)) == len(head)


def test_rows_equal_brute_force(spark, docs):  # noqa: F811
    extra = [(2000 + i, t, None) for i, t in enumerate(["a<P>b", "<M>", "x" * 70, "<" * 50, "S>" * 40, ">P<M", "A b"] * 8)]
    rows = documents() + extra
    got = M.digests(M.transform(documents_df(spark, rows))).collect()
    want = []
    for i, t, _ in rows:
        n, form, p, m, out = brute(t, i)
        want.append((i, n, form, p, m, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_output_is_restored(spark):
    rows = [(i, t, None) for i, t in enumerate(["<", "<<S", "P><P", "a<S", "<M", "<P", "é\U0001F642 <x>"] * 30)]
    out = M.transform(documents_df(spark, rows)).select("doc_id", M.restored().alias("t")).collect()
    assert {r["doc_id"]: r["t"] for r in out} == {i: t for i, t, _ in rows}


def test_empty_table(empty):  # noqa: F811
    assert M.digests(M.transform(empty)).count() == 0
