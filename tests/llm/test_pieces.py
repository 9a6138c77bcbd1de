import itertools
import random

import llm_fixtures as X
import numpy as np
import pytest
import sentencepiece
from llm_fixtures import docs, empty  # noqa: F401

from clauselens.llm import pieces as P

MODEL = P.read_model()


@pytest.fixture(scope="module")
def enc():
    return P.Encoder(MODEL)


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_proto=MODEL)


def brute(lattice, text, n):
    """The n best scores of a short text by listing every segmentation."""
    s = P.MARK + text.replace(" ", P.MARK)
    found = []

    def go(i, score):
        if i == len(s):
            found.append(score)
            return
        single = False
        for j in range(i + 1, len(s) + 1):
            hit = lattice.pieces.get(s[i:j])
            if hit:
                single |= j == i + 1
                go(j, score + hit[1])
        if not single:
            go(i + 1, score + lattice.unknown_score)

    go(0, 0.0)
    return sorted(found, reverse=True)[:n]


@pytest.mark.parametrize("text", ["a", "hello", "to be", "über uns", "a  b", "x\ny", "日本", "ab 🙂", "aaaaaaaa", "  z"])
def test_n_best_equal_all_segmentations(enc, text):
    got = enc.encode([text])[0]
    want = brute(enc.lattice, text, P.N_BEST)
    assert got[1] == want
    full = enc.n_best_ids(text)
    assert [s for s, _ in full] == want and [len(i) for _, i in full] == got[2]
    assert np.frombuffer(got[0], np.int32).tolist() == full[0][1]
    for _, ids in full:
        assert enc.lattice.decode(ids) == text


def test_best_first_and_decoding_over_long_texts(enc, sp):
    rng = random.Random(2)
    for lang in ("en", "de", "fr"):
        text = X.prose(rng, lang, 400)
        raw, scores, counts, back = enc.encode([text])[0]
        ids = np.frombuffer(raw, np.int32).tolist()
        assert back and sp.decode(ids) == text == enc.lattice.decode(ids)
        assert scores == sorted(scores, reverse=True) and len(scores) == P.N_BEST
        assert scores[0] == sum(sp.get_score(i) for i in ids) and counts[0] == len(ids)
        # the model's own greedy merges are one way through the lattice
        assert scores[0] >= sum(sp.get_score(i) for i in sp.encode(text))


def test_forward_pass_equals_backward_search(enc):
    rng = random.Random(4)
    units = sorted({u for _ in range(20) for u in enc.lattice.units(X.prose(rng, "de", 50))})
    score, gap, ids, ends = enc.matcher.forward(units)
    starts = [0, *ends.tolist()]
    for k, u in enumerate(units):
        ways = enc.lattice.search(u, 2)
        assert ways[0] == (score[k], ids[starts[k]:ends[k]].tolist())
        assert gap[k] == (ways[0][0] - ways[1][0] if len(ways) > 1 else np.inf)


def test_combine_is_the_smallest_sums():
    lists = [[0, 1, 4], [0, 2], [0, 2, 3]]
    want = sorted(sum(x) for x in itertools.product(*lists))
    assert [round(s, 9) for s, _ in P.combine(lists, 18)] == want


def test_a_forgetful_encoder_gives_the_same(monkeypatch, enc):
    rng = random.Random(6)
    texts = [X.prose(rng, "fr", 60) for _ in range(300)] + [None, ""]
    monkeypatch.setattr(P, "UNIT_LIMIT", 10)
    assert P.Encoder(MODEL).encode(texts) == enc.encode(texts)


def test_rows(spark, docs, empty):
    rows = {}
    for r in P.encode(docs, keep_ids=True).collect():
        rows.setdefault(r["doc_id"], []).append(r)
    texts = {}
    for d, t, _ in X.documents():
        texts.setdefault(d, []).append(t)
    assert {d: len(v) for d, v in rows.items()} == {d: len(v) for d, v in texts.items()}
    assert rows[1000][0]["n_pieces"] is None and rows[1000][0]["ids"] is None
    assert rows[1001][0]["n_pieces"] == 0 and rows[1001][0]["ids"] == [] and rows[1001][0]["best_score"] == 0
    assert not rows[1013][0]["roundtrip"]                      # holds the white-space mark itself
    assert all(r["roundtrip"] for d in (0, 1008, 1010) for r in rows[d])
    back = {r["doc_id"]: r["text"] for r in P.decode(P.encode(docs.where("doc_id < 60"), keep_ids=True)).collect()}
    assert back == {d: t[0] for d, t in texts.items() if d is not None and d < 60}
    assert P.encode(empty).count() == 0
