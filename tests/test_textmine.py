"""Sentence split, TF-IDF and summary against a brute-force Python version."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from clauselens.operators import textmine as TM
from clauselens.plans import stopwords

TEXTS = [
    "Payment is due within thirty days. Late payment incurs a penalty of two percent. (See notice.) ok.",
    "Either party may terminate this agreement for convenience. Termination requires written notice to the other party.",
    "Payment is due within thirty days. The warranty covers defects in materials and workmanship for one year.",
    "Confidential information must not be disclosed. Arbitration shall take place in the city of the defendant.",
]


def py_split(text):
    text = re.sub(r"\s+", " ", (text or "").strip())
    out, seen = [], set()
    for s in re.split(r"(?<=[.?!])\s+(?=[A-Z0-9(])", text):
        s = s.strip()
        if 30 <= len(s) <= 400 and s not in seen:
            out.append(s)
            seen.add(s)
    return out


def py_scores(sentences, max_features=4000):
    stop = set(stopwords.english())
    docs = []
    for s in sentences:
        tok = [t for t in re.findall(r"\w{2,}", s.lower()) if t not in stop]
        docs.append(Counter(tok + [a + " " + b for a, b in zip(tok, tok[1:])]))
    ctf, df = Counter(), Counter()
    for d in docs:
        ctf.update(d)
        df.update(d.keys())
    vocab = sorted(ctf, key=lambda t: (-ctf[t], t))[:max_features]
    n = len(docs)
    idf = {t: math.log((1 + n) / (1 + df[t])) + 1 for t in vocab}
    out = []
    for d in docs:
        w = [c * idf[t] for t, c in d.items() if t in idf]
        norm = math.sqrt(sum(x * x for x in w))
        out.append(sum(w) / norm if norm else 0.0)
    return out


def sentences_df(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    s = TM.split_sentences(docs, ["doc_id"], "text")
    return s.select("*", F.struct("doc_id", "sentence_pos").alias("sid"))


def test_split_matches_python(spark):
    got = sentences_df(spark).orderBy("doc_id", "sentence_pos").collect()
    exp = [(i, s) for i, t in enumerate(TEXTS) for s in py_split(t)]
    assert [(r["doc_id"], r["sentence"]) for r in got] == exp


def test_tfidf_matches_brute_force(spark):
    all_sents = [s for t in TEXTS for s in py_split(t)]
    for cap in (4000, 7):
        exp = dict(zip(all_sents, py_scores(all_sents, cap)))
        got = {r["sentence"]: (r["score"], r["m"]) for r in TM.tfidf_scores(sentences_df(spark), max_features=cap).collect()}
        assert set(got) == set(exp)
        for s, (score, m) in got.items():
            assert abs(score - exp[s]) < 1e-9, (cap, s)
            assert m == all_sents.count(s)


def test_summary_greedy_equivalence(spark):
    all_sents = [s for t in TEXTS for s in py_split(t)]
    base = py_scores(all_sents)
    kws = [k.lower() for k in TM.P.RISK_KEYWORDS]
    scored = [(round(b + 0.25 * sum(s.lower().count(k) for k in kws), 9), i, s) for i, (b, s) in enumerate(zip(base, all_sents))]
    picked, seen = [], set()
    for sc, i, s in sorted(scored, key=lambda x: (-x[0], x[1])):
        if s[:80].lower() in seen:
            continue
        picked.append(s)
        seen.add(s[:80].lower())
        if len(picked) == 3:
            break
    got = [r["sentence"] for r in TM.corpus_summary(sentences_df(spark), top_k=3).collect()]
    assert got == picked


# ------------------------------------------------------------------ one corpus for all

def corpus(spark, **kw):
    return TM.SentenceCorpus(sentences_df(spark), **kw)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def py_vectors(max_features=4000):
    """Distinct sentences in order with their occurrences and normalised weights."""
    occ = [s for t in TEXTS for s in py_split(t)]
    stop = set(stopwords.english())
    bags = []
    for s in occ:
        tok = [t for t in re.findall(r"\w{2,}", s.lower()) if t not in stop]
        bags.append(Counter(tok + [a + " " + b for a, b in zip(tok, tok[1:])]))
    ctf, df = Counter(), Counter()
    for b in bags:
        ctf.update(b)
        df.update(b.keys())
    vocab = sorted(ctf, key=lambda t: (-ctf[t], t))[:max_features]
    idf = {t: math.log((1 + len(occ)) / (1 + df[t])) + 1 for t in vocab}
    out = {}
    for s, b in zip(occ, bags):
        w = {t: c * idf[t] for t, c in b.items() if t in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out[s] = {t: x / norm for t, x in w.items()} if norm else {}
    return out


def test_nearest_members_equal_brute_force_on_fixed_centroids(spark):
    centroids = [(0, "payment", 0.8), (0, "due", 0.4), (1, "terminate", 0.5), (1, "written notice", 0.5), (2, "nowhere", 1.0), (2, "warranty", 0.1)]
    for cap in (4000, 9):
        vectors = py_vectors(cap)
        want = {}
        for s, v in vectors.items():
            d = []
            for theme in (0, 1, 2):
                c = {t: w for x, t, w in centroids if x == theme}
                d.append((round(math.sqrt(sum((v.get(t, 0) - c.get(t, 0)) ** 2 for t in set(v) | set(c))), 9), theme))
            want[s] = min(d)
        order = list(vectors)
        for theme in (0, 1, 2):
            want_top = sorted((d, order.index(s), s) for s, (d, t) in want.items() if t == theme)[:2]
            got = corpus(spark, max_features=cap).examples(centroids, 2).where(F.col("theme") == theme).orderBy("rank").collect()
            assert [r["sentence"] for r in got] == [s for _, _, s in want_top]
            assert all(abs(r["distance"] - d) < 1e-8 for r, (d, _, _) in zip(got, want_top))


def test_vectors_equal_the_weights(spark):
    c = corpus(spark)
    terms = [t for t, _ in c.vocabulary]
    want = py_vectors()
    text = {(r["h1"], r["h2"]): r["sentence"] for r in c.distinct.collect()}
    for r in c.vectors.collect():
        got = {terms[i]: w for i, w in zip(r["features"].indices, r["features"].values)}
        v = want[text[r["h1"], r["h2"]]]
        assert set(got) == set(v) and all(abs(got[t] - v[t]) < 1e-9 for t in v)


def test_themes_have_terms_and_examples(spark):
    c = corpus(spark)
    centroids = c.fit_themes(k=3)
    assert centroids == c.fit_themes(k=3)
    terms = TM.clause_themes(c, k=3, top_terms=4).collect()
    assert {r["theme"] for r in terms} == {0, 1, 2} and max(r["rank"] for r in terms) == 4
    ex = c.examples(centroids, 6).collect()
    assert sorted(r["sentence"] for r in ex) == sorted(py_vectors())        # few sentences: all are examples
    assert all(0 <= r["distance"] <= 2 for r in ex)


def test_tokenised_once_and_no_sort_aggregate(spark):
    c = corpus(spark)
    for df in (c.scores(), c.summary(), c.examples([(0, "payment", 1.0)])):
        plan = plan_of(df)
        assert "SortAggregate" not in plan and "regexp_extract_all" not in plan and "split(" not in plan
    built = plan_of(TM.distinct_sentences(sentences_df(spark)))
    assert "SortAggregate" not in built and "WindowGroupLimit" in built


def test_empty_corpus(spark):
    none = sentences_df(spark).where("false")
    c = TM.SentenceCorpus(none)
    assert c.scores().count() == c.summary().count() == c.examples(c.fit_themes()).count() == TM.clause_themes(c).count() == 0


def test_one_very_common_sentence_is_one_row_per_task(spark):
    rows = [(i, "The same sentence stands in very many of all documents.") for i in range(3000)] + [(9000, "Another sentence that stands here once only.")]
    s = spark.createDataFrame(rows, "doc_id long, sentence string").select("*", F.struct("doc_id").alias("sid"))
    d = {r["sentence"][:3]: (r["m"], r["first_sid"][0]) for r in TM.distinct_sentences(s).collect()}
    assert d == {"The": (3000, 0), "Ano": (1, 9000)}
