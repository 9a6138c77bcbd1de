import zlib

import pytest
import zstandard

from clauselens.llm import langid as L
import llm_fixtures as X
from llm_fixtures import docs, empty  # noqa: F401


def test_edge_rows_and_split(spark, docs):
    rows = {}
    for r in L.identify(docs).collect():
        rows.setdefault(r["doc_id"], r)
        assert 0 <= r["score"] <= 1
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    for d in (1000, 1001, 1002, 1004):
        assert rows[d]["lang_pred"] == "und" and rows[d]["rejected"] and rows[d]["score"] == 0
    truth = {d: lang for d, _, lang in X.documents() if d is not None and d < 60}
    assert sum(rows[d]["lang_pred"] == lang for d, lang in truth.items()) >= 58
    assert rows[1008]["lang_pred"] == "en" and not rows[1008]["rejected"]


def test_predictions_do_not_depend_on_lang_source_or_id(spark, docs):
    a = L.identify(docs).select("lang_pred", "score").collect()
    other = docs.selectExpr("doc_id + 1 AS doc_id", "text", "'xx' AS lang", "'y' AS source")
    b = L.identify(other, training=docs).select("lang_pred", "score").collect()
    assert a == b


def test_held_out_text_is_not_learned(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 4 == 2)
    seen = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 4 != 2)
    df = X.documents_df(spark, [(held, "geheim " * 20, "de"), (seen, "open text here", "en")])
    learned = L.learn(df)
    assert list(learned) == ["en"] and b"geheim" not in b"".join(learned.values())


def test_narrow_margin_is_rejected_and_ties_go_to_the_larger_language():
    m = L.Model({"en": b"the and of with", "de": b"the and of with"})
    assert m.predict("the and of") == ("en", 0.0)
    assert L.Model({}).predict("text") == ("und", 0.0)
    lang, score = L.Model({"en": b"some words of a language"}).predict("some words of a language")
    assert lang == "en" and score > 0


def test_copies_do_not_shrink_a_dictionary(spark):
    def rows_of(lang, texts, copies, start):
        ids = (i for i in range(start, start + 10 ** 6) if zlib.crc32(str(i).encode()) % 4 != 2)
        return [(next(ids), t, lang) for t in texts for _ in range(copies)]

    few = [f"wort{chr(97 + i)} " * 4 for i in range(3)]
    many = [f"mot{chr(97 + i // 26)}{chr(97 + i % 26)} " * 4 for i in range(60)]
    rows = rows_of("de", few, 1000, 0) + rows_of("fr", many, 50, 10 ** 6) + rows_of("en", ["one text"], 1, 3 * 10 ** 6)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = L.learn(df, sample_texts=10, slice_chars=600)
    assert list(got) == ["de", "fr", "en"] or list(got) == ["fr", "de", "en"]
    assert len(set(got["de"].split())) == 3 and len(got["fr"].split()) == 10


def test_filter_and_empty(spark, docs, empty):
    kept = L.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == L.identify(docs).where("NOT rejected").count()
    assert L.identify(empty).count() == 0 and L.keep_identified(empty).count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_held_out_accuracy(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    r = L.identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (r.lang == r.lang_pred).mean() > 0.98


def brute(text, dictionaries):
    """(sizes, language, score): every piece with every dictionary, by the definitions."""
    import unicodedata
    if not text or not any(unicodedata.category(c)[0] == "L" for c in text):
        return None, "und", 0.0
    sizes = {}
    for lang, d in dictionaries.items():
        total = 0
        for i in range(0, len(text), 8192):
            seen, words = set(), []
            for w in "".join(c if ord(c) >= 128 or c.isalpha() else " " for c in text[i:i + 8192].lower()).encode().split():
                if w not in seen:
                    seen.add(w)
                    words.append(w)
            c = zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            total += len(c.compress(b" ".join(words)))
        sizes[lang] = total
    ranked = sorted(sizes.items(), key=lambda x: (x[1], list(dictionaries).index(x[0])))
    return list(sizes.values()), ranked[0][0], (ranked[1][1] - ranked[0][1]) / ranked[1][1]


def test_sizes_choice_and_score_equal_brute_force(spark, docs):  # noqa: F811
    learned = L.learn(docs)
    got = {}
    for r in L.identify(docs).collect():
        got.setdefault(r["doc_id"], (r["lang_pred"], r["score"]))
    model = L.Model(learned)
    for d, t, _ in X.documents():
        if d is not None and len(t or "") < 60_000:
            sizes, lang, score = brute(t, learned)
            assert got[d] == (lang, score), d
            assert sizes is None or model.sizes(t) == pytest.approx(sizes, abs=0)


def test_very_many_lang_values(spark):
    ids = (i for i in range(10 ** 6) if zlib.crc32(str(i).encode()) % 4 != 2)
    words = {f"l{k:04d}": " ".join(f"{'abcdefghij'[int(c)]}{c2}{k % 7}x" for c in f"{k:04d}" for c2 in "mnop") for k in range(5000)}
    rows = [(next(ids), f"{w} " * 3, lang) for lang, w in words.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    some = spark.createDataFrame([(i, rows[i][1], None) for i in (7, 4321)] + [(1, None, None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in L.identify(some, training=df).collect()}
    assert got[1]["lang_pred"] == "und" and {got[i]["lang_pred"] for i in (7, 4321)} <= set(words)
    learned = L.learn(df, max_languages=300)
    assert len(learned) == 300 and sum(map(len, learned.values())) <= 2 * L.TOTAL_SLICES * L.SLICE_CHARS


def test_groups_of_languages_give_the_same(monkeypatch):
    name = "abcdefghi"
    dictionaries = {f"l{k}": (f"word{c}word other{c}other thing{c}thing " * 5).encode() for k, c in enumerate(name)}
    texts = ["worddword thingdthing", "otheriother wordiword", None, "12", "nothing known"]
    want = L.Model(dictionaries).predict_all(texts)
    monkeypatch.setattr(L, "HELD", 4)
    monkeypatch.setattr(L.Model, "ROWS", 2)
    assert L.Model(dictionaries).predict_all(texts) == want and want[0][0] == "l3" and want[1][0] == "l8"
