"""Text mining: risky snippets, sentence split, TF-IDF sentence scores,
keyword boost, extractive summary and clause themes (T1-T6).

Plan shape (``SentenceCorpus``):

1. sentences are split inside the row (``split`` with look-around) and
   exploded with deterministic ids ``(doc, snippet, sentence)``;
2. identical sentences are combined by a 128-bit digest (two longs): how often is a hash
   aggregate, the first one a row number with a group limit before the shuffle, so a
   sentence held by a third of all documents is one row per map task. The table
   of distinct sentences is written once per corpus and stays dealt by the digest; their
   terms (unigrams and bigrams without stop words) are read off them;
3. in-sentence counts, sums per sentence and joins back to sentences need no further
   exchange; one ``groupBy(term)`` gives corpus term frequency and document
   frequency (weighted by sentence multiplicity);
4. the vocabulary is the top ``max_features`` terms - a table whose size is
   bounded by the parameter, the only broadcast in the plan;
5. weights ``tf * idf`` are summed per sentence (sum and sum of squares give
   the L2-normalised row sum);
6. the summary keeps the best sentence per digest of its 80-character key, then a top-k;
   texts are read back for the result only;
7. themes: k-means over the same weights as vectors, written once; members and examples of
   a theme come from the weights joined with the bounded table of centroids.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import policy as P
from ..functions.text import collapse_ws_at_hand, count_occurrences, py_strip, truthy_str
from ..plans import stopwords
from ..session import materialize, materialize_dealt

# Sentence boundary and token patterns.
SENTENCE_SPLIT_RX = r"(?<=[.?!])\s+(?=[A-Z0-9(])"
TOKEN_RX = r"[\p{L}\p{N}_]{2,}"
SCORE_DIGITS = 9  # ranking precision; keeps ties stable across engines


# ------------------------------------------------------------------ T1

def risky_snippets(xr: DataFrame) -> DataFrame:
    """Both clause texts plus the clause text of every issue naming a
    clause (duplicates kept) -> ``(doc_id, snippet_pos, snippet)``. Issues of the
    cross-reference name no field, so rows of the first pass give the same snippets."""
    pt, tc = F.col("payment_terms.text"), F.col("termination_clause.text")
    per_issue = F.transform("_issues", lambda i: F.when(i["field"] == "payment_terms", pt)
                            .when(i["field"] == "termination_clause", tc))
    snippets = F.filter(F.concat(F.array(pt, tc), per_issue), lambda s: truthy_str(s))
    # outer: with posexplode an inferred filter would compute the texts twice
    return (xr.select("doc_id", F.posexplode_outer(snippets).alias("snippet_pos", "snippet"))
            .where(F.col("snippet_pos").isNotNull()))


# ------------------------------------------------------------------ T2

def split_sentences_col(text: Column, min_len: int = P.SENTENCE_MIN_CHARS,
                        max_len: int = P.SENTENCE_MAX_CHARS) -> Column:
    """T2 for one text: whitespace collapsed, split after ``.?!`` before a
    capital/digit/parenthesis, kept if 30-400 chars, distinct in order."""
    # Once collapsed, spaces are the only white space.
    t = F.trim(collapse_ws_at_hand(F.coalesce(text, F.lit(""))))
    parts = F.transform(F.split(t, SENTENCE_SPLIT_RX, -1), lambda s: F.trim(s))
    keep = F.filter(parts, lambda s: (F.length(s) >= min_len) & (F.length(s) <= max_len))
    return F.array_distinct(keep)


def split_sentences(df: DataFrame, id_cols, text_col: str) -> DataFrame:
    """One row per kept sentence with ``sentence_pos``."""
    return (df.select(*id_cols, F.posexplode_outer(split_sentences_col(F.col(text_col))).alias("sentence_pos", "sentence"))
            .where(F.col("sentence_pos").isNotNull()))


# ------------------------------------------------------------------ T3

def terms_col(sentence: Column, stop_words=None) -> Column:
    """Lower-cased tokens of 2+ word characters, stop words removed, then
    unigrams followed by bigrams."""
    stop = list(stopwords.english() if stop_words is None else stop_words)
    tok = F.filter(F.regexp_extract_all(F.lower(sentence), F.lit(TOKEN_RX), 0),
                   lambda t: ~t.isin(*stop))
    n = F.size(tok)
    bigrams = F.when(n >= 2, F.zip_with(F.slice(tok, 1, n - 1), F.slice(tok, 2, n - 1),
                                        lambda a, b: F.concat_ws(" ", a, b))
                     ).otherwise(F.array().cast("array<string>"))
    return F.concat(tok, bigrams)


def digest(c: Column, one: str, two: str) -> tuple:
    """A 128-bit digest of a string as two longs, which hash aggregates and joins can use."""
    return F.xxhash64(c).alias(one), F.xxhash64(F.lit(0x5EED), c).alias(two)


def distinct_sentences(sentences: DataFrame, sid: str = "sid", text: str = "sentence") -> DataFrame:
    """Identical sentences combined: ``(h1, h2, sentence, m, first_sid)``."""
    s = sentences.select(*digest(F.col(text), "h1", "h2"), F.col(text).alias("sentence"), F.col(sid).alias("first_sid"))
    counts = s.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("m"))
    first = s.withColumn("_r", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("first_sid"))).where("_r = 1").drop("_r")
    return first.join(counts, ["h1", "h2"])


class SentenceCorpus:
    """Distinct sentences with terms, their vocabulary, weights, scores, summary and themes."""

    def __init__(self, sentences: DataFrame, sid: str = "sid", text: str = "sentence",
                 max_features: int = P.TFIDF_MAX_FEATURES, stop_words=None, materialize_mode: str = "checkpoint"):
        self.max_features, self.mode = max_features, materialize_mode
        self._source = (sentences, sid, text, stop_words)

    @cached_property
    def distinct(self) -> DataFrame:
        """``(h1, h2, sentence, m, first_sid)``, written once. Terms are several times as long as
        their sentence; they are not written but read off it where they are needed."""
        sentences, sid, text, _ = self._source
        return materialize_dealt(distinct_sentences(sentences, sid, text), self.mode)

    def terms(self) -> Column:
        return terms_col(F.col("sentence"), self._source[3])

    @cached_property
    def counts(self) -> DataFrame:
        """``(h1, h2, m, term, tf)``; sentences are dealt by their digest already."""
        # outer: with explode an inferred filter would compute the terms twice
        return (self.distinct.select("h1", "h2", "m", F.explode_outer(self.terms()).alias("term"))
                .where(F.col("term").isNotNull()).groupBy("h1", "h2", "m", "term").agg(F.count(F.lit(1)).alias("tf")))

    @cached_property
    def vocabulary(self) -> list:
        """``(term, idf)`` of the ``max_features`` most frequent terms (ties by term), smooth idf
        ``ln((1+n)/(1+df)) + 1``; ``n`` counts sentence occurrences."""
        stats = self.counts.groupBy("term").agg(F.sum(F.col("m") * F.col("tf")).alias("ctf"), F.sum("m").alias("df"))
        n = self.distinct.agg(F.sum("m").alias("n")).scalar()
        top = stats.orderBy(F.desc("ctf"), F.asc("term")).limit(self.max_features)
        idf = F.log((F.lit(1) + n) / (F.lit(1) + F.col("df"))) + F.lit(1.0)
        return [tuple(r) for r in top.select("term", idf.alias("idf")).collect()]

    @cached_property
    def weights(self) -> DataFrame:
        """``(h1, h2, term, w)``: tf * idf of the vocabulary's terms."""
        vocab = self.distinct.sparkSession.createDataFrame(self.vocabulary, "term string, idf double")
        return self.counts.join(F.broadcast(vocab), "term").select("h1", "h2", "term", (F.col("tf") * F.col("idf")).alias("w"))

    @cached_property
    def norms(self) -> DataFrame:
        """``(h1, h2, sw, norm)``: sum of a sentence's weights and their L2 norm."""
        sums = self.weights.groupBy("h1", "h2").agg(F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("w")).alias("sw2"))
        return sums.select("h1", "h2", "sw", F.sqrt("sw2").alias("norm"))

    def scores(self) -> DataFrame:
        """``(h1, h2, sentence, m, first_sid, score)``, the row sum of the L2-normalised
        TF-IDF vector of every distinct sentence."""
        d = self.distinct.select("h1", "h2", "sentence", "m", "first_sid").join(self.norms, ["h1", "h2"], "left")
        score = F.coalesce(F.when(F.col("norm") > 0, F.col("sw") / F.col("norm")), F.lit(0.0))
        return d.select("h1", "h2", "sentence", "m", "first_sid", score.alias("score"))

    def summary(self, top_k: int = P.TOP_K_SUMMARY_SENTENCES, keywords=P.RISK_KEYWORDS) -> DataFrame:
        """T5: ``(sentence, first_sid, rank_score)``, best first, one per 80-character
        lower-cased prefix, top ``top_k``."""
        total = F.round(F.col("score") + keyword_boost(F.col("sentence"), keywords), SCORE_DIGITS)
        key = F.lower(F.left(F.col("sentence"), F.lit(P.SUMMARY_KEY_CHARS)))
        s = self.scores().select("h1", "h2", "first_sid", total.alias("rank_score"), *digest(key, "k1", "k2"))
        order = [F.desc("rank_score"), F.asc("first_sid")]
        best = s.withColumn("_r", F.row_number().over(Window.partitionBy("k1", "k2").orderBy(*order))).where("_r = 1")
        top = best.orderBy(*order).limit(top_k).select("h1", "h2", "rank_score")
        return self.distinct.join(F.broadcast(top), ["h1", "h2"]).select("sentence", "first_sid", "rank_score").orderBy(*order)

    # -------------------------------------------------------------- themes

    @cached_property
    def vectors(self) -> DataFrame:
        """``(h1, h2, m, features)``: the L2-normalised weights as sparse vectors, written once."""
        from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
        from pyspark.ml.linalg import Vectors

        if not self.vocabulary:
            return self.distinct.select("h1", "h2", "m").limit(0)
        v = CountVectorizerModel.from_vocabulary([t for t, _ in self.vocabulary], "terms", "tf").transform(self.distinct.select("h1", "h2", "m", self.terms().alias("terms")))
        v = ElementwiseProduct(scalingVec=Vectors.dense([i for _, i in self.vocabulary]), inputCol="tf", outputCol="w").transform(v)
        v = Normalizer(p=2.0, inputCol="w", outputCol="features").transform(v)
        return materialize(v.select("h1", "h2", "m", "features"), self.mode)

    def fit_themes(self, k: int = 6, seed: int = 42) -> list:
        """Centroids ``(theme, term, weight)`` of k-means over the vectors, zero weights left out."""
        from pyspark.ml.clustering import KMeans

        if not self.vocabulary:
            return []
        model = KMeans(k=k, seed=seed, featuresCol="features", weightCol="m").fit(self.vectors)
        return [(theme, t, float(w)) for theme, c in enumerate(model.clusterCenters())
                for (t, _), w in zip(self.vocabulary, c) if w != 0]

    def members(self, centroids: list) -> DataFrame:
        """``(h1, h2, theme, distance)``: the nearest centroid of every distinct sentence (ties to
        the smaller theme) and its distance. ``centroids`` are as of ``fit_themes``, a table
        bounded by themes times vocabulary."""
        themes = sorted({t for t, _, _ in centroids})
        spark = self.distinct.sparkSession
        table = spark.createDataFrame([(t, term, w) for t, term, w in centroids], "theme int, term string, c double")
        size = {t: sum(w * w for x, _, w in centroids if x == t) for t in themes}
        # One column per theme: a sentence's products with all centroids come from one pass over its weights.
        per_term = table.groupBy("term").pivot("theme", themes).sum("c")
        dots = (self.weights.join(F.broadcast(per_term), "term").groupBy("h1", "h2")
                .agg(*[F.sum(F.col("w") * F.coalesce(F.col(f"`{t}`"), F.lit(0.0))).alias(f"dot{t}") for t in themes]))
        x = self.distinct.select("h1", "h2").join(self.norms, ["h1", "h2"], "left").join(dots, ["h1", "h2"], "left")
        norm = F.coalesce("norm", F.lit(0.0))
        unit = F.when(norm > 0, 1.0).otherwise(0.0)

        def away(t):
            dot = F.when(norm > 0, F.coalesce(F.col(f"dot{t}"), F.lit(0.0)) / norm).otherwise(0.0)
            return F.round(F.sqrt(F.greatest(F.lit(0.0), unit - 2 * dot + F.lit(size[t]))), SCORE_DIGITS)

        near = F.array_min(F.array(*[F.struct(away(t).alias("distance"), F.lit(t).alias("theme")) for t in themes]))
        return x.select("h1", "h2", near.alias("near")).select("h1", "h2", "near.theme", "near.distance")

    def examples(self, centroids: list, n: int = 6) -> DataFrame:
        """``(theme, rank, sentence, m, distance)``, the ``n`` members nearest to each centroid
        (ties in the order of the corpus)."""
        spark = self.distinct.sparkSession
        if not centroids:
            return spark.createDataFrame([], "theme int, rank int, sentence string, m long, distance double")
        m = self.members(centroids).join(self.distinct.select("h1", "h2", "first_sid"), ["h1", "h2"])
        rank = F.row_number().over(Window.partitionBy("theme").orderBy("distance", "first_sid"))
        top = m.withColumn("rank", rank).where(F.col("rank") <= n).select("h1", "h2", "theme", "rank", "distance")
        return self.distinct.join(F.broadcast(top), ["h1", "h2"]).select("theme", "rank", "sentence", "m", "distance")


def tfidf_scores(sentences: DataFrame, sid: str = "sid", text: str = "sentence",
                 max_features: int = P.TFIDF_MAX_FEATURES, stop_words=None,
                 materialize_mode: str = "checkpoint") -> DataFrame:
    """T3 of a corpus of its own: ``(sentence, m, first_sid, score)``."""
    s = SentenceCorpus(sentences, sid, text, max_features, stop_words, materialize_mode).scores()
    return s.select(F.col("sentence").alias(text), "m", "first_sid", "score")


# ------------------------------------------------------------------ T4

def keyword_boost(sentence: Column, keywords=P.RISK_KEYWORDS, weight: float = P.KEYWORD_BOOST) -> Column:
    """T4: ``weight`` x total non-overlapping keyword hits in the lower-cased sentence."""
    low = F.lower(sentence)
    hits = None
    for k in keywords:
        c = count_occurrences(low, k.lower())
        hits = c if hits is None else hits + c
    return (hits * F.lit(weight)).cast("double")


# ------------------------------------------------------------------ T5

def corpus_summary(sentences: DataFrame, sid: str = "sid", text: str = "sentence",
                   top_k: int = P.TOP_K_SUMMARY_SENTENCES, keywords=P.RISK_KEYWORDS,
                   max_features: int = P.TFIDF_MAX_FEATURES, stop_words=None,
                   materialize_mode: str = "checkpoint") -> DataFrame:
    """T5 of a corpus of its own."""
    s = SentenceCorpus(sentences, sid, text, max_features, stop_words, materialize_mode).summary(top_k, keywords)
    return s.withColumnRenamed("sentence", text)


# ------------------------------------------------------------------ T6

def clause_themes(corpus: SentenceCorpus, k: int = 6, top_terms: int = 10, seed: int = 42) -> DataFrame:
    """``(theme, rank, term, weight)``, the heaviest terms of every centroid."""
    rows = []
    centroids = corpus.fit_themes(k, seed)
    for theme in sorted({t for t, _, _ in centroids}):
        own = sorted(((-w, term) for t, term, w in centroids if t == theme))[:top_terms]
        rows += [(theme, r + 1, term, -minus) for r, (minus, term) in enumerate(own)]
    return corpus.distinct.sparkSession.createDataFrame(rows, "theme int, rank int, term string, weight double")
