"""Operator 11: n-gram Jaccard self-join by rare-first prefix filtering.

A document is the set of its distinct word n-grams (64-bit hashes); documents with equal
sets form a class with its smallest doc_id as representative, so copies cost one row.
Sets of n tokens that are linked share at least ``need(n)`` tokens, hence

1. *Lonely sets.* Under any one order of all tokens the prefixes of ``n - need(n) + l`` tokens
   of two linked sets share l tokens. With the hash as order and l = n / 16, a document that
   has too few tokens in common with the prefixes of all others has no partner. About
   a fifth of all tokens is shuffled for this, and it leaves out most documents, passages
   that many documents share included.
2. *Rarity* of every token over the documents that are left. Tokens of one document come
   first and match nothing; then rarest first, ties by hash.
3. *Prefix entries*: of the first ``n - need(n) + 1`` tokens those of several documents, with
   their position, and how many tokens follow in each of 16 hash classes.
4. *Join on prefix tokens* with the length filter, the positional filter (what both have
   left after the token) and the suffix filter (the same class by class, which bounds the
   overlap of the two suffixes). All three hold in the bucket of the pair's first common
   token, so no linked pair is lost.
5. *Verification* of a pair, once, on full sets.

The result needs the components of the link graph, not every link, so members of a bucket
first meet two centres of it (smallest id, smallest position). Only where a bucket still
holds several components, pairs of different components are made, each in the bucket of its
first common token. A large group of near copies thus isn't expanded into all pairs.

Edge cases: null and empty texts and texts without words have an empty set and are linked
with nothing; fewer words than an n-gram are one token; rows that share a doc_id are one
document, with the set of the row with the smallest digest (any before an empty one), and
give one result row; rows with a null doc_id give a row each, without component; further columns
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_words, map_batches, prepare, shingle_hashes, texts, written
from .neardup import components

#: Share of a set by which the prefixes of step 1 are longer.
LONGER = 16
CLASSES = 16
#: Tokens at the head of a prefix by which a pair's first common token is told.
HEAD = 64
#: Ids are broadcast up to this number (about 32 bytes each), else joined by a shuffle.
BROADCAST_IDS = 2_000_000


# ------------------------------------------------------------------ bounds and sets

def need(n: int, percent: int) -> int:
    """Least overlap of a set of ``n`` with any set that it is linked with."""
    return (n * percent + 99) // 100


def longer(n: int) -> int:
    """By how many tokens the prefixes of step 1 are longer: what two linked sets share of
    them, the smaller set's number."""
    return max(1, n // LONGER)


def token_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; bytes.lower() lower-cases A-Z only."""
    if not text:
        return np.zeros(0, np.uint64)
    words, _, _ = hash_words(text.lower())
    return np.unique(shingle_hashes(words, k))


def probes_of(s: np.ndarray, percent: int) -> np.ndarray | None:
    """The tokens of a set that step 1 compares: its smallest hashes. None for sets that no
    different set can be linked with."""
    n = len(s)
    if 100 * n < percent * (n + 1):
        return None
    return s[:n - need(n, percent) + min(longer(n), need(n, percent))]


def lists(arrays: list) -> pa.Array:
    """Arrays of uint64 (or None) as a list column of signed longs."""
    n = np.array([0 if a is None else len(a) for a in arrays], np.int64)
    flat = np.concatenate([np.zeros(0, np.uint64), *(a for a in arrays if a is not None)]).view(np.int64)
    offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array([a is None for a in arrays]))


# ------------------------------------------------------------------ steps 1 to 3

def tokenized(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """``(doc_id, n, digest, probes)`` per document row."""

    def run(batches):
        for b in batches:
            sets = [token_set(t, k) for t in texts(b)]
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.record_batch([b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()),
                                   lists([probes_of(s, percent) if len(s) else None for s in sets])],
                                  names=["doc_id", "n", "digest", "probes"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(src, run, "doc_id long, n long, digest binary, probes array<long>")


def with_company(reps: DataFrame, percent: int) -> DataFrame:
    """The ids of ``reps (rep, n, probes)`` that may have a partner (step 1). The least
    partner of a set of n tokens has ``need(n)``."""
    tokens = reps.select("rep", F.explode("probes").alias("s"))
    shared = tokens.groupBy("s").agg(F.count(F.lit(1)).alias("docs")).where("docs > 1").select("s")
    found = tokens.join(shared, "s", "left_semi").groupBy("rep").agg(F.count(F.lit(1)).alias("m"))
    smallest = F.expr(f"(n * {percent} + 99) div 100")
    least = F.greatest(F.lit(1), F.least(smallest, F.expr(f"((n * {percent} + 99) div 100) div {LONGER}")))
    return found.join(reps.select("rep", "n"), "rep").where(F.col("m") >= least).select("rep")


def sets_of(docs: DataFrame, reps: DataFrame, k: int) -> DataFrame:
    """``(rep, n, tokens)`` of the representatives ``reps (rep, digest)``."""

    def run(batches):
        for b in batches:
            sets = [token_set(t, k) for t in texts(b)]
            own = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            ok = pa.array([a == d for a, d in zip(own, b.column("digest").to_pylist())], pa.bool_())
            yield pa.record_batch([b.column("rep"), pa.array([len(s) for s in sets], pa.int64()), lists(sets)],
                                  names=["rep", "n", "tokens"]).filter(ok)

    src = docs.select(F.col("doc_id").cast("long").alias("rep"), "text")
    few = reps.count() <= BROADCAST_IDS
    return map_batches(src.join(F.broadcast(reps) if few else reps, "rep").select("rep", "text", "digest"), run,
                       "rep long, n long, tokens array<long>")


def once(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` written, with one row per ``key``; repeated rows are rare, so the rows are only
    dealt by the key if there are any."""
    df = written(df, name)
    n = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("k")).first()
    return df if n["n"] == n["k"] else written(df.dropDuplicates([key]), name)


def prefix_entries(sets: DataFrame, percent: int) -> DataFrame:
    """``(s, rep, n, i, tail)``: the prefix tokens that several documents have, the position
    in the document's order and 16 counts of the tokens that follow. The token of the first
    entry of a document carries ``head``, its first ``HEAD`` tokens."""
    tokens = sets.select("rep", F.explode("tokens").alias("s"))
    rarity = tokens.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    known = tokens.join(rarity, "s").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("known"))
    known = known.join(sets.select("rep", "n"), "rep").select("rep", "n", F.col("known.s").alias("known"))

    def run(batches):
        for b in batches:
            at = b.column("known")
            flat, counts = np.asarray(at.flatten()).view(np.uint64), np.asarray(at.value_lengths(), np.int64)
            ends = np.cumsum(counts)
            rep, n = np.asarray(b.column("rep")), np.asarray(b.column("n"))
            out: list = [[] for _ in range(6)]
            for r, size, e, m in zip(rep.tolist(), n.tolist(), ends.tolist(), counts.tolist()):
                t = flat[e - m:e]
                take = size - need(size, percent) + 1 - (size - m)    # what single tokens leave of the prefix
                if take < 1:
                    continue
                kind = (t >> np.uint64(60)).astype(np.int64)
                after = np.bincount(kind, minlength=CLASSES)[None] - np.cumsum(kind[:take, None] == np.arange(CLASSES), 0)
                first = t[:take]
                out[0].append(first), out[1].append(np.full(len(first), r)), out[2].append(np.full(len(first), size))
                out[3].append(size - m + np.arange(len(first)))
                out[4] += [a.tobytes() for a in after.astype(np.int32)]
                out[5] += [first[:HEAD], *[None] * (len(first) - 1)]
            if out[0]:
                s, r, size, i = (np.concatenate(c) for c in out[:4])
                yield pa.record_batch([pa.array(s.view(np.int64)), pa.array(r), pa.array(size), pa.array(i), pa.array(out[4], pa.binary()),
                                       lists(out[5])], names=["s", "rep", "n", "i", "tail", "head"])

    return map_batches(known, run, "s long, rep long, n long, i long, tail binary, head array<long>")


# ------------------------------------------------------------------ step 4

def length_and_position(x: str, y: str, percent: int):
    """The length and the positional filter for two entries of a bucket."""
    nx, ny, ix, iy = (F.col(f"{e}.{c}") for c in ("n", "i") for e in (x, y))
    left = F.least(nx - ix, ny - iy)                     # the token itself and what follows
    return (F.least(nx, ny) * 100 >= F.greatest(nx, ny) * percent) & (left * (100 + percent) >= (nx + ny) * percent)


def suffix_filter(pairs: DataFrame, percent: int) -> DataFrame:
    """``pairs (a, b, na, nb, ta, tb)`` -> ``(a, b)``: the token itself and, class by class, what
    may be common after it must reach the least overlap."""

    def run(batches):
        for p in batches:
            if p.num_rows:
                ta, tb = (np.frombuffer(b"".join(p.column(c).to_pylist()), np.int32).reshape(-1, CLASSES) for c in ("ta", "tb"))
                n = np.asarray(p.column("na")) + np.asarray(p.column("nb"))
                most = 1 + np.minimum(ta, tb).sum(1, dtype=np.int64)
                yield pa.record_batch([p.column("a"), p.column("b")], names=["a", "b"]).filter(pa.array(most * (100 + percent) >= n * percent))

    return map_batches(pairs.select("a", "b", "na", "nb", "ta", "tb"), run, "a long, b long")


def _pairs(joined: DataFrame, x: str, y: str) -> DataFrame:
    """Columns of the suffix filter, smaller id first."""
    a, b = F.col(f"{x}.rep"), F.col(f"{y}.rep")
    return joined.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.col(f"{x}.n").alias("na"), F.col(f"{y}.n").alias("nb"),
                         F.col(f"{x}.tail").alias("ta"), F.col(f"{y}.tail").alias("tb"))


def centre_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """``(a, b)``: members of the buckets with their two centres, distinct."""
    e = F.struct("rep", "n", "i", "tail")
    centres = entries.groupBy("s").agg(F.min_by(e, "rep").alias("c1"), F.min_by(e, F.struct("i", "rep")).alias("c2"))
    both = entries.select("s", e.alias("x")).join(centres, "s")
    to = both.select("x", F.explode(F.array_distinct(F.array("c1", "c2"))).alias("y")).where("x.rep != y.rep")
    return suffix_filter(_pairs(to.where(length_and_position("x", "y", percent)), "x", "y"), percent).distinct()


def open_pairs(entries: DataFrame, heads: DataFrame, root, percent: int) -> DataFrame:
    """``(a, b)``: pairs of different components that meet in a bucket, made in the bucket of
    their first common token if that is in the ``heads (rep, head)`` of both."""
    rows = root(entries, "rep", "comp")
    sizes = rows.groupBy("s", "comp").agg(F.count(F.lit(1)).alias("size"))
    main = (sizes.groupBy("s").agg(F.max(F.struct("size", "comp")).alias("m"), F.count(F.lit(1)).alias("comps"))
            .where("comps > 1").select("s", F.col("m.comp").alias("main")))
    rows = written(rows.join(main, "s").join(heads, "rep"), "open")
    e = F.struct("rep", "n", "i", "tail", "head", "comp", "main")
    x, y = rows.where("comp != main").select("s", e.alias("x")), rows.select("s", e.alias("y"))
    # Of two members outside the main component one order is enough.
    apart = (F.col("x.comp") != F.col("y.comp")) & ((F.col("y.comp") == F.col("y.main")) | (F.col("x.rep") < F.col("y.rep")))
    first = F.coalesce(F.get(F.array_intersect("x.head", "y.head"), F.lit(0)), "s") == F.col("s")
    return suffix_filter(_pairs(x.join(y, "s").where(apart & length_and_position("x", "y", percent) & first), "x", "y"), percent).distinct()


# ------------------------------------------------------------------ step 5 and the whole

def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union of their full sets."""
    a, b = (sets.select(F.col("rep").alias(k), F.col("tokens").alias(f"t{k}")) for k in "ab")
    same = F.size(F.array_intersect("ta", "tb"))
    both = pairs.join(a, "a").join(b, "b")
    return both.where(100 * same >= percent * (F.size("ta") + F.size("tb") - same)).select("a", "b")


def rooted(edges: DataFrame):
    """Function (frame, id column, name): adds the component of the id."""
    roots = written(components(edges), "roots")

    def of(df: DataFrame, col: str, to: str) -> DataFrame:
        r = roots.select(F.col("node").alias(col), F.col("root").alias(to))
        return df.join(r, col, "left").withColumn(to, F.coalesce(to, col))
    return of


def links(entries: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``(a, b)`` that connect every component of the link graph."""
    meet = entries.groupBy("s").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo != hi").select("s")
    heads = entries.where("head IS NOT NULL").select("rep", "head")
    entries = written(entries.drop("head").join(meet, "s", "left_semi"), "entries")
    stars = written(centre_pairs(entries, percent), "stars")
    # One pair per document first, then what is still apart, then buckets that stay torn.
    first = stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    edges = written(verified(first, sets, percent), "links")
    root = rooted(edges)
    rest = stars.join(first, ["a", "b"], "left_anti")
    rest = root(root(rest, "a", "ra"), "b", "rb").where("ra != rb").select("a", "b")
    edges = edges.unionByName(written(verified(rest, sets, percent), "links"))
    pairs = open_pairs(entries, heads, rooted(edges), percent).join(stars, ["a", "b"], "left_anti")
    return edges.unionByName(written(verified(written(pairs, "pairs"), sets, percent), "links"))


def ngram_join(docs: DataFrame, ngram: int = 5, percent: int = 80) -> DataFrame:
    """Per document ``(doc_id, n_shingles, component_id)``: documents are linked if
    100 * intersection >= ``percent`` * union of their sets of ``ngram`` words."""
    prepare(docs.sparkSession)
    rows = written(tokenized(docs, ngram, percent), "tokenized")
    own = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min(F.struct(F.col("digest").isNull().alias("none"), "digest", "n")).alias("d")).select("doc_id", "d.digest", "d.n")
    own = written(own, "documents")
    classes = written(own.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")

    c = classes.select("rep", F.col("digest").alias("own"))
    reps = rows.where("probes IS NOT NULL").select(F.col("doc_id").alias("rep"), "n", "digest", "probes").join(c, "rep")
    reps = once(reps.where("digest = own").select("rep", "n", "probes"), "rep", "probes")
    alive = written(with_company(reps, percent).join(classes, "rep"), "alive")
    sets = once(sets_of(docs, alive, ngram), "rep", "sets")
    root = components(links(written(prefix_entries(sets, percent), "prefixes"), sets, percent)).withColumnRenamed("node", "rep")

    placed = own.join(classes, "digest", "left").join(root, "rep", "left")
    named = placed.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "rep", "doc_id").alias("component_id"))
    nameless = rows.where("doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return named.unionByName(nameless)


def oracle_sql(ngram: int = 4, percent: int = 85) -> str:
    """DuckDB SQL of ``ngram_join`` (one row per doc_id)."""
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all({low}, '[^\\x20\\x09-\\x0D]+') END AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + {ngram - 1}), ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - {ngram - 1}) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= {percent} * (na.n + nb.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""
