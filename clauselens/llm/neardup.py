"""Operator 3: near-duplicates by HyperMinHash sketches and exact verification.

1. Every text becomes the set of its distinct word shingles (64-bit hashes). Documents
   with equal sets form a class; its smallest doc_id represents it, so thousands of
   copies cost one row from here on.
2. A HyperMinHash sketch keeps of each of 256 buckets the smallest hash as a
   leading-zero count (6 bits) plus 10 mantissa bits. Empty buckets borrow from others
   (optimal densification) for banding only. Bands of ``rows`` compressed registers are
   hashed to keys; ``rows`` is the largest with a miss probability of at most 1e-4 at
   the threshold.
3. Members of a bucket are compared with two centres of it (its smallest and largest
   id), not with each other. Candidates pass a collision-corrected Jaccard estimate
   (limit: threshold minus five standard errors) and then exact verification on full sets.
4. Connected components of the links so far tell which buckets still hold several
   components. Only there the members outside the bucket's main component are compared
   with the bucket's other components, so no link between candidates is lost. Before,
   all meet a third centre, the most typical member, and an exact bound from rare
   shingles (``OpenBuckets``) keeps a large group of near copies from
   being expanded into all its pairs.
5. Components: alternating large-star and small-star rounds on DataFrames, written to
   the shared folder each round.

Edge cases: null and empty texts, and texts without words, have an empty set and are
linked with nothing; fewer words than a shingle make one shingle of all words; rows
that share a doc_id are one document; rows with a null doc_id are linked with nothing,
have no component_id and are kept; further columns are not read (``drop_copies``
returns them as they are). Empty tables give empty results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_words, map_batches, mix64, prepare, shingle_hashes, texts, written

REGISTERS = 256
MANTISSA_BITS = 10
EMPTY = 0xFFFF
MISS = 1e-4
#: Standard errors below the threshold at which an estimate still goes to verification.
SLACK = 5.0
#: Buckets with more open members are bounded by rare shingles, and what is rare.
WIDE_BUCKET = 64
RARE_DOCS = 12


def band_rows(threshold: float, registers: int = REGISTERS, miss: float = MISS) -> int:
    """The most registers a band may have so that a pair at the threshold shares no
    band with probability of at most ``miss``."""
    return max(r for r in range(1, 33) if (1 - threshold ** r) ** (registers // r) <= miss)


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes; the upper 8 bits are the sketch's bucket."""
    if not text:
        return np.zeros(0, np.uint64)
    words, _, _ = hash_words(text.lower())          # bytes: lower-cases A-Z only
    return np.unique(shingle_hashes(words, k))


def sketch_of(s: np.ndarray) -> np.ndarray:
    """Registers of a sorted shingle set: leading zeros << 10 | mantissa, 0xFFFF if empty."""
    out = np.full(REGISTERS, EMPTY, np.uint16)
    if len(s):
        bucket = (s >> np.uint64(56)).astype(np.int64)
        first = np.flatnonzero(np.diff(bucket, prepend=-1))
        low = ((s[first] << np.uint64(8)) >> np.uint64(11)).astype(np.float64)     # 53 bits, exact
        frac, bits = np.frexp(low)
        zeros = np.where(low > 0, 53 - bits, 53)
        mantissa = np.maximum((2 * frac - 1) * (1 << MANTISSA_BITS), 0).astype(np.int64)
        out[bucket[first]] = (zeros << MANTISSA_BITS | mantissa).astype(np.uint16)
    return out


#: For every register the order in which it asks the others when it is empty.
_ASK = np.stack([np.random.default_rng(7919 * (i + 1)).permutation(REGISTERS) for i in range(REGISTERS)])


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of the densified sketch."""
    has = sketch != EMPTY
    if not has.any():
        return np.zeros(0, np.uint64)
    full = sketch
    if not has.all():
        gap = np.flatnonzero(~has)
        full = sketch.copy()
        full[gap] = sketch[_ASK[gap, has[_ASK[gap]].argmax(1)]]
    bands = len(full) // rows
    regs = full[:bands * rows].reshape(bands, rows).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
    for j in range(rows):
        key = key * np.uint64(0x9E3779B97F4A7C15) + regs[:, j]
    return mix64(key)


def estimate(a: np.ndarray, b: np.ndarray):
    """Collision-corrected Jaccard estimates of sketch rows, and registers in use.

    Of n registers in use by either set c agree. Two different minima agree too when
    they have equal leading zeros and mantissa, which happens with probability
    2**-MANTISSA_BITS / 3 or so (equal zeros: sum of 4**-i); the estimate removes them.
    """
    used = (a != EMPTY) | (b != EMPTY)
    n = used.sum(1)
    c = ((a == b) & used).sum(1)
    chance = 2.0 ** -MANTISSA_BITS / 3
    j = (c / np.maximum(n, 1) - chance) / (1 - chance)
    return np.clip(j, 0, 1), n


def sketched(docs: DataFrame, shingle: int, rows: int, percent: int) -> DataFrame:
    """``(doc_id, n_shingles, digest, bands, sketch)`` per document row. Sets that no
    different set can reach the threshold with (100 * n < percent * (n + 1)) have no bands."""

    def run(batches):
        for b in batches:
            n, digest, bands, sketch = [], [], [], []
            for t in texts(b):
                s = shingle_set(t, shingle)
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                if len(s) * (100 - percent) >= percent:
                    k = sketch_of(s)
                    bands.append(band_keys(k, rows).view(np.int64))
                    sketch.append(k.tobytes())
                else:
                    bands.append(None)
                    sketch.append(None)
            yield pa.record_batch([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()),
                                   pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                                  names=["doc_id", "n_shingles", "digest", "bands", "sketch"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(src, run, "doc_id long, n_shingles long, digest binary, bands array<long>, sketch binary")


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)``: the smallest node that each node of the edges reaches."""
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = (small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(small.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        e = written(small, "edges")
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h")).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now


class Candidates:
    """Estimation and verification of candidate pairs of class representatives."""

    def __init__(self, sketches: DataFrame, sets: DataFrame, threshold_percent: int):
        self.sketches, self.sets, self.percent = sketches, sets, threshold_percent

    def likely(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose sketches may reach the threshold."""
        t = self.percent / 100
        a = self.sketches.select(F.col("rep").alias("a"), F.col("sketch").alias("sa"), F.col("n").alias("na"))
        b = self.sketches.select(F.col("rep").alias("b"), F.col("sketch").alias("sb"), F.col("n").alias("nb"))
        both = pairs.join(a, "a").join(b, "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * self.percent)

        def run(batches):
            for x in batches:
                if x.num_rows:
                    sa, sb = (np.frombuffer(b"".join(x.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS)
                              for c in ("sa", "sb"))
                    j, n = estimate(sa, sb)
                    ok = j >= t - SLACK * np.sqrt(t * (1 - t) / np.maximum(n, 1))
                    yield pa.record_batch([x.column("a"), x.column("b")], names=["a", "b"]).filter(pa.array(ok))

        return map_batches(both.select("a", "b", "sa", "sb"), run, "a long, b long")

    def links(self, pairs: DataFrame) -> DataFrame:
        """Pairs with percent * union <= 100 * intersection of the full sets."""
        a = self.sets.select(F.col("rep").alias("a"), F.col("shingles").alias("xa"))
        b = self.sets.select(F.col("rep").alias("b"), F.col("shingles").alias("xb"))
        both = pairs.join(a, "a").join(b, "b")
        same = F.size(F.array_intersect("xa", "xb"))
        return both.where(100 * same >= self.percent * (F.size("xa") + F.size("xb") - same)).select("a", "b")


def _full_sets(docs: DataFrame, reps: DataFrame, shingle: int) -> DataFrame:
    """``(rep, shingles)`` of the documents that represent a class in ``reps``."""

    def run(batches):
        for b in batches:
            yield pa.record_batch([b.column("rep"), pa.array([shingle_set(t, shingle).view(np.int64) for t in texts(b)],
                                                            pa.list_(pa.int64()))], names=["rep", "shingles"])

    src = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(reps, "rep", "left_semi")
    return map_batches(src, run, "rep long, shingles array<long>")


def _ordered(a: str, b: str):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def _possible(most, percent: int):
    """Whether sets of n_x and n_y shingles with an intersection of at most ``most`` may be linked."""
    return 100 * most >= percent * (F.col("n_x") + F.col("n_y") - most)


class OpenBuckets:
    """The rows of buckets that hold several components, and what bounds their links.

    With buckets of up to ``WIDE_BUCKET`` members only, pairs are few and made directly. Else
    a shingle is rare if at most ``RARE_DOCS`` of the members of all open buckets have it,
    wide or not, so the bound holds for any pair that meets in one of them. Pairs
    that share a rare shingle come from these shingles (at most 66 pairs each). All other
    pairs share frequent shingles only, so their intersection is at most the smaller
    number of frequent shingles. In a large group of near copies the edits of a copy are
    rare, so this exact bound rules out nearly all pairs that are no links before they
    are made.
    """

    def __init__(self, rows: DataFrame, sets: DataFrame, percent: int):
        """``rows``: (key, rep, bands)."""
        self.percent = percent
        wide = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > WIDE_BUCKET).select("key")
        members = rows.select("rep").distinct()
        if wide.isEmpty():
            members = members.limit(0)
        has = written(sets.join(members, "rep", "left_semi").select("rep", F.explode("shingles").alias("s")), "shingles")
        few = has.groupBy("s").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") <= RARE_DOCS).select("s")
        ids = has.join(few, "s").groupBy("s").agg(F.array_sort(F.collect_list("rep")).alias("ids"))    # at most RARE_DOCS
        self.rare = written(ids.groupBy("ids").agg(F.count(F.lit(1)).alias("k")), "rare")
        per = self.rare.select(F.explode("ids").alias("rep"), "k").groupBy("rep").agg(F.sum("k").alias("rare"))
        facts = (sets.join(rows.select("rep").distinct(), "rep", "left_semi")
                 .select("rep", F.size("shingles").cast("long").alias("n")).join(per, "rep", "left")
                 .select("rep", "n", (F.col("n") - F.coalesce("rare", F.lit(0))).alias("frequent")))
        self.facts = written(facts, "facts")
        self.rows = rows.join(self.facts, "rep").where(F.col("frequent") * 100 >= F.col("n") * percent)

    def to_centre(self, root) -> DataFrame:
        """Pairs of members with the bucket's document that has most frequent shingles,
        the one nearest to what the bucket has in common."""
        rows = written(root(self.rows, "rep", "comp"), "open")
        centre = rows.groupBy("key").agg(F.max(F.struct("frequent", "rep", "n", "comp")).alias("c"))
        pairs = (rows.join(centre, "key").where("comp != c.comp").withColumnsRenamed({"n": "n_x"})
                 .withColumn("n_y", F.col("c.n")).withColumn("other", F.col("c.rep")))
        return pairs.where(_possible(F.least("frequent", "c.frequent"), self.percent)).select(*_ordered("rep", "other")).distinct()

    def pairs(self, root) -> DataFrame:
        """All pairs of different components of a bucket that the bound leaves."""
        facts = root(self.facts, "rep", "comp")
        x, y = (facts.select(*(F.col(c).alias(f"{c}_{k}") for c in ("rep", "n", "frequent", "comp"))) for k in "xy")
        two = self.rare.select("k", "ids", F.explode("ids").alias("rep_x"))
        two = two.select("k", "rep_x", F.explode(F.filter("ids", lambda i: i > F.col("rep_x"))).alias("rep_y"))
        sharing = (two.groupBy("rep_x", "rep_y")
                   .agg(F.sum("k").alias("k")).join(x, "rep_x").join(y, "rep_y")
                   .where("comp_x != comp_y").where(_possible(F.least("frequent_x", "frequent_y") + F.col("k"), self.percent)))

        rows = root(self.rows, "rep", "comp")
        sizes = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("size"), F.min("n").alias("n"), F.max("frequent").alias("f"))
        main = (sizes.groupBy("key").agg(F.max(F.struct("size", "comp")).alias("m"), F.count(F.lit(1)).alias("comps"),
                                         F.min("n").alias("n_y"), F.max("f").alias("f_y"))
                .where("comps > 1").select("key", F.col("m.comp").alias("main"), "n_y", "f_y"))
        # The best partner that the bucket may hold bounds every member of it.
        rows = rows.join(main, "key").withColumnRenamed("n", "n_x")
        most = F.least("frequent", "f_y")
        rows = written(rows.withColumn("n_y", F.greatest("n_y", most)).where(_possible(most, self.percent))
                       .select("key", "rep", "bands", "comp", "main", F.col("n_x").alias("n"), "frequent"), "open")
        small, other = (r.select("key", *(F.col(c).alias(f"{c}_{k}") for c in ("rep", "bands", "n", "frequent", "comp")))
                        for r, k in ((rows.where("comp != main"), "x"), (rows, "y")))
        # A pair that meets in several buckets is made in one of them.
        once = F.array_min(F.array_intersect("bands_x", "bands_y")) == F.col("key")
        near = small.join(other, "key").where(
            (F.col("comp_x") != F.col("comp_y")) & _possible(F.least("frequent_x", "frequent_y"), self.percent) & once)
        return near.select(*_ordered("rep_x", "rep_y")).unionByName(sharing.select(*_ordered("rep_x", "rep_y"))).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, percent: int = 85) -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id, kept. Documents are linked
    if 100 * intersection >= ``percent`` * union of their sets of ``shingle`` words."""
    prepare(docs.sparkSession)
    rows = band_rows(percent / 100)
    all_rows = written(sketched(docs, shingle, rows, percent), "sketches")
    real = all_rows.where("doc_id IS NOT NULL AND digest IS NOT NULL")
    classes = written(real.groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    # Rows that share a doc_id are one document, whatever their texts.
    twice = (real.select("doc_id", "digest").groupBy("doc_id").agg(F.min("digest").alias("d1"), F.max("digest").alias("d2"))
             .where("d1 != d2").select("doc_id"))

    reps = real.where("bands IS NOT NULL").join(
        classes, (real["doc_id"] == classes["rep"]) & (real["digest"] == classes["digest"]), "left_semi")
    keys = reps.select(F.col("doc_id").alias("rep"), F.explode("bands").alias("key"))
    # Buckets with two or more different documents, and their members with two centres.
    buckets = written(keys.groupBy("key").agg(F.min("rep").alias("c1"), F.max("rep").alias("c2")).where("c1 != c2"), "buckets")
    members = written(keys.join(buckets, "key").distinct(), "members")

    in_bucket = written(members.select("rep").distinct(), "reps")
    sketches = written(reps.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "sketch")
                       .join(in_bucket, "rep", "left_semi").dropDuplicates(["rep"]), "rep-sketches")
    sets = written(_full_sets(docs, in_bucket, shingle), "sets")
    n = sets.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("rep").alias("reps")).first()
    if n["rows"] != n["reps"]:      # repeated rows count once, different texts under one id stay
        sets = written(sets.dropDuplicates(["rep", "shingles"]), "sets")
    check = Candidates(sketches, sets, percent)

    stars = (members.select("rep", F.explode(F.array("c1", "c2")).alias("c")).where("rep != c")
             .select(*_ordered("rep", "c")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")))
    stars = written(check.likely(stars.select("a", "b")), "stars")
    # First one link per document (to the centre with the smallest id), then what is still apart.
    first = stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    own = (real.join(twice, "doc_id", "left_semi").select("doc_id", "digest").distinct().join(classes, "digest")
           .select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    edges = written(check.links(first).unionByName(own), "links")

    def rooted(links: DataFrame):
        """Function (frame, id column, name): adds the component of the id."""
        roots = written(components(links), "roots")

        def of(df: DataFrame, col: str, to: str) -> DataFrame:
            r = roots.select(F.col("node").alias(col), F.col("root").alias(to))
            return df.join(r, col, "left").withColumn(to, F.coalesce(to, col))
        return of

    root = rooted(edges)
    apart = root(root(stars, "a", "ra"), "b", "rb").where("ra != rb").select("a", "b")
    edges = edges.unionByName(written(check.links(apart), "links"))
    root = rooted(edges)

    # Buckets that still hold several components; their centres have met everyone already.
    torn = (root(members, "rep", "comp").groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size"))
            .where("lo != hi AND size > 3").select("key"))
    bands = reps.select(F.col("doc_id").alias("rep"), "bands").dropDuplicates(["rep"])
    rows = members.join(torn, "key", "left_semi").where("rep != c1 AND rep != c2").select("key", "rep").join(bands, "rep")
    buckets = OpenBuckets(written(rows, "open"), sets, percent)
    edges = edges.unionByName(written(check.links(written(check.likely(buckets.to_centre(root)), "stars")), "links"))
    root = rooted(edges)
    edges = edges.unionByName(written(check.links(written(check.likely(buckets.pairs(root)), "rest")), "links"))
    root = components(edges).withColumnRenamed("node", "rep")

    placed = (all_rows.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left").join(root, "rep", "left")
              .withColumn("component_id", F.coalesce("root", "rep", "doc_id")))
    null_id = F.col("doc_id").isNull()
    return placed.select("doc_id", "n_shingles", F.when(~null_id, F.col("component_id")).alias("component_id"),
                         (null_id | (F.col("doc_id") == F.col("component_id"))).alias("kept"))


def drop_copies(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group, all columns; of repeated rows with one
    doc_id one stays."""
    result = written(near_duplicates(docs, shingle, percent).where("doc_id IS NOT NULL").select("doc_id", "kept"), "kept")
    gone = result.where("NOT kept").select(F.col("doc_id").alias("gone_id")).distinct()
    twice = result.where("kept").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.col("doc_id").alias("twice_id"))
    left = docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
    if twice.isEmpty():
        return left
    once = left.join(twice, left["doc_id"] == twice["twice_id"], "left_anti")
    more = left.join(twice, left["doc_id"] == twice["twice_id"], "left_semi").dropDuplicates(["doc_id"])
    return once.unionByName(more)
