"""Operator 5: language identification by compression.

Every learned language has a zstandard raw-content dictionary made of its training
text. A text is lower-cased, reduced to its words (ASCII digits and punctuation are
white space), cut into pieces of ``PIECE_CHARS`` (all of it, so the dictionary counts
in long texts too), and the distinct words of every piece, in order, are compressed
with every dictionary: a word repeated a thousand times tells no more than one. The
language with the fewest bytes in total wins. The score is the share of bytes saved
against the second best. A margin under ``MIN_MARGIN`` is too narrow: such a text is
rejected, and so is one without letters.

Training: text and non-null lang of documents whose crc32(doc_id as text) mod 4 is
not 2. A dictionary holds up to ``SAMPLE_TEXTS`` slices of ``SLICE_CHARS`` characters
(longer ones with fewer texts, as many characters in all) from distinct texts chosen by
hash (a documented, bounded sample); predictions cover whole texts and use nothing but
the text. All dictionaries together hold up to ``TOTAL_SLICES`` slices, so with very many lang
values each gets fewer; the ``MAX_LANGUAGES`` values with most training rows are learned. A
task holds the compressors of ``HELD`` languages at a time.

Edge cases: null, empty and letterless texts get ``und``, score 0, rejected; so does
everything when no language was learned. With one learned language the margin is
taken against compression without a dictionary. Ties go to the language with
more training rows, then the first in alphabetical order, with margin 0, hence rejected. A row with a null doc_id is
neither held out nor used for training. Repeated rows give repeated results; other
columns are not read (the filter returns them as they are).
"""

from __future__ import annotations

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, prepare

SAMPLE_TEXTS = 400
SLICE_CHARS = 600
TOTAL_SLICES = 25_600
MAX_LANGUAGES = 10_000
HELD = 64
LEVEL = 9
PIECE_CHARS = 8192
MIN_MARGIN = 0.01
UNDETERMINED = "und"

_LETTER = regex.compile(r"\p{L}")
_TO_SPACE = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256))


def words_of(text: str) -> list:
    return text.lower().encode().translate(_TO_SPACE).split()


def plain(words: list) -> bytes:
    """The distinct words in order."""
    return b" ".join(dict.fromkeys(words))


def held_out(doc_id):
    """crc32(doc_id as text) mod 4 = 2; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, sample_texts: int = SAMPLE_TEXTS, slice_chars: int = SLICE_CHARS,
          total_slices: int = TOTAL_SLICES, max_languages: int = MAX_LANGUAGES) -> dict:
    """lang -> dictionary bytes, of at most ``sample_texts * slice_chars`` characters
    each; languages with more training rows come first."""
    rows = docs.select("doc_id", "text", "lang").where(
        "doc_id IS NOT NULL AND lang IS NOT NULL AND length(text) > 0").where(~held_out("doc_id")).select("lang", "text", F.xxhash64("text").alias("x"))
    seen = (rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("x").alias("texts"))
            .orderBy(F.desc("n"), "lang").limit(max_languages).collect())
    if not seen:
        return {}
    sample = min(sample_texts, max(1, total_slices // len(seen)))
    # The texts with the smallest hashes: a share of the hash range that holds about four
    # times the sample of distinct texts, then the exact cut. With few texts the slices are longer.
    wide = 1 << 40
    plan = [(r["lang"], min(wide, -(-wide * 4 * sample // r["texts"])), max(slice_chars, slice_chars * sample // r["texts"])) for r in seen]
    plan = docs.sparkSession.createDataFrame(plan, "lang string, share long, size long")     # at most ``max_languages`` rows
    h = F.pmod("x", F.lit(wide))
    start = F.pmod("x", F.greatest(F.length("text") - F.col("size"), F.lit(1))).cast("int") + 1
    some = (rows.join(F.broadcast(plan), "lang").where(h < F.col("share"))
            .select("lang", h.alias("h"), F.substr("text", start, F.col("size").cast("int")).alias("piece"))
            .distinct().collect())                      # about 4 * sample rows a language
    out: dict = {}
    for r in sorted(some, key=lambda r: (r["lang"], r["h"], r["piece"])):
        out.setdefault(r["lang"], []).append(r["piece"])
    return {r["lang"]: b" ".join(plain(words_of(p)) for p in out[r["lang"]][:sample]) for r in seen if r["lang"] in out}


class Model:
    """Compressors with the languages' dictionaries, ``HELD`` at a time; with more languages they
    are built anew for every ``ROWS`` texts."""

    ROWS = 512

    def __init__(self, dictionaries: dict, level: int = LEVEL, piece_chars: int = PIECE_CHARS):
        self.langs, self.piece_chars, self.level = list(dictionaries), piece_chars, level
        self.dictionaries = dictionaries
        self.kept = self._built(self.langs) if len(self.langs) <= HELD else None
        if len(self.langs) == 1:
            self.kept.append(zstandard.ZstdCompressor(level=level).compress)

    def _built(self, langs: list) -> list:
        out = []
        for lang in langs:
            d = zstandard.ZstdCompressionDict(self.dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=self.level)
            out.append(zstandard.ZstdCompressor(dict_data=d).compress)
        return out

    def pieces(self, text: str) -> list:
        n = self.piece_chars
        return [plain(words_of(text[i:i + n])) for i in range(0, len(text), n)]

    def sizes(self, text: str) -> list:
        """Bytes per language (and without a dictionary if there is one language only)."""
        return next(iter(self._sizes([self.pieces(text)])))

    def _sizes(self, texts: list) -> list:
        if self.kept is not None:
            return [[sum(len(c(p)) for p in pieces) for c in self.kept] for pieces in texts]
        out: list = [[] for _ in texts]
        for at in range(0, len(self.langs), HELD):
            held = self._built(self.langs[at:at + HELD])
            for sizes, pieces in zip(out, texts):
                sizes += [sum(len(c(p)) for p in pieces) for c in held]
        return out

    def predict_all(self, texts: list) -> list:
        """(language, margin) per text."""
        out = [(UNDETERMINED, 0.0)] * len(texts)
        todo = [i for i, t in enumerate(texts) if t and self.langs and _LETTER.search(t)]
        for at in range(0, len(todo), self.ROWS):
            here = todo[at:at + self.ROWS]
            for i, sizes in zip(here, self._sizes([self.pieces(texts[i]) for i in here])):
                out[i] = self._choice(sizes)
        return out

    def _choice(self, sizes: list) -> tuple:
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        best, second = sizes[order[0]], sizes[order[1]]
        if order[0] >= len(self.langs):                 # the only dictionary does not help
            return self.langs[0], 0.0
        return self.langs[order[0]], (second - best) / second

    def predict(self, text: str | None) -> tuple:
        return self.predict_all([text])[0]


def identify(docs: DataFrame, training: DataFrame | None = None, min_margin: float = MIN_MARGIN) -> DataFrame:
    """Per document row: doc_id, held_out, lang_pred, score, rejected. ``training``
    (default: ``docs``) has the rows to learn from."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(learn(docs if training is None else training))

    def run(batches):
        model = Model(shared.value)
        for b in batches:
            got = model.predict_all(b.column("text").to_pylist())
            yield pa.record_batch([b.column("doc_id"), b.column("held_out"), pa.array([x[0] for x in got], pa.string()),
                                   pa.array([x[1] for x in got], pa.float64()),
                                   pa.array([x[0] == UNDETERMINED or x[1] < min_margin for x in got], pa.bool_())],
                                  names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), "text")
    return map_batches(src, run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows of ``docs`` whose language is identified, with all their columns."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(learn(docs))

    def run(batches):
        model = Model(shared.value)
        for b in batches:
            got = model.predict_all(b.column("text").to_pylist())
            yield b.filter(pa.array([x[0] != UNDETERMINED and x[1] >= min_margin for x in got], pa.bool_()))

    return map_batches(docs, run, docs.schema)
