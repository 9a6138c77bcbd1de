"""Policies: every rule threshold, weight and word list used by the engine.

A policy is a frozen dataclass turned into SQL literals when a plan is built;
nothing here touches data. Two named policies exist:

* ``current()`` – the active profile: issue-weighted risk with numeric drift
  components, buckets 5 / 10.
* ``strict()`` – the older profile recovered from committed results: integer
  weights capped at 20, buckets 4 / 8, all five schema fields required,
  a NOTICE for governing laws outside an approved list.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# ---------------------------------------------------------------------------
# Fixed values. These must equal the originals for results to match; they are
# listed plainly and in their natural order.
# ---------------------------------------------------------------------------

# Field schema (name -> type), in schema order.
SCHEMA_FIELDS = (
    ("parties", "list[text]"),
    ("effective_date", "date"),
    ("governing_law", "text"),
    ("payment_terms", "span"),
    ("termination_clause", "span"),
)

# Validation rules.
REQUIRED_FIELDS = ("payment_terms", "termination_clause", "governing_law")
NET_DAYS_STANDARD = 30
MAX_NET_DAYS = 120
AMOUNT_UPPER_WARN = 1_000_000.0
NET_DAYS_PCT_FROM_MEDIAN = 0.5
CHECK_PARTY_LAW_CONSISTENCY = True
PER_PARTY_NET_DAYS_TOLERANCE = 15
AMBIGUITY_TERMS = (
    "reasonable efforts",
    "commercially reasonable",
    "material breach",
    "best efforts",
    "undue delay",
    "as soon as practicable",
    "without unreasonable delay",
    "may at its discretion",
    "good faith",
)

# Risk weights and buckets (current profile).
CURRENT_WEIGHTS = (
    ("MISSING", 3.0),
    ("AMBIGUOUS", 2.0),
    ("BAD_DATE", 1.0),
    ("NET_DAYS_OVER_MAX", 3.5),
    ("NET_DAYS_OUTLIER", 2.5),
    ("NET_DAYS_DRIFT_VS_PARTY", 2.0),
    ("GOVERNING_LAW_INCONSISTENT", 2.0),
    ("PAYMENT_AMOUNT_HIGH", 2.5),
)
CURRENT_BUCKETS = (("medium", 5.0), ("high", 10.0))
TOP_K_SUMMARY_SENTENCES = 10
RISK_KEYWORDS = (
    "termination", "indemnify", "liability", "jurisdiction", "payment",
    "net", "late fee", "penalty", "warranty", "force majeure",
    "assignment", "notice", "confidential", "arbitration", "governing law",
)

# Strict profile (older scoring rules).
STRICT_WEIGHTS = (
    ("MISSING", 3.0),
    ("ANOMALY", 2.0),
    ("EXTREME", 4.0),
    ("NOTICE", 1.0),
    ("AMBIGUOUS", 1.0),
    ("CROSS_DOC_DEVIATION", 2.0),
)
STRICT_SCORE_CAP = 20.0
STRICT_BUCKETS = (("medium", 4.0), ("high", 8.0))
STRICT_TOP_N_AMBIGUOUS_TERMS = 10
# Terms the strict profile reports (the only ones seen in its results).
STRICT_AMBIGUITY_TERMS = ("material", "reasonable", "commercially reasonable")

# Extractor settings.
REGEX_CONFIDENCE = 0.6
MIN_SPAN_LEN = 20
MODEL_TOP_K_CHUNKS = 1
MODEL_CONCURRENCY = 3
CHUNK_SIZE = 2000
CHUNK_OVERLAP = 150
RULE_SPAN_CONFIDENCE = 0.72
SPAN_WINDOW = 600
# Characters the fallbacks read; None = the whole text (a recogniser hook may want less).
PARTY_PREFIX_CHARS = None
PLACE_PREFIX_CHARS = None
# Names kept from a fallback or recogniser, chunks kept by the keyword prefilter.
MAX_FALLBACK_PARTIES = 4
PREFILTER_CHUNKS = 5

# Chunk hints per field, in field order.
FIELD_HINTS = (
    ("governing_law", ("governed by the laws of", "governing law")),
    ("payment_terms", ("payment terms", "invoice", "net", "payment", "due")),
    ("termination_clause", ("termination", "term and termination", "terminate")),
    ("parties", ("between", "made by and between", "provider", "recipient", "party")),
    ("effective_date", ("effective date", "commencement date", "effective as of")),
)

# Known places for governing-law canonicalisation.
US_STATES = ("Delaware", "California", "New York", "Texas", "Florida",
             "Washington", "Massachusetts", "Illinois", "Georgia", "Virginia")
COUNTRIES = ("United States", "Singapore", "India", "United Kingdom", "Canada",
             "Germany", "France")

# Report settings.
TOP_RISKY_DOCS = 25
MAX_QUOTE_CHARS = 400
REPORT_SECTION_ROWS = 10
REPORT_EVIDENCE_ROWS = 200
EXPLORE_TOP_ROWS = 100
SHORT_TEXT_CHARS = 50
SUMMARY_KEY_CHARS = 80
SENTENCE_MIN_CHARS = 30
SENTENCE_MAX_CHARS = 400
TFIDF_MAX_FEATURES = 4000
KEYWORD_BOOST = 0.25

# Corporate suffixes used by the rule-based party fallback (our stand-in for
# an entity recogniser; a real recogniser plugs in as a hook).
CORPORATE_SUFFIXES = ("Inc", "Corp", "Corporation", "Company", "LLC", "Ltd",
                      "Limited", "LLP", "LP", "PLC", "GmbH", "AG")


@dataclass(frozen=True)
class Policy:
    """All knobs of one analysis profile."""

    name: str = "current"
    required_fields: tuple = REQUIRED_FIELDS
    net_days_standard: int = NET_DAYS_STANDARD
    max_net_days: int = MAX_NET_DAYS
    amount_upper_warn: float = AMOUNT_UPPER_WARN
    net_days_pct_from_median: float = NET_DAYS_PCT_FROM_MEDIAN
    check_party_law_consistency: bool = CHECK_PARTY_LAW_CONSISTENCY
    per_party_net_days_tolerance: int = PER_PARTY_NET_DAYS_TOLERANCE
    ambiguity_terms: tuple = AMBIGUITY_TERMS
    weights: tuple = CURRENT_WEIGHTS
    buckets: tuple = CURRENT_BUCKETS
    score_cap: float | None = None
    top_k_summary: int = TOP_K_SUMMARY_SENTENCES
    risk_keywords: tuple = RISK_KEYWORDS
    # extraction
    regex_confidence: float = REGEX_CONFIDENCE
    min_span_len: int = MIN_SPAN_LEN
    model_top_k_chunks: int = MODEL_TOP_K_CHUNKS
    model_concurrency: int = MODEL_CONCURRENCY
    chunk_size: int = CHUNK_SIZE
    chunk_overlap: int = CHUNK_OVERLAP
    use_fallback: bool = True
    field_hints: tuple = FIELD_HINTS
    places: tuple = US_STATES + COUNTRIES
    party_prefix_chars: int | None = PARTY_PREFIX_CHARS
    place_prefix_chars: int | None = PLACE_PREFIX_CHARS
    max_fallback_parties: int = MAX_FALLBACK_PARTIES
    prefilter_chunks: int = PREFILTER_CHUNKS
    # options that deviate from the original on purpose (all off by default)
    full_amounts: bool = False
    canonical_law: bool = False
    whole_word_places: bool = False
    # reporting
    top_risky_docs: int = TOP_RISKY_DOCS
    max_quote_chars: int = MAX_QUOTE_CHARS
    # strict-only rules
    approved_laws: tuple = ()
    strict_ambiguity_terms: tuple = ()
    top_n_ambiguous_terms: int = STRICT_TOP_N_AMBIGUOUS_TERMS
    extra: dict = field(default_factory=dict, compare=False, hash=False)

    @property
    def weight_map(self) -> dict:
        return dict(self.weights)

    @property
    def medium(self) -> float:
        return dict(self.buckets)["medium"]

    @property
    def high(self) -> float:
        return dict(self.buckets)["high"]

    def with_(self, **kw) -> "Policy":
        return replace(self, **kw)


def current() -> Policy:
    return Policy()


def strict() -> Policy:
    return Policy(
        name="strict",
        required_fields=tuple(f for f, _ in SCHEMA_FIELDS),
        weights=STRICT_WEIGHTS,
        buckets=STRICT_BUCKETS,
        score_cap=STRICT_SCORE_CAP,
        approved_laws=US_STATES + COUNTRIES,
        strict_ambiguity_terms=STRICT_AMBIGUITY_TERMS,
    )


def from_rules(validation: dict | None = None, analysis: dict | None = None, extraction: dict | None = None,
               base: Policy | None = None) -> Policy:
    """A policy from the three rules documents; keys that are absent keep the
    ``base`` value. Unknown keys are ignored, as the original does."""
    v, a, x = validation or {}, analysis or {}, extraction or {}
    std, out, xref = (v.get(k, {}) for k in ("standards", "corpus_outliers", "cross_reference"))
    base = base or current()
    given = {
        "required_fields": tuple(v["required_fields"]) if "required_fields" in v else None,
        "ambiguity_terms": tuple(v["ambiguity_terms"]) if "ambiguity_terms" in v else None,
        "net_days_standard": std.get("net_days_standard"),
        "max_net_days": std.get("max_net_days"),
        "amount_upper_warn": std.get("amount_upper_warn"),
        "net_days_pct_from_median": out.get("net_days_pct_from_median"),
        "check_party_law_consistency": xref.get("check_per_party_governing_law_consistency"),
        "per_party_net_days_tolerance": xref.get("per_party_net_days_tolerance"),
        "weights": tuple({**base.weight_map, **a["weights"]}.items()) if "weights" in a else None,
        "buckets": tuple({**dict(base.buckets), **a["risk_buckets"]}.items()) if "risk_buckets" in a else None,
        "score_cap": a.get("caps", {}).get("max_risk_score_per_doc"),
        "top_k_summary": a.get("top_k_summary_sentences"),
        "risk_keywords": tuple(a["risk_keywords"]) if "risk_keywords" in a else None,
        "regex_confidence": x.get("regex_confidence"),
        "min_span_len": x.get("min_span_len"),
        "model_top_k_chunks": x.get("llm_top_k_chunks"),
        "chunk_size": x.get("chunk_size"),
        "chunk_overlap": x.get("chunk_overlap"),
    }
    return base.with_(**{k: val for k, val in given.items() if val is not None})


def load_rules(spark, folder: str, base: Policy | None = None, validation: str = "validationrules.json",
               analysis: str = "analystrules.json", extraction: str = "extractor.llm.json") -> Policy:
    """``from_rules`` over the JSON files of a folder that Spark can read; a file that
    is absent leaves its defaults."""
    import json

    def read(name):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")
        if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return None
        return json.loads(spark.read.option("wholetext", True).text(path.toString()).first()[0])

    return from_rules(read(validation), read(analysis), read(extraction), base)
