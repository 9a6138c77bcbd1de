"""End-to-end plan: documents -> extract -> validate -> cross-reference -> metrics.

``Portfolio`` is a thin holder of lazily built DataFrames. Two shared
intermediates are materialised once per session, both without any clause text (a contract's
clauses are nearly its whole text, and keeping or shuffling them grows past memory and disk):

* ``facts`` - keys, normalised values and issues of the first pass, read five times by the
  cross-reference (median, party statistics, join);
* ``marked`` - the same documents with all issues; source of metrics, KPIs and exploration.

What needs clause texts (findings' quotes, risky snippets, whole records) reads them from
``first_pass`` or ``validated``, which extract them again in the pass that uses them.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import policy as P
from ..operators import crossref, findings as FN, risk, textmine as TM
from ..operators.extraction import extract_fields
from ..operators.validate import validate_first_pass
from ..session import materialize
from ..sources.contracts import contracts
from ..sources.tables import documents

_CACHE: dict = {}

#: What the cross-reference and the metrics read of a document.
FACTS = ("doc_id", "party_key", "governing_law", "effective_date_normalized", "payment_net_days",
         "payment_amount_normalized", "_issues")


class Portfolio:
    def __init__(self, spark: SparkSession, sf_dir: str, policy: P.Policy = P.current(),
                 docs: DataFrame | None = None, materialize_mode: str | None = None):
        self.spark = spark
        self.sf_dir = sf_dir
        self.policy = policy
        self._docs = docs
        # "persist" (cache, recomputed from lineage if an executor is lost) or
        # "checkpoint" (written to the shared checkpoint folder, lineage cut);
        # set clauselens.materialize=checkpoint on large clusters.
        self.materialize_mode = materialize_mode or spark.conf.get("clauselens.materialize", "persist")

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str, policy: P.Policy = P.current()) -> "Portfolio":
        """One shared instance per (session, scale dir, policy); an instance over another
        folder or policy releases what the one before kept."""
        key = (spark.sparkContext.applicationId, id(spark), sf_dir, policy.name, policy)
        pf = _CACHE.get(key)
        if pf is None:
            for old in list(_CACHE):
                _CACHE.pop(old).release()
            pf = _CACHE[key] = cls(spark, sf_dir, policy)
        return pf

    @cached_property
    def docs(self) -> DataFrame:
        """``(doc_id, text)``: the contract corpus."""
        return self._docs if self._docs is not None else contracts(self.spark, self.sf_dir)

    @cached_property
    def extracted(self) -> DataFrame:
        return extract_fields(self.docs, self.policy)

    @cached_property
    def first_pass(self) -> DataFrame:
        return validate_first_pass(self.extracted, self.policy)

    @cached_property
    def facts(self) -> DataFrame:
        return materialize(self.first_pass.select(*FACTS, F.size("_issues").alias("first_issues")), self.materialize_mode)

    @cached_property
    def marked(self) -> DataFrame:
        return materialize(crossref.cross_reference(self.facts, self.policy), self.materialize_mode)

    @cached_property
    def validated(self) -> DataFrame:
        """Whole records with all issues."""
        return crossref.cross_reference(self.first_pass, self.policy, facts=self.facts)

    @cached_property
    def per_doc(self) -> DataFrame:
        return risk.per_doc_metrics(self.marked, self.policy)

    @cached_property
    def findings(self) -> DataFrame:
        return FN.findings_of_passes(self.first_pass, self.marked, self.policy)

    @cached_property
    def clause_corpus(self) -> TM.SentenceCorpus:
        """Sentences of the risky snippets with ids (doc, snippet, sentence)."""
        s = TM.split_sentences(TM.risky_snippets(self.first_pass), ["doc_id", "snippet_pos"], "snippet")
        return TM.SentenceCorpus(s.select("*", F.struct("doc_id", "snippet_pos", "sentence_pos").alias("sid")))

    @cached_property
    def document_corpus(self) -> TM.SentenceCorpus:
        """Sentences of the documents table with ids (doc, sentence)."""
        s = TM.split_sentences(documents(self.spark, self.sf_dir), ["doc_id"], "text")
        return TM.SentenceCorpus(s.select("*", F.struct("doc_id", "sentence_pos").alias("sid")))

    def release(self) -> None:
        """Give back what is cached; frames made from it stay valid and recompute."""
        alive = self.spark.sparkContext._jsc is not None
        for name in ("facts", "marked", "first_pass", "validated", "extracted", "per_doc", "findings", "clause_corpus", "document_corpus"):
            df = self.__dict__.pop(name, None)
            if df is not None and alive and name in ("facts", "marked"):
                df.unpersist()
