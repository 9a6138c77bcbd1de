"""Benchmark: headline queries at one scale factor; prints ONE JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query runs to completion through Spark's ``noop`` sink (all rows are
produced, none are shipped to the driver). The contract queries share the
materialised validated portfolio, so the first of them (``cross_reference``)
includes extraction and validation of the whole corpus.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = (
    "cross_reference",
    "per_doc_metrics",
    "findings",
    "crossref_report",
    "kpi_net_days",
    "kpi_monthly",
    "kpi_party_avg_risk",
    "top_risky_docs",
    "report_sections",
    "corpus_summary",
    "split_sentences",
    "tfidf_sentence_score",
    "document_summary",
    "make_chunks",
    "chunk_prefilter_top5",
    "strict_risk_score",
    "apply_filters",
    "findings_semi_join",
    "model_extract",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from clauselens.plans.queries import REGISTRY
    from clauselens.session import build_session

    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(8, cpus),
                          extra={"spark.driver.memory": "16g"})
    # A fixed piece of work, so that runs on machines of different speed can be told apart.
    t0 = time.time()
    spark.range(0, 300_000_000, 1, cpus).selectExpr("sum(xxhash64(id) % 1000)").collect()
    calibration = round(time.time() - t0, 3)
    times = {}
    for key in HEADLINE:
        fn = REGISTRY.get(key)
        if fn is None:
            continue
        t0 = time.time()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[key] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus, "calibration": calibration}))
    spark.stop()


if __name__ == "__main__":
    main()
