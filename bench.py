"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line.

Each query is fully materialised with a no-op sink (``write.format("noop")``), so the timing covers
the whole plan without collecting rows to the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "mask_documents",
    "regex_counts_by_lang",
    "protected_mask",
    "detect_spans",
    "merge_spans_array",
    "mask_merged_phi",
    "struct_mask_orders",
    "mask_table_audit",
    "token_features",
    "bio_tags",
    "weak_span_counts",
    "eval_strict",
    "eval_leak",
    "suggest_mapping",
    "gazetteer_mask",
    "lexicon_tokens",
    "ann_roundtrip",
    "first_by_label",
    "eval_per_label",
    "chunks",
    "mask_notes",
    "protected_mask_notes",
    "ner_mask_notes",
    "phrase_matches",
    "rejects_no_ann",
    "corpus_report",
    "eval_iou",
    "eval_iou_rows",
    "span_align",
    "balanced_sample",
    "date_years",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from velado.plans import catalog
    from velado.session import get_spark

    spark = get_spark(f"local[{cpus}]", app="velado-bench", shuffle_partitions=int(cpus) * 2,
                      extra={"spark.velado.inputPartitions": str(int(cpus) * 2)})
    qs = catalog.queries()
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in qs]
    # Untimed warm-up on the smallest tables (JVM start-up, JIT, first codegen), as any benchmark does.
    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(warm):
        qs["mask_documents"](spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.time()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    total = round(sum(times.values()), 3)
    sf = sf_dir.rstrip("/").split("sf")[-1]
    print(json.dumps({
        "metric": "total_sec_headline_queries",
        "value": total,
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "documents": docs,
        "documents_per_sec_mask": round(docs / times["mask_documents"], 1) if "mask_documents" in times else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
