"""Wall time of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from lodestack.plans import registry
from lodestack.session import local_session

HEADLINE = [
    "flagship_length_stats", "a01_dedup_first", "j07_duplicate_links", "a18_unique_ids", "t03_first_sentence",
    "t08_mask_code", "x01_extract_functions", "x02_clean_corpus", "x05_build_pretrain", "o04_split_exact",
    "a19_ngram_counts", "a06_corpus_bleu", "a09_weighted_recall", "a10_structure_recall", "j03_join_pairs",
    "j06_nearest_manifest", "w03_early_stop", "a15_count_spans", "x07_word_counts", "a20_score_language",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8, memory=os.environ.get("BENCH_MEMORY", "8g"))
    spark.sparkContext.setLogLevel("ERROR")
    # One small pass so that class loading is not charged to the first query.
    registry.QUERIES["s03_parquet_scan"](spark, sf).collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
