"""Time the headline queries and print one JSON line.

BENCH_SF_DIR, BENCH_CPUS and BENCH_QUERIES (comma-separated names, or ``all``) choose
what runs. Every query is written to the no-op sink, so all of its rows are computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from attesta.queries import QUERIES  # noqa: E402
from attesta.session import get_spark, ship  # noqa: E402

HEADLINE = [
    "io4_dedupe_by_hash", "io7_replace_by_key", "ly3_assemble_blocks", "ly4_classify_heading",
    "ly14_merge_visual_lines", "ly16_group_lines", "tx1_split_sentences", "ch1_heading_path",
    "ch2_chunk_elements", "ch5_chunk_transcript", "ve5_dense_topk", "ve6_sparse_topk", "rt6_hybrid_search",
    "rt13_interleave", "ct1_parse_markers", "ct6_align_sentences", "ct7_spans_for", "ct11_resolve_citations",
    "tb1_query_table", "tp4_resolve_topics", "tp7_merge_similar_topics", "mt1_ancestors", "mt7_descendants_count",
    "st2_fold_turn", "st3_document_progress",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINE
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=int(cpus))
    ship(spark)
    # one small job of each kind first, so no query pays for the start of the JVM and workers
    spark.range(1000).mapInPandas(lambda frames: frames, "id long").count()
    spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("max(length(text))").collect()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
