"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

HEADLINE = [
    "O1_search", "O3_T6_similar_places", "O4_detail_headers", "O11_U1_for_you", "O15_saved_lists", "O17_dish_listing",
    "O18_category_listing", "E3_E4_dish_suggestions", "E5_attribute_links", "E7_E9_documents", "J7_radius_join",
    "J8_similar_dish_names", "S2_F13_F14_X7_X8_X10_parse_list", "I4_source_upsert", "R2_drop_corrupted_dishes", "R7_audit",
]


def main() -> None:
    from checks import load_all
    from larder.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    queries = load_all()
    wanted = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    seconds = {}
    for name in wanted:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 2)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall clock",
                "value": round(sum(seconds.values()), 2),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
