"""Headline queries, timed one by one: each runs from its files to a count of its rows, nothing is kept between them."""

from __future__ import annotations

import json
import os
import time

from placeproof import plans
from placeproof.plans import scoring
from placeproof.plans.registry import QUERIES
from placeproof.session import local_session

HEADLINES = [
    "tiers_per_profile", "score_photos", "rank_photos", "locate_on_campus", "building_at", "near_signatures", "group_duplicates",
    "provenance", "daily_usage", "spend_admission", "version_changed", "cached_verdicts", "same_organisation", "top_candidates",
    "prompt_verdict", "normalize_text", "split_sentences", "extract_campus_links", "recent_history", "upsert_stream",
]


def main() -> None:
    plans.load()
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(cores=os.environ.get("BENCH_CPUS", "8"), name="placeproof-bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINES:
        scoring.forget_stored()
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
