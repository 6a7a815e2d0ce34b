"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line:
  {"metric": "total_sec", "value": ..., "unit": "sec", "queries": {...}, "sf": ...,
   "quality": {"map@20_knn": ..., ...}}

Each query runs to completion through a no-op sink (the whole plan executes,
nothing is collected). ``quality`` is MAP at n = 20, 50, 200 for the kNN,
popularity and ALS recommenders on groups of 4, the numbers the reference
publishes.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "extract_subset", "song_play_mean", "user_play_mean", "item_liking", "play_histogram", "top_songs",
    "center_by_user", "id_index_items", "split_train", "cv_folds", "group_users", "virtual_users",
    "item_cosine_groups", "k_similar_items", "recommend_knn", "evaluate_knn", "evaluate_popular",
    "evaluate_random", "popularity_curve_subsets", "user_similarity", "artist_terms", "ragged_slice",
    "evaluate_als_sweep",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ.setdefault("PLAYLENS_SHUFFLE_PARTITIONS", str(max(8, int(cpus))))
    from playlens.plans.queries import QUERIES
    from playlens.session import get_session

    spark = get_session(f"local[{cpus}]", "playlens-bench")
    # Warm-up: JVM, Python workers, parquet footers.
    QUERIES["song_play_mean"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    quality: dict[str, float] = {}
    for name in HEADLINE:
        t0 = time.time()
        df = QUERIES[name](spark, sf_dir)
        if name in ("evaluate_knn", "evaluate_popular", "evaluate_als_sweep"):
            label = {"evaluate_knn": "knn", "evaluate_popular": "pop", "evaluate_als_sweep": "mf"}[name]
            for row in df.collect():
                quality[f"map@{row['n']}_{label}"] = round(float(row["map"]), 6)
        else:
            df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"# {name}: {times[name]:.2f}s", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "quality": quality}))
    spark.stop()


if __name__ == "__main__":
    main()
