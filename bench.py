"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_KEYS (comma-separated, default the headline set).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from marketlens.plans import catalog  # noqa: E402
from marketlens.session import local_session  # noqa: E402

HEADLINES = [
    "label_distribution", "align_news_prices", "align_untagged_news", "market_features", "rsi",
    "clean_text", "lexicon_counts", "valence_sentiment", "sentiment_features", "tfidf",
    "tfidf_transform", "text_embedding", "heuristic_score", "ensemble_vote", "safety_rules",
    "metrics_summary", "roc_auc_ovr", "stratified_split", "sentiment_timeline", "stream_score",
    "fit_logistic", "score_batch",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    keys = [k for k in os.environ.get("BENCH_KEYS", "").split(",") if k] or HEADLINES
    spark = local_session(cores, memory=os.environ.get("BENCH_MEMORY", "16g"))
    registered = catalog.queries()
    # One small query first, so that JVM start-up is not charged to the first key.
    registered["label_name"](spark, sf_dir).limit(1).collect()
    seconds = {}
    for key in keys:
        started = time.perf_counter()
        registered[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[key] = round(time.perf_counter() - started, 3)
        print(f"{key}: {seconds[key]}s", file=sys.stderr)
    spark.stop()
    print(json.dumps({
        "metric": "total wall time of headline queries", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))[2:]}))


if __name__ == "__main__":
    main()
