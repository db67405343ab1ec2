"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.01 python bench.py [query ...]
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lumbrera import queries as catalog  # noqa: E402
from lumbrera.session import build_session  # noqa: E402

HEADLINE = (
    "00_score_and_longest_sentences", "t03_sentences", "r01_long_sentences", "r04_readability", "r10_long_sections", "r14_low_contrast_passages",
    "r21_typography_issues", "r24_all_findings", "c02_text_penalties", "c07_apply_caps", "f09_merged_findings", "p01_detect_pii", "p07_redact_secrets",
    "d08_apply_replacements", "d11_final_report", "m03_usage_series", "m05_tokens_by_provider", "m09_latency_by_model", "m24_shares_by_kind",
    "u03_user_stats", "u08_user_kpis", "l09_trailing_counts", "l10_replay_limiter", "q07_execution_table", "s06_extract_blocks", "x01_insert_image_blocks",
    "e04_word_error_rate", "w02_stream_usage",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 1))
    spark = build_session(
        "bench", spark__checkpoint__dir=tempfile.mkdtemp(prefix="spark-"), master=f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"))
    spark.sparkContext.setLogLevel("ERROR")
    available = catalog.load()
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        started = time.perf_counter()
        available[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline queries, total wall clock", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
