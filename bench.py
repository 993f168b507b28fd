"""Time the headline queries. Prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local threads.
Every query is planned and run in full; its rows go to Spark's ``noop`` sink.
``python bench.py name ...`` times the named queries instead, ``all`` every one.
"""

from __future__ import annotations

import json
import os
import sys
import time

from webloom.plans import all_queries
from webloom.session import build_session

HEADLINE = (
    # URL tables
    "url_canonical_groups", "url_validity_audit", "url_exclude_hits", "download_asset_split", "domain_rollup",
    "cross_domain_drops", "origin_list", "secret_redaction", "text_sanitize_controls",
    # pages
    "page_text_corpus", "page_titles", "link_graph_edges", "link_drop_stats", "content_dedup", "sampled_hash_dedup", "page_outcomes",
    # rules
    "rule_corpus_load", "rule_dedup", "rule_match", "field_extract", "field_transform", "extraction_default_fallback", "rule_catalog_diff",
    # robots and sitemaps
    "robots_verdict_by_domain", "crawl_delay_overlay", "sitemap_corpus_load", "sitemap_expand", "sitemap_new_vs_known",
    # frontier
    "url_admission", "discovery_union", "domain_round_robin", "politeness_plan_strict", "domain_batch_cap", "lost_children",
    "retry_reclaim", "retry_ledger", "crawl_depth_bfs", "complete_merge",
    # statistics and windows
    "outcome_summary", "domain_stats", "fetch_error_classes", "crawl_report", "health_rollup", "token_usage", "failure_burst",
    "endpoint_health_score", "latency_ewma", "path_memory_asof", "rate_limit_audit",
    # chat and streams
    "chatml_assemble", "token_counts", "stream_dedup_ttl", "stream_outcome_windows",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = all_queries()
    names = sys.argv[1:] or HEADLINE
    if list(names) == ["all"]:
        names = tuple(known)
    # JVM and Python workers are started before the clock runs.
    for name in ("url_canonical_groups", "page_titles"):
        known[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        known[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
