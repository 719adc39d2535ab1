"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores, BENCH_ONLY limits the
run to queries whose names start with one of its words ("all" runs every query).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "a1_rank_versions", "a2_latest_per_package", "a3_outdated_packages", "a4_best_match", "a5_missing_requirements",
    "b3_search_documents", "b6_find_executables", "b7_resolve_names", "b8_fuzzy_match", "b9_suggest_similar",
    "c1_closure_depth_3", "c3_topological_levels", "c4_detect_cycles",
    "c5_reverse_dependents", "c6_version_conflicts", "c10_resolve_inheritance", "d1_extract_imports", "d3_parse_manifests",
    "d5_extract_declarations", "d7_locate_offsets", "d8_check_signatures", "f5_expand_templates", "g4_stream_mirror_state", "h2_read_source_tree",
    "d16_tap_results", "e1_install_summary", "e4_operation_metrics", "e7_detect_regressions", "e8_usage_trend",
    "e12_mirror_current_state", "e17_evict_by_size", "e19_apply_retention", "f1_merge_layers", "f4_diff_tables",
    "f7_validate_rows", "g1_route_events", "g3_windowed_operation_metrics",
)


def main() -> None:
    from supplyscope.registry import all_queries
    from supplyscope.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="bench")
    queries = all_queries()
    only = os.environ.get("BENCH_ONLY", "").split()
    names = HEADLINE if not only else [n for n in queries if "all" in only or n.startswith(tuple(only))]
    spark.range(100000).groupBy("id").count().write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": float(scale)}))


if __name__ == "__main__":
    main()
