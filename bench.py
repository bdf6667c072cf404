"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

The source corpus (prose, pages and code rendered from the given tables) is stored once as parquet
before the clock starts, as a real corpus is; every query then reads stored tables, runs to a full
result without a driver collect, and is timed from plan building to the last row (best of two runs).
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from lintlake.session import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))
CATALOGUE = (
    "A03_file_health_score", "A04_health_score_mean", "A25_severity_share", "A13_ai_daily_costs", "J01_compare_new",
    "J03_compare_summary", "W01_snapshot_trend", "W06_hotspots", "W07_dedupe_scan", "W14_failure_streaks",
    "M01_remap_observed", "J10_degrees", "S16_export_issues_json", "S10_read_semgrep", "X07_sliding_rate",
)


def main() -> None:
    spark = build_session(
        "bench", master=f"local[{CPUS}]", spark__sql__shuffle__partitions=CPUS, spark__driver__memory="16g",
        spark__ui__enabled="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    from lintlake import catalog
    from lintlake.catalog import bindings
    from lintlake.catalog.core import Tables
    from lintlake.operators import context
    from lintlake.plans import scan
    from lintlake.rules import lines, matches, spans, symbols

    tables = Tables(spark, SF_DIR)
    store = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    bindings.corpus(tables).repartition(4 * int(CPUS)).write.parquet(f"{store}/corpus")
    corpus = spark.read.parquet(f"{store}/corpus")
    n_files = corpus.count()
    registered = catalog.queries()
    headline = {
        "scan_lines": lambda: lines.line_issues(corpus),
        "scan_matches": lambda: matches.match_issues(corpus),
        "scan_static": lambda: scan.scan(corpus, "static"),
        "report_web": lambda: scan.report(corpus, "web"),
        "project_health": lambda: scan.project_health(corpus, scan.report(corpus, "regex")),
        "function_metrics": lambda: spans.function_metrics(corpus),
        "resolve_imports": lambda: context.resolve_imports(corpus, symbols.imports(corpus)),
        **{name: (lambda name=name: registered[name](spark, SF_DIR)) for name in CATALOGUE},
    }
    times = {}
    for name, make in headline.items():
        best = None
        for _ in range(RUNS):
            start = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    print(json.dumps({
        "metric": "total time of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"), "cpus": int(CPUS),
        "corpus_files": n_files, "files_per_sec_static": round(n_files / times["scan_static"], 1),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
