"""Wall time of the headline queries; prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the data and the cores."""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

from measurekit.plans import queries as q
from measurekit.session import build_session

SHARED = ("flagged", "observations", "session_flags", "versions", "sessions", "context", "fact_session")
HEADLINE = ("metric_all", "sen1_scenario_metrics", "sen2_deltas", "sen7_timezone_evidence", "agg11_findings_by_rule", "agg15_daily_volume", "agg19_portioning",
            "agg25_column_profile", "agg31_spearman", "bld10_fact_session", "bld11_fact_component", "check_E", "check_M", "check_MC", "join06_versions",
            "join08_tray_overlap", "join15_rank_percentile", "win2_gaps", "win6_repeat_share_summary", "lineitem_session_metrics", "lineitem_daily_volume",
            "prj08_local_to_utc", "win1_document_repeats", "agg37_lineitem_duplicates")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session("bench", f"local[{cpus}]", cpus, **{"spark.ui.enabled": "false", "spark.driver.memory": "16g",
                                                              "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-")})
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    m = q.measurement(spark, sf_dir)
    for step in SHARED:             # staging and the other shared steps, written once
        start = time.perf_counter()
        getattr(m, step)
        times[f"stage_{step}"] = round(time.perf_counter() - start, 3)
    for name in HEADLINE:
        start = time.perf_counter()
        q.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_wall_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": float(scale.group(1)) if scale else None}))
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
