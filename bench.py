"""Headline queries over ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

``$BENCH_RUNS`` runs of each query (10) behind a warm-up run, into a sink that drops the rows; the least and the median time, in seconds, and the
settings. ``queries`` has the least times of the first of ``$BENCH_MODES`` (names of execution presets with commas between, or ``all``;
``hybrid``, Spark's own settings, if unset). Presets of one process run one after the other, the later ones on compiled code, so to compare them
run each in a process of its own. ``$BENCH_CSV`` names a file for every single run: mode, query, scale, run, seconds.
"""

from __future__ import annotations

import csv
import json
import os
import re
import statistics
import time

from pyspark.sql import SparkSession

from tessera.plans import QUERIES
from tessera.session import MODES, build_session, set_mode

HEADLINE = ["q1", "q3", "q4", "q5", "q6", "q13", "q14", "q18", "q19", "q_bigjoin", "l_count", "l_point"]
RECORDED = ("spark.master", "spark.driver.memory", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.ansi.enabled")


def timed(spark: SparkSession, name: str, directory: str, runs: int) -> list[float]:
    """Seconds of each run but the first, which warms up."""
    times = []
    for _ in range(runs + 1):
        began = time.perf_counter()
        QUERIES[name](spark, directory).write.format("noop").mode("overwrite").save()
        times.append(time.perf_counter() - began)
    return times[1:]


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "10"))
    asked = os.environ.get("BENCH_MODES", "hybrid")
    modes = list(MODES) if asked == "all" else asked.split(",")
    found = re.search(r"sf([0-9.]+)", directory)
    scale = float(found[1]) if found else directory
    spark = build_session(f"local[{cpus}]", "bench", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    every: dict[str, dict[str, list[float]]] = {}
    for mode in modes:
        set_mode(spark, mode)
        every[mode] = {name: timed(spark, name, directory, runs) for name in HEADLINE}
    if os.environ.get("BENCH_CSV"):
        with open(os.environ["BENCH_CSV"], "w", newline="", encoding="utf-8") as f:
            csv.writer(f).writerows([m, q, scale, i, round(t, 6)] for m, by in every.items() for q, times in by.items() for i, t in enumerate(times))
    least, middle = ({m: {q: round(f(times), 4) for q, times in by.items()} for m, by in every.items()} for f in (min, statistics.median))
    settings = {k: spark.conf.get(k, None) for k in RECORDED} | {"cpus": cpus, "runs": runs, "modes": {m: MODES[m] for m in modes}}
    best = least[modes[0]]
    print(json.dumps({
        "metric": "total_best_seconds", "value": round(sum(best.values()), 4), "unit": "sec", "queries": best, "sf": scale,
        "median": middle[modes[0]], "total_median_seconds": round(sum(middle[modes[0]].values()), 4), "modes": {m: {"best": least[m], "median": middle[m]} for m in modes}, "config": settings,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
