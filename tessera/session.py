"""Session factory and execution presets.

A preset changes how Spark runs a plan (whole-stage code generation on or off), never what it computes.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

#: How a plan is executed; results must be equal under all of them.
MODES: dict[str, dict[str, str]] = {
    "fused": {"spark.sql.codegen.wholeStage": "true", "spark.sql.codegen.factoryMode": "CODEGEN_ONLY"},
    "interpreted": {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"},
    "rof": {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "CODEGEN_ONLY"},
    "hybrid": {"spark.sql.codegen.wholeStage": "true", "spark.sql.codegen.factoryMode": "FALLBACK"},
}


def build_session(
    master: str = "local[8]", name: str = "tessera", shuffle_partitions: int = 8, extra: dict[str, str] | None = None
) -> SparkSession:
    """A UTC, ANSI session with adaptive execution."""
    conf = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
    }
    return SparkSession.builder.master(master).appName(name).config(map=conf | (extra or {})).getOrCreate()


def set_mode(spark: SparkSession, mode: str) -> None:
    """Switch the execution preset of a session; an unknown name raises ``KeyError``."""
    for key, value in MODES[mode].items():
        spark.conf.set(key, value)


def with_threads(spark: SparkSession, threads: int) -> SparkSession:
    """A session whose queries run on ``threads`` cores.

    A local session has its cores from its start, so another one takes its place, with its other settings. On a cluster cores belong to
    the executors; there the shuffle's partitions bound the tasks of a stage instead.
    """
    if threads < 1:
        raise ValueError("one thread at least")
    if not spark.sparkContext.master.startswith("local"):
        spark.conf.set("spark.sql.shuffle.partitions", str(threads))
        return spark
    if spark.sparkContext.defaultParallelism == threads:
        return spark
    own = ("spark.master", "spark.app.name", "spark.app.id", "spark.app.startTime", "spark.driver.port", "spark.driver.host", "spark.executor.id", "spark.sql.shuffle.partitions")
    kept = {k: v for k, v in spark.sparkContext.getConf().getAll() if k not in own}
    name = spark.sparkContext.appName
    spark.stop()
    return build_session(f"local[{threads}]", name, threads, kept)
