"""Interactive runner: ``help``, ``load DIR``, ``show``, ``mute``, ``unmute``, ``threads N``, ``mode NAME``, ``run QUERY [mode NAME]``, ``exit``."""

from __future__ import annotations

import sys
import time
from collections.abc import Iterable
from typing import TextIO

from pyspark.sql import SparkSession

from tessera.plans import ORACLE_SQL, QUERIES
from tessera.session import MODES, build_session, set_mode, with_threads
from tessera.sources import TABLES, format_rows

HELP = "help | load DIR | show | show QUERY | mute | unmute | threads N | mode " + "/".join(MODES) + " | run QUERY [mode NAME] | exit"


class Runner:
    """State of one interactive run; :meth:`handle` takes a line and returns False at ``exit``."""

    def __init__(self, spark: SparkSession, out: TextIO = sys.stdout) -> None:
        self.spark, self.out = spark, out
        self.directory: str | None = None
        self.mode: str | None = None
        self.muted = False

    def say(self, text: str) -> None:
        print(text, file=self.out)

    def handle(self, line: str) -> bool:
        """Takes one command; one that fails is reported and leaves the runner as it was."""
        if line.strip() == "exit":
            return False
        try:
            self._do(*line.strip().partition(" ")[::2])
        except Exception as error:  # noqa: BLE001 (whatever a query raises is shown, and the next command awaited)
            self.say(f"failed: {str(error).splitlines()[0] if str(error) else type(error).__name__}")
        return True

    def _do(self, word: str, rest: str) -> None:
        rest = rest.strip()
        if word in ("mute", "unmute"):
            self.muted = word == "mute"
        elif word == "load":
            self.directory = rest
        elif word == "show":
            loaded = f"loaded: {self.directory or 'nothing'}\ntables: {' '.join(TABLES)}\nqueries: {' '.join(QUERIES)}"
            self.say(ORACLE_SQL.get(rest, "unknown query").strip() if rest else loaded)
        elif word == "threads":
            self.spark = with_threads(self.spark, int(rest))
            if self.mode:
                set_mode(self.spark, self.mode)
        elif word == "mode" and rest in MODES:
            set_mode(self.spark, rest)
            self.mode = rest
        elif word == "run":
            self._run(*rest.split())
        else:
            self.say(HELP)

    def _run(self, query: str = "", word: str = "mode", mode: str | None = None) -> None:
        if not self.directory:
            self.say("load a directory first")
        elif query not in QUERIES or word != "mode" or (mode or "fused") not in MODES:
            self.say(HELP)
        else:
            # without a mode ever named, the session's settings hold
            before = {key: self.spark.conf.get(key) for key in MODES["fused"]}
            if mode:
                set_mode(self.spark, mode)
            try:
                began = time.perf_counter()
                text = format_rows(QUERIES[query](self.spark, self.directory))
                took = time.perf_counter() - began
            finally:
                for key, value in before.items():
                    self.spark.conf.set(key, value)
            if not self.muted:
                self.say(text.rstrip("\n"))
            self.say(f"{query}: {text.count(chr(10)) - 1} rows, {took:.3f} s")


def main(lines: Iterable[str] = sys.stdin) -> None:
    runner = Runner(build_session())
    for line in lines:
        if line.strip() and not runner.handle(line):
            break


if __name__ == "__main__":
    main()
