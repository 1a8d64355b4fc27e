"""Steps in order (ORC-01) and experiments that don't stop each other (ORC-02)."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Step:
    """``run`` writes ``outputs``; ``check`` returns violations as a small DataFrame (``audit.expectations``)."""

    name: str
    run: Callable[[SparkSession], None]
    outputs: tuple[str, ...] = field(default=())
    check: Callable[[SparkSession], DataFrame] | None = None


def _written(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def run(spark: SparkSession, steps: list[Step], first: int = 1, last: int | None = None, skip_written: bool = False, audit_only: bool = False, go_on: bool = False) -> list[dict]:
    """One row a step: ``step``, ``status`` (done, skipped, checked, failed), ``seconds``, ``error``. A step fails on an error, an output that isn't there
    or a violation; then the run ends unless ``go_on``."""
    report = []
    for s in steps[first - 1 : last]:
        began, status, error = time.monotonic(), "done", None
        try:
            if audit_only:
                status = "checked"
            elif skip_written and s.outputs and all(_written(spark, p) for p in s.outputs):
                status = "skipped"
            else:
                s.run(spark)
                gone = [p for p in s.outputs if not _written(spark, p)]
                if gone:
                    raise FileNotFoundError(f"not written: {gone}")
            if s.check is not None and status != "skipped":
                from tarn.operators.audit import require

                require(s.check(spark))
        except Exception as e:  # reported, and raised by nobody: the caller reads the report
            status, error = "failed", f"{type(e).__name__}: {e}"
        report.append({"step": s.name, "status": status, "seconds": round(time.monotonic() - began, 3), "error": error})
        if error and not go_on:
            break
    return report
