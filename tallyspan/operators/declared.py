"""What declared commands said, as rows: a table function for SQL's LATERAL.

A command passes or fails by its exit code, or prints one JSON object of
counts.  Some codes say that it could not check at all.  Anything else than a
clean object of counts is a refusal with a reason, never a count of zero.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

#: Counts beyond this many in all are refused.  Fixed value.
MOST = 100_000
RESULT = "status string, key string, value bigint, why string"


def judged(name: str, code: int | None, said: str | None, counts: bool, cannot_run: list[int] | None, truncated: bool) -> Iterator[tuple]:
    """(status, key, value, why): ``passed``, ``failed``, ``cannot run``, ``refused``, or a row ``counted`` for each count."""
    if truncated:
        yield "cannot run", None, None, f"{name} said more than is read"
    elif code is not None and code in (cannot_run or ()):
        yield "cannot run", None, None, f"{name} could not check (exit code {code})"
    elif not counts:
        yield ("passed", None, None, None) if code == 0 else ("failed", None, None, f"{name} failed with {'no exit code' if code is None else f'exit code {code}'}")
    elif code != 0:
        yield "cannot run", None, None, f"{name} did not count"
    else:
        try:
            held = json.loads(said or "")
        except ValueError:
            held = None
        if not isinstance(held, dict) or not all(isinstance(v, int) and not isinstance(v, bool) and v >= 0 for v in held.values()):
            yield "refused", None, None, f"{name} printed no object of counts"
        elif sum(held.values()) > MOST:
            yield "refused", None, None, f"{name} counted more than {MOST}"
        else:
            for key in sorted(held):
                yield "counted", key, held[key], None


@udtf(returnType=RESULT)
class JudgedCommand:
    def eval(self, name: str, code: int, said: str, counts: bool, cannot_run: list, truncated: bool):
        yield from judged(name, code, said, bool(counts), cannot_run, bool(truncated))


def register(spark: SparkSession) -> None:
    """Make ``judged_command(name, code, said, counts, cannot_run, truncated)`` known to SQL."""
    spark.udtf.register("judged_command", JudgedCommand)


def judge_commands(runs: DataFrame) -> DataFrame:
    """name, status, key, value, why: what each run (name, code, said, counts, cannot_run, truncated) comes to.

    A null code is a command that was stopped.  Null flags are false.
    """
    register(runs.sparkSession)
    return runs.sparkSession.sql("SELECT r.name, t.* FROM {runs} r, LATERAL judged_command(r.name, r.code, r.said, coalesce(r.counts, false), r.cannot_run, coalesce(r.truncated, false)) t", runs=runs)
