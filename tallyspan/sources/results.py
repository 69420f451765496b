"""Results of mutation runs: two JSON documents for each target, the mutations and their evaluation, as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import staged
from ..operators.joins import MARKS, idle, mark_code

MUTATIONS = "mutations array<struct<id: bigint, operator: string, display_name: string, origin_span: struct<path: string, begin: array<int>, end: array<int>>>>"
EVALUATION = "tests array<struct<name: string>>, mutation_runs array<struct<mutation_detection_matrix: struct<overall_detections: string, test_detections: array<string>>>>"
IDENTITY = ["file", "begin", "end", "operator", "what"]
#: Marks by which a test kills a mutation, and by which it detects one.  Fixed values.
KILLS, DETECTS = "DC", "DCT"


def _why(marks: Column) -> Column:
    """Why a target's documents can't be read together, or null."""
    n = F.size("_m")
    known = f"^[{''.join(c if c != '-' else chr(92) + '-' for c in MARKS)}]*$"
    out_of_order = F.exists(F.sequence(F.lit(0), n), lambda i: (i < n) & ~F.coalesce(F.get("_m", i)["id"] == i + 1, F.lit(False)))
    uneven = F.exists("_rows", lambda r: ~F.coalesce(F.char_length(r) == n, F.lit(False)))
    return (
        F.when(F.col("_m").isNull() | F.col("_e").isNull(), "unreadable")
        .when(F.coalesce(F.size("_e.mutation_runs"), F.lit(0)) != 1, "other than one evaluation")
        .when(marks.isNull() | (F.char_length(marks) != n) | out_of_order, "verdicts don't line up with mutations")
        .when(~marks.rlike(known), "unknown verdict")
        .when((F.size("_rows") > 0) & ((F.size("_rows") != F.size("_tests")) | uneven), "tests don't line up with their detections")
    )


class Results:
    """Tables of a folder of results: ``refused`` (target, error), ``judged`` and ``seen``.

    ``rows`` hold a target, its mutations and its evaluation as JSON text.  A
    target whose documents don't fit each other is refused as a whole, so that
    nothing of it reads as clean.  ``judged`` has a row for each mutation of a
    target with its verdict's code; ``seen`` one for each mark of a test on a
    mutation that isn't a miss.  Both name mutations by what they change, since
    each target numbers its own.
    """

    def __init__(self, rows: DataFrame, target: str, mutations: str, evaluation: str):
        read = rows.select(F.col(target).alias("target"), F.from_json(mutations, MUTATIONS)["mutations"].alias("_m"), F.from_json(evaluation, EVALUATION).alias("_e"))
        matrix = F.get(F.col("_e.mutation_runs"), F.lit(0))["mutation_detection_matrix"]
        none = F.array().cast("array<string>")
        read = read.select("target", "_m", "_e", matrix["overall_detections"].alias("_marks"), F.coalesce(matrix["test_detections"], none).alias("_rows"), F.coalesce(F.col("_e.tests.name"), none).alias("_tests"))
        read = staged(read.withColumn("error", _why(F.col("_marks"))))
        self.refused = read.where("error is not null").select("target", "error")
        fit = read.where("error is null")
        path = F.regexp_replace("x.m.origin_span.path", r"\\", "/")
        each = fit.select("target", F.posexplode(F.arrays_zip(F.col("_m").alias("m"), F.slice(F.split("_marks", ""), 1, F.size("_m")).alias("mark"))).alias("place", "x"))
        named = [path.alias("file"), F.col("x.m.origin_span.begin").alias("begin"), F.col("x.m.origin_span.end").alias("end"), F.col("x.m.operator").alias("operator"), F.col("x.m.display_name").alias("what")]
        placed = each.select("target", "place", *named, mark_code(F.col("x.mark")).alias("code"))
        self.judged = placed.drop("place")
        rows_of = fit.select("target", F.explode(F.arrays_zip(F.col("_tests").alias("test"), F.col("_rows").alias("row"))).alias("r")).where("r.row is not null")
        marks = rows_of.select("target", "r.test", F.posexplode(F.split("r.row", "")).alias("place", "mark")).where(F.col("mark").isin(*DETECTS))
        self.seen = marks.join(placed.drop("code"), ["target", "place"]).select("target", "test", "mark", *IDENTITY)

    def kills(self) -> DataFrame:
        """Each mutation once, with the strongest code that any target gave it and the tests that killed it, in order."""
        by = self.seen.where(F.col("mark").isin(*KILLS)).groupBy(*IDENTITY).agg(F.array_sort(F.collect_set("test")).alias("killed_by"))
        strongest = self.judged.groupBy(*IDENTITY).agg(F.max("code").alias("code"))
        same = F.lit(True)
        for c in IDENTITY:
            same &= strongest[c].eqNullSafe(by[c])
        return strongest.join(by, same, "left").select(*[strongest[c] for c in IDENTITY], "code", F.coalesce("killed_by", F.array().cast("array<string>")).alias("killed_by"))

    def idle(self) -> DataFrame:
        """target, test: tests that detect something, all of which another test detects too."""
        rows = self.seen.select(F.struct("target", "test").alias("who"), F.struct(*IDENTITY).alias("mutation"))
        return idle(rows, "who", "mutation").select("who.target", "who.test")
