import json

import pytest

from tallyspan.sources.results import Results


def _mutations(n, order=None):
    return json.dumps({"mutations": [{"id": i, "operator": "op", "display_name": f"m{i}", "origin_span": {"path": "src\\a.rs", "begin": [i, 1], "end": [i, 2]}} for i in order or range(1, n + 1)]})


def _evaluation(overall, rows=(), tests=(), runs=1):
    return json.dumps({"tests": [{"name": t} for t in tests], "mutation_runs": [{"mutation_detection_matrix": {"overall_detections": overall, "test_detections": list(rows)}}] * runs})


def _results(spark, rows):
    return Results(spark.createDataFrame(rows, "target string, m string, e string"), "target", "m", "e")


def test_targets_join_under_the_strongest_verdict(spark, rows):
    found = _results(spark, [("a", _mutations(3), _evaluation("D-T", ["D--", "C-T"], ["x", "y"])), ("b", _mutations(3), _evaluation("-C.", ["-C.", "---"], ["z", "w"])), ("none", _mutations(0), _evaluation(""))])
    assert rows(found.refused) == []
    assert sorted((r["what"], r["file"], r["code"], r["killed_by"]) for r in found.kills().collect()) == [("m1", "src/a.rs", 4, ["x", "y"]), ("m2", "src/a.rs", 3, ["z"]), ("m3", "src/a.rs", 2, [])]
    assert rows(found.idle()) == [("a", "x")]


@pytest.mark.parametrize(
    ("m", "e", "why"),
    [
        (_mutations(2), _evaluation("D"), "verdicts don't line up with mutations"),
        (_mutations(2, [2, 1]), _evaluation("DD"), "verdicts don't line up with mutations"),
        (_mutations(2), _evaluation("DX"), "unknown verdict"),
        (_mutations(2), _evaluation("DD", runs=2), "other than one evaluation"),
        (_mutations(2), _evaluation("DD", ["D"], ["x"]), "tests don't line up with their detections"),
        (_mutations(2), _evaluation("DD", ["DD"], ["x", "y"]), "tests don't line up with their detections"),
        ("{", _evaluation("DD"), "unreadable"),
        (None, None, "unreadable"),
    ],
)
def test_results_that_do_not_fit_are_refused(spark, rows, m, e, why):
    found = _results(spark, [("t", m, e), ("ok", _mutations(1), _evaluation("D"))])
    assert rows(found.refused) == [("t", why)]
    assert found.judged.select("target").distinct().collect()[0][0] == "ok"
