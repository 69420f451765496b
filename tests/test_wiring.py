from tallyspan.operators import ratchet as R


def test_measures_that_are_off_and_would_pass(spark, rows):
    judged = spark.createDataFrame([("on", 0, 0), ("off", 0, 0), ("trips", 1, 4), ("stopped", 2, 0), ("choice", 0, 0), ("unsaid", 0, 0)], "measure string, verdict int, findings bigint")
    policies = spark.createDataFrame([("on", True, False), ("off", False, False), ("trips", False, False), ("stopped", False, False), ("choice", False, True), ("unsaid", None, None), ("unjudged", False, False)], "measure string, enabled boolean, optional boolean")
    assert rows(R.passing_and_off(judged, policies)) == [("off",), ("unsaid",)]


def test_a_survey_compares_nothing(spark, rows):
    now = spark.createDataFrame([("a", "x", 3), ("a", "y", 5), ("other", "x", 1)], "measure string, key string, value bigint")
    policies = spark.createDataFrame([("a", "line(s)"), ("b", "site(s)")], "measure string, unit string")
    assert rows(R.survey(now, policies)) == [("a", "line(s)", 2, 8, 5), ("b", "site(s)", 0, 0, 0)]
