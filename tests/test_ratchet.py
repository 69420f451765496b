import pytest

from tallyspan.operators import ratchet as R

SERIES = "measure string, key string, value bigint"
POLICY = "measure string, policy string, basis_points bigint, floor bigint, unit string"


@pytest.fixture
def make(spark):
    series = lambda rows: spark.createDataFrame([("m", *r) for r in rows], SERIES)
    policy = lambda kind, bp=0, floor=0: spark.createDataFrame([("m", kind, bp, floor, "u")], POLICY)
    return series, policy


@pytest.mark.parametrize(("now", "want"), [(6, [("m", "a#f", "grew", 5, 6)]), (5, []), (4, [])])
def test_grew_held_shrank(make, rows, now, want):
    series, policy = make
    assert rows(R.regressions(series([("a#f", now)]), series([("a#f", 5)]), policy("items"))) == want


@pytest.mark.parametrize("kind", ["measures", "census", "items", "sizes"])
def test_an_unknown_key_above_zero_is_new_under_every_policy(make, rows, kind):
    series, policy = make
    assert rows(R.regressions(series([("a", 1), ("b", 1)]), series([("b", 1)]), policy(kind))) == [("m", "a", "new", None, 1)]
    assert rows(R.regressions(series([("a", 0), ("b", 1)]), series([("b", 1)]), policy(kind))) == []


@pytest.mark.parametrize(("now", "want"), [(10_100, 0), (10_101, 1)])
def test_a_size_may_grow_by_its_tolerance(make, now, want):
    series, policy = make
    assert R.regressions(series([("a", now)]), series([("a", 10_000)]), policy("sizes", 100, 50)).count() == want


def test_a_tolerance_saturates(make):
    series, policy = make
    top = R.LARGEST
    assert R.regressions(series([("a", top)]), series([("a", top - 1)]), policy("sizes", 10_000, 0)).count() == 0


def test_a_moved_item_is_held_to_its_old_number(make, rows):
    series, policy = make
    was = series([("old#f", 5), ("x", 1)])
    assert rows(R.regressions(series([("new#f", 5), ("x", 1)]), was, policy("items"))) == []
    assert rows(R.regressions(series([("new#f", 6), ("x", 1)]), was, policy("items"))) == [("m", "new#f", "grew", 5, 6)]
    two = series([("new#f", 5), ("also#f", 5), ("x", 1)])
    assert [r[2] for r in rows(R.regressions(two, was, policy("items")))] == ["new", "new"]


def test_a_census_row_that_is_gone_trips_and_an_item_does_not(make, rows):
    series, policy = make
    was, now = series([("a", 1), ("b", 2)]), series([("a", 1)])
    assert rows(R.stopped_measuring(now, was, policy("census"))) == [("m", "b", 2, None)]
    assert rows(R.verdicts(now, was, policy("census"))) == [("m", 1, 1)]
    assert rows(R.verdicts(now, was, policy("items"))) == [("m", 0, 0)]


def test_what_cannot_be_compared_cannot_run(make, rows, spark):
    series, policy = make
    none = series([]).limit(0)
    assert rows(R.guards(series([("a", 1)]), series([("b", 1)]), policy("items"))) == [("m", "no key in common")]
    assert rows(R.guards(series([("a", 1)]), series([("b", 0)]), policy("items"))) == []
    assert rows(R.guards(none, series([("b", 1)]), policy("census"))) == [("m", "nothing measured")]
    assert rows(R.guards(none, series([("b", 1)]), policy("items"))) == []
    assert rows(R.guards(series([("a", 1)]), none, policy("items"))) == []
    other = spark.createDataFrame([("m", "a", 1, "v")], SERIES + ", unit string")
    assert rows(R.guards(series([("a", 1)]), other, policy("items"))) == [("m", "other unit")]
    assert rows(R.verdicts(series([("a", 9)]), other, policy("items"))) == [("m", 2, 1)]


def test_unread_input_outranks_a_trip_and_hides_no_finding(make, rows, spark):
    series, policy = make
    unread = spark.createDataFrame([("m",)], "measure string")
    assert rows(R.verdicts(series([("a", 2)]), series([("a", 1)]), policy("items"), unread=unread)) == [("m", 2, 1)]
    assert rows(R.verdicts(series([("a", 1)]), series([("a", 1)]), policy("items"), faults=unread)) == [("m", 1, 1)]


def test_records_go_the_way_they_are_asked(make, rows):
    series, policy = make
    now, was = series([("a", 3), ("b", 9), ("new#f", 2)]), series([("a", 5), ("b", 7), ("old#f", 4)])
    assert rows(R.tightened(now, was, policy("items"))) == [("m", "a", 3), ("m", "b", 7), ("m", "new#f", 2)]
    assert rows(R.raised(now, was)) == [("m", "a", 5), ("m", "b", 9), ("m", "new#f", 2)]
    assert rows(R.lowered(now, was)) == [("m", "a", 3), ("m", "b", 7)]


def test_named_keys_are_written_only_if_none_would_rise(make, rows):
    series, _ = make
    now, was = series([("a", 3), ("b", 9)]), series([("a", 5), ("b", 7), ("c", 1)])
    assert rows(R.write_keys(now, was, series([("a", 0)]))) == [("m", "a", 3, False), ("m", "b", 7, False), ("m", "c", 1, False)]
    assert rows(R.write_keys(now, was, series([("a", 0), ("b", 0)]))) == [("m", "a", 5, True), ("m", "b", 7, True), ("m", "c", 1, True)]


def test_a_renamed_file_keeps_its_keys_unless_one_is_held(make, rows):
    series, _ = make
    was = series([("x", 1), ("x#f", 2), ("xy", 3)])
    assert set(rows(R.moved_file(was, "x", "z"))) == {("m", "xy", 3, False), ("m", "z", 1, False), ("m", "z#f", 2, False)}
    assert all(r[3] for r in rows(R.moved_file(was, "x", "xy")))


def test_touched_files_must_be_clean(make, rows, spark):
    series, policy = make
    changed = spark.createDataFrame([("a",)], "path string")
    now, was = series([("a#f", 2), ("b#f", 2), ("a#g", 0)]), series([("a#f", 2), ("b#f", 2), ("a#g", 1)])
    assert rows(R.clean_when_touched(now, was, policy("items"), changed)) == [("m", "a#f", 2, 2)]


def test_the_first_record_passes_here_and_not_in_ci(make, rows):
    series, _ = make
    none = series([]).limit(0)
    assert rows(R.first_record(series([("a", 1)]), none, False)) == [("m", 0, True)]
    assert rows(R.first_record(series([("a", 1)]), none, True)) == [("m", 2, False)]


def test_debt_is_listed_largest_first(make, rows):
    series, _ = make
    found = rows(R.debt(series([(f"k{i}", i) for i in range(8)]), 5))
    assert [(r[1], r[3]) for r in sorted(found, key=lambda r: r[3])] == [("k7", 1), ("k6", 2), ("k5", 3), ("k4", 4), ("k3", 5)]
    assert {(r[4], r[5]) for r in found} == {(28, 2)}
