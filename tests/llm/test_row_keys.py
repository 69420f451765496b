import random

from tallyspan.llm import byte_repeats


def test_a_row_is_no_repeat_of_itself(docs):
    r = random.Random(3)
    text, other, twice = (" ".join(f"{k}{r.randrange(10**6)}" for _ in range(60)) for k in "abc")
    kept = lambda rows: sorted(x["kept"].decode() for x in byte_repeats.remove_repeats(docs(rows)).collect())
    assert kept([(5, text), (5, text)]) == [text, text]
    assert kept([(None, text), (None, other)]) == sorted([text, other])
    got = kept([(None, text + other), (None, twice + "|" + twice), (7, text + "|")])
    assert got == sorted([text + other, twice + "|", "|"])
