import random

from tallyspan.llm import quality


def test_small_groups_are_judged_by_their_own_language(docs):
    r = random.Random(6)
    say = lambda n, letters: " ".join("".join(r.choice("abcdefgh") for _ in range(letters)) for _ in range(n))
    df = docs([(i, say(80, 4)) for i in range(90)], "aa").unionByName(docs([(100 + i, say(80, 11)) for i in range(20)], "bb"))
    found = {x["doc_id"]: x["kept"] for x in quality.judge(df).collect()}
    assert [i for i, kept in found.items() if not kept] == []
