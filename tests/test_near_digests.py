import itertools
import random
from collections import Counter

from pyspark.sql import functions as F

from tallyspan import plans
from tallyspan.operators import similar as S

plans.load()


def test_texts_travel_as_digests(spark, rows, tmp_path, monkeypatch):
    """No words are written, and rows that repeat an id and its text count once."""
    r = random.Random(5)
    words = [f"w{r.randrange(10**6)}" for _ in range(300)]
    texts = [(1, " ".join(words)), (1, " ".join(words)), (2, " ".join(words[:290] + ["other"] * 10)), (3, " ".join(f"x{r.randrange(10**6)}" for _ in range(300))), (4, None)]
    spark.createDataFrame([(i, t, 0) for i, t in texts], "doc_id bigint, text string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    written, staged = [], S.staged
    monkeypatch.setattr(S, "staged", lambda df: written.append(df.drop("_d").dtypes) or staged(df))
    found = rows(plans.QUERIES["near_families"](spark, str(tmp_path)))
    assert found == [(1, 1, 3), (1, 1, 3), (2, 1, 3)]
    assert not [c for table in written for c in table if "string" in c[1]]


def test_large_buckets_are_compared_in_blocks(spark, rows):
    """Pairs of a family over several blocks, and links across components, are those of all pairs."""
    r = random.Random(6)
    sets = {i: {f"c{j}" for j in r.sample(range(40), 34)} for i in range(40)} | {100 + i: {f"d{j}" for j in range(3 * i, 3 * i + 30)} for i in range(9)}
    dice = {(a, b): 20000 * len(sets[a] & sets[b]) // (len(sets[a]) + len(sets[b])) for a, b in itertools.combinations(sets, 2)}
    want = sorted(((a, b, bp) for (a, b), bp in dice.items() if bp >= 8500), key=repr)
    table = spark.createDataFrame([(k, k // 100, k, sorted(v)) for k, v in sets.items()], "k bigint, g bigint, p bigint, ts array<string>").coalesce(1)
    packed = table.select("k", F.size("ts").cast("bigint").alias("n"), F.array_sort(F.transform("ts", lambda t: F.xxhash64(t))).alias("ts"))
    packed = packed.mapInPandas(lambda it: (d.assign(d=[x.tobytes() for x in d["ts"]]).drop(columns="ts") for d in it), "k bigint, n bigint, d binary")
    assert rows(S._compared(table.select("k", "g", "p"), packed, 8500, False, 7)) == want
    part = {k: k for k in sets}
    for a, b, _ in S._compared(table.select("k", "g", "p"), packed, 8500, True, 7).collect():
        assert dice[a, b] >= 8500
        part = {k: part[a] if v == part[b] else v for k, v in part.items()}
    whole = {k: k for k in sets}
    for a, b, _ in want:
        whole = {k: whole[a] if v == whole[b] else v for k, v in whole.items()}
    assert Counter(part.values()).most_common() and len({(part[k], whole[k]) for k in sets}) == len(set(part.values())) == len(set(whole.values()))
