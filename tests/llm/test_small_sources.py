import math

import numpy as np

from tallyspan.llm import mixing


def test_a_small_source_reaches_its_weight(spark, docs):
    df = docs([(i, "x" * 1000) for i in range(300)], source="big").unionByName(docs([(1000 + i, "x") for i in range(10)], source="small"))
    mixed = mixing.mix_sources(df, {"big": 1.0, "small": 1.0}).groupBy("source").count().collect()
    size = {r["source"]: r["count"] for r in mixed}
    assert abs(size["small"] / 150_005 - 1) < 0.01
    low, table = mixing.wide_table(5000.0)
    p = [math.exp(k * math.log(5000.0) - 5000.0 - math.lgamma(k + 1)) for k in range(low, low + len(table))]
    assert np.allclose(table, np.cumsum(p), atol=1e-9)
