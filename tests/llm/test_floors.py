import math

import numpy as np

from tallyspan.llm import quality


def test_an_outlier_in_any_one_statistic_is_far(spark):
    r = np.random.default_rng(8)
    clean = np.abs(r.normal([4.5, 0.0, 0.0, 0.0], [0.1, 0.01, 0.01, 0.01], (150, 4)))
    odd = [[9.0, 0, 0, 0], [4.5, math.sqrt(0.15), 0, 0], [4.5, 0, 1.0, 0], [4.5, 0, 0, math.sqrt(0.35)]]
    df = spark.createDataFrame([("g", *map(float, v)) for v in [*clean, *odd]], "key string, x0 double, x1 double, x2 double, x3 double")
    far = [x[0] for x in df.join(quality.estimate(df), "key").select(quality._distance().alias("d")).orderBy("d").collect()]
    limit = math.sqrt(quality.chi2_quantile(quality.ALPHA, 2))
    assert far[-5] < limit < far[-4]
