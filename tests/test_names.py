"""Pattern search over names against comparing every name with every pattern."""

import random

from pyspark.sql import functions as F

from tarn.functions.scalars import name_like
from tarn.operators import names


def test_against_all_comparisons(spark):
    rng = random.Random(2)
    have = ["".join(rng.choice("abAB_é%1") for _ in range(rng.randrange(1, 9))) for _ in range(400)] + ["", None, "parseResult", "ParseResult", "ab" * 40]
    table = spark.createDataFrame([(n, k) for k, n in enumerate(have)], "name string, token int").repartition(3)
    asked = ["".join(rng.choice("abAB_é%1") for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    asked += ["", "%", "_", "%%", "a", "É", "eres", "RESULT", "nothing", "se_es", "%ab%ab%", None, "a"]
    patterns = spark.createDataFrame(list(enumerate(asked)), "query_id int, token string")
    for escape in (False, True):
        distinct = table.select("name").where("name is not null").distinct()
        want = distinct.crossJoin(patterns).where(name_like(F.col("name"), F.col("token"), escape)).select("query_id", "token", "name")
        found = names.matches(table, patterns, escape)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert names.matches(table.limit(0), patterns).count() == 0 and names.matches(table, patterns.limit(0)).count() == 0
