"""Times the chosen ways against the plain ones: python alternatives.py [SF_DIR]

The skewed table gives a third of all rows to one school, as one year and one key may have.
"""

from __future__ import annotations

import json
import sys
import time

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bench import session
from catalogue.queries import fact_student
from catalogue.standin import PACK, students
from layerwright.literacy import FACT_RULES
from layerwright.operators import dedup_by_key, evaluate, find_repeats, first_per_key, with_group_mean
from layerwright.sources import stage
from layerwright.spec import Rule

ROUNDS = 3


def best(run) -> float:
    times = []
    for _ in range(ROUNDS + 1):
        began = time.perf_counter()
        run()
        times.append(time.perf_counter() - began)
    return round(min(times[1:]), 3)


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def window_mean(df: DataFrame) -> DataFrame:
    mean = F.avg("proficiencia").over(W.partitionBy("ano", "id_escola"))
    return df.withColumn("mean", F.round(mean, 2))


def largest_task_share(df: DataFrame) -> float:
    """Share of the rows in the fullest partition of the result."""
    by_task = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("mean").alias("n"))
    sizes = [r["n"] for r in by_task.collect()]
    return round(max(sizes) / sum(sizes), 3)


def main(sf_dir: str) -> None:
    spark = session("8")
    fact = stage(fact_student(spark, sf_dir).repartition(8), "fact").df
    rules = (*FACT_RULES["fct_avaliacao_aluno"], *(Rule("not_null", c) for c in fact.columns[1:10]))
    skewed = stage(
        fact.withColumns(
            {
                "id_escola": F.when(F.col("id_aluno") % 3 == 0, F.lit(1)).otherwise(F.col("id_escola")),
                "ano": F.when(F.col("id_aluno") % 3 == 0, F.lit(2024)).otherwise(F.col("ano")),
            }
        ).repartition(8),
        "skewed",
    ).df
    rows = students(spark, sf_dir)
    key = PACK["avaliacao_aluno"].key
    repeats = find_repeats(rows, key)
    found = {
        f"{len(rules)} rules, one aggregate": best(lambda: evaluate({"t": (fact, rules)})),
        f"{len(rules)} rules, one job each": best(lambda: [evaluate({"t": (fact, [r])}) for r in rules]),
        "school mean, aggregate and lookup": best(lambda: drain(with_group_mean(fact, ("ano", "id_escola"), "proficiencia", "mean"))),
        "school mean, window": best(lambda: drain(window_mean(fact))),
        "school mean skewed, aggregate and lookup": best(lambda: drain(with_group_mean(skewed, ("ano", "id_escola"), "proficiencia", "mean"))),
        "school mean skewed, window": best(lambda: drain(window_mean(skewed))),
        "dedup, count then first of repeated keys": best(lambda: drain(dedup_by_key(rows, key))),
        "dedup, repeated keys already counted": best(lambda: drain(dedup_by_key(rows, key, repeats))),
        "dedup, first of all keys": best(lambda: drain(first_per_key(rows, key))),
    }
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    found["fullest task skewed, window"] = largest_task_share(window_mean(skewed))
    spark.conf.set("spark.layerwright.maxBroadcastBytes", "0")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    cut = with_group_mean(skewed, ("ano", "id_escola"), "proficiencia", "mean")
    found["fullest task skewed, lookup by shuffle"] = largest_task_share(cut)
    print(json.dumps(found, indent=1))


if __name__ == "__main__":
    main(*(sys.argv[1:] or ["/root/testdata/sf0.1"]))
