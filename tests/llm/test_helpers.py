"""What staged tables leave on disk."""

import os
import time

from pyspark.sql import functions as F

from cohortlib.llm import helpers, paragraphs


def shuffles(spark):
    local = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for top in local for _, _, files in os.walk(str(top)) for f in files if f.startswith("shuffle_")}


def test_files_of_exchanges_go_with_the_write(spark):
    rows = spark.range(2000).withColumn("k", F.col("id") % 7).repartition(3, "k").groupBy("k").agg(F.collect_list("id").alias("ids"))
    before, former = shuffles(spark), spark.conf.get(helpers.CLEANUP, None)
    table = helpers.stage(rows.sort("k"), "sorted")
    for _ in range(50):                                    # they are deleted beside the next work
        if shuffles(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffles(spark) <= before
    assert spark.conf.get(helpers.CLEANUP, None) == former
    assert sum(len(r.ids) for r in table.collect()) == 2000
    assert sum(len(r.ids) for r in rows.collect()) == 2000  # the frame itself can be read again


def test_tables_of_removals_go_when_these_are_written(docs):
    passage = " ".join(f"q{j}," if j % 10 == 9 else f"q{j}" for j in range(40))
    frame = docs([(i, f"w{i} {passage}") for i in range(4)])
    mark = helpers.n_written()
    out = paragraphs.dedup(frame)
    left = [p for p in helpers.written_since(mark) if os.path.exists(p.removeprefix("file:"))]
    assert [os.path.basename(p) for p in left] == ["removals"]
    assert out.where("n_removed > 0").count() == 3
