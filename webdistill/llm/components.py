"""Connected components by smallest label, with pointer jumping; nothing is collected to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webdistill.llm import common


def components(links: DataFrame) -> DataFrame:
    """``id, component`` of every node of ``links`` (``u, v``): the smallest id that it reaches, itself included.

    Each round takes the smallest label of a node and its neighbours, then the label of that label, so a chain of
    length d needs about log d rounds. Labels are written between rounds. Nodes with very many links are one row a task
    in the aggregation, and their rows may be split in the joins.
    """
    spark = links.sparkSession
    edges = common.save(links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct(), "edges")
    label = edges.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("id"), F.least("u", "v").alias("component"))
    label = common.save(label, "labels")
    while True:
        near = edges.join(label.select(F.col("id").alias("v"), "component"), "v").groupBy("u").agg(F.min("component").alias("near"))
        new = label.join(near.withColumnRenamed("u", "id"), "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        of = label.select(F.col("id").alias("component"), F.col("component").alias("next"))
        new = new.join(of, "component").select("id", "old", F.least("component", "next").alias("component"))
        new = common.save(new, "labels")
        common.drop(spark, label)
        label = new.select("id", "component")
        if not new.where("component <> old").limit(1).count():
            common.drop(spark, edges)
            return label
