"""What questions are about, and what is said when nothing is known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What is said when nothing supports an answer.
ABSTAIN = "No encontré conocimiento validado suficiente para responder esa pregunta."

def focal(relations: DataFrame) -> DataFrame:
    """(question_id, focal): the entity with most relations, the smallest id among equals."""
    ends = relations.select("question_id", F.explode(F.array("source", "target")).alias("id"))
    degree = ends.groupBy("question_id", "id").agg(F.count("*").alias("n"))
    return degree.groupBy("question_id").agg(F.min_by("id", F.struct(-F.col("n"), F.col("id"))).alias("focal"))
