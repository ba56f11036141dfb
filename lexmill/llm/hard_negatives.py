"""Hard negatives: rows of other labels whose score comes near to that of an anchor's positives.

Scores are integer inner products. Positives are an anchor's best rows of its own label; the negatives of a positive are the best rows of
other labels within a share of the positive's score. Both are exact searches over the distance-key index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.distance_index import Index, integers
from lexmill.session import Scratch


def _percent(score: str, percent: int) -> Column:
    """percent% of a score as an exact decimal."""
    return F.col(score).cast("decimal(20,0)") * F.lit(percent).cast("decimal(4,0)") * F.lit("0.01").cast("decimal(3,2)")


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row where ``anchors`` holds and each of its
    ``positives`` best rows of the same label, the ``negatives`` best rows of other labels with low% to high% of the positive's score.

    Ids and labels are integers. Components count as floor(256 * x). Rows with a null id, label or vector, or with a null or
    non-finite component, take no part; of rows that share an id, the one with the least label and vector does. Shorter vectors count
    as filled with zeros. Ties go to the smaller id. A positive whose score is negative has no negatives; an anchor without
    positives, or a positive without negatives, gives no row. Other columns are not read.
    """
    v = integers(F.col(vector_col))
    valid = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), v.alias("v"), F.coalesce(anchors, F.lit(False)).alias("anchor")).dropna()
    once = valid.groupBy("id").agg(F.min(F.struct("label", "v", "anchor")).alias("r")).select("id", "r.*")
    once = Scratch(rows.sparkSession).write(once, "vectors")
    index = Index(once)
    once = once.where("anchor")
    none = F.lit(None).cast("long")
    asked = once.select("id", F.lit(0).alias("slot"), "label", "v", none.alias("low"), none.alias("high"))
    near = index.search(asked, positives, same=True).select("id", F.col("rank").alias("slot"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"))
    near = index.scratch.write(near, "positives")
    bounds = {"low": F.ceil(_percent("positive_score", low)).cast("long"), "high": F.floor(_percent("positive_score", high)).cast("long")}
    asked = near.join(once.select("id", "label", "v"), "id").withColumns(bounds).select("id", "slot", "label", "v", "low", "high")
    far = index.search(asked, negatives, same=False)
    return far.join(near, ["id", "slot"]).select(
        F.col("id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
