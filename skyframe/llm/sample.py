"""Bounded samples of labelled documents, on which the classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, *, rows: int, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, label) of at most about ``rows`` labelled documents for which ``train`` holds.

    Every label has an equal share, filled by hash of the id.  The ids alone are picked first, so the documents themselves are only
    filtered: the picked ids are at most ``rows`` (plus the spread of a hash), which bounds the broadcast.  Rows with a null id or
    label are left out; of labels that contradict each other for one id the least counts.
    """
    known = labels.where(train & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("label"))
    counts = known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).limit(1001).collect()
    if len(counts) > 1000:
        raise ValueError(f"{label_col} has over 1000 values; it is no label")
    if not counts:
        return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(None).cast("long").alias("label")).limit(0)
    share = rows / len(counts)
    left, spare = len(counts), rows
    for c in sorted(counts, key=lambda r: r["n"]):  # what small labels leave over goes to the large ones
        share = spare / left
        spare -= min(share, c["n"])
        left -= 1
    cut = F.least(F.lit(1.0), F.lit(float(share)) / F.col("n"))
    sizes = known.sparkSession.createDataFrame([(r["label"], r["n"]) for r in counts], f"label {known.schema['label'].dataType.simpleString()}, n long")
    picked = known.join(F.broadcast(sizes), "label").where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < cut * (1 << 30)).select("_id", "label")
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return checkpoint(text.join(F.broadcast(picked), F.col("id") == F.col("_id")).select("id", "text", F.col("label").cast("long").alias("label")))
