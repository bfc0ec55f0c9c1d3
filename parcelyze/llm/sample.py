"""Bounded, repeatable samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written


def remainder(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % n


def labelled_sample(docs: DataFrame, labelled: DataFrame, per_label: int, name: str) -> DataFrame:
    """(doc_id, label, text): at most ``per_label`` documents of each label, whatever the table's size.

    docs: (doc_id, text), or (doc_id, label, text) if a label belongs to a text; labelled: (doc_id, label). Ids fall to
    ``per_label`` hash cells of each label, and the least hash of a cell is taken: one aggregate with a bounded result,
    evenly spread, and alike on each run. Of an id's several texts the one with the least hash is taken.
    """
    cell = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(per_label))
    ids = labelled.where("doc_id is not null and label is not null").groupBy("label", cell.alias("cell")).agg(F.min_by("doc_id", F.xxhash64("doc_id", F.lit(12))).alias("doc_id")).select("doc_id", "label")
    keys = ["doc_id", "label"] if "label" in docs.columns else ["doc_id"]
    some = docs.where("text is not null").join(F.broadcast(ids), keys)  # ids: labels x per_label rows at most
    return written(some.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")), name)
