"""Bounded samples of labelled rows, dealt by a hash of doc_id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def remainder(n: int) -> F.Column:
    """crc32 of doc_id as text, modulo n; null where doc_id is null."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def per_label(rows: DataFrame, label: str, most: int, labels: int, total: int) -> DataFrame:
    """About `most` doc_ids of each label at most, those of the lowest hashes, and `total` in all; whole below that.

    `rows` holds doc_id and the label only; a doc_id with several labels counts once for each. Counts come from all rows;
    of more than `labels` labels the most frequent are taken. A last limit, of twice the expected number, makes the
    bound strict. The rows are written to the shared folder: no task sends its candidates to the driver.
    """
    counts = {r[label]: r["n"] for r in cut(rows.groupBy(label).agg(F.approx_count_distinct("doc_id").alias("n")).orderBy(F.desc("n"), label).limit(labels), "labels").collect()}
    if not counts:
        return rows.limit(0)
    most, full = max(1, min(most, total // len(counts))), 1 << 32
    shares = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(full, full * most // max(1, n)))])
    h = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(full))
    chosen = rows.withColumn("h", h).where(F.col("h") < shares[F.col(label)]).distinct()
    return cut(chosen.orderBy("h", "doc_id", label).limit(2 * most * len(counts)).drop("h"), "sample")


def sample_texts(docs: DataFrame, chosen: DataFrame, on: list[str]) -> DataFrame:
    """The columns `on`, text and what `chosen` adds: one text for each row of `chosen`, the smallest where a doc_id has several.

    `chosen` is broadcast; `per_label` bounds it.
    """
    found = docs.select(*on, "text").join(F.broadcast(chosen), on)
    return found.groupBy(*chosen.columns).agg(F.min("text").alias("text"))
