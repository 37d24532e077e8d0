"""References to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymill.operators import bloom
from quaymill.session import attach, cut


def orphan_references(
    child: DataFrame,
    key: str,
    row_id: str,
    when: str,
    parent: DataFrame,
    parent_key: str,
    valid_from: str | None = None,
    valid_to: str | None = None,
) -> DataFrame:
    """Rows of ``child`` whose ``key`` has no valid counterpart: ``(period, row_id, kind)``.

    A broadcast Bloom filter of the parent's keys proves most orphans without a shuffle; only the
    references it lets pass are verified by an exact join. Keys are compared as stored.
    kind: 'missing' if no parent row has the key, else 'later' if ``when`` is before the parent's
    earliest ``valid_from``, else 'deleted' if ``when`` is on or after its ``valid_to``.
    Null keys are no reference. A null ``when`` gives a null period and can only be 'missing'.
    Repeated parent rows count once; repeated child rows each give a row. An empty parent makes
    every reference 'missing'. Other columns of either side are not read.
    """
    none = F.lit(None).cast("date")
    parents = cut(
        parent.select(F.col(parent_key).alias("__key"), *((F.col(c).cast("date") if c else none).alias(a) for c, a in ((valid_from, "__from"), (valid_to, "__to"))))
        .where(F.col("__key").isNotNull())
        .groupBy("__key")
        .agg(F.min("__from").alias("__from"), F.max("__to").alias("__to")),
        "parents",
    )
    n = parents.count()
    refs = child.select(F.col(key).alias("__key"), F.col(row_id).alias("row_id"), F.col(when).cast("date").alias("__when")).where(F.col("__key").isNotNull())
    tested = bloom.probe(refs, "__key", parents, "__key", bloom.words_for(n), "__maybe")
    # what the filter rules out asks for nothing, so that one pass over the references serves both
    asked = tested.withColumn("__asked", F.when(F.col("__maybe"), F.col("__key"))).drop("__key", "__maybe")
    known = attach(parents.select(F.col("__key").alias("__asked"), "__from", "__to", F.lit(True).alias("__found")), n)
    kind = F.when(F.col("__found").isNull(), "missing").when(F.col("__when") < F.col("__from"), "later").when(F.col("__when") >= F.col("__to"), "deleted")
    orphans = asked.join(known, "__asked", "left").withColumn("kind", kind).where("kind is not null")
    return orphans.select(F.date_format("__when", "yyyy-MM").alias("period"), "row_id", "kind")


def orphan_report(orphans: DataFrame, *by: str) -> DataFrame:
    """Orphans per ``by`` (table, period, kind)."""
    return orphans.groupBy(*by).agg(F.count("*").alias("references"))
