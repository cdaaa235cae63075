"""Round-robin over several sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import RANGE, ranked


def round_robin(sources: list[DataFrame], span: int = RANGE) -> DataFrame:
    """The rows of the sources (each with an ordinal) with source_idx, rn and position: one row of each live source a cycle.

    A source that has run out leaves the cycle. The place of row rn of a source follows from the sources' sizes alone:
    all earlier cycles and the live sources before it in this one. So nothing is sorted as a whole.
    """
    tagged = reduce(DataFrame.unionByName, [s.withColumn("source_idx", F.lit(i)) for i, s in enumerate(sources)])
    rows = ranked(tagged, "ordinal", "rn", ("source_idx",), span)
    sizes = {r["source_idx"]: r["n"] for r in tagged.groupBy("source_idx").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each source
    n = F.array(*[F.lit(sizes.get(i, 0)).cast("long") for i in range(len(sources))])
    before = F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + F.least(x, F.col("rn")))
    ahead = F.size(F.filter(n, lambda x, i: (i < F.col("source_idx")) & (x > F.col("rn")))).cast("long")
    return rows.withColumn("position", before + ahead)
