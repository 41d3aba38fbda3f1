"""Places of regular expressions in texts, in DataFrame functions alone.

Spark's functions give the matches and the gaps between them, not positions; a running sum
over (gap, match) lengths gives those. Rows of one text are counted by the text's own
matches, so nothing is gathered beyond one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def parts(text: Column, pattern: Column, size) -> Column:
    """array<struct<gap:int, match:string>>: each match with the size of the gap before it."""
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), size)
    both = F.arrays_zip(gaps.alias("gap"), matches.alias("match"))
    return F.filter(both, lambda x: x["match"].isNotNull())


def places(found: DataFrame, keys: list[str], kind: str, list_col: str, size) -> DataFrame:
    """keys, kind, start, end, match for each entry of an array made by ``parts``.

    Repeated rows of the same keys and kind count once.
    """
    rows = found.select(*keys, kind, F.posexplode(list_col).alias("_pos", "_part")).select(
        *keys, kind, "_pos", F.col("_part.gap").cast("long").alias("_gap"), F.col("_part.match").alias("match"))
    rows = rows.dropDuplicates([*keys, kind, "_pos"])
    own = size(F.col("match")).cast("long")
    upto = Window.partitionBy(*keys, kind).orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("_gap") + own).over(upto)
    return rows.withColumn("end", end).select(*keys, kind, (F.col("end") - own).alias("start"), "end", "match")
