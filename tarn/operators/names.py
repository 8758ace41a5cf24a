"""Names that contain a pattern, by an inverted index of letter groups.

Every distinct name has its groups of one to three characters. A pattern is cut at its wildcards;
the groups of its pieces must all be in a name that it matches, so the names that have the
pattern's rarest groups are looked up by equality and only these are compared with the pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.scalars import name_like

GROUP = 3
#: So many of a pattern's rarest groups are looked up.
LOOKED_UP = 3


def _groups(text: Column, size: int) -> Column:
    """All runs of ``size`` characters of a text."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
    found = F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))
    return F.when(F.length(text) >= size, found).otherwise(F.array().cast("array<string>"))


def groups_of_names(names: DataFrame) -> DataFrame:
    """(name, piece): the groups of every distinct name, and '' for all; null names have none."""
    distinct = names.select("name").where(F.col("name").isNotNull()).distinct()
    low = F.lower("name")
    pieces = F.concat(F.array(F.lit("")), *[_groups(low, n) for n in range(1, GROUP + 1)])
    return distinct.select("name", F.explode(F.array_distinct(pieces)).alias("piece"))


def groups_of_patterns(patterns: DataFrame, escape: bool = False) -> DataFrame:
    """(query_id, token, piece): what a name must have to match; '' where the pattern asks for nothing.

    % and _ are wildcards, and a backslash quotes them, unless ``escape``. A piece of three characters or more has its groups of
    three, a shorter one is a group itself.
    """
    cut = F.array(F.lower("token")) if escape else F.split(F.lower("token"), r"[%_\\]")
    part = F.explode(F.filter(cut, lambda p: p != "")).alias("part")
    parts = patterns.select("query_id", "token", part)
    groups = F.when(F.length("part") < GROUP, F.array("part")).otherwise(_groups(F.col("part"), GROUP))
    some = parts.select("query_id", "token", F.explode(groups).alias("piece")).distinct()
    none = patterns.where(F.size(F.filter(cut, lambda p: p != "")) == 0)
    return some.unionByName(none.select("query_id", "token", F.lit("").alias("piece")))


def matches(names: DataFrame, patterns: DataFrame, escape: bool = False) -> DataFrame:
    """(query_id, token, name) of the distinct names that contain a pattern, whatever the number of either.

    ``patterns`` has (query_id, token); repeated rows count once, null ones match nothing.
    """
    asked = patterns.select("query_id", "token").where(F.col("token").isNotNull()).distinct()
    have, want = groups_of_names(names), groups_of_patterns(asked, escape)
    spread = have.join(want.select("piece").distinct(), "piece", "left_semi").groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    # A window holds the groups of one pattern. A group that no name has leaves the pattern without names.
    rare = F.row_number().over(Window.partitionBy("query_id", "token").orderBy(F.coalesce("n", F.lit(0)), "piece"))
    want = want.join(spread, "piece", "left").withColumn("at", rare).where(F.col("at") <= LOOKED_UP)
    needed = F.count(F.lit(1)).over(Window.partitionBy("query_id", "token"))
    want = want.select("query_id", "token", "piece", needed.alias("needed"))
    found = have.join(want, "piece").groupBy("query_id", "token", "name").agg(F.count(F.lit(1)).alias("n"), F.first("needed").alias("needed"))
    found = found.where(F.col("n") == F.col("needed"))
    return found.where(name_like(F.col("name"), F.col("token"), escape)).select("query_id", "token", "name")
