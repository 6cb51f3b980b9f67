"""What a change of a member reaches: callers, projects, covering tests.

``members``: file_id, node, key, path, project, line, col, is_test. ``edges``: callee (a key), caller (a key), file_id and node of the
calling member.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.common import saved
from tessera.operators import root_sets


def callers(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(callee, path, project, line, col, is_test): each calling member once, by its place whatever the case of its path."""
    m = members.select(F.col("file_id").alias("_f"), F.col("node").alias("_n"), "path", "project", "line", "col", "is_test")
    both = edges.join(m, (F.col("file_id") == F.col("_f")) & (F.col("node") == F.col("_n")))
    place = [F.lower("path").alias("_p"), "line", "col"]
    return both.groupBy("callee", *place).agg(F.min("path").alias("path"), F.min(F.lower("project")).alias("project"), F.max("is_test").alias("is_test")).drop("_p")


def first_callers(called: DataFrame, most: int = 50) -> DataFrame:
    """The first ``most`` callers of each key by path and line, with their ``place``."""
    place = F.row_number().over(Window.partitionBy("callee").orderBy("path", "line", "col"))
    return called.withColumn("place", place).where(F.col("place") <= most)


def covering(roots: DataFrame, edges: DataFrame, called: DataFrame, depth: int = 6) -> DataFrame:
    """(key, n_tests, bounded): test members that reach each root within ``depth`` calls; bounded if a key there has callers.

    ``roots``: key; any number of them, as a key holds the roots that it reaches as sets of bits (``root_sets``).
    """
    names = root_sets.numbered(roots)
    met = root_sets.reached(names, edges, depth)
    tests = called.where("is_test").select(F.col("callee").alias("key"), F.concat_ws("\n", F.lower("path"), "line").alias("owner")).distinct()
    hit = root_sets.counted(root_sets.gathered(met.where(F.col("depth") < depth), tests)).withColumnRenamed("n", "n_tests")
    ends = root_sets.members(met.where(F.col("depth") == depth).join(edges.select(F.col("callee").alias("key")).distinct(), "key", "left_semi"))
    out = names.join(hit.withColumnRenamed("root", "_h"), F.col("root") == F.col("_h"), "left")
    out = out.join(ends.select(F.col("root").alias("_e")), F.col("root") == F.col("_e"), "left")
    return out.select("key", F.coalesce("n_tests", F.lit(0)).cast("long").alias("n_tests"), F.col("_e").isNotNull().alias("bounded"))


def impact(of: DataFrame, members: DataFrame, edges: DataFrame, depth: int = 6) -> DataFrame:
    """(file_id, node, key, n_callers, n_projects, n_tests, bounded) for the members ``of``."""
    called = saved(callers(members, edges))
    direct = called.groupBy(F.col("callee").alias("_k")).agg(F.count("*").alias("n_callers"), F.count_distinct("project").alias("n_projects"))
    tests = covering(of.select("key"), edges, called, depth).withColumnRenamed("key", "_t")
    out = of.join(direct, F.col("key") == F.col("_k"), "left").join(tests, F.col("key") == F.col("_t"))
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    return out.select("file_id", "node", "key", zero("n_callers"), zero("n_projects"), "n_tests", "bounded")


def label() -> Column:
    """What is shown beside a member."""
    many = lambda n, one: F.concat(F.col(n).cast("string"), F.when(F.col(n) == 1, F.lit(f" {one}")).otherwise(F.lit(f" {one}s")))
    return F.concat(F.lit("~"), many("n_callers", "caller"), F.lit(" in "), many("n_projects", "project"), F.lit(" · ≥"), many("n_tests", "covering test"))
