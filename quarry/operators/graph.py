"""Bounded traversal of the dependency graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_DEPTH = 10


def checked(depth: int) -> int:
    if not 1 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must lie in 1..{MAX_DEPTH}")
    return depth


def walk(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, depth) for every depth at which a node is reached, cycles included; ``edges`` is (src, dst), ``seeds`` (node).

    Paths are not enumerated: each level is made distinct before it is joined again, which gives the same rows.
    """
    return _levels(edges, seeds, checked(depth), distinct=True)


def _levels(edges: DataFrame, seeds: DataFrame, depth: int, distinct: bool) -> DataFrame:
    """A level is an exchange that the levels after it and the result share; each third level is kept, so the plans after it stay short."""
    level, out = seeds.select("node").distinct() if distinct else seeds.select("node"), None
    for d in range(1, depth + 1):
        level = level.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"))
        if distinct:
            level = level.distinct()
        if d % 3 == 0 and d < depth:
            level = level.persist()
        rows = level.withColumn("depth", F.lit(d))
        out = rows if out is None else out.unionByName(rows)
    return out


def reach(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, depth): each node once at its least depth, the seeds left out."""
    return walk(edges, seeds, depth).groupBy("node").agg(F.min("depth").alias("depth")).join(seeds.select("node").distinct(), "node", "left_anti")


def paths(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, depth) once for each path; parallel rows count."""
    return _levels(edges, seeds, checked(depth), distinct=False)


def tree(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(root, node, depth) once for each path from each root; ``roots`` is (root, node)."""
    level, out = roots.select("root", "node"), None
    for d in range(1, checked(depth) + 1):
        level = level.join(edges, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node"))
        rows = level.withColumn("depth", F.lit(d))
        out = rows if out is None else out.unionByName(rows)
    return out


def reach_from(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, node, depth): for many seeds at once, each node at its least depth from each seed, the seed itself left out."""
    level, out = seeds.select(F.col("node").alias("seed"), "node").distinct(), None
    for d in range(1, checked(depth) + 1):
        level = level.join(edges, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
        rows = level.withColumn("depth", F.lit(d))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("seed", "node").agg(F.min("depth").alias("depth")).filter("seed != node")


def typed(relations: DataFrame, kinds: tuple[str, ...], up: bool, direct: bool = False) -> DataFrame:
    """Edges of the given kinds, from target to source (``up``) or from source to target; only direct ones where asked."""
    a, b = ("target_id", "source_id") if up else ("source_id", "target_id")
    edges = relations.filter(F.col("relation_type").isin(*kinds))
    return (edges.filter("is_direct") if direct else edges).select(F.col(a).alias("src"), F.col(b).alias("dst")).distinct()


def calls(relations: DataFrame, up: bool) -> DataFrame:
    """Call edges from callee to caller (``up``) or from caller to callee."""
    a, b = ("target_id", "source_id") if up else ("source_id", "target_id")
    return relations.filter("relation_type = 'calls'").select(F.col(a).alias("src"), F.col(b).alias("dst"))


def module_edges(files: DataFrame, file_relations: DataFrame) -> DataFrame:
    """Distinct (module, depends_on) over file relations, without a module itself."""
    a = files.select(F.col("id").alias("source_file_id"), F.col("module"))
    b = files.select(F.col("id").alias("target_file_id"), F.col("module").alias("depends_on"))
    return file_relations.join(a, "source_file_id").join(b, "target_file_id").filter("module != depends_on").select("module", "depends_on").distinct()
