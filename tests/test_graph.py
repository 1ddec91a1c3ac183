"""Dependency walks: long chains, cycles, several ways to a task, and many tasks."""

from pyspark.sql import functions as F

from alphaloom.functions.sqlfuncs import dependency_closure


def graph(spark, nodes, edges):
    return spark.createDataFrame([(n,) for n in nodes], "task_id long"), spark.createDataFrame(edges, "task_id long, depends_on long")


def walks(nodes, edges):
    """All paths from tasks without dependencies, by plain search."""
    after = {}
    for task, on in edges:
        after.setdefault(on, set()).add(task)
    depends = {t for t, _ in edges}
    out, stack = set(), [(n,) for n in nodes if n not in depends]
    while stack:
        path = stack.pop()
        out.add(path)
        stack += [(*path, t) for t in after.get(path[-1], ()) if t not in path]
    return out


def test_chain_of_a_thousand_tasks(spark):
    nodes = list(range(1000))
    found = dependency_closure(*graph(spark, nodes, [(k + 1, k) for k in range(999)]))
    rows = found.select("task_id", "root", "depth", F.size("path").alias("n")).collect()
    assert sorted((r.task_id, r.root, r.depth, r.n) for r in rows) == [(k, 0, k, k + 1) for k in nodes]


def test_cycles_and_several_ways(spark):
    nodes = list(range(12))
    edges = [(1, 0), (2, 0), (3, 1), (3, 2), (4, 3), (5, 4), (4, 5), (6, 5), (7, 7), (8, 7), (9, 10), (10, 9), (11, 6), (3, 6)]
    found = {tuple(r.path) for r in dependency_closure(*graph(spark, nodes, edges)).collect()}
    assert found == walks(nodes, edges)


def test_no_edges(spark):
    found = dependency_closure(*graph(spark, [3, 4], []))
    assert sorted(tuple(r.path) for r in found.collect()) == [(3,), (4,)]


def test_many_tasks(spark):
    nodes = spark.range(1_200_000).withColumnRenamed("id", "task_id")
    edges = nodes.where("task_id >= 100000").select("task_id", (F.col("task_id") - 100_000).alias("depends_on"))
    found = dependency_closure(nodes, edges).agg(F.count("*").alias("n"), F.max("depth").alias("d"), F.sum(F.when(F.col("root") != F.col("task_id") % 100_000, 1).otherwise(0)).alias("wrong")).first()
    assert (found.n, found.d, found.wrong) == (1_200_000, 11, 0)
