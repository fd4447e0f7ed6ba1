from pyspark.sql import functions as F

from corvine.engine import Engine, Question


def test_engine(spark):
    docs = spark.createDataFrame([(1, "Red apples grow on trees."), (2, "Green pears grow too."), (3, "Nothing here.")], "doc_id bigint, text string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.7, 0.7])], "doc_id bigint, embedding array<double>")
    engine = Engine(docs, vectors, embed=lambda text: [1.0, 0.1])
    found = engine.search(Question("red apples", top_k=2)).collect()
    assert found[0].doc_id == 1 and found[0].lanes == 2 and len(found) == 2
    assert engine.search("nothing").collect()[0].doc_id in (1, 3)
    assert Engine(docs).search("...").count() == 0
    state = engine.verify(Question("q", literals=("apples", "kiwis")), docs).first()
    assert (state.literals, state.supported, state.state) == (2, 1, "insufficient_evidence")
    assert Question("x", top_k=50).candidates() == 96 and Question("x", mode="local").candidates() == 10


def test_engine_graph(spark):
    edges = spark.createDataFrame([("a", "b", "r"), ("b", "c", "r"), ("c", "d", "r")], "from_node_id string, to_node_id string, relation_type string")
    nodes = spark.createDataFrame([("a", "Alpha", "entity", 3), ("b", "Beta", "entity", 5)], "node_id string, label string, node_type string, support_count int")
    engine = Engine(spark.range(0).select(F.col("id").alias("doc_id"), F.lit("").alias("text")), nodes=nodes, edges=edges)
    assert {(r.node_id, r.depth) for r in engine.neighbourhood(["a"], 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert abs(sum(r.score for r in engine.related(["a"]).collect()) - 1) < 1e-9
    assert [r.node_id for r in engine.entities("be").collect()] == ["b"]


def test_engine_lists_finds_and_travels(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}", f"Guide {i % 3}", f"g-{i}.md") for i in range(7)], "doc_id bigint, text string, title string, key string")
    nodes = spark.createDataFrame([("a", "Alpha Store", "system", 3), ("b", "Beta Store", "system", 5), ("c", "Gamma", "person", 1)], "node_id string, label string, node_type string, support_count int")
    edges = spark.createDataFrame([("a", "b", "writes_to"), ("c", "a", "owns")], "from_node_id string, to_node_id string, relation_type string")
    Engine(docs, nodes=nodes, edges=edges).export(f"file://{tmp_path}/snapshot")
    engine = Engine.load(spark, f"file://{tmp_path}/snapshot")
    assert [r.doc_id for r in engine.page(size=3).collect()] == [6, 5, 4, 3] and [r.doc_id for r in engine.page(2, 3).collect()] == [1, 0]
    assert [r.doc_id for r in engine.titles("guide 1", 2).orderBy("rank").collect()] == [4, 1] and engine.vectors is None
    assert {r.node_id for r in engine.find_entities("store system").collect()} == {"a", "b"} and engine.find_entities("nothing").count() == 0
    assert [r.edge_key for r in engine.find_relations("gamma owns").collect()] == ["c--owns--a"] and [r.edge_key for r in engine.find_relations("alpha writes").collect()] == ["a--writes_to--b"]


def test_snapshots_are_restored(spark, tmp_path):
    import pytest

    from corvine.sources import snapshot

    one, two = (spark.createDataFrame([(i, x) for i in range(3)], "i int, x string") for x in "ab")
    snapshot.export({"t": one}, f"file://{tmp_path}/one")
    snapshot.export({"t": two, "u": two}, f"file://{tmp_path}/two")
    target = f"file://{tmp_path}/target"
    snapshot.restore(spark, f"file://{tmp_path}/one", target)
    with pytest.raises(ValueError, match="there already: t"):
        snapshot.restore(spark, f"file://{tmp_path}/two", target)
    assert {r.x for r in snapshot.current(spark, f"{target}/t").collect()} == {"a"}
    assert snapshot.restore(spark, f"file://{tmp_path}/two", target, overwrite="replace").keys() == {"t", "u"}
    assert {r.x for r in snapshot.current(spark, f"{target}/t").collect()} == {"b"} and snapshot.current(spark, f"{target}/u").count() == 3
    with pytest.raises(ValueError, match="unknown mode"):
        snapshot.restore(spark, f"file://{tmp_path}/two", target, overwrite="merge")


def test_engine_verifies_answers(spark):
    engine = Engine(spark.range(0).select(F.col("id").alias("doc_id"), F.lit("").alias("text")))
    evidence = spark.createDataFrame([(1, "Set `port=8080` in version v1.2.0."), (2, "All of it holds.")], "doc_id int, text string")
    state = lambda answer, *literals: engine.verify(Question("q", literals=literals), evidence, answer).first().state
    assert state("all of it holds.") == "verified" and state("It is v1.2.0") == "partially_supported" and state("It is v1.3.0") == "insufficient_evidence"
    assert state("Nothing to check") == "not_run" and state("Nothing to check", "holds") == "partially_supported" and state("Use `port=8080`", "absent") == "insufficient_evidence"


def test_entry_points_need_no_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
