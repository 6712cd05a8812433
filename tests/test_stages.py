"""A whole run: from source rows to published nodes, what is left out the second time, and plug-ins."""

import pytest
from pyspark.sql import functions as F

from trustweave.operators import graph, quality
from trustweave.operators.resolution import Scored
from trustweave.plans.binding import SPEC
from trustweave.plans.compiler import compile_spec
from trustweave.plans.queries_data import part_build

SF = "/root/testdata/sf0.001"


def test_a_second_run_skips_all(spark, tmp_path):
    work = compile_spec(SPEC, "class:Part")
    first = part_build(spark, SF, str(tmp_path)).run("run1", work)
    assert first.status == "succeeded" and not first.skipped and len(first.done) == len(work.stages)
    again = part_build(spark, SF, str(tmp_path))
    second = again.run("run2", work)
    assert second.status == "succeeded" and not second.done and len(second.skipped) == len(work.stages)
    assert again.lake.read_json("control/runs/run2")["skipped"] == second.skipped
    moved = again.run("run3", compile_spec(SPEC, "class:Part", cursors={"A": "2024-01-01"}))
    assert "normalize:Part:A" in moved.done and "normalize:Part:N" in moved.skipped and "publish:Part" in moved.done
    assert again.lake.read("bindings/Part").where("valid_to IS NOT NULL").count() == 0


def test_plug_ins_and_the_gate(spark, tmp_path):
    build = part_build(spark, SF, str(tmp_path))
    seen = {}

    def resolver(context, facts):
        seen["resolve"] = context
        rows = facts.select("row_id", "source", "src_key").distinct()
        pairs = rows.alias("a").join(rows.alias("b"), F.expr("a.src_key = b.src_key AND a.row_id < b.row_id"))
        return Scored(pairs.select(F.col("a.row_id").alias("x"), F.col("b.row_id").alias("y"), F.lit(1.0).alias("s")), "x", "y", "s")

    def check(context, resolved):
        seen["validate"] = context
        return quality.offenders(resolved.orderBy("canonical_id").limit(1), "mine", "Part", None, "canonical_id", F.lit("as told"))

    build.plugins = {("resolve", "Part"): resolver, ("validate", "Part"): check}
    build.config = {"resolve:Part": {"threshold": 0.5}}
    with pytest.raises(quality.BlockedPublish):
        build.run("run1", compile_spec(SPEC, "class:Part"))
    assert build.lake.read_json("control/runs/run1")["status"] == "failed" and not build.lake.exists("nodes/Part")
    assert seen["resolve"].config == {"threshold": 0.5} and seen["validate"].cls == "Part" and seen["resolve"].run_id == "run1"
    published = []
    build.severity, build.plugins[("publish", "Part")] = "warning", lambda context, df, target: published.append((target, df.count()))
    assert build.run("run2", compile_spec(SPEC, "class:Part")).done == ["publish:Part"]
    plain = part_build(spark, SF, str(tmp_path / "plain"))
    plain.run("run1", compile_spec(SPEC, "class:Part"))
    assert published == [("nodes/Part", plain.lake.read("nodes/Part").count())]


def test_the_latest_row_of_a_key_is_the_node(spark):
    new = spark.createDataFrame([(1, "a", 3), (1, "b", 5), (1, "c", 5), (2, "x", None), (None, "n", 1)], "canonical_id long, v string, t int")
    old = spark.createDataFrame([(1, "old", 0), (3, "kept", 0)], "canonical_id long, v string, t int")
    got = {r["canonical_id"]: r["v"] for r in graph.upsert_nodes(old, new, latest="t").collect()}
    assert got == {1: "c", 2: "x", 3: "kept", None: "n"}
