"""Calls from SQL text."""

import pytest

from trackloom.functions import sql
from trackloom.operators.tools import TOOLS, EventGraph, tool_schemas
from trackloom.plans.graph import event_graph


def test_matching_over_partitions(spark):
    spark.udtf.register("best_matching", sql.BestMatching)
    rows = [("a", 1, 1, 0.9), ("a", 1, 2, 0.8), ("a", 2, 1, 0.8), ("b", 1, 1, 0.5), ("b", 2, 1, 0.7), ("b", 3, None, 0.7)]
    spark.createDataFrame(rows, "scene string, gt long, trk long, w double").createOrReplaceTempView("pairs_of_sql")
    got = spark.sql("SELECT * FROM best_matching(TABLE(SELECT scene, gt, trk, w FROM pairs_of_sql) PARTITION BY scene)").collect()
    assert {tuple(r) for r in got} == {("a", 1, 2, 0.8), ("a", 2, 1, 0.8), ("b", 2, 1, 0.7)}
    with pytest.raises(Exception, match="w is missing"):
        spark.sql("SELECT * FROM best_matching(TABLE(SELECT scene, gt, trk FROM pairs_of_sql) PARTITION BY scene)").collect()


def test_tools_from_sql(spark):
    graph = event_graph(spark, "/root/testdata/sf0.001")
    sql.register(spark, graph, "g_", max_distance_m=10.0)
    got = spark.sql("SELECT global_id, distance_m, match_type FROM g_find_nearby_entities(2)").collect()
    want = graph.find_nearby_entities(2, 10.0).select("global_id", "distance_m", "match_type").collect()
    assert got and sorted(got) == sorted(want)
    joined = spark.sql("SELECT t.id, c.confirmed_interaction_count AS n FROM VALUES (0L), (2L), (99999L) t(id), LATERAL g_count_nearby_entities(t.id) c").collect()
    assert {r.id for r in joined} == {0, 2}
    assert spark.sql("SELECT * FROM g_get_entity_timeline(2)").count() == graph.get_entity_timeline(2).count()
    assert spark.table("g_list_multi_camera_entities").count() == graph.list_multi_camera_entities().count()


def test_schemas(spark):
    schemas = {s["function"]["name"]: s["function"] for s in tool_schemas()}
    assert len(schemas) == 13 and all(s["description"] for s in schemas.values())
    near = schemas["find_nearby_entities"]["parameters"]
    assert near["required"] == ["global_id"] and near["properties"]["max_distance_m"] == {"type": "number", "default": 2.0}
    assert schemas["find_entities_in_camera"]["parameters"]["required"] == ["camera_id"]
    assert all(set(TOOLS[n]) == set(s["parameters"]["properties"]) for n, s in schemas.items())
    empty = EventGraph(spark.createDataFrame([], "ordinal long, camera string, global_id long, frame long, wx double, wy double"), spark.createDataFrame([], "global_id long, appearance_caption string, caption_agreement double"))
    for bad in ({"global_id": "7"}, {}, {"global_id": 7, "max_gap_sec": True}):
        with pytest.raises(ValueError):
            empty.call("find_nearby_entities", **bad)
