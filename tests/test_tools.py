"""The query tools on a small graph: unknown entities, missing columns, calls by name and reports."""

import pytest
from pyspark.sql import functions as F

from trackloom.functions import reports
from trackloom.operators.tools import SCHEMAS, EventGraph


@pytest.fixture(scope="module")
def graph(spark):
    # 1 and 2 walk side by side for 12 frames on camera 1; 3 stands far away; 2 comes back on camera 2
    det = [(i, "1", 1, i, float(i), 0.0) for i in range(12)] + [(100 + i, "1", 2, i, float(i), 1.0) for i in range(12)] + [(200 + i, "1", 3, i, 500.0, 0.0) for i in range(12)] + [(300 + i, "2", 2, 500 + i, 0.0, 0.0) for i in range(3)]
    ent = [(1, "a man in a coat", 0.9, [1.0, 0.0]), (2, "two women", 0.4, [0.8, 0.6]), (3, None, None, None)]
    return EventGraph(spark.createDataFrame(det, "ordinal long, camera string, global_id long, frame long, wx double, wy double"), spark.createDataFrame(ent, "global_id long, appearance_caption string, caption_agreement double, caption_vector array<double>"))


def test_searches(graph):
    assert [(r.global_id, r.similarity) for r in graph.search_by_appearance([2.0, 0.0]).collect()] == [(1, 1.0), (2, 0.8)]
    assert [r.global_id for r in graph.search_by_appearance([1.0, 0.0], 0.7, 1).collect()] == [1]
    assert graph.search_by_action([1.0, 0.0]).count() == 0


def test_actions(graph):
    assert graph.get_entity_action(9).first().error == "no entity with global_id=9"
    assert graph.get_entity_action(1).first().error == "no action_description on this entity"
    with_action = EventGraph(graph.detections, graph.entities.withColumn("action_description", F.lit("walks")))
    r = with_action.get_entity_action(1).first()
    assert (r.action_description, r.action_agreement, r.error) == ("walks", None, None)


def test_timeline_and_cooccurrence(graph):
    t = graph.get_entity_timeline(2).orderBy("place").collect()
    assert [(r.camera, r.start_time, r.start_time_sec, r.num_detections, r.appearance_caption) for r in t] == [("1", "0:00", 0.0, 12, "two women"), ("2", "0:17", 16.7, 3, "two women")]
    assert graph.get_entity_timeline(77).count() == 0
    assert [r.entity_b_window for r in graph.check_entities_cooccur(1, 2).collect()] == ["0:00-0:00"]
    assert graph.check_entities_cooccur(1, 77).count() == 0
    assert sorted(r.global_id for r in graph.find_entities_in_camera("0001", 0, 0.1).collect()) == [1, 2, 3]
    assert graph.find_entities_in_camera("2", None, 16).count() == 0


def test_nearness(graph):
    m = graph.find_nearby_entities(1).collect()
    assert [(r.global_id, r.match_type, r.distance_m, r.camera) for r in m] == [(2, "confirmed_proximity", 1.0, "1")]
    counts = {r.global_id: r.confirmed_interaction_count for r in graph.count_nearby_entities().collect()}
    assert counts == {1: 1, 2: 1, 3: 0} and graph.count_nearby_entities(3).first().confirmed_interaction_count == 0
    found = graph.find_nearby_entities_by_description([1.0, 0.0]).collect()
    assert sorted((r.global_id, r.searched_entity_global_id) for r in found) == [(1, 2), (2, 1)]
    assert [(r.global_id, r.confirmed_interaction_count) for r in graph.rank_entities_by_interaction_count().orderBy("global_id").collect()] == [(1, 1), (2, 1)]


def test_lists(graph):
    assert [(r.global_id, r.cameras) for r in graph.list_multi_camera_entities().collect()] == [(2, ["1", "2"])]
    assert sorted(r.global_id for r in graph.list_human_captioned_entities().collect()) == [1, 2]
    low = graph.list_low_quality_caption_entities().collect()
    assert [(r.global_id, r.num_cameras, [tuple(s) for s in r.sightings]) for r in low] == [(3, 1, [("1", "0:00")])]


def test_calls_by_name(graph):
    assert len(SCHEMAS) == 13
    assert graph.call("count_nearby_entities", global_id=1).first().confirmed_interaction_count == 1
    for name, arguments in (("drop_tables", {}), ("get_entity_timeline", {"id": 1})):
        with pytest.raises(ValueError):
            graph.call(name, **arguments)


def test_reports(spark, graph):
    ranked = graph.rank_entities_by_interaction_count()
    line = reports.ranking_entry(F.col("global_id"), F.col("confirmed_interaction_count"), F.col("appearance_caption"), F.col("caption_agreement"))
    text = lambda df: reports.report(df, line, [F.col("global_id")], F.concat(F.lit("Top "), F.col("n").cast("string")), reports.TOLD["no_ranking"]).first().text
    assert text(ranked) == "Top 2\n  - global_id 1: 1 confirmed interactions -- a man in a coat\n  - global_id 2: 1 confirmed interactions -- two women [caption uncertain, agreement=0.4]"
    assert text(ranked.where("false")) == reports.TOLD["no_ranking"]
    own = reports.count_line(F.lit(6), F.lit(1), F.lit("x"), F.lit(None).cast("double"))
    df = spark.range(1).select(reports.assembled(F.lit(" global_id 5: 3 confirmed interactions of their own\nglobal_id 6: 1 confirmed interaction of her own "), F.array(own, own, F.lit(""))).alias("a"), reports.unexecuted_tool(F.lit("I call get_entity_action(7)"), list(SCHEMAS)).alias("u"), reports.unexecuted_tool(F.lit("done"), list(SCHEMAS)).alias("v"), reports.summary_entry(F.lit(1), F.lit(2), F.lit(None).cast("string")).alias("s"))
    r = df.first()
    assert r.a == "[claim about global_id 5's interaction count removed -- no verified tool result for it]\nglobal_id 6: 1 confirmed interaction of her own\n\nglobal_id 6: 1 confirmed interactions of their own -- x"
    assert (r.u, r.v, r.s) == ("get_entity_action", None, "  - global_id 1: 2 confirmed interactions")
    seen = spark.createDataFrame([(3, None, None, [("1", "0:00"), ("2", "0:17")], 2)], "g long, c string, a double, s array<struct<camera:string,time:string>>, n long")
    assert seen.select(reports.seen_entry(*[F.col(x) for x in "gcasn"])).first()[0] == "  - global_id 3: None [agreement unknown], seen: camera 1 at 0:00; camera 2 at 0:17 (2 camera(s) total)"
    nudges = spark.range(1).select(reports.count_nudge(F.array(F.lit(1), F.lit(2)), F.lit(4)), reports.count_nudge(F.array().cast("array<int>"), F.lit(0)), reports.invented_ids(F.array(F.lit(9)), F.array(F.lit(2), F.lit(1))), reports.table_line(F.lit("s"), [F.lit("49.282")])).first()
    assert "1, 2." in nudges[0] and "4 more" in nudges[0] and nudges[1] == "" and nudges[2].endswith("1, 2.") and nudges[3] == "s" + " " * 34 + "49.282    "
