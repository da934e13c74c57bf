"""The thirteen tools over a stand-in event graph: users as entities, parts as their captions, embeddings as caption vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.catalog import FPS, GAP, NEAR, PAIRS, RELIABLE, SEG, SIGHT, STRIDE, _mmss, query
from trackloom.functions import expressions as X
from trackloom.functions import reports
from trackloom.operators import sightings, tracks
from trackloom.operators.lineage import checkpointed
from trackloom.operators.tools import EventGraph
from trackloom.sources.standins import detections, table

PERSONS = ("ring", "widget", "bolt")
VECTOR = [float(i * 37 % 11 - 5) for i in range(64)]
LEAST = 0.15
ENT = """ent AS (SELECT u.global_id, p_name AS appearance_caption, p_size / 50.0::DOUBLE AS caption_agreement, p_type AS action_description, p_size / 25.0::DOUBLE AS action_agreement, CAST(e.embedding AS DOUBLE[]) AS caption_vector, CAST(a.embedding AS DOUBLE[]) AS action_vector
  FROM (SELECT DISTINCT user_id AS global_id FROM events) u JOIN part ON p_partkey = u.global_id LEFT JOIN embeddings e ON e.vec_id = u.global_id LEFT JOIN embeddings a ON a.vec_id = u.global_id + 100)"""


def _sec(x: str) -> str:
    return f"round_even({x} / 30.0::DOUBLE, 3)"


def _found(kind: str) -> str:
    q = f"[{', '.join(map(str, VECTOR))}]::DOUBLE[]"
    sim = f"list_inner_product({kind}, {q}) / sqrt(list_inner_product({kind}, {kind})) / sqrt(list_inner_product({q}, {q}))"
    return f"{ENT}, sims AS (SELECT *, {sim} AS sim FROM ent WHERE {kind} IS NOT NULL), found AS (SELECT * FROM sims WHERE sim >= {LEAST} ORDER BY sim DESC, global_id LIMIT 20)"


TIMED = f"{SIGHT}, {ENT}, st AS (SELECT s.*, {_sec('start_frame')} AS start_sec, {_sec('end_frame')} AS end_sec FROM s)"
NEARBY = f"{PAIRS}, {ENT}, mt AS (SELECT m.*, ({_sec('target_frame')} + {_sec('other_frame')}) / 2 AS mid FROM m)"


def event_graph(spark: SparkSession, d: str) -> EventGraph:
    det = detections(spark, d)
    vec = lambda name, shift: table(spark, d, "embeddings").select((F.col("vec_id") - shift).alias("global_id"), F.col("embedding").cast("array<double>").alias(name))
    part = table(spark, d, "part").select(F.col("p_partkey").alias("global_id"), F.col("p_name").alias("appearance_caption"), (F.col("p_size") / 50.0).alias("caption_agreement"), F.col("p_type").alias("action_description"), (F.col("p_size") / 25.0).alias("action_agreement"))
    ent = det.select("global_id").distinct().join(part, "global_id").join(vec("caption_vector", 0), "global_id", "left").join(vec("action_vector", 100), "global_id", "left")
    return EventGraph(det, ent, GAP, FPS, STRIDE, RELIABLE, person_words=PERSONS)


@query(f"WITH {_found('caption_vector')} SELECT global_id, appearance_caption, round_even(sim, 3) AS similarity, caption_agreement FROM found")
def search_by_appearance(spark: SparkSession, d: str) -> DataFrame:
    return event_graph(spark, d).search_by_appearance(VECTOR, LEAST)


@query(f"WITH {_found('action_vector')} SELECT global_id, action_description, round_even(sim, 3) AS similarity, action_agreement FROM found")
def search_by_action(spark: SparkSession, d: str) -> DataFrame:
    return event_graph(spark, d).search_by_action(VECTOR, LEAST)


@query(f"WITH {ENT} SELECT 7 AS global_id, action_description, action_agreement, CAST(NULL AS VARCHAR) AS error FROM ent WHERE global_id = 7")
def get_entity_action(spark: SparkSession, d: str) -> DataFrame:
    return event_graph(spark, d).get_entity_action(7).select("global_id", "action_description", "action_agreement", "error")


@query(f"""WITH {TIMED} SELECT st.global_id, appearance_caption, caption_agreement, row_number() OVER (PARTITION BY st.global_id ORDER BY start_frame, camera, seg_idx) - 1 AS place, camera, {_mmss('start_sec')} AS start_time, {_mmss('end_sec')} AS end_time,
round_even(start_sec, 1) AS start_time_sec, round_even(end_sec, 1) AS end_time_sec, round_even(mean_world_x, 2) AS world_x, round_even(mean_world_y, 2) AS world_y, num_detections FROM st LEFT JOIN ent ON ent.global_id = st.global_id""")
def entity_timelines(spark: SparkSession, d: str) -> DataFrame:
    return event_graph(spark, d).get_entity_timeline()


@query(f"""WITH {TIMED} SELECT st.global_id, appearance_caption, {_mmss('start_sec')} AS start_time, {_mmss('end_sec')} AS end_time, round_even(start_sec, 1) AS start_time_sec, round_even(end_sec, 1) AS end_time_sec
FROM st LEFT JOIN ent ON ent.global_id = st.global_id WHERE camera = '2' AND end_sec >= 166.5 AND start_sec <= 666.5""")
def find_entities_in_camera(spark: SparkSession, d: str) -> DataFrame:
    return event_graph(spark, d).find_entities_in_camera("0002", 166.5, 666.5)


@query(f"""WITH {TIMED} SELECT a.camera, {_mmss('a.start_sec')} || '-' || {_mmss('a.end_sec')} AS entity_a_window, {_mmss('b.start_sec')} || '-' || {_mmss('b.end_sec')} AS entity_b_window
FROM st a JOIN st b ON a.camera = b.camera AND a.global_id = 3 AND b.global_id = 5 AND greatest(a.start_sec - b.end_sec, b.start_sec - a.end_sec) <= 60""")
def check_entities_cooccur(spark: SparkSession, d: str) -> DataFrame:
    return event_graph(spark, d).check_entities_cooccur(3, 5, 60.0)


@query(f"""WITH {NEARBY}, k AS (SELECT mt.*, appearance_caption, caption_agreement, row_number() OVER (PARTITION BY target, match_type ORDER BY distance_m, other) AS place FROM mt LEFT JOIN ent ON ent.global_id = mt.other)
SELECT target, other AS global_id, appearance_caption, caption_agreement, camera, {_mmss('mid')} AS time, round_even(mid, 1) AS time_sec, distance_m, match_type, place FROM k WHERE place <= 1000""")
def find_nearby_entities(spark: SparkSession, d: str) -> DataFrame:
    """Of every entity at once."""
    return event_graph(spark, d).find_nearby_entities(None, NEAR)


@query(f"""WITH {NEARBY}, k AS (SELECT mt.*, appearance_caption, row_number() OVER (PARTITION BY target, match_type ORDER BY distance_m, other) AS place FROM mt LEFT JOIN ent ON ent.global_id = mt.other) SELECT other AS global_id, distance_m, match_type FROM k WHERE place <= 1000 AND target = 7""")
def nearby_of_one(spark: SparkSession, d: str) -> DataFrame:
    return event_graph(spark, d).find_nearby_entities(7, NEAR).select("global_id", "distance_m", "match_type")


@query(f"""WITH {NEARBY}, n AS (SELECT target, count(*) AS n FROM m WHERE match_type = 'confirmed_proximity' GROUP BY 1)
SELECT u.global_id, appearance_caption, caption_agreement, coalesce(n, 0) AS confirmed_interaction_count FROM (SELECT DISTINCT global_id FROM det) u LEFT JOIN n ON n.target = u.global_id LEFT JOIN ent ON ent.global_id = u.global_id""")
def count_nearby_entities(spark: SparkSession, d: str) -> DataFrame:
    return event_graph(spark, d).count_nearby_entities(None, NEAR)


@query(f"""WITH {PAIRS}, {_found('caption_vector')}, mt AS (SELECT m.*, ({_sec('target_frame')} + {_sec('other_frame')}) / 2 AS mid, f.sim, f.appearance_caption AS cap, f.caption_agreement AS agr FROM m JOIN found f ON f.global_id = m.target),
b AS (SELECT *, row_number() OVER (PARTITION BY other ORDER BY distance_m, sim DESC, target) AS best FROM mt), k AS (SELECT b.*, ent.appearance_caption, ent.caption_agreement, row_number() OVER (PARTITION BY match_type ORDER BY distance_m, other) AS place FROM b LEFT JOIN ent ON ent.global_id = b.other WHERE best = 1)
SELECT match_type, place, other AS global_id, appearance_caption, caption_agreement, camera, {_mmss('mid')} AS time, round_even(mid, 1) AS time_sec, distance_m, target AS searched_entity_global_id, cap AS searched_entity_caption, agr AS searched_entity_caption_agreement FROM k WHERE place <= 1000""")
def find_nearby_entities_by_description(spark: SparkSession, d: str) -> DataFrame:
    return event_graph(spark, d).find_nearby_entities_by_description(VECTOR, LEAST, NEAR)


@query(f"WITH {SIGHT}, {ENT} SELECT s.global_id, string_agg(DISTINCT camera, ',' ORDER BY camera) AS cameras, any_value(appearance_caption) AS appearance_caption FROM s LEFT JOIN ent ON ent.global_id = s.global_id GROUP BY 1 HAVING count(DISTINCT camera) > 1")
def list_multi_camera_entities(spark: SparkSession, d: str) -> DataFrame:
    return event_graph(spark, d).list_multi_camera_entities().withColumn("cameras", F.array_join("cameras", ","))


def _captions_sql(human: bool) -> str:
    said = f"coalesce(list_has_any(string_split(lower(appearance_caption), ' '), {list(PERSONS)}), false)"
    return f"""WITH {TIMED}, a AS (SELECT global_id, sum(num_detections) AS dets, string_agg(camera || '@' || {_mmss('start_sec')}, ';' ORDER BY start_frame, camera, seg_idx) AS seen, count(DISTINCT camera) AS num_cameras FROM st GROUP BY 1)
SELECT a.global_id, appearance_caption, caption_agreement, seen, num_cameras FROM a LEFT JOIN ent ON ent.global_id = a.global_id WHERE dets >= {RELIABLE} AND {'' if human else 'NOT '}{said}"""


def _seen(df: DataFrame) -> DataFrame:
    return df.withColumn("seen", F.array_join(F.transform("sightings", lambda s: F.concat(s["camera"], F.lit("@"), s["time"])), ";")).drop("sightings")


@query(_captions_sql(False))
def list_low_quality_caption_entities(spark: SparkSession, d: str) -> DataFrame:
    return _seen(event_graph(spark, d).list_low_quality_caption_entities())


@query(_captions_sql(True))
def list_human_captioned_entities(spark: SparkSession, d: str) -> DataFrame:
    return _seen(event_graph(spark, d).list_human_captioned_entities())


RANKED = f"{NEARBY}, c AS (SELECT target AS global_id, count(*) AS n FROM m WHERE match_type = 'confirmed_proximity' GROUP BY 1), r AS (SELECT c.global_id, appearance_caption, caption_agreement, n FROM c LEFT JOIN ent ON ent.global_id = c.global_id ORDER BY n DESC, c.global_id LIMIT 10)"


@query(f"WITH {RANKED} SELECT global_id, appearance_caption, caption_agreement, n AS confirmed_interaction_count FROM r")
def rank_entities_by_interaction_count(spark: SparkSession, d: str) -> DataFrame:
    return event_graph(spark, d).rank_entities_by_interaction_count(NEAR)


FLAG = "CASE WHEN caption_agreement < 0.6 THEN ' [caption uncertain, agreement=' || CAST(caption_agreement AS VARCHAR) || ']' ELSE '' END"


@query(f"""WITH {RANKED}, l AS (SELECT '  - global_id ' || global_id || ': ' || n || ' confirmed interactions -- ' || coalesce(appearance_caption, 'None') || coalesce({FLAG}, '') AS line, n, global_id FROM r)
SELECT CASE WHEN count(*) = 0 THEN '{reports.TOLD["no_ranking"]}' ELSE 'Top ' || count(*) || ' entities by confirmed interaction count:' || chr(10) || string_agg(line, chr(10) ORDER BY n DESC, global_id) END AS text FROM l""")
def ranking_report(spark: SparkSession, d: str) -> DataFrame:
    r = event_graph(spark, d).rank_entities_by_interaction_count(NEAR)
    n = F.col("confirmed_interaction_count")
    line = reports.ranking_entry(F.col("global_id"), n, F.col("appearance_caption"), F.col("caption_agreement"))
    header = F.concat(F.lit("Top "), F.col("n").cast("string"), F.lit(" entities by confirmed interaction count:"))
    return reports.report(r, line, [-n, F.col("global_id")], header, reports.TOLD["no_ranking"])


@query(f"""WITH {NEARBY}, n AS (SELECT target, count(*) AS n FROM m WHERE match_type = 'confirmed_proximity' GROUP BY 1), u AS (SELECT u.global_id, appearance_caption, caption_agreement, coalesce(n, 0) AS n FROM (SELECT DISTINCT global_id FROM det) u LEFT JOIN n ON n.target = u.global_id LEFT JOIN ent ON ent.global_id = u.global_id)
SELECT global_id, 'global_id ' || global_id || ': ' || n || ' confirmed interactions of their own -- ' || coalesce(appearance_caption, 'None') || coalesce({FLAG}, '') AS line FROM u""")
def count_report(spark: SparkSession, d: str) -> DataFrame:
    c = event_graph(spark, d).count_nearby_entities(None, NEAR)
    return c.select("global_id", reports.count_line(F.col("global_id"), F.col("confirmed_interaction_count"), F.col("appearance_caption"), F.col("caption_agreement")).alias("line"))


@query(f"""WITH {NEARBY}, c AS (SELECT target, count(*) AS n FROM m WHERE match_type = 'confirmed_proximity' GROUP BY 1), e AS (SELECT mt.*, appearance_caption, caption_agreement, c.n FROM mt LEFT JOIN ent ON ent.global_id = mt.other LEFT JOIN c ON c.target = mt.other WHERE match_type = 'confirmed_proximity')
SELECT target, other, '  - camera ' || camera || ', ' || {_mmss('mid')} || ': ' || coalesce(appearance_caption, 'None') || coalesce({FLAG}, '') || ' (global_id ' || other || '), ' || CAST(distance_m AS VARCHAR) || 'm away' || CASE WHEN n IS NULL THEN '' ELSE ', ' || n || ' confirmed interactions of their own' END AS line FROM e""")
def proximity_report_lines(spark: SparkSession, d: str) -> DataFrame:
    """A line for each confirmed match, however many an entity has, with the other entity's own count."""
    near = checkpointed(event_graph(spark, d).find_nearby_entities(None, NEAR, top_k=None).where("match_type = 'confirmed_proximity'"))  # read twice
    own = near.groupBy(F.col("target").alias("global_id")).agg(F.count("*").alias("own"))
    line = reports.match_entry(F.col("camera"), F.col("time"), F.col("appearance_caption"), F.col("caption_agreement"), F.col("global_id"), F.col("distance_m"), F.col("own"))
    return near.join(own, "global_id", "left").select("target", F.col("global_id").alias("other"), line.alias("line"))


@query(f"WITH {SIGHT} SELECT 'entities' AS kind, count(DISTINCT global_id) AS n FROM s UNION ALL SELECT 'sightings', count(*) FROM s UNION ALL SELECT 'edges', 3 * count(*) - count(DISTINCT global_id) FROM s")
def graph_counts(spark: SparkSession, d: str) -> DataFrame:
    s = sightings.sightings(detections(spark, d), GAP)
    return tracks.graph_counts(s, sightings.edges(s))


@query(f"""WITH {SIGHT} SELECT count(*) AS n, round_even(avg(num_detections), 6) AS mean, median(num_detections) AS median, round_even(quantile_cont(num_detections, 0.1), 6) AS p10, CAST(max(num_detections) AS DOUBLE) AS max, round_even(avg(CASE WHEN num_detections < 3 THEN 1.0::DOUBLE ELSE 0 END), 6) AS below FROM s""")
def detection_spread(spark: SparkSession, d: str) -> DataFrame:
    """How many detections sightings have: mean, median, tenth percentile, maximum and share below the least reliable number."""
    s = sightings.sightings(detections(spark, d), GAP)
    found = tracks.spread(s, F.col("num_detections").cast("double"), RELIABLE)
    return found.withColumns({c: X.rint(F.col(c), 6) for c in ("mean", "p10", "below")})


@query(f"""WITH {SEG} SELECT global_id, camera, CAST(seg_idx AS BIGINT) AS seg_idx, count(*) AS n, string_agg(frame || ' ' || CAST(CAST(wx * 100 AS BIGINT) AS VARCHAR), ';' ORDER BY frame, ordinal) AS path FROM seg GROUP BY 1, 2, 3""")
def sighting_paths(spark: SparkSession, d: str) -> DataFrame:
    """The trajectory of each sighting in order, as frames and hundredths of its first coordinate."""
    t = sightings.trajectories(detections(spark, d), GAP, FPS)
    step = lambda p: F.concat(p["frame"].cast("string"), F.lit(" "), F.rint(p["x"] * 100).cast("long").cast("string"))
    return t.select("global_id", "camera", "seg_idx", F.size("trajectory").cast("long").alias("n"), F.array_join(F.transform("trajectory", step), ";").alias("path"))


def _flag(x: str) -> str:
    return f"CASE WHEN {x} < 0.6 THEN ' [caption uncertain, agreement=' || {x} || ']' ELSE '' END"


NEAR_LINE = f"'  - camera ' || camera || ', ' || time || ': ' || coalesce(appearance_caption, 'None') || {_flag('caption_agreement')} || ' (global_id ' || other || '), ' || distance_m || 'm away'"


@query(f"""WITH {NEARBY}, k AS (SELECT mt.*, appearance_caption, caption_agreement, {_mmss('mid')} AS time FROM mt LEFT JOIN ent ON ent.global_id = mt.other WHERE match_type = 'confirmed_proximity' AND target = 5)
SELECT CASE WHEN count(*) = 0 THEN 'No confirmed proximity matches found within the given distance/time thresholds.' ELSE 'Confirmed proximity matches (' || count(*) || '):' || chr(10) || string_agg({NEAR_LINE}, chr(10) ORDER BY distance_m, other) END AS text FROM k""")
def proximity_report(spark: SparkSession, d: str) -> DataFrame:
    return reports.proximity_report(event_graph(spark, d).find_nearby_entities(5, NEAR))


@query(f"""WITH {RANKED} SELECT CASE WHEN count(*) = 0 THEN 'No entities had any confirmed proximity matches within the given thresholds.' ELSE 'Top ' || count(*) || ' entities by confirmed interaction count:' || chr(10) || string_agg('  - global_id ' || global_id || ': ' || n || ' confirmed interactions -- ' || coalesce(appearance_caption, 'None') || {_flag('caption_agreement')}, chr(10) ORDER BY n DESC, global_id) END AS text FROM r""")
def ranking_report(spark: SparkSession, d: str) -> DataFrame:
    return reports.ranking_report(event_graph(spark, d).rank_entities_by_interaction_count(NEAR))


def _listed_sql(human: bool) -> str:
    said = f"coalesce(list_has_any(string_split(lower(appearance_caption), ' '), {list(PERSONS)}), false)"
    return f"""WITH {TIMED}, a AS (SELECT global_id, sum(num_detections) AS dets, string_agg('camera ' || camera || ' at ' || {_mmss('start_sec')}, '; ' ORDER BY start_frame, camera, seg_idx) AS seen, count(DISTINCT camera) AS num_cameras FROM st GROUP BY 1),
l AS (SELECT a.global_id, caption_agreement, '  - global_id ' || a.global_id || ': ' || coalesce(appearance_caption, 'None') || ' [' || coalesce('agreement=' || caption_agreement, 'agreement unknown') || '], seen: ' || seen || ' (' || num_cameras || ' camera(s) total)' AS line
FROM a LEFT JOIN ent ON ent.global_id = a.global_id WHERE dets >= {RELIABLE} AND {'' if human else 'NOT '}{said})"""


@query(f"{_listed_sql(True)} SELECT count(*) || ' entities whose caption identifies them as a person:' || chr(10) || string_agg(line, chr(10) ORDER BY global_id) AS text FROM l")
def human_report(spark: SparkSession, d: str) -> DataFrame:
    return reports.human_report(event_graph(spark, d).list_human_captioned_entities())


def _section(low: bool) -> str:
    rule = "coalesce(caption_agreement < 0.6, true)" if low else "caption_agreement >= 0.6"
    name = "'Low-confidence (' || count(*) FILTER (WHERE {0}) || ' of ' || count(*) || ', agreement below 0.6 or unknown):'" if low else "'Higher-confidence (' || count(*) FILTER (WHERE {0}) || ' of ' || count(*) || ', agreement at or above 0.6):'"
    return f"chr(10) || {name.format(rule)} || chr(10) || coalesce(string_agg(line, chr(10) ORDER BY global_id) FILTER (WHERE {rule}), '  (none)')"


@query(f"{_listed_sql(False)} SELECT count(*) || ' entities whose caption names no person: most are people whose caption failed, so take none for an object.' || chr(10) || {_section(True)} || chr(10) || {_section(False)} AS text FROM l")
def low_quality_report(spark: SparkSession, d: str) -> DataFrame:
    return reports.low_quality_report(event_graph(spark, d).list_low_quality_caption_entities())


@query(f"""WITH {NEARBY}{SIGHT[len(SEG):]}, st AS (SELECT s.*, {_sec('start_frame')} AS start_sec, {_sec('end_frame')} AS end_sec FROM s), n AS (SELECT global_id, count(DISTINCT camera) AS n, string_agg(DISTINCT camera, ',' ORDER BY camera) AS cams FROM s GROUP BY 1),
f AS (SELECT min(target) AS target FROM m WHERE target IN (SELECT global_id FROM n WHERE n > 1)), a AS (SELECT min(target) AS target FROM m)
SELECT 1 AS place, 'entities on more than one camera' AS question, CAST(count(*) FILTER (WHERE n > 1) AS VARCHAR) AS expected FROM n
UNION ALL SELECT 2, 'cameras of the first of them', arg_min(cams, global_id) FILTER (WHERE n > 1) FROM n
UNION ALL SELECT 3, 'first entity on one camera alone', CAST(min(global_id) FILTER (WHERE n = 1) AS VARCHAR) FROM n
UNION ALL SELECT 4, 'an entity that does not exist', CAST(max(global_id) + 1000 AS VARCHAR) FROM n
UNION ALL SELECT 5, 'entities whose caption has the word', string_agg(CAST(global_id AS VARCHAR), ',' ORDER BY global_id) FROM ent WHERE contains(appearance_caption, 'ring')
UNION ALL SELECT 6, 'entities on a camera in a window', string_agg(DISTINCT lpad(CAST(global_id AS VARCHAR), 6, '0'), ',' ORDER BY lpad(CAST(global_id AS VARCHAR), 6, '0')) FROM st WHERE camera = '2' AND end_sec >= 0 AND start_sec <= 60
UNION ALL SELECT 7, 'entities near the first one that has any', string_agg(CAST(other AS VARCHAR), ',' ORDER BY other) FROM m WHERE target = (SELECT coalesce(f.target, a.target) FROM f, a)""")
def expected_answers(spark: SparkSession, d: str) -> DataFrame:
    """What a chat about the graph must answer to seven questions, computed from the graph: (place, question, expected)."""
    return event_graph(spark, d).expected_answers("ring", "2", 60.0, NEAR)
