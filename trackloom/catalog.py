"""All queries of the engine over the driver's tables, with DuckDB SQL for each that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.functions import calibration, colours
from trackloom.functions import expressions as X
from trackloom.operators import evaluation as E
from trackloom.operators import captions, identity, proximity, sampling, scans, sightings, similar, tracks
from trackloom.sources.standins import detections, evaluation, table, track_features

GAP, NEAR_FRAMES, NEAR, FPS, STRIDE, RELIABLE = 1440, 30, 10.0, 30.0, 3, 3
PEOPLE, COLOURS = ["the", "de", "die"], ["and", "of", "la", "der"]
HOMOGRAPHY = [[1.2, 0.1, 30.0], [0.05, 1.4, 20.0], [0.0005, 0.001, 1.0]]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

DET = """det AS (SELECT event_id AS ordinal, CASE event_type WHEN 'click' THEN '1' WHEN 'error' THEN '2' WHEN 'purchase' THEN '3' WHEN 'signup' THEN '4' ELSE '5' END AS camera,
  user_id AS global_id, CAST(floor(epoch_us(ts)/60000000) AS BIGINT) - 28401120 AS frame, value AS wx, CAST(json_extract_string(props,'$.k') AS DOUBLE) AS wy FROM events)"""
SEG = f"""{DET}, lagged AS (SELECT *, coalesce(frame - lag(frame) OVER (PARTITION BY global_id, camera ORDER BY frame, ordinal) > {GAP}, false) AS fresh FROM det),
seg AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY global_id, camera ORDER BY frame, ordinal ROWS UNBOUNDED PRECEDING) AS seg_idx FROM lagged)"""
SIGHT = f"""{SEG}, s AS (SELECT global_id, camera, CAST(seg_idx AS BIGINT) AS seg_idx, min(frame) AS start_frame, max(frame) AS end_frame, round_even(avg(wx), 3) AS mean_world_x, round_even(avg(wy), 3) AS mean_world_y, count(*) AS num_detections FROM seg GROUP BY 1, 2, 3)"""
POS = f"""{SEG}, sized AS (SELECT *, count(*) OVER (PARTITION BY global_id, camera, seg_idx) AS dets FROM seg),
last AS (SELECT *, row_number() OVER (PARTITION BY global_id, camera, frame ORDER BY ordinal DESC) AS r FROM sized),
pos AS (SELECT global_id, camera, frame, wx, wy, dets, row_number() OVER (PARTITION BY global_id, camera ORDER BY frame) - 1 AS place FROM last WHERE r = 1)"""
PAIRS = f"""{POS}, near AS (SELECT t.global_id AS target, o.global_id AS other, t.camera, t.frame AS tf, o.frame AS of_, t.dets AS td, o.dets AS od,
  sqrt((o.wx-t.wx)*(o.wx-t.wx)+(o.wy-t.wy)*(o.wy-t.wy)) AS d FROM pos t JOIN pos o ON t.camera = o.camera AND o.place % {STRIDE} = 0 AND t.global_id <> o.global_id AND abs(t.frame - o.frame) <= {NEAR_FRAMES}),
p AS (SELECT *, round_even(d, 2) AS r FROM near WHERE d <= {NEAR}), low AS (SELECT *, min(r) OVER (PARTITION BY target, other) AS m FROM p),
tier AS (SELECT *, max(CASE WHEN d < r THEN 1 ELSE 0 END) OVER (PARTITION BY target, other) AS any_below FROM low WHERE r = m),
pick AS (SELECT *, row_number() OVER (PARTITION BY target, other ORDER BY CASE WHEN d < r THEN 1 ELSE 0 END DESC,
  CASE WHEN any_below = 1 THEN -CAST(camera AS INT) ELSE CAST(camera AS INT) END, CASE WHEN any_below = 1 THEN -of_ ELSE of_ END, CASE WHEN any_below = 1 THEN -tf ELSE tf END) AS k FROM tier),
m AS (SELECT target, other, camera, tf AS target_frame, of_ AS other_frame, r AS distance_m, least(td, od) AS min_detections,
  CASE WHEN r <= 0.15 THEN 'likely_same_person' WHEN least(td, od) < 3 THEN 'uncertain_proximity' ELSE 'confirmed_proximity' END AS match_type FROM pick WHERE k = 1)"""

#: The same over all positions of the other side.
EVERY_PAIR = PAIRS.replace(f" AND o.place % {STRIDE} = 0", "")


def _eval(x: str, truth: str = "true", tracker: str = "true") -> str:
    return f"""{DET}, once AS (SELECT *, 'scene_' || camera AS scene, CAST(floor(frame/60.0) AS BIGINT) + 1 AS fr, row_number() OVER (PARTITION BY camera, CAST(floor(frame/60.0) AS BIGINT), global_id ORDER BY ordinal) AS r FROM det),
g AS (SELECT scene, fr AS frame, global_id AS gt, {x} AS x FROM once WHERE r = 1 AND ordinal % 20 <> 0 AND {truth}),
t AS (SELECT scene, fr AS frame, global_id + CASE WHEN fr > 360 THEN 100000 ELSE 0 END AS trk, {x} + (ordinal % 13) * 0.137 AS x FROM once WHERE r = 1 AND ordinal % 10 <> 1 AND {tracker}),
sim AS (SELECT g.scene, g.frame, g.gt, t.trk, 1 - sqrt((g.x-t.x)*(g.x-t.x)) / 2.0 AS sim FROM g JOIN t ON g.scene = t.scene AND g.frame = t.frame WHERE 1 - sqrt((g.x-t.x)*(g.x-t.x)) / 2.0 > 0),
cnt AS (SELECT coalesce(a.scene, b.scene) AS scene, coalesce(dets, 0) AS dets, coalesce(gt_dets, 0) AS gt_dets, coalesce(ids, 0) AS ids, coalesce(gt_ids, 0) AS gt_ids FROM
  (SELECT scene, count(*) AS gt_dets, count(DISTINCT gt) AS gt_ids FROM g GROUP BY 1) a FULL JOIN (SELECT scene, count(*) AS dets, count(DISTINCT trk) AS ids FROM t GROUP BY 1) b ON a.scene = b.scene)"""


GATED = _eval("global_id * 10 + wy * 0.01")
#: One scene without a tracker, one without ground truth.
LONE = _eval("global_id * 10 + wy * 0.01", "scene <> 'scene_2'", "scene <> 'scene_1'")


def _hota(base: str) -> str:
    return base + """, ng AS (SELECT scene, gt, count(*) AS ng FROM g GROUP BY 1, 2), nt AS (SELECT scene, trk, count(*) AS nt FROM t GROUP BY 1, 2),
al AS (SELECT CAST(i AS DOUBLE) / 20 AS alpha FROM range(1, 20) r(i)),
per AS (SELECT scene, alpha, gt, trk, count(*) AS n, sum(sim) AS s FROM sim, al WHERE sim >= alpha - 2.220446049250313e-16 GROUP BY 1, 2, 3, 4),
tot AS (SELECT per.scene, alpha, sum(n) AS tp, sum(s) AS s, sum(n * n / CAST(greatest(1, ng + nt - n) AS DOUBLE)) AS a, sum(n * n / CAST(greatest(1, ng) AS DOUBLE)) AS re, sum(n * n / CAST(greatest(1, nt) AS DOUBLE)) AS pr
  FROM per JOIN ng ON per.scene = ng.scene AND per.gt = ng.gt JOIN nt ON per.scene = nt.scene AND per.trk = nt.trk GROUP BY 1, 2),
f AS (SELECT cnt.scene, al.alpha, dets = 0 OR gt_dets = 0 AS lone, CAST(coalesce(tp, 0) AS BIGINT) AS tp, CAST(gt_dets - coalesce(tp, 0) AS BIGINT) AS fn, CAST(dets - coalesce(tp, 0) AS BIGINT) AS fp, coalesce(a, 0) AS a, coalesce(re, 0) AS re, coalesce(pr, 0) AS pr, coalesce(s, 0) AS s
  FROM cnt CROSS JOIN al LEFT JOIN tot ON tot.scene = cnt.scene AND tot.alpha = al.alpha),
h AS (SELECT scene, alpha, tp, fn, fp, tp / CAST(greatest(1, tp + fn + fp) AS DOUBLE) AS det_a, a / greatest(1, tp) AS ass_a, re / greatest(1, tp) AS ass_re, pr / greatest(1, tp) AS ass_pr, CASE WHEN lone THEN 1 ELSE s / greatest(1e-10, tp) END AS loc_a FROM f)"""


HOTA = _hota(GATED)
HOTA_SHOWN = "scene, alpha, tp, fn, fp, round_even(det_a, 6) AS det_a, round_even(ass_a, 6) AS ass_a, round_even(ass_re, 6) AS ass_re, round_even(ass_pr, 6) AS ass_pr, round_even(loc_a, 6) AS loc_a, round_even(sqrt(det_a * ass_a), 6) AS hota"


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _sightings(spark: SparkSession, d: str) -> DataFrame:
    return sightings.sightings(detections(spark, d), GAP)


@query(f"WITH {SIGHT} SELECT * FROM s")
def sighting_summary(spark: SparkSession, d: str) -> DataFrame:
    return _sightings(spark, d)


NODE = "concat_ws(':', 'sighting', CAST(global_id AS VARCHAR), camera, CAST(seg_idx AS VARCHAR))"


@query(f"""WITH {SIGHT}, n AS (SELECT *, {NODE} AS node FROM s) SELECT 'entity:' || CAST(global_id AS VARCHAR) AS src, node AS dst, 'HAS_SIGHTING' AS relation FROM n
UNION ALL SELECT node, 'camera:' || camera, 'IN_CAMERA' FROM n UNION ALL SELECT * FROM (SELECT node, lead(node) OVER (PARTITION BY global_id ORDER BY start_frame, camera, seg_idx) AS nx, 'PRECEDES' FROM n) WHERE nx IS NOT NULL""")
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return sightings.edges(_sightings(spark, d))


def _mmss(x: str) -> str:
    return f"CAST(CAST(round_even({x}, 0) AS BIGINT) // 60 AS VARCHAR) || ':' || lpad(CAST(CAST(round_even({x}, 0) AS BIGINT) % 60 AS VARCHAR), 2, '0')"


@query(f"WITH {SIGHT} SELECT global_id, camera, seg_idx, {_mmss('start_frame / 30.0')} AS start, {_mmss('end_frame / 30.0')} AS \"end\", num_detections FROM s")
def entity_timeline(spark: SparkSession, d: str) -> DataFrame:
    return sightings.timeline(_sightings(spark, d), FPS)


@query(f"WITH {SIGHT} SELECT global_id, start_frame, end_frame FROM s WHERE camera = '2' AND end_frame >= 5000 AND start_frame <= 20000")
def camera_window(spark: SparkSession, d: str) -> DataFrame:
    return sightings.in_camera(_sightings(spark, d), "02", 5000, 20000).select("global_id", "start_frame", "end_frame")


@query(f"WITH {SIGHT} SELECT x.global_id AS a, y.global_id AS b, count(*) AS n_matches FROM s x JOIN s y ON x.camera = y.camera AND x.global_id < y.global_id AND greatest(x.start_frame - y.end_frame, y.start_frame - x.end_frame) <= 5 GROUP BY 1, 2")
def cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    return sightings.cooccurrence(_sightings(spark, d), 5)


@query(f"WITH {SIGHT} SELECT global_id, string_agg(DISTINCT camera, ',' ORDER BY camera) AS cameras, count(DISTINCT camera) AS n_cameras FROM s GROUP BY 1 HAVING count(DISTINCT camera) > 1")
def multi_camera_entities(spark: SparkSession, d: str) -> DataFrame:
    return sightings.multi_camera(_sightings(spark, d))


def _matches(spark: SparkSession, d: str, top: int | None = None, stride: int = STRIDE) -> DataFrame:
    return proximity.matches_of_all(detections(spark, d), NEAR_FRAMES, NEAR, GAP, stride, RELIABLE, top=top)


@query(f"WITH {PAIRS} SELECT * FROM m")
def proximity_matches(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d)


@query(f"WITH {PAIRS} SELECT target, match_type, count(*) AS n FROM m GROUP BY 1, 2")
def interaction_counts(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d).groupBy("target", "match_type").agg(F.count("*").alias("n"))


@query(f"WITH {PAIRS}, c AS (SELECT target, count(*) AS interactions FROM m WHERE match_type = 'confirmed_proximity' GROUP BY 1) SELECT * FROM c ORDER BY interactions DESC, target LIMIT 10")
def interaction_rank(spark: SparkSession, d: str) -> DataFrame:
    return proximity.interaction_counts(_matches(spark, d)).orderBy(F.desc("interactions"), "target").limit(10)


@query(f"WITH {PAIRS}, c AS (SELECT *, row_number() OVER (PARTITION BY other ORDER BY distance_m, target) AS k FROM m WHERE target < 20) SELECT other, target AS searched, distance_m, match_type FROM c WHERE k = 1")
def proximity_by_candidates(spark: SparkSession, d: str) -> DataFrame:
    near = _matches(spark, d).where("target < 20")
    best = Window.partitionBy("other").orderBy("distance_m", "target")
    return near.withColumn("k", F.row_number().over(best)).where("k = 1").select("other", F.col("target").alias("searched"), "distance_m", "match_type")


@query("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, list_inner_product(CAST(embedding AS DOUBLE[]), CAST(q.e AS DOUBLE[])) AS sim FROM embeddings, q WHERE vec_id <> 0)
SELECT vec_id, round_even(sim, 3) AS similarity FROM s WHERE sim >= 0.1 ORDER BY sim DESC, vec_id LIMIT 20""")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = e.where("vec_id = 0").agg(F.first("embedding").alias("q"))  # one row
    s = e.where("vec_id <> 0").join(F.broadcast(q)).select("vec_id", X.dot(F.col("embedding"), F.col("q")).alias("sim"))
    return s.where("sim >= 0.1").orderBy(F.desc("sim"), "vec_id").limit(20).select("vec_id", X.rint(F.col("sim"), 3).alias("similarity"))


@query("""SELECT q.vec_id AS query_id, v.vec_id, round_even(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0
WHERE list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) >= 0.3""")
def vector_join(spark: SparkSession, d: str) -> DataFrame:
    """For many query vectors at once, all vectors that are similar enough, through the pivot index."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    q = e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    return similar.similar_vectors(q, e, 0.3).withColumn("similarity", X.rint(F.col("similarity"), 6))


@query("""WITH v AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), t AS (SELECT label, i, sum(x) AS x FROM v GROUP BY 1, 2),
n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) SELECT t.label, n.n AS members, round_even((sum(x * x) - n.n) / (n.n * (n.n - 1)), 3) AS agreement FROM t JOIN n ON t.label = n.label GROUP BY t.label, n.n""")
def agreement_by_label(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    total = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.sum(F.col("x").cast("double")).alias("x"))
    n = e.groupBy("label").agg(F.count("*").alias("members"))
    square = total.groupBy("label").agg(F.sum(F.col("x") * F.col("x")).alias("s"))
    return square.join(n, "label").select("label", "members", X.rint((F.col("s") - F.col("members")) / (F.col("members") * (F.col("members") - 1)), 3).alias("agreement"))


CAPS = "caps AS (SELECT doc_id, doc_id % 100 AS entity, text AS caption FROM documents)"


def _split_sql(text: str) -> str:
    """The words of a text, parted by blanks of any kind."""
    return f"list_filter(regexp_split_to_array({text}, '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '')"


WORDS_SQL = _split_sql("regexp_replace(lower(caption), '[,.]', ' ', 'g')")


def _captions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 100).alias("entity"), F.col("text").alias("caption"))


@query(f"WITH {CAPS} SELECT entity, count(*) AS captions, count(*) FILTER (WHERE list_has_any({WORDS_SQL}, ['the', 'de', 'die'])) AS mentioning FROM caps GROUP BY 1")
def caption_humanness(spark: SparkSession, d: str) -> DataFrame:
    said = X.mentions(F.col("caption"), PEOPLE)
    return _captions(spark, d).groupBy("entity").agg(F.count("*").alias("captions"), F.count(F.when(said, 1)).alias("mentioning"))


@query(f"""WITH {CAPS} SELECT doc_id, replace(replace(array_to_string(list_filter({_split_sql('caption')}, lambda w: NOT list_has_any(string_split(lower(trim(w, '.,;:')), '-'), ['and', 'of', 'la', 'der'])), ' '), ' ,', ','), ' .', '.') AS stripped FROM caps""")
def strip_listed_words(spark: SparkSession, d: str) -> DataFrame:
    return _captions(spark, d).select("doc_id", X.without_words(F.col("caption"), COLOURS).alias("stripped"))


@query(f"""WITH {CAPS}, w AS (SELECT doc_id, {_split_sql("lower(coalesce(caption, ''))")} AS w FROM caps) SELECT doc_id FROM w WHERE len(list_filter(range(3, len(w) + 1), lambda i: w[i] = w[i-1] AND w[i] = w[i-2])) > 0""")
def degenerate_captions(spark: SparkSession, d: str) -> DataFrame:
    return _captions(spark, d).where(X.degenerate(F.col("caption"))).select("doc_id")


@query(f"WITH {GATED} SELECT scene, frame, gt, trk, round_even(sim, 6) AS sim FROM sim")
def similarity_pairs(spark: SparkSession, d: str) -> DataFrame:
    return E.similarity(*evaluation(spark, d)).withColumn("sim", X.rint(F.col("sim"), 6))


@query(f"WITH {GATED} SELECT * FROM cnt")
def count_metric(spark: SparkSession, d: str) -> DataFrame:
    return E.counts(*evaluation(spark, d))


@query(f"""WITH {GATED}, ng AS (SELECT scene, gt, count(*) AS ng FROM g GROUP BY 1, 2), nt AS (SELECT scene, trk, count(*) AS nt FROM t GROUP BY 1, 2),
den AS (SELECT *, sum(sim) OVER (PARTITION BY scene, frame, gt) + sum(sim) OVER (PARTITION BY scene, frame, trk) - sim AS den FROM sim), pot AS (SELECT scene, gt, trk, sum(sim / den) AS pot FROM den GROUP BY 1, 2, 3)
SELECT pot.scene, pot.gt, pot.trk, round_even(pot / (ng + nt - pot), 6) AS ga FROM pot JOIN ng ON pot.scene = ng.scene AND pot.gt = ng.gt JOIN nt ON pot.scene = nt.scene AND pot.trk = nt.trk""")
def hota_alignment(spark: SparkSession, d: str) -> DataFrame:
    g, t = evaluation(spark, d)
    return E.alignment(E.similarity(g, t), g, t).select("scene", "gt", "trk", X.rint(F.col("ga"), 6).alias("ga"))


def _rounded(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: X.rint(F.col(c), 6) for c in cols})


HOTA_FIELDS = ["det_a", "ass_a", "ass_re", "ass_pr", "loc_a", "hota"]


@query(f"WITH {HOTA} SELECT {HOTA_SHOWN} FROM h")
def hota_gated(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(E.hota(*evaluation(spark, d)), HOTA_FIELDS)


def _lone(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    g, t = evaluation(spark, d)
    return g.where("scene <> 'scene_2'"), t.where("scene <> 'scene_1'")


@query(f"WITH {_hota(LONE)} SELECT {HOTA_SHOWN} FROM h")
def hota_one_sided(spark: SparkSession, d: str) -> DataFrame:
    """HOTA where one scene has no tracker and one no ground truth."""
    return _rounded(E.hota(*_lone(spark, d)), HOTA_FIELDS)


@query(f"WITH {HOTA}, z AS (SELECT scene, avg(sqrt(det_a * ass_a)) AS h, avg(det_a) AS d, avg(ass_a) AS a, avg(loc_a) AS l FROM h GROUP BY 1) SELECT round_even(avg(h), 6) AS hota, round_even(avg(d), 6) AS det_a, round_even(avg(a), 6) AS ass_a, round_even(avg(l), 6) AS loc_a FROM z")
def hota_final(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(E.final_score(E.hota(*evaluation(spark, d))), ["hota", "det_a", "ass_a", "loc_a"])


def _identity(base: str) -> str:
    return f"""WITH {base}, o AS (SELECT scene, gt, trk, count(*) AS w FROM sim WHERE sim >= 0.5 GROUP BY 1, 2, 3), b AS (SELECT scene, gt, max(w) AS w FROM o GROUP BY 1, 2), tp AS (SELECT scene, CAST(sum(w) AS BIGINT) AS idtp FROM b GROUP BY 1),
i AS (SELECT cnt.scene, coalesce(idtp, 0) AS idtp, gt_dets - coalesce(idtp, 0) AS idfn, dets - coalesce(idtp, 0) AS idfp FROM cnt LEFT JOIN tp ON cnt.scene = tp.scene)"""


ID_SHOWN = "idtp, idfn, idfp, round_even(idtp / greatest(1.0::DOUBLE, idtp + idfn), 6) AS idr, round_even(idtp / greatest(1.0::DOUBLE, idtp + idfp), 6) AS idp, round_even(idtp / greatest(1.0::DOUBLE, idtp + 0.5::DOUBLE * idfp + 0.5::DOUBLE * idfn), 6) AS idf1"


@query(f"{_identity(GATED)} SELECT scene, {ID_SHOWN} FROM i")
def identity_gated(spark: SparkSession, d: str) -> DataFrame:
    g, t = evaluation(spark, d)
    return _rounded(E.identity(g, t, E.similarity(g, t)), E.ID_RATES)


@query(f"{_identity(LONE)} SELECT scene, {ID_SHOWN} FROM i")
def identity_one_sided(spark: SparkSession, d: str) -> DataFrame:
    g, t = _lone(spark, d)
    return _rounded(E.identity(g, t, E.similarity(g, t)), E.ID_RATES)


@query(f"{_identity(GATED)}, s AS (SELECT CAST(sum(idtp) AS BIGINT) AS idtp, CAST(sum(idfn) AS BIGINT) AS idfn, CAST(sum(idfp) AS BIGINT) AS idfp FROM i) SELECT {ID_SHOWN} FROM s")
def identity_combined(spark: SparkSession, d: str) -> DataFrame:
    """All scenes as one."""
    g, t = evaluation(spark, d)
    return _rounded(E.combined_identity(E.identity(g, t, E.similarity(g, t)), []), E.ID_RATES)


@query(f"""WITH {GATED}, mt AS (SELECT * FROM sim WHERE sim >= 0.5 - 2.220446049250313e-16), sw AS (SELECT *, CASE WHEN lag(trk) OVER (PARTITION BY scene, gt ORDER BY frame) <> trk THEN 1 ELSE 0 END AS s FROM mt),
z AS (SELECT scene, count(*) AS tp, CAST(sum(s) AS BIGINT) AS idsw FROM sw GROUP BY 1)
SELECT cnt.scene, coalesce(tp, 0) AS tp, gt_dets - coalesce(tp, 0) AS fn, dets - coalesce(tp, 0) AS fp, coalesce(idsw, 0) AS idsw, CASE WHEN dets = 0 OR gt_dets = 0 THEN 0 ELSE round_even((coalesce(tp, 0) - (dets - coalesce(tp, 0)) - coalesce(idsw, 0)) / CAST(greatest(1, gt_dets) AS DOUBLE), 6) END AS mota FROM cnt LEFT JOIN z ON cnt.scene = z.scene""")
def clear_gated(spark: SparkSession, d: str) -> DataFrame:
    g, t = evaluation(spark, d)
    return _rounded(E.clear(g, t, E.similarity(g, t)), ["mota"])


@query()
def hota_contested(spark: SparkSession, d: str) -> DataFrame:
    return E.hota(*evaluation(spark, d, contested=True))


@query()
def identity_contested(spark: SparkSession, d: str) -> DataFrame:
    return E.identity(*evaluation(spark, d, contested=True))


@query()
def clear_contested(spark: SparkSession, d: str) -> DataFrame:
    return E.clear(*evaluation(spark, d, contested=True))


BOX = "global_id % 360 AS l, CAST(wy AS BIGINT) % 288 AS t, 20 + global_id % 11 AS w, 40 + global_id % 17 AS h"


@query(f"""WITH {DET}, b AS (SELECT ordinal, camera, CAST(floor(frame/60.0) AS BIGINT) AS slot, {BOX} FROM det), p AS (SELECT x.ordinal AS a, y.ordinal AS b,
greatest(least(x.l + x.w, y.l + y.w) - greatest(x.l, y.l), 0) * greatest(least(x.t + x.h, y.t + y.h) - greatest(x.t, y.t), 0) AS i, x.w * x.h + y.w * y.h AS u FROM b x JOIN b y ON x.camera = y.camera AND x.slot = y.slot AND x.ordinal < y.ordinal)
SELECT a, b, round_even(i / CAST(u - i AS DOUBLE), 6) AS iou FROM p WHERE i > 0""")
def iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("wy").cast("long")
    b = detections(spark, d).select("ordinal", "camera", F.floor(F.col("frame") / 60).alias("slot"), (F.col("global_id") % 360).alias("l"), (k % 288).alias("t"), (20 + F.col("global_id") % 11).alias("w"), (40 + F.col("global_id") % 17).alias("h"))
    p = E.meeting_boxes(b, ["camera", "slot"], "ordinal")
    return p.select("a", "b", X.rint(X.iou([F.col(c) for c in "ltwh"], [F.col(c + "2") for c in "ltwh"]), 6).alias("iou")).where("iou > 0")


@query(f"WITH {DET}, r AS (SELECT *, row_number() OVER (PARTITION BY camera, frame, global_id ORDER BY ordinal) AS k FROM det) SELECT camera, frame, global_id, ordinal FROM r WHERE k = 1")
def dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    first = Window.partitionBy("camera", "frame", "global_id").orderBy("ordinal")
    return detections(spark, d).withColumn("k", F.row_number().over(first)).where("k = 1").select("camera", "frame", "global_id", "ordinal")


@query(f"WITH {DET}, r AS (SELECT *, row_number() OVER (PARTITION BY global_id, camera ORDER BY frame, ordinal) - 1 AS i, count(*) OVER (PARTITION BY global_id, camera) AS n FROM det) SELECT global_id, camera, ordinal FROM r WHERE n <= 5 OR list_contains([CAST(round_even(k * (n - 1) / 4.0, 0) AS BIGINT) FOR k IN range(5)], i)")
def evenly_spaced_sample(spark: SparkSession, d: str) -> DataFrame:
    own = Window.partitionBy("global_id", "camera")
    r = detections(spark, d).withColumn("i", F.row_number().over(own.orderBy("frame", "ordinal")) - 1).withColumn("n", F.count("*").over(own))
    places = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.rint(k * (F.col("n") - 1) / 4.0).cast("int"))
    return r.where((F.col("n") <= 5) | F.array_contains(places, F.col("i"))).select("global_id", "camera", "ordinal")


@query(f"WITH {POS} SELECT global_id, camera, frame FROM pos WHERE place % {STRIDE} = 0")
def stride_sample(spark: SparkSession, d: str) -> DataFrame:
    return proximity.positions(detections(spark, d), GAP).where(F.col("place") % STRIDE == 0).select("global_id", "camera", "frame")


@query(f"WITH {DET}, m AS (SELECT camera, wx, max(wy) AS wy FROM det GROUP BY 1, 2), p AS (SELECT *, max(wy) OVER (PARTITION BY camera ORDER BY wx DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM m) SELECT camera, wx, wy FROM p WHERE above IS NULL OR wy > above")
def pareto_front(spark: SparkSession, d: str) -> DataFrame:
    return scans.front(detections(spark, d), ["camera"], "wx", "wy")


def _world_sql() -> str:
    (a, b, c), (d, e, f), (g, i, j) = HOMOGRAPHY
    rows = [[e * j - f * i, c * i - b * j, b * f - c * e], [f * g - d * j, a * j - c * g, c * d - a * f], [d * i - e * g, b * g - a * i, a * e - b * d]]
    x, y, w = (f"(px * {r[0]!r}::DOUBLE + py * {r[1]!r}::DOUBLE + {r[2]!r}::DOUBLE)" for r in rows)
    return f"round_even({x} / {w}, 3) AS xworld, round_even({y} / {w}, 3) AS yworld"


@query(f"WITH {DET}, b AS (SELECT ordinal, {BOX} FROM det), p AS (SELECT ordinal, l + w / 2.0 AS px, t + h AS py FROM b) SELECT ordinal, {_world_sql()} FROM p")
def ground_point_world(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("wy").cast("long")
    p = detections(spark, d).select("ordinal", (F.col("global_id") % 360 + (20 + F.col("global_id") % 11) / 2.0).alias("px"), (k % 288 + 40 + F.col("global_id") % 17).cast("double").alias("py"))
    x, y = X.to_world(HOMOGRAPHY, F.col("px"), F.col("py"))
    return p.select("ordinal", X.rint(x, 3).alias("xworld"), X.rint(y, 3).alias("yworld"))


@query(f"""WITH {SIGHT}, o AS (SELECT *, max(CASE WHEN num_detections >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY global_id) AS any_reliable FROM s) SELECT global_id, camera, seg_idx, num_detections FROM o WHERE num_detections >= 3 OR any_reliable = 0""")
def reliable_or_all(spark: SparkSession, d: str) -> DataFrame:
    return tracks.reliable_or_all(_sightings(spark, d), RELIABLE).select("global_id", "camera", "seg_idx", "num_detections")


@query("SELECT vec_id * 4 AS a, vec_id * 4 + 1 AS b FROM embeddings")
def match_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Tracks of two cameras, matched one to one; the stand-in's true partner is the copy of the same vector."""
    return identity.best_pairs(track_features(spark, d).drop("vec_id"), False, 0.6).select("a", "b")


@query("SELECT vec_id * 4 + c AS track_id, vec_id * 4 AS root FROM embeddings, range(2) r(c)")
def stitched_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Fragments of one camera, joined round by round; each stand-in vector has two fragments that do not overlap in time."""
    t = track_features(spark, d).drop("vec_id").withColumn("camera", F.lit(0))
    return identity.stitched(t).select("track_id", "root")


@query("SELECT c AS camera, vec_id * 4 + c AS track_id, dense_rank() OVER (ORDER BY vec_id) - 1 AS global_id FROM embeddings, range(2) r(c)")
def global_identities(spark: SparkSession, d: str) -> DataFrame:
    """Dense ids over two cameras: stitching, matching of the groups' representatives, and merges that keep one camera's tracks apart."""
    return identity.resolved(track_features(spark, d).drop("vec_id"))


@query("SELECT count(*) AS clusters, count(*) AS spanning FROM embeddings")
def cluster_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many identities there are over two cameras, and how many of them are on both: here each has a copy on either."""
    return identity.cluster_counts(global_identities(spark, d))


@query("""WITH p AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b, list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS sim FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY label, a ORDER BY sim DESC) AS k FROM p) SELECT label, a, round_even(avg(sim), 6) AS sim FROM k WHERE k <= 3 GROUP BY 1, 2""")
def group_similarity(spark: SparkSession, d: str) -> DataFrame:
    """The mean of the three highest similarities of each vector with the later ones of its label."""
    e = table(spark, d, "embeddings").select("label", F.col("vec_id").alias("a"), "embedding")
    p = similar.nearest_later(e, "label", "a", "embedding", 3)
    return identity.group_similarity(p, ["label", "a"]).withColumn("sim", X.rint(F.col("sim"), 6))


@query(f"""WITH {DET}, b AS (SELECT camera, global_id AS track_id, frame, wx, wy, CAST(global_id % 360 AS DOUBLE) + wy AS px_x, wx AS px_y, row_number() OVER (PARTITION BY camera, global_id, frame ORDER BY ordinal) AS k FROM det)
SELECT camera, track_id, median(wx) AS world_x, median(wy) AS world_y, min(frame) AS first_frame, max(frame) AS last_frame, {', '.join(f"{f}({c}, frame) AS {n}_{c}" for n, f in (("first", "min_by"), ("last", "max_by")) for c in ("px_x", "px_y", "wx", "wy"))} FROM b WHERE k = 1 GROUP BY 1, 2""")
def track_positions(spark: SparkSession, d: str) -> DataFrame:
    """Median position, first and last pixel and world position of each track."""
    b = tracks.first_of_frame(detections(spark, d), ["camera", "global_id", "frame"])
    b = b.select("camera", F.col("global_id").alias("track_id"), "frame", "wx", "wy", (F.col("global_id") % 360 + F.col("wy")).cast("double").alias("px_x"), F.col("wx").alias("px_y"))
    return tracks.track_positions(b)


@query("""WITH v AS (SELECT CAST(label AS VARCHAR) AS camera, vec_id % 7 AS track_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), u AS (SELECT camera, track_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM v),
x AS (SELECT camera, track_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM u), m AS (SELECT camera, track_id, i, avg(x) AS x FROM x GROUP BY 1, 2, 3), n AS (SELECT camera, track_id, sqrt(sum(x * x)) AS n FROM m GROUP BY 1, 2)
SELECT m.camera, m.track_id, i - 1 AS place, round_even(x / n, 6) AS x FROM m JOIN n ON m.camera = n.camera AND m.track_id = n.track_id""")
def track_embeddings(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("label").cast("string").alias("camera"), (F.col("vec_id") % 7).alias("track_id"), F.col("embedding").alias("vector"))
    return tracks.track_embeddings(e).select("camera", "track_id", F.posexplode("embedding").alias("place", "x")).withColumn("x", X.rint(F.col("x"), 6)).withColumn("place", F.col("place").cast("long"))


CLEAR_RATES = [*E.CLEAR_RATES, "motp_sum"]


def _clear(base: str) -> str:
    """The counters per scene as c; one with an empty side keeps its misses or false alarms and, without a tracker, all ids in ml."""
    return f"""WITH {base}, mt AS (SELECT * FROM sim WHERE sim >= 0.5 - 2.220446049250313e-16),
bf AS (SELECT scene, frame, dense_rank() OVER (PARTITION BY scene ORDER BY frame) AS k FROM (SELECT scene, frame FROM g INTERSECT SELECT scene, frame FROM t)),
sw AS (SELECT mt.*, CASE WHEN lag(trk) OVER w <> trk THEN 1 ELSE 0 END AS s, CASE WHEN k - lag(k) OVER w > 1 THEN 1 ELSE 0 END AS br FROM mt JOIN bf ON mt.scene = bf.scene AND mt.frame = bf.frame WINDOW w AS (PARTITION BY mt.scene, gt ORDER BY mt.frame)),
z AS (SELECT scene, count(*) AS tp, sum(s) AS idsw, sum(br) AS frag, sum(sim) AS motp_sum FROM sw GROUP BY 1),
share AS (SELECT n.scene, n.gt, coalesce(h, 0) / CAST(n AS DOUBLE) AS r FROM (SELECT scene, gt, count(*) AS n FROM g GROUP BY 1, 2) n LEFT JOIN (SELECT scene, gt, count(*) AS h FROM mt GROUP BY 1, 2) m ON n.scene = m.scene AND n.gt = m.gt),
kept AS (SELECT scene, count(*) FILTER (WHERE r > 0.8) AS mt, count(*) FILTER (WHERE r >= 0.2 AND r <= 0.8) AS pt, count(*) FILTER (WHERE r < 0.2) AS ml FROM share GROUP BY 1),
fr AS (SELECT scene, max(frame) AS frames FROM (SELECT scene, frame FROM g UNION SELECT scene, frame FROM t) GROUP BY 1),
c AS (SELECT cnt.scene, dets = 0 OR gt_dets = 0 AS lone, CASE WHEN dets = 0 OR gt_dets = 0 THEN 0 ELSE frames END AS frames, CAST(coalesce(tp, 0) AS DOUBLE) AS tp, CAST(gt_dets - coalesce(tp, 0) AS DOUBLE) AS fn, CAST(dets - coalesce(tp, 0) AS DOUBLE) AS fp, CAST(coalesce(idsw, 0) AS DOUBLE) AS idsw, coalesce(frag, 0) AS frag, coalesce(mt, 0) AS mt, coalesce(pt, 0) AS pt, CASE WHEN dets = 0 THEN gt_ids ELSE coalesce(ml, 0) END AS ml, coalesce(motp_sum, 0) AS motp_sum
  FROM cnt JOIN fr ON cnt.scene = fr.scene LEFT JOIN z ON cnt.scene = z.scene LEFT JOIN kept ON cnt.scene = kept.scene)"""


CLEAR_COUNTS = "CAST(frames AS BIGINT) AS frames, CAST(tp AS BIGINT) AS tp, CAST(fn AS BIGINT) AS fn, CAST(fp AS BIGINT) AS fp, CAST(idsw AS BIGINT) AS idsw, CAST(frag AS BIGINT) AS frag, CAST(mt AS BIGINT) AS mt, CAST(pt AS BIGINT) AS pt, CAST(ml AS BIGINT) AS ml, round_even(motp_sum, 6) AS motp_sum"
RATES = {
    "mtr": "mt / CAST(greatest(1, mt + pt + ml) AS DOUBLE)", "ptr": "pt / CAST(greatest(1, mt + pt + ml) AS DOUBLE)", "mlr": "ml / CAST(greatest(1, mt + pt + ml) AS DOUBLE)", "motp": "motp_sum / greatest(1, tp)",
    "clr_re": "tp / greatest(1, tp + fn)", "clr_pr": "tp / greatest(1, tp + fp)", "moda": "(tp - fp) / greatest(1, tp + fn)", "mota": "(tp - fp - idsw) / greatest(1, tp + fn)",
    "motal": "(tp - fp - CASE WHEN idsw > 0 THEN log10(greatest(1, idsw)) ELSE 0 END) / greatest(1, tp + fn)", "smota": "(motp_sum - fp - idsw) / greatest(1, tp + fn)", "clr_f1": "tp / greatest(1, tp + 0.5 * fn + 0.5 * fp)", "fp_per_frame": "fp / greatest(1, frames)",
}
CLEAR_SHOWN = ", ".join(f"CASE WHEN lone THEN {1 if n == 'mlr' else 0} ELSE round_even({x}, 6) END AS {n}" for n, x in RATES.items())


@query(f"{_clear(GATED)} SELECT scene, {CLEAR_COUNTS}, {CLEAR_SHOWN} FROM c")
def clear_fields_gated(spark: SparkSession, d: str) -> DataFrame:
    g, t = evaluation(spark, d)
    return _rounded(E.clear_fields(g, t, E.similarity(g, t)), CLEAR_RATES)


@query(f"{_clear(LONE)} SELECT scene, {CLEAR_COUNTS}, {CLEAR_SHOWN} FROM c")
def clear_fields_one_sided(spark: SparkSession, d: str) -> DataFrame:
    g, t = _lone(spark, d)
    return _rounded(E.clear_fields(g, t, E.similarity(g, t)), CLEAR_RATES)


SUMS = ", ".join(f"CAST(sum({x}) AS DOUBLE) AS {x}" for x in E.CLEAR_COUNTS)


@query(f"{_clear(LONE)}, s AS (SELECT false AS lone, {SUMS} FROM c) SELECT {CLEAR_COUNTS}, {CLEAR_SHOWN} FROM s")
def clear_combined(spark: SparkSession, d: str) -> DataFrame:
    """All scenes as one, those with an empty side among them."""
    g, t = _lone(spark, d)
    return _rounded(E.combined_clear(E.clear_fields(g, t, E.similarity(g, t)), []), CLEAR_RATES)


COMBINED = ["det_re", "det_pr", "det_a", "ass_a", "ass_re", "ass_pr", "loc_a", "hota", "owta"]


def _combined(base: str, by: str = "") -> str:
    """The scenes of base within `by` as x."""
    weigh = lambda c: f"sum({c} * tp) / greatest(1, sum(tp)) AS {c}"
    return f"""WITH {base}, c AS (SELECT {by} alpha, CAST(sum(tp) AS DOUBLE) AS tp, CAST(sum(fn) AS DOUBLE) AS fn, CAST(sum(fp) AS DOUBLE) AS fp, {weigh('ass_a')}, {weigh('ass_re')}, {weigh('ass_pr')}, greatest(1e-10, sum(loc_a * tp)) / greatest(1e-10, sum(tp)) AS loc_a FROM h GROUP BY ALL),
d AS (SELECT *, tp / greatest(1, tp + fn + fp) AS det_a, tp / greatest(1, tp + fn) AS det_re, tp / greatest(1, tp + fp) AS det_pr FROM c), x AS (SELECT *, sqrt(det_a * ass_a) AS hota, sqrt(det_re * ass_a) AS owta FROM d)"""


COMBINED_SHOWN = "alpha, CAST(tp AS BIGINT) AS tp, CAST(fn AS BIGINT) AS fn, CAST(fp AS BIGINT) AS fp, " + ", ".join(f"round_even({c}, 6) AS {c}" for c in COMBINED)


@query(f"{_combined(_hota(LONE))} SELECT {COMBINED_SHOWN} FROM x")
def hota_combined(spark: SparkSession, d: str) -> DataFrame:
    """All scenes as one, those with an empty side among them."""
    return _rounded(E.combined_sequences(E.hota(*_lone(spark, d)), []), COMBINED)


#: Stand-in classes: scenes of odd and even number.
CLASS_SQL = "CASE WHEN CAST(right(scene, 1) AS INT) % 2 = 1 THEN 'odd' ELSE 'even' END"


def _classes(df: DataFrame) -> DataFrame:
    return df.withColumn("class", F.when(F.substring("scene", -1, 1).cast("int") % 2 == 1, "odd").otherwise("even"))


@query(f"""{_combined(HOTA, f"{CLASS_SQL} AS class, ")} SELECT alpha, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(fp) AS BIGINT) AS fp, {', '.join(f"round_even(avg({c}), 6) AS {c}" for c in COMBINED)} FROM x GROUP BY 1""")
def hota_class_average(spark: SparkSession, d: str) -> DataFrame:
    """Means over two classes of their combined scenes."""
    per = E.combined_sequences(_classes(E.hota(*evaluation(spark, d))), ["class"])
    return _rounded(E.class_average(per), COMBINED)


@query(f"""{_combined(HOTA, "'all' AS parent, ")} SELECT parent, {COMBINED_SHOWN} FROM x""")
def hota_super_category(spark: SparkSession, d: str) -> DataFrame:
    """The average over detections of the classes of a super-category."""
    parents = spark.createDataFrame([("odd", "all"), ("even", "all")], "class string, parent string")
    per = E.combined_sequences(_classes(E.hota(*evaluation(spark, d))), ["class"])
    return _rounded(E.combined_sequences(E.super_categories(per, parents), ["parent"]), COMBINED)


@query(f"""{_clear(GATED)}, s AS (SELECT {CLASS_SQL} AS class, false AS lone, {SUMS} FROM c GROUP BY 1), r AS (SELECT {CLEAR_COUNTS}, {', '.join(f"{x} AS {n}" for n, x in RATES.items())} FROM s)
SELECT {', '.join(f"CAST(sum({x}) AS BIGINT) AS {x}" for x in E.CLEAR_COUNTS if x != "motp_sum")}, {', '.join(f"round_even(avg({x}), 6) AS {x}" for x in [*RATES, "motp_sum"])} FROM r""")
def clear_class_average(spark: SparkSession, d: str) -> DataFrame:
    g, t = evaluation(spark, d)
    per = E.combined_clear(_classes(E.clear_fields(g, t, E.similarity(g, t))), ["class"])
    return _rounded(E.class_average_clear(per), CLEAR_RATES)


@query(f"""{_identity(GATED)}, s AS (SELECT {CLASS_SQL} AS class, CAST(sum(idtp) AS BIGINT) AS idtp, CAST(sum(idfn) AS BIGINT) AS idfn, CAST(sum(idfp) AS BIGINT) AS idfp FROM i GROUP BY 1),
r AS (SELECT idtp, idfn, idfp, idtp / greatest(1.0::DOUBLE, idtp + idfn) AS idr, idtp / greatest(1.0::DOUBLE, idtp + idfp) AS idp, idtp / greatest(1.0::DOUBLE, idtp + 0.5::DOUBLE * idfp + 0.5::DOUBLE * idfn) AS idf1 FROM s)
SELECT CAST(sum(idtp) AS BIGINT) AS idtp, CAST(sum(idfn) AS BIGINT) AS idfn, CAST(sum(idfp) AS BIGINT) AS idfp, round_even(avg(idr), 6) AS idr, round_even(avg(idp), 6) AS idp, round_even(avg(idf1), 6) AS idf1 FROM r""")
def identity_class_average(spark: SparkSession, d: str) -> DataFrame:
    g, t = evaluation(spark, d)
    per = E.combined_identity(_classes(E.identity(g, t, E.similarity(g, t))), ["class"])
    return _rounded(E.class_average_identity(per), E.ID_RATES)


@query(f"WITH {GATED}, fr AS (SELECT scene, max(frame) AS frames FROM (SELECT scene, frame FROM g UNION SELECT scene, frame FROM t) GROUP BY 1) SELECT cnt.*, frames FROM cnt LEFT JOIN fr ON cnt.scene = fr.scene")
def count_fields(spark: SparkSession, d: str) -> DataFrame:
    return E.count_fields(*evaluation(spark, d))


@query(f"WITH {GATED} SELECT CAST(sum(dets) AS BIGINT) AS dets, CAST(sum(gt_dets) AS BIGINT) AS gt_dets, CAST(sum(ids) AS BIGINT) AS ids, CAST(sum(gt_ids) AS BIGINT) AS gt_ids FROM cnt")
def count_combined(spark: SparkSession, d: str) -> DataFrame:
    return E.combined_counts(E.counts(*evaluation(spark, d)), [])


@query(f"""WITH {HOTA}, w AS (SELECT scene, {', '.join(f"max(sqrt(det_a * ass_a)) FILTER (WHERE round(alpha * 100) = {5 * i}) AS v{5 * i}" for i in range(1, 20))}, avg(sqrt(det_a * ass_a)) AS auc FROM h GROUP BY 1)
SELECT scene, {', '.join(f"round_even(v{5 * i}, 6) AS hota___{5 * i}" for i in range(1, 20))}, round_even(auc, 6) AS "hota___AUC" FROM w""")
def hota_detailed(spark: SparkSession, d: str) -> DataFrame:
    wide = E.detailed(E.hota(*evaluation(spark, d)), "hota")
    return _rounded(wide, wide.columns[1:])


@query(f"WITH {HOTA} SELECT scene, round_even(sqrt(det_a * ass_a), 6) AS hota_0, round_even(loc_a, 6) AS loc_a_0, round_even(sqrt(det_a * ass_a) * loc_a, 6) AS hota_loc_a_0 FROM h WHERE round(alpha * 100) = 5")
def hota_first_threshold(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(E.at_first_threshold(E.hota(*evaluation(spark, d))), ["hota_0", "loc_a_0", "hota_loc_a_0"])


@query("""WITH c AS (SELECT label AS entity, vec_id AS idx, CAST(embedding AS DOUBLE[]) AS v, vec_id % 10 / 10.0::DOUBLE AS confidence, vec_id % 5 = 1 AS loops, vec_id % 5 <> 0 AS says FROM embeddings),
a AS (SELECT entity, count(*) AS every FROM c GROUP BY 1), s AS (SELECT *, count(*) OVER (PARTITION BY entity) AS sound, sum(CASE WHEN says THEN 1 ELSE 0 END) OVER (PARTITION BY entity) AS people FROM c WHERE NOT loops AND confidence >= 0.3),
e AS (SELECT s.*, sound < every AS excluded FROM s JOIN a ON a.entity = s.entity WHERE says OR 2 * people <= sound), x AS (SELECT entity, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e),
m AS (SELECT entity, i, sum(x) AS x FROM x GROUP BY 1, 2), t AS (SELECT entity, list(x ORDER BY i) AS total FROM m GROUP BY 1), n AS (SELECT entity, count(*) AS n, bool_or(excluded) AS excluded FROM e GROUP BY 1),
r AS (SELECT e.entity, idx, total, row_number() OVER (PARTITION BY e.entity ORDER BY list_inner_product(v, total) DESC, idx) AS k FROM e JOIN t ON e.entity = t.entity)
SELECT r.entity, idx, n, CASE WHEN n = 1 THEN CASE WHEN excluded THEN 0.0 ELSE 1.0 END ELSE round_even((list_inner_product(total, total) - n) / (n * (n - 1)), 3) END AS agreement FROM r JOIN n ON r.entity = n.entity WHERE k = 1""")
def consensus_by_label(spark: SparkSession, d: str) -> DataFrame:
    """Captions that loop, that are unsure and that speak of no person stand among the others of each label."""
    said = F.when(F.col("vec_id") % 5 == 1, "bald bald bald man").when(F.col("vec_id") % 5 == 0, "a small bird").otherwise("a man walks")
    e = table(spark, d, "embeddings").select(F.col("label").alias("entity"), F.col("vec_id").alias("idx"), said.alias("caption"), (F.col("vec_id") % 10 / 10.0).alias("confidence"), F.col("embedding").alias("vector"))
    return captions.consensus(captions.candidates(e)).select("entity", "idx", "n", X.rint(F.col("agreement"), 3).alias("agreement"))


@query(f"""WITH {DET}, b AS (SELECT *, CAST(wy AS BIGINT) % 5 = 0 AS touches FROM det), t AS (SELECT DISTINCT global_id, camera, frame + 7 AS target FROM det WHERE ordinal % 3 = 0),
n AS (SELECT t.*, b.frame, b.touches, b.ordinal, row_number() OVER (PARTITION BY t.global_id, t.camera, target ORDER BY touches, abs(b.frame - target), b.frame < target, b.ordinal) AS k FROM t JOIN b ON t.global_id = b.global_id AND t.camera = b.camera AND abs(b.frame - target) <= 600),
f AS (SELECT *, row_number() OVER (PARTITION BY global_id, camera ORDER BY target DESC) AS z FROM n WHERE k = 1) SELECT global_id, camera, target, frame, touches, ordinal FROM f WHERE z = 1""")
def nearest_box_of_last_target(spark: SparkSession, d: str) -> DataFrame:
    b = detections(spark, d)
    targets = b.where("ordinal % 3 = 0").select("global_id", "camera", (F.col("frame") + 7).alias("target"))
    boxes = b.select("global_id", "camera", "frame", "ordinal", (F.col("wy").cast("long") % 5 == 0).alias("touches"))
    return sampling.last_target(sampling.nearest_boxes(targets, boxes, 600)).select("global_id", "camera", "target", "frame", "touches", "ordinal")


@query(f"""WITH {SEG}, i AS (SELECT global_id, camera, CAST(seg_idx AS BIGINT) AS seg_idx, frame, row_number() OVER (PARTITION BY global_id, camera, seg_idx ORDER BY frame, ordinal) - 1 AS i, count(*) OVER (PARTITION BY global_id, camera, seg_idx) AS n FROM seg),
r AS (SELECT *, row_number() OVER (PARTITION BY global_id ORDER BY n DESC, camera, seg_idx) AS k FROM (SELECT DISTINCT global_id, camera, seg_idx, n FROM i))
SELECT i.global_id, i.camera, i.seg_idx, min(frame) AS first, max(frame) AS last FROM i JOIN r ON i.global_id = r.global_id AND i.camera = r.camera AND i.seg_idx = r.seg_idx WHERE k <= 2 AND i.i >= i.n // 2 AND i.i < least(i.n // 2 + 2, i.n) GROUP BY 1, 2, 3""")
def clip_windows(spark: SparkSession, d: str) -> DataFrame:
    return sampling.clip_windows(sightings.segmented(detections(spark, d), GAP), 2, 2)


@query(f"""WITH {DET}, p AS (SELECT *, ordinal % 2 AS side, CAST(floor(frame/60.0) AS BIGINT) AS slot FROM det), n AS (SELECT a.side, a.ordinal, min(sqrt((a.wx-b.wx)*(a.wx-b.wx)+(a.wy-b.wy)*(a.wy-b.wy))) AS d FROM p a JOIN p b ON a.side = b.side AND a.slot = b.slot AND a.camera <> b.camera GROUP BY 1, 2)
SELECT side, count(*) AS points, round_even(avg(d), 6) AS mean_nearest FROM n GROUP BY 1""")
def cross_camera_agreement(spark: SparkSession, d: str) -> DataFrame:
    p = detections(spark, d).select(F.col("ordinal").alias("id"), (F.col("ordinal") % 2).alias("side"), F.floor(F.col("frame") / 60).alias("slot"), "camera", "wx", "wy")
    return sampling.cross_camera_agreement(p, ["side"], ["slot"]).withColumn("mean_nearest", X.rint(F.col("mean_nearest"), 6))


@query(f"WITH {EVERY_PAIR}, k AS (SELECT *, row_number() OVER (PARTITION BY target, match_type ORDER BY distance_m, other) AS k FROM m) SELECT target, match_type, other, distance_m FROM k WHERE k <= 3")
def proximity_topk_by_type(spark: SparkSession, d: str) -> DataFrame:
    """The three nearest of each entity and kind of match, of all positions of both sides."""
    place = F.row_number().over(Window.partitionBy("target", "match_type").orderBy("distance_m", "other"))
    return _matches(spark, d, 3, stride=1).withColumn("k", place).where("k <= 3").select("target", "match_type", "other", "distance_m")


def _lab_sql() -> str:
    line = lambda c: f"CASE WHEN {c} / 255.0::DOUBLE > 0.04045 THEN pow(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) ELSE {c} / 255.0::DOUBLE / 12.92 END AS l{c}"
    f = lambda t: f"CASE WHEN {t} > 0.008856 THEN cbrt({t}) ELSE 7.787 * {t} + 16.0::DOUBLE / 116.0::DOUBLE END"
    named = ", ".join(f"('{n}', {i}, {r}, {g}, {b})" for i, (n, (r, g, b)) in enumerate(colours.PALETTE.items()))
    return f"""px AS (SELECT CAST(NULL AS VARCHAR) AS name, event_id AS id, CAST(event_id * 37 % 256 AS DOUBLE) AS r, CAST(event_id * 91 % 256 AS DOUBLE) AS g, CAST(event_id * 53 % 256 AS DOUBLE) AS b FROM events
UNION ALL SELECT n, i, r, g, b FROM (VALUES {named}) v(n, i, r, g, b)), li AS (SELECT name, id, {line('r')}, {line('g')}, {line('b')} FROM px),
xyz AS (SELECT name, id, (lr * 0.412453 + lg * 0.357580 + lb * 0.180423) / 0.950456 AS x, lr * 0.212671 + lg * 0.715160 + lb * 0.072169 AS y, (lr * 0.019334 + lg * 0.119193 + lb * 0.950227) / 1.088754 AS z FROM li),
lab AS (SELECT name, id, round_even((CASE WHEN y > 0.008856 THEN 116.0 * cbrt(y) - 16.0 ELSE 903.3 * y END) * 2.55, 0) AS l, round_even(500.0 * ({f('x')} - {f('y')}) + 128.0, 0) AS a, round_even(200.0 * ({f('y')} - {f('z')}) + 128.0, 0) AS b FROM xyz)"""


@query(f"""WITH {_lab_sql()}, k AS (SELECT p.id, n.name, row_number() OVER (PARTITION BY p.id ORDER BY (p.l-n.l)*(p.l-n.l)+(p.a-n.a)*(p.a-n.a)+(p.b-n.b)*(p.b-n.b), n.id) AS k FROM lab p JOIN lab n ON p.name IS NULL AND n.name IS NOT NULL) SELECT id, name AS colour FROM k WHERE k = 1""")
def nearest_colours(spark: SparkSession, d: str) -> DataFrame:
    value = lambda m: (F.col("event_id") * m % 256).cast("double")
    return table(spark, d, "events").select(F.col("event_id").alias("id"), colours.nearest_colour(value(37), value(91), value(53)).alias("colour"))


def _distortion_sql() -> str:
    """The same closed forms, step by step: rotation, homography, undistorted pixels, ground points by the adjugate."""
    v = "xyz"
    skew = {("x", "y"): "-z", ("x", "z"): "y", ("y", "x"): "z", ("y", "z"): "-x", ("z", "x"): "-y", ("z", "y"): "x"}
    cell = lambda i, j: f"({'c' if i == j else '0'} + (1 - c) * {i} * {j} + s * ({skew.get((i, j), '0')})) AS r{i}{j}"
    h = {(0, j): f"800 * {x} + 320 * {z}" for j, (x, z) in enumerate((("rxx", "rzx"), ("rxy", "rzy"), ("100", "t")))} | {(1, j): f"820 * {y} + 240 * {z}" for j, (y, z) in enumerate((("ryx", "rzx"), ("ryy", "rzy"), ("200", "t")))} | {(2, 0): "rzx", (2, 1): "rzy", (2, 2): "t"}
    adj = [["h11*h22-h12*h21", "h02*h21-h01*h22", "h01*h12-h02*h11"], ["h12*h20-h10*h22", "h00*h22-h02*h20", "h02*h10-h00*h12"], ["h10*h21-h11*h20", "h01*h20-h00*h21", "h00*h11-h01*h10"]]
    ground = lambda x, y, name: ", ".join(f"({x} * ({a}) + {y} * ({b}) + ({c})) AS {name}{i}" for i, (a, b, c) in enumerate(adj))
    steps = ", ".join(f"q{n} AS (SELECT *, 1 / (1 + k * r2 * s{n - 1} * s{n - 1}) AS s{n} FROM q{n - 1})" for n in range(1, 6))
    return f"""WITH n AS (SELECT n_nationkey AS camera, 1.8::DOUBLE + n_nationkey * 0.01::DOUBLE AS rx, 0.1::DOUBLE AS ry, n_nationkey * 0.002::DOUBLE AS rz, 5000.0::DOUBLE + n_nationkey AS t, n_nationkey * 1e-4::DOUBLE AS k FROM nation),
a AS (SELECT *, sqrt(rx*rx + ry*ry + rz*rz) AS angle FROM n), u AS (SELECT *, rx / angle AS x, ry / angle AS y, rz / angle AS z, cos(angle) AS c, sin(angle) AS s FROM a),
m AS (SELECT camera, k, t, {', '.join(cell(i, j) for i in v for j in v)} FROM u), h AS (SELECT camera, k, {', '.join(f"{e} AS h{i}{j}" for (i, j), e in h.items())} FROM m),
g AS (SELECT h.*, 640 * (0.1::DOUBLE + 0.8::DOUBLE * i / 4) AS px, 480 * (0.1::DOUBLE + 0.8::DOUBLE * j / 4) AS py FROM h, range(5) x(i), range(5) y(j)),
q0 AS (SELECT *, ((px - 320) * 0.01::DOUBLE) * ((px - 320) * 0.01::DOUBLE) + ((py - 240) * 0.01::DOUBLE) * ((py - 240) * 0.01::DOUBLE) AS r2, 1.0::DOUBLE AS s0 FROM g), {steps},
w AS (SELECT *, (px - 320) * s5 + 320 AS ux, (py - 240) * s5 + 240 AS uy FROM q5), e AS (SELECT camera, {ground('px', 'py', 'p')}, {ground('ux', 'uy', 'd')} FROM w)
SELECT camera, round_even(max(sqrt((p0/p2 - d0/d2) * (p0/p2 - d0/d2) + (p1/p2 - d1/d2) * (p1/p2 - d1/d2))), 4) AS impact FROM e GROUP BY 1"""


@query(_distortion_sql())
def distortion_impact(spark: SparkSession, d: str) -> DataFrame:
    """The largest shift on the ground by radial distortion over a grid of image points, a stand-in camera a nation."""
    key = F.col("n_nationkey")
    h = calibration.ground_homography(F.lit(800.0), F.lit(820.0), F.lit(320.0), F.lit(240.0), calibration.rotation(1.8 + key * 0.01, F.lit(0.1), key * 0.002), [F.lit(100.0), F.lit(200.0), 5000.0 + key])
    p = table(spark, d, "nation").select(key.alias("camera"), F.array(*[F.array(*row) for row in h]).alias("h"), (key * 1e-4).alias("k"), F.explode(calibration.grid(F.lit(640.0), F.lit(480.0))).alias("p"))
    shift = calibration.distortion_shift(calibration.cells(F.col("h")), F.col("p.x"), F.col("p.y"), F.lit(320.0), F.lit(240.0), F.lit(0.01), F.lit(0.01), F.col("k"))
    return p.groupBy("camera").agg(X.rint(F.max(shift), 4).alias("impact"))
