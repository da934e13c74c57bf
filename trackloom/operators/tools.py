"""The thirteen questions that can be asked of an event graph, each a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.functions.expressions import dot, mentions, mmss, normalised, rint, seconds
from trackloom.operators import proximity
from trackloom.operators.sightings import sightings

# Name -> parameters of each tool with their types and, where they may be left out, their defaults.
_FOUND = {"query_vector": ("array", None), "min_similarity": ("number", 0.7), "top_k": ("integer", 20)}
_NEAR = {"max_distance_m": ("number", 2.0), "max_gap_sec": ("number", 1.0)}
TOOLS: dict[str, dict[str, tuple]] = {
    "search_by_appearance": _FOUND,
    "search_by_action": _FOUND,
    "get_entity_action": {"global_id": ("integer", None)},
    "get_entity_timeline": {"global_id": ("integer", None)},
    "find_entities_in_camera": {"camera_id": ("string", None), "start_time_sec": ("number", ...), "end_time_sec": ("number", ...)},
    "check_entities_cooccur": {"global_id_a": ("integer", None), "global_id_b": ("integer", None), "max_gap_sec": ("number", 5.0)},
    "find_nearby_entities": {"global_id": ("integer", None), **_NEAR, "top_k": ("integer", 1000)},
    "count_nearby_entities": {"global_id": ("integer", None), **_NEAR},
    "find_nearby_entities_by_description": {"query_vector": ("array", None), "min_similarity": ("number", 0.7), **_NEAR, "top_k": ("integer", 1000)},
    "list_multi_camera_entities": {},
    "list_low_quality_caption_entities": {},
    "list_human_captioned_entities": {},
    "rank_entities_by_interaction_count": {**_NEAR, "top_k": ("integer", 10)},
}
SCHEMAS = {name: list(parameters) for name, parameters in TOOLS.items()}
_PYTHON = {"integer": int, "number": (int, float), "string": str, "array": (list, tuple)}


def tool_schemas() -> list[dict]:
    """The tools as JSON schemas for clients that choose them by name: types, defaults, and which parameters must be there. None stands for must, ... for no default."""
    out = []
    for name, parameters in TOOLS.items():
        said = (getattr(EventGraph, name).__doc__ or name.replace("_", " ")).strip()
        own = {}
        for p, (kind, default) in parameters.items():
            own[p] = {"type": kind} | ({"items": {"type": "number"}} if kind == "array" else {}) | ({} if default in (None, ...) else {"default": default})
        out.append({"type": "function", "function": {"name": name, "description": said, "parameters": {"type": "object", "properties": own, "required": [p for p, (_, d) in parameters.items() if d is None]}}})
    return out


@dataclass(frozen=True)
class EventGraph:
    """Detections (ordinal, camera, global_id, frame, wx, wy) and entities (global_id, appearance_caption, caption_agreement, caption_vector and perhaps action_description, action_agreement, all_actions, action_vector).

    Questions about unknown entities give no rows. Ties are broken by global_id.
    """

    detections: DataFrame
    entities: DataFrame
    max_gap: int = 30
    fps: float = 30.0
    stride: int = 3
    reliable: int = proximity.RELIABLE
    same_person: float = proximity.SAME_PERSON
    person_words: tuple[str, ...] | None = None

    @property
    def sightings(self) -> DataFrame:
        s = sightings(self.detections, self.max_gap)
        return s.withColumns({"start_time_sec": seconds(F.col("start_frame"), self.fps), "end_time_sec": seconds(F.col("end_frame"), self.fps)})

    def _captioned(self, rows: DataFrame, key: str = "global_id") -> DataFrame:
        """rows with the entity's caption and agreement, null where there is none."""
        own = self.entities.select(F.col("global_id").alias(key), "appearance_caption", "caption_agreement")
        return rows.join(own, key, "left")

    def _search(self, vector: list[float], kind: str, shown: list[str], min_similarity: float, top_k: int) -> DataFrame:
        q = normalised(F.array(*[F.lit(float(x)) for x in vector]))
        e = self.entities.where(F.col(kind).isNotNull()).withColumn("sim", dot(normalised(F.col(kind)), q))
        best = e.where(F.col("sim") >= min_similarity).orderBy(F.desc("sim"), "global_id").limit(top_k)
        return best.select("global_id", *shown[:1], rint(F.col("sim"), 3).alias("similarity"), *shown[1:], "sim")

    def search_by_appearance(self, query_vector: list[float], min_similarity: float = 0.7, top_k: int = 20) -> DataFrame:
        return self._search(query_vector, "caption_vector", ["appearance_caption", "caption_agreement"], min_similarity, top_k).drop("sim")

    def search_by_action(self, query_vector: list[float], min_similarity: float = 0.7, top_k: int = 20) -> DataFrame:
        """Empty on a graph without actions."""
        if "action_vector" not in self.entities.columns:
            return self.entities.sparkSession.createDataFrame([], "global_id long, action_description string, similarity double, action_agreement double")
        return self._search(query_vector, "action_vector", ["action_description", "action_agreement"], min_similarity, top_k).drop("sim")

    def get_entity_action(self, global_id: int) -> DataFrame:
        """One row: the action, or an error where the entity or its action is missing."""
        spark = self.entities.sparkSession
        asked = spark.range(1).select(F.lit(global_id).cast("long").alias("asked"))
        has = [c if c in self.entities.columns else None for c in ("action_description", "action_agreement", "all_actions")]
        kinds = ("string", "double", "array<string>")
        e = self.entities.where(F.col("global_id") == global_id).select("global_id", *[(F.col(c) if c else F.lit(None)).cast(k).alias(n) for c, k, n in zip(has, kinds, ("action_description", "action_agreement", "all_actions"), strict=True)])
        j = asked.join(e, asked.asked == e.global_id, "left")
        error = F.when(F.col("global_id").isNull(), F.concat(F.lit("no entity with global_id="), F.col("asked").cast("string"))).when(F.col("action_description").isNull(), F.lit("no action_description on this entity"))
        return j.select(F.col("asked").alias("global_id"), "action_description", "action_agreement", "all_actions", error.alias("error"))

    def get_entity_timeline(self, global_id: int | None = None) -> DataFrame:
        """The sightings of one entity, of all without an id, with place = 0, 1, ... in order of their start."""
        s = self.sightings if global_id is None else self.sightings.where(F.col("global_id") == global_id)
        place = F.row_number().over(Window.partitionBy("global_id").orderBy("start_frame", "camera", "seg_idx")) - 1
        return self._captioned(s.withColumn("place", place)).select(
            "global_id", "appearance_caption", "caption_agreement", "place", "camera", mmss(F.col("start_time_sec")).alias("start_time"), mmss(F.col("end_time_sec")).alias("end_time"),
            rint(F.col("start_time_sec"), 1).alias("start_time_sec"), rint(F.col("end_time_sec"), 1).alias("end_time_sec"), rint(F.col("mean_world_x"), 2).alias("world_x"), rint(F.col("mean_world_y"), 2).alias("world_y"), "num_detections",
        )

    def find_entities_in_camera(self, camera_id: str, start_time_sec: float | None = None, end_time_sec: float | None = None) -> DataFrame:
        s = self.sightings.where(F.col("camera") == str(int(camera_id)))
        s = s if start_time_sec is None else s.where(F.col("end_time_sec") >= start_time_sec)
        s = s if end_time_sec is None else s.where(F.col("start_time_sec") <= end_time_sec)
        return self._captioned(s).select("global_id", "appearance_caption", mmss(F.col("start_time_sec")).alias("start_time"), mmss(F.col("end_time_sec")).alias("end_time"), rint(F.col("start_time_sec"), 1).alias("start_time_sec"), rint(F.col("end_time_sec"), 1).alias("end_time_sec"))

    def check_entities_cooccur(self, global_id_a: int, global_id_b: int, max_gap_sec: float = 5.0) -> DataFrame:
        """(camera, entity_a_window, entity_b_window) of sightings on one camera at most max_gap_sec apart; no rows: they never co-occurred."""
        s = self.sightings
        one = lambda gid, x: s.where(F.col("global_id") == gid).select("camera", F.col("start_time_sec").alias(f"{x}0"), F.col("end_time_sec").alias(f"{x}1"))
        window = lambda x: F.concat(mmss(F.col(f"{x}0")), F.lit("-"), mmss(F.col(f"{x}1")))
        near = F.greatest(F.col("a0") - F.col("b1"), F.col("b0") - F.col("a1")) <= max_gap_sec
        return one(global_id_a, "a").join(one(global_id_b, "b"), "camera").where(near).select("camera", window("a").alias("entity_a_window"), window("b").alias("entity_b_window"))

    def _matches(self, max_distance_m: float, max_gap_sec: float, targets: DataFrame | None, top: int | None = None) -> DataFrame:
        """Matches of all targets, perhaps only the `top` nearest a kind and some more, or of those in (global_id)."""
        gap = int(round(max_gap_sec * self.fps))
        if targets is None:
            return proximity.matches_of_all(self.detections, gap, max_distance_m, self.max_gap, self.stride, self.reliable, self.same_person, top)
        near = proximity.band_pairs(self.detections, gap, max_distance_m, self.max_gap, self.stride, targets)
        return proximity.matches(near, self.reliable, self.same_person)

    def _shown(self, m: DataFrame) -> DataFrame:
        """Matches with time and captions of the other side."""
        middle = (seconds(F.col("target_frame"), self.fps) + seconds(F.col("other_frame"), self.fps)) / 2
        more = [c for c in m.columns if c in ("place",)]
        return self._captioned(m.select("target", F.col("other").alias("global_id"), "camera", mmss(middle).alias("time"), rint(middle, 1).alias("time_sec"), "distance_m", "match_type", *more))

    def find_nearby_entities(self, global_id: int | None = None, max_distance_m: float = 2.0, max_gap_sec: float = 1.0, top_k: int | None = 1000) -> DataFrame:
        """The entities that came near one, or near each without an id: at most top_k a kind of match, the nearest; all of them, without a place, if it is None."""
        targets = None if global_id is None else self.detections.sparkSession.range(1).select(F.lit(global_id).cast("long").alias("global_id"))
        if top_k is None:
            return self._shown(self._matches(max_distance_m, max_gap_sec, targets))
        place = F.row_number().over(Window.partitionBy("target", "match_type").orderBy("distance_m", "other"))
        # captions come after the cut
        return self._shown(self._matches(max_distance_m, max_gap_sec, targets, top_k).withColumn("place", place).where(F.col("place") <= top_k))

    def count_nearby_entities(self, global_id: int | None = None, max_distance_m: float = 2.0, max_gap_sec: float = 1.0) -> DataFrame:
        """(global_id, appearance_caption, caption_agreement, confirmed_interaction_count); 0 for an entity that nobody came near. It counts what find_nearby_entities shows, a thousand at most."""
        targets = None if global_id is None else self.detections.sparkSession.range(1).select(F.lit(global_id).cast("long").alias("global_id"))
        near = self._matches(max_distance_m, max_gap_sec, targets).where("match_type = 'confirmed_proximity'")
        n = near.groupBy(F.col("target").alias("global_id")).agg(F.least(F.lit(1000), F.count("*")).alias("n"))
        seen = self.detections.select("global_id").distinct()
        seen = seen if global_id is None else seen.where(F.col("global_id") == global_id)
        return self._captioned(seen.join(n, "global_id", "left")).select("global_id", "appearance_caption", "caption_agreement", F.coalesce("n", F.lit(0)).cast("long").alias("confirmed_interaction_count"))

    def find_nearby_entities_by_description(self, query_vector: list[float], min_similarity: float = 0.7, max_distance_m: float = 2.0, max_gap_sec: float = 1.0, top_k: int = 1000) -> DataFrame:
        """What is near any entity that a description finds: each other entity once, with the nearest of them, the more similar one on ties."""
        found = self._search(query_vector, "caption_vector", ["appearance_caption", "caption_agreement"], min_similarity, 20)
        found = found.select("global_id", F.col("sim").alias("searched_sim"), F.col("appearance_caption").alias("searched_caption"), F.col("caption_agreement").alias("searched_agreement"))
        m = self._shown(self._matches(max_distance_m, max_gap_sec, found.select("global_id"))).join(found.withColumnRenamed("global_id", "target"), "target")
        # each searched entity shows at most a thousand matches a kind
        own = F.row_number().over(Window.partitionBy("target", "match_type").orderBy("distance_m", "global_id"))
        m = m.withColumn("own", own).where("own <= 1000")
        best = F.row_number().over(Window.partitionBy("global_id").orderBy("distance_m", F.desc("searched_sim"), "target"))
        m = m.withColumn("best", best).where("best = 1")
        place = F.row_number().over(Window.partitionBy("match_type").orderBy("distance_m", "global_id"))
        return m.withColumn("place", place).where(F.col("place") <= top_k).select("match_type", "place", "global_id", "appearance_caption", "caption_agreement", "camera", "time", "time_sec", "distance_m", F.col("target").alias("searched_entity_global_id"), F.col("searched_caption").alias("searched_entity_caption"), F.col("searched_agreement").alias("searched_entity_caption_agreement"))

    def list_multi_camera_entities(self) -> DataFrame:
        many = self.detections.groupBy("global_id").agg(F.array_sort(F.collect_set("camera")).alias("cameras")).where(F.size("cameras") > 1)
        return self._captioned(many).select("global_id", "cameras", "appearance_caption")

    def _by_caption(self, human: bool) -> DataFrame:
        words = list(self.person_words) if self.person_words else None
        said = mentions(F.col("appearance_caption"), words)
        entry = F.struct("start_frame", "camera", "seg_idx", mmss(F.col("start_time_sec")).alias("time"))
        s = self.sightings.groupBy("global_id").agg(F.sum("num_detections").alias("dets"), F.sort_array(F.collect_list(entry)).alias("s"), F.countDistinct("camera").alias("num_cameras"))
        seen = F.transform("s", lambda x: F.struct(x["camera"].alias("camera"), x["time"].alias("time")))
        return self._captioned(s.where(F.col("dets") >= self.reliable)).where(said if human else ~said).select("global_id", "appearance_caption", "caption_agreement", seen.alias("sightings"), "num_cameras")

    def list_low_quality_caption_entities(self) -> DataFrame:
        """Entities of enough detections whose caption speaks of no person; one without a caption is among them."""
        return self._by_caption(False)

    def list_human_captioned_entities(self) -> DataFrame:
        return self._by_caption(True)

    def rank_entities_by_interaction_count(self, max_distance_m: float = 2.0, max_gap_sec: float = 1.0, top_k: int = 10) -> DataFrame:
        n = proximity.interaction_counts(self._matches(max_distance_m, max_gap_sec, None))
        best = n.orderBy(F.desc("interactions"), "target").limit(top_k)
        return self._captioned(best.select(F.col("target").alias("global_id"), F.col("interactions").alias("confirmed_interaction_count")))

    def expected_answers(self, word: str, camera_id: str, until_sec: float, max_distance_m: float = 2.0, max_gap_sec: float = 1.0) -> DataFrame:
        """(place, question, expected): seven questions to a chat about the graph, with the answers that the graph gives; ids in order, null where there are none.

        Entities count from the least id. The lists of ids are texts that people read.
        """
        per = self.detections.groupBy("global_id").agg(F.array_join(F.array_sort(F.collect_set("camera")), ",").alias("cams"), F.countDistinct("camera").alias("n"))
        many = F.col("n") > 1
        listed = lambda c: F.when(F.count(c) > 0, F.array_join(F.array_sort(F.collect_set(c)), ","))
        ids = lambda: F.when(F.count("global_id") > 0, F.array_join(F.transform(F.array_sort(F.collect_set("global_id")), lambda x: x.cast("string")), ","))
        of = lambda place, question, df, expected: df.agg(expected.cast("string").alias("expected")).select(F.lit(place).alias("place"), F.lit(question).alias("question"), "expected")
        near = self._matches(max_distance_m, max_gap_sec, None).select("target", F.col("other").alias("global_id"))
        first = near.join(per.select(F.col("global_id").alias("target"), many.alias("many")), "target").groupBy("many").agg(F.min("target").alias("target")).orderBy(F.desc("many")).limit(1)
        seen = self.find_entities_in_camera(camera_id, 0.0, until_sec)
        return reduce(DataFrame.union, [
            of(1, "entities on more than one camera", per, F.count(F.when(many, 1))),
            of(2, "cameras of the first of them", per.where(many), F.min_by("cams", "global_id")),
            of(3, "first entity on one camera alone", per.where(~many), F.min("global_id")),
            of(4, "an entity that does not exist", per, F.max("global_id") + 1000),
            of(5, "entities whose caption has the word", self.entities.where(F.contains("appearance_caption", F.lit(word))), ids()),
            of(6, "entities on a camera in a window", seen, listed(F.lpad(F.col("global_id").cast("string"), 6, "0"))),
            of(7, "entities near the first one that has any", near.join(F.broadcast(first.select("target")), "target", "left_semi"), ids()),
        ])

    def call(self, name: str, **arguments: object) -> DataFrame:
        """The tool of that name; an unknown name or argument raises an error."""
        if name not in TOOLS or not set(arguments) <= set(TOOLS[name]):
            raise ValueError(f"no tool {name} with arguments {sorted(arguments)}")
        for p, (kind, default) in TOOLS[name].items():
            if p in arguments and (isinstance(arguments[p], bool) or not isinstance(arguments[p], _PYTHON[kind])):
                raise ValueError(f"{name}: {p} must be of type {kind}")
            if default is None and p not in arguments:
                raise ValueError(f"{name}: {p} is missing")
        return getattr(self, name)(**arguments)

