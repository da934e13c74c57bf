"""Text of reports and of tool calls, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLAIM = r"global_id (\d+): \d+ confirmed interactions? of (their|his|her|its) own[^\n]*"


def tool_calls(text: Column, schema: str = "name STRING, arguments STRING") -> Column:
    """The JSON objects of <tool_call> blocks as an array of structs; what is no JSON object is left out, an open last block ends with the text."""
    blocks = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?s)<tool_call>(.*?)(?:</tool_call>|\z)"), F.lit(1))
    # the loose parser gives a struct of nulls for a broken object, so the whole text must parse as a map of values first
    sound = F.filter(F.transform(blocks, lambda b: F.regexp_replace(b, r"^\s+|\s+$", "")), lambda b: F.try_parse_json(b).isNotNull() & b.startswith("{"))
    return F.transform(sound, lambda b: F.from_json(b, schema))


def scrubbed(text: Column, reported: Column) -> Column:
    """text with each claim on an id's interactions replaced, unless the id is in the array of reported ids."""
    # a claim runs to its line's end, so a line holds at most one that counts: the first
    gid = lambda line: F.regexp_extract(line, CLAIM, 1)
    note = lambda line: F.concat(F.lit("[claim about global_id "), gid(line), F.lit("'s interaction count removed -- no verified tool result for it]"))
    one = lambda line: F.when((gid(line) == "") | F.array_contains(reported.cast("array<string>"), gid(line)), line).otherwise(F.regexp_replace(line, F.lit(CLAIM), note(line)))
    return F.array_join(F.transform(F.split(text, "\n"), one), "\n")


def slug(text: Column, length: int = 40) -> Column:
    """A file name of a query: each character that is no letter or digit as one underscore, cut to `length`."""
    return F.substring(F.regexp_replace(text, r"[^\p{L}\p{N}]", "_"), 1, length)


def clothing_caption(upper: Column, lower: Column, text: Column) -> Column:
    return F.concat(upper, F.lit(" top, "), lower, F.lit(" bottom. "), text)


def ranking_line(place: Column, gid: Column, interactions: Column) -> Column:
    return F.format_string("%d. global_id %d: %d confirmed interactions", place, gid, interactions)


def percent(x: Column) -> Column:
    """A fraction as per cent with five significant digits, as summary rows print it."""
    return F.format_string("%.5g", 100 * x)


# Texts that reports must show word for word.
TOLD = {
    "no_ranking": "No entities had any confirmed proximity matches within the given thresholds.",
    "no_proximity": "No confirmed proximity matches found within the given distance/time thresholds.",
    "no_low_quality": "No entities with a failed (non-human-word) caption found.",
    "no_human": "No human-captioned entities found.",
    "summary": "Summary (guaranteed accurate -- generated directly from tool results, not the model):",
}
AGREED = 0.6


def agreement_flag(agreement: Column, threshold: float = AGREED) -> Column:
    """A note on captions that disagree; nothing where they agree or where that is not known."""
    return F.when(agreement < threshold, F.concat(F.lit(" [caption uncertain, agreement="), agreement.cast("string"), F.lit("]"))).otherwise("")


def agreement_note(agreement: Column) -> Column:
    return F.when(agreement.isNull(), "agreement unknown").otherwise(F.concat(F.lit("agreement="), agreement.cast("string")))


def _said(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit("None"))


def ranking_entry(gid: Column, interactions: Column, caption: Column, agreement: Column) -> Column:
    return F.concat(F.lit("  - global_id "), gid.cast("string"), F.lit(": "), interactions.cast("string"), F.lit(" confirmed interactions -- "), _said(caption), agreement_flag(agreement))


def count_line(gid: Column, interactions: Column, caption: Column, agreement: Column) -> Column:
    return F.concat(F.lit("global_id "), gid.cast("string"), F.lit(": "), interactions.cast("string"), F.lit(" confirmed interactions of their own -- "), _said(caption), agreement_flag(agreement))


def match_entry(camera: Column, time: Column, caption: Column, agreement: Column, gid: Column, metres: Column, interactions: Column | None = None) -> Column:
    """One line of a proximity report; with the matched entity's own count where that is known."""
    line = F.concat(F.lit("  - camera "), camera, F.lit(", "), time, F.lit(": "), _said(caption), agreement_flag(agreement), F.lit(" (global_id "), gid.cast("string"), F.lit("), "), metres.cast("string"), F.lit("m away"))
    own = F.lit("") if interactions is None else F.when(interactions.isNull(), "").otherwise(F.concat(F.lit(", "), interactions.cast("string"), F.lit(" confirmed interactions of their own")))
    return F.concat(line, own)


def seen_entry(gid: Column, caption: Column, agreement: Column, sightings: Column, cameras: Column) -> Column:
    """One line of the caption lists; sightings: array of (camera, time)."""
    seen = F.array_join(F.transform(sightings, lambda s: F.concat(F.lit("camera "), s["camera"], F.lit(" at "), s["time"])), "; ")
    return F.concat(F.lit("  - global_id "), gid.cast("string"), F.lit(": "), _said(caption), F.lit(" ["), agreement_note(agreement), F.lit("], seen: "), seen, F.lit(" ("), cameras.cast("string"), F.lit(" camera(s) total)"))


def summary_entry(gid: Column, confirmed: Column, caption: Column) -> Column:
    """One line of the summary; nothing hangs on behind where there is no caption."""
    line = F.concat(F.lit("  - global_id "), gid.cast("string"), F.lit(": "), confirmed.cast("string"), F.lit(" confirmed interactions -- "), F.coalesce(caption, F.lit("")))
    return F.rtrim(line, F.lit(" -"))


def report(entries: DataFrame, line: Column, order: list[Column], header: Column | str, empty: str) -> DataFrame:
    """One row (text): a header, which may use n, the number of entries, and the entries' lines in order; `empty` without entries.

    All lines end up in one row, as a report does: meant for results that people read.
    """
    place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], line.alias("line"))
    lines = entries.agg(F.sort_array(F.collect_list(place)).alias("rows"), F.count("*").alias("n"))
    head = F.lit(header) if isinstance(header, str) else header
    return lines.select(F.when(F.col("n") == 0, empty).otherwise(F.concat(head, F.lit("\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n"))).alias("text"))


def assembled(intro: Column, reports: Column) -> Column:
    """The scrubbed introduction and the reports, each text once, parted by blank lines; the introduction alone without reports."""
    known = F.array_distinct(F.filter(reports, lambda r: r != ""))
    ids = F.flatten(F.transform(known, lambda r: F.regexp_extract_all(r, F.lit(CLAIM), F.lit(1))))
    own = scrubbed(intro, ids)
    return F.when(F.size(known) == 0, own).otherwise(F.concat(F.btrim(own), F.lit("\n\n"), F.array_join(known, "\n\n")))


def unexecuted_tool(text: Column, tools: list[str]) -> Column:
    """The first of the tools, in the order given, whose name a text mentions; null if it mentions none."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(t)), t) for t in tools], F.lit(None).cast("string"))


def count_nudge(ids: Column, remaining: Column) -> Column:
    """The request to ask next for the counts of these ids; empty without ids."""
    more = F.when(remaining > 0, F.concat(F.lit(" "), remaining.cast("string"), F.lit(" more follow after these."))).otherwise("")
    return F.when(F.size(ids) == 0, "").otherwise(F.concat(F.lit("Call count_nearby_entities for each of these global_ids next: "), F.array_join(ids.cast("array<string>"), ", "), F.lit("."), more))


def invented_ids(wrong: Column, known: Column) -> Column:
    """The note on ids that do not exist, with those that do."""
    listed = lambda a: F.array_join(F.array_sort(a).cast("array<string>"), ", ")
    return F.concat(F.lit("global_id(s) "), listed(wrong), F.lit(" do not exist. Use only ids that tool results have named: "), listed(known), F.lit("."))


def table_line(name: Column, values: list[Column]) -> Column:
    """One line of the console table: the name in 35 places, each value in 10, all to the left."""
    return F.format_string("%-35s" + "%-10s" * len(values), name, *values)


# The first lines of reports, before and after the number of their entries.
HEADERS = {"proximity": ("Confirmed proximity matches (", "):"), "ranking": ("Top ", " entities by confirmed interaction count:"), "human": ("", " entities whose caption identifies them as a person:")}
NONE_LINE = "  (none)"


def headed(kind: str) -> Column:
    before, after = HEADERS[kind]
    return F.concat(F.lit(before), F.col("n").cast("string"), F.lit(after))


def proximity_report(matches: DataFrame) -> DataFrame:
    """One row (text) of the confirmed matches (place, camera, time, appearance_caption, caption_agreement, global_id, distance_m, match_type and, where it is known, interactions)."""
    own = F.col("interactions") if "interactions" in matches.columns else None
    line = match_entry(F.col("camera"), F.col("time"), F.col("appearance_caption"), F.col("caption_agreement"), F.col("global_id"), F.col("distance_m"), own)
    return report(matches.where("match_type = 'confirmed_proximity'"), line, [F.col("place"), F.col("global_id")], headed("proximity"), TOLD["no_proximity"])


def ranking_report(ranked: DataFrame) -> DataFrame:
    """One row (text) of (global_id, appearance_caption, caption_agreement, confirmed_interaction_count), the most interactions first."""
    line = ranking_entry(F.col("global_id"), F.col("confirmed_interaction_count"), F.col("appearance_caption"), F.col("caption_agreement"))
    return report(ranked, line, [-F.col("confirmed_interaction_count"), F.col("global_id")], headed("ranking"), TOLD["no_ranking"])


def _listed() -> Column:
    return seen_entry(F.col("global_id"), F.col("appearance_caption"), F.col("caption_agreement"), F.col("sightings"), F.col("num_cameras"))


def human_report(listed: DataFrame) -> DataFrame:
    """One row (text) of the entities (global_id, appearance_caption, caption_agreement, sightings, num_cameras) whose captions speak of persons."""
    return report(listed, _listed(), [F.col("global_id")], headed("human"), TOLD["no_human"])


def low_quality_report(listed: DataFrame, threshold: float = AGREED) -> DataFrame:
    """One row (text) of the entities whose captions speak of no person, in two sections: captions that disagree or may, and those that agree."""
    low = F.col("caption_agreement").isNull() | (F.col("caption_agreement") < threshold)
    place = F.struct((~low).alias("high"), "global_id", _listed().alias("line"))
    rows = listed.agg(F.sort_array(F.collect_list(place)).alias("rows"), F.count("*").alias("n"))
    of = lambda high: F.filter("rows", lambda r: r["high"] == high)
    share = lambda high: F.concat(F.size(of(high)).cast("string"), F.lit(" of "), F.col("n").cast("string"))
    body = lambda high: F.when(F.size(of(high)) == 0, NONE_LINE).otherwise(F.array_join(F.transform(of(high), lambda r: r["line"]), "\n"))
    head = F.concat(F.col("n").cast("string"), F.lit(" entities whose caption names no person: most are people whose caption failed, so take none for an object."))
    parts = [head, F.concat(F.lit("\nLow-confidence ("), share(False), F.lit(f", agreement below {threshold} or unknown):")), body(False), F.concat(F.lit("\nHigher-confidence ("), share(True), F.lit(f", agreement at or above {threshold}):")), body(True)]
    return rows.select(F.when(F.col("n") == 0, TOLD["no_low_quality"]).otherwise(F.concat_ws("\n", *parts)).alias("text"))
