"""Personal data: base patterns, and bootstrapped contextual extraction of identifiers that no base pattern knows.

All of it is DataFrame functions. Base matches are the seeds. Every identifier-like token (one with a digit or an @) is
an instance; the words around it make lexical patterns, "the two words before" and "the word before and the word after".
An instance of eight digits or more also has a general pattern, its number of digits to the power of two: that is where
identifiers of unknown kinds, in contexts that no seed stands in, meet the seeds. Patterns and instances are a bipartite
graph. A lexical pattern takes part when enough distinct instances stand in its slot and ordinary words hardly do: the
instances' share of the distinct fillers of the slot in the corpus must reach the confidence asked for, and the unknown ones among them
must not begin alike, as the numbers of orders and the stamps of time do. Its confidence is
the sum of its instances' over its distinct fillers, so copies of documents change nothing; a general pattern's is the
share of seeds, and of what lexical patterns found, among its instances. An instance's confidence is 1 for seeds, else the
noisy-or of its patterns. A few rounds spread confidence from seeds over patterns to new instances and on; instances in a
lexical pattern of high confidence become spans of the kind `context`.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import let, stored, struct_row, text_or_empty

#: Kinds in the order that breaks ties of position, with their Java patterns. Possessive quantifiers and the look-behind
#: only keep long runs from being tried again at every character; matches are those of the plain patterns.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
RANK = {k: i for i, k in enumerate((*BASE, "context"))}
#: Identifier-like: a phone or a long number with blanks inside, or a run without white space that holds a digit or @.
MENTION = r"(?<!\S)(?:\+[0-9][\x20().0-9-]+[0-9]|[0-9](?:[\x20-]?[0-9]){11,18}+(?![0-9])|[^\s0-9@]*+[0-9@]\S*+)"
#: What is no part of a value: marks before its first letter or digit (but + and @), marks after its last one.
LEAD = r"^[^\p{L}\p{N}+@]+"
EDGE = LEAD + r"|(?<![^\p{L}\p{N}])[^\p{L}\p{N}]++$"
BLANKS = " \t\n\x0b\x0c\r"
#: Characters on each side of a mention that are looked at first; all of them where these hold no whole words.
SIDE = 64
#: Digits that give an instance a general pattern, and the parts of the corpus that rule patterns out before the whole is read.
DIGITS, PARTS = 8, (256, 16)
BLOCK = 64
#: Characters that make a beginning, and the share of pairs of a slot's unknown instances that may begin alike.
BEGINNING, ALIKE = 4, 0.2


def _at(arr: Column, i: Column) -> Column:
    return F.get(arr, i)


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0), lambda a, x: a + x)


def _luhn(digits: Column) -> Column:
    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: m.isNotNull() & (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255))
    n = F.length(F.regexp_replace(m, "[^0-9]", ""))
    if kind == "phone":
        return n.between(9, 15)
    return F.when(n.between(12, 19), _luhn(F.regexp_replace(m, "[^0-9]", ""))).otherwise(False)


def _located(text: Column, regex: str, keep, extra: dict | None = None) -> Column:
    """Array of (start, end, value) of the matches that keep() accepts, in code points, without moving over the text twice.

    extra: more fields, each from (gaps between matches, place of the match).
    """
    extra = extra or {}

    def spans(m: Column, pieces: Column, idx: Column) -> Column:
        gaps_of = F.transform(pieces, F.length)

        def with_gaps(gaps: Column) -> Column:
            steps_of = F.zip_with(F.slice(gaps, F.lit(1), F.size(m)), m, lambda g, x: g + F.length(x))

            def with_steps(steps: Column) -> Column:
                blocks = F.aggregate(
                    F.sequence(F.lit(0), ((F.size(steps) - 1) / BLOCK).cast("int")),
                    F.array(F.lit(0)),
                    lambda acc, b: F.array_append(acc, F.element_at(acc, -1) + _sum(F.slice(steps, b * BLOCK + 1, F.lit(BLOCK)))),
                )

                def span(i: Column, before: Column) -> Column:
                    start = _at(before, (i / BLOCK).cast("int")) + _sum(F.slice(steps, (i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK)) + _at(gaps, i)
                    return let(start, lambda s: F.struct(s.alias("start"), (s + F.length(_at(m, i))).alias("end"), _at(m, i).alias("value"), *[f(pieces, i).alias(n) for n, f in extra.items()]))

                return let(blocks, lambda before: F.transform(idx, lambda i: span(i, before)))

            return let(steps_of, with_steps)

        return let(gaps_of, with_gaps)

    def found(m: Column) -> Column:
        idx = F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda i: keep(_at(m, i)))
        located = let(idx, lambda ix: F.when(F.size(ix) > 0, let(F.split(text, regex, -1), lambda p: spans(m, p, ix))))
        return F.when(F.size(m) > 0, located)

    return let(F.regexp_extract_all(text, F.lit(regex), F.lit(0)), found)


def _tag(kind: str) -> Callable[[Column], Column]:
    return lambda s: F.struct(s["start"].alias("start"), F.lit(RANK[kind]).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value"))


def base_spans(text: Column) -> Column:
    """Array of (start, rank, end, kind, value), by start, then kind as listed in BASE."""
    some = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9][\\x20-]?[0-9]"), "phone": text.rlike(r"\+[0-9]")}
    parts = []
    for kind, regex in BASE.items():
        found = F.when(some[kind], _located(text, regex, partial(_valid, kind)))
        tagged = F.transform(found, _tag(kind))
        parts.append(F.coalesce(tagged, F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string>>")))
    return F.array_sort(F.concat(*parts))


def _context(pieces: Column, i: Column) -> Column:
    """(before2, before, after): the words next to a mention, lower-cased; empty at a border."""

    def near(piece: Column, part: Column, enough: str) -> Column:
        return F.lower(F.when((F.length(piece) <= SIDE) | part.rlike(enough), part).otherwise(piece))

    last, first = F.get(pieces, i), F.get(pieces, i + 1)
    left = F.split(F.rtrim(near(last, F.substring(last, -SIDE, SIDE), r"\s\S+\s+\S+\s*$"), F.lit(BLANKS)), r"\s+")
    right = F.split(F.ltrim(near(first, F.substring(first, 1, SIDE), r"^\s*\S+\s"), F.lit(BLANKS)), r"\s+")
    return F.struct(F.coalesce(F.try_element_at(left, F.lit(-2)), F.lit("")).alias("before2"), F.coalesce(F.try_element_at(left, F.lit(-1)), F.lit("")).alias("before"), F.coalesce(F.get(right, F.lit(0)), F.lit("")).alias("after"))


def _patterns(before2: Column, before: Column, after: Column) -> Column:
    """The hashes of the two patterns around a slot; null where a word is missing."""
    return F.array(
        F.when((before2 != "") & (before != ""), F.xxhash64(F.lit("before"), before2, before)),
        F.when((before != "") & (after != ""), F.xxhash64(F.lit("around"), before, after)),
    )


def _slots(text: Column) -> Column:
    """Array of (token, patterns around it) of every token of the text; a mention with blanks inside is one token."""

    def around(w: Column) -> Column:
        word = lambda i: F.coalesce(F.when(i >= 0, F.get(w, i)), F.lit(""))
        return F.transform(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.struct(F.get(w, i).alias("token"), _patterns(word(i - 2), word(i - 1), word(i + 1)).alias("patterns")))

    glued = F.array_join(F.zip_with(F.split(text, MENTION, -1), F.regexp_extract_all(text, F.lit(MENTION), F.lit(0)), lambda p, m: F.concat(p, F.coalesce(F.translate(m, " ", "\u00a0"), F.lit("")))), "")
    return let(F.split(F.lower(F.when(text.rlike("[0-9@]"), glued).otherwise(text)), r"\s+"), around)


def _ordinary(src: DataFrame, wanted: DataFrame) -> DataFrame:
    """(pattern, slots): how many distinct tokens that are no instances stand in the slot of each wanted pattern."""
    slots = src.select(F.explode(_slots(F.col("text"))).alias("s")).select("s.token", F.explode("s.patterns").alias("pattern")).where("pattern IS NOT NULL")
    bare = slots.join(wanted, "pattern").select("pattern", F.regexp_replace("token", EDGE, "").alias("bare"))
    bare = bare.where(~F.col("bare").rlike("[0-9@]"))
    return bare.select("pattern", F.xxhash64("bare").alias("bare")).distinct().groupBy("pattern").agg(F.count("*").alias("slots"))


def _fillers(src: DataFrame, counted: DataFrame, confidence: float) -> DataFrame:
    """(pattern, fillers) of the patterns (pattern, n instances) whose instances reach the share `confidence` of all distinct fillers.

    Fillers count over the whole corpus. What a part of the texts holds is a lower bound, so common contexts, which hold
    ordinary words, are ruled out after one text in 256 and their slots in the rest need no counting.
    """
    for part in (*PARTS, 1):
        seen = _ordinary(src.where(F.pmod("text_key", F.lit(part)) == 0) if part > 1 else src, counted.select("pattern"))
        counted = counted.join(seen, "pattern", "left").withColumn("fillers", F.col("n") + F.coalesce("slots", F.lit(0)))
        counted = stored(counted.where(F.col("n") >= confidence * F.col("fillers")).select("pattern", "n", "fillers"))
        if part == 1 or counted.isEmpty():
            break
        counted = counted.drop("fillers")
    return counted.select("pattern", "fillers") if "fillers" in counted.columns else counted.select("pattern", F.col("n").alias("fillers"))


def _varied(edges: DataFrame, confidence: float) -> DataFrame:
    """(pattern, n instances) of the patterns of edges (value, pattern, seed) whose unknown instances are no serial numbers.

    Numbers of orders, stamps of time and numbers of books in one slot begin alike; identifiers of persons do not. So of
    all pairs of a pattern's unknown instances at most the share ALIKE may have the same beginning, unless seeds make up
    the share `confidence` of its instances. Counted by beginning first, so a hot pattern is added up before it moves.
    """
    begun = edges.groupBy("pattern", "seed", F.substring("value", 1, BEGINNING).alias("begin")).agg(F.count("*").cast("double").alias("c"))
    unknown = F.when(~F.col("seed"), F.col("c")).otherwise(0.0)
    of = begun.groupBy("pattern").agg(F.sum("c").cast("long").alias("n"), F.sum(unknown).alias("unknown"), F.sum(F.greatest(F.lit(0.0), unknown * (unknown - 1))).alias("pairs"))
    varied = F.col("pairs") <= ALIKE * F.col("unknown") * (F.col("unknown") - 1)
    return of.where((F.col("unknown") <= 1) | varied | (F.col("n") - F.col("unknown") >= confidence * F.col("n"))).select("pattern", "n")


def scored_patterns(src: DataFrame, m: DataFrame, rounds: int, support: int, confidence: float) -> DataFrame:
    """(pattern, fillers, confidence) of the lexical patterns of `support` distinct instances that take part.

    src: the texts (text, text_key); m: mentions (value, seed, patterns).
    """
    edges = m.select("value", F.explode("patterns").alias("pattern"), "seed").where("pattern IS NOT NULL")
    edges = stored(edges.groupBy("value", "pattern").agg(F.max("seed").alias("seed")))
    total = _fillers(src, _varied(edges, confidence).where(F.col("n") >= support), confidence)
    edges = edges.drop("seed")
    if total.isEmpty():
        return total.withColumn("confidence", F.lit(0.0))
    edges = stored(edges.join(total, "pattern"))
    digits = F.length(F.regexp_replace("value", "[^0-9]", ""))
    inst = m.groupBy("value").agg(F.max(F.col("seed").cast("double")).alias("seed"))
    inst = stored(inst.withColumn("general", F.when(digits >= DIGITS, F.floor(F.log2(digits)).cast("int"))))
    linked = stored(inst.join(edges.select("value").distinct(), "value", "left_semi"))
    per_general = inst.where("general IS NOT NULL").groupBy("general").agg(F.count("*").alias("n"), F.sum("seed").alias("got"))
    known = {r.general: (r.n, r.got) for r in per_general.collect()}  # a row for each power of two
    found = dict.fromkeys(known, 0.0)

    def general() -> Column:
        share = [F.when(F.col("general") == g, F.lit((got + found[g]) / n)) for g, (n, got) in known.items()]
        return F.coalesce(*share, F.lit(0.0))

    def scored(state: DataFrame) -> DataFrame:
        return edges.join(state, "value").groupBy("pattern").agg(F.first("fillers").alias("fillers"), F.sum("conf").alias("got")).select("pattern", "fillers", (F.col("got") / F.col("fillers")).alias("confidence"))

    state = linked.withColumn("conf", F.when(F.col("seed") > 0, 1.0).otherwise(general()))
    for _ in range(rounds):
        miss = edges.join(scored(state).select("pattern", "confidence"), "pattern").groupBy("value").agg(F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence"))))).alias("miss"))
        state = linked.join(miss, "value").withColumn("conf", F.when(F.col("seed") > 0, 1.0).otherwise(1 - F.col("miss") * (1 - general())))
        state = stored(state)
        found |= {r.general: r.got for r in state.where("general IS NOT NULL AND seed = 0").groupBy("general").agg(F.sum(1 - F.col("miss")).alias("got")).collect()}
    return stored(scored(state))


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, support: int = 3, confidence: float = 0.8) -> DataFrame:
    """One row a document: id, text_key (hash of the text), spans: array of (start, rank, end, kind, value).

    Base spans of the kinds of BASE, and `context` spans that overlap none of them. A pattern counts when `support`
    distinct instances stand in it and its confidence reaches `confidence`. Offsets are code points, ends exclusive.
    Null and empty texts have no spans. Repeated rows get a row each with equal results. Ties of position go by kind. An
    empty table gives an empty result. Other columns are not read.
    """
    text = text_or_empty(text_col)
    src = docs.select(F.col(id_col).alias("id"), text.alias("text")).select("id", "text", F.xxhash64("text", F.length("text")).alias("text_key"))
    mentions = F.when(F.col("text").rlike("[0-9@]"), _located(F.col("text"), MENTION, lambda m: F.lit(True), {"around": _context}))
    rows = src.select("id", "text_key", base_spans(F.col("text")).alias("base"), mentions.alias("mentions"))
    rows = stored(rows)

    m = rows.where("mentions IS NOT NULL").select("id", "text_key", "base", F.explode("mentions").alias("m"))
    lead = F.length(F.col("m.value")) - F.length(F.regexp_replace("m.value", LEAD, ""))
    value = F.regexp_replace("m.value", EDGE, "")
    m = m.select("id", "text_key", "base", value.alias("value"), (F.col("m.start") + lead).alias("start"), _patterns(F.col("m.around.before2"), F.col("m.around.before"), F.col("m.around.after")).alias("patterns"))
    m = m.withColumn("end", F.col("start") + F.length("value")).where("value <> ''")
    seed = F.exists("base", lambda b: (b["start"] < F.col("end")) & (b["end"] > F.col("start")))
    m = m.withColumn("seed", seed).drop("base")
    good = scored_patterns(src, m, rounds, support, confidence).where(F.col("confidence") >= confidence).select("pattern")
    new = m.where("NOT seed").select("id", "text_key", "value", "start", "end", F.explode("patterns").alias("pattern")).join(good, "pattern", "left_semi")
    span = F.struct(F.col("start").alias("start"), F.lit(RANK["context"]).alias("rank"), F.col("end").alias("end"), F.lit("context").alias("kind"), "value")
    new = stored(new.groupBy("id", "text_key").agg(F.collect_set(span).alias("more")))
    out = rows.join(new.select(F.col("id").alias("i"), F.col("text_key").alias("k"), "more"), F.col("id").eqNullSafe(F.col("i")) & (F.col("text_key") == F.col("k")), "left")
    return out.select(F.col("id").alias(id_col), "text_key", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string>>")))).alias("spans"))


def _merged(spans: Column) -> Column:
    """Spans that overlap become one, of the first one's kind; in order."""
    kind = "array<struct<start:int,end:int,kind:string>>"

    def add(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        item = F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        return F.when((F.size(acc) > 0) & (s["start"] < last["end"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(item)))

    return F.aggregate(spans, F.array().cast(kind), add)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each span of find_personal replaced by its kind in angle brackets; n_chars, where there is one, follows.

    All rows stay, repeated ones too, with all columns as they were, whatever their names. Spans that overlap become one.
    Null texts stay null. An empty table gives an empty result.
    """
    found = find_personal(docs, id_col, text_col).where(F.size("spans") > 0).select(F.col(id_col).alias("i"), F.col("text_key").alias("k"), "spans")
    found = stored(found.dropDuplicates(["i", "k"]))
    own = text_or_empty(F.col(f"row.`{text_col}`"))
    out = struct_row(docs).withColumns({"own_id": F.col(f"row.`{id_col}`"), "own_key": F.xxhash64(own, F.length(own))})
    out = out.join(found, F.col("own_id").eqNullSafe(F.col("i")) & (F.col("own_key") == F.col("k")), "left")
    text = F.col(f"row.`{text_col}`")

    def cut(m: Column) -> Column:
        end = lambda i: F.when(i < 0, 0).otherwise(F.get(m, i)["end"])
        body = F.transform(F.sequence(F.lit(0), F.size(m) - 1), lambda i: F.concat(F.substring(text, end(i - 1) + 1, F.get(m, i)["start"] - end(i - 1)), F.lit("<"), F.upper(F.get(m, i)["kind"]), F.lit(">")))
        return F.concat(F.array_join(body, ""), F.substring(text, end(F.size(m) - 1) + 1, F.length(text)))

    out = out.select("row", F.when(F.col("spans").isNull(), text).otherwise(let(_merged(F.col("spans")), cut)).alias("text"))
    changed = {text_col: F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("row.n_chars"))
    return out.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
