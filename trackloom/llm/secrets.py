"""Secrets in texts: base patterns, and strings that character Markov models take for random. All of it is DataFrame functions.

Two first-order models of the characters of CHARS are learnt from labelled samples: one of random strings, one of ordinary
identifiers and words. A string's score is the log-likelihood ratio, the sum over its steps from character to character of
log P(random) - log P(ordinary), both smoothed; steps from or to one of JOINTS, which also join words to identifiers, count
nothing, and steps from a character to itself never count for random, as fillers repeat one. The cut is learnt on samples held out: it is at least PRIOR (a secret is
taken to be one string in e^PRIOR) and so high that at most one ordinary string in FALSE_ONE_IN lies above it.

The samples: random strings are drawn, of several alphabets and lengths, by hashing row numbers, and to these come the
keys, hex strings and long mixed values that the base patterns find; ordinary strings are the words and identifiers of the
texts that are shorter than SHORT characters, or of any length and of letters alone or digits alone. They are taken from
texts chosen by hash, about SAMPLE_TEXTS of them. Everything else covers whole texts of all documents.
"""

from __future__ import annotations

import math
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.common import let, stored, text_or_empty
from trackloom.llm.personal import _located

LEARNT = "random"
JOINTS = "+/_=-"
CHARS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789" + JOINTS
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: Kinds in the order that breaks ties of position, with their Java patterns. Look-behinds and counts only leave out at
#: once what the rules drop: hex matches are whole runs, and no later AKIA of a run has more characters than the first.
BASE = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{16,}+", "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+"}
RANK = {k: i for i, k in enumerate((*BASE, LEARNT))}
#: Strings of which the models decide, whole runs of CHARS; shorter ones are taken to be ordinary.
LEAST, SHORT = 16, 12
CANDIDATE = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST},}}+"
WORD = r"[A-Za-z0-9+/_=-]+"
#: Texts, about, that ordinary samples are taken from, and random strings drawn for each alphabet.
SAMPLE_TEXTS, DRAWN = 20_000, 4_000
#: Alphabets of drawn strings.
ALPHABETS = {"hex": "0123456789abcdef", "mixed": CHARS[:62], "base64": CHARS[:64], "upper": CHARS[26:62]}
PRIOR, FALSE_ONE_IN, SMOOTH = math.log(1e5), 10_000, 0.5
#: Scores of held-out samples are counted by whole numbers within these bounds.
BOUND = 500
SPANS = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"


def _valid(kind: str, m: Column) -> Column:
    return F.length(F.regexp_extract(m, ASSIGN, 1)) >= 6 if kind == "assign" else F.lit(True)


def _tagged(kind: str, found: Column) -> Column:
    tag = lambda s: F.struct(s["start"].alias("start"), F.lit(RANK[kind]).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value"))
    return F.coalesce(F.transform(found, tag), F.array().cast(SPANS))


def base_spans(text: Column) -> Column:
    """Array of (start, rank, end, kind, value) of the base kinds, by start, then kind; a span is the whole match."""
    some = {"assign": text.rlike(r"[:=]") & text.rlike("(?i)pass|secret|token|api"), "access": F.contains(text, F.lit("AKIA")), "hex": F.lit(True)}
    return F.array_sort(F.concat(*[_tagged(k, F.when(some[k], _located(text, regex, partial(_valid, k)))) for k, regex in BASE.items()]))


def drawn(spark: SparkSession, n: int = DRAWN) -> DataFrame:
    """(value): n random strings of each alphabet, of 16 to 47 characters; the same ones every time."""
    def strings(name: str, chars: str) -> DataFrame:
        size = 16 + F.pmod(F.xxhash64(F.lit(name), "id"), F.lit(32)).cast("int")
        char = lambda k: F.substring(F.lit(chars), F.pmod(F.xxhash64(F.lit(name), "id", k), F.lit(len(chars))).cast("int") + 1, F.lit(1))
        return spark.range(n).select(F.array_join(F.transform(F.sequence(F.lit(1), size), char), "").alias("value"))

    return reduce(DataFrame.union, [strings(*x) for x in ALPHABETS.items()])


def samples(docs: DataFrame, text_col: str = "text", texts: int = SAMPLE_TEXTS) -> DataFrame:
    """(value, secret): distinct labelled strings, ordinary ones from about `texts` texts, and random ones from base matches there and drawn."""
    own = docs.select(text_or_empty(text_col).alias("text"))
    total = max(docs.count(), 1)
    some = own.where(F.pmod(F.xxhash64("text"), F.lit(total)) < texts) if total > texts else own
    words = some.select(F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("value")).distinct()
    ordinary = words.where((F.length("value") >= 3) & ((F.length("value") < SHORT) | F.col("value").rlike("^([A-Za-z]+|[0-9]+)$")))
    ordinary = ordinary.where(~F.col("value").startswith("AKIA") & ~F.col("value").rlike("^[0-9a-f]{24,}$"))
    found = some.select(F.explode(base_spans(F.col("text"))).alias("s")).select(F.when(F.col("s.kind") == "assign", F.regexp_extract("s.value", ASSIGN, 1)).otherwise(F.col("s.value")).alias("value"))
    found = found.where((F.length("value") >= LEAST) & F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]") & ~F.col("value").rlike(r"[^A-Za-z0-9+/_=-]"))
    secret = found.union(drawn(docs.sparkSession)).distinct()
    return ordinary.select("value", F.lit(False).alias("secret")).union(secret.select("value", F.lit(True).alias("secret")))


def _steps(value: Column) -> Column:
    """Array of the steps of a string, each a number: place of the first character in CHARS times the number of characters, plus the second's."""
    at = lambda i: F.instr(F.lit(CHARS), F.substring(value, i, F.lit(1))) - 1
    return F.transform(F.sequence(F.lit(1), F.length(value) - 1), lambda i: at(i) * len(CHARS) + at(i + 1))


def trained(labelled: DataFrame) -> list[float]:
    """For each step, log P(second | first, random) - log P(second | first, ordinary), 0 where one is of JOINTS, at most 0 where both are one character, from (value, secret) of two characters of CHARS and more."""
    steps = labelled.where(F.length("value") >= 2).select("secret", F.explode(_steps(F.col("value"))).alias("step"))
    n = len(CHARS)
    count = {True: [SMOOTH] * (n * n), False: [SMOOTH] * (n * n)}
    for r in steps.groupBy("secret", "step").agg(F.count("*").alias("n")).collect():  # at most 2 x 67 x 67 rows
        count[r.secret][r.step] += r.n
    total = {k: [sum(c[i * n : i * n + n]) for i in range(n)] for k, c in count.items()}
    plain = n - len(JOINTS)
    ratio = lambda s: math.log(count[True][s] / total[True][s // n]) - math.log(count[False][s] / total[False][s // n])
    return [0.0 if max(s // n, s % n) >= plain else min(0.0, ratio(s)) if s // n == s % n else ratio(s) for s in range(n * n)]


def score(value: Column, ratios: list[float]) -> Column:
    """The log-likelihood ratio of a string of CHARS: above 0 it is more like the random ones."""
    table = F.from_json(F.lit("[" + ",".join(map(repr, ratios)) + "]"), "array<double>")  # folded into one constant
    return let(table, lambda t: F.aggregate(_steps(value), F.lit(0.0), lambda s, i: s + F.get(t, i)))


def learnt_cut(held: DataFrame, ratios: list[float]) -> float:
    """The least whole score of PRIOR and more above which at most one ordinary string in FALSE_ONE_IN of (value, secret) lies."""
    low = F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), F.floor(score(F.col("value"), ratios)))).cast("int").alias("low")
    rows = held.where("NOT secret").groupBy(low).agg(F.count("*").alias("n")).collect()  # at most 2 x BOUND + 1 rows
    allowed, above, cut = sum(r.n for r in rows) / FALSE_ONE_IN, 0, math.ceil(PRIOR)
    for r in sorted(rows, key=lambda r: -r.low):
        above += r.n
        if above > allowed:
            return float(max(cut, r.low + 1))
    return float(cut)


def learn(labelled: DataFrame) -> tuple[list[float], float]:
    """(ratios, cut) from labelled strings (value, secret): three in four by hash teach the models, the others the cut."""
    held = F.pmod(F.xxhash64(F.lit("held"), "value"), F.lit(4)) == 0
    ratios = trained(labelled.where(~held))
    return ratios, learnt_cut(labelled.where(held), ratios)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: DataFrame | None = None) -> DataFrame:
    """One row a document: id, spans: array of (start, rank, end, kind, value), by start, then kind.

    Base spans of the kinds of BASE, and `random` spans: whole runs of LEAST characters of CHARS and more that overlap no
    base span and that the models take for random. labelled: own samples (value, secret) of two characters of CHARS and
    more, else `samples` of the texts. Offsets are code points, ends exclusive. Null and empty texts have no spans.
    Repeated rows get a row each with equal results, null ids too. An empty table gives an empty result. Other columns
    are not read.
    """
    labelled = stored(samples(docs, text_col) if labelled is None else labelled.select("value", "secret"))
    ratios, cut = learn(labelled)
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    more = _tagged(LEARNT, _located(F.col("_text"), CANDIDATE, lambda m: score(m, ratios) > cut))
    rows = rows.select("_id", base_spans(F.col("_text")).alias("_base"), more.alias("_more"))
    free = F.filter("_more", lambda s: ~F.exists("_base", lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"])))
    return rows.select(F.col("_id").alias(id_col), F.when(F.size("_more") == 0, F.col("_base")).otherwise(F.array_sort(F.concat("_base", free))).alias("spans"))
