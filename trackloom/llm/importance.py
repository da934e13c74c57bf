"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Features are the lower-cased tokens `\\w+|[^\\w\\s]+` of the whole text and their neighbour pairs, hashed into a fixed
number of buckets. Two bag-of-n-grams models, one of target text (documents labelled good) and one of all raw text, give
each document the log weight sum(log p_target - log p_raw). Adding Gumbel noise and keeping the k largest keys draws k
documents without replacement in proportion to their weights (DSIR, Xie et al. 2023).

Toxic text has a model of its own: the log share of labelled toxic documents among those with a word, over their share among all,
shrunk towards 0 for rare words. A document's score is that of its strongest word, so a short passage in long good prose counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import small_batches, stored, struct_row
from trackloom.llm.shingles import U, mix

TOKEN = re.compile(r"\w+|[^\w\s]+")
BUCKET_BITS = 16
#: Tokens whose hashes a worker remembers.
CACHE_WORDS = 200_000
#: Labelled rows at most that fit the target model and choose the cut: the ones whose hashed ids are least.
LABELLED = 40_000
SMOOTHING = 0.5
#: Documents that pull a word's toxic ratio towards 0.
SHRINK = 20.0


class _TokenHashes(dict):
    def __missing__(self, token: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[token] = xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"))
        return h


def _buckets(texts: list[str | None], cache: _TokenHashes) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every n-gram of the texts, and the number of n-grams of each text."""
    tokens = [TOKEN.findall(t.lower()) if t else [] for t in texts]
    length = np.array([len(x) for x in tokens], np.int64)
    h = np.fromiter(map(cache.__getitem__, chain.from_iterable(tokens)), U, int(length.sum()))
    doc = np.repeat(np.arange(len(tokens)), length)
    pair = mix(h[:-1] * U(0x9E3779B97F4A7C15) + h[1:])[doc[:-1] == doc[1:]]
    where = np.concatenate([doc, doc[:-1][doc[:-1] == doc[1:]]])
    grams = (np.concatenate([mix(h), pair]) >> U(64 - BUCKET_BITS)).view(np.int64)
    return grams, where


def _words(where: np.ndarray) -> int:
    """How many of the n-grams of _buckets are words: they come first, then the pairs, one fewer in each text with words."""
    return (len(where) + len(np.unique(where))) // 2


def labelled_sample(labels: DataFrame, most: int = LABELLED) -> list[tuple[int, bool, bool]]:
    """(doc_id, good, toxic) of at most `most` labelled rows; good: quality 1 and not toxic. Rows without an id or a quality are left out."""
    rows = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    toxic = F.coalesce("toxic", F.lit(0))
    rows = rows.agg(F.min(((F.col("quality") == 1) & (toxic == 0)).cast("int")).alias("good"), F.max((toxic != 0).cast("int")).alias("toxic"))
    return [(r.doc_id, bool(r.good), bool(r.toxic)) for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()]


def fit(docs: DataFrame, target_ids: np.ndarray, toxic_ids: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """log p_target - log p_raw by bucket, and the shrunk ratio of toxic text. Raw counts cover all documents; the ids are the bounded sample's."""
    ids = docs.sparkSession.sparkContext.broadcast((target_ids, toxic_ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, n = _TokenHashes(), 1 << BUCKET_BITS
        raw, target, seen, toxic = np.zeros((4, n), np.int64)
        for b in batches:
            grams, where = _buckets(b.column("t").to_pylist(), cache)
            doc_ids = np.array([-1 if x is None else x for x in b.column("id").to_pylist()], np.int64)
            raw += np.bincount(grams, minlength=n)
            target += np.bincount(grams[np.isin(doc_ids, ids.value[0])[where]], minlength=n)
            words = _words(where)
            once = np.unique((where[:words] << BUCKET_BITS) | grams[:words])  # each word once a document
            seen += np.bincount(once & (n - 1), minlength=n)
            toxic += np.bincount(once[np.isin(doc_ids, ids.value[1])[once >> BUCKET_BITS]] & (n - 1), minlength=n)
        full = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(raw[full]), pa.array(target[full]), pa.array(seen[full]), pa.array(toxic[full])], ["bucket", "raw", "target", "seen", "toxic"])

    counts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, "bucket long, raw long, target long, seen long, toxic long")
    raw, target, seen, toxic = np.zeros((4, 1 << BUCKET_BITS))
    for r in counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"), F.sum("seen").alias("seen"), F.sum("toxic").alias("toxic")).collect():  # 2^16 rows at most
        raw[r.bucket], target[r.bucket], seen[r.bucket], toxic[r.bucket] = r.raw, r.target, r.seen, r.toxic
    n = len(raw)
    share = toxic.sum() / seen.sum() if seen.any() else 0.0
    slur = np.log((toxic + SHRINK * share) / (seen + SHRINK) / share) if share else np.zeros(n)
    ratio = np.log((target + SMOOTHING) / (target.sum() + SMOOTHING * n)) - np.log((raw + SMOOTHING) / (raw.sum() + SMOOTHING * n))
    return np.stack([ratio, slur])


def log_weights(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, n_grams, log_weight, toxicity) of every document; 0 for a null or empty text. ratio: the two of fit."""
    held = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _TokenHashes()
        for b in batches:
            grams, where = _buckets(b.column("t").to_pylist(), cache)
            w = np.bincount(where, held.value[0][grams], minlength=b.num_rows)
            words = _words(where)
            toxicity = np.zeros(b.num_rows)
            at = np.flatnonzero(np.diff(where[:words], prepend=-1))
            if words:
                toxicity[where[at]] = np.maximum.reduceat(held.value[1][grams[:words]], at)
            n = np.bincount(where, minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("text_key"), pa.array(n.astype(np.int64)), pa.array(w.astype(float)), pa.array(toxicity)], ["id", "text_key", "n_grams", "log_weight", "toxicity"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("t"))
    return source.mapInArrow(run, "id long, text_key long, n_grams long, log_weight double, toxicity double")


def gumbel_keys(weights: DataFrame, seed: int) -> DataFrame:
    """weights with gumbel_key: the log weight plus Gumbel noise that follows from the id, else from the text, and the seed."""
    u = (F.shiftrightunsigned(F.xxhash64(F.coalesce("id", "text_key"), F.lit(seed)), 11) + 0.5) / float(1 << 53)
    return weights.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(u)))


def kth_largest(df: DataFrame, col: str, k: int) -> float | None:
    """The k-th largest value, by histograms over ever narrower ranges: no sort and no large collect. None for k < 1 or too few rows."""
    bins, exact = 1024, 4096
    df = df.select(F.col(col).alias("x")).where("x IS NOT NULL")
    lo, hi, n = df.agg(F.min("x"), F.max("x"), F.count("*")).first()
    if k < 1 or n < k:
        return None
    while n > exact and lo < hi:
        width = (hi - lo) / bins
        rows = df.where((F.col("x") >= lo) & (F.col("x") <= hi)).groupBy(F.least(F.floor((F.col("x") - lo) / width), F.lit(bins - 1)).alias("bin"))
        for r in sorted(rows.agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect(), key=lambda r: -r.bin):
            if k <= r.n:
                lo, hi, n = r.lo, r.hi, r.n
                break
            k -= r.n
    if lo == hi:
        return lo
    return sorted((r.x for r in df.where((F.col("x") >= lo) & (F.col("x") <= hi)).collect()), reverse=True)[k - 1]


def best_cut(scores: list[float], good: list[bool]) -> float:
    """The least score to keep, so that as few labelled rows as possible are on the wrong side."""
    s, g = np.array(scores), np.array(good)
    order = np.argsort(s, kind="stable")
    s, g = s[order], g[order]
    if not len(s) or g.all() or not g.any():
        return float("-inf")
    gain = np.concatenate([[0.0], np.cumsum(np.where(g, -1.0, 1.0))])
    gain[1:-1][s[1:] == s[:-1]] = -np.inf  # a cut between equal scores is none
    i = int(np.argmax(gain))
    return float("inf") if i == len(s) else float(s[0] if i == 0 else (s[i - 1] + s[i]) / 2)


def importance_resample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", most: int = LABELLED) -> DataFrame:
    """One row a document: id, n_grams, log_weight, gumbel_key, selected, text_key (a hash of the text).

    selected marks the k documents with the largest Gumbel keys of those whose toxicity is below the cut that best parts
    labelled toxic text from the rest. Without k, k is the number of documents whose log
    weight reaches the cut that best parts good from bad in the labelled sample (at most `most` rows; model counts cover
    all documents). Null and empty texts weigh 0 (log). Ties at the k-th key go in together only if keys are equal to
    the last bit; repeated rows with one id share key and fate. Without labels all documents are kept. An empty table
    gives an empty result. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    sample = labelled_sample(labels, most)
    ratio = fit(docs, np.array(sorted(i for i, good, _ in sample if good), np.int64), np.array(sorted(i for i, _, toxic in sample if toxic), np.int64), id_col, text_col)
    keyed = stored(gumbel_keys(log_weights(docs, ratio, id_col, text_col), seed))
    seen = []
    if sample:
        frame = docs.sparkSession.createDataFrame(sample, "id long, good boolean, toxic boolean")
        known = keyed.join(F.broadcast(frame), "id").groupBy("id").agg(F.min("log_weight").alias("w"), F.first("good").alias("g"), F.max("toxicity").alias("t"), F.first("toxic").alias("x"))
        seen = known.select("w", "g", "t", "x").collect()  # `most` rows at most: one an id
    harmful = best_cut([r[2] for r in seen], [r[3] for r in seen]) if any(r[3] for r in seen) else float("inf")
    fit_to_keep = F.col("toxicity") < harmful
    if k is None:
        k = keyed.where(fit_to_keep & (F.col("log_weight") >= best_cut([r[0] for r in seen], [r[1] for r in seen]))).count()
    least = kth_largest(keyed.where(fit_to_keep), "gumbel_key", k)
    selected = fit_to_keep & (F.col("gumbel_key") >= least if least is not None else F.lit(k > 0))
    return keyed.select(F.col("id").alias(id_col), "n_grams", "log_weight", "gumbel_key", selected.alias("selected"), "text_key")


def keep_selected(docs: DataFrame, labels: DataFrame, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that importance_resample selects, with all their columns, whatever their names.

    Rows without an id are judged like all others; rows that repeat an id and its text stay or go together.
    """
    chosen = importance_resample(docs, labels, None, seed, id_col, text_col).where("selected").select(F.col(id_col).alias("i"), "text_key").distinct()
    rows = struct_row(docs).withColumns({"own_id": F.col(f"row.`{id_col}`").cast("long"), "own_key": F.xxhash64(F.col(f"row.`{text_col}`"))})
    return rows.join(chosen, rows.own_id.eqNullSafe(chosen.i) & (rows.own_key == chosen.text_key), "left_semi").select("row.*")
