"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import chat, containment, crosstoken, importance, jaccard, licenses, lm, packing, periodic, personal, secrets, sharding, syncmers
from trackloom.llm.common import let, read, text_or_empty


def op5_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance_resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.contained_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    training = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 != 1
    return lm.score_documents(read(spark, sf_dir, "documents"), training)


def op2_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprint_documents(read(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf_dir, "documents"))


def op4_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = text_or_empty()
    docs = read(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    found = sharding.feistel_shards(docs, 40)
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    return chat.read_back(chat.format_conversations(rows.unionByName(own)))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.find_personal(read(spark, sf_dir, "documents"))
    said = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "context")
    return found.select("doc_id", *[of(k) for k in personal.BASE], F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read(spark, sf_dir, "documents"))


def _with_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where one id in ten has its words from a place on repeated with a period, as the contract has it; a null id counts as an empty one."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))

    def repeated(w: Column) -> Column:
        n, g = F.size(w), F.floor(h / 10)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.concat(F.slice(w, F.lit(1), a), F.slice(tail, F.lit(1), n - a)), " ")

    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    return docs.select("doc_id", F.when(h % 10 == 0, let(words, lambda w: F.when(F.size(w) > 0, repeated(w)))).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(_with_periods(read(spark, sf_dir, "documents")))
    first = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"), r.alias("r")))), 1)["r"]
    found = found.withColumn("top", F.when(F.size("runs") > 0, first))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"top.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * F.col("top.length") / F.col("top.period")).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstoken.align_tokens(read(spark, sf_dir, "documents"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(read(spark, sf_dir, "documents"))
    said = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != secrets.LEARNT)
    return found.select("doc_id", *[of(k) for k in secrets.BASE], F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_lm_score, op2_syncmers, op3_license_scan, op4_feistel_shards, op5_importance_resampling, op6_decontamination, op7_best_fit_packing, op8_chat_format, op9_personal_data,
        op10_jaccard_join, op11_periodic_runs, op12_token_alignment, op13_secret_scan,
    )
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _shingles(table: str, key: str) -> str:
    """CTEs w, s (key, list of distinct shingles) of a table's texts, named after the table."""
    return rf"""w_{table} AS (SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^ \t-\r]+') AS w FROM {table}),
s_{table} AS (SELECT {key}, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w_{table})"""


#: One row a conversation, from the rows as they are: what the formatted text must give back.
CHAT_SQL = r"""WITH said AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) v),
r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM said),
e AS (SELECT *, length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 23 AS chars FROM r),
c AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns, coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss, CAST(sum(chars) AS BIGINT) AS formatted_chars FROM e GROUP BY 1)
SELECT CAST(conv_id AS BIGINT) AS conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM c"""

#: Every item whose share of distinct shingles in a document reaches 0.75.
CONTAINED_SQL = f"""WITH {_shingles('documents', 'doc_id')}, {_shingles('benchmark', 'item_id')}, d AS (SELECT doc_id, unnest(s) AS x FROM s_documents), i AS (SELECT item_id, len(s) AS n, unnest(s) AS x FROM s_benchmark),
f AS (SELECT doc_id, item_id, n, count(*) AS k FROM d JOIN i ON d.x = i.x GROUP BY 1, 2, 3) SELECT doc_id, item_id, k AS n_shared, n AS n_item, k / CAST(n AS DOUBLE) AS containment FROM f WHERE 4 * k >= 3 * n"""

#: Links by exact sets, components by following links until no new pair is reached.
COMPONENTS_SQL = f"""WITH RECURSIVE {_shingles('documents', 'doc_id')}, n AS (SELECT doc_id, len(s) AS n FROM s_documents), e AS (SELECT doc_id, unnest(s) AS x FROM s_documents),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b), c AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1)
SELECT n.doc_id, n.n AS n_shingles, c.component_id FROM n JOIN c ON c.a = n.doc_id"""

#: Runs as islands of equal six-word windows a fixed distance apart; CRC-32 bit by bit, as DuckDB has none.
RUNS_SQL = r"""WITH i AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS w, coalesce(CAST(doc_id AS VARCHAR), '') AS s FROM documents),
k AS (SELECT *, len(w) AS n, list_transform(range(8 * length(s)), lambda i: CASE WHEN i % 8 = 0 THEN CAST(ascii(substr(s, CAST(i // 8 + 1 AS INT), 1)) AS BIGINT) ELSE 0 END) AS b FROM i),
h AS (SELECT doc_id, w, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295) AS h FROM k),
a AS (SELECT *, (h // 10) % n AS a, h // 10 AS g FROM h), p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[CAST(CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1 AS INT)]) ELSE w END AS w FROM p),
f AS (SELECT doc_id, n, unnest(range(n - 5)) AS i, w FROM d WHERE n >= 12), e AS (SELECT doc_id, n, i, array_to_string(w[i + 1:i + 6], ' ') AS x FROM f),
q AS (SELECT doc_id, a.i, b.i - a.i AS q FROM e a JOIN e b USING (doc_id, x) WHERE b.i > a.i AND 2 * (b.i - a.i) <= a.n),
o AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS o FROM q),
m AS (SELECT doc_id, min(i) AS s, max(i) - min(i) + 6 + q AS l, q FROM o GROUP BY doc_id, q, o HAVING max(i) - min(i) + 6 + q >= greatest(12, 2 * q)),
r AS (SELECT doc_id, s, l, min(q) AS q FROM m GROUP BY 1, 2, 3),
z AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS t, arg_min([s, l, q], [-l, s, q]) AS top FROM r GROUP BY 1),
u AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM r), v AS (SELECT doc_id, unnest(range(n)) AS i, unnest(w) AS x FROM d),
c AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM v ANTI JOIN u USING (doc_id, i) GROUP BY 1)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, top[1] AS start, top[2] AS length, top[3] AS period, 1000 * top[2] // top[3] AS exponent_milli, sha256(coalesce(z.t, '')) AS runs_sha256, sha256(coalesce(c.t, '')) AS collapsed_sha256
FROM d LEFT JOIN z USING (doc_id) LEFT JOIN c USING (doc_id)"""

#: The others learn models, permute, pack or hash in ways that SQL does not express; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op6_decontamination": CONTAINED_SQL, "op8_chat_format": CHAT_SQL, "op10_jaccard_join": COMPONENTS_SQL, "op11_periodic_runs": RUNS_SQL}
