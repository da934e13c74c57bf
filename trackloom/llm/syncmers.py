"""Document fingerprints from closed syncmers of words, in DataFrame functions only.

A k-mer is k consecutive words; it is a closed syncmer if the least of its s-mers (by hash) is its first or its last one.
That depends on the k-mer alone, so an edit elsewhere never moves an anchor. A fingerprint holds the `size` anchors of
least hash, each with the first position that it has. Two are matched by position: the likeness is the share, among the
`size` least hashes of both, of the common anchors that follow one another in both texts, so an insertion costs little and
the same phrases in another order cost much. shift() gives the displacement that most common anchors agree on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.llm.common import let, stored, text_or_empty

K, S, SIZE = 5, 2, 64
BLANKS = "\t\n\x0b\x0c\r "


def _hashed(text: Column) -> Column:
    """The hash of every word of the text, in order; lower case."""
    bare = F.btrim(F.lower(text), F.lit(BLANKS))
    return F.when(F.length(bare) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.split(bare, r"[\x20\x09-\x0D]+"), lambda w: F.xxhash64(w)))


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """Array of (pos, hash) of the closed syncmers of a text, by word position.

    A text of k words or more without any has the first k-mer with the least s-mer instead, one of 1 to k-1 words is one
    anchor as a whole: only a text without words has none.
    """

    def found(h: Column) -> Column:
        inner = F.transform(h, lambda x, i: F.xxhash64(*[F.get(h, i + j) for j in range(s)]))
        last = k - s

        def pick(m: Column) -> Column:
            edge = lambda i: F.least(F.get(m, i), F.get(m, i + last)) <= F.least(*[F.get(m, i + j) for j in range(1, last)], *([F.get(m, i + 1)] if last == 2 else []))
            places = F.sequence(F.lit(0), F.size(h) - k)
            least = lambda i: F.struct(F.least(*[F.get(m, i + j) for j in range(last + 1)]).alias("low"), i.alias("i"))
            chosen = let(F.filter(places, edge), lambda c: F.when(F.size(c) > 0, c).otherwise(F.array(F.array_min(F.transform(places, least))["i"])))
            cover = [*range(0, k - s + 1, s), *([k - s] if (k - s) % s else [])]  # s-mers that together hold every word
            return F.transform(chosen, lambda i: F.struct(i.alias("pos"), F.xxhash64(*[F.get(m, i + j) for j in cover]).alias("hash")))

        whole = F.array(F.struct(F.lit(0).alias("pos"), F.xxhash64(h, F.size(h)).alias("hash")))
        return F.when(F.size(h) >= k, let(inner, pick)).when(F.size(h) > 0, whole).otherwise(F.array().cast("array<struct<pos:int,hash:bigint>>"))

    return let(_hashed(text), found)


def sketch(text: Column, size: int = SIZE, k: int = K, s: int = S) -> Column:
    """Array of (hash, pos): the `size` anchors of least hash, ascending, each hash once at its first position."""
    by_hash = F.array_sort(F.transform(anchors(text, k, s), lambda a: F.struct(a["hash"].alias("hash"), a["pos"].alias("pos"))))
    once = let(by_hash, lambda a: F.filter(a, lambda x, i: (i == 0) | (F.get(a, i - 1)["hash"] != x["hash"])))
    return F.slice(once, 1, size)


def as_text(fingerprint: Column) -> Column:
    """Each anchor as 16 hexadecimal digits, @ and its position; anchors parted by blanks."""
    return F.array_join(F.transform(fingerprint, lambda a: F.concat(F.lower(F.lpad(F.hex(a["hash"]), 16, "0")), F.lit("@"), a["pos"].cast("string"))), " ")


def likeness(a: Column, b: Column, size: int = SIZE) -> Column:
    """0 to 1; two empty fingerprints are alike."""
    hashes = lambda x: F.transform(x, lambda y: y["hash"])

    def matched(u: Column) -> Column:
        common = lambda c, x: F.filter(x, lambda y: F.array_contains(c, y["hash"]))
        places = lambda c: F.array_sort(F.zip_with(common(c, a), common(c, b), lambda x, y: F.struct(x["pos"].alias("a"), y["pos"].alias("b"))))
        follow = lambda p: F.size(F.filter(p, lambda x, i: (i == 0) | (F.get(p, i - 1)["b"] <= x["b"])))
        return let(F.array_intersect(F.array_intersect(hashes(a), hashes(b)), u), lambda c: let(places(c), follow)) / F.size(u)

    both = let(F.slice(F.array_sort(F.array_union(hashes(a), hashes(b))), 1, size), matched)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both)


def shift(a: Column, b: Column) -> Column:
    """How many words later the anchors of b stand than the same anchors of a, by most votes (ties: the least shift); null without common anchors."""
    votes = F.flatten(F.transform(a, lambda x: F.transform(F.filter(b, lambda y: y["hash"] == x["hash"]), lambda y: y["pos"] - x["pos"])))
    tallied = lambda v: F.transform(F.array_distinct(v), lambda d: F.struct(F.size(F.filter(v, lambda x: x == d)).alias("n"), (-d).alias("d")))
    return let(votes, lambda v: F.when(F.size(v) > 0, -F.array_max(tallied(v))["d"]))


KEY = ["no_id", "i", "h"]


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs as (id, text, n, piece, following): what the next document gives to each, its first floor(n / 4) code points and its sketch.

    Ascending id, a null id first, ties by the text's hash; after the last the first. The order is found from ids and
    hashes alone, range by range; a range takes the first of the next range as its last one's next. Texts are dealt by id
    and hash, once, and each sends only what its predecessor needs.
    """
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).isNull().alias("no_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("i"), F.xxhash64(text).alias("h"), text.alias("text"))
    keys = rows.groupBy(*KEY).agg(F.count("*").alias("copies"), F.max(F.length("text")).alias("n"))
    order = F.struct((~F.col("no_id")).alias("has_id"), "i", "h")
    ranged = stored(keys.withColumn("o", order).repartitionByRange("o").withColumn("p", F.spark_partition_id()))
    over = Window.orderBy("p")  # a row a range
    firsts = ranged.groupBy("p").agg(F.min("o").alias("f"))
    firsts = firsts.select("p", F.coalesce(F.lead("f").over(over), F.first("f").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("f"))
    lead = F.lead("o").over(Window.partitionBy("p").orderBy("o"))
    follow = ranged.withColumn("x", lead).join(F.broadcast(firsts), "p").withColumn("x", F.coalesce("x", "f"))
    to = F.struct(*KEY, "copies", F.floor(F.col("n") / 4).cast("int").alias("q"))
    wanted = follow.select((~F.col("x.has_id")).alias("no_id"), F.col("x.i").alias("i"), F.col("x.h").alias("h"), to.alias("to"))

    rows = rows.repartition(*KEY).withColumn("r", F.row_number().over(Window.partitionBy(*KEY).orderBy("h")))
    given = rows.where("r = 1").join(wanted, KEY)
    given = given.select(*[F.col(f"to.{k}").alias(k) for k in KEY], F.col("to.copies").alias("copies"), F.substring(F.col("text"), F.lit(1), F.col("to.q")).alias("piece"), sketch(F.col("text")).alias("following"))
    # of repeated rows only the last one is followed by another document, the others by their like
    own = F.col("r") < F.col("copies")
    out = rows.join(given, KEY)
    n = F.length("text")
    piece = F.when(own, F.substring(F.col("text"), F.lit(1), F.floor(n / 4).cast("int"))).otherwise(F.col("piece"))
    return out.select(F.when(~F.col("no_id"), F.col("i")).alias("id"), "text", n.alias("n"), piece.alias("piece"), F.when(~own, F.col("following")).alias("following"))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or all) of the next
    document's text, by ascending id, after the last the first. Null and empty texts have an empty fingerprint, alike
    with an empty one (1) and with no other (0). Rows with one id are in order of a hash of their texts; a null id comes
    first. A single document is its own next. An empty table gives an empty result. Other columns are not read.
    """
    rows = with_next(docs, id_col, text_col)
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n") - F.floor(F.col("n") / 4).cast("int")), F.col("piece"))
    rows = rows.select("id", "n", sketch(F.col("text")).alias("own"), edited.alias("edited"), "following")
    rows = rows.withColumn("changed", sketch(F.col("edited"))).withColumn("following", F.coalesce("following", "own"))
    return rows.select(
        F.col("id").alias(id_col),
        F.col("n").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
    )


__all__ = ["anchors", "as_text", "fingerprint_documents", "likeness", "shift", "sketch", "with_next"]
