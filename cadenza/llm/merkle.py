"""Document fingerprints: Merkle trees over sections, paragraphs and runs of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.plans.materialize import cut

# Behind blank lines; behind line ends. All cut without leaving anything out, and each depends on
# the text around it alone, so an edit moves no other.
SECTION = r"(?<=\n\n)(?=[^\n])"
PARAGRAPH = r"(?<=\n)(?=[^\n])"
# Code points of scripts written without spaces (first, last, a block's step, how many of it):
# South-East Asian ones and Tibetan, kana and Bopomofo, Yi, Han and its supplements.
UNSPACED = [
    (0x0E00, 0x109F, 32, 4), (0x1780, 0x17FF, 32, 4), (0x1950, 0x1BFF, 32, 4), (0xA980, 0xAADF, 32, 4), (0x3040, 0x312F, 32, 4),
    (0xA000, 0xA48F, 1024, 64), (0x3400, 0x4DBF, 1024, 64), (0x4E00, 0x9FFF, 1024, 64), (0x20000, 0x3FFFF, 0x8000, 0x800),
]
_STARTS = "".join(f"{chr(a)}-{chr(a + n - 1)}" for first, last, step, n in UNSPACED for a in range(first, last + 1, step))
# Before words of 4, 8, 12 … characters, in any script; within a run of characters, before those of the list.
SPACED = r"(?<= )(?=(?:[^ \n]{4})++(?![^ \n]))"
LEAF = rf"{SPACED}|(?<=[^ \n])(?=[{_STARTS}])"
# All characters of the list are among these; without them, the first half of the rule is all of it.
MAY_BE_UNSPACED = f"[{chr(0x0E00)}-{chr(0x1BFF)}{chr(0x3040)}-{chr(0x3FFFF)}]"


def _digest(text: Column) -> Column:
    """128 bits of SHA-256, as 32 hexadecimal digits."""
    return F.substring(F.sha2(text, 256), 1, 32)


def _leaves(paragraph: Column) -> Column:
    return F.when(paragraph.rlike(MAY_BE_UNSPACED), F.split(paragraph, LEAF)).otherwise(F.split(paragraph, SPACED))


def fingerprint(text: Column) -> Column:
    """The Merkle tree of a text (null: empty) as a string: ``root:leaves``.

    Sections are cut behind blank lines, paragraphs behind line ends, leaves are runs of some
    words of a paragraph: one ends before each word whose length is a multiple of 4 characters,
    and, in scripts written without spaces, before each character of a fixed share. A node's digest is that of its children's digests; the root has 64
    digits. Behind it stand the first 8 digits of every leaf, in order: ``,`` parts the leaves of
    a paragraph, ``;`` paragraphs, ``/`` sections. Texts are equal if and only if their roots are.
    """
    sections = F.transform(
        F.split(F.coalesce(text, F.lit("")), SECTION),
        lambda section: F.transform(
            F.split(section, PARAGRAPH), lambda paragraph: F.transform(_leaves(paragraph), lambda leaf: _digest(leaf))
        ),
    )

    def node(paragraphs: Column) -> Column:
        return F.array_join(F.transform(paragraphs, lambda leaves: _digest(F.array_join(leaves, ","))), ",")

    def shown(paragraphs: Column) -> Column:
        return F.array_join(
            F.transform(paragraphs, lambda leaves: F.array_join(F.transform(leaves, lambda d: F.substring(d, 1, 8)), ",")), ";"
        )

    # one pass makes both parts of each section, so the leaves are hashed once
    parts = F.transform(sections, lambda p: F.struct(_digest(node(p)).alias("digest"), shown(p).alias("shown")))
    return F.aggregate(
        F.array(parts),
        F.lit(""),
        lambda _, p: F.concat(
            F.sha2(F.array_join(F.transform(p, lambda x: x["digest"]), ","), 256), F.lit(":"), F.array_join(F.transform(p, lambda x: x["shown"]), "/")
        ),
    )


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two fingerprints, 0 to 1: equal roots make 1, else the share of the larger one's different leaves that both have."""
    left, right = (F.array_distinct(F.split(F.substring(x, 66, 1 << 30), "[,;/]")) for x in (a, b))
    shared = F.size(F.array_intersect(left, right)) / F.greatest(F.size(left), F.size(right))
    return F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), 1.0).otherwise(shared)


def _paragraphs(print_: Column) -> Column:
    return F.split(F.substring(print_, 66, 1 << 30), "[;/]")


def changed(a: Column, b: Column) -> Column:
    """The different paragraphs of ``a``, as their leaves, that ``b`` has at no place, in linear time;
    none where the roots are equal. Paragraphs put in, taken out or moved around them change nothing."""
    none = F.array().cast("array<string>")
    return F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), none).otherwise(F.array_except(_paragraphs(a), _paragraphs(b)))


def edits(a: Column, b: Column) -> Column:
    """Numbers (from 0, over all sections) of the ``changed`` paragraphs of ``a``."""
    found = changed(a, b)
    return F.filter(F.transform(_paragraphs(a), lambda x, i: F.when(F.array_contains(found, x), i)), lambda i: i.isNotNull())


def next_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, need, next_id, next_hash) per different id: the next one downwards, the largest after the smallest.

    ``need`` is half the length of the id's longest text, ``next_hash`` the smallest hash of the
    next id's texts. Ids are dealt to ranges, each looks within its range, and only one row per
    range is ordered over all of them. A null id is below all others.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    ids = docs.groupBy(F.col(id_column).alias("id")).agg(
        F.min(F.xxhash64(text)).alias("hash"), F.max(F.floor(F.length(text) / 2)).cast("int").alias("need")
    )
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(ids.repartitionByRange(n, F.desc("id")).withColumn("range_", F.spark_partition_id()), "ids")
    one = F.struct(F.col("id").isNotNull().alias("known"), "id", "hash")
    heads = dealt.groupBy("range_").agg(F.max(one).alias("head"))
    upwards = Window.orderBy("range_")
    whole = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("range_", F.coalesce(F.lead("head").over(upwards), F.first("head").over(whole)).alias("follows"))
    inside = F.lead(one).over(Window.partitionBy("range_").orderBy(F.desc("id")))
    found = dealt.withColumn("inside", inside).join(heads, "range_").withColumn("n", F.coalesce("inside", "follows"))
    return found.select("id", "need", F.col("n.id").alias("next_id"), F.col("n.hash").alias("next_hash"))


def fingerprint_edits(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: (id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, n_changed).

    The edited text is the text with its last ``floor(n_chars / 2)`` characters replaced by the
    first as many (or all) of the next document's, downwards by id and round at the end.
    ``near_edited`` and ``near_next`` are the likeness of the fingerprint to those of the edited
    text and of the next document; ``n_changed`` counts the different paragraphs that the
    edited text has at no place.

    Texts are moved once, by id, and both joins read them from there; what a document gives to
    the one before it is only as much as that one replaces, and its fingerprint.

    A null text is empty; empty texts have a fingerprint of their own. A null id is the lowest.
    Rows that repeat an id each get a row, and stand for their id as next document by the text
    of the smallest hash; a lone id is its own next document. An empty table gives an empty one.
    Other columns are not read.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    # as structs, ids can be null and equal, and all joins and the folding have the same key
    rows = docs.select(F.struct(F.col(id_column).alias("id")).alias("key"), text.alias("text"))
    order = next_documents(docs, id_column, text_column)
    order = order.select(F.struct("id").alias("for_key"), "need", F.struct(F.col("next_id").alias("id")).alias("next_key"), "next_hash")
    # not an equality of columns: both joins are to have the same key, so that the texts' shuffle serves both
    same_text = F.xxhash64("text").bitwiseXOR(F.col("next_hash")) == 0
    given = rows.join(order, F.col("key") == F.col("next_key")).where(same_text)
    given = given.select("for_key", F.substring(F.col("text"), F.lit(1), F.col("need")).alias("given"), fingerprint(F.col("text")).alias("next_print"))
    given = given.dropDuplicates(["for_key"])
    joined = rows.join(given, F.col("key") == F.col("for_key"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("given"), F.lit(1), half))
    joined = joined.select(F.col("key.id").alias("id"), fingerprint(F.col("text")).alias("print"), "next_print", n.cast("long").alias("n_chars"), edited.alias("edited"))
    joined = joined.withColumn("edited_print", fingerprint(F.col("edited")))
    return joined.select(
        F.col("id").alias(id_column),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        F.col("print").alias("fingerprint"),
        F.col("edited_print").alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
        F.size(changed(F.col("print"), F.col("edited_print"))).alias("n_changed"),
    )
