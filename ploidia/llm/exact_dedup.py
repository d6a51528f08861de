"""Exact deduplication by deterministic block naming.

Each normalised text is cut into fixed-size byte blocks. The distinct blocks
are sorted and numbered; adjacent numbers are paired, the distinct pairs sorted
and numbered again, until one number stands for the whole text. Numbers stand
for contents compared byte by byte, so equal (length, number) means equal text.

Texts travel once, already reduced to distinct blocks on the map side. Documents
find their blocks' numbers through a 128-bit key; that no two distinct blocks
share a key is checked on the distinct blocks, and a clash changes the salt, so
the key can't cause a wrong result. Every join is between a unique side and an
occurrence side, which adaptive execution splits when one block is hot.

Defined results: null text counts as empty; null doc_id sorts below all others;
of rows equal in text and doc_id (repeated rows) exactly one is kept; an empty
table gives an empty result; other columns are never read by ``exact_groups``
and pass through ``drop_exact_copies`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, staged

BLOCK_BYTES = 4096


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = ascii_lower(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.cast("binary").alias("body"))


def _blocks(block_bytes: int):
    """Fixed-size slices of ``body``; an empty body has one empty block."""
    last = F.greatest(F.lit(0), F.ceil(F.octet_length("body") / block_bytes).cast("int") - 1)
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col("body"), i * block_bytes + 1, F.lit(block_bytes)))


def _key(salt: int, block) -> list:
    return [F.xxhash64(F.lit(2 * salt), block).alias("k1"), F.xxhash64(F.lit(2 * salt + 1), block).alias("k2")]


def _numbered(distinct: DataFrame, by: list[str], keep: list[str], name: str) -> DataFrame:
    """Sorts distinct contents and numbers them: (partition, rank in it) in one long."""
    return staged(distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id()).select(*keep, "name"), name)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_bytes, n_blocks."""
    base = _base(docs, id_col, text_col)
    salt = 0
    while True:
        rows = staged(
            base.select(
                F.monotonically_increasing_id().alias("rid"), "doc_id", F.octet_length("body").alias("n_bytes"), F.sha2("body", 256).alias("text_sha256"),
                F.transform(_blocks(block_bytes), lambda b: F.struct(*_key(salt, b))).alias("seq"),
            ),
            "exact-rows",
        )
        distinct = base.select(F.explode(_blocks(block_bytes)).alias("block")).select(*_key(salt, F.col("block")), "block").distinct()
        names = _numbered(distinct, ["block"], ["k1", "k2"], "exact-blocks")
        if names.groupBy("k1", "k2").count().where("count > 1").isEmpty():
            break
        salt += 1

    longest = rows.agg(F.max(F.size("seq"))).first()[0] or 0
    parts = rows.select("rid", F.size("seq").alias("n"), F.posexplode("seq").alias("pos", "k")).select("rid", "n", "pos", "k.k1", "k.k2")
    level = _sequences(parts.join(names, ["k1", "k2"]), "exact-level")
    ends = [level.where("n = 1")]
    while longest > 1:
        # an odd tail pairs with -1, which is no name
        pairs = F.transform(F.sequence(F.lit(0), F.expr("(n - 1) div 2").cast("int")), lambda i: F.struct(F.get("seq", 2 * i).alias("a"), F.coalesce(F.get("seq", 2 * i + 1), F.lit(-1)).alias("b")))
        parts = level.where("n > 1").select("rid", F.expr("((n + 1) div 2)").cast("int").alias("n"), F.posexplode(pairs).alias("pos", "p")).select("rid", "n", "pos", "p.a", "p.b")
        names = _numbered(parts.select("a", "b").distinct(), ["a", "b"], ["a", "b"], "exact-pairs")
        level = _sequences(parts.join(names, ["a", "b"]), "exact-level")
        ends.append(level.where("n = 1"))
        longest = (longest + 1) // 2

    named = ends[0]
    for more in ends[1:]:
        named = named.unionByName(more)
    whole = staged(rows.select("rid", "doc_id", "n_bytes", "text_sha256", F.size("seq").alias("n_blocks")).join(named.select("rid", F.get("seq", F.lit(0)).alias("name")), "rid"), "exact-named")
    # written, so that the join's sides are plain tables and one group of very many copies is split over tasks
    groups = staged(whole.groupBy("n_bytes", "name").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "rid")).alias("best")), "exact-groups")
    return whole.join(groups, ["n_bytes", "name"]).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("best.rid")).alias("kept"), "text_sha256", "n_bytes", "n_blocks"
    )


def _sequences(parts: DataFrame, name: str) -> DataFrame:
    """One row per document: its names in order."""
    return staged(parts.groupBy("rid").agg(F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("seq")), name)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    A kept (id, text) that stands in several repeated rows stays once.
    """
    kept = staged(exact_groups(docs, id_col, text_col, block_bytes).groupBy("doc_id", "text_sha256").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("copies")).where("kept"), "exact-kept")
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("doc_id"), F.sha2(ascii_lower(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).cast("binary"), 256).alias("text_sha256"))
    joined = inner.alias("d").join(kept.alias("k"), F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("d.text_sha256") == F.col("k.text_sha256"))).select("d.row", "d.doc_id", "d.text_sha256", "k.copies")
    once = joined.where("copies = 1").select("row")
    repeated = joined.where("copies > 1").groupBy("doc_id", "text_sha256").agg(F.first("row").alias("row")).select("row")
    return once.unionByName(repeated).select("row.*")
