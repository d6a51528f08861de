"""Document fingerprints by winnowing, in DataFrame expressions only.

Words ``[^\\x20\\x09-\\x0D]+`` are hashed, each run of ``k`` word hashes gives a
gram hash, and of every ``window`` consecutive grams the smallest is chosen, the
rightmost on ties, with its position. Two texts that share ``window + k - 1``
consecutive words therefore share a chosen gram.

A gram is chosen exactly if some window holds it with nothing smaller to its
left and nothing as small to its right, which is a test on its neighbours: no
nested loop over windows, one pass per text, linear in its length.

Defined results: null counts as empty; a text of fewer than ``k`` words has one
gram of all its words; a text of no words has the empty fingerprint, and two
empty fingerprints have likeness 1; fewer grams than ``window`` make one window.
Rows equal in doc_id follow one another by text; null doc_id comes last.
Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import words_of

K, WINDOW = 5, 4
#: Documents in a range of ids, handled by one sort.
RANGE_ROWS = 2000



def winnow(df: DataFrame, text: Column, out: str, k: int = K, window: int = WINDOW) -> DataFrame:
    """Adds ``out``: array of (h long, pos int), the chosen grams in order of position."""
    w, g = f"{out}__w", f"{out}__g"
    df = df.withColumn(w, F.transform(words_of(F.coalesce(text, F.lit(""))), lambda x: F.xxhash64(x)))
    whole = F.when(F.size(w) > 0, F.array(F.aggregate(w, F.lit(42).cast("long"), lambda acc, x: F.xxhash64(acc, x)))).otherwise(F.array().cast("array<bigint>"))
    rolled = F.transform(F.slice(w, F.lit(1), F.size(w) - (k - 1)), lambda x, i: F.xxhash64(x, *[F.get(F.col(w), i + j) for j in range(1, k)]))
    df = df.withColumn(g, F.when(F.size(w) >= k, rolled).otherwise(whole))

    def chosen(x: Column, i: Column) -> Column:
        # lefts[j]: the j grams before are no smaller; rights[j]: the j grams after are larger
        lefts = [F.lit(True)]
        rights = [F.lit(True)]
        for j in range(1, window):
            lefts.append(lefts[-1] & (i >= j) & (F.get(F.col(g), i - j) >= x))
            rights.append(rights[-1] & (i + j < F.size(g)) & (F.get(F.col(g), i + j) > x))
        found = lefts[window - 1] & rights[0]
        for r in range(1, window):
            found = found | (lefts[window - 1 - r] & rights[r])
        return found

    picked = F.filter(F.transform(F.col(g), lambda x, i: F.when(chosen(x, i), F.struct(x.alias("h"), i.alias("pos")))), lambda s: s.isNotNull())
    least = F.array_min(g)
    last = F.size(g) - F.array_position(F.reverse(g), least).cast("int")
    short = F.when(F.size(g) > 0, F.array(F.struct(least.alias("h"), last.alias("pos")))).otherwise(F.array().cast("array<struct<h:bigint,pos:int>>"))
    return df.withColumn(out, F.when(F.size(g) >= window, picked).otherwise(short)).drop(w, g)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two sets of chosen hashes."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(both, F.lit(1)))


def fingerprint_string(grams: Column) -> Column:
    """Chosen grams as ``position:hash`` in order: equal texts give equal strings."""
    return F.array_join(F.transform(grams, lambda x: F.concat(x["pos"].cast("string"), F.lit(":"), F.lower(F.hex(x["h"])))), " ")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """doc_id, grams (array of h, pos), fingerprint."""
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return winnow(base, F.col("text"), "grams", k, window).select("doc_id", "grams", fingerprint_string(F.col("grams")).alias("fingerprint"))


def with_next_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, text, next_text, bucket, key: the text that follows in ascending doc_id, and after the last the first.

    Ids fall into ranges at approximate quantiles, so that texts are sorted by
    many tasks; a range's last document takes its follower from a table of the
    ranges' first documents, of one row per range.
    """
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    # the quantiles' sketch has a fixed size; ranges are then split further by arithmetic on the id
    n, low, high = base.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    ranges = max(1, -(-n // range_rows))
    cuts = min(ranges, 1000)
    found = base.agg(F.percentile_approx("doc_id", [i / cuts for i in range(1, cuts)], 20_000)).first()[0] if low is not None and cuts > 1 else []
    edges = sorted({low, *(found or [])}) if low is not None else []
    if edges:
        upper = [*edges[1:], high + 1]
        inner = -(-ranges // len(edges))
        at = F.array_position(F.transform(F.array(*[F.lit(e) for e in upper]), lambda e: F.col("doc_id") < e), F.lit(True)).cast("int") - 1
        lo, hi = F.get(F.array(*[F.lit(e) for e in edges]), F.col("at")), F.get(F.array(*[F.lit(e) for e in upper]), F.col("at"))
        share = F.floor((F.col("doc_id") - lo).cast("double") * inner / (hi - lo).cast("double")).cast("long")
        base = base.withColumn("at", at).withColumn("bucket", F.coalesce(F.col("at").cast("long") * inner + F.least(share, F.lit(inner - 1).cast("long")), F.lit(len(edges) * inner).cast("long"))).drop("at")
    else:
        base = base.withColumn("bucket", F.lit(0).cast("long"))
    order = Window.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_last(), "text")
    firsts = base.withColumn("i", F.row_number().over(order)).where("i = 1").select("bucket", F.col("text").alias("first_text"))
    follow = firsts.select("bucket").withColumn("after", F.coalesce(F.lead("bucket").over(Window.orderBy("bucket")), F.min("bucket").over(Window.partitionBy())))
    firsts = follow.join(firsts.withColumnRenamed("bucket", "after"), "after").select("bucket", "first_text")
    held = base.withColumn("follower", F.lead("text").over(order))
    return held.join(firsts, "bucket", "left").select("bucket", "doc_id", "text", F.coalesce("follower", "first_text").alias("next_text"))


def edited_and_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and likeness to the edited and the next text.

    The edited text has the last floor(n/2) characters replaced by the next
    document's first as many, or all it has.
    """
    rows = with_next_text(docs, id_col, text_col, range_rows)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    rows = winnow(rows, F.col("text"), "grams", k, window)
    rows = winnow(rows, F.col("edited"), "edited_grams", k, window)
    rows = winnow(rows, F.col("next_text"), "next_grams", k, window)
    own, other, after = (F.col(c)["h"] for c in ("grams", "edited_grams", "next_grams"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint_string(F.col("grams")).alias("fingerprint"), fingerprint_string(F.col("edited_grams")).alias("edited_fingerprint"),
        likeness(own, other).alias("near_edited"), likeness(own, after).alias("near_next"), F.size("grams").cast("long").alias("n_grams"),
    )
