"""Spot signatures: chains of content words that follow common words, in DataFrame functions alone.

A text is lower-cased and cut into words.  Every common word (an anchor) with the next CHAIN content words behind it,
other anchors between them left out, is one signature.  Likeness is the Jaccard coefficient of signature sets, and sets
whose sizes differ too much are known to be unlike without being compared.  For searches over a corpus, documents are
partitioned by set size so that likely pairs share a partition or are in neighbouring ones, and pairs come from an
inverted index on the rarest signatures of each document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.llm.common import join_groups, stored, texts_of

#: Common words of English, German, French and Spanish; any list will do, a parameter.
ANCHORS = (
    "a an and are as at be by for from in is it not of on or that the this to was were which with "
    "als auf aus das dem den der des die ein eine für im ist mit nicht sich und von zu "
    "au aux ce dans du elle en est et il la le les par pas pour que qui sur un une "
    "al como con del el ella es las lo los no para por se su"
).split()
CHAIN = 2


def _first_full(a: Column, b: Column) -> Column:
    """a unless it is empty, else b; a is worked out once, as the value of a lambda's variable."""
    return F.element_at(F.transform(F.array(a), lambda x: F.when(F.size(x) > 0, x).otherwise(b)), 1)


def signatures(text: Column, anchors: list[str] | None = None, chain: int = CHAIN) -> Column:
    """The distinct signatures of a text, as 64-bit hashes in order.

    A text without a whole chain has its words as signatures, and one without a word has itself; an empty text has
    none.  So equal texts have equal signatures, and only empty ones have none.
    """
    low = F.lower(text)
    words = F.concat(F.lit(" "), F.regexp_replace(low, r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    some = "|".join(sorted(set(anchors or ANCHORS)))
    # Anchors are marked by | in place of the space before them: " the cat of a dog " becomes "|the cat|of|a dog ".
    marked = F.regexp_replace(words, rf" (?=(?:{some}) )", "|")
    content = r"(?:\|[^ |]++)*+ [^ |]++"
    spots = F.regexp_extract_all(marked, F.lit(rf"\|(?=([^ |]++(?:{content}){{{chain}}}))"), F.lit(1))
    spots = F.transform(spots, lambda s: F.regexp_replace(s, r"\|[^ |]+", ""))
    bare = F.filter(F.split(words, " "), lambda w: w != "")
    whole = F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.array(low))
    parts = _first_full(spots, _first_full(bare, whole))
    return F.sort_array(F.array_distinct(F.transform(parts, lambda s: F.xxhash64(s))))


def pruned_jaccard(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard coefficient of two signature sets; 1 for two empty sets.

    A search may prune: under `least`, sets whose sizes alone keep them apart get 0 without being compared.
    """
    n, m = F.size(a), F.size(b)
    bound = F.least(n, m) / F.greatest(n, m)
    both = F.size(F.array_intersect(a, b))
    return F.when((n == 0) & (m == 0), F.lit(1.0)).when((n == 0) | (m == 0) | (bound < least), F.lit(0.0)).otherwise(both / (n + m - both))


def fingerprint(sigs: Column) -> Column:
    return F.sha2(F.array_join(F.transform(sigs, lambda s: s.cast("string")), ","), 256)


def following(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, n, next_id, prev_id, prev_n of each distinct doc_id: its neighbours by ascending id, in a circle.

    Ids are range-partitioned and written with the number of their part.  Within a part, neighbours come from a window;
    over its edges they come from the first and last row of each part, of which there are no more than parts.
    """
    spark = docs.sparkSession
    ids = docs.groupBy("doc_id").agg(F.max(F.length("text")).alias("n"))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = stored(ids.repartitionByRange(parts, "doc_id").withColumn("part", F.spark_partition_id()), "id-ranges")
    edges = ids.groupBy("part").agg(F.min_by("doc_id", F.coalesce("doc_id", F.lit(-(2**63)))).alias("first"), F.max_by(F.struct("doc_id", "n"), F.coalesce("doc_id", F.lit(-(2**63)))).alias("last"), F.lit(0).alias("all"))
    circle = Window.partitionBy("all").orderBy("part")
    whole = circle.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = edges.select(
        "part",
        F.when(F.lead("part").over(circle).isNull(), F.first("first").over(whole)).otherwise(F.lead("first").over(circle)).alias("after"),
        F.coalesce(F.lag("last").over(circle), F.last("last").over(whole)).alias("before"),
    )
    order = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first())
    ids = ids.select("*", F.lead("doc_id").over(order).alias("_next"), F.lag(F.struct("doc_id", "n")).over(order).alias("_prev"), F.lead("part").over(order).isNull().alias("_end"))
    out = ids.join(F.broadcast(edges), "part")
    prev = F.coalesce("_prev", "before")
    return out.select("doc_id", "n", F.when(F.col("_end"), F.col("after")).otherwise(F.col("_next")).alias("next_id"), prev["doc_id"].alias("prev_id"), prev["n"].alias("prev_n"))


def neighbour_report(docs: DataFrame) -> DataFrame:
    """Fingerprint every whole text of docs(doc_id, text) and its edited text, whose last floor(n/4) code points are
    replaced by the first as many (or all) of the document with the next larger doc_id (after the last: the first).

    Returns one row per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.  Null
    text counts as empty.  Rows that share a doc_id are all followed by the next larger doc_id, and the row with the
    largest text follows the doc_id before them.  A null doc_id comes before all others.  A table of one doc_id has it
    follow itself; an empty one gives no rows.
    """
    texts = texts_of(docs)
    links = stored(following(texts), "id-links")
    near = links.select(F.col("doc_id").alias("_id"), "prev_id", "prev_n")
    rows = texts.join(near, texts["doc_id"].eqNullSafe(F.col("_id"))).drop("_id").withColumn("n", F.length("text"))
    # Where ids come once, as they should, the rows themselves, as they are dealt here, are what follows; else one row of each id is.
    once = links.count() == texts.count()
    after = rows if once else rows.groupBy("doc_id", "prev_id", "prev_n").agg(F.max("text").alias("text"))
    # A document hands the document before it what its longest row needs: the head of its text, and its signatures.
    heads = after.select(F.col("prev_id").alias("_to"), F.expr("left(text, cast(prev_n div 4 as int))").alias("head"), signatures(F.col("text")).alias("next_sigs"))
    joined = rows.join(heads, rows["doc_id"].eqNullSafe(F.col("_to")))
    edited = F.concat(F.expr("left(text, cast(n - n div 4 as int))"), F.expr("left(head, cast(n div 4 as int))"))
    joined = joined.select("doc_id", F.col("n").cast("long").alias("n_chars"), signatures(F.col("text")).alias("sigs"), "next_sigs", edited.alias("edited"))
    joined = joined.select("*", signatures(F.col("edited")).alias("edited_sigs"))
    return joined.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        pruned_jaccard(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        pruned_jaccard(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def near_pairs(docs: DataFrame, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """All pairs of documents whose signature sets have a Jaccard coefficient of `least` or more.

    Returns (members, pairs): members(doc_id, class_id) puts documents of one signature set into one class, named by
    its smallest doc_id; pairs(a, b, likeness) holds the like pairs of different classes, a < b.  Sets are partitioned
    by the logarithm of their size, so that like sets lie in one partition or in neighbours.  Within these, like sets
    share one of the rarest signatures of each (the prefix that a set can't do without), so postings are short; sets
    without signatures are in a class of their own, and rows with a null doc_id are left out.
    """
    sigs = stored(texts_of(docs).where("doc_id is not null").select("doc_id", signatures(F.col("text")).alias("sigs")), "signatures")
    key = sigs.select("doc_id", "sigs", F.xxhash64("sigs").alias("key"))
    groups = stored(key.groupBy("sigs").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("size")), "signature-classes")
    total = sigs.count()
    members = join_groups(sigs, groups, "sigs", "size", total).select("doc_id", "class_id")
    sets = groups.select("class_id", "sigs").where(F.size("sigs") > 0)
    words = sets.select("class_id", F.explode("sigs").alias("sig"))
    often = words.groupBy("sig").agg(F.count("*").alias("df"))
    size = F.count("*").over(Window.partitionBy("class_id"))
    rank = F.row_number().over(Window.partitionBy("class_id").orderBy("df", "sig"))
    ranked = words.join(often, "sig").select("class_id", "sig", size.alias("n"), rank.alias("rank"))
    prefix = ranked.where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * F.lit(least - 1e-9)) + 1)
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(least)))
    prefix = stored(prefix.select("class_id", "sig", "n", band.alias("band")), "signature-prefixes")
    near = prefix.select(F.col("class_id").alias("b"), "sig", F.col("n").alias("m"), F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    pairs = prefix.withColumnRenamed("class_id", "a").join(near, ["sig", "band"]).where("a < b and least(n, m) >= greatest(n, m) * %r" % (least - 1e-9)).select("a", "b").distinct()
    left, right = sets.select(F.col("class_id").alias("a"), F.col("sigs").alias("x")), sets.select(F.col("class_id").alias("b"), F.col("sigs").alias("y"))
    pairs = pairs.join(left, "a").join(right, "b").select("a", "b", pruned_jaccard(F.col("x"), F.col("y"), least - 1e-9).alias("likeness"))
    return members, pairs.where(F.col("likeness") >= least - 1e-9)
