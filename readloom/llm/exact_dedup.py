"""Exact duplicates by content-defined chunk recipes.

A text is cut where a rolling hash of its last 32 bytes hits a pattern, so a cut depends on nearby content only.  Each
chunk is named by a digest; digests are verified once per distinct chunk (chunks, not documents, are moved, and equal
chunks meet in the map-side aggregation), and a digest that stands for several contents gets one number per content.
A document is then the ordered list of its verified chunk identifiers, and texts are equal exactly when these lists are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.llm.common import fresh, join_groups, small_batches, stored, texts_of

LEAST, MOST, MEAN_BITS, WINDOW, SLAB = 1024, 16384, 12, 32, 1 << 20


def _gear() -> np.ndarray:
    """256 fixed random words, by the SplitMix64 rule."""
    with np.errstate(over="ignore"):
        z = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


GEAR = _gear()


def _marks(data: bytes) -> np.ndarray:
    """Ends of windows whose hash has MEAN_BITS leading zeros; slabs bound the memory for long texts."""
    found = []
    for at in range(0, len(data), SLAB):
        lead = min(at, WINDOW - 1)
        h = GEAR[np.frombuffer(data, np.uint8, min(SLAB, len(data) - at) + lead, at - lead)]
        for s in (1, 2, 4, 8, 16):
            h[s:] += h[:-s] << np.uint64(s)
        found.append(np.flatnonzero(h[lead:] >> np.uint64(64 - MEAN_BITS) == 0) + at + 1)
    return np.concatenate(found)


def chunks(data: bytes) -> list[bytes]:
    """The content-defined chunks of data: LEAST to MOST bytes each, the last may be shorter; none for no bytes."""
    if len(data) <= LEAST:
        return [data] if data else []
    out, start = [], 0
    for mark in _marks(data).tolist():
        while mark - start > MOST:
            out.append(data[start : start + MOST])
            start += MOST
        if mark - start >= LEAST:
            out.append(data[start:mark])
            start = mark
    while start < len(data):
        out.append(data[start : start + MOST])
        start += MOST
    return out


def _recipes(digest_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sha, recipe = [], []
            for text in b.column(1).to_pylist():
                data = text.encode()
                sha.append(hashlib.sha256(data).hexdigest())
                recipe.append(b"".join(_name(c, digest_bytes) for c in chunks(data)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sha, pa.string()), pa.array(recipe, pa.binary())], ["doc_id", "text_sha256", "recipe"])

    return run


def _name(chunk: bytes, digest_bytes: int) -> bytes:
    return hashlib.blake2b(chunk, digest_size=digest_bytes).digest()


def _contents(digest_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[bytes, bytes] = {}
            ids, pos, names, parts = [], [], [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for i, c in enumerate(chunks(text.encode())):
                    ids.append(doc_id)
                    pos.append(i)
                    names.append(seen.setdefault(n := _name(c, digest_bytes), n))
                    parts.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(pos, pa.int32()), pa.array(names, pa.binary()), pa.array(parts, pa.binary())], [b.schema.names[0], "pos", "name", "content"])

    return run


def recipes(docs: DataFrame, digest_bytes: int = 16) -> DataFrame:
    """One row per row of docs: doc_id, text_sha256, recipe (verified chunk identifiers in order, as one binary).

    Equal recipes mean equal texts, always: where a digest stands for several contents (the count of such digests is
    the only figure the driver sees), its documents get the number of the content after each identifier.
    """
    small_batches(docs.sparkSession)
    texts = texts_of(docs)
    named = stored(texts.mapInArrow(_recipes(digest_bytes), "doc_id long, text_sha256 string, recipe binary"), "recipes")
    parts = texts.mapInArrow(_contents(digest_bytes), "doc_id long, pos int, name binary, content binary")
    shared = parts.groupBy("name", "content").agg(F.lit(1).alias("one")).groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name")
    shared = stored(shared, "shared-digests")
    if shared.isEmpty():
        return named
    unclear = parts.join(shared, "name", "left_semi")
    order = Window.partitionBy("name").orderBy("content")
    numbers = unclear.select("name", "content").distinct().withColumn("number", F.row_number().over(order))
    # Here a document is named by the digest of its whole text, as doc_id may repeat or be null.
    by_sha = texts.select(F.sha2("text", 256).alias("text_sha256"), "text").dropDuplicates(["text_sha256"])
    parts = by_sha.mapInArrow(_contents(digest_bytes), "text_sha256 string, pos int, name binary, content binary")
    number = F.to_binary(F.lpad(F.hex(F.coalesce("number", F.lit(0))), 16, "0"), F.lit("hex"))
    listed = F.sort_array(F.collect_list(F.struct("pos", F.concat("name", number).alias("id"))))
    exact = parts.join(numbers, ["name", "content"], "left").groupBy("text_sha256").agg(listed.alias("ids"))
    exact = exact.select("text_sha256", F.aggregate("ids", F.lit(b""), lambda a, x: F.concat(a, x["id"])).alias("exact"))
    return named.drop("recipe").join(exact, "text_sha256", "left").select("doc_id", "text_sha256", F.coalesce("exact", F.lit(b"")).alias("recipe"))


def exact_duplicates(docs: DataFrame, digest_bytes: int = 16) -> DataFrame:
    """Group equal texts of docs(doc_id, text).

    Returns doc_id, keep_id (the largest doc_id of the group), group_size, kept, text_sha256; one row per row.  A null
    text counts as empty, and empty texts are equal.  Repeated rows of one document count in group_size and are all
    kept or all dropped.  A null doc_id is kept only if no row of its group has an id.  An empty table gives no rows.
    """
    named = stored(recipes(docs, digest_bytes), "named")
    total = named.count()
    groups = named.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    out = join_groups(named, stored(groups, "groups"), "recipe", "group_size", total)
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs whose text is not repeated by a row with a larger doc_id; all columns of docs.

    Repeated rows (same doc_id, same text) are reduced to one.  Only ids move to find what goes.
    """
    found = stored(exact_duplicates(docs), "exact")
    gone, sha = fresh(docs, "dropped", "sha")
    dropped = found.where("not kept").select(F.col("doc_id").alias(gone), F.col("text_sha256").alias(sha)).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(gone)) & (F.sha2(F.coalesce(docs["text"], F.lit("")), 256) == F.col(sha))
    kept = docs.join(dropped, same, "left_anti")
    repeated = found.where("kept and group_size > 1").groupBy("doc_id").count().where("count > 1")
    return kept if repeated.isEmpty() else kept.dropDuplicates(["doc_id", "text"])
