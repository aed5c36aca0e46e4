"""Large deletions out of clipped ends of reads: where the clipped bases lie elsewhere on the same sequence, what is between is gone.

Clipped ends meet the reference by shared words of k bases within a bin and its neighbours, never all against all; the
words vote for a place, and the best place is aligned.  Texts move, never their words: a row has the reference of one bin and
some of its clips, and the words of that reference are an index while the row is at hand.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.operators.pairwise import align_batch

#: Clips of one bin that are looked up together; a bin with more is dealt to several rows.
SHARE = 2000


def placed_clips(clips: DataFrame, reference: DataFrame, k: int = 12, span: int = 16384, pad: int = 8) -> DataFrame:
    """The likeliest place of each of clips(clip, chrom, pos, seq) within `span` bases or a little more: clip, votes, at, part.

    Words of the clip and of the reference that are equal vote for the place that they imply for the clip's first base; the
    most votes win, then the smallest place.  `part` is the reference around it, from place `at` on.  reference(chrom, start,
    seq) comes in stretches that overlap by a clip's length and twice `pad` at least; only those near a clip are cut
    into words.  Where a clip's words are at hand more than once at a place, each of its words votes once.
    """
    bins = F.explode(F.array(*[F.floor(F.col("pos") / span) + d for d in (-1, 0, 1)]))
    near = clips.where(F.length("seq") >= k).select("clip", "chrom", "seq", bins.alias("bin"))
    parts = near.groupBy("chrom", "bin").agg(F.floor(F.count("*") / SHARE).cast("int").alias("parts"))
    near = near.join(parts, ["chrom", "bin"]).withColumn("part", F.pmod(F.xxhash64("clip"), F.col("parts") + 1).cast("int"))
    mine = near.groupBy("chrom", "bin", "part").agg(F.collect_list(F.struct("clip", "seq")).alias("clips"))
    cover = F.explode(F.sequence(F.floor(F.col("start") / span), F.floor((F.col("start") + F.length("seq")) / span)))
    stretches = reference.select("chrom", "start", "seq").withColumn("stretch", F.xxhash64("chrom", "start"))
    wanted = reference.select("chrom", F.col("start").cast("long").alias("start"), "seq").withColumn("bin", cover).join(parts, ["chrom", "bin"])
    wanted = wanted.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts")))).groupBy("chrom", "bin", "part").agg(F.collect_set(F.struct("start", "seq")).alias("stretches"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for chrom, bin_, texts, clips in zip(f.chrom, f.bin, f.stretches, f.clips, strict=True):
                spots: dict[str, dict[tuple[int, int], None]] = {}
                for x in texts:
                    start, seq = int(x["start"]), x["seq"]
                    for i in range(max(0, bin_ * span - start), min(len(seq) - k + 1, (bin_ + 1) * span - start)):
                        spots.setdefault(seq[i : i + k], {})[start, start + i] = None
                for x in clips:
                    votes: dict[tuple[int, int], int] = {}
                    for offset in range(len(x["seq"]) - k + 1):
                        for start, at in spots.get(x["seq"][offset : offset + k], ()):
                            votes[start, at - offset] = votes.get((start, at - offset), 0) + 1
                    rows += [(x["clip"], chrom, *place, n) for place, n in votes.items()]
            yield pd.DataFrame(rows, columns=["clip", "chrom", "start", "place", "votes"])

    kind = dict(clips.dtypes)
    met = mine.join(wanted, ["chrom", "bin", "part"]).select("chrom", "bin", "stretches", "clips")
    votes = met.mapInPandas(run, f"clip {kind['clip']}, chrom {kind['chrom']}, start long, place long, votes long")
    # A word is in one bin, so the votes of bins add up
    votes = votes.groupBy("clip", F.xxhash64("chrom", F.col("start").cast(dict(reference.dtypes)["start"])).alias("stretch"), "place").agg(F.sum("votes").alias("votes"))
    best = votes.groupBy("clip").agg(F.max_by(F.struct("place", "stretch", "votes"), F.struct("votes", -F.col("place"), "stretch")).alias("b")).select("clip", "b.*")
    found = best.join(clips.select("clip", F.length("seq").alias("n")), "clip").join(stretches, "stretch")
    low = F.greatest(F.col("place") - pad, F.col("start"))
    part = F.substring(F.col("seq"), (low - F.col("start") + 1).cast("int"), (F.col("n") + (F.col("place") - low) + pad).cast("int"))
    return found.select("clip", "votes", low.alias("at"), part.alias("part"))


def large_deletions(clips: DataFrame, reference: DataFrame, k: int = 12, span: int = 16384, identity: float = 0.85, clipped: float = 0.15, least: int = 1) -> DataFrame:
    """chrom, start, end, support (reads), ends (clip, head or tail, that show it) of clips(chrom, side, pos, seq).

    A clip counts where it aligns with `identity` of its columns equal and at most `clipped` of its bases left at either
    end, `least` bases or more from where it was clipped: what is between is deleted.  Equal clips are aligned once.  Clips
    shorter than k, null ones, and ones without a shared word have no place.
    """
    each = clips.where("seq is not null").groupBy("chrom", "side", "pos", "seq").agg(F.count("*").alias("n")).withColumn("clip", F.concat_ws(":", "chrom", "side", "pos", "seq"))
    found = each.join(placed_clips(each, reference, k, span), "clip")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for x, r in zip(align_batch(list(zip(f.seq, f.part, strict=True))), f.itertuples(), strict=True):
                size = len(r.seq)
                if not x.states or x.states.count("=") < identity * len(x.states) or max(x.a_start, size - x.a_end) > clipped * size:
                    continue
                # Clipped bases that the alignment leaves belong to it all the same
                left, right = r.at + x.b_start - x.a_start, r.at + x.b_end + size - x.a_end
                if right + least <= r.pos:
                    rows.append((r.chrom, right, r.pos, r.n, r.side))
                elif left >= r.pos + least:
                    rows.append((r.chrom, r.pos, left, r.n, r.side))
            yield pd.DataFrame(rows, columns=["chrom", "start", "end", "n", "side"])

    hits = found.select("chrom", "side", "pos", "seq", "n", "at", "part").mapInPandas(run, "chrom string, start long, end long, n long, side string")
    return hits.groupBy("chrom", "start", "end").agg(F.sum("n").alias("support"), F.array_sort(F.collect_set("side")).alias("ends"))


def merged_deletions(found: DataFrame, slack: int = 10) -> DataFrame:
    """Deletions whose starts are within `slack` bases of the one before, in order of start, as one: the best supported, with all support.

    A window over one sequence's deletions holds one row for each place that a clip shows, not reads.
    """
    order = Window.partitionBy("chrom").orderBy("start", "end")
    new = (F.col("start") - F.lag("start").over(order) > slack) | (F.abs(F.col("end") - F.lag("end").over(order)) > slack)
    rows = found.withColumn("group", F.sum(F.when(F.coalesce(new, F.lit(True)), 1).otherwise(0)).over(order))
    best = F.max_by(F.struct("start", "end"), F.struct("support", -F.col("start"), -F.col("end")))
    out = rows.groupBy("chrom", "group").agg(best.alias("b"), F.sum("support").alias("support"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ends")))).alias("ends"))
    return out.select("chrom", "b.start", "b.end", "support", "ends")
