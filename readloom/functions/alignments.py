"""Column functions on aligned reads: flags, CIGAR, MD tags.  All are built-in expressions.

A CIGAR column is an array of structs (op, len), from `cigar(text)`; positions are 0-based, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The bits of the flag field.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, FIRST, SECOND, SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = (1 << i for i in range(12))


def has_flag(flag: Column, bits: int) -> Column:
    """Any of the bits is set."""
    return flag.bitwiseAND(F.lit(bits)) != 0


def passes_mask(flag: Column, mask: int) -> Column:
    """No bit of the mask is set; mask 0 passes all."""
    return flag.bitwiseAND(F.lit(mask)) == 0


def good_alignment(flag: Column, keep_duplicates: bool = False) -> Column:
    """Mapped, primary, not failed, not a duplicate unless these are kept, and properly paired if paired."""
    bad = UNMAPPED | SECONDARY | SUPPLEMENTARY | QC_FAIL | (0 if keep_duplicates else DUPLICATE)
    return passes_mask(flag, bad) & (~has_flag(flag, PAIRED) | has_flag(flag, PROPER))


def fit_to_realign(flag: Column, md: Column, length: Column, mapq: Column, mismatched: Column, least_length: int | None = None, least_mapq: int | None = None, most_mismatched: float | None = None, keep_duplicates: bool = False) -> Column:
    """A good alignment with MD that is long enough, of enough mapping quality, and has at most a share of its bases mismatched.

    Limits that are None don't hold; a null MD, or a null where a limit holds, doesn't fit.
    """
    fit = good_alignment(flag, keep_duplicates) & md.isNotNull()
    if least_length is not None:
        fit = fit & (length >= least_length)
    if least_mapq is not None:
        fit = fit & (mapq >= least_mapq)
    if most_mismatched is not None:
        fit = fit & (mismatched <= length * most_mismatched)
    return F.coalesce(fit, F.lit(False))


def cigar(text: Column) -> Column:
    """`5M1I3S` as an array of (op, len); `*` and null give an empty array."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\d+[MIDNSHP=X]"), F.lit(0))
    return F.transform(parts, lambda p: F.struct(F.right(p, F.lit(1)).alias("op"), F.regexp_extract(p, r"\d+", 0).cast("int").alias("len")))


def cigar_text(ops: Column) -> Column:
    return F.array_join(F.transform(ops, lambda o: F.concat(o["len"].cast("string"), o["op"])), "")


def cigar_sum(ops: Column, kinds: str) -> Column:
    """Total length of the operations in `kinds`."""
    return F.aggregate(F.filter(ops, lambda o: o["op"].isin(*kinds)), F.lit(0), lambda a, o: a + o["len"])


def cigar_count(ops: Column, kinds: str) -> Column:
    return F.size(F.filter(ops, lambda o: o["op"].isin(*kinds)))


def read_length(ops: Column) -> Column:
    """Aligned bases of the read: matches, mismatches and inserts."""
    return cigar_sum(ops, "M=XI")


def reference_length(ops: Column) -> Column:
    return cigar_sum(ops, "MDN=X")


def reference_end(pos: Column, ops: Column) -> Column:
    return pos + reference_length(ops)


def max_gap(ops: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(F.filter(ops, lambda o: o["op"].isin("I", "D")), lambda o: o["len"])), F.lit(0))


def head_clip(ops: Column) -> Column:
    first = F.try_element_at(F.filter(ops, lambda o: o["op"] != "H"), F.lit(1))
    return F.when(first["op"] == "S", first["len"]).otherwise(0)


def tail_clip(ops: Column) -> Column:
    kept = F.filter(ops, lambda o: o["op"] != "H")
    last = F.try_element_at(kept, F.lit(-1))
    return F.when((F.size(kept) > 1) & (last["op"] == "S"), last["len"]).otherwise(0)


def md_matches(md: Column) -> Column:
    return F.aggregate(F.regexp_extract_all(md, F.lit(r"\d+"), F.lit(0)), F.lit(0), lambda a, x: a + x.cast("int"))


def md_mismatches(md: Column) -> Column:
    """Letters outside deletions."""
    return F.length(F.regexp_replace(F.regexp_replace(md, r"\^[A-Za-z]+", ""), r"\d", ""))


def md_deletes(md: Column) -> Column:
    return F.length(md) - F.length(F.replace(md, F.lit("^"), F.lit("")))


def md_ops(md: Column) -> Column:
    """MD as an array of (kind, len, bases): M for equal bases, X for a mismatch, D for deleted bases."""
    parts = F.regexp_extract_all(md, F.lit(r"\d+|\^[A-Za-z]+|[A-Za-z]"), F.lit(0))

    def op(p: Column) -> Column:
        digits, deleted = p.rlike(r"^\d"), p.startswith("^")
        return F.struct(
            F.when(digits, "M").when(deleted, "D").otherwise("X").alias("kind"),
            F.when(digits, F.regexp_extract(p, r"^\d+", 0).try_cast("int")).when(deleted, F.length(p) - 1).otherwise(1).alias("len"),
            F.when(digits, F.lit("")).otherwise(F.replace(p, F.lit("^"), F.lit(""))).alias("bases"),
        )

    return F.filter(F.transform(parts, op), lambda x: x["len"] > 0)


def _walk(ops: Column, initial: Column, step) -> Column:
    return F.aggregate(ops, initial, step, lambda a: a["out"])


def placed(ops: Column, pos: Column) -> Column:
    """CIGAR operations with where they begin: array of (op, len, read, ref), read offsets counting soft clips."""
    kind = "array<struct<op:string,len:int,read:int,ref:bigint>>"
    start = F.struct(F.lit(0).alias("read"), pos.cast("bigint").alias("ref"), F.array().cast(kind).alias("out"))

    def step(a: Column, o: Column) -> Column:
        here = F.struct(o["op"].alias("op"), o["len"].alias("len"), a["read"].alias("read"), a["ref"].alias("ref"))
        return F.struct(
            (a["read"] + F.when(o["op"].isin("M", "I", "S", "=", "X"), o["len"]).otherwise(0)).alias("read"),
            (a["ref"] + F.when(o["op"].isin("M", "D", "N", "=", "X"), o["len"]).otherwise(0)).alias("ref"),
            F.concat(a["out"], F.array(here)).alias("out"),
        )

    return _walk(ops, start, step)


def mismatches(ops: Column, pos: Column, seq: Column, qual: Column, md: Column) -> Column:
    """Array of (pos, ref, alt, bq) of a read's mismatches outside N, from CIGAR and MD.

    MD counts reference bases from the start; deletions of MD are those of the CIGAR.
    """
    kind = "array<struct<off:int,ref:string>>"
    start = F.struct(F.lit(0).alias("off"), F.array().cast(kind).alias("out"))

    def step(a: Column, m: Column) -> Column:
        here = F.array(F.struct(a["off"].alias("off"), m["bases"].alias("ref")))
        return F.struct((a["off"] + m["len"]).alias("off"), F.when(m["kind"] == "X", F.concat(a["out"], here)).otherwise(a["out"]).alias("out"))

    spots = _walk(md_ops(md), start, step)
    blocks = F.filter(placed(ops, pos), lambda o: o["op"].isin("M", "=", "X"))

    def resolve(s: Column) -> Column:
        at = pos.cast("bigint") + s["off"]
        block = F.try_element_at(F.filter(blocks, lambda o: (o["ref"] <= at) & (at < o["ref"] + o["len"])), F.lit(1))
        offset = (block["read"] + (at - block["ref"]) + 1).cast("int")
        return F.struct(at.alias("pos"), s["ref"].alias("ref"), F.substring(seq, offset, F.lit(1)).alias("alt"), (F.ascii(F.substring(qual, offset, F.lit(1))) - 33).alias("bq"))

    return F.filter(F.transform(spots, resolve), lambda x: (x["alt"] != "N") & (x["alt"] != ""))


def inserts(ops: Column, pos: Column, seq: Column, qual: Column) -> Column:
    """Array of (pos, seq, qual) of inserted bases; pos is the reference position that they stand before."""
    found = F.filter(placed(ops, pos), lambda o: o["op"] == "I")
    return F.transform(found, lambda o: F.struct(o["ref"].alias("pos"), F.substring(seq, o["read"] + 1, o["len"]).alias("seq"), F.substring(qual, o["read"] + 1, o["len"]).alias("qual")))


def deletes(ops: Column, pos: Column, md: Column) -> Column:
    """Array of (pos, seq) of deleted reference bases."""
    found = F.filter(placed(ops, pos), lambda o: o["op"] == "D")
    lost = F.filter(md_ops(md), lambda m: m["kind"] == "D")
    return F.zip_with(found, lost, lambda o, m: F.struct(o["ref"].alias("pos"), m["bases"].alias("seq")))


def identity(ops: Column, nm: Column) -> Column:
    """(m - nm) / m of the matched columns."""
    m = cigar_sum(ops, "M=X")
    return F.when(m > 0, (m - nm) / m)


def read_name(name: Column, flag: Column) -> Column:
    """The name, with `.1` or `.2` for the first and second read of a pair."""
    return F.concat(name, F.when(has_flag(flag, PAIRED) & has_flag(flag, FIRST), ".1").when(has_flag(flag, PAIRED) & has_flag(flag, SECOND), ".2").otherwise(""))


def read_id(name: Column, flag: Column) -> Column:
    return F.concat_ws(":", name, flag.cast("string"))


def bed_row(chrom: Column, pos: Column, name: Column, mapq: Column, ops: Column, nm: Column, seq: Column, qual: Column) -> Column:
    """A read as one struct: interval, name, quality, CIGAR, identity, lengths, clips, bases."""
    return F.struct(
        chrom.alias("chrom"), pos.alias("start"), reference_end(pos, ops).alias("end"), name.alias("name"), mapq.alias("mapq"), cigar_text(ops).alias("cigar"),
        identity(ops, nm).alias("identity"), read_length(ops).alias("read_length"), head_clip(ops).alias("head"), tail_clip(ops).alias("tail"), seq.alias("seq"), qual.alias("qual"),
    )


def clip_sites(ops: Column, pos: Column, seq: Column, least: int = 1) -> Column:
    """Array of (side, pos, seq): clipped ends of `least` or more bases, the head at the start, the tail at the end."""
    head, tail = head_clip(ops), tail_clip(ops)
    kind = "array<struct<side:string,pos:bigint,seq:string>>"
    one = lambda side, at, text, n: F.when(n >= least, F.array(F.struct(F.lit(side).alias("side"), at.cast("bigint").alias("pos"), text.alias("seq")))).otherwise(F.array().cast(kind))
    return F.concat(one("head", pos, F.left(seq, head), head), one("tail", reference_end(pos, ops), F.right(seq, tail), tail))


def tags(fields: Column) -> Column:
    """Optional fields `NM:i:2` as a map from tag to (type, value); of a tag that comes twice the last counts."""
    parts = F.filter(fields, lambda x: x.rlike("^[A-Za-z][A-Za-z0-9]:[A-Za-z]:"))
    one = lambda x: F.struct(F.left(x, F.lit(2)).alias("key"), F.struct(F.substring(x, 4, 1).alias("type"), F.substring(x, 6, 1 << 30).alias("value")).alias("value"))
    last = F.filter(parts, lambda x, i: ~F.exists(F.slice(parts, i + 2, F.size(parts)), lambda y: F.left(y, F.lit(2)) == F.left(x, F.lit(2))))
    return F.map_from_entries(F.transform(last, one))


def with_tag(found: Column, tag: str, kind: str, value: Column) -> Column:
    """Tags with one set, new or not."""
    return F.map_concat(F.map_filter(found, lambda k, v: k != tag), F.create_map(F.lit(tag), F.struct(F.lit(kind).alias("type"), value.cast("string").alias("value"))))


def without_tag(found: Column, tag: str) -> Column:
    return F.map_filter(found, lambda k, v: k != tag)
