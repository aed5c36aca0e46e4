"""Readers and writers of sequencing text formats, as typed DataFrames over Spark's own text sources.

Paths may be any that Spark reads, one file or many; compressed files are read as Spark reads them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions import alignments as A

TAB = "\t"


def _fields(lines: DataFrame, names: list[str]) -> DataFrame:
    parts = lines.withColumn("_f", F.split("value", TAB))
    return parts.select("*", *[F.try_element_at("_f", F.lit(i + 1)).alias(n) for i, n in enumerate(names)]).drop("_f")


def _tag(name: str, kind: str) -> Column:
    found = F.regexp_extract("value", rf"(?:^|\t){name}:{kind}:([^\t]*)", 1)
    return F.when(found != "", found)


def read_sam(spark: SparkSession, *paths: str) -> DataFrame:
    """Alignments: name, flag, chrom, pos (0-based), mapq, cigar, ops, mate_chrom, mate_pos, tlen, seq, qual, md, nm, end, file.

    `*` becomes null, `=` the read's own sequence; header lines and lines of fewer than 11 fields are left out.
    """
    lines = spark.read.text(list(paths)).withColumn("file", F.input_file_name()).where(~F.col("value").startswith("@"))
    rows = _fields(lines, ["name", "flag", "chrom", "pos", "mapq", "cigar", "mate_chrom", "mate_pos", "tlen", "seq", "qual"]).where("qual is not null")
    star = lambda c: F.when(F.col(c) != "*", F.col(c))
    ops = A.cigar(F.col("cigar"))
    rows = rows.select(
        "name", F.col("flag").try_cast("int").alias("flag"), star("chrom").alias("chrom"), (F.col("pos").try_cast("bigint") - 1).alias("pos"), F.col("mapq").try_cast("int").alias("mapq"), star("cigar").alias("cigar"), ops.alias("ops"),
        F.when(F.col("mate_chrom") == "=", star("chrom")).otherwise(star("mate_chrom")).alias("mate_chrom"), (F.col("mate_pos").try_cast("bigint") - 1).alias("mate_pos"), F.col("tlen").try_cast("int").alias("tlen"),
        star("seq").alias("seq"), star("qual").alias("qual"), _tag("MD", "Z").alias("md"), _tag("NM", "i").try_cast("int").alias("nm"), "file",
    )
    return rows.withColumn("end", A.reference_end(F.col("pos"), F.col("ops")))


def sam_header(spark: SparkSession, path: str) -> DataFrame:
    """Header records: kind (HD, SQ, RG, PG, CO) and their tags as a map; comments have the tag `text`."""
    lines = spark.read.text(path).where(F.col("value").startswith("@"))
    kind = F.substring("value", 2, 2)
    pairs = F.filter(F.split("value", TAB), lambda x: x.rlike("^[A-Za-z][A-Za-z0-9]:"))
    tags = F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.substring(x, 1, 2).alias("key"), F.regexp_replace(x, "^..:", "").alias("value"))))
    return lines.select(kind.alias("kind"), F.when(kind == "CO", F.create_map(F.lit("text"), F.regexp_replace("value", r"^@CO\t", ""))).otherwise(tags).alias("tags"))


def reference_dict(header: DataFrame) -> DataFrame:
    """chrom and length of the sequences that a header names."""
    return header.where("kind = 'SQ'").select(F.col("tags")["SN"].alias("chrom"), F.col("tags")["LN"].cast("bigint").alias("length"))


def write_sam(reads: DataFrame, path: str) -> None:
    """Alignments as SAM lines, sorted by chrom and position within each file."""
    text = F.concat_ws(
        TAB, "name", F.col("flag").cast("string"), F.coalesce("chrom", F.lit("*")), (F.coalesce("pos", F.lit(-1)) + 1).cast("string"), F.coalesce("mapq", F.lit(0)).cast("string"), F.coalesce("cigar", F.lit("*")),
        F.coalesce("mate_chrom", F.lit("*")), (F.coalesce("mate_pos", F.lit(-1)) + 1).cast("string"), F.coalesce("tlen", F.lit(0)).cast("string"), F.coalesce("seq", F.lit("*")), F.coalesce("qual", F.lit("*")),
        F.when(F.col("nm").isNotNull(), F.concat(F.lit("NM:i:"), F.col("nm").cast("string"))), F.when(F.col("md").isNotNull(), F.concat(F.lit("MD:Z:"), "md")),
    )
    reads.sortWithinPartitions("chrom", "pos").select(text.alias("value")).write.text(path)


def read_fasta(spark: SparkSession, *paths: str) -> DataFrame:
    """name, description, seq of FASTA records; a record is what stands between lines that begin with `>`."""
    records = spark.read.option("lineSep", ">").text(list(paths)).where("value <> ''")
    head = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    seq = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s+", "")
    return records.select(F.regexp_extract(head, r"^(\S+)", 1).alias("name"), F.regexp_replace(head, r"^\S+\s*", "").alias("description"), seq.alias("seq"))


def base_at(contigs: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """The bases [start, end) of a contig."""
    return contigs.where(F.col("name") == chrom).select(F.substring("seq", start + 1, end - start).alias("seq"))


def write_fasta(records: DataFrame, path: str) -> None:
    records.select(F.concat(F.lit(">"), "name", F.lit("\n"), "seq").alias("value")).write.text(path)


def _fastq_pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Records, and the pieces of records at the edges of splits: a head that goes on in the next split, a rest of one."""
    shape = ["name", "seq", "qual", "file", "at", "edge"]
    held: tuple | None = None  # a record without qualities, and where its split ends
    split: tuple | None = None
    for f in frames:
        rows: list[tuple] = []
        for text, file, start, size in zip(f.value, f.file, f.start, f["size"], strict=True):
            lines = [x.rstrip("\r") for x in text.rstrip("\r\n").split("\n")]
            first, split = split != (file, start), (file, start)
            if held and held[2:] != (file, start + size):
                rows.append((*held[:2], None, *held[2:], "head"))
                held = None
            if len(lines) >= 3 and lines[2].startswith("+"):
                name = (lines[0].removeprefix("@") if start == 0 else lines[0]).split(maxsplit=1)
                one = (name[0] if name else "", lines[1])
                if len(lines) > 3:
                    rows.append((*one, lines[3], file, start, "whole"))
                else:  # the qualities begin with @
                    held = (*one, file, start + size)
            elif held:
                rows.append((*held[:2], "@" + lines[0], file, start, "whole"))
                held = None
            elif first:
                rows.append((None, None, "@" + lines[0], file, start, "rest"))
        yield pd.DataFrame(rows, columns=shape)
    if held:
        yield pd.DataFrame([(*held[:2], None, *held[2:], "head")], columns=shape)


def read_fastq(spark: SparkSession, *paths: str) -> DataFrame:
    """name, seq, qual of four-line FASTQ records: `@name`, bases, `+`, qualities.

    Files are read by splits, cut at `@` after a line end.  A quality line that begins with `@` is cut off its record there,
    which then ends with its `+` line, and is put back; where a split ends in between, the two pieces meet by the split's
    end.  Empty lines behind records are passed over.
    """
    pieces = spark.read.option("lineSep", "\n@").text(list(paths))
    pieces = pieces.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_block_length").alias("size"))
    found = pieces.mapInPandas(_fastq_pieces, "name string, seq string, qual string, file string, at long, edge string")
    heads = found.where("edge = 'head'").select("name", "seq", "file", "at")
    rests = found.where("edge = 'rest'").select("qual", "file", "at")
    return found.where("edge = 'whole'").select("name", "seq", "qual").unionByName(heads.join(rests, ["file", "at"]).select("name", "seq", "qual"))


def write_fastq(records: DataFrame, path: str) -> None:
    """FASTQ of records(name, seq, qual); without qualities every base has quality 40."""
    qual = F.coalesce("qual", F.repeat(F.lit("I"), F.length("seq"))) if "qual" in records.columns else F.repeat(F.lit("I"), F.length("seq"))
    records.select(F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), qual).alias("value")).write.text(path)


def read_bed(spark: SparkSession, *paths: str, compat: bool = False) -> DataFrame:
    """chrom, start, end, name, score, strand; lines without a valid interval are left out.

    Starts are 0-based as BED has them; compat=True takes one from them.
    """
    rows = _fields(spark.read.text(list(paths)).where(~F.col("value").rlike("^(#|track|browser)")), ["chrom", "start", "end", "name", "score", "strand"])
    start = F.col("start").try_cast("bigint") - (1 if compat else 0)
    return rows.select("chrom", start.alias("start"), F.col("end").try_cast("bigint").alias("end"), "name", F.col("score").try_cast("double").alias("score"), "strand").where("start is not null and end is not null and start < end")


def write_bed(rows: DataFrame, path: str, columns: list[str]) -> None:
    rows.select(F.concat_ws(TAB, *[F.col(c).cast("string") for c in columns]).alias("value")).write.text(path)


#: Fixed: the head of a VCF 4.1 file and the fields that variants carry.
VCF_HEAD = [
    "##fileformat=VCFv4.1",
    '##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth">',
    '##INFO=<ID=AD,Number=A,Type=Integer,Description="Allele depth">',
    '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">',
]


def vcf_lines(variants: DataFrame, sample: str = "sample") -> DataFrame:
    """VCF lines (value) of variants(chrom, pos, ref, alt, quality, depth, allele_depth, genotype), header first.

    Lines are in one partition only for the header; records are range-partitioned by position and sorted.
    """
    spark = variants.sparkSession
    head = spark.createDataFrame([(x,) for x in [*VCF_HEAD, TAB.join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", sample])]], "value string").coalesce(1)
    info = F.concat(F.lit("DP="), F.col("depth").cast("string"), F.lit(";AD="), F.col("allele_depth").cast("string"))
    line = F.concat_ws(TAB, "chrom", (F.col("pos") + 1).cast("string"), F.lit("."), "ref", "alt", F.format_string("%.2f", "quality"), F.lit("PASS"), info, F.lit("GT"), "genotype")
    body = variants.repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos")
    return head.unionByName(body.select(line.alias("value")))


def read_vcf(spark: SparkSession, *paths: str) -> DataFrame:
    rows = _fields(spark.read.text(list(paths)).where(~F.col("value").startswith("#")), ["chrom", "pos", "id", "ref", "alt", "quality", "filter", "info"])
    return rows.select("chrom", (F.col("pos").try_cast("bigint") - 1).alias("pos"), "id", "ref", F.split("alt", ",").alias("alts"), F.col("quality").try_cast("double").alias("quality"), "filter", "info").where("pos is not null")


def read_model(spark: SparkSession, path: str) -> DataFrame:
    """Weights of an alignment model in text form: every line that ends in a number is a feature, its labels before it."""
    lines = spark.read.text(path)
    weight = F.regexp_extract("value", r"(?:^|\s)(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)\s*$", 1).try_cast("double")
    return lines.select(F.trim(F.regexp_replace("value", r"\s*-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?\s*$", "")).alias("feature"), weight.alias("weight")).where("weight is not null")


RANKS = ["kingdom", "phylum", "class", "order", "family", "genus", "species"]


def read_taxonomy(spark: SparkSession, *paths: str) -> DataFrame:
    """otu_id and its seven ranks from lines of `id<TAB>a;b;c;...`."""
    rows = _fields(spark.read.text(list(paths)), ["otu_id", "ranks"])
    parts = F.transform(F.split("ranks", ";"), lambda x: F.trim(x))
    return rows.where("ranks is not null").select("otu_id", *[F.try_element_at(parts, F.lit(i + 1)).alias(r) for i, r in enumerate(RANKS)])


def read_tandem_repeats(spark: SparkSession, *paths: str) -> DataFrame:
    """Rows of a repeat finder's table: lines that begin with a number have 15 fields."""
    parts = F.split(F.trim("value"), r"\s+")
    names = ["start", "end", "period", "copies"]
    rows = spark.read.text(list(paths)).where(F.col("value").rlike(r"^\d+\s")).withColumn("_f", parts).where(F.size("_f") == 15)
    return rows.select(*[F.try_element_at("_f", F.lit(i + 1)).try_cast("double" if n == "copies" else "bigint").alias(n) for i, n in enumerate(names)], F.try_element_at("_f", F.lit(14)).alias("unit"))


def read_triples(spark: SparkSession, *paths: str) -> DataFrame:
    """a, b, d from lines of two names and a distance."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(list(paths)).select(F.try_element_at(parts, F.lit(1)).alias("a"), F.try_element_at(parts, F.lit(2)).alias("b"), F.try_element_at(parts, F.lit(3)).try_cast("double").alias("d")).where("d is not null")


def write_model(weights: DataFrame, path: str) -> None:
    """Weights (feature, weight) as lines that read_model reads."""
    weights.select(F.concat_ws(TAB, "feature", F.col("weight").cast("string")).alias("value")).write.text(path)


def read_frequencies(spark: SparkSession, *paths: str) -> DataFrame:
    """name, n from lines of a name and a count; lines without a count are left out."""
    rows = _fields(spark.read.text(list(paths)), ["name", "n"])
    return rows.select("name", F.col("n").try_cast("bigint").alias("n")).where("n is not null")


def read_local_bins(spark: SparkSession, *paths: str) -> DataFrame:
    """file, start, end, bin, read of files of bins: a line `#bin ...` begins a bin, the lines behind it are its reads.

    Start and end are the last two numbers in the file's name.  A bin is one row until it's cut into lines; files are
    read by splits.
    """
    whole = spark.read.option("lineSep", "\n#").text(list(paths)).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    numbers = F.regexp_extract_all("file", F.lit(r"(?<=[_.])(\d+)(?=[_.])"), F.lit(1))
    parts = whole.select("file", F.try_element_at(numbers, F.lit(-2)).cast("bigint").alias("start"), F.try_element_at(numbers, F.lit(-1)).cast("bigint").alias("end"), F.regexp_replace("value", "^#", "").alias("part")).where("part <> ''")
    lines = F.split("part", r"\r?\n")
    each = parts.select("file", "start", "end", F.regexp_extract(lines[0], r"^(\S+)", 1).try_cast("int").alias("bin"), F.explode(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))).alias("read"))
    return each.where("bin is not null and read <> ''")


def read_biadjacency(spark: SparkSession, path: str) -> DataFrame:
    """read, consensus, cost of a table whose first line names the consensus sequences behind its first field; zeros are
    left out."""
    lines = spark.read.text(path)
    head = [r.value for r in lines.limit(1).collect()]
    names = head[0].split(TAB)[1:] if head else []
    parts = F.split("value", TAB)
    cells = F.arrays_zip(F.array(*map(F.lit, names)).cast("array<string>").alias("consensus"), F.slice(parts, 2, len(names) or 1).alias("cost"))
    rows = lines.where(F.col("value") != F.lit(head[0] if head else "")).select(parts[0].alias("read"), F.explode(cells).alias("x"))
    return rows.select("read", F.col("x.consensus").alias("consensus"), F.col("x.cost").try_cast("double").alias("cost")).where("cost > 0")


def newick_edges(trees: DataFrame) -> DataFrame:
    """tree, node, parent, name, length of trees(tree, text) in bracket form; nodes are numbered by where they end.

    A node's parent is the next one behind it that is less deep; roots have none.
    """
    token = F.regexp_extract_all("text", F.lit(r"[(),;]|[^(),;]+"), F.lit(0))
    kind = "array<struct<depth:int,label:string>>"

    def step(a: Column, t: Column) -> Column:
        label = ~t.isin("(", ")", ",", ";")
        closes = t.isin(")", ",", ";")
        node = F.array(F.struct(a["depth"].alias("depth"), a["label"].alias("label"))).cast(kind)
        return F.struct(
            (a["depth"] + F.when(t == "(", 1).when(t == ")", -1).otherwise(0)).alias("depth"),
            F.when(label, F.trim(t)).when(closes | (t == "("), F.lit("")).otherwise(a["label"]).alias("label"),
            F.when(closes, F.concat(a["out"], node)).otherwise(a["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("label"), F.array().cast(kind).alias("out"))
    nodes = trees.select("tree", F.aggregate(token, start, step, lambda a: a["out"]).alias("n"))
    above = lambda x, i: F.try_element_at(F.filter(F.sequence(i + 1, F.size("n")), lambda j: (j > i + 1) & (F.element_at("n", j)["depth"] < x["depth"])), F.lit(1))
    rows = nodes.select("tree", F.posexplode(F.transform("n", lambda x, i: F.struct((above(x, i) - 1).alias("parent"), x["label"].alias("label")))).alias("node", "x"))
    length = F.regexp_extract("x.label", r":\s*([-+0-9.eE]+)\s*$", 1).try_cast("double")
    return rows.select("tree", "node", F.col("x.parent").alias("parent"), F.trim(F.regexp_replace("x.label", r":.*$", "")).alias("name"), length.alias("length"))


def sample_vcf_lines(variants: DataFrame, samples: list[str]) -> DataFrame:
    """VCF lines (value) of variants(chrom, pos, ref, alts, samples: array of (path_id, allele)), a column per sample.

    A sample has the number of its alternative, 0 for the reference.
    """
    spark = variants.sparkSession
    head = ["##fileformat=VCFv4.1", VCF_HEAD[-1], TAB.join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples])]
    allele = lambda s: F.coalesce(F.try_element_at(F.transform(F.filter("samples", lambda x: x["path_id"].cast("string") == s), lambda x: x["allele"]), F.lit(1)), F.lit(0)).cast("string")
    line = F.concat_ws(TAB, "chrom", (F.col("pos") + 1).cast("string"), F.lit("."), "ref", F.array_join("alts", ","), F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT"), *map(allele, samples))
    body = variants.repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos")
    return spark.createDataFrame([(x,) for x in head], "value string").coalesce(1).unionByName(body.select(line.alias("value")))


def pair_fastq(reads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records (name, seq, qual) of the first and of the second reads of pairs that are both there, in the order of
    names; reads of the reverse strand are turned back."""
    back = A.has_flag(F.col("flag"), A.REVERSE)
    seq = F.when(back, F.reverse(F.translate("seq", "ACGTacgt", "TGCAtgca"))).otherwise(F.col("seq"))
    primary = reads.where(A.passes_mask(F.col("flag"), A.SECONDARY | A.SUPPLEMENTARY)).select("name", "flag", seq.alias("seq"), F.when(back, F.reverse("qual")).otherwise(F.col("qual")).alias("qual"))
    side = [primary.where(A.has_flag(F.col("flag"), bit)).drop("flag") for bit in (A.FIRST, A.SECOND)]
    one, two = (s.join(t.select("name"), "name", "left_semi").orderBy("name") for s, t in (side, side[::-1]))
    return one, two


def keep_samples(spark: SparkSession, names: list[str], *paths: str) -> DataFrame:
    """value: the lines of VCF files with the fixed columns and those of the named samples alone, in the files' order.

    Files share one `#CHROM` line, of which the driver reads one; other lines that begin with `#` stay as they are.  A name that
    isn't there is an error.  Without any name, samples and the FORMAT column go.
    """
    lines = spark.read.text(list(paths))
    head = lines.where(F.col("value").startswith("#CHROM")).first()
    columns = head.value.split(TAB) if head else []
    missing = set(names) - set(columns[9:])
    if missing:
        raise ValueError(f"no such samples: {sorted(missing)}")
    kept = [i for i, c in enumerate(columns) if i < (9 if names else 8) or i > 8 and c in set(names)]
    parts = F.split("value", TAB)
    cut = F.concat_ws(TAB, *[F.try_element_at(parts, F.lit(i + 1)) for i in kept])
    return lines.select(F.when(F.col("value").startswith("##"), F.col("value")).otherwise(cut).alias("value"))
