import random

import pytest

from readloom.sources import text_formats as T


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_a_file_in_many_splits_gives_the_rows_of_one(spark, tmp_path, end):
    r = random.Random(4)
    rows, text = [], ""
    for i in range(400):
        seq = "".join(r.choice("ACGTN") for _ in range(r.randrange(1, 60)))
        qual = "".join(r.choice("@+I#5@") for _ in seq)
        rows.append((f"r{i}", seq, qual))
        text += end.join([f"@r{i} text @{i}", seq, r.choice(["+", f"+r{i}"]), qual]) + end
    for n, part in enumerate((text, text)):
        (tmp_path / f"{n}.fq").write_bytes(part.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("128m", str(len(text) // 7), "301"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            one = T.read_fastq(spark, str(tmp_path / "0.fq"))
            assert sorted(map(tuple, one.collect())) == sorted(rows), size
            both = T.read_fastq(spark, str(tmp_path / "0.fq"), str(tmp_path / "1.fq"))
            assert sorted(map(tuple, both.collect())) == sorted(rows * 2), size
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_bins_by_splits(spark, tmp_path):
    lines, rows = [], []
    for b in range(40):
        lines.append(f"#{b} x")
        for k in range(b % 7):
            lines.append(f"read_{b}_{k}#1")
            rows.append((b, f"read_{b}_{k}#1"))
    path = tmp_path / "bins_100_200_.txt"
    path.write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "90"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            out = T.read_local_bins(spark, str(path)).collect()
            assert sorted((x.bin, x.read) for x in out) == sorted(rows) and {(x.start, x.end) for x in out} == {(100, 200)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
