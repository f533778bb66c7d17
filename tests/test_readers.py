"""Readers, names, files and the command line."""

from __future__ import annotations

import gzip
import json
import math

import pytest
from pyspark.sql import functions as F

from spanloom import cli
from spanloom.functions.formatting import matrix_value, plain_value, score_value
from spanloom.functions.names import sample_label, unique_labels, with_unique_names
from spanloom.options import GtfNames
from spanloom.sources.bed import RegionFileError, assign_groups, parse_bed, read_bed
from spanloom.sources.bigwig import BigWigError, BigWigFile, read_range, read_signal
from spanloom.sources.gtf import transcripts
from spanloom.sources.matrix_file import read_matrix
from spanloom.sources.regions import load_regions
from tests import bigwig_bytes as bw


def lines(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "line_no long, line string")


def test_bed_fields(spark):
    rows = parse_bed(
        lines(spark, "c 5 9", "c\t-20\t40\tn\t0\t+", "c\t1\t2\tname\t.\t*", "c\t1\t2\tx\tabc\tstrandx", "c\t1\t2\tignored\t3.5", "c\t1\t2\t\t0\t-\t", "track name=x", "c\t9\t5", "c\t1\t5000000000", "c\t1")
    ).orderBy("line_no").collect()
    assert [(r.start, r.end, r.name, r.score, r.score_raw, r.strand, r.strand_raw, r.bed_field_count) for r in rows[:6]] == [
        (5, 9, "c:5-9", None, None, ".", None, 3),
        (0, 40, "n", 0.0, None, "+", None, 6),
        (1, 2, "name", None, None, ".", None, 6),
        (1, 2, "x", None, "abc", ".", "strandx", 6),
        (1, 2, "c:1-2", 3.5, None, ".", None, 5),
        (1, 2, None, 0.0, None, "-", None, 6),
    ]
    assert [r.error for r in rows[:6]] == [None] * 6
    assert all(r.error for r in rows[6:])
    assert "three" in rows[6].error and "smaller" in rows[7].error


def test_bed_blocks(spark):
    tail = "\t".join(["n", "0", "+", "0", "0", "0"])
    rows = parse_bed(lines(spark, f"c\t10\t99\t{tail}\t2\t5,7,\t0,20,", f"c\t10\t99\t{tail}\t2\t5,\t0,20", f"c\t10\t99\t{tail}\t1\t0\t0", f"c\t10\t99\t{tail}\t0\t\t,")).orderBy("line_no").collect()
    assert [None if r.exons is None else [tuple(x) for x in r.exons] for r in rows] == [[(10, 15), (30, 37)], None, None, []]


def test_groups_end_with_their_label(spark):
    records, _ = assign_groups(lines(spark, "a 1 2", "#first", "#unused", "", "b 1 2", "c 1 2", "#first", "d 1 2"), "genes")
    assert [(r.line_no, r.label) for r in records.orderBy("line_no").collect()] == [(0, "first"), (4, "first"), (5, "first"), (7, "genes")]
    assert unique_labels([("first", "genes"), (" first ", "genes"), ("", "genes"), ("first_r1", "genes")]) == ["first", "first_r1", "genes", "first_r1_r1"]


def test_names_are_told_apart(spark):
    rows = spark.createDataFrame([(k, 0, n) for k, n in enumerate(["dup", "dup", "dup_r1", "dup", "x", "x", None, None])] + [(9, 1, "dup")], "region_id long, group_idx int, name string")
    assert [r.name for r in with_unique_names(rows).orderBy("region_id").collect()] == ["dup", "dup_r1", "dup_r1_r1", "dup_r2", "x", "x_r1", None, None, "dup"]
    assert sample_label("/a/test1.bw.bw") == "test1.bw"


def test_region_files(spark, tmp_path):
    a, b, c = tmp_path / "a.bed", tmp_path / "b.bed", tmp_path / "c.gtf"
    a.write_text("1\t5\t9\tn\t0\t+\n1\t5\t9\tn\t0\t+\n#g\n1\t7\t8\tm\t0\t-\n")
    b.write_text("2\t5\t9\r\n\n")
    c.write_text('# made\n1\ts\tmrna\t11\t90\t.\t-\t.\ttranscript_id "t"; gene_id "q";\n1\ts\tcds\t1\t20\t.\t-\t.\ttranscript_id "t"; gene_id "q";\n1\ts\tcds\t60\t60\t.\t-\t.\ttranscript_id "t"; gene_id "q";\n')
    regions, groups = load_regions(spark, [str(a), str(b), str(c)], GtfNames("mrna", "cds", "gene_id"))
    assert [r.group_label for r in groups.orderBy("group_idx").collect()] == ["g", "a.bed", "b.bed", "c.gtf"]
    rows = regions.orderBy("region_id").collect()
    assert [(r.group_idx, r.chrom, r.start, r.end, r.name) for r in rows] == [(0, "1", 5, 9, "n"), (0, "1", 5, 9, "n_r1"), (1, "1", 7, 8, "m"), (2, "2", 5, 9, "2:5-9"), (3, "1", 10, 90, "q")]
    assert [tuple(x) for x in rows[-1].exons] == [(10, 20), (59, 60)]
    (tmp_path / "bad.bed").write_text("1\t5\t9\ntrack x y\n")
    with pytest.raises(RegionFileError, match="line 2"):
        load_regions(spark, [str(tmp_path / "bad.bed")])
    (tmp_path / "empty.bed").write_text("#only\n")
    with pytest.raises(RegionFileError):
        load_regions(spark, [str(tmp_path / "empty.bed")])


def test_gtf_repeated_transcripts(spark):
    text = ['1\ts\texon\t5\t8\t.\t+\t.\ttranscript_id "a";', '1\ts\ttranscript\t1\t10\t.\t+\t.\ttranscript_id "a";', '1\ts\ttranscript\t3\t30\t.\t+\t.\ttranscript_id "a";', '1\ts\ttranscript\t3\t30\t.\t+\t.\tother "a";']
    rows = transcripts(lines(spark, *text)).orderBy("line_no").collect()
    assert [(r.start, r.exons) for r in rows] == [(0, None), (2, [(4, 8)])]


@pytest.fixture
def score_file(tmp_path):
    blocks = [
        bw.bed_graph(0, [(0, 10, 1.5), (20, 30, 2.0)]),
        bw.variable_step(0, 5, [(40, 3.0), (50, math.nan)]),
        bw.fixed_step(1, 100, 10, 4, [1.0, 2.0, 3.0]),
        bw.fixed_step(1, 500, 10, 4, [9.0], kind=7),
        bw.bed_graph(2, [(7, 9, 4.0)]),
    ]
    chroms = [("chr1", 1000), ("chr2", 2000), ("chrM", 50)]
    return bw.write(tmp_path / "a.bw", chroms, blocks), bw.write(tmp_path / "raw.bw.bw", chroms, blocks, deflate=False)


def test_bigwig(spark, score_file, tmp_path):
    file = BigWigFile(score_file[0])
    assert [(c.name, c.length) for c in file.chroms] == [("chr1", 1000), ("chr2", 2000), ("chrM", 50)]
    assert len(file.blocks()) == 5 and len(file.blocks([(1, 0, 300)])) == 1 and file.blocks([(1, 300, 400)]) == [] and len(file.blocks([(1, 0, 1), (1, 299, 300), (0, 0, 2**32)])) == 2
    signal, chroms = read_signal(spark, list(score_file))
    expected = [("chr1", 0, 10, 1.5), ("chr1", 20, 30, 2.0), ("chr1", 40, 45, 3.0), ("chr2", 100, 104, 1.0), ("chr2", 110, 114, 2.0), ("chr2", 120, 124, 3.0), ("chrM", 7, 9, 4.0)]
    for sample in (0, 1):
        assert [tuple(r) for r in signal.filter(F.col("sample_idx") == sample).drop("sample_idx").orderBy("chrom", "start").collect()] == expected
    assert chroms.count() == 6
    assert [tuple(r)[1:] for r in read_range(spark, score_file[0], "2", 112, 121).orderBy("start").collect()] == [(110, 114, 2.0), (120, 124, 3.0)]
    assert read_range(spark, score_file[0], "MT", 0, 50).count() == 1
    with pytest.raises(BigWigError):
        read_range(spark, score_file[0], "9", 0, 50)
    (tmp_path / "no.bw").write_bytes(b"x" * 100)
    with pytest.raises(BigWigError):
        BigWigFile(str(tmp_path / "no.bw"))


def test_texts_of_values():
    assert [matrix_value(v) for v in (0.0000005, 0.0000015, -1e-9, 24.799999237, None, math.inf, -2.5)] == ["0.000000", "0.000002", "0.000000", "24.799999", "nan", "inf", "-2.500000"]
    assert [plain_value(v) for v in (12345.0, 0.5, None, 1e-5)] == ["1.234e+04", "0.5", "nan", "1e-05"]
    assert [score_value(v) for v in (0.0, 3.5, 100.0)] == ["0.0", "3.5", "100.0"]


def test_command_line(spark, score_file, tmp_path, capsys):
    bed = tmp_path / "r.bed"
    bed.write_text("chr1\t20\t60\tlate\t7\t+\nchr1\t0\t30\tearly\t.\t-\n#one\n2\t100\t130\ttwo\tabc\tx\n7\t1\t2\tgone\t0\t+\n")
    black = tmp_path / "b.bed"
    black.write_text("1\t300\t400\n")
    out = [str(tmp_path / n) for n in ("m.gz", "v.tab", "s.bed")]
    args = ["reference-point", "-R", str(bed), "-S", *score_file, "-o", out[0], "--outFileNameMatrix", out[1], "--outFileSortedRegions", out[2], "-b", "10", "-a", "20", "--bs", "10", "--sortRegions", "descend", "--bl", str(black), "--missingDataAsZero"]
    assert cli.main(args) == 0
    with gzip.open(out[0], "rt") as f:
        text = f.read().splitlines()
    head = json.loads(text[0][1:])
    assert list(head)[:5] == ["upstream", "downstream", "body", "bin size", "ref point"]
    assert head["group_labels"] == ["one", "genes"] and head["group_boundaries"] == [0, 2, 3]
    assert head["sample_labels"] == ["a", "raw.bw"] and head["sample_boundaries"] == [0, 3, 6]
    # Equal means: descending order turns ties round, too.
    assert text[1].split("\t")[:6] == ["chr1", "0", "30", "early", ".", "-"]
    assert text[2].split("\t") == ["chr1", "20", "60", "late", "7.0", "+", "0.000000", "2.000000", "0.000000", "0.000000", "2.000000", "0.000000"]
    assert text[3].split("\t")[:8] == ["chr2", "100", "130", "two", "0.0", ".", "0.000000", "0.400000"]
    table = open(out[1]).read().splitlines()
    assert table[0] == "#one:2\tgenes:1" and table[2] == "one:2\tgenes:1\ta\ta\ta\traw.bw\traw.bw\traw.bw" and len(table) == 6
    regions = open(out[2]).read().splitlines()
    assert regions[2].split("\t") == ["chr1", "20", "60", "late", "7.0", "+", "20", "60", "0", "1", "40", "0", "one"]
    assert cli.main(["diff", out[0], out[0]]) == 0
    other = str(tmp_path / "n.gz")
    with gzip.open(other, "wt") as f:
        f.write("\n".join([text[0], text[2], text[1].replace("2.000000", "2.1"), text[3]]) + "\n")
    assert cli.main(["diff", out[0], other]) == 1
    assert "another order" in capsys.readouterr().out
    assert cli.main(["header", out[0], other]) == 0
    assert cli.main(["reference-point", "-bs", "10"]) == 2
    header, rows = read_matrix(spark, out[0])
    assert header == head and rows.orderBy("row_no").first().values[:2] == [0.0, 2.0]


def test_rows_that_filters_take(spark, score_file, tmp_path, capsys):
    bed = tmp_path / "r.bed"
    bed.write_text("chr1\t20\t60\ta\t7\t+\n#one\nchr2\t1000\t1030\tb\t0\t+\n")
    args = ["scale-regions", "-R", str(bed), "-S", score_file[0], "-o", str(tmp_path / "m.gz"), "-m", "20", "--skipZeros"]
    assert cli.main(args) == 0
    header, rows = read_matrix(spark, str(tmp_path / "m.gz"))
    assert header["group_labels"] == ["one", "genes"] and header["group_boundaries"] == [0, 1, 1] and rows.count() == 1
    bed.write_text("chr2\t1000\t1030\tb\t0\t+\n")
    assert cli.main([*args[:5], "-o", str(tmp_path / "x.gz"), "-m", "20", "--skipZeros"]) == 2
    assert "runtime row filtering" in capsys.readouterr().err and not (tmp_path / "x.gz").exists()
    bed.write_text("chr9\t1000\t1030\tb\t0\t+\n")
    assert cli.main(args) == 2 and "pre-dispatch" in capsys.readouterr().err
    bed.write_text("chr9\t10\t30\ta\t7\t+\n#one\nchr2\t1000\t1030\tb\t0\t+\n")
    assert cli.main(args) == 2
    bed.write_text("chr9\t10\t30\ta\t7\t+\n#one\nchr2\t100\t130\tb\t0\t+\n")
    assert cli.main([*args, "--sortRegions", "no"]) == 0
    assert read_matrix(spark, str(tmp_path / "m.gz"))[0]["group_labels"] == ["genes"]


def test_only_blocks_under_windows_are_read(spark, tmp_path):
    from spanloom.options import Anchor, General, ReferencePoint
    from spanloom.run import STRETCH, window_ranges
    from spanloom.sinks.bigwig import write_bigwig
    from spanloom.sources.bigwig import BigWigFile, BigWigReader, read_signal

    n, path = 400_000, f"{tmp_path}/long.bw"
    signal = spark.range(n).selectExpr("'chr1' AS chrom", "id * 10 AS start", "id * 10 + 10 AS end", "id AS value")
    write_bigwig(path, {"chr1": 10 * n, "chr2": 5}, signal)
    file = BigWigFile(path)
    every = file.blocks()
    assert [(c.name, c.length) for c in file.chroms] == [("chr1", 10 * n), ("chr2", 5)] and len(every) == -(-n // 1024)
    assert read_signal(spark, [path])[0].count() == n
    regions = spark.createDataFrame([("1", 50, 60, "+", None), ("1", 2_000_000, 2_000_900, "-", None), ("3", 0, 9, "+", None)], "chrom string, start long, end long, strand string, exons array<struct<start:long,end:long>>")
    ranges = window_ranges(regions, ReferencePoint(Anchor.TSS, 100, 100), General(bin_size=10))
    k = 2_000_900 // STRETCH
    assert ranges == [("1", 0, STRETCH), ("1", k * STRETCH, (k + 1) * STRETCH), ("3", 0, STRETCH)]
    runs = BigWigReader(path, 1 << 20, ranges).partitions()
    wanted = [b for b in every if any(b.start < e and s < b.end for c, s, e in ranges if c == "1")]
    assert [b for r in runs for b in r.blocks] == wanted and len(wanted) < len(every) / 5
    found, _ = read_signal(spark, [path], ranges)
    assert found.filter("start < 300 AND end > 0").count() == 30 and found.count() < n / 5


def test_number_of_a_bad_line_in_a_later_split(spark, tmp_path):
    path = tmp_path / "long.bed"
    lines = [f"chr1\t{k}\t{k + 5}" for k in range(4000)]
    lines[3500] = "chr1\tx\t9"
    path.write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        with pytest.raises(RegionFileError, match="line 3501: "):
            read_bed(spark, str(path), "genes")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_groups_of_many_headers(spark):
    rows = [(k, f"#g{k}" if k % 3 == 2 else f"chr1\t{k}\t{k + 1}") for k in range(200)]
    records, headers = assign_groups(spark.createDataFrame(rows, "line_no long, line string"), "genes")
    assert len(headers) == 66
    for r in records.collect():
        own = next((h for h in headers if h[0] > r.line_no), None)
        assert r.segment == sum(h[0] < r.line_no for h in headers) and r.label == (own[1] if own else "genes")
