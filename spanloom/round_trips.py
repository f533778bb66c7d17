"""Queries that write derived tables to files, read them back and give what was read, with SQL for it.

Files lie beside the other intermediate tables, in the shared folder.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom import compare, oracle, run
from spanloom.operators.numbering import shared_folder
from spanloom.options import Anchor, General, ReferencePoint, SortOrder
from spanloom.sinks import files
from spanloom.sinks.bigwig import write_bigwig
from spanloom.sources.bed import parse_bed, read_lines
from spanloom.sources.bigwig import local_path, read_range, read_signal
from spanloom.sources.gtf import transcripts
from spanloom.sources.matrix_file import read_matrix
from spanloom.sources.regions import load_regions
from spanloom.tables import derived, sql

Query = Callable[[SparkSession, str], DataFrame]
SAMPLES = 3
REF = ReferencePoint(Anchor.TSS, 50, 100)
GENERAL = General(bin_size=25, sort_regions=SortOrder.KEEP)


def folder(spark: SparkSession) -> str:
    """A new folder for files."""
    path = f"{local_path(shared_folder(spark))}/spanloom/files-{uuid.uuid4().hex}"
    os.makedirs(path)
    return path


def written_signal(spark: SparkSession, sf_dir: str) -> list[str]:
    signal, where = derived(spark, sf_dir, "signal"), folder(spark)
    sizes = derived(spark, sf_dir, "chroms").collect()
    out = [f"{where}/sample{k}.bw" for k in range(SAMPLES)]
    for k, path in enumerate(out):
        write_bigwig(path, {r.chrom: r.length for r in sizes if r.sample_idx == k}, signal.filter(F.col("sample_idx") == k))
    return out


def written_regions(spark: SparkSession, sf_dir: str) -> str:
    """A BED file of five groups, each ended by its label."""
    found = derived(spark, sf_dir, "regions")
    line = F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), F.concat(F.lit("r"), F.col("region_id").cast("string")), F.lit("0"), "strand")
    lines = found.select("group_idx", "region_id", line.alias("line")).unionByName(found.groupBy("group_idx").agg(F.lit(2**62).alias("region_id"), F.concat(F.lit("#"), F.min("group_label")).alias("line")))
    path = f"{folder(spark)}/regions.bed"
    with files.finished(path, False) as f:
        for r in lines.orderBy("group_idx", "region_id").select("line").toLocalIterator(prefetchPartitions=True):
            f.write(r.line + "\n")
    return path


def bigwig_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    signal, _ = read_signal(spark, written_signal(spark, sf_dir))
    return signal.select("sample_idx", "chrom", "start", "end", F.col("value").cast("double").alias("value"))


def bigwig_chroms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_signal(spark, written_signal(spark, sf_dir))[1]


def bigwig_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By another spelling of the chromosome."""
    found = read_range(spark, written_signal(spark, sf_dir)[1], "chrview", 5000, 9000)
    return found.select("start", "end", F.col("value").cast("double").alias("value"))


def bed_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, groups = load_regions(spark, [written_regions(spark, sf_dir)])
    return found.join(groups, "group_idx").select("group_idx", "group_label", "chrom", "start", "end", "name", "strand")


def gtf_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as transcripts and their blocks as exons, exons first; read back as blocks cut to the transcript."""
    found, blocks = derived(spark, sf_dir, "regions"), derived(spark, sf_dir, "exons")
    line = lambda feature: F.concat_ws("\t", "chrom", F.lit("x"), F.lit(feature), (F.col("start") + 1).cast("string"), F.col("end").cast("string"), F.lit("."), "strand", F.lit("."), F.concat(F.lit('gene_id "g"; transcript_id "'), F.col("region_id").cast("string"), F.lit('";')))
    exons = found.select("region_id", "chrom", "strand").join(blocks, "region_id")
    lines = exons.select((F.col("region_id") * 100 + F.col("start") % 50).alias("line_no"), line("exon").alias("line")).unionByName(found.select((F.col("region_id") * 100 + 99).alias("line_no"), line("transcript").alias("line")))
    read = transcripts(lines).select(F.col("name").cast("long").alias("region_id"), "start", "end", "strand", F.explode_outer("exons").alias("x"))
    return read.select("region_id", "start", "end", "strand", F.col("x.start").alias("exon_start"), F.col("x.end").alias("exon_end"))


def result(spark: SparkSession, sf_dir: str, where: run.Files | None = None) -> run.Result:
    """A matrix from files; rows in the order of the files' regions."""
    paths = run.Files([written_regions(spark, sf_dir)], written_signal(spark, sf_dir), *(() if where is None else (where.matrix, where.values, where.sorted_regions)))
    return run.run(spark, paths, REF, GENERAL)


def matrix_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From region and signal files to a matrix file, read back: (name, sample_idx, bin, value)."""
    path = f"{folder(spark)}/m.gz"
    result(spark, sf_dir, run.Files([], [], matrix=path))
    n = REF.n_bins(25)
    long = read_matrix(spark, path)[1].select("row_no", "name", F.posexplode("values").alias("k", "value"))
    value = F.when(~F.isnan("value"), F.col("value")).alias("value")
    return long.select("row_no", "name", F.expr(f"CAST(k div {n} AS int)").alias("sample_idx"), F.expr(f"CAST(k % {n} AS int)").alias("bin"), value)


def matrix_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups in the header of a matrix file, with their boundaries."""
    path = f"{folder(spark)}/m.gz"
    result(spark, sf_dir, run.Files([], [], matrix=path))
    head, _ = read_matrix(spark, path)
    return spark.createDataFrame(list(zip(head["group_labels"], head["group_boundaries"][1:], strict=True)), "label string, boundary long")


def values_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{folder(spark)}/v.tab"
    result(spark, sf_dir, run.Files([], [], values=path))
    lines = spark.read.text(path).filter(~F.startswith("value", F.lit("#")) & ~F.startswith("value", F.lit("1-URGENT:")))
    return lines.select(F.posexplode(F.split("value", "\t")).alias("k", "text")).groupBy("k", "text").agg(F.count(F.lit(1)).alias("n"))


def regions_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered regions, parsed: twelve columns of BED and the group."""
    path = f"{folder(spark)}/r.bed"
    result(spark, sf_dir, run.Files([], [], sorted_regions=path))
    parsed = parse_bed(read_lines(spark, path).filter(~F.startswith("line", F.lit("#"))))
    return parsed.select("chrom", "start", "end", "name", "strand", F.get("extra_fields", F.lit(4)).alias("sizes"), F.get("extra_fields", F.lit(6)).alias("group_label"))


def matrix_files_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two written matrices, of which the second has some values and some regions changed: what the comparison counts."""
    where = folder(spark)
    out = result(spark, sf_dir)
    number = F.expr("CAST(substring(name, 2) AS bigint)")
    moved = out.rows.withColumn("end", F.when(number % 50 == 0, F.col("end") + 1).otherwise(F.col("end")))
    moved = moved.withColumn("values", F.when(number % 7 == 1, F.transform("values", lambda v: v + 1)).otherwise(F.col("values")))
    for name, rows in (("a", out.rows), ("b", moved)):
        files.write_matrix(f"{where}/{name}.gz", out.header | {"verbose": name == "b"}, rows, False)
    d = compare.full_diff(read_matrix(spark, f"{where}/a.gz"), read_matrix(spark, f"{where}/b.gz"))
    counted = [("header", len(d.header)), ("regions", d.n_regions), ("values", d.n_values), ("rows", d.rows[0] - d.rows[1]), ("extra_columns", d.extra_columns), ("reordered", int(d.reordered))]
    return spark.createDataFrame(counted, "what string, n long")


def queries() -> dict[str, tuple[Query, str | None]]:
    bins, cells = oracle.reference_bins("TSS", 50, 100, 25), oracle.runs("mean", False)
    place = "place AS (SELECT region_id, 'r' || region_id AS name, row_number() OVER (ORDER BY group_idx, region_id) - 1 AS row_no FROM reg)"
    named = "SELECT row_no, name, sample_idx, bin, round_even(value * 1000000.0, 0) / 1000000.0 AS value FROM cells JOIN place USING (region_id)"
    exons = f"ex AS ({sql('exons', 'duckdb')})"
    return {
        "bigwig_signal": (bigwig_signal, oracle.query(select='SELECT sample_idx, chrom, s AS "start", e AS "end", CAST(CAST(value AS FLOAT) AS DOUBLE) AS value FROM sig')),
        "bigwig_chroms": (bigwig_chroms, oracle.query(select="SELECT sample_idx, chrom, length FROM chr")),
        "bigwig_range": (bigwig_range, oracle.query(select="SELECT s AS \"start\", e AS \"end\", CAST(CAST(value AS FLOAT) AS DOUBLE) AS value FROM sig WHERE sample_idx = 1 AND chrom = 'view' AND s < 9000 AND e > 5000")),
        "bed_file": (bed_file, oracle.query(select="SELECT group_idx, group_label, chrom, s AS \"start\", e AS \"end\", 'r' || region_id AS name, strand FROM reg")),
        "gtf_blocks": (
            gtf_blocks,
            oracle.query(
                exons,
                "cut AS (SELECT r.region_id, greatest(ex.s, r.s) AS xs, least(ex.e, r.e) AS xe FROM ex JOIN reg r ON r.region_id = ex.region_id)",
                select='SELECT r.region_id, r.s AS "start", r.e AS "end", strand, xs AS exon_start, xe AS exon_end FROM reg r LEFT JOIN (SELECT * FROM cut WHERE xs < xe) c ON c.region_id = r.region_id',
            ),
        ),
        "matrix_file": (matrix_file, oracle.query(bins, cells, place, select=named)),
        "matrix_header": (matrix_header, oracle.query(select="SELECT group_label AS label, CAST(sum(count(*)) OVER (ORDER BY group_idx) AS BIGINT) AS boundary FROM reg GROUP BY group_idx, group_label")),
        "values_file": (values_file, oracle.query(bins, cells, select="SELECT CAST(sample_idx * 6 + bin AS INTEGER) AS k, coalesce(printf('%.4g', value), 'nan') AS text, count(*) AS n FROM cells GROUP BY ALL")),
        "regions_file": (regions_file, oracle.query(select="SELECT chrom, s AS \"start\", e AS \"end\", 'r' || region_id AS name, strand, CAST(e - s AS VARCHAR) AS sizes, group_label FROM reg")),
        "matrix_files_diff": (
            matrix_files_diff,
            oracle.query(
                bins,
                cells,
                select="""SELECT 'header' AS what, 1::BIGINT AS n UNION ALL SELECT 'regions', 2 * count(*) FROM reg WHERE region_id % 50 = 0
                UNION ALL SELECT 'values', count(value) FROM cells WHERE region_id % 7 = 1 UNION ALL SELECT unnest(['rows', 'extra_columns', 'reordered']), 0""",
            ),
        ),
    }
