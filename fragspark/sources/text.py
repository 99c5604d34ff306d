"""Tab-separated inputs: fragments, intervals, groups, scores, scaling factors, chromosome sizes, motifs.

Every reader has a fixed schema. Spark's codecs read plain, .gz and .bz2 files; .zst files, whose codec Hadoop may
lack, are decompressed by Python workers a file at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ALIASES = {"chrom": "chromosome", "mapq": "min_mapq", "strand": "read1_strand"}
_FRAG_TYPES = {
    "chromosome": "string", "start": "long", "end": "long", "min_mapq": "int", "read1_strand": "string",
    "gc_weight": "double", "coverage_scaling_weight": "double", "count_scaling_weight": "double", "flen": "int",
}


_ZST = (".zst", ".zstd")


def lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, block, at, line): lines of text files, ordered by block, where their split begins, and then by at.

    Plain files are split and read by many tasks, compressed ones as Spark's codecs allow. Files of ``.zst`` are decompressed by
    Python workers as a stream, a file at a time.
    """
    told = [paths] if isinstance(paths, str) else list(paths)
    packed = [p for p in told if p.endswith(_ZST)]
    plain = [p for p in told if not p.endswith(_ZST)]

    def run(batches):
        import io

        import pyarrow as pa
        import zstandard

        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, at = [], 0
                for line in io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data)), "utf-8", "replace"):
                    rows.append(line.rstrip("\r\n"))
                    if len(rows) == 50_000:
                        yield pa.RecordBatch.from_pydict({"path": [path] * len(rows), "block": [0] * len(rows), "at": pa.array(range(at, at + len(rows)), pa.int64()), "line": rows})
                        at, rows = at + len(rows), []
                if rows:
                    yield pa.RecordBatch.from_pydict({"path": [path] * len(rows), "block": [0] * len(rows), "at": pa.array(range(at, at + len(rows)), pa.int64()), "line": rows})

    found = []
    if plain or not packed:
        text = spark.read.text(plain)
        found.append(text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line")))
    if packed:
        found.append(spark.read.format("binaryFile").load(packed).select("path", "content").mapInArrow(run, "path string, block long, at long, line string"))
    return found[0] if len(found) == 1 else found[0].union(found[1])


def _fields(df: DataFrame, separator: str = r"\t| +") -> DataFrame:
    plain = df.where(~F.col("line").rlike(r"^\s*(#|track|browser|$)"))
    return plain.withColumn("f", F.split(F.trim("line"), separator))


def _number(i: int) -> Column:
    return F.get("f", F.lit(i)).try_cast("long")


def _intervals(df: DataFrame) -> DataFrame:
    """Rows whose second and third field are numbers (headers aren't), in file order."""
    out = df.withColumn("chrom", F.get("f", F.lit(0))).withColumn("start_pos", _number(1)).withColumn("end_pos", _number(2))
    out = out.where("start_pos is not null and end_pos is not null")
    bad = F.col("end_pos") <= F.col("start_pos")
    return out.withColumn("end_pos", F.when(bad, F.raise_error(F.format_string("interval must end behind its start: %s", "line")).cast("long")).otherwise(F.col("end_pos")))


def _numbered(df: DataFrame, name: str = "window_idx") -> DataFrame:
    """File-order index over all rows: ranked within each split, behind the rows of the splits before it.

    No task ranks more than a split; the running sum has a row for each split.
    """
    splits = df.groupBy("path", "block").agg(F.count("*").alias("_n"))
    before = Window.orderBy("path", "block").rowsBetween(Window.unboundedPreceding, -1)
    based = splits.select(F.col("path").alias("_path"), F.col("block").alias("_block"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    ranked = df.withColumn("_row", F.row_number().over(Window.partitionBy("path", "block").orderBy("at")))
    met = ranked.join(based, (F.col("path") == F.col("_path")) & (F.col("block") == F.col("_block")))
    return met.withColumn(name, (F.col("_base") + F.col("_row") - 1).cast("long")).drop("_row", "_base", "_path", "_block")


def bed(spark: SparkSession, paths: str | list[str], chromosomes: list[str] | None = None) -> DataFrame:
    """chrom, start_pos, end_pos, window_idx (the row's place in the file, kept when chromosomes are chosen)."""
    out = _numbered(_intervals(_fields(lines(spark, paths)))).select("chrom", "start_pos", "end_pos", "window_idx")
    return out if chromosomes is None else out.where(F.col("chrom").isin(*chromosomes))


def grouped_bed(spark: SparkSession, paths: str | list[str], stranded: bool = False) -> DataFrame:
    """BED with a group in column 4: group_name, group_idx by first appearance, and strand if wanted.

    The strand is column 6 where rows have one; column 5 only where no row has a sixth.
    """
    rows = _numbered(_intervals(_fields(lines(spark, paths), r"\t")))
    first = rows.groupBy(F.get("f", F.lit(3)).alias("group_name")).agg(F.min("window_idx").alias("first"))
    ranked = first.withColumn("group_idx", F.row_number().over(Window.orderBy("first")).cast("long") - 1).drop("first")  # a row for each group
    out = rows.withColumn("group_name", F.get("f", F.lit(3)))
    if stranded:
        widest = F.max(F.size("f")).over(Window.partitionBy("path"))
        strand = F.when(widest >= 6, F.get("f", F.lit(5))).otherwise(F.get("f", F.lit(4)))
        out = out.withColumn("strand", F.when(strand.isin("+", "-", "."), strand).otherwise(F.raise_error(F.format_string("bad strand: %s", "line"))))
    return out.join(ranked, "group_name").select("chrom", "start_pos", "end_pos", "group_name", "group_idx", "window_idx", *(["strand"] if stranded else []))


def scored_bed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """BED with a number in column 5, or in column 4 of shorter rows."""
    rows = _numbered(_intervals(_fields(lines(spark, paths), r"\t")))
    return rows.withColumn("score", F.coalesce(F.get("f", F.lit(4)).try_cast("double"), F.get("f", F.lit(3)).try_cast("double"))).select("chrom", "start_pos", "end_pos", "score", "window_idx")


def frag(spark: SparkSession, paths: str | list[str], header: list[str] | None = None, allow_extras: bool = False) -> DataFrame:
    """Fragment files as chrom, start_pos, end_pos, mapq, strand and the weights that are there.

    ``header`` names the columns (aliases chrom, mapq, strand are understood); by default the five standard ones. Unknown
    columns are refused unless allowed. Fields are split at any white space; large files are split between tasks.
    """
    names = [_ALIASES.get(h.lower(), h.lower()) for h in (header or list(_FRAG_TYPES)[:5])]
    unknown = [n for n in names if n not in _FRAG_TYPES]
    if unknown and not allow_extras:
        raise ValueError(f"unknown fragment columns: {unknown}")
    if missing := {"chromosome", "start", "end"} - set(names):
        raise ValueError(f"fragment columns are missing: {sorted(missing)}")
    out_names = {"chromosome": "chrom", "start": "start_pos", "end": "end_pos", "min_mapq": "mapq", "read1_strand": "strand"}
    rows = spark.read.text(paths).where(~F.col("value").rlike(r"^\s*(#|$)")).withColumn("f", F.split(F.trim("value"), r"\s+"))
    wide = F.when(F.size("f") >= len(names), F.col("f")).otherwise(F.raise_error(F.format_string("too few fields: %s", "value")))
    rows = rows.select(wide.alias("f")).where(F.get("f", F.lit(names.index("start"))).try_cast("long").isNotNull() | (F.lower(F.get("f", F.lit(names.index("chromosome")))) != "chromosome") & (F.lower(F.get("f", F.lit(names.index("chromosome")))) != "chrom"))
    return rows.select(*[F.get("f", F.lit(k)).cast(_FRAG_TYPES.get(n, "string")).alias(out_names.get(n, n)) for k, n in enumerate(names)])


def chrom_sizes(spark: SparkSession, path: str) -> DataFrame:
    """chrom, chrom_len, ord from a two-column file or a FASTA index, in file order."""
    rows = _fields(lines(spark, path)).where(_number(1).isNotNull())
    return _numbered(rows, "ord").select(F.get("f", F.lit(0)).alias("chrom"), _number(1).alias("chrom_len"), "ord")


def motifs(spark: SparkSession, path: str) -> DataFrame:
    """motif, motif_group: one column makes each motif its own group."""
    rows = _fields(lines(spark, path))
    motif = F.upper(F.get("f", F.lit(0)))
    return rows.select(motif.alias("motif"), F.coalesce(F.get("f", F.lit(1)), motif).alias("motif_group")).distinct()


def scaling_factors(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    """chrom, start_pos, end_pos, factor, and the file's ``# key=value`` remarks.

    Bins of a chromosome must start at 0 and follow one another; factors must be finite and not negative.
    """
    every = lines(spark, path)
    remarks = dict(r.line.lstrip("# ").split("=", 1) for r in every.where("line like '#%=%'").select("line").limit(1000).collect())
    head = every.where("lower(line) like 'chrom%'").select(F.split(F.lower("line"), "\t").alias("h")).first()
    at = head.h.index("scaling_factor") if head and "scaling_factor" in head.h else 3
    rows = _intervals(_fields(every, r"\t")).withColumn("factor", F.get("f", F.lit(at)).try_cast("double"))
    before = F.lag("end_pos", 1, 0).over(Window.partitionBy("chrom").orderBy("start_pos"))
    ok = (before == F.col("start_pos")) & F.col("factor").isNotNull() & ~F.isnan("factor") & (F.col("factor") >= 0) & (F.col("factor") < float("inf"))
    told = rows.withColumn("factor", F.when(ok, F.col("factor")).otherwise(F.raise_error(F.format_string("bad scaling bin: %s", "line")).cast("double")))
    return told.select("chrom", "start_pos", "end_pos", "factor"), {k.strip(): v.strip() for k, v in remarks.items()}


def write_frag(frags: DataFrame, path: str) -> None:
    """Fragments as sorted, gzip-compressed TSV parts in (chrom, start, end) order."""
    names = {"chrom": "chromosome", "start_pos": "start", "end_pos": "end", "mapq": "min_mapq", "strand": "read1_strand"}
    order = ["chrom", "start_pos", "end_pos"]
    frags.repartitionByRange(*order).sortWithinPartitions(*order).withColumnsRenamed(names).write.csv(path, sep="\t", compression="gzip", header=False)


def write_tsv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.csv(path, sep="\t", header=header, compression="gzip")


def write_scaling_factors(bins: DataFrame, path: str, remarks: dict[str, str]) -> None:
    """bins(chrom, start_pos, end_pos, ..., scaling_factor) as one TSV with ``# key=value`` remarks and a header.

    A row for each stride of the genome; ``scaling_factors`` reads it back.
    """
    spark, names = bins.sparkSession, [c for c in bins.columns if c not in ("chrom", "start_pos", "end_pos", "scaling_factor")]
    head = [f"# {k}={v}" for k, v in remarks.items()] + ["\t".join(["chromosome", "start", "end", *names, "scaling_factor"])]
    top = spark.createDataFrame([("", k - len(head), x) for k, x in enumerate(head)], "chrom string, start_pos long, value string")
    row = F.concat_ws("\t", "chrom", "start_pos", "end_pos", *[F.coalesce(F.col(c).cast("string"), F.lit("NaN")) for c in [*names, "scaling_factor"]])
    every = top.union(bins.select("chrom", F.col("start_pos").cast("long"), row.alias("value")))
    every.coalesce(1).sortWithinPartitions("chrom", "start_pos").select("value").write.text(path)


def write_group_index(groups: DataFrame, path: str) -> None:
    """groups(group_idx, group_name, ...) as one TSV with a header, in the order of their index."""
    groups.coalesce(1).sortWithinPartitions("group_idx").write.csv(path, sep="\t", header=True)


def chromosomes(spark: SparkSession, told: str | list[str] | None) -> list[str] | None:
    """The chromosomes to choose: a list as it is, 'all' for no choice, or the first column of a file."""
    if told is None or isinstance(told, list):
        return told
    if told == "all":
        return None
    return [r.c for r in _numbered(_fields(lines(spark, told)), "n").orderBy("n").select(F.get("f", F.lit(0)).alias("c")).limit(100_000).collect()]
