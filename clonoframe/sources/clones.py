"""Clone-table readers: canonical files, per-sample directories, and other dialects."""

from __future__ import annotations

import csv
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clonoframe import schema as S
from clonoframe.functions.sequence import normalized_gene, standard_only
from clonoframe.operators.benchfeatures import top_clones
from clonoframe.operators.quality import with_frequency

# fixed column names of the supported formats
ALIASES = {"junction_aa": "cdr3_aa", "v_call": "v_gene", "j_call": "j_gene",
           "duplicate_count": "count"}
# names of each canonical column over all supported layouts, in order of preference
NAMES = {
    "cdr3_aa": ["CDR3AA", "junction_aa", "CDR3aa", "amino_acid", "cdr3_aa"],
    "v_gene": ["V_Gene", "v_call", "vGeneName", "v_gene"],
    "j_gene": ["J_Gene", "j_call", "jGeneName", "j_gene"],
    "count": ["Frequency", "duplicate_count", "cloneFraction", "count"],
}
# parts of a name that mark a column where none of the known names is given
SIMILAR = {"cdr3_aa": ["cdr3", "aa"], "v_gene": ["v_gene", "v_call"],
           "j_gene": ["j_gene", "j_call"], "count": []}
LONG_HEADERS = {"CDR3 amino acid sequence": "cdr3_aa", "V segments": "v_gene",
                "J segments": "j_gene", "Count": "count"}
CHAIN_IN_NAME = "__(TRA|TRB|TRG|TRD|IGH|IGK|IGL)"
# file names of cohort archives: accession, group, patient, cells, and a replicate mark before more parts
ARCHIVE_NAME = "^([^_]*)_([^_]*)_([^_]*)_([^_]*)(?:_(L[^_]*)(?=_))?"
TOP = 500
WHOLE_FILE = 1 << 40  # no file is split where only its header is read
BAD = "_rejected"  # holds the text of a line that does not fit its header
ANY_TABLE = "*.{csv,tsv,txt,csv.gz,tsv.gz,txt.gz}"


def separator(path: str) -> str:
    return "\t" if path.removesuffix(".gz").endswith((".tsv", ".txt")) else ","


def with_aliases(df: DataFrame) -> DataFrame:
    """Rename exchange-format columns to the canonical ones where those are missing."""
    return df.withColumnsRenamed(
        {old: new for old, new in ALIASES.items() if old in df.columns and new not in df.columns}
    )


def typed(df: DataFrame) -> DataFrame:
    """Canonical types; counts that are not numbers become null."""
    casts = {"count": F.col("count").try_cast("double").cast("long")}
    if "freq" in df.columns:
        casts["freq"] = F.col("freq").try_cast("double")
    return df.withColumns({k: v for k, v in casts.items() if k in df.columns})


def read_repertoire(
    spark: SparkSession, path: str, sep: str | None = None, meta: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """One clone table: (clones, meta). Missing required columns raise an error naming them."""
    rows = with_aliases(spark.read.csv(path, header=True, sep=sep or separator(path)))
    S.require(rows, S.REQUIRED)
    clones = typed(rows)
    if "freq" not in clones.columns:
        clones = clones.withColumn("freq", F.lit(None).cast("double"))
    return clones, S.sample_meta(clones, meta)


def file_stem(column: str = "_file") -> Column:
    name = F.element_at(F.split(F.col(column), "/"), -1)
    return F.regexp_replace(F.url_decode(name), r"\.(csv|tsv|txt)(\.gz)?$", "")


def parent_folder(column: str = "_file") -> Column:
    return F.element_at(F.split(F.col(column), "/"), -2)


def list_files(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """(path, _file) of the matching files that hold something; only the listing is read.

    ``_file`` is the name by which rows know their file, ``path`` the one to read it by.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(folder)
    )
    return files.where("length > 0").select("path", F.col("_metadata.file_path").alias("_file"))


def header_index(files: DataFrame) -> DataFrame:
    """(path, _file, header): the first line of each file that is not blank; null if there is none.

    Every file is one split, and its task stops reading behind the first such line, so the index
    costs a few blocks a file. The split size is set in a session of its own, which shares the
    context; paths and headers, as many as the listing Spark itself holds, come to the driver.
    """
    spark = files.sparkSession
    listed = files.select("path", "_file").collect()
    headers = {}
    if listed:
        heads = spark.newSession()
        for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            heads.conf.set(key, str(WHOLE_FILE))
        heads.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
        lines = heads.read.text([r["path"] for r in listed]).select(
            F.col("_metadata.file_path").alias("_file"), F.col("value").alias("header")
        )
        found = lines.mapInPandas(_first_lines, "_file string, header string").collect()
        headers = {r["_file"]: r["header"] for r in found}
    rows = [(r["path"], r["_file"], headers.get(r["_file"])) for r in listed]
    return spark.createDataFrame(rows, "path string, _file string, header string")


def _first_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The first line that is not blank; the rest of the task's file is left unread."""
    for batch in batches:
        some = batch[batch["header"].str.strip() != ""]
        if len(some):
            yield some.head(1)
            return


def header_names(header: str, sep: str) -> list[str]:
    """Column names of a header line; empty and repeated ones get their position."""
    names = next(csv.reader([header.removeprefix("\ufeff")], delimiter=sep))
    seen = Counter(n.lower() for n in names)
    return [
        f"_c{i}" if not n else f"{n}{i}" if seen[n.lower()] > 1 else n for i, n in enumerate(names)
    ]


class Folder:
    """Files of any mixture of layouts below one folder, read once by their header lines.

    ``sep`` is taken from each file's extension unless given. Columns are matched by name, within
    and across layouts. A line is rejected if it has more or fewer fields than its header,
    whichever columns a query uses; a file without any line is skipped.
    """

    def __init__(self, files: DataFrame, sep: str | None = None):
        self.spark = files.sparkSession
        self.index = header_index(files)
        self.layouts: dict[tuple[str, str], list[str]] = {}
        for row in sorted(self.index.collect(), key=lambda r: r["_file"]):
            if row["header"] is not None:
                kind = (sep or separator(row["path"]), row["header"])
                self.layouts.setdefault(kind, []).append(row["path"])
        self.parsed = [(header_names(h, d), self._lines(h, d, p)) for (d, h), p in self.layouts.items()]

    def _lines(self, header: str, sep: str, paths: list[str]) -> DataFrame:
        names = header_names(header, sep)
        fields = [T.StructField(n, T.StringType()) for n in [*names, BAD]]
        whole = self.spark.read.schema(T.StructType(fields)).option("columnPruning", False)
        read = whole.csv(
            paths, header=True, sep=sep, mode="PERMISSIVE", columnNameOfCorruptRecord=BAD
        )
        # a scan of the rejected text alone is refused, so its column also names the first field
        first = F.col(f"`{names[0]}`")
        rejected = F.when(F.length(first) < 0, first).otherwise(F.col(BAD))
        return read.withColumns({BAD: rejected, "_file": F.col("_metadata.file_path")})

    def rows(self) -> DataFrame:
        """Text columns with ``_file``; columns that only some layouts have are null elsewhere."""
        good = [with_aliases(lines.where(F.col(BAD).isNull()).drop(BAD)) for _, lines in self.parsed]
        return self._united(good, "_file string")

    def rejected(self) -> DataFrame:
        """(_file, line, first_field) of the lines that ``rows`` leaves out."""
        bad = [
            lines.where(F.col(BAD).isNotNull()).select(
                "_file", F.col(BAD).alias("line"), F.col(f"`{names[0]}`").alias("first_field")
            )
            for names, lines in self.parsed
        ]
        return self._united(bad, "_file string, line string, first_field string")

    def report(self) -> DataFrame:
        """(_file, header, kept, rejected) of every file listed; a skipped one has no header."""
        counts = [
            lines.groupBy("_file").agg(
                F.count_if(F.col(BAD).isNull()).alias("kept"),
                F.count_if(F.col(BAD).isNotNull()).alias("rejected"),
            )
            for _, lines in self.parsed
        ]
        counted = self._united(counts, "_file string, kept long, rejected long")
        return self.index.drop("path").join(counted, "_file", "left").na.fill(0, ["kept", "rejected"])

    def _united(self, frames: list[DataFrame], empty: str) -> DataFrame:
        if not frames:
            return self.spark.createDataFrame([], empty)
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_listed(files: DataFrame, sep: str | None = None) -> DataFrame:
    """Rows of the listed files, see ``Folder``."""
    return Folder(files, sep).rows()


def read_files(
    spark: SparkSession, folder: str, pattern: str = "*.csv", sep: str | None = None
) -> DataFrame:
    """All matching files below a folder, whatever layout each has; empty files are skipped."""
    return read_listed(list_files(spark, folder, pattern), sep)


def read_directory(
    spark: SparkSession, folder: str, chain: str | None = None, pattern: str | None = None
) -> DataFrame:
    """Per-sample files: group from the folder, sample and chain from the file name.

    ``freq`` is the share of the file's reads unless the files carry one. A trailing ``_r``
    marks a second file of the same subject and is kept apart as ``subject_id``.
    """
    glob = pattern or (f"*__{chain}*.csv" if chain else "*.csv")
    rows = typed(read_files(spark, folder, glob))
    S.require(rows, ["cdr3_aa", "v_gene", "j_gene", "count"])
    stem = file_stem()
    sample = F.split_part(stem, F.lit("__"), F.lit(1))
    found = F.regexp_extract(stem, CHAIN_IN_NAME, 1)
    named = rows.withColumns(
        {
            "sample_id": sample,
            "subject_id": F.regexp_replace(sample, "_r$", ""),
            "group": parent_folder(),
            "chain": F.when(found == "", "UNKNOWN").otherwise(found),
        }
    )
    if "freq" in rows.columns:
        return named.drop("_file")
    return with_frequency(named, "_file").drop("_file")


def resolved(columns: list[str]) -> dict[str, list[str]]:
    """Per canonical column the given columns that may hold it: known names, then similar ones."""
    return {
        name: [a for a in NAMES[name] if a in columns]
        + [c for c in columns if any(part in c.lower() for part in parts)]
        for name, parts in SIMILAR.items()
    }


def from_dialect(rows: DataFrame) -> DataFrame:
    """Canonical columns from any supported layout, or from several united by column name.

    Each value comes from the first of its column's names that is not null in the row. Missing
    genes become '?', a missing abundance 1; abundance stays as given, because some layouts
    carry shares.
    """
    found = resolved(rows.columns)
    if not found["cdr3_aa"]:
        raise ValueError("no sequence column found")

    def first(name: str) -> Column:
        return F.coalesce(*[F.col(f"`{c}`") for c in dict.fromkeys(found[name])])

    def gene(name: str) -> Column:
        value = F.coalesce(normalized_gene(first(name)), F.lit("?")) if found[name] else F.lit("?")
        return value.alias(name)

    abundance = first("count").try_cast("double") if found["count"] else F.lit(1.0)
    extra = [c for c in ("_file", "group", "sample_id", "chain") if c in rows.columns]
    out = rows.select(
        first("cdr3_aa").alias("cdr3_aa"), gene("v_gene"), gene("j_gene"),
        abundance.alias("count"), *extra,
    )
    return out.filter(standard_only("cdr3_aa", 4))


def labelled_files(
    spark: SparkSession, folders: dict[str, str], pattern: str = ANY_TABLE, sep: str | None = None, top: int = TOP,
    chain: str = "TRB", suffix: str = "",
) -> DataFrame:
    """Per-sample files of several groups, largest ``top`` valid clones of each sample.

    Separators follow the extensions unless ``sep`` is given. ``folders`` maps a group label to its folder; layouts may differ between folders.
    """
    out = None
    for group, folder in folders.items():
        rows = read_files(spark, folder, pattern, sep).withColumn("group", F.lit(group))
        rows = from_dialect(rows).withColumns(
            {"sample_id": F.regexp_replace(file_stem(), f"{suffix}$", ""), "chain": F.lit(chain)}
        ).drop("_file")
        out = rows if out is None else out.unionByName(rows)
    return top_clones(out, top)


def read_case_control(
    spark: SparkSession, control: str, case: str, chain: str = "TRB", top: int = TOP
) -> DataFrame:
    """Case and control folders of ``<id>__<chain>.csv`` files."""
    return labelled_files(
        spark, {"control": control, "case": case}, f"*{chain}*.csv", ",", top, chain,
        f"(_r)?__{chain}",
    )


def read_joint(spark: SparkSession, control: str, case: str, top: int = TOP) -> DataFrame:
    """Both chains of the samples that have both."""
    parts = [read_case_control(spark, control, case, c, top) for c in ("TRA", "TRB")]
    common = parts[0].select("sample_id").distinct().join(
        parts[1].select("sample_id").distinct(), "sample_id"
    )
    return parts[0].unionByName(parts[1]).join(common, "sample_id", "left_semi")


def read_positive_negative(spark: SparkSession, folder: str, top: int = TOP) -> DataFrame:
    """``negative`` and ``positive`` folders in the exchange or canonical layout."""
    out = None
    for group in ("negative", "positive"):
        rows = read_files(spark, f"{folder}/{group}", "*.csv")
        clean = rows.select(
            F.regexp_replace(file_stem(), "__TRB$", "").alias("sample_id"),
            F.lit(group).alias("group"),
            "cdr3_aa",
            normalized_gene("v_gene").alias("v_gene"),
            normalized_gene("j_gene").alias("j_gene"),
            F.lit("TRB").alias("chain"),
            (F.col("count").try_cast("double").cast("long") if "count" in rows.columns
             else F.lit(1).cast("long")).alias("count"),
        ).filter(standard_only("cdr3_aa", 4))
        out = clean if out is None else out.unionByName(clean)
    return top_clones(out, top)


def first_file_per_patient(files: DataFrame) -> DataFrame:
    """Choose files named ``<accession>_<group>_<patient>_<cells>[_..._L<n>]``.

    PBMC files only, one excluded group, no later replicates, first file per patient.
    """
    parts = {
        name: F.regexp_extract(file_stem(), ARCHIVE_NAME, i)
        for i, name in enumerate(("accession", "cohort", "patient", "cells", "_replicate"), 1)
    }
    named = files.where(file_stem().rlike(ARCHIVE_NAME)).withColumns(parts)
    kept = named.filter("cells = 'PBMC' and cohort != 'HAM' and _replicate in ('', 'L1')")
    first = W.partitionBy("cohort", "patient").orderBy("_file")
    return kept.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "_replicate")


def read_cohort_archive(spark: SparkSession, folder: str, case: str = "MS", top: int = TOP) -> DataFrame:
    """Compressed tab files with long headers, cohort and patient in the file name."""
    # chosen by name, so that no other archive is opened
    chosen = first_file_per_patient(list_files(spark, folder, "*.txt.gz"))
    rows = read_listed(chosen.select("path", "_file"), "\t").withColumnsRenamed(LONG_HEADERS)
    S.require(rows, ["cdr3_aa", "v_gene", "j_gene", "count"])
    clones = rows.join(chosen.drop("path"), "_file").select(
        F.concat_ws("_", "accession", "cohort", "patient").alias("sample_id"),
        F.when(F.col("cohort") == case, case).otherwise("Control").alias("group"),
        "cdr3_aa",
        normalized_gene("v_gene").alias("v_gene"),
        normalized_gene("j_gene").alias("j_gene"),
        F.lit("TRB").alias("chain"),
        F.col("count").try_cast("double").cast("long").alias("count"),
    ).filter(standard_only("cdr3_aa", 4))
    return top_clones(clones, top)
