"""Readers and writers: raw pages, JSON lines, nested JSON, CSV, parquet, and keyed document folders."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from podium import schema
from podium.functions.text import as_col

# Names of files that hold no results, and suffixes by kind of file.
SKIPPED_NAMES = r"^(xxxxxxx|index|matrix|.*instruction)"
SUFFIXES = {
    "html": ("htm", "html"),
    "image": ("jpg", "jpeg", "png", "gif", "bmp", "tif", "tiff"),
    "pdf": ("pdf",),
    "doc": ("doc", "docx"),
}


def file_name(path: Column | str) -> Column:
    return F.regexp_extract(as_col(path), r"([^/]*)$", 1)


def skipped_name(path: Column | str) -> Column:
    return F.lower(file_name(path)).rlike(SKIPPED_NAMES)


def year_of_path(path: Column | str) -> Column:
    """Year of the innermost 'racingYYYY' folder."""
    years = F.regexp_extract_all(as_col(path), F.lit(r"racing(\d{4})"), F.lit(1))
    return F.try_element_at(years, F.lit(-1)).try_cast("int")


def file_type(path: Column | str) -> Column:
    suffix = F.lower(F.regexp_extract(file_name(path), r"\.([A-Za-z0-9]+)$", 1))
    kinds = F.create_map(*[F.lit(x) for kind, names in SUFFIXES.items() for n in names for x in (n, kind)])
    return F.coalesce(F.try_element_at(kinds, suffix), F.lit("other"))


def checksum(content: Column | str) -> Column:
    return F.sha2(as_col(content).cast("binary"), 256)


def scan_pages(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """HTML files under the roots: path, name, year, html and checksum. Files are read by the tasks, not the driver."""
    raw = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.[hH][tT][mM]*")
        .load(list(roots))
    )
    pages = raw.where(F.col("path").rlike(r"(?i)\.html?$") & ~skipped_name("path"))
    return pages.select(
        "path",
        file_name("path").alias("name"),
        year_of_path("path").alias("year"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("html"),
        checksum("content").alias("checksum"),
    )


#: Column that takes a line, or a whole document, which does not read as declared; null for all others.
CORRUPT = "corrupt_record"


def read_json_lines(spark: SparkSession, path: str, ddl: str, corrupt: bool = False) -> DataFrame:
    """JSON lines under a declared schema; with ``corrupt``, malformed lines are kept in CORRUPT."""
    reader = spark.read.schema(f"{ddl}, {CORRUPT} string" if corrupt else ddl)
    return reader.option("columnNameOfCorruptRecord", CORRUPT).json(path)


#: Records of a packed file, which is read by one task as it can't be split.
RECORDS_PER_FILE = 20_000


def _packed(writer: DataFrameWriter, packed: bool) -> DataFrameWriter:
    return writer.option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE) if packed else writer


def write_json_lines(df: DataFrame, path: str, packed: bool = False) -> None:
    """JSON lines; ``packed`` files take a tenth of the disk, and readers know them by their names."""
    _packed(df.write.mode("overwrite"), packed).json(path)


def append_lines(lines: DataFrame, path: str, packed: bool = False) -> None:
    """Add lines of text, as they are, to a folder of such files."""
    _packed(lines.write.mode("append"), packed).text(path)


def read_csv(spark: SparkSession, path: str, ddl: str, corrupt: bool = False) -> DataFrame:
    """Headed CSV; without ``corrupt`` the header must be as declared, with it lines that don't fit are kept in CORRUPT."""
    if not corrupt:
        return spark.read.csv(path, header=True, schema=ddl, enforceSchema=False)
    # lines with too few or too many fields are told by all columns; a value is judged when its column is read
    reader = spark.read.option("columnPruning", False).option("columnNameOfCorruptRecord", CORRUPT)
    return reader.csv(path, header=True, schema=f"{ddl}, {CORRUPT} string")


def write_csv(df: DataFrame, path: str, fields: Sequence[str]) -> None:
    """CSV with the declared columns in the declared order."""
    df.select(*fields).write.mode("overwrite").csv(path, header=True)


def write_json_documents(documents: DataFrame, path: str) -> None:
    """One file for each row's text, a JSON document of several lines."""
    documents.write.mode("append").option("maxRecordsPerFile", 1).text(path)


def read_json_documents(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Records of files that hold one JSON document or an array of them; files that don't read are kept in CORRUPT."""
    reader = spark.read.schema(f"{ddl}, {CORRUPT} string").option("multiLine", True)
    return reader.option("columnNameOfCorruptRecord", CORRUPT).json(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_certificates(spark: SparkSession, path: str) -> DataFrame:
    """Nested certificate documents flattened to the columns that scoring needs."""
    docs = spark.read.schema(schema.CERTIFICATE).json(path, multiLine=True)
    return flatten_certificates(docs)


def flatten_certificates(docs: DataFrame) -> DataFrame:
    s = "scoring"
    bands = {"low": "low", "med": "medium", "high": "high"}
    return docs.where(F.col("orc_ref").isNotNull() & (F.col("orc_ref") != "")).select(
        F.col("orc_ref").alias("cert_ref"),
        "boat_class",
        "gph",
        F.col(f"{s}.coastal.tot").alias("coastal_tot"),
        F.col(f"{s}.coastal.tod").alias("coastal_tod"),
        *[
            F.col(f"{s}.coastal_triple.{band}.{k}").alias(f"coastal_{short}_{k}")
            for short, band in bands.items()
            for k in ("tot", "tod")
        ],
        F.col(f"{s}.windward_leeward.tot").alias("wl_tot"),
        F.col(f"{s}.windward_leeward.tod").alias("wl_tod"),
    )


def write_documents(docs: DataFrame, path: str, key: str, files: int | None = None, packed: bool = False) -> None:
    """One folder per key value; a rerun replaces only the keys it writes. ``key`` must have few values, such as a period.

    The shuffle is by key and a salt, so a key that holds much of the data is written by several tasks.
    """
    spread = docs
    if files:
        salt = F.pmod(F.xxhash64(*docs.columns), F.lit(files))
        spread = docs.repartition(F.col(key), salt)
    writer = spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    _packed(writer, packed).partitionBy(key).json(path)


def read_documents(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Documents of a folder of keys under a declared schema, which names the key too."""
    return spark.read.schema(ddl).json(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Idempotent full reload."""
    df.write.mode("overwrite").parquet(path)


def chosen_marts(builders: Mapping[str, Callable[[], DataFrame]], only: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """The chosen marts, all of them by default; unknown names are refused before any is built."""
    chosen = list(builders) if only is None else list(only)
    unknown = sorted(set(chosen) - set(builders))
    if unknown:
        raise ValueError(f"unknown marts: {', '.join(unknown)}; known are: {', '.join(builders)}")
    return {name: builders[name]() for name in chosen}


def build_marts(
    builders: Mapping[str, Callable[[], DataFrame]], path: str, only: Sequence[str] | None = None
) -> list[str]:
    """Write the chosen marts as JSON lines, one folder each."""
    marts = chosen_marts(builders, only)
    for name, mart in marts.items():
        write_json_lines(mart, f"{path}/{name}")
    return list(marts)
