"""Readers. Every schema is explicit; nothing is inferred from the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructField, StructType

from parcorp import constants as K
from parcorp import schemas
from parcorp.operators.joins import without_scheme
from parcorp.sources import splits

CORRUPT = "_corrupt"


def csv_by_name(spark: SparkSession, path: str, schema: str, null_words: Sequence[str] = K.NULL_WORDS) -> DataFrame:
    """The columns of `schema`, found by the names in the file's header.

    Further columns are not read; a missing one is an error, and so is a folder whose
    files have different headers. Quoted values may hold newlines. Words of `null_words`
    are null, quoted or not.
    """
    options = {"header": True, "multiLine": True, "escape": '"', "enforceSchema": False}
    names = spark.read.options(header=True, multiLine=True, escape='"').csv(path).columns
    text = StructType([StructField(name, StringType()) for name in names])
    wanted = StructType.fromDDL(schema)
    missing = [f.name for f in wanted if f.name not in names]
    if missing:
        raise ValueError(f"{path} has no columns {missing}")
    rows = spark.read.schema(text).options(**options).csv(path)

    return rows.select(*_typed(wanted, null_words))


def _typed(wanted: StructType, null_words: Sequence[str]) -> list[Column]:
    def value(f: StructField) -> Column:
        c = F.col(f"`{f.name}`")
        return F.when(~c.isin(list(null_words)), c).cast(f.dataType).alias(f.name)

    return [value(f) for f in wanted]


def csv_split(spark: SparkSession, path: str, schema: str, null_words: Sequence[str] = K.NULL_WORDS) -> DataFrame:
    """The same rows as `csv_by_name`, for large files: every file is read by many tasks.

    Quotes inside quoted values are doubled, as the writer does; lines end with \\n or \\r\\n.
    All files of a folder have one header.
    """
    names = spark.read.options(header=True, multiLine=True, escape='"').csv(path).columns
    wanted = StructType.fromDDL(schema)
    if missing := [f.name for f in wanted if f.name not in names]:
        raise ValueError(f"{path} has no columns {missing}")
    found = splits.records(splits.csv_changes(splits.units(spark, path, "\n")), "\n")
    titles = found.where("opening").select(F.rtrim("text", F.lit("\r"))).distinct().limit(2).count()
    if titles > 1:
        raise ValueError(f"the files of {path} have different headers")
    columns = ", ".join(f"`{name.replace('`', '``')}` string" for name in names)
    line = F.rtrim("text", F.lit("\r"))
    rows = found.where(~F.col("opening") & (line != "")).select(
        F.from_csv(line, columns, {"escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"}).alias("_r"))
    return rows.select("_r.*").select(*_typed(wanted, null_words))


def json_elements(spark: SparkSession, path: str, schema: DataType, depth: int = 1, entries: bool = False) -> DataFrame:
    """The elements of large JSON files, compact or pretty-printed, read by many tasks.

    Each file is one array, of which every element becomes a row of the fields of `schema`, a struct
    (`depth` 1), or it holds such an array `depth` - 1 brackets deep, before which nothing and
    behind which nothing as deep stands. With `entries` it is an object in place of the array, and every entry becomes a
    row (key, value). What cannot be parsed is kept in `_corrupt`. Files without elements
    give no rows.
    """
    found = splits.records(splits.json_changes(splits.units(spark, path, ",")), ",", depth)
    opened = r'^(?:(?:[^\[{"]++|"(?:[^"\\]++|\\.)*+")*+[\[{]){%d}' % depth
    body = F.when(F.col("opening"), F.regexp_replace("text", opened, "")).otherwise(F.col("text"))
    # parsing ends with the bracket, so what follows the last element does no harm
    whole = F.concat(F.lit("{" if entries else "["), body, F.lit("}" if entries else "]"))
    kind = MapType(StringType(), schema) if entries else ArrayType(schema)
    parsed = found.select(whole.alias("t")).select("t", F.from_json("t", kind).alias("e"))
    bad = F.when(F.col("e").isNull(), F.col("t")).alias(CORRUPT)
    if entries:
        return parsed.where("e IS NULL OR size(e) > 0").select(F.explode_outer("e").alias("key", "value"), bad)
    return parsed.where("e IS NULL OR size(e) > 0").select(F.explode_outer("e").alias("e"), bad).select("e.*", CORRUPT)


def corpus_csv(spark: SparkSession, path: str, schema: str = schemas.TEXTS,
               null_words: Sequence[str] = K.NULL_WORDS) -> DataFrame:
    """A corpus file with quoted multi-line texts, nulls and null words as empty strings."""
    return csv_by_name(spark, path, schema, null_words).na.fill("")


def keyed_csv(spark: SparkSession, path: str, schema: str,
              null_words: Sequence[str] = K.NULL_WORDS) -> DataFrame:
    """A file with a nullable long key; the empty string and null words are null."""
    return csv_by_name(spark, path, schema, null_words)


def _with_corrupt(schema: str) -> str:
    return f"{schema}, {CORRUPT} string"


def record_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record per line; a record that does not parse is kept whole in `_corrupt`."""
    return (
        spark.read.schema(_with_corrupt(schema)).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT).json(path)
    )


def parsed_records(lines: DataFrame, schema: str, keep: Sequence[str] = (), value: str = "value") -> DataFrame:
    """The same for records that are already a text column."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    record = F.from_json(F.col(value), _with_corrupt(schema), options)
    return lines.select(*keep, record.alias("_r")).select(*keep, "_r.*")


def good_and_bad(records: DataFrame, drop: Sequence[str] = ("cdl",)) -> tuple[DataFrame, DataFrame]:
    """Records without the bulky fields, and the raw lines that failed."""
    good = records.where(F.col(CORRUPT).isNull()).drop(CORRUPT, *drop)
    return good.na.fill(""), records.where(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def json_files(spark: SparkSession, paths: Sequence[str], schema: str, lines: bool = False) -> DataFrame:
    """Several files or folders as one table: each file one JSON array or object, or, with
    `lines`, one object per line, which lets a large file be read by many tasks."""
    return spark.read.schema(schema).option("multiLine", not lines).json(list(paths))


def sign_list_letters(spark: SparkSession, path: str) -> DataFrame:
    """A sign list in its published form, one object with all letters, as rows of one letter
    each that `operators.lookups.sign_entries` takes."""
    letter = StructType.fromDDL(schemas.SIGN_LIST)[0].dataType["j:letters"].dataType.elementType
    rows = json_elements(spark, path, letter, depth=3).where(F.col(CORRUPT).isNull())
    letters = F.array(F.struct("`sl:letter`"))
    return rows.select(F.struct(letters.alias("j:letters")).alias("sl:signlist"))


def sign_list(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return json_files(spark, [path], schemas.SIGN_LIST, lines)


def atf_records(spark: SparkSession, paths: Sequence[str], lines: bool = False) -> DataFrame:
    return json_files(spark, paths, schemas.ATF_RECORDS, lines)


def index_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(reading, name) from {"index": {reading: name}}."""
    return json_files(spark, [path], schemas.INDEX, lines).select(
        F.explode("index").alias("reading", "name")
    )


def generated_json(spark: SparkSession, path: str, pretty: bool = False) -> DataFrame:
    """All *.json results of a folder: one record per line, as the writer makes them, or
    with `pretty` one record, or array of records, per file over several lines."""
    reader = spark.read.schema(schemas.GENERATED).option("pathGlobFilter", "*.json")
    return reader.option("multiLine", pretty).json(path).drop("batch")


def split_table(spark: SparkSession, path: str) -> DataFrame:
    """A dataset with a `split` partition column."""
    return spark.read.parquet(path)


def file_inventory(spark: SparkSession, root: str) -> DataFrame:
    """(path) of all files below a folder, on any file system, without their contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(without_scheme(F.col("path")).alias("path"))
