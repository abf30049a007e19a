"""Records of varying shape: their fields, and tables on the fields that all corpora share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcorp.session import materialised


def record_map(record: str) -> Column:
    """The top-level fields of a variant column by name; null for anything but an object."""
    return F.try_variant_get(F.col(record), "$", "map<string, variant>")


def record_fields(records: DataFrame, corpus: str = "corpus", record: str = "record") -> DataFrame:
    """(corpus, field, n, kind): in how many records of a corpus a field stands, and the type
    that holds all its values there.

    A corpus without any field gives one row whose field is null. Combined before the
    shuffle: a task sends one row per corpus and field.
    """
    maps = records.select(F.col(corpus).alias("corpus"), record_map(record).alias("fields"))
    each = maps.select("corpus", F.explode_outer("fields").alias("field", "value"))
    found = each.groupBy("corpus", "field").agg(F.count("*").alias("n"), F.schema_of_variant_agg("value").alias("kind"))
    some = found.groupBy("corpus").agg(F.count("field").alias("c")).where("c > 0").select(F.col("corpus").alias("other"))
    # rows without fields count for nothing where other rows of the corpus have some
    bare = found.where("field IS NULL").join(some, F.col("corpus").eqNullSafe(F.col("other")), "left_anti")
    return found.where("field IS NOT NULL").unionByName(bare.withColumn("kind", F.lit(None).cast("string")))


def common_fields(fields: DataFrame) -> list[str]:
    """Names of the fields that every corpus has, sorted; `fields` as from record_fields."""
    corpora = fields.select("corpus").distinct().count()
    shared = fields.where("field IS NOT NULL").groupBy("field").agg(F.count("*").alias("c"))
    return sorted(r.field for r in shared.where(F.col("c") == corpora).collect())


def collate_records(records: DataFrame, corpus: str = "corpus", record: str = "record",
                    keep: Sequence[str] = ()) -> DataFrame:
    """All records on the fields that every corpus has, with the corpus and the columns `keep`.

    Values are text: objects and arrays as JSON, absent fields and JSON nulls as "". A field
    belongs to a corpus when any of its records has it, so its values decide, not a schema.
    """
    names = common_fields(materialised(record_fields(records, corpus, record)))
    clash = set(names) & {corpus, *keep}
    if clash:
        raise ValueError(f"fields named like columns: {sorted(clash)}")
    parts = records.select(corpus, *keep, record_map(record).alias("fields"))

    def value(name: str) -> Column:
        v = F.col("fields")[F.lit(name)]
        nested = F.schema_of_variant(v).rlike("^(OBJECT|ARRAY)")
        return F.coalesce(F.when(nested, F.to_json(v)).otherwise(F.try_variant_get(v, "$", "string")), F.lit(""))

    return parts.select(corpus, *keep, *[value(n).alias(n) for n in names])
