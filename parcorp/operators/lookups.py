"""Sign lookups: reading -> sign names, sign name -> glyph, sign name -> its only reading."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcorp.session import BROADCAST_BYTES, fits_broadcast, materialised


# ---- nested sign list to flat edges ---------------------------------------------------------
def sign_entries(sign_list: DataFrame) -> DataFrame:
    """(name, glyph, aliases, readings), one row per sign and per form of a sign."""
    signs = (
        sign_list.select(F.explode("`sl:signlist`.`j:letters`").alias("letter"))
        .select(F.explode("letter.`sl:letter`.`j:signs`").alias("sign"))
        .select("sign.`sl:sign`.*")
    )
    forms = signs.select(F.explode("`j:forms`").alias("form")).select("form.`sl:form`.*")
    return _entries(signs).unionByName(_entries(forms))


def _entries(df: DataFrame) -> DataFrame:
    def names(column: str, field: str) -> Column:
        found = F.transform(F.col(f"`{column}`"), lambda x: x[field]["n"])
        return F.coalesce(found, F.array().cast("array<string>"))

    return df.select(
        F.replace("n", F.lit("&amp;"), F.lit("&")).alias("name"),
        F.coalesce("`sl:ucun`", F.lit("")).alias("glyph"),
        F.transform(
            names("j:aka", "sl:aka"), lambda n: F.replace(n, F.lit("&amp;"), F.lit("&"))
        ).alias("aliases"),
        F.filter(names("j:values", "sl:v"), lambda n: n.isNotNull()).alias("readings"),
    )


def reading_edges(entries: DataFrame) -> DataFrame:
    return entries.select(F.explode("readings").alias("reading"), "name")


def glyph_edges(entries: DataFrame) -> DataFrame:
    """An entry's glyph stands for its name and for each of its aliases."""
    return entries.select(F.explode(F.concat(F.array("name"), "aliases")).alias("name"), "glyph")


# ---- edges to lookups ----------------------------------------------------------------------
def reading_names(edges: DataFrame) -> DataFrame:
    """(reading, names): the sorted set of names; an empty name counts for nothing.

    Edges are made distinct first, by a plain hash aggregate: an edge that occurs very
    often is reduced in the map tasks before any list is built.
    """
    names = F.array_remove(F.sort_array(F.collect_list("name")), "")
    return edges.distinct().groupBy("reading").agg(names.alias("names"))


def override(base: DataFrame, index: DataFrame) -> DataFrame:
    """The index (reading, name) replaces the names of its readings and adds new ones."""
    index = index.select("reading", F.array("name").alias("_new"))
    return base.join(index, "reading", "full_outer").select(
        "reading", F.coalesce("_new", "names").alias("names")
    )


def name_glyphs(edges: DataFrame) -> DataFrame:
    """(name, glyphs): the sorted set of glyphs of each name, empty ones left out."""
    glyphs = F.array_remove(F.sort_array(F.collect_list("glyph")), "")
    return edges.distinct().groupBy("name").agg(glyphs.alias("glyphs"))


def ambiguous(glyphs: DataFrame) -> DataFrame:
    return glyphs.where(F.size("glyphs") > 1)


def name_glyph(glyphs: DataFrame) -> DataFrame:
    """(name, glyph): the smallest glyph, or an empty string when there is none."""
    return glyphs.select("name", F.coalesce(F.array_min("glyphs"), F.lit("")).alias("glyph"))


def inverted(readings: DataFrame) -> DataFrame:
    """(name, reading), distinct: which readings a name has. Kept long, so that a name
    with very many readings stays spread over tasks."""
    return readings.select(F.explode("names").alias("name"), "reading").distinct()


def only_readings(readings: DataFrame) -> DataFrame:
    """(name, reading) for the names that have exactly one reading."""
    return (
        inverted(readings).groupBy("name")
        .agg(F.count("*").alias("_n"), F.min("reading").alias("reading"))
        .where("_n = 1").select("name", "reading")
    )


@dataclass
class SignLookups:
    """The tables the sign lookup joins with."""

    readings: DataFrame  # reading, names
    glyphs: DataFrame  # name, glyph
    only: DataFrame  # name, reading
    small: bool  # all three are known to fit a broadcast
    keep_named: bool = False  # keep bare sign names as readings instead of <unk>

    @classmethod
    def of(cls, readings: DataFrame, glyphs: DataFrame, keep_named: bool = False,
           limit: int = BROADCAST_BYTES) -> SignLookups:
        """Check the sizes in bytes. A sign list fits; a lookup that grew with a corpus may
        not: then distinct morphemes are resolved by shuffle joins, with the same results.
        """
        only = materialised(only_readings(readings))  # measured here and joined several times
        small = all(fits_broadcast(df, limit) for df in (readings, glyphs, only))
        return cls(readings, glyphs, only, small, keep_named)

    def entries(self) -> DataFrame:
        """All lookups as one table (kind, key, names, only): readings, own names, only
        readings of names. A key occurs once per kind."""
        none, no_text = F.lit(None).cast("array<string>"), F.lit(None).cast("string")
        return (
            self.readings.select(F.lit("reading").alias("kind"), F.col("reading").alias("key"), "names", no_text.alias("only"))
            .unionByName(self.glyphs.select(F.lit("name").alias("kind"), F.col("name").alias("key"), none.alias("names"), no_text.alias("only")))
            .unionByName(self.only.select(F.lit("only").alias("kind"), F.col("name").alias("key"), none.alias("names"), F.col("reading").alias("only")))
        )

    def morphemes(self) -> DataFrame:
        """(morpheme): what the lookups themselves name: readings, bare and as
        determinatives, and sign names."""
        braced = F.concat(F.lit("{"), "reading", F.lit("}"))
        return (
            self.readings.select(F.explode(F.array("reading", braced)).alias("morpheme"))
            .union(self.glyphs.select("name")).distinct()
        )
