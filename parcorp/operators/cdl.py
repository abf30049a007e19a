"""The text of a record from the tree of its contents (`cdl`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Node kinds of the record format, and the marks of the corpus for them
WORD, DIVISION, LINE = "l", "d", "line-start"
MARKS = {
    "obverse": "<SURFACE>", "reverse": "<SURFACE>", "surface": "<SURFACE>", "column": "<COLUMN>",
    "ruling": "<RULING>", "blank": "<BLANK_SPACE>", "broken": "...", "traces": "...", "nonx": "...",
}
FIELDS = ("node", "type", "subtype", "state", "frag")
LEVELS = 15  # read below the first by one cast


def depth(tree: Column) -> Column:
    """How deep the brackets of a JSON text are nested, at most."""
    brackets = F.regexp_replace(F.regexp_replace(tree, r'"(?:[^"\\]++|\\.)*+"', ""), r"[^\[\]]++", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc: Column, c: Column) -> Column:
        now = acc["now"] + F.when(c == "[", 1).when(c == "]", -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(F.split(brackets, ""), start, step, lambda acc: acc["most"])


def node_type(levels: int) -> str:
    """The fields of a node that a text is made from, its children to the given depth; what
    lies deeper stays a variant."""
    children = "variant" if levels == 0 else f"array<{node_type(levels - 1)}>"
    return f"struct<{', '.join(f'{name} string' for name in FIELDS)}, f struct<form string>, cdl {children}>"


def leaves(tree: Column, levels: int = LEVELS) -> Column:
    """All nodes without children of a variant array of nodes, in reading order, as structs
    of the fields that a text is made from.

    One cast reads `levels` levels of the tree at once; every level then puts the children of
    inner nodes in their places, whatever they hold besides. Only a record that goes deeper
    is measured, and takes further steps of as many levels each, so no depth is assumed. Nodes
    never leave their record: nothing is shuffled.
    """
    def opened(nodes: Column, left: int) -> Column:
        def one(node: Column) -> Column:
            plain = F.array(F.struct(*[node[name].alias(name) for name in FIELDS], node["f"]["form"].alias("form"),
                                     (node["cdl"] if left == 0 else F.lit(None).cast("variant")).alias("deeper")))
            return plain if left == 0 else F.coalesce(opened(node["cdl"], left - 1), plain)

        return F.flatten(F.transform(nodes, one))

    def read(value: Column) -> Column:
        return opened(F.try_variant_get(value, "$", f"array<{node_type(levels)}>"), levels)

    def goes_on(acc: Column, _: Column) -> Column:
        return F.flatten(F.transform(acc, lambda leaf: F.coalesce(read(leaf["deeper"]), F.array(leaf))))

    def deep(nodes: Column) -> Column:
        return F.exists(nodes, lambda leaf: leaf["deeper"].isNotNull())

    steps = F.sequence(F.lit(1), F.greatest(F.ceil(depth(F.to_json(tree)) / (levels + 1)).cast("int"), F.lit(1)))
    # (the array is bound to a name, so that the tree is read once)
    return F.get(F.transform(F.array(read(tree)), lambda nodes: F.when(
        deep(nodes), F.aggregate(steps, nodes, goes_on)).otherwise(nodes)), F.lit(0))


def text_of_tree(tree: Column, marks: dict[str, str] = MARKS) -> Column:
    """Lines of words, marks on lines of their own.

    A word is the node's `frag`, as it stands on the tablet, or else the `form` of its
    reading. A line begins at every line start; a division with a mark is a line, others
    leave no trace. Nodes of other kinds and words without a text are left out; so are
    lines without words. A tree without nodes is an empty text, a missing one is null.
    """
    table = F.create_map(*[F.lit(x) for pair in marks.items() for x in pair])

    def piece(node: Column) -> Column:
        # breaks before and after marks, spaces between words; null: no trace
        mark = F.coalesce(*[F.try_element_at(table, node[k]) for k in ("state", "subtype", "type")])
        return (F.when(node["node"] == WORD, F.concat(F.lit(" "), F.coalesce(node["frag"], node["form"])))
                .when((node["node"] == DIVISION) & (node["type"] == LINE), F.lit("\n"))
                .when(node["node"] == DIVISION, F.concat(F.lit("\n"), mark, F.lit("\n"))))

    strung = F.array_join(F.transform(leaves(tree), piece), "")  # (leaves out the nulls)
    # runs of breaks are one
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(
        strung, r"\n ++", "\n"), r"\n{2,}+", "\n"), r"^[\n ]++|\n++$", "")


def with_text(records: DataFrame, tree: str = "cdl", out: str = "transliteration") -> DataFrame:
    """Add the text of each record's tree, a variant column, which leaves the table."""
    return records.withColumn(out, text_of_tree(F.col(tree))).drop(tree)
