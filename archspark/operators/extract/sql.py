"""Schema facts of SQL scripts: tables, columns, foreign keys, indexes and views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archspark.functions import matching as mt
from archspark.functions.frames import let, running
from archspark.operators.extract.facts import Extraction, file_nodes, prepare
from archspark.operators.graph import attr_struct, edge_frame, node_frame, ref_frame, union_all
from archspark.schema import KEYS

# Statement patterns.
QUOTED_TEXT = r"""'[^']*+(?:''[^']*+)*+'|"[^"]*+"|`[^`]*+`"""
NAME = r"""((?:["`\[]?\w+["`\]]?\s*\.\s*)*["`\[]?\w+["`\]]?)"""
CREATE_TABLE = rf"(?i)\bCREATE\s+(?:TEMP(?:ORARY)?\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?{NAME}\s*\("
CREATE_INDEX = rf"(?i)\bCREATE\s+(UNIQUE\s+)?INDEX\s+(?:IF\s+NOT\s+EXISTS\s+)?{NAME}\s+ON\s+{NAME}\s*\("
ALTER_FK = (
    rf"(?i)\bALTER\s+TABLE\s+{NAME}\s+ADD\s+(?:CONSTRAINT\s+\S+\s+)?FOREIGN\s+KEY\s*\(([^)]*)\)\s*REFERENCES\s+{NAME}\s*\(([^)]*)\)"
)
INLINE_FK = rf"""(?i)(?:FOREIGN\s+KEY\s*\(\s*["`\[]?(\w+)["`\]]?\s*\)\s*)?REFERENCES\s+{NAME}\s*\(\s*["`\[]?(\w+)"""
CREATE_VIEW = rf"(?i)\bCREATE\s+(?:OR\s+REPLACE\s+)?VIEW\s+{NAME}"
TOKEN = rf"(?s){QUOTED_TEXT}|\[[^\]]*+\]|[(),;]|[^'\"`\[(),;]++|."
FIRST_WORD = r"""^(?:"([^"]+)"|`([^`]+)`|\[([^\]]+)\]|([^\s("`\[]+))"""
CONSTRAINTS = ("primary", "foreign", "unique", "constraint", "check", "key", "index")
NOT_TYPES = (
    "NOT", "NULL", "PRIMARY", "KEY", "UNIQUE", "DEFAULT", "REFERENCES", "CONSTRAINT", "CHECK", "COLLATE", "GENERATED", "AS",
    "IDENTITY", "AUTO_INCREMENT",
)


def _last(name: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(name, r"""["`\[\]\s]""", ""), r"\."), -1)


def without_comments(text: Column) -> Column:
    """Comments become one blank; what stands in quotes is no comment."""
    marked = F.regexp_replace(text, rf"({QUOTED_TEXT})|--[^\n]*|/\*(?s:.*?)\*/", "$1\x01")
    return F.translate(F.regexp_replace(marked, rf"({QUOTED_TEXT})\x01", "$1"), "\x01", " ")


def list_items(text: Column) -> Column:
    """Items of the list that starts behind an opening bracket: (raw, bare) up to the bracket that closes it, else null.

    One pass cuts the text into quoted texts, brackets, commas and the rest; running sums give the depth of nesting. Items end at commas of
    the list itself. ``bare`` leaves out what an item nests or quotes.
    """

    def steps(tokens: Column) -> Column:
        return F.transform(tokens, lambda t: F.when(t == "(", 1).when(t == ")", -1).otherwise(0))

    def cut(held: Column) -> Column:
        tokens, depth = held["tokens"], held["depth"]
        end = F.array_position(depth, -1)

        def items(ends: Column) -> Column:
            def item(stop: Column, i: Column) -> Column:
                first = F.when(i == 0, F.lit(0)).otherwise(ends[F.greatest(i - 1, F.lit(0))] + 1)
                own = F.slice(tokens, first + 1, stop - first)
                level = F.slice(depth, first + 1, stop - first)
                flat = F.zip_with(own, level, lambda t, d: F.when((d > 0) | t.rlike("^['()]"), F.lit(" ")).otherwise(t))
                return F.struct(F.array_join(own, "").alias("raw"), F.array_join(flat, "").alias("bare"))

            return F.transform(ends, item)

        commas = F.transform(F.arrays_zip(tokens.alias("t"), depth.alias("d")), lambda x, i: F.when((x["t"] == ",") & (x["d"] == 0) & (i < end - 1), i.cast("int")))
        return F.when(end > 0, let(F.concat(F.array_compact(commas), F.array((end - 1).cast("int"))), items))

    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    return let(tokens, lambda t: let(F.struct(t.alias("tokens"), running(steps(t)).alias("depth")), cut))


def listed(text: Column, pattern: str) -> Column:
    """Matches of a pattern that ends at an opening bracket, with the items of its list; a text is read up to the next match."""

    def rows(held: Column) -> Column:
        hits = held["hits"]
        rest = lambda h, i: F.coalesce(F.try_element_at(hits, i + 2)["before"], F.substring(text, h["stop"] + 1, F.lit(1 << 30)))
        return F.transform(hits, lambda h, i: F.struct(h["match"].alias("match"), h["line"].alias("line"), list_items(rest(h, i)).alias("items")))

    return F.filter(let(F.struct(mt.matches(text, pattern).alias("hits")), rows), lambda r: r["items"].isNotNull())


def _unquote(name: Column) -> Column:
    return F.regexp_replace(F.trim(name), r"""^["`\[\]]+|["`\[\]]+$""", "")


def extract_ddl(files: DataFrame, keys: Sequence[str] = KEYS) -> Extraction:
    staged = prepare(files, ("sql",), keys).withColumn("text", without_comments(F.col("text")))
    name = F.element_at(F.split("path", "/"), -1)
    staged = staged.withColumn("migration", F.lower("path").contains("migration") | name.rlike(r"^\d{3,}[_\-]"))
    base = [*keys, "path", "module", "language", "migration"]
    files_, contains = file_nodes(staged, keys)
    file_id = F.concat(F.lit("file:"), F.col("path"))
    text = F.col("text")

    tables = staged.select(*base, F.explode(listed(text, CREATE_TABLE)).alias("m")).select(
        *base, _last(mt.group(F.col("m.match"), CREATE_TABLE, 1)).alias("table"), F.col("m.items").alias("items"), F.col("m.line").alias("line"),
    )
    table_id = F.concat(F.lit("table:"), F.col("table"))
    table_nodes = node_frame(
        tables, keys,
        attr=attr_struct(extra=F.create_map(F.lit("origin"), F.when(F.col("migration"), "migration").otherwise("schema"))),
        id=table_id, kind=F.lit("table"), name=F.col("table"), qualified_name=F.col("table"), file=F.col("path"),
        module=F.col("module"), language=F.lit("sql"), line=F.col("line"),
    )
    database = node_frame(
        staged.select(*keys).distinct(), keys, attr=attr_struct(extra=F.create_map(F.lit("origin"), F.lit("sql"))),
        id=F.lit("database:primary"), kind=F.lit("database"), name=F.lit("Relational Database"), qualified_name=F.lit("database"),
        language=F.lit("sql"),
    )
    views = staged.select(*base, F.explode(F.regexp_extract_all(text, F.lit(CREATE_VIEW), F.lit(1))).alias("view"))
    view_id = F.concat(F.lit("view:"), _last(F.col("view")))
    view_nodes = node_frame(
        views, keys, attr=attr_struct(extra=F.create_map(F.lit("object"), F.lit("view"))), id=view_id, kind=F.lit("data_store"),
        name=_last(F.col("view")), qualified_name=F.col("view"), file=F.col("path"), module=F.col("module"), language=F.lit("sql"),
    )

    parts = tables.select(*keys, "table", "line", F.posexplode("items").alias("pos", "item"))
    parts = parts.withColumn("definition", F.regexp_replace("item.raw", r"^\s+|\s+$", "")).filter("definition <> ''")
    first = F.coalesce(*[F.nullif(F.regexp_extract("definition", FIRST_WORD, i), F.lit("")) for i in range(1, 5)])
    parts = parts.withColumn("name", first).filter("name IS NOT NULL").withColumn("bare", F.regexp_replace(F.upper("item.bare"), r"\s+", " "))
    parts = parts.withColumn("constraint", F.lower("name").isin(*CONSTRAINTS) & ~F.col("definition").rlike(r"""^["`\[]"""))
    after = F.regexp_replace("definition", FIRST_WORD, "")
    second = F.regexp_replace(F.upper(F.regexp_extract(after, r"^\s*([^\s(]+(?:\s*\([^()]*\))?)", 1)), r"\s+", "")
    word = F.element_at(F.split(second, r"\("), 1)
    column_type = F.when((second == "") | word.isin(*NOT_TYPES) | second.rlike(r"""^[\d'"]"""), "TEXT").otherwise(second)
    columns = parts.filter(~F.col("constraint")).select(
        *keys, "table", "pos", "name", column_type.alias("type"),
        F.col("bare").contains("PRIMARY KEY").alias("primary_key"), (~F.col("bare").contains("NOT NULL")).alias("nullable"),
        F.col("bare").contains("UNIQUE").alias("unique"),
    )
    inline = parts.filter(F.col("definition").rlike(INLINE_FK)).select(
        *keys, "table",
        F.when(F.col("constraint"), F.regexp_extract("definition", INLINE_FK, 1)).otherwise(F.col("name")).alias("column"),
        _last(F.regexp_extract("definition", INLINE_FK, 2)).alias("references_table"),
        F.regexp_extract("definition", INLINE_FK, 3).alias("references_column"),
    )
    altered = staged.select(*keys, F.explode(F.regexp_extract_all(text, F.lit(ALTER_FK), F.lit(0))).alias("m")).select(
        *keys, _last(mt.group(F.col("m"), ALTER_FK, 1)).alias("table"), _unquote(mt.group(F.col("m"), ALTER_FK, 2)).alias("column"),
        _last(mt.group(F.col("m"), ALTER_FK, 3)).alias("references_table"), _unquote(mt.group(F.col("m"), ALTER_FK, 4)).alias("references_column"),
    )
    fks = inline.unionByName(altered)
    indexes = staged.select(*keys, F.explode(listed(text, CREATE_INDEX)).alias("m")).select(
        *keys, _last(mt.group(F.col("m.match"), CREATE_INDEX, 3)).alias("table"), _last(mt.group(F.col("m.match"), CREATE_INDEX, 2)).alias("index"),
        F.explode("m.items.raw").alias("raw"), (mt.group(F.col("m.match"), CREATE_INDEX, 1) != "").alias("unique"),
    ).select(*keys, "table", "index", _unquote(F.col("raw")).alias("column"), "unique")
    edges = union_all(
        contains,
        edge_frame(staged, keys, source=file_id, target=F.lit("database:primary"), kind=F.when(F.col("migration"), "writes").otherwise("uses")),
        edge_frame(tables, keys, source=F.lit("database:primary"), target=table_id, kind=F.lit("contains")),
        edge_frame(views, keys, source=F.lit("database:primary"), target=view_id, kind=F.lit("contains")),
    )
    refs = ref_frame(
        fks, keys,
        attr=F.create_map(F.lit("column"), F.col("column"), F.lit("references_table"), F.col("references_table"),
                          F.lit("references_column"), F.col("references_column")),
        source_id=table_id, target_name=F.col("references_table"), kind=F.lit("references"), language=F.lit("sql"),
    )
    return Extraction(
        nodes=union_all(files_, database, table_nodes, view_nodes), edges=edges, refs=refs, columns=columns, fks=fks, indexes=indexes,
    )
