"""Resolution of references to symbols: a cascade of strategies, the strongest that finds any wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import STOP_NAMES

#: Confidence of each strategy, and how many candidates a name may have.
CONFIDENCE = {"qualified": 0.95, "imported_name": 0.95, "same_file": 0.9, "imported_file": 0.8, "unique": 0.6, "ambiguous": 0.3}
MOST_CANDIDATES = 4


def module_of(path) -> F.Column:
    """Dotted Python module of a path, without leading src, lib or python folders."""
    return F.regexp_replace(F.replace(F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"/__init__$", ""), F.lit("/"), F.lit(".")), r"^(src|lib|python)\.", "")


def import_edges(files: DataFrame, imports: DataFrame) -> DataFrame:
    """path, alias, name, target: imports (path, module, name, alias) bound to the files they name.

    Relative modules count their dots upwards from the importer's package; ``from p import m`` may
    name a submodule."""
    own = F.split(module_of(F.col("path")), r"\.")
    dots = F.char_length(F.regexp_extract("module", r"^\.*", 0))
    is_package = F.col("path").endswith("__init__.py")
    up = F.when(is_package, dots - 1).otherwise(dots)
    package = F.slice(own, F.lit(1), F.greatest(F.size(own) - up, F.lit(0)))
    tail = F.regexp_replace("module", r"^\.+", "")
    absolute = F.when(dots > 0, F.array_join(F.array_remove(F.concat(package, F.split(tail, r"\.")), ""), ".")).otherwise(F.col("module"))
    rows = imports.withColumn("base", absolute)
    tries = F.array(F.struct(F.lit(0).alias("turn"), F.concat_ws(".", "base", F.when(F.col("name") != "", F.col("name"))).alias("m"), F.lit("").alias("bound")), F.struct(F.lit(1).alias("turn"), F.col("base").alias("m"), F.col("name").alias("bound")))
    rows = rows.select("path", "alias", "name", "module", F.explode(tries).alias("t")).select("path", "alias", "module", "t.*")
    targets = files.select(F.col("path").alias("target"), module_of(F.col("path")).alias("m"))
    found = rows.join(targets, "m").where("path <> target")
    nth = F.row_number().over(Window.partitionBy("path", "alias", "module").orderBy("turn", "target"))
    return found.withColumn("nth", nth).where("nth = 1").select("path", "alias", F.col("bound").alias("name"), "target")


def resolve(refs: DataFrame, symbols: DataFrame, bound: DataFrame, imports: DataFrame) -> DataFrame:
    """ref, path, scope, target, strategy, confidence.

    refs: ref, path, name, qualifier, scope; symbols: symbol, path, name; bound: ``import_edges``.
    Stop names, names of one letter, names whose import is external, and a symbol's calls of itself
    are left out. A name with more than four candidates everywhere resolves to none of them."""
    known = bound.select("path", "alias").distinct().withColumn("inside", F.lit(True))
    outside = imports.select("path", "alias").distinct().join(known, ["path", "alias"], "left_anti")
    head = F.regexp_extract("qualifier", r"^\s*([^.(]*)", 1)
    refs = refs.where(~F.col("name").isin(STOP_NAMES) & (F.char_length("name") >= 2)).withColumn("head", F.trim(head))
    refs = refs.join(outside.select("path", F.col("alias").alias("head")), ["path", "head"], "left_anti")
    free = refs.where("qualifier = ''").join(outside.select("path", F.col("alias").alias("name")), ["path", "name"], "left_anti")
    refs = free.unionByName(refs.where("qualifier <> ''"))
    s = symbols.select(F.col("symbol").alias("target"), F.col("path").alias("file"), F.col("name").alias("sname"))
    counts = symbols.groupBy(F.col("name").alias("sname")).agg(F.count("*").alias("everywhere"))
    by_name = refs.join(s, F.col("name") == F.col("sname"))
    files_of = bound.select("path", F.col("target").alias("file")).distinct()
    tag = lambda df, turn, how: df.select("ref", "path", "scope", "target", F.lit(turn).alias("turn"), F.lit(how).alias("strategy"))
    modules = bound.where("name = ''").select("path", F.col("alias").alias("head"), F.col("target").alias("file"))
    names = bound.where("name <> ''").select("path", F.col("alias").alias("name"), F.col("name").alias("sname"), F.col("target").alias("file"))
    everywhere = by_name.join(counts, "sname")
    found = (
        tag(by_name.join(modules, ["path", "head", "file"]), 1, "qualified")
        .unionByName(tag(refs.join(names, ["path", "name"]).join(s, ["file", "sname"]), 2, "imported_name"))
        .unionByName(tag(by_name.where("path = file"), 3, "same_file"))
        .unionByName(tag(by_name.join(files_of, ["path", "file"]), 4, "imported_file"))
        .unionByName(tag(everywhere.where("everywhere = 1"), 5, "unique"))
        .unionByName(tag(everywhere.where(F.col("everywhere").between(2, MOST_CANDIDATES)), 6, "ambiguous"))
    )
    first = F.min("turn").over(Window.partitionBy("ref"))
    found = found.withColumn("first", first).where("turn = first")
    nth = F.row_number().over(Window.partitionBy("ref").orderBy("target"))
    found = found.withColumn("nth", nth).where((F.col("nth") <= MOST_CANDIDATES) & ~F.col("scope").eqNullSafe(F.col("target")))
    found = found.dropDuplicates(["path", "scope", "target"])
    table = F.create_map(*[F.lit(x) for item in CONFIDENCE.items() for x in item])
    return found.select("ref", "path", "scope", "target", "strategy", table[F.col("strategy")].alias("confidence"))
