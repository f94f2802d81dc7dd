"""Definitions and references: joins by name, file and line.

Tables: symbols (seq, name, kind, file, line, ...) and refs (name, file, line, col, context).
Joins are left to Spark's choice of strategy; the probe tables are small only where a caller says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TYPE_CONTEXTS = ("Type", "TypeAnnotation", "GenericArgument", "TraitBound", "ReturnType", "ParameterType", "FieldType")
FUNCTIONS = ("function", "method")
# The kinds that a summary shows, in order.
SHOWN_KINDS = ("function", "method", "struct", "enum", "trait", "impl", "const", "type", "module")
#: Lines after a definition in which calls count as its callees, both ends excluded.
REACH = 100


def fqn(parent: Column, name: Column) -> Column:
    return F.concat_ws("::", parent, name)


def confidence(n: Column) -> Column:
    return F.when(n == 0, 0.0).when(n == 1, 1.0).otherwise(F.lit(0.5) / n + 0.5)


def of_name(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """Definitions or references of the queried names."""
    return queries.select("name").distinct().join(rows, "name")


def definition_counts(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("name").agg(F.count("*").alias("n_defs"))


def resolve(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Every reference with its number of definitions and the confidence. Definitions are counted before the join."""
    joined = refs.join(definition_counts(symbols), "name", "left").withColumn("n_defs", F.coalesce("n_defs", F.lit(0)))
    return joined.withColumn("confidence", confidence(F.col("n_defs")))


def resolved_definitions(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(name, definitions) with the locations of all definitions of each referenced name, once a name."""
    names = refs.select("name").distinct()
    return names.join(symbols, "name", "left").groupBy("name").agg(F.array_sort(F.collect_list(F.when(F.col("file").isNotNull(), F.struct("file", "line")))).alias("definitions"))


def valid_targets(symbols: DataFrame) -> DataFrame:
    """Targets whose references are valid: the only definition of the name, or some definition of the
    name lies in the target's file with its line or its kind. The target itself is such a definition."""
    return symbols.join(definition_counts(symbols), "name")


def validated_references(refs: DataFrame, targets: DataFrame, symbols: DataFrame) -> DataFrame:
    """(name, target file and line, number of references) for targets (name, file, line, kind) that need not be definitions."""
    counted = targets.join(definition_counts(symbols), "name", "left").withColumn("n_defs", F.coalesce("n_defs", F.lit(0)))
    t, d = counted.alias("t"), symbols.select("name", "file", "line", "kind").alias("d")
    near = t.where("n_defs > 1").join(d, F.expr("t.name = d.name and t.file = d.file and (t.line = d.line or t.kind = d.kind)"), "left_semi")
    ok = counted.where("n_defs <= 1").unionByName(near)
    counts = refs.groupBy("name").agg(F.count("*").alias("n_refs"))
    return ok.join(counts, "name", "left").select("name", "file", "line", F.coalesce("n_refs", F.lit(0)).alias("n_refs"))


def enclosing_function(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls with caller: the function or method of the same file with the greatest line at or before the call, the last defined on ties.

    An as-of join by one sorted pass over each file: definitions and calls are put in order together,
    and every call takes the last definition before it. No pairs are made.
    """
    defs = symbols.where(F.col("kind").isin(*FUNCTIONS)).select("file", "line", "seq", F.col("name").alias("caller"), F.lit(0).alias("_call"), *[F.lit(None).cast(t).alias(c) for c, t in calls.dtypes if c not in ("file", "line")])
    probes = calls.select("file", "line", F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("caller"), F.lit(1).alias("_call"), *[c for c in calls.columns if c not in ("file", "line")])
    w = Window.partitionBy("file").orderBy("line", "_call", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return defs.unionByName(probes).withColumn("caller", F.last("caller", ignorenulls=True).over(w)).where("_call = 1").select(*calls.columns, "caller")


def callers(names: DataFrame, refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Call references of the names with the function that each stands in."""
    calls = of_name(names, refs).where("context = 'Call'")
    return enclosing_function(calls.select("name", "file", "line", "col"), symbols)


def callees(defs: DataFrame, refs: DataFrame, reach: int = REACH) -> DataFrame:
    """(seq, callee, line): calls in the file of a definition after its line and less than ``reach`` lines on, the first of each name.

    A band join on buckets of ``reach`` lines: a definition looks into its own bucket and the next.
    """
    d = defs.select("seq", "file", F.col("line").alias("start"), F.explode(F.array(F.floor(F.col("line") / reach), F.floor(F.col("line") / reach) + 1)).alias("b"))
    c = refs.where("context = 'Call'").select("file", "line", "col", F.col("name").alias("callee"), F.floor(F.col("line") / reach).alias("b"))
    return d.join(c, ["file", "b"]).where((F.col("line") > F.col("start")) & (F.col("line") < F.col("start") + reach)).groupBy("seq", "callee").agg(F.min("line").alias("line"))


def usages(names: DataFrame, symbols: DataFrame, refs: DataFrame, include_definition: bool = True) -> DataFrame:
    """(name, role, file, line): definitions, if asked for, and references of the names."""
    found = of_name(names, refs).select("name", F.lit("reference").alias("role"), "file", "line")
    return of_name(names, symbols).select("name", F.lit("definition").alias("role"), "file", "line").unionByName(found) if include_definition else found


def ref_counts(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """References of every defined name, 0 included."""
    counts = refs.groupBy("name").agg(F.count("*").alias("n_refs"))
    return symbols.select("name").distinct().join(counts, "name", "left").select("name", F.coalesce("n_refs", F.lit(0)).alias("n_refs"))


def graph_stats(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """One row: definitions, references, distinct defined names, distinct files of either."""
    d = symbols.agg(F.count("*").alias("definitions"), F.count_distinct("name").alias("names"))
    r = refs.agg(F.count("*").alias("references"))
    f = symbols.select("file").union(refs.select("file")).distinct().agg(F.count("*").alias("files"))
    return d.join(r).join(f)  # one row each


def usages_by_context(refs: DataFrame) -> DataFrame:
    return refs.groupBy("name", "context").agg(F.count("*").alias("n"), F.min(F.struct("file", "line", "col")).alias("first")).select("name", "context", "n", F.col("first.file").alias("file"), F.col("first.line").alias("line"))


def usages_in_context(refs: DataFrame) -> DataFrame:
    """(name, context, pos, file, line, col): the references of each name and context in order, as rows; no list is gathered in one value."""
    w = Window.partitionBy("name", "context").orderBy("file", "line", "col")
    return refs.select("name", "context", F.row_number().over(w).alias("pos"), "file", "line", "col")


def context_counts(refs: DataFrame) -> DataFrame:
    calls, types, imports = F.col("context") == "Call", F.col("context").isin(*TYPE_CONTEXTS), F.col("context") == "Import"
    return refs.groupBy("name").agg(F.count_if(calls).alias("calls"), F.count_if(types).alias("types"), F.count_if(imports).alias("imports"), F.count_if(~(calls | types | imports)).alias("others"))


def kind_breakdown(symbols: DataFrame) -> DataFrame:
    """(pos, kind, n) of the kinds that a summary shows, in its order; those without a symbol are left out."""
    kinds = F.array(*[F.lit(k) for k in SHOWN_KINDS])
    return symbols.where(F.col("kind").isin(*SHOWN_KINDS)).groupBy("kind").agg(F.count("*").alias("n")).select(F.array_position(kinds, F.col("kind")).cast("int").alias("pos"), "kind", "n").orderBy("pos")


def list_symbols(symbols: DataFrame, file: str | None = None, kind: str | None = None) -> DataFrame:
    """Symbols of a kind in files that are ``file`` or end in it by whole path components."""
    out = symbols.where(F.col("kind") == kind) if kind else symbols
    return out.where((F.col("file") == file) | F.col("file").endswith("/" + file.lstrip("/"))) if file else out


def type_usages(refs: DataFrame) -> DataFrame:
    return refs.where(F.col("context").isin(*TYPE_CONTEXTS))


def trait_impls(symbols: DataFrame, trait: str) -> DataFrame:
    return symbols.where((F.col("kind") == "impl") & F.col("signature").contains(trait))


def definition_at(symbols: DataFrame, places: DataFrame) -> DataFrame:
    """The first definition at each (file, line)."""
    return places.select("file", "line").distinct().join(symbols, ["file", "line"]).groupBy("file", "line").agg(F.min_by("name", "seq").alias("name"))


def browse(symbols: DataFrame, parent: str | None, part: str) -> DataFrame:
    """Children of a symbol, or top-level symbols for None, whose name holds part in any case."""
    return symbols.where(F.col("parent").eqNullSafe(F.lit(parent)) & F.lower("name").contains(part.lower()))


def lookup(asked: DataFrame, symbols: DataFrame) -> DataFrame:
    """(qid, seq, name, file, line): the first symbol of the last part of a path (qid, path), under the part before it or under none."""
    parts = F.split("path", "::")
    q = asked.select("qid", F.element_at(parts, -1).alias("name"), F.when(F.size(parts) > 1, F.get(parts, F.size(parts) - 2)).alias("under"))
    # One symbol a name and parent meets the paths, however many share these.
    first = symbols.groupBy("name", F.col("parent").alias("above")).agg(F.min_by(F.struct("seq", "name", "file", "line"), "seq").alias("x")).select(F.col("name").alias("last"), "above", "x")
    met = q.join(first, (q["name"] == first["last"]) & F.col("above").eqNullSafe(F.col("under")))
    return met.groupBy("qid").agg(F.min_by("x", F.col("x.seq")).alias("x")).select("qid", "x.*")


def dependents(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """(name, dependent): functions that call a defined name, once each."""
    calls = refs.where("context = 'Call'").join(symbols.select("name").distinct(), "name", "left_semi").select("name", "file", "line", "col")
    return enclosing_function(calls, symbols).where("caller is not null").select("name", F.col("caller").alias("dependent")).distinct()


def expansion(seeds: DataFrame, symbols: DataFrame, refs: DataFrame, most: int = 5, scope: int = 50) -> DataFrame:
    """(seq, role, name): the parent of each seed symbol, its first callers, and the first callees and types within ``scope`` lines, ``most`` of each."""
    s = seeds.select("seq", "name", "parent", "file", "line")
    parents = s.where("parent is not null").select("seq", F.lit("parent").alias("role"), F.col("parent").alias("name"), F.lit(0).alias("at"))
    called = callers(s, refs, symbols).where("caller is not null").groupBy("name", "caller").agg(F.min("line").alias("at"))
    above = s.select("seq", "name").join(called, "name").select("seq", F.lit("caller").alias("role"), F.col("caller").alias("name"), "at")
    below = callees(s, refs, scope).select("seq", F.lit("callee").alias("role"), F.col("callee").alias("name"), F.col("line").alias("at"))
    # Types that the definition's lines name.
    d = s.select("seq", "file", F.col("line").alias("start"), F.explode(F.array(F.floor(F.col("line") / scope), F.floor(F.col("line") / scope) + 1)).alias("b"))
    t = type_usages(refs).select("file", F.col("line").alias("at"), "name", F.floor(F.col("line") / scope).alias("b"))
    types = d.join(t, ["file", "b"]).where((F.col("at") >= F.col("start")) & (F.col("at") < F.col("start") + scope)).groupBy("seq", "name").agg(F.min("at").alias("at")).select("seq", F.lit("type").alias("role"), "name", "at")
    w = Window.partitionBy("seq", "role").orderBy("at", "name")
    return parents.unionByName(above).unionByName(below).unionByName(types).withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("seq", "role", "name")


def context_lines(symbols: DataFrame, files: DataFrame, before: int = 3, after: int = 10) -> DataFrame:
    """(seq, first, snippet): the lines around each symbol, from files (path, content)."""
    lines, first = F.split("content", "\n"), F.greatest(F.lit(1), F.col("line") - before)
    met = symbols.select("seq", "line", F.col("file").alias("path")).join(files.select("path", "content"), "path")
    return met.select("seq", first.alias("first"), F.array_join(F.slice(lines, first, F.col("line") + after - first + 1), "\n").alias("snippet"))
