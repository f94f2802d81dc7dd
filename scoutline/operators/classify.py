"""Paths, kinds and intents: classes and the boosts that hang on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Boosts by document type, by kind, and the further factors by intent.
DOC_BOOST = {"SourceCode": 1.5, "Documentation": 1.0, "Test": 0.8, "Notes": 0.7, "Benchmark": 0.3}
DOC_INTENT = {
    "Understand": {"SourceCode": 3.0, "Documentation": 0.1, "Notes": 0.1, "Benchmark": 0.05, "Test": 0.1},
    "FindDefinition": {"SourceCode": 2.0, "Documentation": 0.3, "Notes": 0.2, "Benchmark": 0.1, "Test": 0.2},
}
KIND_BOOST = {
    "function": 1.4, "method": 1.4, "struct": 1.3, "enum": 1.3, "trait": 1.3, "module": 1.3, "impl": 1.2, "macro": 1.0,
    "const": 0.9, "static": 0.9, "type": 0.9, "variant": 0.8, "field": 0.7, "doc": 0.6,
}
KIND_INTENT = {
    "Understand": {"function": 1.5, "method": 1.5, "struct": 1.2, "impl": 1.2, "field": 0.3, "doc": 0.2},
    "FindDefinition": {"struct": 2.0, "enum": 2.0, "trait": 2.0, "type": 1.8, "function": 1.8, "method": 1.6, "module": 1.5, "impl": 0.5, "doc": 0.1},
    "Debug": {"function": 1.3, "method": 1.3, "struct": 1.1, "enum": 1.1, "field": 0.5},
}
# Words of questions about code, labels and aliases of kinds.
CODE_WORDS = ("implementation", "algorithm", "logic", "code", "function", "method", "work", "works", "working", "implement", "source", "actual")
KIND_LABELS = {
    "function": "fn", "method": "method", "struct": "struct", "enum": "enum", "trait": "trait", "impl": "impl", "const": "const",
    "static": "static", "type": "type", "module": "mod", "macro": "macro", "variant": "variant", "field": "field", "doc": "doc",
}
ALIASES = {"fn": "function", "mod": "module", "func": "function", "class": "struct", "interface": "trait"}
LANGUAGES = {
    "Rust": ("rs",), "Markdown": ("md", "txt"), "JavaScript": ("js", "mjs", "cjs", "jsx"), "TypeScript": ("ts", "tsx", "mts", "cts"),
    "Python": ("py", "pyw", "pyi"), "Go": ("go",), "Java": ("java",), "C#": ("cs",), "C++": ("cpp", "cc", "cxx", "hpp", "hxx", "h++"),
    "C": ("c", "h"), "Ruby": ("rb", "rake"), "PHP": ("php",), "Swift": ("swift",), "Kotlin": ("kt", "kts"),
}
SUPPORTED = ("Rust", "Markdown")
# Folders that are not counted.
SKIPPED_PATHS = ("/target/", "/node_modules/", "/.git/", "/vendor/", "/build/", "/dist/", "/__pycache__/")


def choose(key: Column, values: dict, default: object = None) -> Column:
    """values[key] as one CASE expression, which stays in generated code."""
    out = None
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


def extension(path: Column) -> Column:
    """What follows the last dot of the file name; empty without one. A leading dot is no extension."""
    return F.regexp_extract(path, r"[^/]\.([^./]*)$", 1)


def is_test_file(path: Column) -> Column:
    return path.contains("/tests/") | path.endswith("_test.rs") | path.endswith("_tests.rs") | path.contains("/test_")


def document_type(path: Column) -> Column:
    """Benchmark, notes and documentation by folder, then tests, then by extension (case-sensitive)."""
    ext = extension(path)
    return (
        F.when(path.contains("/benchmarks/"), "Benchmark")
        .when(path.contains("/notes/"), "Notes")
        .when(path.contains("/doc/") & (ext == "md"), "Documentation")
        .when(is_test_file(path), "Test")
        .when(ext.isin("md", "txt"), "Documentation")
        .otherwise("SourceCode")
    )


def content_type(doc_type: Column) -> Column:
    return F.when(doc_type.isin("SourceCode", "Test"), "code").when(doc_type == "Documentation", "docs").otherwise("notes")


def language(path: Column) -> Column:
    ext = F.lower(extension(path))
    return choose(ext, {e: name for name, exts in LANGUAGES.items() for e in exts})


def skipped(path: Column) -> Column:
    out = F.lit(False)
    for part in SKIPPED_PATHS:
        out = out | path.contains(part)
    return out


def kind_named(name: Column, strict: bool = True) -> Column:
    """A kind by name or alias, whatever its case; an unknown one is an error, or null if not strict."""
    low = F.lower(name)
    found = choose(low, {**{k: k for k in KIND_LABELS}, **ALIASES})
    return F.coalesce(found, F.raise_error(F.concat(F.lit("unknown kind "), name)).cast("string")) if strict else found


def doc_boost(doc_type: Column) -> Column:
    return choose(doc_type, DOC_BOOST, 1.0).cast("float")


def by_intent(intent: Column, key: Column, factors: dict) -> Column:
    out = F.lit(1.0)
    for name, values in factors.items():
        out = F.when(intent == name, choose(key, values, 1.0)).otherwise(out)
    return out.cast("float")


def query_doc_boost(doc_type: Column, query: Column) -> Column:
    """Halved for prose where the query asks for code."""
    wants = F.lit(False)
    for w in CODE_WORDS:
        wants = wants | F.lower(query).contains(w)
    return doc_boost(doc_type) * F.when(wants & doc_type.isin("Documentation", "Notes", "Benchmark"), F.lit(0.5)).otherwise(F.lit(1.0)).cast("float")


def kind_boost(kind: Column) -> Column:
    return choose(kind, KIND_BOOST, 1.0).cast("float")


def hub_penalty(refs: Column) -> Column:
    return F.when(refs > 20, 0.5).when(refs > 10, 0.7).otherwise(1.0).cast("float")


def test_penalty(intent: Column, name: Column) -> Column:
    return F.when((intent == "Understand") & name.startswith("test_"), 0.05).otherwise(1.0).cast("float")


def census(files: DataFrame, max_files: int | None = 10_000) -> DataFrame:
    """(language, n, supported) of the first max_files entries by path, counted before the filter."""
    first = files.orderBy("path").limit(max_files) if max_files else files
    return first.where(~skipped(F.col("path"))).select(language(F.col("path")).alias("language")).where("language is not null").groupBy("language").agg(F.count("*").alias("n")).withColumn("supported", F.col("language").isin(*SUPPORTED))


def main_language(counts: DataFrame) -> DataFrame:
    """One row: the language of most files (ties by name), whether any is supported, and the total."""
    return counts.agg(
        F.min_by("language", F.struct(-F.col("n"), F.col("language"))).alias("language"), F.coalesce(F.bool_or("supported"), F.lit(False)).alias("any_supported"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")
    )


def by_support(counts: DataFrame) -> DataFrame:
    """(supported, pos, language, n): the supported and the other languages of a census, each by falling number of files, ties by name."""
    w = Window.partitionBy("supported").orderBy(F.desc("n"), "language")
    return counts.select("supported", F.row_number().over(w).alias("pos"), "language", "n")


def project_type(files: DataFrame, root: str) -> DataFrame:
    """One row: the project type by marker files directly under root, in order of precedence."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    at_root = F.col("path") == F.concat(F.lit(root.rstrip("/") + "/"), name)
    has = lambda c: F.coalesce(F.bool_or(at_root & c), F.lit(False))
    named = lambda *n: has(name.isin(*n))
    return files.agg(
        F.when(named("Cargo.toml"), "RustCargo").when(named("go.mod"), "GoMod").when(named("package.json"), "NodeJs").when(named("pyproject.toml", "setup.py", "requirements.txt"), "Python")
        .when(named("build.gradle", "build.gradle.kts"), "Gradle").when(named("pom.xml"), "Maven").when(has(name.endswith(".csproj") | name.endswith(".sln")), "DotNet").otherwise("Unknown").alias("project_type")
    )
