"""One query per operator over tables derived from the driver's, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoutline.operators import classify as C
from scoutline.operators import commits, documents, hybrid, memory, query_language, rust_source, state, text_search, tickets, top_k, trigrams, vector_index
from scoutline.operators import navigation as N
from scoutline.plans.fixtures import cte, frame
from scoutline.sources import project
from scoutline.streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *tables: str, sql: str | None = None, raw: bool = False):
    """Registers fn(*tables) as a query; ``sql`` may use the tables by name."""

    def add(fn):
        QUERIES[name] = (lambda spark, sf, fn=fn: fn(spark, *[frame(spark, sf, t) for t in tables])) if raw else (lambda spark, sf, fn=fn: fn(*[frame(spark, sf, t) for t in tables]))
        if sql:
            text = sql.strip()
            head = cte(*tables)
            ORACLES[name] = (head[:-1] + ",\n" + text[5:] if text.startswith("WITH ") else head + text) if len(head) > 6 else text
        return fn

    return add


def probe(symbols: DataFrame) -> DataFrame:
    """The names that are asked for: those of every symbol whose number divides by 20, against all rows."""
    return symbols.where("seq % 20 = 0").select("name").distinct()


# --- classes and filters -------------------------------------------------------------------------

TYPE_SQL = """CASE WHEN contains({p}, '/benchmarks/') THEN 'Benchmark' WHEN contains({p}, '/notes/') THEN 'Notes' WHEN contains({p}, '/doc/') AND {p} LIKE '%.md' THEN 'Documentation'
 WHEN contains({p}, '/tests/') OR {p} LIKE '%\\_test.rs' ESCAPE '\\' OR {p} LIKE '%\\_tests.rs' ESCAPE '\\' OR contains({p}, '/test_') THEN 'Test' WHEN {p} LIKE '%.md' OR {p} LIKE '%.txt' THEN 'Documentation' ELSE 'SourceCode' END"""


def type_sql(p: str) -> str:
    return TYPE_SQL.replace("{p}", p)


@query("P1_P2_P3_path_classes", "files", sql=f"SELECT path, t AS document_type, contains(path, '/tests/') OR path LIKE '%\\_test.rs' ESCAPE '\\' OR path LIKE '%\\_tests.rs' ESCAPE '\\' OR contains(path, '/test_') AS is_test, CASE WHEN t IN ('SourceCode', 'Test') THEN 'code' WHEN t = 'Documentation' THEN 'docs' ELSE 'notes' END AS content_type FROM (SELECT path, {type_sql('path')} AS t FROM files)")
def _(files):
    t = C.document_type(F.col("path"))
    return files.select("path", t.alias("document_type"), C.is_test_file(F.col("path")).alias("is_test"), C.content_type(t).alias("content_type"))


@query("S1_discover_files", "files", sql="SELECT path, size FROM files WHERE regexp_matches(lower(path), '\\.(rs|md|txt)$') AND size <= 1048576 AND NOT contains(path, '/.')")
def _(files):
    return project.discover(files).select("path", "size")


LANG_SQL = "CASE regexp_extract(lower(path), '\\.([^.]*)$', 1) WHEN 'rs' THEN 'Rust' WHEN 'md' THEN 'Markdown' WHEN 'txt' THEN 'Markdown' WHEN 'ts' THEN 'TypeScript' WHEN 'py' THEN 'Python' END"


@query("S2_A7_language_census", "files", sql=f"SELECT language, count(*) AS n, language IN ('Rust', 'Markdown') AS supported FROM (SELECT {LANG_SQL} AS language FROM (SELECT path FROM files ORDER BY path LIMIT 10000) WHERE NOT contains(path, '/target/')) WHERE language IS NOT NULL GROUP BY language")
def _(files):
    return C.census(files)


@query("A8_main_language", "files", sql=f"WITH c AS (SELECT language, count(*) AS n FROM (SELECT {LANG_SQL} AS language FROM (SELECT path FROM files ORDER BY path LIMIT 10000) WHERE NOT contains(path, '/target/')) WHERE language IS NOT NULL GROUP BY language) SELECT (SELECT language FROM c ORDER BY n DESC, language LIMIT 1) AS language, (SELECT bool_or(language IN ('Rust', 'Markdown')) FROM c) AS any_supported, (SELECT sum(n)::BIGINT FROM c) AS total")
def _(files):
    return C.main_language(C.census(files))


@query("S3_project_type", "files", raw=True, sql="SELECT 'NodeJs' AS project_type")
def _(spark, files):
    marks = spark.createDataFrame([("/proj/package.json",), ("/proj/pom.xml",), ("/proj/src/Cargo.toml",)], "path string")
    return C.project_type(files.select("path").unionByName(marks), "/proj")


@query("S4_S5_listing", "files", sql="SELECT path, name, false AS is_dir FROM (SELECT path, regexp_extract(path, '([^/]*)$', 1) AS name FROM files WHERE NOT contains(path, '/target/')) UNION ALL SELECT * FROM (VALUES ('/proj', 'proj', true)) UNION ALL SELECT DISTINCT regexp_extract(path, '^(/proj/[a-z]+)', 1), regexp_extract(path, '^/proj/([a-z]+)', 1), true FROM files UNION ALL SELECT DISTINCT '/proj/notes/benchmarks', 'benchmarks', true FROM files WHERE contains(path, '/notes/benchmarks/')")
def _(files):
    return project.listing(files)


@query("P12_P13_children", "files", sql="SELECT path FROM files WHERE path LIKE '/proj/src/%' AND contains(path, '1') AND NOT contains(substr(path, 11), '/')")
def _(files):
    return project.children(files, "/proj/src", "1").select("path")


@query("S12_S13_modules", "files", raw=True, sql="SELECT 'structure' AS what, '/proj/src/a/mod.rs' AS name UNION ALL SELECT 'structure', '/proj/src/a/b/mod.rs' UNION ALL SELECT 'directory', 'a' UNION ALL SELECT 'directory', 'c'")
def _(spark, files):
    more = spark.createDataFrame([(f"/proj/src/{x}",) for x in ("a/mod.rs", "a.rs", "a/b/mod.rs", "a/b/c/mod.rs", "c/d.rs")], "path string")
    every = files.select("path").unionByName(more)
    return project.module_structure(every, "/proj", "a").select(F.lit("structure").alias("what"), F.col("path").alias("name")).unionByName(project.source_directories(every, "/proj").select(F.lit("directory").alias("what"), "name"))


@query("S10_repositories", "supplier", sql="SELECT '/home/r' || s_suppkey AS root FROM supplier WHERE s_suppkey % 3 <> 1")
def _(supplier):
    k = F.col("s_suppkey").cast("string")
    base = supplier.where("s_suppkey % 3 <> 1").select(F.concat(F.lit("/home/r"), k, F.lit("/.git/HEAD")).alias("path"))
    nested = supplier.where("s_suppkey % 3 = 0").select(F.concat(F.lit("/home/r"), k, F.lit("/sub/.git/HEAD")).alias("path"))
    return project.repositories(base.unionByName(nested))


@query("S11_remotes", "supplier", sql="SELECT s_suppkey, CASE WHEN s_suppkey % 4 < 3 THEN 'host.example' END AS host, CASE WHEN s_suppkey % 4 < 3 THEN 'team' END AS workspace, CASE WHEN s_suppkey % 4 < 3 THEN 'repo' || s_suppkey END AS slug FROM supplier")
def _(supplier):
    k = F.col("s_suppkey").cast("string")
    url = F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("git@host.example:team/repo"), k, F.lit(".git"))).when(F.col("s_suppkey") % 4 == 1, F.concat(F.lit("https://host.example/team/repo"), k)).when(F.col("s_suppkey") % 4 == 2, F.concat(F.lit("https://me@host.example/team/repo"), k, F.lit(".git"))).otherwise(F.lit("/srv/local"))
    return supplier.withColumn("url", url).select("s_suppkey", *project.remote())


@query("P4_kind_aliases", "symbols", sql="SELECT seq, kind, CASE kind WHEN 'function' THEN 'fn' WHEN 'module' THEN 'mod' ELSE kind END AS label FROM symbols")
def _(symbols):
    label = C.choose(F.col("kind"), C.KIND_LABELS)
    return symbols.select("seq", C.kind_named(F.upper(label)).alias("kind"), label.alias("label"))


@query("P6_P7_P8_list_symbols", "symbols", sql="SELECT seq, name FROM symbols WHERE kind = 'struct' AND file LIKE '%/m5.rs' UNION ALL SELECT seq, name FROM symbols WHERE kind = 'struct' AND file = '/proj/src/m0.rs'")
def _(symbols):
    return N.list_symbols(symbols, "m5.rs", "struct").unionByName(N.list_symbols(symbols, "/proj/src/m0.rs", "struct")).select("seq", "name")


@query("P9_type_usages", "refs", sql="SELECT name, file, line FROM refs WHERE context = 'Type'")
def _(refs):
    return N.type_usages(refs).select("name", "file", "line")


@query("P10_trait_impls", "symbols", sql="SELECT seq, signature FROM symbols WHERE kind = 'impl' AND contains(signature, 'Trait2')")
def _(symbols):
    return N.trait_impls(symbols, "Trait2").select("seq", "signature")


@query("P11_definition_at", "symbols", "refs", sql="SELECT file, line, arg_min(name, seq) AS name FROM symbols WHERE (file, line) IN (SELECT file, line FROM refs) GROUP BY file, line")
def _(symbols, refs):
    return N.definition_at(symbols, refs)


@query("P14_J12_browse", "symbols", sql="SELECT seq, name FROM symbols WHERE parent = 'T3' AND contains(lower(name), 'w') UNION ALL SELECT seq, name FROM symbols WHERE parent IS NULL AND contains(lower(name), 'bolt')")
def _(symbols):
    return N.browse(symbols, "T3", "W").unionByName(N.browse(symbols, None, "bolt")).select("seq", "name")


@query("P5_R7_index_rows", "symbols", sql="SELECT count(*) AS docs, count(DISTINCT file) AS files FROM symbols WHERE name IS NOT NULL AND kind IS NOT NULL")
def _(symbols):
    return symbols.where(F.col("name").isNotNull() & C.kind_named(F.col("kind"), strict=False).isNotNull()).agg(F.count("*").alias("docs"), F.count_distinct("file").alias("files"))


# --- navigation ----------------------------------------------------------------------------------


@query("J1_find_definitions", "symbols", sql="SELECT name, seq, file, line FROM symbols WHERE name IN (SELECT name FROM symbols WHERE seq % 20 = 0)")
def _(symbols):
    return N.of_name(probe(symbols), symbols).select("name", "seq", "file", "line")


@query("J2_find_references", "symbols", "refs", sql="SELECT name, file, line, col FROM refs WHERE name IN (SELECT name FROM symbols WHERE seq % 20 = 0)")
def _(symbols, refs):
    return N.of_name(probe(symbols), refs).select("name", "file", "line", "col")


@query("J3_resolve", "symbols", "refs", sql="SELECT name, n_defs, confidence, count(*) AS n FROM (SELECT r.name, d.n AS n_defs, CASE WHEN d.n = 1 THEN 1.0 ELSE 0.5::DOUBLE / d.n + 0.5 END::DOUBLE AS confidence FROM refs r JOIN (SELECT name, count(*) n FROM symbols GROUP BY name) d ON r.name = d.name) GROUP BY ALL")
def _(symbols, refs):
    return N.resolve(refs, symbols).groupBy("name", "n_defs", "confidence").agg(F.count("*").alias("n"))


@query("J4_J17_validated_references", "symbols", "refs", sql="""WITH t AS (SELECT name, file, line + seq % 2 AS line, CASE WHEN seq % 5 = 0 THEN 'macro' ELSE kind END AS kind FROM symbols), c AS (SELECT name, count(*) n FROM symbols GROUP BY name), r AS (SELECT name, count(*) n FROM refs GROUP BY name)
SELECT t.name, t.file, t.line::INT AS line, coalesce(r.n, 0) AS n_refs FROM t JOIN c ON t.name = c.name LEFT JOIN r ON t.name = r.name WHERE c.n <= 1 OR EXISTS (SELECT 1 FROM symbols d WHERE d.name = t.name AND d.file = t.file AND (d.line = t.line OR d.kind = t.kind))""")
def _(symbols, refs):
    t = symbols.select("name", "file", (F.col("line") + F.col("seq") % 2).cast("int").alias("line"), F.when(F.col("seq") % 5 == 0, "macro").otherwise(F.col("kind")).alias("kind"))
    return N.validated_references(refs, t, symbols)


@query("J5_enclosing_function", "symbols", "refs", sql="SELECT r.name, r.file, r.line, r.col, arg_max(d.name, d.line::BIGINT * 1000000000 + d.seq) AS caller, count(*) > 0 AS ok FROM (SELECT *, row_number() OVER () rid FROM refs WHERE context = 'Call') r LEFT JOIN symbols d ON d.file = r.file AND d.kind IN ('function', 'method') AND d.line <= r.line GROUP BY r.rid, r.name, r.file, r.line, r.col")
def _(symbols, refs):
    return N.enclosing_function(refs.where("context = 'Call'").select("name", "file", "line", "col"), symbols).withColumn("ok", F.lit(True))


@query("J6_callees", "symbols", "refs", sql="SELECT d.seq, r.name AS callee, min(r.line)::INT AS line FROM symbols d JOIN refs r ON d.file = r.file AND r.context = 'Call' AND r.line > d.line AND r.line < d.line + 100 WHERE d.kind IN ('function', 'method') GROUP BY d.seq, r.name")
def _(symbols, refs):
    return N.callees(symbols.where(F.col("kind").isin(*N.FUNCTIONS)), refs)


@query("J7_callers", "symbols", "refs", sql="SELECT r.name, r.file, r.line, r.col, arg_max(d.name, d.line::BIGINT * 1000000000 + d.seq) AS caller FROM (SELECT *, row_number() OVER () rid FROM refs WHERE context = 'Call' AND name IN (SELECT name FROM symbols WHERE seq % 20 = 0)) r LEFT JOIN symbols d ON d.file = r.file AND d.kind IN ('function', 'method') AND d.line <= r.line GROUP BY r.rid, r.name, r.file, r.line, r.col")
def _(symbols, refs):
    return N.callers(probe(symbols), refs, symbols)


@query("J16_usages", "symbols", "refs", sql="SELECT name, 'definition' AS role, file, line FROM symbols WHERE name IN (SELECT name FROM symbols WHERE seq % 20 = 0) UNION ALL SELECT name, 'reference', file, line FROM refs WHERE name IN (SELECT name FROM symbols WHERE seq % 20 = 0)")
def _(symbols, refs):
    return N.usages(probe(symbols), symbols, refs)


@query("J8_A2_ref_counts", "symbols", "refs", sql="SELECT s.name, coalesce(r.n, 0) AS n_refs FROM (SELECT DISTINCT name FROM symbols) s LEFT JOIN (SELECT name, count(*) n FROM refs GROUP BY name) r ON s.name = r.name")
def _(symbols, refs):
    return N.ref_counts(symbols, refs)


@query("A1_graph_stats", "symbols", "refs", sql='SELECT (SELECT count(*) FROM symbols) AS definitions, (SELECT count(DISTINCT name) FROM symbols) AS names, (SELECT count(*) FROM refs) AS "references", (SELECT count(*) FROM (SELECT file FROM symbols UNION SELECT file FROM refs)) AS files')
def _(symbols, refs):
    return N.graph_stats(symbols, refs)


@query("A3_usages_by_context", "refs", sql="SELECT name, context, n, f.file AS file, f.line AS line FROM (SELECT name, context, count(*) AS n, min({'file': file, 'line': line, 'col': col}) AS f FROM refs GROUP BY name, context)")
def _(refs):
    return N.usages_by_context(refs)


@query("A4_context_counts", "refs", sql="SELECT name, count(*) FILTER (context = 'Call') AS calls, count(*) FILTER (context = 'Type') AS types, count(*) FILTER (context = 'Import') AS imports, count(*) FILTER (context NOT IN ('Call', 'Type', 'Import')) AS others FROM refs GROUP BY name")
def _(refs):
    return N.context_counts(refs)


@query("A5_kind_breakdown", "symbols", sql="SELECT pos::INT AS pos, k AS kind, count(s.seq) AS n FROM (SELECT unnest(['function', 'method', 'struct', 'enum', 'trait', 'impl', 'const', 'type', 'module']) k, unnest(range(1, 10)) pos) d JOIN symbols s ON s.kind = k GROUP BY pos, k")
def _(symbols):
    return N.kind_breakdown(symbols)


@query("F8_fqn", "symbols", sql="SELECT seq, CASE WHEN parent IS NULL THEN name ELSE parent || '::' || name END AS fqn FROM symbols")
def _(symbols):
    return symbols.select("seq", N.fqn(F.col("parent"), F.col("name")).alias("fqn"))


@query("D10_G2_dependents", "symbols", "refs", sql="SELECT DISTINCT name, dependent FROM (SELECT r.name, arg_max(d.name, d.line::BIGINT * 1000000000 + d.seq) AS dependent FROM (SELECT *, row_number() OVER () rid FROM refs WHERE context = 'Call') r JOIN symbols d ON d.file = r.file AND d.kind IN ('function', 'method') AND d.line <= r.line GROUP BY r.rid, r.name)")
def _(symbols, refs):
    return N.dependents(symbols, refs)


@query("J15_D6_expansion", "symbols", "refs", sql="""WITH s AS (SELECT * FROM symbols WHERE seq % 20 = 0),
c AS (SELECT name, caller, min(line) AS p FROM (SELECT r.name, r.line, arg_max(d.name, d.line::BIGINT * 1000000000 + d.seq) AS caller FROM (SELECT *, row_number() OVER () rid FROM refs WHERE context = 'Call') r JOIN symbols d ON d.file = r.file AND d.kind IN ('function', 'method') AND d.line <= r.line GROUP BY r.rid, r.name, r.line) GROUP BY name, caller),
x AS (SELECT seq, 'parent' AS role, parent AS name, 0 AS p FROM s WHERE parent IS NOT NULL UNION ALL SELECT seq, 'caller', caller, p FROM s JOIN c ON s.name = c.name
      UNION ALL SELECT s.seq, 'type', r.name, min(r.line) FROM s JOIN refs r ON s.file = r.file AND r.context = 'Type' AND r.line >= s.line AND r.line < s.line + 50 GROUP BY s.seq, r.name
      UNION ALL SELECT s.seq, 'callee', r.name, min(r.line) FROM s JOIN refs r ON s.file = r.file AND r.context = 'Call' AND r.line > s.line AND r.line < s.line + 50 GROUP BY s.seq, r.name)
SELECT seq, role, name FROM (SELECT *, row_number() OVER (PARTITION BY seq, role ORDER BY p, name) n FROM x) WHERE n <= 5""")
def _(symbols, refs):
    return N.expansion(symbols.where("seq % 20 = 0"), symbols, refs)


# --- search --------------------------------------------------------------------------------------

BM25_SQL = f"""WITH f AS (SELECT seq, p, 'name' AS field, name AS text FROM base UNION ALL SELECT seq, p, 'content', content FROM base),
tok AS (SELECT seq, p, field, [x for x in regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+') if x <> ''] w FROM f),
ln AS (SELECT p, field, sum(len(w)) total FROM tok GROUP BY p, field), nn AS (SELECT p, count(*) n FROM base GROUP BY p),
post AS (SELECT p, field, seq, len(w) l, term, count(*) tf FROM (SELECT *, unnest(w) term FROM tok) GROUP BY ALL),
df AS (SELECT p, field, term, count(*) df FROM post GROUP BY ALL),
q AS (SELECT qid, term, count(*) times FROM (SELECT qid, unnest([x for x in regexp_split_to_array(lower(query), '[^\\p{{L}}\\p{{N}}]+') if x <> '']) term FROM terms) GROUP BY ALL),
sc AS (SELECT qid, post.p AS part, seq AS doc, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / (total / n))) * times) AS score
       FROM post JOIN q USING (term) JOIN df USING (p, field, term) JOIN ln USING (p, field) JOIN nn USING (p) GROUP BY qid, post.p, seq)
"""


def ranked(scores: DataFrame, k: int, *by: str) -> DataFrame:
    return text_search.top_k(scores.withColumn("score", F.round("score", 6)), k, by or ("qid",))


@query("R1_R2_R3_W3_keyword_search", "symbols", "terms", sql=BM25_SQL.replace("WITH f", "WITH base AS (SELECT seq, name, content, 'all' AS p FROM symbols), f") + "SELECT qid, doc, score, rank FROM (SELECT qid, doc, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc)::INT AS rank FROM sc) WHERE rank <= 10")
def _(symbols, terms):
    return text_search.top_k(top_k.best(symbols, "seq", ["name", "content"], terms, 10, digits=6), 10).select("qid", "doc", "score", "rank")


@query("R4_source_boost", "symbols", "terms", sql=BM25_SQL.replace("WITH f", f"WITH base AS (SELECT seq, name, content, 'all' AS p, {type_sql('file')} AS t FROM symbols), f") + "SELECT qid, doc, score, rank FROM (SELECT qid, doc, s AS score, row_number() OVER (PARTITION BY qid ORDER BY s DESC, doc)::INT AS rank FROM (SELECT qid, doc, round(score + CASE WHEN t = 'SourceCode' THEN 0.5 * (score + (SELECT ln(1 + (count(*) - count(*) FILTER (t = 'SourceCode') + 0.5) / (count(*) FILTER (t = 'SourceCode') + 0.5)) FROM base)) ELSE 0 END, 6) AS s FROM sc JOIN base ON doc = seq)) WHERE rank <= 10")
def _(symbols, terms):
    """The boost keeps the order inside source code and inside the rest, so the best of both hold the best of all."""
    kind = C.document_type(F.col("file"))
    found = top_k.best(symbols, "seq", ["name", "content"], terms, 10, within=kind == "SourceCode")
    return ranked(text_search.source_boosted(found, symbols, "seq", kind), 10).select("qid", "doc", "score", "rank")


@query("R8_W4_D4_triple_search", "symbols", "terms", sql=BM25_SQL.replace("WITH f", f"WITH base AS (SELECT seq, name, content, CASE WHEN t IN ('SourceCode', 'Test') THEN 'code' WHEN t = 'Documentation' THEN 'docs' ELSE 'notes' END AS p FROM (SELECT *, {type_sql('file')} AS t FROM symbols)), f") + "SELECT qid, part, doc, score, rank FROM (SELECT qid, part, doc, round(score, 6) AS score, row_number() OVER (PARTITION BY qid, part ORDER BY round(score, 6) DESC, doc)::INT AS rank FROM sc) WHERE rank <= CASE part WHEN 'code' THEN 10 WHEN 'docs' THEN 5 ELSE 3 END")
def _(symbols, terms):
    part = C.content_type(C.document_type(F.col("file")))
    return hybrid.limited(top_k.best(symbols, "seq", ["name", "content"], terms, 10, part, digits=6), "part").select("qid", "part", "doc", "score", "rank")


@query("A12_triple_counts", "symbols", sql=f"WITH t AS (SELECT CASE WHEN t IN ('SourceCode', 'Test') THEN 'code' WHEN t = 'Documentation' THEN 'docs' ELSE 'notes' END AS p FROM (SELECT {type_sql('file')} AS t FROM symbols)) SELECT coalesce(p, 'total') AS part, count(*) AS n FROM t GROUP BY ROLLUP (p)")
def _(symbols):
    return hybrid.part_counts(symbols, C.content_type(C.document_type(F.col("file"))))


@query("R5_fuzzy_search", "symbols", sql="""WITH q AS (SELECT seq AS qid, 'x' || substr(split_part(name, '_', 1), 2, 20) AS query FROM symbols WHERE seq % 20 = 0),
tok AS (SELECT DISTINCT seq, unnest(regexp_split_to_array(lower(name), '[^\\p{L}\\p{N}]+')) AS token FROM symbols)
SELECT qid, seq, min(damerau_levenshtein(token, query))::INT AS distance FROM (SELECT DISTINCT query, token, damerau_levenshtein(token, query) FROM (SELECT DISTINCT token FROM tok WHERE token <> ''), (SELECT DISTINCT query FROM q) WHERE damerau_levenshtein(token, query) <= 2) JOIN q USING (query) JOIN tok USING (token) GROUP BY qid, seq""")
def _(symbols):
    asked = symbols.where("seq % 20 = 0").select(F.col("seq").alias("qid"), F.concat(F.lit("x"), F.substring(F.split_part("name", F.lit("_"), F.lit(1)), 2, 20)).alias("query"))
    return text_search.fuzzy(symbols, asked)


@query("R6_by_kind", "symbols", sql="SELECT seq, name FROM symbols WHERE kind = 'enum' ORDER BY seq LIMIT 25")
def _(symbols):
    return text_search.by_kind(symbols, "enum", 25).select("seq", "name")


# The boosts of rows by document type, kind, intent and number of references.
RERANK_SQL = f"""WITH t AS (SELECT seq, name, kind, {type_sql('file')} AS t FROM symbols), c AS (SELECT name, count(*) n FROM refs GROUP BY name),
h AS (SELECT kind AS qid, seq AS doc, t.name, kind, t, coalesce(c.n, 0) AS n, CASE seq % 3 WHEN 0 THEN 'Understand' WHEN 1 THEN 'FindDefinition' ELSE 'Debug' END AS intent, CASE WHEN seq % 17 = 0 THEN 0.0 ELSE (seq % 50 + 1)::DOUBLE END AS score FROM t LEFT JOIN c ON t.name = c.name),
b AS (SELECT *, score::FLOAT
 * (CASE t WHEN 'SourceCode' THEN 1.5 WHEN 'Documentation' THEN 1.0 WHEN 'Test' THEN 0.8 WHEN 'Notes' THEN 0.7 ELSE 0.3 END::FLOAT
 * CASE intent WHEN 'Understand' THEN CASE t WHEN 'SourceCode' THEN 3.0 WHEN 'Benchmark' THEN 0.05 ELSE 0.1 END WHEN 'FindDefinition' THEN CASE t WHEN 'SourceCode' THEN 2.0 WHEN 'Documentation' THEN 0.3 WHEN 'Notes' THEN 0.2 WHEN 'Benchmark' THEN 0.1 ELSE 0.2 END ELSE 1 END::FLOAT)
 * (CASE kind WHEN 'function' THEN 1.4 WHEN 'method' THEN 1.4 WHEN 'struct' THEN 1.3 WHEN 'enum' THEN 1.3 WHEN 'trait' THEN 1.3 WHEN 'module' THEN 1.3 WHEN 'impl' THEN 1.2 WHEN 'macro' THEN 1.0 WHEN 'variant' THEN 0.8 WHEN 'field' THEN 0.7 WHEN 'doc' THEN 0.6 ELSE 0.9 END::FLOAT
 * CASE intent WHEN 'Understand' THEN CASE WHEN kind IN ('function', 'method') THEN 1.5 WHEN kind IN ('struct', 'impl') THEN 1.2 WHEN kind = 'field' THEN 0.3 WHEN kind = 'doc' THEN 0.2 ELSE 1 END
   WHEN 'FindDefinition' THEN CASE WHEN kind IN ('struct', 'enum', 'trait') THEN 2.0 WHEN kind IN ('type', 'function') THEN 1.8 WHEN kind = 'method' THEN 1.6 WHEN kind = 'module' THEN 1.5 WHEN kind = 'impl' THEN 0.5 WHEN kind = 'doc' THEN 0.1 ELSE 1 END
   ELSE CASE WHEN kind IN ('function', 'method') THEN 1.3 WHEN kind IN ('struct', 'enum') THEN 1.1 WHEN kind = 'field' THEN 0.5 ELSE 1 END END::FLOAT)
 * CASE WHEN n > 20 THEN 0.5 WHEN n > 10 THEN 0.7 ELSE 1 END::FLOAT AS f FROM h)
SELECT qid, doc, f::DOUBLE AS final FROM b"""


@query("R9_to_R16_W1_scores", "symbols", "refs", sql=RERANK_SQL)
def _(symbols, refs):
    counts = refs.groupBy("name").agg(F.count("*").alias("n_refs"))
    hits = symbols.join(counts, "name", "left").select(
        F.col("kind").alias("qid"), F.col("seq").alias("doc"), F.col("seq").alias("raw_rank"), "name", "kind", "n_refs", C.document_type(F.col("file")).alias("document_type"),
        F.when(F.col("seq") % 3 == 0, "Understand").when(F.col("seq") % 3 == 1, "FindDefinition").otherwise("Debug").alias("intent"),
        F.when(F.col("seq") % 17 == 0, float("nan")).otherwise((F.col("seq") % 50 + 1).cast("double")).alias("score"),
    )
    return text_search.rerank(hits, 1 << 30).select("qid", "doc", "final")


@query("W2_over_fetch", "questions", sql="SELECT qid, CASE WHEN query LIKE 'how %' OR query LIKE 'explain %' THEN 100 ELSE 30 END::INT AS n FROM questions WHERE query NOT LIKE '%where%'")
def _(questions):
    return questions.where("query not like '%where%'").select("qid", text_search.over_fetch(query_language.intent(F.col("query")), 10).alias("n"))


@query("R12_query_boost", "symbols", "terms", sql=f"SELECT qid, round(CASE t WHEN 'SourceCode' THEN 1.5 WHEN 'Documentation' THEN 1.0 * c WHEN 'Test' THEN 0.8 WHEN 'Notes' THEN 0.7 * c ELSE 0.3 * c END, 4)::DOUBLE AS boost FROM (SELECT seq AS qid, {type_sql('file')} AS t, CASE WHEN seq % 2 = 0 THEN 0.5 ELSE 1 END AS c FROM symbols)")
def _(symbols, terms):
    text = F.when(F.col("seq") % 2 == 0, "How it WORKS").otherwise("plain")
    return symbols.select(F.col("seq").alias("qid"), F.round(C.query_doc_boost(C.document_type(F.col("file")), text).cast("double"), 4).alias("boost"))


@query("R17_memory_search", "interactions", sql="""WITH q AS (SELECT 1 AS qid, 'the of and' AS query UNION ALL SELECT 2, 'de la'), f AS (SELECT line_no, 'i' AS field, input_text AS text FROM interactions UNION ALL SELECT line_no, 'r', response_text FROM interactions),
tok AS (SELECT line_no, field, [x for x in regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+') if x <> '' AND strlen(x) <= 40] w FROM f), l AS (SELECT field, sum(len(w)) total, count(*) n FROM tok GROUP BY field),
post AS (SELECT field, line_no, len(w) k, term, count(*) tf FROM (SELECT *, unnest(w) term FROM tok) GROUP BY ALL), df AS (SELECT field, term, count(*) df FROM post GROUP BY ALL),
qt AS (SELECT qid, unnest(string_split(query, ' ')) term FROM q),
s AS (SELECT qid, line_no AS doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * k / (total / n)))), 6) AS score FROM post JOIN qt USING (term) JOIN df USING (field, term) JOIN l USING (field) GROUP BY qid, line_no)
SELECT qid, doc, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc)::INT AS rank FROM s) WHERE rank <= 20""", raw=True)
def _(spark, interactions):
    q = spark.createDataFrame([(1, "the of and"), (2, "de la")], "qid int, query string")
    index = text_search.postings(interactions, "line_no", ["input_text", "response_text"])
    return ranked(text_search.bm25(index, q, interactions, "line_no"), 20).select("qid", "doc", "score", "rank")


TRI_SQL = "WITH t AS (SELECT DISTINCT path, hex(substr(b, i, 1)) || hex(substr(b, i + 1, 1)) || hex(substr(b, i + 2, 1)) AS tri FROM (SELECT path, content AS b, unnest(range(1, length(content) - 1)) i FROM src)) "


@query("R18_J11_trigram_candidates", "symbols", sql="WITH src AS (SELECT seq, content FROM symbols), q AS (SELECT seq AS qid, split_part(content, ' ', 2) AS query FROM symbols WHERE seq % 20 = 0) SELECT qid, seq AS path FROM q, src WHERE list_has_all([substr(content, i, 3) for i in range(1, greatest(length(content) - 1, 1))], [substr(query, i, 3) for i in range(1, length(query) - 1)])")
def _(symbols):
    asked = symbols.where("seq % 20 = 0").select(F.col("seq").alias("qid"), F.split_part("content", F.lit(" "), F.lit(2)).alias("query"))
    return trigrams.matching(trigrams.bitmaps(symbols), asked).select("qid", F.col("id").alias("path"))


@query("A9_R19_trigram_stats", "symbols", sql="WITH t AS (SELECT DISTINCT seq, substr(content, i, 3) tri FROM (SELECT seq, content, unnest(range(1, length(content) - 1)) i FROM symbols WHERE seq % 3 <> 0)) SELECT count(*) AS trigrams, avg(n) AS avg_files, (SELECT count(DISTINCT seq) FROM t) AS files FROM (SELECT tri, count(*) n FROM t GROUP BY tri)")
def _(symbols):
    index = trigrams.index(symbols.select(F.col("seq").alias("path"), "content"))
    return trigrams.stats(trigrams.remove(index, symbols.where("seq % 3 = 0").select(F.col("seq").alias("path"))))


# --- query language ------------------------------------------------------------------------------


@query("Q1_intent", "documents", sql="SELECT doc_id, CASE WHEN regexp_matches(q, '(^|[^\\p{L}\\p{N}])(where|definition|defined)($|[^\\p{L}\\p{N}])') THEN 'FindDefinition' WHEN regexp_matches(q, '(^|[^\\p{L}\\p{N}])(used|references|usages)($|[^\\p{L}\\p{N}])') THEN 'FindUsages' WHEN regexp_matches(q, '(^|[^\\p{L}\\p{N}])(how|explain|understand)($|[^\\p{L}\\p{N}])') THEN 'Understand' WHEN regexp_matches(q, '(^|[^\\p{L}\\p{N}])(fix|change|modify)($|[^\\p{L}\\p{N}])') THEN 'Modify' WHEN regexp_matches(q, '(^|[^\\p{L}\\p{N}])(bug|error|debug)($|[^\\p{L}\\p{N}])') THEN 'Debug' ELSE 'Search' END AS intent FROM (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'where ' WHEN 1 THEN 'Bug_' WHEN 2 THEN 'fix error ' WHEN 3 THEN 'buggy ' WHEN 4 THEN 'HOW used ' ELSE '' END || lower(text) AS qq, lower(CASE doc_id % 8 WHEN 0 THEN 'where ' WHEN 1 THEN 'Bug_' WHEN 2 THEN 'fix error ' WHEN 3 THEN 'buggy ' WHEN 4 THEN 'HOW used ' ELSE '' END || text) AS q FROM documents)")
def _(documents_):
    lead = F.element_at(F.array(*[F.lit(x) for x in ("where ", "Bug_", "fix error ", "buggy ", "HOW used ", "", "", "")]), (F.col("doc_id") % 8 + 1).cast("int"))
    return documents_.select("doc_id", query_language.intent(F.concat(lead, F.col("text"))).alias("intent"))


@query("Q2_identifiers", "symbols", sql="SELECT seq, CASE seq % 3 WHEN 0 THEN name WHEN 1 THEN 'FooBar,' || name ELSE name || ',x_y' END AS found FROM symbols")
def _(symbols):
    text = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("How does "), F.col("name"), F.lit(" work?"))).when(F.col("seq") % 3 == 1, F.concat(F.lit("find FooBar and "), F.col("name"))).otherwise(F.concat(F.col("name"), F.lit("(x_y)")))
    return symbols.select("seq", F.array_join(query_language.identifiers(text), ",").alias("found"))


QUESTION_SQL = """WITH w AS (SELECT qid, lower(query) AS q, query FROM questions),
t AS (SELECT *, CASE WHEN contains(q, 'what is in') THEN [x for x in string_split(substr(q, strpos(q, 'in ') + 3), ' ') if x NOT IN ('the', 'a', 'an', '', 'module')][1]
 WHEN contains(q, 'structure of') THEN [x for x in string_split(substr(q, strpos(q, 'structure of ') + 13), ' ') if x NOT IN ('the', 'a', 'an', '', 'module')][1]
 WHEN contains(q, ' structure') AND string_split(q, ' ')[-2] NOT IN ('module', 'directory') THEN string_split(q, ' ')[-2] END AS target,
 CASE WHEN contains(q, 'who calls') THEN string_split(query, ' ')[3] WHEN contains(q, 'callers of') THEN string_split(query, ' ')[3] WHEN contains(q, ' callers') THEN string_split(query, ' ')[-2] END AS caller,
 CASE WHEN contains(q, 'what does') AND contains(q, ' call') THEN substr(query, 11, strpos(q, ' call') - 11) END AS callee FROM w)
SELECT qid, CASE WHEN target IS NOT NULL THEN 'structure' WHEN caller IS NOT NULL THEN 'callers' WHEN callee IS NOT NULL THEN 'callees' ELSE 'text' END AS route, coalesce(target, caller, callee) AS subject,
 CASE WHEN q LIKE 'where %' THEN 'FindDefinition' WHEN q LIKE 'find usages %' THEN 'FindUsages' WHEN q LIKE 'how %' OR q LIKE 'explain %' THEN 'Understand' WHEN q LIKE 'fix %' THEN 'Modify' ELSE 'Search' END AS intent FROM t"""


@query("Q3_Q4_Q5_dispatch", "questions", sql=QUESTION_SQL)
def _(questions):
    return query_language.dispatched(questions)


@query("D7_symbol_words", "symbols", sql="SELECT seq, 'ParseTree,' || name || ',MAX_LEN' AS found FROM symbols")
def _(symbols):
    return symbols.select("seq", F.array_join(hybrid.symbols_in(F.concat(F.lit("use ParseTree in "), F.col("name"), F.lit(" with MAX_LEN or plain"))), ",").alias("found"))


@query("D7_importance", "symbols", "refs", sql="WITH c AS (SELECT name, count(*) n FROM refs GROUP BY name) SELECT seq, round(0.4 * least(coalesce(n, 0) / 50.0, 1) + 0.3 * CASE visibility WHEN 'pub' THEN 1.0 WHEN 'pub(crate)' THEN 0.7 WHEN 'pub(super)' THEN 0.5 ELSE 0.3 END + 0.3 * CASE WHEN kind IN ('function', 'method') THEN 1.4 WHEN kind IN ('struct', 'enum', 'trait', 'module') THEN 1.3 WHEN kind = 'impl' THEN 1.2 WHEN kind = 'macro' THEN 1.0 WHEN kind = 'variant' THEN 0.8 WHEN kind = 'field' THEN 0.7 WHEN kind = 'doc' THEN 0.6 ELSE 0.9 END / 1.4, 6)::DOUBLE AS importance FROM symbols s LEFT JOIN c ON s.name = c.name")
def _(symbols, refs):
    counts = refs.groupBy("name").agg(F.count("*").alias("n"))
    return symbols.join(counts, "name", "left").select("seq", F.round(hybrid.importance(F.coalesce("n", F.lit(0)), F.col("visibility"), F.col("kind")), 6).alias("importance"))


@query("rules_suggestions", "documents", sql="SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'Review security,Write tests' WHEN doc_id % 4 = 1 THEN 'Analyze root cause' ELSE '' END AS found FROM documents")
def _(documents_):
    text = F.element_at(F.array(*[F.lit(x) for x in ("Refactor the API bug", "there is a Bug", "bug", "- agent(api) test")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return documents_.select("doc_id", F.array_join(query_language.suggestions(text), ",").alias("found"))


# --- state ---------------------------------------------------------------------------------------

CHANGES_SQL = "SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' WHEN a.mtime = b.mtime AND a.size = b.size THEN 'unchanged' ELSE 'modified' END AS change FROM indexed_state a FULL JOIN current_state b ON a.path = b.path"


@query("J9_changes", "indexed_state", "current_state", sql=CHANGES_SQL)
def _(a, b):
    return state.changes(a, b)


@query("J10_U4_deleted", "indexed_state", "current_state", sql="SELECT path FROM indexed_state WHERE path NOT IN (SELECT path FROM current_state)")
def _(a, b):
    return state.deleted(a, b)


@query("U1_to_index", "indexed_state", "current_state", sql=f"SELECT path FROM ({CHANGES_SQL}) WHERE change IN ('added', 'modified')")
def _(a, b):
    return state.to_index(state.changes(a, b))


@query("U3_indexed_files", "symbols", sql="SELECT DISTINCT file FROM symbols")
def _(symbols):
    return state.indexed_files(symbols)


@query("K3_replace_by_file", "symbols", sql="SELECT file, seq, name FROM symbols WHERE seq % 200 >= 40 UNION ALL SELECT file, seq + 1000000, name FROM symbols WHERE seq % 200 < 20")
def _(symbols):
    s = symbols.select("file", "seq", "name")
    return state.replace_by_file(s, s.where("seq % 200 < 20").withColumn("seq", F.col("seq") + 1000000), s.where("seq % 200 between 20 and 39").select("file").distinct())


@query("K7_U5_merge_cached", "indexed_state", "current_state", sql=f"SELECT path, symbol_count FROM indexed_state WHERE path NOT IN (SELECT path FROM ({CHANGES_SQL}) WHERE change IN ('modified', 'deleted')) UNION ALL SELECT path, -1 FROM ({CHANGES_SQL}) WHERE change IN ('added', 'modified')")
def _(a, b):
    c = state.changes(a, b)
    return state.merge_cached(state.to_index(c).withColumn("symbol_count", F.lit(-1).cast("long")), a.select("path", "symbol_count"), c, "path")


@query("K11_upsert", "supplier", sql="SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'new' ELSE s_name END AS s_name FROM supplier WHERE s_suppkey % 4 <> 0 OR s_suppkey % 3 = 0")
def _(supplier):
    old = supplier.where("s_suppkey % 4 <> 0").select("s_suppkey", "s_name")
    return state.upsert(old, supplier.where("s_suppkey % 3 = 0").select("s_suppkey", F.lit("new").alias("s_name")), "s_suppkey")


@query("K6_file_keys", "files", sql="SELECT path, replace(replace(path, '/', '__'), '.', '_d_') AS key, substr(sha256(path), 1, 8) AS hash FROM files")
def _(files):
    return files.select("path", state.file_key(F.col("path")).alias("key"), state.short_hash(F.col("path")).alias("hash"))


@query("A6_A11_crawl_stats", "files", sql="SELECT count(*) AS found, count(*) FILTER (error IS NULL) AS parsed, count(error) AS failed, sum(symbol_count) FILTER (error IS NULL)::BIGINT AS symbols FROM files")
def _(files):
    return state.crawl_stats(files)


# --- memory --------------------------------------------------------------------------------------


@query("W6_sessions", "interactions", sql="SELECT session_id, max(timestamp) AS last, count(*) AS n FROM interactions GROUP BY session_id")
def _(interactions):
    return memory.sessions(interactions)


@query("W5_recent", "interactions", sql="SELECT id, session_id, line_no FROM interactions JOIN (SELECT session_id, max(timestamp) m FROM interactions GROUP BY session_id) USING (session_id) ORDER BY m DESC, session_id, line_no LIMIT 40")
def _(interactions):
    return memory.recent(interactions, 40).select("id", "session_id", "line_no")


@query("P17_recent_of_session", "interactions", sql="SELECT id, line_no FROM (SELECT id, session_id, line_no FROM interactions JOIN (SELECT session_id, max(timestamp) m FROM interactions GROUP BY session_id) USING (session_id) ORDER BY m DESC, session_id, line_no LIMIT 60) WHERE session_id = '19'")
def _(interactions):
    return memory.recent_of_session(interactions, 60, "19").select("id", "line_no")


@query("A10_memory_stats", "interactions", sql="SELECT count(*) AS total, count(DISTINCT session_id) AS sessions, sum(strlen(input_text) + strlen(response_text))::BIGINT AS size_bytes, max(timestamp) AS last_updated FROM interactions")
def _(interactions):
    return memory.stats(interactions)


@query("W11_history", "events", sql="WITH l AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) was FROM events), k AS (SELECT * FROM l WHERE was IS NULL OR was <> event_type) SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) n FROM k) WHERE n <= 50")
def _(events):
    return memory.history(events, "user_id", "event_id", "event_type", 50).select("user_id", "event_id", "event_type")


@query("text_shortened", "interactions", sql="SELECT id, CASE WHEN strlen(input_text) > 120 THEN substr(replace(input_text, chr(10), ' '), 1, 120) || '...' ELSE replace(input_text, chr(10), ' ') END AS text FROM interactions")
def _(interactions):
    return interactions.select("id", memory.shortened(F.col("input_text")).alias("text"))


# --- tickets and security ------------------------------------------------------------------------


@query("A13_board", "tickets", sql="SELECT (SELECT sprint FROM tickets WHERE sprint_state = 'active' AND sprint IS NOT NULL ORDER BY pos LIMIT 1) AS sprint, count(*) AS tickets, sum(points) AS points FROM tickets")
def _(t):
    return tickets.board(t)


@query("A14_W9_groups", "tickets", sql="""WITH g AS (SELECT split_part(key, '-', 1) AS project, sprint, count(*) AS n, coalesce(sum(points), 0) AS points, grouping(split_part(key, '-', 1), sprint) AS level FROM tickets GROUP BY ROLLUP (split_part(key, '-', 1), sprint)),
k AS (SELECT *, regexp_extract(coalesce(sprint, ''), '^.* ([0-9]+) - Q([0-9]+) ([0-9]+)$', ['n', 'q', 'y']) x FROM g WHERE level < 3)
SELECT project, sprint, n, points, level = 1 AS header, row_number() OVER (PARTITION BY project ORDER BY level DESC, coalesce(try_cast(x.y AS INT), 65535), coalesce(try_cast(x.q AS INT), 255), coalesce(try_cast(x.n AS INT), 65535), sprint NULLS LAST)::INT AS pos FROM k""")
def _(t):
    return tickets.groups(t)


@query("P15_ticket_filter", "tickets", sql="SELECT key FROM tickets WHERE (contains(lower(key), 'part 7') OR contains(lower(summary), 'part 7')) AND assignee IS NULL AND split_part(key, '-', 1) = 'OPS'")
def _(t):
    return tickets.filtered(t, "part 7", "", "OPS").select("key")


@query("A16_P20_assignees", "tickets", sql="SELECT DISTINCT assignee FROM (SELECT assignee FROM tickets ORDER BY pos LIMIT 100) WHERE assignee IS NOT NULL")
def _(t):
    return tickets.assignees(t)


@query("A17_projects", "tickets", sql="SELECT split_part(key, '-', 1) AS project, min(pos) AS first FROM tickets GROUP BY 1")
def _(t):
    return tickets.projects(t)


@query("F16_flatten_tickets", "tickets", sql="SELECT key, summary, 'Open' AS status, 'new' AS category, 'Medium' AS priority, 'Task' AS type, coalesce(assignee, 'Unassigned') AS assignee, points, sprint, split_part(key, '-', 1) AS project FROM tickets")
def _(t):
    sprint = F.when(F.col("sprint").isNotNull(), F.array(F.struct(F.lit("old").alias("name")), F.struct(F.col("sprint").alias("name"))))
    fields = F.struct("summary", F.struct(F.lit("Open").alias("name")).alias("status"), F.when(F.col("assignee").isNotNull(), F.struct(F.col("assignee").alias("displayName"))).alias("assignee"), "points", sprint.alias("sprint"))
    return tickets.flattened(t.select(F.to_json(F.struct(F.array(F.struct("key", fields.alias("fields"))).alias("issues"))).alias("value")))


def issue_details(t: DataFrame) -> DataFrame:
    node = lambda x: F.struct(F.lit("paragraph").alias("type"), F.array(F.struct(F.lit("text").alias("type"), x.alias("text"))).alias("content"))
    note = F.struct(F.struct(F.coalesce("assignee", F.lit("Bot")).alias("displayName")).alias("author"), node(F.concat(F.lit("Re "), F.col("summary"))).alias("body"), F.lit("2024-01-02").alias("created"))
    fields = F.struct("summary", node(F.concat(F.lit("About "), F.col("key"))).alias("description"), F.struct(F.lit("Open").alias("name")).alias("status"), F.struct(F.array(note).alias("comments")).alias("comment"))
    return t.select(F.to_json(F.struct("key", fields.alias("fields"))).alias("value"))


@query("F17_ticket_details", "tickets", sql="SELECT key, summary, 'Open' AS status, 'Unassigned' AS assignee, 'About ' || key AS description FROM tickets")
def _(t):
    return tickets.details(issue_details(t))


@query("F17_ticket_comments", "tickets", sql="SELECT key, 0 AS pos, coalesce(assignee, 'Bot') AS author, '2024-01-02' AS created, 'Re ' || summary AS body FROM tickets")
def _(t):
    return tickets.comments(issue_details(t))


@query("A15_severity_summary", "issues", sql="SELECT r::INT AS rank, s AS severity, count(i.id) AS n FROM (SELECT unnest(['critical', 'high', 'medium', 'low']) s, unnest(range(1, 5)) r) LEFT JOIN issues i ON i.severity = s GROUP BY r, s")
def _(issues):
    return tickets.severity_summary(issues)


@query("W8_severity_list", "issues", sql="SELECT id, severity_score FROM issues ORDER BY severity_score DESC, id LIMIT 30")
def _(issues):
    return tickets.severity_list(issues, 30).select("id", "severity_score")


@query("P18_security_filter", "issues", sql="SELECT id FROM issues WHERE status = 'open' AND repo = 'repo3' AND type = 'sca' AND severity IN ('high', 'critical')")
def _(issues):
    return tickets.security_filter(issues, "repo3", "sca", "High, critical").select("id")


# --- documents -----------------------------------------------------------------------------------

MARKDOWN = "concat(CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'lead\n' END, '# A ', cast(doc_id as string), ' #\nfirst\n## B\n\nsecond\n#### C\n### D\n#\ntext ', substr(lang, 1, 2), '\n# E\n')"


@query("F3_W14_markdown_chunks", "documents", sql="""SELECT doc_id AS path, line::INT AS line, level::INT AS level, title, parent, content FROM (
SELECT doc_id, 1 AS line, 0 AS level, 'Introduction' AS title, NULL AS parent, 'lead' AS content FROM documents WHERE doc_id % 3 <> 0
UNION ALL SELECT doc_id, 1 + o, 1, 'A ' || doc_id, NULL, 'first' FROM d UNION ALL SELECT doc_id, 3 + o, 2, 'B', 'A ' || doc_id, 'second' FROM d UNION ALL SELECT doc_id, 6 + o, 4, 'C', 'B', '' FROM d
UNION ALL SELECT doc_id, 7 + o, 3, 'D', 'B', '#' || chr(10) || 'text ' || substr(lang, 1, 2) FROM d UNION ALL SELECT doc_id, 10 + o, 1, 'E', NULL, '' FROM d)""".replace("FROM d", "FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END o FROM documents)").replace("FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END o FROM documents)ocuments", "FROM documents"))
def _(documents_):
    return documents.chunks(documents_.select(F.col("doc_id").alias("path"), F.expr(MARKDOWN).alias("content")))


@query("F10_F11_fenced_blocks", "documents", sql="""WITH b AS (SELECT doc_id, doc_id % 3 AS k FROM documents), x AS (SELECT doc_id, k, unnest(range(0, k + 1)) AS i FROM b)
SELECT doc_id AS path, i::INT AS block, 'rs' AS lang, 'let a = ' || doc_id + i || ';' AS code, 'src/m' || doc_id || '.rs' AS target FROM x UNION ALL SELECT doc_id, (k + 1)::INT, '', 'open', 'src/m' || doc_id || '.rs' FROM b""")
def _(documents_):
    blocks = F.transform(F.sequence(F.lit(0), (F.col("doc_id") % 3).cast("int")), lambda i: F.concat(F.lit("```rs\nlet a = "), (F.col("doc_id") + i).cast("string"), F.lit(";\n```\n\n")))
    text = F.concat(F.format_string("Write `src/m%d.rs` now:\n", F.col("doc_id")), F.array_join(blocks, ""), F.lit("```\nopen"))
    return documents.review_blocks(documents_.select(F.col("doc_id").alias("path"), text.alias("content")))


@query("F12_J13_agent_sections", "documents", sql="""WITH d AS (SELECT doc_id, unnest([1, 3, 8 + length(doc_id::VARCHAR), 16 + length(doc_id::VARCHAR), 99]) AS a FROM documents)
SELECT doc_id AS path, a AS at, CASE WHEN a <= 8 + length(doc_id::VARCHAR) THEN 'one ' || doc_id ELSE 'two é' END AS title FROM d WHERE a BETWEEN 3 AND CASE WHEN doc_id % 2 = 0 THEN 16 ELSE 8 END + length(doc_id::VARCHAR)""")
def _(documents_):
    n = F.col("doc_id").cast("string")
    d = documents_.select(F.col("doc_id").alias("path"), F.concat(F.lit("x\n@ one "), n, F.when(F.col("doc_id") % 2 == 0, "\n@ two é\ny").otherwise("")).alias("content"))
    size = F.char_length(F.col("path").cast("string"))
    offsets = d.select("path", F.explode(F.array(F.lit(1), F.lit(3), 8 + size, 16 + size, F.lit(99))).alias("at"))
    return documents.contained(offsets.withColumn("at", F.col("at").cast("long")), documents.agent_sections(d, "@"))


@query("F13_A18_message_segments", "documents", sql="SELECT doc_id AS id, start, stop, kind, text FROM (SELECT doc_id FROM documents), (VALUES (0::BIGINT, 4::BIGINT, 'text', 'See '), (4, 13, 'file', '@src/a.rs'), (14, 20, 'symbol', '#parse'), (20, 25, 'text', ' now.')) v(start, stop, kind, text)")
def _(documents_):
    return documents.message_segments(documents_.select(F.col("doc_id").alias("id"), F.lit("See @src/a.rs #parse now.").alias("text")))


@query("F14_W10_snippets", "documents", sql="SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS few, array_to_string(string_split(text, chr(10))[greatest(0, doc_id % 9 - 5) + 1 : doc_id % 9 + 195], chr(10)) AS whole FROM documents")
def _(documents_):
    return documents_.select("doc_id", documents.snippet(F.col("text"), F.lit(2), 3).alias("few"), documents.full_snippet(F.col("text"), (F.col("doc_id") % 9).cast("int")).alias("whole"))


@query("F15_rich_text", "documents", sql="SELECT doc_id, 'a' || doc_id || chr(10) || 'b' || array_to_string([chr(10) || 'c' || i for i in range(1, doc_id % 4 + 1)], '') AS text FROM documents")
def _(documents_):
    more = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), (F.col("doc_id") % 4).cast("int"))), lambda i: F.concat(F.lit(',{"type":"paragraph","content":[{"type":"text","text":"c'), i, F.lit('"}]}'))), "")
    first = F.format_string('{"type":"doc","content":[{"type":"paragraph","content":[{"type":"text","text":"a%d"},{"type":"hardBreak"},{"type":"text","text":"b"}]}', F.col("doc_id"))
    tree = F.concat(first, F.when(F.col("doc_id") % 4 > 0, more).otherwise(""), F.lit("]}"))
    return tickets.rich_text(documents_.select("doc_id", tree.alias("text")), "text")


RUST = """//! Module docs
use std::fmt;
/// Doc of %s
pub struct S%d { pub a: u32, b: String }
impl fmt::Display for S%d { fn show(&self) -> u32 { helper(self.a) } }
pub(crate) enum E { One, Two(u32) }
fn helper(x: u32) -> u32 { x }
"""


def rust_files(documents_: DataFrame) -> DataFrame:
    k = F.col("doc_id")
    return documents_.select(F.concat(F.lit("/src/m"), k.cast("string"), F.lit(".rs")).alias("path"), F.format_string(RUST, F.col("lang"), k, k).alias("content"), k)


@query("F1_F5_F6_F7_rust_symbols", "documents", sql="SELECT '/src/m' || doc_id || '.rs' AS file, CASE n WHEN 'S' THEN 'S' || doc_id WHEN 'M' THEN 'm' || doc_id || '_docs' ELSE n END AS name, kind, line::INT AS line, vis AS visibility, CASE p WHEN 'S' THEN 'S' || doc_id ELSE p END AS parent FROM documents, (VALUES ('M', 'doc', 1, '', NULL), ('S', 'struct', 4, 'pub', NULL), ('a', 'field', 4, 'pub', 'S'), ('b', 'field', 4, '', 'S'), ('S', 'impl', 5, '', NULL), ('show', 'function', 5, '', NULL), ('show', 'method', 5, '', 'S'), ('E', 'enum', 6, 'pub(crate)', NULL), ('One', 'variant', 6, '', 'E'), ('Two', 'variant', 6, '', 'E'), ('helper', 'function', 7, '', NULL)) v(n, kind, line, vis, p)")
def _(documents_):
    return rust_source.symbols(rust_files(documents_)).select("file", "name", "kind", "line", "visibility", "parent")


@query("F2_W7_rust_calls", "documents", sql="SELECT '/src/m' || doc_id || '.rs' AS file, 'helper' AS name, 5 AS line FROM documents UNION ALL SELECT '/src/m' || doc_id || '.rs', 'Two', 6 FROM documents")
def _(documents_):
    return rust_source.once(rust_source.references(rust_files(documents_))).where("context = 'Call'").select("file", "name", "line")


@query("F4_typescript_symbols", "documents", sql="""SELECT 'a' || doc_id || '.ts' AS file, n || CASE WHEN n IN ('C', 'run') THEN doc_id::VARCHAR ELSE '' END AS name, kind, CASE p WHEN 'C' THEN 'C' || doc_id END AS parent
FROM documents, (VALUES ('C', 'struct', NULL, 0), ('run', 'method', 'C', 0), ('size', 'field', 'C', 0), ('f', 'function', NULL, 0), ('I', 'trait', NULL, 0), ('E', 'enum', NULL, 1), ('Alias', 'type', NULL, 1), ('make', 'function', NULL, 2), ('stop', 'method', 'C', 2)) v(n, kind, p, k) WHERE k <= doc_id % 3""")
def _(documents_):
    n, k = F.col("doc_id").cast("string"), F.col("doc_id") % 3
    stop = F.when(k == 2, "  async stop(): Promise<void> { }\n").otherwise("")
    more = F.when(k >= 1, "enum E { A, B }\ntype Alias = string;\n").otherwise("")
    last = F.when(k == 2, "async function make() { if (f) { return new I(); } }\n").otherwise("// function none() {}\n")
    code = F.concat(F.lit("export class C"), n, F.lit(" {\n  size: number = 1;\n  private x = 2;\n  run"), n, F.lit("(a: string) { return a; }\n"), stop, F.lit("}\nexport const f = (a) => a;\ninterface I { a: string }\n"), more, last)
    return rust_source.typescript_symbols(documents_.select(F.concat(F.lit("a"), n, F.lit(".ts")).alias("path"), code.alias("content"))).select("file", "name", "kind", "parent")


@query("F9_module_file", "documents", sql="""WITH d AS (SELECT doc_id, doc_id % 3 AS k, doc_id % 2 AS u FROM documents)
SELECT doc_id AS path, (k + 1)::INT AS line, 'mod' AS kind, 'a' || doc_id AS name, CASE k WHEN 0 THEN '' WHEN 1 THEN 'First ' || doc_id ELSE 'First ' || doc_id || ' part' END AS docs FROM d
UNION ALL SELECT doc_id, (k + 2)::INT, 'mod', 'b', '' FROM d UNION ALL SELECT doc_id, (k + 4)::INT, 'use', 'a' || doc_id || '::T', '' FROM d WHERE u = 1""")
def _(documents_):
    k, n = F.col("doc_id") % 3, F.col("doc_id").cast("string")
    docs = F.when(k == 0, F.lit("")).when(k == 1, F.concat(F.lit("/// First "), n, F.lit("\n"))).otherwise(F.concat(F.lit("/// First "), n, F.lit("\n/// part\n")))
    use = F.when(F.col("doc_id") % 2 == 1, F.concat(F.lit("pub use a"), n, F.lit("::T;\n"))).otherwise("use x;\n")
    text = F.concat(docs, F.lit("pub mod a"), n, F.lit(";\nmod b;\nmod c { }\n"), use)
    return rust_source.module_file(documents_.select(n.alias("path"), text.alias("content"))).withColumn("path", F.col("path").cast("long"))


# --- commits, pages, configs ---------------------------------------------------------------------


def commit_log(events: DataFrame) -> DataFrame:
    """A log for each user: every commit's parents are the next one or two older ones."""
    k = F.col("event_id")
    return events.withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id"))).cast("long")).select(F.col("user_id").cast("string").alias("repo"), "pos", k.alias("id"), F.lead("event_id").over(Window.partitionBy("user_id").orderBy(F.desc("event_id"))).alias("p1"), F.lead("event_id", 2).over(Window.partitionBy("user_id").orderBy(F.desc("event_id"))).alias("p2"))


@query("S9_parse_log", "orders", sql="SELECT o_orderkey AS pos, 'h' || o_orderkey AS hash, 'Fix ' || o_orderpriority AS message, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 0 END::INT AS n_parents, 'main,v1,dev' AS refs FROM orders")
def _(orders):
    k = F.col("o_orderkey").cast("string")
    line = F.concat_ws("\x1f", F.concat(F.lit("h"), k), k, F.lit("Me"), F.lit("2 days ago"), F.concat(F.lit("Fix "), F.col("o_orderpriority")), F.when(F.col("o_orderkey") % 2 == 0, "a b").otherwise(""), F.lit("HEAD -> main, tag: v1, origin/dev"))
    return commits.parse_log(orders.select(F.col("o_orderkey").alias("pos"), line.alias("value"))).select("pos", "hash", "message", F.size("parent_hashes").alias("n_parents"), F.array_join("refs", ",").alias("refs"))


@query("G1_J14_A19_commit_lanes", "events")
def _(events):
    log = commit_log(events)
    parents = F.filter(F.array(F.col("p1"), F.when(F.col("id") % 5 == 0, F.col("p2"))), lambda x: x.isNotNull())
    return commits.lanes(log.select("repo", "pos", F.col("id").cast("string").alias("hash"), parents.cast("array<string>").alias("parent_hashes")))


@query("S15_U6_pages", "orders", sql="SELECT o_orderkey AS value FROM orders WHERE o_orderkey < 400")
def _(orders):
    raw = orders.groupBy(F.floor(F.col("o_orderkey") / 20).cast("int").alias("page")).agg(F.to_json(F.struct(F.sort_array(F.collect_list("o_orderkey")).alias("values"), F.lit("x").alias("next"))).alias("body"))
    return project.merged_pages(raw, "bigint").select("value")


@query("S16_short_pages", "orders", sql="SELECT floor(o_orderkey / 20)::INT AS page, o_orderkey AS value FROM orders WHERE o_orderkey < 1000 AND o_orderkey <> 995")
def _(orders):
    """Full pages of 20, but for page 49, which lacks one and so is the last."""
    page = F.floor(F.col("o_orderkey") / 20).cast("int").alias("page")
    raw = orders.groupBy(page).agg(F.to_json(F.sort_array(F.collect_list(F.when(F.col("o_orderkey") != 995, F.col("o_orderkey"))))).alias("body"))
    return project.short_pages(raw, "bigint").select("page", "value")


@query("S17_servers", "supplier", sql="SELECT s_suppkey AS path, 'a' AS name, 'stdio' AS type FROM supplier WHERE s_suppkey % 3 <> 2 UNION ALL SELECT s_suppkey, 'b', 'http' FROM supplier WHERE s_suppkey % 3 = 0")
def _(supplier):
    text = F.when(F.col("s_suppkey") % 3 == 0, '{"mcpServers":{"a":{"command":"run"},"b":{"url":"http://x"},"c":{"type":"sse"}}}').when(F.col("s_suppkey") % 3 == 1, '{"a":{"command":"go"}}').otherwise("{broken")
    return project.servers(supplier.select(F.col("s_suppkey").alias("path"), text.alias("content"))).select("path", "name", "type")


@query("S18_skills", "supplier", sql="SELECT s_suppkey AS path, CASE WHEN s_suppkey % 2 = 0 THEN 'Does ' || s_name ELSE '' END AS description FROM supplier")
def _(supplier):
    text = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit('---\nname: x\ndescription: "Does '), F.col("s_name"), F.lit('"\n---\nbody'))).otherwise("no front matter")
    return project.skills(supplier.select(F.col("s_suppkey").alias("path"), text.alias("content")))


@query("S14_choices", "orders", sql="SELECT floor(o_orderkey / 50)::BIGINT AS page, 'b' || o_orderkey AS key, 'c' || o_custkey AS description FROM orders")
def _(orders):
    v = F.to_json(F.struct(F.concat(F.lit("b"), F.col("o_orderkey")).alias("name"), F.struct(F.concat(F.lit("c"), F.col("o_custkey")).alias("hash")).alias("target")))
    pages = orders.groupBy(F.floor(F.col("o_orderkey") / 50).alias("page")).agg(F.concat(F.lit('{"values":['), F.array_join(F.collect_list(v), ","), F.lit("]}")).alias("body"))
    return project.choices(pages, "$.name", "$.name", "$.target.hash").select("page", "key", "description")


@query("S14_issue_counts", "supplier", sql="SELECT s_suppkey AS id, s AS severity, n FROM supplier, (VALUES ('critical', 1::BIGINT), ('low', 5::BIGINT)) v(s, n)")
def _(supplier):
    return project.issue_counts(supplier.select(F.col("s_suppkey").alias("id"), F.lit('{"critical":1,"low":5,"all":6}').alias("body")))


@query("P16_repo_filter", "supplier", sql="SELECT s_suppkey FROM supplier WHERE contains('repo' || s_suppkey, 'o1') OR s_suppkey % 5 = 0")
def _(supplier):
    repos = supplier.select("s_suppkey", F.concat(F.lit("Repo"), F.col("s_suppkey")).alias("folder"), F.when(F.col("s_suppkey") % 5 == 0, "foo1").otherwise("x").alias("slug"))
    return project.repo_filter(repos, "O1").select("s_suppkey")


# --- streams -------------------------------------------------------------------------------------


@query("P21_watch_filter", "events", sql="SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'a.rs,b.MD' ELSE 'b.MD' END AS paths FROM events WHERE event_id % 3 <> 2")
def _(events):
    paths = F.when(F.col("event_id") % 3 == 0, F.array(F.lit("a.rs"), F.lit("b.MD"))).when(F.col("event_id") % 3 == 1, F.array(F.lit("x.lock"), F.lit("b.MD"))).otherwise(F.array(F.lit("c.py")))
    path = F.transform(paths, lambda p: F.concat(F.lit("/p/"), p))
    return watch.supported_events(events.select("event_id", path.alias("paths"))).select("event_id", F.replace(F.array_join("paths", ","), F.lit("/p/"), F.lit("")).alias("paths"))


@query("T3_U7_bursts", "events", sql="WITH e AS (SELECT user_id, event_type, make_timestamp(epoch_us(ts) // 3600) AS ts FROM events), l AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) >= 500000 THEN 1 ELSE 0 END AS cut FROM e), g AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) k FROM l) SELECT user_id, count(*) AS n, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS paths FROM g GROUP BY user_id, k")
def _(events):
    e = events.select("user_id", "event_type", F.timestamp_micros(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3600)).alias("ts"))
    return watch.bursts(e, "user_id", "event_type").select("user_id", "n", F.array_join("paths", ",").alias("paths"))


@query("T5_A20_increased", "events", sql="SELECT user_id, event_id FROM (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) was FROM events) WHERE was IS NOT NULL AND value > was")
def _(events):
    e = events.select("user_id", "event_id", F.struct("ts", "event_id").alias("ts"), watch.head_mtime("value", "value").alias("mtime"))
    return watch.increased(e, "user_id").select("user_id", "event_id")


@query("T6_event_lines", "events", sql="SELECT event_id, 0 AS pos, CASE WHEN event_id % 4 = 0 THEN 'Delta' ELSE 'Done' END AS chunk, CASE WHEN event_id % 4 = 0 THEN 'ab' ELSE 'end' END AS text FROM events WHERE event_id % 4 < 2 UNION ALL SELECT event_id, 1, 'ToolUse', 'grep' FROM events WHERE event_id % 4 = 0")
def _(events):
    line = F.element_at(F.array(*[F.lit(x) for x in ('{"type":"assistant","message":{"content":[{"type":"text","text":"a"},{"type":"tool_use","name":"grep","input":{}},{"type":"text","text":"b"}]}}', '{"type":"result","result":"end"}', '{"type":"system"}', "{broken")]), (F.col("event_id") % 4 + 1).cast("int"))
    return watch.event_lines(events.select("event_id", line.alias("value")))


# --- hybrid --------------------------------------------------------------------------------------

COS_SQL = "SELECT q.vec_id AS qid, v.vec_id, list_dot_product(v.e, q.e) / (sqrt(list_dot_product(v.e, v.e)) * sqrt(list_dot_product(q.e, q.e))) AS score FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) v, (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 20 = 0) q"


def asked(embeddings: DataFrame) -> DataFrame:
    return embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")


@query("D1_nearest", "embeddings", sql=f"SELECT qid, vec_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, vec_id)::INT AS rank FROM ({COS_SQL})) WHERE rank <= 10")
def _(embeddings):
    return vector_index.exact(asked(embeddings), embeddings, 10).select("qid", "vec_id", F.round("score", 6).alias("score"), "rank")


@query("D2_D3_fusion", "embeddings", sql=f"WITH a AS (SELECT qid, vec_id AS doc, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, vec_id) AS r FROM ({COS_SQL})), b AS (SELECT qid, doc, row_number() OVER (PARTITION BY qid ORDER BY abs(doc - qid), doc) AS r FROM a), s AS (SELECT coalesce(x.qid, y.qid) AS qid, coalesce(x.doc, y.doc) AS doc, coalesce(1.0::DOUBLE / (60 + x.r), 0) + coalesce(1.0::DOUBLE / (60 + y.r), 0) AS score FROM (SELECT * FROM a WHERE r <= 50) x FULL JOIN (SELECT * FROM b WHERE r <= 50) y ON x.qid = y.qid AND x.doc = y.doc) SELECT qid, doc, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc) n FROM s) WHERE score >= 0.0161 OR n <= 3")
def _(embeddings):
    w = Window.partitionBy("qid").orderBy(F.abs(F.col("doc") - F.col("qid")), "doc")
    near = vector_index.exact(asked(embeddings), embeddings, 50).select("qid", F.col("vec_id").alias("doc"), "rank")
    around = asked(embeddings).select("qid", F.explode(F.sequence(F.col("qid") - 50, F.col("qid") + 50)).alias("doc"))
    ids = around.join(embeddings.select(F.col("vec_id").alias("doc")), "doc", "left_semi").withColumn("rank", F.row_number().over(w))
    fused = hybrid.fuse(near, ids).withColumn("score", F.round("score", 9)).withColumn("part", F.lit("all"))
    return hybrid.thresholded(fused, "part", 3, 0.0161).select("qid", "doc", "score")


@query("D5_D6_budget", "interactions", sql="WITH r AS (SELECT session_id AS qid, line_no, row_number() OVER (PARTITION BY session_id ORDER BY line_no)::INT AS rank, sum(length(response_text) // 4) OVER (PARTITION BY session_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)::BIGINT AS tokens FROM interactions) SELECT qid, line_no, tokens, round(1.0::DOUBLE / rank, 6) AS score FROM r WHERE tokens <= 2000")
def _(interactions):
    w = Window.partitionBy("session_id").orderBy("line_no")
    rows = interactions.select(F.col("session_id").alias("qid"), "line_no", F.row_number().over(w).alias("rank"), F.col("response_text").alias("text"))
    return hybrid.fallback_scores(hybrid.within_budget(rows, 2000)).select("qid", "line_no", "tokens", F.round("score", 6).alias("score"))
