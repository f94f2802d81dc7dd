"""Sources: project trees, JSON lines, logs, captured REST pages, config and skill files."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoutline.operators.commits import SEPARATOR, parse_log

MOST_BYTES = 1 << 20
# Files of ignore rules, the later one of a folder deciding.
IGNORE_FILES = (".gitignore", ".ignore")
PAGES = 20
INTERACTION = (
    "id string, timestamp long, session_id string, input struct<text:string,command:string,files:array<string>>, "
    "response struct<type:string,text:string,changes:array<struct<file:string,action:string,diff:string>>>"
)
# Folders that listings don't enter.
SKIPPED_DIRS = ("node_modules", "target", "dist", "build", "vendor", "__pycache__")
SERVER = "map<string,struct<type:string,command:string,args:array<string>,url:string,env:map<string,string>>>"


def read_files(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """(path, size, mtime, content) of all files under root, hidden ones left out; content is read only if it is used."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace("path", r"^file:/+", "/")
    out = raw.select(path.alias("path"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"), *[F.decode("content", "UTF-8").alias("content")] * content)
    return out.where(~F.col("path").rlike(r"/\.[^/]+"))


def read_ignores(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of the ignore files under root, with paths below it. Spark's file sources pass over hidden files, so the
    driver looks through the listing; what it keeps is bounded by the folders of one project."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    base, rows = fs.makeQualified(path).toUri().getPath().rstrip("/"), []
    files = fs.listFiles(path, True)
    while files.hasNext():
        at = files.next().getPath()
        if at.getName() in IGNORE_FILES:
            stream = fs.open(at)
            rows.append((at.toUri().getPath().removeprefix(base), jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            stream.close()
    return spark.createDataFrame(rows, "path string, content string")


def discover(files: DataFrame, ignored: list[str] | None = None) -> DataFrame:
    """Files to index: Rust, markdown and text by lower-case extension, 1 MiB or less (an unknown size is kept), hidden and ignored paths left out."""
    out = files.where(F.lower("path").rlike(r"[^/]\.(rs|md|txt)$") & (F.col("size").isNull() | (F.col("size") <= MOST_BYTES)) & ~F.col("path").rlike(r"/\."))
    for pattern in ignored or []:
        out = out.where(~F.col("path").rlike(pattern))
    return out


def ignore_rules(files: DataFrame, names: tuple[str, ...] = IGNORE_FILES) -> DataFrame:
    """(folder, pos, keep, pattern) of the lines of ignore files (path, content): a regular expression on paths below the folder.

    A pattern with a slash before its end is tied to the folder, others match at any depth; * stays within a name, ** does not;
    a trailing slash asks for a folder; ! takes back. Character classes are taken as they are.
    """
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    lines = files.where(name.isin(*names)).select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), name.alias("name"), F.posexplode(F.split("content", r"\r?\n")).alias("line", "text"))
    text = F.rtrim("text")
    rules = lines.select("folder", "name", "line", text.alias("t")).where("t <> '' and not startswith(t, '#')")
    keep, bare = F.col("t").startswith("!"), F.regexp_replace("t", "^!", "")
    rules = rules.select("folder", (F.array_position(F.array(*[F.lit(n) for n in names]), F.col("name")) * 1_000_000 + F.col("line")).alias("pos"), keep.alias("keep"), bare.alias("p"))
    core = F.regexp_replace("p", "^/|/$", "")
    escaped = F.regexp_replace(core, r"([.+^$(){}|\\])", r"\\$1")
    glob = escaped
    for pattern, becomes in ((r"^\*\*/", "\u0001"), (r"/\*\*/", "\u0002"), (r"/\*\*$", "\u0003"), (r"\*+", "[^/]*"), (r"\?", "[^/]"), ("\u0001", "(?:.*/)?"), ("\u0002", "/(?:.*/)?"), ("\u0003", "/.*")):
        glob = F.regexp_replace(glob, pattern, becomes)
    tied = F.col("p").rlike(r"^/|/.")
    return rules.select("folder", "pos", "keep", F.concat(F.when(tied, "^").otherwise("^(?:.*/)?"), glob, F.when(F.col("p").endswith("/"), "/.*$").otherwise("(?:/.*)?$")).alias("pattern"))


def not_ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """files without those that the last matching rule of the deepest folder leaves out; rules are those of one project, and joined by folder."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    met = files.select("path", F.explode(above).alias("folder")).join(rules, "folder").where(F.expr("rlike(substr(path, length(folder) + 2), pattern)"))
    last = met.groupBy("path").agg(F.max_by("keep", F.struct(F.length("folder"), "pos")).alias("keep")).where("not keep").select("path")
    return files.join(last, "path", "left_anti")


def listing(files: DataFrame, depth: int = 10, skip: tuple[str, ...] = SKIPPED_DIRS) -> DataFrame:
    """(path, name, is_dir) of files and their folders to a depth, folders first, then by name in any case. Skipped folders are listed, not entered."""
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    every = files.select(parts.alias("p")).select(F.explode(F.transform(F.sequence(F.lit(1), F.least(F.size("p"), F.lit(depth))), lambda i: F.struct(F.slice("p", 1, i).alias("p"), (i < F.size("p")).alias("is_dir")))).alias("x"))
    above = F.slice(F.col("x.p"), F.lit(1), F.size("x.p") - 1)
    kept = every.where(~F.exists(above, lambda d: d.isin(*skip))) if skip else every
    return kept.select(F.concat(F.lit("/"), F.array_join("x.p", "/")).alias("path"), F.element_at("x.p", -1).alias("name"), "x.is_dir").distinct().orderBy(F.desc("is_dir"), F.lower("name"), "path")


def children(files: DataFrame, folder: str, part: str = "", only: str | None = None) -> DataFrame:
    """Direct children of a folder whose name holds part in any case; only files or only folders if asked for ("files", "dirs")."""
    e = listing(files)
    e = e.where(F.col("is_dir") == (only == "dirs")) if only else e
    return e.where((F.regexp_extract("path", r"^(.*)/[^/]*$", 1) == folder.rstrip("/")) & F.lower("name").contains(part.lower()))


def source_directories(files: DataFrame, base: str) -> DataFrame:
    d = F.regexp_extract("path", rf"^{base.rstrip('/')}/src/([^/]+)/", 1)
    return files.select(d.alias("name")).where("name <> ''").distinct().orderBy("name")


def module_structure(files: DataFrame, base: str, target: str) -> DataFrame:
    """The module file of target (the first of three places that exists), and, if it is a mod.rs, those of its child folders."""
    b = base.rstrip("/")
    places = [f"{b}/src/{target}/mod.rs", f"{b}/src/{target}.rs", f"{b}/{target}/mod.rs"]
    rank = F.array_position(F.array(*[F.lit(p) for p in places]), F.col("path"))
    found = files.where(F.col("path").isin(*places)).select("path", rank.alias("r")).orderBy("r").limit(1)
    folder = F.regexp_extract("path", r"^(.*)/mod\.rs$", 1)
    parents = found.where(F.col("path").endswith("/mod.rs")).select(folder.alias("folder"))
    below = files.select("path", F.regexp_extract("path", r"^(.*)/[^/]+/mod\.rs$", 1).alias("folder")).where("folder <> ''").join(parents, "folder", "left_semi").select("path")
    return found.select("path").unionByName(below)


def repositories(files: DataFrame, depth: int = 3) -> DataFrame:
    """(root): folders that hold .git/HEAD, to a depth, none inside another."""
    roots = files.select(F.regexp_extract("path", r"^(.*)/\.git/HEAD$", 1).alias("root")).where("root <> ''").distinct()
    roots = roots.where(F.size(F.filter(F.split("root", "/"), lambda x: x != "")) <= depth + 1)
    above = F.transform(F.sequence(F.lit(1), F.size(F.split("root", "/")) - 1), lambda i: F.array_join(F.slice(F.split("root", "/"), 1, i), "/"))
    outer = roots.withColumnRenamed("root", "parent")
    nested = roots.select("root", F.explode(above).alias("parent")).join(outer, "parent", "left_semi").select("root")
    return roots.join(nested, "root", "left_anti")


def remote(url: str = "url"):
    """Columns host, workspace, slug of a remote URL in ssh or https form; null otherwise."""
    m = r"^(?:https?://(?:[^@/]+@)?|ssh://git@|git@)([^/:]+)[:/]([^/]+)/(.+?)(?:\.git)?/?$"
    return [F.nullif(F.regexp_extract(url, m, i), F.lit("")).alias(n) for i, n in ((1, "host"), (2, "workspace"), (3, "slug"))]


def read_interactions(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of interactions; blank and unreadable lines are dropped."""
    return spark.read.schema(INTERACTION).option("mode", "DROPMALFORMED").json(path).where("id is not null")


def read_references(spark: SparkSession, folder: str) -> DataFrame:
    """All cached reference files of a folder, each a JSON array."""
    return spark.read.schema("name string, file string, line int, col int, byte_offset long, byte_length long, context string").option("multiLine", True).json(folder)


def git_log(spark: SparkSession, repo: str, most: int = 500) -> DataFrame:
    """Commits of a repository in topological order, from its log on the driver."""
    form = "%x1f".join(("%H", "%h", "%an", "%ar", "%s", "%P", "%D"))
    text = subprocess.run(["git", "-C", repo, "log", "--all", "--topo-order", f"-n{most}", f"--format={form}"], capture_output=True, text=True, check=True).stdout
    return parse_log(spark.createDataFrame([(repo, i, x) for i, x in enumerate(text.split("\n"))], "repo string, pos long, value string"))


def log_line(*fields: str) -> str:
    return SEPARATOR.join(fields)


def merged_pages(pages: DataFrame, element: str) -> DataFrame:
    """Values of captured pages (page, body), first PAGES pages in order, paging fields dropped: (page, pos, value)."""
    body = F.from_json("body", f"struct<values:array<{element}>>")
    return pages.where(F.col("page") < PAGES).select("page", F.posexplode(body["values"]).alias("pos", "value"))


def short_pages(pages: DataFrame, element: str, per_page: int = 20) -> DataFrame:
    """Values of numbered pages up to the first one that is short."""
    read = pages.select("page", F.from_json("body", f"array<{element}>").alias("values"))
    stop = read.where(F.size("values") < per_page).agg(F.min("page").alias("stop"))
    return read.join(F.broadcast(stop)).where("stop is null or page <= stop").select("page", F.posexplode("values").alias("pos", "value"))


def servers(configs: DataFrame) -> DataFrame:
    """(path, name, type, command, url) of server configs, wrapped or flat; unreadable ones give nothing, and so do entries without what their type needs."""
    wrapped = F.from_json("content", f"struct<mcpServers:{SERVER}>")["mcpServers"]
    rows = configs.select("path", F.explode(F.coalesce(wrapped, F.from_json("content", SERVER))).alias("name", "s"))
    kind = F.coalesce("s.type", F.when(F.col("s.url").isNotNull(), "http").otherwise("stdio"))
    rows = rows.select("path", "name", kind.alias("type"), "s.command", "s.url")
    return rows.where(((F.col("type") == "stdio") & F.col("command").isNotNull()) | (F.col("type").isin("http", "sse") & F.col("url").isNotNull()))


def skills(files: DataFrame) -> DataFrame:
    """(path, description) from the front matter of skill files; empty without one."""
    front = F.regexp_extract("content", r"(?s)\A---\s*\n(.*?)\n---", 1)
    return files.select("path", F.trim(F.regexp_replace(F.regexp_extract(front, r"(?m)^description:[ \t]*(.*)$", 1), "^[\"']|[\"']$", "")).alias("description"))


def choices(pages: DataFrame, key: str, display: str, description: str) -> DataFrame:
    """(key, display, description) of captured list pages, by JSON paths into each value: branches, pull requests."""
    values = pages.select("page", F.explode(F.from_json(F.get_json_object("body", "$.values"), "array<string>")).alias("v"))
    return values.select("page", *[F.get_json_object("v", p).alias(n) for n, p in (("key", key), ("display", display), ("description", description))])


def issue_counts(responses: DataFrame) -> DataFrame:
    """(id, severity, n) of captured counts by repository or container (id, body)."""
    rows = responses.select("id", F.explode(F.from_json("body", "map<string,bigint>")).alias("severity", "n"))
    return rows.where(F.col("severity").isin("critical", "high", "medium", "low"))


def container_counts(responses: DataFrame) -> DataFrame:
    """(container, severity, n) of captured issue lists (body) that name a container each: counts by severity and container."""
    issue = "array<struct<severity:string,container_name:string,status:string>>"
    rows = responses.select(F.explode(F.from_json("body", issue)).alias("i")).where("i.container_name is not null and i.status = 'open'")
    return rows.groupBy(F.col("i.container_name").alias("container"), F.col("i.severity").alias("severity")).agg(F.count("*").alias("n"))


def safe_paths(files: DataFrame) -> DataFrame:
    """files with safe: whether a path to be written is relative and has no .. in it."""
    return files.withColumn("safe", ~F.col("path").startswith("/") & ~F.array_contains(F.split("path", "/"), ".."))


def repo_filter(repos: DataFrame, part: str) -> DataFrame:
    """Repositories whose folder or slug holds part in any case."""
    return repos.where(F.lower("folder").contains(part.lower()) | F.lower("slug").contains(part.lower()))


def command_filter(commands: DataFrame, prefix: str) -> DataFrame:
    """Commands whose name starts with the prefix, with or without its slash."""
    return commands.where(F.col("name").startswith("/" + prefix.lstrip("/")))
