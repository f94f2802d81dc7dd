"""A project's index on disk, and the commands that ask it."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoutline.operators import classify as C
from scoutline.operators import documents, memory, navigation, query_language, query_syntax, rust_source, state, text_search
from scoutline.session import ship
from scoutline.sources import project, sinks, versions
from scoutline.streaming import events

#: Text fields of the index, of which name and content are asked where a query names none.
FIELDS = ["name", "signature", "fqn", "content"]
#: Text fields of an interaction, and segments of its index from which they are merged.
RECALLED, SEGMENTS = ["input_text", "response_text"], 16
RECALLED_POSTINGS = "part string, field string, doc long, len int, term string, at array<int>"
STATE = "path string, mtime long, size long, version int"
REFS = "name string, file string, line int, col int, context string"
POSTINGS = "part string, field string, doc long, len int, term string, at array<int>, file string"
SYMBOLS = "name string, kind string, file string, line int, col int, visibility string, parent string, signature string, content string"


class Engine:
    """Tables symbols, refs, postings, totals and state under ``folder``, built from the project under ``root``."""

    def __init__(self, spark: SparkSession, root: str, folder: str):
        self.spark, self.root, self.folder = spark, root.rstrip("/"), folder.rstrip("/")
        self.store = versions.Store(spark, f"{self.folder}/index")
        self.recalled = versions.Store(spark, f"{self.folder}/recalled")
        ship(spark)

    # --- build

    def files(self) -> DataFrame:
        """Files to index; ignore files of the project are honoured."""
        files = project.read_files(self.spark, self.root).withColumn("path", F.replace("path", F.lit(self.root), F.lit("")))
        return project.not_ignored(project.discover(files), project.ignore_rules(project.read_ignores(self.spark, self.root)))

    @staticmethod
    def parsed(files: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Symbols and references of files, by language."""
        code, prose = files.where(C.language(F.col("path")) == "Rust"), files.where(C.language(F.col("path")) == "Markdown")
        names = [c.split()[0] for c in SYMBOLS.split(", ")]
        found = rust_source.symbols(code).where("error is null").select(names)
        docs = documents.chunk_symbols(documents.chunks(prose)).withColumn("line", F.col("line").cast("int")).select(names)
        return found.unionByName(docs), rust_source.once(rust_source.references(code)).select("name", "file", "line", "col", "context")

    def snapshot(self) -> DataFrame:
        return self.files().select("path", "mtime", "size")

    def index(self) -> dict[str, int]:
        """Builds the index, or brings it up to date by file; returns how many files were parsed and removed.

        Each changed file is parsed once and its rows are written; everything else is made from those. All tables change with one commit.
        """
        store, last = self.store, self.store.manifest()
        listed = store.stage("state", self.snapshot().withColumn("version", F.lit(state.VERSION)))
        now = store.staged(listed, STATE)
        size = now.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        n = last["facts"].get("buckets") or versions.buckets_for(size)
        if n < versions.buckets_for(size) // 4:  # much has come since: all rows are dealt anew
            last, n = last | {"tables": {}}, versions.buckets_for(size)
        was = self.state().select("path", "mtime", "size") if last["tables"] else now.select("path", "mtime", "size").limit(0)
        changed = store.staged(store.stage("changes", state.changes(was, now.select("path", "mtime", "size"))), "path string, change string")
        counts = {r.change: r["count"] for r in changed.groupBy("change").count().collect()}
        # A modified file may have no rows of a kind any more: what it had goes in any case.
        gone = changed.where("change <> 'unchanged'").select(F.col("path").alias("file"))
        touched = [r[0] for r in gone.select(versions.bucket(F.col("file"), n)).distinct().collect()]  # MOST_BUCKETS at most
        if not touched:
            store.clean()
            return {"parsed": 0, "removed": 0}
        symbols, refs = self.parsed(self.files().join(state.to_index(changed), "path", "left_semi"))
        symbols = store.staged(store.stage("parsed", symbols), SYMBOLS)
        named = symbols.withColumn("seq", F.xxhash64("file", "line", "col", "kind", "name")).withColumn("fqn", navigation.fqn(F.col("parent"), F.col("name")))
        postings = query_syntax.positions(named, "seq", FIELDS).join(named.select(F.col("seq").alias("doc"), "file").distinct(), "doc")
        add, drop = {}, {}
        for name, new, schema in (("symbols", symbols, SYMBOLS), ("refs", refs, REFS), ("postings", postings, POSTINGS)):
            held = store.read(name, schema, touched) if last["tables"] else new.limit(0)
            kept = held.join(gone, "file", "left_anti").select(held.columns).unionByName(new.select(held.columns))
            add[name] = store.stage(name, kept.withColumn("bucket", versions.bucket(F.col("file"), n)), by_bucket=True)
            ends = tuple(f"/bucket={b}" for b in touched)
            drop[name] = [f for f in last["tables"].get(name, []) if f.endswith(ends)]
        add["totals"] = store.stage("totals", self._sums(store, add).repartition(1), by_bucket=True)
        drop["totals"] = [f for f in last["tables"].get("totals", []) if f.endswith(ends)]
        add["state"], drop["state"] = listed, last["tables"].get("state", [])
        store.commit(add, drop, last, buckets=n)
        return {"parsed": counts.get("added", 0) + counts.get("modified", 0), "removed": counts.get("deleted", 0)}

    @staticmethod
    def _sums(store: versions.Store, add: dict[str, list[str]]) -> DataFrame:
        """Documents (field empty) and tokens by field of each rewritten bucket, from its rows alone."""
        at = F.regexp_extract(F.input_file_name(), "/bucket=([0-9]+)/", 1).cast("int").alias("bucket")
        docs = store.staged(add["symbols"], SYMBOLS).select(at).groupBy("bucket").agg(F.count("*").alias("total")).select("bucket", F.lit("all").alias("part"), F.lit("").alias("field"), "total")
        tokens = store.staged(add["postings"], POSTINGS).select(at, "part", "field", F.size("at").alias("n")).groupBy("bucket", "part", "field").agg(F.sum("n").alias("total"))
        return docs.unionByName(tokens)

    def watch(self, on_change, folder: str, every: str = "2 seconds"):
        """Keeps the index up to date with the project; on_change(events, result of index) is called after every change, events a DataFrame (path, kind).

        The listing that the stream starts from is made before the index is brought up to date, so nothing falls in between; a further start
        with the same folder goes on where the last one stopped.
        """
        log = events.EventLog(f"{folder}/log")
        if not any(log.folder.glob("*.json")):
            log.write(0, {"files": events.listing(self.root), "events": []})
        self.index()

        def handed(rows: DataFrame, _: int) -> None:
            if not rows.isEmpty():
                on_change(rows.select("path", "kind"), self.index())

        found = events.project_events(self.spark, self.root, f"{folder}/log")
        return found.writeStream.foreachBatch(handed).option("checkpointLocation", f"{folder}/checkpoint").trigger(processingTime=every).start()

    def clear(self) -> None:
        self.store.clear()

    def state(self) -> DataFrame:
        return state.checked_version(self.store.read("state", STATE))

    def symbols(self) -> DataFrame:
        # A stable number for ties: by place, the method of a place after the function.
        return self.store.read("symbols", SYMBOLS).withColumn("seq", F.xxhash64("file", "line", "col", "kind", "name"))

    def refs(self) -> DataFrame:
        return self.store.read("refs", REFS)

    def postings(self) -> DataFrame:
        return self.store.read("postings", POSTINGS)

    def totals(self) -> DataFrame:
        """(part, field, n, total), summed over the buckets."""
        sums = self.store.read("totals", "part string, field string, total long").groupBy("part", "field").agg(F.sum("total").alias("total"))
        return sums.where("field <> ''").join(sums.where("field = ''").select("part", F.col("total").alias("n")), "part")

    # --- ask

    def search(self, query: str, limit: int = 10, fuzzy: bool = False, kind: str | None = None, full: bool = False) -> DataFrame:
        """(rank, name, kind, file, line, score, and content if full) for text; places for caller questions, module files for structure questions."""
        q = self.spark.createDataFrame([(1, query)], "qid long, query string")
        asked = query_language.dispatched(q).first()
        if asked.route == "structure":
            return project.module_structure(self.files(), "", asked.subject)
        if asked.route in ("callers", "callees"):
            return self.callers(asked.subject) if asked.route == "callers" else self.callees(asked.subject)
        rows, intent = self.symbols(), asked.intent
        fetch = max(1, limit) * (10 if intent == "Understand" else 3)
        if kind:
            hits = text_search.by_kind(rows, kind, fetch).select(F.lit(1).cast("long").alias("qid"), F.col("seq").alias("doc"), F.lit(1.0).alias("score"))
        elif fuzzy:
            hits = text_search.fuzzy(rows, q).select("qid", F.col("seq").alias("doc"), F.lit(1.0).alias("score"))
        else:
            scores = query_syntax.search(self.postings(), self.totals(), q, ["name", "content"], FIELDS)
            hits = text_search.source_boosted(scores, rows, "seq", C.document_type(F.col("file"))).select("qid", "doc", "score")
        raw = text_search.top_k(hits, fetch).withColumnRenamed("rank", "raw_rank")
        known = rows.select(F.col("seq").alias("doc"), "name", "kind", "file", "line", "content", C.document_type(F.col("file")).alias("document_type"))
        joined = raw.join(known, "doc").join(navigation.ref_counts(rows, self.refs()), "name", "left").withColumn("intent", F.lit(intent))
        return text_search.rerank(joined, limit).select("rank", "name", "kind", "file", "line", F.col("final").alias("score"), *["content"] * full).orderBy("rank")

    def _name(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([(name,)], "name string")

    def goto(self, name: str) -> DataFrame:
        return navigation.of_name(self._name(name), self.symbols()).select(navigation.fqn(F.col("parent"), F.col("name")).alias("fqn"), "kind", "file", "line")

    def references(self, name: str, include_definition: bool = False) -> DataFrame:
        return navigation.usages(self._name(name), self.symbols(), self.refs(), include_definition)

    def callers(self, name: str) -> DataFrame:
        return navigation.callers(self._name(name), self.refs(), self.symbols())

    def callees(self, name: str) -> DataFrame:
        """Callees of the first definition."""
        first = navigation.of_name(self._name(name), self.symbols()).orderBy("file", "line", "seq").limit(1)
        return navigation.callees(first, self.refs()).select("callee", "line")

    def list_symbols(self, file: str | None = None, kind: str | None = None) -> DataFrame:
        return navigation.list_symbols(self.symbols(), file, kind)

    def index_stats(self) -> DataFrame:
        return state.index_stats(self.state(), self.symbols())

    def stats(self) -> DataFrame:
        return navigation.graph_stats(self.symbols(), self.refs())

    def info(self, name: str, parts: set[str] | None = None) -> dict[str, DataFrame]:
        """The definitions of a name, and of code, callers, callees and refs those asked for; all but code if none is."""
        made = {
            "code": lambda: navigation.of_name(self._name(name), self.symbols()).select("file", "line", "content"),
            "callers": lambda: self.callers(name),
            "callees": lambda: self.callees(name),
            "refs": lambda: navigation.context_counts(navigation.of_name(self._name(name), self.refs())),
        }
        return {"definitions": self.goto(name)} | {k: v() for k, v in made.items() if k in (parts or {"callers", "callees", "refs"})}

    # --- memory

    def interactions(self) -> DataFrame:
        rows = project.read_interactions(self.spark, f"{self.folder}/memory")
        return rows.select("id", "session_id", "timestamp", F.col("timestamp").alias("line_no"), F.col("input.text").alias("input_text"), F.col("response.text").alias("response_text"), F.col("response.type").alias("type"))

    def remember(self, rows: DataFrame) -> None:
        """Appends interactions, and a segment of their postings."""
        store = self.recalled
        kept = store.stage("new", rows)
        rows = self.spark.read.schema(rows.schema).parquet(*[f"{store.folder}/{f}" for f in kept])  # written once, so that both see the same rows
        sinks.append_interactions(rows, f"{self.folder}/memory")
        self._segment(rows.select("id", F.col("input.text").alias("input_text"), F.col("response.text").alias("response_text")))

    def _segment(self, texts: DataFrame) -> None:
        """Indexes texts (id, input_text, response_text) as one more segment; from SEGMENTS on all are merged into one."""
        store, last = self.recalled, self.recalled.manifest()
        held = texts.withColumn("seq", F.xxhash64("id"))
        index = store.stage("postings", query_syntax.positions(held, "seq", RECALLED))
        docs = store.stage("docs", held.select("seq"))
        add, drop = {"postings": index, "docs": docs}, {}
        if len(last["tables"].get("docs", [])) + 1 >= SEGMENTS:
            for name, schema in (("postings", RECALLED_POSTINGS), ("docs", "seq long")):
                drop[name] = last["tables"][name]
                add[name] = store.stage(name, store.staged([*drop[name], *add[name]], schema).coalesce(8))
        store.commit(add, drop, last)

    def repair_memory(self) -> int:
        """Indexes interactions that no segment holds, as after a crash between the two; returns how many."""
        lost = self.interactions().withColumn("seq", F.xxhash64("id")).join(self.recalled.read("docs", "seq long"), "seq", "left_anti")
        n = lost.count()
        if n:
            self._segment(lost.select("id", "input_text", "response_text"))
        return n

    def add(self, text: str, answer: str, session: str | None = None) -> None:
        """Appends one interaction of now."""
        now = int(time.time())
        row = (uuid.uuid4().hex, now, session or "default", {"text": text}, {"type": "Answer", "text": answer})
        self.remember(self.spark.createDataFrame([row], project.INTERACTION))

    def memory_recent(self, n: int = 10, session: str | None = None) -> DataFrame:
        return memory.recent_of_session(self.interactions(), n, session) if session else memory.recent(self.interactions(), n)

    def memory_stats(self, saved: bool = False) -> DataFrame:
        """Statistics of all interactions, saved for the next time; those of the last time if they are enough."""
        if saved and (held := sinks.cached(self.spark, f"{self.folder}/memory_stats", "total long, sessions long, size_bytes long, last_updated long")) is not None:
            return held
        now = memory.stats(self.interactions())
        sinks.save_cached(now, f"{self.folder}/memory_stats")
        return now

    def memory_search(self, query: str, limit: int = 10) -> DataFrame:
        """(rank, id, input_text, response_text, score), asked of the saved segments together."""
        return self.memory_searches(self.spark.createDataFrame([(1, query)], "qid long, query string"), limit).drop("qid").orderBy("rank")

    def memory_searches(self, queries: DataFrame, limit: int = 10) -> DataFrame:
        """(qid, rank, id, input_text, response_text, score) for many queries (qid, query)."""
        index, docs = self.recalled.read("postings", RECALLED_POSTINGS), self.recalled.read("docs", "seq long")
        totals = index.groupBy("part", "field").agg(F.sum(F.size("at")).alias("total")).join(docs.agg(F.count("*").alias("n")))  # one row on the right
        hits = text_search.top_k(query_syntax.search(index, totals, queries, RECALLED), limit)
        rows = self.interactions().withColumn("seq", F.xxhash64("id"))
        return hits.join(rows, F.col("doc") == F.col("seq")).select("qid", "rank", "id", "input_text", "response_text", "score")
