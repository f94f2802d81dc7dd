"""Questions in words: intent, identifiers, caller and structure phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words by intent, in order of precedence.
INTENTS = {
    "FindDefinition": ("where", "definition", "defined"),
    "FindUsages": ("used", "references", "usages"),
    "Understand": ("how", "explain", "understand"),
    "Modify": ("fix", "change", "modify"),
    "Debug": ("bug", "error", "debug"),
}
# Words that are no identifiers.
STOP_WORDS = (
    "how where what why when which who whom the a an and or but if then else is are was were be been being have has had do does did done can "
    "could would should will shall may might must to for in of on at by with from about find get show list explain describe tell give work works "
    "use uses used call calls called define defined definition this that it i me my we our all any some no not only just code file function class method module"
).split()
SKIPPED = ("the", "a", "an", "this", "that", "our", "my")
# Suggestion rules, trigger to (model, description), in order.
SUGGESTIONS = {"api": ("sonnet", "Review security"), "refactor": ("haiku", "Write tests"), "bug": ("sonnet", "Analyze root cause"), "feature": ("haiku", "Add test coverage"), "test": ("haiku", "Check quality")}


def intent(query: Column) -> Column:
    """By whole words; every character but letters and digits ends a word."""
    low = F.lower(query)
    out = F.lit("Search")
    for name, words in reversed(INTENTS.items()):
        out = F.when(low.rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(words)})(?![\p{{L}}\p{{N}}])"), name).otherwise(out)
    return out


def identifiers(query: Column) -> Column:
    """Words of two bytes or more that have an underscore, or both cases, and are no stop word."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    mixed = lambda w: w.rlike(r"\p{Lu}") & w.rlike(r"\p{Ll}")
    return F.filter(F.split(query, r"[^\p{L}\p{N}_]+"), lambda w: (F.octet_length(w) >= 2) & ~F.array_contains(stop, F.lower(w)) & (mixed(w) | w.contains("_")))


def _trimmed(word: Column) -> Column:
    bare = F.regexp_replace(word, r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", "")
    return F.when(F.octet_length(bare) > 1, bare)


def _after(query: Column, low: Column, key: str) -> Column:
    at = F.locate(key, low)
    return F.when(at > 0, _trimmed(F.regexp_extract(F.substr(query, at + len(key)), r"^\s*(\S*)", 1)))


def _before(query: Column, low: Column, key: str) -> Column:
    at = F.locate(key, low)
    return F.when(at > 0, _trimmed(F.regexp_extract(F.substr(query, F.lit(1), at - 1), r"(\S*)\s*$", 1)))


def caller_question(query: Column) -> Column:
    """struct(symbol, direction), symbol null if there is none. The case of the symbol is kept, so that CamelCase names can be found.

    The first caller phrase that occurs decides, whether a symbol can be read from it or not; only then the callee phrase.
    """
    low = F.lower(query)
    symbol = (
        F.when(low.contains("who calls") | low.contains("what calls"), _after(query, low, "calls "))
        .when(low.contains("callers of"), _after(query, low, "callers of "))
        .when(low.contains(" callers"), _before(query, low, " callers"))
        .when(low.contains("that call "), _after(query, low, "that call "))
    )
    start = F.locate("what does ", low)
    rest = F.when(start > 0, F.substr(query, start + len("what does ")))
    end = F.locate(" call", F.lower(rest))
    between = F.regexp_replace(F.trim(F.when(end > 0, F.substr(rest, F.lit(1), end - 1))), r"[.,;:]+$", "")
    callee = F.when(low.contains("what does") & low.contains("call") & (F.octet_length(between) > 1), between)
    return F.struct(F.coalesce(symbol, callee).alias("symbol"), F.when(symbol.isNotNull(), "callers").when(callee.isNotNull(), "callees").alias("direction"))


def _target(low: Column, key: str) -> Column:
    at = F.locate(key, low)
    words = F.split(F.trim(F.substr(low, at + len(key))), r"\s+")
    cleaned = F.transform(words, lambda w: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(w, "(directory)+$", ""), "(module)+$", ""), "(folder)+$", ""), r"\?+$", ""))
    kept = F.filter(cleaned, lambda w: ~w.isin(*SKIPPED) & (F.octet_length(w) > 1))
    return F.when(at > 0, F.get(kept, F.lit(0)))


def structure_question(query: Column) -> Column:
    """struct(target, is_module), target null if the question is none. Phrases in order; one that gives no target leads to the next."""
    low = F.lower(query)
    modules = F.when(low.contains("modules in") | low.contains("modules are in"), _target(low, "in "))
    whats = F.when(low.contains("what's in") | low.contains("what is in"), _target(low, "in "))
    of = F.when(low.contains("structure of"), _target(low, "structure of "))
    words = F.split(F.trim(low), r"\s+")
    at = F.array_position(F.slice(words, F.lit(2), F.greatest(F.lit(0), F.size(words) - 1)), "structure").cast("int")
    name = F.when(at > 0, F.get(words, at - 1))
    before = F.when(low.contains(" structure") & ~name.isin("module", "directory") & (F.octet_length(name) > 2), name)
    target = F.coalesce(modules, whats, of, before)
    return F.struct(target.alias("target"), F.when(target.isNotNull(), modules.isNotNull() | whats.isNull()).alias("is_module"))


def dispatched(queries: DataFrame) -> DataFrame:
    """qid, route (structure, callers, callees or text), subject and intent of each question."""
    s, c = structure_question(F.col("query")), caller_question(F.col("query"))
    return queries.select("qid", "query", s.alias("s"), c.alias("c")).select(
        "qid", F.when(F.col("s.target").isNotNull(), "structure").otherwise(F.coalesce("c.direction", F.lit("text"))).alias("route"), F.coalesce("s.target", "c.symbol").alias("subject"), intent(F.col("query")).alias("intent")
    )


def suggestions(text: Column) -> Column:
    """Descriptions of the first two rules whose trigger occurs; none for short texts or those that name agents already."""
    low = F.lower(text)
    rules = F.array(*[F.struct(F.lit(t).alias("trigger"), F.lit(d).alias("description")) for t, (_, d) in SUGGESTIONS.items()])
    hit = F.transform(F.slice(F.filter(rules, lambda r: low.contains(r["trigger"])), 1, 2), lambda r: r["description"])
    return F.when((F.octet_length(text) < 10) | text.contains("- agent("), F.array().cast("array<string>")).otherwise(hit)
