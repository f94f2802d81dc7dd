"""Benchmark decontamination with spaced seeds, in DataFrame functions only.

Tokens are runs of letters and digits, lower-cased, and single characters in scripts without spaces. A seed is the hash of the tokens that a fixed
mask selects from SPAN consecutive ones; those that it skips may differ. Seeds of all documents
meet those of the benchmark; every hit fixes an alignment, and an alignment counts where some
window of WINDOW tokens has at most SUBSTITUTIONS that differ. The two masks together hit every such
window wherever its substitutions lie (the tests enumerate them), so that the result does not depend on the masks.

A window holds the whole span of some seed that hits it, and so the REACH tokens on either side of a hit's span tell all
that the hit can say. They are compared where the hit is found, in the pass that makes the seeds: no text is shuffled.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutline.llm.shared import Scratch

MASKS = ("111101001", "100110111")
SPAN, WINDOW, SUBSTITUTIONS = 9, 13, 2
REACH = WINDOW - SPAN
#: Characters of Thai, Japanese and Chinese; plain ranges, as looking scripts up is slow.
UNSPACED = r"[\x{E00}-\x{E7F}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}]"
#: Shorter items are not looked for unless asked: phrases of a few words occur in clean documents.
SHORTEST = 5
#: Benchmark seeds, and keys of contaminated documents, that are broadcast, at most; above it Spark joins by its own choice.
BROADCAST_SEEDS = 2_000_000


def tokens(text: str) -> Column:
    """Runs of letters and digits; a character of a script without spaces is a token of its own."""
    spaced = F.regexp_replace(F.lower(F.col(text)), rf"({UNSPACED})", " $1 ")
    return F.array_remove(F.split(spaced, r"[^\p{L}\p{N}]+"), "")


def masked_hash(h: Column, i: Column, kind: int, chosen: list[int]) -> Column:
    """Hash of the tokens at the chosen offsets from i; kind keeps the hashes of several masks apart."""
    return F.xxhash64(F.lit(kind), *[F.get(h, i + o) for o in chosen])


def seeds(df: DataFrame, keys: list[str], text: str, lengths: tuple[int, ...]) -> DataFrame:
    """(keys, h, p, seed) of rows (keys, text): each mask at each position p / masks; h are hashes of the tokens.

    lengths: those of short items, each of which is a further mask without gaps. The masks' hashes differ.
    """
    masks = [(m, [o for o, c in enumerate(mask) if c == "1"]) for m, mask in enumerate(MASKS)] + [(-n, list(range(n))) for n in lengths]
    least = min([SPAN, *lengths])

    def made(h: Column) -> Column:
        at = lambda i: F.array(*[masked_hash(h, i, kind, chosen) for kind, chosen in masks])
        return F.when(F.size(h) >= least, F.flatten(F.transform(F.sequence(F.lit(0), F.size(h) - least), at)))

    # The hashes of tokens are the variable of a lambda, so that a text is split once and not for each
    # use of them. For an inner posexplode Spark would add a filter on the array, and make it twice.
    hashed = F.transform(tokens(text), lambda x: F.xxhash64(x))
    both = df.select(*keys, F.transform(F.array(hashed), lambda h: F.struct(h.alias("h"), made(h).alias("seeds")))[0].alias("x"))
    return both.select(*keys, F.col("x.h").alias("h"), F.col("x.seeds").alias("seeds")).select(*keys, "h", F.posexplode_outer("seeds").alias("p", "seed"))


def overlaps(docs: DataFrame, keys: list[str], benchmark: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(keys, item_id, shift, first, best), a row for each alignment that counts: the first token of its windows that count, and the most equal tokens."""
    n = F.size(tokens("text"))
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    items = items.withColumn("n", n).where(f"n >= {max(shortest, 1)}")
    lengths = tuple(sorted(r.n for r in items.where(f"n < {SPAN}").select("n").distinct().collect()))  # SPAN - 1 at most
    each = len(MASKS) + len(lengths)
    at = F.expr(f"cast(p div {each} as int)")
    own = F.array(*[F.lit(0)] * len(MASKS), *[F.lit(k) for k in lengths])
    test = seeds(items, ["item_id", "n"], "text", lengths).withColumn("from", at).withColumn("only", F.get(own, F.col("p") % each))
    # An item of SPAN tokens or more has the seeds of the masks, a shorter one that of its length.
    test = test.where(f"only = 0 and from <= n - {SPAN} or only = n and from = 0").select("item_id", "n", F.col("h").alias("it"), "from", "seed")
    few = test.limit(BROADCAST_SEEDS + 1).count() <= BROADCAST_SEEDS
    whole = test.select("item_id", "n", "it").distinct()
    slim = test.select("item_id", "n", "from", "seed").distinct()
    left = seeds(docs, keys, "text", lengths)
    if few:
        base = F.col("at")
        hits = left.join(F.broadcast(slim), "seed").withColumn("at", at).join(F.broadcast(whole), ["item_id", "n"])
    else:  # a seed takes the tokens around it into the join, not those of its whole text
        base = F.lit(REACH)
        around = F.transform(F.sequence(F.lit(-REACH), F.lit(WINDOW - 1)), lambda o: F.get("h", F.col("at") + o)).alias("h")
        hits = left.withColumn("at", at).select(*keys, "seed", "at", around).join(slim, "seed").join(whole, ["item_id", "n"])

    def scores(same: Column) -> Column:
        """Equal tokens of each window that holds the hit's span; a short item is one window, for which tokens beyond its ends are unequal."""
        total = lambda x: F.aggregate(x, F.lit(0), lambda a, b: a + b)
        inside = lambda w: (F.col("from") + w >= 0) & (F.col("from") + w + WINDOW <= F.col("n"))
        windows = F.transform(F.sequence(F.lit(-REACH), F.lit(0)), lambda w: F.when(inside(w), total(F.slice(same, w + REACH + 1, WINDOW))))
        return F.when(F.col("n") < WINDOW, F.array(total(same))).otherwise(windows)

    # In lambdas, which Spark interprets, so that the compiled code that makes the seeds stays small.
    same = F.transform(F.sequence(F.lit(-REACH), F.lit(WINDOW - 1)), lambda o: F.coalesce(F.get("h", base + o) == F.get("it", F.col("from") + o), F.lit(False)).cast("int"))
    need = F.when(F.col("n") < WINDOW, F.col("n")).otherwise(WINDOW - SUBSTITUTIONS)
    found = F.transform(F.array(F.transform(F.array(same), scores)[0]), lambda x: F.struct(F.array_max(x).alias("best"), F.array_position(F.transform(x, lambda y: y >= need), True).alias("i")))[0]
    start = F.when(F.col("n") < WINDOW, 0).otherwise(F.col("from") - REACH)
    hits = hits.select(*keys, "item_id", (F.col("at") - F.col("from")).alias("shift"), start.alias("start"), found.alias("x"))
    first = F.when(F.col("x.i") > 0, F.col("shift") + F.col("start") + F.col("x.i") - 1)
    # The condition on an aggregate stays where it is; one on hits would move into the compiled code.
    best = hits.groupBy(*keys, "item_id", "shift").agg(F.min(first).alias("first"), F.max("x.best").cast("long").alias("best"))
    return best.where("first is not null")


def contaminated(docs: DataFrame, benchmark: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, item_id, doc_pos (first token of the first such window), best_matches (equal tokens of
    the best window), n_alignments, one row per document and item that overlap.

    Items of ``shortest`` (1 at least) to WINDOW - 1 tokens must occur whole and unchanged; shorter ones are not
    looked for. Texts of any length are read whole; all alignments count, so there are no ties. Null texts overlap nothing; rows without doc_id or item_id are not reported. Rows that
    share an id stand for one document or item. Other columns are ignored. Either table may be empty.
    """
    docs = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return (
        overlaps(docs, ["doc_id"], benchmark, shortest)
        .groupBy("doc_id", "item_id")
        .agg(F.min("first").alias("doc_pos"), F.max("best").alias("best_matches"), F.count("*").alias("n_alignments"))
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """The rows of docs whose text overlaps no benchmark item.

    Each row is judged by its own text, also where doc_ids are null or repeated. Null and empty texts stay.
    Other columns are kept, whatever their names; either table may be empty.
    """
    keyed = docs.where("text is not null").select(F.col("doc_id").alias("d"), F.xxhash64("text", F.length("text")).alias("t"), "text")
    with Scratch(docs.sparkSession) as scratch:
        gone = scratch.keep(overlaps(keyed, ["d", "t"], benchmark, shortest).select("d", "t").distinct())
    few = gone.count() <= BROADCAST_SEEDS
    same = docs["doc_id"].eqNullSafe(gone["d"]) & (F.xxhash64(docs["text"], F.length(docs["text"])) == gone["t"])
    return docs.join(F.broadcast(gone) if few else gone, same, "left_anti")


#: DuckDB SQL of ``contaminated``: alignments of four equal tokens in a row, which every window of 13 tokens with two substitutions has.
CONTAMINATED_SQL = r"""
WITH d AS (SELECT doc_id, [x for x in regexp_split_to_array(regexp_replace(lower(text), '([\x{E00}-\x{E7F}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}])', ' \1 ', 'g'), '[^\p{L}\p{N}]+') if x <> ''] w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
i AS (SELECT item_id, [x for x in regexp_split_to_array(regexp_replace(lower(text), '([\x{E00}-\x{E7F}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}])', ' \1 ', 'g'), '[^\p{L}\p{N}]+') if x <> ''] w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
dg AS (SELECT doc_id, p, array_to_string(w[p:p+3], ' ') g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1))) p FROM d)),
ig AS (SELECT item_id, p, array_to_string(w[p:p+3], ' ') g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 2, 1))) p FROM i WHERE len(w) >= 5)),
a AS (SELECT DISTINCT doc_id, item_id, dg.p - ig.p AS shift FROM dg JOIN ig USING (g)),
m AS (SELECT doc_id, item_id, shift, len(i.w) n, [CASE WHEN shift + t BETWEEN 1 AND len(d.w) AND d.w[shift + t] = i.w[t] THEN 1 ELSE 0 END for t in range(1, len(i.w) + 1)] AS same
      FROM a JOIN d USING (doc_id) JOIN i USING (item_id)),
c AS (SELECT doc_id, item_id, shift, n, [list_sum(same[t : t + 12]) for t in range(1, greatest(n - 11, 2))] AS scores FROM m),
s AS (SELECT doc_id, item_id, shift, n, t, scores[t] AS score FROM (SELECT *, unnest(range(1, len(scores) + 1)) AS t FROM c))
SELECT doc_id, item_id, min(shift + t - 1)::BIGINT AS doc_pos, max(score)::BIGINT AS best_matches, count(DISTINCT shift) AS n_alignments
FROM s WHERE (n >= 13 AND score >= 11) OR (n < 13 AND t = 1 AND score = n)
GROUP BY doc_id, item_id
"""
