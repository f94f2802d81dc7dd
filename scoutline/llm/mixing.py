"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern, the set of sources that they belong to. Token
capacity flows from patterns to the quotas of their sources; the r-th pass over a pattern costs
r, so that capacity is repeated only where fresh capacity is used up (convex costs). The flow
through a pattern says how often all of its documents are taken, and how many words of one more
pass are left; these go to documents in the order of a seeded hash, the last of them in part.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoutline.llm.shared import Scratch

WORDS = r"[^\x20\x09-\x0D]+"
#: The weights repeat over the sources in code point order, null last.
WEIGHTS = (3, 1, 2)
PASSES, SHARE, SEED = 2, Fraction(3, 2), 5
#: Patterns whose sizes the driver holds, at most; more are an error, not a truncation.
PATTERNS = 200_000
#: Bits of the hash that group documents before the cut is looked for: 4096 groups, and 4096 in the one that has it.
BITS = 12


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, passes: int = PASSES) -> list[Fraction]:
    """Quotas in proportion to weight, none above ``passes`` sizes; excess is shared out again until none is above."""
    out: list[Fraction | None] = [None] * len(sizes)
    left = share * sum(sizes)
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    while open_ := [i for i, x in enumerate(out) if x is None]:
        each = left / sum(weight[i] for i in open_)
        above = [i for i in open_ if weight[i] * each > passes * sizes[i]]
        for i in above or open_:
            out[i] = Fraction(passes * sizes[i]) if above else weight[i] * each
            left -= out[i]
    return out


def route(patterns: list[tuple[frozenset, int]], quotas: dict, passes: int = PASSES) -> list[int]:
    """Words to take of each (sources, size) pattern, by successive shortest paths with potentials.

    Quotas are filled as far as the patterns reach; among such flows the one of least repetition.
    """
    names = list(quotas)
    at = {s: 1 + len(patterns) + i for i, s in enumerate(names)}
    n = 2 + len(patterns) + len(names)
    graph: list[list[list]] = [[] for _ in range(n)]

    def edge(u: int, v: int, room: int, cost: int) -> None:
        graph[u].append([v, room, cost, len(graph[v])])
        graph[v].append([u, 0, -cost, len(graph[u]) - 1])

    for p, (members, size) in enumerate(patterns):
        for r in range(passes):
            edge(0, 1 + p, size, r)
        for s in sorted(members, key=lambda x: (x is None, x or "")):
            edge(1 + p, at[s], passes * size, 0)
    for s in names:
        edge(at[s], n - 1, int(quotas[s] + Fraction(1, 2)), 0)
    potential = [0] * n
    while True:
        far: list[float] = [float("inf")] * n
        way: list[tuple[int, int] | None] = [None] * n
        far[0], todo = 0, [(0, 0)]
        while todo:
            d, u = heapq.heappop(todo)
            if d > far[u]:
                continue
            for i, (v, room, cost, _) in enumerate(graph[u]):
                new = d + cost + potential[u] - potential[v]
                if room and new < far[v]:
                    far[v], way[v] = new, (u, i)
                    heapq.heappush(todo, (new, v))
        if way[n - 1] is None:
            break
        potential = [p + (int(f) if f < float("inf") else 0) for p, f in zip(potential, far, strict=True)]
        # Blocking flow over the edges of reduced cost 0, so that one search serves all equal paths.
        level = [-1] * n
        level[0], queue = 0, [0]
        for u in queue:
            for v, room, cost, _ in graph[u]:
                if room and level[v] < 0 and cost + potential[u] - potential[v] == 0:
                    level[v] = level[u] + 1
                    queue.append(v)
        if level[n - 1] < 0:
            break
        nxt, path = [0] * n, []
        u = 0
        while True:
            if u == n - 1:
                room = min(graph[a][i][1] for a, i in path)
                for a, i in path:
                    e = graph[a][i]
                    e[1] -= room
                    graph[e[0]][e[3]][1] += room
                u, path = 0, []
            elif nxt[u] < len(graph[u]):
                v, room, cost, _ = graph[u][nxt[u]]
                if room and level[v] == level[u] + 1 and cost + potential[u] - potential[v] == 0:
                    path.append((u, nxt[u]))
                    u = v
                else:
                    nxt[u] += 1
            elif path:
                u, i = path.pop()
                nxt[u] += 1
            else:
                break
    # What can flow back to the source is what came from it.
    return [sum(room for v, room, _, _ in graph[1 + p] if v == 0) for p in range(len(patterns))]


def mix_sources(docs: DataFrame, memberships: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken (and ``carry`` columns), one row per input row.

    ``memberships`` names an array column of sources for documents in several of them; without it
    the column source is the only one. size: words of the text, null text 0. source_size and
    target: sums over the document's sources. taken is at most 2 * size. A null source, like an empty
    or null membership, is a source of its own, the last. Documents without words take nothing.
    Rows with one doc_id, or none, are separate rows; of equal rows, which of them takes what is arbitrary.
    An empty table gives an empty result. Texts of any length are counted whole. Other columns are ignored but for
    ``carry``, whose names must not be those of the result.
    """
    spark = docs.sparkSession
    sources = F.coalesce(F.col(memberships), F.array()) if memberships else F.array(F.col("source"))
    sources = F.when(F.size(sources) == 0, F.array(F.lit(None).cast("string"))).otherwise(F.array_sort(F.array_distinct(sources)))
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    # With the text, so that rows without a doc_id, or with one and the same, do not all have one rank.
    rank = F.xxhash64(F.lit(SEED), F.col("doc_id"), sources, F.col("text"))
    pattern = F.to_json(sources, {"ignoreNullFields": "false"})
    with Scratch(spark) as scratch:
        sized = docs.select(size.alias("size"), pattern.alias("_p"), sources.alias("_s"), rank.alias("_u"))
        sized = scratch.save(sized.withColumns({"_a": F.shiftrightunsigned("_u", 64 - BITS), "_b": F.shiftrightunsigned("_u", 64 - 2 * BITS)}).drop("_u"))
        held = sized.groupBy("_p").agg(F.first("_s").alias("s"), F.sum("size").alias("size")).limit(PATTERNS + 1).collect()
        if len(held) > PATTERNS:
            raise ValueError(f"more than {PATTERNS} membership patterns")
        held.sort(key=lambda r: r["_p"])
        patterns = [(frozenset(r.s), r["size"]) for r in held]
        names = sorted({s for m, _ in patterns for s in m}, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
        total = {s: sum(n for m, n in patterns if s in m) for s in names} if memberships else {next(iter(m)): n for m, n in patterns}
        quota = dict(zip(names, targets([total[s] for s in names]), strict=True))
        flow = route(patterns, quota)
        plan = [
            (r["_p"], sum(total[s] for s in m), float(sum(quota[s] for s in m)), *(divmod(f, n) if n else (0, 0)))
            for r, (m, n), f in zip(held, patterns, flow, strict=True)
        ]
        # One row per pattern, PATTERNS at most, here and below.
        plan_df = spark.createDataFrame(plan, "_p string, source_size long, target double, _full long, _rest long").withColumn("_before", F.lit(0).cast("long"))

        def cut(rows: DataFrame, group: str) -> DataFrame:
            """(_p, cut, before): the group in which the words left of a pattern run out, and the words of the groups before it."""
            up_to = Window.partitionBy("_p").orderBy(group).rowsBetween(Window.unboundedPreceding, 0)
            sums = rows.groupBy("_p", "_rest", "_before", group).agg(F.sum("size").alias("_g")).withColumn("_to", F.col("_before") + F.sum("_g").over(up_to))
            found = sums.where("_to > _rest and _to - _g <= _rest")
            return found.groupBy("_p").agg(F.min(group).alias("cut"), F.min_by(F.col("_to") - F.col("_g"), F.col(group)).alias("before"))

        first = scratch.save(cut(sized.join(F.broadcast(plan_df.select("_p", "_rest", "_before")), "_p"), "_a"))
        inner = plan_df.drop("_before").join(first.withColumnsRenamed({"cut": "_cut", "before": "_before"}), "_p")
        second = cut(sized.join(F.broadcast(inner.select("_p", "_rest", "_before", "_cut")), "_p").where("_a = _cut"), "_b")
        put = scratch.keep(plan_df.drop("_before").join(second, "_p", "left"))
    own = ["doc_id", *carry, "size", "source_size", "target", "taken"]
    # The words are counted after the rows are told apart, so that each text is read for one of both kinds.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carry, F.col("text").alias("_text"), pattern.alias("_p"), F.shiftrightunsigned(rank, 64 - 2 * BITS).alias("_b"))
    placed = rows.join(F.broadcast(put), "_p")
    count = F.coalesce(F.regexp_count("_text", F.lit(WORDS)), F.lit(0)).cast("long")
    taken = lambda more: (F.col("_full") * F.col("size") + more).cast("long")
    clear = placed.where("cut is null or _b <> cut").withColumn("size", count)
    clear = clear.withColumn("taken", taken(F.when((F.col("_rest") > 0) & (F.col("cut").isNull() | (F.col("_b") < F.col("cut"))), F.col("size")).otherwise(0)))
    inside = Window.partitionBy("_p").orderBy(F.xxhash64("doc_id"), "doc_id", "size", "_t").rowsBetween(Window.unboundedPreceding, 0)
    split = placed.where("_b = cut").withColumns({"size": count, "_t": F.xxhash64("_text")}).withColumn("_to", F.col("before") + F.sum("size").over(inside))
    split = split.withColumn("taken", taken(F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("_to") + F.col("size")))))
    return clear.select(own).unionByName(split.select(own))
