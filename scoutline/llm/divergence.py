"""Source divergence audit: how far the words of each source stand from those of the other sources and of its language.

Terms are counted in one pass and pre-aggregated in the workers, so that a hot source sends as few rows as any other.
A pair of sources is compared sparsely: of a term that a source lacks, the smoothed probability is one baseline
of that source, so a pair needs the histogram of each side's counts against the other's baseline, and a correction for
terms that both have. The best terms of each group are found by radix selection: histograms over the bits of the
values give the kth value of all groups at once, ties are cut by histograms over the UTF-8 bytes of the terms, and only what
is selected is sorted.
"""

from __future__ import annotations

import string
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoutline.llm.shared import Scratch, parts, small

SCALE, SMOOTHING, LEAST_DOCS, TOP = 1_000_000_000, 5, 30, 50
#: Bits of a value that one histogram tells apart, and how many of them hold any value: 1 + SCALE is below 2 ** 30.
BITS, ROUNDS = 10, 3
#: Hexadecimal digits of a term that one histogram of ties tells apart: two bytes.
DIGITS = 4
#: Entries that a worker holds before it sends them, and bytes of a text that it splits at once.
HELD, SLICE = 200_000, 1 << 20

_LETTERS = string.ascii_letters.encode() + bytes(range(0x80, 0x100))
_TERMS = bytes(b if b in _LETTERS else 0x20 for b in range(256)).translate(bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode()))
GROUP = ["lang", "source"]


def terms_of(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, slice by slice: runs of ASCII letters and of anything beyond ASCII, with A-Z in lower case."""
    data = text.encode("utf-8", "replace").translate(_TERMS)
    at = 0
    while at < len(data):
        end = data.find(b" ", min(len(data), at + SLICE))
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[tuple[str, str]] = Counter()
    counts: dict[tuple[str, str], Counter[bytes]] = defaultdict(Counter)
    docs: dict[tuple[str, str], Counter[bytes]] = defaultdict(Counter)
    kinds = {"lang": pa.string(), "source": pa.string(), "term": pa.binary(), "n": pa.int64(), "docs": pa.int64()}
    size = 0

    def sent() -> Iterator[pa.RecordBatch]:
        for (lang, source), n in counts.items():
            own = docs[lang, source]
            columns = [[lang] * len(n), [source] * len(n), list(n), list(n.values()), [own[t] for t in n]]
            arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays[:2], arrays[2].cast(pa.string()), *arrays[3:]], names=[*kinds])
        counts.clear()
        docs.clear()

    for b in parts(batches):
        for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            group = lang, source
            seen[group] += 1
            n, distinct = counts[group], set()
            size -= len(n)
            for words in terms_of(text):
                n.update(words)
                distinct.update(words)
            docs[group].update(distinct)
            size += len(n)
            if size >= HELD:
                yield from sent()
                size = 0
    yield from sent()
    rows = [(*group, None, 0, n) for group, n in seen.items()]
    arrays = [pa.array([r[i] for r in rows], pa.string() if i == 2 else kind) for i, kind in enumerate(kinds.values())]
    yield pa.RecordBatch.from_arrays(arrays, names=[*kinds])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term; term is null in one row a group, which counts its documents."""
    empty = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in (*GROUP, "text")]
    counted = docs.select(*empty).mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return counted.groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(n: Column, total: Column, size: Column) -> Column:
    """1 + floor(SCALE * (n + 5) / (total + 5 * size)), exactly; null where size is 0."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.when(size > 0, F.call_function("div", wide(n + SMOOTHING) * F.lit(SCALE).cast("decimal(10,0)"), wide(total + SMOOTHING * size)) + 1)


def selected(rows: DataFrame, keys: list[str], k: int, scratch: Scratch) -> DataFrame:
    """The k rows of each group of greatest value, equal values by the UTF-8 bytes of item; rows: (keys, item string, value long from 0 to 2 ** 30 - 1).

    A group of no more than k rows stays whole. Items of a group are distinct. No group is sorted: each round is a histogram, with one row a group and bucket.
    """
    sizes = rows.groupBy(*keys).count()
    state = scratch.save(sizes.where(F.col("count") > k).select(*keys, F.lit(0).cast("long").alias("high"), F.lit(k).cast("long").alias("need")))
    for i in range(ROUNDS):
        shift = BITS * (ROUNDS - 1 - i)
        inside = rows.join(small(state), keys).where(F.shiftright("value", shift + BITS) == F.col("high"))
        hist = inside.groupBy(*keys, "high", "need", F.shiftright("value", shift).alias("bucket")).agg(F.count("*").alias("c"))
        above = F.coalesce(F.sum("c").over(Window.partitionBy(*keys).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        cut = hist.withColumn("above", above).where("above < need and above + c >= need")
        state = scratch.save(cut.select(*keys, F.col("bucket").alias("high"), (F.col("need") - F.col("above")).alias("need"), "c"))
    least = state.withColumnRenamed("high", "least")
    # Ties: need of the c rows with the least value. They are taken while their first width digits are no more than bound; null takes all.
    done = scratch.save(least.where("c = need").select(*keys, "least", F.lit(None).cast("string").alias("bound"), F.lit(0).alias("width")))
    bounds, open_ = [done], scratch.save(least.where("c > need").select(*keys, "least", "need", F.lit("").alias("bound")))
    while not open_.isEmpty():
        tied = rows.withColumn("hex", F.hex("item")).join(small(open_), keys).where((F.col("value") == F.col("least")) & F.col("hex").startswith(F.col("bound")))
        ends = tied.groupBy(*keys).agg(F.min("hex").alias("a"), F.max("hex").alias("b"))
        byte = lambda c: F.regexp_extract_all(c, F.lit(".."), 0)
        # What the first and the last item have in common all have: such bytes are passed over at once. Past its end an item has no byte.
        common = F.array_position(F.zip_with(byte("a"), byte("b"), lambda x, y: F.coalesce(x == y, F.lit(False))), False) - 1
        ends = scratch.save(ends.select(*keys, (common.cast("int") * 2).alias("skip")))
        hist = tied.join(small(ends), keys).groupBy(*keys, "least", "need", (F.col("skip") + DIGITS).alias("width"), F.expr(f"substr(hex, 1, skip + {DIGITS})").alias("bucket")).agg(F.count("*").alias("c"))
        above = F.coalesce(F.sum("c").over(Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        cut = scratch.save(hist.withColumn("above", above).where("above < need and above + c >= need"))
        bounds.append(cut.where("above + c = need").select(*keys, "least", F.col("bucket").alias("bound"), "width"))
        open_ = scratch.save(cut.where("above + c > need").select(*keys, "least", (F.col("need") - F.col("above")).alias("need"), F.col("bucket").alias("bound")))
    limit = bounds[0]
    for more in bounds[1:]:
        limit = limit.unionByName(more)
    limit = scratch.save(limit)
    met = rows.join(small(limit), keys, "left")
    tie = F.col("bound").isNull() | (F.substr(F.hex("item"), F.lit(1), F.col("width")) <= F.col("bound"))
    return met.where(F.col("least").isNull() | (F.col("value") > F.col("least")) | ((F.col("value") == F.col("least")) & tie)).select(rows.columns)


def pair_values(groups: DataFrame, cells: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each two sources of a language; groups: (lang, source, size, base), cells: (lang, source, term, n, p).

    With a term of count 0 at a source's base, the sum of |p - q| over all kept terms is, for sources a and b,
    sum over a's terms of |p - base b| + sum over b's terms of |q - base a| + (size - a's terms - b's terms) * |base a - base b|
    + sum over terms of both of (|p - q| - |p - base b| - |q - base a| + |base a - base b|).
    """
    hist = cells.groupBy(*GROUP, "p").agg(F.count("*").alias("c"))
    b = groups.select("lang", F.col("source").alias("item"), F.col("base").alias("other"))
    beside = hist.join(b, "lang").where("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.expr("c * abs(p - other)")).alias("one"), F.sum("c").alias("own"))
    x = cells.join(groups, GROUP).select("lang", "term", "source", "p", "base")
    y = x.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("base").alias("other"))
    fix = F.expr("abs(p - q) - abs(p - other) - abs(q - base) + abs(base - other)")
    both = x.join(y, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(fix).alias("both"))
    swapped = both.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "both")
    back = beside.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("one").alias("two"), F.col("own").alias("theirs"))
    pair = ["lang", "source", "item"]
    all_ = groups.join(b, "lang").where("source <> item").join(beside, pair, "left").join(back, pair, "left").join(both.unionByName(swapped), pair, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    value = zero("one") + zero("two") + zero("both") + (F.col("size") - zero("own") - zero("theirs")) * F.abs(F.col("base") - F.col("other"))
    return all_.select(*pair, F.coalesce(value, F.lit(0)).cast("long").alias("value"))


def source_divergence(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: distances of sources (part pair) and the terms that a source has more of than its language (part term).

    Null text, lang and source count as empty; a text without terms, and an empty one, still makes its group. Every row is a document, repeated ones
    as well. Other columns are ignored. A language without kept terms gives pairs of value 0. Equal values are ordered by the UTF-8
    bytes of item. Very long texts are counted in slices. An empty table gives no row.
    """
    with Scratch(docs.sparkSession) as scratch:
        counts = scratch.save(term_counts(docs))
        kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= LEAST_DOCS).drop("docs")
        kept = scratch.save(kept)
        langs = kept.groupBy("lang").agg(F.count("*").alias("size"), F.sum("in_lang").alias("all"))
        found = scratch.save(counts.where("term is not null").join(kept, ["lang", "term"]).select(*GROUP, "term", "n", "in_lang"))
        totals = found.groupBy(*GROUP).agg(F.sum("n").alias("total"))
        groups = counts.where("term is null").select(*GROUP).join(langs, "lang", "left").join(totals, GROUP, "left")
        groups = groups.select(*GROUP, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("size", "all", "total")])
        groups = scratch.save(groups.withColumn("base", probability(F.lit(0).cast("long"), F.col("total"), F.col("size"))))
        own = probability(F.col("n"), F.col("total"), F.col("size")).alias("p")
        lang = probability(F.col("in_lang"), F.col("all"), F.col("size")).alias("q")
        cells = scratch.save(found.join(small(groups), GROUP).select(*GROUP, "term", own, lang))
        terms = cells.where("p > q").select(*GROUP, F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
        best = selected(terms, GROUP, top, scratch)
        pairs = pair_values(groups.select(*GROUP, "size", "base"), cells.select(*GROUP, "term", "p"))
        both = pairs.withColumn("part", F.lit("pair")).unionByName(best.withColumn("part", F.lit("term")))
        rank = F.row_number().over(Window.partitionBy("part", *GROUP).orderBy(F.desc("value"), "item"))
        return scratch.keep(both.select(*GROUP, "part", "item", "value", rank.alias("rank")))


DIVERGENCE_SQL = rf"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
t AS (SELECT lang, source, id, unnest(w) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT id) >= {LEAST_DOCS}),
l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY ALL),
q AS (SELECT k.lang, term, 1 + ({SCALE}::HUGEINT * (k.n + {SMOOTHING})) // (l.n + {SMOOTHING} * v) AS q FROM k JOIN l USING (lang)),
g AS (SELECT DISTINCT lang, source FROM d),
full_ AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n
  FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT lang, source, sum(n) AS n FROM full_ GROUP BY ALL),
p AS (
  SELECT f.lang, f.source, f.term, f.n, 1 + ({SCALE}::HUGEINT * (f.n + {SMOOTHING})) // (s.n + {SMOOTHING} * v) AS p
  FROM full_ f JOIN s USING (lang, source) JOIN l USING (lang)),
far AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(far.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= {TOP}
"""
