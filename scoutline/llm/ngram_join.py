"""N-gram Jaccard join with PartEnum signatures.

A document is the set of its distinct word n-grams. Two sets r, s with Jaccard similarity of at
least num/den differ in at most (den - num) * (|r| + |s|) / (den + num) elements. Sets are put in
size bands; an instance j covers the band [L, U] and those smaller sets that can still link into
it, and fixes k, the largest difference that a pair of the instance can have. The hashed feature
domain is cut into n1 first-level ranges, each of n2 = 2 second-level ranges, and the subsets of
n2 - k2 = 1 of them (k2 = 1) are enumerated: 2 * n1 > k signatures, of which linked pairs share
at least 2 * n1 - k.

Linked pairs usually share more than one signature, and so a document need not publish all of
them. Whichever of its signatures hold the fewest features are left out, as many as
the pair's least number of shared signatures allows; a shared signature has the same content, and so the
same rank, on both sides, whence some shared signature is published by both (the argument is
written out at ``signatures``). This drops empty and weak signatures without losing a pair.

Signatures of distinct sets are grouped; every group is compared with its smallest member, and
components are formed. Members of one group that are still in different components may link past its
smallest member; what they share of their rarest elements tells which of them are compared (see ``across``).
Every comparison is exact on the sets of 64-bit n-gram hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoutline.llm.shared import Scratch, connected_components, parts, small

U = np.uint64
C1, C2, C3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
#: Words that a worker remembers the hash of.
MEMO = 100_000
#: Ratio of the ends of a size band.
BAND = 2.0
#: Elements that a batch of rows holds, about.
ELEMENTS = 100_000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = WordHashes()


def word_hashes() -> WordHashes:
    """One memory for all tasks of a Python worker."""
    return _HASHES


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * C2
    x = (x ^ (x >> U(27))) * C3
    return x ^ (x >> U(31))


def shingles(text: bytes | None, n: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the n-grams; of the whole sequence if there are fewer words; empty without words.

    bytes.lower and bytes.split know ASCII only: A-Z, and the six white-space characters space and \\x09-\\x0D.
    """
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, U)
    w = np.fromiter(map(hashes.__getitem__, words), U, len(words))
    if len(w) < n:
        x = U(0)
        with np.errstate(over="ignore"):
            for y in w:
                x = mix(np.array([x * C1 + y + U(len(w))]))[0]
        return np.array([x])
    x = w[: len(w) - n + 1]
    for i in range(1, n):
        x = x * C1 + w[i : len(w) - n + 1 + i]
        x = x ^ (x >> U(29))
    return np.unique(mix(x))


@cache
def bands(top: int, ratio: float) -> np.ndarray:
    """Lower ends of the size bands up to the one that holds ``top``."""
    ends = [1]
    while ends[-1] <= top:
        ends.append(max(ends[-1] + 1, int(ends[-1] * ratio)))
    return np.array(ends)


@cache
def ranges(n: int) -> np.ndarray:
    """Inner ends of n equal ranges of the 64-bit domain."""
    return np.array([(i << 64) // n for i in range(1, n)], U)


def signatures(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """Published signatures of a sorted set of hashes.

    Let a pair (r, s) of an instance with p signatures differ in d <= k_r, k_s elements, where k_x
    bounds the difference of x to any partner in the instance. At least p - d signatures are
    equal. x leaves out its p - k_x - 1 lowest by (features, value). Equal signatures have equal
    rank keys, so those left out by either side are the lowest of the equal ones, at most
    p - min(k_r, k_s) - 1 < p - d of them: one is left that both publish.
    """
    size, out = len(s), []
    if not size:
        return np.empty(0, np.int64)
    ends = bands(max(1024, 1 << (size * 4).bit_length()), BAND)
    own = int(np.searchsorted(ends, size, "right")) - 1
    total = np.concatenate([np.zeros(1, U), np.cumsum(mix(s + C1), dtype=U)])
    for j in (own, own + 1):
        if j > own and size * den < num * int(ends[j]):
            break
        last = int(ends[j + 1]) - 1
        parts = 2 * ((2 * (den - num) * last // (den + num)) // 2 + 1)
        at = np.concatenate([[0], np.searchsorted(s, ranges(parts)), [size]])
        held = np.diff(at)
        value = mix((total[at[1:]] - total[at[:-1]]) * C2 + np.arange(parts, dtype=U) * C1 + U((j + 1) * int(C3) & (1 << 64) - 1))
        partner = min(last, size * den // num)
        keep = min(parts, (den - num) * (size + partner) // (den + num) + 1)
        if keep < parts:
            value = value[np.lexsort((value, held))[parts - keep :]]
        out.append(value)
    return np.concatenate(out).view(np.int64)


def _bytes(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(name).cast(pa.binary()).to_pylist()


def profile(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, h1, h2): size and 128-bit fingerprint of every document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        for b in parts(batches):
            sets = [shingles(t, n, hashes) for t in _bytes(b, "text")]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(np.array([mix(s + C1).sum(dtype=U) for s in sets], U).view(np.int64)),
                    pa.array(np.array([mix(s ^ C3).sum(dtype=U) for s in sets], U).view(np.int64)),
                ],
                ["doc_id", "n_shingles", "h1", "h2"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long")


def publish(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(sig, doc_id) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        for b in parts(batches):
            ids, texts = b.column("doc_id").to_numpy(), _bytes(b, "text")
            for i in range(0, len(ids), 500):
                sigs = [signatures(shingles(t, n, hashes), num, den) for t in texts[i : i + 500]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(sigs)), pa.array(np.repeat(ids[i : i + 500], [len(s) for s in sigs]))],
                    ["sig", "doc_id"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "sig long, doc_id long")


def _with_texts(pairs: DataFrame, docs: DataFrame, *more: str) -> DataFrame:
    texts = docs.select("doc_id", "text")
    return (
        pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
        .join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
        .select("a", "b", *more, "ta", "tb")
    )


def verified(pairs: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Those of the distinct (a, b) whose sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held = word_hashes(), {}
        for b in parts(batches):
            a, c = b.column("a").to_numpy(), b.column("b").to_numpy()
            ta, tc = b.column("ta").cast(pa.binary()), b.column("tb").cast(pa.binary())
            ok = np.zeros(len(a), bool)
            for i in range(len(a)):
                text = ta[i].as_py()
                if text not in held:
                    if len(held) >= 64:
                        held.clear()
                    held[text] = shingles(text, n, hashes)
                r, s = held[text], shingles(tc[i].as_py(), n, hashes)
                if min(len(r), len(s)) * den >= max(len(r), len(s)) * num:
                    both = len(np.intersect1d(r, s, assume_unique=True))
                    ok[i] = den * both >= num * (len(r) + len(s) - both)
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(c[ok])], ["a", "b"])

    return _with_texts(pairs, docs).mapInArrow(run, "a long, b long")


def elements(docs: DataFrame, n: int) -> DataFrame:
    """(e, b, member, cb, size): a row for each element of the set of every row (doc_id, text, cb).

    member tells apart the texts of an id that has several.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        for batch in parts(batches):
            ids, comps, texts = batch.column("doc_id").to_numpy(), batch.column("cb").to_numpy(), _bytes(batch, "text")
            at = 0
            while at < len(ids):
                # Whole sets, of about ELEMENTS elements together.
                sets, first, held = [], at, 0
                while at < len(ids) and held < ELEMENTS:
                    sets.append(shingles(texts[at], n, hashes))
                    held += len(sets[-1])
                    at += 1
                sizes = [len(x) for x in sets]
                members = [xxhash.xxh3_64_intdigest(t or b"") >> 1 for t in texts[first:at]]
                columns = [np.repeat(np.array(v, np.int64), sizes) for v in (ids[first:at], members, comps[first:at], sizes)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64)), *map(pa.array, columns)], ["e", "b", "member", "cb", "size"])

    return docs.select("doc_id", "text", "cb").mapInArrow(run, "e long, b long, member long, cb long, size long")


def across(rows: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """Pairs (a < b) in different components that may still link, of all sets of ``elements``.

    Elements are ordered, those that few of the sets hold first. Linked sets of x >= y elements share at least
    o = num * (x + y) / (num + den) of them, and so the first one shared is among the first x - o + 1 of the one and
    y - o + 1 of the other, where o >= num * x / den and o >= 2 * num * y / (num + den). Sets publish no more than
    that, and of it only elements that sets of several components hold: those of near copies, which are in one component
    by now, meet nowhere. After the first shared element both sets must have o - 1 more.
    """
    rows = scratch.save(rows)
    common = rows.groupBy("e").agg(F.count("*").alias("c"), (F.min("cb") < F.max("cb")).alias("mixed")).where("c > 1")
    own = Window.partitionBy("b", "member")
    placed = scratch.save(
        rows.join(common, "e")
        .withColumn("i", F.col("size") - F.count("*").over(own) + F.row_number().over(own.orderBy("c", "e")))
        .where(f"mixed and {den} * (i - 1) <= {den - num} * size")
        .select("e", "b", "cb", "size", "i")
    )
    scratch.drop(rows)
    larger = placed.select("e", *[F.col(x).alias(f"{x}1") for x in ("b", "cb", "size", "i")])
    smaller = placed.where(f"{num + den} * (i - 1) <= {den - num} * size").select("e", *[F.col(x).alias(f"{x}2") for x in ("b", "cb", "size", "i")])
    met = larger.join(smaller, "e").where(
        f"b1 <> b2 and cb1 <> cb2 and size1 >= size2 and {num} * size1 <= {den} * size2"
        f" and {num} * (size1 + size2) <= {num + den} * (1 + least(size1 - i1, size2 - i2))"
    )
    return met.select(F.least("b1", "b2").alias("a"), F.greatest("b1", "b2").alias("b")).distinct()


def ngram_jaccard_join(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """Components of the graph that links documents of Jaccard similarity num/den or more.

    Returns doc_id, n_shingles, component_id (smallest doc_id reachable), representative (smallest
    doc_id with an equal set), one row per input row. Rows that share a doc_id are one document. Null text, or text without words: n_shingles
    0 and a component of its own. Null doc_id: linked with nothing, component_id null. Other
    columns are ignored; an empty table gives an empty result. Texts of any length are read whole. A similarity of exactly
    num/den links.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with Scratch(docs.sparkSession) as scratch:
        sets = scratch.save(profile(docs, n))
        full = sets.where("n_shingles > 0 and doc_id is not null")
        reps = full.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).where("c > 1").drop("c")
        held = full.join(small(scratch.save(reps)), ["h1", "h2", "n_shingles"], "left")
        members = scratch.save(held.select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep")))
        copies = members.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("rep")).alias("own")).where("not own").select("doc_id")
        once = docs.where("doc_id is not null").join(small(scratch.save(copies)), "doc_id", "left_anti")
        sigs = scratch.save(publish(once, n, num, den))
        groups = scratch.save(
            sigs.groupBy("sig")
            .agg(F.count("*").alias("c"), F.min("doc_id").alias("lo"), F.bit_xor("doc_id").alias("x"), F.bit_xor(F.xxhash64("doc_id")).alias("f"))
            .where("c > 1")
        )
        # Groups with the same members say the same: one of them is enough.
        large = groups.where("c > 2").groupBy("c", "lo", "x", "f").agg(F.min("sig").alias("sig"))
        large = small(scratch.save(large.select("sig", "lo")))
        # Of two members the other one is what x holds besides the smallest.
        two = groups.where("c = 2").select(F.col("lo").alias("a"), F.expr("x ^ lo").alias("b"), F.lit(False).alias("more"))
        pairs = (
            two.unionByName(sigs.join(large, "sig").select(F.col("lo").alias("a"), F.col("doc_id").alias("b"), F.lit(True).alias("more")))
            .where("a < b").groupBy("a", "b").agg(F.max("more").alias("more"))
        )
        pairs = scratch.save(pairs)
        scratch.drop(sigs, groups)
        needed = scratch.save(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
        texts = scratch.save(once.join(small(needed), "doc_id", "left_semi"))
        links = scratch.save(verified(pairs.select("a", "b"), texts, n, num, den))
        # A doc_id with several texts stands for all of their sets.
        several = members.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("doc_id", "a")
        links = scratch.save(links.unionByName(members.join(several, "doc_id").where("rep <> a").select("a", F.col("rep").alias("b"))))
        first = connected_components(links, scratch)
        of = lambda x: first.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
        # Only members of larger groups can have missed each other, and only in groups whose members are in several components.
        placed = pairs.where("more").join(of("b"), "b", "left").select("a", "b", F.coalesce("cb", "b").alias("cb"))
        split = placed.groupBy("a").agg(F.min("cb").alias("x"), F.max("cb").alias("y")).where("x < y").select("a")
        open_ = placed.join(split, "a", "left_semi").select(F.col("b").alias("doc_id"), "cb").distinct()
        rest = across(elements(texts.join(small(scratch.save(open_)), "doc_id"), n), num, den, scratch)
        rest = scratch.save(rest.join(pairs, ["a", "b"], "left_anti"))
        more = scratch.save(verified(rest, texts, n, num, den))
        if not more.isEmpty():
            first = connected_components(links.unionByName(more), scratch)
        home = members.join(first, F.col("rep") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"), F.col("rep").alias("representative"))
        alone = sets.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("doc_id").alias("representative"))
        return scratch.keep(home.unionByName(alone))


#: DuckDB SQL of op1: all pairs that share a shingle, and all that can be reached. For small tables; doc_ids are distinct and not null.
JACCARD_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(w) < 3 THEN w ELSE w[i : i + 2] END, ' ') g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id a, y.doc_id b, count(*) c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 90 * (x.n + y.n - c)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) b FROM r GROUP BY a) m ON m.a = d.doc_id
"""
