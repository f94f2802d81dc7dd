import re
from collections import Counter, defaultdict
from itertools import combinations

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from scoutline.llm.decontamination import contaminated  # noqa: E402
from scoutline.llm.mixing import mix_sources  # noqa: E402
from scoutline.llm.ngram_join import ngram_jaccard_join  # noqa: E402
from scoutline.llm.pii import masked  # noqa: E402
from scoutline.llm.quality_forest import quality_rules  # noqa: E402
from scoutline.session import table  # noqa: E402

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_each_stage_does_what_its_operator_says(spark):
    docs = table(spark, SF, "documents").cache()
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        after = stage(spark, docs, SF).cache()
        rows = {r.doc_id: r for r in after.collect()}
        if name == "quality rules":
            assert set(rows) == {r.doc_id for r in quality_rules(docs, table(spark, SF, "labels")).where("kept").collect()}
        elif name == "n-gram Jaccard join":
            assert set(rows) == {r.component_id for r in ngram_jaccard_join(docs, 5, 80, 100).collect()}
        elif name == "benchmark decontamination":
            assert set(rows) == set(before) - {r.doc_id for r in contaminated(docs, table(spark, SF, "benchmark")).collect()}
        elif name == "personal data":
            assert {i: r.text for i, r in rows.items()} == {i: masked(r.text) for i, r in before.items()}
        else:
            assert {i: r.taken for i, r in rows.items()} == {r.doc_id: r.taken for r in mix_sources(docs).collect() if r.taken}
            assert after.columns == [*COLUMNS, "source_size", "target", "taken"]
            continue
        assert after.columns == COLUMNS
        docs = after
    run = {r.doc_id: r.taken for r in corpus_pipeline.run(spark, SF).collect()}
    assert run == {i: r.taken for i, r in rows.items()}


def test_stages_take_empty_and_odd_tables(spark):
    """Null ids, null and empty texts, repeated rows, extra columns with names that stages use themselves."""
    clean = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(5)]
    rows = [(None, clean[0], "en", "a", 1), (None, clean[1], None, None, 1), (1, clean[2], "en", "a", 1), (1, clean[2], "en", "a", 1), (1, clean[3], "en", "a", 1), (2, clean[4], "en", None, 1), (3, None, None, None, None), (4, "", "en", "a", 0)]
    more = "taken string, row string, cut string, _id string, seed string, d string, e string"
    odd = spark.createDataFrame([(*r, *"tuvwxyz") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + more)
    left = {"quality rules": 6, "n-gram Jaccard join": 5, "benchmark decontamination": 5, "personal data": 5, "mixing sources": 5}
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), SF).collect() == []
        own = stage(spark, odd, SF)
        assert len(set(own.columns)) == len(own.columns) and set(odd.columns) <= set(own.columns)
        own.collect()
        docs = stage(spark, docs, SF)
        got = docs.collect()
        assert len(got) == left[name], name
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(0, clean[0]), (0, clean[1]), (1, clean[2]), (1, clean[3]), (2, clean[4])])
    assert all(0 < r.taken <= 120 for r in got)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base_fails(text):
    """The rules of quality by a plain recount."""
    w = words_of(text)
    repeated = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {j for i in range(len(w) - 2) if repeated[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(w) < 50 or 100 * len(inside) > 50 * len(w)


def near_copies(texts):
    """For each id the smallest id that links of 0.8 of five-word shingles lead to, over all pairs."""
    sets = {}
    for i, t in texts.items():
        w = [x.encode().lower() for x in words_of(t)]
        sets[i] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
    home = {i: i for i in sets}
    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((home[a], home[b]))
            home = {i: x if h == y else h for i, h in home.items()}
    return home


def overlapping(texts, items):
    """Ids of texts with 13 tokens of which 11 stand in an item at equal distances, or a whole item of 5 to 12 tokens."""
    split = lambda t: [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
    grams = defaultdict(set)
    own = {i: split(t) for i, t in items.items()}
    for i, w in own.items():
        for p in range(len(w) - 3):
            grams[tuple(w[p : p + 4])].add((i, p))
    out = set()
    for d, t in texts.items():
        w = split(t)
        # Of eleven equal tokens in thirteen, four stand in a row.
        for i, shift in {(i, p - q) for p in range(len(w) - 3) for i, q in grams.get(tuple(w[p : p + 4]), ())}:
            same = [0 <= shift + k < len(w) and w[shift + k] == x for k, x in enumerate(own[i])]
            n = len(same)
            if n >= 13 and max(sum(same[k : k + 13]) for k in range(n - 12)) >= 11 or 5 <= n < 13 and all(same):
                out.add(d)
    return out


def test_stages_against_plain_versions(spark):
    docs = table(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in stages["quality rules"](spark, docs, SF).collect()}
    assert not any(base_fails(texts[i]) for i in kept)
    labels = {r.doc_id: r for r in table(spark, SF, "labels").collect()}
    good = {i for i, r in labels.items() if r.quality and not r.toxic and not base_fails(texts[i])}
    assert len(good & kept) >= 0.95 * len(good)
    home = near_copies(texts)
    assert {r.doc_id for r in stages["n-gram Jaccard join"](spark, docs, SF).collect()} == set(home.values())
    items = {r.item_id: r.text for r in table(spark, SF, "benchmark").collect()}
    gone = overlapping(texts, items)
    assert gone and {r.doc_id for r in stages["benchmark decontamination"](spark, docs, SF).collect()} == set(texts) - gone
    masked_ = {r.doc_id: r for r in stages["personal data"](spark, docs, SF).collect()}
    mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    assert masked_.keys() == texts.keys() and sum(bool(mail.search(t or "")) for t in texts.values()) > 0
    for i, r in masked_.items():
        assert not mail.search(r.text or "") and r.n_chars == len(r.text)
    mixed = stages["mixing sources"](spark, docs, SF).collect()
    size, taken = Counter(), Counter()
    for r in docs.collect():
        size[r.source] += len(words_of(r.text))
    for r in mixed:
        assert 0 < r.taken <= 2 * len(words_of(texts[r.doc_id])) and r.source_size == size[r.source]
        taken[r.source] += r.taken
    assert all(abs(taken[r.source] - r.target) <= 1 for r in mixed)
