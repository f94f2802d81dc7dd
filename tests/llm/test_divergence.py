import random
import re
from collections import Counter, defaultdict

import pytest

from scoutline.llm import divergence
from scoutline.llm.divergence import selected, source_divergence
from scoutline.llm.shared import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, p double, value string"


def brute(docs, top=50, least=30):
    counts, df, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, *_ in docs:
        lang, source = lang or "", source or ""
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        langs[lang].add(source)
        counts[lang, source].update(words)
        df[lang].update(set(words))
    kept = {lang: [t for t in df[lang] if df[lang][t] >= least] for lang in langs}
    whole = {lang: sum((counts[lang, s] for s in langs[lang]), Counter()) for lang in langs}

    def probs(lang, c):
        total, v = sum(c[t] for t in kept[lang]), len(kept[lang])
        return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * v) for t in kept[lang]}

    out = []
    for lang, sources in langs.items():
        q, p = probs(lang, whole[lang]), {s: probs(lang, counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept[lang])) for o in sources if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept[lang] if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_a_dense_count(spark, monkeypatch, seed):
    monkeypatch.setattr(divergence, "LEAST_DOCS", 4)
    r = random.Random(seed)
    words = [f"{a}{b}" for a in "aBcDé😀ß" for b in "xyzÄ日q"] + ["I", "İ", "K", "don't", "a1b", "_", "\x7f", "\x80"]
    docs = []
    for i in range(160):
        lang, source = r.choice(["en", "de", None, ""]), r.choice(["s1", "s2", "s3", None, "é", "z" * 40])
        text = r.choice([None, "", "123 \n\t"]) if i % 9 == 0 else r.choice([" ", "\n", "-", "7"]).join(r.choices(words, k=r.choice([1, 30, 200])))
        docs.append((i, text, lang, source, "x", 1, 0.5, "y"))
    docs += docs[:7] + [(None, "only here", "xx", "alone", None, None, None, None), (1, None, "yy", "a", None, None, None, None), (1, "", "yy", "b", None, None, None, None)]
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    for top in (50, 3):
        assert rows(source_divergence(df, top)) == brute(docs, top, 4)


def test_long_texts_in_slices_and_little_held(spark, monkeypatch):
    r = random.Random(3)
    docs = [(i, " ".join(r.choices(["aa", "Bb", "cé", "d" * 50], k=3000 if i % 40 == 0 else 5)), "en", f"s{i % 3}") for i in range(100)]
    parts = [tuple(x) for x in spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").select("lang", "source", "text").collect()]
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({c: [p[i] for p in parts] for i, c in enumerate(("lang", "source", "text"))})
    monkeypatch.setattr(divergence, "SLICE", 64)
    monkeypatch.setattr(divergence, "HELD", 5)
    got = defaultdict(lambda: [0, 0])
    for b in divergence._counted([batch]):
        for row in b.to_pylist():
            at = got[row["lang"], row["source"], row["term"]]
            at[0] += row["n"]
            at[1] += row["docs"]
    want = defaultdict(lambda: [0, 0])
    for lang, source, text in parts:
        want[lang, source, None][1] += 1
        for t, n in Counter(text.lower().split()).items():
            want[lang, source, t][0] += n
            want[lang, source, t][1] += 1
    assert got == want
    assert rows(source_divergence(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"))) == brute(docs)


def test_empty_table(spark):
    assert source_divergence(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("k", [1, 4, 50])
def test_selection_with_ties_and_common_prefixes(spark, k):
    r = random.Random(k)
    data = []
    for g in ("a", "b", "c", ""):
        items = {r.choice(["", "same" * 9, "é", "日本"]) + "".join(r.choices("ab\U0001f600", k=r.randrange(5))) for _ in range(120)}
        top = 1 if g == "b" else 2**30 - 1
        data += [(g, t, r.choice([0, 5, 1023, 1024, top]) if g != "c" else 7) for t in items]
    data += [("few", "x", 3), ("few", "", 3)]
    with Scratch(spark) as scratch:
        got = {tuple(x) for x in selected(spark.createDataFrame(data, "g string, item string, value long"), ["g"], k, scratch).collect()}
    want = set()
    for g in {d[0] for d in data}:
        want |= set(sorted((d for d in data if d[0] == g), key=lambda d: (-d[2], d[1].encode()))[:k])
    assert got == want
