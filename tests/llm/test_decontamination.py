import random
import re
from itertools import combinations

import pytest

from scoutline.llm import decontamination
from scoutline.llm.decontamination import MASKS, SHORTEST, SPAN, SUBSTITUTIONS, WINDOW, contaminated, drop_contaminated


def test_masks_hit_every_window_with_two_substitutions():
    for bad in combinations(range(WINDOW), SUBSTITUTIONS):
        assert any(all(p + o not in bad for o, c in enumerate(m) if c == "1") for m in MASKS for p in range(WINDOW - SPAN + 1))


def brute(docs, items, shortest=SHORTEST):
    found = {}
    split = lambda t: [w for w in re.split(r"[^a-z0-9é]+", t.lower()) if w]
    for d, text in docs:
        for i, item in items:
            w, it = split(text or ""), split(item or "")
            n = min(WINDOW, len(it))
            need = WINDOW - SUBSTITUTIONS if len(it) >= WINDOW else n
            if d is None or len(it) < shortest:
                continue
            for shift in range(-len(it), len(w)):
                score = [sum(0 <= shift + t < len(w) and w[shift + t] == it[t] for t in range(s, s + n)) for s in range(len(it) - n + 1)]
                if max(score) >= need:
                    first = shift + next(s for s, x in enumerate(score) if x >= need)
                    pos, best, count = found.get((d, i), (first, 0, 0))
                    found[d, i] = (min(pos, first), max(best, *score), count + 1)
    return found


def test_same_as_all_alignments(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(80)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.choice([4, 5, 8, 9, 12, 13, 20, 40])))) for i in range(16)] + [(99, None), (98, "")]
    docs = [(500, None), (501, ""), (502, "Short")]
    for d in range(60):
        text = [r.choice(words) for _ in range(r.choice([0, 10, 60]))]
        own = r.choice(items[:16])[1].split()
        for _ in range(r.choice([0, 1, 2, 3, 5])):
            own[r.randrange(len(own))] = "other"
        text += own[r.choice([0, 0, 3]) :] + [r.choice(words) for _ in range(r.choice([0, 8]))]
        docs.append((d, r.choice([" ", ", ", "\n"]).join(text).upper()))
    docs.append((60, " ".join([items[5][1]] * 3)))
    df = spark.createDataFrame([(*x, "c") for x in [*docs, docs[10], (None, items[5][1])]], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    got = {(x.doc_id, x.item_id): (x.doc_pos, x.best_matches, x.n_alignments) for x in contaminated(df, bench).collect()}
    assert got == want and len(got) > 20
    left = [x.doc_id for x in drop_contaminated(df, bench).collect()]
    assert set(left) == {d for d, _ in docs} - {d for d, _ in want}
    assert contaminated(df.limit(0), bench).collect() == [] == contaminated(df, bench.limit(0)).collect()
    assert drop_contaminated(df, bench.limit(0)).count() == df.count()


def test_rows_without_or_with_repeated_ids_are_judged_by_their_text(spark):
    item = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(None, item, 1), (None, "clean text", 2), (None, None, 3), (7, "x " + item, 4), (7, "other", 5), (8, "", 6)], "doc_id long, text string, d long")
    bench = spark.createDataFrame([(1, item), (2, "w1 w2")], "item_id long, text string")
    left = drop_contaminated(df, bench)
    assert left.columns == df.columns and sorted(r.d for r in left.collect()) == [2, 3, 5, 6]


@pytest.mark.parametrize("most", [decontamination.BROADCAST_SEEDS, 0])
def test_short_items_where_asked_and_large_benchmarks(spark, monkeypatch, most):
    monkeypatch.setattr(decontamination, "BROADCAST_SEEDS", most)
    r = random.Random(9)
    words = [f"w{i}" for i in range(12)]
    items = [(1, "w1"), (2, "w2 w3"), (3, "to be or not"), (4, " ".join(r.choice(words) for _ in range(7))), (5, " ".join(r.choice(words) for _ in range(16))), (6, "w9 w9 w9"), (7, "")]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.choice([0, 1, 3, 40])))) for i in range(30)] + [(90, "whether to be or not to be"), (91, "x " + items[3][1]), (92, items[4][1] + " w1"), (93, "w " * 5000 + items[4][1].replace("w1 ", "y ", 1))]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for shortest in (0, 1, 3, SHORTEST):
        got = {(x.doc_id, x.item_id): (x.doc_pos, x.best_matches, x.n_alignments) for x in contaminated(df, bench, shortest).collect()}
        assert got == brute(docs, items, max(shortest, 1))


def test_scripts_without_spaces(spark):
    item = "今天天气很好我们一起去公园散步吧"
    changed = item[:5] + "坏" + item[6:]
    df = spark.createDataFrame([(1, "前文。" + item + "后文"), (2, changed), (3, "今天我们去公园"), (4, "ภาษา " + item[:6])], "doc_id long, text string")
    got = contaminated(df, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.doc_pos) for r in got) == [(1, 2), (2, 0)]
