"""Decontamination of passages whose parts stand in another order, against every window."""

import random
from collections import Counter

from factloom.llm import decontamination

WORDS = [f"w{i}" for i in range(400)]


def shingles(w):
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def test_swapped_halves_are_found_as_by_every_window(spark):
    rng = random.Random(8)
    items = [(i, [rng.choice(WORDS) for _ in range(40 + 4 * i)]) for i in range(8)]
    rows = []
    for d in range(40):
        item = list(items[d % 8][1])
        cut = rng.randrange(5, len(item) - 5) if d >= 8 else len(item) // 2
        item = item[cut:] + item[:cut]
        if d % 5 == 4:
            item[3:3] = ["extra"]
        fill = lambda n: [rng.choice(WORDS) for _ in range(n)]
        rows.append((d, fill(100) + item + fill(100 if d % 3 else 0)))
    want = {}
    for d, w in rows:
        for i, q in items:
            for s in range(len(w) - len(q) + 1):
                a, b = shingles(w[s : s + len(q)]), shingles(q)
                sim = sum((a & b).values()) / sum((a | b).values())
                if sim >= 0.8 and sim > want.get((d, i), (0, 0))[0]:
                    want[d, i] = (sim, s)
    assert len(want) >= 8
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(q)) for i, q in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in decontamination.contaminated(docs, bench).collect()}
    assert got.keys() == want.keys() and all(abs(got[k][0] - want[k][0]) < 1e-9 and got[k][1] == want[k][1] for k in want)
    assert decontamination.without_leaks(docs, bench).count() == len(rows) - len({d for d, _ in want})


def test_recall_of_the_index(spark):
    """Windows of similarity 0.8 to 0.9 by changed words, against every window and item: what the Hamming index finds of them."""
    rng = random.Random(31)
    items = [(i, [rng.choice(WORDS) for _ in range(30 + i % 60)]) for i in range(60)]
    rows = []
    for d in range(600):
        w = list(items[d % 60][1])
        for _ in range(1 + d % 2):
            # near an end a changed word touches few shingles, so many windows stay just above the limit
            w[rng.choice([*range(4), *range(len(w) - 4, len(w)), rng.randrange(len(w))])] = "new"
        rows.append((d, [rng.choice(WORDS) for _ in range(30)] + w + [rng.choice(WORDS) for _ in range(30)]))
    want, close = set(), 0
    for d, w in rows:
        i, q = items[d % 60]
        best = 0.0
        for s in range(len(w) - len(q) + 1):
            a, b = shingles(w[s : s + len(q)]), shingles(q)
            best = max(best, sum((a & b).values()) / sum((a | b).values()))
        if best >= 0.8:
            want.add((d, i))
            close += best < 0.9
    assert close > 150
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(q)) for i, q in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).collect()}
    assert not got - want and len(got) >= 0.9 * len(want)
    print("recall", len(got) / len(want), close)


def test_long_texts_copies_and_odd_rows(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    long_ = " ".join(f"x{i % 977}" for i in range(150_000))
    docs = spark.createDataFrame([(1, f"{long_} {passage} {long_}", "k"), (2, passage, "k"), (2, passage, "k"), (None, passage, "k"), (3, None, "k")], "doc_id long, text string, window string")
    bench = spark.createDataFrame([(7, passage), (8, passage.upper()), (None, passage), (9, None)], "item_id long, text string")
    got = sorted(((r.doc_id or -1, r.item_id or -1, r.similarity, r.start_word) for r in decontamination.contaminated(docs, bench).collect()))
    assert got == sorted((d, i, 1.0, 150_000 if d == 1 else 0) for d in (1, 2, -1) for i in (7, 8, -1))
    assert [r.doc_id for r in decontamination.without_leaks(docs, bench).collect()] == [3]
