"""The training-data operators against brute force, exact round trips and edge cases."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from factloom.llm import chat_formatting, decontamination, language_id, lm_scoring, packing, quality, simhash, token_counts, toxicity, warc

BPE = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, key string"
WORDS = [f"w{i}" for i in range(400)]


def documents(spark, rows):
    """Rows (doc_id, text[, lang]) with columns whose names clash with inner ones."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", "s", 0, 7, "k") for r in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    long_ = " ".join(rng.choice(WORDS) for _ in range(30_000))
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "One two three."), (4, "one TWO three."), (5, long_), (5, long_), (None, "no id at all here"), (6, long_ + " tail"), (7, "ß é ñ 中文 İ ²"), (8, None, None), (9, "x " * 50), (10, " ")]
    return rows, documents(spark, rows)


def naive_fingerprint(text, k=4):
    words = [w for w in (text or "").encode().lower().replace(b"\x0b", b" ").split()]
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def naive_components(fps, ids, radius):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            r = find(i)
            least[r] = min(d, least.get(r, d))
    return [least.get(find(i)) for i in range(len(fps))]


def test_simhash_matches_brute_force(spark, odd):
    rng = random.Random(1)
    base = [" ".join(rng.choice(WORDS) for _ in range(300)) for _ in range(20)]
    rows = list(odd[0])
    for i, b in enumerate(base):
        w = b.split()
        for c in range(6):
            v = list(w)
            for _ in range(c):
                v[rng.randrange(len(v))] = "zz"
            rows.append((100 + 10 * i + c, " ".join(v)))
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(documents(spark, rows)).collect()), key=str)
    fps = [naive_fingerprint(r[1]) for r in rows]
    want = sorted(((r[0] is None, r[0] or 0, f, c) for r, f, c in zip(rows, fps, naive_components(fps, [r[0] for r in rows], 4), strict=True)), key=str)
    assert got == want
    assert len({c for *_, c in got}) < len(rows) - 20


def test_grid_finds_every_pair(spark):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for f in list(fps)[:150]:
        g = f
        for b in rng.sample(range(64), rng.randint(1, 5)):
            g ^= 1 << b
        fps.add(g)
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    df = spark.createDataFrame([(f, f) for f in fps], "fp long, root long")
    for radius in (0, 1, 3, 4, 5):
        want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius}
        assert {tuple(r) for r in simhash.links_across(df, radius).collect()} == want
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_dense_groups_have_the_components_of_all_their_pairs(spark, monkeypatch):
    rng = random.Random(12)
    prints = []
    for _ in range(4):
        center = rng.getrandbits(64)
        for _ in range(250):
            f = center
            for b in rng.sample(range(64), rng.randint(0, 9)):
                f ^= 1 << b
            prints.append(f)
    prints += rng.sample(prints, 100)
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(prints)]
    monkeypatch.setattr(simhash, "fingerprints", lambda *_: spark.createDataFrame(rows, "doc_id long, fp long"))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(documents(spark, [])).collect()}
    assert got == dict(enumerate(naive_components(prints, list(range(len(prints))), 4)))
    assert len(set(got.values())) > 4


def test_token_counts_equal_the_library(spark, odd):
    rows = [*odd[0], (20, "<|endoftext|> a"), (21, "it's a''s b'RE ΣΑΣ İx"), (22, "don’t … “x”")]
    tok = token_counts.library(BPE)
    want = sorted(((r[0] or -1, len((r[1] or "").encode()), len(tok.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows), key=str)
    got = token_counts.count_tokens(documents(spark, rows), BPE)
    assert sorted(((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in got.collect()), key=str) == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got.collect())


def test_packing_round_trip(spark, odd):
    rows = [(i, t) for i, t, *_ in odd[0]] + [(100 + i, "word " * (i % 700)) for i in range(300)]
    tok = token_counts.library(BPE)
    out = packing.pack_documents(documents(spark, rows), BPE).collect()
    ids = [[*tok.encode(t or "", add_special_tokens=False).ids, 1] for _, t in rows]
    want = Counter((d, p, 4096 * p, len(x[4096 * p : 4096 * (p + 1)]), zlib.crc32(np.array(x[4096 * p : 4096 * (p + 1)], "<u4").tobytes())) for (d, _), x in zip(rows, ids, strict=True) for p in range(-(-len(x) // 4096)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= math.ceil(sum(map(len, ids)) / 4096) + 1
    assert packing.pack_documents(documents(spark, []), BPE).count() == 0


def naive_best_fit(lengths, size, open_bins):
    """The packing rule by lists of open bins: (free, when opened last in its level, bin)."""
    open_, n, out = [], 0, []
    for step, x in enumerate(lengths):
        fits = [b for b in open_ if b[0] >= x]
        if fits:
            least = min(b[0] for b in fits)
            b = max((b for b in fits if b[0] == least), key=lambda b: b[1])
            open_.remove(b)
        else:
            if len(open_) == open_bins:
                least = min(b[0] for b in open_)
                open_.remove(max((b for b in open_ if b[0] == least), key=lambda b: b[1]))
            b, n = (size, step, n), n + 1
        out.append((b[2], size - b[0]))
        if b[0] > x:
            open_.append((b[0] - x, step, b[2]))
    return out


def test_best_fit_equals_the_rule_by_lists():
    rng = random.Random(21)
    for size, open_bins in ((10, 1), (10, 2), (50, 5), (200, 30)):
        lengths = [rng.randint(1, size) if rng.random() < 0.5 else rng.randint(1, max(1, size // 5)) for _ in range(600)]
        bins = packing.BestFit(size, open_bins)
        cut = rng.randrange(600)
        got = [list(zip(*bins.place(part), strict=True)) for part in (lengths[:cut], lengths[cut:])]
        assert got[0] + got[1] == naive_best_fit(lengths, size, open_bins)
        assert bins.n_open <= open_bins and bins.closings


def test_best_fit_closes_the_fullest():
    bins, places = packing.BestFit(10, 2).place([6, 5, 4, 5, 9, 1])
    assert bins == [0, 1, 0, 1, 2, 2] and places == [0, 0, 6, 5, 0, 9]
    assert packing.BestFit(10, 2).place([6, 7, 5, 3])[0] == [0, 1, 2, 0]  # 7 was fullest and closed


def test_sequences_are_within_a_hundredth_of_the_ideal():
    rng = np.random.default_rng(22)
    lengths = np.minimum(4096, rng.lognormal(6, 1.2, 50_000).astype(int) + 1).tolist()
    bins = packing.BestFit(4096, packing.OPEN_BINS)
    bins.place(lengths)
    assert bins.closings and bins.n_bins <= 1.01 * sum(lengths) / 4096


def test_lm_scores(spark, odd):
    rng = random.Random(4)
    rows = [*odd[0], *((100 + i, " ".join(rng.choice(WORDS[:80]) for _ in range(rng.randint(0, 60)))) for i in range(200))]
    got = lm_scoring.score_documents(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    tokens = [[*(t or "").encode().lower().split(), None] for _, t, *_ in rows]
    train = [x for (d, *_), x in zip(rows, tokens, strict=True) if d is not None and zlib.crc32(str(d).encode()) % 5 != 1]
    c = Counter(w for x in train for w in x)
    n, v = sum(c.values()), len(c)
    want = sorted((d or -1, len(x), sum(c[w] > 0 for w in x), round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x), 6)) for (d, *_), x in zip(rows, tokens, strict=True))
    assert sorted((r.doc_id or -1, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == n and r.score < 0 for r in got)
    assert lm_scoring.score_documents(documents(spark, [])).count() == 0


def test_lm_mixture_is_a_distribution():
    rng = np.random.default_rng(0)
    for order in (1, 2, 3):
        buckets = max(1, order - 1) * lm_scoring.CONTEXTS
        w = lm_scoring.learn_weights(rng.integers(0, buckets, 500), rng.integers(0, lm_scoring.LEVELS**order, 500), rng.integers(1, 9, 500), 1e-4, order)
        assert np.allclose(w.sum(axis=1), 1, atol=1e-3) and (w >= 0).all()


def naive_model_scores(rows, order):
    """The model's score of each row by counters of word tuples: the same buckets, levels and rounds of EM."""
    tokens = [[None] * order + [w.encode() for w in (t or "").lower().split()] + ["end"] for _, t in rows]
    folds = [zlib.crc32(str(d).encode()) % 5 for d, _ in rows]

    def counts(used):
        grams, contexts = Counter(), Counter()
        for x, f in zip(tokens, folds, strict=True):
            for at in range(order, len(x)) if f in used else ():
                for k in range(1, order + 1):
                    grams[tuple(x[at - k + 1 : at + 1])] += 1
                    contexts[tuple(x[at - k + 1 : at])] += 1
        return grams, contexts

    def estimate(x, at, grams, contexts):
        found, context = [], 0
        for k in range(1, order + 1):
            h = tuple(x[at - k + 1 : at])
            found.append(grams[(*h, x[at])] / max(1, contexts[h]))
            if k > 1 and contexts[h]:
                context = (k - 2) * 14 + min(13, int(math.log2(contexts[h] + 1)))
        return context, found[::-1]

    grams, contexts = counts({2, 3, 4})
    vocabulary = sum(1 for g in grams if len(g) == 1)
    seen = Counter()
    for x, f in zip(tokens, folds, strict=True):
        for at in range(order, len(x)) if f == 0 else ():
            context, found = estimate(x, at, grams, contexts)
            seen[context, tuple(min(round(-lm_scoring.STEPS * math.log2(p)) + 1, 255) if p else 0 for p in found)] += 1
    buckets = max(1, order - 1) * 14
    weights = [[0.1 / order] * (order - 1) + [0.8, 0.2 - 0.1 * (order - 1) / order] for _ in range(buckets)]
    for _ in range(60):
        total = [[0.0] * (order + 1) for _ in range(buckets)]
        for (context, levels), n in seen.items():
            share = [w * p for w, p in zip(weights[context], [*(2 ** (-(q - 1) / lm_scoring.STEPS) if q else 0.0 for q in levels), 1 / (vocabulary + 1)], strict=True)]
            for k in range(order + 1):
                total[context][k] += n * share[k] / sum(share)
        for b, own in enumerate(total):
            if sum(own):
                prior = [1e-6] * order + [1e-3]
                weights[b] = [(x + y) / (sum(own) + sum(prior)) for x, y in zip(own, prior, strict=True)]
    grams, contexts = counts({0, 2, 3, 4})
    vocabulary = sum(1 for g in grams if len(g) == 1)
    out = {}
    for (d, _), x in zip(rows, tokens, strict=True):
        out[d] = 0.0
        for at in range(order, len(x)):
            context, found = estimate(x, at, grams, contexts)
            out[d] += math.log10(sum(w * p for w, p in zip(weights[context], [*found, 1 / (vocabulary + 1)], strict=True)))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_model_scores_equal_brute_force(spark, order, monkeypatch):
    rng = random.Random(14)
    rows = [(i, " ".join(rng.choice(WORDS[: 5 + i % 40]) for _ in range(rng.randint(0, 40)))) for i in range(250)]
    monkeypatch.setattr(lm_scoring, "KEYS", 500)  # several ranges
    monkeypatch.setattr(lm_scoring, "BLOCK", 17)
    got = {r.doc_id: r.score for r in lm_scoring.score_documents(documents(spark, rows), order).collect()}
    want = naive_model_scores(rows, order)
    assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-6 for d in want)


def test_lm_longer_contexts_predict_better(spark):
    rng = random.Random(15)
    chain = {w: rng.sample(WORDS[:60], 3) for w in WORDS[:60]}

    def text():
        w, out = rng.choice(WORDS[:60]), []
        for _ in range(80):
            out.append(w)
            w = rng.choice(chain[w])
        return " ".join(out)

    docs = documents(spark, [(i, text()) for i in range(200)])
    total = [sum(r.score for r in lm_scoring.score_documents(docs, order).where("held_out").collect()) for order in (1, 2)]
    assert total[1] > total[0] / 2


def test_decontamination_against_brute_force(spark):
    rng = random.Random(6)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(3, 40)))) for i in range(12)] + [(90, None), (91, ""), (92, "solo")]
    rows = []
    for d in range(60):
        w = [rng.choice(WORDS) for _ in range(80)]
        if d % 2:
            part = items[d % 12][1].upper().split()
            if d % 3 == 0 and len(part) > 30:
                part[5] = "changed"
            w[10:10] = part
        rows.append((d, "\n".join(w)))
    rows += [(200, None), (201, ""), (202, items[0][1]), (203, "Solo!"), (None, items[1][1])]

    def shingled(w):
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    want = {}
    for d, text in rows:
        w = (text or "").lower().replace("!", "").split()
        for i, item in items:
            q = (item or "").split()
            for s in range(max(1, len(w) - len(q) + 1)) if q and w else ():
                a, b = shingled(w[s : s + len(q)]), shingled(q)
                sim = sum((a & b).values()) / sum((a | b).values())
                if sim >= 0.8 and sim > want.get((d, i), (0, 0))[0]:
                    want[d, i] = (sim, s)
    docs, bench = documents(spark, rows), spark.createDataFrame([(*x, "k") for x in items], "item_id long, text string, hash string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in decontamination.contaminated(docs, bench).collect()}
    assert got.keys() == want.keys() and all(abs(got[k][0] - want[k][0]) < 1e-9 for k in want)
    kept = {r.doc_id for r in decontamination.without_leaks(docs, bench).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _ in want}
    assert decontamination.contaminated(docs, bench.limit(0)).count() == 0 and decontamination.contaminated(docs.limit(0), bench).count() == 0


def test_decontamination_with_a_large_benchmark_takes_the_join(spark, monkeypatch):
    docs = documents(spark, [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (2, "z y x w v u")])
    bench = spark.createDataFrame([(7, "b c d e f g")], "item_id long, text string")
    first = decontamination.contaminated(docs, bench).collect()
    monkeypatch.setattr(decontamination, "LITERAL_SHINGLES", 0)
    assert decontamination.contaminated(docs, bench).collect() == first and [(r.doc_id, r.start_word) for r in first] == [(1, 1)]


def test_quality_counts_and_verdicts(spark, odd):
    def naive(text):
        w = (text or "").replace("\x0b", " ").replace("\f", " ").replace("\r", " ").replace("\t", " ").replace("\n", " ").split(" ")
        w = [x for x in w if x]
        lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\r\v\f")]
        g = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        marks = {j for i in range(len(w) - 4) if g[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(marks)

    rows = [*odd[0], (30, "a b c d e f a b c d e x\nq\nq\n \n"), (31, "# $ %")]
    got = quality.quality_rules(documents(spark, rows)).collect()
    key = lambda r: (r[0] or -1, *r[1:])
    assert sorted(key((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in got) == sorted(key((d, *naive(t))) for d, t, *_ in rows)
    assert all(not r.kept for r in got if r.base_failed)
    assert quality.quality_rules(documents(spark, [])).count() == 0
    words = [str(i % 7) for i in range(120_000)]
    assert quality.repeated_words(words) == 120_000 and quality.repeated_words([str(i) for i in range(110_000)]) == 0


def test_quality_rejects_what_is_far_out(spark):
    rng = random.Random(8)
    plain = [(i, " ".join(rng.choice(WORDS) for _ in range(60))) for i in range(300)]
    junk = [(1000 + i, " ".join(rng.choice(WORDS) + "###" for _ in range(60))) for i in range(20)]
    docs = documents(spark, plain + junk)
    kept = {r.doc_id for r in quality.keep_good(docs).collect()}
    assert kept == {i for i, _ in plain}
    assert quality.keep_good(docs).columns == docs.columns


def naive_mcd(x, starts=200):
    """Raw minimum covariance determinant by many random starts of full concentration, with the module's floors."""
    rng, h, best = np.random.default_rng(3), int(np.ceil(quality.CORE * len(x))), (np.inf, None)

    def fit(rows):
        cov = np.cov(rows.T, bias=True)
        return rows.mean(axis=0), cov + np.diag(np.maximum(quality.FLOOR**2 - np.diag(cov), 0) + 1e-9)

    for _ in range(starts):
        mean, cov = fit(x[rng.choice(len(x), 8, replace=False)])
        last = np.inf
        while True:
            diff = x - mean
            near = np.argsort(np.einsum("ij,jk,ik->i", diff, np.linalg.inv(cov), diff))[:h]
            mean, cov = fit(x[near])
            logdet = np.linalg.slogdet(cov)[1]
            if logdet >= last - 1e-9:
                break
            last = logdet
        if last < best[0]:
            best = last, mean
    return best


def test_quality_determinants_are_as_small_as_by_many_starts(spark):
    """Of a cloud and a far fifth, the estimate is that of the cloud alone."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(900):
        far = i % 5 == 0
        n = 200
        rows.append((i, "en", "s", n, int(rng.normal(1900 if far else 1000, 60)), int(max(0, rng.normal(160 if far else 10, 8))), int(far) * 5, int(max(0, rng.normal(30 if far else 4, 3))), 20))
    stats = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long")
    x = np.array([r.x for r in stats.select(quality.vector().alias("x")).collect()])
    logdet, mean = naive_mcd(x)
    params = {}
    real = quality.concentrated

    def watched(rows, params_, levels, core, scale):
        if core is None:
            params.update({r.key: r for r in params_.collect()})
        return real(rows, params_, levels, core, scale)

    quality.concentrated = watched
    try:
        fitted = quality.fit_outliers(stats).collect()
    finally:
        quality.concentrated = real
    got = params["3"]
    scale = quality.CORE_SCALE
    assert len(fitted) == 1 and len(params) == 3
    # the module scales the covariance before the floors, so its determinant is at most that of the scaled one
    assert got.logdet <= logdet + 4 * math.log(scale) + 0.05
    assert np.abs(np.array(got.mean) - mean).max() < 0.1


def test_quality_verdicts_do_not_depend_on_how_parameters_are_joined(spark, monkeypatch):
    rng = random.Random(18)
    rows = [(i, " ".join(rng.choice(WORDS) + "#" * (i % 50 == 0) * 3 for _ in range(40 + i % 9)), "en" if i % 3 else "de") for i in range(240)]
    docs = documents(spark, rows)
    first = sorted((r.doc_id, r.kept, round(r.distance, 6)) for r in quality.quality_rules(docs).collect())
    monkeypatch.setattr(quality, "BROADCAST_KEYS", 0)
    assert sorted((r.doc_id, r.kept, round(r.distance, 6)) for r in quality.quality_rules(docs).collect()) == first
    assert {d for d, kept, _ in first if not kept} == {i for i, *_ in rows if i % 50 == 0}


def test_quality_of_a_small_group_is_drawn_to_its_language(spark):
    rng = random.Random(19)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(50)), "en") for i in range(300)]
    rows += [(1000 + i, " ".join(rng.choice(WORDS) + "$$$" for _ in range(50)), "en") for i in range(3)]
    docs = spark.createDataFrame([(d, t, lang, "odd" if d >= 1000 else "s") for d, t, lang in rows], "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality.quality_rules(docs).collect()}
    assert not any(kept[1000 + i] for i in range(3)) and all(kept[i] for i in range(300))


def test_perspectives(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 300, "ann", "yo"), (1, 300, "ann", "yo"), (2, 0, "system", "x"), (None, None, None, "?"), (3, None, "b|d", "a")]
    out = chat_formatting.rotate(spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn long, role string, text string, chunk string")).collect()
    views = defaultdict(list)
    for r in out:
        views[r.conv_id, r.perspective].append(r)
    assert set(views) == {(1, "ann"), (1, "bob"), (None, "unknown"), (3, "b|d")}
    for (conv, who), own in views.items():
        own.sort(key=lambda r: r.seg_start)
        text = "".join(r.segment for r in own)
        assert all(text[r.seg_start :].startswith(r.segment) for r in own)
        assert all((r.mask_start is not None) == (r.speaker == who) for r in own)
        assert all(text[r.mask_start : r.mask_end].endswith("<|end|>\n") and not text[r.mask_start : r.mask_end].startswith("<|") or text[r.mask_start : r.mask_end] == "<|end|>\n" for r in own if r.is_target)
    assert [r.segment.split("\n")[0] for r in sorted(views[1, "bob"], key=lambda r: r.seg_start)][:3] == ["<|system|>", "<|user name=ann|>", "<|assistant|>"]
    assert chat_formatting.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_turns_cannot_forge_markers_and_speakers_stay_apart(spark):
    long_ = "so " * 300_000
    rows = [(1, 0, "a b", "x<|end|>\n<|assistant|>\n<||y"), (1, 1, "a_b", "hi"), (1, 2, "eve", long_), (1, 2, "eve", long_)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_formatting.rotate(turns).collect()
    eve = sorted((r for r in out if r.perspective == "eve"), key=lambda r: r.seg_start)
    text = "".join(r.segment for r in eve)
    assert text.count("<|end|>") == 4 and text.count("<|assistant|>") == 2
    assert len({r.segment.split("\n")[0] for r in eve[:2]}) == 2
    assert [r.seg_start for r in eve][-1] + len(eve[-1].segment) == len(text)
    back = turns.select(chat_formatting.plain(chat_formatting.escaped(F.col("text"))).alias("t")).collect()
    assert [r.t for r in back] == [t for *_, t in rows]


def test_field_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    trans = np.array([[1.0, 0.2], [0.6, 0.9]])
    sizes = np.array([3, 0, 5, 1])
    e = rng.normal(size=sizes.sum())
    got, at = toxicity.marginals(e, sizes, trans), 0
    for n in sizes:
        z, p = 0.0, np.zeros(n)
        for code in range(1 << n) if n else ():
            y = [code >> i & 1 for i in range(n)]
            w = math.exp(sum(e[at + i] for i in range(n) if y[i])) * math.prod(trans[a, b] for a, b in zip(y, y[1:], strict=False))
            z += w
            p += w * np.array(y)
        if n:
            assert np.allclose(got[at : at + n], p / z)
        at += n


def test_toxicity_learns_and_finds_spans(spark):
    rng = random.Random(9)
    bad = ["vile", "scummy"]
    rows, labels = [], []
    for i in range(400):
        w = [rng.choice(WORDS) for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                w[rng.randrange(40)] = rng.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, None), (1001, ""), (None, "vile words")]
    labels += [(1000, 1, None), (None, 1, 1)]
    docs, lab = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, lab)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(400) if got[i].held_out]
    assert len(held) > 50 and all(got[i].predicted == (i % 4 == 0) for i in held)
    assert 0 <= got[1000].score < 0.3 and got[None].held_out and got[None].predicted == 1
    texts = dict(rows)
    for r in toxicity.spans(docs.where("doc_id < 40"), model).collect():
        assert all(w in bad for w in texts[r.doc_id][r.start : r.end].split())
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == 300 + 2
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.fit(docs, lab.limit(0)) is not None


def test_toxicity_learns_from_long_texts(spark):
    rng = random.Random(25)
    rows, labels = [], []
    for i in range(120):
        w = [rng.choice(WORDS) for _ in range(9_000 if i % 2 else 30)]
        if i % 3 == 0:
            for _ in range(len(w) // 15):
                w[rng.randrange(len(w))] = "vilest" if i % 2 else "scummy"
        rows.append((i, " ".join(w)))
        labels += [(i, 1, int(i % 3 == 0))] * (1 + i % 2)
    docs, lab = documents(spark, [*rows, rows[3]]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, lab)).collect()
    assert len(got) == 121 and all(r.predicted == (r.doc_id % 3 == 0) for r in got)


def test_field_learns_by_the_gradient_of_its_likelihood():
    """The expected counts behind a step equal those of all labellings of a short sequence."""
    rng = np.random.default_rng(26)
    e, trans = rng.normal(size=6), np.exp(rng.normal(size=(2, 2)))
    sizes = np.array([6])
    p = toxicity.marginals(e, sizes, trans)
    got = toxicity.pair_counts(e, p, sizes, trans, np.arange(5))
    z, want = 0.0, np.zeros((2, 2))
    for code in range(64):
        y = [code >> i & 1 for i in range(6)]
        w = math.exp(sum(e[i] for i in range(6) if y[i])) * math.prod(trans[a, b] for a, b in zip(y, y[1:], strict=False))
        z += w
        for a, b in zip(y, y[1:], strict=False):
            want[a, b] += w
    assert np.allclose(got, want / z)


def test_languages(spark):
    rng = random.Random(10)
    alphabets = {"aa": "abcde", "bb": "efghi", "cc": "klmno"}

    def text(lang, n):
        return " ".join("".join(rng.choice(alphabets[lang]) for _ in range(6)) for _ in range(n))

    rows = [(i, text(lang, 30), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 60)]
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "12 ² !", "aa"), (903, text("aa", 20), None), (904, text("aa", 60) + " " + text("cc", 40), None), (None, text("bb", 9), "bb")]
    docs = documents(spark, rows)
    got = {r.doc_id: r for r in language_id.predict(docs, *language_id.fit(docs)).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows if i is not None and i < 900)
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "aa"]
    assert got[904].langs == "aa,cc" and 0.5 < got[904].score < 0.7 and got[None].lang_pred == "bb"
    none = language_id.predict(docs, *language_id.fit(docs.limit(0))).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_language_sets_are_the_best_of_all(spark):
    """Against every subset, each fitted by many rounds of EM from the same likelihoods."""
    from itertools import combinations

    rng = np.random.default_rng(23)
    n = np.array([30, 40, 50, 60])
    owner = np.repeat(np.arange(4), n)
    like = np.exp(rng.normal(-6, 1, (len(owner), 5)))
    mixes = [[0], [1, 3], [0, 2, 4], [0, 1, 2, 4]]
    for i, t in enumerate(owner):
        like[i, mixes[t][i % len(mixes[t])]] = 1.0
    got = language_id.select(like, owner, n)
    for t in range(4):
        own, best = like[owner == t], (-np.inf, None)
        for size in range(1, 6):
            for langs in combinations(range(5), size):
                p = np.full(size, 1 / size)
                for _ in range(200):
                    r = own[:, langs] * p
                    p = (r / r.sum(axis=1, keepdims=True)).mean(axis=0)
                value = np.log(own[:, langs] @ p).sum() - language_id.PENALTY * (size - 1) * np.log(n[t] + 1.0)
                best = max(best, (value, langs))
        assert tuple(np.flatnonzero(got[t] > 0)) == best[1] == tuple(mixes[t])


def test_languages_with_marks_ties_and_long_texts(spark):
    assert language_id.letters("हिन्दी 12 \u0301x") == " हिन्दी x "
    assert language_id.letters("\u0301\u0301 7") == "  "
    rng = random.Random(24)
    word = lambda a: "".join(rng.choice(a) for _ in range(6))
    rows = [(i, " ".join(word("abc" if i % 2 else "xyz") for _ in range(20)), "aa" if i % 2 else "zz") for i in range(80)]
    rows += [(300, "q " * 40, None), (301, " ".join(word("abc") for _ in range(60_000)), None), (302, "999", "empty"), (303, "999", "empty"), (305, "999", "empty")]
    docs = documents(spark, rows)
    langs, log_p = language_id.fit(docs)
    assert langs == ["aa", "zz"]
    got = {r.doc_id: r for r in language_id.predict(docs, langs, log_p).collect()}
    assert got[301].lang_pred == "aa" and got[301].score > 0.99
    tie = language_id.infer(["qq qq"], np.zeros((language_id.BUCKETS, 2), np.float32))
    assert tie[0].tolist() == [0] and abs(tie[1][0] - 0.5) < 1e-9
    assert language_id.predict(docs.limit(0), langs, log_p).count() == 0


PAGES = [
    ('<script>var a="<!--";</script><p>kept?</p><!-- c -->', "kept?"),
    ("a<script>var x=1;", "a"),
    ('<a title="x > y">link</a>', "link"),
    ("<a href='it\"s>'>q</a>", "q"),
    ('<div a=b">x</div>', "x"),
    ("<p>if a <b and c> d</p>", "if a d"),
    ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
    ("&eacute;&mdash;&amp;lt;&copy", "é—&lt;©"),
    ("<title>a <b> c</title>x", "a <b> c\nx"),
    ("x<!-->y<!--->z<!-- a --!>w<!-- open", "xyzw"),
    ("a<template>b<template>c</template>d</template>e", "ae"),
    ("a<noscript>b<br>c</noscript>d</ x>e", "ade"),
    ("<br/>a<br>b<p open", "a\nb"),
    ("<style>p{}</STYLE >z<script>a</scripts></script>y", "zy"),
    ("<", "<"),
    ("", ""),
]


@pytest.mark.parametrize("page, text", PAGES)
def test_page_text(page, text):
    assert warc.page_text(page) == text


def test_page_text_equals_the_parser_of_the_library():
    """On pages of the tables, a parser that shares no code: html.parser with its own tokens."""
    from html.parser import HTMLParser

    import duckdb

    class Text(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.skip = [], 0

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style")
            self.out.append("\n" if tag in warc.BLOCKS else "")

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style")
            self.out.append("\n" if tag in warc.BLOCKS else "")

        def handle_data(self, data):
            self.out.append("" if self.skip else data)

    pages = duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()
    n = 0
    for (html,) in pages:
        if not html.rstrip().endswith("</html>"):
            continue  # the parser keeps what a cut page leaves open
        parser = Text()
        parser.feed(html)
        parser.close()
        lines = [" ".join(x.replace("\xa0", " ").split()) for x in "".join(parser.out).split("\n")]
        assert warc.page_text(html) == "\n".join(x for x in lines if x)
        n += 1
    assert n > 200


def test_warc_of_empty_and_long_pages(spark):
    schema = "page_id long, url string, html string, text string"
    assert warc.derive(warc.responses(spark.createDataFrame([], schema))).count() == 0
    long_ = "<p>" + "word &amp; <b>bold</b> " * 200_000 + "</p>"
    out = warc.derive(warc.responses(spark.createDataFrame([(1, "u", long_, "clash"), (None, None, "<!--" * 100_000, "clash")], schema))).where("record_type = 'conversion'").collect()
    assert {r.page_id: len(r.block) for r in out} == {1: len("word & bold ") * 200_000 - 1, None: 0}


def test_warc_records(spark, tmp_path):
    html = "<html><head><title>T &amp; U</title><style>x</style></head><body><!-- c --><p>A &lt; b&#33; &#x41; &#xD800;</p><script>var a='</p>';</script>é</body></html>"
    pages = spark.createDataFrame([(1, "http://a/b", html, "k"), (2, None, None, "k"), (2, None, None, "k")], "page_id long, url string, html string, block string")
    found = warc.responses(pages)
    out = warc.derive(found).collect()
    assert len(out) == 6
    conv = next(r for r in out if r.page_id == 1 and r.record_type == "conversion")
    assert conv.block == "T & U\nA < b! A &#xD800;\né"
    assert conv.content_length == len(conv.block.encode())
    assert conv.refers_to == found.where("page_id = 1").first().response_id
    assert len({r.record_id for r in out if r.page_id == 1}) == 2
    warc.write_warc(warc.derive(found), str(tmp_path / "w"))
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").glob("part-*")))
    n = 0
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        size = int(dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])[b"Content-Length"])
        assert rest[size : size + 4] == b"\r\n\r\n"
        data, n = rest[size + 4 :], n + 1
    assert n == 6


def test_pipeline_on_small_tables(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "near_dedup", "decontamination", "packing"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before, ids = docs, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, "/root/testdata/sf0.001").cache()
        assert after.columns == docs.columns, name
        assert after.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
        before, ids = after, {r.doc_id for r in after.select("doc_id").collect()}
    packed = corpus_pipeline.STAGES[-1][1](spark, before, "/root/testdata/sf0.001")
    assert {r.doc_id for r in packed.select("doc_id").collect()} == ids
