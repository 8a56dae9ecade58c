"""Quality rules, toxicity, decontamination and the language model."""

from __future__ import annotations

import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sparkmalt.llm import decontaminate, lm, quality, queries, toxicity
from tests.llm.fixtures import EXTRA, SF, hostile, words

BIG = "/root/testdata/sf0.01"


def base_counts(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    wins = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {j for i in range(len(w) - 4) if wins[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside))


def test_quality_query(spark):
    docs = {r["doc_id"]: r["text"] for r in pq.read_table(f"{BIG}/documents.parquet").to_pylist()}
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{BIG}/labels.parquet").to_pylist()}
    rows = queries.op8_quality_rules(spark, BIG).collect()
    assert len(rows) == len(docs)
    verdict = {}
    for r in rows:
        n, *_, rep = want = base_counts(docs[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (n < 10 or 100 * rep > 20 * n)
        assert not (r["base_failed"] and r["kept"])
        verdict[r["doc_id"]] = r["kept"]
    good = [verdict[i] for i, q in labels.items() if q == 1]
    bad = [verdict[i] for i, q in labels.items() if q == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.5


def test_quality_held_out(spark):
    """Labels of a third of the ids are not learned from: their junk goes, and their clean rows stay."""
    stats = quality.rule_stats(spark.read.parquet(f"{BIG}/documents.parquet"), carry=["doc_id"])
    labels = spark.read.parquet(f"{BIG}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    out = quality.apply(stats, quality.fit(stats, labels.where(~held))).join(labels.where(held), "doc_id").select("quality", "rules.kept").collect()
    good, bad = ([r["kept"] for r in out if r["quality"] == q] for q in (1, 0))
    assert len(good) > 90 and np.mean(good) > 0.93 and len(bad) > 10 and not any(bad)


def test_quality_hostile(spark):
    docs = hostile(spark)
    labels = spark.createDataFrame([(1, 1), (2, 0), (6, 1), (None, 1), (7, None)], "doc_id long, quality int")
    stats = quality.rule_stats(docs)
    out = quality.apply(stats, quality.fit(stats, labels))
    assert out.columns == [*docs.columns, "rules"]
    for r in out.collect():
        assert (r["rules"]["n_words"], r["rules"]["n_dup_lines"], r["rules"]["n_repeat_words"]) == tuple(np.array(base_counts(r["text"]))[[0, 3, 4]])
        assert r["text"] or not r["rules"]["kept"]
    assert quality.apply(stats, quality.fit(stats, labels.limit(0))).count() == docs.count()
    none = quality.rule_stats(docs.limit(0))
    assert quality.apply(none, quality.fit(none, labels)).count() == 0


def test_forest_parts_outliers():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    forest = quality.grow(x, 64, 256, 3)
    assert forest.scores(np.full((1, 3), 9.0))[0] > forest.scores(x).max()


def test_toxicity_held_out(spark):
    """On sf0.1: the smaller tables have fewer toxic rows to learn from than the languages have words for them. About one toxic row in twenty shows no sign at all."""
    sf = "/root/testdata/sf0.1"
    rows = {r["doc_id"]: r for r in queries.op5_toxicity(spark, sf).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    held = [(rows[i]["score"], y) for i, y in labels.items() if rows[i]["held_out"]]
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    assert pos and np.mean([s >= 0.7 for s in pos]) >= 0.9 and np.mean([s >= 0.7 for s in neg]) <= 0.01
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows.values())


def test_toxicity_scores_are_those_of_the_lexicon(spark):
    """Every score of the query against a plain reading: each term looked for at each place, hits in exceptions left out, and the curve."""
    docs = spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{BIG}/labels.parquet")
    lexicon = toxicity.fit(docs, labels.where(~F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))))

    def places(form, part):
        return [m.start() for m in re.finditer(f"(?={re.escape(part)})", form)]

    def plain(text):
        total = 0.0
        folded, accented = toxicity.forms(text or "")
        for form, ascii_ in ((folded, True), (accented, False)):
            free = [(n, n + len(p)) for p in lexicon.exceptions if p.isascii() == ascii_ for n in places(form, p)]
            for term, weight in lexicon.weights.items():
                if term.isascii() == ascii_:
                    total += weight * sum(not any(a <= n and n + len(term) <= b for a, b in free) for n in places(form, term))
        bias, x, y = lexicon.curve
        z = bias + (x * math.log1p(total) + y * math.log1p(100 * total / (folded.count(" ") + 20)) if total else 0.0)
        return 1 / (1 + math.exp(-min(30, max(-30, z))))

    got = queries.op5_toxicity(spark, BIG).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert lexicon.weights and len(got) == len(texts)
    for r in got:
        assert abs(r["score"] - plain(texts[r["doc_id"]])) < 1e-9 and r["predicted"] == (r["score"] >= 0.7)


def test_toxicity_folding_and_exceptions(spark):
    lexicon = toxicity.Lexicon({" idiot ": 5.0, " tras": 4.0}, (" trash can ",), (-2.0, 1.0, 1.0))
    docs = spark.createDataFrame([(1, "an idiot"), (2, "an 1d10t"), (3, "аn іdіоt"), (4, "the trash can"), (5, "you trash"), (6, None), (7, ""), (8, "ÍDIÓT!"), (8, "ÍDIÓT!")], "doc_id long, text string")
    out = toxicity.apply(docs, lexicon)
    got = {r["doc_id"]: r["toxicity"] for r in out.collect()}
    assert out.count() == 9
    assert got[2] == pytest.approx(got[1]) and got[3] == pytest.approx(got[1]) and got[8] > got[6]
    assert got[4] == got[6] == got[7] < got[5]
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["toxicity"] for r in toxicity.apply(docs, none).collect()} == {0.0}
    assert toxicity.apply(docs.limit(0), lexicon).count() == 0


def test_toxicity_learns_exceptions(spark):
    """A term that clean texts have only beside one word is forgiven there and nowhere else."""
    rng = random.Random(1)
    filler = lambda: " ".join(f"w{rng.randrange(400)}" for _ in range(20))
    rows = [(n, f"{filler()} grimble {filler()}", 1) for n in range(40)] + [(100 + n, f"{filler()} grimble pie {filler()}", 0) for n in range(4)] + [(200 + n, filler(), 0) for n in range(200)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    lexicon = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"), least=2.0)
    assert " grimble pie " in lexicon.exceptions and any(t.strip() in "grimble" for t in lexicon.weights)
    new = spark.createDataFrame([(1, "a grimble here"), (2, "a grimble pie here"), (3, "nothing here")], "doc_id long, text string")
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.apply(new, lexicon).collect()}
    assert got[1] > got[2] == got[3]


def plain_matches(items, text):
    """All items that one of the text's passages reaches, by BM25 scores and overlaps worked out from the definition."""
    split = lambda t: re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]", " ", (t or "").lower()).split()
    told = [(i, t, split(t)) for i, t in items if split(t)]
    df = Counter(w for _, _, x in told for w in set(x))
    mean = sum(len(x) for _, _, x in told) / len(told)
    out = {}
    w = split(text)
    for item, own, x in told:
        weigh = {t: math.log(1 + (len(told) - df[t] + 0.5) / (df[t] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(x) / mean)) for t, c in Counter(x).items()}
        top = 64
        while len(x) > top:
            top *= 4
        step = max([32, *(len(y) for _, _, y in told if top // 4 < len(y) <= top or len(y) <= top == 64)])
        sentences = [s for s in re.split(r"(?<=[.!?])\s+", own.strip()) if split(s)]
        last = len(split(sentences[-1])) if len(sentences) > 1 else max(1, len(x) // 4)
        for low in [None, *range(0, max(1, len(w)), step)]:
            part = w[:step] if low is None else w[low : low + 2 * step]
            if sum(weigh[t] for t in set(part) & set(weigh)) / sum(weigh.values()) < 0.5 - 1e-9:
                continue
            shares = []
            for half in (x[: len(x) - last], x[len(x) - last :]):
                k = min(3, len(half))
                grams = {tuple(half[a : a + k]) for a in range(len(half) - k + 1)} if half else set()
                there = {tuple(part[a : a + k]) for a in range(len(part) - k + 1)}
                shares.append(len(grams & there) / len(grams) if grams else 1.0)
            if min(shares) >= 0.6:
                out[item] = max(out.get(item, 0), sum(shares))
    return out


def test_decontamination_against_full_scores(spark):
    items = [tuple(r.values()) for r in pq.read_table(f"{SF}/benchmark.parquet").select(["item_id", "text"]).to_pylist()]
    docs = pq.read_table(f"{SF}/documents.parquet").select(["doc_id", "text"]).to_pylist()
    rng = random.Random(2)
    filler = [x for d in docs for x in words(d["text"])[:50]]
    planted = [(10_000 + n, " ".join(rng.choices(filler, k=rng.randint(0, 500)) + words(t) + rng.choices(filler, k=300))) for n, (_, t) in enumerate(items[:8])]
    shown = [(d["doc_id"], d["text"]) for d in docs if len(d["text"] or "") < 3000][:60] + planted
    df = spark.createDataFrame(shown, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block_bytes in (1 << 30, 2000):
        got = {r["doc_id"]: {m["item"] for m in r["matches"]} for r in decontaminate.with_matches(df, bench, block_bytes=block_bytes).collect()}
        assert all(items[n][0] in got[10_000 + n] for n in range(8))
        assert got == {i: set(plain_matches(items, t)) for i, t in shown}


def test_decontamination_query(spark):
    """The query's rows against the plain version, over the whole table."""
    items = [tuple(r.values()) for r in pq.read_table(f"{SF}/benchmark.parquet").select(["item_id", "text"]).to_pylist()]
    want = {(d["doc_id"], i) for d in pq.read_table(f"{SF}/documents.parquet").to_pylist() for i in plain_matches(items, d["text"])}
    rows = queries.op4_decontaminate(spark, SF).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == want and len(rows) == len(want) > 0
    assert all(r["score"] >= 0.5 - 1e-9 and min(r["question_overlap"], r["answer_overlap"]) >= 0.6 for r in rows)
    short = spark.createDataFrame([(7, "one two three four five six seven")], "item_id short, text string")
    assert decontaminate.with_matches(spark.createDataFrame([(1, "zero one two three four five six seven")], "doc_id int, text string"), short).first()["matches"][0]["item"] == 7


def test_decontamination_is_the_same_in_all_block_sizes(spark):
    items = [tuple(r.values()) for r in pq.read_table(f"{SF}/benchmark.parquet").select(["item_id", "text"]).to_pylist()]
    items += [(90_001, " ".join(f"long{i}" for i in range(900))), (90_002, ""), (90_003, None)]
    rng = random.Random(5)
    # items with a part of their words replaced: many near the threshold
    docs = [(n, " ".join(w if rng.random() > share else f"x{rng.randrange(50)}" for w in words(t)) + " filler" * rng.randint(0, 90)) for n, (share, (_, t)) in enumerate((s, x) for s in (0, 0.05, 0.1, 0.15, 0.2) for x in items if x[1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = []
    for block_bytes in (1 << 30, 6000, 1500):
        rows = decontaminate.with_matches(df, bench, block_bytes=block_bytes, carry=["doc_id"]).collect()
        got.append({(r["doc_id"], m["item"]): (round(m["score"], 9), m["question"], m["answer"], m["word"]) for r in rows for m in r["matches"]})
    assert len(got[0]) > len(items) and got[0] == got[1] == got[2]


def test_decontamination_hostile(spark):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, " ".join(f"w{i}" for i in range(40))), (3, " ".join(f"w{i}" for i in range(40))), (None, "w1 w2 zz")], "item_id long, text string")
    out = decontaminate.with_matches(hostile(spark), bench)
    got = [(r["doc_id"], {m["item"] for m in r["matches"]}) for r in out.collect()]
    assert len(got) == hostile(spark).count() and (1, {3}) in got and (3, set()) in got
    assert {len(r["matches"]) for r in decontaminate.with_matches(hostile(spark), bench.limit(0)).collect()} == {0}
    assert decontaminate.with_matches(hostile(spark).limit(0), bench).count() == 0


def small_table(known=300, vocabulary=150, words_in_all=400):
    """A symbol table of invented words, some of them beyond the known ones."""
    counts = {f"{'abcdefg'[n % 7]}{n}{'xyz'[n % 3]}ng".encode(): 4000 // (n + 1) + 1 for n in range(words_in_all)}
    w = lm.split(list(counts))
    mass = np.bincount(lm.endings(w), weights=np.array(list(counts.values()), dtype=float), minlength=1 << 16)
    return lm.symbol_table(dict(list(counts.items())[:known]), mass, vocabulary), counts


def test_network_gradient():
    table, _ = small_table()
    net = lm.Network.start(table, 4, 1)
    rng = np.random.default_rng(0)
    seq = rng.integers(0, table.edge, 60)
    at = np.arange(4, 50)
    loss = lambda flat: -net.like(flat).log_probs(seq, at).mean()
    flat = net.flat().astype(np.float64)
    sums = net.like(np.full(len(flat), 1e-12))
    net.like(flat.copy()).learn(seq, at, sums, 0.0)
    size = np.sqrt(sums.flat())
    seen = np.flatnonzero(size > 1e-3)
    for i in [*rng.choice(seen, 30, replace=False), *rng.integers(0, len(flat), 10)]:
        step = np.zeros(len(flat))
        step[i] = 1e-2
        assert abs((loss(flat + step) - loss(flat - step)) / 2e-2) == pytest.approx(size[i], abs=2e-3)


def test_network_step_holds_logits_of_few_positions():
    """A step's softmaxes are worked out some rows at a time: with those of the whole batch at once it held 5.5 MB."""
    table, _ = small_table(known=400, vocabulary=400)
    net = lm.Network.start(table, lm.HIDDEN, 1)
    sums = net.like(np.full(net.flat().shape, 1e-6))
    seq = np.random.default_rng(0).integers(0, table.edge, lm.BATCH + 4)
    at = np.arange(2, lm.BATCH + 2)
    for step in (lambda: net.learn(seq, at, sums, 0.1), lambda: net.log_probs(seq, at)):
        step()
        tracemalloc.start()
        step()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 5e6


def test_network_with_large_weights():
    """Logits that exp can't take are shifted: the same probabilities as by double arithmetic, and steps stay finite."""
    table, _ = small_table()
    net = lm.Network.start(table, 4, 1)
    net = net.like(net.flat() * 300)
    seq = np.random.default_rng(0).integers(0, table.edge, 600)
    at = np.arange(2, 590)
    h, _ = net.hidden(seq, at)
    soft = lambda x: x - x.max(axis=1, keepdims=True) - np.log(np.exp(x - x.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True))
    h = h[:, :-1].astype(np.float64)
    kind, member = table.kind[seq[at]], table.member[seq[at]]
    want = soft(h @ net.out + net.bias)[np.arange(len(at)), kind]
    for n in range(len(at)):
        g = kind[n] - lm.TAILS
        want[n] += soft(h[n : n + 1] @ net.inner_out[g] + net.inner_bias[g])[0, member[n]] if member[n] >= 0 else table.inner[seq[at[n]]]
    assert want.min() < -200 and np.allclose(net.log_probs(seq, at), want, rtol=1e-4, atol=1e-2)
    net.learn(seq, at, net.like(np.full(net.flat().shape, 1e-6)), 0.1)
    assert np.isfinite(net.flat()).all()


def test_known_words_are_found_by_their_hashes():
    """Hashes with the same first bits, at both ends and in between; those that aren't known stay so."""
    known = np.array([0, 1, 2, 5, 9, 1 << 63, (1 << 63) + 1, (1 << 64) - 1], dtype=np.uint64)
    none = np.zeros(0, dtype=np.int64)
    table = lm.Symbols(known, none, none, none, none, none, none, none)
    assert np.array_equal(table.places(known), np.arange(len(known)))
    other = np.array([3, 10, 1 << 40, (1 << 63) + 2, (1 << 64) - 2], dtype=np.uint64)
    assert not (known[table.places(other)] == other).any()


def test_word_probabilities_sum_to_one():
    """Over all words and, for each tail class, those without a count; in any surroundings, trained or not."""
    table, counts = small_table()
    net = lm.Network.start(table, 8, 2)
    rng = np.random.default_rng(1)
    told = rng.integers(lm.TAILS, table.edge, 500)
    sums = net.like(np.full(net.flat().shape, 1e-6))
    for _ in range(5):
        net.learn(told, np.arange(5, 480), sums, 0.3)
    left = list(counts.items())[300:]
    kinds = table.classes[lm.endings(lm.split([w for w, _ in left]))]
    for around in ([table.edge] * 4, told[:4], told[7:11]):
        seq = np.array([[*around[:2], x, *around[2:]] for x in range(table.edge)]).ravel()
        p = np.exp(net.log_probs(seq, np.arange(2, len(seq), 5)))
        # words beyond the known ones have n / UNSEEN times the probability of a word without a count
        assert p.sum() + sum(n / lm.UNSEEN * p[k] for (_, n), k in zip(left, kinds, strict=True)) == pytest.approx(1, abs=1e-3)


def test_lm_scores(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = lm.train(docs)
    rng = random.Random(1)
    some = [(r["doc_id"], r["text"]) for r in docs.collect() if 50 < len(words(r["text"])) < 400][:40]
    mixed = [(1000 + i, " ".join(rng.sample(words(t), len(words(t))))) for i, t in some]
    noise = [(2000 + i, re.sub(r"\w", lambda m: chr(97 + rng.randrange(26)), t)) for i, t in some]
    df = spark.createDataFrame(some + mixed + noise + [(1, None), (2, "")], "doc_id long, text string")
    out = {r["doc_id"] if r["text"] else -1: r["pseudo"] for r in lm.score(df, model).collect()}
    mean = lambda low: np.mean([out[low + i]["mean_log_prob"] for i, _ in some])
    assert mean(0) > mean(1000) > mean(2000)
    assert out[-1]["n_words"] == 0 and out[-1]["log_prob"] == 0 and out[-1]["mean_log_prob"] is None
    for i, t in some:
        assert out[i]["n_words"] == len(words(t)) and out[i]["log_prob"] == pytest.approx(out[i]["mean_log_prob"] * out[i]["n_words"])


def plain_score(model, counts, text):
    """The sum of log-probabilities, one word after the other, from the weights."""
    table, net = model
    soft = lambda x: x - x.max() - np.log(np.exp(x - x.max()).sum())
    w = [x.encode() for x in words(text)]
    seq = [table.edge] * lm.SIDE + [int(table.of([x])[0][lm.SIDE]) for x in w] + [table.edge] * lm.SIDE
    total = 0.0
    for k, x in enumerate(w, lm.SIDE):
        around = [seq[k + m] for m in range(-lm.SIDE, lm.SIDE + 1) if m]
        h = np.tanh(sum(net.tables[slot][table.row[s]] for slot, s in enumerate(around)))
        kind, member = table.kind[seq[k]], table.member[seq[k]]
        total += soft(h @ net.out + net.bias)[kind]
        if member >= 0:
            total += soft(h @ net.inner_out[kind - lm.TAILS] + net.inner_bias[kind - lm.TAILS])[member]
        else:
            total += table.inner[seq[k]] + (np.log(counts[x] / lm.UNSEEN) if seq[k] < lm.TAILS and x in counts else 0.0)
    return total


def test_lm_query(spark):
    """Every row of the query against plain scores of the same model."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    counts = Counter(x.encode() for t in texts.values() for x in words(t))
    rows = {r["doc_id"]: r for r in queries.op1_lm_score(spark, SF).collect()}
    model = lm.train(docs)
    assert set(rows) == set(texts)
    for i, t in texts.items():
        assert rows[i]["n_words"] == len(words(t))
        if len(words(t)) < 300:
            assert rows[i]["log_prob"] == pytest.approx(plain_score(model, counts, t), rel=1e-3, abs=0.01)


def test_lm_trains_on_every_position(spark):
    text = " ".join(f"w{i * i % 37} x{i % 11}" for i in range(3000))
    table, net = lm.train(spark.createDataFrame([(text,)], "text string").coalesce(1))
    want = lm.Network.start(table, lm.HIDDEN, 3)
    sums = want.like(np.full(want.flat().shape, 1e-6))
    seq, _ = table.of([text.encode()])
    at = np.random.Generator(np.random.PCG64([3, 1])).permutation(np.flatnonzero(seq != table.edge))
    assert len(at) == 6000
    for a in range(0, len(at), lm.BATCH):
        want.learn(seq, at[a : a + lm.BATCH], sums, lm.RATE)
    assert np.allclose(net.flat(), want.flat(), atol=1e-5)


def test_lm_every_word_has_its_own_share(spark):
    rng = random.Random(4)
    texts = [" ".join(f"{rng.choice('abcd')}{int(rng.paretovariate(0.7)) % 3000}ing" for _ in range(200)) for _ in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    counts = Counter(x for t in texts for x in words(t))
    few, all_ = lm.train(docs, vocabulary=20, known=40), lm.train(docs, vocabulary=20, known=len(counts))
    assert len(few[0].hashes) <= 40 < len(all_[0].hashes) == len(counts)
    # the words outside the broadcast table are scored by the joined counts, as if they were in it
    one, other = ({r["doc_id"]: r["pseudo"]["log_prob"] for r in lm.score(docs, m).collect()} for m in (few, all_))
    assert one == pytest.approx(other, rel=1e-4)
    # one surroundings, one class: scores differ by the words' own counts
    rare = [x for x, _ in counts.most_common() if few[0].of([x.encode()])[0][lm.SIDE] < lm.TAILS]
    df = spark.createDataFrame([(0, rare[0]), (1, rare[-1]), (2, "neverseening")], "doc_id int, text string")
    out = {r["doc_id"]: r["pseudo"]["log_prob"] for r in lm.score(df, few).collect()}
    assert counts[rare[0]] > counts[rare[-1]]
    assert out[0] - out[1] == pytest.approx(np.log(counts[rare[0]] / counts[rare[-1]]), abs=1e-5)
    assert out[1] - out[2] == pytest.approx(np.log(counts[rare[-1]] / lm.UNSEEN), abs=1e-5)


def test_lm_hostile(spark):
    docs = hostile(spark)
    out = lm.score(docs, lm.train(docs))
    assert out.columns == [*docs.columns, "pseudo"] and out.count() == docs.count()
    assert {r["n"] for r in out.select("n").collect()} == {"junk"} and EXTRA
    empty = docs.limit(0)
    assert lm.score(empty, lm.train(empty)).count() == 0
    assert out.where(F.col("text").isNull() & (F.col("pseudo.n_words") != 0)).count() == 0
