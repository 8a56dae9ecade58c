"""Exact search, centroids and conversation repair against plain versions and their SQL."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from sparkmalt.llm import centroids, queries, topk, turns
from tests.llm.fixtures import EXTRA, SF
from tests.test_queries import rows

INF, NAN = float("inf"), float("nan")


@pytest.mark.parametrize("name", ["op11_topk", "op12_turn_repair", "op13_centroids"])
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF), con.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


def told(spark, data: list[tuple]):
    """Rows (vec_id, vector) with columns that clash with names used inside."""
    clash = [*EXTRA, "vector_", "cluster", "distance", "slice", "block"]
    return spark.createDataFrame([(i, v, *["junk"] * len(clash)) for i, v in data], "vec_id long, vector array<double>, " + ", ".join(f"`{c}` string" for c in clash))


def plain_best(data: list[tuple], k: int, asks) -> list[tuple]:
    good = [(n, i, v) for n, (i, v) in enumerate(data) if v is not None and all(x is not None and abs(x) < INF for x in v)]
    out = []
    for n, i, v in good:
        if i is not None and asks(i):
            all_ = [(-max(-(2**63), min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(v, w)))), j is None, j or 0) for m, j, w in good if m != n]
            out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(sorted(all_)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [7, 40, 16384])
def test_search(spark, block):
    draw = random.Random(5)
    data: list[tuple] = [(i, [float(draw.randint(-9, 9)) for _ in range(64)]) for i in range(120)]
    data += [(200 + i, [1.0] * 64) for i in range(40)]  # copies, ties
    data += [(50, [1.0] * 64), (0, data[0][1]), (0, data[0][1]), (None, [2.0] * 64), (None, None), (300, None), (350, [1.0, None]), (400, [NAN] * 64), (450, [INF] * 64)]
    data += [(500, []), (550, [3.0]), (600, [float(draw.randint(-3, 3)) for _ in range(201)]), (650, [2.0**60, 5.0, -1.0]), (651, [2.0**60, 5.0, 1.0]), (652, [2.0**20, 1.0] * 32)]
    df = told(spark, data)
    got = topk.search(df, df.where("vec_id % 50 = 0"), k=5, block=block).collect()
    assert sorted(map(tuple, got), key=str) == plain_best(data, 5, lambda i: i % 50 == 0)


def test_search_empty(spark):
    df = told(spark, [])
    assert topk.search(df, df, k=5).collect() == []
    one = told(spark, [(0, [1.0])])
    assert topk.search(one, one, k=5).collect() == []


def test_bounds_hold_and_drop():
    """No level bounds a score from below, and near vectors let the levels drop candidates before exact scores."""
    draw = np.random.default_rng(3)
    steps = np.repeat(draw.integers(-200, 200, (400, 8)), 8, axis=1) + draw.integers(-3, 4, (400, 64))
    x = steps.astype(float)
    exact = x @ x.T
    for s in topk.LEVELS:
        assert (topk.statistics(x, s) @ topk.statistics(x, s).T >= exact - 1e-6).all()
    best = [topk.Best(5, i) for i in range(20)]
    seen: list[int] = []
    whole = topk.products
    topk.products = lambda q, m: seen.append(len(m)) or whole(q, m)
    try:
        topk.screened(x[:20], x, np.arange(400), best, 5)
    finally:
        topk.products = whole
    assert sum(seen) < 0.5 * 20 * 400
    for i, b in enumerate(best):
        assert sorted((s for _, s in b.kept()), reverse=True)[:5] == sorted(np.delete(exact[i], i), reverse=True)[:5]


def plain_clusters(data: list[tuple], k: int, rounds: int, dim: int) -> list[tuple]:
    cut = lambda x: max(-(2**27), min(2**27, int(x)))
    good = [(i, [cut(x) for x in v]) for i, v in data if v is not None and len(v) == dim and all(x is not None and abs(x) < INF for x in v)]
    drawn = sorted(good, key=lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in drawn[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in good]
        for j in range(len(c)):
            mine = [v for (_, v), a in zip(good, at) if a == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine)]
    out = [(i, near(v)) for i, v in good]
    return sorted(((i, j, d, sum(e for _, (e, m) in out if m == j), sum(e for _, (e, _) in out), c[j]) for i, (d, j) in out), key=str)


@pytest.mark.parametrize("k", [1, 6, 500])
def test_clusters(spark, k):
    draw = random.Random(7)
    data: list[tuple] = [(i, [float(draw.randint(-40, 40) + 90 * (i % 5)) for _ in range(19)]) for i in range(150)]
    data += [(3, [7.0] * 19)] * 30 + [(None, [-5.0] * 19), (None, [1e30] + [0.0] * 18), (900, [-1e30] * 19)]
    data += [(901, None), (902, [1.0] * 18), (903, [1.0] * 20), (904, [1.0] * 18 + [None]), (905, [NAN] * 19), (906, [INF] * 19), (907, [])]
    got = centroids.clusters(told(spark, data), k=k, rounds=3, dim=19, seed=2).collect()
    assert sorted(map(tuple, got), key=str) == plain_clusters(data, k, 3, 19)


def test_clusters_empty(spark):
    assert centroids.clusters(told(spark, []), k=4).collect() == []
    assert centroids.clusters(told(spark, [(1, None), (2, [1.0])]), k=4).collect() == []


def test_screening_leaves_exact_distances_out():
    """Bounds never exceed distances, and of well-parted centroids most get no exact distance."""
    draw = np.random.default_rng(4)
    c = draw.integers(-200, 200, (40, 64))
    x = np.repeat(c, 20, axis=0) + draw.integers(-2, 3, (800, 64))
    norms, of_c = (centroids.segment_norms(m, centroids.SEGMENTS) for m in (x, c))
    d = np.square(x[:, None, :] - c[None, :, :]).sum(axis=2)
    assert (np.square(norms[:, None, :] - of_c[None, :, :]).sum(axis=2) <= d + 1e-3).all()
    cluster, best = centroids.nearest(x, norms, c)
    assert (cluster == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


def plain_faults(said: list[tuple]) -> list[str]:
    seen, out = set(), []
    for role, text in said:
        chars = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not chars else "duplicate" if (role, text) in seen else "truncated" if chars[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_repair(said: list[tuple]) -> tuple[int, str, list[tuple]]:
    """The cheapest edits by trying every way for every row, with up to two turns put in before each and at the end."""
    faults = plain_faults(said)
    fill = [[], ["u"], ["a"], ["u", "a"], ["a", "u"]]
    found = []
    ops = [[("D", None)] if f in ("blank", "duplicate") else [("K", r), ("R", "user"), ("R", "assistant"), ("D", None)] for (r, _), f in zip(said, faults)]
    for ways in itertools.product(*ops):
        cost = sum({"K": 0, "R": 3, "D": 4}[e] + (3 if f == "truncated" and e != "D" else 0) for (e, _), f in zip(ways, faults))
        for puts in itertools.product(fill, repeat=len(said) + 1):
            out, audit = [], ""
            for p, way, row in itertools.zip_longest(puts, ways, said):
                out += [({"u": "user", "a": "assistant"}[x], "") for x in p]
                audit += "I" * len(p) + (way[0] if way else "")
                out += [(way[1], row[1])] if way and way[1] is not None else []
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in out)):
                found.append((cost + 3 * sum(map(len, puts)), audit, out))
    return min(found, key=lambda f: f[:2])


def test_repair_small():
    draw = random.Random(11)
    texts = ["Yes.", "No", "", " \t", "Why?", "Yes."]
    for _ in range(60):
        said = [(draw.choice(["user", "assistant", "system", "user", "assistant", "tool", ""]), draw.choice(texts)) for _ in range(draw.randint(0, 3))]
        given: list[tuple] = []
        one = turns.Repair(lambda *e: given.append(e))
        for (role, text), f in zip(said, plain_faults(said)):
            one.add(role, text, f or None)
        cost, audit, out = plain_repair(said)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
        assert one.end() == (cost, audit, digest), said
        assert ("".join(e for e, _, _ in given), [(r, t) for e, r, t in given if e != "D"]) == (audit, out), said


def layers(said: list[tuple]) -> tuple[int, str]:
    """Least (cost, audit) by a table over all rows, without pruning and without early decisions."""
    states = {"": (0, "")}
    for (role, _), f in zip(said, plain_faults(said)):
        new = {s: (c + 4, a + "D") for s, (c, a) in states.items()}
        for letter, to, price in [("K", role[:1], 0), ("R", "u", 3), ("R", "a", 3)] if f not in ("blank", "duplicate") else []:
            for s, (c, a) in states.items():
                if to and to in turns.BETWEEN[s]:
                    n = len(turns.BETWEEN[s][to])
                    way = (c + 3 * n + price + 3 * (f == "truncated"), a + "I" * n + letter)
                    new[to] = min(new.get(to, way), way)
        states = new
    return min((c + 3 * len(turns.BETWEEN[s][""]), a + "I" * len(turns.BETWEEN[s][""])) for s, (c, a) in states.items())


def test_repair_long_holds_little():
    """Turns are sure soon after they come, and without rows to give none is held; the result is that of the whole table."""
    draw = random.Random(13)
    for roles in (["user", "assistant"], ["user"], ["system"], ["user", "assistant", "system", "tool"], ["assistant", "user", "user"]):
        said = [(roles[n % len(roles)] if draw.random() < 0.8 else draw.choice(roles), f"text {n}" + draw.choice(["", ".", "?"])) for n in range(1500)]
        given: list[str] = []
        one, bare, most = turns.Repair(lambda e, r, t: given.append(e)), turns.Repair(), 0
        for (role, text), f in zip(said, plain_faults(said)):
            one.add(role, text, f or None)
            bare.add(role, text, f or None)
            most = max(most, len(one.held))
        assert not bare.held and bare.end() == (end := one.end()), roles
        assert end[:2] == layers(said) and end[1] == "".join(given), roles
        assert most < 300 or "assistant" not in roles, roles


def test_reports_and_edits(spark):
    said = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 3, "user", "Hi."), (1, 4, "assistant", "cut"), (2, None, "assistant", None), (2, 9, None, "x."), (None, 5, "user", "Null id?"), (3, 2**62, "user", "Far."), (3, -(2**62) - 5, "assistant", "No."), (4, 1, "user", "a" * 300_000), (4, 1, "user", "a" * 300_000)]
    df = spark.createDataFrame([(*r, *["junk"] * len(EXTRA)) for r in said], "conv_id long, turn long, role string, text string, " + ", ".join(f"`{c}` string" for c in EXTRA))
    got = {r["conv_id"]: r for r in turns.reports(df).collect()}
    steps = turns.edits(df).orderBy("conv_id", "step").collect()
    by_id: dict = {}
    for c, t, r, x in said:
        by_id.setdefault(c, []).append((t, r or " ", x if x is not None else " "))
    assert set(got) == set(by_id)
    for c, all_ in by_id.items():
        all_.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        one = [(r, x) for _, r, x in all_]
        cost, audit, out = plain_repair(one)
        faults, known = plain_faults(one), [t for t, _, _ in all_ if t is not None]
        pairs = [a[0][:1] + b[0][:1] for a, b in itertools.pairwise(one)]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest()
        assert tuple(got[c]) == (c, min(gaps, 2**63 - 1), *[faults.count(f) for f in ("blank", "duplicate", "truncated")], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest)
        assert [(s["role"], s["text"]) for s in steps if s["conv_id"] == c and s["edit"] != "D"] == out
    assert turns.reports(df.limit(0)).collect() == [] and turns.edits(df.limit(0)).collect() == []


def test_damage(spark):
    assert turns.damaged(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
    df = spark.createDataFrame([(i, t, "assistant", "a. b! c?") for i in range(40) for t in (None, 0, 1)], "conv_id long, turn long, role string, text string")
    import zlib

    want = []
    for i in range(40):
        for t in (None, 0, 1):
            kind = zlib.crc32(f"{i}:{' ' if t is None else t}".encode()) % 20
            row = (i, t, "user" if kind == 4 else "assistant", "" if kind == 1 else "a b c" if kind == 2 else "a. b! c?")
            want += [] if kind == 0 else [row] * (2 if kind == 3 else 1)
    assert sorted(map(tuple, turns.damaged(df).collect()), key=str) == sorted(want, key=str)
def plain_op13(data: list[tuple]) -> list[tuple]:
    """The rows of op13 by its contract, in Python's whole numbers."""
    good = [(i, [math.floor(256 * Fraction(x)) for x in v]) for i, v in data if v is not None and len(v) == 64 and all(x is not None and abs(x) < INF for x in v)]
    c = [v for _, v in sorted(good, key=lambda r: hashlib.sha256(f"2:{r[0]}".encode()).hexdigest())[:40]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))
    for _ in range(5):
        at = [near(v)[1] for _, v in good]
        mine = [[v for (_, v), a in zip(good, at) if a == j] for j in range(len(c))]
        c = [[sum(col) // len(vs) for col in zip(*vs)] if vs else m for vs, m in zip(mine, c)]
    out = [(i, near(v)) for i, v in good]
    held = lambda x: x if x < 2**63 else None
    sums = [sum(d for _, (d, m) in out if m == j) for j in range(len(c))]
    return sorted((i, j, held(d), held(sums[j]), held(sum(sums)), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, (d, j) in out)


@pytest.mark.parametrize("far", [2.0**20, 3e38])
def test_centroids_of_far_vectors(spark, tmp_path, far):
    """Components beyond 2**27 256ths count as they are, as centroids and as vectors, alone and among near ones; NaN and infinity are no numbers."""
    draw = np.random.default_rng(11)
    data: list[tuple] = [(i, (draw.normal(size=64) * (1 + i % 3)).astype(np.float32).tolist()) for i in range(160)]
    for i in range(160, 200):
        v = draw.normal(size=64).astype(np.float32)
        v[i % 64] = far * (1 if i % 2 else -1) * (1 - i % 5 / 8)
        data.append((i, v.tolist()))
    data += [(300, [NAN] * 64), (301, [INF] + [0.0] * 63), (302, [1.0] * 63), (303, None), (304, [None] * 64), (305, [-INF] * 64)]
    spark.createDataFrame(data, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.op13_centroids(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_op13(data), key=str)
