"""Near-duplicate documents by an inverted join on MinHash signature coordinates.

1. Every whole text becomes a set of word shingles with a signature of ``n``
   coordinates; documents with equal sets are one node from here on.
2. Nodes are posted under each coordinate-value pair. Two sets of the wanted
   similarity agree in at least ``match`` coordinates (but for a chance of
   ``loss``), so with a node's pairs in order of rarity, its first
   n - match + 1 hold one that any partner has among its first, too (prefix
   filter); pairs that only one node has post nothing, so most nodes post
   nothing at all.
3. In each posting list collisions are counted by merging the members' shorter
   lists and looking into the longer ones at the candidates only (skipping);
   pairs that reach ``match`` join a candidate cluster. Pairs that are in one
   cluster already are skipped, so a list gives fewer edges than it has nodes.
4. In each cluster the full shingle sets confirm the links, again skipping what
   is connected already.
5. Connected components of the confirmed links give the result.

Long lists and large clusters are dealt out in blocks of at most ``BLOCK``
nodes, each with the list's most central node, so that a tight group is
connected after one linear pass. In groups that then still have several
components the nodes outside the largest one are compared with its blocks and
among themselves, so a tight group with a few others beside it stays linear. No
list of pairs is ever written out, and there is no cap.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmalt.llm.graph import components
from sparkmalt.llm.shingles import fingerprints, shingle_sets, signatures
from sparkmalt.llm.store import written
from sparkmalt.llm.words import U, mix, per_text

COORDINATES = 64
BLOCK = 512
MANY, LONG, DENSE = 48, 4_000_000, 4096  # members and shingles of a block whose intersections are counted at once, in matrices of so many columns


def match_threshold(n: int, similarity: float, loss: float = 1e-5) -> int:
    """The most coordinates that sets of this similarity agree in but for a chance of ``loss``."""
    below, t = 0.0, 0
    while (below := below + comb(n, t) * similarity**t * (1 - similarity) ** (n - t)) <= loss:
        t += 1
    return t


def identities(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, check): the two words of each set's 128-bit fingerprint."""
    f = fingerprints(values, first)
    with np.errstate(over="ignore"):
        return mix(f[:, 0] ^ (f[:, 1] * U(0x9E3779B97F4A7C15))).view(np.int64), mix(f[:, 1]).view(np.int64)


def tagged(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, tag, text): the tag tells texts apart that share a key."""
    return docs.select(F.col(f"`{key}`").alias("key"), F.xxhash64(F.col(f"`{text}`")).alias("tag"), F.col(f"`{text}`").alias("text"))


def signed(docs: DataFrame, key: str, text: str, k: int, n: int) -> DataFrame:
    """(key, tag, n_shingles, node, check, tokens): the set's fingerprint and its hashed coordinate-value pairs, null for empty sets."""
    salt = mix(np.arange(n, dtype=np.uint64) + U(77))

    def judge(part: list[bytes]) -> pa.Array:
        values, first = shingle_sets(part, k)
        size = np.diff(first)
        with np.errstate(over="ignore"):
            tokens = mix(signatures(values, first, n) + salt).view(np.int64)
        node, check = identities(values, first)
        none = size == 0
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * n), pa.array(tokens.ravel()))
        return pa.StructArray.from_arrays([pa.array(size.astype(np.int64)), pa.array(node, mask=none), pa.array(check, mask=none), pc.if_else(pa.array(none), None, lists)], names=kind.names)

    kind = T._parse_datatype_string("n_shingles long, node long, check long, tokens array<long>")
    return tagged(docs, key, text).select("key", "tag", per_text(docs.sparkSession, judge, kind)(F.col("text")).alias("one")).select("key", "tag", "one.*")


def told_apart(base: DataFrame) -> DataFrame:
    """``base`` with another ``node`` for sets whose first words agree and whose second ones don't."""
    turn = 0
    while True:
        turn += 1
        twins = base.where("node IS NOT NULL").groupBy("node").agg(F.min("check").alias("low"), F.max("check").alias("high")).where("low <> high").select("node", F.lit(True).alias("twin"))
        if not twins.take(1):
            return base
        node = F.when(F.col("twin"), F.xxhash64(F.lit(turn), "node", "check")).otherwise(F.col("node"))
        base = written(base.join(twins, "node", "left").withColumn("node", node).select(*base.columns), "signatures")


def sets_of(docs: DataFrame, nodes: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(node, payload): the full sets of ``nodes`` (node, key, tag), as sorted 64-bit values."""

    def judge(part: list[bytes]) -> pa.Array:
        values, first = shingle_sets(part, k)
        return pa.array([values[a:b].tobytes() for a, b in zip(first, first[1:], strict=False)], pa.binary())

    rows = tagged(docs, key, text)
    named = rows.join(nodes, rows["key"].eqNullSafe(nodes["key"]) & (rows["tag"] == nodes["tag"])).select("node", "text")
    return named.select("node", per_text(docs.sparkSession, judge, T.BinaryType())(F.col("text")).alias("payload")).dropDuplicates(["node"])


Joins = Callable[[list[bytes], np.ndarray, int], Iterator[tuple[int, int]]]


def by_signature(match: int, n: int) -> Joins:
    """Joins members whose signatures agree in ``match`` coordinates, by merging posting lists.

    A member's coordinate-value pairs are taken from the rarest on. The lists of
    its first n - match + 1 are merged, which counts collisions with every
    candidate; the longer lists are only looked into at the candidates.
    """
    short = n - match + 1

    def run(payload: list[bytes], group: np.ndarray, split_at: int) -> Iterator[tuple[int, int]]:
        sig = np.frombuffer(b"".join(payload), dtype=np.int64).reshape(-1, n)
        order = np.argsort(sig, axis=None, kind="stable")
        flat = sig.ravel()[order]
        new = np.concatenate(([True], flat[1:] != flat[:-1]))
        starts = np.append(np.flatnonzero(new), len(flat))
        place = np.empty(len(flat), dtype=np.int64)
        place[order] = np.cumsum(new) - 1
        place, holder = place.reshape(sig.shape), order // n
        sizes = np.diff(starts)[place]
        for i in range(len(sig)):
            low = max(i + 1, split_at) if i < split_at or not split_at else len(sig)
            if low >= len(sig):
                continue
            by_size = np.argsort(sizes[i], kind="stable")
            lists = place[i][by_size[:short]]
            count = np.bincount(np.concatenate([holder[starts[t] : starts[t + 1]] for t in lists]), minlength=len(sig))
            there = low + np.flatnonzero((count[low:] > 0) & (group[low:] != group[i]))
            longer = by_size[short:]
            for j in there[count[there] + (sig[np.ix_(there, longer)] == sig[i, longer]).sum(axis=1) >= match]:
                if group[j] != group[i]:
                    yield i, int(j)
                    group[group == group[j]] = group[i]

    return run


def shared_counts(sets: list[np.ndarray], split_at: int) -> np.ndarray:
    """Sizes of the intersections of sets: all with all, or those before ``split_at`` with the others."""
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    several = times[column] > 1  # shingles of one set only add nothing
    column, row = (np.cumsum(times > 1) - 1)[column[several]], row[several]
    left = split_at or len(sets)
    out = np.zeros((left, len(sets) - split_at), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    for first in range(0, int((times > 1).sum()), DENSE):
        a, b = np.searchsorted(column, (first, first + DENSE))
        there = np.zeros((len(sets), DENSE), dtype=np.float32)
        there[row[a:b], column[a:b] - first] = 1
        out += there[:left] @ there[split_at:].T
    return out


def by_set(percent: int, match: int, n: int) -> Joins:
    """Joins members whose sets have 100 * intersection >= percent * union.

    Where there are many members, all intersections are counted at once, as
    products of blocks of the matrix of members and shingles; where there are
    few, or the sets are very long, the signature ahead of each set says which
    are worth counting.
    """

    def at_once(sets: list[np.ndarray], group: np.ndarray, split_at: int) -> Iterator[tuple[int, int]]:
        size = np.array([len(s) for s in sets], dtype=np.int64)
        both = np.rint(shared_counts(sets, split_at)).astype(np.int64)
        linked = 100 * both >= percent * (size[: len(both), None] + size[None, split_at:] - both)
        for i, row in enumerate(linked):
            for j in split_at + np.flatnonzero(row & (group[split_at:] != group[i])):
                if group[j] != group[i]:
                    yield i, int(j)
                    group[group == group[j]] = group[i]

    def run(payload: list[bytes], group: np.ndarray, split_at: int) -> Iterator[tuple[int, int]]:
        sets = [np.frombuffer(p, dtype=np.uint64, offset=8 * n) for p in payload]
        size = np.array([len(s) for s in sets])
        if len(sets) >= MANY and size.sum() <= LONG and split_at < len(sets):
            yield from at_once(sets, group, split_at)
            return
        sig = np.frombuffer(b"".join(p[: 8 * n] for p in payload), dtype=np.int64).reshape(-1, n)
        for i in range(len(sets)):
            rest = np.arange(max(i + 1, split_at), len(sets)) if i < split_at or not split_at else np.zeros(0, dtype=np.int64)
            rest = rest[group[rest] != group[i]]
            rest = rest[100 * np.minimum(size[rest], size[i]) >= percent * np.maximum(size[rest], size[i])]
            agree = (sig[rest] == sig[i]).sum(axis=1)
            for j in rest[agree >= match][np.argsort(-agree[agree >= match], kind="stable")]:
                if group[j] == group[i]:
                    continue
                at = np.searchsorted(sets[i], sets[j])
                both = int((sets[i][np.minimum(at, size[i] - 1)] == sets[j]).sum())
                if 100 * both >= percent * (size[i] + size[j] - both):
                    yield i, int(j)
                    group[group == group[j]] = group[i]

    return run


def edges_within(rows: DataFrame, keys: list[str], joins: Joins) -> DataFrame:
    """Edges (a, b), as stars, of the groups that ``joins`` makes of the rows (node, grp, side, weight, payload) of equal ``keys``; side 1 is compared with side 0 only, side null with all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                if held and any(row[c] != held[0][c] for c in keys):
                    found += one(held)
                    held = []
                held.append(row)
            if found:
                yield out(found)
        if held and (found := one(held)):
            yield out(found)

    def one(held: list[dict]) -> list[tuple[int, int]]:
        nodes = [r["node"] for r in held]
        _, known, group = np.unique([r["grp"] for r in held], return_index=True, return_inverse=True)
        split_at = sum(r["side"] == 0 for r in held)
        for _ in joins([r["payload"] for r in held], group, split_at):
            pass
        # a member of each group that was known before, joined to the least of those that its group has now
        least: dict[int, int] = {}
        for i in known:
            least[group[i]] = min(nodes[i], least.get(group[i], nodes[i]))
        return [(nodes[i], least[group[i]]) for i in known if nodes[i] != least[group[i]]]

    def out(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    ready = rows.repartition(*keys).sortWithinPartitions(*keys, "side", F.desc("weight"), "node")
    return ready.select(*keys, "node", "grp", "side", "payload").mapInArrow(run, "a long, b long")


def joined_groups(members: DataFrame, payload: DataFrame, joins: Joins, block: int = BLOCK) -> DataFrame:
    """(node, root) after joining, inside every group of ``members`` (bin, node, weight), what ``joins`` joins; ``payload``: (node, payload)."""
    whole = members.groupBy("bin").agg(F.count("*").alias("n"), F.max(F.struct("weight", "node"))["node"].alias("centre")).where("n > 1")
    whole = whole.withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    placed = members.join(whole, "bin").withColumn("block", F.pmod(F.xxhash64(F.lit(5), "node"), F.col("blocks")).cast("int"))
    placed = written(placed, "members")
    centres = placed.where("node = centre AND blocks > 1").withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("`to` <> block").drop("block").withColumnRenamed("to", "block")
    rows = placed.unionByName(centres).select("bin", "block", "node", "weight").join(payload, "node").withColumn("grp", F.col("node")).withColumn("side", F.lit(None).cast("int"))
    edges = written(edges_within(rows, ["bin", "block"], joins), "edges")
    tree = components(edges)
    if not placed.where("blocks > 1").take(1):
        return tree
    # groups of several blocks that still have several components: the largest one stays in blocks of its own, the
    # nodes of the others go to each of these, and among themselves to pairs of blocks
    known = placed.where("blocks > 1").join(tree, "node", "left").select("bin", "node", "weight", F.coalesce("root", "node").alias("grp"))
    parts = known.groupBy("bin", "grp").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("bin").agg(F.max(F.struct("n", "grp")).alias("main"), F.sum("n").alias("all")).where(F.col("all") > F.col("main.n"))
    dealt = lambda n: F.ceil(n / block).cast("int")
    mixed = written(mixed.select("bin", F.col("main.grp").alias("main"), dealt(F.col("main.n")).alias("large"), dealt(F.col("all") - F.col("main.n")).alias("small")), "mixed")
    if not mixed.take(1):
        return tree
    left = written(known.join(mixed, "bin"), "mixed-members")
    hashed = lambda n: F.pmod(F.xxhash64(F.lit(6), "node"), n).cast("int")
    to = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    kept = ["node", "weight", "grp"]
    main = F.col("grp") == F.col("main")
    large = left.where(main).select("bin", hashed(F.col("large")).alias("p"), to(F.col("small")).alias("q"), *kept, F.lit(0).alias("side"))
    small = left.where(~main).withColumn("own", hashed(F.col("small")))
    beside = small.select("bin", to(F.col("large")).alias("p"), F.col("own").alias("q"), *kept, F.lit(1).alias("side"))
    among = small.withColumn("other", to(F.col("small")))
    among = among.select("bin", (-1 - F.least("own", "other")).alias("p"), F.greatest("own", "other").alias("q"), *kept, F.when(F.col("own") < F.col("other"), 0).when(F.col("own") > F.col("other"), 1).alias("side"))
    pairs = large.unionByName(beside).unionByName(among).join(payload, "node")
    more = written(edges_within(pairs, ["bin", "p", "q"], joins), "edges")
    return components(edges.union(more)) if more.take(1) else tree


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, n: int = COORDINATES, loss: float = 1e-5, block: int = BLOCK) -> DataFrame:
    """(key, n_shingles, component_id, kept, first, text_tag) for every row of ``docs``.

    Documents whose k-word shingle sets have 100 * intersection >= percent *
    union are linked; component_id is the smallest key that can be reached,
    kept is true for that one. A null or empty text has an empty set and no
    links; rows with a null key link like others but never name a component (a
    component of such rows only has a null id, and one text of it is kept).
    ``first`` is true for one (key, text) of each component, and ``text_tag`` is
    the text's hash, so rows can be told apart where a key repeats. Rows that
    share key and text are one document. An empty table gives an empty table.
    """
    match = match_threshold(n, percent / 100, loss)
    base = told_apart(written(signed(docs, key, text, k, n), "signatures"))
    # one row per node: that of its smallest key, null keys last
    own = F.struct(F.col("key").isNull().alias("none"), "key", "tag")
    nodes = written(base.where("node IS NOT NULL").groupBy("node").agg(F.min(own).alias("own"), F.count("*").alias("rows")), "nodes")
    chosen = base.join(nodes.select("node", F.col("own.key").alias("least"), F.col("own.tag").alias("least_tag")), "node").where(F.col("key").eqNullSafe(F.col("least")) & (F.col("tag") == F.col("least_tag"))).dropDuplicates(["node"]).select("node", "key", "tag", "tokens")
    tokens = chosen.select("node", F.explode("tokens").alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    posted = tokens.join(shared, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("posts"), F.sum("n").alias("weight"))
    posted = written(posted.where(F.size("posts") >= match).withColumn("posts", F.slice("posts", 1, F.size("posts") - match + 1)), "postings")
    blob = F.unhex(F.array_join(F.transform("tokens", lambda t: F.lpad(F.hex(t), 16, "0")), ""))
    sigs = written(posted.select("node").join(chosen, "node").select("node", "key", "tag", blob.alias("payload")), "candidates")
    lists = posted.select(F.explode("posts.token").alias("bin"), "node", "weight")
    clusters = written(joined_groups(lists, sigs.select("node", "payload"), by_signature(match, n), block), "clusters")
    roots = clusters.select("root").distinct().select(F.col("root").alias("node"), "root")
    inside = clusters.union(roots).join(posted.select("node", "weight"), "node").select(F.col("root").alias("bin"), "node", "weight")
    inside = written(inside, "cluster-members")
    sets = sets_of(docs, inside.select("node").join(sigs.select("node", "key", "tag"), "node"), key, text, k)
    full = written(sets.withColumnRenamed("payload", "set").join(sigs, "node").select("node", F.concat("payload", "set").alias("payload")), "sets")
    links = joined_groups(inside, full, by_set(percent, match, n), block)
    forest = nodes.join(links, "node", "left").select("node", "own", F.coalesce("root", "node").alias("root"))
    firsts = written(forest.groupBy("root").agg(F.min("own").alias("first")), "components")
    named = written(forest.join(firsts, "root").select("node", "first"), "named")
    out = base.select("key", "tag", "n_shingles", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("first.key"))
    one = F.col("node").isNull() | (F.col("key").eqNullSafe(F.col("first.key")) & (F.col("tag") == F.col("first.tag")))
    kept = F.when(F.col("key").isNull(), one).otherwise(F.coalesce(F.col("key") == component, F.lit(False)))
    return out.select(F.col("key").alias(key), "n_shingles", component.alias("component_id"), kept.alias("kept"), one.alias("first"), F.col("tag").alias("text_tag"))
