"""Most similar vectors for every vector: a hash-prefix forest (problem 1).

Every tree gives each vector a long hash string, one bit for the side of a
random plane through the centre of the collection; a tree is the sorted array
of these strings. A query descends to the longest prefix that still has enough
vectors and ascends, in all trees at the same depth, until the trees together
hold `candidates` of them; those are compared by cosine.

The number of trees grows with the collection, and no query descends deeper than
the depth at which a pair of the least wanted cosine (as seen from the centre)
shares its prefix in some tree with probability `recall`. So where many vectors
lie close together a query is compared with all that share the prefix, however
many they are: pairs of a small angle share it nearly surely, and no budget cuts
them off.

On a cluster the sorted arrays are cut into subtrees of at most `leaf` vectors.
How many vectors share each of the first `counted` bits is counted beforehand
(at most 2^counted numbers a tree, whatever the size of the data); from the
counts each query knows, without asking anybody, the depth at which the trees
together have enough candidates, and so the subtrees to visit. Prefixes with
more vectors than a subtree may hold are counted further, some bits deeper each
time, and where vectors can't be told apart by any bit they are split into
blocks that all get the query. A tree has at most about 2 x MOST_LEAVES
subtrees, so the plan that goes to all tasks stays bounded: on larger collections
a subtree holds more and is split into blocks too. In a block the queries with
the same range of the sorted array are compared with that range by one matrix
product.

Equal vectors are one vector with several ids. Vectors travel as 16-bit
numbers with a proven bound of the error, to subtrees of dense places (where that
bound would leave too many pairs open) as 32-bit numbers; wherever that bound could change the
result, the cosine is computed again from the original vectors.

The result is approximate: what is lost are neighbours that share no prefix of
the visited depth with the query in any tree. README gives measured recalls.

Defined results
* usable are vectors of `dim` finite entries that are not all zero; others (also null) take no part.
* repeated deliveries of an id count once; equal cosines go to the smaller id.
* fewer than k vectors: all of them; an empty table on either side gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.tables import cut, partitions

BITS = 56
QUERIES = 32_768  # queries sent to one copy of a subtree
MOST_LEAVES = 1 << 15  # of a tree: on larger collections subtrees have more blocks instead
MOST_PREFIXES = 1 << 16  # of a tree, counted at once below the first level
MOST_TREES = 32  # on collections that would need more, queries stay at a smaller depth instead
MOST_COUNTED = 16  # bits of the first counts, whatever the size of the collection
SENT = 500_000  # copies of queries packed at once
CHUNK = 60_000
FEW_PAIRS = 50_000  # pairs to compute again that may be broadcast


@dataclass(frozen=True)
class Forest:
    trees: int = 6  # at least; more on larger collections
    candidates: int = 3_072  # of all these trees together, before a query stops ascending
    visited: int = 8_192  # about as many vectors of a tree may have to be visited before trees are added
    dim: int = 64
    seed: int = 17
    leaf: int = 16_384  # vectors of a subtree
    counted: int = 12  # bits of the prefixes counted at first; more on larger collections
    near: float = 0.85  # cosine of the pairs to find where the call names none
    recall: float = 0.95  # least probability that such a pair shares a visited prefix

    def planes(self) -> np.ndarray:
        return np.random.default_rng(self.seed).standard_normal((self.dim, self.trees * BITS)).astype(np.float32)

    def deepest(self, cosine: float) -> int:
        """The greatest depth at which a pair of this cosine shares its prefix in some tree with probability `recall`."""
        same = 1 - float(np.arccos(np.clip(cosine, -1, 1))) / np.pi  # the same side of one plane
        if same <= 0:
            return 0
        return BITS if same >= 1 else min(BITS, int(np.log(1 - (1 - self.recall) ** (1 / self.trees)) / np.log(same)))

    def grown(self, n: int, cosine: float) -> Forest:
        """The forest for n vectors: so many trees that a query for pairs of this cosine needn't visit many more than `visited` vectors of each."""
        depth = min(MOST_COUNTED, max(1, n // max(1, self.visited)).bit_length() - 1)
        out = self
        while out.trees < MOST_TREES and out.deepest(cosine) < depth:
            out = replace(out, trees=out.trees + 1)
        return replace(out, candidates=self.candidates // self.trees * out.trees, counted=max(self.counted, depth))


def seen_from(centre: np.ndarray, cosine: float) -> float:
    """The mean cosine, about the centre, of pairs of unit vectors that have this cosine about the origin."""
    shift = min(float(np.dot(centre, centre)), 1 - 1e-6)  # the mean of x . centre
    return (cosine - shift) / (1 - shift)


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The usable rows of a list column as a matrix of unit vectors, and their numbers."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == dim)
    flat = column.take(pa.array(rows)).flatten()
    x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)  # null entries become NaN
    norms = np.sqrt((x * x).sum(axis=1))
    tiny = np.flatnonzero((norms == 0) | ~np.isfinite(norms))
    if len(tiny):  # norms that over- or underflow: scale first
        top = np.abs(x[tiny]).max(axis=1)
        fine = np.isfinite(top) & (top > 0)
        y = x[tiny[fine]] / top[fine, None]
        x = x.copy()
        x[tiny[fine]] = y
        norms[tiny[fine]] = np.sqrt((y * y).sum(axis=1))
    good = np.isfinite(norms) & (norms > 0)
    return (x[good] / norms[good, None]).astype(np.float32), rows[good]


def _codes(x: np.ndarray, centre: np.ndarray, planes: np.ndarray, trees: int) -> np.ndarray:
    """Hash strings (vector, tree) of BITS bits as integers; the first bit is the highest."""
    codes = np.zeros((len(x), trees), np.int64)
    for a in range(0, len(x), 8192):
        part = x[a : a + 8192]
        bits = np.zeros((len(part), trees, 64), bool)
        bits[:, :, 64 - BITS :] = ((part - centre) @ planes > 0).reshape(len(part), trees, BITS)
        codes[a : a + 8192] = np.packbits(bits, axis=2).view(">u8").reshape(len(part), trees)
    return codes


def _chunks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and unit vectors of the distinct usable vectors of every chunk."""
    got, n = [], 0

    def whole():
        rows = pa.Table.from_batches(got).combine_chunks()
        vec = rows.column("vec").combine_chunks()
        vec = vec.chunk(0) if isinstance(vec, pa.ChunkedArray) else vec
        keys = rows.column("vkey").to_numpy()
        x, at = _matrix(vec, dim)
        keys, first = np.unique(keys[at], return_index=True)
        return keys, x[first]

    for b in batches:
        if b.num_rows:
            got.append(b)
            n += b.num_rows
            if n >= CHUNK:
                yield whole()
                got, n = [], 0
    if n:
        yield whole()


def _key(vector: str) -> Column:
    """Key of a vector's content; the size tells apart what differs in nulls only, which the hash passes over."""
    return F.xxhash64(F.col(vector), F.size(vector))


def _vectors(df: DataFrame, vector: str) -> DataFrame:
    return df.filter(F.col(vector).isNotNull()).select(_key(vector).alias("vkey"), F.col(vector).alias("vec"))


def _centre(vectors: DataFrame, dim: int) -> tuple[np.ndarray, int]:
    """Mean of all unit vectors, rounded so that the order of the sums doesn't matter, and their number (copies in other chunks count again)."""

    def run(batches):
        total, n = np.zeros(dim), 0
        for _, x in _chunks(batches, dim):
            total += x.sum(axis=0, dtype=np.float64)
            n += len(x)
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(dim, dtype=np.int32)), "s": pa.array(total), "n": pa.array(np.full(dim, n))})

    sums = vectors.mapInArrow(run, "i int, s double, n bigint").groupBy("i").agg((F.sum("s") / F.greatest(F.sum("n"), F.lit(1))).alias("m"), F.sum("n").alias("n")).collect()
    centre = np.zeros(dim, np.float32)
    for r in sums:
        centre[r["i"]] = round(r["m"], 4)
    return centre, max((r["n"] for r in sums), default=0)


Level = list[tuple[np.ndarray, np.ndarray]]


def _counts(vectors: DataFrame, forest: Forest, centre: np.ndarray, depth: int, step: int = 0, within: list[np.ndarray] | None = None) -> Level:
    """Per tree the prefixes of `depth` bits that occur and their numbers of vectors; only below the prefixes `within`, which are `step` bits shorter."""
    trees, dim, planes = forest.trees, forest.dim, forest.planes()

    def run(batches):
        found: list[dict[int, int]] = [{} for _ in range(trees)]
        for _, x in _chunks(batches, dim):
            codes = _codes(x, centre, planes, trees)
            for t in range(trees):
                p = codes[:, t] >> (BITS - depth)
                if within is not None:
                    p = p[np.isin(p >> step, within[t])]
                for v, c in zip(*(a.tolist() for a in np.unique(p, return_counts=True))):
                    found[t][v] = found[t].get(v, 0) + c
        rows = [(t, v, c) for t in range(trees) for v, c in found[t].items()]
        yield pa.RecordBatch.from_pydict({"t": pa.array([r[0] for r in rows], pa.int32()), "p": pa.array([r[1] for r in rows], pa.int64()), "c": pa.array([r[2] for r in rows], pa.int64())})

    got = vectors.mapInArrow(run, "t int, p bigint, c bigint").groupBy("t", "p").agg(F.sum("c").alias("c")).toArrow()
    t, p, c = (got.column(n).to_numpy() for n in ("t", "p", "c"))
    out = []
    for k in range(trees):
        order = np.argsort(p[t == k])
        out.append((p[t == k][order], c[t == k][order]))
    return out


@dataclass
class Plan:
    """Where vectors and queries go. starts, blocks, copies, fine: per tree, of each subtree."""

    centre: np.ndarray
    deepest: int  # no query descends deeper
    sums: list[np.ndarray]  # per tree, running numbers of vectors by prefix of `counted` bits
    starts: list[np.ndarray]
    blocks: list[np.ndarray]
    copies: list[np.ndarray]
    fine: list[np.ndarray]  # whether it is one of many at a depth queries stop at


@dataclass
class Leaf:
    """A subtree: its first code, depth, vectors and queries."""

    start: int
    depth: int
    size: int
    asked: int


def _cut_tree(counts: tuple[np.ndarray, np.ndarray], asked: tuple[np.ndarray, np.ndarray], depth: int, root: int, root_depth: int, most: int) -> list[Leaf]:
    """Subtrees below the prefix `root`, from counts of prefixes of `depth` bits: halved while they have more than `most` vectors."""
    (p, c), (q, a) = counts, asked
    run, ask = np.concatenate([[0], np.cumsum(c)]), np.concatenate([[0], np.cumsum(a)])
    out: list[Leaf] = []
    todo = [(root, root_depth)]
    while todo:
        prefix, d = todo.pop()
        ends = np.array([prefix, prefix + 1], np.int64) << (depth - d)
        lo, hi = np.searchsorted(p, ends)
        n = int(run[hi] - run[lo])
        if n <= most or d == depth:
            lo, hi = np.searchsorted(q, ends)
            out.append(Leaf(prefix << (BITS - d), d, n, int(ask[hi] - ask[lo])))
        else:
            todo += [((prefix << 1) | 1, d + 1), (prefix << 1, d + 1)]
    return out


def _plan(vectors: DataFrame, queries: DataFrame, forest: Forest, centre: np.ndarray, cosine: float) -> Plan:
    level = _counts(vectors, forest, centre, forest.counted)
    asked = _counts(queries, forest, centre, forest.counted)
    most = max(forest.leaf, max(int(c.sum()) for _, c in level) // MOST_LEAVES)
    sums, trees = [], []
    for n, m in zip(level, asked):
        dense = np.zeros((1 << forest.counted) + 1, np.int64)
        dense[n[0] + 1] = n[1]
        sums.append(np.cumsum(dense))
        trees.append(_cut_tree(n, m, forest.counted, 0, 0, most))
    depth = forest.counted
    while depth < BITS:  # prefixes that hold more than a subtree may: count deeper below them
        large = [[x for x in tree if x.size > most and x.depth == depth] for tree in trees]
        widest = max(map(len, large))
        if not widest:
            break
        step = min(BITS - depth, max(1, MOST_PREFIXES.bit_length() - 1 - (widest - 1).bit_length()))
        within = [np.array([x.start >> (BITS - depth) for x in tree], np.int64) for tree in large]
        depth += step
        level, asked = (_counts(x, forest, centre, depth, step, within) for x in (vectors, queries))
        for t, tree in enumerate(trees):
            split = {x.start for x in large[t]}
            trees[t] = [x for x in tree if x.start not in split]
            for x in large[t]:
                trees[t] += _cut_tree(level[t], asked[t], depth, x.start >> (BITS - x.depth), x.depth, most)
    deepest = min(forest.counted, forest.deepest(cosine))
    starts, blocks, copies, fine = [], [], [], []
    for tree in trees:
        tree.sort(key=lambda x: x.start)
        starts.append(np.array([x.start for x in tree], np.int64))
        blocks.append(np.maximum(1, -(-np.array([x.size for x in tree]) // forest.leaf)))
        copies.append(np.maximum(1, -(-np.array([x.asked for x in tree]) // QUERIES)))
        fine.append(np.array([x.depth > deepest + 1 for x in tree]))
    return Plan(centre, deepest, sums, starts, blocks, copies, fine)


def _depths(codes: np.ndarray, plan: Plan, forest: Forest) -> np.ndarray:
    """The deepest level, the same in all trees and at most the plan's, at which they together have enough candidates."""
    depth = np.zeros(len(codes), np.int64)
    for d in range(1, plan.deepest + 1):
        total = np.zeros(len(codes), np.int64)
        for t, run in enumerate(plan.sums):
            p = codes[:, t] >> (BITS - d)
            width = 1 << (forest.counted - d)
            total += run[(p + 1) * width] - run[p * width]
        depth[total >= forest.candidates] = d
    return depth


def _record(dim: int, fine: bool = False) -> np.dtype:
    return np.dtype([("key", "<i8"), ("code", "<i8"), ("scale", "<f4"), ("depth", "u1"), ("x", "<f4" if fine else "<i2", (dim,))])


def _send(plan: Plan, forest: Forest, asking: bool):
    """Rows (place, asking, blob): the vectors or queries of a chunk, packed by the subtree copy they go to."""
    trees, dim, planes = forest.trees, forest.dim, forest.planes()
    kind = _record(dim)

    def run(batches):
        for keys, x in _chunks(batches, dim):
            if not len(keys):
                continue
            codes = _codes(x, plan.centre, planes, trees)
            rec = np.zeros(len(keys), kind)
            rec["key"] = keys
            rec["scale"] = np.abs(x).max(axis=1) / 32767
            rec["x"] = np.rint(x / rec["scale"][:, None])
            if asking:
                rec["depth"] = _depths(codes, plan, forest)
            for t in range(trees):
                rec["code"] = codes[:, t]
                for place, row in _places(plan, t, keys, codes[:, t], rec["depth"].astype(np.int64), asking):
                    order = np.lexsort(place[::-1])
                    place, row = place[:, order], row[order]
                    new = np.flatnonzero(np.concatenate([[True], (np.diff(place, axis=1) != 0).any(axis=0)]))
                    ends = np.append(new[1:], len(row))

                    def pack(a: int, b: int) -> bytes:
                        part = rec[row[a:b]]
                        if plan.fine[t][place[1, a]]:
                            part = part.astype(_record(dim, True))
                            part["x"] = x[row[a:b]]
                        return part.tobytes()

                    yield pa.RecordBatch.from_pydict(
                        {
                            **{n: pa.array(place[i, new], pa.int32()) for i, n in enumerate(("tree", "leaf", "block", "copy"))},
                            "asking": pa.array(np.full(len(new), asking)),
                            "blob": pa.array([pack(a, b) for a, b in zip(new, ends)], pa.binary()),
                        }
                    )

    return run


def _places(plan: Plan, t: int, keys: np.ndarray, codes: np.ndarray, depth: np.ndarray, asking: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (tree, leaf, block, copy) in tree t and the row that goes to each: of vectors at once, of queries about SENT at a time."""
    if not asking:
        leaf = np.searchsorted(plan.starts[t], codes, "right") - 1
        row, copy = _spread(plan.copies[t][leaf], 0)
        leaf = leaf[row]
        block = (keys[row] >> 8) % plan.blocks[t][leaf]
        yield np.stack([np.full(len(row), t), leaf, block, copy]), row
        return
    shift = BITS - depth
    low = (codes >> shift) << shift
    first = np.searchsorted(plan.starts[t], low, "right") - 1
    last = np.searchsorted(plan.starts[t], low + (np.int64(1) << shift) - 1, "right") - 1
    run = np.concatenate([[0], np.cumsum(plan.blocks[t])])
    piece = np.cumsum(run[last + 1] - run[first]) // SENT
    for some in np.split(np.arange(len(keys)), np.flatnonzero(np.diff(piece)) + 1):
        row, leaf = _spread(last[some] - first[some] + 1, first[some])
        each, block = _spread(plan.blocks[t][leaf], 0)
        row, leaf = some[row[each]], leaf[each]
        yield np.stack([np.full(len(row), t), leaf, block, keys[row] % plan.copies[t][leaf]]), row


def _spread(times: np.ndarray, first) -> tuple[np.ndarray, np.ndarray]:
    """Each row number `times` times, and beside it first, first + 1, ..."""
    row = np.repeat(np.arange(len(times)), times)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    return row, offset + (first[row] if isinstance(first, np.ndarray) else first)


_PAIRS = "akey bigint, lkey bigint, sim double, err double"


def _compare(forest: Forest, k: int, min_cosine: float | None, plan: Plan):
    """Queries of a subtree against their ranges of its sorted array."""
    half = np.sqrt(forest.dim) / 2

    def unpack(blobs, fine: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Records, vectors and the bounds of their errors."""
        rec = np.frombuffer(b"".join(blobs), dtype=_record(forest.dim, fine))
        _, first = np.unique(rec["key"], return_index=True)  # the same vector from several chunks
        rec = rec[first]
        if fine:
            return rec, rec["x"].astype(np.float64), np.full(len(rec), 2.0**-23)
        return rec, rec["x"].astype(np.float32) * rec["scale"][:, None], rec["scale"] * half

    def run(table: pa.Table) -> pa.Table:
        asking = table.column("asking").to_numpy()
        blobs = table.column("blob").to_pylist()
        parts: list[tuple] = []
        if asking.any() and not asking.all():
            fine = bool(plan.fine[table.column("tree")[0].as_py()][table.column("leaf")[0].as_py()])
            rest = 1e-9 if fine else 2e-6  # errors of the product
            base, y, e_base = unpack([b for b, a in zip(blobs, asking) if not a], fine)
            order = np.argsort(base["code"], kind="stable")
            base, y, e_base = base[order], np.ascontiguousarray(y[order]), e_base[order]
            ask, x, e_ask = unpack([b for b, a in zip(blobs, asking) if a], fine)
            codes = np.ascontiguousarray(base["code"])
            shift = BITS - ask["depth"].astype(np.int64)
            low = (ask["code"] >> shift) << shift
            lo, hi = np.searchsorted(codes, low), np.searchsorted(codes, low + (np.int64(1) << shift))
            by = np.lexsort((hi, lo))
            change = np.flatnonzero(np.concatenate([[True], (np.diff(lo[by]) != 0) | (np.diff(hi[by]) != 0)])) if len(by) else []
            for s, e in zip(change, np.append(change[1:], len(by)) if len(by) else []):
                a, b = lo[by[s]], hi[by[s]]
                if a == b:
                    continue
                step = max(1, 4_000_000 // int(b - a))
                widest = float(e_base[a:b].max())
                for at in range(s, e, step):
                    rows = by[at : min(e, at + step)]
                    sims = x[rows] @ y[a:b].T
                    slack = (e_ask[rows] + widest) * 1.01 + rest
                    floor = np.full(len(rows), -2.0) if min_cosine is None else min_cosine - slack
                    if b - a > k:
                        many = np.flatnonzero((sims >= floor[:, None]).sum(axis=1) > k) if min_cosine is not None else np.arange(len(rows))
                        if len(many):
                            kth = np.partition(sims[many], b - a - k, axis=1)[:, b - a - k]
                            floor[many] = np.maximum(floor[many], kth - 2 * slack[many])
                    r, c = np.nonzero(sims >= floor[:, None])
                    if len(r):
                        parts.append((ask["key"][rows[r]], base["key"][a + c], sims[r, c], e_ask[rows[r]] + e_base[a + c] + rest))
        cols = [np.concatenate(p) for p in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)] * 2
        return pa.table({n: pa.array(c.astype(t)) for n, c, t in zip(("akey", "lkey", "sim", "err"), cols, (np.int64, np.int64, np.float64, np.float64))})

    return run


def _few_ids(df: DataFrame, id_: str, vector: str, k: int) -> DataFrame:
    """(lkey, ids): the k smallest ids of every vector; pruned by chunks before the shuffle."""

    def run(batches):
        got, n = [], 0

        def prune():
            rows = pa.Table.from_batches(got)
            key, id_s = rows.column("lkey").to_numpy(), rows.column("id").to_numpy()
            order = np.lexsort((id_s, key))
            key, id_s = key[order], id_s[order]
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (id_s[1:] != id_s[:-1])
            key, id_s = key[fresh], id_s[fresh]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            here = np.arange(len(key))
            keep = here - np.maximum.accumulate(np.where(new, here, 0)) < k
            return pa.RecordBatch.from_pydict({"lkey": pa.array(key[keep]), "id": pa.array(id_s[keep])})

        for b in batches:
            if b.num_rows:
                got.append(b)
                n += b.num_rows
                if n >= 4 * CHUNK:
                    yield prune()
                    got, n = [], 0
        if n:
            yield prune()

    ids = df.filter(F.col(vector).isNotNull() & F.col(id_).isNotNull()).select(_key(vector).alias("lkey"), F.col(id_).cast("bigint").alias("id"))
    return ids.mapInArrow(run, "lkey bigint, id bigint").groupBy("lkey").agg(F.slice(F.sort_array(F.collect_set("id")), 1, k).alias("ids"))


def most_similar(queries: DataFrame, query_id: str, query_vector: str, base: DataFrame, base_id: str, base_vector: str, k: int = 10, min_cosine: float | None = None, forest: Forest = Forest()) -> DataFrame:
    """(query_id, base_id, cosine): the k base vectors of highest cosine of every query, if at least min_cosine."""
    asked, there = _vectors(queries, query_vector), _vectors(base, base_vector)
    centre, n = _centre(there, forest.dim)
    cosine = seen_from(centre, forest.near if min_cosine is None else min_cosine)
    forest = forest.grown(n, cosine)
    plan = _plan(there, asked, forest, centre, cosine)
    ddl = "tree int, leaf int, block int, copy int, asking boolean, blob binary"
    sent = there.mapInArrow(_send(plan, forest, False), ddl).unionByName(asked.mapInArrow(_send(plan, forest, True), ddl))
    found = sent.groupBy("tree", "leaf", "block", "copy").applyInArrow(_compare(forest, k, min_cosine, plan), _PAIRS)
    pairs = found.groupBy("akey", "lkey").agg(F.max("sim").alias("sim"), F.max("err").alias("err"))

    named = pairs.join(_few_ids(base, base_id, base_vector, k), "lkey").select("akey", "lkey", "sim", "err", F.explode("ids").alias("id"))
    per = Window.partitionBy("akey")
    placed = named.withColumn("r", F.row_number().over(per.orderBy(F.desc("sim"), "id")))
    placed = placed.withColumns({"kth": F.max(F.when(F.col("r") == k, F.col("sim"))).over(per), "e": F.max("err").over(per), "n": F.count("*").over(per)})
    placed = placed.filter("n <= %d or sim >= kth - 2 * e" % k)
    close = F.col("n") > k if min_cosine is None else (F.abs(F.col("sim") - min_cosine) <= F.col("err")) | (F.col("n") > k)
    unsure = close & ((F.col("n") <= k) | (F.col("sim") <= F.col("kth") + 2 * F.col("e")) | (F.abs(F.col("sim") - (min_cosine if min_cosine is not None else -9)) <= F.col("err")))
    placed = cut(placed.select("akey", "lkey", "id", "sim", unsure.alias("unsure")))

    again = placed.filter("unsure").select("akey", "lkey").distinct()
    small = again.limit(FEW_PAIRS + 1).count() <= FEW_PAIRS
    left = F.broadcast(again) if small else again
    with_y = there.withColumnsRenamed({"vkey": "lkey", "vec": "y"}).join(left, "lkey")
    with_y = with_y.dropDuplicates(["akey", "lkey"])
    both = asked.withColumnsRenamed({"vkey": "akey", "vec": "x"}).join(F.broadcast(with_y) if small else with_y, "akey")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    exact = both.select("akey", "lkey", (dot("x", "y") / F.sqrt(dot("x", "x")) / F.sqrt(dot("y", "y"))).alias("exact")).groupBy("akey", "lkey").agg(F.max("exact").alias("exact"))
    scored = placed.join(exact, ["akey", "lkey"], "left").withColumn("cosine", F.coalesce("exact", "sim"))
    if min_cosine is not None:
        scored = scored.filter(F.col("cosine") >= min_cosine)
    final = scored.withColumn("r", F.row_number().over(per.orderBy("unsure", F.desc("cosine"), "id"))).filter(F.col("r") <= k).select("akey", "id", "cosine")

    ids = queries.filter(F.col(query_vector).isNotNull() & F.col(query_id).isNotNull()).select(F.col(query_id).alias("qid"), _key(query_vector).alias("akey")).distinct()
    return ids.join(final, "akey").select(F.col("qid").alias(query_id), F.col("id").alias(base_id), "cosine")


def similar_landmarks(anchors: DataFrame, landmarks: DataFrame, k: int = 10, min_cosine: float = 0.85, forest: Forest = Forest()) -> DataFrame:
    """(anchor_id, landmark_id, cosine): every usable descriptor's landmarks among its k of highest cosine, from min_cosine on."""
    return most_similar(anchors, "anchor_id", "descriptor", landmarks, "landmark_id", "mu", k, min_cosine, forest)
