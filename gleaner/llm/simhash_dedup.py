"""SimHash near duplicates by a binary trie self-join.

A document's fingerprint takes, bit by bit, the majority of the XXH64 hashes of its word shingles. Equal fingerprints are
one leaf of the trie; only distinct fingerprints are joined. The join walks pairs of trie nodes from the top, adds up the
bits in which their paths differ, and prunes a pair whose sum exceeds the budget.

To deal the walk out, the bits are put in several orders. Of any m blocks of the 64 bits, two fingerprints that differ in k
bits agree in m - k at least; so each choice of m - k blocks, put first, is the top of one trie, in which only pairs on the
diagonal have to be followed. m grows with the number of fingerprints, so that a node below the top holds few. A node
that still holds more than NODE (a group of many near copies) is split further down the trie into the pairs of its
children, before any task loads it. Within a task links are united at once, so a group of n sends at most n - 1 of them on.

Components come from minimum labels with pointer jumping over the links, as tables in the shared folder.

Defined results: a text without words (null, empty, blank) has fingerprint 0, linked like any other; texts shorter than a
shingle count as one shingle; repeated rows share a component; a null doc_id is never a component's id unless it has no
other; an empty table gives no rows; other columns, whatever their names, are passed on by survivors() and not read.

The pipeline's stage, survivors(), takes five-word shingles and a similarity of 0.8. SimHash of 64 bits tells this from
chance too badly, so it uses wide fingerprints of 256 bits and several tries of 64 of these, chosen at random; the pair is
found that agrees at the top of one. Links found so are verified on the shingles themselves. Measured recall is in the README.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import LOWER, chunks, fresh, mixed, numbered, own_columns, shared_dir, sliced, spans, stored, text_bytes, word_hashes
from gleaner.operators.scan import in_groups
from gleaner.sources import staging

SHINGLE = 4
SEED = 42
BUDGET = 4
#: Most fingerprints of a node that one task walks.
NODE = 20_000
#: A node of the walk with at most so many pairs is compared leaf by leaf.
LEAF = 16
FRONTIER = 1 << 19


def fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(SHINGLE, len(words))
    first, last = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    of = xxhash.xxh64_intdigest
    counts, step = np.zeros(64, np.int64), 1 << 16
    for i in range(0, len(first), step):
        h = np.array([of(line[a:b], SEED) for a, b in zip(first[i : i + step], last[i : i + step], strict=True)], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(first), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (64 bits in a long) of each row."""
    id_type = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for batch in sliced(batches):
            found = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, fp long")


def orders(m: int, budget: int = BUDGET) -> list[tuple[list[int], int]]:
    """Bit orders (most significant first) whose first bits must agree, and how many these are."""
    edges = [64 * i // m for i in range(m + 1)]
    blocks = [list(range(edges[i], edges[i + 1])) for i in range(m)]
    out = []
    for top in combinations(range(m), m - budget):
        first = [b for i in top for b in blocks[i]]
        out.append((first + [b for i in range(m) if i not in top for b in blocks[i]], len(first)))
    return out


def blocks_for(n: int, budget: int = BUDGET) -> int:
    """The fewest blocks that leave about 64 of n spread fingerprints below a node at the top."""
    m = budget + 1
    while m < budget + 4 and n / 2 ** (64 * (m - budget) // m) > 64:
        m += 1
    return m


def permuted(x: np.ndarray, order: list[int]) -> np.ndarray:
    """Bits of x in the given order; bit 0 is the most significant."""
    bits = np.unpackbits(np.ascontiguousarray(x).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, order]
    return np.ascontiguousarray(np.packbits(bits, axis=1)).view(">u8").reshape(-1).astype(np.uint64)


def united(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels (the least index of each component so far) after linking u and v."""
    while len(u):
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return label
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(label, high, low)
        while not np.array_equal(up := label[label], label):
            label = up
    return label


def forest(label: np.ndarray, u: np.ndarray, v: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels after linking u and v, and the places of pairs that link as much as all of them, the nearest ones first."""
    picked, alive = [], np.arange(len(u))
    while True:
        a, b = label[u[alive]], label[v[alive]]
        apart = a != b
        alive, a, b = alive[apart], a[apart], b[apart]
        if not len(alive):
            return label, np.concatenate(picked) if picked else alive
        both, of = np.concatenate([a, b]), np.concatenate([alive, alive])
        order = np.lexsort((far[of], both))
        first = np.flatnonzero(np.concatenate([[True], both[order][1:] != both[order][:-1]]))
        picked.append(np.unique(of[order[first]]))
        label = united(label, u[picked[-1]], v[picked[-1]])


def walk(a: np.ndarray, b: np.ndarray | None, depth: int, dist: int, budget: int = BUDGET, wide: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each path's component from the walk below one level of a trie: the paths, and the root path of each.

    Without b, every node of that level is walked with itself, its paths being the sorted distinct a that share their first
    depth bits. With b, the one node of a is walked with the one node of b, whose first depth bits differ in dist places.
    With wide, the whole fingerprints of the paths a and then b, pairs of paths within budget are linked if these differ in REACH
    bits at most; paths may stand more than once. The result is then the places of pairs that link as much as all of them do.
    """
    picked = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    most = FRONTIER if wide is None else FRONTIER >> 4
    own = b is None
    x = a if own else np.concatenate([a, b])
    y, base = (a, 0) if own else (b, len(a))
    label = np.arange(len(x))
    if own:
        head = a >> np.uint64(64 - depth) if depth else np.zeros(len(a), np.uint64)
        lo = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]])) if len(a) else np.zeros(0, np.int64)
        hi = np.append(lo[1:], len(a))
        several = hi - lo > 1
        lo, hi = lo[several], hi[several]
        stack = [(depth, lo, hi, lo, hi, np.zeros(len(lo), np.int64))]
    else:
        stack = [(depth, *(np.array([v], np.int64) for v in (0, len(a), 0, len(y), dist)))]
    while stack:
        d, alo, ahi, blo, bhi, far = stack.pop()
        if len(alo) > most:
            half = len(alo) // 2
            stack += [(d, *(v[:half] for v in (alo, ahi, blo, bhi, far))), (d, *(v[half:] for v in (alo, ahi, blo, bhi, far)))]
            continue
        small = ((ahi - alo) * (bhi - blo) <= LEAF) | (d >= 64)
        if d >= 64:  # equal paths: no more pairs at once than memory holds
            many = ((ahi - alo) * (bhi - blo) > FRONTIER) & (ahi - alo > 1)
            if many.any():
                mid = (alo + ahi) // 2
                stack += [(d, *(v[many] for v in (alo, mid, blo, bhi, far))), (d, *(v[many] for v in (mid, ahi, blo, bhi, far)))]
            fits = ~many
            later = fits & (np.cumsum(np.where(fits, (ahi - alo) * (bhi - blo), 0)) > 2 * FRONTIER)
            if later.any() and (fits & ~later).any():
                stack.append((d, *(v[later] for v in (alo, ahi, blo, bhi, far))))
                fits &= ~later
            alo, ahi, blo, bhi, far, small = (v[fits] for v in (alo, ahi, blo, bhi, far, small))
        if small.any():
            n, w = (ahi - alo)[small], (bhi - blo)[small]
            of = np.repeat(np.arange(len(n)), n * w)
            k = np.arange(len(of)) - np.repeat(np.cumsum(n * w) - n * w, n * w)
            i, j = alo[small][of] + k // w[of], blo[small][of] + k % w[of]
            near = np.bitwise_count(a[i] ^ y[j]) <= budget
            if own:
                near &= i < j
            if wide is not None:
                i, j = i[near], j[near] + base
                apart = label[i] != label[j]
                i, j = i[apart], j[apart]
                far_ = np.bitwise_count(wide[i] ^ wide[j]).sum(1, dtype=np.int64)
                near = far_ <= REACH
                i, j, far_ = i[near], j[near], far_[near]
                label, some = forest(label, i, j, far_)
                picked.append((i[some], j[some]))
            else:
                label = united(label, i[near], j[near] + base)
        alo, ahi, blo, bhi, far = (v[~small] for v in (alo, ahi, blo, bhi, far))
        if not len(alo):
            continue
        bit = np.uint64(1) << np.uint64(63 - d)
        keep = ~((bit << np.uint64(1)) - np.uint64(1)) if d else np.uint64(0)
        amid = np.clip(np.searchsorted(a, (a[alo] & keep) | bit), alo, ahi)
        bmid = np.clip(np.searchsorted(y, (y[blo] & keep) | bit), blo, bhi)
        down = [(alo, amid, blo, bmid, far), (amid, ahi, bmid, bhi, far), (alo, amid, bmid, bhi, far + 1), (amid, ahi, blo, bmid, far + 1)]
        same = (alo == blo) & (ahi == bhi) if own else np.zeros(len(alo), bool)
        live = [(p[1] > p[0]) & (p[3] > p[2]) & (p[4] <= budget) for p in down]
        live[3] &= ~same  # a node with itself: its two children meet once
        stack.append((d + 1, *(np.concatenate([p[k][ok] for p, ok in zip(down, live, strict=True)]) for k in range(5))))
    if wide is not None:
        return np.concatenate([p[0] for p in picked]), np.concatenate([p[1] for p in picked])
    return x, x[label]


def links(distinct: DataFrame, budget: int = BUDGET, node: int = NODE) -> DataFrame:
    """(fp, root): links that connect just those of the distinct fingerprints that differ in budget bits or fewer, in steps."""
    plans = orders(blocks_for(distinct.count(), budget), budget)

    def lay(frames):
        for pdf in frames:
            x = pdf["fp"].to_numpy(np.int64).view(np.uint64)
            for i, (order, top) in enumerate(plans):
                p = permuted(x, order)
                head = (p >> np.uint64(64 - top)).view(np.int64)
                yield pd.DataFrame({"trie": i, "a": head, "b": head, "depth": top, "dist": 0, "side": 2, "path": p.view(np.int64)})

    spec = "trie int, a long, b long, depth int, dist int, side int, path long"
    key = ["trie", "depth", "a", "b", "dist"]
    todo, done = distinct.select("fp").mapInPandas(lay, spec), []

    def deeper(frames):
        """Rows of too full node pairs, dealt to the pairs of children 4 bits further down that the budget allows."""
        for pdf in frames:
            path = pdf["path"].to_numpy(np.int64).view(np.uint64)
            depth = pdf["depth"].to_numpy()
            step = np.minimum(4, 64 - depth)
            after = depth + step
            child = (path >> (64 - after).astype(np.uint64)).view(np.int64)
            for other in range(16):
                fits = other < (1 << step)
                for side in (0, 1):
                    mine = fits & ((pdf["side"] == side) | (pdf["side"] == 2)).to_numpy()
                    if not mine.any():
                        continue
                    facing = np.where(side == 0, pdf["b"], pdf["a"])
                    if not len(facing):
                        continue
                    theirs = (facing << step) | other
                    first, second = (child, theirs) if side == 0 else (theirs, child)
                    dist = pdf["dist"].to_numpy() + np.bitwise_count((child ^ theirs) & ((1 << step) - 1))
                    alike = first == second
                    both = (pdf["side"] == 2).to_numpy()
                    ok = mine & (dist <= budget) & ~(both & (first > second)) & ~(alike & (side == 1) & both)
                    yield pd.DataFrame({"trie": pdf["trie"], "a": first, "b": second, "depth": after, "dist": dist, "side": np.where(alike & both, 2, side), "path": pdf["path"]})[ok]

    while True:
        todo = stored(todo)
        full = stored(todo.groupBy(*key).agg(F.count("*").alias("rows")).where((F.col("rows") > node) & (F.col("depth") < 64)).select(*key))
        if full.isEmpty():
            done.append(todo)
            break
        done.append(todo.join(full, key, "left_anti").select(*todo.columns))
        todo = todo.join(full, key, "left_semi").select(*todo.columns).mapInPandas(deeper, spec)
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    def found(part: pd.DataFrame):
        """Links of whole node pairs: all pairs on the diagonal of a level in one walk, others one by one."""
        alike = part["a"] == part["b"]
        groups = [(g, True) for g in part[alike].groupby(["trie", "depth"])] + [(g, False) for g in part[~alike].groupby(key)]
        for (name, rows), diagonal in groups:
            path, side = rows["path"].to_numpy(np.int64).view(np.uint64), rows["side"].to_numpy()
            a, b = (np.unique(path), None) if diagonal else (np.unique(path[side == 0]), np.unique(path[side == 1]))
            if not diagonal and not (len(a) and len(b)):
                continue
            x, root = walk(a, b, int(name[1]), 0 if diagonal else int(name[4]), budget)
            linked = x != root
            back = np.argsort(plans[int(name[0])][0]).tolist()
            if linked.any():
                yield pd.DataFrame({"fp": permuted(x[linked], back).view(np.int64), "root": permuted(root[linked], back).view(np.int64)})

    def join(frames):
        held: list[pd.DataFrame] = []
        for pdf in frames:
            held.append(pdf)
            if sum(map(len, held)) >= 4 * node:
                rows = pd.concat(held)
                last = (rows[key] == rows[key].iloc[-1]).all(axis=1).to_numpy()  # a node pair that may go on
                yield from found(rows[~last])
                held = [rows[last]]
        if held:
            yield from found(pd.concat(held))

    return rows.repartition(*key).sortWithinPartitions(*key).mapInPandas(join, "fp long, root long").distinct()


def labelled(edges: DataFrame) -> DataFrame:
    """(fp, root) for each fingerprint with a link: the least fingerprint of its component."""
    both = stored(edges.select("fp", "root").unionByName(edges.select(F.col("root").alias("fp"), F.col("fp").alias("root"))))
    label = stored(both.groupBy("fp").agg(F.least(F.min("root"), F.col("fp")).alias("root")))
    while True:
        near = both.join(label.select(F.col("fp").alias("root"), F.col("root").alias("l")), "root").groupBy("fp").agg(F.min("l").alias("l"))
        step = stored(label.join(near, "fp").select("fp", F.least("root", "l").alias("new"), F.col("root").alias("old")))
        jump = step.select(F.col("fp").alias("new"), F.col("new").alias("up"))
        after = stored(step.join(jump, "new", "left").select("fp", F.least("new", F.coalesce("up", "new")).alias("root"), "old"))
        label = after.select("fp", "root")
        if after.where("root <> old").isEmpty():
            return label


def components(prints: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(fp, root) for each distinct fingerprint."""
    distinct = stored(prints.select("fp").distinct())
    label = labelled(links(distinct, budget))
    return stored(distinct.join(label, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")))


def report(docs: DataFrame) -> DataFrame:
    """The digest of the query: each document with its fingerprint and the smallest doc_id that it reaches."""
    prints = stored(fingerprints(docs))
    root = components(prints)
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("m")).join(root, "fp")
    first = least.groupBy("root").agg(F.min("m").alias("component_id"))
    of = root.join(first, "root").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- near copies of the pipeline: five-word shingles, a similarity of 0.8 or more ---

#: Words of a shingle; the most differing bits of WIDE_BITS that link; those of a path's 64 bits that the walk allows.
NEAR_SHINGLE = 5
WIDE_BITS = 256
REACH, PATH_REACH = 60, 22
#: Texts of a group, and bytes of their sets of shingles, that a task compares with as many others.
BLOCK, BLOCK_BYTES = 2048, 1 << 24
#: The least similarity of near copies.
LEAST = 0.8
#: The share of bits in which two equally long texts of similarity 0.8 are expected to agree, and the recall wanted of it.
AGREE, RECALL = 1 - float(np.arccos(8 / 9) / np.pi), 0.98
#: Fingerprints that a node below the top of a trie should hold.
NODE_MEANT = 128
_ODD = mixed(np.arange(301, 301 + NEAR_SHINGLE, dtype=np.uint64)) | np.uint64(1)
_WORD_ODD = mixed(np.arange(401, 401 + WIDE_BITS // 64, dtype=np.uint64)) | np.uint64(1)


def near_shingles(buf: np.ndarray, at: np.ndarray, k: int = NEAR_SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit code and the row of each shingle of texts laid end to end; a text of fewer words is one shingle."""
    starts, ends, row = spans(LOWER[buf], at)
    if not len(starts):
        return np.zeros(0, np.uint64), row
    w = word_hashes(LOWER[buf], starts, ends)
    code, size = np.zeros(len(w), np.uint64), len(w)
    for i in range(min(k, size)):
        code[: size - i] += np.where(row[: size - i] == row[i:], w[i:] * _ODD[i], 0)
    whole = np.zeros(size, bool)
    whole[: max(0, size - k + 1)] = row[: max(0, size - k + 1)] == row[k - 1 :]
    whole[np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))] = True
    return mixed(code[whole]), row[whole]


def wide_prints(buf: np.ndarray, at: np.ndarray, k: int = NEAR_SHINGLE) -> np.ndarray:
    """(rows x 32) bytes: the fingerprints of WIDE_BITS bits of texts laid end to end; zero without words."""
    counts, n = np.zeros((len(at) - 1, WIDE_BITS), np.int64), np.zeros(len(at) - 1, np.int64)
    code, row = near_shingles(buf, at, k)
    if len(code):
        step = 1 << 14
        for i in range(0, len(code), step):
            part, of = code[i : i + step], row[i : i + step]
            bits = np.unpackbits(mixed(part[:, None] * _WORD_ODD).view(np.uint8), axis=1)
            cut = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            counts[of[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
        n = np.bincount(row, minlength=len(n))
    return np.packbits(2 * counts > n[:, None], axis=1)


def wide_of(column: pa.Array) -> pa.Array:
    """The fingerprint of each text of a column, as 32 bytes."""
    buf, at = text_bytes(column)
    got = [wide_prints(buf[at[i] : at[j]], at[i : j + 1] - at[i]) for i, j in chunks(at)]
    whole = np.concatenate(got) if got else np.zeros((0, WIDE_BITS // 8), np.uint8)
    return pa.array([r.tobytes() for r in whole], pa.binary())


def as_words(column: pa.Array) -> np.ndarray:
    """Values of a column of equally many bytes as rows of 64-bit words."""
    whole = column.to_pylist()
    return np.frombuffer(b"".join(whole), np.uint64).reshape(len(whole), -1)


def node_of(texts: pa.Array, hashes: pa.Array) -> pa.Array:
    """What a text is in the tries: its fingerprint, and a hash that tells texts of one fingerprint apart."""
    return pa.array([fp + h for fp, h in zip(wide_of(texts).to_pylist(), (x.tobytes() for x in hashes.to_numpy()), strict=True)], pa.binary())


def parts_of(nodes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints as rows of 64-bit words, and the texts' hashes."""
    rows = as_words(nodes)
    return np.ascontiguousarray(rows[:, :-1]), rows[:, -1].view(np.int64)


def tries_for(n: int) -> tuple[int, list[np.ndarray]]:
    """How many bits must agree at the top of a trie, and the 64 bits that each trie's paths are made of.

    The more fingerprints there are, the more bits must agree; as many tries are taken as find a pair of similarity 0.8
    with a chance of RECALL.
    """
    top = max(0, int(np.log2(max(1, n / NODE_MEANT))))
    rng = np.random.default_rng(SEED)
    tries = 1 if not top else int(np.ceil(np.log(1 - RECALL) / np.log1p(-(AGREE**top))))
    return top, [rng.permutation(WIDE_BITS)[:64] for _ in range(tries)]


def near_links(distinct: DataFrame, node: int = NODE) -> DataFrame:
    """(fp, root, h, root_h): pairs of texts that may be near copies, found in one of several tries, with the texts' hashes: as many
    as it takes to connect what can be connected, the nearest first.

    A node that holds more than node fingerprints first gives way to its children, 4 bits further down, which links the members of
    a large group at once. Then its blocks of at most half of node meet each other, two in a task, but for those of what is linked
    already; so no pair of a full node is left out.
    """
    top, bits_of = tries_for(distinct.count())

    def lay(batches):
        for batch in batches:
            bits = np.unpackbits(parts_of(batch.column(0))[0].view(np.uint8), axis=1)
            for i, order in enumerate(bits_of):
                path = np.ascontiguousarray(np.packbits(bits[:, order], axis=1)).view(">u8").reshape(-1).astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(path), i, np.int32)), pa.array(path.view(np.int64)), batch.column(0)], ["trie", "path", "fp"])

    paths = distinct.select("fp").mapInArrow(lay, "trie int, path long, fp binary")
    level = lambda df, depth: df.withColumn("depth", F.lit(depth)).withColumn("head", F.expr(f"shiftrightunsigned(path, {64 - depth})") if depth else F.lit(0).cast("long"))
    key, depth, done = ["trie", "depth", "head"], top, None
    todo = every = level(paths, depth)  # paths are worked out again where they are used, which is cheaper than keeping them
    overfull = None
    while True:
        full = stored(todo.groupBy(*key).agg(F.count("*").alias("rows")).where(F.col("rows") > node).select(*key)) if depth < 64 else None
        fits = todo if full is None or full.isEmpty() else todo.join(full, key, "left_anti").select(*todo.columns)
        done = fits if done is None else done.unionByName(fits)
        if fits is todo:
            break
        overfull = full if overfull is None else overfull
        depth = min(64, depth + 4)
        todo = level(todo.join(full, key, "left_semi").select("trie", "path", "fp"), depth)
    if depth == 64 and overfull is not None:
        done = done.where(F.col("depth") < 64)  # equal paths that are too many for a task meet in blocks alone
    whole = done.select(*key, F.lit(0).alias("one"), F.lit(0).alias("other"), F.lit(0).alias("side"), "path", "fp")
    found = _met(whole, node)
    if overfull is None:
        return found
    found = stored(found)
    return found.unionByName(_met(_block_pairs(every.join(overfull, key, "left_semi"), labelled(found), key, max(1, node // 2)), node)).distinct()


def _block_pairs(rows: DataFrame, label: DataFrame, key: list[str], size: int) -> DataFrame:
    """The rows of full nodes, once for each pair of blocks that they stand in: a block holds about size rows, and those of a large
    linked group (label) stand in blocks of their own, which don't meet each other."""
    none = F.lit(b"")
    rows = stored(rows.join(label.withColumnRenamed("root", "group"), "fp", "left").withColumn("group", F.coalesce("group", none)))
    large = rows.where(F.length("group") > 0).groupBy(*key, "group").count().where(F.col("count") > size).select(*key, "group", F.lit(True).alias("large"))
    rows = rows.join(large, [*key, "group"], "left").withColumn("group", F.when(F.col("large"), F.col("group")).otherwise(none)).drop("large")
    blocks = stored(rows.groupBy(*key, "group").agg(F.ceil(F.count("*") / size).cast("int").alias("n")))
    rows = rows.join(blocks, [*key, "group"]).withColumn("nth", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")).drop("n")
    spread = blocks.select(*key, "group", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("nth"))
    spread = stored(spread.withColumn("block", F.xxhash64("group", "nth")))
    second = spread.select(*key, F.col("group").alias("group_"), F.col("nth").alias("nth_"), F.col("block").alias("block_"))
    pairs = spread.join(second, key).where("(group = group_ and group = X'' and nth <= nth_) or group < group_")
    sides = pairs.select(*key, "group", "nth", F.col("block").alias("one"), F.col("block_").alias("other"), F.lit(0).alias("side"))
    facing = pairs.where("block <> block_").select(*key, F.col("group_").alias("group"), F.col("nth_").alias("nth"), F.col("block").alias("one"), F.col("block_").alias("other"), F.lit(1).alias("side"))
    met = rows.join(stored(sides.unionByName(facing)), [*key, "group", "nth"])
    return met.select(*key, "one", "other", "side", "path", "fp")


def _met(dealt: DataFrame, node: int) -> DataFrame:
    """Links within each node (one = other), or between the two sides of each pair of blocks of a node."""
    key = ["trie", "depth", "head", "one", "other"]

    def found(rows: pa.Table):
        """Links of whole nodes: those of one level of a trie are walked at once, pairs of blocks one by one."""
        trie, depth, one, other, side = (rows[n].to_numpy() for n in ("trie", "depth", "one", "other", "side"))
        head, path = rows["head"].to_numpy(), rows["path"].to_numpy().view(np.uint64)
        order = np.lexsort((path, side, other, one, np.where(one == other, 0, head), depth, trie))
        raw = rows["fp"].combine_chunks()
        raw = (raw.chunk(0) if isinstance(raw, pa.ChunkedArray) else raw).take(pa.array(order))
        (wide, hashes), path = parts_of(raw), path[order]
        trie, depth, head, one, other, side = (x[order] for x in (trie, depth, np.where(one == other, 0, head), one, other, side))
        changes = np.logical_or.reduce([x[1:] != x[:-1] for x in (trie, depth, head, one, other)])
        cut = np.flatnonzero(np.concatenate([[True], changes]))
        for lo, hi in zip(cut, np.append(cut[1:], len(trie))):
            mid = lo + int(np.searchsorted(side[lo:hi], 1)) if one[lo] != other[lo] else hi
            if mid in (lo, hi) and one[lo] != other[lo]:
                continue
            second = None if mid == hi else path[mid:hi]
            u, v = walk(path[lo:mid], second, int(depth[lo]), 0, PATH_REACH, wide[lo:hi])
            if len(u):
                u, v = u + lo, v + lo
                yield pa.RecordBatch.from_arrays([raw.take(pa.array(u)), raw.take(pa.array(v)), pa.array(hashes[u]), pa.array(hashes[v])], ["fp", "root", "h", "root_h"])

    def join(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 4 * node:
                whole = pa.Table.from_batches(held).combine_chunks()
                columns = [whole[n].to_numpy() for n in key]
                same = np.logical_and.reduce([c == c[-1] for c in columns])
                cut = int(np.argmax(same))  # the last node may go on
                if cut:
                    yield from found(whole.slice(0, cut))
                held = whole.slice(cut).to_batches()
        if held:
            yield from found(pa.Table.from_batches(held))

    return dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(join, "fp binary, root binary, h long, root_h long").distinct()


def text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def near_sets(docs: DataFrame, hashes: DataFrame) -> DataFrame:
    """(h, codes): the distinct shingles of the texts that have these hashes (column h), as 32-bit codes."""
    texts = docs.select(text_hash().alias("h"), "text").join(hashes, "h", "left_semi").dropDuplicates(["h"])

    def codes(batches):
        for batch in sliced(batches):
            buf, at = text_bytes(batch.column(1))
            sets = []
            for i, j in chunks(at):
                code, row = near_shingles(buf[at[i] : at[j]], at[i : j + 1] - at[i])
                code = (code >> np.uint64(32)).astype(np.uint32)
                sets += [np.unique(x).tobytes() for x in np.split(code, np.searchsorted(row, np.arange(1, j - i)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["h", "codes"])

    return texts.mapInArrow(codes, "h long, codes binary")


def _alike(a: pa.Scalar, b: pa.Scalar) -> bool:
    """Whether two sets of codes have a similarity of LEAST or more."""
    x, y = np.frombuffer(a.as_buffer(), np.uint32), np.frombuffer(b.as_buffer(), np.uint32)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= LEAST * (len(x) + len(y) - both) - 1e-9


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(fp, root, near): whether the texts of each pair (fp, root, h, root_h) have a similarity of LEAST or more."""

    def alike(batches):
        for batch in sliced(batches):
            near = [_alike(a, b) for a, b in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.bool_())], ["fp", "root", "near"])

    met = pairs.join(sets.withColumnRenamed("codes", "a"), "h").join(sets.select(F.col("h").alias("root_h"), F.col("codes").alias("b")), "root_h")
    return met.select("fp", "root", "a", "b").mapInArrow(alike, "fp binary, root binary, near boolean")


def verified(pairs: DataFrame, docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (fp, root) of texts whose sets of five-word shingles have a similarity of LEAST or more, which connect all that such
    ones within REACH bits connect in each group that the pairs (fp, root, h, root_h) make.

    All texts of a group are compared with the one that has most pairs, which is linear in the group. A text that is no near copy
    of that one then meets all others, in blocks of a bounded number of texts and bytes, two in a task.
    """
    ends = stored(pairs.select("fp", "h").unionByName(pairs.select(F.col("root").alias("fp"), F.col("root_h").alias("h"))).groupBy("fp", "h").agg(F.count("*").alias("pairs")))
    sets = stored(near_sets(docs, ends.select("h").distinct()))
    group = stored(ends.join(labelled(pairs).withColumnRenamed("root", "group"), "fp"))
    lead = group.groupBy("group").agg(F.max(F.struct("pairs", "fp", "h")).alias("x")).select("group", F.col("x.fp").alias("root"), F.col("x.h").alias("root_h"))
    stars = stored(compared(group.join(lead, "group").where("fp <> root").select("fp", "root", "h", "root_h"), sets))
    links = stars.where("near").select("fp", "root")
    # a group of two has been compared as a whole
    alone = group.join(stars.where("not near").select("fp", F.lit(True).alias("alone")), "fp", "left").withColumn("alone", F.coalesce("alone", F.lit(False)))
    size = alone.groupBy("group").agg(F.count("*").alias("n"), F.count_if("alone").alias("a")).where("a > 0 and n > 2").select("group")
    rows = stored(alone.join(size, "group").select("group", "alone", "fp", "h").join(sets, "h").drop("h"))
    of = rows.groupBy("group").agg(*[F.greatest(F.lit(1), F.ceil(F.count_if(x) / block), F.ceil(F.sum(F.when(x, F.length("codes")).otherwise(0)) / BLOCK_BYTES)).cast("int").alias(n) for x, n in ((F.col("alone"), "a"), (~F.col("alone"), "s"))])
    of = stored(of.withColumn("one", (F.col("a") == 1) & (F.col("s") == 1)))
    rows = rows.join(of, "group").withColumn("nth", F.when(F.col("one"), 0).when(F.col("alone"), F.pmod(F.xxhash64("fp"), F.col("a"))).otherwise(F.col("a") + F.pmod(F.xxhash64("fp"), F.col("s"))).cast("int"))
    # blocks of those alone meet themselves and all blocks after them, others only those
    every = F.sequence(F.lit(0), F.when(F.col("one"), 0).otherwise(F.col("a") + F.col("s") - 1))
    facing = F.when(F.col("nth") < F.col("a"), every).otherwise(F.sequence(F.lit(0), F.col("a") - 1))
    met = rows.withColumn("facing", F.explode(facing)).withColumn("side", (F.col("nth") > F.col("facing")).cast("int"))
    met = met.select("fp", "codes", "alone", "side", "group", F.least("nth", "facing").alias("i"), F.greatest("nth", "facing").alias("j"))
    rest = in_groups(met, ["group", "i", "j"], ["side"], lambda table, cuts: _blocks_linked(table, cuts), "fp binary, root binary")
    return stored(links.unionByName(rest))


def _blocks_linked(rows: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
    """Links of near copies within REACH bits, of each pair of blocks as many as connect them; those not alone are one already."""
    fp, codes = (rows[n].combine_chunks() for n in ("fp", "codes"))
    fp, codes = (c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in (fp, codes))
    wide, alone, side, i_, j_ = parts_of(fp)[0], *(rows[n].to_numpy() for n in ("alone", "side", "i", "j"))
    size = np.fromiter((len(c.as_buffer()) // 4 for c in codes), np.int64, len(codes))
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        own, n = i_[lo] == j_[lo], hi - lo
        w, single, label = wide[lo:hi], alone[lo:hi], np.arange(n)
        if (~single).any():
            label[~single] = np.flatnonzero(~single)[0]
        split = n if own else int(np.searchsorted(side[lo:hi], 1))
        many = size[lo:hi]
        for first in range(0, split, 128):  # a strip of rows at a time
            a = np.arange(first, min(first + 128, split))
            b = np.arange(first, n) if own else np.arange(split, n)
            far = np.zeros((len(a), len(b)), np.int64)
            for k in range(w.shape[1]):
                far += np.bitwise_count(w[a, k][:, None] ^ w[b, k][None])
            near = (far <= REACH) & (label[a][:, None] != label[b][None])
            near &= np.minimum(many[a][:, None], many[b][None]) >= LEAST * np.maximum(many[a][:, None], many[b][None]) - 1e-9
            if own:
                near &= a[:, None] < b[None]
            x, y = np.nonzero(near)
            order = np.argsort(far[x, y], kind="stable")
            x, y = a[x[order]], b[y[order]]
            while len(x):  # a few at a time, as each link spares others
                apart = label[x] != label[y]
                x, y = x[apart], y[apart]
                like = np.array([_alike(codes[lo + p], codes[lo + q]) for p, q in zip(x[:64].tolist(), y[:64].tolist())], bool)
                u, v = x[:64][like], y[:64][like]
                x, y = x[64:], y[64:]
                if len(u):
                    out.append((u + lo, v + lo))
                    label = united(label, u, v)
    u, v = (pa.array(np.concatenate([p[k] for p in out])) for k in (0, 1))
    return pa.RecordBatch.from_arrays([fp.take(u), fp.take(v)], ["fp", "root"])


def survivors(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id, with all its columns.

    Near copies are texts whose sets of five-word shingles have a similarity of LEAST or more. Candidates are told by wide
    fingerprints: 256 bits of which such texts differ in 39 on the average, and REACH at most; each link is then verified on the
    shingles, so a document goes only if it is linked, directly or through others, with the one that stays.
    """
    names = own_columns(docs)
    fp, doc = fresh(docs, "fp"), fresh(docs, "id")

    def narrow(batches):
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), node_of(batch.column(1), batch.column(2))], ["doc_id", "fp"])

    path = shared_dir(docs.sparkSession)
    with staging.run(docs.sparkSession):  # what is stored on the way goes at its end; the outcome alone stays
        prints = stored(docs.select("doc_id", "text", text_hash()).mapInArrow(narrow, f"doc_id {dict(docs.dtypes)['doc_id']}, fp binary"))
        distinct = stored(prints.select("fp").distinct())
        label = labelled(verified(stored(near_links(distinct)), docs))
        root = stored(distinct.join(label, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")))
        ids = prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id"))).alias("s")).join(root, "fp")
        kept = stored(ids.groupBy("root").agg(F.min(F.struct("s.n", "s.id", "fp")).alias("s")).select(F.col("s.id").alias(doc), F.col("s.fp").alias(fp)))
        plain = prints.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty()
        if plain:
            kept = prints.select(F.col("doc_id").alias(doc)).join(kept.select(doc), doc, "left_anti")  # those that go, which are far fewer
        kept.write.parquet(path)
        kept = docs.sparkSession.read.schema(kept.schema).parquet(path)
    if plain:
        return docs.join(kept, F.col("doc_id") == F.col(doc), "left_anti").select(*names)
    # doc_ids that are null or stand more than once: rows are told apart by their texts too
    mine, at = fresh(docs, "own"), docs.columns.index("text")
    wide = numbered(docs, text_hash(), F.lit(None).cast("binary"))

    def run(batches):
        for batch in sliced(batches):
            last = batch.num_columns - 1
            yield batch.set_column(last, batch.schema.field(last), node_of(batch.column(at), batch.column(last - 1)).cast(batch.schema.field(last).type))

    rows = wide.mapInArrow(run, wide.schema).toDF(*docs.columns, fresh(docs, "hash"), mine)
    rows = rows.join(kept, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(mine) == F.col(fp)))
    return rows.dropDuplicates([doc, fp]).select(*names)
