"""N-gram Jaccard join with count vectors and an R-tree, down to groups of linked documents.

A document's set holds the hashes of its distinct word n-grams; two documents link when
``100 * |x & y| >= percent * |x | y|``. A link bounds what the sets don't share:
``|x ^ y| <= (100 - percent) / (100 + percent) * (|x| + |y|)``.

Hashing the n-grams into groups makes a point of a set, the counts of its groups. Summed
coordinate minima bound the overlap of two points, ``|x & y| <= sum_i min(x_i, y_i)``, and likewise
of two boxes of points with their upper corners; a box pair or point pair below the overlap that
a link needs is left out. Survivors are verified on the sets.

The tree's top level deals points out to shards, without loss: over G groups with G above the
bound on ``|x ^ y|``, two linked sets agree in at least ``G - bound`` whole groups, G by size class. So a set goes
to a shard for each of its groups' contents, and linked sets meet in one. This holds as well if
some n-grams are taken out of all sets, so those common in a bounded sample (lines and passages
that many documents share) take no part in the contents. Groups left empty, or with a single n-gram
where sets are large enough to spare these, don't tell and make no shard. A set that has as many of them as groups must agree at least might agree
with others in nothing else; it goes to the shards of its contents with all n-grams, too, where
sets of this kind meet, and to those of groups that don't tell if there are still as many.

1. ``sketches``: one pass over the texts; size, digest and shard keys of each set. Keys are packed
   by key range, and sets that share a key are already linked to one of them, as
   candidates, by the task that packs them, so a key common to a third of all documents is a few
   entries.
2. Per key range, the documents of each shard become candidates with its smallest one. Sets
   with equal digests are one class from here on. ``verified`` prunes candidates by their points,
   then compares the sets.
3. ``components``: alternating large-star and small-star steps on the verified links.
4. ``rest``: only shards that still hold documents of several components can hide links.
   First each member is compared with the most central one of its shard, and the components are
   joined by what links. Then the points of shards where components still meet are split into blocks, the
   block pairs' R-trees are joined, and pairs of different components that survive the bounds are verified.

So a group of k near copies costs about k comparisons, and every pair that could link is either
within one component already or compared: no link between components is lost.

Defined cases: a text of any length gives its whole set; equal sets are one class, whose smallest id stands for it; null text, and text without words: empty set, linked with nothing, its own
component; rows with a null id: component null; rows repeated with the same id are one document
with the links of all of them; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, partitions_for, written

WORDS = 3
PERCENT = 90
DIMS = 64
FINE = 512  # coordinates of the points in the trees, a multiple of DIMS
SAMPLE_DOCS = 8192  # documents that common n-grams are sought in
COMMON_DOCS = 6  # of them, those that hold a common n-gram
CLASS_RATIO = 0.7  # smallest to largest size of a size class
PACK_KEYS = 400_000  # keys that a task packs at once
SLOT_KEYS = 1_000_000  # keys of a key range, about
LEAF = 16  # points of an R-tree leaf
HOT_RUN = 256  # documents of one task that share a key, above which they are sent as rows
BLOCK = 256  # points of a shard's block
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def ngrams(text: str, words: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the text's word n-grams (A-Z in lower case, ASCII white space)."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    word = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))
    size = min(words, len(word))
    out = np.full(len(word) - size + 1, size, np.uint64)
    for k in range(size):
        out = mix(out * _A + word[k: len(word) - size + 1 + k])
    return np.unique(out)


class Shards:
    """Shard keys of a set, by the bound of a link. ``common``: sorted n-grams left out of keys."""

    def __init__(self, percent: int, common: np.ndarray | None = None):
        self.percent = percent
        self.common = np.zeros(0, np.uint64) if common is None else common
        self.tops = [4]  # largest size of each class

    def class_of(self, n: int) -> int:
        while self.tops[-1] < n:
            self.tops.append(max(self.tops[-1] + 1, int(self.tops[-1] / CLASS_RATIO)))
        return int(np.searchsorted(self.tops, n))

    def bound(self, n: int, most: int) -> int:
        """What a set of size n and a linked one of at most ``most`` don't share, at most."""
        return (n + most) * (100 - self.percent) // (100 + self.percent)

    def groups(self, k: int) -> tuple[int, int]:
        """(G, least n-grams of a telling group) of class k; G has room for groups that don't tell."""
        top = self.tops[k]
        bound = self.bound(top, top)
        for telling in (2, 1):
            for g in range(bound + 1, bound * 5 // 4 + 4):
                load = 0.9 * top / g
                weak = g * math.exp(-load) * (1 + load * (telling - 1))
                if g - bound >= weak + 3 * math.sqrt(weak) + 1:
                    return g, telling
        return bound + 1, 1

    def keys(self, grams: np.ndarray) -> np.ndarray:
        n = len(grams)
        if not n:
            return np.zeros(0, np.uint64)
        rare = grams
        if len(self.common):
            at = np.minimum(np.searchsorted(self.common, grams), len(self.common) - 1)
            rare = grams[self.common[at] != grams]
        out = []
        for k in range(self.class_of(n), self.class_of(n * 100 // self.percent) + 1):
            g, telling = self.groups(k)
            spare = g - self.bound(n, min(self.tops[k], n * 100 // self.percent))  # groups that agree, at least
            key, count = self._contents(rare, g, k)
            tells = count >= telling
            out.append(key[tells])
            if g - int(tells.sum()) >= spare:  # too few rare n-grams to tell: all n-grams, too
                key, count = self._contents(grams, g, k)
                tells = count >= telling
                out.append(mix(key + _A)[tells if g - int(tells.sum()) < spare else slice(None)])
        return np.unique(np.concatenate(out))

    @staticmethod
    def _contents(grams: np.ndarray, g: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(key, size) of each of the g groups; groups are hash ranges, so each is a run of the sorted n-grams."""
        ends = np.searchsorted(((grams >> np.uint64(32)) * np.uint64(g)) >> np.uint64(32), np.arange(g + 1, dtype=np.uint64))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(grams + _C), dtype=np.uint64)])
        count = np.diff(ends)
        key = (total[ends[1:]] - total[ends[:-1]]) + count.astype(np.uint64) * _A
        own = np.arange(g, dtype=np.uint64) + np.uint64(k << 40)
        return mix(mix(key) + mix(own + _B)), count


def point(grams: np.ndarray, dims: int = DIMS) -> np.ndarray:
    return np.bincount((grams >> np.uint64(8)) % np.uint64(dims), minlength=dims).astype(np.int32)


def narrow(counts: np.ndarray) -> bytes:
    """The counts in the fewest bytes each that hold the largest."""
    most = int(counts.max(initial=0))
    return counts.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4").tobytes()


def widened(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, f"<u{len(blob) // FINE}").astype(np.int32)


def stars(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, smallest id of each; pairs (smallest, other) of ids that share a key)."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    first = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    hub = ids[first][np.cumsum(first) - 1] if len(keys) else ids
    other = hub != ids
    pairs = np.unique(np.stack([hub[other], ids[other]], axis=1), axis=0) if other.any() else np.zeros((0, 2), np.int64)
    return keys[first], ids[first], pairs[:, 0], pairs[:, 1]


_SKETCH = pa.schema([("slot", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()),
                     ("hub", pa.int64()), ("blob", pa.binary()), ("ids", pa.binary()), ("at", pa.binary())])
_SKETCH_DDL = "slot int, doc_id long, n long, digest binary, hub long, blob binary, ids binary, at binary"


def _rows(schema: pa.Schema, **cols) -> pa.RecordBatch:
    """A batch with the given columns, and nulls in the others."""
    n = len(next(iter(cols.values())))
    return pa.RecordBatch.from_arrays(
        [pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(n, f.type) for f in schema], schema=schema)


def packed(keys: np.ndarray, ids: np.ndarray, slots: int) -> dict[str, list]:
    """Sorted keys with their ids, packed by key range: six bytes a key, ids as places in a list of them.

    Keys lose their low 16 bits, which can only add candidates.
    """
    slot = ((keys >> np.uint64(32)) * np.uint64(slots)) >> np.uint64(32)
    cut = np.flatnonzero(np.diff(slot)) + 1
    out: dict[str, list] = {"slot": slot[np.concatenate([[0], cut])].astype(np.int32), "blob": [], "ids": [], "at": []}
    for k, i in zip(np.split(keys >> np.uint64(16), cut), np.split(ids, cut)):
        own, at = np.unique(i, return_inverse=True)
        out["blob"].append(np.ascontiguousarray(k.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
        out["ids"].append(own.astype("<i8").tobytes())
        out["at"].append(at.astype("<u2" if len(own) < 1 << 16 else "<u4").tobytes())
    return out


def unpacked(blob: bytes, ids: bytes, at: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(blob) // 6
    key = np.zeros((n, 8), np.uint8)
    key[:, :6] = np.frombuffer(blob, np.uint8).reshape(n, 6)
    place = np.frombuffer(at, "<u2" if len(at) == 2 * n else "<u4")
    return key.view("<u8").ravel(), np.frombuffer(ids, "<i8")[place]


def _by_slot(batches, names: list[str]):
    """(slot, its rows) of batches that are sorted by slot."""
    slot, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ["slot", *names])):
            if row[0] != slot:
                if held:
                    yield slot, held
                slot, held = row[0], []
            held.append(row[1:])
    if held:
        yield slot, held


def common_ngrams(docs: DataFrame, words: int) -> np.ndarray:
    """Sorted n-grams that at least COMMON_DOCS different sets hold among SAMPLE_DOCS documents.

    The sample (smallest hashes of the id) and so the answer are bounded; which n-grams they are
    changes how evenly documents are dealt, never which links are found.
    """
    picked = (docs.select(F.col("doc_id").alias("s")).filter("s is not null").orderBy(F.xxhash64("s"), "s").limit(SAMPLE_DOCS).distinct())

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            found = [ngrams(text.as_py() or "", words, hashes) for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([blake2b(g.tobytes(), digest_size=16).digest() for g in found], pa.binary()),
                 pa.array([g.view(np.int64) for g in found], pa.list_(pa.int64()))], names=["digest", "grams"])

    sample = docs.join(F.broadcast(picked), docs["doc_id"] == picked["s"]).select("text")
    counts = (sample.mapInArrow(run, "digest binary, grams array<long>").groupBy("digest").agg(F.first("grams").alias("grams"))
              .select(F.explode("grams").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
              .filter(F.col("n") >= COMMON_DOCS).select("g"))
    return np.sort(counts.toArrow().column("g").to_numpy().view(np.uint64))


def sketches(docs: DataFrame, words: int, percent: int, slots: int, common: np.ndarray, tasks: int) -> DataFrame:
    """Documents (doc_id, n, digest) and candidates (doc_id, hub), the latter with hub not null."""

    def run(batches):
        hashes, shards = WordHashes(), Shards(percent, common)
        keys, ids, have, turn = [], [], 0, 0

        def flush():
            nonlocal keys, ids, have
            if have:
                key, hub, a, b = stars(np.concatenate(keys), np.concatenate(ids))
                keys, ids, have = [], [], 0
                if len(a):
                    yield _rows(_SKETCH, slot=-1 - b % slots, doc_id=b, hub=a)
                yield _rows(_SKETCH, **packed(key, hub, slots))

        for batch in batches:
            out_id, out_n, out_digest = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                grams = ngrams(text.as_py() or "", words, hashes)
                hashes.trim()
                out_id.append(doc_id)
                out_n.append(len(grams))
                out_digest.append(blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None)
                if doc_id is not None and len(grams):
                    key = shards.keys(grams)
                    keys.append(key)
                    ids.append(np.full(len(key), doc_id, np.int64))
                    have += len(key)
                    if have >= PACK_KEYS:
                        yield from flush()
            if out_id:
                turn += 1
                yield _rows(_SKETCH, slot=-1 - (np.arange(len(out_id)) + turn) % slots, doc_id=out_id, n=out_n,
                            digest=out_digest)
        yield from flush()

    def meet(batches):
        out = pa.schema([f for f in _SKETCH if f.name in ("doc_id", "n", "digest", "hub")])
        for slot, held in _by_slot(batches, ["doc_id", "n", "digest", "hub", "blob", "ids", "at"]):
            if slot < 0:
                for k in range(0, len(held), 4096):
                    yield _rows(out, **dict(zip(("doc_id", "n", "digest", "hub"), list(zip(*held[k: k + 4096]))[:4])))
            elif len(held) > 1:
                keys, ids = zip(*(unpacked(*row[4:]) for row in held))
                _, _, a, b = stars(np.concatenate(keys), np.concatenate(ids))
                if len(a):
                    yield _rows(out, doc_id=b, hub=a)

    return (docs.mapInArrow(run, _SKETCH_DDL).repartition(tasks, "slot").sortWithinPartitions("slot")
            .mapInArrow(meet, "doc_id long, n long, digest binary, hub long"))


def components(links: DataFrame) -> DataFrame:
    """id, label: the smallest id that each linked id reaches (alternating large and small stars)."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                    .filter("u <> v").distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # what has no smaller neighbour keeps its links through them
        large = written(large.filter("u <> v"), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")),
            F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        new = written(small, "small")
        if new.exceptAll(edges).isEmpty() and edges.exceptAll(new).isEmpty():
            break
        edges = new
    return edges.select(F.col("u").alias("id"), F.col("v").alias("label"))


def _needed(n_a, n_b, percent: int):
    """Least overlap of linked sets of these sizes."""
    return -((-percent * (n_a + n_b)) // (100 + percent))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b of the pairs whose sets link; pruned by summed coordinate minima before the sets are sent."""
    narrow = sets.select("id", "n", "point")
    near = (pairs.join(narrow.toDF("a", "n_a", "p_a"), "a").join(narrow.toDF("b", "n_b", "p_b"), "b"))
    overlap = F.aggregate(F.zip_with("p_a", "p_b", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    near = near.filter(F.col("n_a") * 100 >= F.col("n_b") * percent).filter(
        F.col("n_b") * 100 >= F.col("n_a") * percent).filter(
        overlap * (100 + percent) >= F.lit(percent) * (F.col("n_a") + F.col("n_b"))).select("a", "b")

    def run(batches):
        for batch in batches:
            x = batch.column("s_a"), batch.column("s_b")
            keep = []
            for i in range(batch.num_rows):
                a, b = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in x)
                at = np.searchsorted(a, b)
                shared = int((a[np.minimum(at, len(a) - 1)] == b).sum())
                keep.append(shared >= _needed(len(a), len(b), percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    full = sets.select("id", "grams")
    return (near.join(full.toDF("a", "s_a"), "a").join(full.toDF("b", "s_b"), "b")
            .select("a", "b", "s_a", "s_b").mapInArrow(run, "a long, b long"))


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """id, n, point, fine (a point of more coordinates), grams of the documents ``wanted`` (id)."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            grams = []
            for text in batch.column(1):
                grams.append(ngrams(text.as_py() or "", words, hashes))
                hashes.trim()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(g) for g in grams], pa.int64()),
                 pa.array([point(g) for g in grams], pa.list_(pa.int32())),
                 pa.array([narrow(point(g, FINE)) for g in grams], pa.binary()),
                 pa.array([g.tobytes() for g in grams], pa.binary())], names=["id", "n", "point", "fine", "grams"])

    return docs.join(wanted.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "text") \
               .mapInArrow(run, "id long, n long, point array<int>, fine binary, grams binary")


def tree_join(n: np.ndarray, label: np.ndarray, points: np.ndarray, side: np.ndarray, percent: int) -> np.ndarray:
    """Index pairs of points with different labels that the bounds leave, by joining R-tree leaves.

    ``side`` 0 and 1: pairs across the sides; a single side: pairs within it. Leaves are packed in
    order of size, then of the points' coordinates. Boxes, and then pairs, are first bounded in
    coordinates summed to DIMS, and what is left in all of them.
    """
    coarse = points.reshape(len(points), -1, DIMS).sum(axis=1)
    order = np.lexsort((*coarse.T[:4], n))
    leaves = [part for s in np.unique(side) for part in
              (lambda o: np.split(o, range(LEAF, len(o), LEAF)))(order[side[order] == s])]
    upper = np.stack([coarse[x].max(axis=0) for x in leaves])
    low = np.array([n[x].min() for x in leaves])
    high = np.array([n[x].max() for x in leaves])
    of = np.array([side[x[0]] for x in leaves])
    one = len(np.unique(side)) == 1
    out = []
    for i in range(len(leaves)):
        j = np.arange(i, len(leaves))
        j = j[(of[j] != of[i]) | one]
        j = j[(high[j] * 100 >= low[i] * percent) & (high[i] * 100 >= low[j] * percent)]
        j = j[np.minimum(upper[j], upper[i]).sum(axis=1) >= _needed(low[j], low[i], percent)]
        if not len(j):
            continue
        a, b = leaves[i], np.concatenate([leaves[k] for k in j])
        fits = ((label[a][:, None] != label[b][None, :]) & (n[a][:, None] * 100 >= n[b][None, :] * percent)
                & (n[b][None, :] * 100 >= n[a][:, None] * percent))
        x, y = np.nonzero(fits)
        x, y = a[x], b[y]
        need = _needed(n[x], n[y], percent)
        for sides in (coarse, points):
            near = np.minimum(sides[x], sides[y]).sum(axis=1) >= need
            x, y, need = x[near], y[near], need[near]
        out.append(np.stack([x, y], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def open_shards(sets: DataFrame, labels: DataFrame, percent: int, tasks: int, slots: int, common: np.ndarray) -> DataFrame:
    """key, id of the members of shards in which different components meet (and of some others)."""

    schema = pa.schema([("slot", pa.int32()), ("key", pa.int64()), ("id", pa.int64()), ("label", pa.int64()),
                        ("blob", pa.binary()), ("ids", pa.binary()), ("at", pa.binary()), ("labels", pa.binary())])

    def pack(batches):
        shards = Shards(percent, common)
        keys, ids, labels, have = [], [], [], 0

        def flush():
            nonlocal keys, ids, labels, have
            if not have:
                return
            key = np.concatenate(keys) & ~np.uint64(0xFFFF)
            i, lab = np.concatenate(ids), np.concatenate(labels)
            keys, ids, labels, have = [], [], [], 0
            order = np.lexsort((lab, key))
            key, i, lab = key[order], i[order], lab[order]
            run = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])) - 1
            size = np.bincount(run)[run]
            hot = size > HOT_RUN
            if hot.any():  # as rows, which are split; of the packed ones the first and last label stay
                yield _rows(schema, slot=-1 - i[hot] % slots, key=(key[hot] >> np.uint64(16)).view(np.int64),
                            id=i[hot], label=lab[hot])
                edge = np.concatenate([[True], run[1:] != run[:-1]]) | np.concatenate([run[1:] != run[:-1], [True]])
                key, i, lab = (x[~hot | edge] for x in (key, i, lab))
            both, of = np.unique(np.stack([i, lab], axis=1), axis=0, return_inverse=True)
            cols = packed(key, of.ravel(), slots)
            cols["labels"] = [both[np.frombuffer(x, "<i8"), 1].astype("<i8").tobytes() for x in cols["ids"]]
            cols["ids"] = [both[np.frombuffer(x, "<i8"), 0].astype("<i8").tobytes() for x in cols["ids"]]
            yield _rows(schema, **cols)

        for batch in batches:
            for doc_id, label, grams in zip(*(batch.column(c) for c in ("id", "label", "grams"))):
                key = shards.keys(np.frombuffer(grams.as_buffer(), np.uint64))
                keys.append(key)
                ids.append(np.full(len(key), doc_id.as_py(), np.int64))
                labels.append(np.full(len(key), label.as_py(), np.int64))
                have += len(key)
                if have >= PACK_KEYS:
                    yield from flush()
        yield from flush()

    def open_runs(batches):
        out = pa.schema([f for f in schema if f.name in ("key", "id", "label")])
        for slot, held in _by_slot(batches, ["key", "id", "label", "blob", "ids", "at", "labels"]):
            if slot < 0:
                for k in range(0, len(held), 4096):
                    yield _rows(out, **dict(zip(("key", "id", "label"), list(zip(*held[k: k + 4096]))[:3])))
                continue
            got = [(*unpacked(blob, ids, at), unpacked(blob, labels, at)[1]) for *_, blob, ids, at, labels in held]
            key, i, lab = (np.concatenate(x) for x in zip(*got))
            order = np.lexsort((lab, key))
            key, i, lab = key[order], i[order], lab[order]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            ends = np.concatenate([starts[1:], [len(key)]])
            keep = np.repeat(lab[starts] != lab[ends - 1], ends - starts)
            if keep.any():
                yield _rows(out, key=key[keep].view(np.int64), id=i[keep], label=lab[keep])

    labelled = sets.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    keyed = (labelled.select("id", "label", "grams")
             .mapInArrow(pack, "slot int, key long, id long, label long, blob binary, ids binary, at binary, labels binary")
             .repartition(tasks, "slot").sortWithinPartitions("slot").mapInArrow(open_runs, "key long, id long, label long"))
    return written(keyed.select("key", "id").distinct(), "open-shards")


def members_of(shards: DataFrame, labels: DataFrame) -> DataFrame:
    """key, blocks (their number), own (the member's block), id, label of the shards in which components meet.

    Of the shards with the same members one is enough.
    """
    labelled = shards.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    shards_of = labelled.groupBy("key").agg(
        F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("size"),
        F.bit_xor(F.xxhash64("id")).alias("m"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("m2")).filter("x < y")
    open_keys = (shards_of.groupBy("m", "m2", "size").agg(F.min("key").alias("key"))
                 .select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    return labelled.join(open_keys, "key").select("key", "blocks", own.alias("own"), "id", "label")


def _grouped(batches, names: list[str]):
    """Tables of the rows that agree in ``names``, of batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        at = np.stack([batch.column(c).to_numpy() for c in names], axis=1)
        cut = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1).tolist(), len(at)]
        for start, stop in zip(cut, cut[1:]):
            here = tuple(at[start].tolist())
            if here != last and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, stop - start))
            last = here
    if held:
        yield pa.Table.from_batches(held)


def _points(column: pa.ChunkedArray) -> np.ndarray:
    return np.stack([widened(x.as_buffer()) for x in column])


def central(members: DataFrame, sets: DataFrame, tasks: int) -> DataFrame:
    """a, b: every member with the most central one of its shard, if that is of another component.

    Near copies of one text link with it sooner than with each other, so this joins a group before
    its pairs are looked at. Each block names its point with the largest overlap with the block's mean,
    the best of a shard's blocks is its centre.
    """

    def run(batches):
        for rows in _grouped(batches, ["key", "own"]):
            points = _points(rows.column("fine"))
            overlap = np.minimum(points, points.mean(axis=0)).sum(axis=1) / (1 + np.abs(points - points.mean(axis=0)).sum(axis=1))
            best = int(np.argmax(overlap))
            yield pa.RecordBatch.from_pydict({"key": [rows.column("key")[best]], "id": [rows.column("id")[best]],
                                              "score": pa.array([float(overlap[best])])})

    points = members.select("key", "own", "id").join(sets.select("id", "fine"), "id").select("key", "own", "id", "fine")
    best = (points.repartition(tasks, "key", "own").sortWithinPartitions("key", "own").mapInArrow(run, "key long, id long, score double")
            .groupBy("key").agg(F.max_by("id", F.struct("score", "id")).alias("centre")))
    met = members.join(best, "key")
    return met.filter("id <> centre").select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()


def rest(members: DataFrame, sets: DataFrame, percent: int, tasks: int) -> DataFrame:
    """a, b: pairs of different components that share a shard and survive the R-trees' bounds."""
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "label")
    members = members.join(sets.select("id", "n", "fine"), "id")

    def run(batches):
        for rows in _grouped(batches, ["key", "i", "j"]):
            if rows.num_rows < 2:
                continue
            i, j, own, ids, label, n = (rows.column(c).to_numpy() for c in ("i", "j", "own", "id", "label", "n"))
            side = np.zeros(len(ids), np.int64) if i[0] == j[0] else (own == j[0]).astype(np.int64)
            if (label == label[0]).all() or i[0] != j[0] and len(np.unique(side)) < 2:
                continue
            got = tree_join(n, label, _points(rows.column("fine")), side, percent)
            if len(got):
                a, b = ids[got[:, 0]], ids[got[:, 1]]
                yield pa.RecordBatch.from_pydict({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return (members.select("key", "i", "j", "own", "id", "label", "n", "fine").repartition(tasks, "key", "i", "j")
            .sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long").filter("a <> b").distinct())


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
         percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = named.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    # words of 6 bytes; keys of two classes, 2 * (100 - percent) / (100 + percent) of a set each
    keys = size / 6 * (0.01 + 4 * (100 - percent) / (100 + percent))
    slots = int(np.clip(keys / SLOT_KEYS, 64, 1 << 22))
    tasks = min(slots, max(partitions_for(docs), int(keys / 4_000_000)))
    common = common_ngrams(named, words)
    sketch = written(sketches(named, words, percent, slots, common, tasks), "sketches")

    rows = sketch.filter("hub is null").select("doc_id", "n", "digest")
    met = sketch.filter("hub is not null").select("hub", "doc_id").distinct()
    classes = rows.filter("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    reps = written(rows.filter("digest is not null and doc_id is not null").join(classes, "digest")
                   .select("doc_id", "rep").distinct(), "classes")
    pairs = (met.join(reps.withColumnsRenamed({"doc_id": "hub", "rep": "x"}), "hub")
             .join(reps.withColumnsRenamed({"rep": "y"}), "doc_id").filter("x <> y")
             .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    pairs = written(pairs, "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = written(_sets(named, wanted, words), "sets")

    links = written(verified(pairs, sets, percent), "links")
    labels = written(components(links), "labels")
    shards = open_shards(sets, labels, percent, tasks, slots, common)
    for pairs_of in (lambda m: central(m, sets, tasks), lambda m: rest(m, sets, percent, tasks)):
        more = written(verified(pairs_of(members_of(shards, labels)), sets, percent), "links")
        joined = labels.select(F.col("id").alias("a"), F.col("label").alias("b")).unionByName(more)
        labels = written(components(joined), "labels")
    repeated = reps.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a < b")
    joined = labels.select(F.col("id").alias("a"), F.col("label").alias("b"))
    final = components(joined.unionByName(repeated.select("a", "b")))
    of = (reps.groupBy("doc_id").agg(F.min("rep").alias("rep"))
          .join(final.withColumnsRenamed({"id": "rep"}), "rep", "left")
          .select(F.col("doc_id").alias("d"), F.coalesce("label", "rep").alias("component_id")))
    return (rows.join(of, F.col("doc_id") == F.col("d"), "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")))
