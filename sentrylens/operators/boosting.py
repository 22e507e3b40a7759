"""Boosted trees, many fits at once: a pass over the train rows grows a level of the trees of all fits.

The trees are those of Spark ML's ``GBTClassifier``: weighted variance, the split of the largest gain, means as leaves, log loss, a
share of the rows drawn anew for each tree. A fit by itself needs some hundred jobs, so sixty fits spend their time in starting jobs.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import RDD, Broadcast, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrylens.session import checkpoint_dir

#: Cells of columns whose bins are counted together, and bytes of histograms that the driver adds up itself in a pass.
BUNDLE_CELLS, DIRECT_BYTES = 1024, 64_000_000
#: Quantiles of a class from which those of all rows are put together.
FINE = 1000
RATE = 0.1


@dataclass(frozen=True)
class Layout:
    """How the columns of a split are cut into bins, and which are counted together."""

    columns: tuple[str, ...]
    cuts: tuple[np.ndarray, ...]
    bundles: tuple[tuple[int, ...], ...]
    weights: tuple[float, float]

    def sizes(self, bundle: Sequence[int]) -> list[int]:
        return [len(self.cuts[c]) + 1 for c in bundle]

    def binned(self, values: Sequence[np.ndarray]) -> np.ndarray:
        """The bin of every value, column by column; a value equal to a cut lies below it."""
        return np.array([np.searchsorted(cut, v, "left") for cut, v in zip(self.cuts, values)], dtype=np.uint8).reshape(len(self.cuts), -1)


@dataclass(frozen=True)
class Kind:
    """The fits of a split that see the same columns: places of the columns and of their bins in a histogram."""

    split: str
    bundles: tuple[int, ...]
    columns: tuple[int, ...]
    starts: tuple[int, ...]
    width: int
    fits: tuple[int, ...]


@dataclass(frozen=True)
class Boosted:
    """A fit: for each tree a full heap of splits (column, bin) and the leaves of its last level."""

    columns: tuple[str, ...]
    layout: Layout
    feature: np.ndarray
    bin: np.ndarray
    leaf: np.ndarray

    def margins(self, bins: np.ndarray) -> np.ndarray:
        n, depth = bins.shape[1], self.leaf.shape[1].bit_length() - 1
        out, rows, new = np.zeros(n), np.arange(n), Scratch(n)
        for m, leaf in enumerate(self.leaf):
            at = _places(bins, rows, self.feature[m], self.bin[m], depth, new)
            out += _taken(_step(m) * leaf, at, new("score", np.float64, n))
        return out


def _step(tree: int) -> float:
    return RATE if tree else 1.0


def _quantiles(classes: Sequence[list[float] | None], weights: Sequence[float], bins: int) -> np.ndarray:
    """Cuts that deal the weight of all classes evenly, from the quantiles and the whole weight of each."""
    known = [(np.array(q), w / len(q)) for q, w in zip(classes, weights) if q]
    value, weight = np.concatenate([q for q, _ in known]), np.concatenate([np.full(len(q), w) for q, w in known])
    order = np.argsort(value, kind="stable")
    below = np.cumsum(weight[order])
    return np.unique(value[order][np.searchsorted(below, below[-1] * np.arange(1, bins) / bins)])


def layouts(
    train: DataFrame, values: Mapping[str, Column], kinds: Sequence[Sequence[str]], bins: int, weights: tuple[float, float], y: str
) -> Layout:
    """Cuts between the values of a column that has up to ``bins`` of them, else at quantiles of the weighted rows."""
    columns = tuple(values)
    rows = train.select(*[v.alias(c) for c, v in values.items()])
    attack = F.coalesce(F.col(y) == 1, F.lit(False))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.zeros(0)] * len(columns)
        for b in batches:
            seen = [s if len(s) > bins else np.unique(np.r_[s, x.to_numpy(zero_copy_only=False)])[: bins + 1] for s, x in zip(seen, b.columns)]
        place = np.repeat(np.arange(len(columns)), [len(s) for s in seen])
        yield pa.RecordBatch.from_pydict({"place": pa.array(place, pa.int32()), "value": np.concatenate(seen)})

    distinct = [[] for _ in columns]
    for r in rows.mapInArrow(found, "place int, value double").distinct().collect():
        distinct[r["place"]].append(r["value"])
    many = [c for c, v in zip(columns, distinct) if len(v) > bins]
    fine = [(i + 0.5) / FINE for i in range(FINE)]
    at = train.agg(
        *[F.count_if(attack == k) for k in (False, True)],
        *[F.percentile_approx(F.when(attack == k, values[c]), fine, 10_000) for c in many for k in (False, True)],
    ).first() if many else ()
    cuts = []
    for c, v in zip(columns, distinct):
        v = np.unique(v)
        place = 2 + 2 * many.index(c) if c in many else None
        cuts.append(_quantiles(at[place : place + 2], np.array(at[:2]) * weights, bins) if c in many else (v[1:] + v[:-1]) / 2)
    bundles: list[list[int]] = []
    for shared in dict.fromkeys(tuple(c in k for k in kinds) for c in columns):
        mine = sorted((i for i, c in enumerate(columns) if tuple(c in k for k in kinds) == shared), key=lambda i: len(cuts[i]))
        full = True
        for i in mine:
            if full or cells * (len(cuts[i]) + 1) > BUNDLE_CELLS:
                bundles.append([])
                cells, full = 1, False
            bundles[-1].append(i)
            cells *= len(cuts[i]) + 1
    return Layout(columns, tuple(cuts), tuple(map(tuple, bundles)), weights)


def _kinds(split: str, layout: Layout, columns: Sequence[tuple[str, ...]], fits: Sequence[int]) -> list[Kind]:
    out = []
    for names in dict.fromkeys(columns):
        bundles = tuple(i for i, b in enumerate(layout.bundles) if layout.columns[b[0]] in names)
        order = tuple(c for i in bundles for c in layout.bundles[i])
        sizes = layout.sizes(order)
        starts = tuple(accumulate(sizes, initial=0))
        out.append(Kind(split, bundles, order, starts[:-1], starts[-1], tuple(j for j, n in zip(fits, columns) if n == names)))
    return out


def _packed(split: str, layout: Layout, train: DataFrame, values: Mapping[str, Column], y: str, parts: int) -> RDD:
    """Each part of the train rows as one item: labels, bins and codes of the bundles."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, bins = [], []
        for b in batches:
            label.append(b.column(0).to_numpy(zero_copy_only=False).astype(bool))
            bins.append(layout.binned([c.to_numpy(zero_copy_only=False) for c in b.columns[1:]]))
        if not label:
            return
        every = np.concatenate(bins, axis=1)
        codes = [np.ravel_multi_index(tuple(every[list(b)].astype(np.int64)), layout.sizes(b)).astype(np.uint16) for b in layout.bundles]
        item = {"split": split, "y": np.concatenate(label), "bins": every, "codes": np.array(codes)}
        yield pa.RecordBatch.from_pydict({"part": pa.array([pickle.dumps(item)], pa.binary())})

    rows = train.select((F.col(y) == 1).alias("_y"), *[v.alias(c) for c, v in values.items()])
    return rows.repartition(parts).mapInArrow(pack, "part binary").rdd.map(lambda r: pickle.loads(r[0]))


class Scratch:
    """Arrays that the steps over a part's rows write to: new ones for each step cost several times the step."""

    def __init__(self, rows: int):
        self.rows, self.arrays = rows, {}

    def __call__(self, name: str, kind: type, n: int) -> np.ndarray:
        if name not in self.arrays:
            self.arrays[name] = np.empty(self.rows, dtype=kind)
        return self.arrays[name][:n]


def _taken(source: np.ndarray, at: np.ndarray, out: np.ndarray) -> np.ndarray:
    return source.take(at, out=out, mode="clip")  # the other modes would go through a copy; all places exist


def _places(bins: np.ndarray, rows: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int, new: Scratch) -> np.ndarray:
    """The place of rows in the level ``depth`` of a tree."""
    n, flat = len(rows), bins.reshape(-1)
    at, cell, right = new("at", np.int64, n), new("cell", np.int64, n), new("right", np.bool_, n)
    mine, limit = new("mine", np.uint8, n), new("limit", np.uint8, n)
    at[:] = 0
    offset = feature.astype(np.int64) * bins.shape[1]
    for k in range(depth):
        level = slice(2**k - 1, 2 ** (k + 1) - 1)
        _taken(offset[level], at, cell)
        np.add(cell, rows, out=cell)
        np.greater(_taken(flat, cell, mine), _taken(cut[level], at, limit), out=right)
        np.add(at, at, out=at)
        np.add(at, right, out=at)
    return at


def _drawn(item: dict, seed: int, tree: int, share: float) -> np.ndarray:
    """The rows of a part that a tree sees: the same in all levels."""
    n = len(item["y"])
    if share >= 1:
        return np.arange(n)
    draws = np.random.Generator(np.random.PCG64([seed % 2**64, tree, item["no"]])).integers(0, 1 << 16, n, dtype=np.uint16)
    return np.flatnonzero(draws < round(share * (1 << 16)))


def _histograms(item: dict, plan: Broadcast, tree: int, level: int, grown: list, wanted: list) -> Iterator[tuple[int, np.ndarray]]:
    """Of every kind of fits: benign rows, attack rows and weighted residuals by wanted node and bin, one fit behind the other."""
    plan = plan.value
    layout: Layout = plan["layouts"][item["split"]]
    sign = np.where(item["y"], np.float32(2), np.float32(-2))
    signed = np.where(item["y"], layout.weights[1], -layout.weights[0]) * (4 if tree else 1)
    codes = 2 * item["codes"].astype(np.int64) + item["y"]
    new, draws = Scratch(len(sign)), {}
    for no, kind in enumerate(plan["kinds"]):
        if kind.split != item["split"]:
            continue
        out = np.zeros((sum(int(wanted[j].max(initial=-1)) + 1 for j in kind.fits), 3, kind.width))
        lo = 0
        for j in kind.fits:
            slots = int(wanted[j].max(initial=-1)) + 1
            if not slots:
                continue
            if (drawn := plan["draws"][j]) not in draws:
                draws[drawn] = _drawn(item, drawn[0], tree, drawn[1])
            rows = draws[drawn]
            if level:
                slot = _taken(wanted[j], _places(item["bins"], rows, *grown[j], level, new), new("cell", np.int64, len(rows)))
                pick = np.flatnonzero(np.greater_equal(slot, 0, out=new("right", np.bool_, len(rows))))
                slot = _taken(slot, pick, new("slot", np.int64, len(pick)))
                rows = _taken(rows, pick, new("rows", np.int64, len(pick)))
            n = len(rows)
            r = _taken(signed, rows, new("r", np.float64, n))
            if tree:  # the residual 4 t / (1 + exp(2 t margin)), with its weight
                e = _taken(sign, rows, new("e", np.float32, n))
                np.multiply(e, _taken(item["margins"][plan["row"][j]], rows, new("m", np.float32, n)), out=e)
                np.exp(e, out=e)
                np.add(e, 1, out=e)
                np.divide(r, e, out=r)
            start = 0
            for b in kind.bundles:
                sizes = layout.sizes(layout.bundles[b])
                cells = 2 * int(np.prod(sizes))
                at = _taken(codes[b], rows, new("at", np.int64, n))
                if slots > 1:
                    np.add(at, np.multiply(slot, cells, out=new("cell", np.int64, n)), out=at)
                counts = np.bincount(at, minlength=slots * cells).reshape(slots, *sizes, 2)
                sums = np.bincount(at, r, slots * cells).reshape(slots, *sizes, 2).sum(axis=-1)
                for i, joint in enumerate((counts[..., 0], counts[..., 1], sums)):
                    place = start
                    for axis, size in enumerate(sizes, 1):
                        others = tuple(k for k in range(1, joint.ndim) if k != axis)
                        out[lo : lo + slots, i, place : place + size] = joint.sum(axis=others)
                        place += size
                start = place
            lo += slots
        yield no, out


def _moved(item: dict, plan: Broadcast, tree: int, grown: list, leaves: list) -> dict:
    """A part after a tree: its margins."""
    plan = plan.value
    mine = [j for k in plan["kinds"] if k.split == item["split"] for j in k.fits]
    n = len(item["y"])
    before, rows, new = item.get("margins"), np.arange(n), Scratch(n)
    out = np.zeros((len(mine), n), dtype=np.float32) if before is None else before.copy()
    depth = leaves[0].shape[0].bit_length() - 1
    for j in mine:
        at = _places(item["bins"], rows, *grown[j], depth, new)
        out[plan["row"][j]] += _taken(np.float32(_step(tree)) * leaves[j], at, new("m", np.float32, n))
    return item | {"margins": out}


def _best(h: np.ndarray, kind: Kind, weights: tuple[float, float]) -> tuple[np.ndarray, ...]:
    """Of nodes: the gain of the best split, its place in ``kind.columns``, its bin, the sums (benign rows, attack rows, weight, residual)
    of the left side, and of both."""
    starts = np.array(kind.starts)
    column = np.searchsorted(starts, np.arange(kind.width), "right") - 1
    h = np.stack([h[:, 0], h[:, 1], h[:, 0] * weights[0] + h[:, 1] * weights[1], h[:, 2]], axis=1)
    total = h[:, :, : (*kind.starts, kind.width)[1]].sum(axis=2, keepdims=True)
    run = np.cumsum(h, axis=2)
    base = np.concatenate([np.zeros((*h.shape[:2], 1)), run], axis=2)[:, :, starts]
    left = run - base[:, :, column]
    right = total - left
    ok = (left[:, 0] + left[:, 1] > 0.5) & (right[:, 0] + right[:, 1] > 0.5)
    ok[:, [*(starts[1:] - 1), kind.width - 1]] = False
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[:, 3] ** 2 / left[:, 2] + right[:, 3] ** 2 / right[:, 2] - total[:, 3] ** 2 / total[:, 2]
    gain = np.where(ok, gain, -np.inf)
    at = gain.argmax(axis=1)
    row = np.arange(len(h))
    return gain[row, at], column[at], at - starts[column[at]], left[row, :, at], total[:, :, 0]


def fit_together(
    trains: Mapping[str, DataFrame], values: Mapping[str, Mapping[str, Column]], fits: Sequence, weights: Mapping[str, tuple[float, float]],
    parts: Mapping[str, int], y: str,
) -> list[Boosted]:
    """All fits (of the same number, depth and bins of trees) side by side, in ``trees * depth`` jobs.

    The binned rows are written once, in parts; a part and the margins of its rows under every fit stay in the executors' storage from
    tree to tree. A pass returns histograms, which the driver adds up, or reducers do if there are many parts.
    """
    spark = next(iter(trains.values())).sparkSession
    checkpoint_dir(spark)
    trees, depth, bins = fits[0].trees, fits[0].depth, fits[0].bins
    kinds, layout, packed = [], {}, []
    for split, train in trains.items():
        mine = [j for j, f in enumerate(fits) if f.split == split]
        names = [fits[j].columns for j in mine]
        layout[split] = layouts(train, values[split], list(dict.fromkeys(names)), bins, weights[split], y)
        kinds += _kinds(split, layout[split], names, mine)
        packed.append(_packed(split, layout[split], train, values[split], y, parts[split]))
    row = {j: i for split in trains for i, j in enumerate(j for k in kinds if k.split == split for j in k.fits)}
    plan = spark.sparkContext.broadcast(
        {"layouts": layout, "kinds": kinds, "row": row, "draws": [(f.seed, f.subsample) for f in fits]}
    )  # what the steps of all trees carry along is kept small
    # an item of its own for each part: a part that is lost is read from the checkpoint again and moved on, tree by tree
    state = spark.sparkContext.union(packed).mapPartitionsWithIndex(lambda i, items: (x | {"no": i} for x in items))
    state = state.persist(StorageLevel.MEMORY_AND_DISK)
    state.checkpoint()
    state.count()
    n_parts = state.getNumPartitions()
    feature, cut = (np.zeros((len(fits), trees, 2**depth - 1), dtype=kind) for kind in (np.int32, np.uint8))
    leaf = np.zeros((len(fits), trees, 2**depth))
    older = None
    for m in range(trees):
        cut[:, m] = 255  # until a split is found, all rows go left
        wanted = [np.zeros(1, dtype=np.int64) for _ in fits]
        known = {j: None for j in range(len(fits))}
        value = np.zeros((len(fits), 1))
        shuffled = False
        for level in range(depth):
            grown = [(feature[j, m], cut[j, m]) for j in range(len(fits))]
            found = state.mapPartitions(lambda items, a=(plan, m, level, grown, wanted): (h for x in items for h in _histograms(x, *a)))
            size = n_parts * 24 * sum(k.width * sum(int(wanted[j].max(initial=-1)) + 1 for j in k.fits) for k in kinds)
            if size > DIRECT_BYTES * len(trains):
                found, shuffled = found.reduceByKey(np.add, min(n_parts, len(kinds))), True
            sums: dict[int, np.ndarray] = {}
            for no, h in found.collect():
                sums[no] = sums[no] + h if no in sums else h
            if older is not None:  # the first pass of a tree has moved the rows on
                older.unpersist()
                older = None
            following = [np.full(2 ** (level + 1), -1) for _ in fits]
            deeper = np.zeros((len(fits), 2 ** (level + 1)))
            for no, kind in enumerate(kinds):
                nodes = _nodes(kind, sums.get(no), wanted, known, level)
                if nodes is None:
                    deeper[list(kind.fits), ::2] = value[list(kind.fits)]
                    continue
                h, owner, place = nodes
                gain, column, at, left, total = _best(h, kind, layout[kind.split].weights)
                split_here = gain > 1e-9 * np.maximum(total[:, 2], 1)
                j, p = owner, place
                if level == 0:
                    value[j, 0] = total[:, 3] / np.maximum(total[:, 2], 1e-300)
                deeper[list(kind.fits), ::2] = value[list(kind.fits)]
                s = np.flatnonzero(split_here)
                feature[j[s], m, 2**level - 1 + p[s]] = np.array(kind.columns)[column[s]]
                cut[j[s], m, 2**level - 1 + p[s]] = at[s]
                right = total - left
                deeper[j[s], 2 * p[s]] = left[s, 3] / left[s, 2]
                deeper[j[s], 2 * p[s] + 1] = right[s, 3] / right[s, 2]
                smaller = (right[:, :2].sum(axis=1) < left[:, :2].sum(axis=1)).astype(int)
                for f in kind.fits:
                    mine = s[j[s] == f]
                    following[f][2 * p[mine] + smaller[mine]] = np.arange(len(mine))
                    known[f] = (p[mine], smaller[mine], h[mine])
            wanted, value = following, deeper
        leaf[:, m] = value
        if m + 1 < trees:
            grown, leaves = [(feature[j, m].copy(), cut[j, m].copy()) for j in range(len(fits))], list(leaf[:, m].astype(np.float32))
            older = state
            state = state.map(lambda x, a=(plan, m, grown, leaves): _moved(x, *a)).persist(StorageLevel.MEMORY_AND_DISK)
        if shuffled:
            spark.sparkContext._jvm.System.gc()  # else shuffle files of finished passes stay
    state.unpersist()
    return [Boosted(f.columns, layout[f.split], feature[j], cut[j], leaf[j]) for j, f in enumerate(fits)]


def _nodes(kind: Kind, sums: np.ndarray | None, wanted: list, known: dict, level: int):
    """The histograms of a level's nodes, whose they are and where they stand; the larger child's are the parent's less the smaller's."""
    if sums is None or not len(sums):
        return None
    hs, owner, place, lo = [], [], [], 0
    for f in kind.fits:
        n = int(wanted[f].max(initial=-1)) + 1
        mine, lo = sums[lo : lo + n], lo + n
        if level == 0:
            hs.append(mine)
            p = np.zeros(n, dtype=np.int64)
        elif n:
            above, smaller, h = known[f]
            hs += [mine, h - mine]
            p = np.r_[2 * above + smaller, 2 * above + 1 - smaller]
        else:
            continue
        place.append(p)
        owner.append(np.full(len(p), f))
    return np.concatenate(hs), np.concatenate(owner), np.concatenate(place)


def score_together(
    test: DataFrame, values: Mapping[str, Column], fits: Sequence, models: Sequence[Boosted], y: str, keep: Sequence[str]
) -> DataFrame:
    """Every row of a split under each of its fits."""
    layout, split = models[0].layout, fits[0].split
    kept = test.select(*keep).schema
    rows = test.select(F.col(y).cast("int").alias("y"), *keep, *[values[c].alias(f"x{i}") for i, c in enumerate(layout.columns)])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            bins = layout.binned([c.to_numpy(zero_copy_only=False) for c in b.columns[1 + len(keep) :]])
            for f, m in zip(fits, models):
                score = 1 / (1 + np.exp(-2 * m.margins(bins)))
                own = [pa.repeat(pa.scalar(f.name), n), pa.repeat(pa.scalar(f.seed, pa.int32()), n), pa.repeat(pa.scalar(split), n)]
                yield pa.RecordBatch.from_arrays(
                    [*own, b.column(0), pa.array(score), *b.columns[1 : 1 + len(keep)]], names=["fit", "seed", "split", "y", "score", *keep]
                )

    more = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(scored, "fit string, seed int, split string, y int, score double" + more)
