"""Near-duplicates of vectors by hierarchical navigable small-world graphs, one per shard.

Vectors are compared inside their label. Equal vectors are one class with a
weight. A label's classes are dealt to shards of about SHARD by a hash, and a
task builds each shard's graph, inserting in batches: a batch is searched in
the graph so far and in itself, every new vector is tied to a diverse choice of
the nearest, and full lists are pruned by the same rule. Graphs are written to
the shared folder.

Every two shards of a label then meet in a task, and each one's vectors are
searched in the other's graph (a shard alone: in its own), at every size. Where
all of a vector's beam links, the search goes on along the ties through every
vector that links or nearly does. Two audits of bounded size follow, of rows
chosen by a hash:

* probes: held vectors (PROBES at most) turned until their cosine with themselves
  is the threshold, in a direction given by the hash. Each must be found again,
  so a graph is judged where links are rare, too;
* real links: one row in AUDIT_SHARE (AUDIT_ROWS at most) compared with all of the
  shard. A vector's links weigh one over their number, so a large group counts
  no more than a pair.

While either finds less than RECALL, all beams are doubled; only when a beam of
one in WHOLE of the shard has failed is the whole shard compared. With 256 probes
the measured recall has a standard error of 0.006 at 0.99. Links that the audit
saw are kept. Links count by their cosine in double precision. The task returns
each vector's links and one tie to a linked vector, and the ties' components are
the duplicates' groups; pairs are never rows. Every pair of shards is searched,
so the work of a label grows with the square of its shards, each far below a
full comparison; ``report`` takes what each cell's audits found.

Null vectors, zero vectors, and those with null or non-finite components link
with nothing, like those with a null label or id. Vectors of different length
don't link. Rows with equal vec_id are the same vector. Extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, mix64
from .ngram_join import roots
from .topk import usable

THRESHOLD, SHARD = 0.93, 8192
#: Ties per vector in upper layers and in the lowest, first beam, vectors inserted together.
TIES, TIES0, BEAM, BATCH = 12, 24, 48, 256
#: Recall that the audits ask for, probes, rows compared with the whole shard: one in so many, at most.
RECALL, PROBES, AUDIT_SHARE, AUDIT_ROWS = 0.99, 256, 16, 512
#: How far below the threshold the search along ties still goes on, at the first beam.
SLACK = 0.03
#: Neighbours looked at in one step of all beams together (bounds the step's memory).
STEP_CELLS = 1 << 15
#: After a failed audit of beams of one in so many of the shard, all of it is compared.
WHOLE = 4


class Graph:
    """Unit vectors (float32) with tie lists by layer; layers[l] is vectors x ties, -1 where empty."""

    def __init__(self, unit: np.ndarray, layers: list[np.ndarray], entry: int):
        self.unit, self.layers, self.entry = unit, layers, entry

    # ------------------------------------------------------------------ search

    def _beams(self, layer: int, wanted: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The best ``width`` (numbers, similarities) that a beam from ``start`` finds for each wanted vector."""
        ties, n = self.layers[layer], len(self.unit)
        rows, grow = len(wanted), max(4, width // 16)
        beam = np.full((rows, width), -1)
        near = np.full((rows, width), -np.inf, np.float32)
        done = np.ones((rows, width), bool)
        seen = np.zeros((rows, n), bool)
        have = start.shape[1]
        beam[:, :have], done[:, :have] = start, start < 0
        at = np.nonzero(start >= 0)
        near[at] = np.einsum("ij,ij->i", wanted[at[0]], self.unit[start[at]])
        seen[at[0], start[at]] = True
        active = np.arange(rows)
        while len(active):
            todo = ~done[active]
            pick = np.argsort(np.where(todo, -near[active], np.inf), axis=1, kind="stable")[:, :grow]
            good = np.take_along_axis(todo, pick, 1)
            chosen = np.where(good, np.take_along_axis(beam[active], pick, 1), -1)
            done[active[:, None], pick] = True
            found = np.where(chosen[..., None] >= 0, ties[chosen], -1).reshape(len(active), -1)
            r, c = np.nonzero(found >= 0)
            who = found[r, c]
            fresh = ~seen[active[r], who]
            key = np.unique(r[fresh] * n + who[fresh])
            r, who = key // n, key % n
            seen[active[r], who] = True
            value = np.einsum("ij,ij->i", wanted[active[r]], self.unit[who])
            better = value > near[active[r], -1] if width else value > 2
            r, who, value = r[better], who[better], value[better]
            if len(r):
                count = np.bincount(r, minlength=len(active))
                most = int(count.max())
                new, newnear = np.full((len(active), most), -1), np.full((len(active), most), -np.inf, np.float32)
                slot = np.arange(len(r)) - (np.cumsum(count) - count)[r]
                new[r, slot], newnear[r, slot] = who, value
                allb = np.concatenate([beam[active], new], 1)
                alln = np.concatenate([near[active], newnear], 1)
                alld = np.concatenate([done[active], new < 0], 1)
                order = np.argsort(-alln, axis=1, kind="stable")[:, :width]
                beam[active] = np.take_along_axis(allb, order, 1)
                near[active] = np.take_along_axis(alln, order, 1)
                done[active] = np.take_along_axis(alld, order, 1)
            active = active[~done[active].all(1)]
        return beam, near

    def search(self, wanted: np.ndarray, width: int, down_to: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Beams of ``width`` in layer ``down_to``, entered through the layers above."""
        out_b, out_n = [], []
        rows = max(1, min(BATCH, STEP_CELLS // (max(4, width // 16) * self.layers[0].shape[1]), (1 << 24) // len(self.unit)))
        for lo in range(0, len(wanted), rows):
            part = wanted[lo:lo + rows]
            start = np.full((len(part), 1), self.entry)
            for layer in range(len(self.layers) - 1, down_to, -1):
                start = self._beams(layer, part, start, 4)[0]
            b, v = self._beams(down_to, part, start, max(width, start.shape[1]))
            out_b.append(b)
            out_n.append(v)
        return np.concatenate(out_b), np.concatenate(out_n)

    def reach(self, wanted: np.ndarray, beam: np.ndarray, near: np.ndarray, floor: float) -> tuple[np.ndarray, ...]:
        """(row, number, similarity) of all that ties lead to from the beams through vectors of at least ``floor``."""
        ties, n, out = self.layers[0], len(self.unit), []
        for lo in range(0, len(wanted), max(1, (1 << 24) // n)):
            hi = min(len(wanted), lo + max(1, (1 << 24) // n))
            seen = np.zeros((hi - lo, n), bool)
            r, c = np.nonzero(beam[lo:hi] >= 0)
            who, value = beam[lo:hi][r, c], near[lo:hi][r, c]
            seen[r, who] = True
            while len(r):
                good = value >= floor
                r, who, value = r[good], who[good], value[good]
                out.append((r + lo, who, value))
                nexts = []
                for at in range(0, len(r), STEP_CELLS // ties.shape[1]):
                    some = slice(at, at + STEP_CELLS // ties.shape[1])
                    row, to = np.repeat(r[some], ties.shape[1]), ties[who[some]].ravel()
                    fresh = to >= 0
                    fresh[fresh] = ~seen[row[fresh], to[fresh]]
                    key = np.unique(row[fresh].astype(np.int64) * n + to[fresh])
                    row, to = key // n, key % n
                    seen[row, to] = True
                    nexts.append((row, to, np.einsum("ij,ij->i", wanted[lo + row], self.unit[to])))
                r, who, value = (np.concatenate(x) for x in zip(*nexts)) if nexts else (r[:0], who[:0], value[:0])
        if not out:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.float32)
        return tuple(np.concatenate(x) for x in zip(*out))


def choose(wanted: np.ndarray, numbers: np.ndarray, near: np.ndarray, unit: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` of each row's candidates (sorted, nearest first): those nearer to the wanted vector than to any
    chosen before them, then the nearest of the rest."""
    rows, width = numbers.shape
    out = np.full((rows, most), -1, np.int32)
    for lo in range(0, rows, 512):
        c, s = numbers[lo:lo + 512], near[lo:lo + 512]
        v = unit[np.maximum(c, 0)]
        among = np.matmul(v, v.transpose(0, 2, 1))
        closest = np.full(c.shape, -np.inf, np.float32)
        taken = np.zeros(c.shape, bool)
        for j in range(width):
            ok = (c[:, j] >= 0) & (s[:, j] > closest[:, j]) & (taken.sum(1) < most)
            taken[:, j] = ok
            closest = np.where(ok[:, None], np.maximum(closest, among[:, :, j]), closest)
        rank = np.where(taken, 0, 1) * width + np.arange(width)
        rank = np.where(c >= 0, rank, 3 * width)
        pick = np.argsort(rank, axis=1)[:, :most]
        out[lo:lo + 512, :pick.shape[1]] = np.take_along_axis(c, pick, 1)
    return out


def _ranked(numbers: np.ndarray, near: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-near, axis=1, kind="stable")[:, :most]
    return np.take_along_axis(numbers, order, 1), np.take_along_axis(near, order, 1)


def build(unit: np.ndarray, ids: np.ndarray) -> Graph:
    """The graph of unit vectors; ``ids`` decide their layers, so a rerun builds the same graph."""
    n = len(unit)
    u = (mix64(ids.astype(np.uint64) + np.uint64(77)) >> np.uint64(11)).astype(float) / float(1 << 53)
    level = np.floor(-np.log(np.maximum(u, 1e-18)) / np.log(TIES)).astype(int)
    level = np.minimum(level, int(np.log(max(n, 2)) / np.log(TIES)) + 1)
    top = int(level.max(initial=0))
    layers = [np.full((n, TIES0 if k == 0 else TIES), -1, np.int32) for k in range(top + 1)]
    order = np.argsort(-level, kind="stable")              # the highest first: the entry is there from the start
    graph = Graph(unit, layers, int(order[0]) if n else 0)
    done = 0
    while done < n:
        batch = order[done:done + (min(BATCH, max(16, done)))]
        for layer in range(int(level[batch[0]]), -1, -1):
            own = batch[level[batch] >= layer]
            most = layers[layer].shape[1]
            among = unit[own] @ unit[own].T
            np.fill_diagonal(among, -np.inf)
            k = min(len(own), 2 * most)
            numbers, near = _ranked(np.broadcast_to(own, among.shape), among, k)
            if done:
                b, v = graph.search(unit[own], BEAM, layer) if layer < len(layers) else (None, None)
                numbers, near = _ranked(np.concatenate([numbers, b], 1), np.concatenate([near, v], 1), 2 * most)
            numbers = np.where(np.isfinite(near), numbers, -1)
            ties = choose(unit[own], numbers, near, unit, most)
            layers[layer][own] = ties
            _tie_back(layers[layer], unit, own, ties)
        done += len(batch)
    return graph


def _tie_back(layer: np.ndarray, unit: np.ndarray, own: np.ndarray, ties: np.ndarray) -> None:
    """Add each new vector to the lists of those it is tied to; lists that overflow are chosen anew."""
    r, c = np.nonzero(ties >= 0)
    to, new = ties[r, c], own[r]
    listed = (layer[to] == new[:, None]).any(1)
    to, new = to[~listed], new[~listed]
    if not len(to):
        return
    near = np.einsum("ij,ij->i", unit[to], unit[new])
    order = np.lexsort((-near, to))
    to, new = to[order], new[order]
    each, count = np.unique(to, return_counts=True)
    slot = np.arange(len(to)) - np.repeat(np.cumsum(count) - count, count)
    most = layer.shape[1]
    few = slot < most                                       # the nearest of a list's newcomers
    row = np.repeat(np.arange(len(each)), count)[few]
    extra = np.full((len(each), most), -1)
    extra[row, slot[few]] = new[few]
    both = np.concatenate([layer[each], extra], 1)
    value = np.where(both >= 0, np.einsum("ij,ikj->ik", unit[each], unit[np.maximum(both, 0)]), -np.inf)
    numbers, value = _ranked(both, value.astype(np.float32), 2 * most)
    full = (numbers >= 0).sum(1) > most
    layer[each[~full]] = numbers[~full, :most]
    if full.any():
        layer[each[full]] = choose(unit[each[full]], numbers[full], value[full], unit, most)


# --------------------------------------------------------------------------- links

def _exact(a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs (rows of a, rows of b) reach the threshold in double precision."""
    out = np.zeros(len(left), bool)
    for lo in range(0, len(left), 1 << 16):
        x, y = a[left[lo:lo + (1 << 16)]], b[right[lo:lo + (1 << 16)]]
        norm = np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y))
        out[lo:lo + (1 << 16)] = np.einsum("ij,ij->i", x, y) / norm >= threshold
    return out


def _by_hash(n: int, most: int, salt: int) -> np.ndarray:
    return np.argsort(mix64(np.arange(n, dtype=np.uint64) + np.uint64(salt)), kind="stable")[:most]


def probes(unit: np.ndarray, threshold: float, most: int = PROBES) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of vectors chosen by a hash, and for each a unit vector whose cosine with it is the threshold."""
    chosen = _by_hash(len(unit), most, 417)
    own = unit[chosen].astype(float)
    away = np.random.default_rng(len(unit)).standard_normal(own.shape)
    away -= own * np.einsum("ij,ij->i", own, away)[:, None]
    size = np.sqrt((away * away).sum(1, keepdims=True))
    away = np.where(size > 1e-9, away / np.maximum(size, 1e-9), 0)       # one dimension has no other direction
    turned = threshold * own + np.sqrt(1 - min(threshold, 1.0) ** 2) * away
    turned /= np.sqrt((turned * turned).sum(1, keepdims=True))
    return chosen, turned.astype(np.float32)


def audit(graph: Graph, held: np.ndarray, wanted: np.ndarray, unit: np.ndarray,
          threshold: float) -> tuple[np.ndarray, np.ndarray, int]:
    """All (row of wanted, row of held) links, none of a vector with itself, of one row of wanted in AUDIT_SHARE
    (AUDIT_ROWS at most), chosen by a hash; and the number of these rows."""
    some = _by_hash(len(wanted), min(AUDIT_ROWS, -(-len(wanted) // AUDIT_SHARE)), 991)
    left, right = [np.zeros(0, int)], [np.zeros(0, int)]
    for lo in range(0, len(some), 256):
        r, c = np.nonzero(unit[some[lo:lo + 256]] @ graph.unit.T >= threshold - 1e-3)
        r = some[lo:lo + 256][r]
        keep = _exact(wanted, held, r, c, threshold)
        if held is wanted:
            keep &= r != c
        left.append(r[keep])
        right.append(c[keep])
    return np.concatenate(left), np.concatenate(right), len(some)


def _loosely(graph: Graph, unit: np.ndarray, width: int, loose: float) -> tuple[np.ndarray, np.ndarray]:
    """(row of unit, number) pairs of similarity >= loose that the graph yields with beams of ``width``."""
    left, right = [], []
    part = max(1, (1 << 22) // width)
    for lo in range(0, len(unit), part):
        b, near = graph.search(unit[lo:lo + part], min(width, len(graph.unit)))
        r, c = np.nonzero(near >= loose)
        left.append(lo + r)
        right.append(b[r, c])
        more = np.flatnonzero(near[:, -1] >= loose)        # the worst of the beam still links: go on from it
        if len(more):
            r, who, value = graph.reach(unit[lo + more], b[more], near[more], loose - SLACK * width / BEAM)
            left.append(lo + more[r[value >= loose]])
            right.append(who[value >= loose])
    key = np.unique(np.concatenate([*left, np.zeros(0, int)]) * len(graph.unit)
                    + np.concatenate([*right, np.zeros(0, int)]))
    return key // len(graph.unit), key % len(graph.unit)


def find(graph: Graph, held: np.ndarray, wanted: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, dict]:
    """(row of wanted, row of held) pairs with cosine >= threshold that the graph of ``held`` yields, and the audits."""
    n, size = len(held), np.sqrt((wanted * wanted).sum(1, keepdims=True))
    unit = (wanted / size).astype(np.float32)
    loose, width = threshold - 1e-3, BEAM
    *sure, audited = audit(graph, held, wanted, unit, threshold)
    sure_key = sure[0] * n + sure[1]
    links = np.bincount(sure[0], minlength=len(wanted))[sure[0]]
    weight = 1.0 / links                                    # a vector's links together: one
    source, turned = probes(graph.unit, threshold)
    probe_key = np.arange(len(source)) * n + source
    while True:
        left, right = _loosely(graph, turned, width, loose)
        probed = float(np.isin(probe_key, left * n + right).mean()) if len(probe_key) else 1.0
        if probed >= RECALL:
            left, right = _loosely(graph, unit, width, loose)
            keep = _exact(wanted, held, left, right, threshold)
            key = left[keep] * n + right[keep]
            real = float(weight[np.isin(sure_key, key)].sum() / weight.sum()) if len(weight) else 1.0
            if real >= RECALL:
                break
        width *= 2
        if WHOLE * width > max(n, WHOLE * BEAM):           # the widest beams have failed
            found = [np.nonzero(unit[lo:lo + 256] @ graph.unit.T >= loose) for lo in range(0, len(unit), 256)]
            left = np.concatenate([lo * 256 + r for lo, (r, _) in enumerate(found)])
            right = np.concatenate([c for _, c in found])
            keep = _exact(wanted, held, left, right, threshold)
            key, width, probed, real = left[keep] * n + right[keep], n, 1.0, 1.0
            break
    key = np.union1d(key, sure_key)                         # what the audit saw is known
    return key // n, key % n, {"vectors": len(wanted), "held": n, "audited": audited, "probes": len(source),
                               "beam": width, "probed": probed, "linked": real, "whole": width == n}


def _blob(graph: Graph) -> list[bytes]:
    return [np.concatenate([x.ravel() for x in graph.layers]).astype("<i4").tobytes(), graph.unit.tobytes()]


def _graph(ties: bytes, unit: bytes, n: int, entry: int) -> Graph:
    flat, unit_ = np.frombuffer(ties, "<i4"), np.frombuffer(unit, np.float32).reshape(n, -1)
    layers, at = [], 0
    while at < len(flat):
        w = TIES0 if not at else TIES
        layers.append(flat[at:at + n * w].reshape(n, w))
        at += n * w
    return Graph(unit_, layers, entry)


SHARDS_SCHEMA = ("label string, width int, shard int, shards int, ids binary, size binary, vectors binary, "
                 "ties binary, unit binary, entry int")


def _build_shard(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("id")
    ids, size = (rows.column(c).to_numpy() for c in ("id", "size"))
    held = rows.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
    unit = (held / np.sqrt((held * held).sum(1, keepdims=True))).astype(np.float32)
    graph = build(unit, ids)
    first = [rows.column(c)[0].as_py() for c in ("label", "width", "shard", "shards")]
    row = [*first, ids.astype("<i8").tobytes(), size.astype("<i8").tobytes(), held.astype("<f8").tobytes(),
           *_blob(graph), graph.entry]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 5, pa.int32()]
    return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)],
                                ["label", "width", "shard", "shards", "ids", "size", "vectors", "ties", "unit", "entry"])


FOUND_SCHEMA = ("a bigint, b bigint, links bigint, vectors bigint, held bigint, audited bigint, probes bigint, "
                "beam bigint, probed double, linked double, whole boolean")


def _link(threshold: float):
    def run(cell: pa.Table) -> pa.Table:
        sides = []
        for row in sorted(cell.to_pylist(), key=lambda r: r["shard"]):
            ids, size = (np.frombuffer(row[c], "<i8") for c in ("ids", "size"))
            held = np.frombuffer(row["vectors"], "<f8").reshape(len(ids), -1)
            sides.append((ids, size, held, _graph(row["ties"], row["unit"], len(ids), row["entry"])))
        ids = np.concatenate([s[0] for s in sides])
        size = np.concatenate([s[1] for s in sides])
        if len(sides) == 1:
            left, right, *audits = find(sides[0][3], sides[0][2], sides[0][2], threshold)
        else:
            n = len(sides[0][0])
            a, b, one = find(sides[1][3], sides[1][2], sides[0][2], threshold)
            c, d, other = find(sides[0][3], sides[0][2], sides[1][2], threshold)
            left, right, audits = np.concatenate([a, d]), np.concatenate([b + n, c + n]), [one, other]
        keep = left != right
        key = np.unique(np.minimum(left, right)[keep] * len(ids) + np.maximum(left, right)[keep])
        left, right = key // len(ids), key % len(ids)
        links = np.bincount(left, size[right], len(ids)) + np.bincount(right, size[left], len(ids))
        rank = np.argsort(ids, kind="stable")               # ties go to the smallest id
        place = np.empty(len(ids), int)
        place[rank] = np.arange(len(ids))
        tie = ids[rank[roots(len(ids), place[left], place[right])]][place]
        has = links > 0
        rows = pa.Table.from_arrays([pa.array(tie[has]), pa.array(ids[has]), pa.array(links[has].astype(np.int64))],
                                    ["a", "b", "links"])
        both = pa.concat_tables([rows, pa.Table.from_pylist(audits)], promote_options="default")
        return both.select(["a", "b", "links", *audits[0]])

    return run


def near_duplicates(spark: SparkSession, vectors: DataFrame, *, threshold: float = THRESHOLD,
                    shard: int = SHARD, report: str | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors`` (vec_id, embedding, label).

    ``report``: a folder to write the audits to, a row for each search of a shard's vectors in a graph."""
    scratch = Scratch(spark, "hnsw")
    vector = F.transform("embedding", lambda x: x.cast("double"))
    good = (usable(F.col("embedding")) & F.exists("embedding", lambda x: x != 0)
            & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    rows = scratch.write(vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"),
        F.when(good, vector).alias("vector")), "rows")
    classes = scratch.write(rows.where("vector IS NOT NULL").groupBy("label", "vector").agg(
        F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("size")).withColumn("width", F.size("vector")), "classes")
    shards = classes.groupBy("label", "width").agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("shards"))
    dealt = classes.join(shards, ["label", "width"]).withColumn(
        "shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int"))
    graphs = scratch.write(dealt.select("label", "width", "shard", "shards", "id", "size", "vector")
                           .groupBy("label", "width", "shard").applyInArrow(_build_shard, SHARDS_SCHEMA), "graphs")
    cells = (graphs.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
             .withColumn("i", F.least("shard", "o")).withColumn("j", F.greatest("shard", "o")))
    result = scratch.write(cells.groupBy("label", "width", "i", "j").applyInArrow(_link(threshold), FOUND_SCHEMA), "found")
    found = result.where("b IS NOT NULL").select("a", "b", "links")
    if report:
        result.where("b IS NULL").drop("a", "b", "links").write.mode("overwrite").parquet(report)
    groups = components(spark, scratch.write(found.where("a < b").select("a", "b").distinct(), "ties"),
                        scratch, "groups")
    counted = found.groupBy(F.col("b").alias("id")).agg(F.sum("links").alias("links"))
    classed = scratch.write(
        classes.join(counted, "id", "left").join(groups, "id", "left")
        .select("label", "vector", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                F.coalesce("component", "id").alias("component_id")), "classed")
    same = rows.where("vector IS NOT NULL").join(classed, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("vector IS NULL").select("vec_id", F.lit(0).cast("bigint").alias("n_links"),
                                                F.col("vec_id").alias("component_id"))
    return same.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def oracle_sql(threshold: float = THRESHOLD) -> str:
    return f"""
WITH RECURSIVE good AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.label = y.label AND x.vec_id <> y.vec_id
  WHERE list_cosine_similarity(x.v, y.v) >= {threshold}),
reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT e.vec_id, coalesce(k.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e
JOIN (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id) c USING (vec_id)
LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) k USING (vec_id)"""
