"""The k most similar vectors of every vector, by balanced posting lists.

1. Vectors are scaled to their largest component, quantised to 16 bits a component, and
   equal ones collapse to one class that knows up to k + 1 of its ids.
2. Balanced posting lists are fitted on a bounded sample by splitting clusters until
   each holds about the same number of sampled vectors, so dense topics get many lists.
3. Every vector finds its nearest centroids through an in-memory graph.  It is posted
   to its nearest list and, at a boundary, replicated to those almost as near; it
   probes every list whose distance passes the ratio pruning.
4. Lists are the shuffle key.  One task fits a bounded number of them, so the driver
   holds the finished graph and no sample; where a
   collection outgrows that, lists grow and each is divided again by the task that holds
   it, by the same balanced lists, replication and ratio pruning.  So a vector moves as
   often in a large collection as in a small one.  Only a list beyond ``BLOCK`` rows
   (which no split of the sample divides, or of more than some four thousand million
   vectors) is cut into blocks of data and of queries.  Partial results (k per query and
   list) merge by query.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colophon.storage import written

SCALE = 32767.0
#: Bounds of the fit: vectors wanted per list, sampled vectors per list (fewer from ``WIDE`` vectors a list on), sample rows.
LIST_SIZE, SAMPLE_PER_LIST, LEAST_SAMPLE, SAMPLE_ROWS, WIDE = 256, 24, 6, 400_000, 60_000
#: Posting and probing: distance ratio and most lists for each.
POST_RATIO, POST_LISTS, PROBE_RATIO, PROBE_LISTS = 1.10, 3, 1.30, 6
#: Posted vectors from which on a task divides its list again; rows of a list from which on it is cut.
DIVIDE, BLOCK = 1536, 1 << 17
#: Cosines that the building of the graph holds at a time; with their order some 16 bytes each.
NEAREST_CELLS = 1 << 22


def codes_of(x: np.ndarray) -> np.ndarray:
    """Rows at 16 bits a component, the largest of each filling them; rows are finite and not all zero."""
    return np.rint(x / np.abs(x).max(axis=1, keepdims=True) * SCALE).astype("<i2")


def unit_rows(q: np.ndarray) -> np.ndarray:
    """Quantised rows scaled to length 1, in float32."""
    x = q.astype(np.float32)
    x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return x


def distances(q: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 - cosine of rows ``a`` and ``b`` of ``q``; whole numbers add up exactly, so a pair has one distance in every list."""
    out = np.zeros(len(a), np.float32)
    for i in range(0, len(a), 1 << 14):
        x, y = q[a[i : i + (1 << 14)]].astype(np.float64), q[b[i : i + (1 << 14)]].astype(np.float64)
        dot, xx, yy = (np.einsum("ij,ij->i", *z) for z in ((x, y), (x, x), (y, y)))
        out[i : i + (1 << 14)] = 1 - dot / np.sqrt(xx * yy)
    return out


def _classes(df: DataFrame, key: str, vector: str, dim: int, keep: int) -> DataFrame:
    """``q BINARY, ids ARRAY<STRING>``: quantised valid vectors; equal ones of a batch share a row with their ``keep`` least ids."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, ids = batch.column(1), batch.column(0)
            size = np.asarray(lists.value_lengths().fill_null(0))
            size = np.where(np.asarray(ids.is_valid()), size, 0)
            fit = np.flatnonzero(size == dim)
            flat = lists.take(pa.array(fit)).flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)  # a null component reads as NaN
            good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            fit, x = fit[good], x[good]
            q = codes_of(x) if len(x) else np.zeros((0, dim), "<i2")
            rows: dict[bytes, set] = {}
            for code, i in zip((r.tobytes() for r in q), ids.take(pa.array(fit)).to_pylist()):
                rows.setdefault(code, set()).add(i)
            least = [sorted(v)[:keep] for v in rows.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.binary()), pa.array(least, pa.list_(pa.string()))], ["q", "ids"])

    return df.select(F.col(key).cast("string"), F.col(vector).cast("array<float>")).mapInArrow(convert, "q binary, ids array<string>")


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        label = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, label, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), c)
    return c, np.argmax(x @ c.T, axis=1)


def balanced_centroids(x: np.ndarray, leaf: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of clusters of at most about ``leaf`` sampled rows, and their sizes.

    A cluster that no split divides (near-equal vectors) stays one; its size tells the
    caller to cut its list into blocks.
    """
    rng = np.random.default_rng(seed)
    out, sizes, todo = [], [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        part = x[rows]
        if len(rows) > leaf:
            _, label = _kmeans(part, min(16, -(-len(rows) // leaf)), rng)
            groups = [rows[label == j] for j in np.unique(label)]
            if len(groups) > 1:
                todo.extend(groups)
                continue
        mean = part.sum(axis=0)
        norm = np.linalg.norm(mean)
        out.append(mean / norm if norm > 1e-9 else part[0])
        sizes.append(len(rows))
    return np.asarray(out, np.float32), np.asarray(sizes)


class CentroidGraph:
    """A navigable graph over centroids: an entry layer above a neighbour graph.

    ``search`` moves all queries of a batch at once; queries that stand at one node
    compare themselves with that node's neighbours in one matrix product.
    """

    def __init__(self, centroids: np.ndarray, degree: int = 24, seed: int = 11) -> None:
        n = len(centroids)
        self.c = centroids
        self.edges = self._nearest(centroids, centroids, min(n, degree))
        pivots = max(1, int(np.sqrt(n)))
        entry, _ = _kmeans(centroids, pivots, np.random.default_rng(seed)) if n > pivots else (centroids.copy(), None)
        self.entry = entry.astype(np.float32)
        self.down = self._nearest(self.entry, centroids, min(n, 3 * -(-n // len(self.entry))))

    @staticmethod
    def _nearest(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
        rows, step = [], max(1, min(2048, NEAREST_CELLS // len(b)))
        for i in range(0, len(a), step):
            s = a[i : i + step] @ b.T
            near = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < len(b) else np.tile(np.arange(len(b)), (len(s), 1))
            rows.append(near.astype(np.int32))  # a copy: a slice would keep the whole order of all rows
        return np.concatenate(rows)

    def _expand(self, q: np.ndarray, at: np.ndarray, table: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Best ``width`` of each query's neighbours ``table[at]``."""
        k = min(width, table.shape[1])
        ids, sims = np.zeros((len(q), k), np.int32), np.full((len(q), k), -2.0, np.float32)
        order = np.argsort(at, kind="stable")
        cuts = np.flatnonzero(np.r_[True, at[order][1:] != at[order][:-1], True])
        for a, b in zip(cuts[:-1], cuts[1:]):
            rows = order[a:b]
            near = table[at[rows[0]]]
            s = q[rows] @ self.c[near].T
            top = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < len(near) else np.tile(np.arange(len(near)), (len(rows), 1))
            ids[rows], sims[rows] = near[top], np.take_along_axis(s, top, axis=1)
        return ids, sims

    @staticmethod
    def _merge(ids: np.ndarray, sims: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(ids, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1).copy()
        sims[:, 1:][ids[:, 1:] == ids[:, :-1]] = -2.0
        top = np.argsort(-sims, axis=1, kind="stable")[:, :width]
        return np.take_along_axis(ids, top, 1), np.take_along_axis(sims, top, 1)

    def search(self, q: np.ndarray, width: int, hops: int = 2) -> tuple[np.ndarray, np.ndarray]:
        """``width`` near centroids of each query, best first, and their cosines."""
        s = q @ self.entry.T
        m = min(3, s.shape[1])
        start = np.argpartition(-s, m - 1, axis=1)[:, :m] if m < s.shape[1] else np.tile(np.arange(m), (len(q), 1))
        found = [self._expand(q, start[:, j], self.down, width) for j in range(m)]
        ids, sims = self._merge(np.concatenate([f[0] for f in found], 1), np.concatenate([f[1] for f in found], 1), width)
        for hop in range(hops):
            best = ids[:, 0].copy()
            more = self._expand(q, ids[:, min(hop, ids.shape[1] - 1)], self.edges, width)
            ids, sims = self._merge(np.concatenate([ids, more[0]], 1), np.concatenate([sims, more[1]], 1), width)
            if hop and (ids[:, 0] == best).all():
                break
        return ids, sims


def _chosen(sims: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of each row's nearest lists, best first, to probe and to post to, by the ratio of distances."""
    dist = np.sqrt(np.maximum(2 - 2 * sims, 1e-12))
    ratio = dist / np.maximum(dist[:, :1], 1e-6)
    spot = np.arange(sims.shape[1])
    probe = (sims > -1.5) & (ratio <= PROBE_RATIO) & (spot < PROBE_LISTS)
    post = probe & (ratio <= POST_RATIO) & (spot < POST_LISTS)
    probe[:, 0] = post[:, 0] = True
    return probe, post


def _nearest_in(x: np.ndarray, nid: np.ndarray, data: np.ndarray, ask: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows ``ask, data, cosine``: up to ``k`` of ``data`` for each of ``ask``, itself left out."""
    outs = []
    for i in range(0, len(ask), 1024):
        a = ask[i : i + 1024]
        if not len(data):
            break
        s = x[a] @ x[data].T
        s[nid[a][:, None] == nid[data][None, :]] = -2.0
        m = min(k, len(data))
        top = np.argpartition(-s, m - 1, axis=1)[:, :m] if m < len(data) else np.tile(np.arange(len(data)), (len(a), 1))
        best = np.take_along_axis(s, top, 1)
        r, c = np.nonzero(best > -1.5)
        outs.append((a[r], data[top[r, c]], best[r, c]))
    if not outs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    return tuple(np.concatenate(z) for z in zip(*outs))


def search_list(x: np.ndarray, nid: np.ndarray, data: np.ndarray, ask: np.ndarray, k: int, divide: int = DIVIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``_nearest_in``; a list of more than ``divide`` posted vectors is divided again."""
    if len(data) <= divide:
        return _nearest_in(x, nid, data, ask, k)
    step = max(1, LIST_SIZE // SAMPLE_PER_LIST)
    centroids, _ = balanced_centroids(x[data[::step]], max(2, LIST_SIZE // step))
    if len(centroids) < 2:
        return _nearest_in(x, nid, data, ask, k)
    width = min(len(centroids), PROBE_LISTS + 2)

    def lists(rows: np.ndarray, posting: bool) -> tuple[np.ndarray, np.ndarray]:
        who, which = [], []
        for i in range(0, len(rows), 4096):
            part = rows[i : i + 4096]
            s = x[part] @ centroids.T
            top = np.argpartition(-s, width - 1, axis=1)[:, :width]
            near = np.take_along_axis(s, top, 1)
            order = np.argsort(-near, axis=1, kind="stable")
            r, c = np.nonzero(_chosen(np.take_along_axis(near, order, 1))[int(posting)])
            who.append(part[r])
            which.append(np.take_along_axis(top, order, 1)[r, c])
        return np.concatenate(who), np.concatenate(which)

    def by_list(rows: np.ndarray, posting: bool) -> tuple[np.ndarray, np.ndarray]:
        who, which = lists(rows, posting)
        order = np.argsort(which, kind="stable")
        return who[order], np.searchsorted(which[order], np.arange(len(centroids) + 1))

    held, held_at = by_list(data, True)
    asked, asked_at = by_list(ask, False)
    parts = [
        _nearest_in(x, nid, held[held_at[j] : held_at[j + 1]], asked[asked_at[j] : asked_at[j + 1]], k)
        for j in range(len(centroids))
        if held_at[j + 1] > held_at[j] and asked_at[j + 1] > asked_at[j]
    ]
    if not parts:
        return _nearest_in(x, nid, data[:0], ask, k)
    a, d, s = (np.concatenate(z) for z in zip(*parts))
    # A pair met in several lists counts once, though its cosine may differ in the last bits.
    order = np.lexsort((-s, nid[d], nid[a]))
    a, d, s = a[order], d[order], s[order]
    first = np.r_[True, (nid[a][1:] != nid[a][:-1]) | (nid[d][1:] != nid[d][:-1])]
    a, d, s = a[first], d[first], s[first]
    keep = _least(nid[a], -s, nid[d], k)
    return a[keep], d[keep], s[keep]


def _least(ask: np.ndarray, far: np.ndarray, data: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` rows of each ``ask`` that are least by ``far, data``."""
    order = np.lexsort((data, far, ask))
    if not len(order):
        return order
    asked = ask[order]
    group = np.flatnonzero(np.r_[True, asked[1:] != asked[:-1]])
    rank = np.arange(len(order)) - np.repeat(group, np.diff(np.r_[group, len(order)]))
    return order[rank < k]


def _fit(sample: DataFrame, dim: int, per_list: int, n: int) -> tuple[CentroidGraph, np.ndarray] | None:
    """The graph over the lists of a sample (``q``) of ``n`` vectors, and the blocks of each list, made by one task; None without rows."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = np.frombuffer(bytearray().join(c for batch in batches for c in batch.column(0).to_pylist()), f"S{2 * dim}")
        if len(codes):
            codes.sort()  # rows come in any order
            x = unit_rows(codes.view("<i2").reshape(-1, dim))
            centroids, sizes = balanced_centroids(x, per_list)
            blocks = np.maximum(1, np.ceil(sizes * (n / len(x)) * POST_LISTS / BLOCK)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((CentroidGraph(centroids), blocks))], pa.binary())], ["made"])

    made = sample.repartition(1).mapInArrow(fit, "made binary").collect()
    return pickle.loads(made[0]["made"]) if made else None


def most_similar(
    df: DataFrame,
    key: str = "id",
    vector: str = "embedding",
    dim: int = 64,
    k: int = 5,
    list_size: int = LIST_SIZE,
    sample_rows: int = SAMPLE_ROWS,
    wide: int = WIDE,
) -> DataFrame:
    """``a, b, rank_ids``-free pairs ``id, near_id``: near_id is among the k most similar of id.

    A row takes part if its vector has ``dim`` finite components, not all zero, and its
    id is not null; rows that repeat id and vector count once.  Equal directions are at
    cosine 1: members of a class of more than k + 1 get k of its least ids.  Ties in
    cosine go to the lesser class number, so which of several equals is given may vary.
    An empty or wholly invalid table gives an empty result.  Approximate: recall is
    measured in the tests and stated in the README.
    """
    spark = df.sparkSession
    keep = k + 1
    classes = _classes(df, key, vector, dim, keep).groupBy("q").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids"))
    base = written(classes.select(F.monotonically_increasing_id().alias("nid"), "q", "ids"), "classes")
    n = base.count()
    empty = spark.createDataFrame([], "id string, near_id string")
    if n == 0:
        return empty
    n_lists = max(1, min(-(-n // list_size), sample_rows // SAMPLE_PER_LIST))
    if n > n_lists * wide:  # wide lists: more of them, from fewer sampled vectors each
        n_lists = min(-(-n // wide), sample_rows // LEAST_SAMPLE)
    per_list = max(LEAST_SAMPLE, min(SAMPLE_PER_LIST, sample_rows // n_lists))
    share = min(1.0, n_lists * per_list / n)
    sample = base.where(F.pmod(F.xxhash64("q"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("q")
    fitted = _fit(sample, dim, per_list, n) or _fit(base.select("q").limit(1), dim, per_list, n)
    graph = spark.sparkContext.broadcast(fitted)  # at most SAMPLE_ROWS / LEAST_SAMPLE * ~2 nodes

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, cut = graph.value
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(1)
            q = unit_rows(np.frombuffer(b"".join(codes.to_pylist()), "<i2").reshape(-1, dim))
            nid = batch.column(0).to_numpy(zero_copy_only=False)
            held = np.asarray(batch.column(2))
            ids, sims = g.search(q, PROBE_LISTS + 2)
            probe, post = _chosen(sims)
            r, s = np.nonzero(probe)
            lists, posted = ids[r, s].astype(np.int64), post[r, s]
            many = cut[lists]
            home = nid[r] % many
            # One row per block met: as data in its home block, as a query in all of them.
            rep = np.repeat(np.arange(len(r)), many)
            block = np.arange(len(rep)) - np.repeat(np.cumsum(many) - many, many)
            qblock = home[rep]
            is_data = posted[rep] & False
            rows = [rep, lists[rep], block, qblock, is_data]
            data = np.flatnonzero(posted & (many > 1))
            single = many[rep] == 1
            rows[4] = np.where(single, posted[rep], False)
            if len(data):  # data of a cut list goes to every query block
                rep2 = np.repeat(data, many[data])
                qb = np.arange(len(rep2)) - np.repeat(np.cumsum(many[data]) - many[data], many[data])
                rows = [np.concatenate(z) for z in zip(rows, [rep2, lists[rep2], home[rep2], qb, np.ones(len(rep2), bool)])]
            back, lst, blk, qbl, dat = rows
            src = r[back]
            role = np.where(dat, np.where(many[back] == 1, 2, 1), 0).astype(np.int8)  # 0 query, 1 data, 2 both
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((lst << 40) | (blk << 20) | qbl, pa.int64()),
                    pa.array(nid[src], pa.int64()),
                    codes.take(pa.array(src)),
                    pa.array(((held[src].astype(np.int8) << 2) | role).astype(np.int8), pa.int8()),
                ],
                ["cell", "nid", "q", "tag"],
            )

    def scan(cell: pd.DataFrame) -> pd.DataFrame:
        q = np.frombuffer(b"".join(cell["q"]), "<i2").reshape(-1, dim)
        x = unit_rows(q)
        tag, nid = cell["tag"].to_numpy(), cell["nid"].to_numpy()
        data, ask = np.flatnonzero((tag & 3) > 0), np.flatnonzero((tag & 3) != 1)
        data = data[np.argsort(nid[data], kind="stable")]
        a, d, _ = search_list(x, nid, data, ask, k + 1)  # one more, as float32 may swap the last two
        far = distances(q, a, d)
        keep = _least(nid[a], far, nid[d], k)
        a, d, far = a[keep], d[keep], far[keep]
        return pd.DataFrame({"nid": nid[a], "cand": nid[d], "far": far, "n": (tag[a] >> 2).astype(np.int8), "m": (tag[d] >> 2).astype(np.int8)})

    cells = base.select("nid", "q", F.size("ids").cast("tinyint").alias("held")).mapInArrow(assign, "cell bigint, nid bigint, q binary, tag tinyint")
    part = cells.groupBy("cell").applyInPandas(scan, "nid bigint, cand bigint, far float, n tinyint, m tinyint")
    # k per probed block: a bounded list per query; a pair met in several has one distance, so the set holds it once.
    merged = part.groupBy("nid").agg(F.first("n").alias("n"), F.slice(F.array_sort(F.collect_set(F.struct("far", "cand", "m"))), 1, k).alias("near"))
    taken = merged.select(
        "nid",
        F.aggregate(
            F.filter("near", lambda x: F.lit(True)),
            F.struct(F.greatest(F.lit(k) - F.col("n") + 1, F.lit(0)).alias("left"), F.array().cast("array<struct<cand:bigint,take:int>>").alias("got")),
            lambda acc, x: F.struct(
                F.greatest(acc["left"] - x["m"], F.lit(0)).alias("left"),
                F.when(acc["left"] > 0, F.concat(acc["got"], F.array(F.struct(x["cand"].alias("cand"), F.least(acc["left"], x["m"].cast("int")).alias("take"))))).otherwise(acc["got"]).alias("got"),
            ),
        )["got"].alias("got"),
    ).select("nid", F.inline("got"))
    names = base.select("nid", "ids")
    apart = (
        taken.join(names.select(F.col("nid").alias("cand"), F.col("ids").alias("near_ids")), "cand")
        .select("nid", F.slice("near_ids", 1, F.col("take")).alias("near_ids"))
        .join(names, "nid")
        .select(F.explode("ids").alias("id"), "near_ids")
        .select("id", F.explode("near_ids").alias("near_id"))
    )
    twins = names.where(F.size("ids") > 1).select(F.explode("ids").alias("id"), "ids").select("id", F.explode("ids").alias("near_id")).where("id <> near_id")
    found = apart.union(twins)
    full = base.where(F.size("ids") == keep).select("q", "ids")
    if not full.isEmpty():  # members of large classes beyond those the class names
        rest = _classes_all(df, key, vector, dim).join(full, "q").where(~F.array_contains("ids", F.col("id")))
        found = found.union(rest.select("id", F.explode(F.slice("ids", 1, k)).alias("near_id")))
    return found


def _classes_all(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """``q, id`` of every valid row."""
    return _classes(df, key, vector, dim, 1 << 30).select("q", F.explode("ids").alias("id")).distinct()


def similar_pairs(df: DataFrame, key: str = "id", vector: str = "embedding", dim: int = 64, k: int = 5, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``id_a, id_b`` (``id_a < id_b``), distinct: one is among the other's k most similar."""
    near = most_similar(df, key, vector, dim, k, sample_rows=sample_rows).where("id <> near_id")
    return near.select(F.least("id", "near_id").alias("id_a"), F.greatest("id", "near_id").alias("id_b")).distinct()
