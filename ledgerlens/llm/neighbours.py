"""Approximate nearest neighbours by cosine: a robust-pruned directed graph for each shard, searched by beams.

Equal vectors are one node of the index, with the least ids that may be asked for. Nodes are dealt to shards by a digest,
so a shard has about `shard_rows` nodes at any size of the table and its memory is bounded. In a shard, points are inserted in
growing batches: a greedy search of the graph so far proposes neighbours (the beam and the way to it), robust pruning keeps
the nearest and drops every other candidate that is `alpha` times nearer to one kept than to the point, and the reverse
edges are pruned alike. Points that no edge leads to become further entries, so all are reachable. Each distinct query is sent to each
shard once, and beam search answers it; what the shards find is scored exactly, in double precision on the original vectors, and
merged. The index decides only which vectors are scored.

Work: every query meets every shard, as neighbours may be anywhere (nearest cosines in high dimensions exclude no shard);
the queries are a share of the rows, so the work grows with rows times queries / `shard_rows`, which is the reason for large shards.

Vectors that are null, empty, zero or that hold a null or non-finite component take no part, nor do rows without an id.
Vectors of different lengths never meet. A row that is repeated counts once; rows that share an id but not a vector are
each searched, and none is found by a query of that id. Ties go to the smaller id. A query with fewer candidates than k gets all of them that the
search meets. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.shared import batched, written

DEGREE, BEAM, SEARCH_BEAM, ALPHA, SHARD_ROWS = 32, 64, 128, 1.2, 10_000
#: Points that are searched or pruned at once, and nodes expanded at once for each.
_BATCH, _WIDE, _WAY = 512, 4, 8
_FAR = np.float32(np.inf)


def _unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors / np.abs(vectors).max(1, keepdims=True)
    return (v / np.sqrt((v * v).sum(1, keepdims=True))).astype(np.float32)


class Graph:
    """A directed graph over unit vectors; distances are squared Euclidean ones, 2 - 2 cos."""

    def __init__(self, points: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> None:
        self.points, self.degree, self.alpha2 = points, degree, np.float32(alpha * alpha)
        n = len(points)
        self.edges = np.full((n, degree), -1, np.int32)
        first = int((points @ points.mean(0)).argmax()) if n else 0
        self.entries = np.array([first][:n], np.int64)
        order = np.concatenate(([first], np.delete(np.arange(n), first))) if n else np.zeros(0, np.int64)
        done = 1
        while done < n:
            batch = order[done : done + min(done, _BATCH)]
            found, way = self._walk(points[batch], beam)
            self.edges[batch] = self._pruned(batch, np.concatenate((found, way), 1))
            self._add_reverse(batch)
            done += len(batch)
        self._connect()

    def _distances(self, queries: np.ndarray, ids: np.ndarray) -> np.ndarray:
        d = 2 - 2 * np.einsum("bd,bcd->bc", queries, self.points[np.maximum(ids, 0)])
        d[ids < 0] = _FAR
        return d

    def _walk(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The beam of each query, nearest first, and the first nodes on the way; -1 where there is none."""
        b, n = len(queries), len(self.points)
        ids = np.full((b, beam), -1, np.int32)
        distance = np.full((b, beam), _FAR, np.float32)
        open_ = np.zeros((b, beam), bool)
        seen = np.zeros((b, n), np.int32)
        way = np.full((b, _WAY), -1, np.int32)
        at = np.repeat(self.entries[None, :].astype(np.int32), b, 0)
        active, walked = np.arange(b), 0
        while active.size:
            rows = active[:, None]
            # A node counts once a query: of several places the last to leave its number is the one.
            place = np.arange(1, at.shape[1] + 1, dtype=np.int32)[None, :]
            new = (at >= 0) & (seen[rows, at] == 0)
            r, c = np.nonzero(new)
            seen[active[r], at[r, c]] = np.broadcast_to(place, at.shape)[r, c]
            new &= seen[rows, at] == place
            at = np.where(new, at, -1)
            d = self._distances(queries[active], at)
            all_ids = np.concatenate((ids[active], at), 1)
            all_d = np.concatenate((distance[active], d), 1)
            all_open = np.concatenate((open_[active], new), 1)
            if all_d.shape[1] > beam:
                near = np.argpartition(all_d, beam - 1, 1)[:, :beam]
                all_ids, all_d, all_open = (np.take_along_axis(x, near, 1) for x in (all_ids, all_d, all_open))
            order = np.lexsort((all_ids, all_d))
            all_ids, all_d, all_open = (np.take_along_axis(x, order, 1) for x in (all_ids, all_d, all_open))
            # The nearest open nodes are expanded.
            pick = all_open & (np.cumsum(all_open, 1) <= _WIDE)
            ids[active], distance[active], open_[active] = all_ids, all_d, all_open & ~pick
            alive = pick.any(1)
            chosen = np.full((len(active), _WIDE), -1, np.int32)
            r, c = np.nonzero(pick)
            chosen[r, np.cumsum(pick, 1)[r, c] - 1] = all_ids[r, c]
            if walked < _WAY:
                way[active, walked] = chosen[:, 0]
                walked += 1
            active, chosen = active[alive], chosen[alive]
            at = np.where(chosen[:, :, None] >= 0, self.edges[np.maximum(chosen, 0)], -1).reshape(len(active), _WIDE * self.degree)
        return ids, way

    def _pruned(self, nodes: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """At most `degree` diverse neighbours of each node, nearest first."""
        out = np.full((len(nodes), self.degree), -1, np.int32)
        for i in range(0, len(nodes), _BATCH // 2):
            own, ids = nodes[i : i + _BATCH // 2], np.sort(candidates[i : i + _BATCH // 2], 1)
            ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
            ids[ids == own[:, None]] = -1
            d = self._distances(self.points[own], ids)
            order = np.lexsort((ids, d))
            ids, d = np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)
            p = self.points[np.maximum(ids, 0)]
            between = 2 - 2 * np.matmul(p, p.transpose(0, 2, 1))
            alive, rows = ids >= 0, np.arange(len(own))
            for k in range(self.degree):
                first = alive.argmax(1)
                has = alive[rows, first]
                if not has.any():
                    break
                out[i + rows[has], k] = ids[rows, first][has]
                alive &= self.alpha2 * between[rows, first] > d
                alive[rows, first] = False
        return out

    def _add_reverse(self, batch: np.ndarray) -> None:
        r, c = np.nonzero(self.edges[batch] >= 0)
        to, origin = self.edges[batch][r, c], batch[r].astype(np.int32)
        order = np.lexsort((origin, to))
        to, origin = to[order], origin[order]
        while to.size:
            targets, starts, sizes = np.unique(to, return_index=True, return_counts=True)
            taken = np.minimum(sizes, self.degree)
            pool = np.full((len(targets), 2 * self.degree), -1, np.int32)
            pool[:, : self.degree] = self.edges[targets]
            rank = np.arange(len(to)) - np.repeat(starts, sizes)
            now = rank < self.degree
            pool[np.repeat(np.arange(len(targets)), sizes)[now], self.degree + rank[now]] = origin[now]
            known = (pool[:, : self.degree] >= 0).sum(1)
            roomy = known + taken <= self.degree
            if roomy.any():
                packed = -np.sort(-pool[roomy], 1)[:, : self.degree]
                packed[:, 1:][packed[:, 1:] == packed[:, :-1]] = -1
                self.edges[targets[roomy]] = packed
            if (~roomy).any():
                self.edges[targets[~roomy]] = self._pruned(targets[~roomy], pool[~roomy])
            to, origin = to[~now], origin[~now]

    def _connect(self) -> None:
        """Adds entries until every node is reached from one."""
        reached = np.zeros(len(self.points), bool)
        wave, entries = self.entries, list(self.entries)
        while len(reached):
            reached[wave] = True
            while wave.size:
                to = np.unique(self.edges[wave])
                to = to[to >= 0]
                wave = to[~reached[to]]
                reached[wave] = True
            left = np.flatnonzero(~reached)
            if not left.size:
                break
            wave = left[:1]
            entries.append(left[0])
        self.entries = np.array(entries, np.int64)

    def search(self, queries: np.ndarray, beam: int = SEARCH_BEAM) -> np.ndarray:
        """The nodes of each query's last beam, nearest first."""
        return self._walk(queries, beam)[0]


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of products, added from the first component to the last, so a value doesn't depend on what is computed beside it."""
    a, b = np.broadcast_arrays(a, b)
    total = np.zeros(a.shape[:-1])
    for k in range(a.shape[-1]):
        total += a[..., k] * b[..., k]
    return total


def cosines(queries: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Cosines in double precision."""
    with np.errstate(all="ignore"):
        norm = np.sqrt(_dot(queries, queries)) * np.sqrt(_dot(others, others))
        plain = _dot(queries, others) / norm
        odd = ~(np.isfinite(norm) & (norm > 1e-290))
        if odd.any():  # squares beyond the range of a double
            q, o = (x / np.abs(x).max(-1, keepdims=True) for x in np.broadcast_arrays(queries, others))
            plain = np.where(odd, _dot(q, o) / (np.sqrt(_dot(q, q)) * np.sqrt(_dot(o, o))), plain)
    return plain


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _answers(rows: DataFrame, k: int, degree: int, beam: int, search_beam: int, alpha: float, kind: str, of_id: str) -> DataFrame:
    """(vec, score, id): the best of a query in one shard. rows: a shard's nodes, then its queries, in each partition."""

    def answered(graph: Graph, nodes: np.ndarray, ids: list, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        asked = _matrix(batch.column(3))
        wide = min(len(nodes), search_beam)
        for i in range(0, len(asked), _BATCH):
            part = asked[i : i + _BATCH]
            met = graph.search(_unit(part), wide)  # the whole beam: equal scores of different vectors go by their ids
            score = cosines(part[:, None, :], nodes[np.maximum(met, 0)])
            owner, s, v = [], [], []
            for j, (row, found) in enumerate(zip(met.tolist(), score.tolist())):
                best = sorted((-x, m) for node, x in zip(row, found) if node >= 0 for m in ids[node])[: k + 1]
                owner += [i + j] * len(best)
                s += [-x for x, _ in best]
                v += [m for _, m in best]
            yield pa.RecordBatch.from_arrays([batch.column(3).take(pa.array(owner, pa.int64())), pa.array(s, pa.float64()), pa.array(v, batch.schema.field("ids").type.value_type)], ["vec", "score", "id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, graph = None, None
        vectors: list[np.ndarray] = []
        nodes, ids = np.zeros((0, 0)), []
        for whole in batches:
            if not whole.num_rows:
                continue
            at = whole.column(0).to_numpy() * 2 + whole.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            for a, b in zip(cuts, cuts[1:]):
                batch = whole.slice(a, b - a)
                if at[a] // 2 != shard:
                    shard, graph, vectors, ids = at[a] // 2, None, [], []
                if at[a] % 2 == 0:
                    vectors.append(_matrix(batch.column(3)))
                    ids.extend(batch.column(2).to_pylist())
                    continue
                if graph is None:
                    nodes = np.concatenate(vectors) if vectors else np.zeros((0, 1))
                    vectors = []
                    graph = Graph(_unit(nodes), degree, beam, alpha) if len(nodes) else None
                if graph is not None:
                    yield from answered(graph, nodes, ids, batch)

    return batched(rows).mapInArrow(run, f"vec {kind}, score double, id {of_id}")


def usable(vector: Column) -> Column:
    """Whether a vector takes part: finite, without nulls, and not all zero."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(
    vectors: DataFrame, is_query: Column, id: str = "vec_id", vector: str = "embedding", k: int = 5, shard_rows: int = SHARD_ROWS,
    degree: int = DEGREE, beam: int = BEAM, search_beam: int = SEARCH_BEAM, alpha: float = ALPHA,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows that the index finds for each row that `is_query` holds for, its own left out."""
    rows = vectors.where(vectors[id].isNotNull() & usable(vectors[vector])).select(vectors[id].alias("id"), vectors[vector].alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    kind, of_id = rows.schema["vec"].dataType.simpleString(), rows.schema["id"].dataType.simpleString()
    # Of the ids of a vector the k + 1 least can be asked for; each task keeps those of its own before the shuffle.
    ranked = rows.select("id", "vec").withColumn("r", F.dense_rank().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("r") <= k + 1)
    nodes = written(ranked.groupBy("vec").agg(F.sort_array(F.collect_set("id")).alias("ids")).withColumn("dim", F.size("vec")))
    # Lengths of vectors are few: a count for each comes to the driver.
    counts = sorted((r["dim"], -(-r["n"] // shard_rows)) for r in nodes.groupBy("dim").agg(F.count("*").alias("n")).collect())
    if not counts:
        return vectors.sparkSession.createDataFrame([], f"query_id {of_id}, rank int, vec_id {of_id}, score double")
    first, starts = 0, []
    for dim, shards in counts:
        starts.append((dim, first, shards))
        first += shards
    placed = F.broadcast(vectors.sparkSession.createDataFrame(starts, "dim int, first int, shards int"))
    own = F.col("first") + F.pmod(F.xxhash64("vec"), F.col("shards")).cast("int")
    points = nodes.join(placed, "dim").select(own.alias("shard"), F.lit(0).alias("asks"), "ids", "vec")
    queries = rows.where("asks").select("vec").distinct().withColumn("dim", F.size("vec")).join(placed, "dim")
    each = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("shards") - 1))
    asked = queries.select(each.alias("shard"), F.lit(1).alias("asks"), F.lit(None).cast(f"array<{of_id}>").alias("ids"), "vec")
    together = points.unionByName(asked).repartitionById(first, F.col("shard")).sortWithinPartitions("shard", "asks", F.xxhash64("vec"), "vec")
    found = _answers(together, k, degree, beam, search_beam, alpha, kind, of_id)
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("vec").orderBy(F.desc("score"), "id"))).where(F.col("r") <= k + 1)
    answers = written(best.groupBy("vec").agg(F.sort_array(F.collect_list(F.struct("r", "id", "score"))).alias("best")))
    ids = rows.where("asks").select("id", "vec").distinct()
    others = F.slice(F.filter("best", lambda x: x["id"] != F.col("query_id")), 1, k)
    joined = ids.withColumnRenamed("id", "query_id").join(answers, "vec").select("query_id", F.posexplode(others).alias("p", "x"))
    return joined.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), "x.score")


#: Every pair of a query and a row: what the index comes near to.
ORACLE = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))) AS score
      FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
