"""Exact top-k search by inner product in M-trees.

With M the greatest norm, every vector x gets one more component sqrt(M^2 - |x|^2) and every query a zero: then
|q - x|^2 = |q|^2 + M^2 - 2 <q, x>, so the greatest inner products are the nearest points of a metric space.

Vectors are dealt to the nearest of a bounded number of pivots, the entries of the topmost node, and a cell of many
vectors is dealt further by a hash, so that a tree is small whatever the cell. A tree is a set of pages: a node has
objects with their distance to the object above it, inner nodes covering radii and children too. A search takes pages
best first, leaves out what |d(q, parent) - d(object, parent)| - radius rules out without a distance, and ends where the
nearest page left is too far. It runs in two rounds: a tree of the nearest cell sets the distance to beat, and all trees
of cells within it follow. Scores are integers; distances are floats with a slack, and decide only what is looked at.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm._shared import scratch, written

#: Objects of a node, vectors of a tree, entries of the topmost node, queries of a packed row and packed rows of a task.
PAGE, TREE, MOST_PIVOTS, PACKED, ROWS = 128, 8192, 1024, 1024, 32
#: Components that a tree, the topmost node and a packed row hold at most: fewer vectors where they are longer.
TREE_SIZE, PIVOT_SIZE, PACKED_SIZE = 1 << 22, 1 << 20, 1 << 18
#: Squared norms from here on are out of the range of scores.
TOO_LONG = float(1 << 62)
#: What float distances may be off, in norms.
SLACK = 1e-6
#: The id of a null in ties: larger than any other.
LAST = 1 << 63


def lifted(vectors: np.ndarray, top: float) -> np.ndarray:
    """Vectors with their additional component."""
    x = vectors.astype(np.float64)
    return np.c_[x, np.sqrt(np.maximum(top * top - (x * x).sum(1), 0))]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances of lifted vectors."""
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T), 0))


def build(vectors: np.ndarray, pivot: np.ndarray, top: float) -> list[dict]:
    """Pages of a tree below ``pivot``; the first one is the root."""
    points, pages = lifted(vectors, top), []

    def add(rows: np.ndarray, above: np.ndarray) -> int:
        number = len(pages)
        pages.append({})
        if len(rows) <= PAGE:
            pages[number] = {"rows": rows, "up": distances(points[rows], above[None])[:, 0], "radius": None, "child": None}
            return number
        centres = rows[np.linspace(0, len(rows) - 1, min(PAGE, -(-2 * len(rows) // PAGE))).astype(int)]
        nearest = distances(points[rows], points[centres]).argmin(1)
        groups = [rows[nearest == i] for i in range(len(centres))]
        if max(map(len, groups)) > 0.9 * len(rows):  # copies: no centre parts them
            groups = np.array_split(rows, len(centres))
            centres = np.array([g[0] for g in groups])
        full = [(c, g) for c, g in zip(centres, groups) if len(g)]
        heads = np.array([c for c, _ in full])
        radius = np.array([distances(points[g], points[[c]]).max() for c, g in full])
        children = np.array([add(g, points[c]) for c, g in full], np.int32)
        pages[number] = {"rows": heads, "up": distances(points[heads], above[None])[:, 0], "radius": radius, "child": children}
        return number

    add(np.arange(len(vectors)), lifted(pivot[None], top)[0])
    return pages


def search(pages: list[dict], query: np.ndarray, own: int, above: float, top: float, k: int, least: int | None) -> tuple[list[tuple], int]:
    """(the best (score, -id, ...) of a tree at or over ``least``, distances computed).

    A page holds ``vectors`` of its objects, and leaves ``ids`` and ``uids``; ``above`` is the distance to the pivot.
    """
    q, slack = query.astype(np.int64), SLACK * (top + 1)
    square = float((q.astype(np.float64) ** 2).sum())
    best: list[tuple] = []
    reach = np.sqrt(max(square + top * top - 2.0 * least, 0.0)) + slack if least is not None else np.inf
    slack += SLACK * np.sqrt(square)
    queue, computed = [(0.0, 0, above)], 0
    while queue:
        low, number, parent = heapq.heappop(queue)
        if low > reach + slack:
            break
        page = pages[number]
        bound = np.abs(parent - page["up"])
        if page["radius"] is not None:
            bound = bound - page["radius"]
        kept = np.flatnonzero(bound <= reach + slack)
        if not len(kept):
            continue
        computed += len(kept)
        if page["child"] is None:
            scores = page["vectors"][kept] @ q
            floor = best[0][0] if len(best) == k else least
            near = np.flatnonzero(scores >= floor) if floor is not None else np.arange(len(kept))
            for i in near.tolist():
                at = kept[i]
                if page["uids"][at] == own:
                    continue
                ident = page["ids"][at]
                item = (int(scores[i]), -(LAST if ident is None else ident), page["uids"][at])
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
            if len(best) == k:
                reach = min(reach, np.sqrt(max(square + top * top - 2.0 * best[0][0], 0.0)))
        else:
            x = page["lifted"][kept]
            d = np.sqrt(np.maximum(square + (x * x).sum(1) - 2 * (x[:, :-1] @ q.astype(np.float64)), 0))
            lows = np.maximum(d - page["radius"][kept], 0)
            for i in np.flatnonzero(lows <= reach + slack).tolist():
                heapq.heappush(queue, (float(lows[i]), int(page["child"][kept[i]]), float(d[i])))
    return best, computed


def prepared(vectors: DataFrame, scale: float = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(uid, id, v, norm2): integer vectors floor(``scale`` x) that take part, as a written table."""
    part = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < float(1 << 31)))
    rows = vectors.filter(F.col(vector_col).isNotNull()).filter(part)
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("v"))
    rows = rows.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))).filter(F.col("norm2") < TOO_LONG)
    return written(rows.withColumn("uid", F.monotonically_increasing_id()), "vectors")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of integers; shorter ones end in zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), width), np.int32)
    if len(column):
        out[np.arange(width)[None] < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _dealt(pivots: np.ndarray, top: float):
    """Each vector's nearest pivot and its distance."""
    centres = lifted(pivots, top)

    def run(batches):
        for batch in batches:
            v = _matrix(batch.column(2), pivots.shape[1])
            cell, far = np.zeros(len(v), np.int32), np.zeros(len(v))
            for at in range(0, len(v), 2048):
                d = distances(lifted(v[at : at + 2048], top), centres)
                cell[at : at + 2048], far[at : at + 2048] = d.argmin(1), d.min(1)
            packed = pa.array([x.tobytes() for x in v], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed, pa.array(cell), pa.array(far)], ["uid", "id", "v", "cell", "far"])

    return run


def _pages(pivots: np.ndarray, top: float):
    """A tree as rows: one for each page."""

    def run(key, table):
        cell, sub = (k.as_py() for k in key)
        table = table.sort_by("uid")
        width = pivots.shape[1]
        vectors = np.frombuffer(b"".join(table.column("v").to_pylist()), np.int32).reshape(-1, width) if width else np.zeros((len(table), 0), np.int32)
        ids, uids = table.column("id").to_pylist(), table.column("uid").to_pylist()
        rows = []
        for number, p in enumerate(build(vectors, pivots[cell], top)):
            leaf = p["child"] is None
            rows.append({
                "cell": cell, "sub": sub, "page": number, "vectors": vectors[p["rows"]].tobytes(), "up": p["up"].tolist(),
                "radius": None if leaf else p["radius"].tolist(), "child": None if leaf else p["child"].tolist(),
                "ids": [ids[i] for i in p["rows"]] if leaf else None, "uids": [uids[i] for i in p["rows"]] if leaf else None,
            })
        return pa.Table.from_pylist(rows, PAGES)

    return run


PAGES = pa.schema([("cell", pa.int32()), ("sub", pa.int32()), ("page", pa.int32()), ("vectors", pa.binary()), ("up", pa.list_(pa.float64())), ("radius", pa.list_(pa.float64())), ("child", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64())), ("uids", pa.list_(pa.int64()))])
PAGES_SQL = "cell int, sub int, page int, vectors binary, up array<double>, radius array<double>, child array<int>, ids array<long>, uids array<long>"
ASKS_SQL = "cell int, pack long, uid binary, id binary, v binary, least binary, far binary"
NONE = -(1 << 63)


def _asked(pivots: np.ndarray, top: float, radii: np.ndarray | None, packed: int):
    """Packed questions to cells: to the nearest one alone, or with ``radii`` to all that the reach touches."""
    centres, width = lifted(pivots, top), pivots.shape[1]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, packed):
                part = batch.slice(at, packed)
                uid, ident = part.column(0).to_numpy(), part.column(1).to_numpy()
                v, least = _matrix(part.column(2), width), part.column(3).to_numpy()
                q = np.c_[v.astype(np.float64), np.zeros(len(v))]
                far = distances(q, centres)
                if radii is None:
                    met = far == far.min(1, keepdims=True)
                    met &= np.cumsum(met, 1) == 1
                else:
                    square = (q * q).sum(1)
                    reach = np.where(least == NONE, np.inf, np.sqrt(np.maximum(square + top * top - 2.0 * least, 0)))
                    met = far - radii <= (reach + SLACK * (top + 1 + np.sqrt(square)))[:, None]
                cells = np.flatnonzero(met.any(0))
                rows = [np.flatnonzero(met[:, c]) for c in cells]
                packs = [int(uid[0])] * len(cells)
                out = [[x[r].tobytes() for r in rows] for x in (uid, ident, v, least)] + [[far[r, c].tobytes() for c, r in zip(cells, rows)]]
                yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(packs, pa.int64()), *[pa.array(x, pa.binary()) for x in out]], ["cell", "pack", "uid", "id", "v", "least", "far"])

    return run


def _found(width: int, top: float, k: int):
    """The best of one tree for the questions of one group."""

    def run(pages, asks):
        tree = []
        if len(pages) and len(asks):
            for p in pages.sort_by("page").to_pylist():
                v = np.frombuffer(p["vectors"], np.int32).reshape(len(p["up"]), width).astype(np.int64)
                inner = p["child"] is not None
                tree.append({"vectors": v, "up": np.array(p["up"]), "radius": np.array(p["radius"]) if inner else None, "child": p["child"], "ids": p["ids"], "uids": p["uids"], "lifted": lifted(v, top) if inner else None})
        out = []
        for row in asks.to_pylist() if tree else []:
            uid, ident, least, far = (np.frombuffer(row[c], t) for c, t in (("uid", np.int64), ("id", np.int64), ("least", np.int64), ("far", np.float64)))
            v = np.frombuffer(row["v"], np.int32).reshape(len(uid), width)
            for i in range(len(uid)):
                best, _ = search(tree, v[i], int(uid[i]), float(far[i]), top, k, None if least[i] == NONE else int(least[i]))
                out += [(int(uid[i]), int(ident[i]), None if -b == LAST else -b, s) for s, b, _ in best]
        columns = list(zip(*out)) or [[], [], [], []]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("uid", "query_id", "id", "score"), columns)})

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: float = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of the greatest inner product for each row that ``is_query`` takes.

    ``is_query`` is a condition on ``id``. Components become floor(``scale`` x). All rows but the query's own are
    candidates, ties go to the smaller id, a null id is the largest; rows without an id are no queries. Rows that repeat
    an id are rows each: a repeated query has its ranks once for each of its rows, and finds its copies. Vectors that
    are null or hold a null or a non-finite component take no part, and neither do those out of the scores' range (a
    component of 2^31 or a squared norm of 2^62 and more, scaled). Shorter vectors end in zeros, an empty one scores 0.
    Fewer candidates give fewer rows, an empty table none. Other columns are not read, so their names can't clash.

    Memory: a task holds a tree (``TREE`` vectors or so) and ``ROWS`` x ``PACKED`` queries at most; the driver and the
    tasks' closures hold up to ``MOST_PIVOTS`` vectors. Longer vectors make them fewer (``TREE_SIZE`` and the like).
    """
    spark = vectors.sparkSession
    with scratch(spark) as keep:
        rows = prepared(vectors, scale, id_col, vector_col)
        asked = rows.filter(F.col("id").isNotNull() & is_query)
        n, top2, width = rows.agg(F.count("*"), F.max("norm2"), F.max(F.size("v"))).first()
        schema = "query_id long, rank int, vec_id long, score long"
        queries = asked.count()
        if not queries:
            return spark.createDataFrame([], schema)
        top = float(np.sqrt(top2))
        tree, most, packed = (max(1, min(n, size // max(1, width))) for n, size in ((TREE, TREE_SIZE), (MOST_PIVOTS, PIVOT_SIZE), (PACKED, PACKED_SIZE)))
        # a bounded sample: the rows of the least hashes
        seeds = rows.orderBy(F.xxhash64("uid"), "uid").limit(min(most, -(-4 * n // tree))).select("v").collect()
        pivots = np.unique(np.array([[*r[0], *[0] * (width - len(r[0]))] for r in seeds], np.int32).reshape(len(seeds), width), axis=0)
        cells = written(rows.select("uid", "id", "v").mapInArrow(_dealt(pivots, top), "uid long, id long, v binary, cell int, far double"), "cells")
        sizes = {r["cell"]: (r["n"], r["far"]) for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}  # a row for each pivot
        trees = np.array([-(-sizes[c][0] // tree) if c in sizes else 0 for c in range(len(pivots))])
        radii = np.array([sizes[c][1] if c in sizes else -np.inf for c in range(len(pivots))])
        subs = F.create_map(*[F.lit(int(x)) for c, t in enumerate(trees) for x in (c, t)])
        split = cells.withColumn("sub", F.pmod(F.xxhash64("uid"), subs[F.col("cell")]).cast("int")).select("cell", "sub", "uid", "id", "v")
        pages = written(split.groupBy("cell", "sub").applyInArrow(_pages(pivots, top), PAGES_SQL), "pages")
        parts = -(-queries // (packed * ROWS))

        def answers(asks: DataFrame, all_trees: bool) -> DataFrame:
            """Questions against pages, by (tree, part of the questions)."""
            asks = asks.withColumn("part", F.pmod(F.xxhash64("pack"), F.lit(parts)).cast("int"))
            number = subs[F.col("cell")]
            asks = asks.withColumn("sub", F.explode(F.sequence(F.lit(0), number - 1)) if all_trees else F.pmod(F.xxhash64("pack"), number).cast("int"))
            dealt = pages.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
            keys = ["cell", "sub", "part"]
            return dealt.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInArrow(_found(width, top, k), "uid long, query_id long, id long, score long")

        kinds = [F.lit(NONE).cast("long").alias("least")]
        seeking = asked.select("uid", "id", "v", *kinds)
        first = written(answers(seeking.mapInArrow(_asked(pivots, top, None, packed), ASKS_SQL), False), "first")
        floors = first.groupBy("uid").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") >= k)
        known = asked.join(floors, "uid", "left").select("uid", "id", "v", F.coalesce("least", F.lit(NONE)).alias("least"))
        rest = answers(written(known.mapInArrow(_asked(pivots, top, radii, packed), ASKS_SQL), "asks"), True)
        order = Window.partitionBy("uid").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        best = rest.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        return keep(best.select("query_id", "rank", F.col("id").alias("vec_id"), "score"), "nearest")


def op12(spark, root):
    """Query op12_mtree_topk: queries are the rows whose vec_id is divisible by 100."""
    return top_k(spark.read.parquet(f"{root}/embeddings.parquet"), F.col("id") % 100 == 0)


SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
           FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
     r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
