"""Exact top-k by inner product, as a Voronoi join of queries with all rows.

Pivots (a bounded sample of rows) part the rows into cells; the queries of a cell are a
query group. Each group is first solved in its home cell, which gives a score that the
k-th best match of none of its queries can miss (``theta``; where the home cell has too
few rows, it follows from the cells' summaries). From the summaries (rows, radius, the k
+ 1 least distances to the pivot) follows next, for each group and cell, how far from its
pivot a row must lie to reach theta, and only such rows are replicated to the group.
Groups that need nearly the same cells are joined where that costs less: a row is then
sent once for all of them. Groups are solved locally, their rows in parts of at most about
PART and their queries in blocks of at most about QUERIES, and the parts' best are
merged for each query.

Bounds, with q = p + u, |u| <= R in the group and x = c + v in the cell:
q.x lies within R|c| + (|p| + R)|v| of p.c.

Rows whose id is null, or whose vector is null or holds a component that is null or, once
scaled, not finite, take no part. Shorter vectors are filled with zeros. A row is no
candidate of itself, but other rows with its id are. Ties go to the smaller id. Products
are exact; one beyond 64 bits counts as the largest or least long. An empty table, or one
without queries, gives no rows. Only the id and vector columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Pivots at most; rows for each pivot at least; rows and values of a part; queries of a block.
PIVOTS, PER_PIVOT, PART, VALUES, QUERIES = 256, 64, 8192, 1 << 21, 1024
#: What sending a row to a group costs, in inner products.
SENDING = 100
ROW = "rid long, vec_id long, is_query boolean, v binary"
FOUND = "rid long, query_id long, match long, vec_id long, score long"


def scaled(vectors: DataFrame, vec_id: str, vector: str, scale: int, query: Column) -> DataFrame:
    """rid, vec_id, is_query and v: floor(scale * x) of each component, as doubles, of the rows that take part."""
    c = F.col(vector)

    def component(x: Column) -> Column:
        y = scale * x.cast("double")
        return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)  # larger doubles are whole

    whole = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(scale * x.cast("double")) < float("inf")))
    held = vectors.withColumn("__rid", F.monotonically_increasing_id())
    held = held.where(F.col(vec_id).isNotNull() & c.isNotNull() & whole)
    asks = F.coalesce(query, F.lit(False)).alias("is_query")
    return held.select(F.col("__rid").alias("rid"), F.col(vec_id).cast("long").alias("vec_id"), asks, F.transform(c, component).alias("v"))


def matrix(lists: list[np.ndarray] | pa.ListArray, width: int) -> np.ndarray:
    """Rows of doubles, filled with zeros to width."""
    out = np.zeros((len(lists), width))
    for k, row in enumerate(lists):
        out[k, : len(row)] = row
    return out


def scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products: in doubles where these are exact, else in whole numbers of any size, cut to 64 bits."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, queries.shape[1])
    if most < 2**53:
        return (queries @ rows.T).astype(np.int64)
    whole = [np.array([[int(x) for x in row] for row in held], object).reshape(held.shape) for held in (queries, rows)]
    return np.clip(whole[0] @ whole[1].T, -(2**63), 2**63 - 1).astype(np.int64)


def best_of(s: np.ndarray, k: int) -> list[np.ndarray]:
    """Places of the k largest of each row, equal ones in order of place."""
    n = s.shape[1]
    if n <= k:
        return list(np.argsort(-s.astype(float), axis=1, kind="stable")) if np.abs(s).max(initial=0) < 2**53 else [np.lexsort((np.arange(n), ~row)) for row in s]
    least = np.partition(s, n - k, axis=1)[:, n - k]
    out = []
    for row, at in zip(s, least, strict=True):
        place = np.flatnonzero(row >= at)
        out.append(place[np.lexsort((place, ~row[place]))][:k])
    return out


def reach(pivots: np.ndarray, cells: list, groups: dict[int, tuple[int, float, float]], k: int) -> dict[int, dict[int, float]]:
    """For each group its cells but its own in which a match may lie, with the least distance from the pivot of a row that can be one.

    cells: (cell, n, radius, least distances); groups: by cell (queries, radius, the score that no k-th best of the home cell falls short of)."""
    norms, out = np.linalg.norm(pivots, axis=1), {}
    np.seterr(invalid="ignore", over="ignore")  # bounds beyond doubles rule nothing out
    for g, (_, far, theta) in groups.items():
        dots = pivots @ pivots[g]
        spread = norms[g] + far
        low = [dots[cell] - far * norms[cell] - spread * d for cell, _, _, least in cells for d in least]
        low = sorted((x for x in low if np.isfinite(x)), reverse=True)
        theta = max(theta, low[k] if len(low) > k else -np.inf)  # one more than k, for a row is no match of itself
        out[g] = {}
        for cell, _, radius, _ in cells:
            if cell != g:
                around = dots[cell] + far * norms[cell]
                slack = 1e-6 * (1 + abs(around) + spread * radius)
                if not around + spread * radius + slack < theta:
                    least = (theta - around - slack) / spread if spread > 0 else -np.inf
                    out[g][cell] = float(least) if np.isfinite(least) else -np.inf
    return out


def joined(wanted: dict[int, dict[int, float]], sizes: dict[int, int], asked: dict[int, int]) -> dict[int, int]:
    """The group that each group becomes part of: two are joined where sending their rows once saves more than the added products cost."""
    head = {g: g for g in wanted}
    sets = {g: frozenset(cells) for g, cells in wanted.items()}
    alike: dict[frozenset, int] = {}
    for g in sorted(wanted):  # equal needs first: those cost nothing
        head[g] = alike.setdefault(sets[g], g)
    held = {g: [sets[g], sum(asked[x] for x in head if head[x] == g)] for g in sorted(set(head.values()))}

    def rows(cells: frozenset) -> int:
        return sum(sizes[c] for c in cells)

    def cost(cells: frozenset, queries: int) -> int:
        return rows(cells) * (SENDING * -(-queries // QUERIES) + queries)

    order = sorted(held, key=lambda g: (-rows(held[g][0]), g))
    kept: list[int] = []
    for g in order:  # each joins the earlier group where it saves most
        cells, queries = held[g]
        saving = [(cost(cells, queries) + cost(*held[h]) - cost(cells | held[h][0], queries + held[h][1]), -h) for h in kept]
        if saving and max(saving)[0] > 0:
            h = -max(saving)[1]
            held[h] = [cells | held[h][0], queries + held[h][1]]
            head = {x: h if y == g else y for x, y in head.items()}
        else:
            kept.append(g)
    return head


def solve(k: int):
    """The k best rows of each query, both of one group, part and block."""

    def run(_, queries: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(queries) and len(held):
            held = held.sort_values(["vec_id", "rid"], kind="stable")
            x = np.frombuffer(b"".join(held["v"]), float).reshape(len(held), -1)
            ids, rids = held["vec_id"].to_numpy(), held["rid"].to_numpy()
            for at in range(0, len(queries), 256):
                some = queries.iloc[at : at + 256]
                s = scores(np.frombuffer(b"".join(some["v"]), float).reshape(len(some), -1), x)
                for row, (rid, query_id, places) in enumerate(zip(some["rid"], some["vec_id"], best_of(s, k + 1), strict=True)):
                    found += [(rid, query_id, rids[c], ids[c], s[row, c]) for c in [c for c in places if rids[c] != rid][:k]]
        return pd.DataFrame(found, columns=["rid", "query_id", "match", "vec_id", "score"])

    return run


def _parts(rows: int, width: int) -> int:
    return max(1, -(-rows // PART), -(-rows * width // VALUES))


def meet(asked: DataFrame, data: DataFrame, groups: dict[int, tuple[int, int]], k: int) -> DataFrame:
    """The best of each group's queries among its rows. asked, data: placed rows with their group ``to``; groups: (parts, blocks) of each."""
    spark = asked.sparkSession
    shape = spark.createDataFrame([(g, parts, blocks) for g, (parts, blocks) in groups.items()], "to int, parts int, blocks int")
    shape, mixed, key = F.broadcast(shape), F.xxhash64("rid"), ["to", "part", "block"]  # a row a group, PIVOTS at most

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def one(n: str) -> Column:
        return F.pmod(mixed, F.col(n).cast("long")).cast("int")

    rows = data.join(shape, "to").select("to", one("parts").alias("part"), every("blocks").alias("block"), "rid", "vec_id", "v")
    queries = asked.join(shape, "to").select("to", every("parts").alias("part"), one("blocks").alias("block"), "rid", "vec_id", "v")
    return queries.groupBy(*key).cogroup(rows.groupBy(*key)).applyInPandas(solve(k), FOUND)


def top_k(prepared: DataFrame, path: str, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of every row with is_query among all others. prepared: from scaled()."""
    spark = prepared.sparkSession
    rows = saved(prepared, f"{path}/rows")
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_query").cast("long")).alias("q"), F.max(F.size("v")).alias("width")).first()
    if not seen.n or not seen.q:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(1, seen.width)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "rid").limit(min(PIVOTS, max(1, seen.n // PER_PIVOT))).select("v").collect()
    pivots = np.unique(matrix([r.v for r in sample], width), axis=0)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = (pivots**2).sum(axis=1)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                lists = part.column(3)
                starts = lists.offsets.to_numpy()
                values = lists.flatten().to_numpy(zero_copy_only=False)
                x = matrix([values[a - starts[0] : b - starts[0]] for a, b in zip(starts[:-1], starts[1:], strict=True)], width)
                cell = np.argmin(half[None, :] - 2 * (x @ pivots.T), axis=1)
                near = np.linalg.norm(x - pivots[cell], axis=1)
                columns = [*part.columns[:3], pa.array([r.tobytes() for r in x], pa.binary()), pa.array(cell.astype(np.int32)), pa.array(near)]
                yield pa.RecordBatch.from_arrays(columns, ["rid", "vec_id", "is_query", "v", "cell", "near"])

    placed = saved(rows.mapInArrow(assign, f"{ROW}, cell int, near double"), f"{path}/placed")
    asked = spark.read.schema(placed.schema).parquet(f"{path}/placed").where("is_query")  # read anew, for it meets its own table
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("near"))
    least = placed.select("cell", "near").withColumn("rank", rank).where(F.col("rank") <= k + 1).groupBy("cell").agg(F.collect_list("near").alias("least"))
    far = F.max(F.when(F.col("is_query"), F.col("near"))).alias("far")
    queries = F.sum(F.col("is_query").cast("long")).alias("queries")
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("near").alias("radius"), queries, far).join(least, "cell").collect()  # a row a pivot
    sizes, homes = {r.cell: r.n for r in cells}, {r.cell: r for r in cells if r.queries}

    def shapes(rows_of: dict[int, int], queries_of: dict[int, int]) -> dict[int, tuple[int, int]]:
        return {g: (_parts(n, width), max(1, -(-queries_of[g] // QUERIES))) for g, n in rows_of.items()}

    counts = {g: r.queries for g, r in homes.items()}
    home = meet(asked.withColumn("to", F.col("cell")), placed.withColumn("to", F.col("cell")), shapes({g: sizes[g] for g in homes}, counts), k)
    home = saved(home, f"{path}/home")
    # of each query the k-th best so far, of each group the least of those
    worst = home.groupBy("rid").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).select("rid", F.get("s", F.lit(k - 1)).alias("kth"))
    worst = asked.select("rid", "cell").join(worst, "rid", "left").groupBy("cell")
    thetas = {r.cell: r for r in worst.agg(F.min("kth").alias("least"), F.count("kth").alias("n"), F.count(F.lit(1)).alias("of")).collect()}  # a row a group
    groups = {g: (r.queries, r.far, float(thetas[g]["least"]) if thetas[g].n == thetas[g].of else -np.inf) for g, r in homes.items()}
    wanted = reach(pivots, [(r.cell, r.n, r.radius, r["least"]) for r in cells], groups, k)
    head = joined(wanted, sizes, counts)
    found = home
    pairs: dict[tuple[int, int], float] = {}
    for g, needed in wanted.items():
        for cell, from_ in needed.items():
            pairs[head[g], cell] = min(from_, pairs.get((head[g], cell), np.inf))
    if pairs:
        rows_of: dict[int, int] = {}
        queries_of: dict[int, int] = {}
        for to, cell in pairs:
            rows_of[to] = rows_of.get(to, 0) + sizes[cell]
        for g, to in head.items():
            queries_of[to] = queries_of.get(to, 0) + counts[g]
        where = F.broadcast(spark.createDataFrame([(to, cell, x) for (to, cell), x in pairs.items()], "to int, cell int, from_ double"))  # PIVOTS squared at most
        heads = F.broadcast(spark.createDataFrame(list(head.items()), "cell int, to int"))
        data = placed.join(where, "cell").where("NOT near < from_")
        # the home cell of one part of a joined group may be among the cells that another part needs
        others = meet(asked.join(heads, "cell"), data, shapes(rows_of, queries_of), k)
        found = home.unionByName(others).dropDuplicates(["rid", "match"])
    order = Window.partitionBy("rid").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
