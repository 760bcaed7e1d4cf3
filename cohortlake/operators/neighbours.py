"""The nearest rows, exactly, without pairs of the whole table.

Rows with equal features are one place, which keeps its k + 1 smallest keys: no row needs more
of them. Places are cut into chunks of a bounded size along a tree, so the places of a chunk lie
together. Every place is searched for in its own chunk first. The distance of the last neighbour
found there says which other chunks may hold one as near, by the box around their places, and
the place is searched for in all of these too. Nothing is left out, in any number of features;
with a few, few chunks are asked beside the own one, with many, most of them are.

Bounds of boxes are rounded as distances are, feature by feature in the same order, so a bound
is never above the distance of a place in the box. ``neighbour_recall`` checks the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cohortlake.functions.scalars import hash_unit
from cohortlake.operators.joins import SMALL_ROWS, join_small
from cohortlake.operators.runs import POS, sorted_runs
from cohortlake.session import materialise

#: orders of the plane (the exact search needs none), rows of a block
ORDERS, BLOCK = 3, 64
#: keys that a chunk of places holds on average, and places that are searched for in one task
CHUNK = 1 << 14
#: places for each chunk, and numbers in all, that the tree of the chunks is made from
CUT_FROM, CUT_MOST = 64, 1 << 20


def _require_numbers(df: DataFrame, features: Sequence[str]) -> None:
    """A row without a feature has no distance; impute first."""
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in features])
    n = df.filter(missing).count()
    if n:
        raise ValueError(f"{n} rows lack a feature; impute or drop them before looking for neighbours")


# Functions made by a function are sent with the job, so workers need not hold this package.


def _halving() -> Callable[[np.ndarray, int], tuple[list, list[np.ndarray]]]:
    def halved(points: np.ndarray, most: int) -> tuple[list, list[np.ndarray]]:
        """A tree that halves the points along their widest feature, and the points of its leaves.

        A node is [feature, greatest value on the left, left, right], a leaf [-1, 0, its number, -1].
        Leaves near in number are near in space; equal points are not parted.
        """
        points = np.clip(points, -1e100, 1e100)  # the spread of a feature is a number
        nodes: list = []
        leaves: list[np.ndarray] = []
        waiting = [(np.arange(len(points)), -1, 0)]
        while waiting:
            rows, parent, side = waiting.pop()
            if parent >= 0:
                nodes[parent][side] = len(nodes)
            spread = np.ptp(points[rows], axis=0) if len(rows) > most else np.zeros(1)
            if not spread.max() > 0:
                nodes.append([-1, 0.0, len(leaves), -1])
                leaves.append(rows)
                continue
            feature = int(spread.argmax())
            value = points[rows, feature]
            middle = (len(rows) - 1) // 2
            cut = np.partition(value, middle)[middle]
            if cut == value.max():
                cut = value[value < cut].max()
            waiting += [(rows[value > cut], len(nodes), 3), (rows[value <= cut], len(nodes), 2)]
            nodes.append([feature, float(cut), 0, 0])
        return nodes, leaves

    return halved


def _bounding() -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    def bounds(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For each point and box, no more than the squared distance of anything in the box; 0 where that is no number."""
        least = np.zeros((len(x), len(low)))
        for f in range(x.shape[1]):
            gap = np.maximum(np.maximum(low[:, f] - x[:, f, None], x[:, f, None] - high[:, f]), 0.0)
            least += gap * gap
        least[np.isnan(least)] = 0.0
        return least

    return bounds


def _matrix() -> Callable[[pa.Array | pa.ChunkedArray, int], np.ndarray]:
    def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)

    return matrix


def _ranking() -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    def ranked(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Dense ranks of the keys, -1 of a missing one, and a row that holds each rank."""
        at = pc.sort_indices(keys, null_placement="at_end").to_numpy()
        at = at[:len(keys) - keys.null_count]
        ordered = keys.take(pa.array(at))
        new = np.append(True, pc.not_equal(ordered[1:], ordered[:-1]).to_numpy(zero_copy_only=False)) if len(at) else np.empty(0, bool)
        rank = np.full(len(keys), -1, np.int64)
        rank[at] = np.cumsum(new) - 1
        return rank, at[new]

    return ranked


def _least_keys(width: int, most: int, gathered: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    matrix, ranked = _matrix(), _ranking()
    names = ["_x", "_keys"]

    def thinned(places: pa.Array, lists: pa.Array) -> pa.RecordBatch:
        keys = lists.flatten()
        of = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        x, rank = matrix(places, width), ranked(keys)[0]
        # equal places side by side, in the order in which they come
        by = np.lexsort(x.T)
        new = np.append(True, (x[by[1:]] != x[by[:-1]]).any(axis=1))
        number = np.empty(len(x), np.int64)
        number[by] = np.minimum.reduceat(by, np.flatnonzero(new))[np.cumsum(new) - 1]
        number = number[of]
        order = np.lexsort((rank, number))
        number, rank = number[order], rank[order]
        new = np.append(True, number[1:] != number[:-1])
        once = new | np.append(True, rank[1:] != rank[:-1])
        order, number, new = order[once], number[once], new[once]
        first = np.flatnonzero(new)
        keep = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order)))) < most
        offsets = np.append(0, np.cumsum(np.add.reduceat(keep, first, dtype=np.int64))).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [places.take(pa.array(number[first])), pa.ListArray.from_arrays(pa.array(offsets), keys.take(pa.array(order[keep])))], names)

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The places of a batch, each with its smallest keys; if gathered, equal places come one after the other."""
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            places, lists = batch.columns
            if held is not None:
                places = pa.concat_arrays([held.column(0).cast(places.type), places])
                lists = pa.concat_arrays([held.column(1).cast(lists.type), lists])
            done = thinned(places, lists)
            if gathered:
                # the last place may go on in the next batch
                held = done.slice(done.num_rows - 1)
                done = done.slice(0, done.num_rows - 1)
            yield done
        if held is not None:
            yield held

    return least


def _in_cells(nodes: list, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    matrix = _matrix()
    tree = [np.array(column) for column in zip(*nodes)]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The leaf of the tree that each place falls into."""
        feature, cut, left, right = tree
        for batch in batches:
            x = matrix(batch.column(0), width)
            node = np.zeros(len(x), np.int64)
            while (inner := np.flatnonzero(feature[node] >= 0)).size:
                at = node[inner]
                node[inner] = np.where(x[inner, feature[at]] <= cut[at], left[at], right[at])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(left[node].astype(np.int64))], ["_x", "_keys", "_cell"])

    return placed


def _in_chunk(width: int, most: int, block: int, floor: np.ndarray, ceiling: np.ndarray) -> Callable[[pa.Table], pa.Table]:
    halved, bounds, matrix, ranked = _halving(), _bounding(), _matrix(), _ranking()
    nothing = complex(np.nan, np.nan)

    def search(points: np.ndarray, ranks: np.ndarray, asked: np.ndarray, bars: np.ndarray, limits: np.ndarray) -> np.ndarray:
        """The ``most`` nearest of the points for each one asked, but for those of the barred rank.

        A neighbour is a complex number, the squared distance and the rank: they sort by distance and rank,
        a distance that is no number after the others, and one without a rank is none.
        """
        held = np.full((len(asked), most), nothing)
        if not len(points):
            return held
        _, leaves = halved(points, block)
        size = max(map(len, leaves))
        member = np.full((len(leaves), size), -1, np.int64)
        for number, leaf in enumerate(leaves):
            member[number, :len(leaf)] = leaf
        low = np.array([points[leaf].min(axis=0) for leaf in leaves])
        high = np.array([points[leaf].max(axis=0) for leaf in leaves])
        # a key at several places may be met twice at one distance
        repeated = len(np.unique(ranks)) < len(ranks)

        def visit(best: np.ndarray, x: np.ndarray, bar: np.ndarray, i: np.ndarray, leaf: np.ndarray) -> None:
            rows = member[leaf]
            away = np.zeros(rows.shape)
            for f in range(width):
                step = points[rows, f] - x[i, f, None]
                away += step * step
            away[rows < 0] = np.inf
            # the others have nothing to add
            near = ~(away.min(axis=1) > best[i, -1].real)
            i, rows, away = i[near], rows[near], away[near]
            found = np.empty(rows.shape, complex)
            found.real, found.imag = away, ranks[rows]
            found[(rows < 0) | (ranks[rows] == bar[i, None])] = nothing
            found = np.concatenate([best[i], found], axis=1)
            if repeated:
                found.sort(axis=1)
                a, b = found[:, 1:], found[:, :-1]
                again = (a.imag == b.imag) & ((a.real == b.real) | (np.isnan(a.real) & np.isnan(b.real)))
                found[:, 1:][again] = nothing
            found.partition(most - 1, axis=1)
            best[i] = np.sort(found[:, :most], axis=1)

        # a bounded number of bounds and distances at a time
        step = max(1, 1_000_000 // max(len(leaves), size + most))
        for start in range(0, len(asked), step):
            part = slice(start, start + step)
            best, x, bar, limit = held[part], asked[part], bars[part], limits[part]
            every = np.arange(len(x))
            near = bounds(x, low, high)
            first = near.argmin(axis=1)
            visit(best, x, bar, every, first)
            # other leaves that may hold one as near as the last one found; all of them while too few are found
            may = ~(near > np.fmin(best[:, -1].real, limit)[:, None])
            may[every, first] = False
            i, leaf = np.nonzero(may)
            order = np.lexsort((near[i, leaf], i))
            i, leaf = i[order], leaf[order]
            nth = np.arange(len(i)) - np.searchsorted(i, every)[i]
            # the nearest of them for every place at once, then the second
            for turn in np.split(np.argsort(nth, kind="stable"), np.cumsum(np.bincount(nth))[:-1]) if len(i) else []:
                now, there = i[turn], leaf[turn]
                still = ~(near[now, there] > np.fmin(best[now, -1].real, limit[now]))
                if still.any():
                    visit(best, x, bar, now[still], there[still])
        return held

    def nearest_in_chunk(table: pa.Table) -> pa.Table:
        """What the places asked for find among those held, and whether the box of another chunk is as near as the last one found."""
        asking = pc.is_null(table.column("_keys"))
        held, asked = table.filter(pc.invert(asking)), table.filter(asking)
        lists, bars = held.column("_keys").combine_chunks(), asked.column("_bar").combine_chunks()
        keys = pa.concat_arrays([lists.flatten(), bars])
        rank, holder = ranked(keys)
        n = len(keys) - len(bars)
        points = np.repeat(matrix(held.column("_x"), width), pc.list_value_length(lists).to_numpy(zero_copy_only=False), axis=0)
        limits = pc.fill_null(asked.column("_limit"), np.nan).to_numpy()
        x, own = matrix(asked.column("_x"), width), asked.column("_chunk").to_numpy()
        more = np.zeros(len(x), bool)
        step = max(1, 1_000_000 // max(1, len(floor)))
        with np.errstate(all="ignore"):
            best = search(points, rank[:n], x, rank[n:], limits)
            for start in range(0, len(x), step) if len(floor) > 1 else []:
                may = ~(bounds(x[start:start + step], floor, ceiling) > best[start:start + step, -1:].real)
                may[np.arange(len(may)), own[start:start + step]] = False
                more[start:start + step] = may.any(axis=1)
        keep = ~np.isnan(best.imag)
        offsets = np.append(0, np.cumsum(keep.sum(axis=1))).astype(np.int32)
        found = best[keep]
        near = pa.StructArray.from_arrays(
            [pa.array(found.real), keys.take(pa.array(holder[found.imag.astype(np.int64)]))], ["distance", "key"])
        return asked.select(["_place", "_bar", "_x", "_chunk"]).append_column("_more", pa.array(more)).append_column(
            "near", pa.ListArray.from_arrays(pa.array(offsets), near))

    return nearest_in_chunk


def _elsewhere(low: np.ndarray, high: np.ndarray, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    bounds, matrix = _bounding(), _matrix()

    def reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The other chunks that may hold a neighbour as near as the last one found, or any while too few are found."""
        width = low.shape[1]
        step = max(1, 1_000_000 // (len(low) * width))
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("near"))
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            away = np.append(lists.flatten().field("distance").to_numpy(zero_copy_only=False), np.nan)
            limit = np.where(sizes == most, away[np.cumsum(sizes) - 1], np.nan)
            own = batch.column(batch.schema.get_field_index("_chunk")).to_numpy()
            x = matrix(batch.column(batch.schema.get_field_index("_x")), width)
            for start in range(0, len(x), step):
                with np.errstate(all="ignore"):
                    may = ~(bounds(x[start:start + step], low, high) > limit[start:start + step, None])
                may[np.arange(len(may)), own[start:start + step]] = False
                i, chunk = np.nonzero(may)
                taken = batch.select(["_place", "_bar", "_x"]).take(pa.array(start + i))
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array(chunk), pa.array(limit[start + i])], ["_place", "_bar", "_x", "_chunk", "_limit"])

    return reaching


def _searched(places: DataFrame, asked: DataFrame, n_chunks: int, kernel: Callable[[pa.Table], pa.Table], made: T.StructType) -> DataFrame:
    """What each place asked for finds in the chunk that it is sent to, in tasks of a bounded number of them."""
    # one number for each chunk
    sizes = {r["_chunk"]: r["count"] for r in asked.groupBy("_chunk").count().collect()}
    parts = F.element_at(F.lit([-(-sizes.get(c, 0) // CHUNK) for c in range(max(1, n_chunks))]), F.col("_chunk").cast("int") + 1)
    kind = asked.schema["_bar"].dataType
    held = places.select("_chunk", parts.alias("_parts"), "_place", "_x", "_keys").filter("_parts > 0").select(
        "_chunk", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), "_place", "_x",
        F.lit(None).cast(kind).alias("_bar"), F.lit(None).cast("double").alias("_limit"), "_keys")
    sent = asked.select(
        "_chunk", F.pmod(F.xxhash64("_place", "_bar"), parts).cast("int").alias("_part"), "_place", "_x", "_bar", "_limit",
        F.lit(None).cast(places.schema["_keys"].dataType).alias("_keys"))
    return held.unionByName(sent).groupBy("_chunk", "_part").applyInArrow(kernel, made)


def _least(column: str, k: int) -> Column:
    """The first ``k`` of the lists of a group, each once."""
    return F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(column)))), 1, k)


def nearest(
    df: DataFrame, features: Sequence[str], key: str, k: int = 5, orders: int = ORDERS, block: int = BLOCK, seed: int = 42,
) -> DataFrame:
    """``key`` and ``near``: the ``k`` nearest other rows as (distance, key), the nearest first.

    Distances are Euclidean, and none nearer is left out; ties go to the smaller key. Rows
    without a feature are refused. Any number of features works. ``key`` is unique; rows of equal key, or
    without one, are no neighbours, and a repeated key has the nearest of all its rows. ``block`` rows are
    compared at a time, ``seed`` draws the places that the tree of the chunks is made from: neither
    changes the result, nor does ``orders``, which is no longer needed.
    """
    names = list(features)
    _require_numbers(df, names)
    width, most = len(names), k + 1
    # adding 0.0 makes one zero of two
    x = F.array(*[F.col(c).cast("double") + F.lit(0.0) for c in names])
    rows = materialise(df.select(F.col(key).alias("_key"), x.alias("_x")))
    kind = rows.schema["_key"].dataType
    known = rows.filter(F.col("_key").isNotNull())
    listed = T.StructType([T.StructField("_x", T.ArrayType(T.DoubleType())), T.StructField("_keys", T.ArrayType(kind))])
    # the rows of a place are thinned out before they are shuffled, and once more where they meet
    thinned = known.select("_x", F.array("_key").alias("_keys")).mapInArrow(_least_keys(width, most, False), listed)
    met = thinned.withColumn("_hash", F.xxhash64("_x")).repartition("_hash").sortWithinPartitions("_hash", "_x").select("_x", "_keys")
    places = materialise(met.mapInArrow(_least_keys(width, most, True), listed))
    total = places.agg(F.count(F.lit(1)).alias("places"), F.sum(F.size("_keys")).alias("keys")).first()
    if rows.isEmpty():
        return df.select(F.col(key), F.array().cast("array<struct<distance:double,key:string>>").alias("near")).limit(0)
    n_places, n_keys = total["places"], total["keys"] or 0
    nodes = [[-1, 0.0, 0, -1]]
    if n_keys > CHUNK:
        # the tree only says which places share a chunk
        drawn = F.pmod(F.xxhash64(F.lit(seed), "_x"), F.lit(n_places)) < min(CUT_FROM * (n_keys // CHUNK + 1), CUT_MOST // width)
        points = places.filter(drawn).select("_x").toArrow().column("_x")
        nodes, _ = _halving()(_matrix()(points, width), CUT_FROM)
    cells = places.mapInArrow(_in_cells(nodes, width), T.StructType([*listed, T.StructField("_cell", T.LongType())]))
    ordered = sorted_runs(cells, ["_cell", "_x"]).rows
    # a few numbers for each leaf of the tree; a leaf is one chunk, a very full one several
    leaves = {r["_cell"]: r for r in ordered.groupBy("_cell").agg(
        F.min(POS).alias("start"), F.count(F.lit(1)).alias("places"), F.sum(F.size("_keys")).alias("keys")).collect()}
    starts, sizes, cuts, before, n_chunks = [], [], [], [], 0
    for cell in range(max(leaves, default=0) + 1):
        r = leaves.get(cell)
        starts.append(r["start"] if r else 0)
        sizes.append(r["places"] if r else 1)
        cuts.append(min(r["places"], -(-r["keys"] // (2 * CHUNK))) if r else 0)
        before.append(n_chunks)
        n_chunks += cuts[-1]
    start, size, cut, first = [F.element_at(F.lit(v).cast("array<bigint>"), F.col("_cell").cast("int") + 1) for v in (starts, sizes, cuts, before)]
    placed = ordered.withColumns({"_start": start, "_size": size, "_cut": cut, "_first": first}).select(
        F.col(POS).alias("_place"), "_x", "_keys", F.expr(f"_first + ({POS} - _start) * _cut div _size").alias("_chunk"))
    # one box for each chunk
    boxes = placed.groupBy("_chunk").agg(
        *[F.array(*[f(F.col("_x")[i]) for i in range(width)]).alias(n) for n, f in (("low", F.min), ("high", F.max))]).orderBy("_chunk").collect()
    # a row finds its own key among those of its place, so one more is looked for; a key at several places
    # may be met more often, and asks for itself
    asked = placed.select("_place", F.lit(None).cast(kind).alias("_bar"), "_x", "_chunk")
    repeated = materialise(known.groupBy("_key").count().filter("count > 1").select("_key"))
    barred = not repeated.isEmpty()
    if barred:
        asking = known.join(repeated, "_key", "left_semi").distinct()
        asked = asked.unionByName(asking.join(placed, "_x").select("_place", F.col("_key").alias("_bar"), "_x", "_chunk"))
    asked = materialise(asked.withColumn("_limit", F.lit(None).cast("double")))
    made = T.StructType([
        T.StructField("_place", T.LongType()), T.StructField("_bar", kind), listed["_x"], T.StructField("_chunk", T.LongType()),
        T.StructField("_more", T.BooleanType()), T.StructField("near", T.ArrayType(T.StructType([T.StructField("distance", T.DoubleType()), T.StructField("key", kind)])))])
    low, high = (np.array([r[n] for r in boxes], float).reshape(len(boxes), width) for n in ("low", "high"))
    found = materialise(_searched(placed, asked, n_chunks, _in_chunk(width, most, block, low, high), made))
    if n_chunks > 1:
        more = found.filter("_more")
        others = more.mapInArrow(_elsewhere(low, high, most), asked.select("_place", "_bar", "_x", "_chunk", "_limit").schema)
        there = _searched(placed, others, n_chunks, _in_chunk(width, most, block, low[:0], high[:0]), made)
        found = materialise(found.filter(~F.col("_more")).select("_bar", "_x", "near").unionByName(
            more.unionByName(there).groupBy("_place", "_bar", "_x").agg(_least("near", most).alias("near")).select("_bar", "_x", "near")))

    def answer(keys: DataFrame, near: Column) -> DataFrame:
        return keys.select(F.col("_key").alias(key), F.transform(near, lambda n: F.struct(
            F.sqrt(n["distance"]).alias("distance"), n["key"].alias("key"))).alias("near"))

    single = known.join(repeated, "_key", "left_anti") if barred else known
    of_place = found.filter(F.col("_bar").isNull()).select("_x", "near")
    others = F.filter("near", lambda n: n["key"] != F.col("_key"))
    # a bounded number of values is broadcast
    answers = answer(join_small(single, of_place, "_x", limit=min(SMALL_ROWS, 4_000_000 // (width + 4 * most))), F.slice(others, 1, k))
    if barred:
        of_key = found.filter(F.col("_bar").isNotNull()).groupBy(F.col("_bar").alias("_key")).agg(_least("near", k).alias("near"))
        answers = answers.unionByName(answer(of_key, F.col("near")))
    unknown = rows.filter(F.col("_key").isNull()).select("_key").limit(1)
    return answers.unionByName(answer(unknown, F.array().cast(made["near"].dataType)))


def _closer(held: list, width: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per task and query: the other rows, and those strictly nearer than each neighbour found."""
    keys = [r["q"] for r in held]
    nth = [keys.index(q) for q in keys]  # a repeated key is one query
    points = [[float(v) for v in r["qx"]] for r in held]
    limits = [list(r["d"]) for r in held]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(keys), k + 1), np.int64)
        for batch in batches:
            found = batch.column(0)
            x = np.ascontiguousarray(batch.column(1).flatten().to_numpy().reshape(batch.num_rows, width).T)
            for i, (key, point, limit) in enumerate(zip(keys, points, limits)):
                other = pc.fill_null(pc.not_equal(found, pa.scalar(key, found.type)), False).to_numpy(zero_copy_only=False)
                away = np.zeros(batch.num_rows)
                for f in range(width):
                    step = x[f] - point[f]
                    away += step * step
                away = np.sqrt(away)
                counts[i, 0] += np.count_nonzero(other)
                for j, d in enumerate(limit):
                    counts[i, j + 1] += np.count_nonzero((away < d if d == d else away == away) & other)
        yield pa.RecordBatch.from_arrays(
            [pa.array(nth, pa.int64()), *[pa.array(c) for c in counts.T],
             pa.array([len(d) for d in limits], pa.int64())],
            ["nth", "others", *[f"closer{j}" for j in range(k)], "n_found"])

    return run


def neighbour_recall(df: DataFrame, features: Sequence[str], key: str, k: int = 5, queries: int = 200, **options) -> DataFrame:
    """Share of the neighbours found that belong to the true k nearest, over ``queries`` rows drawn by a hash.

    Each query meets every row in one scan, which counts the rows strictly nearer than each
    neighbour found: a neighbour is a true one if fewer than k are, so equal distances count.
    """
    names = list(features)
    asked = df.orderBy(hash_unit(F.col(key), "recall"), key).limit(queries)
    drawn = asked.select(F.col(key).alias("q"), F.array(*[F.col(c).cast("double") for c in names]).alias("qx"))
    near = nearest(df, names, key, k, **options)
    found = materialise(join_small(near.withColumnRenamed(key, "q"), drawn, "q"))
    # ``queries`` rows reach the driver, with the distances of their neighbours
    held = found.select("q", "qx", F.transform("near", lambda n: n["distance"]).alias("d")).collect()
    rows = df.select(F.col(key).alias("_key"), F.array(*[F.col(c).cast("double") for c in names]).alias("_x"))
    met = rows.mapInArrow(_closer(held, len(names), k), T.StructType([
        T.StructField(c, T.LongType()) for c in ("nth", "others", *[f"closer{j}" for j in range(k)], "n_found")]))
    closer = met.groupBy("nth").agg(
        *[F.sum(c).alias(c) for c in ("others", *[f"closer{j}" for j in range(k)])], F.max("n_found").alias("n_found")
    ).filter("others > 0")
    right = reduce(lambda a, b: a + b, [
        F.when((F.lit(j) < F.col("n_found")) & (F.col(f"closer{j}") < k), 1).otherwise(0) for j in range(k)])
    return closer.agg(
        F.count(F.lit(1)).alias("n_queries"),
        (F.sum(right) / F.sum(F.least(F.col("others"), F.lit(k)))).alias("recall"))
