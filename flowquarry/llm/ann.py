"""Approximate nearest neighbours by inner product: NN-descent graph, greedy graph search.

Vectors. Null, zero, empty and non-finite vectors take no part; vectors of different lengths are an error. Equal
vectors are one node of the graph, so any number of copies is one node; results are put back on ids at the end,
and for k neighbours the k + 1 smallest ids of a node always suffice.

Building. A node has two lists: the `degree` nodes of least angle to it, and the `degree` nodes of largest inner
product with it. The first makes the graph one of neighbourhoods whatever the norms are; the second is what is
asked for, and a node's neighbours by angle have nearly the same one. Where all norms are equal the two agree and
one is kept. Rough blocks, by planes halfway between pairs of nodes, start the lists. Then, round by round, joins
bring the neighbours and reverse neighbours of a node together (neighbours of neighbours); entries are flagged new
until they have taken part, pairs of old ones are passed over, and so are nodes without a new one. Rounds end when
few lists change. Vectors travel whole, as floats where that loses nothing, and are compared in double precision.

Searching. A query holds a pool of the `width` best nodes it has seen. Each step joins its best nodes not yet
opened with the graph, scores their neighbours exactly (double precision, original vectors) and keeps the best,
until few pools have nodes left to open. Queries start at given nodes; rows of the table start at their own. As a fixed width
finds less the more nodes there are, recall is measured in the run: a fixed number of queries is compared with all nodes, and if their
pools hold too few of the best nodes, an exact check follows: blocks of queries meet blocks of nodes, and each query gets what reaches the
bar that its pool sets, the score of its k-th best node. Then nothing is missed. That is one product of matrices for each pair of blocks, with a pass over it; the work
grows with queries times nodes, but far more pools, which a graph of nearly isotropic vectors asks for, cost more (README).

Scale. Work is per node and per query; reverse lists are sampled to `reverse` members by hash, as the method
does, so a hub is no hot key. Nothing is collected but a fixed number of vectors for the planes; rounds are written
tables, and each is deleted when the next is there. Repeated ids with different vectors are rows like any other. Extra
columns are ignored, and an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowquarry.llm.stage import dropped, settled

DEGREE, JOINED, REVERSE, ROUNDS = 24, 12, 8, 40
WIDTH, OPENED, STEPS = 32, 16, 100
#: Rounds and steps end when at most this share of all lists' or pools' entries is new; ROUNDS and STEPS only bound them.
DONE = 0.02
#: The exact check follows if less than this share of the best nodes of HELD queries (against all nodes) is in their pools.
TARGET, HELD = 0.91, 100
#: Components of vectors in a block of the exact check, and queries and nodes of a block that are compared at once.
NUMBERS, ASKED, MET = 1 << 20, 512, 2048
#: Rough blocks: how often nodes are dealt into blocks of about BLOCK, and how many a node keeps of each of its blocks.
TREES, BLOCK, FIRST, PLANES = 28, 1024, 10, 24
#: The two orders of a node's lists.
ANGLE, PRODUCT = 0, 1


def vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, vec) of the rows that take part; ids are made long and vectors arrays of float, if they are such, or of double."""
    kind = table.schema[vec_col].dataType
    kind = "float" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "double"
    rows = table.select(table[id_col].cast("long").alias("id"), table[vec_col].cast(f"array<{kind}>").alias("vec")).where("id is not null and size(vec) > 0")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.where(F.forall("vec", fine) & F.exists("vec", lambda x: x != 0))
    # -0.0 is made 0.0, so that equal vectors are one node
    return rows.select("id", F.transform("vec", lambda x: x + F.lit(0.0).cast(kind)).alias("vec"))


def nodes(rows: DataFrame, keep: int) -> tuple[DataFrame, DataFrame]:
    """(node, vec) of distinct vectors, node being the smallest id, and (node, ids) with the `keep` smallest ids of each."""
    distinct = settled(rows.groupBy("vec").agg(F.min("id").alias("node")).select("node", "vec"))
    known = rows.join(distinct.withColumnRenamed("vec", "_vec"), F.col("vec") == F.col("_vec")).select("node", "id")
    # Spark limits a hot node's rows in every task before it deals them out
    few = known.withColumn("n", F.row_number().over(Window.partitionBy("node").orderBy("id"))).where(F.col("n") <= keep)
    return distinct, settled(few.groupBy("node").agg(F.array_sort(F.collect_list("id")).alias("ids")))


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _unpacked(blobs: pa.Array, size: int) -> np.ndarray:
    """The vectors that _coded has packed, in double precision."""
    found = blobs.to_pylist()
    narrow = np.fromiter((len(b) == 4 * size for b in found), bool, len(found))
    v = np.empty((len(found), size))
    for own, kind in ((narrow, np.float32), (~narrow, np.float64)):
        v[own] = np.frombuffer(b"".join(b for b, o in zip(found, own) if o), kind).reshape(-1, size)
    return v


def _coded(distinct: DataFrame, size: int, trees: int) -> DataFrame:
    """(node, code, places): the vector's bytes, and on which side of each plane its direction lies, per tree."""
    # a fixed number of rows
    ends = distinct.orderBy(F.xxhash64("node", F.lit(-1)), "node").limit(2 * PLANES * trees).select("vec").collect()
    ends = np.array([r["vec"] for r in ends] or np.ones((1, size)), float)
    ends /= np.linalg.norm(ends, axis=1, keepdims=True)
    pairs = np.arange(PLANES * trees)
    x, y = ends[2 * pairs % len(ends)], ends[(2 * pairs + 1) % len(ends)]
    normals, middles = (x - y).T, ((x + y) / 2 * (x - y)).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column(1))
            short = v.astype(np.float32)
            fits = (short == v).all(axis=1)
            code = [(s if f else w).tobytes() for s, w, f in zip(short, v, fits)]
            unit = v / np.linalg.norm(v, axis=1, keepdims=True)
            side = (unit @ normals > middles).astype(np.int64).reshape(len(v), trees, PLANES)
            places = (side << np.arange(PLANES)).sum(axis=2)
            yield pa.record_batch([batch.column(0), pa.array(code, pa.binary()), pa.array(places.tolist(), pa.list_(pa.int64()))], names=["node", "code", "places"])

    return distinct.select("node", "vec").mapInArrow(run, "node long, code binary, places array<long>")


_LISTS = "node long, kind int, far array<double>, other array<long>, old array<boolean>"
_NEAR = "node long, kind int, near array<struct<far: double, other: long, new: boolean>>"


def _merged(parts: list[tuple[np.ndarray, ...]], degree: int) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """(node, kind, far, other, old) of the best `degree` of each node's (kind, other, far), nearest first, old if one of the same is; and where a list begins."""
    node, kind, far, other, old = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((~old, other, far, kind, node))
    node, kind, far, other, old = (x[order] for x in (node, kind, far, other, old))
    head = np.ones(len(node), bool)
    head[1:] = (node[1:] != node[:-1]) | (kind[1:] != kind[:-1])
    fresh = head.copy()
    fresh[1:] |= (far[1:] != far[:-1]) | (other[1:] != other[:-1])
    first = np.flatnonzero(head)
    place = np.cumsum(fresh) - 1
    keep = fresh & (place - np.repeat(place[first], np.diff(np.append(first, len(node)))) < degree)
    return tuple(x[keep] for x in (node, kind, far, other, old)), np.flatnonzero(head[keep])


def _listed(first: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(first, len(values)), pa.int32()), values)


def _best(lists: DataFrame, degree: int) -> DataFrame:
    """(node, kind, near): the best `degree` of each node's (kind, other, far), nearest first, new unless a list names it as old. A task holds the entries of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def near(entries: tuple[np.ndarray, ...], first: np.ndarray) -> pa.RecordBatch:
            node, kind, far, other, old = entries
            values = pa.StructArray.from_arrays([pa.array(far), pa.array(other), pa.array(~old)], names=["far", "other", "new"])
            return pa.record_batch([pa.array(node[first]), pa.array(kind[first]), _listed(first, values)], names=["node", "kind", "near"])

        held = None
        for batch in batches:
            if batch.num_rows:
                far, other, old = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (2, 3, 4))
                sizes = batch.column(2).value_lengths().to_numpy()
                fresh = (*(np.repeat(batch.column(i).to_numpy(), sizes) for i in (0, 1)), far, other, old)
                held, first = _merged([fresh] if held is None else [held, fresh], degree)
                cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # rows come by node: all but the last are whole
                if cut:
                    yield near(tuple(x[:cut] for x in held), first[first < cut])
                    held = tuple(x[cut:] for x in held)
        if held is not None and len(held[0]):
            yield near(*_merged([held], degree))

    return lists.repartition("node").sortWithinPartitions("node").mapInArrow(run, _NEAR)


def _local(degree: int, kept: int, limit: int, size: int, kinds: tuple[int, ...]):
    """Rows (place, node, code, new, bar, reach) sorted by place: each place's `degree` nearest members, if under the bar of their list; a task keeps `kept` of a node."""

    def search(ids: np.ndarray, v: np.ndarray, new: np.ndarray, bars: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        out, n = [], len(ids)
        take = min(degree, n - 1)
        unit = v / np.linalg.norm(v, axis=1, keepdims=True)
        passed = None if new.all() else ~(new[:, None] | new[None, :])
        for kind in kinds:
            if kind == ANGLE:
                c = unit - unit[0]  # a common offset takes no digits away
                # squared distances but for the row's own square, in one product
                rough = np.column_stack([c, np.ones(n)]) @ np.column_stack([-2.0 * c, (c * c).sum(axis=1)]).T
            else:
                rough = v @ (v[0] - v).T
            if passed is not None:
                rough[passed] = np.inf
            np.fill_diagonal(rough, np.inf)
            top = np.argpartition(rough, take - 1, axis=1)[:, :take]
            own, other = np.repeat(np.arange(n), take), top.ravel()
            ok = own != other
            if passed is not None:
                ok &= ~passed[own, other]
            own, other = own[ok], other[ok]
            # the same for a pair wherever it meets, so that it is one entry of a list
            far = ((unit[own] - unit[other]) ** 2).sum(axis=1) if kind == ANGLE else -(v[own] * v[other]).sum(axis=1)
            ok = far < bars[kind][own]
            out.append((ids[own[ok]], np.full(int(ok.sum()), kind, np.int32), far[ok], ids[other[ok]], np.zeros(int(ok.sum()), bool)))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def emit(place, ids, v, new, bar, reach):
            edges = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1, [len(place)]])
            out = []
            for a, b in zip(edges, edges[1:]):
                for i in range(a, b, limit):
                    j = min(i + limit, b)
                    if j - i > 1:
                        out += search(ids[i:j], v[i:j], new[i:j], (bar[i:j], reach[i:j]))
            # a task's own lists of a node are one, so a node that is met everywhere sends few
            none = (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, bool))
            (node, kind, far, other, old), first = _merged([*out, none], kept)
            return pa.record_batch([pa.array(node[first]), pa.array(kind[first]), *(_listed(first, pa.array(x)) for x in (far, other, old))], names=["node", "kind", "far", "other", "old"])

        for batch in batches:
            if not batch.num_rows:
                continue
            place, ids, bar, reach = (batch.column(i).to_numpy() for i in (0, 1, 4, 5))
            fresh = (place, ids, _unpacked(batch.column(2), size), batch.column(3).to_numpy(zero_copy_only=False), bar, reach)
            held = fresh if held is None else tuple(np.concatenate(x) for x in zip(held, fresh))
            cut = int(np.argmax(held[0] == held[0][-1]))
            if cut:
                yield emit(*(x[:cut] for x in held))
                held = tuple(x[cut:] for x in held)
        if held is not None:
            yield emit(*held)

    return run


def build(distinct: DataFrame, degree: int = DEGREE, joined: int = JOINED, reverse: int = REVERSE, rounds: int = ROUNDS, trees: int = TREES) -> DataFrame:
    """(node, near: array of node ids of both lists)."""
    norm = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    facts = distinct.agg(F.min(norm).alias("low"), F.max(norm).alias("high"), F.count("*").alias("n"), F.min(F.size("vec")).alias("least"), F.max(F.size("vec")).alias("size")).first()
    if facts["least"] != facts["size"]:
        raise ValueError(f"vectors of {facts['least']} and of {facts['size']} components")
    total, size = facts["n"], facts["size"] or 1
    kinds = (ANGLE,) if not total or facts["high"] <= facts["low"] * (1 + 1e-5) else (ANGLE, PRODUCT)
    coded = settled(_coded(distinct, size, trees))
    far_off = F.lit(float("inf"))
    bits = min(PLANES, max(0, (total // BLOCK).bit_length()))
    spots = coded.select("node", "code", F.posexplode("places").alias("tree", "place"))
    # members of a block come in the order of its further planes, which cut a block over the limit
    place = F.xxhash64("tree", F.col("place").bitwiseAND(F.lit((1 << bits) - 1)))
    spots = spots.select(place.alias("place"), "node", "code", F.lit(True).alias("new"), far_off.alias("bar"), far_off.alias("reach"), F.shiftright("place", bits).alias("further"), F.xxhash64("node").alias("h"))
    first = spots.repartition("place").sortWithinPartitions("place", "further", "h").drop("further", "h").mapInArrow(_local(FIRST, degree, BLOCK * 2, size, kinds), _LISTS)
    graph = settled(_best(first, degree))
    codes = coded.select("node", "code")
    for turn in range(rounds):
        # the nearest `joined` entries of a list take part; what has taken part is old from then on
        pairs = graph.select("node", "kind", F.posexplode("near").alias("at", "x")).select("node", "kind", "at", "x.*")
        part = pairs.where(F.col("at") < joined)
        back = part.where("new").select(F.col("other").alias("place"), F.col("node").alias("who"), F.xxhash64("node", F.lit(turn)).alias("h"))
        back = back.withColumn("n", F.row_number().over(Window.partitionBy("place").orderBy("h"))).where(F.col("n") <= reverse)
        around = part.select(F.col("node").alias("place"), F.col("other").alias("who"), "new").union(back.select("place", "who", F.lit(True).alias("new")))
        around = around.union(graph.where(F.col("kind") == ANGLE).select(F.col("node").alias("place"), F.col("node").alias("who"), F.lit(False).alias("new")))
        # at most 2 * degree + reverse + 1 members; a node that has nothing new is passed over
        around = around.groupBy("place").agg(F.collect_set(F.struct("who", "new")).alias("m")).where(F.exists("m", lambda x: x["new"]))
        around = around.select("place", F.explode("m").alias("m")).select("place", "m.who", "m.new")
        ends = graph.withColumn("end", F.when(F.size("near") >= degree, F.element_at("near", -1)["far"]).otherwise(far_off))
        bars = ends.groupBy("node").agg(*[F.coalesce(F.max(F.when(F.col("kind") == k, F.col("end"))), far_off).alias(n) for k, n in ((ANGLE, "bar"), (PRODUCT, "reach"))])
        known = codes.join(bars.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select("node", "code", F.coalesce("bar", far_off).alias("bar"), F.coalesce("reach", far_off).alias("reach"))
        met = around.join(known, F.col("who") == F.col("node")).select("place", "node", "code", "new", "bar", "reach")
        found = met.repartition("place").sortWithinPartitions("place", "node").mapInArrow(_local(degree, degree, 1 << 20, size, kinds), _LISTS)
        known = graph.select("node", "kind", F.col("near.far").alias("far"), F.col("near.other").alias("other"), F.transform("near", lambda x, i: (i < joined) | ~x["new"]).alias("old"))
        before, graph = graph, settled(_best(known.union(found), degree))
        dropped(before)
        fresh = F.size(F.filter(F.slice("near", 1, joined), lambda x: x["new"]))
        if (graph.agg(F.sum(fresh).alias("n")).first()["n"] or 0) <= DONE * joined * total * len(kinds):
            break
    near = graph.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list(F.transform("near", lambda x: x["other"])))).alias("near"))
    return near


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, added up in order, in double precision."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


def _score(rows: DataFrame) -> DataFrame:
    """(query, node, score) of rows (query, node, qvec, vec)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(_products(_matrix(batch.column(2)), _matrix(batch.column(3))))], names=["query", "node", "score"])

    return rows.mapInArrow(run, "query long, node long, score double")


def search(queries: DataFrame, distinct: DataFrame, graph: DataFrame, width: int = WIDTH, opened: int = OPENED, steps: int = STEPS) -> DataFrame:
    """(query, node, score): the pool of each query (query, qvec, start) after greedy search."""
    vec = distinct.withColumnRenamed("node", "_node")
    edges = graph.withColumnRenamed("node", "_from")

    def scored(pairs: DataFrame) -> DataFrame:
        met = pairs.join(vec, F.col("node") == F.col("_node")).select("query", "node", "vec")
        return _score(met.join(queries.select(F.col("query").alias("_q"), "qvec"), F.col("query") == F.col("_q")).select("query", "node", "qvec", "vec"))

    best = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    pool = settled(scored(queries.select("query", F.col("start").alias("node"))).withColumn("open", F.lit(True)))
    for _ in range(steps):
        turn = pool.withColumn("n", F.row_number().over(Window.partitionBy("query", "open").orderBy(F.desc("score"), "node")))
        now = F.col("open") & (F.col("n") <= opened)
        ahead = turn.where(now).join(edges, F.col("node") == F.col("_from")).select("query", F.explode("near").alias("node")).distinct()
        ahead = ahead.join(pool.select("query", "node"), ["query", "node"], "left_anti")
        grown = turn.select("query", "node", "score", (F.col("open") & ~now).alias("open")).union(scored(ahead).withColumn("open", F.lit(True)))
        before, pool = pool, settled(grown.withColumn("n", F.row_number().over(best)).where(F.col("n") <= width).drop("n"))
        dropped(before)
        left = pool.agg(F.count_if("open").alias("open"), F.count("*").alias("n")).first()
        if left["open"] <= DONE * left["n"]:
            break
    return pool.select("query", "node", "score")


def best_nodes(queries: DataFrame, distinct: DataFrame, k: int, sample: int) -> DataFrame:
    """(query, least): the score of the k-th best node (the query's own left out) of at most `sample` queries, against all nodes."""
    own = queries.orderBy(F.xxhash64("query"), "query").limit(sample).select("query", "start", "qvec").collect()  # a fixed number of rows
    if not own:
        return queries.select("query", F.lit(0.0).alias("least"), F.lit(0).alias("k")).limit(0)
    asked = np.array([r["qvec"] for r in own], float)
    starts = np.array([r["start"] for r in own], np.int64)
    names = np.array([r["query"] for r in own], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(names), k), -np.inf)
        for batch in batches:
            if batch.num_rows:
                found = asked @ _matrix(batch.column(1)).T
                found[starts[:, None] == batch.column(0).to_numpy()[None, :]] = -np.inf
                best = -np.sort(-np.concatenate([best, found], axis=1), axis=1)[:, :k]
        ok = np.isfinite(best)
        yield pa.record_batch([pa.array(np.repeat(names, ok.sum(axis=1))), pa.array(best[ok])], names=["query", "score"])

    met = distinct.select("node", "vec").mapInArrow(run, "query long, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
    return met.withColumn("n", rank).where(F.col("n") <= k).groupBy("query").agg(F.min("score").alias("least"), F.count("*").alias("k"))


def recall(pool: DataFrame, queries: DataFrame, least: DataFrame) -> float:
    """The share of the sampled queries' best nodes that their pools hold; 1 if nothing was sampled."""
    # scores are added up in another order here and there
    near = pool.join(queries.select(F.col("query").alias("_q"), "start"), F.col("query") == F.col("_q")).where(F.col("node") != F.col("start"))
    hits = near.join(least, "query").where(F.col("score") >= F.col("least") - F.abs("least") * 1e-12 - 1e-300).groupBy("query").agg(F.count("*").alias("n"))
    one = least.join(hits, "query", "left").agg(F.sum(F.least(F.coalesce("n", F.lit(0)), F.col("k"))).alias("found"), F.sum("k").alias("all")).first()
    return one["found"] / one["all"] if one["all"] else 1.0


def _lengths(v: np.ndarray) -> np.ndarray:
    most = np.abs(v).max(axis=1)  # so that no square leaves the range of a double
    return most * np.linalg.norm(v / most[:, None], axis=1)


def _reaching(k: int):
    """The nodes of a block that reach the bars of a block's queries: (query, node, score), at most the k + 1 best of a query."""

    def meet(queries: pa.Table, nodes: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        if queries.num_rows and nodes.num_rows:
            q, v, bar = _matrix(queries["qvec"]), _matrix(nodes["vec"]), queries["bar"].to_numpy()
            size, norm = _lengths(q), _lengths(v)
            order = np.argsort(norm)  # norms that are compared at once lie close together, so that floats tell them apart
            v, norm, name, asked = v[order], norm[order], nodes["node"].to_numpy()[order], queries["query"].to_numpy()
            unit, slack = (q / size[:, None]).astype(np.float32), (q.shape[1] + 16) * 2.0**-23
            for a in range(0, len(q), ASKED):
                own, other, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
                bars = bar[a : a + ASKED].copy()
                for b in range(len(v) - 1 - (len(v) - 1) % MET, -1, -MET):  # long vectors first
                    most = norm[b : b + MET].max()
                    rough = unit[a : a + ASKED] @ (v[b : b + MET] / most).astype(np.float32).T
                    # a float that is no less than the bar comes out over this, whatever was rounded away
                    least = np.fmax(bars / size[a : a + ASKED] / most - slack, -2.0).astype(np.float32)
                    i, j = np.nonzero(rough >= np.nextafter(least, np.float32(-np.inf))[:, None])
                    exact = np.concatenate([np.zeros(0), *[_products(q[a + i[x : x + (1 << 16)]], v[b + j[x : x + (1 << 16)]]) for x in range(0, len(i), 1 << 16)]])
                    ok = exact >= bars[i]
                    own, other, score = (np.concatenate(x) for x in ((own, i[ok]), (other, b + j[ok]), (score, exact[ok])))
                    best = np.lexsort((name[other], -score, own))
                    own, other, score = own[best], other[best], score[best]
                    place = np.arange(len(own)) - np.searchsorted(own, own)
                    full = own[place == k], score[place == k]
                    bars[full[0]] = np.maximum(bars[full[0]], full[1])
                    own, other, score = own[place <= k], other[place <= k], score[place <= k]
                found.append((asked[a + own], name[other], score))
        columns = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({n: pa.array(c) for n, c in zip(("query", "node", "score"), columns)})

    return meet


def completed(pool: DataFrame, queries: DataFrame, distinct: DataFrame, k: int) -> DataFrame:
    """The pool with every node that scores no less than its query's k-th best node there (the query's own left out).

    Both sides are dealt into blocks by a hash; a task holds two blocks and a part of their products. No row is made for a pair that stays under the bar.
    """
    others = pool.join(queries.select(F.col("query").alias("_q"), "start"), F.col("query") == F.col("_q")).where(F.col("node") != F.col("start"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "node"))
    bars = others.withColumn("n", rank).where(F.col("n") == k).select(F.col("query").alias("_q"), F.col("score").alias("_bar"))
    asked = queries.join(bars, F.col("query") == F.col("_q"), "left").select("query", "qvec", F.coalesce("_bar", F.lit(float("-inf"))).alias("bar"))
    facts = distinct.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("size")).first()
    a, b = (max(1, -(-n * (facts["size"] or 1) // NUMBERS)) for n in (queries.count(), facts["n"]))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = asked.withColumn("_a", F.pmod(F.xxhash64("query"), F.lit(a))).withColumn("_b", every(b))
    right = distinct.select("node", "vec", F.pmod(F.xxhash64("node"), F.lit(b)).alias("_b")).withColumn("_a", every(a))
    found = left.groupBy("_a", "_b").cogroup(right.groupBy("_a", "_b")).applyInArrow(_reaching(k), "query long, node long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    return settled(pool.union(found).distinct().withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 12).drop("n"))


def nearest(table: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", width: int = WIDTH, target: float = TARGET, **options) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row of `table` that `is_query` (on column id) picks, itself left out."""
    rows = settled(vectors(table, id_col, vec_col))
    distinct, members = nodes(rows, k + 1)
    graph = settled(build(distinct, **options))
    asked = rows.where(is_query).groupBy("id", "vec").count().select("id", "vec")
    queries = settled(asked.join(distinct.withColumnRenamed("vec", "_vec"), F.col("vec") == F.col("_vec")).select(F.col("id").alias("query"), F.col("vec").alias("qvec"), F.col("node").alias("start")))
    pool = search(queries, distinct, graph, max(width, k + 12))
    if recall(pool, queries, settled(best_nodes(queries, distinct, k, HELD))) < target:
        pool = completed(pool, queries, distinct, k)
    # nodes that the k + 1 members of better ones leave no place for go before members are put back; ties stay
    held = pool.join(members.withColumnRenamed("node", "_m"), F.col("node") == F.col("_m")).select("query", "score", "ids", F.size("ids").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("query").orderBy(F.desc("score"))) - F.sum("n").over(Window.partitionBy("query", "score"))
    found = held.withColumn("better", upto).where(F.col("better") <= k).select("query", "score", F.explode("ids").alias("id")).where("id <> query")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
