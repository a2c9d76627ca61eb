"""Vector operators: order-embedding containment, pooling, scaling, clustering, transport cost."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import numbered
from ..sources.tables import table, written
from . import tiles

TAU, MARGIN, BLOCK, SPAN = 0.5, 0.1, 1024, 4096


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))


def against(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """Every query (prefix q_) beside every row (prefix t_), in blocks: an equality join on block and part, so no side is broadcast whole."""
    blocks = max(1, -(-queries.count() // BLOCK))
    parts = rows.sparkSession.sparkContext.defaultParallelism
    spread = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select(spread("vec_id", blocks).alias("block"), every(parts).alias("part"), *[F.col(c).alias(f"q_{c}") for c in queries.columns])
    t = rows.select(every(blocks).alias("block"), spread("vec_id", parts).alias("part"), *[F.col(c).alias(f"t_{c}") for c in rows.columns])
    return q.join(t, ["block", "part"]).drop("block", "part")


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def distance2(a: str, b: str) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def _asked(v: DataFrame) -> DataFrame:
    return v.where(F.col("vec_id") % 100 == 0)


def _pairs(spark, sf_dir, pairs: tiles.Pairs, schema: str) -> DataFrame:
    """Every query vector against all rows, in tiles."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    return tiles.over_pairs(_asked(v), v, pairs, schema)


def _schema(**columns: pa.DataType) -> pa.Schema:
    return pa.schema(list(columns.items()))


def dominance_frequency(spark, sf_dir):
    add = lambda q, t, s, x, ok, other, kept: [kept[0] + ((x <= TAU) & ok).sum(axis=1)]
    sums = tiles.PerQuery(_schema(vec_id=pa.int64(), n=pa.int64()), tiles.violations, (0,), add)
    return _pairs(spark, sf_dir, sums, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("freq"))


def dominance_conjunctive(spark, sf_dir):
    each = tiles.PerLabel(_schema(label=pa.int32(), t_vec_id=pa.int64(), ok=pa.bool_()), tiles.violations, 2 * TAU)
    both = _pairs(spark, sf_dir, each, "label int, t_vec_id long, ok boolean").groupBy("label", "t_vec_id").agg(F.bool_and("ok").alias("ok"))
    return both.groupBy("label").agg(F.count_if("ok").alias("freq"))


def dimension_violation_count(spark, sf_dir):
    most = np.int64(np.iinfo(np.int64).max)  # stands for none

    def add(q, t, s, n, ok, other, kept):
        return [np.minimum(kept[0], np.where(ok, n, most).min(axis=1, initial=most)), kept[1] + (n * ok).sum(axis=1, dtype=np.int64), kept[2] + ((n < 6) & ok).sum(axis=1), kept[3] + ok.sum(axis=1)]

    sums = tiles.PerQuery(_schema(vec_id=pa.int64(), least=pa.int64(), total=pa.int64(), positive=pa.int64(), n=pa.int64()), tiles.greater, (most, 0, 0, 0), add)
    got = _pairs(spark, sf_dir, sums, "vec_id long, least long, total long, positive long, n long")
    some = lambda c: F.when(F.col("n") > 0, F.col(c))
    return got.groupBy("vec_id").agg(F.min(some("least")).cast("int").alias("least"), F.sum(some("total")).alias("total"), F.sum("positive").alias("positive"))


def order_loss(spark, sf_dir):
    def add(q, t, s, x, ok, other, kept):
        same = (q.label[s, None] == t.label[None]) & (q.label[s, None] != tiles.NULL)
        return [kept[0] + np.where(ok, np.where(same, x, np.maximum(0.0, MARGIN - x)), 0.0).sum(axis=1), kept[1] + (ok | other & ~same).sum(axis=1)]

    sums = tiles.PerQuery(_schema(vec_id=pa.int64(), loss=pa.float64(), n=pa.int64()), tiles.violations, (0.0, 0), add)
    got = _pairs(spark, sf_dir, sums, "vec_id long, loss double, n long")
    return got.groupBy("vec_id").agg(F.round(F.sum(F.when(F.col("n") > 0, F.col("loss"))), 6).alias("loss"))


def _matrix(spark, sf_dir, values, shown, name: str) -> DataFrame:
    schema = pa.schema([("q_vec_id", pa.int64()), ("t_vec_id", pa.int64()), (name, pa.float64())])
    return _pairs(spark, sf_dir, tiles.Matrix(schema, values, shown), f"q_vec_id long, t_vec_id long, {name} double")


def alignment_matrix(spark, sf_dir):
    """Every query vector against all rows: the output grows with the square of the table."""
    return _matrix(spark, sf_dir, tiles.violations, tiles.log_rounded, "value")


def pairwise_cost_matrix(spark, sf_dir):
    """Every query vector against all rows: the output grows with the square of the table."""
    return _matrix(spark, sf_dir, tiles.distances, tiles.rounded, "cost")


def components_of(v: DataFrame) -> DataFrame:
    return v.select("vec_id", "label", F.posexplode("e").alias("dim", "x"))


def mean_pool_by_label(spark, sf_dir):
    return components_of(vectors(spark, sf_dir)).groupBy("label", "dim").agg(F.round(F.avg("x"), 6).alias("mean"))


def standard_scale(spark, sf_dir):
    x = components_of(vectors(spark, sf_dir))
    stats = x.groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    return x.join(F.broadcast(stats), "dim").select("vec_id", "dim", F.round((F.col("x") - F.col("mean")) / F.col("std"), 6).alias("z"))


def centroids(v: DataFrame, by: str) -> DataFrame:
    """One vector a group: the means, in order of dimension. As many rows as groups."""
    x = v.select(by, F.posexplode("e").alias("dim", "x")).groupBy(by, "dim").agg(F.avg("x").alias("x"))
    return x.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("c"))


def closest_to_centroid(spark, sf_dir):
    v = vectors(spark, sf_dir)
    d = v.join(centroids(v, "label"), "label").select("label", "vec_id", F.round(distance2("e", "c"), 6).alias("d"))
    return d.groupBy("label").agg(F.min(F.struct("d", "vec_id")).alias("m")).select("label", F.col("m.vec_id").alias("vec_id"), F.col("m.d").alias("distance"))


def lloyd(v: DataFrame, k: int, rounds: int) -> DataFrame:
    """Lloyd's iterations from the first k ids; k centroids, so the side that is broadcast has k rows."""
    c = v.where(F.col("vec_id") < k).select(F.col("vec_id").alias("cluster"), F.col("e").alias("c"))
    for step in range(rounds + 1):
        near = v.join(F.broadcast(c), F.lit(True)).select("vec_id", "e", "cluster", F.round(distance2("e", "c"), 9).alias("d"))
        got = near.groupBy("vec_id").agg(F.min(F.struct("d", "cluster")).alias("m"))
        placed = v.join(got, "vec_id").select("vec_id", "e", F.col("m.cluster").alias("cluster"), F.col("m.d").alias("d"))
        if step < rounds:
            c = centroids(placed, "cluster")
    return placed


def lloyd_kmeans(spark, sf_dir):
    return lloyd(vectors(spark, sf_dir), 4, 2).select("vec_id", "cluster")


def cluster_representatives(spark, sf_dir):
    placed = lloyd(vectors(spark, sf_dir), 4, 2)
    return placed.groupBy("cluster").agg(F.min(F.struct("d", "vec_id")).alias("m"), F.count("*").alias("n")).select("cluster", F.col("m.vec_id").alias("vec_id"), "n")


def transport(cost: np.ndarray) -> float:
    """Least cost of moving uniform weights on rows to uniform weights on columns, by shortest paths over whole units.

    Each round finds the shortest paths from all rows with supply to every column, and then uses as many of them as still have room: after the round's potentials all are tight.
    """
    n, m = cost.shape
    g = int(np.gcd(n, m))
    supply, demand = np.full(n, m // g), np.full(m, n // g)
    u, v = np.zeros(n), cost.min(axis=0).astype(float)
    into: list[dict[int, int]] = [{} for _ in range(m)]  # what each column has of each row
    while supply.any():
        sources = np.flatnonzero(supply)
        dist_r, dist_c, via_c = np.full(n, np.inf), np.full(m, np.inf), np.full(m, -1)
        dist_r[sources] = 0.0
        for lo in range(0, len(sources), 256):
            some = sources[lo : lo + 256]
            reduced = cost[some] + u[some, None] - v
            best = reduced.argmin(axis=0)
            new = np.maximum(reduced[best, np.arange(m)], 0)
            better = new < dist_c
            dist_c[better], via_c[better] = new[better], some[best[better]]
        via_r, left = np.full(n, -1), dist_c.copy()
        order, wanted = [], int(np.count_nonzero(demand))
        while wanted:
            j = int(left.argmin())
            d = left[j]
            left[j] = np.inf
            order.append(j)
            wanted -= bool(demand[j])
            for i in into[j]:
                if dist_r[i] == np.inf:  # arcs in use are tight
                    dist_r[i], via_r[i] = d, j
                    new = d + np.maximum(cost[i] + u[i] - v, 0)
                    better = (new < dist_c) & (left < np.inf)
                    left[better] = dist_c[better] = new[better]
                    via_c[better] = i
        end = d
        u += np.minimum(dist_r, end)
        v += np.minimum(dist_c, end)
        for j in order:
            while demand[j]:
                path, c = [], j
                while True:
                    r = int(via_c[c])
                    path.append((r, c))
                    if via_r[r] < 0:
                        break
                    c = int(via_r[r])
                amount = min([int(supply[r]), int(demand[j]), *(into[int(via_r[x])].get(x, 0) for x, _ in path[:-1])])
                if not amount:
                    break
                for x, y in path:
                    into[y][x] = into[y].get(x, 0) + amount
                for x, _ in path[:-1]:
                    at = into[int(via_r[x])]
                    at[x] -= amount
                    if not at[x]:
                        del at[x]
                supply[r] -= amount
                demand[j] -= amount
    return float(sum(k * cost[i, j] for j, of in enumerate(into) for i, k in of.items()) / (n * (m // g)))


def emd_uniform(spark, sf_dir):
    """Exact earth mover's distance of each label's vectors to those of all labels. An exact plan needs a pair's vectors at once: each pair of labels is one task, which grows with the table."""
    groups = vectors(spark, sf_dir).groupBy("label").agg(F.collect_list("e").alias("mine"))
    labels = groups.select(F.col("label").alias("other"), F.col("mine").alias("theirs"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for label, other, x, y in b.itertuples(index=False):
                x, y = np.stack(list(x)), np.stack(list(y))
                cost = np.stack([((r - y) ** 2).sum(axis=1) for r in x])
                out.append((label, other, round(transport(cost), 6)))
            yield pd.DataFrame(out, columns=["label", "other", "emd"])

    pairs = groups.join(labels, F.col("label") <= F.col("other")).select("label", "other", "mine", "theirs")
    return pairs.repartition(4 * spark.sparkContext.defaultParallelism, "label", "other").mapInPandas(run, "label int, other int, emd double")


def emd_one_dimension(spark, sf_dir):
    """W1 of each label's first components to those of all rows: the area between their distribution functions."""
    x = vectors(spark, sf_dir).select("label", F.col("e")[0].alias("x"))
    n = x.groupBy("label").agg(F.count("*").alias("n"))
    whole = x.agg(F.count("*").alias("total"))
    marks = written(spark, numbered(x.select("x").distinct(), "x", name="k"))
    step = marks.join(marks.select((F.col("k") - 1).alias("k"), F.col("x").alias("next")), "k").select("x", "k", "next", F.floor(F.col("k") / SPAN).alias("span"))
    placed = x.join(marks, "x").groupBy("label", "k").agg(F.count("*").alias("here"))
    # Counts up to each mark: within ranges of SPAN marks, and what the ranges before hold, as many rows as ranges.
    ranges = placed.groupBy("label", F.floor(F.col("k") / SPAN).alias("span")).agg(F.sum("here").alias("held"))
    grid = step.select("span").distinct().join(F.broadcast(n.select("label")), F.lit(True)).join(ranges, ["label", "span"], "left")
    before = F.sum("held").over(Window.partitionBy("label").orderBy("span").rowsBetween(Window.unboundedPreceding, -1))
    grid = grid.select("label", "span", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.sum(F.coalesce("here", F.lit(0))).over(Window.partitionBy("label", "span").orderBy("k"))
    mine = step.join(grid, "span").join(placed, ["label", "k"], "left").select("label", "k", "x", "next", (F.col("before") + inside).alias("f"))
    both = mine.join(mine.groupBy("k").agg(F.sum("f").alias("g")), "k").join(F.broadcast(n), "label").join(F.broadcast(whole), F.lit(True))
    return both.groupBy("label").agg(F.round(F.sum(F.abs(F.col("f") / F.col("n") - F.col("g") / F.col("total")) * (F.col("next") - F.col("x"))), 6).alias("emd"))


_V = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 100 = 0)"
_VIOL = "list_sum(list_transform(list_zip(q.e, t.e), lambda z: greatest(0.0, z[1] - z[2]) * greatest(0.0, z[1] - z[2])))"
_DIST = "list_sum(list_transform(list_zip({0}, {1}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_X = "x AS (SELECT vec_id, label, unnest(range(64)) AS dim, unnest(e) AS x FROM v)"


def _lloyd_sql() -> str:
    parts, c = [f"WITH {_V}", "c0 AS (SELECT vec_id AS cluster, e AS c FROM v WHERE vec_id < 4)"], "c0"
    for k in range(3):
        parts.append(f"p{k} AS (SELECT vec_id, any_value(e) AS e, min(struct_pack(d := d, cluster := cluster)) AS m FROM (SELECT v.vec_id, v.e, {c}.cluster, round({_DIST.format('v.e', c + '.c')}, 9) AS d FROM v, {c}) GROUP BY vec_id)")
        parts.append(f"c{k + 1} AS (SELECT cluster, list(x ORDER BY dim) AS c FROM (SELECT cluster, dim, avg(x) AS x FROM (SELECT m.cluster AS cluster, unnest(range(64)) AS dim, unnest(e) AS x FROM p{k}) GROUP BY ALL) GROUP BY cluster)")
        c = f"c{k + 1}"
    return ", ".join(parts)


SQL = {
    "dominance_frequency": f"WITH {_V} SELECT q.vec_id, count(*) FILTER ({_VIOL} <= 0.5) AS freq FROM q, v AS t WHERE q.vec_id <> t.vec_id GROUP BY 1",
    "dominance_conjunctive": f"WITH {_V}, b AS (SELECT q.label, t.vec_id, bool_and({_VIOL} <= 1.0) AS ok FROM q, v AS t GROUP BY ALL) SELECT label, count(*) FILTER (ok) AS freq FROM b GROUP BY 1",
    "dimension_violation_count": f"WITH {_V}, n AS (SELECT q.vec_id, len(list_filter(list_zip(q.e, t.e), lambda z: z[1] > z[2])) AS n FROM q, v AS t WHERE q.vec_id <> t.vec_id) SELECT vec_id, CAST(min(n) AS INTEGER) AS least, CAST(sum(n) AS BIGINT) AS total, count(*) FILTER (n < 6) AS positive FROM n GROUP BY 1",
    "order_loss": f"WITH {_V} SELECT q.vec_id, round(sum(CASE WHEN q.label = t.label THEN {_VIOL} ELSE greatest(0.0, 0.1 - {_VIOL}) END), 6) AS loss FROM q, v AS t WHERE q.vec_id <> t.vec_id GROUP BY 1",
    "alignment_matrix": f"WITH {_V} SELECT q.vec_id AS q_vec_id, t.vec_id AS t_vec_id, round(ln({_VIOL} + 1e-7), 6) AS value FROM q, v AS t",
    "pairwise_cost_matrix": f"WITH {_V} SELECT q.vec_id AS q_vec_id, t.vec_id AS t_vec_id, round({_DIST.format('q.e', 't.e')}, 6) AS cost FROM q, v AS t",
    "mean_pool_by_label": f"WITH {_V}, {_X} SELECT label, CAST(dim AS INTEGER) AS dim, round(avg(x), 6) AS mean FROM x GROUP BY ALL",
    "standard_scale": f"WITH {_V}, {_X}, s AS (SELECT dim, avg(x) AS m, stddev_pop(x) AS d FROM x GROUP BY 1) SELECT vec_id, CAST(dim AS INTEGER) AS dim, round((x - m) / d, 6) AS z FROM x JOIN s USING (dim)",
    "closest_to_centroid": f"WITH {_V}, {_X}, c AS (SELECT label, list(x ORDER BY dim) AS c FROM (SELECT label, dim, avg(x) AS x FROM x GROUP BY ALL) GROUP BY 1), d AS (SELECT v.label, vec_id, round({_DIST.format('e', 'c')}, 6) AS d FROM v JOIN c USING (label)) SELECT label, vec_id, d AS distance FROM d QUALIFY row_number() OVER (PARTITION BY label ORDER BY d, vec_id) = 1",
    "lloyd_kmeans": _lloyd_sql() + " SELECT vec_id, m.cluster AS cluster FROM p2",
    "cluster_representatives": _lloyd_sql() + " SELECT m.cluster AS cluster, arg_min(vec_id, struct_pack(d := m.d, i := vec_id)) AS vec_id, count(*) AS n FROM p2 GROUP BY 1",
    "emd_one_dimension": """WITH x AS (SELECT label, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings), marks AS (SELECT x, lead(x) OVER (ORDER BY x) AS next FROM (SELECT DISTINCT x FROM x)),
g AS (SELECT l.label, m.x, m.next, (SELECT count(*) FROM x WHERE x.label = l.label AND x.x <= m.x) / (SELECT count(*) FROM x WHERE x.label = l.label)::DOUBLE AS f, (SELECT count(*) FROM x WHERE x.x <= m.x) / (SELECT count(*) FROM x)::DOUBLE AS g FROM marks AS m, (SELECT DISTINCT label FROM x) AS l)
SELECT label, round(sum(abs(f - g) * (next - x)), 6) AS emd FROM g GROUP BY 1""",
}
QUERIES = {f.__name__: f for f in (dominance_frequency, dominance_conjunctive, dimension_violation_count, order_loss, alignment_matrix, pairwise_cost_matrix, mean_pool_by_label, standard_scale, closest_to_centroid, lloyd_kmeans, cluster_representatives, emd_uniform, emd_one_dimension)}
