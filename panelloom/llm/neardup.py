"""Near-duplicate vectors by product quantisation.

Vectors are scaled to length one. A coarse k-means gives inverted lists; each vector is
held by the list of its nearest centroid as a code: per subspace, the nearest of CODEWORDS
means of the residuals, plus the residual's distance from its code. With r the distance of
the cosine threshold and the plane halfway between the centroids of two partners' lists,
the partners' distances from it, each towards its own centroid, add up to r at most, so one
of them is within r / 2: every vector asks in the lists whose plane it is within `probe` * r
of, which loses nothing at 0.5, whatever lists vectors are held by (a lower probe loses pairs
whose difference points at a centroid). Of two that ask in each other's lists the smaller
counts the pair. Lists lie in groups, as many as a group has lists: a vector's list is sought
in the nearest HOME_GROUPS of them, and a group is passed over if none of its lists can be
asked, its centroids being further than the vector's own and twice the distance from planes. In a list distances to the codes come from lookup tables
(asymmetric: who asks isn't coded); as code and vector differ by the stored error, no
partner is further from the asker's residual than r plus that error, so the lookup loses
nothing. What passes is compared exactly, in double precision.

Equal vectors, grouped by all their components, are one row with a number of copies; rows
find their class by a 64-bit hash, and by the vector where classes share one. Long lists are
cut into blocks and met block by block, each a group of bounded size; a block gives counts
and the links of a spanning forest, never all pairs. Lists grow with the square root of the
vectors. Their centroids are learned group by group from a sample of TRAIN_ROWS vectors at
most (as many as there are lists, where that is more): any centroids give whole results. Every vector is indexed and every vector asks.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components
link with nothing and are kept; vectors of different lengths don't link. Every row is a
vector of its own: rows with equal ids are counted each and n_links counts rows; equal
vectors link with each other. A row with a null id links as any other: a component's id is
its smallest id that is not null, or null if there is none, and rows with that id are kept.
An empty table gives an empty result; extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stash, arrow_limits, small, table
from .components import components

COSINE = 0.95
#: Lists: LISTS_ROOT * sqrt(vectors), MIN_LISTS at least; share of the threshold's radius within which lists are asked.
LISTS_ROOT, MIN_LISTS, PROBE = 0.5, 4, 0.5
#: Nearest groups of lists in which a vector's own list is sought.
HOME_GROUPS = 2
#: Training: rows a list and in all, rounds.
ROWS_A_LIST, TRAIN_ROWS, ROUNDS = 32, 100_000, 8
SUBSPACES, CODEWORDS, SEED = 8, 256, 1
#: More than single precision can lose of a squared distance of 16 at most.
ROUNDING = 1e-4
#: Vectors of a list that meet in one task.
BLOCK = 2048


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(ROUNDS):
        near = np.concatenate([(x[i : i + 4096] @ c.T - 0.5 * (c**2).sum(axis=1)).argmax(axis=1) for i in range(0, len(x), 4096)])
        order = np.argsort(near, kind="stable")
        at = np.searchsorted(near[order], np.arange(k + 1))
        sums = np.concatenate([np.zeros((1, x.shape[1])), np.cumsum(x[order], axis=0)])
        n = np.diff(at)
        c[n > 0] = (sums[at[1:]] - sums[at[:-1]])[n > 0] / n[n > 0, None]
    return c


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps the squares of very small and large components finite
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def train(x: np.ndarray, lists: int, seed: int = SEED) -> dict:
    """Centroids by group, the groups' middles and how far they reach, and codebooks, from sampled vectors."""
    rng = np.random.default_rng(seed)
    x = unit(x)
    lists = min(lists, len(x))
    group = _nearest(x, _kmeans(x, max(1, round(np.sqrt(lists))), rng))
    own = [x[group == g] for g in np.unique(group)]
    parts = [_kmeans(v, min(len(v), max(1, round(lists * len(v) / len(x)))), rng) for v in own]
    coarse, middles = np.concatenate(parts), np.stack([p.mean(axis=0) for p in parts])
    reach = np.array([np.sqrt(((p - c) ** 2).sum(axis=1).max()) for p, c in zip(parts, middles, strict=True)])
    m = {"coarse": coarse, "starts": np.cumsum([0] + [len(p) for p in parts]), "middles": middles, "reach": reach, "dim": x.shape[1], "width": -(-x.shape[1] // SUBSPACES)}
    rest = np.concatenate([x[i : i + 4096] - coarse[homes(m, x[i : i + 4096])] for i in range(0, len(x), 4096)])
    rest = np.pad(rest, ((0, 0), (0, SUBSPACES * m["width"] - x.shape[1])))
    return m | {"books": np.stack([_kmeans(rest[:, s * m["width"] : (s + 1) * m["width"]], min(CODEWORDS, len(x)), rng) for s in range(SUBSPACES)])}


def _squares(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Squared distances."""
    return np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ to.T + (to**2).sum(axis=1), 0)


def _nearest(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.concatenate([_squares(x[i : i + 4096], to).argmin(axis=1) for i in range(0, len(x), 4096)])


def homes(m: dict, x: np.ndarray) -> np.ndarray:
    """The nearest list of each vector in its nearest groups."""
    far, home, least = _squares(x, m["middles"]), np.zeros(len(x), np.int64), np.full(len(x), np.inf)
    near = np.argsort(far, axis=1, kind="stable")[:, :HOME_GROUPS]
    for g in range(len(m["middles"])):
        rows = np.flatnonzero((near == g).any(axis=1))
        d = _squares(x[rows], m["coarse"][m["starts"][g] : m["starts"][g + 1]])
        at = d.argmin(axis=1)
        d = d[np.arange(len(rows)), at]
        less = d < least[rows]
        home[rows[less]], least[rows[less]] = m["starts"][g] + at[less], d[less]
    return home


def encode(m: dict, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of residuals and their distances from them."""
    width, books = m["width"], m["books"]
    rest = np.pad(x - m["coarse"][home], ((0, 0), (0, SUBSPACES * width - x.shape[1])))
    codes, error = np.zeros((len(x), SUBSPACES), np.uint8), np.zeros(len(x))
    for s in range(SUBSPACES):
        d = _squares(rest[:, s * width : (s + 1) * width], books[s])
        codes[:, s] = near = d.argmin(axis=1)
        error += d[np.arange(len(x)), near]
    return codes, np.sqrt(error)


def _asks(m: dict, x: np.ndarray, home: np.ndarray | int, lists: np.ndarray, radius: float) -> np.ndarray:
    """Whether vectors, of the lists named, ask in the other lists named."""
    own, other = m["coarse"][home], m["coarse"][lists]
    apart = np.sqrt(np.maximum(((other - own) ** 2).sum(axis=1), 1e-18))
    return (((x - other) ** 2).sum(axis=1) - ((x - own) ** 2).sum(axis=1)) / (2 * apart) <= radius + 1e-9


def probes(m: dict, x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home list of every vector and (row, list) of the others it asks in."""
    home, rows, lists = homes(m, x), [], []
    own = m["coarse"][home]
    to_own = ((x - own) ** 2).sum(axis=1)
    far = np.sqrt(_squares(x, m["middles"])) - m["reach"]
    for g in range(len(m["middles"])):
        some = np.flatnonzero(far[:, g] <= np.sqrt(to_own) + 2 * radius + 1e-6)
        others = m["coarse"][m["starts"][g] : m["starts"][g + 1]]
        apart = np.sqrt(np.maximum(_squares(own[some], others), 1e-18))
        plane = (_squares(x[some], others) - to_own[some, None]) / (2 * apart)
        row, to = np.nonzero((plane <= radius + 1e-6) & (m["starts"][g] + np.arange(len(others)) != home[some, None]))
        sure, row, to = plane[row, to] <= radius - 1e-6, some[row], m["starts"][g] + to
        sure[~sure] = _asks(m, x[row[~sure]], home[row[~sure]], to[~sure], radius)
        rows.append(row[sure])
        lists.append(to[sure])
    return home, np.concatenate(rows), np.concatenate(lists)


def _candidates(m: dict, of: int, queries: np.ndarray, codes: np.ndarray, error: np.ndarray, radius: float) -> np.ndarray:
    """Mask (held, queries): within the radius by table lookup, given the codes' errors. Tables hold a row a codeword, so that lookups copy rows."""
    width, books = m["width"], m["books"].astype(np.float32)
    rest = np.pad((queries - m["coarse"][of]).astype(np.float32), ((0, 0), (0, SUBSPACES * width - queries.shape[1])))
    mask, limit = np.empty((len(codes), len(queries)), bool), ((radius + error + 1e-6) ** 2 + ROUNDING).astype(np.float32)
    tables = [_squares(books[s], rest[:, s * width : (s + 1) * width]) for s in range(SUBSPACES)]
    step = max(1, (1 << 14) // max(1, len(queries)))  # sums stay in the processor's cache
    for lo in range(0, len(codes), step):
        at = codes[lo : lo + step]
        total = tables[0][at[:, 0]]
        for s in range(1, SUBSPACES):
            total += tables[s][at[:, s]]
        np.less_equal(total, limit[lo : lo + step, None], out=mask[lo : lo + step])
    return mask


def _pairs(mask: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and columns that are set, some at a time."""
    row, column = np.nonzero(mask)
    for i in range(0, len(row), 1 << 16):
        yield row[i : i + (1 << 16)], column[i : i + (1 << 16)]


def cell(m: dict, of: int, held: dict, query: dict, cosine: float, asked: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of one block of holders and one of askers: ids, linked copies, smallest id of the local component."""
    radius = np.sqrt(2 - 2 * cosine)
    link = np.zeros((len(held["id"]), len(query["id"])), bool)
    step = 256  # lookup tables stay in the processor's cache
    for lo in range(0, link.shape[1], step):
        q = slice(lo, lo + step)
        maybe = _candidates(m, of, query["x"][q], held["codes"], held["error"], radius)
        if np.count_nonzero(maybe) > 0.05 * maybe.size:  # a product tells all but cosines at the threshold
            near = held["x"] @ query["x"][q].T
            link[:, q] = maybe & (near >= cosine)
            maybe &= np.abs(near - cosine) < 1e-9
        for h, a in _pairs(maybe):
            link[h, lo + a] = (held["x"][h] * query["x"][lo + a]).sum(axis=1) >= cosine
    for h, a in _pairs(link):
        home, smaller = query["home"][a], query["id"][a] < held["id"][h]
        # Of two vectors at home here the smaller id asks, and so it does if the pair meets in both lists.
        counts = np.where(home == of, smaller, True)
        both = np.flatnonzero((home != of) & ~smaller)
        counts[both] = ~_asks(m, held["x"][h[both]], of, home[both], asked)
        link[h, a] = counts
    a, b = np.flatnonzero(link.any(axis=0)), np.flatnonzero(link.any(axis=1))
    link = link[np.ix_(b, a)].T
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    ids = np.concatenate([query["id"][a], held["id"][b]])
    counts = np.concatenate([link @ held["copies"][b], link.T @ query["copies"][a]])
    root_a, root_b, most = query["id"][a], held["id"][b], np.iinfo(np.int64).max
    while True:
        new_a = np.minimum(root_a, np.where(link, root_b[None], most).min(axis=1))
        new_b = np.minimum(root_b, np.where(link, new_a[:, None], most).min(axis=0))
        if (new_a == root_a).all() and (new_b == root_b).all():
            return ids, counts, np.concatenate([root_a, root_b])
        root_a, root_b = new_a, new_b


def _matrix(column: pa.ChunkedArray, kind: type, dim: int) -> np.ndarray:
    return unit(np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim)) if len(column) else np.zeros((0, dim))


def links(vectors: DataFrame, m: dict, stash: Stash, cosine: float = COSINE, probe: float = PROBE) -> DataFrame:
    """(id, copies, vector) of one length -> (id, links, root): one row for each vector and block in which it links."""
    held, dim, radius = vectors.sparkSession.sparkContext.broadcast(m), m["dim"], probe * float(np.sqrt(2 - 2 * cosine))
    kind = np.float32 if dict(vectors.dtypes)["vector"] == "array<float>" else np.float64

    def place(parts):
        p = held.value
        for whole in parts:
            for lo in range(0, whole.num_rows, 2048):
                part = whole.slice(lo, 2048)
                raw = part.column("vector").flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)
                x = unit(raw)
                home, row, to = probes(p, x, radius)
                codes, error = encode(p, x, home)
                body = [v.tobytes() for v in raw]
                ids, copies = part.column("id").to_numpy(zero_copy_only=False), part.column("copies").to_numpy(zero_copy_only=False)
                n = len(x)
                at = np.concatenate([np.arange(n), row])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([home, to])), pa.array(home[at]), pa.array(ids[at]), pa.array(copies[at]), pa.array([body[i] for i in at], pa.binary()), pa.array([codes[i].tobytes() for i in at], pa.binary()), pa.array(error[at])],
                    ["list", "home", "id", "copies", "x", "codes", "error"],
                )

    placed = vectors.select("id", "copies", "vector").mapInArrow(place, "list long, home long, id long, copies long, x binary, codes binary, error double")
    placed = stash.put(placed)
    size = placed.groupBy("list").agg(F.ceil(F.count_if(F.col("home") == F.col("list")) / BLOCK).alias("holders"), F.ceil(F.count("*") / BLOCK).alias("askers"))
    placed = placed.join(small(size), "list").filter("holders > 0")
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    rows = ["id", "copies", "home", "x", "codes", "error"]
    holders = placed.filter("home = list").select("list", block("holders").alias("i"), every("askers").alias("j"), F.lit(True).alias("holds"), *rows)
    askers = placed.select("list", every("holders").alias("i"), block("askers").alias("j"), F.lit(False).alias("holds"), *rows)

    def meet(key, group):
        def side(t):
            return {
                "id": t.column("id").to_numpy(), "copies": t.column("copies").to_numpy(), "home": t.column("home").to_numpy(), "x": _matrix(t.column("x"), kind, dim),
                "codes": np.frombuffer(b"".join(t.column("codes").to_pylist()), np.uint8).reshape(-1, SUBSPACES), "error": t.column("error").to_numpy(),
            }

        holds = group.column("holds")
        ids, counts, roots = cell(held.value, key[0].as_py(), side(group.filter(holds)), side(group.filter(pa.compute.invert(holds))), cosine, radius)
        return pa.table({"id": ids, "links": counts, "root": roots})

    return holders.unionAll(askers).groupBy("list", "i", "j").applyInArrow(meet, "id long, links long, root long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, probe: float = PROBE) -> DataFrame:
    """(vec_id, embedding) -> (vec_id, n_links, component_id, kept), one row a row."""
    spark = vectors.sparkSession
    arrow_limits(spark)
    stash = Stash(spark, "vectors")
    fine = F.expr("embedding is not null and forall(embedding, v -> v is not null and not isnan(v) and abs(v) < double('infinity')) and exists(embedding, v -> v <> 0)")
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    vectors = vectors.withColumn("hash", F.when(F.coalesce(fine, F.lit(False)), F.xxhash64(F.size("embedding"), "embedding")))
    classes = vectors.filter("hash is not null").groupBy(F.col("embedding").alias("vector")).agg(F.first("hash").alias("hash"), F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = stash.put(classes.withColumns({"id": F.monotonically_increasing_id(), "dim": F.size("vector")}))  # written once, so ids stay
    found = None
    for r in classes.groupBy("dim").agg(F.count("*").alias("n")).orderBy("dim").collect():  # a row a length
        own = classes.filter(F.col("dim") == r["dim"]).select("id", "copies", "vector")
        lists = max(MIN_LISTS, int(LISTS_ROOT * np.sqrt(r["n"])))
        rows = max(CODEWORDS * 4, lists, min(lists * ROWS_A_LIST, TRAIN_ROWS))
        sample = classes.filter(F.col("dim") == r["dim"]).orderBy("hash", "vector").limit(rows).select("vector").toArrow().column("vector").combine_chunks()
        m = train(sample.flatten().to_numpy(zero_copy_only=False).reshape(-1, r["dim"]), lists)
        new = links(own, m, stash, cosine, probe)
        found = new if found is None else found.unionAll(new)
    alone = vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if found is not None:
        found = stash.put(found)
        labels = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), stash)
        per = found.groupBy("id").agg(F.sum("links").alias("links")).join(labels.withColumnRenamed("node", "id"), "id", "left")
        shared = small(stash.put(classes.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash", F.lit(True).alias("shared"))))
        named = classes.select("id", "hash", "vector", "rep", "copies").join(small(stash.put(per)), "id", "left").filter("links is not null or copies > 1")
        named = named.join(shared, "hash", "left").withColumns({"component": F.coalesce("component", "id"), "only": F.when(F.col("shared"), F.col("vector"))})
        named = stash.put(named.select("hash", "only", "component", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
        least = small(stash.put(named.groupBy("component").agg(F.min("rep").alias("component_id"))))
        named = small(stash.put(named.join(least, "component").select(F.col("hash").alias("_hash"), "only", "n_links", F.struct("component_id").alias("of"))))
        rows = vectors.join(named, (F.col("hash") == F.col("_hash")) & (F.col("only").isNull() | (F.col("only") == F.col("embedding"))), "left")
        alone = rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("of").isNull(), F.col("vec_id")).otherwise(F.col("of.component_id")).alias("component_id"))
    return alone.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


SQL = """
WITH RECURSIVE r AS (
  SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings
), v AS (
  SELECT rid, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM r
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), u AS (
  SELECT rid, e, sqrt(list_dot_product(e, e)) AS n FROM v
), l AS (
  SELECT x.rid AS a, y.rid AS b FROM u x JOIN u y ON x.rid <> y.rid AND len(x.e) = len(y.e) WHERE list_dot_product(x.e, y.e) / (x.n * y.n) >= 0.95
), reach AS (
  SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a
), c AS (
  SELECT reach.a, min(r.vec_id) AS m FROM reach JOIN r ON reach.b = r.rid GROUP BY reach.a
), k AS (
  SELECT a, count(*) AS n FROM l GROUP BY a
), o AS (
  SELECT vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, CASE WHEN k.a IS NULL THEN vec_id ELSE least(vec_id, c.m) END AS component_id
  FROM r LEFT JOIN k ON rid = k.a LEFT JOIN c ON rid = c.a
)
SELECT vec_id, n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM o
"""
