"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one representative per group.

Cells are fitted on a bounded sample; every vector is assigned, and a length too rare for the sample is one cell. A vector is compared with the members of its own cell
and of every other cell that could hold a vector within the threshold: if `y` lies in cell `c'` and `|x - y| <= r` for
unit vectors, then `x.c - x.c' <= r * |c - c'|`, for whichever cell `c` holds `x`. That bound loses no link, whatever
the sample was; but in many dimensions hardly any difference points straight at another centroid, and by default the
bound is narrowed to four standard deviations of one in a random direction (recall is measured in the tests).

Equal vectors are folded into one with a weight before anything is compared. Cells are cut into blocks of members and
of queries, so a task's two matrices are bounded however full a cell is. Tasks report sums of links and one edge per
vector to the smallest vector of its local component, never pairs.

Null, zero or empty vectors, and those with null or non-finite components, link with nothing, and neither do vectors
of different lengths. Repeated rows are vectors of their own. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import extended, stored
from folioscope.llm.graph import components

MEMBERS, QUERIES, STRIP, PAIRS = 4096, 16384, 1024, 100_000


def kmeans(units: np.ndarray, cells: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Unit centroids by Lloyd's rounds with cosine; a cell that empties restarts at the worst served vector."""
    chosen = np.random.default_rng(seed).choice(len(units), size=min(cells, len(units)), replace=False)
    centroids = units[np.sort(chosen)]
    for _ in range(rounds):
        likeness = units @ centroids.T
        home = likeness.argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, units)
        norms = np.linalg.norm(sums, axis=1)
        worst = np.argsort(likeness.max(axis=1), kind="stable")
        for rank, cell in enumerate(np.flatnonzero(norms == 0)):
            sums[cell] = units[worst[rank]]
            norms[cell] = 1.0
        centroids = sums / norms[:, None]
    return centroids


def unit_rows(lists: pa.ListArray) -> np.ndarray:
    """Unit vectors, in double precision, of lists of one length without nulls."""
    rows = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _one(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _fit(rows: DataFrame, total: int, sample: int, per_cell: int) -> dict[int, np.ndarray]:
    """Centroids per vector length, from at most `sample` vectors of the smallest hashes."""
    chosen = rows.orderBy("_h", "_g").limit(sample).select("_v").toArrow().column("_v")
    chosen, sizes = _one(chosen), _one(chosen.combine_chunks()).value_lengths().to_numpy()
    cells = max(1, min(round(total / per_cell), sample // 16))
    fitted = {}
    for size in np.unique(sizes).tolist():
        own = unit_rows(chosen.take(pa.array(np.flatnonzero(sizes == size))))
        fitted[size] = kmeans(own, max(1, cells * len(own) // len(chosen)))
    return fitted


def near_duplicates(
    vectors: DataFrame,
    id_column: str,
    column: str,
    threshold: float = 0.95,
    sample: int = 20_000,
    per_cell: int = 1000,
    deviations: float | None = 4.0,
) -> DataFrame:
    """Per row: its id, n_links, component_id (smallest id reachable) and kept. A row without an id links with nothing
    and is kept.

    `deviations` narrows the cells looked at to those that a difference of the threshold's length in a random
    direction reaches within so many standard deviations; None looks at every cell that could hold a link.
    """
    rows = vectors.select(F.col(id_column).alias("_id"), F.col(column).alias("_v"))
    bad = F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    good = F.coalesce((F.size("_v") > 0) & ~bad & F.exists("_v", lambda x: x != 0), F.lit(False)) & F.col("_id").isNotNull()
    own = [F.xxhash64("_v").alias("_h"), F.xxhash64(F.lit(11), "_v").alias("_g")]
    valid = rows.where(good)
    folded = stored(valid.groupBy(*own).agg(F.min_by("_v", "_id").alias("_v"), F.min("_id").alias("_id"), F.count(F.lit(1)).alias("_n")))
    total = folded.count()
    centroids = _fit(folded, total, sample, per_cell) if total else {}
    reach = {}
    for size, c in centroids.items():
        share = 1.0 if deviations is None else min(1.0, deviations / np.sqrt(size))
        reach[size] = share * np.sqrt(2 - 2 * threshold) * np.linalg.norm(c[:, None] - c[None], axis=2) + 1e-9

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_v")
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            at, sizes, cells, members = [], [], [], []
            for size in np.unique(lengths).tolist():
                mine = np.flatnonzero(lengths == size)
                if size in centroids:
                    likeness = unit_rows(lists.take(pa.array(mine))) @ centroids[size].T
                    home = likeness.argmax(axis=1)
                    best = likeness[np.arange(len(mine)), home]
                    query, probed = np.nonzero(best[:, None] - likeness <= reach[size][home])
                else:  # too rare for the sample: one cell, so all of that length are compared
                    home = probed = np.zeros(len(mine), dtype=np.int64)
                    query = np.arange(len(mine))
                at += [mine, mine[query]]
                cells += [home, probed]
                members += [np.ones(len(mine), dtype=bool), np.zeros(len(query), dtype=bool)]
                sizes.append(np.full(len(mine) + len(query), size))
            at, sizes, cells, members = (np.concatenate(x) if len(x) else np.empty(0, dtype=np.int64) for x in (at, sizes, cells, members))
            yield pa.RecordBatch.from_arrays(
                [
                    *(c.take(pa.array(at)) for c in batch.columns), pa.array(sizes.astype(np.int32)), pa.array(cells.astype(np.int32)),
                    pa.array(members.astype(bool)),
                ],
                names=[*batch.schema.names, "_size", "_cell", "_member"],
            )

    folded_rows = folded.select("_id", "_v", "_n")
    assigned = stored(folded_rows.mapInArrow(assign, extended(folded_rows, "_size int, _cell int, _member boolean")))
    # How many blocks each cell needs: as many rows as there are cells.
    filled = assigned.groupBy("_size", "_cell").agg(
        F.count_if("_member").alias("_m"), F.count_if(~F.col("_member")).alias("_q")
    )
    blocks = filled.select(
        "_size", "_cell", F.ceil(F.col("_m") / MEMBERS).cast("int").alias("_mb"), F.ceil(F.col("_q") / QUERIES).cast("int").alias("_qb")
    ).where("_mb > 0 AND _qb > 0")
    spread = lambda n: F.pmod(F.xxhash64("_id"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    placed = assigned.join(F.broadcast(blocks), ["_size", "_cell"])  # one row per cell, at most a sixteenth of the sample
    placed = placed.withColumn("_mine", F.when(F.col("_member"), spread("_mb")).otherwise(spread("_qb")))
    placed = placed.withColumn("_other", F.explode(F.when(F.col("_member"), every("_qb")).otherwise(every("_mb"))))
    placed = placed.withColumns(
        {"_mb": F.when(F.col("_member"), F.col("_mine")).otherwise(F.col("_other")), "_qb": F.when(F.col("_member"), F.col("_other")).otherwise(F.col("_mine"))}
    )

    def compare(table: pa.Table) -> pa.Table:
        member = table.column("_member").to_numpy()
        ids = table.column("_id")
        units = unit_rows(_one(table.column("_v")))
        weight = table.column("_n").to_numpy()
        number = _one(ids).dictionary_encode().indices.to_numpy()
        queries, members = np.flatnonzero(~member), np.flatnonzero(member)
        links = np.zeros(len(units), dtype=np.int64)
        root = np.arange(number.max() + 1)
        # Single precision finds who may be near, double precision says who is.
        rough = units.astype(np.float32)
        target = rough[members].T
        for start in range(0, len(queries), STRIP):
            strip = queries[start : start + STRIP]
            near = rough[strip] @ target >= np.float32(threshold - 1e-4)
            hit = np.flatnonzero(near.any(axis=1))
            q, m = np.nonzero(near[hit])
            q, m = strip[hit[q]], members[m]
            for first in range(0, len(q), PAIRS):
                x, y = q[first : first + PAIRS], m[first : first + PAIRS]
                true = (np.einsum("ij,ij->i", units[x], units[y]) >= threshold) & (number[x] != number[y])
                x, y = x[true], y[true]
                links += np.bincount(x, weights=weight[y], minlength=len(links)).astype(np.int64)
                root = _union(root, number[x], number[y])
        linked = np.flatnonzero(~member & (links > 0))
        # One edge to any vector of the same local component holds it together.
        first: dict[int, int] = {}
        heads = [first.setdefault(int(root[number[i]]), int(i)) for i in [*linked.tolist()]]
        kept, head = pa.array(linked), pa.array(heads, pa.int64())
        links_out = pa.array(links[linked])
        rest = [i for i in members.tolist() if int(root[number[i]]) in first]
        also = pa.array([first[int(root[number[i]])] for i in rest], pa.int64())
        out_ids = pa.chunked_array([*ids.take(kept).chunks, *ids.take(pa.array(rest, pa.int64())).chunks], type=ids.type)
        out_heads = pa.chunked_array([*ids.take(head).chunks, *ids.take(also).chunks], type=ids.type)
        counts = pa.chunked_array([links_out, pa.array(np.zeros(len(rest), dtype=np.int64))])
        return pa.table({"u": out_ids, "v": out_heads, "links": counts})

    kind = rows.schema["_id"].dataType.simpleString()
    grouped = placed.groupBy("_size", "_cell", "_mb", "_qb")
    found = stored(grouped.applyInArrow(compare, f"u {kind}, v {kind}, links long"))
    links = found.groupBy(F.col("u").alias("_rep")).agg(F.sum("links").alias("_links"))
    groups = components(found.select("u", "v")).select(F.col("node").alias("_rep2"), F.col("component").alias("_group"))
    reps = folded.select(F.col("_id").alias("_rep"), "_h", "_g", "_n").join(links, "_rep", "left")
    reps = reps.join(groups, F.col("_rep") == F.col("_rep2"), "left")
    reps = reps.select("_h", "_g", (F.coalesce("_links", F.lit(0)) + F.col("_n") - 1).alias("_links"), F.coalesce("_group", "_rep").alias("_group"))
    keyed = rows.select("_id", *[F.when(good, c).alias(c_name) for c, c_name in ((F.xxhash64("_v"), "_h"), (F.xxhash64(F.lit(11), "_v"), "_g"))])
    joined = keyed.join(reps, ["_h", "_g"], "left")
    group = F.coalesce("_group", "_id")
    return joined.select(
        F.col("_id").alias(id_column),
        F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"),
        group.alias("component_id"),
        F.col("_id").eqNullSafe(group).alias("kept"),
    )


def _union(root: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Labels after joining the given pairs, every label pointing at its component's smallest."""
    while True:
        a, b = root[left], root[right]
        apart = a != b
        if not apart.any():
            return root
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = root[root]
            if (further == root).all():
                break
            root = further
