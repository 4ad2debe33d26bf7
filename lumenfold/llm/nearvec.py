"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

A unit vector u is stored as scale * q + e with q in -127..127. For two of them
``|u.v - scale_u scale_v q_u.q_v| <= |e_u| |v - e_v| + |u - e_u| |e_v| + |e_u| |e_v|`` (Cauchy-Schwarz, with the true residual norms).
Blocks of codes, not of doubles, are shuffled. A tile is the product of two parts of q, exact in floating point. Of pairs
whose product less the bound reaches the threshold the link is proven, of those whose product plus the bound does not there
is none; the pairs between are computed again in double precision, from the doubles of their vectors alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import map_batches, written
from lumenfold.llm.components import block_pairs, connected_components, forest, map_groups

#: Vectors of one block of codes; a pair of blocks is a task's unit of work.
BLOCK = 4096
#: Vectors of each side of one product.
TILE = 1024
#: Pairs that are recomputed at a time.
_PAIRS = 1 << 15


def quantised(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of doubles: unit vectors, q, scale, norm of scale * q, norm of the residual (a little over, for rounding)."""
    unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
    scale = np.abs(unit).max(1) / 127.0
    q = np.rint(unit / scale[:, None])
    about = q * scale[:, None]
    return unit, q.astype(np.int8), scale, np.linalg.norm(about, axis=1), np.linalg.norm(unit - about, axis=1) + 1e-12


def judged(a: tuple, b: tuple, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of codes (q, scale, norm, residual) of two sides: boolean matrices of the proven links and of the open pairs.

    With ``same`` the sides are equal, and no vector is paired with itself. The 1e-9 covers the rounding of doubles."""
    exact = np.float32 if a[0].shape[1] * 127 * 127 < 1 << 24 else np.float64
    product = (a[0].astype(exact) @ b[0].astype(exact).T).astype(np.float64) * np.outer(a[1], b[1])
    slack = np.outer(a[3], b[2]) + np.outer(a[2] + a[3], b[3]) + 1e-9
    sure, possible = product - slack >= threshold, product + slack >= threshold
    if same:
        np.fill_diagonal(sure, False)
        np.fill_diagonal(possible, False)
    return sure, possible & ~sure


def exact_links(a: np.ndarray, b: np.ndarray, pairs: np.ndarray, threshold: float) -> np.ndarray:
    """``pairs`` (a boolean matrix) without those whose cosine, in doubles, is below the threshold. a and b are unit vectors."""
    i, j = np.nonzero(pairs)
    out = np.zeros_like(pairs)
    for at in range(0, len(i), _PAIRS):
        x, y = i[at : at + _PAIRS], j[at : at + _PAIRS]
        out[x, y] = np.einsum("ij,ij->i", a[x], b[y]) >= threshold
    return out


def summary(cid_a: np.ndarray, cid_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, linked: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a tile's links: its linked vectors, each one's root in a spanning forest, and the vectors it is linked with (copies counted)."""
    i, j = np.nonzero(linked)
    count_a = np.bincount(i, n_b[j], len(cid_a)).astype(np.int64)
    if same:
        nodes = np.unique(i)
        adjacent = linked[np.ix_(nodes, nodes)]
        cid, count = cid_a[nodes], count_a[nodes]
    else:
        left, right = np.unique(i), np.unique(j)
        adjacent = np.zeros((len(left) + len(right),) * 2, bool)
        adjacent[: len(left), len(left) :] = linked[np.ix_(left, right)]
        adjacent |= adjacent.T
        count_b = np.bincount(j, n_a[i], len(cid_b)).astype(np.int64)
        cid, count = np.concatenate([cid_a[left], cid_b[right]]), np.concatenate([count_a[left], count_b[right]])
    np.fill_diagonal(adjacent, True)
    return cid, cid[forest(len(cid), adjacent)], count


#: Links, as (a, root b, links); and the vectors of open pairs, as (a, tile_a, tile_b, in_a, codes): a tile is named by the smallest cid of each side.
_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64()), ("tile_a", pa.int64()), ("tile_b", pa.int64()), ("in_a", pa.bool_()), ("q", pa.binary()), ("scale", pa.float64()), ("about", pa.float64()), ("rest", pa.float64())])


def near_vectors(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Only vectors with the same non-null label and length are compared. A vector that is null, empty, zero, or holds a null or a non-finite component links
    with nothing: 0 links, its own component, kept. Equal vectors are one class, compared once and counted in full. Rows
    with the same id are vectors of their own. A null id has a null component if it links with none. An empty table gives no rows.

    Work: n^2 / 2 products within a label, in pairs of blocks of ``block`` codes that are spread over all tasks, however
    large a label is. A tile returns counts, a spanning forest and the vectors (not the pairs) whose links the codes leave open;
    only those vectors' doubles are fetched."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    usable = rows.where(F.col("label").isNotNull() & v.isNotNull() & F.forall(v, fine) & F.exists(v, lambda x: x != 0))
    classes = written(usable.groupBy("label", "v").agg(F.min("vec_id").alias("first"), F.count("*").alias("n")).withColumn("cid", F.monotonically_increasing_id()), "vector-classes")

    def encode():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            lists, dims = batch.column("v").to_numpy(zero_copy_only=False), batch.column("dims").to_numpy()
            q, numbers = [b""] * len(lists), np.zeros((3, len(lists)))
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                _, codes, *three = quantised(np.stack(lists[at]))
                numbers[:, at] = three
                for k, x in zip(at.tolist(), codes):
                    q[k] = x.tobytes()
            columns = [batch.column(c) for c in ("cid", "label", "dims", "n")]
            return pa.RecordBatch.from_arrays([*columns, pa.array(q, pa.binary()), *map(pa.array, numbers)], names=["cid", "label", "dims", "n", "q", "scale", "about", "rest"])

        return one

    sized = classes.select("cid", "label", F.size("v").alias("dims"), "n", "v")
    coded = written(map_batches(sized, encode, f"cid long, label {sized.schema['label'].dataType.simpleString()}, dims int, n long, q binary, scale double, about double, rest double"), "vector-codes")
    pairs = block_pairs(coded, ["label", "dims"], block, F.col("cid"))

    def codes(group: dict[str, np.ndarray], at: np.ndarray) -> tuple:
        q = np.frombuffer(b"".join(group["q"][at]), np.int8).reshape(len(at), -1)
        return q, *(group[c][at].astype(np.float64) for c in ("scale", "about", "rest"))

    def compare(group: dict[str, np.ndarray]) -> pa.RecordBatch | None:
        first = group["block_a"][0]
        same = bool(group["block_b"][0] == first)
        order = np.argsort(group["cid"], kind="stable")
        parts = lambda rows: [rows[k : k + tile] for k in range(0, len(rows), tile)]
        # A row of a block that meets itself is there once.
        left = parts(order[group["block"][order] == first])
        right = left if same else parts(order[group["block"][order] != first])
        cid, n, out = group["cid"].astype(np.int64), group["n"].astype(np.int64), []
        for x, at_a in enumerate(left):
            a = codes(group, at_a)
            for at_b in right[x:] if same else right:
                one = at_b is at_a
                sure, unclear = judged(a, a if one else codes(group, at_b), threshold, one)
                if sure.any():
                    rows = summary(cid[at_a], cid[at_b], n[at_a], n[at_b], sure, one)
                    out.append([*map(pa.array, rows), *(pa.nulls(len(rows[0]), t) for t in _FOUND.types[3:])])
                if unclear.any():
                    own = [(at_a[unclear.any(1)], True)] + ([] if one else [(at_b[unclear.any(0)], False)])
                    for at, in_a in own:
                        k = len(at)
                        out.append([pa.array(cid[at]), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), *(pa.array(np.full(k, v)) for v in (cid[at_a[0]], cid[at_b[0]], in_a)), pa.array(group["q"][at].tolist(), pa.binary()), *(pa.array(group[c][at].astype(np.float64)) for c in ("scale", "about", "rest"))])
        if not out:
            return None
        return pa.Table.from_batches([pa.RecordBatch.from_arrays(x, schema=_FOUND) for x in out]).combine_chunks().to_batches()[0]

    schema = "a long, b long, links long, tile_a long, tile_b long, in_a boolean, q binary, scale double, about double, rest double"
    compared = written(map_groups(pairs.select("label", "dims", "block_a", "block_b", "block", "cid", "n", "q", "scale", "about", "rest"), ["label", "dims", "block_a", "block_b"], compare, schema), "vector-tiles")

    def settle(group: dict[str, np.ndarray]) -> pa.RecordBatch | None:
        same = bool(group["tile_a"][0] == group["tile_b"][0])
        inside = group["in_a"].astype(bool)
        at_a = np.flatnonzero(inside)
        at_b = at_a if same else np.flatnonzero(~inside)
        unit = quantised(np.stack(group["v"]))[0]
        _, unclear = judged(codes(group, at_a), codes(group, at_b), threshold, same)
        linked = exact_links(unit[at_a], unit[at_b], unclear, threshold)
        cid, n = group["cid"].astype(np.int64), group["n"].astype(np.int64)
        rows = summary(cid[at_a], cid[at_b], n[at_a], n[at_b], linked, same)
        return pa.RecordBatch.from_arrays([*map(pa.array, rows)], names=["a", "b", "links"]) if len(rows[0]) else None

    unsettled = compared.where("tile_a is not null").withColumnRenamed("a", "cid").join(classes.select("cid", "n", "v"), "cid")
    settled = map_groups(unsettled.select("tile_a", "tile_b", "in_a", "cid", "n", "v", "q", "scale", "about", "rest"), ["tile_a", "tile_b"], settle, "a long, b long, links long")
    found = written(compared.where("tile_a is null").select("a", "b", "links").unionByName(settled), "vector-links")
    links = found.groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    reached = connected_components(found.select("a", "b")).withColumnRenamed("id", "cid")
    known = classes.join(reached, "cid", "left").join(links, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    smallest = known.groupBy("component").agg(F.min("first").alias("component_id"))
    answers = known.join(smallest, "component").select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = rows.join(answers, ["label", "v"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
