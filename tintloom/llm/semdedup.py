"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within cells, one representative a group.

Cells are fitted on a bounded sample (``most_sample`` vectors); every vector is then assigned to its nearest centre.
A vector is also sent as a probe to each later cell that can hold a neighbour: if y lies in cell c' and x in cell c,
then x.(c - c') <= |x - y| |c - c'|, and linked vectors are at most sqrt(2 - 2 least) apart. So no link is lost at
a border, and a link between two cells is found in the later one. Equal vectors are taken together with their number
first. Home vectors and probes of a cell meet in blocks of bounded size, so no task holds a whole cell. A block sends
one count of links for each vector, and only as many links as connect its vectors (a spanning forest), never all pairs.

Vectors that are null, zero or hold null or non-finite components, and rows without a label, link with nothing: they
have no links and are kept. Vectors of different length don't link. Rows with a null vec_id link with nothing. Rows
that repeat a vec_id count as vectors of their own, but share a component. An empty table gives an empty result. Only
the three named columns are read, whatever others there are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, components, join_by_key, materialize, small_batches, table
from .vectors import matrix, sample_rows, spherical_kmeans, unit_vectors

BLOCK = 2048
#: Vectors that are held against all centres at once.
ROWS = 1024
#: What a vector is in a block: at home in the cell, the same as a probe, or a probe from an earlier cell.
HOME, OWN, GUEST = 0, 1, 2


def _assign(rows: DataFrame, centres: np.ndarray, least: float) -> DataFrame:
    """Rows (rep, weight, label, dim, unit, home, probes array<int>): the cell of each vector, and that and the later ones
    that it probes.

    Vectors of another dimension than the centres' share cell 0 with each other.
    """
    reach = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-9
    names = ["rep", "weight", "label", "dim", "unit", "home", "probes"]

    def run(batches):
        for batch in batches:
            dims, units = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            home, probes = np.zeros(len(units), np.int32), [[0]] * len(units)
            mine = [i for i, d in enumerate(dims) if len(centres) and d == centres.shape[1]]
            for first in range(0, len(mine), ROWS):
                some = mine[first : first + ROWS]
                dot = matrix([units[i] for i in some], centres.shape[1]) @ centres.T
                best = dot.argmax(1)
                apart = np.sqrt(np.maximum(0.0, 2 - 2 * (centres[best] @ centres.T)))
                near = dot[np.arange(len(some)), best][:, None] - dot <= reach * apart + 1e-9
                near &= np.arange(len(centres)) >= best[:, None]
                near[np.arange(len(some)), best] = True
                for r, i in enumerate(some):
                    home[i] = best[r]
                    probes[i] = np.flatnonzero(near[r]).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home), pa.array(probes, pa.list_(pa.int32()))], names=names)

    return rows.select("rep", "weight", "label", "dim", "unit").mapInArrow(run, "rep long, weight long, label string, dim int, unit binary, home int, probes array<int>")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As many of the links a-b as connect what they connect: label spreading over the local graph."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    off = root != np.arange(len(nodes))
    return nodes[off], nodes[root[off]]


def links(units: DataFrame, centres: np.ndarray, least: float) -> tuple[DataFrame, DataFrame]:
    """Rows (rep, n) with the linked vectors of other classes, and a forest (a, b) of links; units are distinct vectors."""
    placed = materialize(_assign(units, centres, least), "cells")
    key = ["label", "dim", "cell"]
    homes = placed.select("label", "dim", F.col("home").alias("cell"), "rep", "weight", "unit")
    probes = placed.select("label", "dim", F.explode("probes").alias("cell"), "rep", "weight", "unit", "home")
    count = lambda d, name: d.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    parts = count(homes, "h").join(count(probes, "p"), key)
    side = F.xxhash64("rep")
    # each home block meets each probe block of its cell
    h = homes.join(parts, key).withColumn("hb", F.pmod(side, F.col("h")).cast("int")).withColumn("pb", F.explode(F.sequence(F.lit(0), F.col("p") - 1)))
    p = probes.join(parts, key).withColumn("pb", F.pmod(side, F.col("p")).cast("int")).withColumn("hb", F.explode(F.sequence(F.lit(0), F.col("h") - 1)))
    rows = lambda d, role: d.select(*key, "hb", "pb", role.alias("role"), "rep", "weight", "unit")
    both = rows(h, F.lit(HOME)).unionByName(rows(p, F.when(F.col("home") == F.col("cell"), F.lit(OWN)).otherwise(F.lit(GUEST))))

    def counted(ids: np.ndarray, n: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"rep": ids, "other": ids, "n": n.astype(np.int64)})[n > 0]

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        home, probe = rows[rows.role == HOME], rows[rows.role != HOME]
        none = np.zeros(0, np.int64)
        found = [pd.DataFrame({"rep": none, "other": none, "n": none})]
        if not len(home) or not len(probe):
            return found[0]
        dim = int(rows.dim.iloc[0])
        x, weight, ids = matrix(home.unit, dim), home.weight.to_numpy(), home.rep.to_numpy()
        for i in range(0, len(probe), 512):
            part = probe.iloc[i : i + 512]
            own, guest = part.rep.to_numpy(), part.role.to_numpy() == GUEST
            near = matrix(part.unit, dim) @ x.T >= least
            near &= own[:, None] != ids[None, :]
            r, c = np.nonzero(near)
            if len(r):
                found.append(counted(own, np.bincount(r, weight[c], len(own))))
                # two vectors at home in this cell meet twice, each as the other's probe
                once = guest[r]
                found.append(counted(ids, np.bincount(c[once], part.weight.to_numpy()[r[once]], len(ids))))
                a, b = forest(own[r], ids[c])
                found.append(pd.DataFrame({"rep": a, "other": b, "n": np.zeros(len(a), np.int64)}))
        return pd.concat(found)

    made = materialize(both.groupBy(*key, "hb", "pb").applyInPandas(meet, "rep long, other long, n long"), "links")
    return made.where("rep = other").groupBy("rep").agg(F.sum("n").alias("n")), made.where("rep <> other").select(F.col("rep").alias("a"), F.col("other").alias("b"))


def near_duplicates(rows: DataFrame, *, least: float = 0.93, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", most_sample: int = 20_000, cell_size: int = 1000, most_cells: int = 4096) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each row.

    About ``cell_size`` vectors of the commonest label share a cell, with at most ``most_cells`` cells.
    """
    small_batches(rows.sparkSession)
    units = materialize(unit_vectors(rows, vec_id, embedding, label), "units")
    classes = units.groupBy("label", "dim", "unit").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    # ids that repeat on different vectors would make classes share a representative
    classes = materialize(classes.withColumn("rep_id", F.col("rep")).withColumn("rep", F.xxhash64("label", "unit")), "classes")
    sample = sample_rows(units, most_sample)
    # cells are shared by all labels, but only vectors of one label meet in them
    n = classes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    centres = spherical_kmeans(sample, max(1, min(most_cells, n // cell_size))) if len(sample) else sample
    counts, chosen = links(classes, centres, least)
    ids = classes.select(F.col("rep"), "rep_id")
    named = chosen.join(ids.toDF("a", "ia"), "a").join(ids.toDF("b", "ib"), "b").select(F.col("ia").alias("a"), F.col("ib").alias("b"))
    groups = components(named)
    # by class first, so that a vector that many rows hold is no key of these joins
    known = classes.select("rep", "rep_id", "weight").join(counts, "rep", "left").join(groups.withColumnRenamed("node", "rep_id"), "rep_id", "left")
    known = materialize(known.select("rep", "weight", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep_id").alias("component_id")), "known")
    members = join_by_key(units.select("vec_id", F.xxhash64("label", "unit").alias("rep")), known, ["rep"], "weight").select("vec_id", "n_links", "component_id")
    # a repeated id shares its component, and each of its rows takes the most links
    members = members.groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    every = rows.select(F.col(vec_id).cast("long").alias("vec_id"))
    out = every.join(members, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3_embedding_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"))


__all__ = ["NO_ID", "near_duplicates", "op3_embedding_dedup"]
