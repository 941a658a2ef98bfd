"""The forest: root paths, closure, document order, sibling order, moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import natural_key
from ..plans.joins import lookup_join
from ..plans.scan import numbered
from ..session import materialize


def root_paths(children: DataFrame) -> DataFrame:
    """Path from the root to every reachable node, by pointer doubling.

    Adds ``depth`` (0 at the top), ``path`` (ids root to node) and ``sort_path``
    (``struct<s: sequence, n: node_id>`` root to node; its order is document
    order). A forest of depth d takes about log2(d) joins instead of d. Nodes
    under a missing father and nodes on a cycle cannot be reached and drop out,
    so the rounds end.
    Steps are written to the shared folder, so lost executors cost no replay.
    """
    step = F.struct(F.col("sequence").alias("s"), F.col("node_id").alias("n"))
    state = children.select("node_id", F.col("father_id").alias("ptr"), F.array(step).alias("seg"))
    while True:
        state = materialize(state, "doubling")
        done = state.where(F.col("ptr") == 0).select("node_id", "seg")
        open_rows = state.where(F.col("ptr") != 0)
        if open_rows.isEmpty():
            break
        up = state.select(
            F.col("node_id").alias("up_id"), F.col("ptr").alias("up_ptr"), F.col("seg").alias("up_seg")
        )
        grown = lookup_join(open_rows, up, "ptr", "up_id", "inner").select(
            "node_id", F.col("up_ptr").alias("ptr"), F.concat("up_seg", "seg").alias("seg")
        )
        ids = F.transform("seg", lambda x: x["n"])
        grown = grown.where((F.col("ptr") == 0) | (F.size(F.array_distinct(ids)) == F.size(ids)))
        state = state.where(F.col("ptr") == 0).unionByName(grown)
    return children.join(done, "node_id").select(
        "node_id", "father_id", "sequence", "master_id",
        (F.size("seg") - 1).cast("long").alias("depth"),
        F.transform("seg", lambda x: x["n"]).alias("path"),
        F.col("seg").alias("sort_path"),
    )


def closure(paths: DataFrame) -> DataFrame:
    """All (ancestor, descendant) pairs with their distance, each node included."""
    return paths.select(
        F.posexplode("path").alias("i", "ancestor_id"), F.col("node_id").alias("descendant_id"), "depth"
    ).select("ancestor_id", "descendant_id", (F.col("depth") - F.col("i")).cast("long").alias("distance"))


def subtree(paths: DataFrame, root_id: int) -> DataFrame:
    """The rows of one subtree: a filter on the path, no join."""
    return paths.where(F.array_contains("path", F.lit(root_id)))


def preorder(paths: DataFrame, siblings: bool = False) -> DataFrame:
    """Document order of the whole forest as ``pos``, 1-based.

    The global rank is taken over range partitions, never in one task.
    """
    # Only ids travel through the ranking; array columns of struct sort as they are.
    out = numbered(paths, [], [F.col("sort_path")], "pos")
    if not siblings:
        return out
    rank = sibling_rank(paths).select("node_id", "rank")
    ranked = out.join(rank, "node_id")
    return with_neighbours(ranked, "rank")


def sibling_rank(children: DataFrame, unique_sequences: bool = False) -> DataFrame:
    """Dense position among siblings, ``rank`` 1..n, for fathers of any width.

    Sequences may be anything, even all equal, so rows are cut by range; with
    ``unique_sequences`` the sequence itself gives the buckets and all is lazy.
    """
    order = [F.col("sequence"), F.col("node_id")]
    if unique_sequences:
        return numbered(children, ["father_id"], order, "rank", bucket=F.floor(F.col("sequence") / 1_000_000), cheap=True)
    return numbered(children, ["father_id"], order, "rank")


def with_neighbours(ranked: DataFrame, rank: str = "rank") -> DataFrame:
    """Add ``prev_sibling`` and ``next_sibling`` by equi-join on the rank."""
    near = ranked.select(F.col("father_id").alias("f"), F.col(rank).alias("r"), F.col("node_id").alias("n"))
    prev = near.select(F.col("f").alias("father_id"), (F.col("r") + 1).alias(rank), F.col("n").alias("prev_sibling"))
    nxt = near.select(F.col("f").alias("father_id"), (F.col("r") - 1).alias(rank), F.col("n").alias("next_sibling"))
    return ranked.join(prev, ["father_id", rank], "left").join(nxt, ["father_id", rank], "left")


def fix_sequences(children: DataFrame) -> DataFrame:
    """Siblings renumbered 1..n; ``changed`` marks the rows that need a write."""
    out = sibling_rank(children)
    return out.withColumn("changed", F.col("rank") != F.col("sequence")).withColumn("sequence", F.col("rank")).drop("rank")


def sort_forest(named: DataFrame, ascending: bool = True, name: str = "name") -> DataFrame:
    """Siblings in natural order of their lower-cased names; ties keep their order.

    ``named`` holds node_id, father_id, sequence and the name. Wide fathers are
    split over range partitions.
    """
    keyed = named.withColumn("__k", natural_key(F.lower(F.col(name))))
    key = F.col("__k").asc() if ascending else F.col("__k").desc()
    out = numbered(keyed, ["father_id"], [key, F.col("sequence").asc(), F.col("node_id").asc()], "rank")
    return out.withColumn("changed", F.col("rank") != F.col("sequence")).withColumn("sequence", F.col("rank")).drop("rank", "__k")


def sort_siblings(named: DataFrame, father_id: int, ascending: bool = True, name: str = "name") -> DataFrame:
    """:func:`sort_forest` for the children of one father."""
    return sort_forest(named.where(F.col("father_id") == father_id), ascending, name)


def subtree_counts(paths: DataFrame) -> DataFrame:
    """Number of nodes in every subtree, root included; combined before the shuffle."""
    return (
        paths.select(F.explode("path").alias("node_id"))
        .groupBy("node_id").agg(F.count(F.lit(1)).cast("long").alias("n_nodes"))
    )


def names_on_path(paths: DataFrame, names: DataFrame) -> DataFrame:
    """Add ``names``: the names along the path, root to node.

    ``names`` has node_id and name. Path steps are joined and put back per node;
    a path is as long as the tree is deep, so the lists stay small.
    """
    steps = paths.select("node_id", F.posexplode("path").alias("i", "step_id"))
    named = lookup_join(steps, names.select(F.col("node_id").alias("nid"), "name"), "step_id", "nid", "left")
    lists = named.groupBy("node_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("i", F.coalesce("name", F.lit("")).alias("name")))),
            lambda s: s["name"],
        ).alias("names")
    )
    return paths.join(lists, "node_id")


def move_is_valid(moves: DataFrame, paths: DataFrame) -> DataFrame:
    """``valid`` per (src, dst): not onto itself and not below its own descendant."""
    dst = paths.select(F.col("node_id").alias("dst_node"), F.col("path").alias("dst_path"))
    joined = lookup_join(moves, dst, "dst", "dst_node", "left")
    # dst 0 is the top level and always allowed.
    blocked = F.coalesce(F.array_contains("dst_path", F.col("src")), F.lit(False))
    known = (F.col("dst") == 0) | F.col("dst_node").isNotNull()
    return joined.withColumn("valid", known & ~blocked).drop("dst_node", "dst_path")


def move_subtree(
    children: DataFrame, src: int, father: int, after: int | None = None, first: bool = False
) -> DataFrame:
    """Re-parent ``src`` with all below it: after a sibling, first, or last; renumbered.

    One row changes its father; the new order is a sort key, not a loop.
    """
    mine = F.col("node_id") == src
    if first:
        place = F.lit(-1).cast("long")
        base = F.when(mine, place).otherwise(F.col("sequence"))
        order = [base, F.when(mine, 0).otherwise(1)]
    elif after is not None:
        at = children.where((F.col("node_id") == after) & (F.col("father_id") == father)).agg(F.max("sequence")).head()[0]
        base = F.when(mine, F.lit(2**62 if at is None else at)).otherwise(F.col("sequence"))
        order = [base, F.when(mine, 1).when(F.col("node_id") == after, 0).otherwise(2)]
    else:
        base = F.when(mine, F.lit(2**62)).otherwise(F.col("sequence"))
        order = [base, F.lit(0)]
    moved = children.withColumns(
        {"__o1": order[0].cast("long"), "__o2": order[1], "__f": F.when(mine, F.lit(father)).otherwise(F.col("father_id")).cast("long")}
    )
    moved = moved.withColumn("father_id", F.col("__f"))
    out = numbered(moved, ["father_id"], [F.col("__o1"), F.col("__o2"), F.col("node_id")], "rank")
    return (
        out.withColumn("changed", (F.col("rank") != F.col("sequence")) | mine)
        .withColumn("sequence", F.col("rank")).drop("rank", "__o1", "__o2", "__f")
    )


def _neighbour_of(children: DataFrame, node: int) -> dict | None:
    """Father and neighbours of one node: at most three rows reach the driver."""
    me = children.where(F.col("node_id") == node).select("father_id", "sequence").head()
    if me is None:
        return None
    sib = children.where((F.col("father_id") == me.father_id) & (F.col("node_id") != node))
    prev = sib.where(F.col("sequence") < me.sequence).orderBy(F.desc("sequence")).limit(2).collect()
    nxt = sib.where(F.col("sequence") > me.sequence).orderBy("sequence").limit(1).collect()
    up = children.where(F.col("node_id") == me.father_id).select("father_id").head()
    return {
        "father": me.father_id,
        "prev": [r.node_id for r in prev],
        "next": [r.node_id for r in nxt],
        "grandfather": up.father_id if up else None,
    }


def move_step(children: DataFrame, node: int, direction: str) -> DataFrame:
    """``up``/``down`` swap with a neighbour, ``indent`` goes under the previous
    sibling, ``outdent`` goes after the father. Without a target nothing moves."""
    near = _neighbour_of(children, node)
    same = children.withColumn("changed", F.lit(False))
    if near is None:
        return same
    if direction == "up" and near["prev"]:
        before = near["prev"][1] if len(near["prev"]) > 1 else None
        return move_subtree(children, node, near["father"], before, first=before is None)
    if direction == "down" and near["next"]:
        return move_subtree(children, node, near["father"], near["next"][0])
    if direction == "indent" and near["prev"]:
        return move_subtree(children, node, near["prev"][0])
    if direction == "outdent" and near["grandfather"] is not None:
        return move_subtree(children, node, near["grandfather"], near["father"])
    return same


def write_order(pending: DataFrame, paths: DataFrame) -> DataFrame:
    """Pending nodes with their depth: fathers are written before children."""
    return pending.join(paths.select("node_id", "depth"), "node_id").orderBy("depth", "node_id")


def path_text(path: Column) -> Column:
    """Ids of a path joined by ``/``."""
    return F.array_join(F.transform(path, lambda x: x.cast("string")), "/")
