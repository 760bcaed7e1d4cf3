"""Merkle manifest of a dataset: one tree for each group, a tree over their roots, and proofs.

Trees are built from blocks of 4,096 consecutive nodes, so a tree of any size is a few
shuffles and no task sees more than a block. Proofs come by pointer jumping: every node
starts with its sibling, a segment of one step towards its parent, and a self-join appends
the segment of the node it points to, which doubles the distance. After round r a node at a
height divisible by 2^r points 2^r levels up, so only these are kept as targets; after
log2(depth) rounds every leaf points to its root.

Digests travel as 32 bytes; hashes are taken over their lowercase hex text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.operators.runs import sorted_runs
from cohortlake.session import materialise

#: levels that one block climbs; a block has 2 to this power nodes at its bottom
BLOCK = 12
#: bytes of one step of a proof: 0 alone, 1 sibling at the left, 2 at the right; then the sibling
STEP = 33
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NODES = "tree string, n long, depth int, level int, place long, digest binary, step binary"
_COLUMNS = [field.split()[0] for field in _NODES.split(", ")]


def sized(value: Column) -> Column:
    """A value with its length in bytes before it, or ``-`` for null: no two rows read alike."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(fields: Sequence[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[sized(f) for f in fields]).cast("binary"), 256))


def group_key(group: Column) -> Column:
    """The group as a string that sorts by its bytes, null first and apart from the empty text."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def _climb(rows: pd.DataFrame, block: int) -> pd.DataFrame:
    """All nodes above one block of neighbours, with the step that each makes to its parent."""
    rows = rows.sort_values("place")
    tree, n, depth, level, first = (rows[c].iloc[0] for c in ("tree", "n", "depth", "level", "place"))
    digests, top, out = [bytes(d) for d in rows["digest"]], int(min(level + block, depth)), []
    for at in range(int(level), top):
        above = []
        for i in range(0, len(digests), 2):
            pair = digests[i:i + 2]
            for side, own in enumerate(pair):
                step = bytes(STEP) if len(pair) == 1 else bytes([2 - side]) + pair[1 - side]
                out.append((tree, n, depth, at, first + i + side, own, step))
            above.append(hashlib.sha256("".join(d.hex() for d in pair).encode()).digest())
        digests, first = above, first >> 1
    # the top of the block has no step yet: it is a leaf of the next round, or the root
    out.append((tree, n, depth, top, first, digests[0], None))
    return pd.DataFrame(out, columns=_COLUMNS)


def tree_nodes(leaves: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Nodes below the roots with their steps, and one root for each tree.

    ``leaves`` has ``tree``, ``place`` (from 0, without gaps) and ``digest``.
    """
    sizes = leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "depth", F.when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0).cast("int"))
    sizes = materialise(sizes)
    deepest = sizes.agg(F.max("depth")).first()[0] or 0  # one number
    bottom = leaves.join(sizes, "tree").select(
        "tree", "n", "depth", F.lit(0).alias("level"), "place", "digest", F.lit(None).cast("binary").alias("step"))
    nodes, roots = [], bottom.filter("depth = 0")
    for level in range(0, deepest, block):
        made = materialise(
            bottom.filter(F.col("depth") > level)
            .groupBy("tree", F.shiftright("place", block).alias("__block"))
            .applyInPandas(lambda rows: _climb(rows, block), _NODES).select(*_COLUMNS))
        nodes.append(made.filter("step is not null"))
        bottom = made.filter("step is null")
        roots = roots.union(bottom.filter("level = depth"))
        bottom = bottom.filter("level < depth")
    below = nodes[0] if nodes else bottom.limit(0)
    for more in nodes[1:]:
        below = below.union(more)
    return below, roots.select("tree", "n", "digest")


def root_paths(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """``tree``, ``place`` and ``steps`` (packed, up to the root of its tree) of each leaf."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0  # one number
    paths = nodes.filter("level = 0").select("tree", "depth", "place", F.col("step").alias("steps"))
    upper = nodes.filter("level > 0").select("tree", "n", "depth", "level", "place", F.col("step").alias("steps"))
    distance = 1
    while distance < deepest:
        paths = _jump(paths, upper.filter(F.col("level") == distance), distance, block)
        if 2 * distance < deepest:
            met = upper.filter(F.col("level") % (2 * distance) == distance)
            far = upper.filter(F.col("level") % (2 * distance) == 0)
            upper = materialise(_jump(far, met, distance, block))
        distance *= 2
    return paths.select("tree", "place", "steps")


def _jump(rows: DataFrame, targets: DataFrame, distance: int, block: int) -> DataFrame:
    """Rows whose pointer is ``distance`` up take over the steps of the node it leads to.

    The 2^distance rows that point to one node meet it in shares of at most 2^``block``,
    for which the node is repeated: N / 2^``block`` records, whatever the distance.
    """
    level = F.col("level") if "level" in rows.columns else F.lit(0)
    short = min(distance, block)
    done = rows.filter(level + distance >= F.col("depth"))
    more = rows.filter(level + distance < F.col("depth")).withColumn(
        "__to", F.shiftright("place", short)).withColumn("__level", level + distance)
    # the shares of the last node of a level end where that level ends
    first = F.shiftleft("place", distance - short)
    end = F.shiftright(F.expr(f"shiftright(n - 1, level - {distance})"), short)
    share = F.explode(F.sequence(first, F.least(first + ((1 << distance - short) - 1), end)))
    met = targets.select("tree", F.col("level").alias("__level"), F.col("steps").alias("__steps"), share.alias("__to"))
    joined = more.join(met, ["tree", "__level", "__to"]).withColumn("steps", F.concat("steps", "__steps"))
    return done.select(*rows.columns).union(joined.select(*rows.columns))


def proofs(
    docs: DataFrame, group: str = "lang", order: str = "doc_id", fields: Sequence[str] = FIELDS,
    tampered: Column | None = None, block: int = BLOCK,
) -> DataFrame:
    """Per row its ``order`` column, ``leaf``, ``tampered`` leaf or null, ``steps``, ``subroot`` and ``root``.

    Leaves of a group ascend by ``order``, null first, and by their digest where that ties, so
    repeated rows are leaves of their own with equal digests. Groups ascend by their bytes,
    null first; a null group is a group, apart from the empty text. Null and empty fields
    differ. Other columns are not read. A lone leaf is its own subroot, a lone subroot the
    root. An empty table has no root and gives no rows. ``steps`` is packed, leaf to root.
    """
    spark = docs.sparkSession
    stored = materialise(docs.select(
        group_key(F.col(group)).alias("tree"), F.col(order).alias("id"),
        leaf_digest([F.col(f) for f in fields]).alias("digest"),
        (F.lit(None).cast("binary") if tampered is None else tampered).alias("tampered")))
    placed = materialise(sorted_runs(stored, ["tree", "id", "digest"]).row_number(["tree"], "nth").select(
        "tree", (F.col("nth") - 1).alias("place"), "id", "digest", "tampered"))
    nodes, roots = tree_nodes(placed.select("tree", "place", "digest"), block)
    roots = materialise(roots)
    tops = materialise(sorted_runs(roots, ["tree"]).numbered("nth").select(
        F.lit("").alias("tree"), (F.col("nth") - 1).alias("place"), "digest",
        F.col("tree").alias("group"), F.col("n").alias("size")))
    top_nodes, top_root = tree_nodes(tops.select("tree", "place", "digest"), block)
    root = top_root.first()  # one row
    if root is None:
        return spark.createDataFrame([], f"{order} {dict(docs.dtypes)[order]}, leaf binary, tampered binary, "
                                         "steps binary, subroot binary, root binary")
    # the rest of the way, once for each share of a group's leaves
    onward = tops.join(root_paths(top_nodes, block), ["tree", "place"], "left").select(
        F.col("group").alias("tree"), F.col("digest").alias("subroot"),
        F.coalesce("steps", F.lit(b"")).alias("onward"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("size") - 1, block))).alias("share"))
    return (
        placed.join(root_paths(nodes, block), ["tree", "place"], "left")
        .withColumn("share", F.shiftright("place", block)).join(materialise(onward), ["tree", "share"])
        .select(F.col("id").alias(order), F.col("digest").alias("leaf"), "tampered",
                F.concat(F.coalesce("steps", F.lit(b"")), F.col("onward")).alias("steps"), "subroot",
                F.lit(bytes(root["digest"])).alias("root"))
    )


def text_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _each(steps: Column) -> Column:
    places = F.sequence(F.lit(0), (F.octet_length(steps) / STEP).cast("int") - 1)
    split = F.transform(places, lambda i: F.struct(
        F.hex(F.substring(steps, i * STEP + 1, F.lit(1))).alias("side"),
        text_of(F.substring(steps, i * STEP + 2, F.lit(STEP - 1))).alias("sibling")))
    return F.when(F.octet_length(steps) > 0, split).otherwise(F.array().cast(
        "array<struct<side:string,sibling:string>>"))


def siblings_digest(steps: Column) -> Column:
    """Hash of the siblings of a proof, from the leaf's to that below the root."""
    held = F.filter(_each(steps), lambda s: s["side"] != "00")
    return F.sha2(F.concat_ws("", F.transform(held, lambda s: s["sibling"])).cast("binary"), 256)


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its proof lead to, as hex text."""
    return F.aggregate(_each(steps), text_of(leaf), lambda own, s: F.sha2(
        F.when(s["side"] == "01", F.concat(s["sibling"], own)).when(s["side"] == "02", F.concat(own, s["sibling"]))
        .otherwise(own).cast("binary"), 256))
