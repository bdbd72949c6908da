"""Merkle manifest of a dataset: lag and lead windows supply siblings, first-child rows hash parents.

Every row is a leaf. The leaves of one group (a source) form a tree of ``FAN`` children a node, and the
roots of the groups, in the order of their names, form the tree above them. The nodes of a
group are cut into blocks of ``FAN ** LEVELS`` in a row, so that no run of siblings crosses a block: one window per
level runs inside the blocks, whatever the size of the group. Blocks of blocks follow until every group has one node.
DataFrame functions only.
"""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tiebreak.session import Stored

FAN, LEVELS = 3, 4
BLOCK = FAN ** LEVELS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
# monotonically_increasing_id keeps the partition above this bit and the row's place below it
PLACE_BITS = 33


def digest(*columns):
    """Lower-case hexadecimal sha256 of columns of text put together."""
    return F.sha2(F.concat(*columns), 256)


def leaf(*columns):
    """The digest of a row's columns, each '-' if null, else its UTF-8 byte count, ':' and its value."""
    def field(c):
        text = (F.col(c) if isinstance(c, str) else c).cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
    return digest(*map(field, columns))


def _placed(rows: DataFrame, tables: Stored, group, order, label):
    """``rows`` with ``i``, the place in the group by ``order`` from 0, and ``n``, the size of the group.

    Rows are range-partitioned by group and order, so a large group lies in many partitions; the sizes of its
    parts give each part its first place. ``rows`` must be a stored table.
    """
    keys = [group, *order]
    # rows alike in all keys are interchangeable, and may lie in several partitions
    spread = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys, "tie").sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()
    spread = tables.write(spread.drop("tie").select(
        "*", F.shiftright(at, PLACE_BITS).alias("part"), at.bitwiseAND((1 << PLACE_BITS) - 1).alias("place")), label)
    sizes = spread.groupBy(group, "part").agg(F.min("place").alias("first"), F.count("*").alias("m"))
    before = W.partitionBy(group).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    shifts = sizes.select(
        group, "part", (F.coalesce(F.sum("m").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("m").over(W.partitionBy(group)).alias("n"))
    placed = spread.join(shifts, [group, "part"]).withColumn("i", F.col("place") + F.col("shift")).drop("part", "place", "shift")
    placed = tables.write(placed, label)
    tables.drop(spread)
    return placed


def _level(j):
    """What a window needs to know of level ``j`` of a block: (window, step, is a node, nodes in the group, slot, run length)."""
    step = FAN ** j
    nodes = F.expr(f"(n + {step - 1}) div {step}")
    slot = F.expr(f"(i div {step}) % {FAN}")
    run = F.least(F.lit(FAN), nodes - (F.expr(f"i div {step}") - slot))
    return W.partitionBy("g", "block").orderBy("i"), step, F.expr(f"i % {step} = 0"), nodes, slot, run


def _hashed(nodes: DataFrame) -> DataFrame:
    """``nodes`` (g, i, n, h, block) with, level by level from 0, ``h0`` ..., the node that starts at this row, and ``s0`` ..., its siblings."""
    out, none = nodes.withColumnRenamed("h", "h0"), F.lit("")
    for j in range(LEVELS):
        window, step, is_node, n_nodes, slot, run = _level(j)
        h, s = F.col(f"h{j}"), F.col(f"s{j}")
        left = F.concat(*(
            F.when(slot >= d, F.coalesce(F.lag(h, d * step).over(window), none)).otherwise(none) for d in reversed(range(1, FAN))))
        right = F.concat(*(
            F.when(slot + d < run, F.coalesce(F.lead(h, d * step).over(window), none)).otherwise(none) for d in range(1, FAN)))
        out = out.select("*", F.when(is_node & (n_nodes > 1), F.struct(left.alias("left"), right.alias("right"))).alias(f"s{j}"))
        out = out.select("*", F.when(is_node & (slot == 0), F.when(s.isNull(), h).otherwise(digest(h, s["right"]))).alias(f"h{j + 1}"))
    return out


def _in_blocks(nodes):
    return nodes.withColumn("block", F.expr(f"i div {BLOCK}"))


def _grown(leaves: DataFrame, tables: Stored, label):
    """The leaves and, block by block, the tables above them; the last has one node a group."""
    stack = [leaves]
    while (stack[-1].agg(F.max("n")).first()[0] or 1) > 1:
        tops = _hashed(_in_blocks(stack[-1])).where(f"i % {BLOCK} = 0").select(
            "g", F.col("block").alias("i"), F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n"), F.col(f"h{LEVELS}").alias("h"))
        stack.append(tables.write(tops, label))
    return stack


def _paths(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """``nodes`` with ``path``: the siblings of each row's node and of the nodes over it, lowest first.

    ``above`` (g, i, path) has those of the blocks. A window hands them down from a node to its children.
    """
    columns = nodes.columns
    above = above.select("g", F.col("i").alias("block"), F.col("path").alias(f"p{LEVELS}"))
    out = _hashed(_in_blocks(nodes).join(above, ["g", "block"]))
    for j in reversed(range(LEVELS)):
        window, step, is_node, _, slot, _ = _level(j)
        over = F.col(f"p{j + 1}")
        parent = over
        for d in range(1, FAN):
            parent = F.when(slot == d, F.lag(over, d * step).over(window)).otherwise(parent)
        out = out.select("*", F.when(is_node, F.concat(F.array_compact(F.array(f"s{j}")), parent)).alias(f"p{j}"))
    return out.withColumnsRenamed({"h0": "h", "p0": "path"}).select(*columns, "path")


def _down(stack, above: DataFrame) -> DataFrame:
    """Paths of the rows of ``stack[0]``; ``above`` (g, path, ...) has those of the groups."""
    paths = stack[-1].join(above, "g")
    for nodes in reversed(stack[:-1]):
        extra = [c for c in above.columns if c not in ("g", "path")]
        paths = _paths(nodes, paths).join(above.select("g", *extra), "g") if extra else _paths(nodes, paths)
    return paths


def manifest(docs: DataFrame, columns=COLUMNS, id_col="doc_id", source_col="source", also=None) -> DataFrame:
    """(doc_id, leaf, subroot, root, path, and the columns of ``also``) per row of ``docs``.

    A leaf is the digest of ``columns``. Per source, leaves ascend by id; while a source has several
    nodes, every three in a row (the last run: fewer, even one) become the digest of their digests. The node that is left
    is ``subroot``. Subroots ascend by source, bytewise, null first, and give ``root`` likewise. ``path`` lists the
    siblings on the way from the leaf through the subroot to the root, one (left, right) pair of joined digests a level, empty
    where a run has one node. ``also`` names columns of ``docs`` (name -> column) that the result carries.

    A null or empty text is a leaf like any other (null and empty differ), a null id comes first in its source, a null source is a
    source. Rows under one id are ordered by their leaves; rows alike in all of ``columns`` are leaves each.
    An empty table gives no row. Other columns are ignored, and may have any name.
    """
    tables = Stored(docs.sparkSession, "merkle")
    also = also or {}
    extra = {f"x{i}": name for i, name in enumerate(also)}
    # null sorts ahead of any name, and the two marks keep it apart from a source named '-'
    source = F.coalesce(F.concat(F.lit(":"), F.col(source_col).cast("string")), F.lit("-"))
    rows = tables.write(docs.select(
        source.alias("g"), F.col(id_col).alias("k"), leaf(*columns).alias("h"),
        *(c.alias(x) for x, c in zip(extra, also.values()))), "rows")
    leaves = _placed(rows, tables, "g", ["k", "h"], "leaves")
    tables.drop(rows)
    stack = _grown(leaves, tables, "nodes")
    subroots = tables.write(stack[-1].select(F.lit("").alias("g"), F.col("g").alias("name"), "h"), "subroots")
    sources = _grown(_placed(subroots, tables, "g", ["name"], "sources"), tables, "tops")
    top = sources[-1].first()
    path = F.array().cast("array<struct<left:string,right:string>>")
    roots = _down(sources, sources[-1].select("g", path.alias("path")))
    above = tables.write(roots.select(F.col("name").alias("g"), F.col("h").alias("subroot"), "path"), "above")
    found = _down(stack, above)
    return found.select(
        F.col("k").alias("doc_id"), F.col("h").alias("leaf"), "subroot", F.lit(top and top["h"]).cast("string").alias("root"), "path",
        *(F.col(x).alias(name) for x, name in extra.items()))


def folded(leaf_col, path="path"):
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(F.col(path), leaf_col, lambda h, s: digest(s["left"], h, s["right"]))


def proof(path="path"):
    """The digest of all siblings of a path, level by level, left to right."""
    return digest(F.array_join(F.transform(F.col(path), lambda s: F.concat(s["left"], s["right"])), ""))
