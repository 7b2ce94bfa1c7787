"""Property graphs as node, edge and evidence tables: assembly, statistics, integrity, neighbourhood, components."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import stable_id
from ..sources.snapshots import cut_lineage
from .ordered import best_row


def node_rows(df: DataFrame, kind: str, key, label, props: Sequence[str] = (), *, prefix: str | None = None) -> DataFrame:
    """Nodes of one type from a table: id (from the type and key), type, label, props (JSON with keys in order)."""
    p = F.to_json(F.struct(*[F.col(c) for c in sorted(props)])) if props else F.lit("{}")
    key = F.col(key) if isinstance(key, str) else key
    return df.select(stable_id(prefix or kind.lower(), F.concat(F.lit(kind + ":"), key.cast("string"))).alias("id"), F.lit(kind).alias("type"), (F.col(label) if isinstance(label, str) else label).cast("string").alias("label"), p.alias("props"))


def edge_rows(df: DataFrame, source: tuple[str, object], target: tuple[str, object], relation: str, props: Sequence[str] = ()) -> DataFrame:
    """Edges between nodes that ``node_rows`` makes of (type, key) pairs."""

    def end(kind, key):
        key = F.col(key) if isinstance(key, str) else key
        return stable_id(kind.lower(), F.concat(F.lit(kind + ":"), key.cast("string")))

    p = F.to_json(F.struct(*[F.col(c) for c in sorted(props)])) if props else F.lit("{}")
    return df.select(end(*source).alias("src"), end(*target).alias("dst"), F.lit(relation).alias("relation"), p.alias("props"))


def first_nodes(nodes: DataFrame, seq: str | None = None) -> DataFrame:
    """One node per id; the first in ``seq``, else the least in label and props."""
    return best_row(nodes, ["id"], [F.col(c) for c in ([seq] if seq else ["type", "label", "props"])])


def distinct_edges(edges: DataFrame) -> DataFrame:
    """One edge per source, target, relation and properties, with an id made of them."""
    out = edges.select("src", "dst", "relation", "props").distinct()
    return out.withColumn("id", stable_id("edge", F.concat_ws("|", "src", "relation", "dst", "props")))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts by node type and by relation, and totals: kind, name, n."""
    n = nodes.groupBy(F.col("type").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("kind"), "name", "n")
    e = edges.groupBy(F.col("relation").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("kind"), "name", "n")
    both = n.unionByName(e)
    return both.unionByName(both.groupBy("kind").agg(F.sum("n").alias("n")).select("kind", F.lit("*").alias("name"), "n"))


def integrity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Violations: check, item, n. Duplicate ids, edges with a missing end, and nodes without any edge."""
    twice = nodes.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("duplicate_id").alias("check"), F.col("id").alias("item"), "n")
    ids = nodes.select("id").distinct()
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    dangling = ends.join(ids, "id", "left_anti").groupBy("id").agg(F.count(F.lit(1)).alias("n")).select(F.lit("dangling_edge").alias("check"), F.col("id").alias("item"), "n")
    orphan = ids.join(ends.distinct(), "id", "left_anti").select(F.lit("orphan_node").alias("check"), F.col("id").alias("item"), F.lit(1).cast("long").alias("n"))
    return twice.unionByName(dangling).unionByName(orphan)


def neighbourhood(edges: DataFrame, node: str) -> DataFrame:
    """Edges that touch a node, with the other end and the direction."""
    out = edges.where(F.col("src") == node).select(F.col("dst").alias("other"), "relation", F.lit("out").alias("direction"))
    into = edges.where(F.col("dst") == node).where(F.col("src") != node).select(F.col("src").alias("other"), "relation", F.lit("in").alias("direction"))
    return out.unionByName(into)


def related_facts(nodes: DataFrame, edges: DataFrame, owners: DataFrame, owner: str, evidence: DataFrame | None = None) -> DataFrame:
    """Owner, relation, node and (left) evidence: the two-hop join from owners through edges."""
    links = edges.select(F.col("src").alias("owner"), F.col("dst").alias("id"), "relation")
    out = owners.select(F.col(owner).alias("owner")).join(links, "owner").join(nodes, "id").select("owner", "relation", "id", "type", "label", "props")
    if evidence is not None:
        out = out.join(evidence.select(F.col("node_id").alias("id"), F.col("text").alias("evidence_text")), "id", "left")
    return out


def components(edges: DataFrame, *, src: str = "src", dst: str = "dst") -> DataFrame:
    """node and component (its least node) of each node with an edge. Least labels spread along edges and jump to
    their label's label; each round ends lineage in the shared folder, and the number of rounds grows with the
    logarithm of the longest path."""
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    both = cut_lineage(e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("component")))
    while True:
        near = both.join(label, F.col("b") == F.col("node")).groupBy(F.col("a").alias("n")).agg(F.min("component").alias("near"))
        spread = label.join(near, F.col("node") == F.col("n"), "left").select("node", F.col("component").alias("old"), F.least("component", "near").alias("to"))
        jump = label.select(F.col("node").alias("to"), F.col("component").alias("further"))
        new = cut_lineage(spread.join(jump, "to", "left").select("node", "old", F.least("to", "further").alias("component")))
        label = new.select("node", "component")
        if new.where("component <> old").isEmpty():
            return label


def closure(edges: DataFrame, seeds: DataFrame, *, src: str = "src", dst: str = "dst", most_rounds: int | None = None) -> DataFrame:
    """Nodes that links reach from seeds (id), with the number of steps; stops when nothing new comes. A bound on the
    steps is an error where it is reached with nodes still to come."""
    links = edges.select(F.col(src).alias("id"), F.col(dst).alias("next")).distinct()
    seen = cut_lineage(seeds.select("id").distinct().withColumn("depth", F.lit(0)))
    front = seen
    for k in count(1):
        new = front.join(links, "id").select(F.col("next").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(k))
        front = cut_lineage(new)
        if front.isEmpty():
            return seen
        if most_rounds is not None and k > most_rounds:
            raise ValueError(f"links reach further than {most_rounds} steps from the seeds")
        seen = cut_lineage(seen.unionByName(front))


def roots(links: DataFrame, child: str, parent: str, *, most_rounds: int = 32) -> DataFrame:
    """Each child's root along part-of links, by pointer doubling; a child in a cycle gets a null root."""
    up = cut_lineage(links.groupBy(F.col(child).alias("node")).agg(F.min(parent).alias("at")))
    for _ in range(most_rounds):
        step = up.select(F.col("node").alias("at"), F.col("at").alias("further"))
        new = cut_lineage(up.join(step, "at", "left").select("node", F.coalesce("further", "at").alias("at"), F.col("further").isNotNull().alias("moved")))
        up = new.select("node", "at")
        if new.where("moved").isEmpty():
            return up.select(F.col("node").alias(child), F.col("at").alias("root"))
    moving = up.join(up.select(F.col("node").alias("at"), F.lit(True).alias("cyclic")), "at", "left")
    return moving.select(F.col("node").alias(child), F.when(F.col("cyclic").isNull(), F.col("at")).alias("root"))


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GraphML as text lines with a key to sort by; written by one task only if the caller coalesces."""

    def esc(c):
        out = F.coalesce(F.col(c).cast("string"), F.lit(""))
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            out = F.replace(out, F.lit(a), F.lit(b))
        return out

    n = nodes.select(F.lit(1).alias("part"), F.col("id").alias("k"), F.format_string('<node id="%s"><data key="type">%s</data><data key="label">%s</data></node>', esc("id"), esc("type"), esc("label")).alias("line"))
    e = edges.select(F.lit(2).alias("part"), F.col("id").alias("k"), F.format_string('<edge id="%s" source="%s" target="%s"><data key="relation">%s</data></edge>', esc("id"), esc("src"), esc("dst"), esc("relation")).alias("line"))
    spark = nodes.sparkSession
    ends = spark.createDataFrame([(0, "", '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="directed">'), (3, "", "</graph></graphml>")], "part int, k string, line string")
    return ends.unionByName(n).unionByName(e)
