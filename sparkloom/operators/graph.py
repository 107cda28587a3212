"""Property graphs as two tables: nodes(id, label, props) and edges(src, type, dst, props)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize

# Labels and edge types of the projected graph.
LABELS = ["Workspace", "Person", "Identity", "Conversation", "Message", "Event", "File", "Note", "Video", "Transcript"]
EDGE_TYPES = ["HAS_IDENTITY", "SENT_BY", "IN_CONVERSATION", "PARTICIPATED_IN", "REPLY_TO", "THREAD_ROOT", "ATTACHED_TO", "MENTIONS", "PREDICTED_DUE", "OWNS", "AUTHORED", "PART_OF", "HAS_TRANSCRIPT", "LINKED_TO"]


def node(df: DataFrame, node_id, label: str, **props: Column) -> DataFrame:
    """nodes rows from a table; properties are strings, nested ones JSON."""
    pairs = [x for k, v in props.items() for x in (F.lit(k), v.cast("string"))]
    made = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return df.select(node_id.alias("id"), F.lit(label).alias("label"), made.alias("props")).where("id is not null")


def edge(df: DataFrame, src, kind: str, dst) -> DataFrame:
    return df.select(src.alias("src"), F.lit(kind).alias("type"), dst.alias("dst")).where("src is not null and dst is not null")


def union(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Later labels replace, properties merge, later ones winning."""
    rows = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    entries = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_v", F.map_entries("props").alias("e")))), lambda x: x["e"]))
    merged = rows.groupBy("id").agg(F.max_by("label", "_v").alias("label"), entries.alias("e"))
    # the last entry of each key
    last = lambda e: F.map_from_entries(F.filter(e, lambda x, i: ~F.exists(F.slice(e, i + 2, F.size(e)), lambda y: y["key"] == x["key"])))
    return merged.select("id", "label", last(F.col("e")).alias("props"))


def upsert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """One edge per (src, type, dst)."""
    return old.unionByName(new, allowMissingColumns=True).dropDuplicates(["src", "type", "dst"])


def delete_edges(edges: DataFrame, src=None, kind: str | None = None, dst=None) -> DataFrame:
    hit = F.lit(True)
    for c, v in (("src", src), ("type", kind), ("dst", dst)):
        if v is not None:
            hit &= F.col(c) == F.lit(v)
    return edges.where(~hit)


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def reachable(edges: DataFrame, focus, hops: int) -> DataFrame:
    """id, depth of all nodes within hops of focus, edges read both ways; one join per hop."""
    spark, links = edges.sparkSession, both_ways(edges)
    kind = edges.schema["src"].dataType.simpleString()
    seen = spark.createDataFrame([(focus, 0)], f"id {kind}, depth int")
    front = seen
    for d in range(1, hops + 1):
        step = links.join(front.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        front = materialize(step.join(seen, "id", "left_anti").withColumn("depth", F.lit(d)), "front")
        seen = seen.unionByName(front)
    return seen


def ego(nodes: DataFrame, edges: DataFrame, focus, hops: int = 2, labels: list[str] | None = None, types: list[str] | None = None, limit: int = 400) -> tuple[DataFrame, DataFrame]:
    """(nodes with depth, edges among them) around a node.

    Nodes of other labels are walked through but not returned; the focus always is. Types restrict the
    returned edges only. The nearest nodes, then the smallest ids, stay within the limit.
    """
    found = reachable(edges, focus, min(3, max(1, hops))).join(nodes, "id")
    if labels:
        found = found.where(F.col("label").isin(labels) | (F.col("depth") == 0))
    found = found.orderBy("depth", "id").limit(limit)
    return found, among(edges if not types else edges.where(F.col("type").isin(types)), found)


def among(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are both given nodes."""
    return edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")


def neighbors(nodes: DataFrame, edges: DataFrame, node_id, types: list[str] | None = None, limit: int = 200) -> DataFrame:
    own = edges.where((F.col("src") == F.lit(node_id)) | (F.col("dst") == F.lit(node_id)))
    if types:
        own = own.where(F.col("type").isin(types))
    other = own.select(F.when(F.col("src") == F.lit(node_id), F.col("dst")).otherwise(F.col("src")).alias("id")).distinct()
    return other.join(nodes, "id").orderBy("id").limit(limit)


def shortest_paths(edges: DataFrame, src, dst, max_hops: int = 4, limit: int = 5) -> DataFrame:
    """path (array of ids), hops of the shortest paths of at most max_hops edges, in order of their ids."""
    spark, links = edges.sparkSession, both_ways(edges)
    kind = edges.schema["src"].dataType.simpleString()
    depth = reachable(edges, src, min(6, max(1, max_hops)))
    hit = depth.where(F.col("id") == F.lit(dst)).first()
    if hit is None:
        return spark.createDataFrame([], f"path array<{kind}>, hops int")
    hops = hit["depth"]
    # nodes from which the target is as far as the source's depth leaves: walking back along decreasing depth
    target = depth.where(F.col("id") == F.lit(dst)).select("id")
    levels = [target]
    for d in range(hops - 1, -1, -1):
        back = links.join(levels[0].withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"))
        levels.insert(0, materialize(depth.where(F.col("depth") == d).join(back, "id", "left_semi").select("id"), "level"))
    # every prefix along these nodes is one of a shortest path, so that the first paths have the first prefixes
    paths = spark.createDataFrame([([src],)], f"path array<{kind}>")
    for level in levels[1:]:
        steps = links.join(level.withColumnRenamed("id", "dst"), "dst", "left_semi")
        grown = paths.withColumn("src", F.element_at("path", -1)).join(steps, "src").select(F.concat("path", F.array("dst")).alias("path"))
        paths = grown.orderBy("path").limit(max(limit, 1))
    return paths.select("path", F.lit(hops).alias("hops")).orderBy("path").limit(limit)


def top_nodes(nodes: DataFrame, label: str, by: str = "message_count", limit: int = 20) -> DataFrame:
    score = F.coalesce(F.col("props")[by].try_cast("double"), F.lit(0.0))
    return nodes.where(F.col("label") == label).select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def census(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind (node or edge), name, n."""
    n = nodes.groupBy(F.lit("node").alias("kind"), F.col("label").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return n.unionByName(edges.groupBy(F.lit("edge").alias("kind"), F.col("type").alias("name")).agg(F.count(F.lit(1)).alias("n")))


def advisory_edges(insights: DataFrame, nodes: DataFrame | None) -> DataFrame:
    """LINKED_TO edges of insights about two entities that are both in the graph; without nodes, the insights are of nodes only."""
    two = insights.where(F.size("entities") == 2).select(F.get("entities", F.lit(0)).alias("src"), F.get("entities", F.lit(1)).alias("dst"), F.lit("LINKED_TO").alias("type"), F.lit("advisory").alias("state"), "confidence")
    return two if nodes is None else among(two, nodes)


def review(links: DataFrame, src, dst, accept: bool) -> DataFrame:
    """An advisory link accepted (its state changes) or dismissed (it goes)."""
    hit = (F.col("src") == F.lit(src)) & (F.col("dst") == F.lit(dst))
    return links.withColumn("state", F.when(hit, "accepted").otherwise(F.col("state"))) if accept else links.where(~hit)


def placeholder(ref) -> Column:
    """The node of a sender whom no person stands for."""
    return F.concat(F.lit("per_unknown_"), F.regexp_replace(F.lower(ref), "[^a-z0-9]+", "_"))


def _people(t: dict[str, DataFrame]) -> tuple[list[DataFrame], list[DataFrame], DataFrame | None]:
    """Nodes and edges of persons and identities, and (ref, person_id)."""
    c, nodes, edges, owner = F.col, [], [], None
    if "persons" in t:
        nodes.append(node(t["persons"], c("person_id"), "Person", name=c("display_name"), message_count=c("message_count")))
    if "identities" in t:
        nodes.append(node(t["identities"], c("_id"), "Identity", provider=c("provider"), ref=c("ref")))
    if "persons" in t and "identities" in t:
        member = t["persons"].select("person_id", F.explode("identity_ids").alias("_id")).join(t["identities"].select("_id", "ref"), "_id")
        edges.append(edge(member.where(~c("ref").startswith("contact:")), c("person_id"), "HAS_IDENTITY", c("_id")))
        owner = member.groupBy("ref").agg(F.min_by("person_id", "_id").alias("person_id"))
    return nodes, edges, owner


def _messages(t: dict[str, DataFrame], owner: DataFrame | None) -> tuple[list[DataFrame], list[DataFrame]]:
    c, msgs = F.col, t["messages"]
    conv_key = F.concat_ws(":", "provider", "conversation_id")
    talk = msgs.where("conversation_id is not null")
    conv = talk.groupBy(conv_key.alias("id")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("message_count"))
    nodes = [node(msgs, c("_id"), "Message", ts=c("ts"), provider=c("provider")), node(conv, c("id"), "Conversation", first_ts=c("first_ts"), last_ts=c("last_ts"), message_count=c("message_count"))]
    edges = [edge(talk, c("_id"), "IN_CONVERSATION", conv_key)]
    if owner is not None:
        sent = msgs.where("sender_ref <> ''").join(owner.withColumnRenamed("ref", "sender_ref"), "sender_ref", "left")
        lost = sent.where("person_id is null").select("sender_ref").distinct()
        nodes.append(node(lost, placeholder(c("sender_ref")), "Person", name=c("sender_ref"), unresolved=F.lit("true")))
        edges.append(edge(sent, c("_id"), "SENT_BY", F.coalesce("person_id", placeholder(c("sender_ref")))))
        edges.append(edge(sent.where("conversation_id is not null"), c("person_id"), "PARTICIPATED_IN", conv_key).distinct())
    reply = F.when(c("reply_to_id") != "", F.concat_ws(":", "provider", "reply_to_id"))
    root = F.when(reply.isNull() & (c("thread_root_id") != ""), F.concat_ws(":", "provider", "thread_root_id"))
    edges += [edge(msgs, c("_id"), "REPLY_TO", reply), edge(msgs, c("_id"), "THREAD_ROOT", root)]
    if "attachments" in msgs.columns:
        held = msgs.select("_id", "provider", F.explode("attachments").alias("a"))
        edges.append(edge(held, c("_id"), "ATTACHED_TO", F.concat_ws(":", "provider", "a.provider_file_id")))
    if "mentions" in t:
        edges.append(edge(t["mentions"], c("_id"), "MENTIONS", c("resolved_person_id")))
    if "deadlines" in t:
        event = F.concat(F.lit("evt_"), F.substring(F.sha2(F.concat_ws("|", "_id", "due"), 256), 1, 24))
        nodes.append(node(t["deadlines"].dropDuplicates(["_id", "due"]), event, "Event", due=c("due"), hardness=c("hardness"), cue=c("cue"), state=F.lit("advisory")))
        edges.append(edge(t["deadlines"], c("_id"), "PREDICTED_DUE", event))
    return nodes, edges


def project(tables: dict[str, DataFrame], workspace: str = "ws") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of canonical tables: a pure function of them. Edges to missing nodes and loops are left out.

    Edges run from what was made to what it belongs to: a message to its file, a file to its owner, a note to
    its author. ``mentions`` (_id, resolved_person_id) and ``deadlines`` (_id, due, hardness, cue) are optional.
    """
    c = F.col
    nodes, edges, owner = _people(tables)
    if "messages" in tables:
        more_nodes, more_edges = _messages(tables, owner)
        nodes, edges = nodes + more_nodes, edges + more_edges
    for name, label, by, kind in (("files", "File", "owner_ref", "OWNS"), ("notes", "Note", "author_ref", "AUTHORED")):
        if (t := tables.get(name)) is None:
            continue
        nodes.append(node(t, c("_id"), label, name=c("name") if "name" in t.columns else c("title")))
        if owner is not None and by in t.columns:
            edges.append(edge(t.join(owner.withColumnRenamed("ref", by), by), c("_id"), kind, c("person_id")))
        if "parent_id" in t.columns:
            edges.append(edge(t, c("_id"), "PART_OF", F.when(c("parent_id") != "", F.concat_ws(":", "provider", "parent_id"))))
    for name, label in (("videos", "Video"), ("transcripts", "Transcript")):
        if (t := tables.get(name)) is not None:
            nodes.append(node(t, c("_id"), label, title=c("title")))
            if name == "transcripts":
                edges.append(edge(t, F.concat_ws(":", "provider", "video_id"), "HAS_TRANSCRIPT", c("_id")))
    space = next(iter(tables.values())).sparkSession.createDataFrame([(f"ws:{workspace}",)], "id string")
    nodes.append(node(space, c("id"), "Workspace"))
    all_nodes = union(nodes).withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("label"))).where("_n = 1").drop("_n")
    all_edges = union(edges).where("src <> dst").dropDuplicates(["src", "type", "dst"])
    return all_nodes, among(all_edges, all_nodes)
