"""Property graph held as two tables.

nodes(node_id, class, text, properties map<string,string>, document_id, confidence)
edges(src, predicate, dst, confidence)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.text import keywords, stable_id
from lattica.operators.scoring import containment_kernel, top_matches
from lattica.operators.topk import first_per_group, top_k_per_group
from lattica.session import cut_lineage, plain_unions

# Keys of a node's properties that are never shown.
HIDDEN_PROPERTIES = ("text", "start", "end")
UNNAMED = "Unnamed"
# Default and largest size of an entity listing.
ENTITY_LIMIT, ENTITY_LIMIT_MAX = 100, 1000


def _within(limit: int) -> int:
    if limit > ENTITY_LIMIT_MAX:
        raise ValueError(f"at most {ENTITY_LIMIT_MAX} entities a listing")
    return limit


def display_name(properties: Column) -> Column:
    keys = ("text", "name", "label")
    return F.coalesce(*[F.try_element_at(properties, F.lit(k)) for k in keys], F.lit(UNNAMED))


def node_text(node_class: Column, text: Column, properties: Column) -> Column:
    """``[class] - text - key: value ...`` with the properties in key order."""
    shown = F.filter(
        F.array_sort(F.map_entries(properties)), lambda e: ~e["key"].isin(*HIDDEN_PROPERTIES)
    )
    described = F.transform(shown, lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.concat_ws(" - ", F.concat(F.lit("["), node_class, F.lit("]")), text, described)


def relation_text(subject: Column, predicate: Column, obj: Column) -> Column:
    return F.concat(subject, F.lit(" ["), predicate, F.lit("] "), obj)


def list_entities(
    nodes: DataFrame, node_class: str | None = None, search: str | None = None, limit: int = ENTITY_LIMIT
) -> DataFrame:
    """Entities of a class, or containing a text, or simply the first ones, by id."""
    if node_class is not None:
        nodes = nodes.filter(F.col("class") == node_class)
    elif search is not None:
        nodes = nodes.filter(F.contains(F.col("text"), F.lit(search)))
    return nodes.orderBy("node_id").limit(_within(limit))


def both_directions(edges: DataFrame) -> DataFrame:
    """Every edge as two steps (node_id -> neighbor)."""
    forward = edges.select(F.col("src").alias("node_id"), F.col("dst").alias("neighbor"))
    backward = edges.select(F.col("dst").alias("node_id"), F.col("src").alias("neighbor"))
    return forward.unionAll(backward)


def degrees(edges: DataFrame) -> DataFrame:
    """Relations per node, both ends counted; hubs shrink to one row per map task."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id"))
    return ends.groupBy("node_id").agg(F.count("*").alias("relation_count"))


def neighbors(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct (seed, neighbor) pairs one step away; `seeds` has (node_id)."""
    return (
        both_directions(edges)
        .join(seeds.select("node_id").distinct(), "node_id")
        .select(F.col("node_id").alias("seed"), "neighbor")
        .distinct()
    )


def reachable(seeds: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """(seed, node_id, hops): nodes within `depth` steps with their smallest distance.

    One equi-join per level.  A level holds each (seed, node) once, nodes seen
    before are removed by an anti-join, and from the third level on the level
    is checkpointed so that the plan does not repeat all earlier ones.
    """
    plain_unions(edges.sparkSession)
    steps = both_directions(edges)
    frontier = seeds.select(F.col("node_id").alias("seed"), "node_id").distinct()
    visited = frontier.withColumn("hops", F.lit(0).cast("bigint"))
    for hop in range(1, depth + 1):
        if hop > 2:
            visited = cut_lineage(visited)
            frontier = visited.filter(F.col("hops") == hop - 1).select("seed", "node_id")
        new = (
            frontier.join(steps, "node_id")
            .select("seed", F.col("neighbor").alias("node_id"))
            .distinct()
            .join(visited.select("seed", "node_id"), ["seed", "node_id"], "left_anti")
        )
        frontier = new
        # The explicit shuffle is the one the next anti-join needs.
        visited = visited.unionByName(new.withColumn("hops", F.lit(hop).cast("bigint")))
        if hop < depth:
            visited = visited.repartition("seed", "node_id")
    return visited


def incident_edges(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with at least one end among the ids.

    Two semi-joins instead of one join on a disjunction: the second only takes
    edges whose source is not among the ids, so no edge appears twice.
    """
    wanted = ids.select("node_id").distinct()
    by_src = edges.join(wanted.withColumnRenamed("node_id", "src"), "src", "left_semi")
    rest = edges.join(wanted.withColumnRenamed("node_id", "src"), "src", "left_anti")
    by_dst = rest.join(wanted.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    return by_src.select(*edges.columns).unionByName(by_dst.select(*edges.columns))


def induced_subgraph(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among the ids."""
    wanted = ids.select("node_id").distinct()
    return (
        edges.join(wanted.withColumnRenamed("node_id", "src"), "src", "left_semi")
        .join(wanted.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
        .select(*edges.columns)
    )


def edge_texts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges as text; an end without a node shows its id."""
    names = nodes.select("node_id", "text")
    return (
        edges.join(names.select(F.col("node_id").alias("src"), F.col("text").alias("_s")), "src", "left")
        .join(names.select(F.col("node_id").alias("dst"), F.col("text").alias("_o")), "dst", "left")
        .select(
            *edges.columns,
            relation_text(F.coalesce("_s", "src"), F.col("predicate"), F.coalesce("_o", "dst")).alias("content"),
        )
    )


def entity_details(ids: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Incoming and outgoing relations of the given nodes with the names of the other ends."""
    wanted = ids.select("node_id").distinct()
    names = nodes.select(F.col("node_id").alias("other_id"), F.col("text").alias("other_name"))
    outgoing = edges.select(F.col("src").alias("node_id"), "predicate", F.col("dst").alias("other_id"), F.lit("outgoing").alias("direction"))
    incoming = edges.select(F.col("dst").alias("node_id"), "predicate", F.col("src").alias("other_id"), F.lit("incoming").alias("direction"))
    sided = outgoing.unionAll(incoming).join(wanted, "node_id", "left_semi")
    return sided.join(names, "other_id", "left").select(
        "node_id", "direction", "predicate", "other_id", F.coalesce("other_name", "other_id").alias("other_name")
    )


def star_pattern(
    nodes: DataFrame, edges: DataFrame, node_class: str, first: str, second: str
) -> DataFrame:
    """Two-triple basic graph pattern: nodes of a class with both predicates, and the two objects."""
    centre = nodes.filter(F.col("class") == node_class).select("node_id")
    left = edges.filter(F.col("predicate") == first).select(F.col("src").alias("node_id"), F.col("dst").alias("first"))
    right = edges.filter(F.col("predicate") == second).select(F.col("src").alias("node_id"), F.col("dst").alias("second"))
    return centre.join(left, "node_id").join(right, "node_id")


def search(
    nodes: DataFrame,
    edges: DataFrame,
    questions: DataFrame,
    limit: int = 20,
    depth: int = 1,
    seed_limit: int | None = None,
    relation_limit: int | None = None,
) -> DataFrame:
    """Graph context per question: matching nodes, what they reach, and their relations.

    `questions` has (request_id, question).  Seeds are the nodes whose text
    holds most of the keywords.  The result (request_id, kind, hit_id, content,
    score) lists up to `seed_limit` seeds (half of `limit` by default), reached
    nodes by distance, and up to `relation_limit` relations (a quarter), at most
    `limit` rows per question.
    """
    seed_limit = max(1, limit // 2) if seed_limit is None else seed_limit
    relation_limit = limit // 4 if relation_limit is None else relation_limit
    near_limit = max(0, limit - seed_limit - relation_limit)
    plain_unions(nodes.sparkSession)
    terms = questions.select("request_id", F.array_distinct(keywords(F.col("question"))).alias("payload"))
    matched = top_matches(
        nodes.select(F.col("node_id").alias("item_id"), F.col("text").alias("payload")),
        terms,
        containment_kernel(),
        seed_limit,
    ).select("request_id", F.col("item_id").alias("node_id"), F.col("rank").cast("bigint").alias("seed_rank"))

    # A handful of rows per question from here on, used several times below:
    # written once instead of planned again in every branch.
    matched = cut_lineage(matched)
    steps = both_directions(edges)
    found = matched.withColumn("hops", F.lit(0).cast("bigint"))
    frontier = matched.select("request_id", "node_id")
    for hop in range(1, depth + 1):
        # So many nodes are known at most, and so many more can be listed:
        # a hub hands on no more neighbours than these.
        nearby = top_k_per_group(
            steps.join(frontier.select("node_id").distinct(), "node_id", "left_semi").distinct(),
            ["node_id"], [F.col("neighbor")], seed_limit + near_limit * hop, rank="_n",
        )
        reached = (
            frontier.join(nearby, "node_id")
            .select("request_id", F.col("neighbor").alias("node_id"))
            .distinct()
            .join(found.select("request_id", "node_id"), ["request_id", "node_id"], "left_anti")
        )
        # Nodes are listed by distance, so a level never contributes more than its share.
        reached = top_k_per_group(reached, ["request_id"], [F.col("node_id")], near_limit, rank="seed_rank").withColumn(
            "seed_rank", F.col("seed_rank").cast("bigint")
        )
        frontier = reached.select("request_id", "node_id")
        found = found.unionByName(reached.withColumn("hops", F.lit(hop).cast("bigint")))

    if depth > 1:
        nearest = top_k_per_group(found.filter("hops > 0"), ["request_id"], [F.col("hops"), F.col("seed_rank")], near_limit, rank="_n").drop("_n")
        found = found.filter("hops = 0").unionByName(nearest)
    found = cut_lineage(found)
    described = found.join(nodes, "node_id").select(
        "request_id",
        F.lit("node").alias("kind"),
        F.col("node_id").alias("hit_id"),
        node_text(F.col("class"), F.col("text"), F.col("properties")).alias("content"),
        F.coalesce("confidence", F.lit(0.5)).alias("score"),
        "hops",
        "seed_rank",
    )
    # The first `relation_limit` relations of each node suffice.
    inside = found.select("request_id", "node_id")
    order = [F.col("src"), F.col("predicate"), F.col("dst")]
    ends = edges.withColumn("node_id", F.explode(F.array_distinct(F.array("src", "dst"))))
    per_node = top_k_per_group(
        ends.join(inside.select("node_id").distinct(), "node_id", "left_semi"), ["node_id"], order, relation_limit, rank="_e"
    )
    touching = top_k_per_group(
        inside.join(per_node, "node_id").select("request_id", *edges.columns).distinct(), ["request_id"], order, relation_limit, rank="_n"
    )
    relations = edge_texts(touching, nodes).select(
        "request_id",
        F.lit("relation").alias("kind"),
        F.concat_ws("|", "src", "predicate", "dst").alias("hit_id"),
        "content",
        F.col("confidence").alias("score"),
        F.lit(None).cast("bigint").alias("hops"),
        F.col("_n").cast("bigint").alias("seed_rank"),
    )
    listed = described.unionByName(relations).filter(F.col("content") != "")
    order = [F.col("kind"), F.col("hops"), F.col("seed_rank"), F.col("hit_id")]
    return top_k_per_group(listed, ["request_id"], order, limit, rank="position").drop("hops", "seed_rank")


# --- loading approved extractions ---------------------------------------------


def load_nodes(mentions: DataFrame) -> DataFrame:
    """One node per distinct text of a document, described by its first mention.

    `mentions` has (document_id, text, entity_type, start, end, confidence).
    """
    first = first_per_group(
        mentions.select("document_id", "text", "entity_type", "start", "end", "confidence"),
        ["document_id", "text"],
        [F.col("start"), -F.col("confidence"), F.col("entity_type"), F.col("end")],
    )
    return first.select(
        stable_id(F.col("document_id"), F.col("text")).alias("node_id"),
        F.col("entity_type").alias("class"),
        "text",
        F.create_map(
            F.lit("text"), F.col("text"),
            F.lit("start"), F.col("start").cast("string"),
            F.lit("end"), F.col("end").cast("string"),
        ).alias("properties"),
        "document_id",
        F.col("confidence").cast("double").alias("confidence"),
    )


def load_edges(relations: DataFrame, nodes: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Edges of relations both of whose ends were loaded for the same document.

    `relations` has (document_id, subject, predicate, object, confidence); the
    columns `carry` follow the edges.
    """
    names = nodes.select("document_id", F.col("text"), "node_id")
    subjects = names.select("document_id", F.col("text").alias("subject"), F.col("node_id").alias("src"))
    objects = names.select("document_id", F.col("text").alias("object"), F.col("node_id").alias("dst"))
    return (
        relations.join(subjects, ["document_id", "subject"])
        .join(objects, ["document_id", "object"])
        .select("document_id", "src", "predicate", "dst", "confidence", *(carry or []))
    )


def load_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows loaded per document."""
    entities = nodes.groupBy("document_id").agg(F.count("*").alias("entities_loaded"))
    relations = edges.groupBy("document_id").agg(F.count("*").alias("relations_loaded"))
    joined = entities.join(relations, "document_id", "left")
    return joined.withColumn("relations_loaded", F.coalesce("relations_loaded", F.lit(0)).cast("bigint"))
