"""Similar signatures as one template, within a tree of bounded width, over many runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logsheaf.config import DRAIN_CHILDREN, DRAIN_SIMILARITY, WILDCARD
from logsheaf.operators.components import connected_components
from logsheaf.operators.ranking import with_position
from logsheaf.schemas import TEMPLATE, TEMPLATE_ALIAS
from logsheaf.session import materialize

# A signature is listed under at most so many sets of its shared items at once.
KEYS = 128


def with_leaf(signatures: DataFrame, prefix_tokens: int = 1, max_children: int = DRAIN_CHILDREN) -> DataFrame:
    """Adds ``leaf``, the place of each signature in a tree of bounded width.

    The tree parts signatures by their number of tokens, then token by token
    for the first ``prefix_tokens``. Below each node the tokens seen first (ties by
    text) keep a child of their own, all others share that of the wildcard,
    so that there are at most ``max_children``; wildcards go there anyway. The
    first ones stay so when later runs add signatures.

    Only the (node, token) pairs are ranked, and ranks beyond the limit are
    dropped ahead of the shuffle; signatures are not gathered.
    """
    tokens = F.split("signature", " ")
    placed = signatures.withColumn("leaf", F.size(tokens).cast("string"))
    for depth in range(prefix_tokens):
        token = F.coalesce(F.get(tokens, F.lit(depth)), F.lit(""))
        placed = placed.withColumn("_token", token)
        children = (
            placed.where(F.col("_token") != WILDCARD)
            .groupBy("leaf", "_token")
            .agg(F.min("first_seen").alias("_seen"))
        )
        order = W.partitionBy("leaf").orderBy("_seen", "_token")
        kept = (
            children.withColumn("_rank", F.row_number().over(order))
            .where(F.col("_rank") < max_children)
            .select("leaf", "_token", F.lit(True).alias("_kept"))
        )
        child = F.when(F.col("_kept"), F.col("_token")).otherwise(WILDCARD)
        placed = (
            placed.join(kept, ["leaf", "_token"], "left")
            .withColumn("leaf", F.concat_ws(" ", "leaf", child))
            .drop("_token", "_kept")
        )
    return placed


def _list_length(places: Column, needed: Column) -> Column:
    """How many items of a set of ``needed`` may be listed at once, within ``KEYS`` sets."""
    rest = places - needed

    def grown(state: Column, size: Column) -> Column:
        sets = state["sets"] * (rest + size) / size
        fits = (state["size"] == size - 1) & (sets <= KEYS)
        return F.struct(
            F.when(fits, sets).otherwise(state["sets"]).alias("sets"),
            F.when(fits, size).otherwise(state["size"]).alias("size"),
        )

    start = F.struct(F.lit(1.0).alias("sets"), F.lit(0).alias("size"))
    # One item at least, however many places there are.
    size = F.aggregate(F.sequence(F.lit(1), needed), start, grown, lambda state: state["size"])
    return F.greatest(size, F.lit(1))


def _longer(state: Column, size: Column) -> Column:
    """A list (key, at) with each later item that makes it ``size`` long and still leaves enough."""
    return F.transform(
        F.sequence(state["at"] + 1, F.size("items") - F.col("needed") + size),
        lambda place: F.struct(
            F.concat(state["key"], F.array(F.element_at("items", place))).alias("key"), place.alias("at")
        ),
    )


def _listed(base: DataFrame) -> DataFrame:
    """Every node under each of its sets of ``length`` items."""
    start = F.array(F.struct(F.array().cast("array<bigint>").alias("key"), F.lit(0).alias("at")))
    lists = F.aggregate(
        F.sequence(F.lit(1), F.col("length")),
        start,
        lambda lists, size: F.flatten(F.transform(lists, lambda state: _longer(state, size))),
    )
    return base.select("*", F.inline(lists))


def similar_links(rows: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between nodes that connect the same ones as all similar pairs do.

    ``rows`` (node, leaf, tokens, fresh) are read from a written table. Nodes of one leaf
    and length are similar where at least the share ``similarity`` of their
    places holds the same token, wildcards aside. Pairs of nodes of which none
    is fresh are passed over.

    Similar nodes have a set of as many equal (place, token) items as are
    needed, so each node is listed under the sets of its shared items, and all
    nodes of a set are linked to its first. Where that would be too many sets,
    it is listed under smaller ones; their nodes are compared with the first,
    and only sets that still hold unconnected nodes are listed with one item
    more. No pairs of a list are formed, and none is gathered.
    """
    needed = F.greatest(F.ceil(F.col("places") * similarity), F.lit(1)).cast("int")
    items = rows.select(
        "node", "leaf", "fresh", F.size("tokens").alias("places"), F.posexplode("tokens").alias("place", "token")
    ).where(F.col("token") != WILDCARD)
    numbered = materialize(
        items.groupBy("leaf", "places", "place", "token")
        .agg(F.count("*").alias("f"), F.max("fresh").alias("fresh"))
        .where((F.col("f") > 1) & F.col("fresh"))
        .drop("fresh")
        .withColumn("item", F.monotonically_increasing_id())
    )
    base = (
        items.join(numbered, ["leaf", "places", "place", "token"])
        .groupBy("node", "fresh", "places")
        .agg(F.array_sort(F.collect_list(F.struct("f", "item"))).alias("_items"))
        .withColumn("needed", needed)
        .where(F.size("_items") >= F.col("needed"))
        .select(
            "node",
            "fresh",
            "needed",
            _list_length(F.col("places"), F.col("needed")).alias("length"),
            F.transform("_items", lambda i: i["item"]).alias("items"),
        )
    )
    # How many items the longest messages still lack in their lists.
    lacking = rows.select(F.size("tokens").alias("places")).distinct().withColumn("needed", needed).agg(
        F.max(F.col("needed") - _list_length(F.col("places"), F.col("needed")))
    )
    unfinished = lacking.first()[0] or 0
    if unfinished > 0:
        base = materialize(base)
    listed, found = _listed(base), None
    while True:
        listed = materialize(listed)
        firsts = (
            listed.groupBy("key")
            .agg(F.min("node").alias("first"), F.max("node").alias("_last"), F.max("fresh").alias("_fresh"))
            .where((F.col("first") != F.col("_last")) & F.col("_fresh"))
            .select("key", "first")
        )
        pairs = listed.join(firsts, "key").where(F.col("node") != F.col("first"))
        if unfinished > 0:
            other = base.select(F.col("node").alias("first"), F.col("items").alias("_items"))
            whole = F.size("key") == F.col("needed")
            alike = F.size(F.array_intersect("items", "_items")) >= F.col("needed")
            pairs = pairs.join(other, "first").where(whole | alike)
        links = pairs.select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
        if unfinished > 0:
            links = materialize(links)
        found = links if found is None else found.unionByName(links)
        if unfinished <= 0:
            return found
        # Sets that hold nodes of several components go on with one item more.
        labels = connected_components(found)
        open_ = listed.where(F.size("key") < F.col("needed")).join(labels, "node", "left").withColumn(
            "component", F.coalesce("component", "node")
        )
        mixed = (
            open_.groupBy("key")
            .agg(F.min("component").alias("_least"), F.max("component").alias("_most"), F.max("fresh").alias("_fresh"))
            .where((F.col("_least") != F.col("_most")) & F.col("_fresh"))
            .select("key")
        )
        rest = open_.drop("component").join(mixed, "key", "left_semi").select(*listed.columns)
        longer = _longer(F.struct("key", "at"), F.size("key") + 1)
        listed = rest.withColumn("_next", F.explode(longer)).withColumns(
            {"key": F.col("_next.key"), "at": F.col("_next.at")}
        ).drop("_next")
        unfinished -= 1


def _texts(members: DataFrame, group: str) -> DataFrame:
    """(group, template): equal places keep their token, the others are wildcards."""
    places = (
        members.select(group, F.posexplode(F.split("signature", " ")).alias("place", "token"))
        .groupBy(group, "place")
        .agg(F.min("token").alias("least"), F.max("token").alias("most"))
        .withColumn("token", F.when(F.col("least") == F.col("most"), F.col("least")).otherwise(WILDCARD))
    )
    listed = places.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("place", "token"))).alias("_places"))
    return listed.select(
        group, F.array_join(F.transform("_places", lambda p: p["token"]), " ").alias("template")
    )


def resolved(templates: DataFrame, aliases: DataFrame) -> DataFrame:
    """``templates`` under present ids and with the present texts of their clusters.

    An id that met an older one reads as the oldest it ever met; the stored id
    stays valid in stored sessions, and ``aliases`` leads from it.
    """
    present = aliases.groupBy("template_id").agg(F.min("merged_into").alias("_into"))
    named = templates.join(present, "template_id", "left").withColumn(
        "template_id", F.coalesce("_into", "template_id")
    )
    texts = _texts(named, "template_id").withColumnRenamed("template", "_text")
    return (
        named.join(texts, "template_id")
        .withColumn("template", F.col("_text"))
        .select(*TEMPLATE.fieldNames())
        .to(TEMPLATE)
    )


def merge_similar(
    signatures: DataFrame,
    similarity: float = DRAIN_SIMILARITY,
    prefix_tokens: int = 1,
    max_children: int = DRAIN_CHILDREN,
) -> DataFrame:
    """Templates after merging similar signatures, as TEMPLATE rows.

    What similar pairs of one leaf connect is one template: places that differ
    become wildcards, and its id follows the earliest member. The result
    depends neither on order nor on the number of signatures.
    """
    return extend_merged(signatures, None, None, similarity, prefix_tokens, max_children)[0]


def extend_merged(
    signatures: DataFrame,
    known: DataFrame | None,
    aliases: DataFrame | None,
    similarity: float = DRAIN_SIMILARITY,
    prefix_tokens: int = 1,
    max_children: int = DRAIN_CHILDREN,
) -> tuple[DataFrame, DataFrame]:
    """Templates of the signatures that ``known`` lacks, and aliases of ids that met.

    Stored signatures keep their ids. A new one joins the cluster that similar
    pairs connect it to; where they connect several, the smallest id names all,
    and the others become its aliases. Other clusters get ids after the
    largest, by first appearance. Pairs of stored signatures were compared
    before: their clusters enter as they are, and only lists that hold new
    signatures are looked at.
    """
    spark = signatures.sparkSession
    columns = ("signature", "first_seen", "n_events", "template_id")
    rows = signatures.withColumn("template_id", F.lit(None).cast("int")).select(*columns)
    highest = 0
    if known is not None:
        present = aliases.groupBy("template_id").agg(F.min("merged_into").alias("_into"))
        old = known.join(present, "template_id", "left").withColumn(
            "template_id", F.coalesce("_into", "template_id")
        )
        rows = rows.join(known.select("signature"), "signature", "left_anti").unionByName(old.select(*columns))
        highest = known.agg(F.coalesce(F.max("template_id"), F.lit(0))).first()[0]
    rows = materialize(rows.withColumn("node", F.monotonically_increasing_id()))
    placed = with_leaf(rows, prefix_tokens, max_children).select(
        "node", "leaf", F.split("signature", " ").alias("tokens"), F.col("template_id").isNull().alias("fresh")
    )
    links = similar_links(placed, similarity)
    if known is not None:
        stored = rows.where(F.col("template_id").isNotNull()).select("node", "template_id")
        heads = stored.groupBy("template_id").agg(F.min("node").alias("a"))
        links = links.unionByName(
            stored.join(heads, "template_id").where(F.col("a") != F.col("node")).select("a", F.col("node").alias("b"))
        )
    labels = connected_components(links)
    members = materialize(
        rows.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    )
    groups = members.groupBy("component").agg(
        F.min("template_id").alias("oldest"),
        F.count_if(F.col("template_id").isNull()).alias("new"),
        F.min(F.struct("first_seen", "signature")).alias("leader"),
    ).where(F.col("new") > 0)
    ranked = with_position(
        groups.where(F.col("oldest").isNull()).select("component", "leader.first_seen", "leader.signature"),
        F.col("first_seen"),
        F.col("signature"),
    ).select("component", (F.col("position") + highest + 1).cast("int").alias("_new"))
    ids = groups.join(ranked, "component", "left").select("component", F.coalesce("oldest", "_new").alias("_id"))
    touched = materialize(members.join(ids, "component"))
    texts = _texts(touched, "component")
    fresh = (
        touched.where(F.col("template_id").isNull())
        .join(texts, "component")
        .withColumn("template_id", F.col("_id"))
        .withColumn("n_tokens", F.size(F.split("signature", " ")))
        .select(*TEMPLATE.fieldNames())
        .to(TEMPLATE)
    )
    met = (
        touched.where(F.col("template_id") > F.col("_id"))
        .select("template_id", F.col("_id").alias("merged_into"))
        .distinct()
    )
    if known is None:
        return fresh, spark.createDataFrame([], TEMPLATE_ALIAS)
    # Ids that were aliases of one that now met another lead on to it as well.
    onward = aliases.join(met.select(F.col("template_id").alias("merged_into"), F.col("merged_into").alias("_on")), "merged_into")
    return fresh, met.unionByName(onward.select("template_id", F.col("_on").alias("merged_into"))).to(TEMPLATE_ALIAS)
