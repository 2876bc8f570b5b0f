"""Walking the link graph, its edges, relations and merges of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..runtime import cut
from ..settings import ExclusionRule, WalkSettings


def exclusion(rules: tuple[ExclusionRule, ...], is_seed: Column, types: dict[str, str]) -> Column:
    """Label of the first rule that excludes a card; null if none.

    ``types`` maps the columns of the cards to Spark types. Explicit ids hold for every card;
    the other criteria skip seeds unless a rule says otherwise. A missing value counts as not listed.
    """
    found = F.lit(None).cast("string")
    for number, rule in reversed(list(enumerate(rules, 1))):
        label = F.lit(rule.reason or f"rule {number}")
        meets = F.lit(False)
        if rule.type_names:
            meets = meets | F.coalesce(F.col("type_name").isin(*rule.type_names), F.lit(False))
        if rule.doc_type_titles:
            meets = meets | F.coalesce(F.lower("doc_type_title").isin(*[t.lower() for t in rule.doc_type_titles]), F.lit(False))
        if rule.field and rule.field in types:
            value = F.lower(F.col(rule.field).cast("string"))
            listed = F.coalesce(value.isin(*[v.lower() for v in rule.values]), F.lit(False))
            meets = meets | (~listed if rule.none_of else listed)
        if not rule.applies_to_seed:
            meets = meets & ~is_seed
        if rule.card_ids:
            meets = meets | F.col("card_id").isin(*rule.card_ids)
        found = F.when(meets, label).otherwise(found)
    return found


def walk(seeds: DataFrame, links: DataFrame, cards: DataFrame, settings: WalkSettings = WalkSettings()) -> dict[str, DataFrame]:
    """Breadth-first walk from ``seeds(card_id, pos)`` over ``links(card_id, other_id, direction, ref_type, pos)``.

    Returns ``nodes(card_id, depth, seq, status, reason)`` with status ``card``, ``excluded`` or
    ``error`` (no such card), ``entry_paths`` and ``skipped_links``. A level is one join of the
    frontier with the links, reduced to the first way to each new card, so hubs cost one row per
    card; only ``max_docs`` rows are ever put in a global order. Levels are written and reread.
    """
    direction = F.array_position(F.array(*map(F.lit, settings.directions)), F.col("direction"))
    used = links.where(F.col("direction").isin(*settings.directions)).withColumn("d", direction)
    has = cards.withColumn("known", F.lit(True))
    first = seeds.groupBy("card_id").agg(F.min("pos").alias("k"))

    def number(rows: DataFrame, depth: int, before: int) -> DataFrame:
        order = Window.partitionBy(F.lit(0)).orderBy("k")
        placed = rows.orderBy("k").limit(max(0, settings.max_docs - before)).withColumn("seq", F.row_number().over(order) + before)
        met = placed.join(has, "card_id", "left")
        label = exclusion(settings.rules, F.lit(depth == 0), dict(cards.dtypes))
        status = F.when(F.col("known").isNull(), F.lit("error")).when(label.isNotNull(), F.lit("excluded")).otherwise(F.lit("card"))
        return cut(met.select("card_id", F.lit(depth).alias("depth"), "seq", status.alias("status"), F.when(status == "excluded", label).alias("reason")))

    nodes = level = number(first, 0, 0)
    total = level.count()
    for depth in range(1, settings.max_depth + 1):
        ways = level.where("status = 'card'").select("card_id", "seq").join(used, "card_id").where("other_id <> card_id")
        new = ways.groupBy(F.col("other_id").alias("card_id")).agg(F.min(F.struct("seq", "d", "pos")).alias("k")).join(nodes, "card_id", "left_anti")
        level = number(new, depth, total)
        found = level.count()
        if not found:
            break
        total += found
        nodes = cut(nodes.unionByName(level))

    parents = nodes.select("card_id", "depth", "status", "reason")
    looked = parents.where("status in ('card', 'excluded')").join(used, "card_id")
    target = nodes.select(F.col("card_id").alias("t_id"), F.lit(True).alias("taken"))
    judged = looked.join(target, F.col("other_id") == F.col("t_id"), "left")
    followed = judged.where("status = 'card' and other_id <> card_id")
    paths = followed.where("taken").select(F.col("other_id").alias("card_id"), F.lit("link").alias("kind"), (F.col("depth") + 1).alias("depth"), F.col("card_id").alias("via_id"), "ref_type", "direction")
    roots = seeds.join(nodes.select("card_id"), "card_id", "left_semi")
    paths = paths.unionByName(roots.select("card_id", F.lit("seed").alias("kind"), F.lit(0).alias("depth"), F.lit(None).cast(dict(nodes.dtypes)["card_id"]).alias("via_id"), F.lit(None).cast("string").alias("ref_type"), F.lit(None).cast("string").alias("direction")))
    cause = F.when(F.col("depth") + 1 > settings.max_depth, F.lit("max_depth")).otherwise(F.lit("max_docs"))
    skipped = followed.where("taken is null").select("card_id", "other_id", "direction", "ref_type", cause.alias("reason"))
    skipped = skipped.unionByName(judged.where("status = 'excluded'").select("card_id", "other_id", "direction", "ref_type", F.lit("excluded").alias("reason")))
    return {"nodes": nodes, "entry_paths": paths, "skipped_links": skipped}


def edges(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """``from_id, to_id, relation_type, reverse_type, source, dangling``: one edge per ordered pair.

    An edge with a type beats one without, then the first found wins. Incoming links say nothing
    of the type. An edge dangles if an end is no visited card.
    """
    visited = nodes.where("status = 'card'").select("card_id", "seq")
    rows = links.join(visited, "card_id")
    out = F.col("direction") == "outgoing"
    found = rows.select(
        F.when(out, F.col("card_id")).otherwise(F.col("other_id")).alias("from_id"), F.when(out, F.col("other_id")).otherwise(F.col("card_id")).alias("to_id"),
        F.when(out, F.col("ref_type")).alias("relation_type"), F.when(out, F.col("reverse_type")).alias("reverse_type"), F.col("direction").alias("source"),
        F.struct("seq", (~out).cast("int").alias("d"), "pos").alias("k"),
    )
    return split_edges(first_typed(found), visited)


def first_typed(found: DataFrame) -> DataFrame:
    """One row of ``(from_id, to_id)``: with a type if any has, then the smallest ``k``."""
    best = found.groupBy("from_id", "to_id").agg(F.min_by(F.struct("relation_type", "reverse_type", "source"), F.struct(F.col("relation_type").isNull(), F.col("k"))).alias("e"))
    return best.select("from_id", "to_id", "e.relation_type", "e.reverse_type", "e.source")


def split_edges(rows: DataFrame, inside: DataFrame) -> DataFrame:
    """``rows`` with ``dangling``: whether an end is not among ``inside(card_id)``."""
    a = inside.select(F.col("card_id").alias("from_id"), F.lit(True).alias("has_from")).distinct()
    b = inside.select(F.col("card_id").alias("to_id"), F.lit(True).alias("has_to")).distinct()
    met = rows.drop("dangling").join(a, "from_id", "left").join(b, "to_id", "left")
    return met.withColumn("dangling", F.col("has_from").isNull() | F.col("has_to").isNull()).drop("has_from", "has_to")


def incoming_types(incoming: DataFrame, graph: DataFrame) -> DataFrame:
    """Incoming rows ``(card_id, other_id, pos)`` with the relation that the source's outgoing edge gives.

    The reverse name counts, else the forward one; of repeated edges the last (largest ``pos``).
    """
    out = graph.where("source = 'outgoing'").groupBy("from_id", "to_id").agg(F.max_by(F.coalesce("reverse_type", "relation_type"), F.col("pos")).alias("relation"))
    return incoming.join(out, (F.col("other_id") == F.col("from_id")) & (F.col("card_id") == F.col("to_id")), "left").select("card_id", "other_id", "pos", "relation")


def related_documents(links: DataFrame, relation: str | None = None) -> DataFrame:
    """``card_id, other_id, direction, relation, resolved``: both directions of every card.

    An incoming row without a type takes that of its source's first outgoing link back. The filter
    ignores case and blanks at the ends.
    """
    out = links.where("direction = 'outgoing'")
    first = out.groupBy("card_id", "other_id").agg(F.min_by(F.coalesce("reverse_type", "ref_type"), F.col("pos")).alias("back"))
    first = first.select(F.col("card_id").alias("src"), F.col("other_id").alias("dst"), "back", F.lit(True).alias("met"))
    given = F.coalesce("reverse_type", "ref_type")
    into = links.where("direction = 'incoming'").join(first, (F.col("other_id") == F.col("src")) & (F.col("card_id") == F.col("dst")), "left")
    into = into.select("card_id", "other_id", "direction", F.coalesce(given, F.col("back")).alias("relation"), (given.isNull() & F.coalesce("met", F.lit(False))).alias("resolved"))
    both = out.select("card_id", "other_id", "direction", F.col("ref_type").alias("relation"), F.lit(False).alias("resolved")).unionByName(into)
    if relation is None:
        return both
    return both.where(F.trim(F.lower(F.coalesce("relation", F.lit("")))) == relation.strip().lower())


def relation_types(related: DataFrame) -> DataFrame:
    """``card_id, types``: the sorted distinct relation types of each card."""
    return related.groupBy("card_id").agg(F.sort_array(F.collect_set("relation")).alias("types"))


def merge_documents(previous: DataFrame, current: DataFrame) -> DataFrame:
    """All documents, those of the current run in place of the previous ones."""
    return previous.join(current.select("card_id"), "card_id", "left_anti").unionByName(current)


def merge_leftovers(previous: DataFrame, current: DataFrame, touched: DataFrame, key: str) -> DataFrame:
    """Exclusions, errors or skipped links: the old ones only of cards that the current run did not touch."""
    return previous.join(touched.select(F.col("card_id").alias(key)).distinct(), key, "left_anti").unionByName(current)


def merge_graphs(previous: DataFrame, current: DataFrame, inside: DataFrame) -> DataFrame:
    """The edges of two runs, old ones first, of which the first with a type wins; split anew by ``inside``."""
    rows = previous.withColumn("k", F.struct(F.lit(0).alias("run"), "dangling", "pos")).unionByName(current.withColumn("k", F.struct(F.lit(1).alias("run"), "dangling", "pos")))
    return split_edges(first_typed(rows), inside)


def new_ids(requested: DataFrame, stored: DataFrame) -> DataFrame:
    """``card_id, pos``: requested ids that aren't stored, each at its first place."""
    return requested.groupBy("card_id").agg(F.min("pos").alias("pos")).join(stored.select("card_id"), "card_id", "left_anti")


def merged_seeds(previous: DataFrame, current: DataFrame) -> DataFrame:
    """``card_id, run, pos``: ids of both runs, each at its first place."""
    rows = previous.select("card_id", F.lit(0).alias("run"), "pos").unionByName(current.select("card_id", F.lit(1).alias("run"), "pos"))
    return rows.groupBy("card_id").agg(F.min(F.struct("run", "pos")).alias("k")).select("card_id", "k.run", "k.pos")


def entry_via(documents: DataFrame, paths: DataFrame) -> DataFrame:
    """``card_id, origin, relation``: how each document came into the set: as a seed, or by its first path."""
    first = paths.groupBy("card_id").agg(F.bool_or(F.col("kind") == "seed").alias("seed"), F.min_by(F.struct("via_id", "ref_type"), F.col("pos")).alias("p"))
    parent = documents.select(F.col("card_id").alias("d_id"), F.concat("doc_kind", F.lit(" №"), F.coalesce("number", F.lit("?"))).alias("label"))
    met = first.join(parent, F.col("p.via_id") == F.col("d_id"), "left")
    return met.select(
        "card_id",
        F.when(F.col("seed"), F.lit("seed")).otherwise(F.coalesce("label", F.col("p.via_id").cast("string"), F.lit(""))).alias("origin"),
        F.when(F.col("seed"), F.lit("")).otherwise(F.coalesce("p.ref_type", F.lit("untyped"))).alias("relation"),
    )


def links_complete(graph: DataFrame, documents: DataFrame, excluded: DataFrame, errors: DataFrame, skipped: DataFrame) -> DataFrame:
    """One row ``status, unexplained, inside, skipped, limits``: dangling edges need a known reason.

    FAIL if one has none; WARN if links were skipped for a limit; else PASS.
    """
    known = documents.select("card_id").unionByName(excluded.select("card_id")).unionByName(errors.select("card_id")).unionByName(skipped.select(F.col("other_id").alias("card_id"))).distinct()
    loose = graph.where("dangling")
    open_ = loose.join(known.withColumnRenamed("card_id", "from_id"), "from_id", "left_anti").unionByName(
        loose.join(known.withColumnRenamed("card_id", "from_id"), "from_id", "left_semi").join(known.withColumnRenamed("card_id", "to_id"), "to_id", "left_anti")
    )
    counts = open_.select(F.lit("unexplained").alias("what")).unionByName(graph.where("not dangling").select(F.lit("inside").alias("what")))
    counts = counts.unionByName(skipped.select(F.lit("skipped").alias("what"))).unionByName(skipped.where("reason in ('max_depth', 'max_docs')").select(F.lit("limits").alias("what")))
    row = counts.agg(*[F.count_if(F.col("what") == w).alias(w) for w in ("unexplained", "inside", "skipped", "limits")])
    return row.select(F.when(F.col("unexplained") > 0, "FAIL").when(F.col("limits") > 0, "WARN").otherwise("PASS").alias("status"), "*")
