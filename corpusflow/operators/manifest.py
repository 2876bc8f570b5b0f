"""Statuses, kinds, statistics, checks and listings of a document set."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.text import date_or_null, document_label, int_or_null, text_or_null
from ..settings import CardSections, ChunkSettings, CoverageRules, StatusRules


def resolve_status(status_id: Column, state_id: Column, rules: StatusRules = StatusRules()) -> Column:
    """``cancelled`` by status id or state, else ``active`` by state, else ``draft``; nulls match nothing."""
    cancelled = F.coalesce(F.lower(status_id).isin(*rules.cancelled_status_ids), F.lit(False)) | F.coalesce(state_id.isin(*rules.cancelled_state_ids), F.lit(False))
    return F.when(cancelled, F.lit("cancelled")).when(state_id.isin(*rules.active_state_ids), F.lit("active")).otherwise(F.lit("draft"))


def card_metadata(cards: DataFrame, fallback_kind: str = "Без вида", rules: StatusRules = StatusRules()) -> DataFrame:
    """Document fields of cards through their fallbacks: kind, number, date, status, label."""
    kind = F.coalesce(text_or_null(F.col("doc_type_title")), text_or_null(F.col("type_name")), F.lit(fallback_kind))
    number = F.coalesce(text_or_null(F.col("full_number")), text_or_null(F.col("secondary_number")))
    date = F.coalesce(F.col("doc_date"), F.col("creation_date"))
    return cards.select(
        "card_id", kind.alias("doc_kind"), number.alias("doc_number"), date.alias("doc_date"), F.unix_seconds(date.cast("timestamp")).alias("doc_date_ts"),
        resolve_status(F.col("status_id"), F.col("state_id"), rules).alias("doc_status"), text_or_null(F.col("department")).alias("department"),
        text_or_null(F.col("subject")).alias("subject"), document_label(kind, number, date).alias("label"),
    )


def from_sections(cards: DataFrame, section: str = "Common", keep: tuple[str, ...] = ()) -> DataFrame:
    """Flat card columns out of ``sections MAP<STRING, STRUCT<fields MAP<STRING, STRING>, ..>>``, and those to ``keep``."""
    field = lambda name: F.try_element_at(F.try_element_at(F.col("sections"), F.lit(section))["fields"], F.lit(name))
    return cards.select(
        F.col("id").alias("card_id"), "type_name", field("DocTypeTitle").alias("doc_type_title"), field("FullNumber").alias("full_number"),
        field("SecondaryFullNumber").alias("secondary_number"), date_or_null(field("DocDate")).alias("doc_date"), date_or_null(field("CreationDate")).alias("creation_date"),
        field("StatusID").alias("status_id"), int_or_null(field("StateID")).alias("state_id"), field("DepartmentName").alias("department"), field("Subject").alias("subject"), *keep,
    )


def document_fields(cards: DataFrame, relations: DataFrame | None = None, fallback_kind: str = "Без вида", rules: StatusRules = StatusRules(), sections: CardSections = CardSections(), keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per card, read out of its sections, with all fields that its chunks carry, and its own columns to ``keep``.

    Kind, number, date, approval state and author fall back on one another; names come from the
    rows of their sections. ``relations(card_id, direction, pos, doc_id, relation, doc_type)`` are
    listed outgoing ones first, each in their order. A card's list is one value; where a card may have
    millions of relations, ``relations_md5`` reads them in this order without a list.
    """
    # a generated column is computed once per row, however many fields are read out of it
    cards = cards.select(*[c for c in cards.columns if c != "sections"], F.explode(F.array("sections")).alias("sections"))
    none = F.lit(None).cast("string")
    part = lambda section: F.try_element_at(F.col("sections"), F.lit(section))
    common = lambda name: text_or_null(F.try_element_at(part(sections.common)["fields"], F.lit(name)))
    approval = lambda name: text_or_null(F.try_element_at(part(sections.approval)["fields"], F.lit(name)))

    def names(section: str, column: str) -> Column:
        found = F.transform(part(section)["rows"], lambda r: text_or_null(F.try_element_at(r, F.lit(column))))
        return F.coalesce(F.filter(found, lambda n: n.isNotNull()), F.array().cast("array<string>"))

    title, number = F.coalesce(common("DocTypeTitle"), text_or_null(F.col("type_caption")), F.lit(fallback_kind)), F.coalesce(common("FullNumber"), common("SecondaryFullNumber"))
    date, state = F.coalesce(date_or_null(common("DocDate")), date_or_null(common("CreationDate"))), int_or_null(common("StateID"))
    approval_state = F.coalesce(approval("StateName"), common("StateName"))
    approval_id = F.coalesce(int_or_null(approval("StateID")), F.when(approval("StateName").isNull(), state))
    named = F.try_element_at(F.create_map(*[F.lit(v) for pair in sections.state_names for v in pair]), approval_id) if sections.state_names else none
    rows = cards.select(
        F.col("id").alias("doc_id"), F.col("type_name").alias("card_type_name"), F.col("type_caption").alias("card_type_caption"), title.alias("doc_kind"), number.alias("doc_number"), date.alias("doc_date"),
        F.unix_seconds(date.cast("timestamp")).alias("doc_date_ts"), resolve_status(common("StatusID"), state, rules).alias("doc_status"), common("StatusNameStatus").alias("doc_status_name"),
        state.alias("state_id"), common("StateName").alias("state_name"), approval_state.alias("approval_state"), F.coalesce(named, approval_state).alias("approval_state_name"),
        common("DepartmentName").alias("department"), common("DepartmentID").alias("department_id"), F.coalesce(common("AuthorName"), common("RegistratorName"), text_or_null(F.col("created_by_name"))).alias("author"),
        F.array().cast("array<string>").alias("acl_groups"), common("Subject").alias("subject"), common("Comment").alias("comment"), common("SignedByName").alias("signed_by"),
        names(sections.directions, "DirectionActivityName").alias("direction_activity"), names(sections.approvers, "UserName").alias("approvers"), names(sections.responsible, "UserName").alias("responsible"),
        common("ValidityPeriod").alias("validity_period"), int_or_null(F.col("version").cast("string")).alias("card_version"), F.col("modified").alias("card_modified"), document_label(title, number, date).alias("label"), *keep,
    )
    shape = "array<struct<doc_id:string,relation:string,direction:string,doc_type:string>>"
    if relations is None:
        return rows.withColumn("relations", F.array().cast(shape))
    one = F.struct(F.when(F.col("direction") == "outgoing", 0).otherwise(1).alias("d"), "pos", F.struct(F.col("doc_id").cast("string").alias("doc_id"), "relation", "direction", "doc_type").alias("r"))
    listed = relations.groupBy(F.col("card_id").cast("string").alias("doc_id")).agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["r"]).alias("relations"))
    return rows.join(listed, "doc_id", "left").withColumn("relations", F.coalesce(F.col("relations").cast(shape), F.array().cast(shape)))


def relations_md5(relations: DataFrame, line: Column, separator: str = ",") -> DataFrame:
    """``card_id, relations_md5``: MD5 of a card's relations, each told by ``line``, joined in the order of ``document_fields``.

    Relations are sorted by Spark and hashed as they pass: those of one card are never held together, however many it has.
    """
    rows = relations.select("card_id", "direction", "pos", "doc_id", "relation", "doc_type").where("card_id is not null").repartition("card_id")
    outgoing = F.when(F.col("direction") == "outgoing", 0).otherwise(1)
    placed = rows.select("*", outgoing.alias("d"), F.col("doc_id").cast("string").alias("doc")).sortWithinPartitions("card_id", "d", "pos", "doc", "relation", "direction", "doc_type")
    told = placed.select("card_id", line.alias("line")).where("line is not null")
    between = separator.encode()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, hashlib.md5()
        for batch in batches:
            keys, lines, out, at = batch.column(0).to_pylist(), batch.column(1).to_pylist(), [], 0
            kind = batch.schema.field(0).type
            while at < len(keys):
                key, end = keys[at], at + 1
                while end < len(keys) and keys[end] == key:
                    end += 1
                if key != last:
                    if last is not None:
                        out.append((last, state.hexdigest()))
                    last, state = key, hashlib.md5()
                else:
                    state.update(between)
                state.update(separator.join(lines[at:end]).encode())
                at = end
            yield made(out, kind)
        if last is not None:
            yield made([(last, state.hexdigest())], kind)

    def made(rows: list[tuple[object, str]], kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], kind), pa.array([v for _, v in rows], pa.string())], ["card_id", "relations_md5"])

    return told.mapInArrow(hashed, f"card_id {dict(relations.dtypes)['card_id']}, relations_md5 string")


def root_crumbs(label: Column, role: Column, file_name: Column) -> Column:
    """What comes before a file's sections: its document, and its own name unless it is the main file."""
    return F.when(role == "main", F.array(label)).otherwise(F.array(label, F.concat(F.lit("Приложение «"), file_name, F.lit("»"))))


def payloads(chunks: DataFrame, files: DataFrame, documents: DataFrame, level: str = "child", settings: ChunkSettings = ChunkSettings()) -> DataFrame:
    """Chunks with the fields of their file and document: what the index holds.

    ``chunks`` have ``file_sha256, breadcrumbs, kind, strategy, ordinal, ..``, ``files`` their
    ``card_id, row_id, role, name, category, route`` by hash, ``documents`` those of
    ``document_fields``. The section path leaves out the root and the clause.
    """
    child = level == "child"
    met = chunks.join(files.select("file_sha256", F.col("card_id").cast("string").alias("doc_id"), F.col("row_id").alias("file_row_id"), F.col("name").alias("file_name"), F.col("category").alias("file_category"), F.coalesce("role", F.lit("skipped")).alias("file_role"), F.col("route").alias("parse_route")), "file_sha256").join(documents, "doc_id")
    length = F.size(root_crumbs(F.col("label"), F.col("file_role"), F.col("file_name")))
    path = F.slice("breadcrumbs", length + 1, F.greatest(F.size("breadcrumbs") - length, F.lit(0)))
    if child:
        ends = (F.size(path) > 0) & F.coalesce(F.endswith(F.get(path, F.size(path) - 1), F.col("clause")), F.lit(False))
        path = F.when(ends, F.slice(path, 1, F.size(path) - 1)).otherwise(path)
    kind = F.when(F.col("kind") == "table", "table").when(F.col("strategy") == "structural", "structural").otherwise("fallback") if child else F.lit("structural")
    refs = F.array().cast("array<string>") if child else F.col("item_refs")
    return met.select(
        *documents.columns, "file_sha256", "file_row_id", "file_name", "file_category", "file_role", "parse_route", "chunk_id", F.lit(level).alias("chunk_level"), kind.alias("chunk_kind"), F.col("ordinal").alias("chunk_index"),
        (F.col("parent_id") if child else F.lit(None).cast("string")).alias("parent_id"), refs.alias("child_ids"), path.alias("section_path"), (F.col("clause") if child else F.lit(None).cast("string")).alias("clause"),
        "heading", F.array_join("breadcrumbs", settings.separator).alias("breadcrumbs"), "page_no", "text", "body", "tokens",
    )


def card_view(cards: DataFrame, sections: list[str] | None, documents: DataFrame | None = None) -> DataFrame:
    """``doc_id, included, omitted, sections, files, summary`` of cards with the wanted sections only, or all where none are named.

    Names of sections ignore case; files are those that really exist. Without ``documents`` the fields
    of ``document_fields`` are read from the cards themselves, which needn't meet them then.
    """
    told = ("label", "doc_kind", "doc_number", "doc_date", "subject", "doc_status", "doc_status_name", "state_name", "approval_state_name", "department", "author", "signed_by", "validity_period", "comment", "approvers", "responsible")
    own = documents is None
    held = document_fields(cards, keep=("sections", "files")) if own else cards.withColumnRenamed("id", "doc_id")
    wanted = [s.lower() for s in sections or []]
    has = lambda name: F.lit(True) if sections is None else F.lower(name).isin(*wanted)
    keys = F.sort_array(F.map_keys("sections"))
    real = F.transform(F.filter("files", lambda f: ~F.coalesce(f["is_virtual"], F.lit(False))), lambda f: f["name"])
    view = held.select(
        "doc_id", F.filter(keys, has).alias("included"), F.filter(keys, lambda k: ~has(k)).alias("omitted"),
        F.map_filter("sections", lambda k, _: has(k)).alias("sections"), F.coalesce(real, F.array().cast("array<string>")).alias("files"),
        *([F.struct(*told).alias("summary")] if own else []),
    )
    return view if own else view.join(documents.select("doc_id", F.struct(*told).alias("summary")), "doc_id", "left")


def coverage_kinds(texts: list[Column], kinds: dict[str, tuple[str, ...]], other: str) -> Column:
    """All kinds whose patterns any of the texts matches; ``other`` if none."""
    values = F.array(*[F.coalesce(t, F.lit("")) for t in texts])

    def matches(patterns: tuple[str, ...]) -> Column:
        pattern = "(?iuU)" + "|".join(f"(?:{p})" for p in patterns)
        return F.exists(values, lambda x: x.rlike(pattern))

    hits = [F.when(matches(p), F.lit(k)) for k, p in kinds.items()]
    found = F.filter(F.array(*hits), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(other)))


def manifest_stats(documents: DataFrame, files: DataFrame) -> DataFrame:
    """``dim, key, n``: counts by kind, status and type of documents, and by reason and extension of skipped files; totals too."""
    dims = lambda *pairs: F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), k.alias("key")) for d, k in pairs])).alias("p")
    by_doc = documents.select(dims(("documents", F.lit("")), ("doc_kind", F.col("doc_kind")), ("doc_status", F.col("doc_status")), ("card_type", F.coalesce("type_name", F.lit("?")))))
    skipped = F.col("skip_reason").isNotNull()
    by_file = files.select(dims(
        ("files", F.lit("")), ("downloaded", F.when(~skipped, F.lit(""))), ("skipped", F.when(skipped, F.lit(""))), ("skip_reason", F.col("skip_reason")),
        ("skip_extension", F.when(F.col("skip_reason") == "format", F.coalesce(F.nullif("extension", F.lit("")), F.lit("-")))),
        ("duplicates", F.when(F.col("duplicate_of").isNotNull(), F.lit(""))),
    ))
    return by_doc.unionByName(by_file).where("p.key is not null").groupBy("p.dim", "p.key").agg(F.count(F.lit(1)).alias("n"))


def first_values(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """``key, value``: the value of each key's first row, which may be null."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(F.col(value)), F.col(order)).alias("v")).select(key, F.col(f"v.{value}").alias(value))


def corpus_summary(files: DataFrame, documents: DataFrame) -> DataFrame:
    """``what, n, bytes``: documents, files, and files by extension."""
    all_ = files.agg(F.lit("files").alias("what"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    each = files.groupBy(F.concat(F.lit("."), "extension").alias("what")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    docs = documents.agg(F.lit("documents").alias("what"), F.count(F.lit(1)).alias("n"), F.lit(0).cast("bigint").alias("bytes"))
    return docs.unionByName(all_).unionByName(each)


def causes(rows: DataFrame, by: list[str], order: list[str], patterns: dict[str, tuple[str, ...]], allow: tuple[int, ...] = (), deny: tuple[int, ...] = ()) -> DataFrame:
    """``rows`` with ``cause``: why a row isn't chosen, or ``kept``.

    Rows without an id and repeats (the first in its group stays) drop out first, then rows that miss
    a column's patterns, then those of a refused state; a null state is never refused.
    """
    place = F.row_number().over(Window.partitionBy(*by, "card_id").orderBy(*order))
    meets = F.lit(True)
    for column, wanted in patterns.items():
        meets = meets & F.coalesce(F.col(column).cast("string"), F.lit("")).rlike("(?iuU)" + "|".join(f"(?:{w})" for w in wanted))
    state = F.col("state_id").isNull() | ((F.col("state_id").isin(*allow) if allow else F.lit(True)) & (~F.col("state_id").isin(*deny) if deny else F.lit(True)))
    known = rows.where("card_id is not null").withColumn("__n", place)
    judged = known.withColumn("cause", F.when(F.col("__n") > 1, "duplicate").when(~meets, "match").when(~state, "state").otherwise("kept")).drop("__n")
    return judged.unionByName(rows.where("card_id is null").withColumn("cause", F.lit("no_id")))


def paged_listing(
    rows: DataFrame, page_limit: int, max_pages: int, max_documents: int, patterns: dict[str, tuple[str, ...]], allow: tuple[int, ...] = (), deny: tuple[int, ...] = ()
) -> tuple[DataFrame, DataFrame]:
    """The chosen rows of views that are read page by page, and one row of counters per view.

    ``rows`` are ``(view, page, pos, card_id, state_id, ..)``, pages from 1. Reading a view ends before
    the first page without rows, after one without a new id or with fewer than ``page_limit`` rows,
    after the one with which ``max_documents`` are chosen, and after ``max_pages``; the last two cut
    it off (``truncated``). Pages are decided by their counts; only those that are read are
    numbered, and of these rows as many as are wanted.
    """
    judged = causes(rows, ["view"], ["page", "pos"], patterns, allow, deny)
    is_ = lambda *names: F.col("cause").isin(*names)
    pages = judged.groupBy("view", "page").agg(F.count(F.lit(1)).alias("rows"), F.count_if(~is_("no_id", "duplicate")).alias("fresh"), F.count_if(is_("kept")).alias("chosen"))
    along = Window.partitionBy("view").orderBy("page")
    counted = pages.withColumns({"at": F.row_number().over(along), "total": F.sum("chosen").over(along.rowsBetween(Window.unboundedPreceding, 0))})
    full, ends = F.col("total") >= max_documents, (F.col("fresh") == 0) | (F.col("rows") < page_limit)
    marked = counted.withColumns({"cut": full | ((F.col("page") >= max_pages) & ~ends), "stop": full | ends | (F.col("page") >= max_pages)})
    before = F.coalesce(F.max("stop").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    read = marked.withColumn("before", before).where((F.col("page") == F.col("at")) & ~F.col("before"))
    held = judged.join(read.select("view", "page"), ["view", "page"])
    count = lambda name: F.count_if(is_(name))
    sums = held.groupBy("view").agg(F.count(F.lit(1)).alias("received"), F.count_if(~is_("no_id", "duplicate")).alias("unique"), count("no_id").alias("without_id"), count("duplicate").alias("duplicates"), count("match").alias("excluded_by_match"), count("state").alias("excluded_by_state"))
    last = read.groupBy("view").agg(F.max("page").alias("pages"), F.least(F.max("total"), F.lit(max_documents)).alias("selected"), F.bool_or("cut").alias("truncated"))
    order = Window.partitionBy("view").orderBy("page", "pos")
    kept = held.where("cause = 'kept'").drop("cause").withColumn("n", F.row_number().over(order)).where(F.col("n") <= max_documents)
    return kept, last.join(sums, "view")


def listing(rows: DataFrame, patterns: dict[str, tuple[str, ...]], allow: tuple[int, ...] = (), deny: tuple[int, ...] = (), limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The chosen rows of a listing ``(card_id, state_id, pos, ..)`` in order, and one row of counters; see ``causes``."""
    judged = causes(rows, [], ["pos"], patterns, allow, deny)
    kept = judged.where("cause = 'kept'").drop("cause")
    kept = kept if limit is None else kept.orderBy("pos").limit(limit)
    return kept, judged.agg(
        F.count(F.lit(1)).alias("received"), F.count_if(F.col("cause") == "no_id").alias("without_id"), F.count_if(F.col("cause") == "duplicate").alias("duplicates"),
        F.count_if(F.col("cause") == "match").alias("excluded_by_match"), F.count_if(F.col("cause") == "state").alias("excluded_by_state"), F.count_if(F.col("cause") == "kept").alias("selected"),
    )


def checks(documents: DataFrame, files: DataFrame, excluded: DataFrame, errors: DataFrame, seeds: DataFrame, important: tuple[str, ...] = ("doc_kind", "doc_number", "doc_date")) -> DataFrame:
    """``name, status, n``: files downloaded and open, cards complete, ids unique, exclusions kept out, errors; last the overall row."""
    row = lambda df, name, bad, level: df.agg(F.count_if(bad).alias("n")).select(F.lit(name).alias("name"), F.when(F.col("n") > 0, F.lit(level)).otherwise(F.lit("PASS")).alias("status"), "n")
    empty = F.lit(False)
    for c in important:
        empty = empty | F.col(c).isNull() | (F.col(c).cast("string") == "")
    repeated = documents.groupBy("card_id").agg(F.count(F.lit(1)).alias("times"))
    leaked = excluded.select("card_id").distinct().join(documents.select("card_id"), "card_id", "left_semi")
    failed = errors.join(seeds.select("card_id", F.lit(True).alias("seed")).distinct(), "card_id", "left")
    fetch = failed.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("seed")).alias("s")).select(
        F.lit("fetched").alias("name"), F.when(F.col("s") > 0, "FAIL").when(F.col("n") > 0, "WARN").otherwise("PASS").alias("status"), "n"
    )
    out = (
        row(files, "downloaded", F.col("skip_reason") == "error", "FAIL")
        .unionByName(row(files, "open", F.col("smoke_ok") == F.lit(False), "FAIL"))
        .unionByName(row(documents, "complete", empty, "WARN"))
        .unionByName(row(repeated, "unique", F.col("times") > 1, "FAIL"))
        .unionByName(row(leaked, "excluded", F.lit(True), "FAIL"))
        .unionByName(fetch)
    )
    worst = out.agg(F.bool_or(F.col("status") == "FAIL").alias("f"), F.bool_or(F.col("status") == "WARN").alias("w"), F.sum("n").alias("n"))
    return out.unionByName(worst.select(F.lit("overall").alias("name"), F.when(F.col("f"), "FAIL").when(F.col("w"), "WARN").otherwise("PASS").alias("status"), "n"))


def coverage(documents: DataFrame, files: DataFrame, graph: DataFrame, targets: dict[str, float], rules: CoverageRules = CoverageRules()) -> DataFrame:
    """``name, target, actual, ok``: documents of each kind against its target, and how the set is composed.

    A document with several kinds counts for each. A kind's facts count its documents that are
    cancelled, changed (joined by an edge of change to another of the kind), have terms or tables,
    attachments (two files, or an edge that says so) or links. Shares are of downloaded files; a
    scan is an image or a file without a text layer.
    """
    kinds = documents.select("card_id", F.explode("kinds").alias("kind"))
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(float(t)).alias("target")) for k, t in targets.items()])).alias("t")
    goals = documents.sparkSession.range(1).select(wanted).select("t.*")
    actual = kinds.groupBy("kind").agg(F.countDistinct("card_id").alias("actual"))
    by_kind = goals.join(actual, "kind", "left").select(F.col("kind").alias("name"), "target", F.coalesce("actual", F.lit(0)).cast("double").alias("actual"))

    inside = graph.where("not dangling")
    says = lambda column, pattern: F.coalesce(F.col(column), F.lit("")).rlike("(?iuU)" + pattern)
    ends = lambda edges, mark: edges.select(F.explode(F.array("from_id", "to_id")).alias("card_id")).distinct().withColumn(mark, F.lit(True))
    added = inside.where(says("relation_type", rules.attachment)).select(F.col("from_id").alias("card_id")).unionByName(inside.where(says("reverse_type", rules.attachment)).select(F.col("to_id").alias("card_id")))
    per_doc = files.groupBy("card_id").agg(F.bool_or("has_terms").alias("terms"), F.bool_or("has_tables").alias("tables"), F.count_if(F.col("skip_reason").isNull()).alias("got"))
    wide = documents.select("card_id", "doc_status", F.explode(F.concat("kinds", F.array(F.lit("*")))).alias("kind")).join(per_doc, "card_id", "left")
    wide = wide.join(ends(inside, "linked"), "card_id", "left").join(added.distinct().withColumn("added", F.lit(True)), "card_id", "left")
    change = inside.where(says("relation_type", rules.change)).select("from_id", "to_id")
    pairs = change.join(kinds.select(F.col("card_id").alias("from_id"), F.col("kind").alias("kind")), "from_id").join(kinds.select(F.col("card_id").alias("to_id"), F.col("kind").alias("kind")), ["to_id", "kind"])
    changed = pairs.select("kind", F.explode(F.array("from_id", "to_id")).alias("card_id")).distinct().withColumn("changed", F.lit(True))
    wide = wide.join(changed, ["kind", "card_id"], "left")
    flags = {"cancelled": F.col("doc_status") == "cancelled", "changed": F.col("changed"), "terms": F.col("terms"), "tables": F.col("tables"), "attachments": (F.col("got") >= 2) | F.col("added"), "linked": F.col("linked")}
    counted = wide.groupBy("kind").agg(*[F.count_if(c).alias(f) for f, c in flags.items()])
    told = counted.select("kind", F.explode(F.array(*[F.struct(F.lit(f).alias("fact"), F.col(f).alias("n")) for f in flags])).alias("x")).select("kind", "x.fact", "x.n")
    asked = documents.sparkSession.range(1).select(F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip((name, kind, fact, float(least)), ("name", "kind", "fact", "target"))]) for name, kind, fact, least in rules.facts])).alias("a")).select("a.*")
    facts = asked.join(told, ["kind", "fact"], "left").select("name", "target", F.coalesce("n", F.lit(0)).cast("double").alias("actual"))

    downloaded = files.where("skip_reason is null").join(documents.select("card_id").distinct(), "card_id", "left_semi")
    scan = F.col("extension").isin(*rules.images) | (F.col("has_text") == F.lit(False))
    share = downloaded.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n"), F.count_if("has_text").alias("digital"), F.count_if(scan).alias("scans"))
    dates = documents.agg(F.coalesce(F.year(F.max("doc_date")) - F.year(F.min("doc_date")), F.lit(0)).cast("double").alias("actual"))
    part = lambda name, least, of: share.select(F.lit(name).alias("name"), F.lit(least).alias("target"), F.round(F.col(of) / F.col("n"), 6).alias("actual"))
    out = by_kind.unionByName(facts).unionByName(part("digital share", rules.digital_share, "digital")).unionByName(part("scan share", rules.scan_share, "scans"))
    out = out.unionByName(dates.select(F.lit("span of years").alias("name"), F.lit(float(rules.span_of_years)).alias("target"), "actual"))
    return out.withColumn("ok", F.col("actual") >= F.col("target"))


def counters(files: DataFrame, *by: str) -> DataFrame:
    """Files by the reason why they are skipped, if they are, and by other columns."""
    reason = F.coalesce(F.substring_index("skip_reason", ":", 1), F.lit("kept")).alias("reason")
    return files.groupBy(reason, *by).agg(F.count(F.lit(1)).alias("n"))


def review_rows(documents: DataFrame, files: DataFrame, via: DataFrame) -> DataFrame:
    """One row per document for review, in order of kind, number and id."""
    got = files.groupBy("card_id").agg(F.count_if(F.col("skip_reason").isNull()).alias("files"))
    met = documents.join(via, "card_id", "left").join(got, "card_id", "left")
    return met.select(
        "card_id", "doc_kind", F.coalesce("doc_number", F.lit("")).alias("number"), F.coalesce(F.date_format("doc_date", "yyyy-MM-dd"), F.lit("")).alias("doc_date"),
        F.coalesce("subject", F.lit("")).alias("subject"), "doc_status", "origin", "relation", F.coalesce("files", F.lit(0)).alias("files"),
    ).orderBy("doc_kind", "number", "card_id")
