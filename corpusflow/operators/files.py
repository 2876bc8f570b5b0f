"""Which files of a record are indexed, and how equal contents are told apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..runtime import written
from ..settings import FileRules

ROLES = ("main", "appendix", "supplement")


def download_skip(rows: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """``rows`` with ``skip_reason`` (``virtual``, ``format`` or null) and its detail."""
    extension = F.lower("extension")
    reason = F.when(F.col("is_virtual"), F.lit("virtual")).when(~extension.isin(*allowed), F.lit("format"))
    return rows.withColumn("skip_reason", reason).withColumn("skip_detail", F.when(F.col("skip_reason") == "format", F.coalesce(F.nullif(extension, F.lit("")), F.lit("-"))))


def _skip(rules: FileRules) -> Column:
    found = F.when(~F.col("extension").isin(*rules.extensions), F.lit("format"))
    for prefix in rules.skip_prefixes:
        found = found.when(F.startswith(F.lower("name"), F.lit(prefix.lower())), F.lit("print copy"))
    return found.when(F.col("category").isin(*rules.skip_categories), F.lit("category"))


def _candidate_rank(rules: FileRules) -> Column:
    """The first main-file rule that a file meets; null if none."""
    rank = None
    for i, c in enumerate(rules.main_candidates):
        meets = F.col("extension") == c.extension
        meets = meets if c.any_category else meets & F.coalesce(F.col("category").isin(*c.categories), F.lit(False))
        rank = F.when(meets, F.lit(i)) if rank is None else rank.when(meets, F.lit(i))
    return rank


def file_roles(files: DataFrame, cards: DataFrame, rules: FileRules = FileRules(), whole: bool = False) -> DataFrame:
    """``card_id, row_id, role, skip_reason`` of every file, before contents are compared; ``whole`` adds what ``content_owners`` asks for.

    One file of a card is main: the first rule that any file meets, then its place. The card's
    files meet in one window; the main file's extension decides about pdf copies.
    """
    more, place = (["sha256"], [F.col("pos").alias("card_pos"), F.lit(True).alias("has_card")]) if whole else ([], [])
    slim = files.select("card_id", "row_id", "pos", "extension", "category", "name", *more).join(cards.select("card_id", "type_name", *place), "card_id", "left")
    marked = slim.withColumn("skip", _skip(rules)).withColumn("cand", F.when(F.col("skip").isNull(), _candidate_rank(rules)))
    order = Window.partitionBy("card_id").orderBy(F.col("cand").asc_nulls_last(), "pos", "row_id")
    first = marked.withColumn("n", F.row_number().over(order)).withColumn("is_main", (F.col("n") == 1) & F.col("cand").isNotNull())
    main_type = F.max(F.when(F.col("is_main"), F.col("extension"))).over(Window.partitionBy("card_id"))
    seen = first.withColumn("main_ext", main_type)
    in_ = lambda values: F.coalesce(F.col("category").isin(*values), F.lit(False))
    copy = in_(rules.main_text_categories) & (F.col("extension") == "pdf") & F.coalesce(F.col("main_ext") == "docx", F.lit(False))
    extra = in_(rules.supplement_categories)
    welcome = F.coalesce(F.col("type_name").isin(*rules.supplement_types), F.lit(False))
    reason = F.coalesce("skip", F.when(F.col("is_main"), F.lit(None)).when(copy, F.lit("pdf copy")).when(extra & ~welcome, F.lit("supplement of another type")))
    role = F.when(F.col("is_main"), F.lit("main")).when(extra, F.lit("supplement")).otherwise(F.lit("appendix"))
    facts = ["pos", *more, "card_pos", "has_card"] if whole else []
    return seen.withColumn("skip_reason", reason).select("card_id", "row_id", F.when(F.col("skip_reason").isNull(), role).alias("role"), "skip_reason", *facts)


def content_owners(planned: DataFrame, files: DataFrame, cards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``card_id, row_id, role, skip_reason, copies`` after equal contents are settled; and the copies, one row each.

    The owner of a content is the file of the best role, then the first in record and file
    order; the others are skipped. ``copies`` counts them on the owner. The second table has
    ``card_id, row_id`` of the owner, ``rank, card_pos, pos, copy_row_id`` to sort its copies by, and
    ``also_in``, the copy's card, which may be the owner's own. The files are written
    down once, owners are found by a minimum, and a file meets its content's owner once. Where ``planned`` comes whole from ``file_roles``, no file is looked up again.
    """
    if "has_card" not in planned.columns:
        facts = files.groupBy("card_id", "row_id").agg(F.min("pos").alias("pos"), F.min_by("sha256", "pos").alias("sha256"))
        planned = planned.join(facts, ["card_id", "row_id"], "left")
        planned = planned.join(cards.select("card_id", F.col("pos").alias("card_pos"), F.lit(True).alias("has_card")), "card_id", "left")
    taken = F.col("role").isNotNull() & F.col("sha256").isNotNull() & F.coalesce("has_card", F.lit(False))
    # files of no content have a key of their own, as nulls would fill one task
    content = F.when(taken, F.concat(F.lit("+"), "sha256")).otherwise(F.concat(F.lit("-"), "row_id"))
    keyed = written(planned.select("card_id", "row_id", "role", "skip_reason", "pos", "card_pos", content.alias("content")))
    rank = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")).cast("int")
    k, some = F.struct(rank.alias("rank"), "card_pos", "pos", "row_id", "card_id"), F.startswith("content", F.lit("+"))
    owners = keyed.where(some).groupBy("content").agg(F.min(k).alias("owner"), (F.count(F.lit(1)) - 1).alias("copies")).where("copies > 0")
    lost = keyed.where(some).join(owners, "content").where(k != F.col("owner"))
    copies = lost.select("owner.card_id", "owner.row_id", rank.alias("rank"), "card_pos", "pos", F.col("row_id").alias("copy_row_id"), F.col("card_id").alias("also_in"))
    out, copy = keyed.join(owners, "content", "left"), F.coalesce(k != F.col("owner"), F.lit(False))
    role, reason = F.when(~copy, F.col("role")), F.when(copy, F.lit("copy")).otherwise(F.col("skip_reason"))
    return out.select("card_id", "row_id", role.alias("role"), reason.alias("skip_reason"), F.when(~copy, F.col("copies")).alias("copies")).fillna(0, ["copies"]), copies


def mark_duplicates(files: DataFrame, cards: DataFrame) -> DataFrame:
    """``card_id, row_id, duplicate_of``: the first file of a hash in record order is the origin; files without a hash are none's copy."""
    keyed = files.select("card_id", "row_id", "pos", "sha256").join(cards.select("card_id", F.col("pos").alias("card_pos")), "card_id")
    hashed = keyed.where("sha256 is not null")
    order = Window.partitionBy("sha256").orderBy("card_pos", "pos", "row_id")
    origin = F.first(F.concat_ws("/", F.col("card_id").cast("string"), "row_id")).over(order)
    marked = hashed.withColumn("n", F.row_number().over(order)).withColumn("origin", origin)
    known = marked.select("card_id", "row_id", F.when(F.col("n") > 1, F.col("origin")).alias("duplicate_of"))
    return known.unionByName(keyed.where("sha256 is null").select("card_id", "row_id", F.lit(None).cast("string").alias("duplicate_of")))


def parse_route(pages: DataFrame, min_chars: int = 50, min_share: float = 0.5, max_mixed: float = 0.1) -> DataFrame:
    """``file_id, n_pages, text_pages, route``: native if enough pages have a usable text layer, else by model.

    A page counts with ``min_chars`` characters besides white space and at most ``max_mixed`` of
    its words written in two scripts.
    """
    w = F.filter(F.split(F.coalesce("text", F.lit("")), r"(?U)\s+"), lambda x: x.rlike(r"\p{L}"))
    mixed = F.filter(w, lambda x: x.rlike(r"\p{IsCyrillic}") & x.rlike(r"\p{IsLatin}"))
    chars = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", ""))
    good = (chars >= min_chars) & (F.size(mixed) <= F.size(w) * max_mixed)
    counted = pages.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_pages"), F.count_if(good).alias("text_pages"))
    return counted.withColumn("route", F.when(F.col("text_pages") >= F.col("n_pages") * min_share, F.lit("native")).otherwise(F.lit("model")))


def inspect_pages(pages: DataFrame, patterns: tuple[str, ...], first_pages: int = 30, max_line: int = 120) -> DataFrame:
    """``file_id, n_pages, has_text, has_terms``: a text layer on the first pages, and a short line that matches a heading pattern."""
    short = F.exists(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: (F.length(x) <= max_line) & F.lit(False) if not patterns else (F.length(x) <= max_line) & x.rlike("(?iuU)" + "|".join(patterns)))
    has = (F.col("page_no") < first_pages) & F.col("text").rlike(r"(?U)\S")
    return pages.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("n_pages"), F.coalesce(F.bool_or(has), F.lit(False)).alias("has_text"), F.bool_or(short).alias("has_terms")
    )


def admit_files(manifest_files: DataFrame, cards: DataFrame, disk: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files that may be ingested, and one issue ``(kind, card_id, row_id, path)`` for each of the others.

    A file needs its card, the file on disk, and the recorded hash. Files that were never
    downloaded are neither.
    """
    have = cards.select(F.col("card_id").alias("c_id"), F.lit(True).alias("has_card")).distinct()
    there = disk.select("path", F.col("sha256").alias("disk_sha"), "size")
    met = manifest_files.where("downloaded").join(have, F.col("card_id") == F.col("c_id"), "left").join(there, "path", "left")
    kind = (
        F.when(F.col("has_card").isNull(), F.lit("card_missing"))
        .when(F.col("disk_sha").isNull(), F.lit("file_missing"))
        .when(F.col("disk_sha") != F.col("sha256"), F.lit("hash_changed"))
    )
    judged = met.withColumn("kind", kind)
    files = judged.where("kind is null").select("card_id", "row_id", "path", "sha256", "size")
    return files, judged.where("kind is not null").select("kind", "card_id", "row_id", "path")


def orphan_files(disk: DataFrame, manifest_files: DataFrame, cards: DataFrame) -> DataFrame:
    """``path, kind`` of files on disk that the manifest lacks; the first part of a path is its card."""
    stray = disk.join(manifest_files.select("path").distinct(), "path", "left_anti").withColumn("dir", F.substring_index("path", "/", 1))
    known = cards.select(F.col("card_id").cast("string").alias("dir"), F.lit(True).alias("has_card")).distinct()
    return stray.join(known, "dir", "left").select("path", F.when(F.col("has_card"), F.lit("not_in_manifest")).otherwise(F.lit("no_card")).alias("kind"))
