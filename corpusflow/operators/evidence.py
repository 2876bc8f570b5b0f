"""The evidence of a question as one text within a budget of characters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

# What the text says between its parts
NONE = "(свидетельств нет: инструменты ничего не нашли)"
DOCUMENTS = "Документы (факты карточки цитируй ссылкой на документ, например [D1]):"
FRAGMENTS = "Фрагменты:"
UNNAMED = "документ"
NO_CARD = "; карточка не запрашивалась: автор, подписант, согласующие и срок действия неизвестны"
OVERFLOW = "(остальные фрагменты не поместились в бюджет ответа)"
CONTEXT = "\n  Контекст раздела: "
LINE_END = "\r\n|[\n\x0b\f\r\x1c\x1d\x1e\x85\u2028\u2029]"


@dataclass(frozen=True)
class EvidenceSettings:
    max_chars: int = 24_000
    context_chars: int = 700  # of a fragment's section
    least: int = 400  # a rest under this is not filled
    relations: int = 8  # of a document without a card


def cut_to(c: Column, limit: Column) -> Column:
    """At most ``limit`` characters of a stripped text, then a mark if there were more."""
    return F.when(F.length(c) > limit, F.concat(F.regexp_replace(c.substr(F.lit(1), limit), r"(?U)\s+$", ""), F.lit("…"))).otherwise(c)


def first_of(rows: DataFrame) -> DataFrame:
    """Of rows with one alias in a question the first."""
    return rows.groupBy("question_id", "alias").agg(F.min_by(F.struct(*[c for c in rows.columns if c not in ("question_id", "alias")]), "n").alias("r")).select("question_id", "alias", "r.*")


def document_lines(documents: DataFrame, settings: EvidenceSettings) -> DataFrame:
    """``question_id, used, lines``: what is shown of each question's documents, and its length.

    A document's card is shown while under half of the budget is used, later ones by a line with
    subject, department and relations.
    """
    text = lambda name: F.coalesce(F.col(name), F.lit(""))
    part = lambda before, name, after="": F.when(text(name) != "", F.concat(F.lit(before), F.col(name), F.lit(after))).otherwise(F.lit(""))
    line = F.concat(F.lit("["), "alias", F.lit("] "), F.coalesce(F.nullif(F.col("label"), F.lit("")), F.lit(UNNAMED)), F.lit(" — "), text("status"))
    summary = F.filter(F.split(F.regexp_replace(text("card_text"), f"(?:{LINE_END})\\z", ""), LINE_END), lambda _, i: i > 0)  # its first line repeats label and status
    relations = F.slice(F.coalesce("relations", F.array().cast("array<string>")), 1, settings.relations)
    card = F.concat(F.array(line), F.transform(summary, lambda s: F.concat(F.lit("    "), s)))
    short = F.concat(F.array(F.concat(line, part("; тема: «", "subject", "»"), part("; подразделение: ", "department"), F.lit(NO_CARD))), F.transform(relations, lambda r: F.concat(F.lit("    связь: "), r)))
    shown = first_of(documents).select("question_id", "n", "alias", (text("card_text") != "").alias("has"), card.alias("card"), short.alias("short"))
    chars = lambda lines: F.aggregate(lines, F.lit(0), lambda s, x: s + F.length(x))
    sizes = shown.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("n", "alias", "has", chars(F.col("card")).alias("card"), chars(F.col("short")).alias("short")))).alias("sizes"))

    def step(s: Column, d: Column) -> Column:
        full = d["has"] & (s["used"] < settings.max_chars // 2)
        return F.struct((s["used"] + F.when(full, d["card"]).otherwise(d["short"])).alias("used"), F.concat(s["picks"], F.array(F.struct(d["alias"].alias("alias"), full.alias("full")))).alias("picks"))

    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<struct<alias:string,full:boolean>>").alias("picks"))
    picked = sizes.select("question_id", F.explode(F.aggregate("sizes", start, step)["picks"]).alias("p")).select("question_id", "p.alias", "p.full")
    lines = shown.join(picked, ["question_id", "alias"]).select("question_id", "n", "alias", F.when(F.col("full"), F.col("card")).otherwise(F.col("short")).alias("lines"))
    joined = lines.groupBy("question_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("n", "alias", "lines"))), lambda r: r["lines"])).alias("lines"))
    return joined.select("question_id", chars(F.col("lines")).alias("used"), "lines")


def fragment_lines(fragments: DataFrame, used: DataFrame, settings: EvidenceSettings) -> DataFrame:
    """``question_id, lines, overflow``: sections first, then hits, then those of earlier turns, in the budget that ``used(question_id, used)`` leaves.

    The context of a section is shown once, with its first hit, and not where the section itself is
    shown. The first fragment is shown whole; a later one that doesn't fit is cut, which takes all
    that was left, or ends the list where too little is left. What is shown is decided by a fold
    over lengths; texts meet the decisions afterwards.
    """
    text = lambda name: F.coalesce(F.col(name), F.lit(""))
    order = F.when(F.col("kind") == "section", 0).when(F.col("cached"), 2).otherwise(1)
    page = F.when(F.coalesce("page_no", F.lit(0)) != 0, F.concat(F.lit(", стр. "), F.col("page_no").cast("string"))).otherwise(F.lit(""))
    head = F.concat(F.lit("["), "alias", F.lit("] ("), text("doc_alias"), F.lit(", "), text("status"), page, F.lit(") "), text("breadcrumbs"))
    context = strip(text("context"))
    tells = (F.col("kind") == "hit") & (F.lit(settings.context_chars) > 0) & (context != "") & (context != strip(text("text")))
    rows = first_of(fragments).select(
        "question_id", F.coalesce(order, F.lit(1)).alias("o"), "n", "alias", "kind", "chunk_id", text("parent_id").alias("parent"), F.concat(head, F.lit("\n"), text("text")).alias("base"),
        F.when(F.coalesce(tells, F.lit(False)), F.concat(F.lit(CONTEXT), cut_to(context, F.lit(settings.context_chars)))).alias("more"),
    )
    listed = F.sort_array(F.collect_list(F.struct("o", "n", "alias", F.length("base").alias("base"), F.length("more").alias("more"), "parent")))
    sizes = rows.groupBy("question_id").agg(listed.alias("sizes"), F.collect_set(F.when(F.col("kind") == "section", F.col("chunk_id"))).alias("seen")).join(used, "question_id", "left")
    picks_kind = "array<struct<alias:string,more:boolean,room:int>>"

    def step(s: Column, f: Column) -> Column:
        more = f["more"].isNotNull() & ~F.array_contains(s["seen"], f["parent"])
        size, room = f["base"] + F.when(more, f["more"]).otherwise(0), F.lit(settings.max_chars) - s["used"]
        tight = (size > room) & (F.size(s["picks"]) > 0)
        ends = tight & (room < settings.least)
        pick = F.struct(f["alias"].alias("alias"), more.alias("more"), F.when(tight, room).alias("room"))
        after = F.struct(
            (s["used"] + F.when(tight, room).otherwise(size)).alias("used"),
            F.when(more & (f["parent"] != ""), F.concat(s["seen"], F.array(f["parent"]))).otherwise(s["seen"]).alias("seen"),
            F.concat(s["picks"], F.array(pick)).cast(picks_kind).alias("picks"), F.lit(False).alias("over"),
        )
        stopped = F.struct(s["used"].alias("used"), s["seen"].alias("seen"), s["picks"].alias("picks"), F.lit(True).alias("over"))
        return F.when(s["over"], s).when(ends, stopped).otherwise(after)

    base_used = F.coalesce(F.col("used"), F.lit(0)) + len(DOCUMENTS) + len(FRAGMENTS)
    start = F.struct(base_used.cast("int").alias("used"), F.col("seen"), F.array().cast(picks_kind).alias("picks"), F.lit(False).alias("over"))
    folded = sizes.select("question_id", F.aggregate("sizes", start, step).alias("s")).select("question_id", F.col("s.over").alias("overflow"), F.explode("s.picks").alias("p"))
    met = rows.join(folded.select("question_id", "overflow", "p.*").withColumnRenamed("more", "with_more"), ["question_id", "alias"])
    whole = F.concat("base", F.when(F.col("with_more"), F.col("more")).otherwise(F.lit("")))
    block = F.when(F.col("room").isNotNull(), cut_to(strip(whole), F.col("room"))).otherwise(whole)
    told = met.groupBy("question_id", "overflow").agg(F.sort_array(F.collect_list(F.struct("o", "n", "alias", block.alias("block")))).alias("b"))
    return told.select("question_id", F.transform("b", lambda r: r["block"]).alias("lines"), "overflow")


def render_evidence(questions: DataFrame, documents: DataFrame, fragments: DataFrame, settings: EvidenceSettings = EvidenceSettings()) -> DataFrame:
    """``question_id, text`` of each of ``questions``.

    ``documents`` are ``question_id, n, alias, label, status, card_text, subject, department, relations``,
    ``fragments`` are ``question_id, n, alias, kind, cached, chunk_id, parent_id, doc_alias, status, page_no,
    breadcrumbs, text, context``; ``n`` is their order, of repeated aliases the first counts. A
    question without either is told that there is no evidence. Only lengths of a question's
    evidence meet in one row before the budget is applied.
    """
    shown = document_lines(documents, settings)
    blocks = fragment_lines(fragments, shown.select("question_id", "used"), settings)
    none = F.array().cast("array<string>")
    rows = questions.select("question_id").distinct().join(shown.select("question_id", F.col("lines").alias("d")), "question_id", "left").join(blocks.withColumnRenamed("lines", "f"), "question_id", "left")
    ending = F.when(F.coalesce("overflow", F.lit(False)), F.array(F.lit(OVERFLOW))).otherwise(none)
    lines = F.concat(F.array(F.lit(DOCUMENTS)), F.coalesce("d", none), F.array(F.lit(FRAGMENTS)), F.coalesce("f", none), ending)
    return rows.select("question_id", F.when(F.col("d").isNull() & F.col("f").isNull(), F.lit(NONE)).otherwise(F.array_join(lines, "\n")).alias("text"))
