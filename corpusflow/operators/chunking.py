"""Structural chunks of files, their parent sections, and reading sections back.

Headings, clauses and appendices of a file are told apart by windows in the order of its items; texts
meet only inside one section, or where a file has no structure at all. Which neighbours share a chunk
or a parent depends on what came before, so that is decided by a small helper on arrays of sizes.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import ids
from ..functions.text import bare_number, clause_number, cut_words, header_number, sentences, strip, word_count, words
from ..runtime import cut
from ..settings import ChunkSettings

# How appendices, contents lines and attributions are written, and the parts of a file that aren't text
APPENDIX = r"(?iuU)^\s*Приложение\s*(?:№|N|#)?\s*(\d+[а-яa-z]?)(?=[\s.:;)]|$)"
AFTER_NUMBER = r"(?U)^\s*(\d+(?:\.\d+)*)[.)]?(?=\s+\S)"
CONTENTS = r"(?U)(?:\t|\.{3,}|…)\s*\d{1,3}\s*$"
ATTRIBUTION = r"(?iuU)^\s*к\s"
BLANKS = r"[ \t\u00a0]+"
SKIPPED = ("page_header", "page_footer", "footnote", "picture", "formula", "document_index")
HEADINGS = ("section_header", "title")
NO_COLUMN = "колонка "

Counter = Callable[[Column], Column]  # tokens of a text; built of Spark's functions, as it is used inside arrays too


# ---------------------------------------------------------------- sizes to spans
# Each helper is called once a row: as nondeterministic functions the optimizer won't copy them into filters.


def spans(sizes: Column, limit: Column, overlap: Column | int = 0) -> Column:
    """``array<array<int>>``: first place and number of the neighbours in each window of at most ``limit``.

    A window repeats the last places of the one before until ``overlap`` is reached, as far as the
    next place still fits. A place larger than the limit has a window of its own.
    """

    @F.pandas_udf("array<array<int>>")
    def cut_up(lists: pd.Series, limits: pd.Series, overlaps: pd.Series) -> pd.Series:
        def windows(size: list[int], most: int, shared: int) -> list[list[int]]:
            out, at, total = [], 0, 0
            for i, n in enumerate(size):
                if i > at and total + n > most:
                    out.append([at, i - at])
                    back, repeated = i, 0
                    while back - 1 > at and repeated < shared and repeated + size[back - 1] + n <= most:
                        back -= 1
                        repeated += size[back]
                    at, total = back, repeated
                total += n
            return [*out, [at, len(size) - at]] if len(size) else out

        return pd.Series([windows(list(s), m, o) for s, m, o in zip(lists, limits, overlaps)], dtype=object)

    return cut_up.asNondeterministic()(sizes, limit, F.lit(overlap) if isinstance(overlap, int) else overlap)


def pack_starts(sizes: Column, room: Column) -> Column:
    """First places of the windows of ``spans`` without overlap, by Spark alone, after which a file's rows still lie together."""
    start = F.struct(F.array(F.lit(0)).alias("starts"), F.lit(0).alias("at"), F.lit(0).cast("bigint").alias("total"))

    def step(held: Column, i: Column) -> Column:
        size = F.get(sizes, i).cast("bigint")
        full = (i > held["at"]) & (held["total"] + size > room)
        return F.struct(
            F.when(full, F.concat(held["starts"], F.array(i))).otherwise(held["starts"]).alias("starts"), F.when(full, i).otherwise(held["at"]).alias("at"), (F.when(full, F.lit(0).cast("bigint")).otherwise(held["total"]) + size).alias("total")
        )

    return F.aggregate(F.sequence(F.lit(0), F.size(sizes) - 1), start, step, lambda held: held["starts"])


def slices(rows: str, starts: str) -> Column:
    """An array's neighbours from each start to the next."""
    return F.transform(F.col(starts), lambda at, k: F.slice(F.col(rows), at + 1, F.coalesce(F.get(starts, k + 1), F.size(rows)) - at))


def row_spans(sizes: Column, room: Column) -> Column:
    """Like ``spans`` without overlap, where a place that is larger than the room is alone even beside smaller ones."""

    @F.pandas_udf("array<array<int>>")
    def cut_up(lists: pd.Series, rooms: pd.Series) -> pd.Series:
        def runs(size: list[int], most: int) -> list[list[int]]:
            out: list[list[int]] = []
            total = most + 1
            for i, n in enumerate(size):
                if n > most or total + n > most:
                    out.append([i, 0])
                    total = 0
                out[-1][1] += 1
                total = most + 1 if n > most else total + n
            return out

        return pd.Series([runs(list(s), m) for s, m in zip(lists, rooms)], dtype=object)

    return cut_up.asNondeterministic()(sizes, room)


def draft_numbers(sizes: Column, clauses: Column, marks: Column, least: int) -> Column:
    """The number of the draft that each paragraph of a section falls into.

    A paragraph without a number goes on with a draft that has a line ending in a colon, if it is
    a list item or the line before it ends in a colon, semicolon or comma. Others open a draft
    where the clause changes or ``least`` tokens are reached; entries of an appendix stay together.
    Marks are bits: 1 numbered, 2 list item, 4 ends in a colon, 8 ends in a semicolon or comma, 16 entry.
    """

    @F.pandas_udf("array<int>")
    def number(all_sizes: pd.Series, all_clauses: pd.Series, all_marks: pd.Series) -> pd.Series:
        out = []
        for size, clause, mark in zip(all_sizes, all_clauses, all_marks):
            own, draft, total, seen, previous, current = [], -1, 0, 0, 0, None
            for n, c, m in zip(size, clause, mark):
                goes_on = draft >= 0 and not m & 1 and seen & 4 and (m & 2 or previous & 12)
                together = m & 16 and seen & 16
                if not goes_on and (draft < 0 or c != current or (total >= least and not together)):
                    draft, total, seen, current = draft + 1, 0, 0, c
                own.append(draft)
                total, previous = total + n, m
                seen |= m & 4 if goes_on else m & 20
            out.append(own)
        return pd.Series(out, dtype=object)

    return number.asNondeterministic()(sizes, clauses, marks)


# ---------------------------------------------------------------- texts and tables in windows


def by_words(text: Column, limit: Column, counter: Counter) -> Column:
    """A text longer than the limit, cut between words into parts that fit however long its words are.

    Words and step are bound as variables: what an inner function takes from outside is made anew for each part.
    """
    blank = counter(F.lit(" "))
    step = lambda w: F.greatest(F.lit(1), F.floor((limit + blank) / F.greatest(F.lit(1), F.array_max(F.transform(w, counter)) + blank)).cast("int"))
    bound = F.transform(F.array(words(text)), lambda w: F.struct(w.alias("words"), step(w).alias("step")))
    cut_up = lambda b: F.transform(F.sequence(F.lit(0), F.size(b["words"]) - 1, b["step"]), lambda i: F.array_join(F.slice(b["words"], i + 1, b["step"]), " "))
    return F.when(counter(text) <= limit, F.array(text)).otherwise(F.flatten(F.transform(bound, cut_up)))


def with_windows(rows: DataFrame, text: str, limit: str, overlap: int, counter: Counter = word_count) -> DataFrame:
    """``rows`` with ``windows``: the text if it fits, else runs of whole sentences that overlap."""
    fits = counter(F.col(text)) <= F.col(limit)
    pieces = F.flatten(F.transform(sentences(F.col(text)), lambda s: by_words(s, F.col(limit), counter)))
    made = rows.withColumn("__pieces", F.when(~fits, pieces).otherwise(F.array().cast("array<string>")))
    blank = counter(F.lit(" "))  # what joining costs, nothing where words are counted
    made = made.withColumn("__sizes", F.transform("__pieces", lambda p: counter(p) + blank))
    made = made.withColumn("__spans", spans(F.col("__sizes"), F.col(limit) + blank, F.least(F.lit(overlap), F.col(limit) - 1)))
    joined = F.transform("__spans", lambda s: F.array_join(F.slice("__pieces", s[0] + 1, s[1]), " "))
    return made.withColumn("windows", F.when(F.size("__pieces") > 0, joined).otherwise(F.array(text))).drop("__pieces", "__sizes", "__spans")


def cells_of(line: Column) -> Column:
    inner = F.regexp_replace(strip(line), r"^\||\|$", "")
    return F.transform(F.split(inner, r"\|"), lambda c: F.regexp_replace(c, r"(?U)^[\s*]+|[\s*]+$", ""))


def table_windows(rows: DataFrame, key: list[str], text: str, limit: str, overlap: int, counter: Counter = word_count) -> DataFrame:
    """``key, place, part``: tables that fit, others as parts under a repeated header, in order of ``place``.

    A row too wide for its header becomes ``column: value`` records, a header too wide for
    anything beside it becomes text before the rows.
    """
    lines = F.split(F.col(text), "\n")
    read = rows.select(*key, F.col(text).alias("table"), F.col(limit).alias("limit"), F.slice(lines, 1, 2).alias("head"), F.slice(lines, 3, 1_000_000_000).alias("body"))
    read = read.withColumn("names", cells_of(F.get("head", 0))).withColumn("wide", counter(F.array_join("head", "\n")))
    fits = counter(F.col("table")) <= F.col("limit")
    whole = read.where(fits).select(*key, F.array(F.lit(0), F.lit(0)).alias("place"), F.col("table").alias("part"))
    large = read.where(~fits)

    headers = large.where(F.col("wide") >= F.col("limit")).withColumn("named", F.array_join(F.filter("names", lambda n: n != ""), " | "))
    headers = with_windows(headers, "named", "limit", overlap, counter).select(*key, F.posexplode("windows").alias("i", "part")).select(*key, F.array(F.lit(-1), "i").alias("place"), "part")

    room = F.greatest(F.col("limit") - F.col("wide"), F.lit(0))
    grouped = large.where(F.size("body") > 0).withColumn("sizes", F.transform("body", counter)).withColumn("room", room)
    grouped = grouped.withColumn("runs", row_spans(F.col("sizes"), F.col("room"))).select("*", F.posexplode("runs").alias("i", "run"))
    alone = F.get("sizes", F.get("run", 0)) > F.col("room")
    under = grouped.where(~alone).select(*key, F.array("i", F.lit(0)).alias("place"), F.array_join(F.concat("head", F.slice("body", F.get("run", 0) + 1, F.get("run", 1))), "\n").alias("part"))

    cells = grouped.where(alone).withColumn("cells", cells_of(F.get("body", F.get("run", 0))))
    named = F.transform("cells", lambda c, i: F.when(c != "", F.concat(F.coalesce(F.nullif(F.get("names", i), F.lit("")), F.concat(F.lit(NO_COLUMN), (i + 1).cast("string"))), F.lit(": "), c)))
    pairs = F.flatten(F.transform(F.filter(named, lambda p: p.isNotNull()), lambda p: by_words(p, F.col("limit"), counter)))
    records = cells.withColumn("pairs", pairs).withColumn("pair_sizes", F.transform("pairs", counter)).withColumn("cuts", spans(F.col("pair_sizes"), F.col("limit")))
    records = records.select(*key, "i", "pairs", F.posexplode("cuts").alias("j", "cut")).select(*key, F.array("i", "j").alias("place"), F.array_join(F.slice("pairs", F.get("cut", 0) + 1, F.get("cut", 1)), "\n").alias("part"))
    return whole.unionByName(headers).unionByName(under).unionByName(records)


# ---------------------------------------------------------------- from items to pieces


def layout_of(items: DataFrame) -> tuple[list[int], list[int], bool]:
    """Depths of tables and skipped parts, levels that headings may have, and whether there are tables; as many as layouts nest.

    A heading without a level lies one below the last that has one, or on the top.
    """
    blocks = F.col("label").isin("table", *SKIPPED)
    level = heading_level(F.col("label").isin(*HEADINGS))
    found = items.agg(
        F.collect_set(F.when(blocks, F.coalesce("depth", F.lit(0)))).alias("depths"), F.collect_set(F.when(level > 0, level)).alias("levels"), F.bool_or(F.col("label") == "table").alias("tables")
    ).first()
    given = {1, *found["levels"]}
    return sorted(found["depths"]), sorted(given | {n + 1 for n in given}), bool(found["tables"])


def visible_items(items: DataFrame, depths: list[int]) -> DataFrame:
    """``items`` without what lies inside tables and skipped parts, which have these depths: deeper items up to the next of at most their depth."""
    blocks = F.col("label").isin("table", *SKIPPED)
    deep = items.withColumn("depth", F.coalesce("depth", F.lit(0)))
    before = Window.partitionBy("file_sha256").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    hidden = F.lit(False)
    for d in depths:
        last = F.last(F.when(F.col("depth") <= d, F.struct(((F.col("depth") == d) & blocks).alias("blocks"))), ignorenulls=True).over(before)
        hidden = hidden | ((F.col("depth") > d) & F.coalesce(last["blocks"], F.lit(False)))
    return deep.withColumn("hidden", hidden).where("not hidden").drop("hidden")


def heading_level(heading: Column) -> Column:
    """The level of an item that is a heading: its marks, else its own level; 0 of others."""
    marks = F.regexp_extract(F.coalesce("text", F.lit("")), r"^\s*(#+)\s*", 1)
    return F.when(heading, F.when(marks != "", F.length(marks)).when(F.coalesce("header_level", F.lit(0)) == 0, 1).otherwise(F.col("header_level"))).otherwise(0)


def after_number(c: Column) -> Column:
    return strip(F.regexp_replace(c, AFTER_NUMBER, ""))


def read_pieces(items: DataFrame, depths: list[int], s: ChunkSettings) -> DataFrame:
    """``file_sha256, seq, kind, text, ref, page_no, level, number, listed``: headers, paragraphs and tables.

    Contents lines and skipped parts drop out; a paragraph that is a number only joins the next
    one that has none. Short paragraphs with a whole number are headers without a level.
    """
    label, raw = F.col("label"), F.coalesce("text", F.lit(""))
    kind = F.when(label == "table", "table").when(label.isin(*HEADINGS), "header").otherwise("paragraph")
    shown = visible_items(items, depths).where(~label.isin(*SKIPPED) & (strip(raw) != "") & ((label == "table") | ~raw.rlike(CONTENTS)))
    plain = strip(F.regexp_replace(F.when(kind == "header", F.regexp_replace(raw, r"^\s*#+\s*", "")).otherwise(raw), BLANKS, " "))
    rows = shown.select(
        "file_sha256", "seq", kind.alias("kind"), F.when(kind == "table", strip(raw)).otherwise(plain).alias("text"), F.coalesce("self_ref", F.lit("")).alias("ref"), "page_no", heading_level(kind == "header").alias("level"),
        F.when((label == "list_item") & F.coalesce("enumerated", F.lit(False)), F.col("marker")).alias("marker"), (label == "list_item").alias("listed"),
    )
    own, marked = clause_number(F.col("text")), bare_number(F.col("marker"))
    rows = rows.withColumn("own", own).withColumn("marked", marked)
    rows = rows.withColumn("text", F.when((F.col("kind") == "paragraph") & F.col("marked").isNotNull() & F.col("own").isNull(), F.concat(strip(F.col("marker")), F.lit(" "), "text")).otherwise(F.col("text")))
    rows = rows.withColumn("number", F.when(F.col("kind") == "header", header_number(F.col("text"))).when(F.col("kind") == "paragraph", F.coalesce("marked", "own")))
    rows = rows.withColumn("lone", F.when((F.col("kind") == "paragraph") & F.col("number").isNull(), bare_number(F.col("text"))))
    before = Window.partitionBy("file_sha256").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    waiting = F.last(F.when(F.col("kind") == "paragraph", F.struct("lone")), ignorenulls=True).over(before)["lone"]
    joins = F.col("number").isNull() & F.col("waiting").isNotNull() & F.col("lone").isNull()
    rows = rows.withColumn("waiting", F.when(F.col("kind") == "paragraph", waiting)).withColumn("joins", joins).where("lone is null")
    rows = rows.withColumn("text", F.when(F.col("joins"), F.concat("waiting", F.lit(". "), "text")).otherwise(F.col("text"))).withColumn("number", F.when(F.col("joins"), F.col("waiting")).otherwise(F.col("number")))
    rest = after_number(F.col("text"))
    titled = (F.col("kind") == "paragraph") & F.col("number").isNotNull() & ~F.col("number").contains(".") & (rest != "") & ~rest.rlike(r"[.;:]$") & (word_count(rest) <= s.title_max_words)
    return rows.select("file_sha256", "seq", F.when(titled, "header").otherwise(F.col("kind")).alias("kind"), "text", "ref", "page_no", "level", "number", "listed")


def without_titles(pieces: DataFrame) -> DataFrame:
    """``pieces`` without the only heading of the top level where it opens a file; ``title`` holds it, ``place`` counts what is left."""
    by = Window.partitionBy("file_sha256").orderBy("seq")
    real = F.when((F.col("kind") == "header") & (F.col("level") > 0), F.col("level"))
    later = F.min(real).over(by.rowsBetween(1, Window.unboundedFollowing))
    first = (F.row_number().over(by) == 1) & real.isNotNull() & (later.isNull() | (later > real))
    rows = pieces.withColumn("opens", first)
    every = Window.partitionBy("file_sha256")
    rows = rows.withColumn("title", F.max(F.when(F.col("opens"), F.col("text"))).over(every)).where("not opens").drop("opens")
    return rows.withColumn("place", F.row_number().over(by))


def open_appendices(pieces: DataFrame, s: ChunkSettings) -> DataFrame:
    """``pieces`` where an appendix mark past the first piece is a header, with ``refs`` and ``appendix``.

    Up to two short paragraphs after it, past lines of attribution, are its title; text after the
    mark is one of them.
    """
    number = F.regexp_extract("text", APPENDIX, 1)
    mark = F.col("text").rlike(APPENDIX)
    starts = (F.col("kind") == "paragraph") & (F.col("place") > 1) & mark & (word_count(F.col("text")) <= s.appendix_max_words)
    by = Window.partitionBy("file_sha256").orderBy("seq")
    rows = pieces.withColumn("starts", starts).withColumn("ap", F.sum(F.col("starts").cast("int")).over(by))
    group = Window.partitionBy("file_sha256", "ap")
    along = group.orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inline = F.regexp_replace(F.regexp_replace("text", APPENDIX, ""), r"^[ .:;—-]+|[ .:;—-]+$", "")
    rows = rows.withColumn("inline", F.max(F.when(F.col("starts"), inline)).over(group))
    stops = ~F.col("starts") & ((F.col("kind") != "paragraph") | F.col("number").isNotNull() | mark)
    rows = rows.withColumn("open", (F.col("ap") > 0) & ~F.col("starts") & ~F.max(stops).over(along))
    own = F.when(F.col("open") & ((F.col("inline") != "") | ~F.col("text").rlike(ATTRIBUTION)), F.col("seq"))
    rows = rows.withColumn("from", F.min(own).over(group)).withColumn("inside", F.col("open") & (F.col("seq") >= F.col("from")))
    good = (word_count(F.col("text")) <= s.appendix_title_max_words) & ~F.col("text").rlike(r"[.;:]\s*$")
    fine = F.min(F.when(F.col("inside"), good).otherwise(F.lit(True))).over(along)
    counted = F.sum(F.col("inside").cast("int")).over(along)
    rows = rows.withColumn("titles", F.col("inside") & fine & (counted <= 2 - (F.col("inline") != "").cast("int")))
    held = F.sort_array(F.collect_list(F.when(F.col("titles"), F.struct("seq", "text", "ref"))).over(group))
    rows = rows.withColumn("held", held).where("not titles")
    name = F.concat_ws(". ", F.concat(F.lit(f"{s.appendix_word} № "), number), F.nullif(F.array_join(F.concat(F.filter(F.array("inline"), lambda t: t != ""), F.transform("held", lambda h: h["text"])), " "), F.lit("")))
    is_, refs = F.col("starts"), F.array("ref")
    return rows.select(
        "file_sha256", "seq", F.when(is_, "header").otherwise(F.col("kind")).alias("kind"), F.when(is_, name).otherwise(F.col("text")).alias("text"),
        F.when(is_, F.concat(refs, F.transform("held", lambda h: h["ref"]))).otherwise(refs).alias("refs"), "page_no", "level", F.when(~is_, F.col("number")).alias("number"), "listed", "title", is_.alias("appendix"),
    )


def crumb(text: Column, number: Column, s: ChunkSettings) -> Column:
    """How a heading is shown in a path."""
    short = lambda c: F.when(word_count(c) > s.crumb_max_words, cut_words(c, s.crumb_max_words)).otherwise(c)
    rest = after_number(text)
    clause = F.concat_ws(" ", F.lit(s.clause_word), number, F.when((rest != "") & (word_count(rest) <= s.title_max_words), rest))
    return F.when(number.isNull(), short(text)).when(number.contains("."), clause).otherwise(short(F.concat(F.lit(f"{s.section_word} "), text)))


def placed_pieces(pieces: DataFrame, levels: list[int], s: ChunkSettings) -> DataFrame:
    """Paragraphs and tables with their ``section`` (the path of headings above them), ``heading``, ``inside`` an appendix, and ``run``.

    A heading closes all others of its level or below. One without a level lies under the last
    that has one; appendices lie on the file's top level. A run ends at each heading and table.
    """
    by = Window.partitionBy("file_sha256").orderBy("seq")
    header = F.col("kind") == "header"
    top = F.coalesce(F.min(F.when(header & (F.col("level") > 0), F.col("level"))).over(Window.partitionBy("file_sha256")), F.lit(1))
    rows = pieces.withColumn("real", F.when(header & F.col("appendix"), top).when(header & (F.col("level") > 0), F.col("level")))
    above = F.last("real", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("level", F.when(header, F.coalesce("real", F.coalesce(above, F.lit(0)) + 1)))
    structural = F.max(header | ((F.col("kind") == "paragraph") & F.col("number").isNotNull())).over(Window.partitionBy("file_sha256"))
    rows = rows.withColumn("structural", structural).withColumn("crumb", F.when(header, crumb(F.col("text"), F.col("number"), s)))
    here = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    open_ = [F.last(F.when(F.col("level") <= n, F.struct("level", "crumb", "text", "appendix")), ignorenulls=True).over(here) for n in levels]
    shape = "array<struct<level:int,crumb:string,text:string,appendix:boolean>>"
    stack = F.filter(F.array(*[F.when(o["level"] == n, o) for o, n in zip(open_, levels)]).cast(shape), lambda h: h.isNotNull())
    breaks = header | ((F.col("kind") == "table") & F.col("structural"))
    rows = rows.withColumn("stack", stack).withColumn("run", F.sum(breaks.cast("int")).over(here)).where("kind <> 'header'")
    whole = F.when(F.col("title").isNull(), F.array().cast("array<string>")).otherwise(F.array(crumb(F.col("title"), F.lit(None).cast("string"), s)))
    return rows.select(
        "file_sha256", "seq", "kind", "text", "refs", "page_no", "number", "listed", "structural", "run",
        F.when(F.col("structural"), F.transform("stack", lambda h: h["crumb"])).otherwise(whole).alias("section"),
        F.when(F.col("structural"), F.get(F.transform("stack", lambda h: h["text"]), F.size("stack") - 1)).otherwise(F.col("title")).alias("heading"),
        F.exists("stack", lambda h: h["appendix"]).alias("inside"),
    )


# ---------------------------------------------------------------- chunks and parents


def drafts_of(placed: DataFrame, tables: bool, s: ChunkSettings, counter: Counter) -> DataFrame:
    """``file_sha256, seq, kind, structural, section, heading, clause, page_no, body, refs``: what is cut into chunks.

    Neighbouring paragraphs of a clause are merged while short, lists stay with what opens them,
    tables stand alone. A file without structure is one text, with its tables after it.
    """
    entry = F.coalesce(F.col("number").isNotNull() & ~F.col("number").contains(".") & F.col("inside"), F.lit(False))
    bits = lambda *pairs: sum((F.when(c, F.lit(b)).otherwise(F.lit(0)) for c, b in pairs), F.lit(0))
    mark = bits((F.col("number").isNotNull(), 1), (F.col("listed"), 2), (F.col("text").rlike(r"(?U):\s*$"), 4), (F.col("text").rlike(r"(?U)[;,]\s*$"), 8), (entry, 16))
    texts = placed.where("kind = 'paragraph'").withColumn("clause", F.when(~entry, F.col("number"))).withColumn("mark", mark).withColumn("size", counter(F.col("text")))
    rows = F.sort_array(F.collect_list(F.struct("seq", "size", "clause", "mark", "text", "refs", "page_no")))
    runs = texts.groupBy("file_sha256", "structural", "run").agg(rows.alias("rows"), F.first("section").alias("section"), F.first("heading").alias("heading"))
    each_of = lambda name: F.transform("rows", lambda r: r[name])
    numbered = runs.select("*", each_of("size").alias("sizes"), each_of("clause").alias("clauses"), each_of("mark").alias("marks"))
    own = draft_numbers(F.col("sizes"), F.col("clauses"), F.col("marks"), s.min_tokens)
    numbered = numbered.withColumn("own", own).withColumn("own", F.when(F.col("structural"), F.col("own")).otherwise(F.transform("own", lambda _: F.lit(0))))
    starts = F.filter(F.sequence(F.lit(0), F.size("own") - 1), lambda i: (i == 0) | (F.get("own", i) != F.get("own", i - 1)))
    held = numbered.withColumn("starts", starts).select("file_sha256", "structural", "section", "heading", F.explode(slices("rows", "starts")).alias("rows"))
    merged = held.select(
        "file_sha256", F.get("rows", 0)["seq"].alias("seq"), F.lit("text").alias("kind"), "structural", "section", "heading", F.when(F.col("structural"), F.get("rows", 0)["clause"]).alias("clause"),
        F.get("rows", 0)["page_no"].alias("page_no"), F.array_join(F.transform("rows", lambda r: r["text"]), "\n").alias("body"), F.flatten(F.transform("rows", lambda r: r["refs"])).alias("refs"),
    )
    if not tables:
        return merged
    apart = placed.where("kind = 'table'").select("file_sha256", "seq", "kind", "structural", "section", "heading", F.lit(None).cast("string").alias("clause"), "page_no", F.col("text").alias("body"), "refs")
    return merged.unionByName(apart)


def chunk_items(items: DataFrame, settings: ChunkSettings = ChunkSettings(), counter: Counter = word_count, roots: DataFrame | None = None, hold: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Chunks and parent sections of ``items(file_sha256, seq, depth, label, text, ..)``.

    ``roots(file_sha256, root)`` puts a path before all sections of a file. Parents have the ids
    of their chunks as ``item_refs``. Both are made from the items each time they are read; who reads
    both gives ``hold`` (``runtime.cut``, say), which gets the one table that they are made of.
    """
    s = settings
    depths, levels, tables = layout_of(items)
    drafts = drafts_of(placed_pieces(open_appendices(without_titles(read_pieces(items, depths, s)), s), levels, s), tables, s, counter)
    none = F.array().cast("array<string>")
    drafts = drafts.withColumn("root", none) if roots is None else drafts.join(roots.select("file_sha256", "root"), "file_sha256", "left").withColumn("root", F.coalesce("root", none))
    path = F.concat("root", "section")
    crumbs = lambda path: F.when(F.col("clause").isNull(), path).otherwise(F.concat(path, F.array(F.concat(F.lit(f"{s.clause_word} "), "clause"))))
    rows = drafts.withColumn("budget", F.greatest(F.lit(s.max_tokens) - counter(F.array_join(crumbs(path), s.separator)), F.lit(s.overlap_tokens + 1)))
    rows = cut(rows) if tables else rows  # which are read in several ways
    facts = ["file_sha256", "seq", "kind", "structural", "root", "section", "heading", "clause", "page_no", "refs"]
    made = with_windows(rows.where("kind = 'text'"), "body", "budget", s.overlap_tokens, counter).select(*facts, F.posexplode("windows").alias("i", "body"))
    made = made.withColumn("refs", F.when(F.col("i") == 0, F.col("refs"))).withColumn("place", F.array(F.lit(0), "i")).drop("i")  # a draft's refs go with its first window
    if tables:
        made = made.unionByName(table_windows(rows.where("kind = 'table'"), facts, "body", "budget", s.overlap_tokens, counter).withColumnRenamed("part", "body"))
    order = Window.partitionBy("file_sha256").orderBy(F.when(F.col("structural") | (F.col("kind") == "text"), 0).otherwise(1), "seq", "place")
    made = made.withColumn("ordinal", F.row_number().over(order) - 1)
    # what follows from these columns is made after they are moved
    key = F.when(F.col("structural"), F.array_join("section", s.separator)).otherwise("")
    slim = made.select(
        "file_sha256", ids.chunk_id(F.col("file_sha256"), F.col("ordinal")).alias("chunk_id"), "ordinal", "kind", F.when(F.col("structural"), "structural").otherwise("fixed").alias("strategy"),
        path.alias("path"), key.alias("section_key"), "heading", "clause", "body", "page_no", F.col("refs").alias("item_refs"),
    )
    packed = packed_chunks(slim, s, counter)
    packed = packed if hold is None else hold(packed)
    prefix = F.array_join("breadcrumbs", s.separator)
    text = F.when(prefix == "", F.col("body")).otherwise(F.concat(prefix, F.lit("\n"), "body"))
    along = Window.partitionBy("file_sha256").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chunks = children_in(packed).withColumn("item_refs", F.last("item_refs", ignorenulls=True).over(along)).withColumn("breadcrumbs", crumbs(F.col("path"))).withColumn("text", text).withColumn("tokens", counter(F.col("text")))
    columns = ["file_sha256", "ordinal", "chunk_id", "kind", "strategy", "breadcrumbs", "section_key", "heading", "clause", "body", "text", "tokens", "page_no", "item_refs", "parent_id"]
    return chunks.select(*columns), parents_in(packed, s, counter)


def parents_of(chunks: DataFrame, settings: ChunkSettings = ChunkSettings(), counter: Counter = word_count) -> tuple[DataFrame, DataFrame]:
    """``chunks`` with ``parent_id``, and the parents: neighbours under one path, packed whole up to the token limit.

    ``part`` of ``parts`` counts a path's parents in the whole file.
    """
    packed = packed_chunks(chunks, settings, counter)
    return children_in(packed).drop("path"), parents_in(packed, settings, counter)


def packed_chunks(chunks: DataFrame, s: ChunkSettings, counter: Counter) -> DataFrame:
    """``file_sha256, path, rows``: a row per parent, with its chunks. Neighbours under one path meet, and aren't moved where their file's chunks lie together."""
    by = Window.partitionBy("file_sha256").orderBy("ordinal")
    changes = ~F.coalesce(F.lag("path").over(by) == F.col("path"), F.lit(False))
    rows = chunks.withColumn("new", changes.cast("int")).withColumn("run", F.sum("new").over(by))
    held = F.struct("ordinal", *[c for c in chunks.columns if c not in ("file_sha256", "path", "ordinal")])
    runs = rows.groupBy("file_sha256", "run").agg(F.first("path").alias("path"), F.sort_array(F.collect_list(held)).alias("rows"))
    room = F.lit(s.parent_max_tokens) - counter(F.array_join("path", s.separator))
    packed = runs.withColumn("room", room).withColumn("sizes", F.transform("rows", lambda r: counter(r["body"]))).withColumn("starts", pack_starts(F.col("sizes"), F.col("room")))
    return packed.select("file_sha256", "path", F.explode(slices("rows", "starts")).alias("rows"))


def numbered_parents(rows: DataFrame) -> DataFrame:
    """``rows(file_sha256, path, first, ..)`` of parents with ``n``, ``part``, ``parts`` and ``parent_id``."""
    same = Window.partitionBy("file_sha256", "path")
    each = rows.withColumn("n", F.row_number().over(Window.partitionBy("file_sha256").orderBy("first")) - 1)
    each = each.withColumn("part", F.row_number().over(same.orderBy("n"))).withColumn("parts", F.count(F.lit(1)).over(same).cast("int"))
    return each.withColumn("parent_id", ids.parent_id(F.col("file_sha256"), F.col("n"))).drop("first")


def children_in(packed: DataFrame) -> DataFrame:
    """Chunks with their ``parent_id`` and ``path``."""
    owners = numbered_parents(packed.withColumn("first", F.get("rows", 0)["ordinal"]))
    return owners.select("file_sha256", "path", "parent_id", F.inline("rows"))


def parents_in(packed: DataFrame, s: ChunkSettings, counter: Counter) -> DataFrame:
    """The parents, whose tokens are counted before they are numbered: then texts that aren't read needn't be sorted."""
    prefix, lead = F.array_join("path", s.separator), F.get("rows", 0)
    text = F.when(prefix == "", F.col("body")).otherwise(F.concat(prefix, F.lit("\n"), "body"))
    told = packed.select(
        "file_sha256", "path", lead["ordinal"].alias("first"), lead["section_key"].alias("section_key"), lead["heading"].alias("heading"), lead["page_no"].alias("page_no"),
        F.array_join(F.transform("rows", lambda r: r["body"]), "\n\n").alias("body"), F.transform("rows", lambda r: r["chunk_id"]).alias("item_refs"),
    )
    return numbered_parents(told.withColumn("tokens", counter(text))).select(
        "file_sha256", F.col("parent_id").alias("chunk_id"), F.col("n").alias("ordinal"), F.lit("section").alias("kind"), F.lit("parent").alias("strategy"), F.col("path").alias("breadcrumbs"),
        "section_key", "heading", "body", text.alias("text"), "tokens", "page_no", "item_refs", "part", "parts",
    )


# ---------------------------------------------------------------- built-in parts


def section_runs(chunks: DataFrame) -> DataFrame:
    """``chunks`` with ``run``: the number of the run of neighbours of a file under the same ``section``."""
    order = Window.partitionBy("file_id").orderBy("n")
    starts = F.coalesce(~F.lag("section").over(order).eqNullSafe(F.col("section")), F.lit(True)) | (F.row_number().over(order) == 1)
    return chunks.withColumn("start", starts.cast("int")).withColumn("run", F.sum("start").over(order)).drop("start")


def numbered_parts(parents: DataFrame) -> DataFrame:
    """``parents`` with ``part`` of ``parts`` per section of a file, counted over the whole file."""
    by = Window.partitionBy("file_id", "section")
    return parents.withColumn("part", F.row_number().over(by.orderBy("run"))).withColumn("parts", F.count(F.lit(1)).over(by).cast("int"))


def read_document(parents: DataFrame, requests: DataFrame, settings: ChunkSettings = ChunkSettings()) -> DataFrame:
    """``doc_id, place, section_id, total, next_offset``: sections from an offset within the token and count budgets, at least one.

    ``requests`` has ``(doc_id, offset)``; sections are ordered by role, file name and index.
    """
    roles = F.array_position(F.array(*map(F.lit, ("main", "appendix", "supplement"))), F.col("file_role"))
    order = Window.partitionBy("doc_id").orderBy(F.when(roles > 0, roles).otherwise(99), "file_name", "n")
    placed = parents.withColumn("place", F.row_number().over(order) - 1).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))
    asked = placed.join(requests, "doc_id").withColumn("start", F.least(F.greatest("offset", F.lit(0)), F.col("total") - 1)).where(F.col("place") >= F.col("start"))
    used = F.sum("tokens").over(Window.partitionBy("doc_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    fits = (F.col("place") == F.col("start")) | ((F.col("used") <= settings.content_max_tokens) & (F.col("place") - F.col("start") < settings.content_max_sections))
    kept = asked.withColumn("used", used).where(fits)
    end = F.max("place").over(Window.partitionBy("doc_id")) + 1
    return kept.select("doc_id", "place", "section_id", "total", F.when(end < F.col("total"), end).alias("next_offset"))


def find_sections(requests: DataFrame, parents: DataFrame, chunks: DataFrame) -> DataFrame:
    """``doc_id, wanted, section_id, other_document``: a section by its own id or by that of one of its chunks."""
    own = parents.select(F.col("section_id").alias("wanted"), F.col("section_id").alias("s1"), F.col("doc_id").alias("d1"))
    via = chunks.select(F.col("chunk_id").alias("wanted"), F.col("parent_id").alias("section_id")).join(parents.select("section_id", F.col("doc_id").alias("d2")), "section_id").select("wanted", F.col("section_id").alias("s2"), "d2")
    met = requests.join(own, "wanted", "left").join(via, "wanted", "left")
    return met.select("doc_id", "wanted", F.coalesce("s1", "s2").alias("section_id"), (F.coalesce("d1", "d2") != F.col("doc_id")).alias("other_document"))
