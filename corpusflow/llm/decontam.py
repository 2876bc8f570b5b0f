"""Benchmark decontamination on question templates.

Numbers, units and names are replaced by typed placeholders that keep their value aside. Windows of
template tokens are joined by hash with the benchmark's, so a question whose parameters were changed
still matches. The values then decide: wherever an item lies along a document at one and the same
offset, each benchmark value must stand for one and the same document value, as it does in a question
asked anew and does not where two texts merely share a form. A document that holds an item several
times, or several items of one template, is judged for each on its own.

A capitalised word that opens a sentence may be a name or not, so windows with one are taken both
ways. Windows are also compared literally, without placeholders; an equal one is a copy, however
many numbers it has. An item whose windows are mostly placeholders is compared as a whole, with its
units and names counted as words. An item too short for a window is looked for as a sentence or line
of its own.

Items that a window can't tell apart are judged once, as a group: those that hold the same literal
window, and those of one template whose values are equal and different in the same places.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import body, cut, let, without_rows

# Units of measure, time and money in English, Spanish, French and German
UNITS = "km|cm|mm|m|kg|mg|g|lb|lbs|oz|l|ml|mph|kmh|hours|hour|minutes|minute|seconds|second|days|day|weeks|week|months|month|years|year|miles|mile|meters|meter|metres|feet|foot|inches|inch|dollars|dollar|euros|euro|cents|percent|horas|hora|minutos|minuto|segundos|segundo|días|día|semanas|semana|meses|mes|años|año|metros|metro|kilómetros|litros|litro|heures|heure|secondes|seconde|jours|jour|semaines|semaine|mois|ans|an|années|mètres|mètre|kilomètres|litres|litre|stunden|stunde|minuten|sekunden|sekunde|tage|tag|wochen|woche|monate|monat|jahre|jahr|kilometer|liter|prozent"
MARK, END = "\x01", "\x02"


@dataclass(frozen=True)
class DecontamSettings:
    window: int = 8  # template tokens
    shortest: int = 4  # items of fewer tokens match only as sentences or lines of their own, and those of one token nothing
    literal: float = 0.5  # share of the tokens of a window, or of an item without such windows, that must be literal, where placeholders are compared
    broadcast_windows: int = 2_000_000  # benchmark windows up to which they are sent to every task
    broadcast_rows: int = 2_000_000  # names of leaked rows up to which they are sent to every task


def template_tokens(text: Column) -> Column:
    """Tokens of a text; a placeholder is ``\\x01type\\x02value``, other tokens are runs of lower-case letters and digits.

    A name (type ``n``) is a capitalised word inside a sentence (after a letter, digit, comma or
    semicolon and one space); any other capitalised word is an opening (``o``); a unit follows a number; each run of digits that is a word of its own is a number.
    Patterns begin with what is rare, and those on numbers run only where there are digits.
    """
    t = F.when(text.rlike("[\x01\x02]"), F.regexp_replace(text, "[\x01\x02]", " ")).otherwise(text)
    t = F.regexp_replace(t, r"(?=\p{Lu})(?<=[\p{L}\p{N},;]\x20)(\p{Lu}\p{Ll}+)", f"{MARK}n{END}$1")
    t = F.regexp_replace(t, rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}_{END}])(\p{{Lu}}\p{{Ll}}+)", f"{MARK}o{END}$1")

    def numbers(x: Column) -> Column:
        x = F.regexp_replace(x, rf"(?<=\p{{N}})\x20?({UNITS})(?![\p{{L}}\p{{N}}])", f" {MARK}u{END}$1")
        return F.regexp_replace(x, rf"(?<![\p{{L}}\p{{N}}_{END}])(\p{{N}}+)(?![\p{{L}}\p{{N}}_])", f"{MARK}d{END}$1")

    t = let(t, lambda x: F.when(x.rlike(r"\p{N}"), numbers(x)).otherwise(x))
    return F.filter(F.split(F.lower(t), r"[^\p{L}\p{N}\x01\x02]+"), lambda x: x != "")


OPENING, NAME = f"{MARK}o", f"{MARK}n"


def slots_of(tokens: Column) -> Column:
    """``array<struct<at, opening, value>>`` of the placeholders and openings."""

    def slot(t: Column, i: Column) -> Column:
        return F.when(t.startswith(MARK), F.struct(i.alias("at"), t.startswith(OPENING).alias("opening"), F.substring_index(t, END, -1).alias("value")))

    return F.filter(F.transform(tokens, slot), lambda s: s.isNotNull())


def hashes_of(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.xxhash64(t))


def windows_of(hashes: Column, width: int) -> Column:
    """Hashes of the windows of ``width`` tokens, from token hashes."""
    many = F.transform(F.sequence(F.lit(1), F.size(hashes) - (width - 1)), lambda i: F.xxhash64(F.slice(hashes, i, width)))
    return F.when(F.size(hashes) >= width, many).otherwise(F.array().cast("array<bigint>"))


def slots_in(slots: Column, at: Column, width: Column, kind: Column) -> Column:
    """The slots of a window of some kind: 0 without openings, 1 with them, 2 none, as it is literal."""
    return F.filter(slots, lambda s: (s["at"] >= at) & (s["at"] < at + width) & (kind < 2) & ((kind == 1) | ~s["opening"]))


def _parsed(rows: DataFrame, *keep: str) -> DataFrame:
    """``slots`` of texts and token hashes: ``hashes`` with openings as words, ``named`` with openings as names, ``literal``.

    ``named`` and ``literal`` are null where they equal ``hashes``.
    """

    def both(tokens: Column) -> Column:
        value = lambda t: F.substring_index(t, END, -1)
        kind = lambda t: F.substring_index(t, END, 1)
        words = F.transform(tokens, lambda t: F.when(t.startswith(OPENING), value(t)).otherwise(kind(t)))
        names = F.transform(tokens, lambda t: F.when(t.startswith(OPENING), F.lit(NAME)).otherwise(kind(t)))
        opens = F.exists(tokens, lambda t: t.startswith(OPENING))
        typed = F.exists(tokens, lambda t: t.startswith(MARK) & ~t.startswith(OPENING))
        return F.struct(
            slots_of(tokens).alias("slots"),
            hashes_of(words).alias("hashes"),
            F.when(opens, hashes_of(names)).alias("named"),
            F.when(typed, hashes_of(F.transform(tokens, value))).alias("literal"),
        )

    found = rows.select(*keep, let(template_tokens(body()), both).alias("f"))
    return found.select(*keep, "f.slots", "f.hashes", "f.named", "f.literal")


def _windows(parsed: DataFrame, widths: list[int], *keep: str) -> DataFrame:
    """One row per window and kind that differs: ``keep``, ``width, at, kind, window``; of the text also ``n`` and, if kept, its arrays."""

    def part(width: int) -> DataFrame:
        none = F.array().cast("array<bigint>")
        made = [F.when(F.col(c).isNotNull(), windows_of(F.col(c), width)).otherwise(none).alias(short) for c, short in (("hashes", "a"), ("named", "b"), ("literal", "c"))]
        found = parsed.select(*keep, F.size("hashes").alias("n"), *made)
        rows = found.select(*keep, "n", "a", F.size("a").alias("many"), F.size("b").alias("more"), F.posexplode(F.concat("a", "b", "c")).alias("place", "window"))
        at = F.pmod(F.col("place"), F.col("many"))
        kind = F.when(F.col("place") < F.col("many"), 0).when(F.col("place") < F.col("many") + F.col("more"), 1).otherwise(2)
        rows = rows.where((F.col("place") < F.col("many")) | (F.col("window") != F.get(F.col("a"), at)))
        return rows.select(*keep, "n", F.lit(width).alias("width"), at.alias("at"), kind.alias("kind"), "window")

    out = part(widths[0])
    for width in widths[1:]:
        out = out.unionByName(part(width))
    return out


def units_of(text: Column, longest: int) -> Column:
    """Sentences and lines, and runs of neighbours of up to ``longest`` tokens in all, of two tokens or more.

    Literal tokens joined by blanks, sentences by ``|``. Brackets and quotes bound a sentence too.
    """
    parts = F.split(F.lower(text), r"[.!?:;\u2026]+(?![\p{L}\p{N}])|[\r\n()\[\]\u0022\u00ab\u00bb\u201c\u201d\u201e]+")
    clean = F.transform(parts, lambda p: F.array_join(F.filter(F.split(p, r"[^\p{L}\p{N}]+"), lambda w: w != ""), " "))

    def runs(units: Column) -> Column:
        found = F.flatten(F.transform(F.sequence(F.lit(1), F.size(units)), lambda i: F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda k: F.array_join(F.slice(units, i, k), "|"))))
        return F.when(F.size(units) > 0, F.array_distinct(found)).otherwise(F.array().cast("array<string>"))

    return F.filter(let(F.filter(clean, lambda u: u != ""), runs), lambda r: F.size(F.split(r, r"[ |]")).between(2, longest))


def _groups(rows: DataFrame, *window: str) -> tuple[DataFrame, DataFrame]:
    """Windows with the ``group`` of the items that hold them, and the groups' ``(group, item_id)``.

    Windows held by the same items share a group, which is named by sums over the items, so that no
    window's items are gathered.
    """
    rows = rows.select(*window, "item_id").distinct()
    sums = [F.count(F.lit(1)), F.bit_xor(F.xxhash64("item_id")), F.bit_xor(F.xxhash64("item_id", F.lit(1))), F.min("item_id")]
    held = rows.groupBy(*window).agg(F.xxhash64(*sums).alias("group"))
    one = held.groupBy("group").agg(F.min(F.struct(*window)).alias("w")).select("group", "w.*")
    return held, one.join(rows, list(window)).select("group", "item_id")


@dataclass(frozen=True)
class Known:
    """What a benchmark is looked for by.

    ``windows(width, window, group, plain, b_at, b_slots, whole, whole_hash)``; ``plain`` windows are
    evidence by themselves. ``whole`` is the length of an item that is compared as a whole from this
    window on. ``sentences(unit, group)`` are short items. ``members(group, item_id)``.
    """

    windows: DataFrame
    widths: list[int]
    sentences: DataFrame
    members: DataFrame


def benchmark_windows(benchmark: DataFrame, settings: DecontamSettings = DecontamSettings()) -> Known:
    """The windows of all items by groups of items; an item shorter than the window is one window of its own length.

    A window that recurs in an item has a row for each place, as each may tell another story of the
    values. Of a value only the first slot that has it is kept, as ``#place``, for only which slots
    are equal matters; an item without a window that is literal enough keeps its units and names.
    """
    parsed = cut(_parsed(benchmark.where("item_id is not null"), "item_id", "text"))
    sizes = parsed.select(F.size("hashes").alias("n")).where(F.col("n") < settings.window).distinct()
    lengths = sorted(r["n"] for r in sizes.collect())  # fewer than ``window`` numbers
    widths = [settings.window, *[n for n in lengths if n >= settings.shortest]]
    number = lambda s: s["value"].rlike(r"^\p{N}")
    first = lambda s, every: F.concat(F.lit("#"), (F.array_position(every, s["value"])).cast("string"))
    renamed = lambda keep: let(F.transform("slots", lambda s: s["value"]), lambda every: F.transform("slots", lambda s: F.struct(s["at"], s["opening"], F.when(keep(s), s["value"]).otherwise(first(s, every)).alias("value"))))
    items = parsed.select("item_id", "slots", "hashes", "named", "literal", renamed(lambda s: F.lit(False)).alias("shape"), renamed(lambda s: ~number(s)).alias("worded"))
    items = items.where(F.size("hashes") >= settings.shortest)
    rows = _windows(items, widths, "item_id", "hashes", "named", "shape", "worded").where((F.col("width") == settings.window) | (F.col("n") == F.col("width")))
    rows = cut(rows.withColumn("b_slots", slots_in(F.col("shape"), F.col("at"), F.col("width"), F.col("kind"))).withColumn("rich", F.size("b_slots") <= F.col("width") * (1 - settings.literal)))

    held, members = _groups(rows.where(F.size("b_slots") == 0), "width", "window")
    nothing = [F.lit(None).cast("int").alias("whole"), F.lit(None).cast("bigint").alias("whole_hash")]
    plain = held.select("width", "window", "group", F.lit(True).alias("plain"), F.lit(0).alias("b_at"), F.expr("slice(array(named_struct('at', 0, 'opening', false, 'value', '')), 1, 0)").alias("b_slots"), *nothing)
    valued = rows.where("rich and size(b_slots) > 0").withColumn("group", F.xxhash64(F.lit("template"), "hashes", "named", "shape"))
    some = valued.select("width", "window", "group", F.lit(False).alias("plain"), F.col("at").alias("b_at"), "b_slots", *nothing).distinct()
    dense = rows.where("kind = 0").groupBy("item_id").agg(F.bool_or("rich").alias("any")).where("not any").select("item_id")
    dense = rows.where("kind = 0 and at = 0").join(dense, "item_id", "left_semi").withColumn("group", F.xxhash64(F.lit("whole"), "hashes", "worded"))
    whole_slots = F.filter("worded", lambda s: ~s["opening"]).alias("b_slots")
    wholes = dense.select("width", "window", "group", F.lit(False).alias("plain"), F.col("at").alias("b_at"), whole_slots, F.col("n").alias("whole"), F.xxhash64("hashes").alias("whole_hash")).distinct()

    short = parsed.where(F.size("hashes").between(2, settings.shortest - 1)).select("item_id", F.explode(units_of(body(), settings.shortest - 1)).alias("unit"), F.size("hashes").alias("n"))
    sentences, sharing = _groups(short.where(F.size(F.split("unit", r"[ |]")) == F.col("n")), "unit")
    members = members.unionByName(valued.select("group", "item_id")).unionByName(dense.select("group", "item_id")).unionByName(sharing).distinct()
    return Known(cut(plain.unionByName(some).unionByName(wholes)), widths, cut(sentences), cut(members))


def _places(docs: DataFrame, known: Known, settings: DecontamSettings) -> DataFrame:
    """``__row, __id, group, plain, windows``: where groups of items are found, by windows.

    Only hashes meet the benchmark's; the tokens and values of the few texts with a template window are then looked at.
    """
    few = known.windows.count() <= settings.broadcast_windows
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("__row"))
    slim = _windows(_parsed(texts, "doc_id", "__row"), known.widths, "doc_id", "__row").drop("n")
    hits = slim.join(F.broadcast(known.windows) if few else known.windows, ["width", "window"])
    met = cut(hits.withColumnRenamed("doc_id", "__id").drop("window").distinct())
    names = cut(met.where("not plain").select("__id", "__row").distinct())
    same = (F.col("__row") == F.col("__own")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    asked = F.broadcast(names) if names.count() <= settings.broadcast_rows else names
    asked_texts = texts.withColumnRenamed("__row", "__own").join(asked, same, "left_semi").dropDuplicates(["doc_id", "__own"])
    hits = met.where("not plain").join(_parsed(asked_texts, "doc_id", "__own"), same)
    own = F.when(F.col("kind") == 1, F.col("named")).otherwise(F.col("hashes"))
    hits = hits.where(F.col("whole").isNull() | (F.xxhash64(F.slice(own, F.col("at") + 1, F.coalesce("whole", "width"))) == F.col("whole_hash")))
    hits = hits.withColumn("d_slots", slots_in(F.col("slots"), F.col("at"), F.coalesce("whole", "width"), F.col("kind")))
    opens = F.exists("b_slots", lambda s: s["opening"]) | F.exists("d_slots", lambda s: s["opening"])
    pairs = F.transform(F.arrays_zip("b_slots", "d_slots"), lambda p: F.struct(p["b_slots"]["value"].alias("b"), p["d_slots"]["value"].alias("d")))
    offset = (F.col("at") - F.col("b_at")).alias("offset")
    hits = hits.select("__row", "__id", "group", "whole", offset, "width", "at", pairs.alias("pairs"), opens.alias("opens"))
    worded = F.col("whole") - F.size("pairs") + F.size(F.filter("pairs", lambda p: p["b"] == p["d"]))
    hits = hits.where(F.col("whole").isNull() | (worded >= F.col("whole") * settings.literal))
    places = hits.groupBy("__row", "__id", "group", "offset").agg(
        F.collect_set(F.struct("width", "at")).alias("windows"),
        F.array_distinct(F.flatten(F.collect_set(F.when(~F.col("opens"), F.col("pairs"))))).alias("firm"),
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"),
    )

    def agree(name: str) -> Column:
        return (F.size(name) > 0) & (F.size(F.array_distinct(F.transform(name, lambda p: p["b"]))) == F.size(name))

    plain = met.where("plain").groupBy("__row", "__id", "group").agg(F.collect_set(F.struct("width", "at")).alias("windows"))
    agreed = places.where(agree("firm") | agree("pairs"))
    return plain.select("__row", "__id", "group", F.lit(True).alias("plain"), "windows").unionByName(agreed.select("__row", "__id", "group", F.lit(False).alias("plain"), "windows"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, settings: DecontamSettings = DecontamSettings()) -> DataFrame:
    """``__row, __id, n_windows, n_items, item_id, kind`` of the contaminated rows of ``docs``.

    An item leaks where it lies along the document at some offset with an equal literal window, or
    with values that agree, be it without the windows that take an opening for a name; an item
    without a window that is literal enough, where all of it agrees and half of its tokens are the
    same, numbers left out; an item of two or three tokens, where it is a sentence, a line or a bracket of its own.
    ``n_windows`` counts the document's windows and sentences in such places, ``n_items`` the items,
    ``item_id`` is the smallest of them and ``kind`` is ``verbatim`` if some window or sentence is as
    the item has it, else ``parameters``. A passage that many items share leaks all of them.

    Rows grow with documents and groups of items, not with their items: items are counted once for
    each set of groups that some document holds. Null and empty texts, null item ids and items of one token match
    nothing; an empty benchmark or table gives no rows; rows equal in doc_id and text share one.
    """
    known = benchmark_windows(benchmark, settings)
    places = _places(docs, known, settings)
    if not known.sentences.isEmpty():
        units = docs.select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__row"), F.posexplode(units_of(body(), settings.shortest - 1)).alias("at", "unit"))
        few = known.sentences.count() <= settings.broadcast_windows
        met = units.join(F.broadcast(known.sentences) if few else known.sentences, "unit")
        places = places.unionByName(met.select("__row", "__id", "group", F.lit(True).alias("plain"), F.array(F.struct(F.lit(0).alias("width"), "at")).alias("windows")))
    found = places.groupBy("__row", "__id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("windows")))).cast("bigint").alias("n_windows"),
        F.array_sort(F.collect_set("group")).alias("groups"),
        F.when(F.bool_or("plain"), F.lit("verbatim")).otherwise(F.lit("parameters")).alias("kind"),
    )
    found = cut(found.withColumn("set", F.xxhash64("groups")))
    sets = found.groupBy("set").agg(F.first("groups").alias("groups")).select("set", F.explode("groups").alias("group"))
    counted = sets.join(known.members, "group").groupBy("set").agg(F.count_distinct("item_id").alias("n_items"), F.min("item_id").alias("item_id"))
    return found.join(counted, "set").select("__row", "__id", "n_windows", "n_items", "item_id", "kind")


def mark_leaks(docs: DataFrame, benchmark: DataFrame, settings: DecontamSettings = DecontamSettings()) -> DataFrame:
    """``doc_id, contaminated, n_windows, n_items, item_id, kind``: one row per row of ``docs``."""
    found = find_leaks(docs, benchmark, settings)
    rows = docs.select("doc_id", F.xxhash64("text").alias("__own"))
    same = (F.col("__own") == F.col("__row")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    return rows.join(found, same, "left").select(
        "doc_id",
        F.col("item_id").isNotNull().alias("contaminated"),
        F.coalesce("n_windows", F.lit(0)).alias("n_windows"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        "item_id",
        "kind",
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, settings: DecontamSettings = DecontamSettings()) -> DataFrame:
    """The rows of ``docs`` without a leak, with their columns."""
    found = find_leaks(docs, benchmark, settings)
    return without_rows(docs, found.select("__id", F.col("__row").alias("__key")), settings.broadcast_rows)
