"""Replacing names of persons by numbered ones."""

from __future__ import annotations

import json
import re

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..runtime import cut

NAME = r"(?U)\b(\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?\s+\p{Lu}\.\s?\p{Lu}\.|\p{Lu}\.\s?\p{Lu}\.\s?\p{Lu}\p{Ll}+)"


def surname_of(name: Column) -> Column:
    """The longest word of four letters or more, the first of equals; the whole name if there is none."""
    parts = F.filter(F.split(name, r"(?U)[\s.]+"), lambda w: F.length(w) >= 4)
    best = F.aggregate(parts, F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a))
    return F.when(best == "", name).otherwise(best)


def spellings(rows: DataFrame, scope: str, text: str) -> DataFrame:
    """``scope, name, surname``: distinct spellings of names with initials in a text; surnames in small letters."""
    found = rows.select(scope, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(NAME), F.lit(1)))).alias("name")).distinct()
    return found.withColumn("surname", F.lower(surname_of(F.col("name"))))


def field_names(cards: DataFrame, scope: str, fields: tuple[str, ...], system: tuple[str, ...] = ()) -> DataFrame:
    """``scope, name, surname``: names that stand, parted by commas, in named fields of cards and of the rows of their sections.

    A field counts by what its key has before ``::``. Names of ``system`` accounts don't count.
    """
    sections = cards.select(scope, F.explode(F.map_values("sections")).alias("s"))
    maps = sections.select(scope, F.explode(F.concat(F.array("s.fields"), F.coalesce("s.rows", F.array().cast("array<map<string,string>>")))).alias("m"))
    entries = maps.select(scope, F.explode("m").alias("k", "v")).where(F.substring_index("k", "::", 1).isin(*fields))
    names = entries.select(scope, F.explode(F.split("v", ",")).alias("n")).select(scope, F.regexp_replace("n", r"(?U)^\s+|\s+$", "").alias("name")).where("name <> ''").distinct()
    if system:
        names = names.where(~F.col("name").isin(*system))
    return names.withColumn("surname", F.lower(surname_of(F.col("name"))))


def numbered_names(found: DataFrame, scope: str, label: str = "Person") -> DataFrame:
    """``found`` with ``alias``: surnames of a scope in sorted order."""
    ranks = found.select(scope, "surname").distinct().withColumn("__rank", F.row_number().over(Window.partitionBy(scope).orderBy("surname")))
    return found.join(ranks, [scope, "surname"]).withColumn("alias", F.concat(F.lit(f"{label} "), F.col("__rank").cast("string"))).drop("__rank")


class Replacer:
    """Replaces all of a scope's names in one pass of a text by an automaton that is built once.

    Longer names win over shorter ones that overlap them, earlier over later ones of one length.
    """

    def __init__(self, table: dict[str, str]) -> None:
        self.machine = ahocorasick.Automaton()
        for name, alias in table.items():
            self.machine.add_word(name, (len(name), alias))
        self.machine.make_automaton()

    def __call__(self, text: str) -> str:
        hits = sorted(((-size, end - size + 1, alias) for end, (size, alias) in self.machine.iter(text)), key=lambda h: h[:2])
        if not hits:
            return text
        taken, spans = bytearray(len(text)), []
        for size, start, alias in hits:
            if not any(taken[start : start - size]):
                taken[start : start - size] = b"\1" * -size
                spans.append((start, start - size, alias))
        parts, at = [], 0
        for start, end, alias in sorted(spans):
            parts += [text[at:start], alias]
            at = end
        return "".join([*parts, text[at:]])


def replace_names(rows: DataFrame, scope: str, columns: list[str], names: DataFrame, bare: bool = True) -> DataFrame:
    """``rows`` with every name of their scope replaced in ``columns`` (texts, or arrays or maps of texts, whose values count).

    ``names`` are ``scope, name, surname``, of one or several sources; with ``bare`` surnames alone are
    replaced too, as they are spelled in the names. Rows of one scope share its automaton, which a
    task builds once. Null texts stay null; rows without a scope or a name stay as they are.
    """
    told = numbered_names(cut(names.select(scope, "name", "surname").where("name <> ''").distinct()), scope)  # found once, as they are used twice
    spelled = told.select(scope, "name", "alias")
    if bare:
        alone = told.select(scope, surname_of(F.col("name")).alias("name"), "alias")
        spelled = spelled.unionByName(alone)
    one = spelled.groupBy(scope, "name").agg(F.min("alias").alias("alias"))
    maps = one.groupBy(scope).agg(F.to_json(F.sort_array(F.collect_list(F.struct("name", "alias")))).alias("__names"))
    met = rows.join(maps, scope, "left")
    values = {c: F.map_values(c) if t.startswith("map") else F.col(c) if t.startswith("array") else F.array(c) for c, t in rows.dtypes if c in columns}
    made = met.withColumn("__made", replaced(F.array(*values.values()), F.col("__names")))
    back = {}
    for place, (name, kind) in enumerate((c, t) for c, t in rows.dtypes if c in columns):
        new = F.get("__made", place)
        back[name] = F.when(F.col(name).isNotNull(), F.map_from_arrays(F.map_keys(name), new) if kind.startswith("map") else new if kind.startswith("array") else F.get(new, 0))
    return made.select(*[back[c].alias(c) if c in back else F.col(c) for c in rows.columns])


def replaced(texts: Column, names: Column) -> Column:
    """Arrays of arrays of texts with names replaced; ``names`` are tables of ``name, alias`` as JSON, each read once in a batch."""

    @F.pandas_udf("array<array<string>>")
    def run(lists: pd.Series, tables: pd.Series) -> pd.Series:
        known = {t: Replacer({n["name"]: n["alias"] for n in json.loads(t)}) for t in tables.dropna().unique()}
        out = []
        for arrays, table in zip(lists, tables):
            change = known.get(table)
            out.append(arrays if change is None else [None if a is None else [None if t is None else change(t) for t in a] for a in arrays])
        return pd.Series(out, dtype="object")

    return run(texts, names)


def anonymize(rows: DataFrame, scope: str, text: str) -> DataFrame:
    """``rows`` with every spelling of a name with initials that their scope's texts hold replaced, the longest first."""
    return replace_names(rows, scope, [text], spellings(rows, scope, text), bare=False)


def leftovers(rows: DataFrame, scope: str, text: str, found: DataFrame) -> DataFrame:
    """Rows in which a surname of their scope is still to be found."""
    return rows.join(found.select(scope, "surname").distinct(), scope).where(F.lower(text).contains(F.col("surname"))).select(*rows.columns).distinct()
