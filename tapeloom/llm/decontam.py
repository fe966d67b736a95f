"""Benchmark decontamination: windows of templates, joined by hash, with consistent slots.

A template is a text in lower case without marks in which names, numbers and units are
typed placeholders.  A document leaks an item if windows of WIDTH template tokens cover
at least half of the item's windows.  A window counts if its slots have the item's own
values, or if along its alignment each of their values is replaced by one value
throughout.  So copies are found, and also questions asked again with other numbers,
names or units.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.store import stage
from .names import free

WIDTH, MIN_LITERALS = 8, 3
#: Windows of the benchmark (24 bytes each) up to which their table is broadcast; a larger one is shuffled.
BROADCAST_WINDOWS = 1_000_000
# Fixed marks of the private use area: name, number, unit, and the brackets of a slot's value.
NAME, NUMBER, UNIT, OPEN, CLOSE = "", "", "", "", ""
# Fixed list: units that follow a number.
UNITS = "kg g mg t lb oz km m cm mm mi ft in yd l ml s ms min h hr kmh mph w kw kwh v a hz mb gb tb usd eur gbp dollars euros pounds percent meters metres miles hours minutes seconds days weeks months years".split()


def template(text: Column, values: bool = False, names: bool = True) -> Column:
    """The template tokens of a text; with ``values`` slots keep theirs in brackets, without
    ``names`` names stay words, so letter case says nothing.  Tokens keep their positions."""
    hold = f"{OPEN}$0{CLOSE}" if values else ""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{NAME}-{CLOSE}]+", " ")
    if names:
        t = F.regexp_replace(t, r"(?<=[\p{Ll}\p{N},;:)] )\p{Lu}\p{L}*", f" {NAME}{hold} ")
    t = F.regexp_replace(t, r"\p{N}+(?:[.,:/]\p{N}+)*", f" {NUMBER}{hold} ")
    t = F.regexp_replace(t, f"(?<=[{NUMBER}{CLOSE}] {{1,2}})(?:%|(?i:{'|'.join(UNITS)})(?!\\p{{L}}))", f" {UNIT}{hold} ")
    if values:
        return F.regexp_extract_all(F.lower(t), F.lit(rf"[{NAME}-{UNIT}]{OPEN}[^{CLOSE}]*{CLOSE}|\p{{L}}+"), F.lit(0))
    return F.array_remove(F.split(F.lower(t), rf"[^\p{{L}}{NAME}-{UNIT}]+"), "")


def windows(df: DataFrame, tokens: str, width: int) -> DataFrame:
    """Add ``_w``: a 64-bit hash of each window of ``width`` tokens.

    Explode it with an outer generator: for an inner one the optimizer puts a filter on
    the array below all projections, where every lambda would compute its arrays anew.
    """
    d = df.withColumn("_h", F.transform(tokens, lambda t: F.xxhash64(t)))
    starts = F.when(F.size("_h") >= width, F.sequence(F.lit(0), F.size("_h") - width)).otherwise(F.array().cast("array<int>"))
    return d.withColumn("_w", F.transform(starts, lambda i: F.xxhash64(*[F.col("_h")[i + k] for k in range(width)]))).drop("_h")


def _slots(df: DataFrame, keys: list[str], text: Column, names: bool) -> DataFrame:
    """(keys, position, value) of the placeholders of texts."""
    d = df.select(*keys, F.posexplode_outer(template(text, values=True, names=names)).alias("p", "t"))
    return d.where(F.col("t").rlike(f"^[{NAME}-{UNIT}]")).select(*keys, "p", F.regexp_extract("t", f"{OPEN}(.*){CLOSE}", 1).alias("v"))


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, min_literals: int = MIN_LITERALS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", any_case: bool = False) -> DataFrame:
    """One row per leaking (document, item): the item's windows that were found, all its
    windows, and whether every slot has the item's own value.

    With ``any_case`` a window also counts as found if it matches with names as words in
    lower case, so copies in capitals or title case leak too.

    Items under ``width`` template tokens, and windows with under ``min_literals`` tokens
    that are no placeholder, say too little and match nothing.  Null and empty texts leak
    nothing; null ids never match; rows that share an id are judged together, each text along its
    own alignments; empty tables
    give an empty table; other columns are not read.
    """
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")).where("item is not null")
    b = windows(items.select("item", template(F.col("text")).alias("tokens")), "tokens", width)
    b = b.select("item", "tokens", F.posexplode_outer("_w").alias("q", "w"))
    literal = F.filter(F.slice("tokens", F.col("q") + 1, F.lit(width)), lambda t: ~t.isin(NAME, NUMBER, UNIT))
    b = b.where(F.col("w").isNotNull() & (F.size(literal) >= min_literals)).select(F.lit(True).alias("names"), "item", "q", "w")
    kinds = [True, False] if any_case else [True]
    every = lambda make: reduce(DataFrame.unionByName, [make(k).withColumn("names", F.lit(k)) for k in kinds])
    if any_case:  # the same windows once more, with names as words
        plain = windows(items.select("item", template(F.col("text"), names=False).alias("tokens")), "tokens", width)
        plain = plain.select(F.lit(False).alias("names"), "item", F.posexplode_outer("_w").alias("q", "w"))
        b = b.unionByName(plain.join(b.select("item", "q").distinct(), ["item", "q"], "left_semi"))
    b = stage(b)
    sizes = b.groupBy("item").agg(F.countDistinct("q").alias("item_windows"))

    d = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text")).where("doc is not null")
    w = every(lambda names: windows(d.select("doc", "th", template(F.col("text"), names=names).alias("tokens")), "tokens", width).select("doc", "th", F.posexplode_outer("_w").alias("p", "w")))
    known = F.broadcast(b) if b.count() <= BROADCAST_WINDOWS else b
    hits = w.join(known, ["names", "w"]).select("doc", "th", "names", "item", "q", (F.col("p") - F.col("q")).alias("shift")).distinct()
    hits = stage(hits)  # only windows that occur in the benchmark: far fewer than those of the documents

    # enough of the item first, then the values of the documents that are left
    found = hits.groupBy("doc", "item").agg(F.countDistinct("q").alias("n")).join(sizes, "item").where("2 * n >= item_windows").select("doc", "item", "item_windows")
    found = stage(found)
    along = ["doc", "th", "names", "item", "shift"]  # an alignment
    held = hits.join(found, ["doc", "item"])
    runs = held.groupBy(*along).agg(F.min("q").alias("lo"), (F.max("q") + width - 1).alias("hi"))
    few = d.join(found.select("doc").distinct(), "doc", "left_semi").dropDuplicates(["doc", "th"])
    mine = every(lambda names: _slots(few, ["doc", "th"], F.col("text"), names)).withColumnsRenamed({"p": "dp", "v": "dv"})
    asked = items.join(found.select("item").distinct(), "item", "left_semi")
    theirs = every(lambda names: _slots(asked, ["item"], F.col("text"), names)).withColumnsRenamed({"p": "ip", "v": "iv"})
    pairs = runs.join(theirs, ["names", "item"]).where(F.col("ip").between(F.col("lo"), F.col("hi"))).withColumn("dp", F.col("ip") + F.col("shift")).join(mine, ["doc", "th", "names", "dp"])
    value, whole = W.partitionBy(*along, "iv"), W.partitionBy(*along)
    same = F.col("dv") == F.col("iv")
    slots = pairs.withColumns({"same": same, "one": F.min("dv").over(value) == F.max("dv").over(value), "all_same": F.min(same).over(whole)})
    slots = slots.select(*along, "same", "one", "all_same", F.explode(F.sequence(F.col("ip") - (width - 1), F.col("ip"))).alias("q"))
    slots = slots.groupBy(*along, "q").agg(F.min("same").alias("same"), F.min("one").alias("one"), F.min("all_same").alias("all_same"))
    judged = held.join(slots, [*along, "q"], "left").where("coalesce(same or one, true)")
    out = judged.groupBy("doc", "item", "item_windows").agg(F.countDistinct("q").alias("n_windows"), F.min(F.coalesce("all_same", F.lit(True))).alias("same_values"))
    return out.where("2 * n_windows >= item_windows").select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "n_windows", "item_windows", "same_values")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents (all columns, rows and order of columns as given) that leak no item.

    A document is an id with its text: a null id is an id like others, and a clean text stays
    though another one under its id leaks.  Repeated rows stay or go together; null and empty
    texts stay; texts of any length are judged whole; an empty table gives an empty table, an
    empty benchmark keeps all; other columns, of whatever name, are not read.
    """
    doc, th = free(docs, "leak_doc", "leak_th")
    named = docs.select(F.struct(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("th")).alias("key"), F.col(text_col).alias("text"))
    found = leaks(named, benchmark, id_col="key", text_col="text", **options)
    bad = stage(found.select(F.col("key.doc").alias(doc), F.col("key.th").alias(th)).distinct())
    return docs.join(bad, docs[id_col].eqNullSafe(bad[doc]) & (F.xxhash64(docs[text_col]) == bad[th]), "left_anti")
