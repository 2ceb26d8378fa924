"""Benchmark decontamination by template canonicalisation (DataFrame operations only).

Numbers, units after numbers, and capitalised words inside a sentence become
typed placeholders; the rest is lower-cased and split into words.  Windows of
``width`` template words are hashed and joined with those of the benchmark, so
an item whose numbers, names or units were changed still matches.  A document
and an item that share at least ``coverage`` of the item's windows are compared
slot by slot, each slot where the longest run of shared windows over it lies in
the document, so words put in or left out do no harm.  A value of the item must
stand for one value of the document wherever it occurs, and a name of the
document for one name of the item.  Pairs with too many slots that break this are
dropped.

A capitalised word that opens a sentence, line, quotation or bracket may be a
name or an ordinary word.  Windows with such openers are hashed twice, with the
words as they are and with all openers as name slots; both kinds are joined, so
an opener matches itself, any other opener, and a name inside a sentence.  If
the share is reached only through opener slots, replaced openers that recur must
pass the slot check too.  In an item below ``width`` words all must, and one that
the benchmark also has uncapitalised is an ordinary word and fails it.

Items of ``shortest`` to ``width - 1`` words match as one window of their whole
length.  Shorter ones say too little to be looked for inside a text: they match a
document that has them, word for word, as a whole line.  The benchmark's windows
are counted first: up to ``broadcast_windows`` they are broadcast, beyond that
the join is shuffled.

Defined cases: null, empty and wordless texts match nothing; a null item id or
``doc_id`` is reported as null; rows that repeat an id are compared on their own
(a hash of id and text identifies a row, so equal rows are one); an empty table
gives an empty result; other columns are ignored, :func:`drop_leaks` carries them
along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depinfer.llm.common import materialize, ship, text_or_empty

# Units that make a number a quantity.
UNITS = "kg|mg|g|lbs|lb|oz|km|cm|mm|m|miles|mile|feet|foot|ft|inches|inch|hours|hour|minutes|minute|min|seconds|second|days|day|weeks|week|months|month|years|year|dollars|dollar|cents|cent|euros|euro|liters|liter|litres|litre|ml|l|percent|degrees|degree"

_NAME = r"(?<=[\p{L}\p{N},;:] )\p{Lu}\p{Ll}+"
_OPENER = r"(?<![\p{L}\p{M}\p{N}\x01-\x05])\p{Lu}\p{Ll}+"
_NUMBER = r"\p{N}+(?:[.,]\p{N}+)*"
_QUANTITY = rf"({_NUMBER}) ?({UNITS})\b"
_BETWEEN = r"[^\p{L}\p{M}\p{N}\x01-\x05]+"
_ROW = "xxhash64(doc_id, text)"


def _words(text):
    return F.filter(F.split(F.lower(text), _BETWEEN), lambda w: w != "")


def _clean(text):
    return F.regexp_replace(text, r"[\x01-\x05]", " ")


def template_line(text):
    """The words of a text with placeholders for names, numbers and units, in one string; openers are marked."""
    text = F.regexp_replace(F.regexp_replace(_clean(text), _NAME, "\x02"), _OPENER, "\x05$0")
    text = F.regexp_replace(text, _QUANTITY, "\x01 \x03")
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, _NUMBER, "\x01")), _BETWEEN, " "))


def template_words(line):
    """The words of a :func:`template_line`, openers as they are."""
    return F.split(F.replace(line, F.lit("\x05"), F.lit("")), " ")


def opener_words(line):
    """The same words with openers as name slots; positions agree."""
    return F.split(F.regexp_replace(line, "\x05[^ ]*", "\x02"), " ")


def marked_words(text):
    """The same words with their values, marked by type; positions agree with :func:`template_words`."""
    text = F.regexp_replace(F.regexp_replace(_clean(text), _NAME, "\x02$0"), _OPENER, "\x05$0")
    text = F.regexp_replace(text, _QUANTITY, "$1 \x03$2")
    text = F.regexp_replace(text, r"(?<=\p{N})[.,](?=\p{N})", "\x04")
    return F.split(F.trim(F.regexp_replace(F.lower(text), _BETWEEN, " ")), " ")


def _windows(rows: DataFrame, widths: list[int], *keep: str) -> DataFrame:
    """``keep, at, hash, opened`` for each window of the ``widths`` of ``words``, and of ``open`` where that differs and is not all placeholders."""
    placed = rows.filter(F.size("words") >= min(widths)).select(*keep, "words", "open", F.explode(F.expr(f"sequence(0, size(words) - {min(widths)})")).alias("at"))
    kinds = []
    for n in widths:
        # The smallest width always fits; beyond it a window may reach past the end.
        word = "{}[at + {}]" if n == min(widths) else "get({}, at + {})"
        hashed = lambda words: F.xxhash64(F.lit(n), *(F.expr(word.format(words, i)) for i in range(n)))  # noqa: B023, E731
        says = F.expr(" or ".join(f"{word.format('open', i)} > '\x05'" for i in range(n)))
        if n == min(widths):
            kinds += [hashed("words").alias(f"h{n}"), F.when(says, hashed("open")).alias(f"g{n}")]
        else:
            fits = F.col("at") + n <= F.size("words")
            kinds += [F.when(fits, hashed("words")).alias(f"h{n}"), F.when(fits & says, hashed("open")).alias(f"g{n}")]
    both = placed.select(*keep, "at", *kinds)
    lists = []
    for n in widths:
        plain, opened = F.struct(F.col(f"h{n}").alias("hash"), F.lit(False).alias("opened")), F.struct(F.col(f"g{n}").alias("hash"), F.lit(True).alias("opened"))
        some = F.when(F.col(f"g{n}") != F.col(f"h{n}"), F.array(plain, opened)).otherwise(F.array(plain))
        lists.append(some if n == min(widths) else F.when(F.col(f"h{n}").isNull(), F.array().cast("array<struct<hash:bigint,opened:boolean>>")).otherwise(some))
    return both.select(*keep, "at", F.explode(lists[0] if len(lists) == 1 else F.concat(*lists)).alias("w")).select(*keep, "at", "w.hash", "w.opened")


def _short_leaks(rows: DataFrame, items: DataFrame, shortest: int) -> DataFrame:
    """Documents with a line whose words are those of an item below ``shortest`` words."""
    literal = lambda text: F.array_join(_words(text), " ")
    asked = items.select("item_id", literal(F.col("text")).alias("line")).filter(f"line <> '' and size(split(line, ' ')) < {shortest}")
    lines = rows.select(F.expr(_ROW).alias("row"), "doc_id", F.explode(F.split("text", "\n")).alias("line")).select("row", "doc_id", literal(F.col("line")).alias("line"))
    one = F.lit(1).cast("long")
    return lines.join(asked, "line").select("row", "doc_id", "item_id", one.alias("windows"), one.alias("item_windows"), (one * 0).alias("slots"), (one * 0).alias("consistent_slots")).distinct()


def _slots(pairs: DataFrame, marked: DataFrame, asked: DataFrame) -> DataFrame:
    """``row, item, short, kind, value, other`` for each slot of an item that lies in a shared window."""
    wanted = "asked[i] rlike '^[\\\\x02\\\\x03]|\\\\p{N}' or not plain and asked[i] rlike '^\\\\x05'"
    found = f"transform(filter(sequence(0, size(asked) - 1), i -> {wanted}), i -> struct(asked[i] as asked, i + get(filter(aligned, a -> exists(a.places, p -> p <= i and i < p + width)), 0).shift as at))"
    sides = pairs.select("row", "item", "short", "plain", "width", "aligned").join(marked, "row").join(asked, "item")
    slots = sides.select("row", "item", "short", "said", F.expr(f"explode({found})").alias("s")).filter("s.at >= 0 and s.at < size(said)")
    bare = lambda c: F.translate(c, "\x02\x05", "")
    return slots.select("row", "item", "short", F.substring("s.asked", 1, 1).alias("kind"), bare(F.col("s.asked")).alias("value"), bare(F.expr("get(said, s.at)")).alias("other"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = 8, coverage: float = 0.5, consistency: float = 0.8, shortest: int = 5, broadcast_windows: int = 1_000_000) -> DataFrame:
    """``row, doc_id, item_id, windows, item_windows, slots, consistent_slots`` per leak."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text")).withColumn("line", template_line(F.col("text")))
    items = items.withColumn("words", template_words(F.col("line"))).withColumn("open", opener_words(F.col("line")))
    items = materialize(items.withColumn("item", F.xxhash64("item_id", "text")).dropDuplicates(["item"]), "op2-items")
    sizes = sorted(r["n"] for r in items.filter("line <> ''").select(F.least(F.size("words"), F.lit(width)).alias("n")).distinct().collect())
    widths = [n for n in sizes if n >= shortest] or [width]
    known = None
    for n in widths:
        part = _windows(items.filter(F.size("words") >= width if n == width else F.size("words") == n), [n], "item")
        known = part if known is None else known.unionByName(part)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    known = materialize(known.select("item", F.col("at").alias("item_at"), "hash", F.col("opened").alias("item_opened")), "op2-windows")
    small = known.count() <= broadcast_windows
    split = rows.select(F.expr(_ROW).alias("row"), "doc_id", template_line(F.col("text")).alias("line"))
    split = split.select("row", "doc_id", template_words(F.col("line")).alias("words"), opener_words(F.col("line")).alias("open"))
    hits = _windows(split, widths, "row", "doc_id").join(F.broadcast(known) if small else known, "hash").select("row", "doc_id", "item", "at", "item_at", F.expr("if(opened or item_opened, null, item_at)").alias("plain_at"))
    counted = hits.groupBy("row", "item", (F.col("at") - F.col("item_at")).alias("shift")).agg(F.first("doc_id").alias("doc_id"), F.collect_set("item_at").alias("places"), F.collect_set("plain_at").alias("plain"))
    covered = lambda places: F.size(F.array_distinct(F.flatten(F.collect_list(places))))
    aligned = F.sort_array(F.collect_list(F.struct(F.size("places").alias("n"), (-F.abs("shift")).alias("near"), "shift", "places")), asc=False)
    pairs = counted.groupBy("row", "item").agg(F.first("doc_id").alias("doc_id"), covered("places").alias("windows"), covered("plain").alias("plain"), aligned.alias("aligned"))
    whole = items.select("item", "item_id", F.greatest(F.size("words") - width + 1, F.lit(1)).alias("item_windows"), (F.size("words") < width).alias("short"), F.least(F.size("words"), F.lit(width)).alias("width"))
    pairs = pairs.join(whole, "item").filter(F.col("windows") >= F.lit(coverage) * F.col("item_windows"))
    pairs = materialize(pairs.withColumn("plain", F.col("plain") >= F.lit(coverage) * F.col("item_windows")), "op2-pairs")
    wanted = materialize(pairs.select("row").distinct(), "op2-rows")
    marked = rows.withColumn("row", F.expr(_ROW)).join(wanted, "row", "left_semi").dropDuplicates(["row"]).select("row", marked_words(F.col("text")).alias("said"))
    slots = materialize(_slots(pairs, marked, items.select("item", marked_words(F.col("text")).alias("asked"))), "op2-slots")
    of_value = slots.groupBy("row", "item", "short", "value").agg(F.count_distinct("other").alias("n"), F.min("other").alias("other"), F.count("*").alias("times"), F.bool_and(F.col("kind") == "\x05").alias("opener"), F.bool_or(F.col("kind") == "\x02").alias("name"))
    of_value = of_value.filter("not opener or (times > 1 or short) and (n > 1 or other <> value)")
    of_other = slots.filter("kind = '\x02'").groupBy("row", "item", "other").agg(F.count_distinct("value").alias("back"))
    ordinary = materialize(items.select(F.explode(F.split("line", " ")).alias("word")).filter("word >= '\x06'").distinct(), "op2-ordinary")
    out_of = lambda c: ordinary.select(F.col("word").alias(c), F.lit(True).alias(f"{c}_ordinary"))
    of_value = of_value.join(of_other, ["row", "item", "other"], "left").join(out_of("value"), "value", "left").join(out_of("other"), "other", "left")
    fine = F.expr("n = 1 and not (name and back > 1) and not (short and opener and (value_ordinary is not null or other_ordinary is not null))")
    checked = of_value.groupBy("row", "item").agg(F.count("*").alias("slots"), F.count_if(fine).alias("consistent_slots"))
    out = pairs.join(checked, ["row", "item"], "left").na.fill(0, ["slots", "consistent_slots"])
    out = out.filter(F.col("consistent_slots") >= F.lit(consistency) * F.col("slots"))
    out = out.select("row", "doc_id", "item_id", F.col("windows").cast("long").alias("windows"), F.col("item_windows").cast("long").alias("item_windows"), "slots", "consistent_slots")
    return out.unionByName(_short_leaks(rows, items, shortest)) if any(n < shortest for n in sizes) else out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without a leak."""
    columns = docs.columns
    leaks = materialize(find_leaks(docs, benchmark, **options).select(F.col("row").alias("__op2_row")).distinct(), "op2-leaks")
    row = F.xxhash64(F.col("doc_id").cast("long"), text_or_empty())
    return docs.withColumn("__op2_key", row).join(leaks, F.col("__op2_key") == F.col("__op2_row"), "left_anti").select(*columns)


ship(__name__)
