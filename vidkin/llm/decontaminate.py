"""Benchmark decontamination by template windows. Built-in DataFrame functions only.

A text is cut into words; a point or comma between digits belongs to the number. A word that begins with a
digit is a number, a unit that follows a number is a unit, and any other word with a capital letter may be a
name, wherever it stands: at the start of a sentence too. Windows of five words have two forms. The caseless
one has lower-case words with numbers as placeholders, so a copy in another case matches. The typed one has
placeholders for numbers, units and possible names; it counts where two of the words or more are none of
these. A window of five numbers stands for itself, so that long runs of numbers don't match each other.

Windows of documents are hash-joined with those of the benchmark, each of an item's windows once by form and
values. Matches that hold slots are gathered per document, item and diagonal (document position less item
position), so that one occurrence of a question lies on one diagonal; windows without slots need none. Each
slot value of the item has one value on a diagonal, the one that most windows give it; windows with another
count only where it is the item's own. A document is contaminated by an item when the remaining windows
cover at least `least` of the item's distinct (caseless) windows.

Defined results: null or empty texts, and texts and items under five words, give no windows and no
rows; repeated rows of one doc_id count as one document; items with the same text are each reported;
empty tables give an empty result; other columns are ignored. Texts are read whole.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 5
LEAST = 0.8
#: Windows of the benchmark up to which their hashes are broadcast (8 bytes each and a map's slack, where a whole row
#: takes some 500 bytes); beyond, a shuffle join.
BROADCAST_WINDOWS = 200_000
#: Placeholders, and what takes the place of a point or comma between digits, from the private use area.
NUMBER, UNIT, NAME, POINT = "\ue001", "\ue002", "\ue003", "\ue005"
#: Units that may follow a number.
UNITS = "km cm mm m mi miles kg g mg lb lbs oz l ml s sec secs seconds min mins minutes h hours days weeks months years usd eur dollars euros cents percent"
_GAPS = "".join(c for c in map(chr, range(128)) if not c.isalnum())
#: Every character by itself: the regex engine looks those up in one table, but tests ranges one by one.
_GAP, _IN = (f"[{no}{''.join(f'\\x{ord(c):02x}' for c in _GAPS)}]" for no in ("", "^"))


def _templates(rows: DataFrame, key: str) -> DataFrame:
    """key and, word by word, as_is, low (lower case), caseless (numbers as placeholders), united (units too)."""
    text = F.coalesce("text", F.lit(""))
    text = F.when(F.rlike(text, F.lit("[0-9][.,][0-9]")), F.regexp_replace(text, "(?<=[0-9])[.,](?=[0-9])", POINT)).otherwise(text)
    rows = rows.select(key, F.btrim(text, F.lit(_GAPS)).alias("as_is"))
    rows = rows.select(key, "as_is", F.lower("as_is").alias("low"), F.rlike("as_is", F.lit("[0-9]")).alias("digits"))
    rows = rows.withColumn("caseless", F.when(F.col("digits"), F.regexp_replace("low", f"[0-9](?<!{_IN}[0-9]){_IN}*+", NUMBER)).otherwise(F.col("low")))
    united = F.regexp_replace("caseless", f"{NUMBER}({_GAP}+)(?:{'|'.join(UNITS.split())})(?!{_IN})", f"{NUMBER}$1{UNIT}")
    rows = rows.withColumn("united", F.when(F.col("digits"), united).otherwise(F.col("caseless")))
    split = lambda c: F.split(c, f"{_GAP}+")
    rows = rows.select(key, "digits", split("as_is").alias("as_is"), split("low").alias("low"), "caseless", "united")
    return rows.select(key, "as_is", "low", *[F.when(F.col("digits"), split(c)).otherwise(F.col("low")).alias(c) for c in ("caseless", "united")])


def windows(rows: DataFrame, key: str, words: int = WORDS) -> DataFrame:
    """key, at, the arrays of the whole text, and hashes of the window's caseless and typed form."""
    cut = _templates(rows, key)
    n = F.size("low")
    at = cut.filter(n >= words).select(key, "as_is", "low", "caseless", "united", F.explode(F.sequence(F.lit(0), n - words)).alias("at"))
    each = lambda name: [F.get(name, F.col("at") + j) for j in range(words)]
    numbers = reduce(and_, [c == NUMBER for c in each("caseless")])
    caseless = F.when(numbers, F.xxhash64(*each("low"))).otherwise(F.xxhash64(*each("caseless")))
    typed = F.xxhash64(*[_typed(*x) for x in zip(each("as_is"), each("low"), each("united"), strict=True)])
    return at.select(key, "at", "as_is", "low", "united", caseless.alias("window"), typed.alias("typed_window"))


def _typed(as_is: Column, low: Column, united: Column) -> Column:
    return F.when((as_is != low) & (united == low), NAME).otherwise(united)


def _hashes() -> Column:
    return F.when(F.col("typed_window") != F.col("window"), F.array("window", "typed_window")).otherwise(F.array("window"))


def _pair(s: Column) -> Column:
    return F.concat(s["item"], F.lit(" "), s["doc"])


def _agreeing(entries: Column) -> Column:
    """Entries of one diagonal without those that hold a changed value other than the one most windows give
    the slot (of equals the own value, then the greatest)."""
    found = F.flatten(F.transform(entries, lambda e: e["slots"]))
    slots = F.array_distinct(found)
    ranked = F.transform(slots, lambda s: F.struct(s["item"].alias("item"), F.size(F.filter(found, lambda x: x == s)).alias("n"), s["doc"].alias("doc")))
    better = lambda x, s: (x["n"] > s["n"]) | ((x["n"] == s["n"]) & ((x["doc"] == x["item"]) | (x["doc"] > s["doc"])))
    lost = F.transform(F.filter(ranked, lambda s: (s["item"] != s["doc"]) & F.exists(ranked, lambda x: (x["item"] == s["item"]) & better(x, s))), _pair)
    split = F.size(F.array_distinct(F.transform(slots, lambda s: s["item"]))) < F.size(slots)
    return F.when(split, F.filter(entries, lambda e: ~F.arrays_overlap(F.transform(e["slots"], _pair), lost))).otherwise(entries)


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, words: int = WORDS, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """doc_id, item_id, n_windows (covered), item_windows, coverage, n_slots (values with what they became, at most
    on a diagonal), n_changed (of these, with another value)."""
    of_window = lambda name: F.slice(name, F.col("at") + 1, words)
    bench = windows(benchmark, "item_id", words)
    kinds = F.zip_with(F.arrays_zip(of_window("as_is").alias("as_is"), of_window("low").alias("low")), of_window("united"), lambda w, u: _typed(w["as_is"], w["low"], u))
    bench = bench.select("item_id", "at", "window", "typed_window", of_window("low").alias("words"), kinds.alias("kinds"))
    total = bench.groupBy("item_id").agg(F.countDistinct("window").cast("long").alias("item_windows"))
    # The typed form counts with two plain words; a document's other typed forms find nothing.
    plain = F.size(F.filter("kinds", lambda k: ~k.isin(NUMBER, UNIT, NAME)))
    bench = bench.select("item_id", "at", "window", "words", "kinds", F.explode(F.when(plain >= 2, _hashes()).otherwise(F.array("window"))).alias("hash"))
    bench = bench.groupBy("item_id", "hash", "window", "words", "kinds").agg(F.min("at").alias("item_at"))
    small = bench.limit(broadcast_windows + 1).count() <= broadcast_windows
    mine = windows(docs.select("doc_id", "text"), "doc_id", words)
    # The words of a window as columns, which are read only where the hash is found; the text stays behind.
    own = [F.get("low", F.col("at") + j).alias(f"d{j}") for j in range(words)]
    mine = mine.select("doc_id", "at", "low", F.explode(_hashes()).alias("hash"))
    if small:
        mine = mine.join(F.broadcast(bench.select("hash").distinct()), "hash", "left_semi")
    # Of the documents only the windows found get here; the benchmark's rows don't pass the driver.
    hits = mine.select("doc_id", "at", "hash", *own).join(bench.hint("merge"), "hash")
    placed = F.zip_with(F.arrays_zip("words", "kinds"), F.array(*[f"d{j}" for j in range(words)]), lambda b, d: F.struct(b["words"].alias("item"), d.alias("doc"), b["kinds"].alias("kind")))
    slot = lambda p: p["kind"].isin(NUMBER, UNIT, NAME)
    hits = hits.withColumn("placed", placed).filter(F.forall("placed", lambda p: (p["item"] == p["doc"]) | slot(p)))
    slots = F.transform(F.filter("placed", slot), lambda p: F.struct(F.concat(p["kind"], p["item"]).alias("item"), F.concat(p["kind"], p["doc"]).alias("doc")))
    hits = hits.select("doc_id", "item_id", "at", "item_at", "window", slots.alias("slots"))
    line = F.when(F.size("slots") > 0, F.col("at") - F.col("item_at"))
    lines = hits.groupBy("doc_id", "item_id", line.alias("line"))
    lines = lines.agg(F.collect_set(F.struct("window", "slots")).alias("entries"))
    lines = lines.select("doc_id", "item_id", _agreeing(F.col("entries")).alias("entries"))
    lines = lines.select("doc_id", "item_id", F.transform("entries", lambda e: e["window"]).alias("windows"), F.array_distinct(F.flatten(F.transform("entries", lambda e: e["slots"]))).alias("slots"))
    by = lines.groupBy("doc_id", "item_id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("windows")))).cast("long").alias("n_windows"),
        F.max(F.size("slots")).cast("long").alias("n_slots"),
        F.max(F.size(F.filter("slots", lambda s: s["item"] != s["doc"]))).cast("long").alias("n_changed"),
    )
    out = by.join(total, "item_id")
    coverage = F.col("n_windows") / F.col("item_windows")
    return out.select("doc_id", "item_id", "n_windows", "item_windows", coverage.alias("coverage"), "n_slots", "n_changed").filter(F.col("coverage") >= least)
