"""Benchmark decontamination by templates, with DataFrame functions only.

Numbers, units after numbers, and names (words with a capital) become typed placeholders; the rest
is lower-cased words. Windows of five such words are hashed and joined with the windows of the
benchmark items, so a question asked with other numbers or names still matches.

1. Every text is cut into windows; a text is a candidate for an item if it holds at least 80 % of
   the item's distinct windows.
2. Matching windows of candidates are laid side by side. Along one alignment (the distance between
   the two places) each value in a slot of the item must stand for one value in the text. Windows
   of inconsistent alignments do not count; if 80 % still match, the item has leaked.

Only windows with at least three plain words are used, as others fit any text. Texts are told
apart by 128 bits of hash, so copies are decided together, whatever their doc_ids.

A copy in other letter case keeps its words, but not its names. So each window is also hashed with
names as case-folded words, and an item has leaked if either form reaches 80 %. `recased=False`
leaves the second form out.

Defined results: null and empty texts hold no window and stay; items of fewer than five words, or
without a window of three plain words, match nothing; rows and items may repeat; null ids are kept
as they are.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.sources.scratch import materialise

WIDTH = 5
PLAIN_WORDS = 3
PERCENT = 80
#: Benchmark windows that a broadcast may hold, at about 16 bytes each.
BROADCAST_WINDOWS = 2_000_000

TOKEN = r"[0-9]+(?:[.,:/-][0-9]+)*|\p{L}[\p{L}\p{M}]*"
NUMBER, UNIT, NAME = "0", "1", "2"
# fixed values: unit words that may follow a number
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg gram grams lb lbs "
    "pound pounds oz ounce ounces ton tons ml l liter liters litre litres gallon gallons s sec "
    "second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "percent dollar dollars cent cents euro euros usd eur mph kph degrees c f k"
).split()


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def _is_number(word: Column) -> Column:
    return (word >= "0") & (word < ":")


def template(words: Column, folded: bool = False) -> Column:
    """The typed placeholder or the lower-case form of each word; folded, names are words as well."""

    def typed(word: Column, i: Column) -> Column:
        low = F.lower(word)
        after_number = (i > 0) & _is_number(F.get(words, i - 1))
        known = F.when(_is_number(word), NUMBER).when(low.isin(UNITS) & after_number, UNIT)
        if folded:
            # by way of upper case, which some letters share
            return known.otherwise(F.lower(F.upper(word)))
        return known.when(word != low, NAME).otherwise(low)

    return F.transform(words, typed)


def _starts(words: Column) -> Column:
    return F.when(F.size(words) >= WIDTH, F.sequence(F.lit(0), F.size(words) - WIDTH)).otherwise(
        F.array().cast("array<int>")
    )


def _window_hash(words: Column, start: Column, folded: bool) -> Column:
    """The two forms of a template never meet."""
    form = [F.lit(True)] if folded else []
    return F.xxhash64(*[F.get(words, start + k) for k in range(WIDTH)], *form)


def _forms(recased: bool) -> dict[str, bool]:
    """Names of template columns, and whether they are folded."""
    return {"typed": False, "plain": True} if recased else {"typed": False}


def _templates(recased: bool) -> list[Column]:
    return [template(F.col("words"), folded).alias(name) for name, folded in _forms(recased).items()]


def _keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("key_1"), F.xxhash64(F.lit(1), text).alias("key_2")]


def _laid_out(rows: DataFrame, recased: bool, *keys: str) -> DataFrame:
    """keys, folded, start, window, values, kinds: one row per window and form, with its lower-case words."""
    cut = rows.select(*keys, tokens(F.col("text")).alias("words"))
    typed = cut.select(*keys, "words", *_templates(recased))

    def placed(name: str, folded: bool) -> Column:
        return F.transform(
            _starts(F.col(name)),
            lambda s: F.struct(
                F.lit(folded).alias("folded"),
                s.alias("start"),
                _window_hash(F.col(name), s, folded).alias("window"),
                F.transform(F.slice("words", s + 1, WIDTH), F.lower).alias("values"),
                F.slice(name, s + 1, WIDTH).alias("kinds"),
            ),
        )

    each = F.concat(*[placed(name, folded) for name, folded in _forms(recased).items()])
    return typed.select(*keys, F.explode(each).alias("w")).select(*keys, "w.*")


def _item_windows(benchmark: DataFrame, recased: bool) -> DataFrame:
    """`source` names an item even where it has no id, `item` one of its forms."""
    rows = benchmark.select(F.xxhash64("item_id", "text").alias("source"), "item_id", "text").distinct()
    placed = _laid_out(rows, recased, "source", "item_id")
    plain = F.size(F.filter("kinds", lambda kind: ~kind.isin(NUMBER, UNIT, NAME)))
    return placed.filter(plain >= PLAIN_WORDS).withColumn("item", F.xxhash64("source", "folded"))


def leaks(docs: DataFrame, benchmark: DataFrame, recased: bool = True) -> DataFrame:
    """(key_1, key_2, item_id) of the texts that hold an item."""
    items = materialise(_item_windows(benchmark, recased))
    sizes = items.groupBy("item").agg(F.countDistinct("window").alias("size"))
    wanted = items.select("window").distinct()
    if items.count() <= BROADCAST_WINDOWS:
        wanted = F.broadcast(wanted)
    typed = docs.select(*_keys(F.col("text")), tokens(F.col("text")).alias("words"))
    typed = typed.select("key_1", "key_2", *_templates(recased))

    def hashes(name: str, folded: bool) -> Column:
        return F.transform(_starts(F.col(name)), lambda s: _window_hash(F.col(name), s, folded))

    each = F.concat(*[hashes(name, folded) for name, folded in _forms(recased).items()])
    windows = typed.select("key_1", "key_2", F.explode(each).alias("window"))
    found = materialise(windows.join(wanted, "window", "left_semi").distinct())
    pairs = found.join(items.select("item", "window").distinct(), "window")
    enough = 100 * F.col("n") >= PERCENT * F.col("size")
    candidates = materialise(
        pairs.groupBy("key_1", "key_2", "item").agg(F.count("*").alias("n")).join(sizes, "item").filter(enough)
        .select("key_1", "key_2", "item", "size")
    )
    held = _consistent(docs, items, wanted, candidates, recased).filter(enough)
    named = held.join(items.select("item", "source", "item_id").distinct(), "item")
    # one row per item, whichever of its forms match
    return named.select("key_1", "key_2", "source", "item_id").distinct().drop("source")


def _consistent(
    docs: DataFrame, items: DataFrame, wanted: DataFrame, candidates: DataFrame, recased: bool
) -> DataFrame:
    """Candidates with the number of distinct item windows in alignments whose slots agree."""
    named = docs.select(*_keys(F.col("text")), "text")
    texts = named.join(candidates.select("key_1", "key_2").distinct(), ["key_1", "key_2"], "left_semi")
    laid_out = _laid_out(texts, recased, "key_1", "key_2").join(wanted, "window", "left_semi")
    own = laid_out.select(
        "key_1", "key_2", "start", "window", F.col("values").alias("own_values")
    ).distinct()  # copies of a text give the same windows
    theirs = items.select("item", F.col("start").alias("item_start"), "window", "values", "kinds")
    aligned = own.join(theirs, "window").join(candidates, ["key_1", "key_2", "item"])
    run = ["key_1", "key_2", "item", "size", "run"]
    aligned = materialise(aligned.withColumn("run", F.col("start") - F.col("item_start")))
    slots = aligned.select(
        *run, F.explode(F.arrays_zip("kinds", "values", "own_values")).alias("slot")
    ).filter(F.col("slot.kinds").isin(NUMBER, UNIT, NAME))
    maps = slots.select(*run, "slot.*").distinct().groupBy(*run, "kinds", "values").agg(F.count("*").alias("forms"))
    broken = maps.filter("forms > 1").select(*run).distinct()
    return (
        aligned.join(broken, run, "left_anti")
        .groupBy("key_1", "key_2", "item", "size")
        .agg(F.countDistinct("window").alias("n"))
    )


def contamination(docs: DataFrame, benchmark: DataFrame, recased: bool = True) -> DataFrame:
    """Per document: doc_id, n_items that its text holds, the smallest of them, and whether it stays."""
    by_text = leaks(docs, benchmark, recased).groupBy("key_1", "key_2").agg(
        F.count("*").alias("n"), F.min("item_id").alias("first_item")
    )
    named = docs.select("doc_id", *_keys(F.col("text")))
    n_items = F.coalesce("n", F.lit(0))
    return named.join(by_text, ["key_1", "key_2"], "left").select(
        "doc_id", n_items.alias("n_items"), "first_item", (n_items == 0).alias("kept")
    )


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, recased: bool = True) -> DataFrame:
    """The documents, with all their columns, whose text holds no item."""
    held = leaks(docs, benchmark, recased).select(F.col("key_1").alias("_1"), F.col("key_2").alias("_2")).distinct()
    first, second = _keys(docs["text"])
    return docs.join(held, (first == held["_1"]) & (second == held["_2"]), "left_anti")
