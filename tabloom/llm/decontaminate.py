"""Benchmark decontamination (9): template windows with typed placeholders, in SQL functions only.

Numbers, names (a capital inside a sentence) and units (after a number) become typed slots, all else is lower-cased words.
Each run of WINDOW tokens of an item and of a document, from every token on, is a key; a second key, with the names as
words, makes the match free of case. A window with fewer than LEAST_LITERALS words is too common: it is lengthened until it
has them, within WIDEST tokens, and its slot values are a key too. Items shorter than WINDOW are one window of their own
length. Keys are hash-joined. Each alignment that met is then compared over the whole item: runs of LEAST_RUN agreeing
tokens count, or LEAST_SHARE of the item, if their slot values map one to one or are all equal. What is found of an item
depends on that item and the document alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import MOST_HOT, cut, drop_ids, once

WINDOW = 8
#: Tokens of a window that must not be slots, and how long it may get for that.
LEAST_LITERALS, WIDEST = 5, 32
#: Agreeing tokens in a row that make a leak (the whole item, if shorter); or the share of the item's tokens that agrees.
LEAST_RUN, LEAST_SHARE = 13, 0.8
#: Item windows that are broadcast; with more, document windows go through a sieve of so many words of 64 bits (broadcast,
#: 64 MB at most), and those that are left are shuffled, those of hot keys to so many parts.
BROADCAST_WINDOWS, SIEVE_WORDS, SALTS = 300_000, 1 << 20, 64
NAME, UNIT, NUMBER = "\ue000", "\ue001", "\ue002"
UNITS = (
    "mm cm m km in ft yd mi mg g kg lb lbs oz t ml cl l s sec secs min mins h hr hrs day days week weeks month months year years "
    "second seconds minute minutes hour hours meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram kilograms "
    "liter liters litre litres mile miles foot feet inch inches pound pounds ounce ounces dollar dollars euro euros cent cents percent "
    "degree degrees kmh mph w kw mw v a hz khz mhz ghz b kb mb gb tb pa kpa j kj cal kcal k c f"
)
_SPLIT = f"[^\\p{{L}}\\p{{N}}{NAME}-{NUMBER}]+"


def marked(text: Column) -> Column:
    """text, lower-cased, with a mark before each name and unit; slot values are still there."""
    names = F.regexp_replace(text, r"(?<=[\p{Ll}\p{N},;] )(?=\p{Lu})", NAME)
    units = rf"(?<=[0-9] ?)(?=(?:{UNITS.replace(' ', '|')})(?![\p{{L}}\p{{N}}]))"
    return once(F.lower(names), lambda low: F.when(low.rlike("[0-9]"), F.regexp_replace(low, units, f" {UNIT}")).otherwise(low))


def _tokens(marks: Column) -> Column:
    return F.array_remove(F.split(marks, _SPLIT), "")


def raw_tokens(marks: Column) -> Column:
    """The words with slot values and without marks."""
    return _tokens(F.regexp_replace(marks, f"[{NAME}{UNIT}]", ""))


def templates(marks: Column) -> Column:
    """The tokens of raw_tokens with each slot replaced by its type."""
    slots = F.regexp_replace(marks, f"([{NAME}{UNIT}])[\\p{{L}}\\p{{N}}]+", "$1")
    return _tokens(F.regexp_replace(slots, r"(?<![\p{L}\p{N}])\p{N}+(?![\p{L}\p{N}])", NUMBER))


def _slot(t: Column) -> Column:
    return t.isin(NAME, UNIT, NUMBER)


def _none() -> Column:
    return F.array().cast("array<int>")


def _range(lo: Column, hi: Column) -> Column:
    """lo to hi; empty if lo is larger."""
    return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(_none())


def _key(at: Column, h: Column) -> Column:
    return F.struct(at.cast("int").alias("at"), h.alias("h"))


def _where(t: Column, test: Callable[[Column], Column]) -> Column:
    """Places of the tokens that pass, from 0."""
    return F.filter(_range(F.lit(0), F.size(t) - 1), lambda i: test(F.get(t, i)))


def _dense(t: Column, slots: Column) -> Column:
    """Starts of the windows with fewer than LEAST_LITERALS words; slots: places of slots."""
    over = WINDOW - LEAST_LITERALS  # so many slots after the first make a window dense
    around = lambda k: _range(F.greatest(F.get(slots, k + over) - (WINDOW - 1), F.lit(0)), F.least(F.get(slots, k), F.size(t) - WINDOW))
    return F.array_distinct(F.flatten(F.transform(_range(F.lit(0), F.size(slots) - 1 - over), around)))


def _more_keys(t: Column, raw: Column, dense: Column) -> Column:
    """The keys of dense windows: lengthened to LEAST_LITERALS words, and with their slot values."""

    def wide(at: Column) -> Column:
        def of(w: Column) -> Column:
            end = F.get(_where(w, lambda x: ~_slot(x)), F.lit(LEAST_LITERALS - 1)) + 1
            return once(end, lambda e: F.when(e.isNotNull(), F.xxhash64(F.slice(w, F.lit(1), F.coalesce(e, F.lit(0))))))

        return _key(at, once(F.slice(t, at + 1, WIDEST), of))

    exact = lambda at: _key(at, F.xxhash64(F.lit("exact"), F.slice(raw, at + 1, WINDOW)))
    widened = F.filter(F.transform(dense, wide), lambda k: k["h"].isNotNull())
    return F.concat(widened, F.transform(dense, exact))


def _variant_keys(t: Column, raw: Column, starts: Column, slots: Column, of_item: bool) -> Column:
    """Keys of the windows from starts. A document has plain keys of dense windows too, which no item has."""
    plain = lambda at: F.transform(at, lambda i: _key(i, F.xxhash64(F.slice(t, i + 1, WINDOW))))

    def keys(dense: Column) -> Column:
        more = once(raw, lambda r: _more_keys(t, r, dense))
        first = plain(F.array_except(starts, dense) if of_item else starts)
        return F.when(F.size(dense) > 0, F.concat(first, more)).otherwise(first)

    return once(_dense(t, slots), keys)


def _long_keys(marks: Column, of_item: bool) -> Column:
    """array of struct(at, h) of all windows: with names as slots and, where a window has a name, with names as words."""
    nameless = F.regexp_replace(marks, NAME, "")

    def of(t: Column) -> Column:
        last = F.size(t) - WINDOW

        def keys(slots: Column) -> Column:
            first = _variant_keys(t, raw_tokens(marks), _range(F.lit(0), last), slots, of_item)
            names = F.filter(slots, lambda i: F.get(t, i) == NAME)
            near = F.array_distinct(F.flatten(F.transform(names, lambda i: _range(F.greatest(i - (WINDOW - 1), F.lit(0)), F.least(i, last)))))
            other = F.filter(slots, lambda i: F.get(t, i) != NAME)
            second = once(templates(nameless), lambda words: _variant_keys(words, raw_tokens(marks), near, other, of_item))
            return F.when(F.exists(slots, lambda i: F.get(t, i) == NAME), F.concat(first, second)).otherwise(first)

        return F.when(last >= 0, once(_where(t, _slot), keys)).otherwise(F.array().cast("array<struct<at:int,h:bigint>>"))

    return once(templates(marks), of)


def _short_keys(marks: Column, n: Column | int, of_item: bool) -> Column:
    """The same of all windows of n tokens, for items of n < WINDOW tokens: as template if it has the words, else exact."""
    n = F.lit(n) if isinstance(n, int) else n
    literals = lambda w: F.size(F.filter(w, lambda x: ~_slot(x)))

    def of(t: Column, raw: Column) -> Column:
        plain = F.transform(_range(F.lit(0), F.size(t) - n), lambda i: _key(i, F.when(literals(F.slice(t, i + 1, n)) >= LEAST_LITERALS, F.xxhash64(F.slice(t, i + 1, n)))))
        exact = F.transform(_range(F.lit(0), F.size(t) - n), lambda i: _key(i, F.xxhash64(F.lit("exact"), F.slice(raw, i + 1, n))))
        plain = F.filter(plain, lambda k: k["h"].isNotNull())
        return F.when(F.size(plain) > 0, plain).otherwise(exact) if of_item else F.concat(plain, exact)

    both = [once(templates(m), lambda t: once(raw_tokens(marks), lambda r: of(t, r))) for m in (marks, F.regexp_replace(marks, NAME, ""))]
    return F.concat(*both)


def _doc_keys(text: Column, lengths: list[int]) -> Column:
    return once(marked(text), lambda m: F.concat(_long_keys(m, False), *[_short_keys(m, n, False) for n in lengths]))


def _runs(z: Column, agree: Callable[[Column], Column]) -> Column:
    """array of struct(lo, n): maximal runs of elements of z that agree, from 0."""
    apart = F.filter(_range(F.lit(0), F.size(z) - 1), lambda i: ~agree(F.get(z, i)))
    edges = F.concat(F.array(F.lit(-1)), apart, F.array(F.size(z)))
    return once(edges, lambda e: F.transform(F.sequence(F.lit(1), F.size(e) - 1), lambda j: F.struct((F.get(e, j - 1) + 1).alias("lo"), (F.get(e, j) - F.get(e, j - 1) - 1).alias("n"))))


def _sieved(there: DataFrame, keys: DataFrame) -> DataFrame:
    """there without most rows whose h is in no row of keys: a bit for each h, one of 64 * SIEVE_WORDS, is set or not.

    Rows are dropped where they are made, before any shuffle; none is whose h is in keys.
    """
    bit = "CAST(shiftrightunsigned(h, 58) AS INT)"
    word = F.pmod("h", F.lit(SIEVE_WORDS)).alias("word")
    bits = keys.groupBy(word).agg(F.expr(f"bit_or(shiftleft(1L, {bit}))").alias("bits"))
    return there.select("*", word).join(F.broadcast(bits), "word").where(F.expr(f"bit_get(bits, {bit}) = 1")).drop("word", "bits")


def _met_by_shuffle(there: DataFrame, keys: DataFrame) -> DataFrame:
    """there joined with keys by h, for keys of any number: sieved, then shuffled, with the rows of a hot h in SALTS parts."""
    hits = cut(_sieved(there, keys), "hits")
    least = hits.count() // MOST_HOT
    hot = cut(hits.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > least).select("h"), "hot")  # under MOST_HOT rows
    cold = hits.join(F.broadcast(hot), "h", "left_anti").join(keys, "h")
    salted = hits.join(F.broadcast(hot), "h").withColumn("salt", F.pmod(F.xxhash64("doc_id", "at"), F.lit(SALTS)).cast("int"))
    parts = keys.join(F.broadcast(hot), "h").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return cold.unionByName(salted.join(parts, ["h", "salt"]).drop("salt"))


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document and item it holds: doc_id, item_id, n_windows, reparameterised.

    Tokens agree if they are equal words in any case or slots of one type. A document holds an item if, along an alignment
    that a key found, a run of LEAST_RUN tokens or more (the whole item, if shorter) agrees, has LEAST_LITERALS words,
    and its slot values map one to one; or if such a run agrees in slot values too; or if LEAST_SHARE of the item's tokens
    agree along it, under the conditions of the first case. A shorter phrase in common is no leak. n_windows: all windows
    of these runs; reparameterised: no such alignment has all slot values equal.
    Each item that has a token is found wherever it stands as a whole, in any case, with other slot values too if a window
    of it has the words (within WIDEST tokens); a one-word item is held by every document with that word. Null
    texts and null ids hold nothing and are held by nothing; repeated rows of an id are one document. Documents that
    hold nothing have no row; empty tables give an empty table. Other columns are not read.
    """
    items = items.select(F.col(item_id_col).cast("long").alias("item_id"), marked(F.col(item_text_col)).alias("m")).where("item_id IS NOT NULL AND m IS NOT NULL")
    items = items.select("item_id", F.xxhash64("m").alias("item_text"), "m", raw_tokens(F.col("m")).alias("item_raw"), templates(F.col("m")).alias("item_t"))
    items = cut(items.where(F.size("item_t") > 0).distinct(), "items")
    n = F.size("item_t")
    keys = F.when(n >= WINDOW, _long_keys(F.col("m"), True)).otherwise(_short_keys(F.col("m"), n, True))
    windows = cut(items.select("item_id", "item_text", n.alias("item_n"), F.inline(keys)).withColumnRenamed("at", "item_at").distinct(), "windows")
    lengths = sorted(r["item_n"] for r in windows.where(F.col("item_n") < WINDOW).select("item_n").distinct().collect())
    small = windows.count() <= BROADCAST_WINDOWS

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    there = rows.select("doc_id", F.inline(_doc_keys(F.col("text"), lengths)))
    keys = windows.select("h", "item_id", "item_text", "item_at")
    shift = (F.col("at") - F.col("item_at")).alias("shift")
    joined = there.join(F.broadcast(keys), "h") if small else _met_by_shuffle(there, keys)
    met = cut(joined.select("doc_id", "item_id", "item_text", shift).distinct(), "met")

    # each alignment over the whole item, for the documents that met something
    who = met.select("doc_id").distinct()
    again = rows.join(who, "doc_id", "left_semi").distinct().select("doc_id", marked(F.col("text")).alias("m")).select("doc_id", raw_tokens(F.col("m")).alias("raw"), templates(F.col("m")).alias("t"))
    texts = items.select("item_id", "item_text", "item_raw", "item_t")
    spots = met.join(again, "doc_id").join(F.broadcast(texts) if small else texts, ["item_id", "item_text"])
    skipped = F.greatest(F.lit(0), -F.col("shift"))
    part = lambda tokens, at: F.slice(tokens, at + 1, F.greatest(F.lit(0), F.size("item_t") - skipped))
    spots = spots.select(
        "doc_id", "item_id", F.size("item_t").alias("item_n"), F.least(F.lit(LEAST_RUN), F.size("item_t")).alias("need"),
        part("t", F.col("shift") + skipped).alias("t"), part("raw", F.col("shift") + skipped).alias("raw"), part("item_t", skipped).alias("item_t"), part("item_raw", skipped).alias("item_raw"),
    )
    equal = lambda z: z["raw"] == z["item_raw"]
    agree = lambda z: (z["t"] == z["item_t"]) | equal(z)
    slot = lambda z: (z["t"] == z["item_t"]) & _slot(z["t"])
    enough = lambda runs: F.filter(runs, lambda r: r["n"] >= F.col("need"))

    def judged(agreeing: Column, n: Column) -> Column:
        """struct(n, ok, same) of agreeing tokens."""

        def of(pairs: Column) -> Column:
            theirs = F.array_distinct(F.transform(pairs, lambda z: F.struct(z["item_t"], z["item_raw"])))
            ours = F.array_distinct(F.transform(pairs, lambda z: F.struct(z["item_t"], z["raw"])))
            one_to_one = (F.size(pairs) == F.size(theirs)) & (F.size(pairs) == F.size(ours))
            return F.struct(n.alias("n"), one_to_one.alias("ok"), F.forall(pairs, equal).alias("same"))

        words = F.size(F.filter(agreeing, lambda z: ~slot(z)))
        found = once(F.array_distinct(F.filter(agreeing, slot)), of)
        return F.struct(found["n"].alias("n"), (found["ok"] & (words >= LEAST_LITERALS)).alias("ok"), found["same"].alias("same"))

    zipped = F.slice(F.arrays_zip("item_t", "item_raw", "t", "raw"), F.lit(1), F.least(F.size("item_t"), F.size("t")))
    spots = spots.select("doc_id", "item_id", "need", "item_n", zipped.alias("z")).where(F.size("z") > 0)
    spots = spots.select("doc_id", "item_id", "need", "item_n", "z", _runs(F.col("z"), agree).alias("runs"), enough(_runs(F.col("z"), equal)).alias("equal"))
    like = F.filter(F.transform(enough("runs"), lambda r: judged(F.slice("z", r["lo"] + 1, r["n"]), r["n"])), lambda x: x["ok"])
    share = once(F.filter("z", agree), lambda x: F.filter(F.array(judged(x, F.size(x))), lambda j: j["ok"] & (j["n"] >= F.col("item_n") * LEAST_SHARE)))
    spots = spots.select("doc_id", "item_id", "runs", "equal", like.alias("like"), share.alias("share")).where("size(like) > 0 OR size(share) > 0 OR size(equal) > 0")
    count = lambda runs: F.aggregate(runs, F.lit(0).cast("long"), lambda s, r: s + F.greatest(r["n"] - WINDOW + 1, F.lit(1)))
    of_share = count(F.filter("runs", lambda r: r["n"] >= WINDOW))
    counted = F.when(F.size("like") > 0, count("like")).when(F.size("share") > 0, F.greatest(of_share, F.lit(1))).otherwise(count("equal"))
    both = F.concat("like", "share")
    same = F.when(F.size(both) > 0, F.exists(both, lambda r: r["same"])).otherwise(F.lit(True))
    return spots.groupBy("doc_id", "item_id").agg(F.sum(counted).alias("n_windows"), (~F.max(same)).alias("reparameterised"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without those that hold an item; columns unchanged."""
    return drop_ids(docs, leaks(docs, items).select("doc_id"))
