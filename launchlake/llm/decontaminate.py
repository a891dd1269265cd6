"""Benchmark decontamination by canonical templates.

Texts become templates: numbers, names and units are replaced by typed placeholders,
everything else is lower-cased letters. A benchmark item is found in a document when
windows of five template words, covering at least ``share`` of the item's distinct
windows, occur there in the item's order and with consistent slots: equal values of the
item must stand for equal values of the document, wherever the pieces of the copy lie.
Copies and re-parameterised questions are both caught that way.

Only DataFrame functions are used. The windows of all documents are looked up once among the
distinct windows of the benchmark, before anything else is made of them. Pairs of document and
item are then formed through the item's rarest windows only: if more than ``1 - share`` of the
windows are tried, a document that holds ``share`` of them must hold one of those, so lines
common to many items don't pair every document with all of them.

A pair is judged around every stretch of the document, as long as the item, in which an alignment
(a distance between places in document and item) holds: the one with most windows is the reference; every window
of the item is taken where it lies nearest to it, up to one length of the item away, so words put in or left out
between the pieces don't matter; and the longest chain of windows whose places increase in both texts is kept. Along the whole
chain, for every value of the item the value at most places counts, or the item's own among equally
frequent ones, and the windows over other values are lost; without such a value all windows over
these slots are. ``exact`` says that the whole item stands there in one piece and with its own values.

Definitions: a window of placeholders only is no evidence. Items without any other window (fewer than five
words, or placeholders only) are found where their whole sequence of words and numbers stands, without regard to case;
items of one or two words only where they are the whole document. Numbers are digits or spelled out (English, German,
Spanish, French; no articles); units count after a number. Names are words of two letters or
more with a capital, and are read in three ways, each with windows of its own: only inside a
sentence, anywhere, and none at all. So names that begin sentences, names in capitals or mixed
case, and copies in lower case or in capitals are all found; values are compared without case.
A copy in lower case whose names were changed, too, has nothing that tells its names. Null, empty and wordless texts
have no windows, in documents and in the benchmark; items with a null id are found like others, and repeated items are one. Documents are told apart by
128 bits of id and text, so a repeated row is judged like its twin and rows that share an id but not
the text are judged by themselves. Texts may be of any length. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from launchlake.llm.common import bounded, free_name, row_key, settle

WINDOW = 5
SHARE = 0.8

# Units of measure that count as slots behind a number.
UNITS = ("mm cm dm m km in ft yd mi mg g kg t lb lbs oz ml cl l gal s sec secs min mins h hr hrs ms "
         "second seconds minute minutes hour hours day days week weeks month months year years "
         "meter meters metre metres kilometer kilometers kilometre kilometres mile miles foot feet inch inches yard yards "
         "gram grams kilogram kilograms pound pounds ounce ounces ton tons liter liters litre litres gallon gallons "
         "mph kph dollar dollars cent cents euro euros usd eur percent degree degrees").split()
# Spelled-out cardinals; words that are articles as well are left out.
NUMBERS = ("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
           "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion "
           "null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn "
           "zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend "
           "cero uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince veinte treinta cuarenta cincuenta sesenta setenta "
           "ochenta noventa cien ciento mil "
           "zéro deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante mille").split()
NUMBER, NAME, UNIT = 0, 1, 2  # codes of placeholders; other words have the hash of their letters
TOKEN = r"[0-9]+(?:[.,:/][0-9]+)*|\p{L}+"
INSIDE, CAPITAL = "\x01", "\x02"  # stand before words with a capital, inside a sentence or elsewhere


def words_of(text: Column) -> Column:
    """The numbers and words of a text in lower case; words with a capital are marked."""
    bare = F.replace(F.replace(text, F.lit(INSIDE), F.lit(" ")), F.lit(CAPITAL), F.lit(" "))
    marked = F.regexp_replace(bare, r"(?<!\p{L})(?=\p{L}{2})(?=\p{L}*\p{Lu})", CAPITAL)
    marked = F.regexp_replace(marked, rf"{CAPITAL}(?<=[\p{{L}}0-9,;]\s{CAPITAL})", INSIDE)
    return F.regexp_extract_all(F.lower(marked), F.lit(f"[{INSIDE}{CAPITAL}]?(?:{TOKEN})"), F.lit(0))


def _bare(word: Column) -> Column:
    return F.when(F.ascii(word) <= 2, F.substring(word, 2, 1 << 30)).otherwise(word)


def _is_number(bare: Column) -> Column:
    return F.coalesce(F.ascii(bare).between(48, 57) | bare.isin(NUMBERS), F.lit(False))


def with_codes(rows: DataFrame) -> DataFrame:
    """``rows`` with the ``bare`` words of ``words`` and one code per word: names nowhere, inside sentences, and anywhere."""
    number, name, unit = (F.lit(code).cast("bigint") for code in (NUMBER, NAME, UNIT))
    rows = rows.withColumn("bare", F.transform("words", _bare))
    rows = rows.withColumn("none", F.transform("bare", lambda b, i: F.when(_is_number(b), number).when(
        b.isin(UNITS) & (i > 0) & _is_number(F.get("bare", i - 1)), unit).otherwise(F.xxhash64(b))))
    named = lambda marks: F.zip_with("words", "none", lambda w, c: F.when((F.ascii(w) <= marks) & ~c.isin(NUMBER, UNIT), name).otherwise(c))
    return rows.withColumns({"inside": named(1), "anywhere": named(2)})


def _raw_hash(bare: list[Column]) -> Column:
    return F.xxhash64(F.lit("raw"), F.lit(len(bare)), *bare)


def _window(codes: str, pos: Column) -> Column:
    return F.xxhash64(*[F.get(codes, pos + i) for i in range(WINDOW)])


def _window_hashes(docs: DataFrame, key: Column, text: str, raw_sizes: list[int]) -> DataFrame:
    """key, pos and h of all windows of all documents; a window that reads the same in all three ways stands once."""
    rows = with_codes(docs.filter(F.col(text).isNotNull()).select(key.alias("key"), words_of(F.col(text)).alias("words")))
    # outer: for an inner one the optimizer would filter by the size of the array, and cut every text three times
    rows = rows.select("*", F.size("words").alias("n"), F.posexplode_outer("none").alias("pos", "code")).filter("pos is not null")
    pos = F.col("pos")
    rows = rows.select("key", "pos", "n", "bare", _window("none", pos).alias("h0"), _window("inside", pos).alias("h1"), _window("anywhere", pos).alias("h2"))
    hashes = F.when(pos + WINDOW > F.col("n"), F.array().cast("array<bigint>")).when(F.col("h0") == F.col("h2"), F.array("h0")).otherwise(F.array("h0", "h1", "h2"))
    raw = [F.when((pos + m <= F.col("n")) & ((F.lit(m) > 2) | (F.col("n") == m)), _raw_hash([F.get("bare", pos + i) for i in range(m)])) for m in raw_sizes]
    hashes = F.concat(hashes, F.array_compact(F.array(*raw))) if raw else hashes
    return rows.select("key", "pos", F.explode_outer(hashes).alias("h")).filter("h is not null")


def _item_words(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """item, version, words (codes) and bare: every different template of every item."""
    rows = benchmark.select(F.col(item_id).alias("item"), F.col(text).alias("text")).distinct().select("item", "text", words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    return with_codes(rows).select("item", "text", "bare", F.explode(F.array_distinct(F.array("none", "inside", "anywhere"))).alias("words")).select(
        "item", F.xxhash64(F.col("item").isNull(), "item", "text", "words").alias("version"), "words", "bare")


def _items(versions: DataFrame) -> DataFrame:
    """version, item, at, h, n (distinct windows of the version) and size (words): each distinct window once, at its first place."""
    at = F.sequence(F.lit(0), F.size("words") - WINDOW)
    hashes = F.when(F.size("words") >= WINDOW, F.transform(at, lambda i: _window("words", i))).otherwise(F.array().cast("array<bigint>"))
    placed = versions.select("item", "version", "words", F.posexplode(hashes).alias("at", "h"))
    literal = F.exists(F.slice("words", F.col("at") + 1, WINDOW), lambda w: ~w.isin(NUMBER, NAME, UNIT))
    first = placed.filter(literal).groupBy("version", "item", "h").agg(F.min("at").alias("at"), F.max(F.size("words")).alias("size"))
    sizes = first.groupBy("version").agg(F.count("*").alias("n"))
    return first.join(sizes, "version")


def _longest_chain(hits: Column) -> Column:
    """Of hits (at, pos) sorted by ``at``, the most whose ``pos`` increases, last first."""
    longest = F.aggregate(hits, F.array().cast("array<struct<at:int,pos:int,len:int>>"), lambda done, x: F.concat(done, F.array(F.struct(
        x["at"].alias("at"), x["pos"].alias("pos"),
        (F.coalesce(F.array_max(F.transform(F.filter(done, lambda d: d["pos"] < x["pos"]), lambda d: d["len"])), F.lit(0)) + 1).alias("len")))))

    def back(state: Column, x: Column) -> Column:
        fits = (x["len"] == state["need"]) & (x["pos"] < state["pos"])
        return F.when(fits, F.struct((state["need"] - 1).alias("need"), x["pos"].alias("pos"), F.concat(state["out"], F.array(x)).alias("out"))).otherwise(state)

    start = lambda run: F.struct(F.array_max(F.transform(run, lambda x: x["len"])).alias("need"), F.lit((1 << 31) - 1).alias("pos"),
                                 F.array().cast("array<struct<at:int,pos:int,len:int>>").alias("out"))
    chained = F.transform(F.array(longest), lambda run: F.aggregate(F.reverse(run), start(run), back)["out"])[0]
    return F.transform(chained, lambda x: F.struct(x["at"].alias("at"), x["pos"].alias("pos")))


def _chains(hits: DataFrame, share: float) -> DataFrame:
    """key, version, ref, item, n, at and pos: the windows of every chain that can reach ``share``."""
    pair = ["key", "version"]
    region = F.floor(F.col("shift") / F.col("size"))
    best = hits.groupBy(*pair, region.alias("region"), "size", "shift").agg(F.count_distinct("at").alias("c")).groupBy(*pair, "region", "size").agg(
        F.min(F.struct((-F.col("c")).alias("c"), "shift"))["shift"].alias("ref"))
    reach = best.select(*pair, "ref", F.explode(F.array(F.col("region") - 1, F.col("region"), F.col("region") + 1)).alias("region"))
    near = hits.withColumn("region", region).join(reach, [*pair, "region"]).filter(F.abs(F.col("shift") - F.col("ref")) <= F.col("size"))
    group = [*pair, "ref", "item", "n"]
    nearest = near.groupBy(*group, "at").agg(F.min(F.struct(F.abs(F.col("shift") - F.col("ref")).alias("far"), "pos"))["pos"].alias("pos"))
    # One row per window of the item at most, so an array is as long as an item.
    runs = nearest.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("at", "pos"))).alias("run")).filter(F.size("run") >= _needed(share))
    return runs.select(*group, F.explode(_longest_chain(F.col("run"))).alias("x")).select(*group, "x.at", "x.pos")


def _needed(share: float) -> Column:
    return F.ceil(F.col("n") * F.lit(share) - F.lit(1e-9))


def found_items(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                item_text: str = "text", share: float = SHARE) -> DataFrame:
    """key, item, coverage and exact (the whole item in one piece, with its own values) for every item found in a document."""
    versions = settle(_item_words(benchmark, item_id, item_text), "bench-words")
    items = settle(_items(versions), "bench-windows")
    # Items without a window are looked for as they are, through their first words.
    spoken = items.select("item").distinct().withColumn("windowed", F.lit(True))
    raw = versions.alias("v").join(spoken.alias("s"), F.col("v.item").eqNullSafe(F.col("s.item")), "left_anti").select("item", "bare").distinct()
    size = F.least(F.size("bare"), F.lit(WINDOW))
    start = F.lit(None).cast("bigint")
    for m in range(1, WINDOW + 1):
        start = F.when(size == m, _raw_hash([F.get("bare", F.lit(i)) for i in range(m)])).otherwise(start)
    raw = settle(raw.select("item", "bare", size.alias("m"), start.alias("h")), "bench-raw")
    raw_sizes = sorted(r.m for r in raw.select("m").distinct().collect())  # five at most

    wanted = settle(items.select("h").union(raw.select("h")).distinct(), "bench-hashes")
    places = _window_hashes(docs, row_key(doc_id, text), text, raw_sizes)
    matched = settle(places.join(bounded(wanted), "h", "left_semi").distinct(), "matched-windows")

    # An item's rarest windows, one more than it may miss, lead to its candidates.
    spread = items.groupBy("h").agg(F.count("*").alias("df"))
    ranked = items.join(spread, "h").groupBy("version", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("hs"))
    seeds = settle(ranked.select("version", F.explode(F.slice("hs", 1, (F.col("n") - _needed(share) + 1).cast("int"))).alias("s")).select("version", "s.h"), "seeds")
    pairs = settle(matched.select("key", "h").join(bounded(seeds), "h").select("key", "version").distinct(), "candidates")
    hits = settle(pairs.join(items, "version").join(matched, ["key", "h"]).select(
        "key", "version", "item", "n", "size", "at", "pos", (F.col("pos") - F.col("at")).alias("shift")), "hits")
    chains = settle(_chains(hits, share), "chains")
    whole = matched.join(bounded(raw), "h").select("key", "item", "bare", "pos")

    # The words of the documents that are left, for the values of slots and for items without windows.
    keys = settle(chains.select("key").union(whole.select("key")).distinct(), "judged-keys")
    own = docs.filter(F.col(text).isNotNull()).select(row_key(doc_id, text).alias("key"), F.col(text).alias("own_text")).join(bounded(keys), "key", "left_semi")
    own = settle(own.dropDuplicates(["key"]).select("key", F.transform(words_of(F.col("own_text")), _bare).alias("own")), "judged-words")
    verbatim = whole.join(own, "key").filter(F.slice("own", F.col("pos") + 1, F.size("bare")) == F.col("bare")).select("key", "item").distinct().select(
        "key", "item", F.lit(1.0).alias("coverage"), F.lit(True).alias("exact"))

    slots = versions.select("version", "bare", F.posexplode("words").alias("place", "kind")).filter(F.col("kind").isin(NUMBER, NAME, UNIT)).select(
        "version", "place", "kind", F.get("bare", F.col("place")).alias("item_value"))
    along = ["key", "version", "ref"]
    under = chains.select(*along, (F.col("pos") - F.col("at")).alias("shift"), F.explode(F.sequence(F.col("at"), F.col("at") + WINDOW - 1)).alias("place")).distinct().join(slots, ["version", "place"])
    values = settle(under.join(own, "key").select(*along, "shift", "place", "kind", "item_value", F.get("own", F.col("place") + F.col("shift")).alias("value")), "slot-values")
    # An item has few slots, so the votes on one of its values are few.
    slot = [*along, "kind", "item_value"]
    votes = values.groupBy(*slot, "value").agg(F.count("*").alias("n")).groupBy(*slot).agg(
        F.sort_array(F.collect_list(F.struct("n", (F.col("value") == F.col("item_value")).alias("own"), "value")), asc=False).alias("v")).filter(F.size("v") > 1)
    tied = (F.col("v")[0].n == F.col("v")[1].n) & (F.col("v")[0].own == F.col("v")[1].own)
    odd = values.join(votes.select(*slot, F.when(~tied, F.col("v")[0].value).alias("holds")), slot).filter(F.col("holds").isNull() | (F.col("value") != F.col("holds")))
    lost = odd.select(*along, "shift", F.explode(F.sequence(F.col("place") - (WINDOW - 1), F.col("place"))).alias("at")).distinct()
    changed = values.filter("value != item_value").select(*along).distinct().withColumn("changed", F.lit(True))
    kept = chains.withColumn("shift", F.col("pos") - F.col("at")).join(lost, [*along, "shift", "at"], "left_anti")
    covered = kept.groupBy(*along, "item", "n").agg(F.count("*").alias("c"), (F.min("shift") == F.max("shift")).alias("one_piece")).filter(F.col("c") >= _needed(share))
    judged = covered.join(changed, along, "left").select("key", "item", (F.col("c") / F.col("n")).alias("coverage"),
                                                        (F.col("one_piece") & (F.col("c") == F.col("n")) & F.col("changed").isNull()).alias("exact"))
    return judged.unionByName(verbatim).groupBy("key", "item").agg(F.max(F.struct("coverage", "exact")).alias("b")).select("key", "item", "b.coverage", "b.exact")


def decisions(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **rules) -> DataFrame:
    """Per row of ``docs``: doc_id, contaminated, n_items, and the item covered best (ties: the smallest, a null id last) with its coverage."""
    found = settle(found_items(docs, benchmark, doc_id, text, **rules), "found-items")
    best = found.groupBy("key").agg(F.count("*").alias("n_items"), F.min(F.struct((-F.col("coverage")).alias("c"), F.col("item").isNull().alias("no_id"), "item", "exact")).alias("b"))
    best = settle(best.select("key", "n_items", F.col("b.item").alias("item_id"), (-F.col("b.c")).alias("coverage"), F.col("b.exact").alias("exact")), "best-items")
    return docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("key")).join(bounded(best), "key", "left").select(
        "doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), "item_id", "coverage", "exact")


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **rules) -> DataFrame:
    """``docs`` without the rows in which an item was found; all columns stay, whatever their names."""
    name = free_name(docs, "found")
    found = settle(found_items(docs, benchmark, doc_id, text, **rules).select(F.col("key").alias(name)).distinct(), "found-keys")
    return docs.join(bounded(found), row_key(doc_id, text) == F.col(name), "left_anti")
