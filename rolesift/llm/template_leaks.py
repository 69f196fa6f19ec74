"""Benchmark items in documents, also with other numbers, names or units.

Words become templates: numbers (``1,200`` and ``2.5`` are one each), units and names
(capitalised words but for ``COMMON``, wherever they stand, so a sentence may begin with
one) turn into typed placeholders, the rest is lower-cased. Windows of
``WINDOW`` template words are hashed and joined with the windows of the items; a
shorter item is one window of its own length. Windows of a document and an item that
lie on one diagonal make a run. It counts when it covers ``MIN_WORDS`` words or half
of the item, and when its slots are consistent: each value the item has in its slots
stands for one value of the document throughout, and the other way round. A copied
item maps each value to itself; a re-parameterised one maps them all to new values;
a chance likeness does neither. Slots count where windows match. A run that has
``MIN_WORDS`` words or half of the item in a row word for word counts whatever its
slots say.

Everything is DataFrame functions. The windows of documents are narrow rows (hash of
the text, place, hash of the window) and texts are not moved by the first join; only
texts with a run are tokenised again. The items are broadcast behind a count, else
Spark shuffles the narrow rows. Equal texts share their key, so a hot group of copies
is judged once and its rows meet the verdict in a join Spark can split.

Null or empty texts and items match nothing. Repeated rows are reported once each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesift.llm.base import table
from rolesift.session import broadcast_if_small, materialize

WINDOW = 8
MIN_WORDS = 13
# windows of items kept for a broadcast: a row is 4 numbers
BROADCAST_WINDOWS = 400_000
# fixed values: units of measure
UNITS = (
    "mm cm km ft mile miles inch inches feet yard yards meter meters metre metres kilometer kilometers kilometre "
    "kilometres centimeter centimeters centimetre centimetres millimeter millimeters mg kg lb lbs oz ton tons tonne tonnes "
    "gram grams kilogram kilograms pound pounds ounce ounces ml liter liters litre litres gallon gallons pint pints cup cups "
    "ms sec seconds min minute minutes hour hours day days week weeks month months year years decade decades century "
    "centuries usd eur gbp dollar dollars euro euros cent cents pence percent degree degrees celsius fahrenheit kelvin kmh mph "
    "hz khz mhz ghz kw watt watts kilowatt kilowatts volt volts amp amps ampere amperes ohm ohms joule joules newton newtons "
    "calorie calories horsepower byte bytes kb mb gb tb acre acres hectare hectares"
).split()
# fixed values: words that begin sentences and are no names
COMMON = (
    "a about after all also although an and any are as at because been before but by can compute consider could describe did "
    "do does each every explain find for from given had has have he her here his how however i if in is it its let many may "
    "more most must my no not now of on once one or other our out over she should show since so some such suppose than that "
    "the their then there these they this those though to under until up was we were what when where whether which while who "
    "whom whose why will with would you your"
).split()


def tokens(text: Column) -> Column:
    """Words as they stand; a number with points or commas between its digits is one."""
    return F.regexp_extract_all(text, F.lit(r"\d+(?:[.,]\d+)+(?![\p{L}\p{N}])|[\p{L}\p{N}]+"), F.lit(0))


def plain(word: Column) -> Column:
    return F.lower(word)


def template(word: Column) -> Column:
    """The placeholder of a word, or the word lower-cased."""
    code, first, low = F.ascii(word), F.substring(word, 1, 1), F.lower(word)
    return (
        F.when((code >= 48) & (code <= 57), "<num>")
        .when((first != F.lower(first)) & ~low.isin(COMMON), "<name>")
        .when(low.isin(UNITS), "<unit>")
        .otherwise(low)
    )


def _key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(2), text).alias("k2")]


def windows(templates: Column, width: int) -> Column:
    """The hash of each window of ``width`` words, in order; none for a shorter text."""
    n = F.size(templates) - width + 1
    return F.when(
        n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(templates, i, width)))
    ).otherwise(F.array().cast("array<long>"))


def item_windows(items: DataFrame) -> DataFrame:
    """(item_id, width, n, words, place, window): an item's windows.

    Windows with fewer than two literal words say little and are left to their
    neighbours, unless the item has no better ones.
    """
    rows = items.select("item_id", tokens(F.coalesce("text", F.lit(""))).alias("words"))
    rows = rows.filter(F.size("words") > 0).withColumn("templates", F.transform("words", template))
    n = F.size("words")
    width = F.least(F.lit(WINDOW), n)
    spans = F.transform(F.sequence(F.lit(1), n - width + 1), lambda i: F.slice("templates", i, width))
    literal = F.transform(spans, lambda s: F.size(F.filter(s, lambda w: ~w.startswith("<"))))
    rows = rows.select(
        "item_id", "words", n.alias("n"), width.alias("width"), spans.alias("spans"), literal.alias("literal")
    )
    enough = F.least(F.lit(2), F.array_max("literal"))
    rows = rows.select("item_id", "words", "n", "width", "literal", enough.alias("enough"), F.posexplode("spans").alias("place", "span"))
    rows = rows.filter(F.element_at("literal", F.col("place") + 1) >= F.col("enough"))
    return rows.select("item_id", "words", "n", "width", "place", F.xxhash64("span").alias("window"))


def find_leaks(documents: DataFrame, items: DataFrame, keys: bool = False) -> DataFrame:
    """One row for each document and item it holds: ``doc_id, item_id, n_words, exact``.

    ``n_words`` of the item are covered; ``exact`` tells whether all slots kept their
    values. With ``keys`` the rows are (k1, k2, item_id, ...), one for each text.
    """
    known = materialize(item_windows(items))
    small = broadcast_if_small(known.select("item_id", "n", "width", "place", "window"), BROADCAST_WINDOWS)
    widths = sorted(r[0] for r in known.select("width").distinct().collect())  # WINDOW numbers at most
    texts = documents.select(F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.select(*_key(F.col("text")), F.transform(tokens(F.col("text")), template).alias("templates"))
    hits = None
    for width in widths:
        found = rows.select("k1", "k2", F.posexplode(windows(F.col("templates"), width)).alias("at", "window"))
        met = found.join(small.filter(F.col("width") == width), "window")
        hits = met if hits is None else hits.union(met)
    if hits is None:
        hits = rows.select("k1", "k2", F.lit(0).alias("at"), F.lit(0).cast("long").alias("window")).join(small, "window")
    run = hits.groupBy("k1", "k2", "item_id", "n", "width", (F.col("at") - F.col("place")).alias("shift")).agg(
        F.collect_set("place").alias("places")  # at most the length of an item
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + F.col("width") - 1)))))
    run = run.withColumn("n_words", covered).filter(
        (F.col("n_words") >= F.least(F.lit(MIN_WORDS), F.col("n"))) | (2 * F.col("n_words") >= F.col("n"))
    )
    run = materialize(run)
    # the words of each run: texts of documents with a run only, joined by their key
    with_run = broadcast_if_small(run.select("k1", "k2").distinct())
    suspects = texts.select(*_key(F.col("text")), "text").join(with_run, ["k1", "k2"], "left_semi")
    suspects = suspects.groupBy("k1", "k2").agg(F.first("text").alias("text")).select(
        "k1", "k2", tokens(F.col("text")).alias("doc_words")
    )
    item_words = broadcast_if_small(known.select("item_id", "n", "words").dropDuplicates(["item_id", "n", "words"]))
    both = run.join(suspects, ["k1", "k2"]).join(item_words, ["item_id", "n"])
    lo, hi = F.array_min("places"), F.array_max("places") + F.col("width") - 1
    words = F.transform(
        F.sequence(lo, hi),
        lambda i: F.struct(
            i.alias("place"),
            template(F.get("words", i)).alias("kind"),
            plain(F.get("words", i)).alias("theirs"),
            plain(F.get("doc_words", i + F.col("shift"))).alias("ours"),
        ),
    )
    both = both.withColumn("pairs", words)
    # the most words in a row that are the item's own
    stretch = F.aggregate(
        "pairs",
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda acc, s: F.struct(
            F.when(s["theirs"].eqNullSafe(s["ours"]), acc["now"] + 1).otherwise(0).alias("now"),
            F.when(s["theirs"].eqNullSafe(s["ours"]), F.greatest(acc["most"], acc["now"] + 1)).otherwise(acc["most"]).alias("most"),
        ),
        lambda acc: acc["most"],
    )
    # slots of matched windows only: a word between them that differs says nothing against them
    matched = lambda i: F.exists("places", lambda p: (i >= p) & (i < p + F.col("width")))
    is_slot = lambda s: s["kind"].startswith("<") & s["ours"].isNotNull()
    value = lambda s: F.struct(s["kind"].alias("kind"), s["theirs"].alias("theirs"), s["ours"].alias("ours"))
    slots = F.array_distinct(F.transform(F.filter("pairs", lambda s: is_slot(s) & matched(s["place"])), value))
    both = both.withColumn("slots", slots).withColumn("verbatim", stretch)
    distinct = lambda name: F.size(F.array_distinct(F.transform("slots", lambda s: F.struct(s["kind"], s[name]))))
    consistent = (distinct("theirs") == F.size("slots")) & (distinct("ours") == F.size("slots"))
    exact = ~F.exists("pairs", lambda s: is_slot(s) & (s["theirs"] != s["ours"]))
    copied = (F.col("verbatim") >= F.least(F.lit(MIN_WORDS), F.col("n"))) | (2 * F.col("verbatim") >= F.col("n"))
    leaks = both.filter(consistent | copied).groupBy("k1", "k2", "item_id").agg(
        F.max("n_words").alias("n_words"), F.max(exact).alias("exact")
    )
    if keys:
        return leaks
    named = documents.select("doc_id", *_key(F.coalesce("text", F.lit(""))))
    return named.join(broadcast_if_small(materialize(leaks)), ["k1", "k2"]).select("doc_id", "item_id", "n_words", "exact")


def drop_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    keys = materialize(find_leaks(documents, items, keys=True).select("k1", "k2").distinct())
    rows = documents.select(F.struct(*documents.columns).alias("row"), *_key(F.coalesce("text", F.lit(""))))
    return rows.join(broadcast_if_small(keys), ["k1", "k2"], "left_anti").select("row.*")


def op6_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op6_template_leaks": (op6_template_leaks, None)}
