"""Benchmark decontamination by template windows and consistent slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsheaf.llm.tables import small, spare
from logsheaf.session import materialize

WINDOW = 8
LEAST_WINDOW = 5
LEAST_TOKENS = 13
LEAST_SHARE = 0.5

# A token is a run of letters and digits; numbers keep their inner marks.
TOKEN = r"[\p{L}\p{N}]+(?:[.,]\p{N}+)*"
# The same, with each character of a script without spaces as a token of its own.
UNSPACED = (
    r"\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{2E80}-\x{2FDF}\x{3005}-\x{3007}\x{3040}-\x{30FF}"
    r"\x{31F0}-\x{31FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF66}-\x{FF9F}\x{20000}-\x{3FFFF}"
)
PIECE = rf"[\p{{L}}\p{{N}}&&[^{UNSPACED}]]+(?:[.,]\p{{N}}+)*|[\p{{L}}\p{{N}}&&[{UNSPACED}]]"
NUMBER = r"^\p{N}[\p{N}.,]*$"
UNITS = (
    "mm", "cm", "km", "mg", "kg", "ml", "kb", "mb", "gb", "mph", "kmh", "inch", "inches",
    "feet", "foot", "yard", "yards", "mile", "miles", "meter", "meters", "metre", "metres",
    "kilometer", "kilometers", "gram", "grams", "kilogram", "kilograms", "pound", "pounds",
    "ounce", "ounces", "liter", "liters", "litre", "litres", "gallon", "gallons", "second",
    "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month",
    "months", "year", "years", "dollar", "dollars", "euro", "euros", "cent", "cents", "percent",
    "degree", "degrees",
)


def tokens(text: Column) -> Column:
    """All tokens of a text in order; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE), F.lit(0))


def is_literal(form: Column) -> Column:
    return ~form.startswith("<")


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often it is used."""
    return F.transform(F.array(value), use)[0]


def plain_forms(words: Column) -> Column:
    """Lower-case tokens, with numbers as ``<num>`` and names of units as ``<unit>``."""

    def form(low: Column) -> Column:
        return F.when(low.rlike(NUMBER), "<num>").when(low.isin(*UNITS), "<unit>").otherwise(low)

    return F.transform(F.transform(words, F.lower), form)


def template_forms(words: Column, plain: Column) -> Column:
    """The same with capitalised tokens as ``<name>``."""
    return F.zip_with(
        words,
        plain,
        lambda word, form: F.when(is_literal(form) & (word != form), "<name>").otherwise(form),
    )


def windows(form: Column, size: int) -> Column:
    """Hash of each run of ``size`` forms, by position."""

    def runs(hashes: Column) -> Column:
        last = F.size(hashes) - size
        each = F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda at: F.xxhash64(F.slice(hashes, at + 1, F.lit(size))),
        )
        return F.when(last >= 0, each).otherwise(F.array().cast("array<bigint>"))

    return _bound(F.transform(form, lambda f: F.xxhash64(f)), runs)


def text_windows(text: Column, size: int) -> Column:
    """Windows of a text as arrays by position: with names left as they are, as a template, and exact.

    There is no template where the text has no capitals. Windows of which fewer
    than half are literal are never looked up by their form but exactly; only
    texts with so many numbers and units can have any, others have none.
    Below ``LEAST_WINDOW`` there are only exact windows.
    """
    none = F.array().cast("array<bigint>")

    def exact(words: Column) -> Column:
        return windows(F.transform(words, F.lower), size)

    def of_forms(words: Column, plain: Column) -> Column:
        template = template_forms(words, plain)
        odd = 2 * F.size(F.filter(plain, lambda f: ~is_literal(f))) > size
        named = F.exists(template, lambda f: f == "<name>")
        return F.struct(
            windows(plain, size).alias("plain"),
            F.when(named, windows(template, size)).otherwise(none).alias("template"),
            F.when(odd, exact(words)).otherwise(none).alias("exact"),
        )

    def of_words(words: Column) -> Column:
        if size < LEAST_WINDOW:
            return F.struct(none.alias("plain"), none.alias("template"), exact(words).alias("exact"))
        return _bound(plain_forms(words), lambda plain: of_forms(words, plain))

    return _bound(tokens(text), of_words)


def placed_windows(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, at, window) of all windows to look up; a template only where it differs."""
    # Without "outer", Spark would compute all windows again in a filter before the explode.
    each = docs.select("doc_id", text_windows(F.col("text"), size).alias("w")).select(
        "doc_id", F.posexplode_outer(F.arrays_zip("w.plain", "w.template", "w.exact")).alias("at", "w")
    )
    plain, template, exact = F.col("w.plain"), F.col("w.template"), F.col("w.exact")
    kinds = (
        F.when(exact.isNotNull(), F.array(plain, template, exact))
        .when(template != plain, F.array(plain, template))
        .otherwise(F.array(plain))
    )
    return each.select("doc_id", "at", F.explode(kinds).alias("window"))


def _items(benchmark: DataFrame, id: str, text: str) -> DataFrame:
    """Items with their tokens, forms and window size; those without a token are left out."""
    rows = benchmark.select(F.col(id).alias("item_id"), tokens(F.col(text)).alias("item_words"))
    return (
        rows.withColumn("exact", F.transform("item_words", F.lower))
        .withColumn("plain", plain_forms(F.col("item_words")))
        .withColumn("template", template_forms(F.col("item_words"), F.col("plain")))
        .withColumn("size", F.least(F.size("item_words"), F.lit(WINDOW)))
        .where(F.col("size") > 0)
    )


def _item_windows(items: DataFrame, size: int) -> DataFrame:
    """Windows (window, item_id, item_pos).

    With placeholders, half of the places must be literal; windows for which that does not
    hold before names become placeholders are indexed exactly. Others need no exact
    window, since where one is equal the form is equal too.
    """
    all_forms = None
    for name in ("exact", "template", "plain") if size >= LEAST_WINDOW else ("exact",):
        rows = items.where(F.col("size") == size).select(
            "item_id", name, "plain", F.posexplode(windows(F.col(name), size)).alias("item_pos", "window")
        )
        if size >= LEAST_WINDOW:
            form = "plain" if name == "exact" else name
            literals = F.size(F.filter(F.slice(form, F.col("item_pos") + 1, size), is_literal))
            rows = rows.where((2 * literals < size) == F.lit(name == "exact"))
        rows = rows.select("window", "item_id", "item_pos")
        all_forms = rows if all_forms is None else all_forms.unionByName(rows)
    return all_forms.distinct()


def _consistent(slots: str) -> Column:
    """Each item value meets one document value, and names also the other way round.

    Numbers and units may become equal, as 3 and 5 become 4 and 4.
    """
    names = F.filter(slots, lambda s: s["form"] == "<name>")

    def distinct(rows: Column, field: str) -> Column:
        return F.size(F.array_distinct(F.transform(rows, lambda s: s[field])))

    return (distinct(F.col(slots), "theirs") == F.size(slots)) & (
        distinct(names, "ours") == F.size(names)
    )


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Benchmark items that documents repeat, also with other numbers, names and units.

    Texts become templates, whose windows of ``WINDOW`` tokens are joined
    with the items' by hash. Windows at one distance between document and item
    form an alignment. It counts as a whole if its slots, the places with a
    placeholder, are filled consistently: equal values of the item always meet
    equal values of the document, and equal names also the other way round.
    Otherwise its windows count that repeat the item word for word, or that
    hold no slot value in conflict with another. An item is repeated
    where the windows that count cover ``LEAST_TOKENS`` tokens or
    ``LEAST_SHARE`` of the item's windows.

    Returns (doc_id, item_id, n_windows, coverage, n_slots, n_changed): the best
    alignment's windows, their share of the item's, its distinct slot
    values, and how many of them differ between item and document. Rows are only
    of documents and items that match. ``n_changed`` above 0 is a question with
    other values.

    A window with fewer than half literal words, say one of an equation, is
    looked up with its own numbers and units only. Items shorter than ``WINDOW``
    are matched whole, and below ``LEAST_WINDOW`` tokens only as they are, but
    for case; one of a single word is found wherever the word is. Characters of
    scripts without spaces are tokens. Documents of a null id are
    told apart from others but not from each other, as are those with equal
    ids; null texts are empty; empty tables give no rows; other columns are
    ignored.
    """
    items = materialize(_items(benchmark, item_id, item_text))
    sizes = [row["size"] for row in items.select("size").distinct().orderBy("size").collect()]
    narrow = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    words = narrow.select("doc_id", tokens(F.col("text")).alias("words"))
    hits = None
    for size in sizes or [WINDOW]:
        indexed = small(materialize(_item_windows(items, size)))
        found = placed_windows(narrow, size).join(indexed, "window").select(
            "doc_id", "item_id", F.col("at").alias("pos"), "item_pos", F.lit(size).alias("size")
        )
        hits = found if hits is None else hits.unionByName(found)
    aligned = materialize(
        hits.groupBy("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift"), "size").agg(
            F.sort_array(F.collect_set("item_pos")).alias("starts")
        )
    )
    matched = small(materialize(aligned.select(F.col("doc_id").alias("matched_id")).distinct()))
    texts = words.join(matched, F.col("doc_id").eqNullSafe(F.col("matched_id")), "left_semi")
    both = (
        aligned.withColumnRenamed("doc_id", "matched_id")
        .join(texts, F.col("matched_id").eqNullSafe(F.col("doc_id")))
        .drop("matched_id")
        .join(items.select("item_id", "item_words", "template", "size"), ["item_id", "size"])
    )

    def slot(at: Column) -> Column:
        return F.struct(
            F.lower(F.element_at("item_words", at + 1)).alias("theirs"),
            F.lower(F.try_element_at("words", at + F.col("shift") + 1)).alias("ours"),
            F.element_at("template", at + 1).alias("form"),
        )

    def covered() -> Column:
        return F.array_distinct(
            F.flatten(F.transform("starts", lambda at: F.sequence(at, at + F.col("size") - 1)))
        )

    def slots() -> Column:
        return F.array_distinct(
            F.filter(F.transform("covered", slot), lambda s: ~is_literal(s["form"]))
        )

    all_slots = both.withColumn("covered", covered()).withColumn("slots", slots())
    ambiguous = all_slots.withColumn(
        "clashing",
        F.filter(
            "slots",
            lambda s: F.exists(
                "slots", lambda t: (s["theirs"] == t["theirs"]) != (s["ours"] == t["ours"])
            ),
        ),
    ).withColumn("consistent", _consistent("slots"))
    placed = ambiguous.withColumn(
        "clashes", F.filter("covered", lambda at: F.array_contains("clashing", slot(at)))
    ).withColumn("edits", F.filter("covered", lambda at: slot(at)["theirs"] != slot(at)["ours"]))

    def without(places: str, at: Column) -> Column:
        return ~F.exists(places, lambda place: (place >= at) & (place < at + F.col("size")))

    kept = placed.withColumn(
        "starts",
        F.when(F.col("consistent"), F.col("starts")).otherwise(
            F.filter("starts", lambda at: without("clashes", at) | without("edits", at))
        ),
    ).where(F.size("starts") > 0)
    item_windows = F.size("item_words") - F.col("size") + 1
    checked = (
        kept.withColumn("covered", covered())
        .withColumn("slots", slots())
        .select(
            "doc_id",
            "item_id",
            F.size("starts").alias("n_windows"),
            F.size("covered").alias("n_tokens"),
            (F.size("starts") / item_windows).alias("coverage"),
            "slots",
        )
    )
    pairs = F.size("slots")
    changed = F.size(F.filter("slots", lambda s: s["theirs"] != s["ours"]))
    enough = (F.col("n_tokens") >= LEAST_TOKENS) | (F.col("coverage") >= LEAST_SHARE)
    best = F.max(
        F.struct(
            "n_windows",
            "coverage",
            (-changed).alias("same"),
            pairs.alias("n_slots"),
            changed.alias("n_changed"),
        )
    ).alias("best")
    return (
        checked.where(enough)
        .groupBy("doc_id", "item_id")
        .agg(best)
        .select(
            "doc_id",
            "item_id",
            F.col("best.n_windows").alias("n_windows"),
            F.col("best.coverage").alias("coverage"),
            F.col("best.n_slots").alias("n_slots"),
            F.col("best.n_changed").alias("n_changed"),
        )
    )


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The rows of ``docs``, with all columns, whose document repeats no benchmark item.

    Rows of one id go together, those of a null id too, and repeated rows stay
    repeated; a null text repeats nothing. Very long texts are looked through as a
    whole. An empty table stays empty; columns may have any names.
    """
    own = spare("found", docs)
    found = contaminated(docs, benchmark, id, text).select(F.col("doc_id").alias(own)).distinct()
    found = small(materialize(found))
    return docs.join(found, F.col(id).eqNullSafe(F.col(own)), "left_anti")
