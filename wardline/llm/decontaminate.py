"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so that a question with other parameters has the same
template. Windows of template words are hashed and joined with those of the benchmark; the values behind the
placeholders are then compared: within one alignment, windows count with placeholders only if each of their values of
the benchmark item stands for one value of the document. A capitalised word that opens a sentence may be a name or not,
so windows with one are read both ways. Windows are built only for documents that hold an anchor: a few words in a row
without any placeholder, of which each benchmark window has one. Everything is a DataFrame expression.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.texts import named, quoted
from wardline.session import stage

NUMBER, NAME, UNIT = "<number>", "<name>", "<unit>"
# Units, lower case.
UNITS = (
    "mm cm m km in inch inches ft feet foot yd yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds oz ounce ounces "
    "ml l liter liters litre litres gallon gallons second seconds sec minute minutes min hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros percent degrees degree mph kph"
).split()
# Marks put before typed words while a text is canonicalised; control characters of the text itself become blanks.
_NUMBER_MARK, _NAME_MARK, _UNIT_MARK, _OPENER_MARK = "\x01", "\x02", "\x03", "\x04"
_MARKS = _NUMBER_MARK + _NAME_MARK + _UNIT_MARK + _OPENER_MARK
_BLANKS = "\t\n\x0b\x0c\r" + _MARKS
_INNER = r"[^\p{L}\p{N} \x01-\x04]"
_IS_NUMBER = r"(?<![^ ])(?=[^\p{L}\p{N} ]{0,8}[0-9][0-9.,:/]*+[^\p{L}\p{N} ]*+(?![^ ]))"
_IS_UNIT = r"(?i)(?<=[0-9][^\p{L}\p{N} ]{0,3} )(?=(?:" + "|".join(UNITS) + r")(?![\p{L}\p{N}]))"
_IS_NAME = r"([^ .!?:] )(?=\p{Lu})"
_IS_OPENER = r"(?<![^ ])(?=\p{Lu})"
#: Words in a row of an anchor, the longest that a window has.
ANCHOR_SIZES = (5, 3, 2, 1)
_NO_LETTERS = r"[^\p{L}]+"
_OUTER = rf"(?={_INNER})(?:(?<![^ \x01-\x04]){_INNER}++|(?<=[\p{{L}}\p{{N}}]){_INNER}++(?![^ ]))"


@dataclass(frozen=True)
class DecontaminationOptions:
    """``window`` template words are compared at a time, shorter items as a whole; a window counts if at least
    ``literal`` of its words are not placeholders (all but two in windows of fewer words). A document holds an item
    if alignments cover ``coverage`` of the item's windows, or if one alignment has ``run`` words of the item in a row
    (the whole of a shorter one). At most ``broadcast_rows`` benchmark windows are
    broadcast (24 bytes each); more are joined by a shuffle. Up to ``anchors`` anchors (a hash each) travel with the plan;
    with more, or with ``literal`` below one, windows are built for every document, with the same result.
    """

    window: int = 8
    literal: int = 4
    coverage: float = 0.5
    run: int = 13
    broadcast_rows: int = 1_000_000
    anchors: int = 50_000


def _pinned(frame: DataFrame, column: str, value: Column) -> DataFrame:
    """``frame`` with ``value`` computed once per row.

    A plain projection would be folded into the lambdas that use the column and run again for every element.
    """
    return frame.select(*[c for c in frame.columns if c != column], F.explode(F.array(value)).alias(column))


def marked_words(text: Column) -> Column:
    """A text in lower case, words blanks apart, outer punctuation gone, typed words behind their marks.

    Each step is one pass over the text; words of punctuation only are left out. A name is a capitalised word
    that does not open a sentence, one that does has a mark of its own; a unit follows a number, or is glued to it.
    """
    plain = F.translate(F.coalesce(text, F.lit("")), _BLANKS, " " * len(_BLANKS))
    spaced = F.regexp_replace(plain, r"(?<=[0-9])(?=\p{L})", " ")
    numbered = F.regexp_replace(F.regexp_replace(spaced, _IS_UNIT, _UNIT_MARK), _IS_NUMBER, _NUMBER_MARK)
    typed = F.regexp_replace(F.when(plain.rlike("[0-9]"), numbered).otherwise(plain), _IS_NAME, f"$1{_NAME_MARK}")
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(typed, _IS_OPENER, _OPENER_MARK), _OUTER, "")))


def _split(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " +"))


def _placeholders(text: Column) -> Column:
    for mark, name in ((_NUMBER_MARK, NUMBER), (_UNIT_MARK, UNIT), (_NAME_MARK, NAME)):
        text = F.regexp_replace(text, f"{mark}[^ ]++", name)
    return text


def with_template(frame: DataFrame) -> DataFrame:
    """``frame`` (with ``text``, which is dropped) plus ``words`` (or placeholders), ``values`` (marked words), ``plain``.

    ``values`` is null where nothing is typed. ``opened`` and ``opened_values`` are words and values with sentence
    openers as names, null where there are none; ``plain``, the words without placeholders, is null without either.
    """
    frame = _pinned(frame, "text", marked_words(F.col("text")))
    typed, opens = F.col("text").rlike(r"[\x01-\x03]"), F.contains("text", F.lit(_OPENER_MARK))
    closed, opened = F.translate("text", _OPENER_MARK, ""), F.translate("text", _OPENER_MARK, _NAME_MARK)
    readings = F.struct(
        _split(F.when(typed, _placeholders(closed)).otherwise(closed)).alias("words"), F.when(typed, _split(closed)).alias("values"),
        F.when(opens, _split(_placeholders(opened))).alias("opened"), F.when(opens, _split(opened)).alias("opened_values"),
        F.when(typed | opens, _split(F.translate("text", _MARKS, ""))).alias("plain"),
    )
    return _pinned(frame, "text", readings).select(*[c for c in frame.columns if c != "text"], "text.*")


def _joined(hashes: Column, gap: int) -> Column:
    """Hashes of windows that are longer by ``gap`` words, each from two that overlap or touch; null for null."""
    count = F.greatest(F.size(hashes) - gap, F.lit(0))
    longer = F.zip_with(F.slice(hashes, F.lit(1), count), F.slice(hashes, F.lit(gap + 1), count), lambda a, b: F.xxhash64(a, b))
    return F.when(hashes.isNotNull(), longer)


def with_hashes(frame: DataFrame, readings: dict[str, str], sizes: list[int]) -> DataFrame:
    """``frame`` without the ``readings``' arrays of words and with ``k``: for each of ``sizes`` the ``size`` and, by the names of
    ``readings``, a hash for every window. They are doubled up from pairs, each length computed once per row.
    """
    kept, span, done = [c for c in frame.columns if c not in readings.values()], 1, {}
    of = lambda make: F.struct(*[make(name).alias(name) for name in readings])
    rows = _pinned(frame, "_hashes", of(lambda name: F.transform(readings[name], lambda w: F.xxhash64(w)))).select(*kept, "_hashes")
    while True:
        for n in sizes:
            if span <= n < 2 * span:
                done[n] = f"_size{n}"
                rows = _pinned(rows, done[n], of(lambda name: _joined(F.col("_hashes")[name], n - span))) if n > span else rows.withColumn(done[n], F.col("_hashes"))  # noqa: B023
        if 2 * span > max(sizes):
            kinds = [F.struct(F.lit(n).alias("size"), *[F.col(done[n])[name].alias(name) for name in readings]) for n in sizes]
            return rows.select(*kept, F.explode(F.array(*kinds)).alias("k"))
        rows, span = _pinned(rows, "_hashes", of(lambda name: _joined(F.col("_hashes")[name], span))), span * 2  # noqa: B023


def telling_windows(placed: DataFrame, options: DecontaminationOptions) -> DataFrame:
    """The rows of ``placed_windows`` with their slots, without those that have too few words besides placeholders."""
    return _with_slots(placed).where(_telling(options)).drop("size")


def _telling(options: DecontaminationOptions) -> Column:
    most = F.col("size") - F.least(F.lit(options.literal), F.greatest(F.lit(1), F.col("size") - 2))
    return F.col("slots").isNull() | (F.size(F.split("slots", " ")) <= most)


def every_window(frame: DataFrame, sizes: list[int]) -> DataFrame:
    """One row per window of ``frame`` (``id``, ``text``): ``id``, ``size``, ``pos``, ``hash``, ``slots``, ``opened``.

    ``slots`` are the typed words of a window with placeholders, one blank apart. Each such window comes a second time
    without placeholders and slots: a verbatim copy in other letter case is found although its names no longer look like
    names. Windows with a sentence opener come once more with it as a name (``opened``). All from one pass over the text.
    """
    return _with_slots(placed_windows(frame, sizes))


def placed_windows(frame: DataFrame, sizes: list[int]) -> DataFrame:
    """The same rows with the marked words ``values`` of the reading that has placeholders there, instead of ``slots``.

    Each reading is a row for a moment and each of its windows another, so that no window is a call of an interpreted lambda.
    """
    words = with_template(frame.select("id", "text"))
    runs = with_hashes(words, {"typed": "words", "opened": "opened", "plain": "plain"}, sizes)
    plain = F.coalesce("k.plain", "k.typed")

    def reading(hashes: Column, other: Column, values: Column, opened: Column) -> Column:
        """Windows of a reading count where their hashes differ from those of the ``other``: they have placeholders of it."""
        return F.struct(hashes.alias("hashes"), other.alias("other"), values.alias("values"), opened.alias("opened"))

    none = F.lit(None)
    every = reading(plain, none.cast("array<bigint>"), none.cast("array<string>"), none.cast("boolean"))
    typed = F.when(F.col("values").isNotNull(), reading(F.col("k.typed"), plain, F.col("values"), F.lit(False)))
    opened = F.when(F.col("opened_values").isNotNull(), reading(F.col("k.opened"), F.col("k.typed"), F.col("opened_values"), F.lit(True)))
    read = runs.select("id", F.col("k.size").alias("size"), F.size(plain).alias("_n"), F.explode(F.array(every, typed, opened)).alias("r")).where("r IS NOT NULL")
    placed = read.select("id", "size", "_n", "r", F.posexplode("r.hashes").alias("pos", "hash"))
    differs = F.col("r.other").isNull() | ((F.col("hash") != F.get("r.other", F.col("pos"))) & (F.col("pos") < F.col("_n")))
    return placed.where(differs).select("id", "size", "pos", "hash", F.col("r.opened").alias("opened"), F.col("r.values").alias("values"))


def _with_slots(placed: DataFrame) -> DataFrame:
    inside = F.slice("values", F.col("pos") + 1, F.col("size"))
    slots = F.array_join(F.filter(inside, lambda v: v.between(_NUMBER_MARK, _OPENER_MARK)), " ")
    return _pinned(placed.withColumn("slots", F.lit(None)), "slots", slots).drop("values")


def item_anchors(per_item: DataFrame, options: DecontaminationOptions) -> tuple[dict[int, list[int]], bool] | None:
    """Hashes of anchors by number of words, and whether some window has none; null with more than ``anchors``.

    ``per_item`` has ``text`` and its window ``size``. An anchor is the longest run of words of a window that are no placeholder in
    any reading, counted in runs of letters, which do not depend on punctuation or numbers around them. A window without
    such words can only match with its openers, or verbatim, as they stand, and any of these will do. What is left has
    no letters, so a document without numbers does not hold it.
    """
    if options.literal < 1:
        return None
    raw = _split(F.col("text"))
    items = _pinned(_pinned(per_item.select("size", "text"), "text", marked_words(F.col("text"))), "text", raw)
    inside = F.transform(F.sequence(F.lit(0), F.size("text") - F.col("size")), lambda i: F.slice(F.col("text"), i + 1, F.col("size")))
    windows = items.select("size", F.explode(inside).alias("w"))

    grams = F.array(*[
        F.struct(F.lit(n).alias("n"), F.slice("w", k + 1, n).alias("words")) for n in ANCHOR_SIZES for k in range(options.window - n + 1)
    ])
    letters = lambda words: F.filter(F.split(F.translate(F.array_join(words, " "), _MARKS, ""), _NO_LETTERS), lambda x: x != "")
    free = lambda words, marks: F.forall(words, lambda x: ~x.rlike(marks))
    kind = lambda g: F.when(free(g["words"], r"^[\x01-\x04]"), 3).when(g["n"] > 1, 0).when(free(g["words"], r"^[\x01-\x03]"), 2).otherwise(1)
    told = F.transform(grams, lambda g: F.struct(kind(g).alias("kind"), g["n"].alias("n"), F.size(g["words"]).alias("size"), letters(g["words"]).alias("letters")))
    usable = F.filter(told, lambda g: (g["kind"] > 0) & (g["size"] == g["n"]) & (F.size(g["letters"]) >= g["n"]))
    first = lambda g: F.slice(g["letters"], F.lit(1), g["n"])
    ranked = F.transform(usable, lambda g: F.struct(g["kind"].alias("kind"), g["n"].alias("n"), F.char_length(F.array_join(first(g), "")).alias("chars"), F.xxhash64(first(g)).alias("hash")))
    literal = F.exists("w", lambda x: ~x.rlike(r"^[\x01-\x04]"))
    windows = windows.select(literal.alias("literal"), F.array_max(ranked).alias("a"))
    chosen = F.when(~F.col("literal") | (F.col("a.kind") == 3), F.col("a"))
    rows = windows.select(chosen.alias("a")).select("a.n", "a.hash").distinct().limit(options.anchors + 2).collect()
    if len(rows) > options.anchors:
        return None
    return {n: [r["hash"] for r in rows if r["n"] == n] for n in ANCHOR_SIZES}, any(r["n"] is None for r in rows)


def with_anchor(frame: DataFrame, anchors: tuple[dict[int, list[int]], bool] | None) -> DataFrame:
    """The distinct rows of ``frame`` (``id``, ``text``) whose text may hold a window of the benchmark; no hit is lost.

    Each run of letters is a row for a moment, so that the test is compiled code; only rows with an anchor go on.
    """
    if anchors is None:
        return frame
    by_size, numbers = anchors
    tests = [F.col("text").rlike(r"\p{N}")] if numbers else []
    for n, hashes in by_size.items():
        if hashes:
            gram = F.xxhash64("_word", *[F.get("_letters", F.col("_at") + j) for j in range(1, n)])
            tests.append(gram.isin(hashes))
    if not tests:
        return frame.limit(0)
    letters = _pinned(frame.withColumn("_letters", F.lit(None)), "_letters", F.split(F.lower("text"), _NO_LETTERS))
    placed = letters.select("id", "text", "_letters", F.posexplode("_letters").alias("_at", "_word"))
    return placed.where(reduce(or_, tests)).select("id", "text").distinct()


def item_windows(
    benchmark: DataFrame, options: DecontaminationOptions, key: str = "item_id", text: str = "text"
) -> tuple[DataFrame, list[int], tuple[dict[int, list[int]], bool] | None]:
    """The benchmark's windows, the window sizes in use (at most ``window``), and the anchors (see ``item_anchors``).

    Each row has its item's number of ``windows``, how many of them can match with placeholders (``open_windows``:
    those with enough other words, or without any), and whether it is ``bare``, a window without any.
    """
    items = benchmark.select(named(benchmark, key).alias("id"), named(benchmark, text).alias("text"))
    words = with_template(items.withColumn("kept", F.col("text")))
    per_item = stage(words.select("id", F.col("kept").alias("text"), F.least(F.size("words"), F.lit(options.window)).alias("size")).where("size > 0"), "benchmark")
    sizes = sorted(r["size"] for r in per_item.select("size").distinct().collect())  # options.window values at most
    whole = None
    for size in sizes:
        rows = every_window(per_item.where(F.col("size") == size), [size])
        whole = rows if whole is None else whole.unionByName(rows)
    if whole is None:
        nothing = {"pos": F.lit(0), "size": F.lit(0), "hash": F.lit(0).cast("long"), "slots": F.lit(""), "opened": F.lit(False), "bare": F.lit(False), "windows": F.lit(0).cast("long"), "open_windows": F.lit(0).cast("long")}
        return per_item.select("id", *[c.alias(n) for n, c in nothing.items()]), [], ({}, False)
    typed = F.col("slots").isNotNull()
    marked = whole.withColumns({"telling": _telling(options), "bare": ~F.max(typed & ~F.coalesce("opened", F.lit(False))).over(Window.partitionBy("id", "pos"))})
    marked = stage(marked, "benchmark_windows")
    sizes_of = marked.groupBy(F.col("id").alias("i")).agg(
        F.countDistinct("pos").alias("windows"), F.countDistinct(F.when(F.col("bare") | (typed & F.col("telling")), F.col("pos"))).alias("open_windows")
    )
    return marked.where("telling").drop("telling").join(sizes_of, F.col("id").eqNullSafe(F.col("i"))).drop("i"), sizes, item_anchors(per_item, options)


def find_leaks(docs: DataFrame, benchmark: DataFrame, options: DecontaminationOptions | None = None, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and benchmark item found in it: the keys, ``matched`` windows of the item's ``windows``,
    ``coverage`` and ``altered`` (some value differs from the item's: a re-parameterised copy).

    Null and empty texts hold nothing, and empty items are found nowhere. Rows that share a key count as one
    document; null keys are a key of their own. Where an item's value stands for several values of an alignment, the
    windows that hold it count only if they are verbatim. ``coverage`` is the share of all windows, or that of the
    windows that can match with placeholders where it is larger and these span ``run`` words or the whole item; it is
    below the option's where a run alone decides.
    """
    options = options or DecontaminationOptions()
    wanted, sizes, anchors = item_windows(benchmark, options, item, item_text)
    of_item = ["windows", "open_windows", "item_size"]
    items = wanted.select(F.col("id").alias("item_id"), F.col("pos").alias("item_pos"), "hash", F.col("slots").alias("item_slots"), "bare", "windows", "open_windows", F.col("size").alias("item_size"))
    rows = docs.select(named(docs, key).alias("id"), named(docs, text).alias("text"))
    small = items.limit(options.broadcast_rows + 1).count() <= options.broadcast_rows
    placed = placed_windows(with_anchor(rows, anchors), sizes or [options.window])
    # few windows meet an item's: slots are read for these alone, except where all words would then go through a shuffle
    hits = telling_windows(placed.join(F.broadcast(items), "hash"), options) if small else telling_windows(placed, options).join(items, "hash")
    # Sets below are bounded by the item: its windows, each with the slots of the one or two ways it matches.
    hit = F.struct(F.col("item_pos").alias("pos"), "bare", F.col("item_slots").alias("theirs"), F.col("slots").alias("ours"))
    aligned = hits.groupBy(F.col("id").alias("doc_id"), "item_id", (F.col("pos") - F.col("item_pos")).alias("shift"))
    per_shift = aligned.agg(F.collect_set(hit).alias("hits"), *[F.max(c).alias(c) for c in of_item])
    words = lambda c: F.split(c, " ")
    slotted = F.filter("hits", lambda h: h["theirs"].isNotNull() & h["ours"].isNotNull())
    zipped = F.flatten(F.transform(slotted, lambda h: F.arrays_zip(words(h["theirs"]).alias("theirs"), words(h["ours"]).alias("ours"))))
    per_shift = _pinned(per_shift, "pairs", F.array_distinct(zipped))
    values = F.transform("pairs", lambda p: p["theirs"])
    several = F.array_distinct(F.filter(values, lambda v: F.size(F.filter("pairs", lambda p: p["theirs"] == v)) > 1))
    unclear = F.when(F.size(F.array_distinct(values)) == F.size("pairs"), F.array().cast("array<string>")).otherwise(several)
    per_shift = _pinned(per_shift, "unclear", unclear)
    kept = F.filter("hits", lambda h: h["ours"].isNull() | ~F.arrays_overlap(words(h["theirs"]), F.col("unclear")))
    altered = F.exists("pairs", lambda p: p["theirs"] != p["ours"])
    per_shift = _pinned(per_shift.withColumn("altered", altered), "kept", kept)
    per_shift = _pinned(per_shift, "places", F.array_sort(F.array_distinct(F.transform("kept", lambda h: h["pos"]))))
    long = F.least(F.col("windows"), F.greatest(F.lit(1), options.run - F.col("item_size") + 1)).cast("int")
    in_row = F.exists(F.transform("places", lambda p, i: F.get("places", i + long - 1) == p + long - 1), lambda x: x)
    flat = per_shift.select("doc_id", "item_id", *of_item, "altered", F.coalesce(in_row, F.lit(False)).alias("in_row"), F.explode("kept").alias("h"))
    is_open = F.col("h.bare") | F.col("h.ours").isNotNull()
    found = flat.groupBy("doc_id", "item_id").agg(
        F.countDistinct("h.pos").alias("matched"), F.countDistinct(F.when(is_open, F.col("h.pos"))).alias("open_matched"),
        (F.max(F.when(is_open, F.col("h.pos"))) - F.min(F.when(is_open, F.col("h.pos")))).alias("extent"),
        *[F.max(c).alias(c) for c in [*of_item, "in_row"]], F.min("altered").alias("altered"),
    )
    wide = F.col("extent") + F.col("item_size") >= F.least(F.lit(options.run), F.col("windows") + F.col("item_size") - 1)
    opened = F.when(wide, F.col("open_matched") / F.col("open_windows"))
    covered = found.withColumn("coverage", F.greatest(F.col("matched") / F.col("windows"), opened)).where((F.col("coverage") >= options.coverage) | F.col("in_row"))
    return covered.select(F.col("doc_id").alias(key), "item_id", "matched", "windows", "coverage", "altered")


def drop_leaks(docs: DataFrame, leaks: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` without those that hold a benchmark item; a null key is compared like any other."""
    bad = leaks.select(F.col(quoted(key)).alias("_leaked")).distinct()
    return docs.join(bad, named(docs, key).eqNullSafe(F.col("_leaked")), "left_anti")
