"""Benchmark decontamination on templates: numbers, names and units become typed placeholders.

Documents and benchmark items are cut into windows of ``WIDTH`` template words. Windows are joined by hash, and the
slots of joined windows are checked: along one alignment of document and item, a value of the item must always stand
for the same value of the document. A question asked with other numbers or names is caught, a chance pattern is not.

A document's windows are first held against a bitmap of the item windows (``2^BITS`` bits, whatever the benchmark's
size; a hit too many costs a row, none is lost), so only what may match is shuffled.

Every window also matches as it is written, in any case of letters and with no check of slots. A capitalised word that
starts a sentence may be a name or not: windows with one are looked up both ways, and the check of slots decides; the
words of ``OPENERS`` are no names there. Windows of which less than half is literal count along an alignment that has
another window too, but make none by themselves. Items shorter than a window are one window;
items of fewer than ``FEWEST`` words are found where a whole line or text consists of them. A document leaks an item if
``RUN`` windows of one alignment (a run of 13 words) or all of a shorter item's, or half of all the item's windows, are found.

A window that items of more than ``COMMON`` different templates hold (the prompt of a whole benchmark) says nothing of one
item: it counts along an alignment that another window has made, and the rule above must also hold for the item's other
windows alone. An item that has none but such windows must be found whole, starting from its rarest one. So a shared
prompt joins no documents with items. Items of the same text are searched once.

Edge cases: null texts have no windows; rows without a document or item id are left out of the result; rows that repeat
an id are the same document or item; an empty table on either side gives no rows.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.llm.common import TokenTable, flags, hash64, rolled, slices
from partloom.session import written

WIDTH, FEWEST, RUN, COMMON = 8, 5, 6, 16
BITS = 23
# Unit words that may follow a number.
UNITS = frozenset(
    "% mm cm m km in ft yd mi mg g kg t lb oz ml cl l gal s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week"
    " weeks month months year years meter meters metre metres kilometer kilometers kilometre kilometres mile miles foot feet inch inches"
    " gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres degree degrees celsius fahrenheit kelvin dollar"
    " dollars euro euros cent cents usd eur gbp volt volts watt watts kw kwh mph kmh percent".split()
)
# Words that start sentences and are no names. Words that are names as well (will, may, mark) are not among them.
OPENERS = frozenset(
    "a an the this that these those there here it its he she they we you i his her their our your my who whom whose what which when where why how"
    " if in on at by for from of to with without into after before during between among under over about against through as than then so and or but"
    " not no yes is are was were be been do does did has have had can could would should shall must might each every all both some any many much"
    " few several most more another other one two three four five six seven eight nine ten while because since until although though once given"
    " let suppose assume find calculate compute determine explain describe write name list".split()
)
NUMBER = re.compile(r"[+-]?[$€£]?[0-9][0-9.,:/]*")
QUANTITY = re.compile(r"[+-]?[$€£]?[0-9][0-9.,]*(?P<unit>[^\W\d_]+|%)")
_STRIP = string.punctuation.replace("%", "").replace("$", "").replace("+", "") + "“”‘’«»…–—"

# What joins two windows: their words, a template of them, one with names where sentences start, one with few literal words.
WRITTEN, OPEN, NAMED, DENSE, NEVER = 0, 1, 2, 3, 9
CAPITAL, STOPS, IS_NUMBER, IS_UNIT, IS_QUANTITY, EMPTY, OPENS = 1, 2, 4, 8, 16, 32, 64
FACTS = np.dtype([("word", "u8"), ("flags", "u1")])
HOLDER = {name: np.uint64(hash64(name.encode())) for name in ("<number>", "<name>", "<unit>", "<quantity>")}


_UNITS, _OPENERS = (frozenset(w.encode() for w in words) for words in (UNITS, OPENERS))


def facts(token: bytes) -> tuple[int, int]:
    """Hash of the bare word and what can be said of it without its neighbours."""
    core = token.rstrip(b".,;:!?")
    if not core.isalpha():  # for bytes: letters a to z
        return _facts(token)
    word = core.lower()
    flags = STOPS if token.endswith((b".", b"!", b"?", b":")) else 0
    if core[:1].isupper() and not core[1:].isupper():
        flags |= CAPITAL
    if word in _UNITS:
        flags |= IS_UNIT
    if word in _OPENERS:
        flags |= OPENS
    return hash64(word), flags


def _facts(token: bytes) -> tuple[int, int]:
    """``facts`` of any token; plain words take the shorter way above."""
    text = token.decode("utf-8", "replace")
    bare = text.strip(_STRIP)
    word = bare.casefold()
    flags = STOPS if text.rstrip("\"')]”’»").endswith((".", "!", "?", ":", "…")) else 0
    if not any(c.isalnum() for c in bare) and bare != "%":
        return 0, flags | EMPTY
    if NUMBER.fullmatch(bare):
        flags |= IS_NUMBER
    elif (m := QUANTITY.fullmatch(word)) and m["unit"] in UNITS:
        flags |= IS_QUANTITY
    elif bare[0].isupper() and not bare[1:].isupper():
        flags |= CAPITAL
    if word in UNITS:
        flags |= IS_UNIT
    if word in OPENERS:
        flags |= OPENS
    return hash64(word.encode("utf-8", "surrogatepass")), flags


class Templates:
    """Template windows of many texts at once."""

    def __init__(self):
        self.tokens = TokenTable(facts)

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Text and line number, place in the text, bare word and template words (equal unless a slot) of every word.

        There are two templates: without and with names where sentences start.
        """
        self.tokens.trim()
        lines = [(k, line.split()) for k, t in enumerate(texts) for line in t.splitlines()]
        sizes = np.array([len(each) for _, each in lines], np.int64)
        codes = self.tokens.codes([w for _, each in lines for w in each])
        seen = self.tokens.table(FACTS)[codes]
        owner = np.repeat(np.array([k for k, _ in lines], np.int64), sizes)
        line = np.repeat(np.arange(len(lines)), sizes)
        flags = seen["flags"]
        starts = (np.diff(line, prepend=-1) > 0) | np.append(False, (flags[:-1] & STOPS) > 0)[: len(line)]
        real = (flags & EMPTY) == 0
        # A start passes over tokens without a word (bullets, dashes) to the next word.
        after_stop = np.diff(np.cumsum(starts)[real], prepend=0) > 0
        owner, line, flags, word = owner[real], line[real], flags[real], seen["word"][real]
        number = (flags & IS_NUMBER) > 0
        follows = np.append(False, number[:-1] & (owner[1:] == owner[:-1])) if len(owner) else number
        shapes = []
        for closed in (after_stop, after_stop & ((flags & OPENS) > 0)):
            shape = word.copy()
            shape[((flags & CAPITAL) > 0) & ~closed] = HOLDER["<name>"]
            shape[((flags & IS_UNIT) > 0) & follows] = HOLDER["<unit>"]
            shape[(flags & IS_QUANTITY) > 0] = HOLDER["<quantity>"]
            shape[number] = HOLDER["<number>"]
            shapes.append(shape)
        start = np.searchsorted(owner, np.arange(len(texts)))
        return owner, line, np.arange(len(owner)) - start[owner] if len(owner) else owner, word, shapes

    @staticmethod
    def whole(parts: np.ndarray, word: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of the parts (lines or texts, numbered in ``parts``) of exactly ``width`` words."""
        starts = np.flatnonzero(np.diff(parts, prepend=-1))
        at = starts[np.diff(np.append(starts, len(parts))) == width]
        return at, rolled(word, width)[at]

    @staticmethod
    def windows(owner: np.ndarray, word: np.ndarray, shapes: list[np.ndarray], width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Level, words or template words, start (index of a word) and hash of the windows inside one text.

        ``WRITTEN`` has every window; ``OPEN`` those with slots of which at least half of the words are literal, ``NAMED``
        the same with names where sentences start, ``DENSE`` those with fewer literal words.
        """
        n = len(owner) - width + 1
        if n <= 0:
            return
        at = np.flatnonzero(owner[:n] == owner[width - 1 :])
        yield WRITTEN, word, at, rolled(word, width)[at]
        for level, shape, other in ((OPEN, shapes[0], word), (NAMED, shapes[1], shapes[0])):
            template = rolled(shape, width)
            literal, new = (np.append(0, np.cumsum(x)) for x in (word == shape, shape != other))
            literal, new = (literal[width:] - literal[:-width])[at], (new[width:] - new[:-width])[at] > 0
            for part, own in ((level, literal * 2 >= width), (DENSE, literal * 2 < width)):
                chosen = at[new & own]
                yield part, shape, chosen, template[chosen]


def _slots(word, shape, at, width) -> list[list[int]]:
    signed = word.view(np.int64)
    return [signed[a : a + width][word[a : a + width] != shape[a : a + width]].tolist() for a in at]


WINDOWS = pa.schema([("id", pa.int64()), ("at", pa.int64()), ("window", pa.int64()), ("slots", pa.list_(pa.int64())), ("level", pa.int32())])
OF_ITEMS = [("width", pa.int64()), ("n_windows", pa.int64()), ("template", pa.int64())]


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of the items, with the words of a window, the windows of the item and the hash of its whole template."""
    reader = Templates()
    schema = pa.schema([*WINDOWS, *(pa.field(*each) for each in OF_ITEMS)])
    for batch in batches:
        for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            owner, _, place, word, shapes = reader.read([text])
            if not len(owner):
                continue
            width = min(WIDTH, len(owner))
            n_windows = len(owner) - width + 1
            template = xxhash.xxh64_intdigest(shapes[1].tobytes()) - (1 << 63)
            searched = reader.windows(owner, word, shapes, width)
            for level, shape, at, window in searched if width >= FEWEST else [(WRITTEN, word, *reader.whole(owner, word, width))]:
                n = len(at)
                slots = _slots(word, shape, at, width)
                columns = [[ident] * n, place[at], window.view(np.int64), slots, [level] * n, [width] * n, [n_windows] * n, [template] * n]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _first(window: np.ndarray) -> np.ndarray:
    return window & np.uint64((1 << BITS) - 1)


def _second(window: np.ndarray) -> np.ndarray:
    return (window >> np.uint64(BITS)) & np.uint64((1 << BITS) - 1)


def bitmap(windows: DataFrame) -> np.ndarray:
    """``2^BITS`` flags; two of them are set per item window. At most a megabyte comes to the driver."""
    full = (1 << BITS) - 1
    low, next_ = F.col("window").bitwiseAND(full), F.shiftright("window", BITS).bitwiseAND(full)
    return flags(windows.select(F.explode(F.array(low, next_))), BITS)


def _document_windows(shared, widths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, known = Templates(), shared.value
        for batch in batches:
            for part in slices(batch, 128):
                idents = part.column(0)
                owner, line, place, word, shapes = reader.read([t or b"" for t in part.column(1).to_pylist()])
                for width in widths:
                    if width >= FEWEST:
                        searched = reader.windows(owner, word, shapes, width)
                    else:
                        searched = ((WRITTEN, word, *reader.whole(parts, word, width)) for parts in (line, owner))
                    for level, template, at, window in searched:
                        hit = known[_first(window)]
                        at, window = at[hit], window[hit]
                        hit = known[_second(window)]
                        at, window = at[hit], window[hit]
                        columns = [idents.take(pa.array(owner[at])), place[at], window.view(np.int64), _slots(word, template, at, width), [level] * len(at)]
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, WINDOWS, strict=True)], schema=WINDOWS)

    return run


ALIGNMENT = ["doc_id", "item_id", "shift"]


def _paired(met: DataFrame) -> DataFrame:
    """Windows of documents and items that met, by alignment."""
    level = F.greatest("level", "item_level").alias("level")
    met = met.where(F.size("slots") == F.size("item_slots"))
    return met.select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift"), "n_windows", "n_own", "own", "item_at", level, "item_slots", "slots")


def _steady(paired: DataFrame) -> DataFrame:
    """Windows found, those of them that are not common, and values changed per alignment, up to the level at which a value stands for two.

    What is found as written has no slots, so a contradiction among templates takes only the templates away.
    """
    pair = F.explode(F.arrays_zip("item_slots", "slots"))
    slots = paired.select(*ALIGNMENT, "level", pair.alias("slot")).select(*ALIGNMENT, "level", F.col("slot.item_slots").alias("asked"), F.col("slot.slots").alias("given"))
    values = slots.groupBy(*ALIGNMENT, "asked", "given").agg(F.min("level").alias("level"))
    # A value of the item that meets a second value of the document contradicts itself from the second one's level on.
    asked = values.groupBy(*ALIGNMENT, "asked").agg(
        F.get(F.sort_array(F.collect_list("level")), F.lit(1)).alias("until"), F.collect_list(F.when(F.col("asked") != F.col("given"), F.col("level"))).alias("changed")
    )
    limits = asked.groupBy(*ALIGNMENT).agg(F.coalesce(F.min("until"), F.lit(NEVER)).alias("until"), F.flatten(F.collect_list("changed")).alias("changed"))
    windows = paired.groupBy(*ALIGNMENT, "item_at").agg(
        F.min("level").alias("level"), F.min(F.when(F.col("own"), F.col("level"))).alias("own_level"), *[F.max(n).alias(n) for n in ("n_windows", "n_own")]
    )
    within = windows.join(limits, ALIGNMENT, "left").withColumn("until", F.coalesce("until", F.lit(NEVER))).where("level < until")
    changed = F.size(F.filter(F.coalesce("changed", F.array().cast("array<int>")), lambda level: level < F.col("until")))
    return within.groupBy(*ALIGNMENT).agg(
        *[F.max(n).alias(n) for n in ("n_windows", "n_own")],
        F.count("*").alias("found"),
        F.count_if(F.col("own_level") < F.col("until")).alias("own"),
        F.max(changed).cast("bigint").alias("changed"),
    )


def _weighed(items: DataFrame, common: int) -> DataFrame:
    """Windows of the items with ``own`` (not common), ``n_own`` (own windows of the item) and ``makes`` (makes alignments)."""
    asked = items.select(
        F.col("id").alias("item_id"), F.col("at").alias("item_at"), F.col("slots").alias("item_slots"), "window", "n_windows", F.col("level").alias("item_level"), "template"
    ).distinct()
    held = asked.groupBy("window").agg(F.count_distinct("template").alias("held"))
    asked = asked.join(held, "window").withColumn("own", F.col("held") <= common)
    per_item = asked.groupBy("item_id").agg(
        F.count_distinct(F.when(F.col("own"), F.col("item_at"))).alias("n_own"),
        F.min(F.when(F.col("item_level") < DENSE, F.struct("held", "item_at", "window"))).alias("rarest"),
    )
    open_ = F.col("item_level") < DENSE
    rarest = (F.col("n_own") == 0) & (F.struct("held", "item_at", "window") == F.col("rarest"))
    return asked.join(per_item, "item_id").withColumn("makes", open_ & (F.col("own") | rarest)).drop("rarest", "held", "template")


def leaks(docs: DataFrame, benchmark: DataFrame, common: int = COMMON) -> DataFrame:
    """One row per document (doc_id, text) and benchmark item (item_id, text) that it leaks.

    Columns: doc_id, item_id, ``n_found`` windows of ``n_windows``, ``run`` (most windows of one alignment),
    ``n_changed``, the slots whose value differs from the item's, and ``short``, true for items of fewer than ``FEWEST`` words.
    """
    texts = lambda rows, key: rows.where(F.col(key).isNotNull() & F.col("text").isNotNull()).select(key, F.col("text").cast("binary"))
    schema = "id bigint, at bigint, window bigint, slots array<bigint>, level int"
    known = written(texts(benchmark, "item_id").distinct().withColumn("first", F.sha2("text", 256)), "items")
    # Items of the same text are searched as the first of them.
    firsts = known.groupBy("first").agg(F.min("item_id").alias("item_id"), F.min("text").alias("text"))
    members = known.select("item_id", "first").join(firsts.select("first", F.col("item_id").alias("searched")), "first").select("searched", "item_id")
    of_items = f"{schema}, width bigint, n_windows bigint, template bigint"
    items = written(firsts.select("item_id", "text").mapInArrow(_item_windows, of_items), "item-windows")
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())  # WIDTH values at most
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(items))
    found = written(texts(docs, "doc_id").mapInArrow(_document_windows(shared, widths), schema), "document-windows")
    found = found.withColumnRenamed("id", "doc_id").distinct()

    asked = written(_weighed(items, common), "weighed-windows")
    open_ = found.where(F.col("level") < DENSE).join(asked.where("makes"), "window")
    paired = written(_paired(open_), "window-pairs")
    # Dense and common windows are looked up where an alignment expects them, never by their template alone.
    expected = paired.select(*ALIGNMENT).distinct().join(asked.where("NOT makes"), "item_id")
    expected = expected.withColumn("at", F.col("shift") + F.col("item_at")).drop("shift")
    rest = found.join(expected, ["doc_id", "at", "window"]).where((F.col("level") == DENSE) == (F.col("item_level") == DENSE))
    paired = written(paired.unionByName(_paired(rest)), "aligned-windows")
    steady = _steady(paired)
    each = steady.groupBy("doc_id", "item_id").agg(
        *[F.max(n).alias(n) for n in ("n_windows", "n_own", "changed")],
        F.max("found").alias("run"),
        F.least(F.sum("found"), F.max("n_windows")).alias("n_found"),
        F.max("own").alias("own_run"),
        F.least(F.sum("own"), F.max("n_own")).alias("own_found"),
    )

    def enough(run: str, n_found: str, of: str) -> Column:
        return (F.col(run) >= F.least(F.lit(RUN), of)) | (2 * F.col(n_found) >= F.col(of))

    own = F.when(F.col("n_own") == 0, F.col("run") >= F.col("n_windows")).otherwise(enough("own_run", "own_found", "n_own"))
    leaked = each.where(enough("run", "n_found", "n_windows") & own).withColumnRenamed("item_id", "searched").withColumnRenamed("changed", "n_changed")
    short = items.groupBy("id").agg((F.max("width") < FEWEST).alias("short")).withColumnRenamed("id", "searched")
    measures = ["n_found", "n_windows", "run", "n_changed", "short"]
    return leaked.join(short, "searched").join(members, "searched").groupBy("doc_id", "item_id").agg(*[F.max(m).alias(m) for m in measures])


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` less the documents that leak an item; columns as they come.

    A line that is an item of fewer than ``FEWEST`` words ("Yes", "See also") is reported by ``leaks`` and rejects nothing.
    """
    gone = leaks(docs, benchmark).where("NOT short").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
