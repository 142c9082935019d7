"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

A text is made a template: digits, with separators between them, become a number slot; a unit after a number becomes a
unit slot; a run of capitalised words inside a sentence becomes a name slot; the rest is lower-cased and stripped of
punctuation. Windows of eight template words, four of them at least no slots, are hashed and joined with the windows
of the benchmark's items. Hits are counted for each document, item and place, which is a run of neighbouring offsets
between the two; a document that has at least half of an item's windows at one place is a candidate. Then the slots that
these windows cover are filled in again: each value in the item must stand for one value only in the document (a
re-parameterised question maps 12 to 30 wherever 12 stands).

An item of under eight words is one window of its own length. An item's first word is looked for as a literal and as
what it becomes inside a sentence; an item with windows of too few literals is also looked for by its plain words. The benchmark's windows are broadcast only up to
BROADCAST_WINDOWS of them, beyond that they are shuffled.

Cases: null and empty texts and items match nothing; a row that repeats is reported once; null ids are reported as
null; rows of one id with different texts are judged one by one; other columns are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import cut

WIDTH, LITERALS, SHARE = 8, 4, 0.5
BROADCAST_WINDOWS = 2_000_000
# Units that may follow a number.
UNITS = "mm cm m km mg g kg t ml cl l s sec min h hr hrs hour hours minute minutes second seconds day days week weeks month months year years inch inches foot feet ft yard yards mile miles pound pounds lb lbs oz ounce ounces gallon gallons dollar dollars cent cents euro euros percent degrees mph kmh watt watts volt volts".split()
NUMBER, UNIT, NAME, JOINT = "\ue000", "\ue001", "\ue002", "\ue003"
OWN, INSIDE, EXACT = range(3)
_INSIDE, _NAME = "(?<=[^.!?:\\s][ \\t])", "\\p{Lu}\\p{Ll}+"
_BLANKS = " \t\n\x0b\f\r"
_PUNCTUATION, _TYPOGRAPHIC = "[!-/:-@\\[-`{-~«»¿¡]+", "“”‘’…–—"


def _tokens(text: Column) -> Column:
    some = reduce(Column.__or__, (F.contains(text, F.lit(c)) for c in _TYPOGRAPHIC))
    plain = F.when(some, F.translate(text, _TYPOGRAPHIC, "")).otherwise(text)
    return F.split(F.btrim(F.regexp_replace(plain, _PUNCTUATION, ""), F.lit(_BLANKS)), f"[{_BLANKS}]+")


def template_tokens(text: Column) -> Column:
    """Template words of a text, a run of name words as one; raw_tokens gives the words that stand at the same places.

    Groups repeat possessively: nothing follows that they could give way to, and else each repetition takes more of the
    thread's stack, so that a long run of names or digits would end the executor.
    """
    text = F.regexp_replace(text, f"{_INSIDE}{_NAME}(?:[ \\t]{_NAME})*+", NAME)
    text = F.lower(F.regexp_replace(text, "[0-9]+(?:[.,][0-9]+)*+", NUMBER))
    units = F.regexp_replace(text, f"(?<={NUMBER}[ \\t]?)(?:{'|'.join(sorted(UNITS, key=len, reverse=True))})(?![\\p{{L}}\\p{{N}}])", UNIT)
    return _tokens(F.when(F.contains(text, F.lit(NUMBER)), units).otherwise(text))


def raw_tokens(text: Column) -> Column:
    return _tokens(F.lower(F.regexp_replace(text, f"({_INSIDE}{_NAME})[ \\t](?={_NAME})", f"$1{JOINT}")))


def _windows(df: DataFrame, keys: list[str], width: int) -> DataFrame:
    """keys, pos and hash of each window of `hashes`."""
    at = F.when(F.size("hashes") >= width, F.sequence(F.lit(0), F.size("hashes") - width))
    made = F.transform(at, lambda i: F.xxhash64(*(F.get(F.col("hashes"), i + k) for k in range(width))))
    # the outer form: an inner one would compute all windows once more to see whether there are any
    return df.select(*keys, F.posexplode_outer(made).alias("pos", "hash")).filter("hash is not null")


def _strong(hashes: Column, words: Column) -> Column:
    """Where the item's windows start that have enough literals; an item of under eight words is one window as it is.

    A slot's hash is odd, a literal's even. Equal windows have equal slots, so the documents' side needs no such test.
    """
    width = F.least(F.size(hashes), F.lit(WIDTH))
    least = F.when(words < WIDTH, 0).when(width < WIDTH, F.ceil(width * LITERALS / WIDTH)).otherwise(LITERALS)
    enough = lambda i: F.size(F.filter(F.slice(hashes, i + 1, width), lambda h: h.bitwiseAND(1) == 0)) >= least
    return F.filter(F.sequence(F.lit(0), F.size(hashes) - width), enough)


def _item_windows(forms: DataFrame, width: int) -> DataFrame:
    """form_key, item_pos and hash of the items' windows of this width."""
    rows = _windows(forms.filter(F.col("width") == width), ["form_key", "strong"], width).withColumnRenamed("pos", "item_pos")
    return rows.filter(F.array_contains("strong", F.col("item_pos"))).drop("strong")


def _hashes(tokens: Column) -> Column:
    def one(t: Column) -> Column:
        h = F.xxhash64(t)
        return F.when(_slot(t), h.bitwiseOR(1)).otherwise(h.bitwiseAND(-2))

    return F.when(F.get(tokens, 0) != "", F.transform(tokens, one)).otherwise(F.array().cast("array<bigint>"))


def _slot(t: Column) -> Column:
    return t.rlike(f"[{NUMBER}{UNIT}{NAME}]")


def _forms(items: DataFrame) -> DataFrame:
    """form_key, item_key, item_id, kind, tokens, their hashes, the item's own words, window width and starts of windows.

    An item has up to three forms: its template (OWN), the template it has inside a sentence, where its first word may
    be a name (INSIDE), and its plain words (EXACT) if one of the others has windows with too few literals.
    """
    inside, words = F.concat(F.lit("x "), F.btrim("item", F.lit(_BLANKS))), _tokens(F.lower("item"))
    rest = lambda t: F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0)))

    def form(df: DataFrame, kind: int, tokens: Column, own: Column) -> DataFrame:
        df = df.withColumns({"kind": F.lit(kind), "tokens": tokens, "item_tokens": own}).withColumn("form_key", F.xxhash64("item_key", "kind"))
        df = df.withColumn("hashes", _hashes(F.col("tokens"))).filter(F.size("hashes") > 0).withColumn("width", F.least(F.size("hashes"), F.lit(WIDTH)))
        return df.withColumn("strong", _strong(F.col("hashes"), F.size(words)))

    within = form(items, INSIDE, rest(template_tokens(inside)), rest(raw_tokens(inside))).filter(F.col("tokens") != template_tokens(F.col("item")))
    templates = cut(form(items, OWN, template_tokens(F.col("item")), raw_tokens(F.col("item"))).union(within), "templates")
    weak = templates.filter(F.size("strong") <= F.size("hashes") - F.col("width")).select("item_key").distinct()
    return cut(templates.union(form(items.join(weak, "item_key", "left_semi").select(*items.columns), EXACT, words, words)).drop("item"), "items")


def _candidates(found: DataFrame, sizes: DataFrame) -> DataFrame:
    """doc_key, form_key, windows, pick, picks: which windows of the form stand at which offsets, at least SHARE of them.

    Offsets no more than WIDTH from the next belong together, since a word put in or left out shifts what follows. A
    window found at several of them counts where most others are; an offset that has enough alone is judged alone, too.
    A text that repeats an item has a row for each time, so nothing grows with the square of that.
    """
    each = found.groupBy("doc_key", "form_key", "offset").agg(F.collect_set("item_pos").alias("at")).withColumn("n", F.size("at"))
    by_offset = Window.partitionBy("doc_key", "form_key").orderBy("offset")
    each = each.withColumn("gap", F.col("offset") - F.lag("offset").over(by_offset))
    each = each.withColumn("place", F.count(F.when(F.col("gap") > WIDTH, 1)).over(by_offset))
    best = each.select("doc_key", "form_key", "place", "n", "offset", F.explode("at").alias("pos")).groupBy("doc_key", "form_key", "place", "pos").agg(F.max(F.struct("n", "offset")).alias("m"))
    pick = lambda pos, offset: F.struct(pos.alias("pos"), offset.alias("offset"))
    mixed = best.groupBy("doc_key", "form_key", F.concat(F.lit("p"), F.col("place")).alias("pick")).agg(F.collect_list(pick(F.col("pos"), F.col("m.offset"))).alias("picks"))
    single = each.select("doc_key", "form_key", F.concat(F.lit("o"), F.col("offset")).alias("pick"), F.transform("at", lambda p: pick(p, F.col("offset"))).alias("picks"))
    return mixed.union(single).join(sizes, "form_key").filter(F.size("picks") >= F.col("windows") * SHARE)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, hits (windows found), windows (of the item), slots, changed (slots with other values), doc_key.

    doc_key is xxhash64(doc_id, text), which tells rows apart that share an id.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("text is not null")
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("item")).filter("item is not null").distinct()
    forms = _forms(items.withColumn("item_key", F.xxhash64("item_id", "item")))
    docs = docs.withColumn("doc_key", F.xxhash64("doc_id", "text"))

    found = None
    for exact, width in sorted(tuple(r) for r in forms.select(F.col("kind") == EXACT, "width").distinct().collect()):
        theirs = _item_windows(forms.filter((F.col("kind") == EXACT) == exact), width)
        hashed = docs.select("doc_key", (_tokens(F.lower("text")) if exact else template_tokens(F.col("text"))).alias("tokens")).select("doc_key", _hashes(F.col("tokens")).alias("hashes"))
        if theirs.count() <= BROADCAST_WINDOWS:
            theirs = F.broadcast(theirs)
        hits = _windows(hashed, ["doc_key"], width).join(theirs, "hash").select("doc_key", "form_key", "item_pos", (F.col("pos") - F.col("item_pos")).alias("offset"))
        found = hits if found is None else found.union(hits)
    if found is None:
        return docs.sparkSession.createDataFrame([], f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {dict(items.dtypes)['item_id']}, hits long, windows int, slots int, changed int, doc_key long")
    likely = cut(_candidates(found, forms.select("form_key", F.size("strong").alias("windows"))), "likely")

    named = docs.join(likely.select("doc_key").distinct(), "doc_key", "left_semi").dropDuplicates(["doc_key"])
    theirs = named.select("doc_key", F.posexplode(raw_tokens(F.col("text"))).alias("j", "theirs"))
    item_words = forms.select("form_key", "kind", F.posexplode(F.arrays_zip(F.col("tokens").alias("token"), F.col("item_tokens").alias("mine"))).alias("i", "w"))
    item_words = item_words.select("form_key", "kind", "i", "w.mine", _slot(F.col("w.token")).alias("slot")).filter((F.col("slot")) | ((F.col("kind") == INSIDE) & (F.col("i") == 0)))
    # only what matched windows cover is filled in, slot by slot
    covered = likely.select("doc_key", "form_key", "pick", F.explode("picks").alias("c")).join(forms.select("form_key", "width"), "form_key")
    covered = covered.select("doc_key", "form_key", "pick", "c", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("k")).select("doc_key", "form_key", "pick", (F.col("c.pos") + F.col("k")).alias("i"), (F.col("c.pos") + F.col("c.offset") + F.col("k")).alias("j")).distinct()
    filled = covered.join(item_words, ["form_key", "i"]).join(theirs, ["doc_key", "j"], "left")
    # inside a sentence the item's first word is a slot, but must be that very word
    first = F.array_contains(F.split("theirs", JOINT), F.split("mine", JOINT)[0])
    pair = F.struct("mine", "theirs")
    judged = filled.groupBy("doc_key", "form_key", "pick").agg(
        F.count_distinct(F.when(F.col("slot"), F.col("mine"))).alias("slots"), F.count_distinct(F.when(F.col("slot"), pair)).alias("values"),
        F.count_distinct(F.when(F.col("slot") & ~F.col("mine").eqNullSafe(F.col("theirs")), pair)).alias("changed"),
        F.bool_or((F.col("kind") == INSIDE) & (F.col("i") == 0) & ~F.coalesce(first, F.lit(False))).alias("other"),
    )
    pairs = likely.select("doc_key", "form_key", "pick", "windows", F.size("picks").cast("long").alias("hits")).join(judged, ["doc_key", "form_key", "pick"], "left")
    pairs = pairs.filter("slots is null or (slots = values and not other)").join(forms.select("form_key", "item_key", "item_id"), "form_key").join(named.select("doc_key", "doc_id"), "doc_key")
    none = lambda c: F.coalesce(c, F.lit(0)).cast("int").alias(c)
    best = pairs.groupBy("doc_key", "item_key").agg(F.max(F.struct("hits", "windows", none("slots"), none("changed"), "doc_id", "item_id")).alias("b"))
    return best.select("b.doc_id", "b.item_id", "b.hits", "b.windows", "b.slots", "b.changed", "doc_key").distinct()
