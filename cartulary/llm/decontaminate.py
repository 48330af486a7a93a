"""Benchmark decontamination by templates, in DataFrame functions only.

Numbers, names and units become typed placeholders, so a question that was given
other values keeps its template.  Texts have two forms: in one only numbers and
units are placeholders and words are lower-cased, so copies in other capitals are
found; in the other all runs of capitalised words are names as well, also where a
sentence begins.  Windows of template tokens are hashed and joined with those of
the benchmark, form by form; a match counts only if the values in its slots are
consistent: within one alignment each value of the item stands for one value of the
document.  Each alignment is judged by itself: one that is inconsistent takes
nothing from what the others cover.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.llm.workspace import Workspace

WINDOW = 8
#: An item is leaked if this share of its windows, or this many windows, are found in a document.
SHARE = 0.5
RUN = 13
#: Items of fewer tokens do not identify a passage: they are leaked where a whole line has exactly their tokens and values.
LEAST_TOKENS = 5
#: Words, other than placeholders, that a window must have if any value in its slots differs: runs of numbers alone match any table.
LEAST_WORDS = 3
#: Benchmark windows (a hash, two positions, and the values in a window's slots) that are broadcast at most; beyond, they are joined by a shuffle.
BROADCAST_WINDOWS = 500_000
#: Document ids that are broadcast at most.
BROADCAST_DOCS = 1_000_000

# Units that may follow a number.
UNITS = "km|cm|mm|m|kg|mg|g|lb|lbs|oz|ml|l|mph|kph|miles|mile|feet|foot|inches|inch|meters|meter|metres|metre|hours|hour|minutes|minute|seconds|second|days|day|weeks|week|months|month|years|year|dollars|dollar|cents|cent|euros|euro|percent|degrees|degree"

#: The last quantifiers give nothing back, so long runs need no stack.
NUMBER = r"\d+(?:[.,]\d+)*+"
NAME = r"\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)*+"
_NUM, _NAME, _UNIT = "\ue001", "\ue002", "\ue003"
WORDS_FORM, NAMES_FORM = 0, 1
FORMS = (WORDS_FORM, NAMES_FORM)


def _plain(text: Column) -> Column:
    return F.translate(text, _NUM + _NAME + _UNIT, "   ")


def template_tokens(text: Column, form: int) -> Column:
    """The template of a text as an array of tokens; null stays null."""
    text = _plain(text)
    if form == NAMES_FORM:
        text = F.regexp_replace(text, NAME, f" {_NAME} ")
    text = F.regexp_replace(F.lower(text), NUMBER, f" {_NUM} ")
    text = F.regexp_replace(text, rf"({_NUM} +)(?:{UNITS})([^\p{{L}}]|$)", f"$1{_UNIT}$2")
    return F.array_remove(F.split(text, rf"[^\p{{L}}\p{{N}}{_NUM}-{_UNIT}]+"), "")


def slot_values(text: Column, form: int) -> Column:
    """The numbers, and in that form the names, of a text in order: one for each placeholder of theirs."""
    return F.regexp_extract_all(_plain(text), F.lit(f"({NUMBER}|{NAME})" if form == NAMES_FORM else f"({NUMBER})"), F.lit(1))


def hashed_windows(df: DataFrame, length: int) -> DataFrame:
    """df with, for its column tokens, the hashes of all windows of this length in order: windows of twice the length are made of two.

    They are to be exploded with the outer form: for the inner one the optimiser
    adds a test of their number below all projections, where they are made again.
    """
    df = df.withColumn("hashes", F.transform("tokens", lambda t: F.xxhash64(t)))
    width = 1
    while width < length:
        step = min(width, length - width)
        n = F.greatest(F.size("hashes") - step, F.lit(0))
        df = df.withColumn("hashes", F.zip_with(F.slice("hashes", 1, n), F.slice("hashes", step + 1, n), lambda x, y: F.xxhash64(x, y)))
        width += step
    return df


def _slots(tokens: Column) -> Column:
    return F.size(F.filter(tokens, lambda t: (t == _NUM) | (t == _NAME)))


def _places(tokens: Column) -> Column:
    """Where the slots are among the tokens, from 0."""
    return F.filter(F.transform(tokens, lambda t, i: F.when((t == _NUM) | (t == _NAME), i)), lambda i: i.isNotNull())


def benchmark_windows(benchmark: DataFrame, window: int, form: int) -> DataFrame:
    """A row per window of each item: item_id, b_pos, length, hash, n_windows, few (too few words to match other values), and of its slots the places and the values."""
    items = benchmark.where("item_id is not null").select("item_id", template_tokens(F.col("text"), form).alias("tokens"), slot_values(F.col("text"), form).alias("values")).where(F.size("tokens") >= LEAST_TOKENS)
    sizes = range(min(LEAST_TOKENS, window), window + 1)
    by_length = [hashed_windows(items.where(F.least(F.size("tokens"), F.lit(window)) == n), n).withColumn("length", F.lit(n)) for n in sizes]
    each = reduce(DataFrame.union, by_length).select("*", F.size("hashes").alias("n_windows"), F.posexplode_outer("hashes").alias("b_pos", "hash")).where("hash is not null")
    own = F.slice("tokens", F.col("b_pos") + 1, F.col("length"))
    before = _slots(F.slice("tokens", F.lit(1), F.col("b_pos")))
    words = F.size(F.filter(own, lambda t: ~t.isin(_NUM, _NAME, _UNIT)))
    return each.select(F.lit(form).alias("form"), "item_id", "b_pos", "length", "hash", "n_windows", (words < LEAST_WORDS).alias("few"), _places(own).alias("b_places"), F.slice("values", before + 1, _slots(own)).alias("b_values"))


def _few(df: DataFrame, bound: int) -> DataFrame:
    """df, which is a written table, as the small side of a join: broadcast if it has no more rows than the bound."""
    return F.broadcast(df) if df.count() <= bound else df


def leaks(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, share: float = SHARE, run: int = RUN) -> DataFrame:
    """A row per leaked (doc_id, item_id): matched, n_windows, share, slots.

    Of the two forms the one that covers more counts, the first on a tie: matched
    windows of the item are those that alignments without a conflict cover, slots
    the pairs of values of these alignments.  A window of fewer than LEAST_WORDS
    words counts only with equal values.

    An item shorter than the window is one window; one of fewer than LEAST_TOKENS
    tokens is leaked by a line of exactly its tokens and numbers, one without a
    token by nothing.  Null and empty texts match nothing; rows without a doc_id or
    item_id are ignored; repeated rows count once; empty tables give no rows; other
    columns are ignored.  Texts of any length are compared whole.
    """
    work = Workspace(docs.sparkSession, "decontaminate")
    known = work.table("windows", reduce(DataFrame.union, [benchmark_windows(benchmark, window, f) for f in FORMS]))
    small = known.count() <= BROADCAST_WINDOWS
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    # A pass for each form and window length that the benchmark has: one length, or a few where items are shorter than the window.
    hits = []
    for form, length in sorted(map(tuple, known.select("form", "length").distinct().collect())):
        own = known.where((F.col("form") == form) & (F.col("length") == length))
        keys = own.select("hash").distinct()
        tokens = texts.select("doc_id", template_tokens(F.col("text"), form).alias("tokens"))
        each = hashed_windows(tokens, length).select("doc_id", F.posexplode_outer("hashes").alias("pos", "hash"))
        met = each.join(F.broadcast(keys) if small else keys, "hash")
        hits.append(met.join(F.broadcast(own) if small else own, "hash").select("form", "doc_id", "item_id", "pos", "b_pos", "n_windows", "few", "b_places", "b_values"))
    if not hits:
        hits = [known.select("form", F.lit(None).cast("long").alias("doc_id"), "item_id", F.col("b_pos").alias("pos"), "b_pos", "n_windows", "few", "b_places", "b_values")]
    found = work.table("found", reduce(DataFrame.union, hits))
    whole = ["form", "doc_id", "item_id"]

    def covered(matches: DataFrame) -> DataFrame:
        # A window may stand in a document many times: it is one match.
        counts = matches.groupBy(*whole, "n_windows").agg(F.countDistinct("b_pos").alias("matched"))
        return counts.where((F.col("matched") >= share * F.col("n_windows")) | (F.col("matched") >= run))

    # What all alignments cover is a bound of what consistent ones do: other pairs need no values.
    bound = work.table("bound", covered(found).select(*whole))
    found = found.join(_few(bound, BROADCAST_DOCS), whole, "left_semi").withColumn("shift", F.col("pos") - F.col("b_pos"))
    pairs = work.table("pairs", _slot_pairs(work, texts, found.where(F.size("b_values") > 0)))
    unequal = pairs.where("differ").select(*whole, "pos", "shift").distinct()
    by_value = pairs.groupBy(*whole, "shift", "b").agg(F.countDistinct("d").alias("values"))
    shifts = by_value.groupBy(*whole, "shift").agg(F.count("*").alias("slots"), F.max("values").alias("most"))
    kept = found.join(shifts.where("most > 1"), [*whole, "shift"], "left_anti")
    kept = kept.where("not few").unionByName(kept.where("few").join(unequal, [*whole, "pos", "shift"], "left_anti"))
    slots = shifts.where("most = 1").groupBy(*whole).agg(F.sum("slots").alias("slots"))
    judged = covered(kept).join(slots, whole, "left").select("doc_id", "item_id", F.col("matched"), F.col("n_windows").cast("long").alias("n_windows"), F.coalesce("slots", F.lit(0)).alias("slots"), (-F.col("form")).alias("first"))
    best = judged.groupBy("doc_id", "item_id").agg(F.max(F.struct("matched", "first", "n_windows", "slots")).alias("m")).select("doc_id", "item_id", "m.matched", "m.n_windows", "m.slots")
    return best.union(_short(work, texts, benchmark)).select("doc_id", "item_id", "matched", "n_windows", F.round(F.col("matched") / F.col("n_windows"), 6).alias("share"), "slots")


def _slot_pairs(work: Workspace, texts: DataFrame, filled: DataFrame) -> DataFrame:
    """A row for each slot of each match: form, doc_id, item_id, pos, shift, the values b and d of item and document, and whether they differ."""
    # Only documents whose matches have slots are read again.
    slotted = work.table("slotted", filled.select("doc_id").distinct())
    own = texts.join(_few(slotted, BROADCAST_DOCS), "doc_id", "left_semi")
    forms = [own.select(F.lit(f).alias("form"), "doc_id", template_tokens(F.col("text"), f).alias("tokens"), slot_values(F.col("text"), f).alias("d_values")) for f in FORMS]
    slots = reduce(DataFrame.union, forms).select("form", "doc_id", _places(F.col("tokens")).alias("places"), "d_values")
    slots = slots.select("form", "doc_id", F.explode_outer(F.arrays_zip(F.col("places").alias("place"), F.col("d_values").alias("d"))).alias("slot")).select("form", "doc_id", "slot.place", "slot.d")
    # A row for each slot of a match finds its value by its place in the text: no text is carried along.
    asked = filled.select("form", "doc_id", "item_id", "pos", "shift", F.explode(F.arrays_zip(F.col("b_places").alias("place"), F.col("b_values").alias("b"))).alias("slot"))
    asked = asked.select("form", "doc_id", "item_id", "pos", "shift", (F.col("pos") + F.col("slot.place")).alias("place"), "slot.b")
    d = F.coalesce("d", F.lit(""))
    return asked.join(slots, ["form", "doc_id", "place"], "left").select("form", "doc_id", "item_id", "pos", "shift", "b", d.alias("d"), (F.col("b") != d).alias("differ"))


def _short(work: Workspace, texts: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Leaks of items of too few tokens: lines that have exactly their tokens and numbers."""

    def identity(text: Column) -> Column:
        return F.xxhash64(template_tokens(text, WORDS_FORM), slot_values(text, WORDS_FORM))

    size = F.size(template_tokens(F.col("text"), WORDS_FORM))
    items = work.table("short", benchmark.where("item_id is not null").where((size > 0) & (size < LEAST_TOKENS)).select("item_id", identity(F.col("text")).alias("hash"), F.size(slot_values(F.col("text"), WORDS_FORM)).cast("long").alias("slots")).distinct())
    if not items.limit(1).count():
        lines = texts.select("doc_id", F.lit(0).cast("long").alias("hash")).limit(0)
    else:
        lines = texts.select("doc_id", F.explode(F.split("text", "[\r\n]+")).alias("line")).select("doc_id", identity(F.col("line")).alias("hash"))
    met = lines.join(_few(items, BROADCAST_WINDOWS), "hash").select("doc_id", "item_id", "slots").distinct()
    return met.select("doc_id", "item_id", F.lit(1).cast("long").alias("matched"), F.lit(1).cast("long").alias("n_windows"), "slots")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that leak no item, with all their columns, also those without a text or a doc_id.

    Repeated rows stay or go together; an empty benchmark lets all stay; columns
    named like those of the operator are kept as they are.  See leaks().
    """
    work = Workspace(docs.sparkSession, "decontaminate")
    leaked = work.table("leaked", leaks(docs, benchmark, **options).select("doc_id").distinct())
    return docs.join(_few(leaked, BROADCAST_DOCS), "doc_id", "left_anti").select(docs.columns)


def sql(window: int = WINDOW, share: float = SHARE, run: int = RUN) -> str:
    """DuckDB SQL of leaks(), from the definition."""
    number, name = NUMBER.replace("*+", "*"), NAME.replace("*+", "*")
    plain = f"translate(text, '{_NUM}{_NAME}{_UNIT}', '   ')"

    def tokens(form: int) -> str:
        t = f"regexp_replace({plain}, '{name}', ' {_NAME} ', 'g')" if form == NAMES_FORM else plain
        t = f"regexp_replace(lower({t}), '{number}', ' {_NUM} ', 'g')"
        t = rf"regexp_replace({t}, '({_NUM} +)(?:{UNITS})([^\p{{L}}]|$)', '\1{_UNIT}\2', 'g')"
        return rf"list_filter(regexp_split_to_array({t}, '[^\p{{L}}\p{{N}}{_NUM}-{_UNIT}]+'), lambda x: x <> '')"

    def vals(form: int) -> str:
        return f"regexp_extract_all({plain}, '{number}|{name}')" if form == NAMES_FORM else f"regexp_extract_all({plain}, '{number}')"

    def both(key: str, table: str) -> str:
        return " union all ".join(f"select {f} as form, {key}, {tokens(f)} as tokens, {vals(f)} as vals from {table} where {key} is not null and text is not null" for f in FORMS)

    count = f"len(list_filter({{0}}, lambda x: x = '{_NUM}' or x = '{_NAME}'))"
    words = f"len(list_filter(list_slice(tokens, b_pos + 1, b_pos + length), lambda x: x <> '{_NUM}' and x <> '{_NAME}' and x <> '{_UNIT}'))"
    return f"""
with items as ({both('item_id', 'benchmark')}),
sized as (select *, least({window}, len(tokens)) as length, len(tokens) - least({window}, len(tokens)) + 1 as n_windows from items where len(tokens) >= {LEAST_TOKENS}),
b as (select form, item_id, length, n_windows, vals, tokens, unnest(range(n_windows)) as b_pos from sized),
bw as (select form, item_id, b_pos, length, n_windows, {words} < {LEAST_WORDS} as few, array_to_string(list_slice(tokens, b_pos + 1, b_pos + length), ' ') as w,
  list_slice(vals, {count.format("list_slice(tokens, 1, b_pos)")} + 1, {count.format("list_slice(tokens, 1, b_pos + length)")}) as b_values from b),
t as (select distinct * from ({both('doc_id', 'documents')})),
d as (select t.form, doc_id, tokens, vals, length, unnest(range(len(tokens) - length + 1)) as pos from t join (select distinct form, length from sized) l on t.form = l.form and len(tokens) >= length),
dw as (select form, doc_id, pos, length, array_to_string(list_slice(tokens, pos + 1, pos + length), ' ') as w from d),
hits as (select form, doc_id, item_id, pos, b_pos, pos - b_pos as shift, n_windows, few, b_values from dw join bw using (form, w, length)),
slot as (select h.form, h.doc_id, item_id, pos, shift, unnest(b_values) as bv, unnest(list_slice(vals, {count.format("list_slice(tokens, 1, pos)")} + 1, {count.format("list_slice(tokens, 1, pos)")} + len(b_values))) as dv from (select distinct form, doc_id, item_id, pos, shift, b_values from hits where len(b_values) > 0) h join t on t.form = h.form and t.doc_id = h.doc_id),
shifts as (select form, doc_id, item_id, shift, count(*) as slots, max(n) as most from (select form, doc_id, item_id, shift, bv, count(distinct coalesce(dv, '')) as n from slot group by all) group by all),
unequal as (select distinct form, doc_id, item_id, pos, shift from slot where bv <> coalesce(dv, '')),
kept as (select h.* from hits h left join shifts s using (form, doc_id, item_id, shift) left join unequal u using (form, doc_id, item_id, pos, shift) where coalesce(s.most, 1) = 1 and not (few and u.pos is not null)),
counts as (select form, doc_id, item_id, n_windows::bigint as n_windows, count(distinct b_pos)::bigint as matched from kept group by all),
slots as (select form, doc_id, item_id, sum(slots)::bigint as slots from shifts where most = 1 group by all),
judged as (select *, row_number() over (partition by doc_id, item_id order by matched desc, form) as k from counts left join slots using (form, doc_id, item_id) where matched >= {share} * n_windows or matched >= {run}),
short as (select item_id, tokens, vals from items where form = {WORDS_FORM} and len(tokens) between 1 and {LEAST_TOKENS - 1}),
lines as (select doc_id, {tokens(WORDS_FORM)} as tokens, {vals(WORDS_FORM)} as vals from (select doc_id, unnest(regexp_split_to_array(text, '[\\r\\n]+')) as text from documents where doc_id is not null and (select count(*) from short) > 0))
select doc_id, item_id, matched, n_windows, round(matched / n_windows, 6) as share, coalesce(slots, 0)::bigint as slots from judged where k = 1
union all select distinct doc_id, item_id, 1::bigint, 1::bigint, 1.0::double, len(short.vals)::bigint from lines join short using (tokens) where lines.vals = short.vals
"""
