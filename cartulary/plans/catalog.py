"""Queries of the engine's operators on carrier tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartulary.functions import geo
from cartulary.functions import scalars as S
from cartulary.operators import limits, lookup
from cartulary.sources import provider

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a function (table reader, session) as a query under its name."""

    def add(build):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(lambda name: spark.read.parquet(f"{folder}/{name}.parquet"), spark)

        QUERIES[build.__name__] = run
        if sql is not None:
            SQL[build.__name__] = sql
        return build

    return add


def micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


PALETTES = [("dusk", "s0", "u0", "a0"), ("sand", "s1", "u1", "a1"), ("gulf", "s2", "u2", "a2")]
THEMES = [("NATION_1", "sand", "domes", "Into one"), ("NATION_2", "gulf", "", None), ("NATION_3", "lost", None, "Into three"), ("NATION_4", "", "towers", "")]
BY_COUNTRY = [("NATION_1", "arch"), ("NATION_5", "")]
BY_SUBREGION = [("SUB_0", "palm"), ("SUB_3", "castle")]
BY_CONTINENT = [("AFRICA", "sand"), ("ASIA", "gulf"), ("EUROPE", "lost")]


def values(rows: list[tuple], columns: str) -> str:
    """Fixed rows as a SQL table."""
    lit = lambda v: "null" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return f"(values {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) as v({columns})"


@query(f"""
with n as (select n_name as country, 'SUB_' || (n_nationkey % 7) as subregion, r_name as continent, n_nationkey from nation join region on n_regionkey = r_regionkey),
j as (select n.*, t.palette tp, t.motif tm, t.label tl, c.palette cp, l1.landmark la, l2.landmark lb from n
 left join (select * from {values(THEMES, 'country, palette, motif, label')}) t using (country)
 left join (select * from {values(BY_CONTINENT, 'continent, palette')}) c using (continent)
 left join (select * from {values(BY_COUNTRY, 'country, landmark')}) l1 using (country)
 left join (select * from {values(BY_SUBREGION, 'subregion, landmark')}) l2 using (subregion)),
w as (select *, coalesce(nullif(tp, ''), nullif(cp, ''), 'dusk') as wanted from j)
select c_custkey, country, p.palette, p.sky, p.sun, p.accent, coalesce(nullif(tm, ''), 'mountains') as motif, coalesce(nullif(tl, ''), 'Into ' || country) as label, coalesce(nullif(la, ''), nullif(lb, ''), 'mountains') as landmark
from customer join w on c_nationkey = n_nationkey join (select * from {values(PALETTES, 'palette, sky, sun, accent')}) p on p.palette = case when wanted in ('dusk', 'sand', 'gulf') then wanted else 'dusk' end
""")
def theme_resolution(t, spark):
    places = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("country"), F.concat(F.lit("SUB_"), F.col("n_nationkey") % 7).alias("subregion"), F.col("r_name").alias("continent"))
    own = lambda rows, columns: lookup.dimension(spark, rows, columns)
    themed = lookup.resolve_theme(places, own(THEMES, "country string, palette string, motif string, label string"), own(PALETTES, "palette string, sky string, sun string, accent string"), own(BY_COUNTRY, "country string, landmark string"), own(BY_SUBREGION, "subregion string, landmark string"), own(BY_CONTINENT, "continent string, palette string"), "dusk", "mountains")
    return t("customer").select("c_custkey", "c_nationkey").join(F.broadcast(themed), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "country", "palette", "sky", "sun", "accent", "motif", "label", "landmark")


@query("""
with f as (select c_nationkey as k, 'Land ' || c_nationkey as common, count(*)::bigint as population, sum(cast(round(c_acctbal * 100) as bigint))::bigint as area from customer where c_acctbal > 9000 group by 1),
p as (select s_nationkey as k, case when s_nationkey % 3 = 0 then '' else 'Realm ' || s_nationkey end as official, case when s_nationkey % 4 = 0 then '' else 'economy of ' || count(*) end as economy, max(s_name) as culture from supplier where s_acctbal > 5000 group by 1),
j as (select k, coalesce(nullif(official, ''), common, 'Country ' || k) as name, population, area, economy, culture from f full join p using (k))
select k::bigint as k, name, section, value from (
 select k, name, 'population' as section, population::varchar as value from j union all select k, name, 'area', area::varchar from j union all select k, name, 'economy', economy from j union all select k, name, 'culture', culture from j) where coalesce(value, '') <> ''
""")
def dossier_full_outer(t, spark):
    facts = t("customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("population"), F.sum(F.round(F.col("c_acctbal") * 100).cast("bigint")).alias("area")).withColumn("common", F.concat(F.lit("Land "), F.col("k")))
    profile = t("supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n"), F.max("s_name").alias("culture"))
    profile = profile.select("k", "culture", F.when(F.col("k") % 3 == 0, "").otherwise(F.concat(F.lit("Realm "), F.col("k"))).alias("official"), F.when(F.col("k") % 4 == 0, "").otherwise(F.concat(F.lit("economy of "), F.col("n"))).alias("economy"))
    both = facts.join(profile, "k", "full").withColumn("name", F.coalesce(S.some(F.col("official")), F.col("common"), F.concat(F.lit("Country "), F.col("k"))))
    rows = both.select("k", "name", *(F.col(c).cast("string").alias(c) for c in ("population", "area", "economy", "culture"))).unpivot(["k", "name"], ["population", "area", "economy", "culture"], "section", "value")
    return rows.where(F.coalesce("value", F.lit("")) != "").select(F.col("k").cast("bigint").alias("k"), "name", "section", "value")


PINS = [(f"Brand#{k}", f"pin{k}.jpg") for k in (1, 2, 3, 5, 8)]


@query(f"""
with found as (select p_brand, 'search ' || min(p_type) as found from part where p_size > 40 group by 1)
select p_partkey, coalesce(file, found, 'none') as hero from part left join (select * from {values(PINS, 'p_brand, file')}) using (p_brand) left join found using (p_brand)
""")
def hero_fallback(t, spark):
    found = t("part").where("p_size > 40").groupBy("p_brand").agg(F.concat(F.lit("search "), F.min("p_type")).alias("found"))
    return t("part").join(lookup.dimension(spark, PINS, "p_brand string, file string"), "p_brand", "left").join(found, "p_brand", "left").select("p_partkey", F.coalesce("file", "found", F.lit("none")).alias("hero"))


ALIASES = [("us", "nation_2"), ("uk", "nation_1"), ("nation_7", "tion_1")]


@query(f"""
with i as (select lower(n_name) as key, arg_max(n_name, n_nationkey) as name, min(n_nationkey) as o from nation where n_name <> '' group by 1),
q as (select distinct query, coalesce(target, lower(trim(query))) as q from (select case p_partkey % 6 when 0 then ' us ' when 1 then 'UK' when 2 then 'Nation_' || (p_partkey % 30) when 3 then 'TION_' || (p_partkey % 9) when 4 then '' else p_name end as query from part) left join (select * from {values(ALIASES, 'alias, target')}) on lower(trim(query)) = alias),
r as (select query, name, row_number() over (partition by query order by case when key = q then 0 when starts_with(key, q) then 1 else 2 end, o) as k from q join i on contains(key, q) where q <> '')
select p_partkey, p.query, name from (select p_partkey, case p_partkey % 6 when 0 then ' us ' when 1 then 'UK' when 2 then 'Nation_' || (p_partkey % 30) when 3 then 'TION_' || (p_partkey % 9) when 4 then '' else p_name end as query from part) p left join (select query, name from r where k = 1) r on p.query = r.query
""")
def name_resolution(t, spark):
    k = F.col("p_partkey")
    asked = t("part").select(k, F.when(k % 6 == 0, " us ").when(k % 6 == 1, "UK").when(k % 6 == 2, F.concat(F.lit("Nation_"), k % 30)).when(k % 6 == 3, F.concat(F.lit("TION_"), k % 9)).when(k % 6 == 4, "").otherwise(F.col("p_name")).alias("query"))
    index = lookup.name_index(t("nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("ordinal")))
    return lookup.resolve_names(asked, F.broadcast(index), lookup.dimension(spark, ALIASES, "alias string, target string")).select("p_partkey", "query", "name")


# Feature 1 has a hole, 2 two parts, 3 overlaps 1, 4 a ring of two points; rings of 2 are equal in area.
RINGS = [(1, 0, [(0, 0), (60, 0), (60, 40), (0, 40), (0, 0)]), (1, 1, [(20, 10), (40, 10), (40, 30), (20, 30), (20, 10)]), (2, 0, [(-100, -50), (-60, -50), (-60, -20), (-100, -20), (-100, -50)]), (2, 1, [(100, 20), (140, 20), (140, 50), (100, 50), (100, 20)]), (3, 0, [(-20, -10), (30, -15), (25, 25), (-20, -10)]), (4, 0, [(10, 60), (20, 60)]), (4, 1, [(10, 60), (30, 60), (20, 80), (10, 60)])]
VERTICES = [(f, r, i, float(x), float(y)) for f, r, ring in RINGS for i, (x, y) in enumerate(ring)]
_POINTS = "select c_custkey as id, (c_custkey * 37 % 3600) / 10.0 - 180 as lng, (c_custkey * 53 % 1800) / 10.0 - 90 as lat from customer"
_V = f"v as (select feature, ring, i, x::double as lng, y::double as lat from {values(VERTICES, 'feature, ring, i, x, y')})"
_BOX = "b as (select feature, min(lng) as west, min(lat) as south, max(lng) as east, max(lat) as north from v group by 1)"
_EDGE = "e as (select feature, ring, lng as x1, lat as y1, coalesce(lag(lng) over w, first_value(lng) over d) as x2, coalesce(lag(lat) over w, first_value(lat) over d) as y2 from v window w as (partition by feature, ring order by i), d as (partition by feature, ring order by i desc))"


def _points(t):
    return t("customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 37 % 3600 / 10.0 - 180).alias("lng"), (F.col("c_custkey") * 53 % 1800 / 10.0 - 90).alias("lat"))


def _vertices(spark):
    return lookup.dimension(spark, VERTICES, "feature int, ring int, i int, lng double, lat double")


@query(f"with {_V}, {_BOX}, p as ({_POINTS}) select id, feature from p join b on lng between west and east and lat between south and north")
def bbox_join(t, spark):
    return geo.in_boxes(_points(t), F.broadcast(geo.bounds(_vertices(spark)))).select("id", "feature")


@query(f"""with {_V}, {_BOX}, {_EDGE}, p as ({_POINTS}),
c as (select id, feature, count(*) filter ((y1 > lat) <> (y2 > lat) and lng < (x2 - x1) * (lat - y1) / nullif(y2 - y1, 0) + x1) as n from p join b on lng between west and east and lat between south and north join e using (feature) group by all)
select id, min(feature) as feature from c where n % 2 = 1 group by 1""")
def point_in_polygon(t, spark):
    return geo.in_polygons(_points(t), _vertices(spark))


@query("select c_nationkey, min(lng) as west, min(lat) as south, max(lng) as east, max(lat) as north from (select c_nationkey, (c_custkey * 37 % 3600) / 10.0 - 180 as lng, (c_custkey * 53 % 1800) / 10.0 - 90 as lat from customer) group by 1".replace("select c_nationkey, min(lng) as west, min(lat) as south, max(lng) as east, max(lat) as north", "select c_nationkey, min(lng)::double as west, min(lat)::double as south, max(lng)::double as east, max(lat)::double as north"))
def bbox_agg(t, spark):
    own = t("customer").select(F.col("c_nationkey").alias("feature"), (F.col("c_custkey") * 37 % 3600 / 10.0 - 180).cast("double").alias("lng"), (F.col("c_custkey") * 53 % 1800 / 10.0 - 90).cast("double").alias("lat"))
    return geo.bounds(own).withColumnRenamed("feature", "c_nationkey")


@query(f"""with {_V}, {_EDGE}, r as (select feature, ring, count(*) as n, abs(sum(x2 * y1 - x1 * y2) / 2) as area, avg(x1) as lng, avg(y1) as lat from e group by 1, 2)
select feature, ring, area, round(lng, 6) as lng, round(lat, 6) as lat from (select *, row_number() over (partition by feature order by area desc, ring) as k from r where n >= 3) where k = 1""")
def ring_area_centroid(t, spark):
    return geo.ring_centres(_vertices(spark)).select("feature", "ring", "area", F.round("lng", 6).alias("lng"), F.round("lat", 6).alias("lat"))


# Candidates of a query: the documents whose number falls into its slot, in order.
_CANDIDATE = """select item_id, b.text as query, doc_id, 'File:' || replace(d.text, ' ', '_') || '.jpg' as title,
 case doc_id % 5 when 0 then 'image/png' when 1 then 'image/svg+xml' when 2 then 'text/plain' else 'image/jpeg' end as mime,
 case when doc_id % 7 = 0 then '' else 'u' || doc_id end as url, case when doc_id % 3 = 0 then '' when doc_id % 3 = 1 then null when doc_id % 2 = 0 then 't/' || n_chars || 'px-' || doc_id else 't' || doc_id end as thumb,
 (case when doc_id % 11 = 0 then 0 else n_chars % 3000 end)::bigint as width, (n_chars % 1700)::bigint as height, case when doc_id % 13 = 0 then null else doc_id % 17 end as idx
 from documents d join benchmark b on d.doc_id % (select max(item_id) + 1 from benchmark) = b.item_id"""
_JUNK_SQL = "(?i)(" + "|".join(S.JUNK_TERMS) + ")"


def _candidates(t, spark):
    items = t("benchmark").agg(F.max("item_id")).first()[0] + 1
    d, b, k = t("documents").alias("d"), t("benchmark").alias("b"), F.col("doc_id")
    return d.join(b, k % items == F.col("item_id")).select(
        "item_id", F.col("b.text").alias("query"), "doc_id", F.concat(F.lit("File:"), F.replace("d.text", F.lit(" "), F.lit("_")), F.lit(".jpg")).alias("title"),
        F.when(k % 5 == 0, "image/png").when(k % 5 == 1, "image/svg+xml").when(k % 5 == 2, "text/plain").otherwise("image/jpeg").alias("mime"),
        F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("u"), k)).alias("url"), F.when(k % 3 == 0, "").when(k % 3 == 1, None).when(k % 2 == 0, F.concat(F.lit("t/"), "n_chars", F.lit("px-"), k)).otherwise(F.concat(F.lit("t"), k)).alias("thumb"),
        F.when(k % 11 == 0, 0).otherwise(F.col("n_chars") % 3000).cast("bigint").alias("width"), (F.col("n_chars") % 1700).cast("bigint").alias("height"), F.when(k % 13 != 0, k % 17).alias("idx"),
    )


@query(f"""with c as ({_CANDIDATE}),
p as (select *, row_number() over (partition by item_id order by coalesce(idx, 9999), doc_id) - 1 as pos from c),
f as (select *, coalesce(nullif(thumb, ''), nullif(url, '')) as shown, list_filter(regexp_split_to_array(lower(query), '[^a-z0-9]+'), lambda x: length(x) > 3) as words from p
 where mime like 'image/%' and mime <> 'image/svg+xml' and coalesce(nullif(thumb, ''), nullif(url, '')) is not null and not regexp_matches(title, '{_JUNK_SQL}') and (width = 0 or width >= 500)),
s as (select item_id, doc_id, shown, case when regexp_matches(thumb, '/\\d+px-') then regexp_replace(thumb, '/\\d+px-', '/1280px-') else coalesce(nullif(url, ''), shown) end as full_size, title as id, case when len(words) = 0 then 0.0 else len(list_filter(words, lambda x: contains(lower(title), x))) / len(words) end * 6 + case when mime = 'image/jpeg' then 4 else 0 end
 + ln(case when width > 0 and height > 0 then (width * height)::double else 250000 end) * 0.55 + case when width > 0 and height > 0 then least(width, height) / greatest(width, height) else 0.6 end - pos * 0.25 as score, pos from f)
select item_id, doc_id, shown, full_size, id, round(score, 6) as score, k as rank from (select *, row_number() over (partition by item_id order by round(score, 6) desc, pos) as k from s) where k <= 8""")
def image_relevance_topk(t, spark):
    placed = _candidates(t, spark).withColumn("pos", F.row_number().over(Window.partitionBy("item_id").orderBy(F.coalesce("idx", F.lit(9999)), "doc_id")) - 1)
    shown = S.first_of(F.col("thumb"), F.col("url"))
    kept = placed.withColumn("shown", shown).where(F.startswith("mime", F.lit("image/")) & (F.col("mime") != "image/svg+xml") & F.col("shown").isNotNull() & ~S.is_junk(F.col("title")) & ((F.col("width") == 0) | (F.col("width") >= 500)))
    words = F.filter(F.split(F.lower("query"), "[^a-z0-9]+"), lambda w: F.length(w) > 3)
    title = F.lower("title")
    share = F.when(F.size(words) == 0, 0.0).otherwise(F.size(F.filter(words, lambda w: F.contains(title, w))) / F.when(F.size(words) > 0, F.size(words)))
    scored = kept.withColumn("score", F.round(S.image_score(share, F.col("mime"), F.col("width"), F.col("height"), F.col("pos")), 6))
    return lookup.first_by(scored.withColumn("full_size", S.full_image(F.col("thumb"), F.col("url"))), ["item_id"], [F.desc("score"), "pos"], 8).select("item_id", "doc_id", "shown", "full_size", F.col("title").alias("id"), "score", "rank")


@query(f"select page_id, title, regexp_matches(title, '{_JUNK_SQL}') as junk from (select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) || case page_id % 4 when 0 then ' Map of old' when 1 then ' mapuche émap' when 2 then ' family_tree' else ' logos' end as title from pages)")
def junk_title_filter(t, spark):
    k = F.col("page_id") % 4
    titled = t("pages").select("page_id", F.concat(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.when(k == 0, " Map of old").when(k == 1, " mapuche émap").when(k == 2, " family_tree").otherwise(" logos")).alias("title"))
    return titled.select("page_id", "title", S.is_junk(F.col("title")).alias("junk"))


@query("""select source, doc_id, w * h as area from (select *, row_number() over (partition by source order by w * h desc, doc_id) as k from (
 select source, doc_id, nullif(n_chars % 3000, 0) as w, n_chars % 1700 as h from documents where case lang when 'en' then 'image/jpeg' when 'de' then 'image/png' else 'image/svg+xml' end = 'image/jpeg' and coalesce(text, '') <> '') where w >= 700) where k = 1""")
def image_fallback_largest(t, spark):
    mime = F.when(F.col("lang") == "en", "image/jpeg").when(F.col("lang") == "de", "image/png").otherwise("image/svg+xml")
    found = t("documents").select("source", "doc_id", mime.alias("mime"), F.col("text").alias("url"), F.nullif(F.col("n_chars") % 3000, F.lit(0)).alias("width"), (F.col("n_chars") % 1700).alias("height"))
    own = found.where((F.col("mime") == "image/jpeg") & S.some(F.col("url")).isNotNull() & (F.col("width") >= 700)).select("source", "doc_id", (F.col("width") * F.col("height")).alias("area"))
    return own.groupBy("source").agg(F.max_by("doc_id", F.struct("area", -F.col("doc_id"))).alias("doc_id"), F.max("area").alias("area"))


@query("""with u as (select source, lang, doc_id, 0 as p, doc_id % 3 = 0 as used from documents where n_chars > 2000 union all select source, lang, doc_id, 1, doc_id % 3 = 0 from documents where n_chars <= 2000)
select source, lang, doc_id, p::bigint as priority, used from (select *, row_number() over (partition by source, lang order by used, p, doc_id) as k from u) where k = 1""")
def preference_union(t, spark):
    docs = t("documents").select("source", "lang", "doc_id", "n_chars", (F.col("doc_id") % 3 == 0).alias("used"))
    both = docs.where("n_chars > 2000").withColumn("priority", F.lit(0)).unionByName(docs.where("n_chars <= 2000").withColumn("priority", F.lit(1)))
    best = both.groupBy("source", "lang").agg(F.min(F.struct("used", "priority", "doc_id")).alias("m"))
    return best.select("source", "lang", "m.doc_id", F.col("m.priority").cast("bigint").alias("priority"), "m.used")


_ASKED = "select conv_id, turn, case when turn % 3 = 0 then ' ' || translate(text, 'aeiou', 'AEIOU') else text end as q from conversations"


@query(f"select conv_id, turn, q as query from (select *, row_number() over (partition by conv_id, lower(trim(q)) order by turn) as k from ({_ASKED}) where trim(q) <> '') where k = 1")
def query_dedupe(t, spark):
    asked = t("conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.concat(F.lit(" "), F.translate("text", "aeiou", "AEIOU"))).otherwise(F.col("text")).alias("query")).where(F.trim("query") != "")
    return lookup.first_by(asked.withColumn("key", F.lower(F.trim("query"))), ["conv_id", "key"], ["turn"]).select("conv_id", "turn", "query")


@query(f"""with q as (select conv_id, turn, q, row_number() over (partition by conv_id, lower(trim(q)) order by turn) as k from ({_ASKED}) where trim(q) <> ''),
g as (select conv_id, turn, row_number() over (partition by conv_id order by turn) as place from q where k = 1),
a as (select conv_id, turn, place, case when role = 'user' then null else 'p' || length(text) % 7 end as photo from g join conversations using (conv_id, turn) where place <= 8),
f as (select conv_id, photo, min(place) as place from a where photo is not null group by all)
select conv_id, photo, place, row_number() over (partition by conv_id order by place) as rank from f qualify rank <= 10""")
def gallery(t, spark):
    asked = t("conversations").select("conv_id", "turn", "role", "text", F.when(F.col("turn") % 3 == 0, F.concat(F.lit(" "), F.translate("text", "aeiou", "AEIOU"))).otherwise(F.col("text")).alias("query")).where(F.trim("query") != "")
    distinct = lookup.first_by(asked.withColumn("key", F.lower(F.trim("query"))), ["conv_id", "key"], ["turn"])
    eight = lookup.first_by(distinct, ["conv_id"], ["turn"], 8, "place")
    found = eight.select("conv_id", "place", F.when(F.col("role") != "user", F.concat(F.lit("p"), F.length("text") % 7)).alias("photo")).where("photo is not null")
    photos = found.groupBy("conv_id", "photo").agg(F.min("place").alias("place"))
    return lookup.first_by(photos, ["conv_id"], ["place"], 10).select("conv_id", "photo", F.col("place").cast("bigint").alias("place"), F.col("rank").cast("bigint").alias("rank"))


@query("select p_brand, array_to_string(list_sort(list(distinct p_name)), '|') as names from part group by 1")
def alphabetical_names(t, spark):
    return t("part").groupBy("p_brand").agg(F.concat_ws("|", F.array_sort(F.collect_set("p_name"))).alias("names"))


@query("select doc_id, trim(coalesce(lang, '') || ' ' || coalesce(source, '')) as query from documents")
def era_fallback_query(t, spark):
    return t("documents").select("doc_id", S.fallback_query(F.col("lang"), F.col("source")).alias("query"))


@query("""with recursive q as (select o_custkey as g, row_number() over (partition by o_custkey order by o_orderkey) as k, [o_orderkey % 5, o_orderkey % 7, o_orderkey % 11] as c from orders),
f as (select g, 1::bigint as k, [c[1]] as taken from q where k = 1 union all select f.g, q.k, list_append(taken, list_filter(c, lambda x: not list_contains(taken, x))[1]) from f join q on q.g = f.g and q.k = f.k + 1)
select g as o_custkey, array_to_string(list_transform(taken, lambda x: coalesce(x::varchar, '-')), ',') as picks from (select *, row_number() over (partition by g order by k desc) as last from f) where last = 1""")
def greedy_distinct(t, spark):
    k = F.col("o_orderkey")
    rows = t("orders").groupBy(F.col("o_custkey").alias("group")).agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), F.array(k % 5, k % 7, k % 11).alias("c")))).alias("s"))
    picked = lookup.greedy_distinct(rows.select("group", F.transform("s", lambda x: x["c"]).alias("queries")))
    return picked.select(F.col("group").alias("o_custkey"), F.concat_ws(",", F.transform("picks", lambda x: F.coalesce(x.cast("string"), F.lit("-")))).alias("picks"))


_ROUND = "p_partkey % 181 - 90 as lat, p_partkey * 7 % 360 - 180 as lng, p_partkey % 5026 - 3000 as year, 8 + p_partkey % 343 as tol"
_GUESS = "l_orderkey * 3 % 181 - 90 as glat, l_orderkey * 11 % 360 - 180 as glng, l_orderkey % 5026 - 3000 as gy"
_KM = "2 * 6371 * asin(least(1, sqrt(power(sin(radians(glat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(glat)) * power(sin(radians(glng - lng) / 2), 2))))"


def _plays(t):
    rounds = t("part").selectExpr("p_partkey", *_ROUND.split(", "))
    guesses = t("lineitem").selectExpr("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", *_GUESS.split(", "))
    joined = guesses.join(rounds, F.col("l_partkey") == F.col("p_partkey"))
    km = S.haversine_km(*(F.col(c).cast("double") for c in ("lat", "lng", "glat", "glng")))
    return joined.withColumn("km", F.round(km, 6)).withColumn("ls", S.location_score(F.col("km"))).withColumn("ts", S.time_score(F.col("gy") - F.col("year"), F.col("tol")))


_PLAYS = f"select *, floor(5000 * exp(-km / 1500) + 0.5)::bigint as ls, floor(5000 * exp(-abs(gy - year) / tol) + 0.5)::bigint as ts from (select *, round({_KM}, 6) as km from (select l_orderkey, l_partkey, l_linenumber, l_suppkey, {_GUESS} from lineitem) join (select p_partkey, {_ROUND} from part) on l_partkey = p_partkey)"


@query(f"select l_orderkey, l_linenumber, l_partkey, l_suppkey, km, ls, ts, ls + ts as rs from ({_PLAYS})")
def round_scores(t, spark):
    return _plays(t).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "km", "ls", "ts", (F.col("ls") + F.col("ts")).alias("rs"))


@query(f"""with r as (select p_partkey, {_ROUND} from part), g as (select l_partkey, min(l_orderkey) as l_orderkey from lineitem where l_quantity >= 49 group by 1),
j as (select p_partkey, lat, lng, year, tol, case when l_orderkey is not null then l_orderkey * 3 % 181 - 90 end as glat, l_orderkey * 11 % 360 - 180 as glng, coalesce(l_orderkey % 5026 - 3000, 1000) as gy from r left join g on p_partkey = l_partkey),
k as (select *, round({_KM}, 6) as km from j)
select p_partkey, km, coalesce(floor(5000 * exp(-km / 1500) + 0.5), 0)::bigint as ls, floor(5000 * exp(-abs(gy - year) / tol) + 0.5)::bigint as ts from k""")
def timed_out_rounds(t, spark):
    rounds = t("part").selectExpr("p_partkey", *_ROUND.split(", "))
    guesses = t("lineitem").where("l_quantity >= 49").groupBy("l_partkey").agg(F.min("l_orderkey").alias("l_orderkey")).selectExpr("l_partkey", *_GUESS.split(", "))
    joined = rounds.join(guesses, F.col("p_partkey") == F.col("l_partkey"), "left")
    km = F.round(S.haversine_km(*(F.col(c).cast("double") for c in ("lat", "lng", "glat", "glng"))), 6)
    return joined.withColumn("km", km).select("p_partkey", "km", F.coalesce(S.location_score(F.col("km")), F.lit(0).cast("bigint")).alias("ls"), S.time_score(F.coalesce("gy", F.lit(1000)) - F.col("year"), F.col("tol")).alias("ts"))


@query(f"""with p as (select *, ls + ts as rs from ({_PLAYS})), r as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as i from p)
select l_orderkey, sum(rs)::bigint as total, string_agg(case when rs >= 9000 then '🟩' when rs >= 7000 then '🟨' when rs >= 4000 then '🟧' when rs >= 1500 then '🟥' else '⬛' end, '' order by i) as emojis,
floor(sum(rs) / (count(*) * 10000) * 100 + 0.5)::bigint as percent, case when sum(rs) >= count(*) * 8000 then 'Master Chronologist' when sum(rs) >= count(*) * 6000 then 'Seasoned Time Traveller' when sum(rs) >= count(*) * 4000 then 'Budding Explorer' else 'Wide-eyed Novice' end as title from r group by 1""")
def game_totals_tiers(t, spark):
    plays = _plays(t).withColumn("rs", F.col("ls") + F.col("ts"))
    games = plays.groupBy("l_orderkey").agg(F.sum("rs").alias("total"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", S.tier(F.col("rs")).alias("e")))).alias("s"))
    most = F.col("n") * 10000
    return games.select("l_orderkey", "total", F.concat_ws("", F.transform("s", lambda x: x["e"])).alias("emojis"), S.half_up(F.col("total") / most * 100).cast("bigint").alias("percent"), S.rank_title(F.col("total"), most).alias("title"))


@query(f"select l_orderkey, l_linenumber, l_partkey, l_suppkey, sum(ls + ts) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey rows unbounded preceding)::bigint as running from ({_PLAYS})")
def running_totals(t, spark):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey").rowsBetween(Window.unboundedPreceding, 0)
    return _plays(t).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.sum(F.col("ls") + F.col("ts")).over(order).alias("running"))


GOLDEN = [(1, "32,30,37,43,9"), (2, "14,40,23,31,12"), (158, "19,32,4,41,15"), (330, "3,2,16,13,0")]


@query(f"select seed::bigint as seed, first from {values(GOLDEN, 'seed, first')}")
def daily_permutation(t, spark):
    seeds = lookup.dimension(spark, [(s,) for s, _ in GOLDEN], "seed bigint")
    return seeds.select("seed", F.concat_ws(",", F.slice(S.permutation(F.col("seed"), 44), 1, 5).cast("array<string>")).alias("first"))


@query("""with d as (select distinct user_id, ts::date as d from events), g as (select *, d - (row_number() over (partition by user_id order by d))::int as island from d)
select user_id, (date_diff('day', date '2026-01-01', d) + 1)::bigint as day, row_number() over (partition by user_id, island order by d) as streak from g""")
def streaks(t, spark):
    days = t("events").select("user_id", F.to_date("ts").alias("d")).distinct()
    islands = days.withColumn("island", F.date_sub("d", F.row_number().over(Window.partitionBy("user_id").orderBy("d"))))
    return islands.select("user_id", S.day_number(F.col("d")).cast("bigint").alias("day"), F.row_number().over(Window.partitionBy("user_id", "island").orderBy("d")).cast("bigint").alias("streak"))


@query("""select conv_id, turn, lag(turn) over w as before, lead(turn) over w as after, row_number() over w = 1 as first, count(*) over (partition by conv_id) = row_number() over w as last,
coalesce(lead(turn) over w, 0) as next_page, lead(turn) over w is null as next_era from conversations window w as (partition by conv_id order by turn)""")
def neighbours_nav(t, spark):
    w = Window.partitionBy("conv_id").orderBy("turn")
    after, at = F.lead("turn").over(w), F.row_number().over(w)
    return t("conversations").select("conv_id", "turn", F.lag("turn").over(w).alias("before"), after.alias("after"), (at == 1).alias("first"), (at == F.count("*").over(Window.partitionBy("conv_id"))).alias("last"), F.coalesce(after, F.lit(0)).alias("next_page"), after.isNull().alias("next_era"))


@query("select conv_id, i::bigint as i, repeat('X', i // 10) || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][i % 10 + 1] as roman, role from (select *, (row_number() over (partition by conv_id order by turn))::int as i from conversations)")
def timeline_roman(t, spark):
    i = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return t("conversations").select("conv_id", i.cast("bigint").alias("i"), "role").select("conv_id", "i", S.roman(F.col("i")).alias("roman"), "role")


_TITLE = "'File:' || replace(text, ' ', '_') || case doc_id % 4 when 0 then ' - Archive 12' when 1 then ' (no 47902) x' when 2 then ', Photo 3 of 8, photo 4 of 8' else ',, ' end || '.jpg'"


@query(rf"""with t as (select doc_id, {_TITLE} as title from documents),
a as (select doc_id, title, trim(replace(regexp_replace(substr(title, strpos(title, ':') + 1), '\.[^.]+$', ''), '_', ' ')) as c from t),
b as (select doc_id, title, regexp_replace(regexp_replace(regexp_split_to_array(c, '\s[-–—]\s')[1], '\([^)]*\d[^)]*\)', '', 'g'), ',?\s*photo\s+\d+\s+of\s+\d+', '', 'i') as c from a)
select doc_id, trim(regexp_replace(regexp_replace(c, '\s{{2,}}', ' ', 'g'), '[,\s]+$', '')) as caption, upper(substr(trim(regexp_replace(title, '\s+', ' ', 'g')), 1, 1)) || substr(trim(regexp_replace(title, '\s+', ' ', 'g')), 2) as subject,
case when lang = 'en' then 'x' else 'x en' end as short from b join (select doc_id, lang from documents) using (doc_id)""")
def captions(t, spark):
    k = F.col("doc_id") % 4
    docs = t("documents").select("doc_id", "lang", F.concat(F.lit("File:"), F.replace("text", F.lit(" "), F.lit("_")), F.when(k == 0, " - Archive 12").when(k == 1, " (no 47902) x").when(k == 2, ", Photo 3 of 8, photo 4 of 8").otherwise(",, "), F.lit(".jpg")).alias("title"))
    return docs.select("doc_id", S.title_caption(F.col("title")).alias("caption"), S.clean_subject(F.col("title")).alias("subject"), S.subject_caption(F.lit("x en"), F.col("lang")).alias("short"))


@query("""select page_id, replace(replace(replace(replace(replace(coalesce(html, 'null'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') as safe, replace(replace(replace(replace(replace(coalesce(anchor, 'null'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') as in_app, replace(replace(replace(replace(replace(coalesce(anchor, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') as in_game from (select *, case when contains(url, '#') then substr(url, strpos(url, '#')) || '<&"''>' end as anchor from pages)""")
def html_escape(t, spark):
    anchor = F.when(F.contains("url", F.lit("#")), F.concat(F.substr("url", F.locate("#", "url")), F.lit("<&\"'>")))
    return t("pages").select("page_id", S.escape_html(F.col("html")).alias("safe"), S.escape_html(anchor).alias("in_app"), S.escape_html(anchor, "").alias("in_game"))


@query("select o_orderkey, case when y < 0 then (-y)::varchar || ' BCE' else y::varchar || ' CE' end as year, case when km < 1 then 'less than 1 km' when km < 20 then floor(km + 0.5)::bigint::varchar || ' km' else format('{:,}', floor(km + 0.5)::bigint) || ' km' end as km from (select o_orderkey, (o_orderkey % 5026 - 3000)::bigint as y, o_orderkey % 31 * (o_orderkey % 17) * 7 / 16.0 as km from orders)")
def format_year_km(t, spark):
    own = t("orders").selectExpr("o_orderkey", "cast(o_orderkey % 5026 - 3000 as bigint) as y", "o_orderkey % 31 * (o_orderkey % 17) * 7 / 16.0 as km")
    return own.select("o_orderkey", S.format_year(F.col("y")).alias("year"), S.format_km(F.col("km")).alias("km"))


@query(r"""with p as (select page_id, url, case when contains(url, '#') then substr(url, 1, strpos(url, '#') - 1) else url end as base, case when contains(url, '#') then substr(url, strpos(url, '#')) else '#a%20b' end as anchor from pages),
u as (select page_id, url as own, base || case when contains(base, '?') then '&' else '?' end || 'country=%20New+Land%20&country=x' || anchor as url from p)
select page_id, trim(url_decode(replace(nullif(regexp_extract(url, '[?&]country=([^&#]*)', 1), ''), '+', ' '))) as country, nullif(trim(coalesce(url_decode(nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '')), '')), '') as page, trim(url_decode(substr(url, strpos(url, '#') + 1))) as anchor,
replace(replace(replace(replace(url_encode(own || ' !''()~'), '%21', '!'), '%27', chr(39)), '%28', '('), '%29', ')') as encoded from u""")
def url_params(t, spark):
    own = F.col("url")
    cut = F.locate("#", "url")
    base = F.when(cut > 0, F.substr(own, F.lit(1), cut - 1)).otherwise(own)
    anchor = F.when(cut > 0, F.substr(own, cut)).otherwise("#a%20b")
    asked = t("pages").select("page_id", own.alias("own"), F.concat(base, F.when(F.contains(base, F.lit("?")), "&").otherwise("?"), F.lit("country=%20New+Land%20&country=x"), anchor).alias("url"))
    url = F.col("url")
    return asked.select("page_id", S.query_value(url, "country").alias("country"), S.query_value(url, "page").alias("page"), S.fragment(url).alias("anchor"), S.encode_component(F.concat("own", F.lit(" !'()~"))).alias("encoded"))


@query("select event_id, coalesce(nullif(trim(list_extract(string_split(xff, ','), -1)), ''), peer) as ip from (select event_id, case event_id % 3 when 0 then null when 1 then '1.1.1.1, 10.0.0.' || user_id || ' ' else '9.9.9.9,' end as xff, '127.0.0.' || (user_id % 9) as peer from events)")
def client_ip(t, spark):
    k = F.col("event_id") % 3
    own = t("events").select("event_id", F.when(k == 1, F.concat(F.lit("1.1.1.1, 10.0.0."), "user_id", F.lit(" "))).when(k == 2, "9.9.9.9,").alias("xff"), F.concat(F.lit("127.0.0."), F.col("user_id") % 9).alias("peer"))
    return own.select("event_id", S.client_ip(F.col("xff"), F.col("peer")).alias("ip"))


@query("select event_id, (props->>'k')::bigint as k, case when event_id % 10 = 0 then 'bad' when (props->>'k')::bigint = 0 then 'empty' else 'ok' end as state from (select event_id, case when event_id % 10 = 0 then null else props end as props from events)")
def json_roundtrip(t, spark):
    own = t("events").select("event_id", F.when(F.col("event_id") % 10 == 0, "{broken").otherwise(F.col("props")).alias("props")).withColumn("data", F.from_json("props", "k bigint", {"mode": "PERMISSIVE"}))
    again = F.from_json(F.to_json("data"), "k bigint")
    return own.select("event_id", again["k"].alias("k"), F.when(F.col("data.k").isNull(), "bad").when(F.col("data.k") == 0, "empty").otherwise("ok").alias("state"))


@query("select o_custkey, string_agg(v, ', ' order by k) as joined from (select o_custkey, o_orderpriority as k, min(o_orderstatus) as v from orders group by 1, 2) group by 1")
def map_values_join(t, spark):
    own = t("orders").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderstatus").alias("v")).groupBy("o_custkey").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("o_orderpriority", "v")))).alias("m"))
    return own.select("o_custkey", F.array_join(F.map_values("m"), ", ").alias("joined"))


@query("""with p as (select c_custkey, ((c_custkey * 37 % 14400) / 10.0 - 720)::double as lng, ((c_custkey * 53 % 1800) / 10.0 - 90)::double as lat from customer),
q as (select c_custkey, lng - 360 * floor((lng + 180) / 360) as w, lat, cos(radians(lat)) * sin(radians(lng - 20)) as x, cos(radians(30)) * sin(radians(lat)) - sin(radians(30)) * cos(radians(lat)) * cos(radians(lng - 20)) as y, sin(radians(30)) * sin(radians(lat)) + cos(radians(30)) * cos(radians(lat)) * cos(radians(lng - 20)) as z from p)
select c_custkey, round(w, 6) as lng, round(x, 6) + 0 as x, round(y, 6) + 0 as y, round(z, 9) >= 0 as near from q""")
def norm_lng_project(t, spark):
    own = t("customer").select("c_custkey", (F.col("c_custkey") * 37 % 14400 / 10.0 - 720).cast("double").alias("lng"), (F.col("c_custkey") * 53 % 1800 / 10.0 - 90).cast("double").alias("lat"))
    x, y, _ = S.orthographic(F.col("lat"), F.col("lng"), F.lit(30.0), F.lit(20.0))
    z = F.sin(F.radians(F.lit(30.0))) * F.sin(F.radians("lat")) + F.cos(F.radians(F.lit(30.0))) * F.cos(F.radians("lat")) * F.cos(F.radians(F.col("lng") - 20))
    return own.select("c_custkey", F.round(S.wrap_longitude(F.col("lng")), 6).alias("lng"), (F.round(x, 6) + 0.0).alias("x"), (F.round(y, 6) + 0.0).alias("y"), (F.round(z, 9) >= 0).alias("near"))


_REQ = "select event_id, case event_id % 20 when 0 then 'HEAD' else 'GET' end as method, case event_id % 4 when 0 then '/api/history' when 1 then '/api/story' when 2 then '/api/profile' else '/index.html' end as path, case event_id % 9 when 0 then '   ' when 1 then repeat('x', 61) else 'Land ' || user_id end as country, case event_id % 11 when 0 then '' when 1 then repeat('e', 81) else event_type end as era, repeat('p', (event_id % 45)::int) as period from events"
_STATUS = "case when method = 'HEAD' then 200 when path not like '/api/%' then 200 when trim(country) = '' or length(trim(country)) > 60 then 400 when path = '/api/story' and (trim(era) = '' or length(trim(era)) > 80 or length(trim(period)) > 40) then 400 else 200 end"


def _requests(t):
    k = F.col("event_id")
    return t("events").select(
        "event_id", "user_id", "ts", F.when(k % 20 == 0, "HEAD").otherwise("GET").alias("method"), F.when(k % 4 == 0, "/api/history").when(k % 4 == 1, "/api/story").when(k % 4 == 2, "/api/profile").otherwise("/index.html").alias("path"),
        F.when(k % 9 == 0, "   ").when(k % 9 == 1, "x" * 61).otherwise(F.concat(F.lit("Land "), "user_id")).alias("country"), F.when(k % 11 == 0, "").when(k % 11 == 1, "e" * 81).otherwise(F.col("event_type")).alias("era"), F.repeat(F.lit("p"), (k % 45).cast("int")).alias("period"),
    )


@query(f"select event_id, {_STATUS} as status, case when method = 'HEAD' or path not like '/api/%' then '' when {_STATUS} = 400 then 'rejected' when event_id % 5 = 0 then 'hit' else 'computed' end as step from ({_REQ})")
def request_validation(t, spark):
    country, era, period = F.trim("country"), F.trim("era"), F.trim("period")
    idle = (F.col("method") == "HEAD") | ~F.startswith("path", F.lit("/api/"))
    bad = (country == "") | (F.length(country) > 60) | ((F.col("path") == "/api/story") & ((era == "") | (F.length(era) > 80) | (F.length(period) > 40)))
    status = F.when(idle, 200).when(bad, 400).otherwise(200)
    return _requests(t).select("event_id", status.alias("status"), F.when(idle, "").when(bad, "rejected").when(F.col("event_id") % 5 == 0, "hit").otherwise("computed").alias("step"))


def _calls(t):
    return t("events").select(F.col("user_id").alias("key"), micros("ts").alias("at"), F.col("event_id").alias("id"))


_W = 6 * 3600 * 1_000_000


@query(f"""with recursive e as (select user_id as key, epoch_us(ts) as "at", event_id as id, row_number() over (partition by user_id order by ts, event_id) as k from events),
f as (select key, "at", id, k, ["at"] as hits, 'ok' as outcome from e where k = 1
 union all select e.key, e."at", e.id, e.k, case when len(list_filter(hits, lambda x: e."at" - x < {_W})) >= 2 then list_filter(hits, lambda x: e."at" - x < {_W}) else list_append(list_filter(hits, lambda x: e."at" - x < {_W}), e."at") end, case when len(list_filter(hits, lambda x: e."at" - x < {_W})) >= 2 then 'key' else 'ok' end from f join e on e.key = f.key and e.k = f.k + 1)
select key, "at", id, outcome from f""")
def rate_limit_per_key(t, spark):
    return limits.rate_limit(_calls(t), window_us=_W, per_key=2)


@query(f"""with recursive e as (select user_id as key, epoch_us(ts) as "at", event_id as id, row_number() over (order by ts, event_id) as k from events),
f as (select key, "at", id, k, [{{'k': key, 't': "at"}}] as hits, 'ok' as outcome from e where k = 1
 union all select key, "at", id, k, case when outcome = 'ok' then list_append(live, {{'k': key, 't': "at"}}) else live end, outcome from (select e.key, e."at", e.id, e.k, list_filter(hits, lambda x: e."at" - x.t < {_W}) as live,
  case when len(list_filter(hits, lambda x: e."at" - x.t < {_W})) >= 40 then 'global' when len(list_filter(hits, lambda x: e."at" - x.t < {_W} and x.k = e.key)) >= 2 then 'key' else 'ok' end as outcome from f join e on e.k = f.k + 1))
select key, "at", id, outcome from f""")
def rate_limit_global(t, spark):
    return limits.rate_limit(_calls(t), window_us=_W, per_key=2, overall=40)


@query("""with e as (select event_id as id, epoch_us(ts) as "at", ts::date as d, event_type = 'error' as failed from events),
r as (select *, coalesce(sum((not failed)::int) over (partition by d order by "at", id rows between unbounded preceding and 1 preceding), 0) as before from e)
select id, "at", case when before >= 200 then 'rejected' when failed then 'refunded' else 'ok' end as outcome from r""")
def daily_quota(t, spark):
    calls = t("events").select(F.col("event_id").alias("id"), micros("ts").alias("at"), "event_type")
    day = F.floor(F.col("at") / 86_400_000_000).cast("bigint")
    return limits.daily_quota(calls, cap=200, failed=F.col("event_type") == "error", day=day).select("id", "at", "outcome")


@query("select key, \"at\", id, value from (select user_id as key, epoch_us(ts) as \"at\", event_id as id, case when event_type = 'error' then null else event_type end as value, lead(epoch_us(ts)) over (partition by user_id order by ts, event_id) as n from events) where value is not null and (n is null or n - \"at\" >= 1800000000)")
def debounce_last(t, spark):
    events = _calls(t).join(t("events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("value")), "id")
    return limits.debounce(events, gap_us=30 * 60 * 1_000_000).select("key", "at", "id", "value")


@query("select event_id, key, case when user_id % 4 = 0 then 'hit' when row_number() over (partition by key order by ts, event_id) = 1 then 'computed' else 'shared' end as served from (select *, lower('Land ' || user_id || '|' || event_type) as key from events)")
def cache_hit_miss(t, spark):
    calls = t("events").withColumn("key", F.lower(F.concat_ws("|", F.concat(F.lit("Land "), "user_id"), "event_type")))
    return limits.single_flight(calls, calls.where("user_id % 4 = 0"), "key", ["ts", "event_id"]).select("event_id", "key", "served")


@query("select event_id, user_id from (select *, event_id // 50 as version, max(event_id // 50) over (partition by user_id) as newest from events) where version = newest")
def stale_discard(t, spark):
    return limits.latest_only(t("events").withColumn("version", F.floor(F.col("event_id") / 50)), "user_id", "version").select("event_id", "user_id")


@query("""with p as (select doc_id as key, case when quality = 0 then '' else 'labelled ' || toxic end as value from labels), s as (select doc_id as key, lang as value from documents)
select key, coalesce(nullif(p.value, ''), s.value) as value, case when nullif(p.value, '') is not null then 'primary' when s.value is not null then 'secondary' end as provider from p full join s using (key)""")
def provider_failover(t, spark):
    primary = t("labels").select(F.col("doc_id").alias("key"), F.when(F.col("quality") == 0, "").otherwise(F.concat(F.lit("labelled "), "toxic")).alias("value"))
    return provider.failover(primary, t("documents").select(F.col("doc_id").alias("key"), F.col("lang").alias("value")))


@query("""with k as (select distinct 'Land ' || user_id || ' — ' || event_type || case when user_id % 2 = 0 then ' (' || user_id % 10 || ')' else '' end as s, user_id from events), a as (select s, 'land' || user_id as key, user_id from k)
select s as subject, e.i::bigint as i, case when key like '%7' then null when key like '%9' then null else 'Era ' || e.i || ' of ' || key end as title, case when key like '%7' then 'quota' when key like '%9' then 'empty' end as error from a, (select unnest([1, 2, 3]) as i) e where not (key like '%7' or key like '%9') or e.i = 1""")
def enrichment_pipeline(t, spark):
    user = F.col("user_id")
    subject = F.concat(F.lit("Land "), user, F.lit(" — "), F.col("event_type"), F.when(user % 2 == 0, F.concat(F.lit(" ("), user % 10, F.lit(")"))).otherwise(""))
    asked = t("events").select(subject.alias("subject"), F.concat(F.lit("land"), user).alias("key")).distinct()
    good, bad = provider.valid(provider.enrich(asked, provider.fixture), "country string, eras array<struct<title:string,period:string,hook:string>>", "size(data.eras) > 0")
    eras = good.select("key", F.posexplode("data.eras").alias("i", "era")).select("key", (F.col("i") + 1).cast("bigint").alias("i"), F.col("era.title").alias("title"), F.lit(None).cast("string").alias("error"))
    answers = eras.union(bad.select("key", F.lit(1).cast("bigint"), F.lit(None).cast("string"), "error"))
    return asked.join(answers, "key").select("subject", "i", "title", "error")


@query("""select n_nationkey, arg_min(c_custkey, r) as c_custkey from (select n_nationkey, c_custkey, [case when lower(c_name) = lower('Customer#' || n_nationkey) then 0 else 1 end, c_custkey] as r from nation join customer on c_nationkey = n_nationkey) group by 1""")
def facts_pick_one(t, spark):
    both = t("customer").join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    exact = F.lower("c_name") == F.lower(F.concat(F.lit("Customer#"), "n_nationkey"))
    return both.groupBy("n_nationkey").agg(F.min_by("c_custkey", F.struct(F.when(exact, 0).otherwise(1), "c_custkey")).alias("c_custkey"))


@query(f"""with c as ({_CANDIDATE}), o as (select *, row_number() over (partition by item_id order by coalesce(idx, 9999), doc_id) as pos, (length(title) - length(replace(lower(title), 'th', ''))) // 2 as hits from c)
select item_id, doc_id, pos as rank, hits::bigint as hits from o where pos <= 4""")
def candidate_scan(t, spark):
    cached = lookup.first_by(_candidates(t, spark), ["item_id"], [F.coalesce("idx", F.lit(9999)), "doc_id"], 8)
    hits = F.floor((F.length("title") - F.length(F.replace(F.lower("title"), F.lit("th"), F.lit("")))) / 2)
    return cached.where("rank <= 4").select("item_id", "doc_id", "rank", hits.cast("bigint").alias("hits"))


@query(f"""select event_id, route, length(body)::bigint as n, type like 'text/%' and event_id % 2 = 0 and length(body) >= 600 and method <> 'HEAD' as zipped from (select event_id, method, case when path like '/api/%' then substr(path, 6) else 'static' end as route, case when path like '%.html' then 'text/html' else 'application/json' end as type, repeat('z', (event_id % 1300)::int) as body from ({_REQ}))""")
def route_requests(t, spark):
    own = _requests(t).withColumn("body", F.repeat(F.lit("z"), (F.col("event_id") % 1300).cast("int")))
    types = F.create_map(F.lit("html"), F.lit("text/html"))
    kind = F.coalesce(F.try_element_at(types, F.substring_index("path", ".", -1)), F.lit("application/json"))
    zipped = F.startswith(kind, F.lit("text/")) & (F.col("event_id") % 2 == 0) & (F.octet_length("body") >= 600) & (F.col("method") != "HEAD")
    return own.select("event_id", F.when(F.startswith("path", F.lit("/api/")), F.substring("path", 6, 100)).otherwise("static").alias("route"), F.octet_length("body").cast("bigint").alias("n"), zipped.alias("zipped"))


@query("""with l as (select user_id, arg_max(props, event_id) as saved, count(*) as n from events group by 1)
select user_id, coalesce((saved->>'k')::bigint, 0) as total, 'Day ' || n || ' — ' || format('{:,}', coalesce((saved->>'k')::bigint, 0) * 100) || '/10,000' || chr(10) || repeat('🟩', (n % 6)::int) || chr(10) || 'https://example.org/play' as share from l""")
def saved_state(t, spark):
    last = t("events").groupBy("user_id").agg(F.max_by("props", "event_id").alias("saved"), F.count("*").alias("n"))
    total = F.coalesce(F.from_json("saved", "k bigint")["k"], F.lit(0).cast("bigint"))
    first = F.concat(F.lit("Day "), F.col("n"), F.lit(" — "), F.format_number(total * 100, 0), F.lit("/10,000"))
    return last.select("user_id", total.alias("total"), F.concat_ws("\n", first, F.repeat(F.lit("🟩"), (F.col("n") % 6).cast("int")), F.lit("https://example.org/play")).alias("share"))


@query("select conv_id, turn, 'Page ' || i || ' of ' || n as page, i = 1 as first, i = n as last, greatest(0, least(n - 1, i + 2)) as clamped from (select *, row_number() over (partition by conv_id order by turn) as i, count(*) over (partition by conv_id) as n from conversations)")
def story_pages(t, spark):
    own = Window.partitionBy("conv_id")
    each = t("conversations").select("conv_id", "turn", F.count("*").over(own).alias("n"), F.row_number().over(own.orderBy("turn")).cast("bigint").alias("i"))
    return each.select("conv_id", "turn", F.concat(F.lit("Page "), "i", F.lit(" of "), "n").alias("page"), (F.col("i") == 1).alias("first"), (F.col("i") == F.col("n")).alias("last"), F.greatest(F.lit(0).cast("bigint"), F.least(F.col("n") - 1, F.col("i") + 2)).alias("clamped"))


SPOTS = [(0, 10.0, 20.0), (3, -5.0, 40.0), (8, 33.5, -70.25)]


@query(f"select c_custkey, coalesce(case when c_custkey % 5 = 0 then (c_custkey % 90)::double end, lat) as lat, coalesce(case when c_custkey % 5 = 0 then (c_custkey % 180)::double end, lng) as lng from customer left join (select k, lat::double as lat, lng::double as lng from {values(SPOTS, 'k, lat, lng')}) on c_nationkey = k")
def camera_location(t, spark):
    spots = lookup.dimension(spark, SPOTS, "k int, lat double, lng double")
    hovered = F.col("c_custkey") % 5 == 0
    own = t("customer").join(spots, F.col("c_nationkey") == F.col("k"), "left")
    return own.select("c_custkey", F.coalesce(F.when(hovered, (F.col("c_custkey") % 90).cast("double")), "lat").alias("lat"), F.coalesce(F.when(hovered, (F.col("c_custkey") % 180).cast("double")), "lng").alias("lng"))


@query("select c_custkey, c_mktsegment, c_nationkey in (0, 3, 8) as pinned from customer where c_nationkey in (0, 3, 8, 11)")
def static_points(t, spark):
    return t("customer").where(F.col("c_nationkey").isin(0, 3, 8, 11)).select("c_custkey", "c_mktsegment", F.col("c_nationkey").isin(0, 3, 8).alias("pinned"))


@query("select user_id, epoch_us(date_trunc('minute', ts)) as minute, arg_max(event_id, (ts, event_id)) as event_id from events group by 1, 2".replace("arg_max(event_id, (ts, event_id))", "arg_max(event_id, [epoch_us(ts), event_id])"))
def throttle_last(t, spark):
    own = t("events").groupBy("user_id", F.unix_micros(F.date_trunc("minute", F.col("ts").cast("timestamp"))).alias("minute"))
    return own.agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("select event_id, n - \"at\" as took, coalesce(n - \"at\" > 21600000000, true) as aborted from (select event_id, epoch_us(ts) as \"at\", lead(epoch_us(ts)) over (partition by user_id order by ts, event_id) as n from events)")
def slow_requests(t, spark):
    following = F.lead("at").over(Window.partitionBy("key").orderBy("at", "id"))
    own = _calls(t).withColumn("took", following - F.col("at"))
    return own.select(F.col("id").alias("event_id"), "took", F.coalesce(F.col("took") > 6 * 3600 * 1_000_000, F.lit(True)).alias("aborted"))


_QUEUE = [(seed, i, int(k)) for seed, first in GOLDEN for i, k in enumerate(first.split(","))]


@query(f"select seed::bigint as seed, i::bigint as i, p_partkey, p_name from {values(_QUEUE, 'seed, i, k')} join (select p_partkey, p_name, row_number() over (order by p_partkey) - 1 as ordinal from part) on ordinal = k")
def daily_rounds(t, spark):
    """The rounds of a day's game by their place among all rounds."""
    picked = lookup.dimension(spark, [(s,) for s, _ in GOLDEN], "seed bigint").select("seed", F.posexplode(F.slice(S.permutation(F.col("seed"), 44), 1, 5)).alias("i", "k"))
    # Places under 44 are found among the first 44 rounds: no order of all is needed.
    first = t("part").select("p_partkey", "p_name").orderBy("p_partkey").limit(44)
    places = first.withColumn("k", F.row_number().over(Window.orderBy("p_partkey")) - 1)
    return picked.join(places, "k").select("seed", F.col("i").cast("bigint").alias("i"), "p_partkey", "p_name")


@query("""select c_custkey, round(degrees(case when rho = 0 then radians(30.0) else asin(cos(c) * sin(radians(30)) + y * sin(c) * cos(radians(30)) / rho) end), 6) + 0 as lat from (
 select *, sqrt(x * x + y * y) as rho, case when x * x + y * y <= 1 then asin(sqrt(x * x + y * y)) end as c from (select c_custkey, (c_custkey % 41 - 20) / 16.0 as x, (c_custkey % 37 - 18) / 16.0 as y from customer)) where true""")
def inverse_projection(t, spark):
    own = t("customer").select("c_custkey", ((F.col("c_custkey") % 41 - 20) / 16.0).alias("x"), ((F.col("c_custkey") % 37 - 18) / 16.0).alias("y"))
    lat, _ = S.orthographic_inverse(F.col("x"), F.col("y"), F.lit(30.0), F.lit(20.0))
    return own.select("c_custkey", (F.round(lat, 6) + 0.0).alias("lat"))


@query("""with c as (select conv_id, turn, row_number() over (partition by conv_id order by turn) - 1 as page, dense_rank() over (order by conv_id) as era, count(*) over (partition by conv_id) as n from conversations)
select conv_id, turn, case when page + 1 < n then conv_id else (select min(d.conv_id) from conversations d where d.conv_id > c.conv_id) end as next_era, case when page + 1 < n then page + 1 when conv_id < (select max(conv_id) from conversations) then 0 end as next_page,
 case when page > 0 then conv_id else (select max(d.conv_id) from conversations d where d.conv_id < c.conv_id) end as last_era, case when page > 0 then page - 1 when conv_id > (select min(conv_id) from conversations) then 0 end as last_page from c""")
def page_rollover(t, spark):
    """Turning the page beyond an era's edge leads to page 0 of the neighbouring era, in both directions."""
    own = Window.partitionBy("conv_id")
    pages = t("conversations").select("conv_id", "turn", (F.row_number().over(own.orderBy("turn")) - 1).cast("bigint").alias("page"), F.count("*").over(own).alias("n"))
    # Neighbours by place, found by a range sort and a join; a window over all eras would be one task.
    eras = t("conversations").groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id")
    near = lookup.neighbours(eras, "conv_id")
    nxt, prev = F.col("page") + 1 < F.col("n"), F.col("page") > 0
    return pages.join(near, "conv_id").select("conv_id", "turn", F.when(nxt, F.col("conv_id")).otherwise(F.col("after")).alias("next_era"), F.when(nxt, F.col("page") + 1).when(F.col("after").isNotNull(), 0).cast("bigint").alias("next_page"), F.when(prev, F.col("conv_id")).otherwise(F.col("before")).alias("last_era"), F.when(prev, F.col("page") - 1).when(F.col("before").isNotNull(), 0).cast("bigint").alias("last_page"))


_ENDPOINT = f"""with r as ({_REQ.replace("select event_id,", "select event_id, user_id, ts,")}),
q as (select *, method = 'HEAD' and path like '/api/%' as head, {_STATUS} = 400 as bad, lower(trim(country)) || '|' || path || '|' || trim(era) as k, event_type = 'error' as failed from r join (select event_id, event_type from events) using (event_id)),
c as (select *, path like '/api/%' and not head and not bad as asks from q),
h as (select *, row_number() over (partition by k, asks and not failed order by ts, event_id) as n, min(case when asks and not failed then ts end) over (partition by k) as filled from c),
d as (select *, asks and not (not failed and n > 1) and not (failed and coalesce(filled < ts, false)) as calls from h),
b as (select *, coalesce(sum(case when calls and not failed then 1 else 0 end) over (partition by ts::date order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as spent from d)
select event_id, case when head then 'head' when path not like '/api/%' then 'static' when bad then 'rejected' when not calls then 'hit' when spent >= 40 then 'quota' when failed then 'refunded' else 'computed' end as step,
 case when head or path not like '/api/%' then 200 when bad then 400 when not calls then 200 when spent >= 40 then 429 when failed then 502 else 200 end as status from b"""


@query(_ENDPOINT)
def endpoint_order(t, spark):
    """What answers a request: a HEAD, a file, validation, the cache, the day's quota, a failed call that is refunded, or a call.

    The cache of a key is filled by its first request that does not fail.
    """
    events = t("events").select("event_id", (F.col("event_type") == "error").alias("failed"))
    country, era, period, api = F.trim("country"), F.trim("era"), F.trim("period"), F.startswith("path", F.lit("/api/"))
    bad = api & (F.col("method") != "HEAD") & ((country == "") | (F.length(country) > 60) | ((F.col("path") == "/api/story") & ((era == "") | (F.length(era) > 80) | (F.length(period) > 40))))
    asked = _requests(t).join(events, "event_id").select("event_id", "ts", "failed", (api & (F.col("method") == "HEAD")).alias("head"), api.alias("api"), bad.alias("bad"), F.concat_ws("|", F.lower(country), "path", era).alias("k"))
    asked = asked.withColumn("asks", F.col("api") & ~F.col("head") & ~F.col("bad"))
    ready = F.col("asks") & ~F.col("failed")
    n = F.row_number().over(Window.partitionBy("k", ready).orderBy("ts", "event_id"))
    filled = F.min(F.when(ready, F.col("ts"))).over(Window.partitionBy("k"))
    calls = F.col("asks") & ~(~F.col("failed") & (n > 1)) & ~(F.col("failed") & F.coalesce(filled < F.col("ts"), F.lit(False)))
    called = asked.withColumn("calls", calls)
    paid = limits.daily_quota(called.where("calls").withColumn("at", F.col("ts")).withColumn("id", F.col("event_id")), cap=40, failed=F.col("failed"), day=F.to_date("ts")).select("event_id", "outcome")
    both = called.join(paid, "event_id", "left")
    step = F.when(F.col("head"), "head").when(~F.col("api"), "static").when(F.col("bad"), "rejected").when(~F.col("calls"), "hit").when(F.col("outcome") == "rejected", "quota").when(F.col("outcome") == "refunded", "refunded").otherwise("computed")
    return both.select("event_id", step.alias("step")).select("event_id", "step", F.when(F.col("step") == "rejected", 400).when(F.col("step") == "quota", 429).when(F.col("step") == "refunded", 502).otherwise(200).alias("status"))
