"""Column functions: strings, formats, dates, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Terms that mark a dull title.
JUNK_TERMS = (
    r"\bmaps?\b", r"\batlas\b", r"\bcarte\b", r"\bkarte\b", r"\bmapa\b", r"cadastr", r"\bsurvey\b", r"locator", r"\bflags?\b", r"coat[\s_-]?of[\s_-]?arms", r"\bseal\b", r"\bemblem", r"\blogo", r"\bdiagram", r"\bcharts?\b", r"flowchart",
    r"\bicon\b", r"orthographic", r"\blocation\b", r"topograph", r"administ", r"\bblank\b", r"\boutline\b", r"\bgpx\b", r"wikimedia", r"spreadsheet", r"\bsignature\b", r"\bplan\b", r"schematic", r"\bsketch\b", r"\bstamps?\b", r"banknote", r"postcard",
    r"\bposter\b", r"caricature", r"infographic", r"screenshot", r"chronolog", r"\btimeline", r"genealog", r"family[\s_-]?tree",
)
#: Epoch of day numbers.
DAY_ONE = "2026-01-01"


def some(c: Column) -> Column:
    """c, or null where it is empty: what counts as missing in the source's logic."""
    return F.nullif(c, F.lit(""))


def first_of(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(some(c) for c in columns))


def half_up(c: Column) -> Column:
    """Rounds to a whole number, halves upwards also below zero."""
    return F.floor(c + 0.5)


def junk_pattern(terms: tuple[str, ...] = JUNK_TERMS) -> str:
    """A case-insensitive pattern of the terms, whose word bounds know ASCII letters, digits and underscores only."""
    word = "[A-Za-z0-9_]"
    return "(?i)(?:" + "|".join(t.replace(r"\b", f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))") for t in terms) + ")"


def is_junk(title: Column) -> Column:
    return title.rlike(junk_pattern())


# Entities.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))


def escape_html(c: Column, null: str = "null") -> Column:
    """Markup as text; null: what stands for null."""
    c = F.coalesce(c, F.lit(null))
    for char, entity in ENTITIES:
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def fallback_query(country: Column, era: Column) -> Column:
    """The search for an era when its own found nothing."""
    return F.trim(F.concat_ws(" ", F.coalesce(country, F.lit("")), F.coalesce(era, F.lit(""))))


def full_image(thumb: Column, url: Column) -> Column:
    """The address of a large picture: the thumbnail's at a width of 1280, where it has a width, else the file's, else the thumbnail's."""
    sized = r"/\d+px-"
    return F.when(thumb.rlike(sized), F.regexp_replace(thumb, rf"^(.*?){sized}(.*)$", "$1/1280px-$2")).otherwise(first_of(url, thumb))


def clean_subject(c: Column) -> Column:
    """White space collapsed, trimmed, first letter upper case."""
    c = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 2**31 - 1))


def subject_caption(subject: Column, country: Column) -> Column:
    """The subject without the country at its end; never blank."""
    tail = F.concat(F.lit(" "), F.lower(country))
    cut = F.when(F.endswith(F.lower(subject), tail), F.trim(F.substr(subject, F.lit(1), F.length(subject) - F.length(tail)))).otherwise(subject)
    return F.coalesce(some(cut), subject)


def title_caption(title: Column) -> Column:
    """A readable caption from a file title."""
    c = F.when(F.contains(title, F.lit(":")), F.substr(title, F.locate(":", title) + 1)).otherwise(F.lit(""))
    c = F.trim(F.replace(F.regexp_replace(c, r"\.[^.]+$", ""), F.lit("_"), F.lit(" ")))
    c = F.element_at(F.split(c, r"\s[-–—]\s", 2), 1)
    c = F.regexp_replace(c, r"\([^)]*\d[^)]*\)", "")
    c = F.regexp_replace(c, r"(?is)^(.*?),?\s*photo\s+\d+\s+of\s+\d+(.*)$", "$1$2")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\s{2,}", " "), r"[,\s]+$", ""))


def roman(n: Column) -> Column:
    """Roman numerals of X and less: 40 is XXXX."""
    ones = F.array(*(F.lit(x) for x in ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX")))
    n = n.cast("int")
    return F.concat(F.repeat(F.lit("X"), F.floor(n / 10).cast("int")), F.element_at(ones, n % 10 + 1))


def format_year(y: Column) -> Column:
    return F.when(y < 0, F.concat(F.abs(y).cast("string"), F.lit(" BCE"))).otherwise(F.concat(y.cast("string"), F.lit(" CE")))


def format_km(km: Column) -> Column:
    return F.when(km < 1, "less than 1 km").when(km < 20, F.concat(half_up(km).cast("string"), F.lit(" km"))).otherwise(F.concat(F.format_number(half_up(km), 0), F.lit(" km")))


def encode_component(c: Column) -> Column:
    """Percent-encoding as browsers do for a component of a URL."""
    c = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        c = F.replace(c, F.lit(code), F.lit(char))
    return c


def query_value(url: Column, name: str) -> Column:
    """The first value of a query parameter, decoded and trimmed."""
    return F.trim(F.try_url_decode(some(F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1))))


def fragment(url: Column) -> Column:
    """What follows the first #, decoded and trimmed."""
    return F.trim(F.try_url_decode(F.when(F.contains(url, F.lit("#")), F.substr(url, F.locate("#", url) + 1)).otherwise("")))


def client_ip(forwarded: Column, peer: Column) -> Column:
    """The last hop of X-Forwarded-For, else the peer."""
    return F.coalesce(some(F.trim(F.element_at(F.split(forwarded, ","), -1))), peer)


def day_number(ts: Column) -> Column:
    return F.datediff(F.to_date(ts), F.lit(DAY_ONE).cast("date")) + 1


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * 6371 * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def location_score(km: Column) -> Column:
    return half_up(5000 * F.exp(-km / 1500)).cast("bigint")


def time_score(years: Column, tolerance: Column) -> Column:
    return half_up(5000 * F.exp(-F.abs(years) / tolerance)).cast("bigint")


def tier(score: Column) -> Column:
    """An emoji for the score of a round."""
    return F.when(score >= 9000, "🟩").when(score >= 7000, "🟨").when(score >= 4000, "🟧").when(score >= 1500, "🟥").otherwise("⬛")


def rank_title(total: Column, most: Column) -> Column:
    return F.when(total >= most * 0.8, "Master Chronologist").when(total >= most * 0.6, "Seasoned Time Traveller").when(total >= most * 0.4, "Budding Explorer").otherwise("Wide-eyed Novice")


def permutation(seed: Column, n: int) -> Column:
    """A seeded shuffle of 0..n-1: Fisher-Yates on a 32-bit generator, in one expression."""
    mask = 0xFFFFFFFF
    low = lambda x: x.bitwiseAND(F.lit(mask))
    signed = lambda x: F.shiftright(F.shiftleft(x, 32), 32)
    shift = lambda x, k: F.shiftright(low(x), k)
    times = lambda x, y: low(signed(x) * signed(y))  # noqa: E731  products of signed 32-bit numbers fit 64 bits

    def step(state: Column, i: Column) -> Column:
        a = low(state["a"] + F.lit(0x6D2B79F5))
        t = times(a.bitwiseXOR(shift(a, 15)), a.bitwiseOR(F.lit(1).cast("bigint")))
        t = low(t.bitwiseXOR(low(t + times(t.bitwiseXOR(shift(t, 7)), t.bitwiseOR(F.lit(61).cast("bigint"))))))
        r = t.bitwiseXOR(shift(t, 14))
        j = F.floor(r.cast("double") / 4294967296.0 * (i + 1)).cast("int")
        p = state["p"]
        swapped = F.transform(p, lambda x, k: F.when(k == i, F.get(p, j)).when(k == j, F.get(p, i)).otherwise(x))
        return F.struct(a.alias("a"), swapped.alias("p"))

    start = F.struct(low(seed.cast("bigint")).alias("a"), F.sequence(F.lit(0), F.lit(n - 1)).alias("p"))
    return F.aggregate(F.sequence(F.lit(n - 1), F.lit(1), F.lit(-1)), start, step)["p"]


def wrap_longitude(lng: Column) -> Column:
    """Into [-180, 180)."""
    return F.pmod(lng + 180, F.lit(360)) - 180


def orthographic(lat: Column, lng: Column, lat0: Column, lng0: Column) -> tuple[Column, Column, Column]:
    """x, y on the unit disc and whether the point is on the near side."""
    f, d, f0 = F.radians(lat), F.radians(lng - lng0), F.radians(lat0)
    return F.cos(f) * F.sin(d), F.cos(f0) * F.sin(f) - F.sin(f0) * F.cos(f) * F.cos(d), F.sin(f0) * F.sin(f) + F.cos(f0) * F.cos(f) * F.cos(d) >= 0


def orthographic_inverse(x: Column, y: Column, lat0: Column, lng0: Column) -> tuple[Column, Column]:
    """lat and lng of a point of the disc; null outside it, the centre itself at its middle."""
    rho = F.sqrt(x * x + y * y)
    c, f0 = F.asin(rho), F.radians(lat0)
    lat = F.degrees(F.asin(F.cos(c) * F.sin(f0) + y * F.sin(c) * F.cos(f0) / rho))
    lng = lng0 + F.degrees(F.atan2(x * F.sin(c), rho * F.cos(c) * F.cos(f0) - y * F.sin(c) * F.sin(f0)))
    return F.when(rho > 1, None).when(rho == 0, lat0).otherwise(lat), F.when(rho > 1, None).when(rho == 0, lng0).otherwise(wrap_longitude(lng))


def image_score(relevance: Column, mime: Column, width: Column, height: Column, position: Column) -> Column:
    """Share of the query in the title first; form and size, and place in the search, decide among equals."""
    known = (F.coalesce(width, F.lit(0)) > 0) & (F.coalesce(height, F.lit(0)) > 0)
    area = F.when(known, (width * height).cast("double")).otherwise(250000.0)
    ratio = F.when(known, F.least(width, height) / F.greatest(width, height)).otherwise(0.6)
    return relevance * 6 + F.when(mime == "image/jpeg", 4).otherwise(0) + F.log(area) * 0.55 + ratio - position * 0.25
