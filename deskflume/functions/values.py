"""Small column functions: labels, dates, masks, mail, JSON fields, vectors."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seniority levels, lowest first; outside of them stands STANDALONE.
LEVELS = ("JUNIOR", "MID", "SENIOR")
#: White space as the texts' tools see it, beyond ASCII as well (the body of a character class).
SPACES = r"\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def rounded(x: Column, places: int) -> Column:
    """A double rounded as DuckDB does: its product with the power of ten decides, not its shortest decimal
    form, so 1.03625 gives 1.0362 (the product is below 10362.5) where Spark's own round gives 1.0363."""
    return F.round(x * float(10**places)) / float(10**places)


def shape(text: Column) -> Column:
    """Capitals as A and figures as N, each; runs of lower-case letters as a with their length, one letter
    as a: ana-X1 gives a{3}-AN. Other characters stay."""
    runs = F.regexp_extract_all(text, F.lit("[a-z]+|[^a-z]+"), F.lit(0))
    masked = F.transform(runs, lambda r: F.when(~r.rlike("^[a-z]"), F.regexp_replace(F.regexp_replace(r, "[A-Z]", "A"), "[0-9]", "N")).when(F.length(r) == 1, "a").otherwise(F.concat(F.lit("a{"), F.length(r), F.lit("}"))))
    return F.array_join(masked, "")


def retreat(text: Column, n: int) -> Column:
    """At most ``n`` characters, back to the last full stop or line end where there is one."""
    head = F.substring(text, 1, n)
    back = F.regexp_extract(head, r"(?s)^(.*[.\n])", 1)
    return F.when(F.length(text) <= n, text).when(back != "", back).otherwise(head)


def sample_text(text: Column, n: int) -> Column:
    """Of texts over ``n`` characters 60 % of these from the head, 20 % from the middle, the rest from the tail.
    White space before line ends goes first."""
    text = F.regexp_replace(text, f"[{SPACES}]+\n", "\n")
    a, b = n * 6 // 10, n * 2 // 10
    middle = F.substring(text, F.floor((F.length(text) - b) / 2).cast("int") + 1, F.lit(b))
    return F.when(F.length(text) <= n, text).otherwise(F.concat_ws("\n\n[…]\n\n", F.substring(text, 1, a), middle, F.substring(text, -(n - a - b), n - a - b)))


def reply_subject(number: Column, title: Column, desk: str = "Desk", most: int = 80) -> Column:
    """Re: [desk] #number title, by which an answer finds its ticket again; long titles are cut."""
    flat = F.regexp_replace(F.regexp_replace(title, f"[{SPACES}]+", " "), "^ | $", "")
    short = F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).otherwise(flat)
    return F.rtrim(F.concat(F.lit(f"Re: [{desk}] #"), number.cast("string"), F.lit(" "), short))


def edited(original: Column, sent: Column) -> Column:
    """Whether a reply was changed before it was sent, but for line ends and outer white space."""

    def plain(x):
        return F.regexp_replace(F.replace(x, F.lit("\r\n"), F.lit("\n")), f"^[{SPACES}]+|[{SPACES}]+$", "")

    return plain(original) != plain(sent)


def distinct_topics(topics: Column) -> Column:
    """Without repeats in another case; the first spelling stays, in order."""
    return F.aggregate(topics, F.array().cast("array<string>"), lambda kept, x: F.when(F.exists(kept, lambda y: F.lower(y) == F.lower(x)), kept).otherwise(F.array_append(kept, x)))


def loose_json(text: Column, schema: str) -> Column:
    """What stands between the first { and the last }, read by the schema; null where it is no JSON."""
    return F.from_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1), schema)


def quarter_label(day: Column, offset: int) -> Column:
    moved = F.add_months(F.date_trunc("quarter", day), 3 * offset)
    return F.concat(F.lit("Q"), F.quarter(moved), F.lit(" "), F.year(moved))


def epoch_millis(day: Column) -> Column:
    return F.unix_date(day).cast("long") * 86_400_000


def _two(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def duration_label(millis: Column) -> Column:
    """<1s, 42s, 3m 05s, 1h 12m: seconds rounded, hours without an end."""
    s = F.floor(millis / 1000 + 0.5)
    m = F.floor(s / 60)
    return (
        F.when(millis < 1000, "<1s").when(s < 60, F.concat(s, F.lit("s")))
        .when(m < 60, F.concat(m, F.lit("m "), _two(s % 60), F.lit("s"))).otherwise(F.concat(F.floor(m / 60), F.lit("h "), _two(m % 60), F.lit("m")))
    )


def gap_label(millis: Column) -> Column:
    """+0.4s below ten seconds, else + and the duration; never negative."""
    millis = F.greatest(millis, F.lit(0))
    return F.when(millis < 10_000, F.concat(F.lit("+"), F.floor((millis + 50) / 1000).cast("string"), F.lit("."), F.pmod(F.floor((millis + 50) / 100), F.lit(10)).cast("string"), F.lit("s"))).otherwise(F.concat(F.lit("+"), duration_label(millis)))


def elapsed_millis(created: Column, completed: Column, now: Column) -> Column:
    """Until the end, or until now while it runs; null if now is not known; never negative."""
    return F.greatest(F.timestamp_diff("MILLISECOND", created, F.coalesce(completed, now)), F.lit(0))


def sla_label(state: Column, seconds: Column) -> Column:
    """Time left until a due time, or time over, in the largest unit, rounded; a dash without one, Met for kept ones."""
    delta = F.floor(seconds / 60 + 0.5)
    size = F.abs(delta)
    text = (
        F.when(size >= 1440, F.concat(F.floor(size / 1440 + 0.5), F.lit("d"))).when(size >= 60, F.concat(F.floor(size / 60 + 0.5), F.lit("h")))
        .otherwise(F.concat(size, F.lit("m")))
    )
    return F.when((state == "none") | seconds.isNull(), "—").when(state == "met", "Met").otherwise(F.concat(text, F.when(delta >= 0, " left").otherwise(" over")))


def staleness(state: Column, complete: Column, latest: Column, now: Column) -> Column:
    """How old a source's last whole crawl is; null where it is as new as the latest one, or none is known."""
    hours = F.floor(F.timestamp_diff("SECOND", complete, now) / 3600)
    age = F.when(hours < 1, "less than an hour ago").when(hours < 24, F.concat(hours, F.lit("h ago"))).otherwise(F.concat(F.floor(hours / 24), F.lit("d ago")))
    return F.when(state == "UNREACHABLE", "unavailable now").when(complete < latest, age)


def freshness(hours: Column) -> Column:
    """Which upkeep is due: metadata after a day, samples after 30 days, removal after 90."""
    return F.struct((hours >= 24).alias("tier1_due"), (hours >= 24 * 30).alias("resample_due"), (hours > 24 * 90).alias("expired"))


def idf_bucket(share: Column) -> Column:
    return F.when(share <= 0.05, "rare").when(share <= 0.25, "uncommon").otherwise("common")


def third(x: Column, low: float, high: float) -> Column:
    return F.when(x < low, "low").when(x < high, "medium").otherwise("high")


def rank_of(level: Column) -> Column:
    """0 for the lowest level and for unknown ones."""
    return F.greatest(F.array_position(F.array(*map(F.lit, LEVELS)), level).cast("int") - 1, F.lit(0))


def least_level(priority: Column) -> Column:
    return F.when(priority == "URGENT", "SENIOR").when(priority == "HIGH", "MID").otherwise("JUNIOR")


def next_level(level: Column) -> Column:
    """The level above; null above the highest."""
    return F.get(F.array(*map(F.lit, LEVELS)), rank_of(level) + 1)


def eligible(tier: Column, level: Column) -> Column:
    """Whether a member may take what stands at a level."""
    return (tier == "STANDALONE") | (rank_of(tier) >= rank_of(level))


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def hashed_vector(text: Column, size: int, padded: int) -> Column:
    """Word counts in ``size`` places by the first two bytes of the words' SHA-256, of length 1, padded with zeros."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9][a-z0-9-]+"), F.lit(0))
    places = F.transform(words, lambda w: F.conv(F.substring(F.sha2(w, 256), 1, 4), 16, 10).cast("int") % size)

    def counted(places):
        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.size(F.filter(places, lambda p: p == k)).cast("double"))

    def unit(x):
        return F.transform(x["counts"], lambda n: F.when(x["norm"] > 0, n / x["norm"]).otherwise(0.0))

    counts = _once(places, counted)
    normed = _once(counts, lambda c: F.struct(c.alias("counts"), F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x)).alias("norm")))
    return F.concat(_once(normed, unit), F.array_repeat(F.lit(0.0), padded - size))


def locator(sheet: Column, cells: Column, page: Column, page_end: Column, lines: Column) -> Column:
    """Where a passage stands, for readers: a sheet with its cells, a page or a span of pages, or lines."""
    span = F.when(page_end > page, F.concat(F.lit("-"), page_end)).otherwise("")
    on_sheet = F.concat_ws(" ", F.lit("sheet"), sheet, F.nullif(cells, F.lit("")))
    return F.when(sheet != "", on_sheet).when(page >= 1, F.concat(F.lit("page "), page, span)).when(lines != "", F.concat(F.lit("lines "), lines)).otherwise("location unknown")


def draft_query(text: Column, stopwords: tuple[str, ...]) -> Column:
    """The first 12 distinct words of the first 400 characters that are no stop words."""
    words = F.regexp_extract_all(F.lower(F.substring(F.coalesce(text, F.lit("")), 1, 400)), F.lit("[a-z0-9][a-z0-9-]{2,}"), F.lit(0))
    return F.array_join(F.slice(F.array_distinct(F.filter(words, lambda w: ~w.isin(*stopwords))), 1, 12), " ")


def external_entity(xml: Column) -> Column:
    """Whether the first 4096 characters declare an entity that stands elsewhere."""
    head = F.substring(xml, 1, 4096)
    return head.rlike("(?i)<!DOCTYPE") & head.rlike("(?i)<!ENTITY[^>]*SYSTEM")


def strings_only(text: Column) -> Column:
    """The strings of a JSON list; none where it is no list."""
    parsed = F.try_parse_json(text)
    items = F.try_variant_get(parsed, "$", "array<variant>")
    strings = F.filter(items, lambda v: F.schema_of_variant(v) == "STRING")
    return F.coalesce(F.transform(strings, lambda v: F.try_variant_get(v, "$", "string")), F.array().cast("array<string>"))


def presence(listed: Column, read: Column) -> Column:
    """Of a table: gone from the catalogue, listed but not readable any more, or neither."""
    return F.when(~listed, "DROPPED").when(~read, "UNREADABLE").otherwise("OK")


def assumption_note(kind: Column, text: Column, day: Column) -> Column:
    """What an assumed fact rests on: the order of day and month, the currency, or the document's day."""
    figures = text.rlike(r"^[0-9]{1,2} *[./-] *[0-9]{1,2} *[./-] *[0-9]{2,4}$")
    return (
        F.when(kind == "MONEY", "Currency assumed: defaultCurrency.")
        .when((kind == "DATE") & figures, "Day/month order assumed: dateOrder = DMY.")
        .when(kind == "DATE", F.concat(F.lit("Relative to the document's day, "), day, F.lit(".")))
        .otherwise("Assumed by a default rule.")
    )
