"""Typed facts in text: dates, amounts, durations, codes, addresses, links, quantities.

A small Arrow function finds candidates, one pass a pattern and linear in the text; Spark expressions give
their meaning (norm, number and unit, an interval of days) and drop those that have none; a second
small function lets the longest of overlapping candidates stand, then the order of KINDS, then the place
(a sweep over a sorted list). At most MOST facts of a text stay, the first ones, in order.

Days are half-open intervals of UTC milliseconds. What a text leaves open is decided by rule and
marked ASSUMED: day before month where figures allow both, US dollars for a bare $, and words such as
"yesterday" count from the day that the caller gives.

Defined results: null and empty texts have no facts; offsets and lengths are in code points, of whole
texts; of dates, amounts and durations of one value only the first counts; URLs lose user, default port,
query and fragment, their escapes stay as written; rows of one id are read each.
"""

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

#: Kinds in order of precedence.
KINDS = ("URL", "EMAIL", "IDENTIFIER", "MONEY", "DATE", "DURATION", "QUANTITY")
#: Names of months in two languages; relative days; currencies with sign and decimals; units of time and of quantities.
MONTHS = (
    ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"),
    ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"),
)
RELATIVE = {"yesterday": -1, "tomorrow": 1, "today": 0, "last month": -30, "next month": 30, "last week": -7, "next week": 7}
CURRENCIES = {"USD": ("$", 2), "EUR": ("€", 2), "GBP": ("£", 2), "JPY": ("¥", 0), "CHF": ("CHF", 2), "CLP": ("CLP$", 0), "COP": ("COL$", 2), "MXN": ("MX$", 2), "BRL": ("R$", 2), "CAD": ("CA$", 2), "INR": ("INR", 2), "SEK": ("SEK", 2)}
TIMES = {"W": (604800, ("week", "semana")), "D": (86400, ("day", "dia", "día")), "H": (3600, ("hour", "hora", "hr", "h")), "M": (60, ("minute", "minuto", "min", "m")), "S": (1, ("second", "segundo", "sec", "s"))}
#: Units that have no plural.
SHORT = ("h", "m", "s")
UNITS = ("%", "kg", "mg", "lb", "oz", "km", "cm", "mm", "mi", "ft", "kib", "mib", "gib", "tib", "kb", "mb", "gb", "tb", "ml", "px", "°c", "°f")
ASSUMED_CURRENCY = "USD"
MOST = 64
DAY = 86_400_000

_S = r"[\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
_NAME = "(" + "|".join(n for names in MONTHS for n in names) + ")"
_NTH = "(?:st|nd|rd|th)?"
_AMOUNT = r"(-?\d{1,3}(?:[.,]\d{3})+(?:[.,]\d{1,2})?|-?\d+(?:[.,]\d{1,2})?)"
_SIGNS = "|".join(re.escape(s) for s in sorted((s for s, _ in CURRENCIES.values()), key=len, reverse=True))
_CODES = "|".join(CURRENCIES)
_TIME = "|".join(w if w in SHORT else w.replace("í", "[íÍ]") + "s?" for _, words in TIMES.values() for w in words)
#: (kind, how it is read, pattern), in the order in which repeated values are dropped; groups are a, b, c, ...
RULES = (
    ("DATE", "iso", r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b"),
    ("DATE", "figures", r"\b(\d{1,2})[./](\d{1,2})[./](\d{4})\b"),
    ("DATE", "named", rf"(?i){_NAME}{_S}{{0,3}}(\d{{1,2}}){_NTH},?{_S}{{0,3}}(\d{{4}})|(\d{{1,2}}){_NTH}{_S}{{0,3}}(?:de{_S}{{0,3}})?{_NAME}(?:,?{_S}{{0,3}}|{_S}{{0,3}}de{_S}{{0,3}})(\d{{4}})"),
    ("DATE", "month", rf"(?i)\b{_NAME}{_S}{{0,3}}(?:de{_S}{{0,3}})?(\d{{4}})\b"),
    ("DATE", "quarter", r"(?i)\bQ([1-4])[ -]?(\d{4})\b"),
    ("DATE", "relative", r"(?i)\b(" + "|".join(RELATIVE) + r")\b"),
    ("MONEY", "sign", rf"({_SIGNS}){_S}{{0,2}}{_AMOUNT}\b"),
    ("MONEY", "before", rf"\b{_AMOUNT}{_S}{{0,2}}({_CODES})\b"),
    ("MONEY", "behind", rf"\b({_CODES}){_S}{{0,2}}{_AMOUNT}\b"),
    ("DURATION", "words", rf"(?i)\b(\d{{1,6}}){_S}{{0,2}}({_TIME})\b"),
    ("DURATION", "coded", r"\bP(?:(\d{1,3})W)?(?:(\d{1,3})D)?(?:T(?:(\d{1,3})H)?(?:(\d{1,3})M)?(?:(\d{1,3})S)?)?\b"),
    ("IDENTIFIER", "code", r"\b(?:[A-Za-z0-9]+(?:[-_/.][A-Za-z0-9]+){1,3}|[A-Za-z]{2,}[0-9]{3,})\b|#[0-9]{2,}\b"),
    ("EMAIL", "address", r"@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("URL", "link", r"(?i)\bhttps?://[^<>\"')\]" + _S[1:-1] + "]+"),
    ("QUANTITY", "unit", rf"(?i)(?<!\d)(\d++(?:[.,]\d++)?+){_S}?({'|'.join(UNITS)})(?=[^a-z0-9]|$)"),
)
#: What a text must hold for a pattern to be tried.
GATES = {"iso": "-", "figures": "./", "quarter": "Qq", "coded": "P", "address": "@", "link": ("://",), "sign": [s for s, _ in CURRENCIES.values()], "before": list(CURRENCIES), "behind": list(CURRENCIES)}
_READ = [how for _, how, _ in RULES]
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_GROUPS = "abcde"
#: Texts without any of these have no fact.
_SIGN_OF_ONE = r"(?i)[0-9@]|://|yesterday|tomorrow|today|(?:last|next) (?:month|week)"
_CANDIDATE = pa.struct([("rule", pa.int32()), ("start", pa.int32()), ("text", pa.string()), ("before", pa.string()), *[(g, pa.string()) for g in _GROUPS]])


def _addresses(text: str, domain: re.Pattern):
    """(start, end) of mail addresses. Each @ looks back over its own run of characters only."""
    floor = 0
    at = text.find("@")
    while at >= 0:
        begin = floor + len(text[floor:at].rstrip(_LOCAL))
        while begin < at and not re.compile(r"\b", re.A).match(text, begin):
            begin += 1
        m = domain.match(text, at) if begin < at else None
        if m:
            yield begin, m.end()
        floor = m.end() if m else at + 1
        at = text.find("@", floor)


def candidates(text: Column) -> Column:
    """Array of candidates by rule and place: rule, start, text, groups, and for months the 8 characters before."""

    @F.arrow_udf("array<struct<rule:int,start:int,text:string,before:string,a:string,b:string,c:string,d:string,e:string>>")
    def scan(texts: pa.Array) -> pa.Array:
        rules = [(k, how, re.compile(p, re.A), GATES.get(how)) for k, (_, how, p) in enumerate(RULES)]
        month = re.compile(f"(?i){_NAME}", re.A)
        columns, offsets = [[] for _ in _CANDIDATE], [0]
        for t in texts.to_pylist():
            named = bool(t) and month.search(t) is not None
            for k, how, rule, gate in rules if t else ():
                if gate and not any(x in t for x in gate) or not named and how in ("named", "month"):
                    continue
                if how == "address":
                    spans = ((a, b, ()) for a, b in _addresses(t, rule))
                else:
                    spans = ((*m.span(), [g for g in m.groups() if g is not None] if how == "named" else m.groups()) for m in rule.finditer(t))
                for a, b, groups in spans:
                    row = (k, a, t[a:b], t[max(0, a - 8) : a] if how == "month" else None, *groups, *[None] * (len(_GROUPS) - len(groups)))
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
            offsets.append(len(columns[0]))
        rows = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _CANDIDATE, strict=True)], fields=list(_CANDIDATE))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)

    return scan(text)


@F.arrow_udf(ArrayType(IntegerType()))
def _standing(starts: pa.Array, lengths: pa.Array, ranks: pa.Array, keys: pa.Array) -> pa.Array:
    """Places, in order of the text, of the candidates that stand."""
    out = []
    for s, n, r, k in zip(starts.to_pylist(), lengths.to_pylist(), ranks.to_pylist(), keys.to_pylist(), strict=True):
        seen, own = set(), []
        for i, key in enumerate(k or ()):
            if key is None or key not in seen:
                seen.add(key)
                own.append(i)
        kept: list[tuple[int, int, int]] = []  # (start, end, place), sorted
        for i in sorted(own, key=lambda i: (-n[i], r[i], s[i])):
            at = bisect_left(kept, (s[i],))
            if not (at < len(kept) and kept[at][0] < s[i] + n[i]) and not (at and kept[at - 1][1] > s[i]):
                kept.insert(at, (s[i], s[i] + n[i], i))
        out.append([i for _, _, i in kept[:MOST]])
    return pa.array(out, pa.list_(pa.int32()))


def _look(values: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def amount(raw: Column, decimals: Column) -> Column:
    """Minor units of an amount in figures: the last of both separators is the decimal one; a single
    one is if at most ``decimals`` digits follow, and groups thousands if three do; else null."""
    body = F.regexp_replace(raw, "^-", "")
    tail = F.regexp_extract(body, "[.,]([0-9]*)$", 1)
    head = F.regexp_replace(body, "[.,][0-9]*$", "")
    both, n = body.contains(".") & body.contains(","), F.length(tail)
    decimal = both | ((n == decimals) & (decimals > 0))
    grouped = (n == 3) & ((decimals == 0) | (F.length(body) > 4))
    whole = F.when(~body.rlike("[.,]"), body).when(decimal, head).when(grouped, F.concat(head, tail)).when(n <= decimals, head)
    rest = F.when(body.rlike("[.,]") & (decimal | ~grouped), tail).otherwise("")
    whole = F.regexp_replace(whole, "[.,]", "")
    minor = F.when(F.length(whole) <= 15, whole.try_cast("long") * F.pow(F.lit(10), decimals).cast("long") + F.when(decimals > 0, F.rpad(F.left(rest, decimals), decimals, "0").try_cast("long")).otherwise(0))
    return F.when(minor < 1 << 53, F.when(raw.startswith("-"), -minor).otherwise(minor))


def expand_magnitude(mantissa: Column, zeros: Column) -> Column:
    """Figures times ten to the ``zeros``, as figures; null where digits would be left over."""
    whole, rest = F.regexp_extract(mantissa, "^([0-9]{1,12})(?:[.,]([0-9]{1,3}))?$", 1), F.regexp_extract(mantissa, "^([0-9]{1,12})(?:[.,]([0-9]{1,3}))?$", 2)
    return F.when((whole != "") & (F.length(rest) <= zeros), F.concat(whole, rest, F.repeat(F.lit("0"), zeros - F.length(rest))))


def normal_identifier(raw: Column) -> Column:
    return F.regexp_replace(F.lower(raw), "[^a-z0-9]+", "")


def _days(x, how, day):
    """(first day, day behind the last, ASSUMED?) of a date, as days since 1970."""
    number = {n: k % 12 + 1 for k, n in enumerate(n for names in MONTHS for n in names)}

    def first(year, month):
        return F.add_months(F.make_date(year, F.lit(1), F.lit(1)), month - 1)

    def one(year, month, d, real=True):
        start = first(year, month)
        ok = month.between(1, 12) & (d >= 1) & (d <= F.day(F.last_day(start))) if real else F.lit(True)
        return F.when(ok, F.unix_date(start) + d - 1)

    a, b, c = (x[g].try_cast("int") for g in "abc")
    front = x["a"].rlike("^[0-9]")
    name = _look(number, F.lower(F.when(front, x["b"]).otherwise(x["a"])))
    open_ = a.between(1, 12) & b.between(1, 12)
    figures = F.when(open_ | ((a > 12) & (b <= 12)), one(c, b, a, False)).when((b > 12) & (a <= 12), one(c, a, b, False))
    inside = x["before"].rlike(rf"[0-9]{{1,2}}{_S}{{0,3}}(de{_S}{{0,3}})?$")
    shift = _look(RELATIVE, F.lower(x["a"]))
    lo = (
        F.when(how == "iso", one(a, b, c)).when(how == "figures", figures).when(how == "named", one(c, name, F.when(front, a).otherwise(b)))
        .when((how == "month") & ~inside, F.unix_date(first(b, name))).when(how == "quarter", F.unix_date(first(b, a * 3 - 2))).when(how == "relative", F.unix_date(day) + shift)
    )
    hi = F.when(how == "month", F.unix_date(first(b, name + 1))).when(how == "quarter", F.unix_date(first(b, a * 3 + 1))).otherwise(lo + 1)
    return lo, hi, (how == "relative") | ((how == "figures") & open_)


def _values(x: Column, day: Column) -> Column:
    """What a candidate would be worth under its kind; ``_meaning`` puts the fact together."""
    kind, how = F.get(F.array(*[F.lit(k) for k, _, _ in RULES]), x["rule"]), F.get(F.array(*map(F.lit, _READ)), x["rule"])
    text = F.when(kind == "URL", F.regexp_replace(x["text"], "[.,;:!?]+$", "")).otherwise(x["text"])

    lo, hi, guessed = _days(x, how, day)
    sign = F.when(how == "sign", _look({s: c for c, (s, _) in CURRENCIES.items()}, x["a"]))
    code = F.coalesce(sign, F.when(how == "before", x["b"]).otherwise(x["a"]))
    minor = amount(F.when(how == "before", x["a"]).otherwise(x["b"]), _look({c: n for c, (_, n) in CURRENCIES.items()}, code))
    bare = (how == "sign") & (x["a"] == CURRENCIES[ASSUMED_CURRENCY][0])

    word = F.lower(x["b"])
    role = _look({w + s: k for k, (_, words) in TIMES.items() for w in words for s in ("", "s") if not (s and w in SHORT)}, word)
    count = x["a"].try_cast("long")
    parts = {k: F.coalesce(x[g].try_cast("long"), F.lit(0)) for k, g in zip(TIMES, _GROUPS, strict=True)}
    seconds = F.when(how == "words", count * _look({k: n for k, (n, _) in TIMES.items()}, role)).otherwise(sum((parts[k] * n for k, (n, _) in TIMES.items()), F.lit(0)))
    shown = {k: F.when(v > 0, F.concat(v, F.lit(k))).otherwise("") for k, v in parts.items()}
    clock = F.concat(shown["H"], shown["M"], shown["S"])
    coded = F.concat(F.lit("P"), shown["W"], shown["D"], F.when(clock != "", F.concat(F.lit("T"), clock)).otherwise(""))
    span = F.when(how == "words", F.concat(F.when(role.isin("W", "D"), "P").otherwise("PT"), count, role)).when(seconds > 0, coded)

    figure = F.regexp_replace(x["a"], ",", "")
    figure = F.regexp_replace(F.regexp_replace(figure, "^0+(?=[0-9])", ""), r"(\.[0-9]*?)0+$", "$1")
    figure = F.regexp_replace(figure, r"\.$", "")
    unit = F.lower(x["b"])

    mark = text.startswith("#")
    named = mark | ((F.length(text) >= 5) & text.rlike("[A-Za-z]") & text.rlike("[0-9]"))
    link = r"(?i)^(https?)://(?:[^/?#@]*@)?([^/?#:]+)(?::([0-9]*))?([^?#]*)"
    scheme, host, port, path = (F.regexp_extract(text, link, g) for g in range(1, 5))
    usual = (port == "") | ((F.lower(scheme) == "http") & (port == "80")) | ((F.lower(scheme) == "https") & (port == "443"))
    origin = F.concat(F.lower(scheme), F.lit("://"), F.lower(host), F.when(usual, "").otherwise(F.concat(F.lit(":"), port)), F.when(path == "", "/").otherwise(path))

    return F.struct(
        kind.alias("kind"), how.alias("how"), x["start"].alias("start"), text.alias("text"), lo.alias("lo"), hi.alias("hi"), F.coalesce(guessed | bare, F.lit(False)).alias("guessed"),
        F.when(kind == "MONEY", code).when(kind == "DURATION", "s").when(kind == "QUANTITY", unit).alias("unit"), F.when(kind == "MONEY", minor).alias("minor"),
        F.when(kind == "DURATION", seconds).alias("seconds"), F.when(kind == "DURATION", span).alias("span"), F.when(kind == "QUANTITY", figure).alias("figure"),
        F.when((kind == "IDENTIFIER") & named, normal_identifier(text)).when((kind == "URL") & (host != ""), origin).alias("name"),
    )


def _meaning(v: Column) -> Column:
    """The fact of a candidate's values; its norm is null if it is none."""
    kind, text = v["kind"], v["text"]

    def date(days):
        return F.date_from_unix_date(days).cast("string")

    norm = (
        F.when(kind == "DATE", F.concat(date(v["lo"]), F.lit("/"), date(v["hi"]))).when(kind == "MONEY", F.concat(v["unit"], F.lit(":"), v["minor"])).when(kind == "DURATION", v["span"])
        .when(kind == "QUANTITY", F.concat(v["figure"], F.lit(":"), v["unit"])).when(kind == "EMAIL", F.lower(text)).otherwise(v["name"])
    )
    key = F.when(kind.isin("DATE", "MONEY"), norm).when(kind == "DURATION", F.concat(v["seconds"], F.lit(":"), F.when(v["how"] == "words", F.lower(text)).otherwise(v["span"])))
    return F.struct(
        kind.alias("kind"), v["start"].alias("start"), F.length(text).alias("length"), text.alias("text"), norm.alias("norm"),
        F.coalesce(v["minor"].cast("decimal(38,6)"), v["seconds"].cast("decimal(38,6)"), v["figure"].try_cast("decimal(38,6)")).alias("num"), v["unit"].alias("unit"),
        (v["lo"].cast("long") * DAY).alias("ts"), (v["hi"].cast("long") * DAY).alias("ts_end"), F.when(v["guessed"], "ASSUMED").otherwise("EXACT").alias("confidence"),
        F.concat(kind, F.lit(" "), key).alias("key"), F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("int").alias("rank"),
    )


def meanings(found: Column, day: Column) -> Column:
    """The facts of ``candidates``, with key and rank; those without a norm are none."""
    return F.filter(F.transform(F.transform(found, lambda x: _values(x, day)), _meaning), lambda f: f["norm"].isNotNull())


def facts(docs: DataFrame, text="text", day="1970-01-01") -> DataFrame:
    """(id, kind, start, length, text, norm, num, unit, ts, ts_end, confidence) of each text's facts; no
    shuffle. day: the column of the day, or the day, from which relative words count."""
    when = F.col(day) if day in docs.columns else F.lit(day)
    rows = docs.where(F.col(text).rlike(_SIGN_OF_ONE)).select("id", when.cast("date").alias("day"), candidates(F.col(text)).alias("found"))
    rows = rows.select("id", meanings(F.col("found"), F.col("day")).alias("f"))
    stand = _standing(F.col("f.start"), F.col("f.length"), F.col("f.rank"), F.col("f.key"))
    # No filter by size and no plain explode of a function's result: Spark would compute both functions again for the filter.
    return rows.select("id", "f", stand.alias("places")).select("id", F.inline(F.transform("places", lambda i: F.get("f", i)))).drop("key", "rank")


def matching(facts: DataFrame, filters: list[tuple[str, str]]) -> DataFrame:
    """Ids with a fact for each (kind, norm): one grouped pass, whatever the number of filters."""
    tests = [F.bool_or((F.col("kind") == k) & (F.col("norm") == v)).alias(f"f{i}") for i, (k, v) in enumerate(filters)]
    held = facts.groupBy("id").agg(*tests)
    for i in range(len(filters)):
        held = held.where(F.col(f"f{i}"))
    return held.select("id")


def overlapping(facts: DataFrame, windows: DataFrame) -> DataFrame:
    """(id, window): dates that meet a window (window, ts, ts_end), half-open both, once each pair.

    Both sides are dealt to the months that they touch and joined by month, so no row meets a window of
    another time; a pair that shares several months counts in the first that both have."""

    def month(ms):
        return F.expr(f"12 * year(date_from_unix_date(CAST(floor({ms} / {DAY}) AS INT))) + month(date_from_unix_date(CAST(floor({ms} / {DAY}) AS INT))) - 1")

    def dealt(rows, *columns):
        some = rows.where("ts < ts_end")
        return some.select(*columns, "ts", "ts_end", month("ts").alias("lo"), F.explode(F.sequence(month("ts"), month("(ts_end - 1)"))).alias("month"))

    left = dealt(facts.where("kind = 'DATE'"), "id").distinct()
    right = dealt(windows, "window").withColumnsRenamed({"ts": "w_ts", "ts_end": "w_end", "lo": "w_lo"})
    met = left.join(right, "month").where("ts < w_end AND w_ts < ts_end AND month = greatest(lo, w_lo)")
    return met.select("id", "window").distinct()


def rarity(facts: DataFrame, documents: int, share: float = 0.2) -> DataFrame:
    """(kind, norm, documents) of facts in at most a share of the documents."""
    counted = facts.groupBy("kind", "norm").agg(F.count_distinct("id").alias("documents"))
    return counted.where(F.col("documents") <= share * documents)
