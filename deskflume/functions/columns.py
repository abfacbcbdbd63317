"""What a column of a table holds: rates of its values by rule, the semantic type they speak for, what may be shown."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of column names that speak for a type.
WORDS = {
    "CREDENTIAL": ["password", "passwd", "secret", "token", "apikey", "api_key", "credential", "privatekey"],
    "EMAIL": ["email", "mail", "contact"],
    "PHONE": ["phone", "tel", "mobile", "msisdn", "fax"],
    "CARD": ["card", "pan", "cc"],
    "ACCOUNT": ["account", "iban", "wallet", "acct"],
    "NATIONAL_ID": ["ssn", "sin", "nin", "nif", "cif", "dni", "nie", "passport", "nationalid", "national_id"],
    "PERSON_NAME": ["name", "firstname", "lastname", "surname", "fullname", "owner", "customer", "employee"],
    "ADDRESS": ["address", "street", "avenue", "city", "zipcode", "postcode", "postal"],
    "DATE_OF_BIRTH": ["dob", "birth", "born", "birthday"],
    "COMPENSATION": ["salary", "pay", "comp", "wage", "bonus", "remuneration", "netpay", "grosspay"],
    "HEALTH": ["health", "diagnosis", "diagnostic", "medical", "medication", "patient", "clinical"],
    "TEMPORAL": ["date", "at", "when", "time"],
    "ENUM": ["status", "state", "kind", "type", "category", "stage", "phase"],
    "MEASURE": ["count", "qty", "quantity", "amount", "total", "sum", "length", "size", "weight", "duration"],
    "FREE_TEXT": ["notes", "comment", "description", "body", "message", "text"],
}
#: For each type its confidence, what a word of the name adds, and the test, as SQL over column_rates.
RULES = {
    "CREDENTIAL": (0.95, 0.0, "named"),
    "EMAIL": (0.75, 0.20, "mean_length >= 6 AND letters > 0.4 AND emails = 1"),
    "PHONE": (0.75, 0.20, "digits > 0.5 AND phones = 1"),
    "CARD": (0.85, 0.10, "digits > 0.6 AND shortest >= 12 AND longest <= 19 AND cards = 1"),
    "ACCOUNT": (0.80, 0.15, "mean_length >= 10 AND letters > 0.2 AND ibans = 1"),
    "NATIONAL_ID": (0.70, 0.25, "digits > 0.4 AND longest <= 20 AND NOT numeric AND NOT temporal"),
    "PERSON_NAME": (0.55, 0.25, "named AND NOT numeric AND letters > 0.7 AND mean_length BETWEEN 3 AND 40"),
    "ADDRESS": (0.60, 0.20, "named AND mean_length >= 6"),
    "DATE_OF_BIRTH": (0.70, 0.25, "named AND dates = 1 AND (temporal OR digits > 0.3)"),
    "COMPENSATION": (0.70, 0.25, "numeric AND named"),
    "HEALTH": (0.65, 0.30, "named"),
    "TEMPORAL": (0.60, 0.15, "temporal"),
    "ENUM": (0.50, 0.15, "NOT numeric AND NOT temporal AND distinct_values <= 100 AND (top_share >= 0.5 OR distinct_values <= 12)"),
    "MEASURE": (0.45, 0.10, "numeric"),
    "FREE_TEXT": (0.60, 0.10, "NOT numeric AND mean_length >= 40 AND distinct_values >= 0.9 * rows"),
}
#: Types whose values may be shown; of all others only the shape.
SHOWN = ("TEMPORAL", "ENUM", "MEASURE")
#: Patterns of our own for values; a third-party check of numbers would be stricter.
VALUES = {
    "emails": r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+$",
    "phones": r"^\+?[0-9][0-9 ().-]{5,18}[0-9]$",
    "cards": r"^[0-9]{12,19}$",
    "ibans": r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$",
    "dates": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T].*)?$",
}
#: Most frequent values that count for the share of the top.
TOP = 10


def cells(df: DataFrame) -> DataFrame:
    """(name, numeric, temporal, value): the values of all columns as text."""
    kinds = [(f.name, f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal"), f.dataType.typeName().startswith(("date", "timestamp"))) for f in df.schema]
    each = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(a).alias("numeric"), F.lit(t).alias("temporal"), F.col(f"`{n}`").cast("string").alias("value")) for n, a, t in kinds])
    return df.select(F.inline(each))


def column_rates(cells: DataFrame) -> DataFrame:
    """(name, numeric, temporal, rows, distinct_values, shortest, longest, mean_length, letters, digits,
    top_share, emails, phones, cards, ibans, dates) of each column; null values count in no rate. The
    values are counted first, so rates are taken over distinct values with their counts."""
    counted = cells.where("value IS NOT NULL").groupBy("name", "numeric", "temporal", "value").agg(F.count("*").alias("n"))
    size, n = F.char_length("value"), F.col("n")
    rows = F.sum("n")
    chars = F.sum(size * n)

    def of(pattern):
        return F.coalesce(F.sum(F.char_length(F.regexp_replace("value", pattern, "")) * n) / F.nullif(chars, F.lit(0)), F.lit(0.0))

    stats = counted.groupBy("name", "numeric", "temporal").agg(
        rows.alias("rows"), F.count("*").alias("distinct_values"), F.min(size).alias("shortest"), F.max(size).alias("longest"), (chars / rows).alias("mean_length"),
        of("[^A-Za-z]").alias("letters"), of("[^0-9]").alias("digits"), *[(F.sum(F.when(F.col("value").rlike(p), n).otherwise(0)) / rows).alias(k) for k, p in VALUES.items()],
    )
    top = _top(counted).select("name", F.col("top").alias("__top"))
    return stats.join(top, "name").withColumn("top_share", F.col("__top") / F.col("rows")).drop("__top")


def _top(counted: DataFrame) -> DataFrame:
    """(name, top): rows of the TOP most frequent values; each task of a value's hash sends TOP at most."""
    from pyspark.sql import Window

    part = Window.partitionBy("name", F.pmod(F.xxhash64("value"), F.lit(64))).orderBy(F.desc("n"), "value")
    few = counted.withColumn("place", F.row_number().over(part)).where(F.col("place") <= TOP)
    best = few.withColumn("place", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("n"), "value"))).where(F.col("place") <= TOP)
    return best.groupBy("name").agg(F.sum("n").alias("top"))


def name_says(name: Column, words: list[str]) -> Column:
    """Whether a part of the column's name, or the whole name, is one of the words."""
    low = F.lower(name)
    return F.arrays_overlap(F.concat(F.split(low, "[^a-z0-9]+"), F.array(low)), F.array(*map(F.lit, words)))


def classified(rates: DataFrame) -> DataFrame:
    """(name, type, confidence, shown): the type whose test holds with the highest confidence, ties by
    name; UNKNOWN with none. Values of a few types only may be shown."""
    found = F.array_compact(F.array(*[_guess(kind, *rule) for kind, rule in RULES.items()]))
    best = F.get(F.array_sort(found), F.lit(0))
    kind = F.coalesce(best["type"], F.lit("UNKNOWN"))
    return rates.select("name", kind.alias("type"), F.coalesce(-best["back"], F.lit(0.0)).alias("confidence"), kind.isin(*SHOWN).alias("shown"))


def _guess(kind: str, base: float, bonus: float, test: str) -> Column:
    named = name_says(F.col("name"), WORDS[kind])
    plain = F.expr(test.replace("named", "true"))
    holds = plain & named if "named" in test else plain
    return F.when(holds, F.struct((-F.round(base + F.when(named, bonus).otherwise(0.0), 2)).alias("back"), F.lit(kind).alias("type")))


def exemplars(cells: DataFrame, classes: DataFrame, floor: int = 5, most: int = 10) -> DataFrame:
    """(name, place, value, n): the most frequent values of columns whose values may be shown (classes: name,
    shown), held by ``floor`` rows at least. Of all other columns nothing."""
    from pyspark.sql import Window

    counted = cells.where("value IS NOT NULL").groupBy("name", "value").agg(F.count("*").alias("n")).where(F.col("n") >= floor)
    open_ = counted.join(F.broadcast(classes.where("shown").select("name")), "name", "left_semi")  # a row a column
    order = [F.desc("n"), F.asc("value")]
    few = open_.withColumn("place", F.row_number().over(Window.partitionBy("name", F.pmod(F.xxhash64("value"), F.lit(64))).orderBy(*order))).where(F.col("place") <= most)
    return few.withColumn("place", F.row_number().over(Window.partitionBy("name").orderBy(*order))).where(F.col("place") <= most).select("name", "place", "value", "n")


def bounds(cells: DataFrame, classes: DataFrame) -> DataFrame:
    """(name, kind, low, high) of columns of numbers and times: their bounds where values may be shown, else
    how many characters they have; kind none for others and for columns without values."""
    number = F.col("value").try_cast("double")
    least, most = (F.when(F.first("numeric"), by("value", number)).otherwise(plain("value")) for by, plain in ((F.min_by, F.min), (F.max_by, F.max)))
    shapes = cells.groupBy("name", "numeric", "temporal").agg(least.alias("least"), most.alias("most"), F.min(F.char_length("value")).alias("shortest"), F.max(F.char_length("value")).alias("longest"))
    rows = shapes.join(classes.select("name", "shown", "type"), "name")
    told = F.col("numeric") | F.col("temporal") | (F.col("type") == "TEMPORAL")
    kind = F.when(~told, "none").when(~F.col("shown"), "digits").when(F.col("least").isNull(), "none").otherwise("bounds")
    low, high = (F.when(kind == "bounds", F.col(v)).when(kind == "digits", F.col(n).cast("string")) for v, n in (("least", "shortest"), ("most", "longest")))
    return rows.select("name", kind.alias("kind"), low.alias("low"), high.alias("high"))
