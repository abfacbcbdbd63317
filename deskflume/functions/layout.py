"""Chunks of laid-out documents: pages by paragraphs, items under their headings, tables with their head."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import SPACES

#: Characters of a page's part, levels of headings, what joins them, cells of a table's piece.
PAGE_CHARS, DEPTH, JOIN, CELLS = 8000, 3, " › ", 600


def _trimmed(x: Column) -> Column:
    return F.regexp_replace(x, f"^[{SPACES}]+|[{SPACES}]+$", "")


def page_parts(page: Column, most: int = PAGE_CHARS) -> Column:
    """The page as parts of at most ``most`` characters: paragraphs are packed while they fit, and one that is
    longer is cut. Blank pages have no part."""
    text = _trimmed(F.coalesce(page, F.lit("")))
    begin = F.struct(F.lit("").alias("held"), F.array().cast("array<string>").alias("parts"))

    def step(acc, para):
        joined = F.when(acc["held"] == "", para).otherwise(F.concat(acc["held"], F.lit("\n\n"), para))
        full = (F.length(joined) > most) & (acc["held"] != "")
        held = F.when(full, para).otherwise(joined)
        cuts = F.greatest(F.ceil(F.length(held) / most) - 1, F.lit(0)).cast("int")
        cut = F.when(cuts > 0, F.transform(F.sequence(F.lit(0), F.greatest(cuts - 1, F.lit(0))), lambda k: F.substring(held, k * most + 1, F.lit(most)))).otherwise(F.array().cast("array<string>"))
        done = F.concat(acc["parts"], F.when(full, F.array(acc["held"])).otherwise(F.array().cast("array<string>")), cut)
        return F.struct(F.substring(held, cuts * most + 1, F.lit(most)).alias("held"), done.alias("parts"))

    packed = F.aggregate(F.split(text, f"\n[{SPACES}]*\n", -1), begin, step, lambda acc: F.concat(acc["parts"], F.when(acc["held"] != "", F.array(acc["held"])).otherwise(F.array().cast("array<string>"))))
    return F.when(text == "", F.array().cast("array<string>")).when(F.length(text) <= most, F.array(text)).otherwise(packed)


def table_pieces(rows: Column, cells: int = CELLS) -> Column:
    """A table (array of rows of cells) as texts of at most ``cells`` cells, one row at least, each under the head row."""
    wide = F.size(rows[0])
    per = F.greatest(F.lit(1), F.floor(F.lit(cells) / wide) - 1).cast("int")

    def shown(row):
        return F.concat(F.lit("| "), F.array_join(row, " | ", ""), F.lit(" |"))

    starts = F.sequence(F.lit(1), F.greatest(F.size(rows) - 1, F.lit(1)), per)

    def cut(lines):
        return F.transform(starts, lambda k: F.array_join(F.concat(F.slice(lines, 1, 1), F.slice(lines, k + 1, per)), "\n"))

    pieces = F.get(F.transform(F.array(F.transform(rows, shown)), cut), F.lit(0))  # the lines are made once, not for each piece
    return F.when((F.size(rows) > 0) & (wide > 0), pieces).otherwise(F.array().cast("array<string>"))


def heading_chunks(items: Column) -> Column:
    """Items in reading order (heading, text, page) as chunks (text, page, prefix_end), each under the path of
    its headings. A heading right behind another is one level below it, at most DEPTH levels; one behind other text
    begins anew, and stands under those above it only. Blank items are left out."""
    some = F.filter(items, lambda x: F.regexp_replace(x["text"], f"[{SPACES}]+", "") != "")
    none = F.array().cast("array<string>")
    begin = F.struct(none.alias("path"), F.lit(False).alias("last"), F.array().cast("array<array<string>>").alias("paths"))

    def step(acc, x):
        depth = F.when(acc["last"], F.least(F.size(acc["path"]) + 1, F.lit(DEPTH))).otherwise(1)
        above = F.slice(acc["path"], F.lit(1), depth - 1)
        path = F.when(x["heading"], F.array_append(above, _trimmed(x["text"]))).otherwise(acc["path"])
        own = F.when(x["heading"], above).otherwise(acc["path"])
        return F.struct(path.alias("path"), x["heading"].alias("last"), F.array_append(acc["paths"], own).alias("paths"))

    paths = F.aggregate(some, begin, step, lambda acc: acc["paths"])

    def chunk(x, path):
        prefix = F.when(F.size(path) > 0, F.concat(F.array_join(path, JOIN), F.lit(JOIN))).otherwise("")
        return F.struct(F.concat(prefix, x["text"]).alias("text"), x["page"].alias("page"), F.length(prefix).alias("prefix_end"))

    return F.zip_with(some, paths, chunk)
