"""The corpus pipeline: language ID, line dedup, near dedup, mixing, byte-level BPE.

STAGES are (name, function); each takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the docs of the next. All but the last return the columns of
documents.
"""

from pyspark.sql import functions as F

from deskflume.llm import bpe, lang_id, line_dedup, mixing, near_dups
from deskflume.llm.common import documents, shared_folder, stored


def language(spark, docs, sf_dir):
    """Drops documents whose language cannot be told (no letters)."""
    return lang_id.reject(docs)


def lines(spark, docs, sf_dir):
    """Lines that an earlier document holds go; n_chars follows the text."""
    kept = line_dedup.dedup_lines(docs)
    columns = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("text", "n_chars")]
    out = kept.select(*columns, F.col("kept_text").alias("text"), F.char_length("kept_text").cast("long").alias("n_chars"))
    return out.select(*docs.columns)


def near_copies(spark, docs, sf_dir):
    """Of each group of near copies the smallest doc_id stays."""
    return near_dups.near_dedup(docs)


def mix(spark, docs, sf_dir):
    """Documents in the order of the mix, as often as it takes them."""
    return mixing.mixture(docs)


def tokens(spark, docs, sf_dir):
    """Token ids of each document of the mix, decoded again."""
    return bpe.digests(bpe.round_trip(docs))


STAGES = [("language ID", language), ("line dedup", lines), ("near dedup", near_copies), ("source mix", mix), ("byte-level BPE", tokens)]
#: The language model, the similarity join and the tokenizer have no SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = documents(spark, sf_dir)
    folder = shared_folder(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, folder, f"stage-{k}")
    return docs
