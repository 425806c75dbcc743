"""Token tables with byte offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioform.functions.text import plain_words, token_kind, token_texts


def token_rows(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(*keys, idx, text, type, char_start, char_end): one row per token, offsets as running sums of octet lengths.

    Linear in the text's length, unlike functions.text.tokens, which builds one array per text and suits verses. A row's
    tokens stay in its task: the window needs one shuffle by ``keys``, which must be unique. Null and empty texts have no tokens.
    """
    rows = df.select(*keys, F.posexplode(token_texts(text)).alias("idx", "text"))
    end = F.sum(F.octet_length("text")).over(Window.partitionBy(*keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("char_end", end.cast("int"))
    return out.select(*keys, "idx", "text", token_kind(F.col("text")).alias("type"), (F.col("char_end") - F.octet_length("text")).alias("char_start"), "char_end")


def word_counts(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(*keys, word, n): words of the reader's tokenizer in lower case, counted per key with partial sums before the shuffle."""
    return df.select(*keys, F.explode(plain_words(F.lower(text))).alias("word")).groupBy(*keys, "word").agg(F.count("*").alias("n"))


def words_to_text(words: DataFrame, keys: list[str], word: str, order: str) -> DataFrame:
    """(*keys, text): the words of each key in their order, a space between."""
    return words.groupBy(*keys).agg(F.expr(f"listagg({word}, ' ') WITHIN GROUP (ORDER BY {order})").alias("text"))
