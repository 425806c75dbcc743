"""Search, lookup, facets and pages over blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioform.functions.text import unquote_query


def text_matches(text: Column, query: str) -> Column:
    """Substring, whatever the case; quotes around the query are dropped, an empty query matches all."""
    return F.contains(F.lower(text), F.lower(F.lit(unquote_query(query))))


def strongs_matches(tokens: Column, number: str) -> Column:
    """A token with the Strong's number, whatever its case."""
    return F.exists(tokens, lambda t: F.exists(t["strongs"], lambda s: F.upper(s) == number.upper()))


def first_hits(df: DataFrame, hit: Column, order: list[str], limit: int) -> DataFrame:
    """The first ``limit`` hits in canonical order (a top-k without a full sort)."""
    return df.where(hit).orderBy(*order).limit(limit)


def hit_counts(df: DataFrame, hit: Column, facets: list[str]) -> DataFrame:
    """Exact number of hits per facet value."""
    return df.where(hit).groupBy(*facets).agg(F.count("*").alias("n_hits"))


def point(df: DataFrame, **key) -> DataFrame:
    """Rows with the key; values are pushed to the scan."""
    for k, v in key.items():
        df = df.where(F.col(k) == F.lit(v))
    return df


def same_key(a: Column, b: str) -> Column:
    return F.lower(a) == F.lower(F.lit(b))


def like(c: Column, pattern: str) -> Column:
    """LIKE without regard to the case of ASCII letters, as SQLite has it; % and _ are wild."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(c, upper, lower).like(pattern.translate(str.maketrans(upper, lower)))


def facet_condition(df: DataFrame, wanted: dict[str, str]) -> Column:
    """Every facet value wanted; 'all' and '' are wild. Array columns match if they contain the value."""
    out = F.lit(True)
    for k, v in wanted.items():
        if v not in ("all", ""):
            out = out & (F.array_contains(k, v) if dict(df.dtypes)[k].startswith("array") else F.col(k) == v)
    return out


def facet_filter(df: DataFrame, **wanted: str) -> DataFrame:
    return df.where(facet_condition(df, wanted))


def catalogue_condition(df: DataFrame, term: str, fields: list[str], wanted: dict[str, str]) -> Column:
    """Facets and a term contained in the joined fields, whatever the case."""
    facets = facet_condition(df, wanted)
    return facets & F.contains(F.lower(F.concat_ws(" ", *fields)), F.lit(term.lower())) if term else facets


def catalogue_filter(df: DataFrame, term: str, fields: list[str], **wanted: str) -> DataFrame:
    """The rows shown; catalogue_counts() tells how many there are of how many."""
    return df.where(catalogue_condition(df, term, fields, wanted))


def catalogue_counts(df: DataFrame, term: str, fields: list[str], **wanted: str) -> DataFrame:
    """(n_shown, n_all) in one pass."""
    return df.agg(F.count(F.when(catalogue_condition(df, term, fields, wanted), 1)).alias("n_shown"), F.count("*").alias("n_all"))


def key_contains(df: DataFrame, key: str, term: str) -> DataFrame:
    """Rows of a lexicon or tree whose key contains the term, whatever the case; an empty term matches all."""
    return df.where(F.contains(F.lower(key), F.lit(term.lower())))


def limited_hits(parts: dict[str, DataFrame], limit: int) -> DataFrame:
    """(corpus, id, n_total): the first ``limit`` hits over several corpora ({name: hits (id)}), corpora in the order given, and the
    exact number of all. Each corpus gives at most ``limit`` rows to the final top-k; totals are counted apart."""
    hits = [df.select(F.lit(n).alias("corpus"), F.lit(i).alias("_c"), F.col("id").cast("string").alias("id"), F.col("id").alias("_o")).orderBy("_o").limit(limit).drop("_o") for i, (n, df) in enumerate(parts.items())]
    total = sum(df.count() for df in parts.values())
    out = hits[0]
    for h in hits[1:]:
        out = out.unionByName(h)
    return out.orderBy("_c", F.length("id"), "id").limit(limit).select("corpus", "id", F.lit(total).alias("n_total"))


def facet_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of a facet with their counts."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def letter_index(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """First letters in upper case, per value of ``by``."""
    return df.where(F.length(column) > 0).select(*(by or []), F.upper(F.substring(column, 1, 1)).alias("letter")).distinct()


def page(df: DataFrame, order: list[str], number: int, size: int) -> DataFrame:
    """Rows of page ``number`` (clamped to 1 .. last) with the number of pages. Only a page's rows are ever ranked in one task."""
    total = df.count()
    pages = max(1, -(-total // size))
    number = min(max(number, 1), pages)
    return df.orderBy(*order).offset((number - 1) * size).limit(size).withColumn("page_no", F.lit(number)).withColumn("n_pages", F.lit(pages))


def lookup_cascade(keys: DataFrame, lexicon: DataFrame, key: str) -> DataFrame:
    """Lexicon rows of Strong's keys: as is, without H/G, zero-padded to five; the first form found wins."""
    bare = F.regexp_replace(F.upper(key), "^[HG]", "")
    forms = keys.select(F.col(key).alias("asked"), F.posexplode(F.array(F.upper(key), bare, F.lpad(bare, 5, "0"))).alias("rank", "lex_key"))
    hits = forms.join(lexicon, "lex_key")
    first = hits.withColumn("_k", F.row_number().over(Window.partitionBy("asked").orderBy("rank", "lex_key")))
    return first.where("_k = 1").drop("_k", "rank")
