"""Keyword theme scoring and the arg-max theme.

A taxonomy is an ordered mapping theme -> keywords.  The score of a theme
is the number of its keywords present at least once in the lower-cased
text; the guess is the highest score, ties to the earlier theme, '' when
nothing scores.  A taxonomy given as a mapping is constants in the expression
(one pass over each text, no join); a taxonomy table of any size is scored by a
multi-pattern automaton over its keywords (:mod:`pressroom.operators.keywords`).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressroom.functions import text as T

# The default taxonomy, theme -> keywords, in order.
DEFAULT_THEMES: dict[str, list[str]] = {
    "venda_sentenca": [
        "venda", "sentenc", "decisao", "decisão", "corrupc", "operacao",
        "operação", "preso", "afastad", "propina", "lavagem", "faroeste",
        "naufragio", "sisamnes",
    ],
    "filhotismo": [
        "filhotism", "filho", "filha", "esposa", "parente", "principe",
        "príncipe", "familiar", "conjuge", "cônjuge", "escritorio",
        "escritório", "banco-master",
    ],
    "impedimento": [
        "impediment", "suspeic", "suspeição", "recusa", "cnj", "resolucao",
        "resolução",
    ],
    "parentesco_geral": [
        "nepotism", "cla", "clã", "dinastia", "parentesco", "familia", "família",
    ],
}


def theme_scores(text_lc, taxonomy: Mapping[str, Sequence[str]] | None = None) -> Column:
    """array<struct<n, neg_ord, theme>> for each theme, taxonomy order."""
    tax = taxonomy or DEFAULT_THEMES
    t = F.col(text_lc) if isinstance(text_lc, str) else text_lc
    return F.array(*[
        F.struct(T.keyword_hits(t, list(kws)).alias("n"), F.lit(-i).alias("neg_ord"), F.lit(th).alias("theme"))
        for i, (th, kws) in enumerate(tax.items())])


def guess_theme(text, taxonomy: Mapping[str, Sequence[str]] | None = None, lowered: bool = False) -> Column:
    """Best theme by keyword count, ties to the earlier theme, '' at zero.

    Pass an already lower-cased column with ``lowered=True`` (see
    :func:`with_themes`) so the text is lower-cased once, not once per keyword.
    """
    t = F.col(text) if isinstance(text, str) else text
    best = F.array_max(theme_scores(t if lowered else F.lower(t), taxonomy))
    return F.when(best["n"] > 0, best["theme"]).otherwise(F.lit(""))


def with_themes(df: DataFrame, text: str, taxonomy: Mapping[str, Sequence[str]] | None = None,
                guess: str | None = "theme", scores: str | None = None) -> DataFrame:
    """Add the guess (and / or the per-theme scores) with the text lower-cased once."""
    d = df.withColumn("_lc", F.lower(F.col(text)))
    if scores:
        d = d.withColumn(scores, theme_scores(F.col("_lc"), taxonomy))
    if guess:
        d = d.withColumn(guess, guess_theme(F.col("_lc"), taxonomy, lowered=True))
    return d.drop("_lc")


def taxonomy_from_df(themes: DataFrame) -> dict[str, list[str]]:
    """Taxonomy rows (theme, theme_ord, keyword) -> ordered mapping, for taxonomies that are
    configuration; :func:`theme_scores_join` scores tables of any size."""
    tax: dict[str, list[str]] = {}
    for r in themes.orderBy("theme_ord", "keyword").collect():
        tax.setdefault(r["theme"], []).append(r["keyword"])
    return tax


def theme_scores_join(docs: DataFrame, themes: DataFrame, key: str, text: str) -> DataFrame:
    """J7 for taxonomies of any size: (key, theme, theme_ord, n).  An automaton over the keywords reads each
    text once; its hits, narrow rows, meet the themes in an equi-join on the keyword."""
    from pressroom.operators.keywords import keyword_hits

    kw = themes.select("theme", "theme_ord", "keyword").where(F.col("keyword").isNotNull()).distinct()
    hits = keyword_hits(docs, kw, key, text).distinct().join(kw, "keyword")
    return hits.groupBy(key, "theme", "theme_ord").agg(F.count("*").alias("n"))


def guess_theme_join(docs: DataFrame, themes: DataFrame, key: str, text: str) -> DataFrame:
    """A7, U3 with a taxonomy table: (key, theme), the highest score, ties to the earlier theme (then the
    least name), '' where nothing scores.  One row for each distinct key."""
    scores = theme_scores_join(docs, themes, key, text)
    best = scores.groupBy(key).agg(F.min_by("theme", F.struct(-F.col("n"), F.col("theme_ord"), F.col("theme"))).alias("theme"))
    return docs.select(key).distinct().join(best, key, "left").select(key, F.coalesce("theme", F.lit("")).alias("theme"))
