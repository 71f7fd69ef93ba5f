"""Text operators: lexicon sentiment (V1), snippets.

All Column expressions (JVM side; the regular expressions run outside generated code); no Python UDF.
The whole text is searched, never a prefix.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ludex import config


def word_count(text: Column, words) -> Column:
    """How often any of ``words`` occurs in ``text`` as a whole token: a maximal run of [a-z],
    lower-cased, whatever else separates them.  One regex pass with an alternation."""
    some = "|".join(re.escape(w) for w in words)
    return F.regexp_count(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"(?<![a-z])(?:{some})(?![a-z])"))


def with_lexicon(df: DataFrame, text_col: str, positive=None, negative=None, prefix: str = "lex_") -> DataFrame:
    """Add pos, neg (token counts with multiplicity), score = pos - neg, label by sign."""
    out = df.withColumns({prefix + "pos": word_count(F.col(text_col), positive or config.POSITIVE_WORDS),
                          prefix + "neg": word_count(F.col(text_col), negative or config.NEGATIVE_WORDS)})
    score = F.col(prefix + "pos") - F.col(prefix + "neg")
    return (out.withColumn(prefix + "score", score)
               .withColumn(prefix + "label", F.when(score > 0, "positive").when(score < 0, "negative")
                           .otherwise("neutral")))


def lexicon_sql(text: str, positive=None, negative=None, prefix: str = "lex_") -> str:
    """The same computation as DuckDB SQL select items (for oracles)."""
    def arr(ws):
        return "[" + ", ".join("'" + w + "'" for w in ws) + "]"
    toks = rf"string_split_regex(regexp_replace(lower(COALESCE({text}, '')), '[^a-z\s]', ' ', 'g'), '\s+')"
    pos = f"len(list_filter({toks}, lambda x: list_contains({arr(positive or config.POSITIVE_WORDS)}, x)))"
    neg = f"len(list_filter({toks}, lambda x: list_contains({arr(negative or config.NEGATIVE_WORDS)}, x)))"
    score = f"({pos} - {neg})"
    return (f"CAST({pos} AS INTEGER) AS {prefix}pos, CAST({neg} AS INTEGER) AS {prefix}neg, "
            f"CAST({score} AS INTEGER) AS {prefix}score, "
            f"CASE WHEN {score} > 0 THEN 'positive' WHEN {score} < 0 THEN 'negative' ELSE 'neutral' END AS {prefix}label")
