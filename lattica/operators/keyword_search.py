"""Keyword search over whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.access import Principal, visible_to
from lattica.functions.text import keywords
from lattica.operators import inverted_index


def search_terms(question: Column) -> Column:
    """Distinct lower-case keywords of a question."""
    return F.array_distinct(F.transform(keywords(question), F.lower))


def search(
    items: DataFrame,
    questions: DataFrame,
    k: int = 10,
    principal: Principal | None = None,
    min_score: float | None = None,
    id_column: str = "doc_id",
    text: str = "text",
    carry: str | None = None,
    index: DataFrame | None = None,
) -> DataFrame:
    """k best texts per question; `questions` has (request_id, question).

    The column `carry` follows the winners.  A written `index` must hold exactly
    the items that the principal may read, so that ranks are among these.
    """
    if principal is not None:
        items = visible_to(items, principal)
    asked = questions.select("request_id", search_terms(F.col("question")).alias("payload"))
    return inverted_index.search(items, asked, k, min_score, id_column, text, carry, index)
