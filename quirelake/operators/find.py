"""Find in a book: matches within text nodes, without overlap, from left to right."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: hits that are kept.
LIMIT = 1000
#: Elements whose text is not searched.
SKIPPED = r"(?is)<(script|style|noscript|svg|math|template)\b.*?</\1\s*>"


def text_nodes(html: Column) -> Column:
    """Texts between tags; skipped elements have none."""
    return F.filter(F.split(F.regexp_replace(html, SKIPPED, "<x>"), "<[^>]*>", -1), lambda x: x != "")


def occurrences(text: Column, query: Column) -> Column:
    """How often the trimmed query occurs. Case counts only where lower-casing changes a length."""
    needle, low = F.lower(F.trim(query)), F.lower(text)
    folds = (F.length(low) == F.length(text)) & (F.length(needle) == F.length(F.trim(query)))
    hay = F.when(folds, low).otherwise(text)
    gone = F.length(hay) - F.length(F.replace(hay, needle, F.lit("")))
    return F.when(F.length(needle) == 0, F.lit(0).cast("long")).otherwise(F.floor(gone / F.greatest(F.length(needle), F.lit(1))).cast("long"))


def summary(total: Column, available: Column, step: Column, limit: int = LIMIT) -> list[Column]:
    """available, total, index and capped; a step beyond the last hit goes on with the first."""
    kept = F.when(available, F.least(total, F.lit(limit))).otherwise(F.lit(0)).cast("long")
    index = F.when(kept == 0, F.lit(-1)).otherwise(F.pmod(step, F.greatest(kept, F.lit(1)))).cast("long")
    return [available.alias("available"), kept.alias("total"), index.alias("index"), (available & (total >= limit)).alias("capped")]
