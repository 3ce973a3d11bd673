"""Row filters of the curation flow."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Title prefixes that mark pages of other namespaces in the Icelandic dump.
ICELANDIC_PREFIXES = [
    "Flokkur:", "Spjall:", "Snið:", "Notandaspjall:", "Notandi:", "Mynd:", "Wikipedia:", "Talk:", "Module:", "Wikipediaspjall:", "Sniðaspjall:", "Flokkaspjall:",
    "Melding:", "flokkur:", "Hjálp:", "User:", "wikipedia:", "notandi:", "Listi_yfir_CSI:", "snið:", "Gátt:", "Myndaspjall:", "Hjálparspjall:",
]


@dataclass
class FilterOptions:
    """The defaults keep everything."""

    min_views: int = 0
    min_word_count: int = 0
    max_template_count: float = float("inf")
    max_outlink_count: float = float("inf")
    keep_category_count: int = 0
    prefixes_to_remove: list[str] = field(default_factory=list)


def has_prefix(title: Column, prefixes: Iterable[str]) -> Column:
    found = F.lit(False)
    for p in prefixes:
        found = found | F.coalesce(F.startswith(title, F.lit(p)), F.lit(False))
    return found


def without_prefixes(df: DataFrame, prefixes: Iterable[str], title: str = "title") -> DataFrame:
    return df.where(~has_prefix(F.col(title), prefixes))


def keeps(o: FilterOptions) -> Column:
    """Whether an article stays: popular or well categorised, else long enough and not mostly templates or links. Unknown numbers fail their test."""
    known = lambda c: F.coalesce(c, F.lit(False))
    popular = known(F.col("views") >= o.min_views) | known(F.col("category_count") >= o.keep_category_count)
    sound = known(F.col("word_count") >= o.min_word_count) & known(F.col("template_count") <= F.lit(o.max_template_count)) & known(F.col("outlink_count") <= F.lit(o.max_outlink_count))
    return ~has_prefix(F.col("title"), o.prefixes_to_remove) & (popular | sound)


def filter_articles(df: DataFrame, options: FilterOptions) -> tuple[DataFrame, DataFrame]:
    """(kept articles, distinct title keys of none of the kept ones). Titles that differ in case or underscores alone have one key."""
    kept = df.where(keeps(options))
    return kept, df.select("title_match").subtract(kept.select("title_match"))


def only_sentinel_ids(ids: Column) -> Column:
    """Whether the word null is the only id."""
    return F.coalesce(F.array_distinct(ids) == F.array(F.lit("null")), F.lit(False))


def main_articles(pages: DataFrame) -> DataFrame:
    """Pages of the main namespace with text that are not redirects."""
    return pages.where((F.col("ns") == "0") & F.col("redirect").isNull() & (F.col("text") != "") & ~F.startswith(F.lower("text"), F.lit("#redirect")))


def is_disambiguation(templates: Column) -> Column:
    return F.exists(templates, lambda t: F.lower(F.trim(t)) == "disambiguation")


def contains(text: Column, pattern: str) -> Column:
    """Whether a pattern occurs, whatever the case."""
    return F.rlike(text, F.lit(f"(?i){pattern}"))
