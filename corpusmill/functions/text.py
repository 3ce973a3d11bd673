"""Scalar text functions as Column expressions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.split and str.strip see it, for Java patterns.
SPACE = r"[\s\x1c-\x1f]"


def title_match_hyphen(title: Column) -> Column:
    """Title key without hyphens. Underscores stay, so underscored titles do not meet spaced ones."""
    return F.lower(F.trim(F.replace(title, F.lit("-"), F.lit(""))))


def title_match(title: Column) -> Column:
    """Title key with spaces for underscores; the one that joins dump titles to pageview titles."""
    return F.lower(F.replace(title, F.lit("_"), F.lit(" ")))


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def title_normalized(title: Column) -> Column:
    """ASCII form of a title; distinct titles can share it."""
    return F.regexp_replace(F.replace(F.lower(strip(title)), F.lit(" "), F.lit("_")), "[^a-z0-9_-]", "")


def vector_id(title: Column, chunk_idx: Column) -> Column:
    """Id of a chunk's vector by its normalized title; collides where titles do."""
    return F.concat_ws("_", title_normalized(title), chunk_idx.cast("string"))


def safe_vector_id(key: Column, chunk_idx: Column) -> Column:
    """Id of a chunk's vector by the digest of its title key; does not collide."""
    return F.concat(F.md5(key.cast("binary")), F.lit("#"), chunk_idx.cast("string"))


def source_id(title: Column, url: Column) -> Column:
    return F.md5(F.concat(title, url).cast("binary"))


def chunk_id(title: Column, url: Column, chunk_idx: Column) -> Column:
    return F.concat(source_id(title, url), F.lit("#"), chunk_idx.cast("string"))


def words(text: Column) -> Column:
    """Words between runs of Unicode white space."""
    return F.filter(F.split(text, rf"(?U){SPACE}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def single_space_count(text: Column) -> Column:
    """Parts between single spaces; empty parts count."""
    return F.size(F.split(text, " ", -1))


def normalize_whitespace(text: Column) -> Column:
    """Three or more newlines to two, spaces and tabs to one, then no blanks around newlines; in this order."""
    for pattern, to in ((r"\n{3,}", "\n\n"), (r" {3,}", " "), (r"\t{3,}", "\t"), (r"[ \t]*\n[ \t]*", "\n")):
        text = F.regexp_replace(text, pattern, to)
    return text


def clean_scraped(text: Column) -> Column:
    """Three or more newlines to two, two or more tabs to one, no carriage returns."""
    return F.replace(F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"\t{2,}", "\t"), F.lit("\r"), F.lit(""))


def link_targets(wikitext: Column) -> Column:
    """Targets of [[...]] links, before any pipe."""
    return F.regexp_extract_all(wikitext, F.lit(r"\[\[([^|\]]+)"), 1)


def link_bodies(wikitext: Column) -> Column:
    """Whole bodies of [[...]] links."""
    return F.regexp_extract_all(wikitext, F.lit(r"\[\[(.*?)\]\]"), 1)


def category_bodies(wikitext: Column, prefix: str = "Category:") -> Column:
    """Bodies of category links, with their sort keys."""
    return F.regexp_extract_all(wikitext, F.lit(r"\[\[\Q" + prefix + r"\E(.*?)\]\]"), 1)


def categories_of_links(links: Column, prefix: str = "Category:") -> Column:
    """Of link titles, those that are categories, stripped, without the prefix."""
    return F.transform(F.filter(links, lambda x: F.startswith(x, F.lit(prefix))), lambda x: strip(F.substr(x, F.lit(len(prefix) + 1))))


def joined(values: Column) -> Column:
    return F.array_join(values, "|")


def article_url(title: Column, lang: str = "en") -> Column:
    return F.concat(F.lit(f"https://{lang}.wikipedia.org/wiki/"), F.replace(title, F.lit(" "), F.lit("_")))


def quoted(text: Column) -> Column:
    """Percent-encoded UTF-8; letters, digits and _.-~/ stay."""
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def article_url_quoted(title: Column, lang: str = "en") -> Column:
    return F.concat(F.lit(f"https://{lang}.wikipedia.org/wiki/"), quoted(F.replace(title, F.lit(" "), F.lit("_"))))


def curid_url(page_id: Column, lang: str = "en") -> Column:
    """Url by page id; null without one."""
    return F.concat(F.lit(f"https://{lang}.wikipedia.org/w/index.php?curid="), page_id.cast("string"))


def first_real_page_id(ids: Column) -> Column:
    """The least id that is neither null nor the word null."""
    return F.try_element_at(F.filter(F.array_sort(ids), lambda x: x.isNotNull() & (x != "null")), F.lit(1))


def wiki_language(wiki_code: Column) -> Column:
    return F.substring_index(wiki_code, ".", 1)


def path_language(path: Column) -> Column:
    """The last folder of a path."""
    return F.try_element_at(F.split(path, "/"), F.lit(-2))


def prefix_before_colon(title: Column) -> Column:
    return F.when(F.instr(title, ":") > 0, F.substring_index(title, ":", 1))


#: Fixed value: what is put before each chunk of an article.
CHUNK_PREFIX = "This is text from the wikipedia article with title: "


def with_chunk_prefix(title: Column, chunk: Column, quote: bool = True) -> Column:
    mark = F.lit("'" if quote else "")
    return F.concat(F.lit(CHUNK_PREFIX), mark, strip(title), mark, F.lit("\n"), chunk)


def symbol_counts(code: Column) -> Column:
    """Views by hour or day from a code like A2B1: an array of (slot, count); A is slot 1."""
    found = F.regexp_extract_all(code, F.lit(r"[^0-9][0-9]+"), 0)
    return F.transform(found, lambda x: F.struct((F.ascii(x) - 64).alias("slot"), F.substr(x, F.lit(2)).cast("int").alias("views")))


def padded_month(date: Column) -> Column:
    return F.date_format(date, "MM")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either has no length."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.when(a.isNotNull() & b.isNotNull(), F.lit(0.0)))


def l2_normalized(a: Column) -> Column:
    """a of length 1; zeros stay zeros. The length is bound in an array of one, so that it is computed once and not for each number."""
    scaled = F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: F.coalesce(F.try_divide(x.cast("double"), n), F.lit(0.0)).cast("float")))
    return F.when(a.isNotNull(), scaled[0])


def eta_seconds(done: Column, total: Column, elapsed: Column) -> Column:
    """Time left at the pace so far; null before the first is done."""
    return F.try_divide(elapsed * (total - done), done)


def compression_ratio(raw: Column, packed: Column) -> Column:
    """How many times smaller the packed size is; null for none."""
    return F.try_divide(raw, packed)
