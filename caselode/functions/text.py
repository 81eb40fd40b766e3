"""Text predicates and keys as native column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def has_alias(lowered: Column, alias: str) -> Column:
    """Whether lower-cased text holds an alias: anywhere if it has a space or 8
    characters or more, otherwise not next to a-z or 0-9."""
    alias = alias.lower()
    if " " in alias or len(alias) >= 8:
        return lowered.contains(alias)
    # the plain search is cheap, and most texts don't hold the alias at all
    return lowered.contains(alias) & lowered.rlike(f"(?<![a-z0-9]){re.escape(alias)}(?![a-z0-9])")


def has_alias_sql(lowered: str, alias: str) -> str:
    """The same for engines whose patterns have no lookbehind."""
    alias = alias.lower()
    if " " in alias or len(alias) >= 8:
        return f"contains({lowered}, '{alias}')"
    return f"regexp_matches({lowered}, '(^|[^a-z0-9]){re.escape(alias)}($|[^a-z0-9])')"


def has_any(lowered: Column, phrases: list[str]) -> Column:
    return any_of([has_alias(lowered, p) for p in phrases])


def tokens(text: Column) -> Column:
    """Distinct lower-case tokens of two characters or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9][a-z0-9+._-]{1,}"), F.lit(0)))


def collapse(text: Column) -> Column:
    """White space of any script to single spaces, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def cves(text: Column) -> Column:
    found = F.regexp_extract_all(F.upper(text), F.lit(r"CVE-\d{4}-\d{4,7}"), F.lit(0))
    return F.array_sort(F.array_distinct(found))


def domains(text: Column, top_level: list[str], skip: list[str]) -> Column:
    """Distinct domains under the listed top-level names, sorted."""
    found = F.regexp_extract_all(F.lower(text), F.lit(rf"\b(?:[a-z0-9-]+\.)+(?:{'|'.join(top_level)})\b"), F.lit(0))
    return F.array_sort(F.array_except(F.array_distinct(found), F.array(*map(F.lit, skip)).cast("array<string>")))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normalise_title(title: Column) -> Column:
    """Lower case, up to two trailing source suffixes off, other characters to spaces, collapsed.

    A suffix is what follows a bar, a dash (hyphen, en or em) and holds no bar.
    """
    t = _strip(F.lower(_strip(title)))
    for _ in range(2):
        t = _strip(F.regexp_replace(t, r"\s*[|\u2013\u2014-]\s*[^|]+$", ""))
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9\s]", " "), r"\s+", " "))


def story_key(title: Column, published: Column, fallback: Column | None = None) -> Column:
    """First 16 hex digits of the SHA-1 of normalised title and day; without a date the day is that of the fallback, or "undated"."""
    stamp = published if fallback is None else F.coalesce(published, fallback)
    day = F.coalesce(F.date_format(stamp, "yyyy-MM-dd"), F.lit("undated"))
    return F.substring(F.sha1(F.concat_ws("|", normalise_title(title), day)), 1, 16)


def plain_quote(text: Column) -> Column:
    """Lower case, plain quotation marks and dashes, white space collapsed."""
    return collapse(F.translate(F.lower(text), "‘’“”–—", "''\"\"--"))


def quote_is_verbatim(quote: Column, body: Column) -> Column:
    """True or false by whether the normalised quote is in the normalised text, null where it is blank."""
    return F.when(plain_quote(quote) != "", F.contains(plain_quote(F.coalesce(body, F.lit(""))), plain_quote(quote)))


def head_tail(text: Column, cap: int, marker: str = "\n[...]\n") -> Column:
    """Long texts cut to their head and, of a sixth of the cap, their tail."""
    tail = cap // 6
    return F.when(F.length(text) <= cap, text).otherwise(
        F.concat(F.substring(text, 1, cap - tail), F.lit(marker), F.substring(text, -tail, tail))
    )


def first_wins(items: Column) -> Column:
    """Array without blanks and without items that equal an earlier one in lower case; order kept."""
    plain = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    return F.aggregate(
        plain,
        F.array().cast("array<string>"),
        lambda out, x: F.when(F.exists(out, lambda y: F.lower(y) == F.lower(x)), out).otherwise(F.array_append(out, x)),
    )


def operator_terms(framing: Column, aliases: Column, cve: Column, domain: Column) -> Column:
    """Framing, aliases, CVEs and domains in that order: 3 to 80 characters, no technique ids, first of equals."""
    terms = first_wins(F.concat(framing, aliases, cve, domain))
    return F.filter(terms, lambda t: F.length(t).between(3, 80) & ~t.rlike(r"^[A-Z]{2}\d{3}(\.\d{3})?$"))


#: Endings of names of companies.
COMPANY_WORDS = ["llc", "inc", "ltd", "corp", "corporation", "company", "group", "holdings", "partners", "studios", "logistics", "resources"]


def is_entity_term(term: Column) -> Column:
    """Names rather than indicators: blank terms, addresses, a company word after another word,
    or two words and more of which at least 60 % of those that begin with a letter have a capital."""
    words = F.filter(F.split(_strip(term), r"\s+"), lambda w: w != "")
    letters = F.filter(words, lambda w: w.rlike(r"^\p{L}"))
    capital = F.size(F.filter(letters, lambda w: w.rlike(r"^\p{Lu}")))
    company = F.lower(_strip(term)).rlike(rf" ({'|'.join(COMPANY_WORDS)})( |$)") | F.lower(_strip(term)).rlike(rf"^({'|'.join(COMPANY_WORDS)}) ")
    names = (F.size(words) >= 2) & (F.size(letters) > 0) & (capital >= 0.6 * F.size(letters))
    return (F.size(words) == 0) | F.contains(term, F.lit("@")) | company | names


def labelled_line(text: Column, label: str) -> Column:
    """What follows `label:` on a line of its own; null if there is no such line."""
    found = F.regexp_extract(text, rf"(?m)^{re.escape(label)}:\s*(.+?)\s*$", 1)
    return F.when(found != "", found)


def number_in_path(url: Column, part: str) -> Column:
    """The number after /part/ in a URL."""
    return F.regexp_extract(url, rf"/{re.escape(part)}/(\d+)", 1).try_cast("long")


def handle(name: Column) -> Column:
    """A social handle without @, URL and capitals."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(name), r"^https?://[^/]+/", ""), r"^@|[/?].*$", ""))


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def wait_seconds(error: Column, most: int = 3600) -> Column:
    """Seconds that a throttling message asks to wait, at most `most`; null if it names none."""
    asked = F.regexp_extract(error, r"(?i)(?:in|after) (\d+) seconds?", 1).try_cast("int")
    return F.when(asked.isNotNull(), F.least(asked, F.lit(most)))


def filing_story_key(court: Column, docket: Column) -> Column:
    """First 16 hex digits of the SHA-1 of a filing's court and docket number: one case on all days."""
    plain = [F.regexp_replace(F.lower(_strip(F.coalesce(c, F.lit("")))), r"\s+", " ") for c in (court, docket)]
    return F.substring(F.sha1(F.concat_ws("|", F.lit("docket"), *plain)), 1, 16)
