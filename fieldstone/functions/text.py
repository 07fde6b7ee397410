"""Normal forms, trigram similarity and token ranking of texts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_text(x: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$", ""), r"\s+", " "))


def normalize_registry(x: Column) -> Column:
    """Upper case without blanks, dots and hyphens, then without leading zeros; null when nothing is left."""
    return F.nullif(F.regexp_replace(F.regexp_replace(F.upper(x), r"[\s.\-]", ""), "^0+", ""), F.lit(""))


def normalize_email(x: Column) -> Column:
    trimmed = F.lower(F.trim(x))
    return F.when(trimmed.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s.]+$"), trimmed)


def normalize_url(x: Column) -> Column:
    """Scheme and host in lower case, a bare closing slash removed; null for other schemes and where credentials stand."""
    scheme, host, rest = (F.regexp_extract(x, r"^(?i)(https?)://([^/?#]*)(.*)$", i) for i in (1, 2, 3))
    return F.when((scheme != "") & (host != "") & ~host.contains("@"), F.concat(F.lower(scheme), F.lit("://"), F.lower(host), F.when(rest == "/", "").otherwise(rest)))


def normalize_domain(x: Column) -> Column:
    """The host of an address or URL without www., in lower case. The list of public suffixes isn't part of this library: subdomains stay."""
    host = F.regexp_extract(F.lower(F.trim(x)), r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^@/]*@)?(?:www\.)?([a-z0-9.-]+)", 1)
    return F.when(host.contains("."), F.regexp_replace(host, r"\.$", ""))


def normalize_phone(x: Column) -> Column:
    """+ and 7 to 15 digits; null otherwise. Numbering plans aren't checked."""
    digits = F.regexp_replace(x, r"[^\d+]", "")
    return F.when(digits.rlike(r"^\+[1-9]\d{6,14}$"), digits)


NORMAL_FORMS = {"text": normalize_text, "registry_id": normalize_registry, "email": normalize_email, "url": normalize_url, "domain": normalize_domain, "phone": normalize_phone}


def trigrams(x: Column) -> Column:
    """Distinct trigrams of the lower-cased words of letters and digits, each with two blanks before and one behind."""
    words = F.filter(F.split(F.lower(x), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    of = lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, of)))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of trigrams; 0 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def tokens(x: Column) -> Column:
    """Tokens of a search text: runs of letters and digits, e-mail addresses and hosts also whole."""
    low = F.lower(F.coalesce(x, F.lit("")))
    whole = F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}_-]+(?:[.@][\p{L}\p{N}_-]+)+"), F.lit(0))
    return F.concat(F.filter(F.split(low, r"[^\p{L}\p{N}]+"), lambda w: w != ""), whole)


def term_rank(occurrences: Column) -> Column:
    """Rank of a term that occurs n times, each weighted 0.1: 0.1 / 1.64493406685 times the sum of 1/j^2 for j up to n."""
    series = F.aggregate(F.sequence(F.lit(1), F.greatest(occurrences, F.lit(1))), F.lit(0.0), lambda s, j: s + 1.0 / (j * j))
    return F.when(occurrences > 0, series * (0.1 / 1.64493406685)).otherwise(0.0)


def utf8_truncate(x: Column, size: int) -> Column:
    """The longest beginning of a text that has at most `size` bytes of UTF-8, without a broken character at its end."""
    head = F.substring(F.encode(x, "UTF-8"), 1, size)
    return F.when(F.octet_length(x) <= size, x).otherwise(F.regexp_replace(F.make_valid_utf8(head.cast("string")), "�+$", ""))


def strip_markdown(x: Column) -> Column:
    """Plain text of common Markdown: headings, emphasis, code, quotes, lists, links and images."""
    x = F.regexp_replace(x, r"(?m)^\s{0,3}(#{1,6}|>|[-*+]|\d+\.)\s+", "")
    x = F.regexp_replace(x, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[*_`~]{1,3}", ""), r"\s+", " "))


def canonical_json(entries: Column) -> Column:
    """A map of strings as JSON whose keys are sorted: equal maps give equal strings."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))


def dedupe_by(values: Column, form=normalize_text) -> Column:
    """The values whose normal form comes first among their like, in order."""
    forms = F.transform(values, form)
    return F.filter(values, lambda x, i: F.array_position(forms, form(x)) == i + 1)


def ordered_union(lists: Column, form=normalize_text) -> Column:
    """All values of lists, an array of arrays in order (the survivor's first), each normal form once."""
    return dedupe_by(F.flatten(F.filter(lists, lambda x: x.isNotNull())), form)


def rfc3339(x: Column) -> Column:
    """The instant of a time with seconds and an offset or Z, in milliseconds; null for anything else."""
    sound = x.rlike(r"^\d{4}-\d{2}-\d{2}[Tt]([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d+)?([Zz]|[+-]([01]\d|2[0-3]):[0-5]\d)$")
    return F.when(sound, F.date_trunc("MILLISECOND", F.try_to_timestamp(F.upper(x))))
