"""Text functions as column expressions.

Java's `\\w`, `\\s` and `(?i)` are ASCII unless told otherwise, so patterns
over Cyrillic carry `(?U)` or `(?iu)`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .profiles import Profile


def plain_e(text: Column) -> Column:
    return F.translate(F.lower(text), "ё", "е")


def normalize_query(text: Column) -> Column:
    """Lower case, ё as е, all but letters, digits, _ and - as single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(plain_e(text), r"(?U)[^\w\s\-]", " "), r"(?U)\s+", " "))


def normalize_query_client(text: Column) -> Column:
    """The narrower form: only a-z, а-я, digits, _ and - survive."""
    return F.trim(F.regexp_replace(F.regexp_replace(plain_e(text), r"[^a-zа-я0-9_\s-]", " "), r"(?U)\s+", " "))


def raw_tokens(text: Column, profile: Profile) -> Column:
    """Runs of the profile's token characters, before stopwords and stems; null: none."""
    return F.regexp_extract_all(plain_e(F.coalesce(text, F.lit(""))), F.lit(profile.token), F.lit(0))


def kept_token(token: Column, profile: Profile) -> Column:
    """Two characters or more and not a stopword."""
    return (F.length(token) >= 2) & ~token.isin(*profile.stopwords) if profile.stopwords else F.length(token) >= 2


def stem(token: Column, profile: Profile) -> Column:
    """A token without the longest of the profile's suffixes that leaves three characters."""
    out = F.when(F.lit(False), token)
    for suffix in sorted(profile.suffixes, key=len, reverse=True):
        rest = F.length(token) - len(suffix)
        out = out.when((rest >= 3) & F.endswith(token, F.lit(suffix)), F.left(token, rest))
    return out.otherwise(token)


def tokenize(text: Column, profile: Profile) -> Column:
    """Stemmed tokens without stopwords and single characters; null: none."""
    tokens = F.filter(raw_tokens(text, profile), lambda w: kept_token(w, profile))
    if not profile.suffixes:
        return tokens
    return F.filter(F.transform(tokens, lambda w: stem(w, profile)), lambda w: kept_token(w, profile))


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"(?U)\S+")).cast("int")


def squeeze(text: Column) -> Column:
    """Trimmed, lower case, ё as е, white space as single blanks."""
    return F.trim(F.regexp_replace(plain_e(text), r"(?U)\s+", " "))


def document_number(text: Column) -> Column:
    """The first code number (СНиП, СН РК, СП РК) in a text; '' if none."""
    # Fixed value: how code numbers are written.
    return F.regexp_extract(text, r"(?iu)((?:СНиП|СН\s*РК|СП\s*РК)\s*[\d.\-]+)", 1)


def document_type(number: Column) -> Column:
    """Document type by the number's prefix, in upper case."""
    up = F.upper(number)
    # The prefixes of the types.
    return (
        F.when(up.startswith("СНИП"), "СНиП").when(up.startswith("СН РК"), "СН РК").when(up.startswith("СП РК"), "СП РК").otherwise("НТД")
    )


def line_kind(line: Column) -> Column:
    """table, chapter, paragraph or text: what a stripped line starts."""
    return (
        F.when(line.rlike(TABLE), "table").when(line.rlike(CHAPTER), "chapter").when(line.rlike(PARAGRAPH), "paragraph").otherwise("text")
    )


# How lines of building codes begin.
PARAGRAPH = r"^\s*(\d+(?:\.\d+){1,4})(?:[\.\)])?\s+"
CHAPTER = r"(?iu)^\s*(?:Глава|Раздел|Приложение)\s+(?:\d+|[А-ЯA-Z])"
TABLE = r"(?iu)^\s*Таблица\s+(\d+)"


def status_from_text(text: Column) -> Column:
    """expired or replaced by the words of a listing, else active; replaced wins."""
    low = F.lower(text)
    return F.when(low.contains("заменен"), "replaced").when(low.contains("утратил"), "expired").otherwise("active")


def safe_name(name: Column, limit: int = 50) -> Column:
    return F.substring(F.regexp_replace(name, r"(?U)[^\w.\-]", "_"), 1, limit)


def upload_name(name: Column, limit: int = 200) -> Column:
    """Sanitised file name: odd characters as _, runs collapsed, cut."""
    return F.substring(F.regexp_replace(F.regexp_replace(name, r"(?U)[^\w\-.]", "_"), "_+", "_"), 1, limit)


def trigrams(text: Column) -> Column:
    """The set of trigrams of the words of a text, two blanks before and one after."""
    # three blanks between words: of what starts at any place, only what lies in one padded word is taken
    padded = F.concat(F.lit("  "), F.regexp_replace(F.lower(text), r"(?U)\W+", "   "), F.lit(" "))
    return F.array_distinct(F.regexp_extract_all(padded, F.lit(r"(?=(  [^ ]| [^ ].|[^ ][^ ].))"), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def highlight_tokens(query: Column) -> Column:
    """Distinct words of a query, hyphenated words also by their parts."""
    words = F.filter(F.split(normalize_query(query), " "), lambda w: F.length(w) >= 2)
    parts = lambda w: F.when(w.contains("-"), F.concat(F.array(w), F.split(w, "-"))).otherwise(F.array(w))
    return F.array_distinct(F.filter(F.flatten(F.transform(words, parts)), lambda w: F.length(w) >= 2))


def highlight(text: Column, tokens: list[str]) -> Column:
    """Mark the tokens, longest first, е and ё alike, in any case."""
    import re

    if not tokens:
        return text
    alike = lambda t: re.sub("[её]", "[её]", re.escape(t.lower()))
    pattern = "|".join(alike(t) for t in sorted(set(tokens), key=lambda t: (-len(t), t)))
    return F.regexp_replace(text, f"(?iu)({pattern})", "<mark>$1</mark>")


def status_label(status: Column) -> Column:
    """Russian label of a status; an unknown one is its own label."""
    # Labels of the statuses.
    labels = {"active": "Действует", "replaced": "Заменён", "expired": "Утратил силу", "amended": "С изменениями", "draft": "Проект"}
    out = status
    for k, v in labels.items():
        out = F.when(status == k, v).otherwise(out)
    return out


def guessed_number(sample: Column, stem: Column) -> Column:
    """The first code number in the head of a document or its file's name, else the name (100 characters)."""
    # Fixed value: prefixes of code numbers.
    pattern = r"(?iu)(СН\s*РК|СП\s*РК|СНиП|ГОСТ|СТ\s*РК)[\s\-]*([\d.\-]+\s*\d*)"
    text = F.concat_ws(" ", sample, stem)
    found = F.concat(F.upper(F.regexp_extract(text, pattern, 1)), F.lit(" "), F.trim(F.regexp_extract(text, pattern, 2)))
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(F.substring(stem, 1, 100))


def guessed_title(title: Column, stem: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), F.substring(F.replace(stem, F.lit("_"), F.lit(" ")), 1, 300))


def guessed_type(number: Column, stem: Column) -> Column:
    """The national kinds win over СНиП, which may also stand in the file's name."""
    up = F.upper(number)
    snip = F.contains(up, F.lit("СНИП")) | F.contains(F.upper(stem), F.lit("СНИП"))
    return F.when(F.contains(up, F.lit("СН РК")), "СН РК").when(F.contains(up, F.lit("СП РК")), "СП РК").when(snip, "СНиП").otherwise("НТД")


def relevance_band(percent: Column) -> Column:
    """The four bands in which hits are shown."""
    return F.when(percent >= 90, "emerald").when(percent >= 75, "blue").when(percent >= 55, "amber").otherwise("slate")


def hue(text: Column) -> Column:
    """A stable hue (0 to 359) of a string: a 32-bit rolling hash with factor 31.

    Characters beyond the basic plane count by their code point.
    """
    wrapped = lambda x: F.pmod(x + 2147483648, F.lit(4294967296)) - 2147483648
    step = lambda h, c: F.ascii(c).cast("long") + wrapped(wrapped(h) * 32) - h
    characters = F.filter(F.split(text, ""), lambda c: c != "")
    return (F.abs(F.aggregate(characters, F.lit(0).cast("long"), step)) % 360).cast("int")


def mask(key: Column, head: int = 4, tail: int = 4) -> Column:
    """The ends of a secret; all of a short one."""
    return F.when(F.length(key) <= head + tail, key).otherwise(F.concat(F.substring(key, 1, head), F.lit("…"), F.right(key, F.lit(tail))))


def join_url(base: Column, href: Column) -> Column:
    """Absolute address of a link on a site."""
    root = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    return F.when(href.rlike("^https?://"), href).when(href.startswith("/"), F.concat(root, href)).otherwise(F.concat(root, F.lit("/"), href))


def without_fences(text: Column) -> Column:
    """A model's output without thoughts, code fences and trailing commas."""
    out = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    out = F.regexp_replace(out, r"```(?:json)?", "")
    return F.regexp_replace(F.regexp_replace(out, r",\s*([}\]])", "$1"), r"(?U)^\s+|\s+$", "")
