"""Text expressions. Everything here is a plain Column expression, so it stays inside codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

# One class for "white space" that reads the same in Java and RE2 regexes and covers the same
# characters as Unicode-aware strip/split.
WS = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]"
NOT_WS = r"[^\s\p{Z}\x0b\x1c-\x1f\x{85}]"
# the same class character by character
WS_CHARS = "\t\n\x0b\f\r" + "".join(map(chr, [*range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def bind(value: Column, body) -> Column:
    """`body(value)` with `value` evaluated once, for expressions that use a costly value several times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Without the white space at both ends; only the ends are looked at."""
    return F.btrim(c, F.lit(WS_CHARS))


def collapse(c: Column) -> Column:
    """Every run of white space becomes one blank; ends are stripped."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def norm_key(c: Column) -> Column:
    """Lower-case, stripped, single-blank form used as an exact de-duplication key."""
    return collapse(F.lower(c))


def lower_strip(c: Column) -> Column:
    return strip(F.lower(c))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def token_count(c: Column) -> Column:
    """Default token counter: white-space separated words."""
    return F.coalesce(F.regexp_count(c, F.lit(f"{NOT_WS}+")), F.lit(0)).cast("int")


def sentence_count(c: Column) -> Column:
    """Pieces between sentence marks whose stripped length exceeds 10, at least 1; tags ignored.

    A piece qualifies exactly when it holds a non-blank, nine or more characters and another
    non-blank, which one codegen-friendly regex count expresses without building the pieces.
    """
    clean = F.regexp_replace(c, "<[^>]+>", "")
    edge = r"[^.!?\s\p{Z}\x0b\x1c-\x1f\x{85}]"
    return F.greatest(F.lit(1), F.regexp_count(clean, F.lit(f"{edge}[^.!?]{{9,}}{edge}"))).cast("int")


def min_expected_statements(c: Column, ratio: float = 1.0) -> Column:
    return (sentence_count(c) * F.lit(ratio)).cast("int")


def wrap_page(c: Column) -> Column:
    return F.when(c.startswith("<page>"), c).otherwise(F.concat(F.lit("<page>"), c, F.lit("</page>")))


def strip_page_tags(c: Column) -> Column:
    out = F.regexp_replace(c, r"(?i)\s*</?\s*page\s*>\s*", "")
    out = F.regexp_replace(out, r"[,\s]+PAGE(?=[\s)\].]|$)", "")
    return strip(F.regexp_replace(out, r"(?i)^\s*NONE\s*$", ""))


def parse_entity_type(c: Column, trim: bool = False) -> Column:
    t = F.upper(strip(c) if trim else c)
    return F.when(t.isin(*fixed.ENTITY_TYPES), t).otherwise(F.lit("UNKNOWN"))


def content_type(header: Column, url: Column) -> Column:
    """pdf / html / binary / unknown from the content-type header first, the URL second."""
    h = F.coalesce(F.lower(header), F.lit(""))
    path = F.split_part(F.lower(url), F.lit("?"), F.lit(1))
    return (
        F.when(h.contains("application/pdf"), "pdf")
        .when(h.contains("text/html") | h.contains("application/xhtml+xml"), "html")
        .when(path.endswith(".pdf"), "pdf")
        .when(path.endswith(".html") | path.endswith(".htm"), "html")
        .when(h.startswith("text/"), "html")
        .when(h.rlike("^(image|audio|video)/"), "binary")
        .otherwise("unknown")
    )


def is_captcha(html: Column) -> Column:
    low = F.lower(html)
    hit = reduce(lambda a, b: a | b, [low.contains(p) for p in fixed.CAPTCHA_PHRASES])
    return (F.length(low) <= fixed.CAPTCHA_MAX_CHARS) & hit


def clean_title(c: Column) -> Column:
    return strip(F.regexp_extract(strip(c), r"(?s)^(.*?)(\s*[|—\-]|$)", 1))


def clean_whitespace(c: Column) -> Column:
    """CRLF to LF, runs of blanks to one, three or more newlines to two, then strip each line."""
    out = F.regexp_replace(c, r"\r\n?", "\n")
    out = F.regexp_replace(out, r"[\t\x0b\f\r\x1c-\x1f\x{85}\p{Z}]+", " ")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    out = F.regexp_replace(out, r" *\n *", "\n")
    return strip(out)


def words_regex(words: list[str]) -> str:
    """Whole-word alternation with Unicode-aware word edges."""
    return r"(?<![\p{L}\p{N}_])(?:" + "|".join(words) + r")(?![\p{L}\p{N}_])"


def citation(title: Column, authors: Column, year: Column, page: Column) -> Column:
    """"Title - Author - Year - p. N" with empty parts left out; null when nothing is left."""
    who = (
        F.when(F.size(authors) == 1, authors[0])
        .when(F.size(authors) == 2, F.concat_ws(" & ", authors))
        .when(F.size(authors) > 2, F.concat(authors[0], F.lit(" et al.")))
    )
    return blank_to_null(F.concat_ws(
        " - ",
        blank_to_null(title),
        blank_to_null(who),
        F.when(year != 0, year.cast("string")),
        F.when(page.isNotNull(), F.concat(F.lit("p. "), page.cast("string"))),
    ))


def sentence_span(text: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """Widen a half-open 0-based span to sentence edges (. ! ? newline), end mark included."""
    left = F.substring(text, F.lit(1), start)
    right = F.substring(text, end + 1, F.length(text))
    # read backwards: a pattern anchored at the end would be tried from every earlier position
    new_start = start - F.length(F.regexp_extract(F.reverse(left), r"^([^.!?\n]*)", 1))
    new_end = end + F.length(F.regexp_extract(right, r"^([^.!?\n]*[.!?\n]?)", 1))
    return new_start, new_end


def context_snippet(text: Column, start: Column, end: Column, max_chars: int = 400) -> Column:
    """Sentence around a span inside a window of max_chars/2 on each side."""
    half = max_chars // 2
    lo = F.greatest(F.lit(0), start - half)
    hi = F.least(F.length(text), end + half)
    left = F.substring(text, lo + 1, start - lo)
    right = F.substring(text, end + 1, hi - end)
    left_keep = F.reverse(F.regexp_extract(F.reverse(left), r"^([^.!?\n]*)", 1))
    right_keep = F.regexp_extract(right, r"^([^.!?\n]*[.!?\n]?)", 1)
    snippet = strip(F.concat(left_keep, F.substring(text, start + 1, end - start), right_keep))
    bad = (start < 0) | (end > F.length(text)) | (start >= end)
    return F.when(bad, F.substring(text, F.lit(1), F.lit(max_chars))).otherwise(snippet)


def preview(c: Column, width: int = 100) -> Column:
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width), F.lit("..."))).otherwise(c)


def display_name(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def _drop_each(c: Column, parts: list[str], hit, rest) -> Column:
    """Folds over fixed parts in list order: where `hit` holds for a part, `rest` cuts it off once."""
    listed = F.array(*[F.lit(p) for p in parts])
    return F.aggregate(listed, c, lambda acc, p: F.when(hit(acc, p), rest(acc, p)).otherwise(acc))


def normalize_person(c: Column) -> Column:
    """Lower case, leading titles removed in list order, single blanks."""
    cut = lambda t, p: F.substring(t, F.length(p) + 1, F.length(t))
    return collapse(_drop_each(lower_strip(c), fixed.PERSON_TITLES, lambda t, p: t.startswith(p), cut))


def normalize_org(c: Column) -> Column:
    """Lower case, trailing suffixes removed in list order (so they can stack)."""
    cut = lambda t, p: F.substring(t, F.lit(1), F.length(t) - F.length(p))
    return strip(_drop_each(lower_strip(c), fixed.ORG_SUFFIXES, lambda t, p: t.endswith(p), cut))


def same_role(x: Column, y: Column) -> Column:
    """Role match of two lower-cased, stripped roles: equal, same synonym group, or one in the other."""
    same_group = reduce(lambda p, q: p | q, [x.isin(*g) & y.isin(*g) for g in fixed.ROLE_SYNONYMS])
    return (x == y) | same_group | y.contains(x) | x.contains(y)


def same_org(x: Column, y: Column) -> Column:
    """Match of two normalised organisation names: equal or one in the other."""
    return (x == y) | y.contains(x) | x.contains(y)


def role_matches(a: Column, b: Column) -> Column:
    return same_role(lower_strip(a), lower_strip(b))


def org_matches(a: Column, b: Column) -> Column:
    return same_org(normalize_org(a), normalize_org(b))


def escape_xml(c: Column) -> Column:
    for raw, ent in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(raw), F.lit(ent))
    return c


def quote_csv(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))


def fixed3(c: Column) -> Column:
    """Three decimals, as text; null stays null (format_string alone would print it)."""
    return F.when(c.isNotNull(), F.format_string("%.3f", c))
