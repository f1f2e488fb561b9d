"""Token, lexicon and markup expressions."""

from __future__ import annotations

import html
import html.entities
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions.folds import let


def norm_token(c: Column) -> Column:
    """Trimmed lower-case token; empty becomes null."""
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def norm_tokens(arr: Column) -> Column:
    """Normalised tokens of an array, blanks removed; a null array is empty."""
    return F.coalesce(F.array_compact(F.transform(arr, norm_token)), F.array().cast("array<string>"))


def non_blank(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def literal_rx(terms) -> str:
    """Alternation that matches any of the literal terms."""
    return "|".join(re.sub(r"([.?*+^$()\[\]{}|\\])", r"\\\1", t) for t in terms)


def contains_any(c: Column, terms) -> Column:
    """True where any term is a substring; never null for a non-null text.

    One compiled pattern keeps generated code small; a chain of substring
    tests over a whole lexicon overflows the method size limit.
    """
    terms = list(terms)
    return F.contains(c, F.lit(terms[0])) if len(terms) == 1 else F.rlike(c, F.lit(literal_rx(terms)))


def first_match(text: Column, lexicon: dict[str, list[str]], test=contains_any) -> Column:
    """Canonical value of the first lexicon entry that matches, in lexicon order."""
    expr = None
    for canonical, terms in lexicon.items():
        cond = test(text, terms)
        expr = F.when(cond, canonical) if expr is None else expr.when(cond, canonical)
    return expr


def canon(c: Column, lexicon: dict[str, list[str]], fallback: str) -> Column:
    """Substring canonicalisation: first entry wins, else the fallback; blank is null."""
    s = norm_token(c)
    return F.when(s.isNotNull(), F.coalesce(first_match(s, lexicon), F.lit(fallback)))


def padded_words(c: Column) -> Column:
    """' w1 w2 ' form: every run of non-word characters becomes one space."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", " "), F.lit(" "))


def word_any(padded: Column, terms) -> Column:
    """Whole-word test on padded text; hyphenated terms compare as word sequences."""
    return contains_any(padded, [f" {t.replace('-', ' ')} " for t in terms])


def infer_canon(title: Column, description: Column, lexicon: dict[str, list[str]]) -> Column:
    """Whole-word inference: title first, then description."""
    return F.coalesce(
        first_match(padded_words(title), lexicon, word_any),
        first_match(padded_words(description), lexicon, word_any),
    )


def tags_of(text: Column, lexicon: dict[str, list[str]]) -> Column:
    """All lexicon keys with a substring hit, in lexicon order."""
    return F.array_compact(F.array(*[F.when(contains_any(text, terms), tag) for tag, terms in lexicon.items()]))


def text_blob(*parts: Column) -> Column:
    """Joined lower-case text with every run outside [a-z0-9åäö] turned into a space."""
    return F.trim(F.regexp_replace(F.lower(F.concat_ws(" ", *parts)), "[^a-z0-9åäö]+", " "))


def squash(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[\s\u00A0]+", " "))


def fold_label(c: Column) -> Column:
    """Lower-case ASCII letters and digits only, diacritics folded."""
    return F.regexp_replace(F.translate(F.lower(c), "åäöéè", "aaoee"), "[^a-z0-9]+", "")


def _table(entries: dict[str, str]) -> Column:
    """Map literal from two strings, so that the plan holds one value and not a literal an entry."""
    cut = "\u0001"
    return F.map_from_arrays(F.split(F.lit(cut.join(entries)), cut), F.split(F.lit(cut.join(entries.values())), cut))


# A reference is a number in either base, or a name of up to 32 characters; the closing semicolon may be missing.
_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
# Numbers that do not stand for their own code point: control codes, noncharacters
_ODD_NUMBERS = {str(n): s for n in (*range(0xA0), *range(0xFDD0, 0xFDF0), *(p * 0x10000 + 0xFFFE + i for p in range(17) for i in (0, 1)))
                if (s := html.unescape(f"&#{n};")) != chr(n)}
_NAMES = {name: value for name, value in html.entities.html5.items() if name.endswith(";")}
_OPEN_NAMES = {name: value for name, value in html.entities.html5.items() if not name.endswith(";")}
# References that are looked at before the whole table.
COMMON_ENTITIES = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": "\u00a0",
    "&copy;": "©", "&middot;": "·", "&amp;": "&",
}


def _numbered(ref: Column) -> Column:
    digits = F.regexp_extract(ref, "([0-9a-fA-F]+);?$", 1)
    hexed = F.rlike(ref, F.lit("^&#[xX]"))
    short = F.regexp_replace(digits, "^0+(?=.)", "")
    number = F.when(F.length(short) > 10, F.lit(0x110000)).when(hexed, F.conv(short, 16, 10).cast("bigint")).otherwise(short.cast("bigint"))

    def character(n):
        own = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        return F.when((n > 0x10FFFF) | n.between(0xD800, 0xDFFF), "\ufffd").otherwise(F.coalesce(_table(_ODD_NUMBERS)[n.cast("string")], own))

    return let(number, character)


def _named(ref: Column) -> Column:
    """The longest name that the reference begins with; without one it stays as it is."""
    name = F.substring(ref, 2, 40)
    prefixes = F.filter(F.transform(F.sequence(F.greatest(F.length(name) - 1, F.lit(2)), F.lit(2)), lambda n: F.substring(name, F.lit(1), n)),
                        lambda p: F.map_contains_key(_table(_OPEN_NAMES), p))
    longest = lambda p: F.concat(_table(_OPEN_NAMES)[p], F.substring(name, F.length(p) + 1, F.length(name)))
    cut = F.when(F.length(name) > 2, let(F.try_element_at(prefixes, F.lit(1)), longest))
    return F.coalesce(_table(_NAMES)[name], _table(_OPEN_NAMES)[name], cut, ref)


def _decode_once(c: Column) -> Column:
    def joined(parts):
        refs, gaps = parts["refs"], parts["gaps"]
        one = lambda r: F.coalesce(_table(COMMON_ENTITIES)[r], F.when(F.startswith(r, F.lit("&#")), _numbered(r)).otherwise(_named(r)))
        return F.concat(F.element_at(gaps, 1), F.array_join(F.transform(refs, lambda r, i: F.concat(one(r), F.element_at(gaps, i + 2))), ""))

    found = F.struct(F.regexp_extract_all(c, F.lit(_REFERENCE), 0).alias("refs"), F.split(c, _REFERENCE, -1).alias("gaps"))
    return F.when(F.contains(c, F.lit("&")), let(found, joined)).otherwise(c)


def decode_entities(c: Column) -> Column:
    """HTML character references decoded exactly, up to three passes, inside the JVM; text without '&' is left alone."""
    return let(let(_decode_once(c), _decode_once), _decode_once)


def clean_title(c: Column) -> Column:
    """Entities decoded, tags to spaces, whitespace collapsed; blank is null."""
    s = decode_entities(non_blank(c))
    s = F.regexp_replace(s, r"(?s)<[^>]+>", " ")
    return F.nullif(squash(s), F.lit(""))


def clean_description(c: Column) -> Column:
    """Breaks to newlines, tags stripped twice, one blank line between kept lines."""
    s = decode_entities(non_blank(c))
    s = F.regexp_replace(s, r"(?i)<\s*br\s*/?\s*>", "\n")
    s = F.regexp_replace(F.regexp_replace(s, r"(?s)<[^>]+>", " "), r"(?s)<[^>]+>", " ")
    lines = F.filter(F.transform(F.split(s, r"\r\n|\r|\n"), squash), lambda x: x != "")
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n\n"))


def user_agent_label(c: Column) -> Column:
    s = c
    chrome = F.regexp_extract(s, r"Chrome/(\d+)", 1)
    safari = F.regexp_extract(s, r"Version/(\d+).*Safari", 1)
    firefox = F.regexp_extract(s, r"Firefox/(\d+)", 1)
    return (
        F.when(F.coalesce(s, F.lit("")) == "", F.lit(None).cast("string"))
        .when(chrome != "", F.concat(F.lit("Chrome/"), chrome))
        .when(safari != "", F.concat(F.lit("Safari/"), safari))
        .when(firefox != "", F.concat(F.lit("Firefox/"), firefox))
        .otherwise("other")
    )


def availability(c: Column) -> Column:
    s = F.replace(F.replace(F.lower(c), F.lit(" "), F.lit("")), F.lit("_"), F.lit(""))
    return (
        F.when(F.contains(s, F.lit("instock")) | F.contains(s, F.lit("instoreonly")), "in_stock")
        .when(F.contains(s, F.lit("outofstock")) | F.contains(s, F.lit("soldout")), "out_of_stock")
        .when(F.contains(s, F.lit("preorder")) | F.contains(s, F.lit("presale")), "preorder")
        .when(F.contains(s, F.lit("backorder")), "backorder")
        .otherwise("unknown")
    )


def error_label(c: Column) -> Column:
    """Fetch-error text to a reason label; first rule wins."""
    s = F.lower(F.trim(c))
    rules = [
        (["blocked by robots"], "robots-blocked"), (["allowlist"], "allowlist-blocked"),
        (["429"], "http-429"), (["403"], "http-403"), (["404"], "http-404"), (["503"], "http-503"),
        (["timeout"], "timeout"), (["tls", "ssl", "certificate"], "tls-certificate"),
        (["name or service not known", "nodename nor servname provided"], "dns-failure"),
    ]
    expr = None
    for terms, label in rules:
        cond = contains_any(s, terms)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise(F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("unknown-fetch-error")))
