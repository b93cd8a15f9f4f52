"""Text functions as columns: cleaning, counting, references, offsets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"[ \t\n\r\f\x0B]"
BLANKS = " \t\n\r\f\x0b"

#: What is removed from a text, in this order, with the replacement.
STRIP = (
    (r"(?s)<!--.*?-->", ""),
    (r"(?s)```.*?```", ""),
    (r"`[^`\n]+`", ""),
    (r"(?md)^>.*$", ""),
    (r"!\[[^\]]*\]\([^)]*\)", ""),
    (r"@[\p{L}\p{N}_]+", ""),
    (r"\n{3,}", "\n\n"),
)
#: Each pattern of STRIP needs one of these in the text.
MARKS = (">", "`", "![", "@", "\n\n\n")
#: Reference words and their canonical forms.
REFERENCE = r"(?i)(?:(close[sd]?|fix(?:e[sd])?|resolve[sd]?|ref(?:erence)?s?|see)[ \t\n\r\f\x0B]+)?#([0-9]+)"
MECHANISMS = {
    "close": "closes", "closed": "closes", "closes": "closes", "fix": "fixes", "fixed": "fixes", "fixes": "fixes",
    "resolve": "resolves", "resolved": "resolves", "resolves": "resolves", "ref": "refs", "refs": "refs", "reference": "refs", "references": "refs", "see": "see",
}
LINK = r'<([^>]+)>; *rel="([^"]+)"'
TOKEN = r"[A-Za-z]+n't|'(?:ll|re|ve|m|s|d)\b|[\p{L}\p{N}_]+|[^ \t\n\r\f\x0B\p{L}\p{N}_]"
YEAR = r"\b(19[7-9][0-9]|20[0-4][0-9])\b"
OVERSHOOT = 2


def strip_ends(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))


def strip_steps(c: Column) -> list[Column]:
    """The text after each cleaning step, in order; a null text is empty."""
    out, now = [], F.coalesce(c, F.lit(""))
    for pattern, to in STRIP:
        now = F.regexp_replace(now, F.lit(pattern), F.lit(to))
        out.append(now)
    return out


def strip_text(c: Column) -> Column:
    """The text after all cleaning steps; one without a mark that some step needs is not searched."""
    text = F.coalesce(c, F.lit(""))
    marked = reduce(Column.__or__, [text.contains(m) for m in MARKS])
    return strip_ends(F.when(marked, strip_steps(c)[-1]).otherwise(text))


def n_words(c: Column) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(c, f"{WHITE}+"), lambda x: x != "")).cast("int")


def clean_urn(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), "^<+|>+$", "")


def references(c: Column) -> Column:
    """array<struct<number, mechanism>> of the `#n` in a text, in order."""
    words = F.transform(F.regexp_extract_all(c, F.lit(REFERENCE), F.lit(1)), lambda x: F.lower(x))
    known = F.create_map(*[F.lit(x) for kv in MECHANISMS.items() for x in kv])
    numbers = F.regexp_extract_all(c, F.lit(REFERENCE), F.lit(2))
    return F.zip_with(numbers, words, lambda n, w: F.struct(n.try_cast("bigint").alias("number"), F.coalesce(known[w], F.lit("bare")).alias("mechanism")))


def links(c: Column) -> Column:
    """map<rel, url> of a Link header; rels are taken not to repeat."""
    return F.map_from_arrays(F.regexp_extract_all(c, F.lit(LINK), F.lit(2)), F.regexp_extract_all(c, F.lit(LINK), F.lit(1)))


def first_year(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, YEAR, 1), F.lit("")).cast("int")


def length_bucket(n: Column) -> Column:
    return F.when(n == 0, "0").when(n < 200, "1-200").when(n < 1000, "200-1k").when(n < 5000, "1k-5k").otherwise("5k+")


def pieces(c: Column) -> Column:
    """Tokens with the white space before them: their lengths add up to exact offsets. Contractions are parted."""
    raw = F.regexp_extract_all(c, F.lit(rf"{WHITE}*(?:{TOKEN})"), F.lit(0))
    cut = lambda p, n: F.array(F.substring(p, F.lit(1), F.length(p) - n), F.right(p, F.lit(n)))
    part = lambda p: F.when(F.lower(p).endswith("n't") & (F.length(F.ltrim(p)) > 3), cut(p, 3)).when(F.lower(strip_ends(p)) == "cannot", cut(p, 3)).otherwise(F.array(p))
    low = F.lower(c)
    return F.when(low.contains("n't") | low.contains("cannot"), F.flatten(F.transform(raw, part))).otherwise(raw)  # most texts have nothing to part


def bare(c: Column) -> Column:
    """Tokens without the white space before them."""
    return F.transform(c, lambda p: F.ltrim(p, F.lit(BLANKS)))


def utf8_to_chars(text: Column, n: Column) -> Column:
    """Whole characters in the first n bytes of the UTF-8 form."""
    whole = F.length(F.substring(text.cast("binary"), F.lit(1), n).cast("string"))
    return F.when(F.octet_length(F.left(text, whole)) > n, whole - 1).otherwise(whole)


def utf16_to_chars(text: Column, n: Column) -> Column:
    """Whole characters in the first n code units of the UTF-16 form; a cut surrogate pair is left out."""
    units = F.encode(text, "UTF-16LE")
    cut = F.hex(F.substring(units, 2 * n, F.lit(1))).rlike("^D[89AB]") & (2 * n < F.octet_length(units))
    whole = n - F.when(cut, 1).otherwise(0)
    return F.length(F.decode(F.substring(units, F.lit(1), 2 * whole), "UTF-16LE"))
