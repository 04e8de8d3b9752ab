"""Text expressions: headline and name normalisation, fingerprints, similarity, injection marks, HTML.

All are column expressions; Unicode normal forms are taken in batches, of the texts that hold anything beyond ASCII."""

from __future__ import annotations

import sys
from unicodedata import combining, normalize

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that don't identify a headline, name endings.
HEADLINE_STOPWORDS = (
    "a an and are as at be by for from has have how in into is it its of on or that the their they this to was were what when which who will with your you "
    "about after all also amid among any been before between can could may more most new now not over said says than them there these those up via would"
).split()
NAME_SUFFIXES = "inc incorporated corp corporation co ltd limited llc plc sa sarl gmbh ag nv bv holdings holding group company technologies technology labs lab sas spa oy ab as pte pty kk srl sl".split()
# Java's own classes of words are ASCII, and its end of a text lies in front of a last line break
OUTLET = r"[\t\n\f\r ]+[-|–—][\t\n\f\r ]+[A-Z][\p{L}\p{N}_ .&'’]{1,40}\z"
NOT_WORD = r"[^\p{L}\p{N}_\s]"

# What has no place in collected text; label and pattern.
INJECTIONS = (
    ("instruction_override", r"(?i)ignore\s+(all\s+)?(the\s+)?(previous|prior|above)\s+instructions?"),
    ("instruction_override", r"(?i)disregard\s+(all\s+)?(previous|prior|above)"),
    ("role_spoof", r"(?im)^\s*(system|assistant|developer)\s*:"),
    ("tag_spoof", r"(?i)</?\s*(system|assistant|user|instructions?)\s*>"),
    ("tool_spoof", r"(?i)<\s*/?\s*(function_calls|tool_use|invoke|antml)[^>]*>"),
    ("prompt_leak", r"(?i)(reveal|print|repeat|output)\s+(your\s+)?(system\s+)?prompt"),
    ("policy_override", r"(?i)you\s+are\s+now\s+(a|an|in)\s+"),
    ("exfiltration", r"(?i)!\[[^\]]*\]\(\s*https?://[^)]*\{[^)]*\)"),
    ("secret_request", r"(?i)\b(api[_ -]?key|secret[_ -]?key|password|token)\b\s*[:=]"),
    ("long_base64", r"[A-Za-z0-9+/]{400,}={0,2}"),
)


def _forms(kind: str, dropped: str = ""):
    """The Unicode normal form of texts, a batch at once, without the characters `dropped`. (Arrow's own composed
    forms are left decomposed.)"""

    @F.arrow_udf("string")
    def of(texts: pa.Array) -> pa.Array:
        found = pa.array([None if t is None else normalize(kind, t) for t in texts.to_pylist()], pa.string())
        return pc.replace_substring_regex(found, pattern=f"[{dropped}]", replacement="") if dropped else found

    return of


def _combining() -> str:
    """A class of the characters that unicodedata calls combining, as ranges."""
    marks = [i for i in range(0x300, sys.maxunicode + 1) if combining(chr(i))]
    ranges, begin = [], marks[0]
    for a, b in zip(marks, [*marks[1:], 0]):
        if b != a + 1:
            ranges.append((begin, a))
            begin = b
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges)


_COMBINING = _combining()


def _beyond_ascii(text: Column, kind: str, dropped: str = "") -> Column:
    """The normal form of texts that hold anything beyond ASCII; others aren't sent to it."""
    return F.coalesce(_forms(kind, dropped)(F.when(F.rlike(text, F.lit(r"[^\x00-\x7F]")), text)), text)


def unaccented(text: Column) -> Column:
    """Compatibility decomposition without combining marks."""
    return _beyond_ascii(text, "NFKD", _COMBINING)


def title_tokens(title: Column) -> Column:
    """The words of a headline that identify it, in order."""
    text = F.lower(F.regexp_replace(unaccented(F.coalesce(title, F.lit(""))), OUTLET, ""))
    words = F.split(F.trim(F.regexp_replace(text, NOT_WORD, " ")), r"\s+")
    return F.filter(words, lambda w: (w != "") & ~w.isin(HEADLINE_STOPWORDS))


def fingerprint(tokens: Column) -> Column:
    """Of distinct words in any order; null under three, which would collide."""
    distinct = F.array_sort(F.array_distinct(tokens))
    return F.when(F.size(distinct) >= 3, F.left(F.sha2(F.array_join(distinct, " "), 256), F.lit(32)))


def jaccard(a: Column, b: Column) -> Column:
    either = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / either).otherwise(0.0)


def normal_name(name: Column) -> Column:
    """Lower case, no accents, dots, punctuation or trailing company forms; the bare name if nothing is left."""
    text = F.regexp_replace(F.replace(F.lower(unaccented(name)), F.lit("."), F.lit("")), r"[^\p{L}\p{N}_\s-]", " ")
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    bare = F.trim(F.regexp_replace(text, rf"(^|\s)(({'|'.join(NAME_SUFFIXES)})(\s|$))+$", ""))
    return F.when(bare != "", bare).otherwise(F.lower(F.trim(name)))


def squashed(name: Column) -> Column:
    return F.regexp_replace(name, r"[\s\-_]", "")


def name_similarity(a: Column, b: Column) -> Column:
    """1 equal, 0.95 equal but for spacing, 0.9 the same words, else the larger of their overlap and
    0.6 where one holds the other."""
    x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    common = F.size(F.array_intersect(x, y))
    within = F.when((common == F.least(F.size(x), F.size(y))), 0.6).otherwise(0.0)
    return (
        F.when((a == "") | (b == "") | a.isNull() | b.isNull(), 0.0).when(a == b, 1.0).when(squashed(a) == squashed(b), 0.95)
        .when((common == F.size(x)) & (common == F.size(y)), 0.9).otherwise(F.round(F.greatest(jaccard(x, y), within), 4))
    )


def cleaned(text: Column) -> Column:
    """Compatibility composition, and invisible characters dropped."""
    return F.regexp_replace(_beyond_ascii(F.coalesce(text, F.lit("")), "NFKC"), "[\\u200B-\\u200F\\u2028\\u2029\\u2060\\uFEFF\\x00]", "")


def _scoped(pattern: str) -> str:
    """The pattern with its flags inside of it, to be one branch of several."""
    flags = pattern[2 : pattern.index(")")] if pattern.startswith("(?") else ""
    return f"(?{flags}:{pattern[len(flags) + 3 :]})" if flags else f"(?:{pattern})"


_ANY = "|".join(_scoped(p) for _, p in INJECTIONS)


def _replacing(text: Column) -> list[tuple[str, Column, Column]]:
    """Label, number of matches, and the text behind each replacement in turn."""
    steps = []
    for label, pattern in INJECTIONS:
        n = F.regexp_count(text, F.lit(pattern))
        text = F.regexp_replace(text, pattern, f"[neutralised:{label}]")
        steps.append((label, n, text))
    return steps


def injection_counts(text: Column) -> Column:
    """map<label, matches> of the labels that occur, counted on the cleaned text while they are replaced in
    turn. One pass over all patterns together finds the few texts for which this is done."""
    text = cleaned(text)
    steps = _replacing(text)
    labels = dict.fromkeys(label for label, _, _ in steps)
    count = lambda label: sum((n for name, n, _ in steps if name == label), F.lit(0))
    counts = F.map_filter(F.create_map(*[x for label in labels for x in (F.lit(label), count(label))]), lambda _, n: n > 0)
    return F.when(F.rlike(text, F.lit(_ANY)), counts).otherwise(F.create_map().cast("map<string,int>"))


def neutralised(text: Column, most: int = 20_000) -> Column:
    """The cleaned text with injections replaced by their label, cut at `most` characters, ends stripped."""
    text = cleaned(text)
    clean = F.when(F.rlike(text, F.lit(_ANY)), _replacing(text)[-1][2]).otherwise(text)
    return F.trim(F.when(F.length(clean) > most, F.concat(F.left(clean, F.lit(most)), F.lit("\n[truncated]"))).otherwise(clean))


# Entities in the order in which they are replaced.
ENTITIES = {
    "&amp;": "&",
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&#39;": "'",
    "&apos;": "'",
    "&nbsp;": " ",
    "&mdash;": "-",
    "&ndash;": "-",
}
# What HTML is cut at.
SCRIPTS, BREAKS, TAGS, NUMBERS = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", r"(?i)<br\s*/?>|</p>", r"<[^>]+>", r"&#(\d+);"


def _numbered(text: Column) -> Column:
    """Decimal references as their characters; what is no character is a blank."""

    def letter(digits: Column) -> Column:
        n = digits.try_cast("bigint")
        valid = (n < 0x110000) & ~n.between(0xD800, 0xDFFF)
        return F.when(F.coalesce(valid, F.lit(False)), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise(" ")

    between, digits = F.split(text, NUMBERS, -1), F.regexp_extract_all(text, F.lit(NUMBERS), F.lit(1))
    return F.array_join(F.zip_with(between, digits, lambda t, d: F.concat(t, F.when(d.isNotNull(), letter(d)).otherwise(""))), "")


def html_text(html: Column) -> Column:
    """A lossy reduction of HTML to text."""
    text = F.coalesce(html, F.lit(""))
    text = F.regexp_replace(text, SCRIPTS, " ")  # in one pass: what begins first ends first
    text = F.regexp_replace(F.regexp_replace(text, BREAKS, "\n"), TAGS, " ")
    for entity, plain in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(plain))
    text = F.when(F.contains(text, F.lit("&#")), _numbered(text)).otherwise(text)
    return F.trim(F.regexp_replace(text, r"[ \t]{2,}", " "))


def content_hash(*fields: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*fields)), 256)
