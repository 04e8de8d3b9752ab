"""Quality rules: base measures of a text, and its divergence from the distributions of its language.

For every language of the corpus, two reference distributions are counted over all its documents:
of characters over seven classes, and of words over the language's `common` most frequent words
and one class for all others. A document with at least `min_words` words is compared to the references
of its language by the Jensen-Shannon distance (base 2, from 0 to 1) on both, and fails if either
distance is above its limit. Shorter documents have too few words for a distribution and aren't
judged by it. A document without a language takes the nearest reference for each distance.

References are counted in one pass with partial counts for each batch; the most frequent words are ranked by
Spark (which limits the groups before it shuffles); the driver gets common + 8 numbers a language.

told_apart() also holds a third distance, of words by bands of rank (the 8 most frequent, then up to 32, 128
and 512, and all others), to a limit of each language: its own documents' median and eight times their median
deviation, at most half the distance of a text with no common word. Bands hold enough words of a short
text to tell word salad and other languages apart; the finer histogram tells repeats of a few words.

Defined results: a null or empty text has no words and fails the base rules; ties for the last
common words go to the first in code point order; repeated rows each count and each get a result;
an empty table gives an empty table; further columns are not returned.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, claim, stored

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
STRIPPED = ".,;:!?\"'()"
COMMON, MIN_WORDS, MAX_CLASS, MAX_WORD = 30, 50, 0.3, 0.45
BANDS, DEVIATIONS, MOST_OF_NONE = (8, 32, 128, 512), 8, 0.5
RUN = 8

# character classes: other, a-z, A-Z, further letters, digits, white space, punctuation
CLASSES = 7


def _classes() -> np.ndarray:
    table = np.fromiter((3 if chr(i).isalpha() else 0 for i in range(1 << 16)), np.uint8)
    table[97:123], table[65:91], table[48:58] = 1, 2, 4
    table[[32, *range(9, 14)]] = 5
    table[[ord(c) for c in ".,;:!?"]] = 6
    return table


TABLE = _classes()


def class_counts(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    high = points >= len(TABLE)
    counts = np.bincount(TABLE[points[~high] if high.any() else points], minlength=CLASSES)
    for p in points[high].tolist():
        counts[3 if chr(p).isalpha() else 0] += 1
    return counts


def plain(word: str) -> str:
    return word.lower().strip(STRIPPED)


def repeat_words(words: list[str]) -> int:
    """Words covered by runs of RUN words that occur at least twice. Runs are named exactly, by
    doubling: equal names of halves make equal names."""
    n = len(words)
    ids: dict[str, int] = {}
    names = np.array([ids.setdefault(w, len(ids)) for w in words])
    if n <= RUN or len(ids) > n - RUN:  # fewer repeats than a run has words
        return 0
    size = 1
    while size < RUN:
        _, names = np.unique(names[:-size] * np.int64(n) + names[size:], return_inverse=True)
        size *= 2
    again = np.bincount(names)[names] > 1
    if not again.any():
        return 0
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + RUN, -1)
    return int((np.cumsum(edge) > 0).sum())


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    parts = [float((x[x > 0] * np.log2(x[x > 0] / m[x > 0])).sum()) for x in (p, q)]
    return max(0.0, sum(parts) / 2) ** 0.5


def references(docs: DataFrame, common: int = COMMON, text_col: str = "text", lang_col: str = "lang") -> dict[str, tuple[np.ndarray, dict[str, int], np.ndarray]]:
    """For each language: character counts, the common words' places, and word counts (others first)."""
    bounded_batches(docs.sparkSession)

    def count(batches):
        claim("quality")
        for b in batches:
            words: dict[str, Counter] = defaultdict(Counter)
            classes: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(CLASSES, np.int64))
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
                words[lang].update(map(plain, WORDS.findall(text)))
                classes[lang] += class_counts(text)
            rows = [(lang, None, w, n) for lang, c in words.items() for w, n in c.items()] + [(lang, k, None, int(n)) for lang, c in classes.items() for k, n in enumerate(c)]
            columns = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int64()))], names=["lang", "class", "word", "n"])

    known = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = stored(known.mapInArrow(count, "lang string, class int, word string, n long").groupBy("lang", "class", "word").agg(F.sum("n").alias("n")), "quality-counts")
    of_words = counts.filter("word is not null")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = of_words.filter("word != ''").withColumn("rank", rank).filter(F.col("rank") <= common)
    found = {}
    totals = dict(map(tuple, of_words.groupBy("lang").agg(F.sum("n")).collect()))
    for lang in totals:
        found[lang] = (np.zeros(CLASSES), {}, np.zeros(common + 1))
    for r in counts.filter("class is not null").collect():
        if r["lang"] in found:
            found[r["lang"]][0][r["class"]] = r["n"]
    for r in top.collect():
        found[r["lang"]][1][r["word"]] = r["rank"]
        found[r["lang"]][2][r["rank"]] = r["n"]
    for lang, (_, _, words) in found.items():
        words[0] = totals[lang] - words.sum()
    return found


def banded(reference: tuple[np.ndarray, dict[str, int], np.ndarray]) -> tuple[dict[str, int], np.ndarray]:
    """Each common word's band of rank, and the bands' counts (others first)."""
    _, places, words = reference
    band = {w: 1 + int(np.searchsorted(BANDS, k)) for w, k in places.items()}
    counts = np.zeros(len(BANDS) + 1)
    counts[0] = words[0]
    for w, k in places.items():
        counts[band[w]] += words[k]
    return band, counts


def cut(reference: tuple[np.ndarray, dict[str, int], np.ndarray], common: int) -> tuple[np.ndarray, dict[str, int], np.ndarray]:
    """A reference with fewer common words."""
    classes, places, words = reference
    return classes, {w: k for w, k in places.items() if k <= common}, np.concatenate(([words[0] + words[common + 1 :].sum()], words[1 : common + 1]))


def band_distance(forms: Counter, bands: tuple[dict[str, int], np.ndarray]) -> float:
    counts = np.zeros(len(BANDS) + 1)
    for w, n in forms.items():
        counts[bands[0].get(w, 0)] += n
    return distance(counts, bands[1])


def told_apart(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """judged(), with band_distance, the language it is to (the nearest where the document has none that
    is known), and kept only within that language's limit. The driver gets a limit a language."""
    spark = docs.sparkSession
    full = references(docs, BANDS[-1], text_col, lang_col)
    bands = {lang: banded(r) for lang, r in full.items()}
    found = stored(judged(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, full=full), "quality-judged")
    own = found.filter(F.col("band_distance").isNotNull())
    median = own.groupBy("band_lang").agg(F.percentile_approx("band_distance", 0.5, 10_000).alias("median"))
    spread = own.join(F.broadcast(median), "band_lang").groupBy("band_lang", "median").agg(F.percentile_approx(F.abs(F.col("band_distance") - F.col("median")), 0.5, 10_000).alias("spread"))
    none = np.eye(1, len(BANDS) + 1)[0]
    limits = [(r["band_lang"], float(min(r["median"] + DEVIATIONS * r["spread"], MOST_OF_NONE * distance(none, bands[r["band_lang"]][1])))) for r in spread.collect()]
    limit = spark.createDataFrame(limits, "band_lang string, band_limit double")
    fits = F.col("band_distance").isNull() | (F.col("band_distance") <= F.col("band_limit"))
    return found.join(F.broadcast(limit), "band_lang", "left").withColumn("kept", F.col("kept") & fits).select(*found.columns, F.round("band_limit", 4).alias("band_limit"))  # a row a language


def judged(docs: DataFrame, common: int = COMMON, min_words: int = MIN_WORDS, max_class: float = MAX_CLASS, max_word: float = MAX_WORD, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", full: dict | None = None) -> DataFrame:
    """doc_id, the base measures, base_failed, kept, class_distance and word_distance (null: not judged).
    With `full` references of more words, band_distance and band_lang too."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast({lang: cut(r, common) for lang, r in full.items()} if full is not None else references(docs, common, text_col, lang_col))
    bands = spark.sparkContext.broadcast({lang: banded(r) for lang, r in (full or {}).items()})

    full = None if full is None else True  # the workers get the broadcasts

    def judge(text: str, lang: str | None) -> tuple:
        words = WORDS.findall(text)
        lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
        repeated = repeat_words(words)
        failed = len(words) < 20 or 100 * repeated > 30 * len(words)
        by_class = by_word = by_band = band_lang = None
        if len(words) >= min_words and shared.value:
            own = [shared.value[lang]] if lang in shared.value else shared.value.values()
            forms, classes = Counter(map(plain, words)), class_counts(text)
            by_class = min(distance(classes, r[0]) for r in own)
            by_word = 1.0
            for _, places, reference in own:
                counts = np.zeros(common + 1)
                for w, k in places.items():
                    counts[k] = forms.get(w, 0)
                counts[0] = len(words) - counts.sum()
                by_word = min(by_word, distance(counts, reference))
            if full is not None:
                by_band, band_lang = min((band_distance(forms, bands.value[k]), k) for k in ([lang] if lang in bands.value else bands.value))
        fits = by_class is None or (by_class <= max_class and by_word <= max_word)
        rounded = [None if x is None else round(x, 4) for x in (by_class, by_word)]
        return (len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, failed, fits and not failed, *rounded, *([] if full is None else [None if by_band is None else round(by_band, 4), band_lang]))

    def run(batches):
        claim("quality")
        for b in batches:
            rows = [judge(t, lang) for t, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist())]
            columns = list(zip(*rows)) if rows else [()] * (len(names) - 1)
            kinds = [*[pa.int64()] * 5, *[pa.bool_()] * 2, *[pa.float64()] * (2 if full is None else 3), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance", *([] if full is None else ["band_distance", "band_lang"])]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    kinds = [rows.schema["doc_id"].dataType.simpleString(), *["long"] * 5, *["boolean"] * 2, *["double"] * 2, *([] if full is None else ["double", "string"])]
    return rows.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
