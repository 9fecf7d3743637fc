"""Text expressions (TXT-*). All are native Column expressions: they stay inside
whole-stage codegen and are shared by batch and streaming plans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the reference's behaviour).
# Whitespace as Python's str.split() sees it; Java's and RE2's \s are narrower.
# As classes it takes half the time of the listed ranges.
WS = r"[\s\x1c-\x1f\x{85}\p{Z}]"
# Characters that the strict clean drops: all but ASCII letters, digits and " .,!?-"
# (whitespace is a single space by then). As a class of its own, {Alnum} is one test a
# character in Java; the three ranges took 20 times as long.
STRICT_KEEP = r"[^\p{Alnum} .,!?-]+"
# Characters kept by the permissive clean: Python's Unicode \w, whitespace, .,!?'"-
PERMISSIVE_DROP = r"[^\p{L}\p{N}_" + WS[1:-1] + r".,!?'" + '"' + r"-]"
# Length bounds of the curation filter, inclusive.
MIN_WORDS = 5
MAX_WORDS = 150

# Fixed values of the preprocessing before similarity: contractions as (pattern, words),
# applied in this order to lower-cased text, and words without content.
CONTRACTIONS = [
    ("won't", "will not"), ("can't", "can not"), ("shan't", "shall not"), ("n't", " not"), ("let's", "let us"),
    ("'re", " are"), ("'ve", " have"), ("'ll", " will"), ("'d", " would"), ("'m", " am"), ("'s", ""),
]
STOPWORDS = """a about above after again against all am an and any are as at be because been before being below between
both but by can could did do does doing down during each few for from further had has have having he her here hers
herself him himself his how i if in into is it its itself just me more most my myself nor now of off on once only or
other our ours ourselves out over own same she should so some such than that the their theirs them themselves then
there these they this those through to too under until up very was we were what when where which while who whom why
will with would you your yours yourself yourselves""".split()

_BIG = 2147483647


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse_ws(c) -> Column:
    """Runs of whitespace -> one space, trimmed (Python ' '.join(s.split()))."""
    return F.trim(F.regexp_replace(_col(c), WS + "+", " "))


def capitalize_sentences(c) -> Column:
    """Split on literal '. ', upper-case the first char and lower-case the rest of
    each piece, re-join. (initcap would be wrong: it capitalises every word.)"""
    parts = F.split(_col(c), r"\. ", -1)
    return F.array_join(
        F.transform(parts, lambda s: F.concat(F.upper(F.substring(s, 1, 1)),
                                              F.lower(F.substring(s, 2, _BIG)))),
        ". ")


def clean_strict(c) -> Column:
    """TXT-01: collapse whitespace, drop non [a-zA-Z0-9 .,!?-], no space before
    punctuation, punctuation runs -> last char, capitalise sentences."""
    t = collapse_ws(c)
    t = F.regexp_replace(t, STRICT_KEEP, "")
    t = F.regexp_replace(t, r" +([.,!?])", "$1")
    t = F.regexp_replace(t, r"([.,!?]){2,}", "$1")
    return capitalize_sentences(t)


def clean_permissive(c) -> Column:
    """TXT-02: symbols -> space, collapse spaces, no space before .,!?,
    dot runs -> '...', trim."""
    t = F.regexp_replace(_col(c), PERMISSIVE_DROP, " ")
    t = F.regexp_replace(t, WS + "+", " ")
    t = F.regexp_replace(t, r" ([.,!?])", "$1")
    t = F.regexp_replace(t, r"\.{2,}", "...")
    return F.trim(t)


def dup_key(c, strip_punctuation: bool = False) -> Column:
    """TXT-03 / DUP-09: lower, trim, collapse whitespace; optionally strip
    punctuation first (declared exact-match preprocessing)."""
    t = F.lower(_col(c))
    if strip_punctuation:
        t = F.regexp_replace(t, r"[.,!?;:'" + '"' + r"()\[\]-]", "")
    return collapse_ws(t)


def words(c) -> Column:
    """Whitespace tokens, empty pieces removed (Python str.split())."""
    return F.filter(F.split(collapse_ws(c), " ", -1), lambda w: w != F.lit(""))


def clean_words(c) -> Column:
    """Tokens of strict-cleaned text, whose only whitespace is the plain space:
    the same result as ``words`` with one cheap split instead of a regex pass
    over the full whitespace class."""
    return F.filter(F.split(_col(c), " ", -1), lambda w: w != F.lit(""))


def clean_dup_key(c) -> Column:
    """TXT-03 on strict-cleaned text (plain spaces only): lower, collapse, trim."""
    return F.trim(F.regexp_replace(F.lower(_col(c)), " {2,}", " "))


def similarity_words(c) -> Column:
    """The words that similarity of texts looks at: lower-cased, contractions written out,
    special characters gone, words without content dropped ("not" and "no" stay)."""
    t = F.translate(F.lower(_col(c)), "\u2018\u2019\u02bc`", "\'\'\'\'")
    for short, full in CONTRACTIONS:
        t = F.regexp_replace(t, rf"{short}([^\p{{L}}\p{{N}}]|\z)", f"{full}$1")
    t = F.regexp_replace(F.replace(t, F.lit("\'"), F.lit("")), r"[^\p{L}\p{N}]+", " ")
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.filter(F.split(t, " ", -1), lambda w: (w != F.lit("")) & ~F.array_contains(stop, w))


def word_count(c) -> Column:
    """TXT-04. Null text counts 0 words (and is length-filtered)."""
    return F.coalesce(F.size(words(c)).cast("long"), F.lit(0).cast("long"))


def in_length_range(wc, lo: int = MIN_WORDS, hi: int = MAX_WORDS) -> Column:
    """FLT-01: inclusive word-count bounds."""
    return _col(wc).between(lo, hi)


def vocab_richness(c, clean: bool = False) -> Column:
    """TXT-05: distinct lower-cased words / words, 0 for no words."""
    w = (clean_words if clean else words)(F.lower(_col(c)))
    n = F.size(w)
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(0.0)).otherwise(
        F.size(F.array_distinct(w)).cast("double") / n.cast("double"))


def sentence_lengths(c, clean: bool = False) -> Column:
    """Words per sentence; sentences split on '.', blank ones dropped.
    ``clean=True`` for strict-cleaned text (plain spaces only): no regex."""
    if clean:
        sents = F.filter(F.split(_col(c), r"\.", -1), lambda s: F.trim(s) != F.lit(""))
        return F.transform(sents, lambda s: F.size(clean_words(s)))
    sents = F.filter(F.split(_col(c), r"\.", -1), lambda s: collapse_ws(s) != F.lit(""))
    return F.transform(sents, lambda s: F.size(words(s)))


def text_complexity(c, clean: bool = False) -> tuple[Column, Column, Column]:
    """TXT-06: (richness, mean sentence length, population std of it)."""
    lens = sentence_lengths(c, clean)
    n = F.size(lens).cast("double")
    total = F.aggregate(lens, F.lit(0).cast("long"), lambda a, x: a + x)
    mean = total.cast("double") / n
    sq = F.aggregate(lens, F.lit(0).cast("long"), lambda a, x: a + x * x)
    # population variance from integer moments: (n*sum(x^2) - sum(x)^2) / n^2
    var = (n * sq.cast("double") - total.cast("double") * total.cast("double")) / (n * n)
    empty = F.coalesce(F.size(lens), F.lit(0)) == 0
    avg = F.when(empty, F.lit(0.0)).otherwise(mean)
    std = F.when(empty, F.lit(0.0)).otherwise(F.sqrt(F.greatest(var, F.lit(0.0))))
    return vocab_richness(c, clean), avg, std


def syllables(word: Column) -> Column:
    """Vowel-group count, at least one per word (used by the Flesch score)."""
    n = F.size(F.regexp_extract_all(F.lower(word), F.lit(r"([aeiouy]+)"), 1))
    return F.greatest(n, F.lit(1))


def flesch_reading_ease(c, clean: bool = False) -> Column:
    """206.835 - 1.015 * words/sentences - 84.6 * syllables/words, where a word
    has max(1, vowel groups) syllables."""
    w = (clean_words if clean else words)(c)
    nw = F.size(w).cast("double")
    ns = F.greatest(F.size(sentence_lengths(c, clean)), F.lit(1)).cast("double")
    if clean:
        # plain-space text: vowel groups never cross a word boundary, so the
        # per-word sum is the text's group count plus one per vowel-less word
        low = F.lower(_col(c))
        groups = F.size(F.regexp_extract_all(low, F.lit(r"([aeiouy]+)"), 1))
        bare = F.size(F.regexp_extract_all(low, F.lit(r"(?<![^ ])([^aeiouy ]+)(?![^ ])"), 1))
        nsyl = (groups + bare).cast("double")
    else:
        nsyl = F.aggregate(F.transform(w, syllables), F.lit(0), lambda a, x: a + x).cast("double")
    return F.when(nw == 0, F.lit(0.0)).otherwise(
        F.lit(206.835) - F.lit(1.015) * (nw / ns) - F.lit(84.6) * (nsyl / nw))


def max_trigram_repeat(word_list: Column) -> Column:
    """Largest number of occurrences of one word 3-gram. ``word_list`` must be a
    column reference (not an expression): it is read inside a lambda."""
    w = word_list
    n = F.size(w)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))),
                        lambda i: F.concat_ws(" ", F.slice(w, i, 3)))
    grams = F.when(n >= 3, grams).otherwise(F.array().cast("array<string>"))
    # longest run in the sorted array: O(g log g), not O(g^2)
    init = F.struct(F.lit(None).cast("string").alias("prev"),
                    F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc, g):
        run = F.when(acc["prev"] == g, acc["run"] + 1).otherwise(F.lit(1))
        return F.struct(g.alias("prev"), run.alias("run"),
                        F.greatest(acc["best"], run).alias("best"))

    return F.coalesce(F.aggregate(F.array_sort(grams), init, step)["best"], F.lit(0))
