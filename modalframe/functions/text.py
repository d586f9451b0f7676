"""Clinical-note cleaning and sentence-preserving truncation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import bind, hash_slot

# The cleaning patterns in the order they apply
CLEANING_STEPS = (
    (r"(?U)[\s\x1c-\x1f]+", " "),
    (r"(?iu)\[Report de-identified.*?\]", ""),
    (r"\*\*[^*]*\*\*", ""),
    (r"([a-zA-Z])\.([a-zA-Z])", "$1. $2"),
    (r"[.]{3,}", "..."),
    (r"[-]{3,}", "---"),
)
MAX_TOKENS = 512
TRIGGER_CHARS_PER_TOKEN = 4
KEPT_CHARS_PER_TOKEN = 3
SENTENCE_END = ". "
WORD_BREAK = r"[^\p{L}\p{N}]+"


def clean_note(text: Column | str) -> Column:
    """NULL -> ''; collapse whitespace, drop template artefacts and **masked** spans, space out `a.b`, cap runs."""
    c = F.col(text) if isinstance(text, str) else text
    c = F.coalesce(c, F.lit(""))
    first, *rest = CLEANING_STEPS
    c = F.trim(F.regexp_replace(c, *first))
    for pattern, replacement in rest:
        c = F.regexp_replace(c, pattern, replacement)
    return c


def truncate_note(text: Column | str, max_tokens: int = MAX_TOKENS) -> Column:
    """Keep the leading sentences of a long note while their summed length stays under 3 characters per token.

    Sentence lengths are not negative, so "stop at the first that does not fit" is a count of prefix sums.
    """
    limit = max_tokens * KEPT_CHARS_PER_TOKEN

    def step(acc, s):
        total = acc["total"] + F.length(s)
        return F.struct(total.alias("total"), (acc["kept"] + F.when(total < limit, 1).otherwise(0)).alias("kept"))

    def leading(sentences):
        start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("kept"))
        kept = F.aggregate(sentences, start, step, lambda a: a["kept"])
        return F.array_join(F.slice(sentences, F.lit(1), kept), SENTENCE_END)

    def cut(note):
        joined = bind(bind(F.split(note, r"\. ", -1), leading), lambda j: F.when(j.endswith("."), j).otherwise(F.concat(j, F.lit("."))))
        return F.when(F.length(note) > max_tokens * TRIGGER_CHARS_PER_TOKEN, joined).otherwise(note)

    # a cleaned note costs several regular expressions, so it is bound once
    return bind(F.col(text) if isinstance(text, str) else text, cut)


def preprocess_note(text: Column | str, max_tokens: int = MAX_TOKENS) -> Column:
    return F.trim(truncate_note(clean_note(text), max_tokens))


def is_blank(text: Column | str) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.length(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "")) == 0


def word_slots(text: Column | str, slots: int) -> Column:
    """The hash slot of each word, in order and with repeats; words are runs of letters and digits, lower-cased."""
    c = F.col(text) if isinstance(text, str) else text
    words = F.filter(F.split(F.lower(c), WORD_BREAK, -1), lambda w: w != "")
    return F.transform(words, lambda w: hash_slot(w, slots))
