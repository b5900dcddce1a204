"""Answer and question text as Column expressions; no Python on the executors.

Character classes are spelt out, as ``\\b``, ``\\s`` and ``\\w`` differ between engines outside ASCII.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

# Articles; and the markers by which each rule knows an answer that says nothing.
ARTICLES = ["a", "an", "the"]
ABSTAIN = ["not in passages", "i don't know", "i do not know", "unknown", "no answer", "cannot answer", "none"]
UNCERTAIN = ["not in passages", "unknown", "no answer", "none", "i don't know"]
UNCERTAIN_NORMALISED = ["not in passages", "unknown", "no answer", "none"]
UNCERTAIN_FALLBACK = ["not in passages", "unknown", "no answer", "none", "i don't know", "i do not know", "n/a"]
UNFAITHFUL = ["not in passages", "not in the passages", "no answer", "cannot determine", "i don't know", "i do not know"]
NO_SUBSTANCE = [
    "not in passages", "unknown", "not enough information", "don't know", "do not know", "no answer", "insufficient", "cannot determine", "no answer found",
    "no relevant information", "no information", "n/a", "none", "unable to answer", "i cannot answer", "i cannot find", "i'm not sure", "i am not sure", "i don't have", "no info",
]

#: White space of any script, and what belongs to words.
SPACE = r"[\x{9}-\x{D}\x{1C}-\x{1F}\x{85}\p{Z}]"
WORD = r"[\p{L}\p{M}\p{N}_]"
EDGES = f"^{SPACE}+|{SPACE}+$"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: what a lambda refers to is else computed for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """Lower case without surrounding white space; null is empty."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), EDGES, "")


def tokens(text: Column) -> Column:
    """Lower-case words of a text without ASCII punctuation and articles."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[!-/:-@\[-`{-~]", "")
    return F.filter(F.split(F.regexp_replace(plain, f"{SPACE}+", " "), " "), lambda t: (t != "") & ~t.isin(ARTICLES))


def normalize_answer(text: Column) -> Column:
    return F.array_join(tokens(text), " ")


def exact_match(pred: Column, gold: Column) -> Column:
    return (normalize_answer(pred) == normalize_answer(gold)).cast("double")


def _f1(common: Column, p: Column, g: Column) -> Column:
    both = (p > 0) & (g > 0)
    return F.when(~both, (p == g).cast("double")).when(common == 0, 0.0).otherwise(2.0 * common / (p + g))


def _bags(pred: Column, gold: Column) -> Column:
    return F.struct(tokens(pred).alias("p"), tokens(gold).alias("g"))


def token_f1(pred: Column, gold: Column) -> Column:
    """F1 of the two bags of tokens; where one is empty, whether both are."""
    count = lambda bag, t: F.size(F.filter(bag, lambda x: x == t))

    def body(s: Column) -> Column:
        common = F.aggregate(F.array_distinct(s["p"]), F.lit(0), lambda a, t: a + F.least(count(s["p"], t), count(s["g"], t)))
        return let(common, lambda c: _f1(c, F.size(s["p"]), F.size(s["g"])))

    return let(_bags(pred, gold), body)


def overlap_f1(p: Column, g: Column) -> Column:
    """F1 of two sets, as arrays without repeated elements."""
    return _f1(F.size(F.array_intersect(p, g)), F.size(p), F.size(g))


def set_f1(pred: Column, gold: Column) -> Column:
    """F1 of the two sets of tokens."""
    return let(_bags(pred, gold), lambda s: overlap_f1(F.array_distinct(s["p"]), F.array_distinct(s["g"])))


def is_abstention(answer: Column) -> Column:
    """Nothing, or an abstention said in full."""
    return strip(answer).isin(["", *ABSTAIN])


def is_uncertain(answer: Column) -> Column:
    """What the weighted arbitrator takes for no answer: null, empty, or a marker."""
    return (F.coalesce(answer, F.lit("")) == "") | strip(answer).isin(UNCERTAIN)


def is_uncertain_normalised(answer: Column) -> Column:
    """What the selective rules and the probabilistic arbitrator take for no answer, on the normalised text."""
    return normalize_answer(answer).isin(["", *UNCERTAIN_NORMALISED])


def is_uncertain_fallback(answer: Column) -> Column:
    """What the last fallback takes for no answer."""
    return (F.coalesce(answer, F.lit("")) == "") | strip(answer).isin(UNCERTAIN_FALLBACK)


def _has_any(text: Column, phrases: list[str]) -> Column:
    found = F.lit(False)
    for phrase in phrases:
        found = found | F.contains(text, F.lit(phrase))
    return found


def is_unfaithful(answer: Column) -> Column:
    """An abstention for the faithfulness summary: blank, or a pattern anywhere."""
    return let(strip(answer), lambda low: (low == "") | _has_any(low, UNFAITHFUL))


def has_substance(answer: Column) -> Column:
    """Three characters or more, and none of the phrases of a missing answer anywhere."""
    return let(strip(answer), lambda low: (F.length(low) >= 3) & ~_has_any(low, NO_SUBSTANCE))


def lookup_key(text: Column) -> Column:
    """Lower case, anything but letters, marks, digits and underscores a blank, single blanks; in every script."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}_]+", " "))


@F.pandas_udf(StringType())
def surface_key(text: pd.Series) -> pd.Series:
    """The ASCII form of a name: compatibility forms taken apart, other characters dropped, punctuation a blank, lower case.
    There is no built-in for the decomposition, hence an Arrow batch."""
    ascii_ = text.fillna("").map(lambda s: unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode())
    return ascii_.str.replace(r"[^\w\s]+", " ", regex=True).str.split().str.join(" ").str.lower()


def slug(text: Column) -> Column:
    """A name as part of an id: no punctuation, lower case, blanks and hyphens one hyphen; ``unknown`` if nothing is left."""
    s = F.regexp_replace(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}_\x{9}-\x{D}\p{Z}-]+", "")), r"[\x{9}-\x{D}\p{Z}-]+", "-")
    return F.when(s == "", "unknown").otherwise(s)


def ascii_key(text: Column) -> Column:
    """The punctuation-free form of answers for set comparison: ASCII letters and digits, single blanks."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+", " "))


def set_f1_plain(pred: Column, gold: Column) -> Column:
    """F1 of the sets of words of the ASCII keys; 0 where one is empty."""
    words = lambda c: F.filter(F.array_distinct(F.split(ascii_key(c), " ")), lambda w: w != "")

    def body(s: Column) -> Column:
        return F.when((F.size(s["p"]) == 0) | (F.size(s["g"]) == 0), 0.0).otherwise(overlap_f1(s["p"], s["g"]))

    return let(F.struct(words(pred).alias("p"), words(gold).alias("g")), body)
