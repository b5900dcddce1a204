"""The registered queries of the core and their SQL, and pieces of SQL that several of them share.

The SQL writes its constants out and does not take them from the operators, so that a wrong value shows.
"""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a query ``(spark, folder) -> DataFrame`` under its name, with its SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


SPACE = r"[\x{9}-\x{D}\x{1C}-\x{1F}\x{85}\p{Z}]"


def tokens(x: str) -> str:
    """Words of an answer: lower case, no ASCII punctuation, no articles."""
    return rf"list_filter(string_split(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[!-/:-@\[-`{{-~]', '', 'g'), '{SPACE}+', ' ', 'g'), ' '), lambda t: t <> '' AND t NOT IN ('a', 'an', 'the'))"


def norm(x: str) -> str:
    return f"array_to_string({tokens(x)}, ' ')"


def key(x: str) -> str:
    """The lookup key of a name or text, in every script."""
    return rf"trim(regexp_replace(lower(coalesce({x}, '')), '[^\p{{L}}\p{{M}}\p{{N}}_]+', ' ', 'g'))"


def strip(x: str) -> str:
    return rf"regexp_replace(lower(coalesce({x}, '')), '^{SPACE}+|{SPACE}+$', '', 'g')"


def plain(x: str) -> str:
    """A text whose letters outside ASCII are underscores and whose other characters outside ASCII are blanks, so that
    ASCII word boundaries hold for every script."""
    return rf"regexp_replace(regexp_replace(coalesce({x}, ''), '[^\x00-\x7F\p{{L}}\p{{M}}\p{{N}}]', ' ', 'g'), '[^\x00-\x7F]', '_', 'g')"


def uncertain(x: str) -> str:
    return f"(coalesce({x}, '') = '' OR {strip(x)} IN ('not in passages', 'unknown', 'no answer', 'none', 'i don''t know'))"


def uncertain_normalised(x: str) -> str:
    return f"({norm(x)} IN ('', 'not in passages', 'unknown', 'no answer', 'none'))"


def uncertain_fallback(x: str) -> str:
    return f"(coalesce({x}, '') = '' OR {strip(x)} IN ('not in passages', 'unknown', 'no answer', 'none', 'i don''t know', 'i do not know', 'n/a'))"


def substantial(x: str) -> str:
    phrases = (
        "not in passages|unknown|not enough information|don''t know|do not know|no answer|insufficient|cannot determine|no answer found|no relevant information|no information|n/a|none|"
        "unable to answer|i cannot answer|i cannot find|i''m not sure|i am not sure|i don''t have|no info"
    )
    return f"(length({strip(x)}) >= 3 AND NOT regexp_matches({strip(x)}, '{phrases}'))"


#: The answers without repeated rows, and F1 of two token lists ``p`` and ``g``.
ONCE = "SELECT DISTINCT answer_id, qid, question, gold, pred, em, f1, v3bu_pred, dec_pred, decision, soft_em FROM selective_answers"
COMMON = "coalesce(list_sum(list_transform(list_distinct(p), lambda t: least(len(list_filter(p, lambda x: x = t)), len(list_filter(g, lambda y: y = t))))), 0)"
F1 = f"CASE WHEN len(p) = 0 OR len(g) = 0 THEN (len(p) = len(g))::DOUBLE WHEN {COMMON} = 0 THEN 0.0 ELSE 2.0 * {COMMON} / (len(p) + len(g)) END"
SHARED = "len(list_intersect(list_distinct(p), list_distinct(g)))"
SET_F1 = f"CASE WHEN len(p) = 0 OR len(g) = 0 THEN (len(p) = len(g))::DOUBLE WHEN {SHARED} = 0 THEN 0.0 ELSE 2.0 * {SHARED} / (len(list_distinct(p)) + len(list_distinct(g))) END"
