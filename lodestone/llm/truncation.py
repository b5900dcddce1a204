"""Texts that are cut off, by length spikes per source and by how texts of the collection end.

Two passes over the whole table. One marks how every text ends and keeps a slim row of each; from these come, for every
source and measure (characters, bytes and any declared size column), the histogram of lengths of texts that end openly,
and the lengths where it spikes. The other counts, for every word and word pair, how often a sentence ends after it.
Then a text is flagged that ends openly at a spike, and one that ends inside a structure, inside a quotation or after a
word where sentences don't end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestone.session import cut as keep

#: A spike has at least LEAST texts and TIMES the level of its surroundings, which reach AROUND lengths to each side.
LEAST, TIMES, AROUND = 5, 5.0, 25
#: A share of sentence ends under this makes a word one after which no sentence ends.
NO_END = 0.02
#: A word pair has its own share from so many occurrences on; below, the word's holds.
PAIR_LEAST = 30
#: Texts of up to so many words without a sentence mark are phrases.
PHRASE_WORDS = 7
#: Texts that end in the same word pair are dealt over so many tasks.
SALTS = 8
#: Spikes are broadcast up to so many rows; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 100_000

# Marks that replace what was cut off.
OMISSION = r"(?:\s*(?:(?<!…)…(?!…)|\.\.\.|\[(?:\.\.\.|…|more|cut|truncated|continued)\]|\((?:\.\.\.|…|more|cut|truncated|continued)\)|<(?:more|cut|truncated)>))+\s*$"
# Abbreviations whose point ends no sentence.
ABBREVIATIONS = [
    "approx", "av", "b", "c", "ca", "capt", "cf", "ch", "cie", "d", "dept", "dr", "dra", "e", "env", "et", "etc", "ex", "ff", "fig", "g", "gen", "hr", "i", "jr", "m", "mme", "mr", "mrs", "ms", "no", "nr", "núm", "p", "pág", "pop", "pp", "prof", "rd", "s", "sen", "sog", "sr", "sra", "st", "t", "u", "v", "vgl", "vol", "vs", "z",
    "им", "ок", "проф", "ул",
]
CLOSERS = "\"'”’»）)\\]}」』》“*`|"
ENDS = ".!?。！？।؟…"
LETTER = r"\p{L}\p{M}\p{N}"


def _base(text: Column) -> Column:
    """The text without a mark of omission, and without a closing fence that nothing opened. The patterns run only over
    texts whose last characters can belong to them."""
    fences = F.size(F.split(text, "```", -1)) - 1
    bare = F.when(F.contains(text, F.lit("```")) & (fences % 2 == 1), F.regexp_replace(text, r"\s*```\s*$", "")).otherwise(text)

    def unmarked(t: Column) -> Column:
        last = F.right(F.regexp_replace(F.right(t, F.lit(8)), r"\s+$", ""), F.lit(3))
        blank_end = F.right(t, F.lit(8)).rlike(r"^\s*$")
        return F.when(blank_end | last.rlike(r"(?:…|\.\.\.|[\])>])$"), F.regexp_replace(t, OMISSION, "")).otherwise(t)

    def trimmed(t: Column) -> Column:
        return F.rtrim(F.when(F.right(t, F.lit(1)).rlike(r"[\s\p{So}\p{Cf}\x{FE0F}]"), F.regexp_replace(t, r"[\s\p{So}\p{Cf}\x{FE0F}]+$", "")).otherwise(t))

    return trimmed(unmarked(bare))


def _count(text: Column, mark: str) -> Column:
    """How often a mark stands in a text."""
    return (F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / len(mark)


def _tokens(base: Column) -> Column:
    return F.regexp_extract_all(base, F.lit(rf"[{LETTER}]+|[^\s{LETTER}]"), F.lit(0))


def _shape(word: Column) -> Column:
    """Numbers count by their length."""
    caseless = F.upper(word) == F.lower(word)  # spares the pattern for most words
    return F.when(caseless & word.rlike(r"^\p{N}+$"), F.concat(F.lit("#"), F.least(F.length(word), F.lit(5)).cast("string"))).otherwise(word)


def _pair(before: Column, word: Column) -> Column:
    """The key of a word with what stands before it; capitalised words before it are one class."""
    first = F.left(before, F.lit(1))
    name = F.when((first != F.lower(first)) & before.rlike(r"^\p{Lu}"), F.lit("N")).otherwise(_shape(before))
    return F.concat_ws(" ", F.coalesce(name, F.lit("^")), _shape(word))


def _marked(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with how their texts end. What stands at the end is read from the reversed text, so that no pattern has to
    look for the end; patterns over the whole text run only where a mark that they need is there."""
    base, tail = F.col("__base"), F.col("__tail")
    rows = rows.withColumn("__base", _base(F.col(text))).withColumn("__tail", F.reverse("__base"))
    token = lambda g: F.reverse(F.regexp_extract(tail, rf"^([{LETTER}]+|[^\s{LETTER}])?\s*([{LETTER}]+|[^\s{LETTER}])?", g))
    rows = rows.withColumns({"__last": F.nullif(token(1), F.lit("")), "__before": F.nullif(token(2), F.lit(""))})
    last, before = F.col("__last"), F.col("__before")
    letters = rf"^[{LETTER}]+$"
    point = last.isin(".", "…") & before.rlike(letters) & (
        F.lower(before).isin(ABBREVIATIONS) | before.rlike(r"^\p{IsLatin}$")
    ) & ~base.rlike(r"(?i)\b(?:[ap]\.m|c|j\.-c|u\.s|u\.k|et al|etc|ed|inc|ltd|jr)\.$")
    closed = (tail.rlike(f"^[{CLOSERS}\\s]*[{ENDS}]") | tail.rlike(r"^[;·]\p{IsGreek}")) & ~point
    listed = base.rlike(r"^\s*[{\[]")
    quote = F.contains(base, F.lit('"')) & (_count(base, '"') % 2 == 1) & ~listed
    unpaired = F.lit(False)
    for opening, closing in (("«", "»"), ("「", "」"), ("『", "』"), ("《", "》"), ("（", "）"), ("(", ")")):
        unpaired = unpaired | (F.contains(base, F.lit(opening)) & (_count(base, opening) > _count(base, closing)))
    structure = (
        (base.rlike(r"^\s*(?:```\w*\s*)?\{") & ~tail.rlike(r"^(?:```)?\s*\}"))
        | (base.rlike(r"^\s*(?:```\w*\s*)?\[\s*[\[{\"]") & ~tail.rlike(r"^(?:```)?\s*\]"))
        | tail.rlike(r"^[^\n|](?:[^\n]*\|)(?:\n|\z)")
        | (F.contains(base, F.lit("**")) & ((F.size(F.split(base, r"\*\*", -1)) - 1) % 2 == 1))
        | base.endswith("�")
    )
    few = base.rlike(rf"^[^{LETTER}]*+(?:[{LETTER}]++[^{LETTER}]*+){{0,{PHRASE_WORDS}}}$")
    inner = base.rlike(f"(?:[{LETTER}]{{2}}|[{CLOSERS}])[{ENDS}](?:[\\s{CLOSERS}]|$)|[。！？।]")
    return rows.withColumns({
        "__several": base.rlike(rf"[{LETTER}][^{LETTER}]+[{LETTER}]"),
        "__phrase": few & ~inner & ~base.rlike(r"^\s*[{\[|`]"),
        "__broken": structure | quote | unpaired,
        "__open": ~closed,
        "__word": F.when(last.rlike(letters), last),
        "__pair": F.when(last.rlike(letters), _pair(before, last)),
        "__shut": tail.rlike(f"^[{CLOSERS}]"),
        "__figure": base.rlike(r"^\p{N}"),
    }).drop("__tail", "__last", "__before")


def _lengths(rows: DataFrame, measures: dict[str, Column], *columns: Column) -> DataFrame:
    """``columns..., measure, length`` of the texts that end openly and are no phrases."""
    each = F.explode(F.create_map(*[x for k, v in measures.items() for x in (F.lit(k), v.cast("bigint"))])).alias("measure", "length")
    return rows.where(F.col("__open") & ~F.col("__phrase")).select(*columns, each)


def spikes(rows: DataFrame, source: str, measures: dict[str, Column]) -> DataFrame:
    """``source, measure, length, n, level`` of the lengths at which texts of a source end openly far too often."""
    each = _lengths(rows, measures, F.col(source).alias("source"))
    counts = each.where(F.col("length") > 0).groupBy("source", "measure", "length").agg(F.count(F.lit(1)).alias("n"))
    at = Window.partitionBy("source", "measure").orderBy("length")
    wide, near = (F.sum("n").over(at.rangeBetween(-k, k)) for k in (AROUND, 2))
    level = (wide - near) / (2 * AROUND - 4)
    return counts.withColumn("level", level).where((F.col("n") >= LEAST) & (F.col("n") >= TIMES * F.col("level")) & (F.col("n") - F.col("level") >= 3 * F.sqrt(F.col("level") + 1)))


def endings(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """How often words and word pairs occur with something after them, and how often a sentence ends there; how often a
    pair's second word is only the beginning of a longer one in its place."""
    t = F.col("__tokens")
    index = F.sequence(F.lit(1), F.size(t) - 1)

    def entry(i: Column) -> Column:
        after, then = F.element_at(t, i + 1), F.try_element_at(t, i + 2)
        ends = after.isin(list(ENDS)) & (then.isNull() | ~then.rlike(r"^[\p{Ll}\p{N}]")) | (after.isin(list(")”»\"")) & then.isin(list(ENDS)))
        return F.struct(
            F.element_at(t, i).alias("word"),
            F.when(i > 1, F.element_at(t, F.greatest(i - 1, F.lit(1)))).alias("before"),
            F.coalesce(ends, F.lit(False)).cast("int").alias("ends"),
        )

    found = rows.where(F.size(t) > 1).select(F.explode(F.transform(index, entry)).alias("e")).select("e.*")
    found = found.where((F.length("word") > 1) | F.col("word").rlike(r"^[\p{L}\p{M}\p{N}]"))  # a token of several characters is a word
    pairs = keep(
        found.groupBy(_shape(F.col("word")).alias("word"), _pair(F.col("before"), F.col("word")).alias("pair"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("ends").alias("ends"))
    )
    words = pairs.groupBy("word").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))
    stems = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("pair"), F.lit(1), F.length("pair") - i))
    longer = (
        pairs.where((F.col("n") >= 2) & (F.length("word") > 1) & ~F.col("word").startswith("#") & F.col("pair").endswith(F.col("word")))
        .select(F.explode(stems).alias("stem"), "n").groupBy("stem").agg(F.sum("n").alias("longer"))
    )
    return words, pairs.select("pair", "n", "ends"), longer


def find_cut(df: DataFrame, key: str = "response_id", text: str = "text", source: str = "provider", sizes: tuple[str, ...] = ("n_output_tokens",)) -> DataFrame:
    """``key, source, cut boolean, reason`` with one row for each distinct row (key, source, text, sizes).

    Null, empty and blank texts are not cut. A null source is a source of its own. Repeated rows count once, here and
    in the statistics. An empty table gives no rows; columns other than those named are ignored.
    """
    own = df.select(F.col(key).alias("__key"), F.col(source).alias("__source"), F.col(text).alias("__text"), *(F.col(c).alias(f"__size_{c}") for c in sizes)).distinct()
    measures = {"chars": F.length("__base"), "bytes": F.octet_length("__base"), "raw_chars": F.length("__text"), "raw_bytes": F.octet_length("__text")}
    full = F.coalesce(F.length(F.trim("__text")) > 0, F.lit(False))
    rows = keep(_marked(own, "__text").withColumns({"__hash": F.xxhash64("__text"), "__full": full} | {f"__size_{k}": v for k, v in measures.items()}).drop("__base", "__text"))
    sized = {k: F.col(f"__size_{k}") for k in (*measures, *sizes)}
    tops = keep(spikes(rows.where("__full"), "__source", sized))
    if tops.count() <= BROADCAST_ROWS:
        tops = F.broadcast(tops)
    words, pairs, longer = endings(own.where(full).select(_tokens(_base(F.col("__text"))).alias("__tokens")))
    words = words.select(F.col("word").alias("__w"), F.col("n").alias("__wn"), F.col("ends").alias("__we"))
    pairs = pairs.select(F.col("pair").alias("__p"), F.col("n").alias("__pn"), F.col("ends").alias("__pe"))

    # only open endings need the statistics; the other rows are not shuffled
    asks = F.col("__full") & F.col("__open")
    opened, others = rows.where(asks), rows.where(~asks)
    ended = opened.where(F.col("__word").isNotNull()).select(_shape(F.col("__word")).alias("__shape"), "__pair").distinct()
    known = (
        ended.join(words, F.col("__shape") == F.col("__w"), "left").join(pairs, F.col("__pair") == F.col("__p"), "left").join(longer, F.col("__pair") == F.col("stem"), "left")
        .select(
            F.col("__pair").alias("__k"),
            F.when(F.col("__pn") >= PAIR_LEAST, F.col("__pe") / F.col("__pn")).when(F.col("__wn") >= 2, F.col("__we") / F.col("__wn")).otherwise(0.0).alias("__rate"),
            F.coalesce("__wn", F.lit(0)).alias("__seen"),
            (F.coalesce("longer", F.lit(0)) > 3 * F.coalesce("__pn", F.lit(0))).alias("__stem"),
        )
    )
    top = tops.select(F.col("source").alias("__s"), F.col("measure").alias("__m"), F.col("length").alias("__l"))
    at_spike = _lengths(rows.where("__full"), sized, "__key", "__source", F.col("__hash").alias("__hh"))
    hit = at_spike.join(top, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("measure") == F.col("__m")) & (F.col("length") == F.col("__l"))).select(F.col("__key").alias("__hk"), "__hh").distinct()
    # texts without a last word meet nothing; those that end in the same pair are dealt over salts
    salt = F.pmod(F.xxhash64("__key", "__hash"), F.lit(SALTS)).cast("int")
    salted = known.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    worded = opened.where(F.col("__pair").isNotNull()).withColumn("__at", salt).join(salted, (F.col("__pair") == F.col("__k")) & (F.col("__at") == F.col("__salt")), "left")
    every = worded.unionByName(opened.where(F.col("__pair").isNull()), allowMissingColumns=True)
    joined = every.join(hit, F.col("__key").eqNullSafe(F.col("__hk")) & (F.col("__hash") == F.col("__hh")), "left")
    joined = joined.unionByName(others, allowMissingColumns=True)
    unseen = F.coalesce((F.col("__seen") == 0) | (F.col("__stem") & (F.col("__rate") < 0.5)), F.lit(False))
    lower = F.coalesce(F.col("__word").rlike(r"^\p{Ll}"), F.lit(False))
    no_end = F.when(F.col("__word").isNull(), ~F.col("__shut")).otherwise(F.coalesce("__rate", F.lit(0.0)) < NO_END)
    reason = (
        F.when(~F.col("__full"), None)
        .when(F.col("__broken") & ~F.col("__phrase"), "structure")
        .when(F.col("__phrase") & ~(lower & F.col("__several") & ~F.col("__figure")), None)
        .when(F.col("__open") & F.col("__hh").isNotNull(), "spike")
        .when(F.col("__open") & unseen, "word")
        .when(F.col("__open") & no_end & ~F.col("__phrase"), "sentence")
    )
    return joined.select(F.col("__key").alias(key), F.col("__source").alias(source), reason.isNotNull().alias("cut"), reason.alias("reason")).distinct()


def rates(found: DataFrame, source: str = "provider") -> DataFrame:
    """``source, n, n_cut, share`` for every source."""
    return found.groupBy(source).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("cut").cast("int")).alias("n_cut"), F.avg(F.col("cut").cast("double")).alias("share"))
