"""Variant spellings of names, linked by suffix blocking and longest-common-subsequence comparison of their tokens.

Names are folded (case, accents, punctuation) and split into tokens. Misspelt tokens find their usual form among the
tokens with which they share a suffix, or a beginning and the other token of their names; a key that is too common is
refined by what is left of the token without one or two letters, which loses no pair that the comparison would accept.
Candidates are compared by their longest common subsequence. Initials and abbreviations are spelt out where the rest of the name leaves one
possibility. Names whose tokens then agree, whatever their order, are one entity; a name that fits several is none.
"""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lodestone.session import cut as keep

#: Shortest suffix that is indexed, and the tokens that one may bring together before it is refined.
SUFFIX, COMMON = 4, 200
#: Shortest token that can be misspelt, and longest that is refined letter by letter.
MISSPELT, LONG = 3, 24
#: Shortest token that can carry a name by itself.
CORE = 5

# Titles, and words that name no part of an entity.
TITLES = "dr prof mr mrs ms miss sir dame lord lady rev hon capt gen sen mme mlle herr frau sra sr don".split()
EMPTY = "the of at for and in an de du la le der die das el company co ltd limited inc incorporated corp corporation plc gmbh llc".split()
# What a name is, said beside it.
KIND = r"\(\s*(?:film|movie|novel|book|play|song|album|painting|town|city|village|person|company|disambiguation)\s*\)|^\s*(?:the\s+)?(?:town|city|village)\s+of\s"
# Short forms that are no beginnings of their words.
SHORT = {
    "st": "saint", "mt": "mount", "mnt": "mount", "pt": "port", "ft": "fort", "dept": "department", "intl": "international", "assn": "association", "govt": "government", "bros": "brothers", "natl": "national", "acad": "academy", "univ": "university", "inst": "institute", "lab": "laboratory", "soc": "society", "assoc": "association",
}
# Nicknames and the names that they stand for.
NICKNAMES = {
    "alexander": "alex al sandy xander lex sasha", "anthony": "tony ant", "benjamin": "ben benny benji", "charles": "charlie chuck chas chaz", "deborah": "deb debbie debby", "dorothy": "dot dottie dolly dory", "edward": "ed eddie ted teddy ned", "eleanor": "nell nellie ellie nora elle", "elizabeth": "beth liz lizzie betty betsy eliza libby bess lisa", "frederick": "fred freddie freddy fritz", "gertrude": "trudy gertie trude", "harold": "harry hal", "ingrid": "inge", "james": "jim jimmy jamie", "joseph": "joe joey jo", "katherine": "kate kathy katie kat kit kitty", "lawrence": "larry laurie lars", "leopold": "leo poldi", "margaret": "maggie meg peggy marge margie greta", "michael": "mike mick mickey micky", "nicholas": "nick nicky", "patricia": "pat patty trish tricia", "patrick": "paddy", "quentin": "quint", "rebecca": "becky becca reba", "richard": "rick dick rich ricky richie", "robert": "bob rob bobby robbie bert", "samuel": "sam sammy", "stephen": "steve stevie steph", "susan": "sue susie suzy", "theodore": "theo ted teddy", "thomas": "tom tommy", "ulrich": "uli ulli", "victoria": "vicky vic tori vickie", "wanda": "wendy", "william": "bill will billy willy liam", "yvonne": "vonnie evie", "zoe": "zo", "john": "jack johnny", "daniel": "dan danny", "david": "dave davy", "matthew": "matt", "christopher": "chris kit", "andrew": "andy drew", "barbara": "barb babs", "jennifer": "jen jenny", "catherine": "cathy cate", "donald": "don", "gregory": "greg", "jeffrey": "jeff", "kenneth": "ken kenny", "ronald": "ron", "timothy": "tim", "walter": "walt", "virginia": "ginny", "martha": "marty", "helen": "nellie", "henry": "hank", "philip": "phil", "peter": "pete", "raymond": "ray", "florence": "flo", "frances": "fran", "judith": "judy", "pamela": "pam", "sandra": "sandy", "jacob": "jake",
}


@F.pandas_udf(T.StringType())
def fold(s: pd.Series) -> pd.Series:
    """Lower case without accents."""
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).casefold())


@F.pandas_udf(T.IntegerType())
def common_subsequence(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence, with the rows of the table as bits of an integer."""

    def length(x: str, y: str) -> int:
        at: dict[str, int] = {}
        for i, c in enumerate(x):
            at[c] = at.get(c, 0) | 1 << i
        full = (1 << len(x)) - 1
        v = full
        for c in y:
            m = v & at.get(c, 0)
            v = ((v + m) | (v - m)) & full
        return len(x) - v.bit_count()

    return pd.Series([length(x, y) for x, y in zip(a, b)])


def _nicknames() -> dict[str, list[str]]:
    """The names that each nickname may stand for."""
    found: dict[str, list[str]] = {}
    for full, nicks in NICKNAMES.items():
        for nick in nicks.split():
            found.setdefault(nick, []).append(full)
    return found


def _map(d: dict[str, str]) -> Column:
    return F.from_json(F.lit(json.dumps(d)), "map<string,string>")


def parse(names: DataFrame) -> DataFrame:
    """``name, n, tokens array<struct<w, dot>>``: the words of each name, with whether a point follows."""
    spelt = {nick: fulls[0] for nick, fulls in _nicknames().items() if len(fulls) == 1} | SHORT
    # letters that stand for words: "AoG" and "EK" are written like "A.o.G." and "E.K."
    apart = F.regexp_replace("name", r"\b(\p{Lu})o(\p{Lu})\b", "$1.o.$2.")
    apart = F.when(apart.rlike(r"\p{Ll}"), F.regexp_replace(apart, r"\b(\p{Lu})(\p{Lu})\b", "$1. $2.")).otherwise(apart)
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(fold(apart), r"[’‘`´]", "'"), r"'s\b", " "), KIND, " ")
    parts = F.regexp_extract_all(plain, F.lit(r"[\p{L}\p{M}\p{N}]+\.?"), F.lit(0))
    table = _map(spelt)
    tokens = F.transform(
        parts,
        lambda p: F.struct(
            F.coalesce(F.element_at(table, F.rtrim(p, F.lit("."))), F.rtrim(p, F.lit("."))).alias("w"), (p.endswith(".") & (F.length(p) <= 7)).alias("dot")
        ),
    )
    return names.select("name", "n", tokens.alias("tokens"))


# Strings that are dates or quantities and no names.
NO_NAME = (
    r"(?iU)^\W*(?:(?:ca?|circa|approx|about|env|um|rd)\b\.?\s*)?[\p{N}.,/'\s–-]+(?:(?:st|nd|rd|th)\b)?\s*[%€$£]?\s*(?:\p{L}+\.?)?\W*$"
    r"|^\W*\p{N}{1,2}(?:st|nd|rd|th)?\.?\s+(?:de\s+)?\p{L}+\.?,?\s+(?:de\s+)?\p{N}{1,4}\W*$|^\W*\p{L}+\.?\s+\p{N}{1,2}(?:st|nd|rd|th)?,?\s+\p{N}{3,4}\W*$"
)


def collect_names(*columns: Column | DataFrame) -> DataFrame:
    """``name, n`` of the distinct strings of one-column tables; dates, quantities and strings without letters are no names."""
    every = None
    for c in columns:
        one = c.toDF("name")
        every = one if every is None else every.unionByName(one)
    dated = F.col("name").rlike(r"\p{N}") & F.col("name").rlike(NO_NAME)
    return every.where(F.col("name").rlike(r"\p{L}") & ~dated).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def rests(w: Column) -> Column:
    """What is left of a token without one letter, or without two of seven or more. Two tokens whose longest common
    subsequence lacks so few letters of the longer one have a rest in common. Tokens over LONG letters, of which there
    would be many rests, have the lengths from their own to two more instead, as such pairs differ by two letters at most."""
    without = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
    one = without(w)
    two = F.when(F.length(w) >= 7, F.flatten(F.transform(one, without))).otherwise(F.array().cast("array<string>"))
    letters = F.when(F.length(w) <= LONG, F.concat(F.array(w), one, two)).otherwise(F.array().cast("array<string>"))
    lengths = F.when(F.length(w) >= LONG - 1, F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: (F.length(w) + i).cast("string"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(letters, lengths))


def respell(words: DataFrame, partners: DataFrame) -> DataFrame:
    """``w, usual``: the usual form of misspelt tokens. ``words`` has ``w, spellings, n`` of every token, ``partners``
    the distinct pairs ``w, p`` of tokens that stand in one name."""
    long = words.where((F.length("w") >= MISSPELT) & ~F.col("w").isin(TITLES + EMPTY) & ~F.col("w").rlike(r"\p{N}"))  # numbers are never misspelt
    by_suffix = long.where(F.length("w") > SUFFIX).select("w", F.concat(F.lit("s"), F.substring("w", -SUFFIX, SUFFIX)).alias("key"))
    by_both = long.select("w", F.concat(F.lit("b"), F.substring("w", -2, 2), F.lit("|"), F.substring("w", 1, 1)).alias("key"))
    partner = partners.where((F.length("w") >= MISSPELT) & ~F.col("w").isin(TITLES + EMPTY)).select("w", F.concat(F.lit("p"), F.col("p"), F.lit("|"), F.substring("w", 1, 1)).alias("key"))
    keys = by_suffix.unionByName(by_both).unionByName(partner)
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    sized = keys.join(sizes, "key")
    refined = F.transform(rests(F.col("w")), lambda x: F.concat("key", F.lit("|"), x))
    blocks = sized.select("w", F.explode(F.when(F.col("size") <= COMMON, F.array("key")).otherwise(refined)).alias("key")).distinct()
    facts = long.select("w", "spellings", "n")
    a = blocks.join(facts, "w").select("key", F.col("w").alias("a"), F.struct("spellings", "n", "w").alias("fa"))
    b = blocks.join(facts, "w").select("key", F.col("w").alias("b"), F.struct("spellings", "n", "w").alias("fb"))
    near = (
        a.join(b, "key").where((F.col("fa") < F.col("fb")) & (F.abs(F.length("a") - F.length("b")) <= 2))
        .where(F.levenshtein("a", "b", 4) >= 0).select("a", "b", "fb", F.col("fa.spellings").alias("rare")).distinct()
    )
    most = F.greatest(F.length("a"), F.length("b"))
    scored = near.withColumn("lcs", common_subsequence("a", "b")).withColumn("ratio", 2 * F.col("lcs") / (F.length("a") + F.length("b")))
    close = (F.col("lcs") >= most - 1) | ((most >= 9) & (F.col("lcs") >= most - 2) & (F.col("ratio") >= 0.85))
    # a short token keeps its first letter, and the usual form is much more usual
    sure = ((most >= 8) | (F.substring("a", 1, 1) == F.substring("b", 1, 1))) & ((F.col("rare") <= 3) | (F.col("rare") * 3 <= F.col("fb.spellings")))
    best = scored.where(close & sure).groupBy("a").agg(F.max_by("b", F.struct("fb.spellings", "ratio", "fb.n", "b")).alias("b"))
    first = keep(best.select(F.col("a").alias("w"), F.col("b").alias("usual")))
    again = first.select(F.col("w").alias("usual"), F.col("usual").alias("further"))
    return first.join(again, "usual", "left").select("w", F.coalesce("further", "usual").alias("usual"))


def entities(names: DataFrame) -> DataFrame:
    """``name, entity``: the key of the entity that each name stands for. Names of one entity have the same key."""
    parsed = keep(parse(names))
    long = parsed.select("name", "n", F.posexplode("tokens").alias("pos", "t")).select("name", "n", "pos", "t.w", "t.dot")
    # tokens that were torn apart: two neighbours that together are a token of other names
    whole = long.groupBy("w").agg(F.countDistinct("name").alias("spellings"), F.sum("n").alias("n"))
    torn = parsed.where(F.size("tokens") >= 2).select("name", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("tokens") - 1), lambda i: F.concat(F.element_at("tokens", i)["w"], F.element_at("tokens", i + 1)["w"]))).alias("pos", "w"))
    joined = torn.where(F.length("w") >= 8).join(whole.select("w"), "w").groupBy("name").agg(F.min(F.struct("pos", "w")).alias("j"))
    mended = F.when(F.col("j").isNull(), F.col("tokens")).otherwise(
        F.concat(F.slice("tokens", F.lit(1), F.col("j.pos")), F.array(F.struct(F.col("j.w").alias("w"), F.lit(False).alias("dot"))), F.slice("tokens", F.col("j.pos") + 3, F.size("tokens")))
    )
    parsed = parsed.join(joined, "name", "left").select("name", "n", mended.alias("tokens"))
    tokens = keep(parsed.select("name", "n", F.posexplode("tokens").alias("pos", "t")).select("name", "n", "pos", "t.w", "t.dot"))

    # partners: the other tokens of a token's names
    sets = tokens.where(F.length("w") >= 3).groupBy("name").agg(F.collect_set("w").alias("ws"), F.max("n").alias("n"))
    spread = sets.select("n", F.explode("ws").alias("w"), "ws")
    words = spread.groupBy("w").agg(F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("n"))
    pairs = spread.select("w", F.explode("ws").alias("p")).where("w <> p").distinct()
    usual = respell(words, pairs)
    spelt = keep(tokens.join(usual, "w", "left").select("name", "n", "pos", F.coalesce("usual", "w").alias("w"), "dot").where(~F.col("w").isin(TITLES + EMPTY)))

    # full forms: what the unabbreviated names with a token also contain
    full = spelt.where((F.length("w") >= 3) & ~F.col("dot")).groupBy("name").agg(F.collect_set("w").alias("ws"), F.max("n").alias("n"))
    beside = full.select(F.explode("ws").alias("core"), "ws", "n").select("core", F.explode("ws").alias("w"), "n").where("core <> w").groupBy("core", "w").agg(F.count(F.lit(1)).alias("forms"))
    # a short token (an initial, or a beginning with a point) is spelt out beside a core of its name
    several = spelt.sparkSession.createDataFrame([(nick, full) for nick, fulls in _nicknames().items() if len(fulls) > 1 for full in fulls], "nick string, long string")
    short = spelt.where((F.length("w") <= 5) | F.col("dot"))
    cores = spelt.where((F.length("w") >= CORE) & ~F.col("dot")).select("name", F.col("w").alias("core"))
    # the first letter is part of the key, so that a common core does not bring all its partners together; nicknames meet
    # the names that they stand for
    asked = keep(short.select("name", "pos", F.col("w").alias("short"), "dot").join(cores, "name"))
    ambiguous = [n for n, f in _nicknames().items() if len(f) > 1]
    beside_of = beside.withColumnRenamed("w", "long").withColumn("first", F.left("long", F.lit(1)))
    between = F.concat(F.lit("^"), F.regexp_replace("short", r"(\p{L})(?=\p{L})", "$1.*"), F.lit("$"))
    clipped = (F.length("short") >= 3) & (F.col("dot") | F.col("short").rlike("^[^aeiou]+$")) & F.regexp_like("long", between)
    wanted = asked.select("short", "dot", "core").distinct()
    spelt_out = wanted.withColumn("first", F.left("short", F.lit(1))).join(beside_of, ["core", "first"]).where(
        (F.length("long") > F.length("short") + 1) & (F.col("long").startswith(F.col("short")) & ~F.col("long").isin(ambiguous) | clipped)
    )
    meant = wanted.join(F.broadcast(several), F.col("short") == F.col("nick")).drop("nick").join(beside_of.drop("first"), ["core", "long"])
    meanings = (
        spelt_out.select("short", "dot", "core", "long").unionByName(meant.select("short", "dot", "core", "long"))
        .groupBy("short", "dot", "core").agg(F.count_distinct("long").alias("k"), F.min("long").alias("long"))
    )
    options = (
        asked.join(meanings, ["short", "dot", "core"])
        .groupBy("name", "pos").agg(F.min(F.struct("k", "long")).alias("o")).select("name", "pos", F.when(F.col("o.k") == 1, F.array("o.long")).alias("longs"))
    )
    out = spelt.join(options, ["name", "pos"], "left").groupBy("name").agg(
        F.array_sort(F.collect_list(F.struct("pos", "w", "dot", "longs"))).alias("ts"), F.max("n").alias("n")
    )
    # initials give way where two long tokens stand; single letters in a row may stand for all words beside the core
    long_count = F.size(F.filter("ts", lambda t: (F.length(t["w"]) >= 3)))
    spelled = F.transform("ts", lambda t: F.when(t["longs"].isNotNull() & (F.size("ts") > 0) & (F.size(t["longs"]) == 1), F.try_element_at(t["longs"], F.lit(1))).otherwise(t["w"]))
    first_initial = F.filter(spelled, lambda w, i: (F.length(w) >= 2))
    letters = F.array_join(F.transform(F.filter("ts", lambda t: F.length(t["w"]) == 1), lambda t: t["w"]), "")
    core = F.try_element_at(F.filter(F.transform("ts", lambda t: t["w"]), lambda w: F.length(w) >= CORE), F.lit(1))
    drop_initials = (long_count >= 2) | (F.size(first_initial) >= 2)
    bag = F.array_sort(F.array_distinct(F.when(drop_initials, F.filter(spelled, lambda w: F.length(w) >= 2)).otherwise(spelled)))
    # where long tokens carry the name, an initial that was spelt out is a middle name unless it is the only given one
    kept = F.when(
        long_count >= 2,
        F.array_sort(F.array_distinct(F.transform(F.filter("ts", lambda t: (F.length(t["w"]) >= 2)), lambda t: F.when(t["longs"].isNotNull() & (F.size(t["longs"]) == 1), F.try_element_at(t["longs"], F.lit(1))).otherwise(t["w"])))),
    ).otherwise(bag)
    givens = F.array(*[F.lit(x) for x in NICKNAMES])
    kept = F.array_sort(F.array_distinct(F.transform(kept, lambda w: F.when((F.length(w) >= 3) & (F.length(w) <= 5) & (F.size(F.filter(givens, lambda g: g.startswith(w))) == 1), F.try_element_at(F.filter(givens, lambda g: g.startswith(w)), F.lit(1))).otherwise(w))))
    keyed = keep(out.select("name", "n", kept.alias("bag"), letters.alias("letters"), core.alias("core"), long_count.alias("longs")).where(F.size("bag") > 0))

    # one token alone belongs to the only entity of two tokens that has it; letters in a row to the words they begin
    forms = keyed.where((F.size("bag") >= 2) & (F.aggregate("bag", F.lit(True), lambda s, w: s & (F.length(w) >= 3)))).groupBy("bag").agg(F.count(F.lit(1)).alias("k"))
    single = forms.where(F.size("bag") == 2).select(F.explode("bag").alias("w"), "bag").groupBy("w").agg(F.count(F.lit(1)).alias("of"), F.min("bag").alias("only")).where("of = 1")
    rows = keyed.join(single.select(F.col("w").alias("alone"), "only"), (F.size("bag") == 1) & (F.try_element_at("bag", F.lit(1)) == F.col("alone")), "left")
    initials = lambda b: F.array_join(F.array_sort(F.transform(b, lambda w: F.substring(w, 1, 1))), "")
    acronyms = forms.where(F.size("bag") >= 3).select(F.explode("bag").alias("c"), "bag").select("c", initials(F.array_remove("bag", F.col("c"))).alias("acr"), "bag").groupBy("c", "acr").agg(F.count(F.lit(1)).alias("of"), F.min("bag").alias("meant")).where("of = 1").drop("of")
    written = F.array_join(F.array_sort(F.filter(F.split("letters", ""), lambda c: (c != "") & (c != "o"))), "")
    rows = rows.join(acronyms, (F.length("letters") >= 3) & (F.col("core") == F.col("c")) & (written == F.col("acr")), "left")
    final = F.coalesce("meant", "only", "bag")
    return rows.select("name", F.array_join(final, " ").alias("entity"))


def variants(found: DataFrame) -> DataFrame:
    """``name_a, name_b`` of all pairs of different spellings of one entity, ``name_a`` first by code points."""
    a, b = found.select("entity", F.col("name").alias("name_a")), found.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").where(F.col("name_a") < F.col("name_b")).select("name_a", "name_b").distinct()


def table_names(openie: DataFrame, triples: DataFrame) -> DataFrame:
    """The names of ``entities``, ``subject`` and ``object``, exactly as they stand; nulls and empty lists give none."""
    return collect_names(openie.select(F.explode("entities")), triples.select("subject"), triples.select("object"))
