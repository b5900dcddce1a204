"""Sentence units of texts in many languages and scripts.

A text is cut into blocks (paragraphs; headings, list items, infobox lines and Q/A lines are one unit each). In a
paragraph every character is tagged boundary or inside by a linear chain: only characters after which a sentence can
end have a score for "boundary", the rest are inside for certain, so that Viterbi decoding runs over the candidates.
The score is a log-linear model of what stands around the candidate; a transition keeps a quotation that opens a
sentence together with what follows it. The model is trained on a bounded sample of the texts themselves: paragraph
ends, joined with the beginning of another paragraph, are boundaries, and marks inside numbers or before commas are
not. For scripts without sentence marks (Thai) the candidates are blanks, and the model learns from paragraphs whose
ends were stripped which words end and which begin sentences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestone.session import cut as keep

#: Texts on which the model is trained, whatever the size of the collection.
TRAIN_TEXTS = 6000
#: Words that make up less than this part of all words of their kind have no score of their own.
RARE = 50_000
EPOCHS, RATE, PULL = 5, 0.05, 0.02

# Marks, quotation marks and brackets.
MARKS = ".!?。！？।؟…．｡"
PAIRS = {"«": "»", "“": "”", "„": "“”", "「": "」", "『": "』", "《": "》", "(": ")", "（": "）", "[": "]", "‹": "›"}
BRACKETS = "(（["
CLOSING = "\"'”’»）)]」』》›“*"
CANDIDATE = re.compile(r"[.!?。！？।؟…．｡]+(?:[   ]?[!?…]+)*(?:[   ]?»|[\"'”’）)\]」』》›“])*(?:\[\d{1,3}\])*")
GREEK_QUESTION = re.compile(r"(?<=[Ͱ-Ͽἀ-῿A-Za-z])[;;](?:[\"'”’»)])*(?:\[\d{1,3}\])*(?=\s|$)")
# Abbreviations that are followed by what they belong to, and others that may also end a sentence.
BEFORE_NAMES = set(
    "dr prof mr mrs ms mme mlle hr fr frau st ste rev hon capt gen sen col lt sgt gov rep sr sra srta dra dña d m mm cie ca cf c no nr nos núm pág págs p pp vol vols ch chap fig figs approx aprox env vgl sog bzw bspw ed eds vs v b art sec sept oct nov dec jan feb mar apr jun jul aug t ee dept mt ft rd zt ul "
    "им ул проф акад ок ср см стр пр пл д-р г-н р к κ κα σ σελ αρ बाद पृ डॉ श्री د م أ ص".split()
)
MAY_END = set("inc ltd co corp jr esq etc al am pm usa uk us bc ad km kg cm mm г гг д т чел руб км др пр тыс млн χλμ μ μχ πχ uu jc ff a h u e i n".split())
INFORMAL = re.compile(r"(?:u|ur|i|i'd|i'm|btw|ok|okay|iirc|thx|thanks|imo|idk|pretty|lol|nope|yeah|no way)\b", re.I)
MONTHS = re.compile(r"(?:januar|februar|märz|april|mai|juni|juli|august|september|oktober|november|dezember|january|february|march|may|june|july|october|december)", re.I)
#: Words before a German ordinal.
ORDINAL = re.compile(r"(?i)(?:^|\s)(?:im|am|vom|zum|beim|dem|den|des)\s\d{1,2}$")
NAMES = (
    "bias", "next_upper", "next_lower", "next_digit", "next_uncased", "next_open", "next_informal", "before_names", "may_end_upper", "may_end_other", "initial", "single_other",
    "short_word", "long_word", "question", "repeated", "dots", "dots_spaced", "full_stop_wide", "danda", "no_blank", "closes_quote", "month", "number", "ends_often", "bracket_whole", "other_script_stop", "name_question", "continues",
)
PRIOR = {
    "bias": 1.0, "next_upper": 2.0, "next_lower": -4.0, "next_digit": -0.5, "next_uncased": 1.0, "next_open": 1.5, "next_informal": 4.0, "before_names": -8.0, "may_end_upper": 0.0, "may_end_other": -6.0, "initial": -7.0, "single_other": -6.0,
    "short_word": -0.5, "long_word": 1.5, "question": 1.0, "repeated": 5.0, "dots": 0.0, "dots_spaced": -6.0, "full_stop_wide": 6.0, "danda": 6.0, "no_blank": -1.0, "closes_quote": -2.0, "month": -6.0, "number": 0.0, "ends_often": 1.0, "bracket_whole": 4.0, "other_script_stop": -8.0, "name_question": -4.0, "continues": -9.0,
}
AT = {n: i for i, n in enumerate(NAMES)}
LINE_UNIT = re.compile(r"\s*(?:==+.*==+\s*$|#{1,6}\s|\{\{|\}\}|\|[^\n]*=|[QA]:\s|[QA]：)")
LIST_ITEM = re.compile(r"\s*(?:[-*•‣▪–]\s+\S|\d{1,3}[.)]\s+\S|[a-z]\)\s+\S)")
THAI = re.compile(r"[฀-๿]")
LETTERS = re.compile(r"[^\W\d_]")
BEFORE_POINT = re.compile(r"([^\W_][\w'’-]*)\.(?=\s|$)")
DEVANAGARI, GREEK = re.compile(r"[ऀ-ॿ]"), re.compile(r"[Ͱ-Ͽ]")
SPAN_MARK = re.compile("[" + re.escape("\"'" + "".join(PAIRS) + "".join(PAIRS.values())) + "]")
STOPS = re.compile("[" + re.escape(MARKS) + "\u202f\u00a0 ]*")


def blocks(text: str) -> Iterator[tuple[int, int, bool]]:
    """``start, end, whole``: paragraphs, and lines that are one unit, without surrounding white space."""
    start = end = None
    listed, ended = True, True
    for line in re.finditer(r"[^\r\n]*(?:\r\n|\r|\n|$)", text):
        a, b = line.span()
        if a == b:
            continue
        body = line.group().strip()
        if not body:
            if start is not None:
                yield start, end, False
            start, listed, ended = None, True, True
            continue
        s = a + len(line.group()) - len(line.group().lstrip())
        item = bool(LIST_ITEM.match(line.group())) and (listed or ended)
        if item or LINE_UNIT.match(line.group()):
            if start is not None:
                yield start, end, False
            yield s, s + len(body), True
            start, listed, ended = None, True, True
            continue
        start, end = (s if start is None else start), s + len(body)
        listed, ended = False, body[-1] in MARKS + CLOSING
    if start is not None:
        yield start, end, False


def spans(p: str) -> list[tuple[int, int, str]]:
    """Quotations and brackets of a paragraph: opening, closing, kind. What isn't closed is none."""
    found, stack = [], []
    for m in SPAN_MARK.finditer(p):
        i, c = m.start(), m.group()
        if c in '"\'':
            if c == "'":
                before, after = p[i - 1] if i else " ", p[i + 1] if i + 1 < len(p) else " "
                opens = (before.isspace() or before in "([«“\"—") and not after.isspace()
                closes = any(k == "'" for _, k in stack) and not after.isalnum() and (before in ".!?,…" or before.isalnum())
                if not opens and not closes:
                    continue
            else:
                closes = any(k == c for _, k in stack)
            if closes:
                while stack:
                    o, k = stack.pop()
                    if k == c:
                        found.append((o, i, c))
                        break
            else:
                stack.append((i, c))
        elif any(c in PAIRS.get(k, "") for _, k in stack) and not (c == "“" and not any(k == "„" for _, k in stack)):
            while stack:
                o, k = stack.pop()
                if c in PAIRS.get(k, ""):
                    found.append((o, i, k))
                    break
        elif c in PAIRS:
            stack.append((i, c))
    return found


def _word_before(p: str, i: int) -> str:
    j = i
    while j and (p[j - 1].isalnum() or p[j - 1] in ".-'’" or "ऀ" <= p[j - 1] <= "๿" or "̀" <= p[j - 1] <= "ͯ"):
        j -= 1
    return p[j:i]


class Paragraph:
    """The candidates of a paragraph, with their features."""

    def __init__(self, p: str, endings: dict[str, float]):
        self.ends, self.starts, self.rows, self.quote = [], [], [], []
        cover = spans(p)
        found = [(m.start(), m.end()) for m in CANDIDATE.finditer(p)]
        greek = len(GREEK.findall(p)) > 3
        devanagari = bool(DEVANAGARI.search(p))
        if greek:
            found = sorted(found + [(m.start(), m.end()) for m in GREEK_QUESTION.finditer(p)])
        for s, e in found:
            # closing marks that close nothing open before the mark belong to what follows
            while e > s + 1 and p[e - 1] in "\"'“" and not any(c == e - 1 for _, c, _ in cover):
                e -= 1
            inside = [(o, c, k) for o, c, k in cover if o < s and c >= e]
            if inside:
                continue
            n = e
            while n < len(p) and p[n].isspace():
                n += 1
            if n >= len(p):
                continue
            closed = [(o, c, k) for o, c, k in cover if s <= c < e and o < s]
            opened = min((o for o, _, _ in closed), default=None)
            kind = next((k for o, _, k in closed if o == opened), "")
            x = self._features(p, s, e, n, kind, endings, devanagari)
            if x is None:
                continue
            if kind and kind in BRACKETS and opened is not None and not self._begins(p, opened):
                continue
            if kind in BRACKETS and kind:
                x[AT["bracket_whole"]] = 1
                opened = None
            elif kind:
                x[AT["closes_quote"]] = 1
                wide = p[n] not in "\"“«„「『(（《" and not (p[n].isupper() or p[n].isdigit())
                lead = p[:opened].rstrip()
                if wide and LETTERS.match(p[n]) and lead and lead[-1] not in ":：,،、" and n == e:
                    x[AT["continues"]] = 1
            self.ends.append(e)
            self.starts.append(n)
            self.rows.append(x)
            self.quote.append(opened if opened is not None else -1)

    def _begins(self, p: str, o: int) -> bool:
        lead = p[:o].rstrip()
        return not lead or lead[-1] in MARKS + CLOSING

    def _features(self, p: str, s: int, e: int, n: int, kind: str, endings: dict[str, float], devanagari: bool) -> np.ndarray | None:
        x = np.zeros(len(NAMES))
        mark, run, nxt, blank = p[s], p[s:e], p[n], n > e
        word = _word_before(p, s)
        low = word.replace(".", "").lower().strip("'’-")
        last = re.split(r"[.\s]", word)[-1].lower()
        x[AT["bias"]] = 1
        stops = re.match(r"[.!?。！？।؟…．｡   ]*", run).group()
        if mark in "。！？．｡" or (mark == "…" and not nxt.islower() and ord(p[max(0, s - 1)]) > 0x2E80):
            x[AT["full_stop_wide"]] = 1
            return x
        if mark == "।":
            x[AT["danda"]] = 1
            return x
        if nxt in ",;،，、)）»”]":
            return None
        if mark == "." and len(stops.strip()) == 1:
            if not blank and not kind:
                if not (nxt.isupper() and n + 1 < len(p) and (p[n + 1].islower() or p[n + 1] == " ") and len(last) >= 3 and last not in BEFORE_NAMES and "www" not in word or last in ("г", "км", "чел") and nxt.isupper()):
                    if not (LETTERS.match(nxt) and not nxt.isupper() and not nxt.islower() and len(last) >= 3 and last.isascii()):
                        return None
                x[AT["no_blank"]] = 1
            if re.fullmatch(r"(?:[^\W\d_]\.)*[^\W\d_]", word) and word[-1].isupper() and low not in MAY_END | {""} or (len(low) == 1 and word.isupper()):
                x[AT["initial"]] = 1
            elif last in BEFORE_NAMES and low not in MAY_END:
                x[AT["before_names"]] = 1
            elif low in MAY_END or last in MAY_END:
                x[AT["may_end_upper" if nxt.isupper() or nxt in "\"“«„'(「¿¡" else "may_end_other"]] = 1
            elif len(low) == 1 and not low.isdigit():
                x[AT["initial" if word[-1:].isupper() else "single_other"]] = 1
            elif word and len(word) <= 3 and not low.isdigit():
                x[AT["short_word"]] = 1
            if re.match(r"[^\W\d_]{4,}$", last) and last not in BEFORE_NAMES and low not in MAY_END:
                x[AT["long_word"]] = 1
                if nxt.islower() and last.islower() and word.islower():
                    x[AT["next_informal"]] += 0.6
            if low.isdigit():
                x[AT["number"]] = 1
                if len(low) <= 2 and (MONTHS.match(p[n:]) or nxt.isdigit() or ORDINAL.search(p[:s])):
                    x[AT["month"]] = 1
            if devanagari and (("ऀ" <= p[s - 1] <= "ॿ") or "ऀ" <= nxt <= "ॿ"):
                x[AT["other_script_stop"]] = 1
            if THAI.match(nxt) or (s and THAI.match(p[s - 1])):
                x[AT["other_script_stop"]] = 1
            if low in endings:
                x[AT["ends_often"]] = endings[low]
        else:
            if len(stops.strip()) > 1 and set(stops.strip()) <= {".", "…"}:
                x[AT["dots"]] = 1
                if s and p[s - 1].isspace():
                    x[AT["dots_spaced"]] = 1
            elif mark in "?!؟":
                x[AT["question"]] = 1
                if len(stops.strip()) > 1:
                    x[AT["repeated"]] = 1
                if word[:1].isupper() and nxt.islower():
                    x[AT["name_question"]] = 1
            if not blank and not kind and (nxt.isalnum() and nxt.isascii()) and not nxt.isupper():
                return None
        if nxt.isupper():
            x[AT["next_upper"]] = 1
        elif nxt.islower():
            x[AT["next_lower"]] = 1
            if INFORMAL.match(p[n:]) and (mark != "." or len(stops) > 1 or len(last) >= 2):
                x[AT["next_informal"]] = 1
        elif nxt.isdigit():
            x[AT["next_digit"]] = 1
        elif LETTERS.match(nxt):
            x[AT["next_uncased"]] = 1
        else:
            x[AT["next_open"]] = 1
        return x


def viterbi(score: np.ndarray, quote: list[int], starts: list[int]) -> list[bool]:
    """The best tags of a chain: a candidate that closes the quotation which opened its sentence is no boundary."""
    best, back = (0.0, -1e9), []  # the scores of the last tag being boundary (the paragraph's start counts), inside
    for i, s in enumerate(score):
        opens = quote[i] >= 0 and quote[i] == (starts[i - 1] if i else 0)
        from_b, from_i = best
        b = (from_b + s - (12.0 if opens else 0.0), from_i + s)
        back.append((b[0] >= b[1], from_b >= from_i))
        best = (max(b), max(best))
    tags, tag = [False] * len(score), best[0] > best[1]
    for i in range(len(score) - 1, -1, -1):
        tags[i] = tag
        tag = back[i][0] if tag else back[i][1]
    return tags


def _contexts(p: str) -> list[tuple[int, int, str, str]]:
    """The blanks of a Thai paragraph with the ends of what stands before and after them."""
    found = []
    for m in re.finditer(r"\s+", p):
        left, right = p[: m.start()].split()[-1:], p[m.end() :].split()[:1]
        if left and right:
            a, b = _edge(left[0], -1), _edge(right[0], 1)
            if THAI.search(a) and b[:1].isascii() and b[:1].isupper():
                b = "^"  # a name after a Thai word
            found.append((m.start(), m.end(), a, b))
    return found


def _edge(word: str, side: int) -> str:
    """Numbers are one class; of a word, the run of one script at its edge, Thai shortened."""
    word = word.strip("“”\"'«»()")
    if re.fullmatch(r"[\d.,]+", word):
        return "#"
    runs = re.findall(r"[฀-๿]+|[^฀-๿]+", word)
    if not runs:
        return "?"
    run = runs[-1] if side < 0 else runs[0]
    if THAI.match(run):
        return run[-5:] if side < 0 else run[:5]
    return run


def edge_counts(texts: list[str]) -> dict[tuple[str, str], list[int]]:
    """How often words stand at the edges of paragraphs and elsewhere: ``(kind, word) -> [at the edge, elsewhere]``.

    Kinds: ``end`` for words before a point, ``left`` and ``right`` for what stands before and after the blanks of
    unpunctuated scripts (the edge is there the end and the beginning of a paragraph).
    """
    found: dict[tuple[str, str], list[int]] = {}

    def count(kind: str, word: str, edge: bool) -> None:
        found.setdefault((kind, word), [0, 0])[not edge] += 1

    for t in texts:
        for a, b, whole in blocks(t):
            if whole:
                continue
            p = t[a:b]
            for m in BEFORE_POINT.finditer(p):
                count("end", m.group(1).lower(), m.end() == len(p))
            if THAI.search(p):
                p = re.sub(r"\s+", " ", p)
                words = p.split()
                first = _edge(words[0], 1)
                count("left", _edge(words[-1], -1), True)
                count("right", first, True)
                if first[:1].isascii() and first[:1].isupper():
                    count("right", "^", True)
                for _, _, left, right in _contexts(p):
                    count("left", left, False)
                    count("right", right, False)
    return found


def edge_scores(counts: list[tuple[str, str, int, int]]) -> dict[str, dict[str, float]]:
    """Of each kind the words with their log odds of standing at an edge; of words before points only those that differ
    from all words together by chance in less than one case of twenty."""
    out: dict[str, dict[str, float]] = {"end": {}, "left": {}, "right": {}}
    total = {k: (sum(r[2] for r in counts if r[0] == k), sum(r[3] for r in counts if r[0] == k)) for k in out}
    for kind, word, edge, other in counts:
        edges, others = total[kind]
        if kind == "end":
            n, share = edge + other, edges / max(1, edges + others)
            if abs(edge - n * share) >= 2 * np.sqrt(n * share * (1 - share)) > 0:
                out[kind][word] = float(np.clip(np.log((edge + 0.5) / (n * share + 0.5)), -3, 1))
        elif edge + other >= 2:
            out[kind][word] = float(np.log((edge + 0.1) / (edges + 1)) - np.log((other + 0.1) / (others + 1)))
    return out


class Model:
    """Weights of the marks, words that end sentences, and the edges of unpunctuated sentences."""

    def __init__(self, counts: list[tuple[str, str, int, int]] | None = None) -> None:
        self.weights = np.array([PRIOR[n] for n in NAMES])
        self.counted = counts is not None
        self._take(counts or [])

    def _take(self, counts: list[tuple[str, str, int, int]]) -> None:
        scores = edge_scores(counts)
        self.endings, self.left, self.right = scores["end"], scores["left"], scores["right"]

    def train(self, texts: list[str]) -> None:
        """Fit the weights on some texts; their own edges are counted if those of the collection were not given."""
        if not self.counted:
            self._take([(k, w, e, o) for (k, w), (e, o) in edge_counts([t for t in texts if t]).items()])
        paragraphs = [t[a:b] for t in texts if t for a, b, whole in blocks(t) if not whole]
        # paragraph ends before another paragraph's beginning are boundaries; marks before commas and figures are none
        rows, labels = [], []
        ended = [p for p in paragraphs if p[-1] in MARKS + CLOSING and not THAI.search(p)]
        for p, q in zip(ended, ended[1:] + ended[:1]):
            joined = Paragraph(p[-200:] + " " + q[:60], self.endings)
            cut = min(len(p), 200)
            for e, x, o in zip(joined.ends, joined.rows, joined.quote):
                if e == cut and o < 0:
                    rows.append(x)
                    labels.append(1.0)
                elif e < cut and (x[AT["before_names"]] or x[AT["initial"]] or x[AT["month"]]):
                    rows.append(x)
                    labels.append(0.0)
        if rows:
            x, y, prior = np.array(rows), np.array(labels), self.weights.copy()
            rng = np.random.default_rng(0)
            for _ in range(EPOCHS):
                for i in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
                    z = 1 / (1 + np.exp(-np.clip(x[i] @ self.weights, -30, 30)))
                    self.weights -= RATE * (x[i].T @ (z - y[i]) / len(i) + PULL * (self.weights - prior))

    def units(self, text: str | None) -> list[tuple[int, int]]:
        if not text:
            return []
        found = []
        for a, b, whole in blocks(text):
            found += [(a, b)] if whole else [(a + s, a + e) for s, e in self.sentences(text[a:b])]
        return found

    def sentences(self, p: str) -> list[tuple[int, int]]:
        c = Paragraph(p, self.endings)
        cuts = []
        if c.rows:
            tags = viterbi(np.array(c.rows) @ self.weights, c.quote, c.starts)
            cuts = [(e, s) for e, s, t in zip(c.ends, c.starts, tags) if t]
        if THAI.search(p):
            cuts += self._blanks(p, cuts)
        out, at = [], 0
        for e, s in sorted(set(cuts)):
            if e > at:
                out.append((at, e))
            at = s
        if at < len(p):
            out.append((at, len(p)))
        return out

    def _blanks(self, p: str, cuts: list[tuple[int, int]]) -> list[tuple[int, int]]:
        cover = spans(p)
        taken = {s for _, s in cuts}
        rows, score, quote = [], [], []
        for a, b, left, right in _contexts(p):
            if any(o < a < c for o, c, _ in cover) or b in taken or not (THAI.search(p[max(0, a - 40) : b + 40])):
                continue
            closed = next((o for o, c, _ in cover if c == a - 1), -1)
            rows.append((a, b))
            score.append(self.left.get(left, -1.5 if left.isascii() else 0.0) + self.right.get(right, -2.0 if right.isascii() else -0.5) + 1.0)
            quote.append(closed)
        tags = viterbi(np.array(score), quote, [b for _, b in rows]) if rows else []
        return [r for r, t in zip(rows, tags) if t]


def count_edges(texts: DataFrame) -> list[tuple[str, str, int, int]]:
    """``edge_counts`` over all texts (``t``), counted in tasks and summed. Kept are words that make up 1/RARE of all
    words of their kind or more, RARE at most of each, whatever the size of the collection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = edge_counts(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in found], pa.string()), pa.array([w for _, w in found], pa.string()), *(pa.array([c[i] for c in found.values()], pa.int64()) for i in (0, 1))], names=["kind", "word", "edge", "other"]
            )

    counts = keep(texts.select("t").mapInArrow(run, "kind string, word string, edge bigint, other bigint").groupBy("kind", "word").agg(F.sum("edge").alias("edge"), F.sum("other").alias("other")))
    total = counts.groupBy("kind").agg(F.sum(F.col("edge") + F.col("other")).alias("total"))
    usual = counts.join(F.broadcast(total), "kind").where((F.col("edge") + F.col("other")) * RARE >= F.col("total"))
    return [(r.kind, r.word, r.edge, r.other) for r in usual.collect()]


def distinct_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``t, h`` of the different texts that are not blank, kept in the checkpoint folder."""
    return keep(docs.where(F.length(F.trim(text)) > 0).select(F.col(text).alias("t"), F.xxhash64(text).alias("h")).distinct())


def fit(texts: DataFrame) -> Model:
    """A model whose edges are counted over all of ``texts`` (``t, h``) and whose weights are fitted on TRAIN_TEXTS at
    most, drawn by hash."""
    model = Model(count_edges(texts))
    n = texts.count()
    drawn = texts.where(F.pmod("h", F.lit(1_000_000)) < int(1_000_000 * min(1.0, 3 * TRAIN_TEXTS / max(n, 1))) + 1)
    model.train([r.t for r in drawn.orderBy("h").limit(TRAIN_TEXTS).collect()])
    return model


def sentence_units(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """``doc_id, sent_start, sent_end`` of the sentence units of all documents, in code points.

    Null, empty and blank texts have none; rows that repeat an id and text come out once. A text under several ids is
    decoded once. An empty table gives no rows; other columns are ignored.
    """
    texts = distinct_texts(docs, text)
    held = docs.sparkSession.sparkContext.broadcast(model or fit(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, starts, ends = [], [], []
            for t, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for s, e in held.value.units(t):
                    hashes.append(h)
                    starts.append(s)
                    ends.append(e)
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["h", "sent_start", "sent_end"])

    units = texts.select("t", "h").mapInArrow(run, "h bigint, sent_start bigint, sent_end bigint")
    ids = docs.where(F.length(F.trim(text)) > 0).select(F.col(doc_id).alias("__id"), F.xxhash64(text).alias("h")).distinct()
    return ids.join(units, "h").select(F.col("__id").alias(doc_id), "sent_start", "sent_end").distinct()
