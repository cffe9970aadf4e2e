"""Sentence units in many languages: a linear-chain model over possible boundaries, decoded with Viterbi.

Every character of a line is tagged as the last of a sentence or as inside one. A character can be last only where a
terminator with its closing marks ends, or, in scripts without terminators, before a blank; elsewhere the tag is
fixed. What is left is a chain of candidates with features of both sides and of the step between them.

All that is known of words is learnt from the corpus, in one count over all texts (`Lexicon`): a token that often
stands before a full stop but never before a line break, or before a lower-case letter, is an abbreviation; a word
that is capitalised only where a sentence may begin is a starter; and, for scripts without terminators, which letters
stand at the ends and beginnings of lines more often than inside them. The weights of the chain, its steps included,
are fitted by forward-backward on a bounded sample of texts whose labels the layout gives: a terminator before a line
break is a boundary, and the next line is what the text reads like after it once the break is taken out; before a
lower-case letter, a digit of the same number or a comma there is none; the other places are summed over both tags.
Texts of scripts without terminators are stripped of breaks and blanks: their joints are boundaries, all other places
between two letters are not, and the blanks of the text are left open. The prior mean of the weights is what a typist's
manual says.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweft.session import stored

# marks
_STOP = ".。｡।॥۔．។៕။።։"
_STRONG = "!?！？؟‼⁇⁈⁉"
_MORE = "…⋯"
_CLOSE = "\"'”’»›」』)）]】〉》＂)"
_OPEN_OF = {")": "(", "）": "（", "]": "[", "】": "【", "」": "「", "』": "『", "”": "“", "»": "«", "›": "‹", "〉": "〈", "》": "《"}
_OPENERS = frozenset([*_OPEN_OF.values(), "„"])
_BREAKS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85  "
_NATIVE = frozenset("。｡।॥۔។៕။።։")

# Abbreviations and titles in everyday use, which count as a little evidence before any corpus is read.
_LISTED = frozenset(
    "dr prof mr mrs ms st mt rev gen capt no nr vol p pp fig ch e.g i.e etc cf vs ca approx a.m p.m u.s u.k jan feb apr aug sept oct nov dec co ltd inc corp sq "
    "hr fr abb bd vgl ff usw bzw d.h z.b u.a jh sr sra srta dra pág págs núm aprox ee uu стр рис им г гг см др т.е т.д т.п т.ч тыс млн डॉ श्री पृ د أ ص ดร พ.ศ".split()
)
# Articles, personal pronouns and demonstratives, which are no names and begin many sentences.
_CLOSED = frozenset("the a an i he she it we you they this that these those der die das ein eine ich er sie es wir ihr dies dieser diese el la los las un una yo él ella nosotros ellos esto este esta я он она оно мы вы они это этот эта".split())
_GERMAN = re.compile(r"\b(?:der|die|das|und|wurde|wurden|nicht|ein|eine|von|mit|ist|am|den|dem|im)\b")
_LINE = re.compile(f"[^{_BREAKS}]+")
_TERM = f"[{re.escape(_STOP + _STRONG + _MORE)}]"
_CAND = re.compile(rf"{_TERM}+(?:[{re.escape(_CLOSE)}]|“(?=[\s,;:–—-]|$)|[\"'](?=[\s,;:–—-]|$)|{_TERM})*")
_THAI = "฀-๿຀-໿က-႟ក-៿"
_GAP = re.compile(rf"(?<=[{_THAI}])\s+(?=[{_THAI}\d])|(?<=[\d)”])\s+(?=[{_THAI}])")
_UNPUNCTUATED = re.compile(f"[{_THAI}]")
_LETTERS = re.compile(f"[{_THAI}\\d]+")
_REPEAT = "ๆໆ"
_MARKED, _UNMARKED = re.compile("[។៕။]"), re.compile("[฀-๿຀-໿]")  # Khmer and Burmese texts that use their full stops
_WORD = re.compile(r"[^\W_]+(?:[̀-ͯऀ-෿]*[^\W_]*)*")
_BEFORE = re.compile(r"[^\s(\[{«“„‘\"'/（「『]*$")
_UNIT = re.compile(r"\d\s?[a-zа-я]$")
_INITIAL = re.compile(r"[^\W\d_]\.")
_SEEN = re.compile(r"\S")
_DIGIT = re.compile(r"\d")
_REACH = 64  # code points on either side that a feature looks at; no abbreviation is longer
_MARK = re.compile(r"[()（）\[\]【】「」『』“”«»‹›〈〉《》„]")

#: Feature names with the prior mean of their weights (log odds of a boundary).
FEATURES = {
    "bias": 0.0, "strong": 4.0, "native": 5.0, "stop": 3.0, "ellipsis": 2.5, "blank_gap": 6.0,
    "next_lower": -9.0, "next_mixed": 1.0, "next_upper": 1.0, "next_plain": 0.5, "next_digit": 0.5, "next_opener": 1.0, "next_mark": -9.0, "line_end": 9.0,
    "tight_stop_upper": -1.0, "tight_stop_other": -10.0, "tight_digits": -12.0, "spaced_before": -3.0,
    "abbr_sure": -8.0, "abbr_likely": -6.5, "abbr_short": -0.5, "abbr_never": 1.0, "abbr_digit": -2.0, "initial": -9.0, "dotted": -1.0, "ordinal": -7.0,
    "starter_sure": 4.0, "starter_likely": 1.5, "starter_closed": 2.0, "starter_never": -0.5, "starter_after_sure": 6.0,
    "quote_strong": -8.0, "quote_strong_starter": 4.0, "quote_particle": -12.0, "quote_stop": 1.0, "deep": -12.0,
    "letters": -4.0, "gap_number_after": -6.0, "gap_number_between": -4.0, "gap_number_before": -0.5, "gap_repeat": -6.0, "gap_listed": -6.0,
    "before_rare": -4.0, "before_less": -1.0, "before_more": 1.0, "behind_rare": -4.0, "behind_less": -1.0, "behind_more": 1.0,
}
#: Weights of two boundaries in a row, by the characters between them: under 3, under 12, more.
TRANSITIONS = {"both_glued": -4.0, "both_near": 0.0, "both_far": 0.0}
_REACHES = (3, 12)
_NAMES = list(FEATURES)
_AT = {k: i for i, k in enumerate(_NAMES)}
_STEPS = list(TRANSITIONS)


def _step(gap: int) -> int:
    return 0 if gap < _REACHES[0] else 1 if gap < _REACHES[1] else 2


@lru_cache(200_000)
def _kind(c: str) -> str:
    k = unicodedata.category(c)
    if k in ("Ll",):
        return "lower"
    if k in ("Lu", "Lt"):
        return "upper"
    if k[0] in "LM":
        return "plain"
    if k[0] == "N":
        return "digit"
    if c in _OPENERS or k in ("Ps", "Pi") or c in "¿¡\"'":
        return "opener"
    return "mark"


@dataclass
class Lexicon:
    """What the corpus says of tokens before a stop (`left`), of capitalised words (`right`), and of the letters before
    and behind a place in scripts without terminators: for each the name of the feature it sets."""

    left: dict[str, str] = field(default_factory=dict)
    right: dict[str, str] = field(default_factory=dict)
    before: dict[str, str] = field(default_factory=dict)
    behind: dict[str, str] = field(default_factory=dict)


def _token(near: str) -> tuple[str, str]:
    """(whole, known part) of the token that ends a piece of text: lower case, without its last stops, digits as #."""
    core = _DIGIT.sub("#", _BEFORE.search(near)[0].rstrip(".").lower())
    piece = core.rpartition(".")[2]
    # of a token such as `mill.Dr` with a sentence's end inside, the last piece counts
    return core, core if "." not in core or core in _LISTED or len(piece) < 2 else piece


def _features(line: str, start: int, end: int, depth: int, german: bool, lex: Lexicon, after: str | None = None) -> list[int]:
    """Indices of the features of a candidate whose terminator begins at `start` and whose closing marks stop before `end`. after: the text that follows in place of the line's rest."""
    f = ["bias"]
    if after is None:
        m = _SEEN.search(line, end)
        body = line[m.start() : m.start() + _REACH] if m else ""
        tight = bool(m) and m.start() == end
    else:
        body, tight = after.lstrip()[:_REACH], False
    cluster = line[start:end]
    if not cluster or cluster.isspace():
        return _gap_features(line[max(0, start - _REACH) : start], body, bool(cluster), lex)
    terms = [c for c in cluster if c in _STOP or c in _STRONG or c in _MORE]
    strong = any(c in _STRONG for c in terms)
    native = any(c in _NATIVE for c in terms)
    many = cluster.count(".") > 1 or any(c in _MORE for c in terms)
    f.append("strong" if strong else "native" if native else "ellipsis" if many else "stop")
    quoted = cluster[-1] in "\"'”’»›」』“＂" and len(cluster) > 1
    if not body:
        return [_AT[x] for x in (*f, "line_end")]
    c = body[0]
    kind = _kind(c)
    word = _WORD.match(body)
    word = word[0] if word else ""
    if kind == "lower" and any(x.isupper() for x in word[1:]):
        kind = "mixed"
    f.append("next_" + kind)
    low = word.lower()
    begins = lex.right.get(low) or ("starter_closed" if low in _CLOSED else None) if kind == "upper" else None
    if begins and body[len(word) : len(word) + 1] == "." and (len(word) == 1 or low in _LISTED or lex.left.get(low, "")[:6] in ("abbr_s", "abbr_l")):
        begins = None  # of `J. K. Olm`, `Co. Ltd.` the second token is no start of its own
    starter = begins not in (None, "starter_never")
    if not strong and not native and not many:
        near = line[max(0, start - _REACH) : start]
        core, known = _token(near)
        piece = core.rpartition(".")[2]
        if tight:
            if kind == "digit":
                f.append("tight_digits")
            elif kind == "upper" or kind == "opener":
                f.append("tight_stop_upper")
            else:
                f.append("tight_stop_other")
        number = bool(known) and not known.strip("#")
        abbr = lex.left.get(known) or ("abbr_likely" if known in _LISTED else None)
        single = len(piece) == 1 and piece.isalpha() and _kind(piece) != "plain"
        if single and known not in _LISTED and not (_UNIT.search(near) and not _INITIAL.match(body)):
            f.append("initial")
        elif abbr and not number:
            f.append(abbr)
            if kind == "digit" and abbr in ("abbr_sure", "abbr_likely"):
                f.append("abbr_digit")
        elif known and not number and len(known) <= 3:
            f.append("abbr_short")
        if "." in core:
            f.append("dotted")
        if german and number and len(known) <= 2 and kind == "upper":
            f.append("ordinal")
        elif begins:
            f.append(begins)
            if begins in ("starter_sure", "starter_closed") and abbr in ("abbr_sure", "abbr_likely"):
                f.append("starter_after_sure")
    elif many and start and line[start - 1].isspace():
        f.append("spaced_before")
    if quoted:
        if body.startswith(("と", "って")):
            f.append("quote_particle")
        elif strong:
            f.append("quote_strong")
            if starter:
                f.append("quote_strong_starter")
        else:
            f.append("quote_stop")
    if depth > 0:
        f.append("deep")
    return [_AT[x] for x in f]


def _gap_features(near: str, body: str, blank: bool, lex: Lexicon) -> list[int]:
    """Features of a place between two letters of a script without terminators; blank: whether a blank stands there."""
    f = ["letters"]
    if blank:
        f = ["letters", "blank_gap"]
        last = near.rsplit(None, 1)
        unit = last[-1] if last else ""
        if body[:1].isdigit():
            f.append("gap_number_after")
        if unit.isdigit():
            f.append("gap_number_between" if len(unit) < len(near) else "gap_number_before")
        elif near[-1:].isdigit():
            f.append("gap_number_before")
        if near[-1:] in _REPEAT or body[:1] in _REPEAT:
            f.append("gap_repeat")
        if unit.rstrip(".") in _LISTED:
            f.append("gap_listed")
    for x in (lex.before.get(_DIGIT.sub("#", near[-3:])), lex.behind.get(_DIGIT.sub("#", body[:3]))):
        if x:
            f.append(x)
    return [_AT[x] for x in f]


def _candidates(line: str) -> list[tuple[int, int, int]]:
    """(start, end, open brackets and quotes after it) of the places where a sentence of the line may end."""
    found = [(m.start(), m.end()) for m in _CAND.finditer(line)]
    if _UNPUNCTUATED.search(line) and not (_MARKED.search(line) and not _UNMARKED.search(line)):
        found = sorted(found + [(m.start(), m.end()) for m in _GAP.finditer(line)])
    if not found:
        return []
    opened, closed = _matched(line)
    return [(s, e, bisect_left(opened, e) - bisect_left(closed, e)) for s, e in found]


def _matched(line: str) -> tuple[list[int], list[int]]:
    """Places of the opening and of the closing marks of all pairs, each in order. What stays open, or was never opened, counts for nothing."""
    stack: list[tuple[str, int]] = []
    held: dict[str, int] = {}
    opened, closed = [], []
    for m in _MARK.finditer(line):
        c = m[0]
        want = "„" if c in "“”" and held.get("„") else _OPEN_OF.get(c)
        if want and held.get(want):
            while True:
                o, at = stack.pop()
                held[o] -= 1
                if o == want:
                    break
            opened.append(at)
            closed.append(m.start())
        elif c in _OPENERS:
            stack.append((c, m.start()))
            held[c] = held.get(c, 0) + 1
    return sorted(opened), closed


class Model:
    """Weights of the chain and the lexicon; decode() tags the candidates of a line."""

    def __init__(self, weights: np.ndarray | None = None, steps: np.ndarray | None = None, lexicon: Lexicon | None = None):
        self.w = np.array(list(FEATURES.values())) if weights is None else np.asarray(weights, float)
        self.steps = np.array(list(TRANSITIONS.values())) if steps is None else np.asarray(steps, float)
        self.lexicon = lexicon or Lexicon()

    def decode(self, line: str) -> list[int]:
        """Ends (exclusive) of the sentences of a line, without its own end."""
        cand = _candidates(line)
        if not cand:
            return []
        german = bool(_GERMAN.search(line))
        w, steps = self.w.tolist(), self.steps.tolist()
        emit = [sum(w[i] for i in _features(line, s, e, d, german, self.lexicon)) for s, e, d in cand]
        inside, last, back = 0.0, emit[0], []
        for j in range(1, len(cand)):
            both = last + steps[_step(cand[j][0] - cand[j - 1][1])]
            to_in = (last, 1) if last > inside else (inside, 0)
            to_last = (both, 1) if both > inside else (inside, 0)
            back.append((to_in[1], to_last[1]))
            inside, last = to_in[0], to_last[0] + emit[j]
        state, ends = int(last > inside), []
        for j in range(len(cand) - 1, -1, -1):
            if state:
                ends.append(cand[j][0] if line[cand[j][0] : cand[j][1]].isspace() else cand[j][1])
            if j:
                state = back[j - 1][state]
        return ends[::-1]

    def spans(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of the sentences of a text in code points, without the blanks around them."""
        out = []
        for m in _LINE.finditer(text):
            line, base, at = m[0], m.start(), 0
            if line.isspace():
                continue
            for end in [*self.decode(line), len(line)]:
                part = line[at:end]
                body = part.strip()
                if body:
                    s = base + at + len(part) - len(part.lstrip())
                    out.append((s, s + len(body)))
                at = end
        return out


# What all texts say of tokens

_STOPS, _WORDS, _GRAMS = 0, 1, 2
_BEGINS = re.compile(rf"(?:^|{_TERM}[{re.escape(_CLOSE)}“]*\s+)[\s{re.escape(''.join(sorted(_OPENERS)))}¿¡\"'(]*([^\W\d_]\w*)")
_NAMED = re.compile(r"[^\W\d_]\w*")
_SINGLE = re.compile(r"(?<![.…])\.(?![.…])")


def _script(c: str) -> str:
    """The first word of the character's Unicode name, which names its script."""
    return unicodedata.name(c, "?").split(" ", 1)[0]


_script = lru_cache(20_000)(_script)


def count_tokens_of(texts: Iterable[str]) -> dict[tuple[int, str], list[int]]:
    """Counts by (kind, token). Tokens before a single stop: before a line break, a sure inside, a digit, anything else; capitalised, with or without a stop.
    Capitalised words: where a sentence may begin, all. Letters of scripts without terminators, three at a time: at line ends, at line beginnings, all.
    Of the first four also a bitmap of the hashed surroundings, which tells copies of one text from different uses."""
    out: dict[tuple[int, str], list[int]] = {}
    named = Counter()

    def add(kind: int, token: str, place: int, n: int = 1, around: str | None = None) -> None:
        got = out.setdefault((kind, token), [0] * 9)
        got[place] += n
        if around is not None:
            got[5 + place] |= 1 << (zlib.crc32(around.encode("utf-8", "surrogatepass")) & 63)

    for text in texts:
        lines = [x for x in map(str.strip, _LINE.findall(text)) if x]
        for i, line in enumerate(lines):
            if "." in line:
                for m in _SINGLE.finditer(line):
                    s, e = m.span()
                    known = _token(line[max(0, s - _REACH) : s])[1]
                    if not known or len(known) > 16:
                        continue
                    around = line[max(0, s - len(known) - 12) : e + 12] + (lines[i + 1][:12] if e >= len(line) and i + 1 < len(lines) else "")
                    if e >= len(line):
                        if i + 1 < len(lines):
                            add(_STOPS, known, 0, 1, around)
                        continue
                    if not line[e].isspace():
                        if line[e] in ",;:" or line[e] in _CLOSE and line[e + 1 : e + 2] in (",", ";"):
                            add(_STOPS, known, 1, 1, around)
                        continue
                    body = line[e : e + _REACH].lstrip()
                    k = _kind(body[:1])
                    mixed = k == "lower" and any(c.isupper() for c in _WORD.match(body)[0])
                    place = 1 if k == "lower" and not mixed or k == "mark" else 2 if k == "digit" else 3
                    add(_STOPS, known, place, 1, around if place < 3 else body[:16])
            if line.lower() != line:
                named.update(w for w in _NAMED.findall(line) if w[0].isupper())
                for m in _BEGINS.finditer(line):
                    if m[1][0].isupper():
                        add(_WORDS, m[1].lower(), 0, 1, line[m.end() : m.end() + 16])
            if _UNPUNCTUATED.search(line):
                flat = _DIGIT.sub("#", line)
                if _UNPUNCTUATED.search(line[-1]) or line[-1].isdigit():
                    add(_GRAMS, flat[-3:], 0)
                if _UNPUNCTUATED.search(line[0]) or line[0].isdigit():
                    add(_GRAMS, flat[:3], 1)
                for gram, n in Counter(g[j : j + 3] for g in map(str, _LETTERS.findall(flat)) for j in range(len(g) - 2)).items():
                    add(_GRAMS, gram, 2, n)
    for w, n in named.items():
        add(_WORDS, w.lower(), 1, n)
        if len(w) <= 16:
            add(_STOPS, w.lower(), 4, n)
    return out


def different(counts: np.ndarray) -> np.ndarray:
    """From counts and bitmaps the different uses (as far as 64 bits tell them apart, some 260), then the plain counts."""
    bits = np.bitwise_count(counts[:, 5:9].astype(np.int64).view(np.uint64))
    uses = np.minimum(counts[:, :4], 64 * np.log(64 / np.maximum(64 - bits, 1)))
    return np.concatenate([np.where(bits > 0, uses, counts[:, :4]), counts[:, :5]], 1).astype(float)


def _group_of(kind: int, token: str) -> str:
    """Tokens of a group share base rates: their kind and the script of the last letter."""
    return f"{kind}{_script(token[-1]) if kind == _STOPS else ''}"


def grade(kind: np.ndarray, token: list[str], counts: np.ndarray, totals: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray]:
    """The feature that each token sets ('' for none; letters as `before|behind`), and the evidence for it in nats.

    An abbreviation is likelier than the last word of a sentence when its stops shun line ends, which sentences meet at
    a rate that all tokens of the script show, and when lower case, commas or numbers follow. A starter is capitalised
    only where sentences may begin.
    """
    name, weight = [], np.zeros(len(token))
    for i, (k, t, n) in enumerate(zip(kind.tolist(), token, counts.astype(float))):
        total = totals[_group_of(k, t)]
        got = ""
        if k == _STOPS and n[:4].any():
            rate = max(0.05, (total[0] + 2) / (total[0] + total[3] + 20))  # a tenth before any text is read
            digit = min(0.3, (total[2] + 1) / (total[:4].sum() + 20))
            score = n[0] * np.log(0.01 / rate) + n[3] * np.log(0.99 / (1 - rate)) + n[1] * np.log(0.3 / 0.02) + n[2] * np.log(0.3 / digit)
            score += 3.0 if t in _LISTED else -2.0 - 0.4 * max(0, len(t) - 3) ** 2  # of many tokens some shun line ends by chance; few long ones are abbreviations
            stops = max(1.0, n[4:8].sum())
            score -= 4 * np.log1p(max(0.0, n[8] - stops) / stops)  # abbreviations keep their stop
            got = "abbr_sure" if score > 8 else "abbr_likely" if score > 3 else "abbr_never" if score < -2 and len(t) <= 4 else ""
            weight[i] = abs(score)
        elif k == _STOPS:
            pass
        elif k == _WORDS:
            share = (n[4] + 0.5) / (n[5] + 1.0)
            got = "starter_sure" if share > 0.97 and n[0] >= 15 else "starter_likely" if share > 0.85 and n[0] >= 6 else "starter_never" if share < 0.3 and n[5] >= 8 else ""
            weight[i] = n[5]
        else:
            want = total[:2] * n[2] / max(1.0, total[2])
            score = np.log((n[:2] + 1.0) / (want + 1.0))
            sides = ["_rare" if x < -2 else "_less" if x < -0.7 else "_more" if x > 0.7 else "" for x in score]
            got = "|".join(a + b if b else "" for a, b in zip(("before", "behind"), sides))
            got = "" if got == "|" else got
            weight[i] = np.abs(score).max() if got else 0.0
        name.append(got)
    return name, weight


def lexicon_of(entries: Iterable[tuple[int, str, str]]) -> Lexicon:
    lex = Lexicon()
    for kind, token, name in entries:
        if kind == _STOPS:
            lex.left[token] = name
        elif kind == _WORDS:
            lex.right[token] = name
        else:
            for of, x in zip((lex.before, lex.behind), name.split("|")):
                if x:
                    of[token] = x
    return lex


def learn_lexicon(texts: Iterable[str]) -> Lexicon:
    """The lexicon of texts at hand; `corpus_lexicon` is the same for a table."""
    got = count_tokens_of(texts)
    if not got:
        return Lexicon()
    kind, token = np.array([k for k, _ in got]), [t for _, t in got]
    counts = different(np.array([[x - (1 << 64) if x >> 63 else x for x in c] for c in got.values()], np.int64))
    totals: dict[str, np.ndarray] = {}
    for k, t, n in zip(kind.tolist(), token, counts):
        totals[_group_of(k, t)] = totals.get(_group_of(k, t), 0.0) + n.astype(float)
    return lexicon_of((k, t, x) for k, t, x in zip(kind.tolist(), token, grade(kind, token, counts, totals)[0]) if x)


def corpus_lexicon(texts: DataFrame, *, entries: int = 200_000) -> Lexicon:
    """The lexicon of a table of one text column, counted over all of it. A fitted parameter table: of the tokens whose
    evidence passes a threshold the `entries` with the most are kept, which bounds what the driver holds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                got = count_tokens_of(t for t in whole.column(0).slice(at, 2000).to_pylist() if t)
                cols = list(zip(*got.values())) if got else [()] * 9
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in got], pa.int8()), pa.array([t for _, t in got], pa.string()), pa.array([_group_of(k, t) for k, t in got], pa.string()),
                     *[pa.array(c, pa.int64()) for c in cols[:5]], *[pa.array(np.array(c, np.uint64).view(np.int64)) for c in cols[5:]]],
                    names=["kind", "token", "grp", *plain, *maps])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = different(np.stack([b.column(c).to_numpy() for c in (*plain, *maps)], 1))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *[pa.array(c) for c in n.T]], names=["kind", "token", "grp", *uses])

    plain, maps, uses = [f"n{i}" for i in range(5)], [f"m{i}" for i in range(4)], [f"u{i}" for i in range(9)]
    head = "kind tinyint, token string, grp string"
    counts = texts.mapInArrow(count, ", ".join([head, *[f"{c} bigint" for c in (*plain, *maps)]])).groupBy("kind", "token", "grp").agg(*[F.sum(c).alias(c) for c in plain], *[F.bit_or(c).alias(c) for c in maps])
    counts = stored(counts.mapInArrow(weigh, ", ".join([head, *[f"{c} double" for c in uses]])), "tokens")
    totals = {r["grp"]: np.array([r[c] for c in uses], float) for r in counts.groupBy("grp").agg(*[F.sum(c).alias(c) for c in uses]).collect()}  # one row for each script

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind, token = b.column(0).to_numpy(), b.column(1).to_pylist()
            name, weight = grade(kind, token, np.stack([b.column(c).to_numpy() for c in uses], 1), totals)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(name), pa.array(weight)], names=["kind", "token", "name", "weight"])

    best = counts.mapInArrow(judge, "kind tinyint, token string, name string, weight double").where("name <> ''").orderBy(F.col("weight").desc(), "kind", "token").limit(entries)
    return lexicon_of((r[0], r[1], r[2]) for r in best.select("kind", "token", "name").collect())


# Training of the chain


def _chains(texts: Iterable[str], lex: Lexicon) -> list[list[tuple[list[int], int, int]]]:
    """Chains of (features, kind of step from the one before, label): 0 inside, 1 last, -1 open."""
    out = []
    for text in texts:
        lines = [x for x in map(str.strip, _LINE.findall(text)) if x]
        for line, after in zip(lines, [*lines[1:], ""]):
            german = bool(_GERMAN.search(line))
            chain, at = [], -100
            for s, e, d in _candidates(line):
                gap, at = _step(s - at), e
                if e >= len(line):
                    if after and _kind(after[0]) in ("upper", "plain", "digit", "opener"):
                        chain.append((_features(line, s, e, 0, german, lex, after=" " + after), gap, 1))
                    continue
                f = _features(line, s, e, d, german, lex)
                sure = _AT["next_lower"] in f or _AT["tight_digits"] in f or line[e:].lstrip()[:1] in ",;:"
                chain.append((f, gap, 0 if sure else -1))
            if _UNPUNCTUATED.search(line[-1]) and _UNPUNCTUATED.match(after[:1] or " "):
                joined = line + " " + after
                chain.append((_features(joined, len(line), len(line) + 1, 0, german, lex), _step(len(line) - at), 1))
                flat = line + after  # stripped of the break and of blanks, with the joint as the one boundary
                out.append([(_features(flat, len(line), len(line), 0, german, lex), 2, 1)])
            if chain:
                out += [chain[i : i + 64] for i in range(0, len(chain), 64)]
            if _UNPUNCTUATED.search(line):
                for m in _LETTERS.finditer(line):
                    out += [[(_gap_features(line[max(0, j - 3) : j], line[j : j + 3], False, lex), 2, 0)] for j in range(m.start() + 3, m.end() - 2, 7)]
    return out


def _flow(emit: list[np.ndarray], both: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Chances of tag 1 at each place, and of two in a row at each step, by forward-backward over chains of falling length (place t: the first len(emit[t]) chains)."""
    fore = [(np.zeros(len(emit[0])) + emit[0][:, 0], emit[0][:, 1])]
    for t in range(1, len(emit)):
        n = len(emit[t])
        i, l = (x[:n] for x in fore[-1])
        fore.append((np.logaddexp(i, l) + emit[t][:, 0], np.logaddexp(i, l + both[t]) + emit[t][:, 1]))
    back = [(np.zeros(len(emit[-1])), np.zeros(len(emit[-1])))]
    for t in range(len(emit) - 2, -1, -1):
        n = len(emit[t + 1])
        i, l = back[0][0] + emit[t + 1][:, 0], back[0][1] + emit[t + 1][:, 1]
        bi, bl = np.zeros(len(emit[t])), np.zeros(len(emit[t]))
        bi[:n], bl[:n] = np.logaddexp(i, l), np.logaddexp(i, l + both[t + 1])
        back.insert(0, (bi, bl))
    whole = np.logaddexp(fore[0][0] + back[0][0], fore[0][1] + back[0][1])
    one = [np.exp(np.minimum(f[1] + b[1] - whole[: len(f[1])], 0)) for f, b in zip(fore, back)]
    two = [np.zeros(0)]
    for t in range(1, len(emit)):
        n = len(emit[t])
        two.append(np.exp(np.minimum(fore[t - 1][1][:n] + both[t] + emit[t][:, 1] + back[t][1] - whole[:n], 0)))
    return one, two


def train(texts: Iterable[str], *, lexicon: Lexicon | None = None, strength: float = 1.0, weight: float = 2000.0, rounds: int = 120) -> Model:
    """The model that is likeliest a posteriori; no texts leave the prior mean.

    Chains are fitted by gradients of forward-backward: expected counts given the labels that the layout gives, less
    the expected counts without them. `strength` is the precision of the prior around its mean, `weight` what all
    chains together count at most. The lexicon is learnt from the same texts unless one is given.
    """
    texts = [t for t in texts if t]
    lex = learn_lexicon(texts) if lexicon is None else lexicon
    chains = sorted(_chains(texts, lex), key=len, reverse=True)
    if not chains:
        return Model(lexicon=lex)
    prior = np.array([*FEATURES.values(), *TRANSITIONS.values()])
    d, length = len(FEATURES), len(chains[0])
    places = [[c[t] for c in chains if len(c) > t] for t in range(length)]
    x, step, free = [], [], []
    for p in places:
        m = np.zeros((len(p), d))
        for i, (f, _, _) in enumerate(p):
            m[i, f] = 1
        x.append(m)
        step.append(np.array([s for _, s, _ in p]))
        label = np.array([y for _, _, y in p])
        free.append(np.stack([np.where(label == 1, -1e9, 0.0), np.where(label == 0, -1e9, 0.0)], 1))
    scale = min(1.0, weight / sum(map(len, chains)))

    def slope(w: np.ndarray) -> np.ndarray:
        emit = [np.stack([np.zeros(len(m)), m @ w[:d]], 1) for m in x]
        both = [w[d:][s] for s in step]
        told, all_ = _flow([e + f for e, f in zip(emit, free)], both), _flow(emit, both)
        g = np.zeros(len(w))
        for t, m in enumerate(x):
            g[:d] += (told[0][t] - all_[0][t]) @ m
            if t:
                np.add.at(g[d:], step[t], told[1][t] - all_[1][t])
        return scale * g - strength * (w - prior)

    w, mean, square = prior.copy(), np.zeros(len(prior)), np.zeros(len(prior))
    for r in range(1, rounds + 1):  # Adam, whose steps shrink towards the end
        g = slope(w)
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        w = w + 0.2 * (1 - r / (rounds + 1)) * (mean / (1 - 0.9**r)) / (np.sqrt(square / (1 - 0.99**r)) + 1e-6)
    return Model(w[:d], w[d:], lex)


#: The scripts that a training sample is drawn from in equal parts, by a letter that names each.
_SCRIPTS = {"thai": "[฀-๿]", "lao": "[຀-໿]", "burmese": "[က-႟]", "khmer": "[ក-៿]", "devanagari": "[ऀ-ॿ]", "arabic": "[؀-ۿ]", "cyrillic": "[Ѐ-ӿ]", "kana": "[぀-ヿ]", "han": "[一-鿿]", "german": "(?i)\\b(der|und|nicht)\\b", "spanish": "(?i)\\b(el|los|una)\\b"}


def fit(texts: DataFrame, *, sample: int = 500, sample_chars: int = 4000) -> Model:
    """The model of a table of texts (_text, and _key that tells rows apart): its lexicon from all texts, its weights from
    at most 2 x `sample` stretches of at most `sample_chars` characters, drawn by hash from all files, each script alike."""
    lex = corpus_lexicon(texts.select("_text"))
    named = F.lit("other")
    for name, letter in reversed(_SCRIPTS.items()):
        named = F.when(F.col("_text").rlike(letter), name).otherwise(named)
    drawn = texts.select("_text", F.pmod(F.xxhash64("_key", "_text"), F.lit(1 << 30)).alias("_h"), named.alias("_s"))
    there = {r[0]: r[1] for r in drawn.groupBy("_s").count().collect()}  # one row for each script
    chance = F.lit(0)
    for name, n in there.items():
        chance = F.when(F.col("_s") == name, int((1 << 30) * min(1.0, sample / len(there) / n))).otherwise(chance)
    start = F.pmod(F.col("_h"), F.greatest(F.length("_text") - sample_chars, F.lit(0)) + 1).cast("int")
    part = F.substring("_text", start + 1, F.lit(sample_chars))
    return train([r[0] for r in drawn.where(F.col("_h") < chance).select(part).limit(2 * sample).collect()], lexicon=lex)


_MODELS: dict = {}


def _model(key: str, shared) -> Model:
    """The worker's model of one call, unpacked once."""
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = shared.value
    return _MODELS[key]


def split_sentences(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", sample: int = 500, model: Model | None = None) -> DataFrame:
    """(doc_id, start_pos, end_pos) of every sentence of every non-null text, positions in code points, end exclusive.

    Unless a model is given, one is fitted: its lexicon on all texts, its weights on a sample of about `sample` of them.
    A line break ends a sentence, blanks around it belong to none, every other character belongs to exactly one. Null,
    empty and blank texts give no row; a repeated row gives its sentences once for each time. Extra columns are ignored.
    """
    docs = documents.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    spark = docs.sparkSession
    # texts that pass a filter can sit in a few splits: they are dealt out before the work
    parts = max(docs.rdd.getNumPartitions(), 2 * spark.sparkContext.defaultParallelism)
    docs = stored(docs.repartition(parts), "texts")
    if model is None:
        model = fit(docs.select("_text", F.col("doc_id").alias("_key")), sample=sample)
    shared, key = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = _model(key, shared)
        for batch in batches:
            owner, starts, ends = [], [], []
            for i, t in enumerate(batch.column(1)):
                spans = tagger.spans(t.as_py())
                owner += [i] * len(spans)
                starts += [s for s, _ in spans]
                ends += [e for _, e in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["doc_id", "start_pos", "end_pos"])

    return docs.mapInArrow(split, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start_pos bigint, end_pos bigint")
