"""Sentence boundaries across languages and scripts by a linear-chain model.

Every character of a text is tagged as the last one of a sentence or not.  Only
characters that close a mark, characters before white space in a script that is written
without marks, and any Chinese or Japanese character of a long stretch that has no mark
at all can be last ones; all others are inside with certainty, so the chain runs over
the candidates.  Blank lines, list items and the end of the text are boundaries with
certainty: they end sentences whatever is around them, so nothing is left to decide.
The weights are those of an averaged structured perceptron over boundary features and
the transition between neighbouring tags; decoding is Viterbi's.  The model is trained
here, from the marked passages of ``sentence_lessons``; those in scripts that do without
punctuation are learned with their punctuation stripped too.  Time and memory are linear
in the length of a text.
"""

from __future__ import annotations

import random
import re
import unicodedata
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame

from lumaframe.functions.arrow import flat_map_rows
from lumaframe.llm.sentence_lessons import ALWAYS_ON, LESSONS, MAY_END, MONTHS, ORDINAL_LEADS

MARKS = ".!?…。．！？｡।॥؟۔‼⁇⁈⁉᙮។။\u037e"
OPENERS = {"(": ")", "[": "]", "{": "}", "（": "）", "【": "】", "《": "》", "〈": "〉", "「": "」", "『": "』", "“": "”", "«": "»", "„": "“", "‚": "‘", "‘": "’", "‹": "›"}
CLOSERS = set(OPENERS.values()) | {"”", "»", "’"}
UNMARKED = "฀-๿຀-໿ក-៿က-႟"  # Thai, Lao, Khmer, Burmese
_ITEM = r"(?:[-*•‣◦–—]|\(?\d{1,3}[.)]|[A-Za-z][)]|#{1,6})[^\S\n]+"
_BREAK = re.compile(rf"\n[^\S\n]*\n\s*|\n(?=[^\S\n]*{_ITEM}\S)")
_NUMBERED = re.compile(r"[^\S\n]*\(?(\d{1,3})[.)][^\S\n]")
_HEADING = re.compile(r"(?m)^[^\S\n]*#{1,6}[^\S\n]+[^\n]*")
_MARKER = re.compile(rf"\s*{_ITEM}")
_CANDIDATE = re.compile(rf"[{re.escape(MARKS)}]+|(?<=[{UNMARKED}])\s+(?=\S)|(?<=\S)\s+(?=[{UNMARKED}])")
_UNMARKED = re.compile(rf"[{UNMARKED}]")
_HAN = "\u3041-\u30ff\u31f0-\u31ff\u3400-\u9fff\uf900-\ufaff"
_HAN_PAIR = re.compile(rf"(?<=[{_HAN}])(?=[{_HAN}])")
_HAN_CHAR = re.compile(rf"[{_HAN}]")
_OWN_MARK = re.compile(rf"[{re.escape(MARKS.replace('.', ''))}]")
HAN_STRETCH = 40  # Chinese or Japanese characters without any mark that are no heading or label any more
_PAIRED = re.compile("[" + re.escape("".join(OPENERS) + "".join(CLOSERS)) + '"]')
_SEPARATORS = frozenset("()[]{}（）「」『』“”„«»\"，、；：,;:！？。!?")
_CODE = re.compile(r"[a-z]{1,2}[\d/]")
_NEXT = re.compile(r"[^\W_]+")
_ALWAYS, _MAY, _LEADS, _MONTHS = set(ALWAYS_ON), set(MAY_END), set(ORDINAL_LEADS), set(MONTHS)


def blocks(text: str) -> list[tuple[int, int]]:
    """(start, end) of the stretches that blank lines, list items and headings cut, trimmed."""
    cuts = {0, len(text)}
    first = _NUMBERED.match(text)
    last = int(first.group(1)) if first else 0
    for m in _BREAK.finditer(text):
        number = _NUMBERED.match(text, m.end())
        if number:
            n = int(number.group(1))
            if m.group().count("\n") == 1 and n not in (1, last + 1):
                continue  # a wrapped line that happens to start with a number
            last = n
        cuts.update(m.span())
    for m in _HEADING.finditer(text):
        cuts.add(m.end())
    out, edges = [], sorted(cuts)
    for a, b in zip(edges, edges[1:]):
        part = text[a:b]
        left, right = len(part) - len(part.lstrip()), len(part.rstrip())
        if right > left:
            out.append((a + left, a + right))
    return out


class Spans:
    """Quotations and brackets of a block: opener by closer, and how deep a character lies.

    Only pairs that close within the block count.
    """

    def __init__(self, block: str):
        stack: list[tuple[str, int]] = []  # (awaited closer, place of the opener)
        awaited: dict[str, int] = defaultdict(int)
        self.pairs: dict[int, int] = {}
        for m in _PAIRED.finditer(block):
            ch, i = m.group(), m.start()
            if awaited and awaited[ch]:
                while True:  # what opened later and is still open never closes
                    closer, at = stack.pop()
                    awaited[closer] -= 1
                    if closer == ch:
                        self.pairs[i] = at
                        break
                continue
            closer = OPENERS.get(ch) or ('"' if ch == '"' else "«" if ch == "»" else None)
            if closer:
                stack.append((closer, i))
                awaited[closer] += 1
        self.opened, self.closed = sorted(self.pairs.values()), list(self.pairs)

    def depth(self, i: int) -> int:
        return bisect_right(self.opened, i) - bisect_right(self.closed, i)


def candidates(block: str, pairs: dict[int, int]) -> list[tuple[int, int, int, int | None]]:
    """(mark start, mark end, sentence end, opener of the last closing mark) in order."""
    out = []
    last = 0
    for m in _CANDIDATE.finditer(block):
        s, e = m.span()
        if s < last:
            continue
        if block[s].isspace():
            if s > 0 and (block[s - 1] in MARKS or block[s - 1] in CLOSERS or block[s - 1] == '"'):
                continue
            out.append((s, s, s, None))
            continue
        end, opener = e, None
        while end < len(block):
            at = end
            if block[at] in "   " and at + 1 < len(block) and block[at + 1] in "»›":
                at += 1
            if at not in pairs:
                break
            opener, end = pairs[at], at + 1
        while end < len(block) and block[end] in MARKS:
            end += 1
        last = end
        if end < len(block):
            out.append((s, e, end, opener))
    if len(block) > HAN_STRETCH and not _OWN_MARK.search(block) and len(_HAN_CHAR.findall(block)) > HAN_STRETCH:
        out += [(m.start(), m.start(), m.start(), None) for m in _HAN_PAIR.finditer(block)]
        out.sort()
    return out


@lru_cache(maxsize=20_000)
def _kind(ch: str) -> str:
    """Coarse class of a character: case, digit or script."""
    if not ch:
        return "end"
    code = ord(ch)
    if ch.isdigit():
        return "digit"
    if code < 0x250 or 0x370 <= code < 0x530 or 0x1E00 <= code < 0x2000:
        return "upper" if ch.isupper() else "lower" if ch.islower() else "space" if ch.isspace() else "other"
    if 0x0600 <= code < 0x0780:
        return "arabic"
    if 0x0900 <= code < 0x0E00:
        return "indic"
    if _UNMARKED.match(ch):
        return "thai" if code < 0x0E80 else "lao" if code < 0x0F00 else "burmese" if code < 0x10A0 else "khmer"
    if 0x2E80 <= code < 0xA000 or 0xF900 <= code < 0xFB00 or 0x20000 <= code < 0x32000:
        return "han" if code >= 0x3400 else "kana" if 0x3040 <= code < 0x3100 else "other"
    if 0xAC00 <= code < 0xD7B0:
        return "hangul"
    return "emoji" if unicodedata.category(ch) == "So" else "letter" if ch.isalpha() else "other"


_CASED = ("upper", "lower", "digit")
_VOWEL = re.compile("[aeiouyäöüáéíóúàèùâêîôûαεηιουωάέήίόύώаеёиоуыэюя]")


@lru_cache(maxsize=50_000)
def _abbreviation(token: str) -> tuple[bool, bool]:
    """(always goes on, may end a sentence) of a token before its dot."""
    bare = token.rsplit("/", 1)[-1].lstrip("-–—")
    if bare not in _ALWAYS and bare not in _MAY:
        bare = bare.rsplit(".", 1)[-1]
    return bare in _ALWAYS, bare in _MAY


def attributes(block: str, start: int, spans: Spans, cand: tuple[int, int, int, int | None], starters: frozenset[str], marked: bool) -> tuple:
    """What the tag of one candidate depends on, as a tuple of few different values."""
    s, e, end, opener = cand
    size = len(block)
    after = end
    while after < size and block[after].isspace():
        after += 1
    gap = "none" if after == end else "line" if "\n" in block[end:after] else "space"
    lead = after
    while lead < size and (block[lead] in OPENERS or block[lead] in "\"'¿¡‘" or _kind(block[lead]) == "emoji" or (lead > after and block[lead].isspace())):
        lead += 1
    nxt = _kind(block[lead : lead + 1])
    if s == e and not block[s].isspace():
        return ("han", block[s - 1], block[max(0, s - 2) : s], block[s], block[s : s + 2])
    if s < e:
        mark = block[s:e]
        kind = "dot" if mark == "." else "dots" if set(mark) <= {"."} else "ellipsis" if "…" in mark else "wide" if ord(mark[0]) > 0x2E7F else "danda" if mark[0] in "।॥" else "bang"
        inside = spans.depth(end - 1) > 0 if opener is None else spans.depth(end) > 0 and block[end] not in OPENERS and block[end] != '"'
        if inside:
            return ("inside", kind)
    if nxt == "lower" and _CODE.match(block, lead, lead + 3):
        nxt = "code"  # v2.1, f/8
    if s < e and opener is not None:
        at = opener
        while at > 0 and block[at - 1].isspace():
            at -= 1
        lead_in = block[at - 1 : at]
        first = not lead_in or lead_in in MARKS or opener == start or "\n" in block[opener - 1 : opener]
        return ("closed", block[opener] in "([{（【", lead_in in (":", "："), nxt, first, _kind(lead_in), block[lead : lead + 1] if nxt not in _CASED else "")
    if s < e and kind != "dot":
        return ("mark", kind, gap, nxt, lead > after)
    word = _NEXT.match(block, lead, lead + 40)
    next_word = word.group() if word else ""
    whole = block[max(0, s - 40) : s]
    before = whole.rstrip("   ")
    at = len(before)
    while at > 0 and before[at - 1] not in _SEPARATORS and not before[at - 1].isspace():
        at -= 1
    token = before[at:].lstrip("'’(")
    prev = _kind(before[-1:])
    if s == e:
        follows = _TOKEN.match(block, after, after + 40).group().strip("()\"“”").lower()
        abbreviated = token.rstrip(".").lower() in _ALWAYS or (follows.endswith(".") and follows.rstrip(".") in _ALWAYS)
        left = _kind(block[s - 1 : s])
        inside = end > 0 and spans.depth(end - 1) > 0
        ends = ("", "") if left in ("thai", "lao") or (marked and left != "burmese") else (block[max(0, s - 3) : s], block[after : after + 2])
        return ("gap", left, nxt, inside, prev, abbreviated, marked, *ends)
    short = token.lower()
    there = at < len(before)
    head = before[:at].rstrip().rsplit(maxsplit=1)[-1:]
    pair = (head[-1].lower().strip("(„\"") + short) if head and head[-1].endswith(".") else ""
    always, may = _abbreviation(short)
    always, may = always or pair in _ALWAYS, may or pair in _MAY
    single = len(token) == 1 and token.isalpha()
    shape = "num" if token.isdigit() else "dec" if _DECIMAL.fullmatch(token) else ("singleU" if token.isupper() else "singlel") if single else "word"
    terse = shape == "word" and len(token) < 5 and token.isalpha() and not _VOWEL.search(short)
    lone = always and there and (len(before) == len(token) or before[: len(before) - len(token)].rstrip()[-1:] in (*MARKS, "|"))
    ordinal = shape == "num" and bool(head) and head[-1].lower() in _LEADS
    after_word = block[lead + len(next_word) : lead + len(next_word) + 1]
    next_short = after_word == "." and any(_abbreviation(next_word.lower()))
    return (
        "dot", gap, nxt, lead > after, prev, always, may, shape, before != whole, terse,
        lone and short in ("no", "max", "min", "art"), lone,
        there and max(0, s - 40) + at <= start and shape == "num",
        ordinal, shape == "num" and len(token) > 2, next_word.lower() in _MONTHS,
        next_word.isupper() and 1 < len(next_word) < 6, next_word.lower() in starters, next_short, (short.rsplit(".", 1)[-1] if short not in _MAY else short) if may else "",
    )


_TOKEN = re.compile(r"\S+")
_DECIMAL = re.compile(r"[\d.,/:_v]+")


def features(a: tuple) -> list[str]:
    """The features that a candidate's attributes switch on."""
    if a[0] == "han":
        _, last, last2, first, first2 = a
        return ["han", f"han:l={last}", f"han:ll={last2}", f"han:n={first}", f"han:nn={first2}", f"han:{last}{first}"]
    if a[0] == "gap":
        _, left, nxt, inside, prev, abbreviated, marked, tail, head = a
        return [
            "gap", f"gap:{left}:{nxt}", f"gap:in={inside}", f"gap:{left}:marked={marked}", f"gap:digit={prev == 'digit' or nxt == 'digit'}",
            f"gap:latin={prev in ('upper', 'lower') or nxt in ('upper', 'lower', 'code')}", f"gap:abbr={abbreviated}", f"gap:tail={tail}", f"gap:tail={tail[1:]}", f"gap:head={head}",
        ]
    if a[0] == "inside":
        return ["mark", "in=True", f"in=True:m={a[1]}"]
    if a[0] == "closed":
        _, bracket, colon, nxt, first, lead_in, ch = a
        cased = nxt in _CASED
        return ["mark", "closed", f"closed:b={bracket}", f"closed:colon={colon}:b={bracket}", f"closed:colon={colon}:cased={cased}", f"closed:n={nxt}", f"closed:colon={colon}:n={nxt}:first={first}",
                f"closed:before={'colon' if colon else lead_in}:n={nxt}", f"closed:first={first}:cased={cased}", f"closed:w={ch}:colon={colon}"]
    kind, gap, nxt, opens = ("dot", *a[1:4]) if a[0] == "dot" else a[1:5]
    f = ["mark", f"m={kind}", f"m={kind}:n={nxt}"]
    if kind in ("dots", "ellipsis"):
        return [*f, f"m={kind}:lower={nxt == 'lower'}", f"m={kind}:gap={gap}"]
    f += [f"m={kind}:gap={gap}", f"m={kind}:gap={gap}:n={nxt}:o={opens}"]
    if kind != "dot":
        return f
    _, gap, nxt, opens, prev, always, may, shape, spaced, terse, counted, lone, item, ordinal, big, month, caps, starter, next_short, ending = a
    f += [f"dot:always={always}:n={nxt}", f"dot:may={may}:n={nxt}", f"dot:may={may}:starter={starter}", f"dot:shape={shape}:n={nxt}:gap={gap}", f"dot:p={prev}:n={nxt}:gap={gap}", f"dot:always={always}",
          f"dot:glued={gap == 'none'}:n={nxt}", f"dot:spaced={spaced}", f"dot:terse={terse}:n={nxt}", f"dot:shape={shape}:starter={starter}", f"dot:next_short={next_short}", f"dot:ending={ending}:n={nxt}"]
    if always:
        f.append(f"dot:lone={lone}:digit={nxt == 'digit'}:word={counted or not lone}")
    if item:
        f.append("dot:item")
    if shape == "num":
        f += [f"dot:ordinal={ordinal}:big={big}:n={nxt}", f"dot:ordinal={ordinal}:month={month}:n={nxt}"]
    if gap == "none" and nxt == "upper":
        f.append(f"dot:glued:caps={caps}:p={prev}")
    return f


class SentenceModel:
    """Weights of the chain: boundary features and tag transitions; and words that begin sentences."""

    def __init__(self, weights: dict[str, float], moves: dict[tuple[int, int], float], starters: frozenset[str] = frozenset()):
        self.weights, self.moves, self.starters = weights, moves, starters
        self.known: dict[tuple, float] = {}

    def decode(self, rows: list[tuple]) -> list[int]:
        """The best tag sequence (1 = a sentence ends here) of the candidates' attributes."""
        w, known = self.weights, self.known
        scores = []
        for row in rows:
            own = known.get(row)
            if own is None:
                if len(known) > 200_000:
                    known.clear()
                own = known[row] = sum(w.get(f, 0.0) for f in features(row))
            scores.append(own)
        return self.viterbi(scores)

    def viterbi(self, scores: list[float]) -> list[int]:
        """The best tag sequence for the candidates' scores, by Viterbi's algorithm."""
        if not scores:
            return []
        m = self.moves
        m00, m10, m01, m11 = m[0, 0], m[1, 0], m[0, 1], m[1, 1]
        low, high, back = 0.0, scores[0], []
        for own in scores[1:]:
            a0, a1, b0, b1 = low + m00, high + m10, low + m01, high + m11
            back.append((a1 > a0, b1 > b0))
            low, high = (a1 if a1 > a0 else a0), (b1 if b1 > b0 else b0) + own
        tag = int(high > low)
        tags = [tag]
        for step in reversed(back):
            tag = int(step[tag])
            tags.append(tag)
        return tags[::-1]

    def ends(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of every sentence, in code points of ``text``."""
        out = []
        for a, b in blocks(text):
            block = text[a:b]
            marker = _MARKER.match(block)
            start = marker.end() if marker else 0
            spans = Spans(block)
            cands = [c for c in candidates(block, spans.pairs) if c[2] > start]
            marked = bool(_OWN_MARK.search(block))
            tags = self.decode([attributes(block, start, spans, c, self.starters, marked) for c in cands])
            begin = 0
            for c, tag in zip(cands, tags, strict=True):
                if tag:
                    out.append((a + begin, a + c[2]))
                    begin = c[2]
                    while begin < len(block) and block[begin].isspace():
                        begin += 1
            if begin < len(block):
                out.append((a + begin, b))
        return out


def _number(rng: random.Random) -> str:
    return rng.choice([str(rng.randint(1, 30)), str(rng.choice([50, 100, 320, 1600])), f"{rng.randint(0, 9)}.{rng.randint(0, 99)}", f"1/{rng.randint(10, 500)}", f"{rng.randint(0, 9)},{rng.randint(1, 9)}"])


Passage = tuple[str, str, str]  # language, subject, line


def _passages() -> list[Passage]:
    return [(lang, subject, line) for lang, subjects in LESSONS.items() for subject, lines in subjects.items() for line in lines.strip().splitlines()]


def _starters(passages: list[Passage]) -> frozenset[str]:
    """Words that begin sentences of the passages and stand in few other places."""
    begin: dict[str, int] = defaultdict(int)
    for _, _, line in passages:
        for part in line.split("|"):
            word = _NEXT.search(part)
            if word and _kind(word.group()[0]) == "upper":
                begin[word.group().lower()] += 1
    return frozenset(w for w, n in begin.items() if n > 1)


_STRIPPED = {"th": 0.3, "lo": 0.5, "km": 0.4, "my": 0.4, "zh": 0.15, "ja": 0.15}  # share of blocks without their marks
_RARE = dict.fromkeys(("ko", "ru", "el", "lo", "km", "my"), 0.4)  # share of blocks of languages with few lines, beside 1 of the others
_SPACELESS = ("zh", "ja")
_PUNCTUATION = re.compile(rf"[{re.escape(MARKS)},，、；;：:“”「」\"]+")


def _compose(rng: random.Random, passages: list[Passage]) -> tuple[str, set[int]]:
    """A block of a few passages, and where its sentences end."""
    text, ends = "", set()
    langs = sorted({p[0] for p in passages})
    lang = rng.choices(langs, [_RARE.get(x, 1.0) for x in langs])[0]
    own = [p for p in passages if p[0] == lang]
    stripped = rng.random() < _STRIPPED.get(lang, 0.0)
    pure = stripped or lang in ("km", "my")  # white space means another thing there
    for _ in range(rng.randint(4, 8) if stripped and lang in _SPACELESS else rng.randint(1, 5)):
        kind, _, line = rng.choice(own if pure or rng.random() < 0.75 else [p for p in passages if p[0] not in ("km", "my")])
        line = re.sub("[#@]", lambda m: _number(rng) if m.group() == "#" else str(rng.randint(1, 31)), line)
        for i, part in enumerate(line.split("|")):
            if stripped:
                part = " " * part.startswith(" ") + re.sub(r"\s+", " ", _PUNCTUATION.sub("" if kind in _SPACELESS else " ", part)).strip()
            if not part.strip():
                continue
            join = "" if not text else part[: len(part) - len(part.lstrip())] if i else rng.choice(["", " "]) if kind in _SPACELESS and not stripped else "" if kind in _SPACELESS else " "
            if text and kind not in (*_SPACELESS, "th") and not part[:1].strip() == "" and not join:
                join = " "
            if join == " ":
                r = rng.random()
                spaced = kind not in ("th", "lo", "km", "my")
                join = "  " if r < 0.04 else "\n" if r < 0.09 and spaced else "" if r < 0.15 and spaced and text[-1] in MARKS and not part.strip()[0].islower() and not part.strip()[0].isdigit() else " " if r < 0.17 and spaced else " "
            if kind != "th":  # lines may be wrapped anywhere
                part = re.sub(" ", lambda _: "\n" if rng.random() < 0.06 else " ", part.strip())
            text += join + part.strip()
            ends.add(len(text))
    return text, ends


def _labelled(rng: random.Random, passages: list[Passage], count: int, starters: frozenset[str]) -> list[tuple[list[tuple], list[int]]]:
    out = []
    for _ in range(count):
        text, ends = _compose(rng, passages)
        spans = Spans(text)
        cands = candidates(text, spans.pairs)
        marked = bool(_OWN_MARK.search(text))
        out.append(([attributes(text, 0, spans, c, starters, marked) for c in cands], [int(c[2] in ends) for c in cands]))
    return out


def train(sequences: int = 7_000, rounds: int = 6, seed: int = 3, passages: list[Passage] | None = None) -> SentenceModel:
    """An averaged structured perceptron over ``sequences`` composed blocks."""
    rng = random.Random(seed)
    passages = passages or _passages()
    starters = _starters(passages)
    data = _labelled(rng, passages, sequences, starters)
    names = {row: features(row) for rows, _ in data for row in rows}
    w: dict[str, float] = defaultdict(float)
    total: dict[str, float] = defaultdict(float)
    moves = {(a, b): 0.0 for a in (0, 1) for b in (0, 1)}
    move_total = dict.fromkeys(moves, 0.0)
    model = SentenceModel(w, moves, starters)
    step = 1
    for _ in range(rounds):
        rng.shuffle(data)
        for rows, gold in data:
            guess = model.viterbi([sum(w[f] for f in names[row]) for row in rows])
            if guess != gold:
                for i, (row, g, t) in enumerate(zip(rows, guess, gold, strict=True)):
                    if g != t:
                        for f in names[row]:
                            w[f] += t - g
                            total[f] += step * (t - g)
                    if i:
                        for tags, sign in ((gold, 1.0), (guess, -1.0)):
                            moves[tags[i - 1], tags[i]] += sign * 0.02
                            move_total[tags[i - 1], tags[i]] += sign * 0.02 * step
            step += 1
    return SentenceModel({f: v - total[f] / step for f, v in w.items() if v - total[f] / step}, {k: v - move_total[k] / step for k, v in moves.items()}, starters)


@lru_cache(maxsize=1)
def default_model() -> SentenceModel:
    return train()


def _make_split(model: SentenceModel | None, with_text: bool) -> Callable[[], Callable[..., list[tuple]]]:
    model = model or default_model()
    weights, moves, starters = dict(model.weights), dict(model.moves), model.starters

    def make() -> Callable[..., list[tuple]]:
        own = SentenceModel(weights, moves, starters)

        def split(doc_id: int | None, text: str | None) -> list[tuple]:
            ends = own.ends(text) if text else []
            return [(doc_id, n, a, b, *([text[a:b]] if with_text else [])) for n, (a, b) in enumerate(ends, 1)]

        return split

    return make


_ROWS = "doc_id bigint, sentence_no int, start_pos int, end_pos int"


def sentence_rows(docs: DataFrame, model: SentenceModel | None = None) -> DataFrame:
    """(doc_id, sentence_no, start_pos, end_pos) of every sentence of ``docs``.

    Positions count Unicode code points; ``end_pos`` includes closing marks.  Null,
    empty and blank texts have no sentences; whole texts are read, however long;
    repeated rows give repeated sentences; a null doc_id stays null.  Columns beside
    doc_id and text are ignored.
    """
    return flat_map_rows(docs, ["doc_id", "text"], _make_split(model, False), _ROWS)


def sentences(docs: DataFrame, model: SentenceModel | None = None) -> DataFrame:
    """``sentence_rows`` with each sentence's own text."""
    return flat_map_rows(docs, ["doc_id", "text"], _make_split(model, True), _ROWS + ", sentence string")
