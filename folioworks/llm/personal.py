"""Personal information inside free text (problem 5): a skip-chain conditional random field."""

from __future__ import annotations

import gc
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELS = ("O", "email", "phone", "id_number", "address", "name")
O, EMAIL, PHONE, ID, ADDRESS, NAME = range(6)
#: Rows per table from which the context weights are fitted; the texts of a sample have at most SAMPLE_CHARS.
SAMPLE_ROWS, SAMPLE_CHARS = 6000, 20_000
#: Rounds of message passing; entities and their links span few tokens, so messages settle earlier.
ROUNDS = 8
#: Log-potential of two linked distant tokens that carry one label.
SKIP = 1.5

# Word lists of the features, lower case.
TITLES = "dr mr mrs ms miss mx prof professor sgt sergeant capt captain lt lieutenant col colonel maj major sir dame rev hon insp"
STREETS = "street st avenue ave boulevard blvd road rd lane ln drive dr court ct way terrace place pl square sq close crescent row walk alley parade"
PREPOSED_STREETS = "rue via calle rua avenue boulevard place chemin"
UNITS = "apt apartment unit suite ste flat floor room"
ID_CUES = "employee passport national security ssn licence license tax personnel staff identity insurance taxpayer"
ID_PREFIXES = "emp uid ssn nin pid"
DIGIT_WORDS = "zero oh one two three four five six seven eight nine double triple"
ABBREVIATIONS = "ave blvd st rd ln ct dr apt ste ext no pl sq"

_T, _S, _P, _U, _C = (frozenset(x.split()) for x in (TITLES, STREETS, PREPOSED_STREETS, UNITS, ID_CUES))
_DIGITS = DIGIT_WORDS.replace(" ", "|")
_AT = r"(?:[ \xa0]?@[ \xa0]?|[ \xa0]?\[(?:at|@)\][ \xa0]?|[ \xa0]?\((?:at|@)\)[ \xa0]?)"
_DOT = r"(?:\.|[ \xa0]?\[(?:dot|\.)\][ \xa0]?|[ \xa0]?\((?:dot|\.)\)[ \xa0]?)"
#: What can only be plain words: small ASCII letters and single spaces, up to a word that an address or number may begin with.
_PLAIN = rf"(?-i:(?!(?:{_DIGITS})\b)(?:[a-z]{{2,}}[ ](?![@\[(]|(?:at|dot|underscore|dash|plus|{_DIGITS})\b))+)"
#: Marks, and words before a space or at a sentence's end, that no longer token begins with.
_FAST = (
    rf"[.,;:!?|*\"'/=<>{{}}\#-]|(?!(?:{_DIGITS})\b)(?-i:[A-Z][a-z]+(?=[ ,;!?|*\n](?![@\[(]|(?:at|dot|underscore|dash|plus)\b)))"
    rf"|(?!(?:{_DIGITS}|{ABBREVIATIONS.replace(' ', '|')}|{TITLES.replace(' ', '|')})\b)(?-i:[A-Za-z][a-z]+(?=[.:]{{1,3}}(?:\n|$|[ ](?![@\[(]|(?:at|dot|underscore|dash|plus)\b))))"
)
_TOKEN = re.compile(
    rf"""(?P<plain>{_PLAIN})|(?P<fast>{_FAST})|(?P<uri>[A-Za-z][A-Za-z+]{{1,9}}://\S+)
    |(?P<email>\w[\w.+-]*{_AT}\w[\w-]*(?:{_DOT}\w[\w-]*)*{_DOT}[^\W\d_]{{2,}}(?![\w@])
      |\w+(?:[ ](?:dot|underscore|dash|plus)[ ]\w+)*[ ]at[ ]\w+(?:[ ]dot[ ]\w+)*[ ]dot[ ][^\W\d_]{{2,}}(?!\w))
    |(?P<package>[\w.+-]+@[\d.]*\d)
    |(?P<cite>\[\^[^\]\s]*\])
    |(?P<spoken>(?:{_DIGITS})(?:[ -]+(?:{_DIGITS})){{6,}}(?!\w))
    |(?P<code>(?:CVE-\d+-\d+|\d{{4}}-\d\d-\d\d(?!\d)|\d{{1,3}}(?:\.\d{{1,3}}){{3}}(?![\d-])|\d{{1,3}}(?:,\d{{3}})+(?!\d)))
    |(?P<tag>[A-Za-z]{{2,4}}[-_]?\d{{4,}}(?!\w)|[A-Z]\d{{6,9}}(?!\w))
    |(?P<house>\d{{1,5}}[A-Za-z]?(?![\w/])(?!\)?[ \xa0]?[-‑./ ]?\(?\d))
    |(?P<number>(?:\+[ \xa0]?)?\(?\d+(?:\)?[ \xa0]?[-‑–./]?\(?\d+)+(?!\w))
    |(?P<initial>[^\W\d_]\.(?=[\s\w]|$))
    |(?P<abbreviation>(?:{"|".join(ABBREVIATIONS.split())}|{"|".join(TITLES.split())})\.)
    |(?P<word>[^\W_](?:[\w'’-]*\w)?)
    |(?P<mark>[^\s\w]|_)""",
    re.VERBOSE | re.IGNORECASE,
)
_SHARP = frozenset(("email", "spoken", "tag", "house", "number", "initial", "abbreviation"))


@dataclass
class Tokens:
    """The tokens of one text: places, kinds, texts and lower-case texts."""

    start: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    kind: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    low: list[str] = field(default_factory=list)


def tokenize(text: str) -> Tokens:
    t = Tokens()
    start, end, kinds, texts, lows = t.start, t.end, t.kind, t.text, t.low
    for m in _TOKEN.finditer(text):
        kind, s = m.lastgroup, m[0]
        a = m.start()
        if kind == "plain":
            words = s.split()
            texts += words
            lows += words
            kinds += ["word"] * len(words)
            for w in words:
                start.append(a)
                a += len(w)
                end.append(a)
                a += 1
            continue
        if kind == "fast":
            kind = "word" if len(s) > 1 else "mark"
        low = s.lower()
        if kind == "word" and low.endswith(("'s", "’s")):
            low = low[:-2]
        start.append(a)
        end.append(a + len(s))
        kinds.append(kind)
        texts.append(s)
        lows.append(low)
    return t


def _is_cap(s: str) -> bool:
    return s[0].isupper()


@dataclass
class Model:
    """The fitted potentials: bounded dictionaries that are sent to the workers.

    ``given``/``family`` are the known names; ``lower`` the words that are mostly written small;
    ``left``/``right`` score the words before and after a run of capitalised words, ``words`` the words
    of such runs, ``phone_left``/``phone_right`` the words around phone-like numbers. All scores are
    log-odds between -4 and 4.
    """

    given: frozenset
    family: frozenset
    lower: frozenset = frozenset()
    left: dict = field(default_factory=dict)
    right: dict = field(default_factory=dict)
    words: dict = field(default_factory=dict)
    phone_left: dict = field(default_factory=dict)
    phone_right: dict = field(default_factory=dict)
    known: frozenset | None = None
    chain_table: np.ndarray = field(default_factory=lambda: _CHAIN)
    link_table: np.ndarray = field(default_factory=lambda: _LINK)


#: A context counts as one of mentions when at least this share of what stands in it is certain; the rest of
#: its mentions are of persons not known beforehand.
CERTAIN_SHARE = 0.25


def _odds(pos: float, neg: float, share: float = 0.5) -> float:
    """Log-odds of two counts, 0 where the positive share is ``share``, between -4 and 4."""
    return max(-4.0, min(4.0, math.log((pos + 0.5) / (neg + 0.5)) - math.log(share / (1 - share))))


def _letters(w: str) -> str:
    return "".join(c for c in w if c.isalpha())


def _title(t: Tokens, i: int) -> bool:
    return i >= 0 and t.kind[i] in ("word", "abbreviation") and t.low[i].rstrip(".") in _T and _is_cap(t.text[i])


def _namelike(t: Tokens, i: int, m: Model) -> bool:
    return t.kind[i] == "word" and _is_cap(t.text[i]) and t.low[i] not in m.lower and len(t.low[i]) > 1 and not _title(t, i)


def _runs(t: Tokens, m: Model) -> Iterator[tuple[int, int]]:
    """Maximal runs of capitalised words that aren't usually small, with initials between or before them."""
    small = m.lower
    big = [i for i, (k, s) in enumerate(zip(t.kind, t.text, strict=True)) if k == "word" and s[0].isupper() and len(s) > 1]
    names = {i for i in big if t.low[i] not in small and len(t.low[i]) > 1 and t.low[i] not in _T}
    if not names:
        return
    inside = sorted(names | {i - 1 for i in names if i and t.kind[i - 1] == "initial"})
    a = b = inside[0]
    for i in inside:
        if i > b + 1:
            yield a, b + 1
            a = i
        b = i
    yield a, b + 1


def _around(t: Tokens, a: int, b: int) -> tuple[str, str]:
    """The words before and after tokens a..b-1; a few marks before them are skipped, other marks say nothing."""
    left, right = a - 1, b
    while left >= 0 and t.kind[left] == "mark" and t.low[left] in ",:*\"'(":
        left -= 1
    before = "^" if left < 0 else t.low[left] if t.kind[left] != "mark" else ""
    after = "$" if right == len(t.low) else t.low[right] if t.kind[right] != "mark" else ""
    return before, after


def _pair(t: Tokens, i: int, m: Model) -> int:
    """The end of a known full name that begins at token i, or 0: given (initial) family, family (,) given, initial family."""
    n = len(t.low)

    def word(k: int, names: frozenset) -> bool:
        return k < n and t.kind[k] == "word" and t.low[k] in names

    if word(i, m.given):
        k = i + 2 if i + 1 < n and t.kind[i + 1] == "initial" else i + 1
        if word(k, m.family):
            return k + 1
    if word(i, m.family):
        k = i + 2 if i + 1 < n and t.low[i + 1] == "," and t.start[i + 1] == t.end[i] else i + 1
        if word(k, m.given):
            return k + 1
    if t.kind[i] == "initial" and word(i + 1, m.family):
        return i + 2
    return 0


def _phone_shape(s: str) -> float:
    """How much the shape of a number speaks for a phone number, 0 if nothing does."""
    digits = sum(c.isdigit() for c in s)
    if digits < 7 or digits > 15:
        return 0.0
    if s[0] in "+(" and digits >= 9 or s.startswith("00") and digits >= 11:
        return 7.0
    groups = re.findall(r"\d+", s)
    sizes = [len(g) for g in groups]
    if sizes in ([3, 3, 4], [1, 3, 3, 4], [4, 6], [5, 6], [3, 4, 4]) or len(sizes) > 2 and digits >= 10 and sizes[-1] in (3, 4):
        return 6.0
    if sizes == [10] and s[0] not in "01" or sizes == [11] and s[0] in "01":
        return 4.6
    return 3.0 if sizes == [3, 4] else 0.0


def fit(texts: Iterable[str], given: Iterable[str], family: Iterable[str]) -> Model:
    """The model of a sample of texts: scores of contexts and words (``fit_scores``), then edge potentials (``fit_potentials``)."""
    texts = [x for x in texts if x]
    rows = [tokenize(x) for x in texts]
    m = fit_scores(rows, given, family)
    fit_potentials(texts, m, rows)
    return m


def fit_scores(rows: list[Tokens], given: Iterable[str], family: Iterable[str]) -> Model:
    """Fits the context and word scores from texts whose certain mentions are the labels.

    Certain names are known full names and capitalised words after a title; certain phone numbers are
    those whose shape alone decides. Contexts in which certain mentions occur score high, contexts of
    other runs and numbers score low; words then are scored by the contexts they occur in.
    """
    m = Model(frozenset(x.lower() for x in given if x), frozenset(x.lower() for x in family if x))
    small, big = Counter(), Counter()
    for t in rows:
        for i, (k, s, w) in enumerate(zip(t.kind, t.text, t.low, strict=True)):
            if k == "word":
                if not _is_cap(s):
                    small[w] += 1
                elif not s.isupper() or len(s) == 1 or i:
                    big[w] += 1
    names = m.given | m.family
    m.lower = frozenset(w for w, n in small.items() if w not in names and n >= 3 and 2 * n > big[w])
    phone_l, phone_r = ({}, {}), ({}, {})

    def add(table: tuple[dict, dict], key: str, good: bool) -> None:
        if not key:
            return
        d = table[0] if good else table[1]
        d[key] = d.get(key, 0) + 1

    found = []
    for t in rows:
        for a, b in _runs(t, m):
            titled = _title(t, a - 1)
            words = [w for w, k in zip(t.low[a:b], t.kind[a:b], strict=True) if k == "word"]
            found.append((words, *_around(t, a, b), titled, titled or any(_pair(t, i, m) for i in range(a, b))))
        for i, k in enumerate(t.kind):
            if k == "number" or k == "house":
                shape = _phone_shape(t.text[i])
                if shape:
                    l, r = _around(t, i, i + 1)
                    add(phone_l, l, shape >= 6)
                    add(phone_r, r, shape >= 6)
    keep = lambda x: {k: _odds(x[0].get(k, 0), x[1].get(k, 0), CERTAIN_SHARE) for k in {*x[0], *x[1]} if x[0].get(k, 0) + x[1].get(k, 0) >= 3}
    m.phone_left, m.phone_right = keep(phone_l), keep(phone_r)
    # the parts of mail addresses are names of persons too: local parts such as given.family or family_g
    parts = Counter()
    for t in rows:
        for i, k in enumerate(t.kind):
            if k == "email":
                local = re.split(r"[ \xa0]?(?:@|[\[(](?:at|@)[\])])| at ", t.low[i])[0]
                parts.update({p for p in re.split(r"[\d._+\- ]+", local) if len(p) > 2} - {"dot", "plus"})
    # contexts are scored by the mentions in them and words by their contexts, twice: the second time runs of
    # words that were found to be names count as mentions too
    for _ in range(2):
        left, right = ({}, {}), ({}, {})
        for words, l, r, titled, good in found:
            good = good or len(words) > 1 and all(m.words.get(w, 0.0) > 1 for w in words)
            if not titled:
                add(left, l, good)
            add(right, r, good)
        m.left, m.right = keep(left), keep(right)
        pos, neg = Counter(), Counter()
        for words, l, r, titled, good in found:
            score = 2.0 if titled or good else m.left.get(l, 0.0) + m.right.get(r, 0.0)
            if abs(score) >= 1 and not (l == "^" and r == "$"):
                (pos if score > 0 else neg).update(w for w in words if w not in names)
        for w in {*pos, *neg, *parts}:
            mailed = parts.get(_letters(w), 0)
            m.words[w] = _odds(pos[w] + 2 * mailed, neg[w] if mailed < 2 else min(neg[w], pos[w] + mailed))
    return m


def _evidence(t: Tokens, m: Model) -> dict[int, list[float]]:
    """The unary log-potentials of the tokens that may be part of a mention; all others are outside for certain."""
    n = len(t.kind)
    out: dict[int, list[float]] = {}

    def at(i: int) -> list[float]:
        v = out.get(i)
        if v is None:
            v = out[i] = [0.0, -3.0, -3.0, -3.0, -3.0, -3.0]
        return v

    known = m.given | m.family if m.known is None else m.known
    m.known = known
    sharp = [i for i, k in enumerate(t.kind) if k in _SHARP]
    for i in sharp:
        _sharp_evidence(t, i, t.kind[i], m, at)
        if i and t.kind[i] == "house" and t.kind[i - 1] == "word" and t.low[i - 1].endswith(("strasse", "straße")):
            _address_evidence(t, i - 1, i + 1, m, at)
    for i in [i for i, w in enumerate(t.low) if w in known]:
        if t.kind[i] == "word":
            for j in range(i, _pair(t, i, m)):
                at(j)[NAME] += 8.0
    for a, b in _runs(t, m):
        l, r = _around(t, a, b)
        titled = _title(t, a - 1)
        around = max(-4.0, min(4.0, 0.75 * (m.left.get(l, 0.0) + m.right.get(r, 0.0))))
        scores = [
            None if t.kind[i] == "initial" else 2.5 if t.low[i] in m.given or t.low[i] in m.family else m.words.get(t.low[i], 0.0) for i in range(a, b)
        ]
        for i, score in zip(range(a, b), scores, strict=True):
            before = scores[i - a - 1] if i > a else None
            after = scores[i - a + 1] if i + 1 < b else None
            if score is None:  # an initial speaks for a name as far as its neighbours do
                at(i)[NAME] += 1.5 + 3.5 * (titled and i == a) + 1.0 * ((after or 0.0) > 0) + 1.0 * ((before or 0.0) > 0)
                continue
            if titled:
                score += 5.0 if i == a else 2.0 * (score > 0) + 3.0 * (before is None)
            else:
                # a run of two or more words where names stand
                score += around + 1.5 * (around > 0.5 and b - a > 1 and score > -0.5)
            # two words of names side by side
            score += 2.0 * (scores[i - a] > 0 and ((before or 0.0) > 0 or (after or 0.0) > 0))
            at(i)[NAME] += max(-4.0, min(7.0, score))
        if b + 1 < n and t.low[b] == "," and b in out and t.kind[b + 1] == "word":
            at(b)
    # a comma carries a mention on only between tokens that may belong to one
    for i in range(1, n - 1):
        if t.kind[i] == "mark" and t.low[i] == "," and i not in out and i - 1 in out and i + 1 in out:
            at(i)[:] = (0.0, -6.0, -6.0, -6.0, -1.0, -1.0)
    return out


def _address_evidence(t: Tokens, a: int, b: int, m: Model, at) -> None:
    """Marks the head a..b-1 of an address and the unit, town and postal code that follow it."""
    for i in range(a, b):
        at(i)[ADDRESS] += 8.0
    n, i = len(t.kind), b
    for _ in range(3):
        j = i + 1 if i < n and t.low[i] == "," else i
        if j >= n:
            return
        if t.low[j].rstrip(".") in _U and j + 1 < n and t.kind[j + 1] == "house":
            e = j + 2
        else:
            if j == i and t.start[j] == t.end[i - 1] + 1 and t.kind[j] != "house" and not t.broken(i):
                return
            e = j + 1 if t.kind[j] == "house" and len(t.text[j]) == 5 else j
            k = 0
            while e < n and k < 2 and _namelike(t, e, m) and t.low[e] not in m.given:
                e, k = e + 1, k + 1
            if k and e < n and t.kind[e] == "house" and len(t.text[e]) == 5:
                e += 1
            if e == j or not k and e == j + 1 and j == i and len(t.text[j]) != 5:
                return
        for x in range(i, e):
            at(x)[ADDRESS] += 6.0
        i = e


def _sharp_evidence(t: Tokens, i: int, k: str, m: Model, at) -> None:
    n = len(t.kind)
    if k == "email":
        at(i)[EMAIL] += 11.0
    elif k == "spoken":
        at(i)[PHONE] += 9.0
    elif k == "initial" or k == "abbreviation":
        if k == "initial":
            e = _pair(t, i, m)
            for j in range(i, e):
                at(j)[NAME] += 8.0
    else:
        s = t.text[i]
        cued = False
        for j in range(i - 1, max(-1, i - 5), -1):
            if t.kind[j] == "mark" and t.low[j] in ".;|!?":
                break
            cued = cued or t.low[j] in _C
        if k == "tag":
            prefix = re.match(r"[a-z]+", t.low[i]).group()
            if prefix in ID_PREFIXES.split():
                at(i)[ID] += 9.0
            elif cued:
                at(i)[ID] += 8.0
            return
        digits = sum(c.isdigit() for c in s)
        near = t.low[i - 1] if i else "^"
        if cued and digits >= 5 and not s.startswith(("+", "(")):
            v = at(i)
            v[ID] += 8.0
            if i and t.kind[i - 1] == "word" and t.text[i - 1].isupper() and len(t.text[i - 1]) == 2 and t.low[i - 1] not in ("no", "id", "nr"):
                at(i - 1)[ID] += 8.0
        shape = _phone_shape(s)
        if shape:
            l, r = _around(t, i, i + 1)
            v = at(i)
            v[PHONE] += shape + 0.75 * (m.phone_left.get(l, 0.0) + m.phone_right.get(r, 0.0))
            if i + 2 <= n and i + 1 < n and t.low[i + 1] in ("ext", "ext.", "x", "extension") and i + 2 < n and t.kind[i + 2] == "house":
                at(i + 1)[PHONE] += 6.0
                at(i + 2)[PHONE] += 6.0
        elif re.fullmatch(r"\d{3}[- ]\d{2}[- ]\d{4}", s) and not cued and near not in ("number", "prefix", "no", "no."):
            at(i)[ID] += 3.5
        if k == "house" and digits <= 5:
            j = i + 1
            if j < n and t.low[j] == "," and j + 1 < n and t.low[j + 1] in _P:
                j += 1
            if j < n and t.low[j] in _P and j + 1 < n and t.kind[j + 1] == "word" and _is_cap(t.text[j + 1]):
                e = j + 2
                while e < n and e < j + 4 and t.start[e] == t.end[e - 1] + 1 and _namelike(t, e, m) and not t.broken(e):
                    e += 1
                _address_evidence(t, i, e, m, at)
                return
            if j < n and t.kind[j] == "initial":
                j += 1
            e = j
            while e < n and e < j + 4 and t.kind[e] in ("word", "abbreviation") and _is_cap(t.text[e]):
                e += 1
                if e > j + 1 and t.low[e - 1].rstrip(".") in _S:
                    _address_evidence(t, i, e, m, at)
                    return


#: Log-potentials of neighbouring labels and of the labels of linked distant tokens, before they are estimated.
_CHAIN = np.full((6, 6), -3.0)
np.fill_diagonal(_CHAIN, 1.0)
_CHAIN[O, :] = -1.0
_CHAIN[:, O] = -0.5
_CHAIN[O, O] = 0.0
_LINK = np.zeros((6, 6))
np.fill_diagonal(_LINK, SKIP)
_LINK[O, O] = 0.0


def infer(
    unary: np.ndarray, chain: np.ndarray, links: np.ndarray, rounds: int = ROUNDS, chain_table: np.ndarray = _CHAIN, link_table: np.ndarray = _LINK
) -> np.ndarray:
    """The labels of all nodes by loopy max-product message passing, all edges at once.

    ``chain`` and ``links`` hold pairs of node numbers: neighbours, and distant repeated or similar tokens.
    Every edge carries a message each way; a round sends all of them anew, half kept from the last round so
    that loops settle.
    """
    if not len(unary):
        return np.zeros(0, np.int8)
    edges = np.concatenate([chain, links]).reshape(-1, 2)
    if not len(edges):
        return unary.argmax(1).astype(np.int8)
    tables = np.concatenate([np.repeat(chain_table[None], len(chain), 0), np.repeat(link_table[None], len(links), 0)])
    src = np.concatenate([edges[:, 0], edges[:, 1]])
    dst = np.concatenate([edges[:, 1], edges[:, 0]])
    potential = np.concatenate([tables, tables.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    message = np.zeros((len(src), 6))
    belief = unary.copy()
    for r in range(rounds):
        out = ((belief[src] - message[back])[:, :, None] + potential).max(1)
        out -= out.max(1, keepdims=True)
        message = out if r == 0 else 0.5 * (message + out)
        belief = unary.copy()
        np.add.at(belief, dst, message)
    return belief.argmax(1).astype(np.int8)


def _folded(word: str) -> str:
    """A word without accents."""
    return word if word.isascii() else "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


@dataclass
class Graph:
    """The nodes of a batch of texts, their evidence, and the two kinds of edges."""

    tokens: list[Tokens | None] = field(default_factory=list)
    unary: list[list[float]] = field(default_factory=list)
    where: list[tuple[int, int]] = field(default_factory=list)
    first: list[int] = field(default_factory=list)
    last: list[int] = field(default_factory=list)
    chain: list[tuple[int, int]] = field(default_factory=list)
    links: list[tuple[int, int]] = field(default_factory=list)

    def labels(self, m: Model, rounds: int = ROUNDS, with_links: bool = True) -> np.ndarray:
        links = np.array(self.links if with_links else [], np.int64).reshape(-1, 2)
        unary = np.array(self.unary, np.float64).reshape(-1, 6)
        # the neighbours that are outside for certain
        unary[self.first] += m.chain_table[O]
        unary[self.last] += m.chain_table[:, O]
        return infer(unary, np.array(self.chain, np.int64).reshape(-1, 2), links, rounds, m.chain_table, m.link_table)


def graph(texts: list[str | None], m: Model, rows: list[Tokens] | None = None) -> Graph:
    """The field over all texts of a batch: a node for each token that may belong to a mention.

    Neighbouring nodes are chained. A node is linked to the last earlier node of its text that is the same
    word (without case, accents or possessive), the same number (its last nine letters and digits, however
    grouped), or the given name an initial before the same family name stands for. ``rows`` are the texts'
    tokens, if they are there already.
    """
    g = Graph()
    for row, text in enumerate(texts):
        if not text:
            g.tokens.append(None)
            continue
        t = tokenize(text) if rows is None else rows[row]
        t.source = text
        g.tokens.append(t)
        seen: dict = {}
        number: dict[int, int] = {}
        found = _evidence(t, m)
        for i in sorted(found):
            k = number[i] = len(g.unary)
            if i - 1 not in found:
                g.first.append(k)
            if i + 1 not in found:
                g.last.append(k)
            g.unary.append(found[i])
            g.where.append((row, i))
            if i - 1 in number:
                g.chain.append((number[i - 1], k))
            same, kind, low = None, t.kind[i], t.low[i]
            if kind == "word":
                if len(low) > 3:
                    same = _folded(low)
                if i + 1 in found and t.kind[i + 1] == "word":
                    seen[low[0], t.low[i + 1]] = k
            elif kind == "initial":
                same = (low[0], t.low[i + 1]) if i + 1 in found else None
            elif kind in ("number", "tag", "house") and len(low) > 6:
                same = "".join(c for c in low if c.isalnum())[-9:]
            if same:
                if same in seen and number.get(i - 1) != seen[same]:
                    g.links.append((seen[same], k))
                seen[same] = k
    return g


def fit_potentials(texts: list[str], m: Model, rows: list[Tokens] | None = None, rounds: int = 2) -> None:
    """Estimates the edge potentials from the sample, by labels inferred with the potentials so far.

    A potential is the log-odds of two labels on an edge against independent labels, with the stated
    potentials as 50 observations a label pair, between -3 and 3. Labels of unlinked, unchained tokens don't
    matter, so the estimate is that of a pseudo-likelihood's first step, repeated ``rounds`` times.
    """
    g = graph(texts, m, rows)
    if not g.unary:
        return
    prior_chain, prior_link = m.chain_table, m.link_table
    for _ in range(rounds):
        labels = g.labels(m)

        # nodes beside tokens that are outside for certain
        begins = np.bincount(labels[g.first], minlength=6)
        ends = np.bincount(labels[g.last], minlength=6)

        def table(pairs: list[tuple[int, int]], prior: np.ndarray, both: bool) -> np.ndarray:
            n = np.zeros((6, 6))
            if not both:
                n[O, :] += begins
                n[:, O] += ends
            if pairs:
                e = np.array(pairs)
                np.add.at(n, (labels[e[:, 0]], labels[e[:, 1]]), 1)
            if both:
                n = n + n.T
            rows, cols = n.sum(1, keepdims=True), n.sum(0, keepdims=True)
            expected = rows * cols / max(n.sum(), 1)
            # what was seen weighs as often as it could have been seen, the stated potential 50 times
            weight = expected / (expected + 50)
            return weight * np.clip(np.log((n + 0.5) / (expected + 0.5)), -3, 3) + (1 - weight) * prior

        m.chain_table, m.link_table = table(g.chain, prior_chain, False), table(g.links, prior_link, True)


def mentions(texts: list[str | None], m: Model, rounds: int = ROUNDS, with_links: bool = True) -> list[list[tuple[str, int, int]]]:
    """The mentions of every text as (type, start, end), in order; starts and ends are 0-based code points."""
    g = graph(texts, m)
    tokens, where = g.tokens, g.where
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if not g.unary:
        return out
    labels = g.labels(m, rounds, with_links)
    run: list[tuple[int, int]] = []

    def close() -> None:
        if run:
            row = run[0][0]
            out[row].extend(_checked(tokens[row], [i for _, i in run], int(labels_of[0]), m))

    labels_of = [0]
    for (row, i), y in zip(where, labels.tolist(), strict=True):
        if run and (run[-1] != (row, i - 1) or y != labels_of[0]):
            close()
            run = []
        if y != O:
            labels_of[0] = y
            run.append((row, i))
    close()
    return out


def _checked(t: Tokens, ids: list[int], label: int, m: Model) -> list[tuple[str, int, int]]:
    """The exact check of a run of tokens with one label: trims marks, and asks a name for two parts or a title."""
    while ids and t.kind[ids[-1]] == "mark":
        ids = ids[:-1]
    while ids and t.kind[ids[0]] == "mark":
        ids = ids[1:]
    if not ids:
        return []
    if label == NAME:
        words = [i for i in ids if t.kind[i] in ("word", "initial")]
        if not _title(t, ids[0] - 1) and len(words) < 2 or all(t.kind[i] == "initial" for i in words):
            return []
    if label in (EMAIL, PHONE) and len(ids) > 1 and t.kind[ids[1]] in ("email", "number", "spoken"):
        return [(LABELS[label], t.start[i], t.end[i]) for i in ids]
    end = t.end[ids[-1]]
    if label == NAME and t.text[ids[-1]].lower().endswith(("'s", "’s")):
        end -= 2
    return [(LABELS[label], t.start[ids[0]], end)]


def _broken(self: Tokens, i: int) -> bool:
    """Whether a line break stands before token i."""
    return "\n" in self.source[self.end[i - 1] : self.start[i]]


Tokens.broken = _broken
Tokens.source = ""


def fit_model(tables: list[tuple[DataFrame, str, str]], roster: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits a model on a bounded sample: of each (table, key, text) the ``sample_rows`` rows of least key hash.

    ``roster`` holds ``given_name`` and ``family_name``, at most 100,000 rows (checked). Only the fit is on a
    sample; every row is searched.
    """
    known = roster.select("given_name", "family_name").limit(100_001).collect()
    if len(known) > 100_000:
        raise ValueError("more than 100,000 known persons")
    texts: list[str] = []
    for df, key, text in tables:
        rows = df.select(F.xxhash64(F.col(key)).alias("h"), F.col(text).alias("t"))
        # a hash bound keeps the rows of all tasks together near the sample's size, however many tasks there are
        bound = -(2.0**63) + 2.0**64 * min(1.0, 1.2 * sample_rows / max(1, df.count()))
        rows = rows.where((F.col("h") <= bound) & F.length("t").between(1, SAMPLE_CHARS))
        texts += [r["t"] for r in rows.orderBy("h", "t").limit(sample_rows).collect()]
    return fit(texts, {r[0] for r in known}, {r[1] for r in known})


def find_personal(df: DataFrame, key: str, text: str, model: Model, with_text: bool = False, batch_chars: int = 1 << 22) -> DataFrame:
    """Every mention of personal information: ``(<key>, pii_type, match_start, match_end)``, 1-based code points.

    With ``with_text`` one row per input row instead: ``(<key>, redacted, mentions)``, where each mention is
    replaced by a placeholder such as ``[EMAIL]`` and all else is unchanged.

    Method: a skip-chain conditional random field over the tokens of each text. Tokens that may belong to a
    mention have log-potentials from their shape, the known names, and fitted scores of their contexts;
    neighbours and distant repeated or similar tokens share potentials, and loopy message passing over all
    texts of a batch makes the labels consistent. Runs of one label are mentions after an exact check.
    Everything runs in Arrow batches, without a shuffle.

    Defined cases: null and empty texts have no mentions (``redacted`` is the text itself); repeated rows
    are searched like others; texts of any length are searched whole; extra columns are ignored.
    """
    types = dict(df.select(key).dtypes)
    spark_type = "array<struct<pii_type:string,match_start:int,match_end:int>>"
    ddl = f"`{key}` {types[key]}, " + (f"redacted string, mentions {spark_type}" if with_text else "pii_type string, match_start int, match_end int")
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        gc.disable()  # the many small lists of a batch hold no cycles
        try:
            yield from search(m, batches)
        finally:
            gc.enable()

    def search(m: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            a = 0
            while a < len(texts):
                b, size = a, 0
                while b < len(texts) and size < batch_chars:
                    size += len(texts[b] or "")
                    b += 1
                found = mentions(texts[a:b], m)
                keys = batch.column(0).slice(a, b - a)
                if with_text:
                    rows = [redact(x, f) for x, f in zip(texts[a:b], found, strict=True)]
                    lists = [[{"pii_type": k, "match_start": s + 1, "match_end": e} for k, s, e in f] for f in found]
                    kind = pa.list_(pa.struct([("pii_type", pa.string()), ("match_start", pa.int32()), ("match_end", pa.int32())]))
                    yield pa.RecordBatch.from_arrays([keys, pa.array(rows, pa.string()), pa.array(lists, kind)], names=[key, "redacted", "mentions"])
                else:
                    take = [i for i, f in enumerate(found) for _ in f]
                    flat = [x for f in found for x in f]
                    yield pa.RecordBatch.from_arrays(
                        [
                            keys.take(pa.array(take, pa.int64())), pa.array([x[0] for x in flat], pa.string()),
                            pa.array([x[1] + 1 for x in flat], pa.int32()), pa.array([x[2] for x in flat], pa.int32()),
                        ],
                        names=[key, "pii_type", "match_start", "match_end"],
                    )
                a = b

    return df.select(key, text).mapInArrow(run, ddl)


def redact(text: str | None, found: list[tuple[str, int, int]]) -> str | None:
    """``text`` with a typed placeholder for each mention."""
    if not text or not found:
        return text
    out, at = [], 0
    for kind, a, b in found:
        out.append(text[at:a] + f"[{kind.upper()}]")
        at = b
    return "".join(out) + text[at:]
