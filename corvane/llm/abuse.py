"""p8: abusive, hateful or sexual passages, in plain or disguised spelling.

Noisy channel. What stands in the text is what was meant, sent through a channel that swaps letters for
digits and signs, masks, repeats, spaces or slips them. A disguised token is a lattice of letters; Viterbi
search runs it against all words at once, ordinary ones and those of the lexicon on equal terms (a word's
share in all documents), and against spellings that are no word (a character trigram model of all
documents). The most probable path is what is read.

Score. A restored passage becomes a string of word classes; features are relations between classes (somebody
addressed + insult, group + is + beast, modal + harm ...), not phrases. A logistic model weighs them. Its
weights start at PRIOR and are moved by the reviewed documents (`fit`): a bounded sample of labels, with
rates for wrong labels, the best passage of a document standing for it.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.abuse_lexicon import IDIOMS, LANGUAGES, NO_PEOPLE, PEOPLES, forms
from corvane.session import written

#: A passage from this score on makes a document a case.
THRESHOLD = 0.5
#: A word is shipped to the tasks if its share of all words is at least one in this many, so that is also their bound.
MAX_WORDS = 1 << 16
#: Occurrences per million words a lexicon word has at least.
PRIOR_PER_MILLION = 20
#: Reviewed documents the weights are fitted on at most.
MAX_LABELS = 20_000
#: Chance that a reviewer marks a clean document, or passes an abusive one; precision of the prior weights.
WRONG_YES, WRONG_NO = 0.02, 0.12
PRECISION = 4.0

# Letters that a sign may stand for.
CHANNEL = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i", "(": "c", "<": "c", "{": "c", "¢": "c", "&": "a", "§": "s", "%": "o",
}
MASKS = "*#_?^~"
#: Costs of the channel in nats. Masks are put on words that offend, so there they are cheap.
SIGN, REPEAT, MASK_OFFENSIVE, MASK, SLIP = 0.5, 0.3, 0.7, 6.0, 7.0
#: Cost of a sign that stands for nothing: a separator, a mask, or one that is used for a letter.
SILENT, SILENT_MASK, SILENT_LETTER = 1.0, 3.0, 4.0
#: Nats of a digit or sign that stands for itself, and of the step outside the vocabulary if nothing is known of it.
DIGIT, OTHER_SIGN = 2.3, 3.0

_TAG = re.compile(r"<[^<>]*>")
_SIGN = "[^\\W_]|[$@!*|€]"
_SPACED = re.compile(rf"(?<![^\W_])(?:{_SIGN})(?:([ .\-_·*/~!])\1*(?:{_SIGN}))(?:\1+(?:{_SIGN}))+(?![^\W_])")
_PASSAGE = re.compile(r"(?<=[.!?…])\s+|(?<=[.!?…][\"”»'’)\]])\s+|\n+")
# A line that ends no sentence, before one that begins with a small letter (or a disguised one).
_BROKEN = re.compile(r"(?<=[\w,])\s*\n\s*(?=[\d$@!|€]*([^\W\d_]))")
_WORDS = re.compile(r"[a-z]+")
_MARKED = re.compile(r"[a-z](?:[a-z0-9@$!*]*[a-z0-9])?(?:-proof)?|[,;:]| - ")
_EDGE = ".,;:!?'\"-…/\\"
_ALIKE = str.maketrans({
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "к": "k", "м": "m", "т": "t",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ι": "i", "ν": "v", "’": "'", "‘": "'", "\u00a0": " ", "\u202f": " ",
    **dict.fromkeys("\u200b\u200c\u200d\u2060\ufeff\u00ad", ""), **{chr(c): "" for c in range(0x300, 0x370)},
})


def plain(text: str) -> str:
    """Lower case without markup, entities, accents, zero-width characters and doubly encoded letters."""
    if "Ã" in text or "â" in text or "Â" in text:
        def mend(m: re.Match) -> str:
            try:
                return m.group().encode("cp1252").decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                return m.group()

        text = re.sub(r"[ÃÂâ][\u0080-ɏ‐-™€™œ]{1,2}", mend, text)
    if "<" in text or "&" in text:
        text = _TAG.sub("\n", html.unescape(text))
    if "\n" in text:
        text = _BROKEN.sub(lambda m: " " if m.group(1).islower() else m.group(), text)
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text.replace("ß", "ss")).translate(_ALIKE)
    return text


_FORMS = forms()
#: Classes without which no feature can hold, by word; and the words whose masking is cheap.
_HOT = {w for table in _FORMS.values() for w, k in table.items() if k in "IWBbSsNVFEK"}
_OFFENSIVE = {w for table in _FORMS.values() for w, k in table.items() if k in "ISN"}
#: Parts of idioms can be disguised as well.
_IDIOM_WORDS = {w for kinds in IDIOMS.values() for many in kinds.values() for x in many for w in re.findall(r"[a-z]{4,}", re.sub(r"\\w|\(\?[:=]", " ", x))}
LEXICON = sorted({w for table in _FORMS.values() for w in table if len(w) > 2} | _IDIOM_WORDS)


class Decoder:
    """The most probable words behind disguised tokens."""

    def __init__(self, trigrams: dict[str, float], words: dict[str, float]):
        """trigrams and words: counts over all documents (words: those above the bound)."""
        total = max(1.0, sum(c for t, c in trigrams.items() if t.startswith("^^")))
        prior = PRIOR_PER_MILLION * 1e-6
        share = {w: c / total for w, c in words.items()}
        outside = max(1e-3, 1 - sum(share.values()))
        context: dict[str, float] = defaultdict(float)
        for t, c in trigrams.items():
            context[t[:2]] += c
        self.log = {t: math.log((c + 0.01) / (context[t[:2]] + 0.3)) for t, c in trigrams.items()}
        self.floor = {x: math.log(0.01 / (c + 0.3)) for x, c in context.items()}
        self.outside = math.log(outside)
        for w in LEXICON:
            share[w] = max(share.get(w, 0.0), prior)
        self.share = {w: math.log(s) for w, s in share.items()}
        self.sorted = sorted(self.share)
        self.near: dict[str, list[str]] = defaultdict(list)
        for w in LEXICON:
            if len(w) > 3 and (w in _HOT or w in _ALL_ANCHORS):
                for v in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}:
                    self.near[v].append(w)
        self.memo: dict[str, str] = {}

    def spelled(self, token: str) -> float:
        """Log probability of a token that is no known word, letter by letter."""
        a, b, out = "^", "^", self.outside
        for c in token:
            if c.isalpha():
                got = self.log.get(a + b + c)
                out += got if got is not None else self.floor.get(a + b, -5.0)
            else:
                out -= DIGIT if c.isdigit() else OTHER_SIGN
            a, b = b, c
        return out + (self.log.get(a + b + "$") or self.floor.get(a + b, -3.0))

    def itself(self, token: str) -> float:
        got = self.share.get(token)
        return got if got is not None else self.spelled(token)

    @staticmethod
    def lattice(token: str) -> list[list[tuple[str, float]]]:
        """Arcs (letters, cost) of every run of equal characters; "*" stands for any letter."""
        arcs, k = [], 0
        while k < len(token):
            c, n = token[k], 1
            while k + n < len(token) and token[k + n] == c:
                n += 1
            letters = c if c.isalpha() else CHANNEL.get(c, "")
            inside = 0 < k and k + n < len(token)
            if c in MASKS:
                here = [("*" * n, 0.0)]
                if inside:
                    here.append(("", SILENT_MASK))
            else:
                cost = 0.0 if c.isalpha() else SIGN
                here = []
                for x in letters:
                    if n < 3:
                        here.append((x * n, cost * n))
                        if n == 2:
                            here.append((x, cost + 2.0))
                    else:
                        here += [(x, cost + REPEAT), (x * 2, cost + REPEAT)]
                if not c.isalpha():
                    here.append(("", SILENT if not letters or (n > 1 and inside) else SILENT_LETTER))
            arcs.append(here)
            k += n
        return arcs

    def words_of(self, token: str) -> list[tuple[float, str]]:
        """(channel cost, word) of the words the lattice of a token can spell, masks counted."""
        states: dict[str, tuple[float, int]] = {"": (0.0, 0)}
        ws = self.sorted
        for arcs in self.lattice(token):
            following: dict[str, tuple[float, int]] = {}
            for prefix, (cost, masks) in states.items():
                for letters, more in arcs:
                    heads = [prefix]
                    for c in letters:
                        grown = []
                        for h in heads:
                            for x in "abcdefghijklmnopqrstuvwxyz" if c == "*" else c:
                                p = h + x
                                at = bisect_left(ws, p)
                                if at < len(ws) and ws[at].startswith(p):
                                    grown.append(p)
                        heads = grown
                    for h in heads:
                        new = (cost + more, masks + letters.count("*"))
                        if h not in following or new < following[h]:
                            following[h] = new
            states = following
            if not states:
                return []
        return [(cost + masks * (MASK_OFFENSIVE if p in _OFFENSIVE else MASK), p) for p, (cost, masks) in states.items() if p in self.share]

    def decode(self, token: str) -> str:
        """The most probable reading of a token: a word through the channel, or the token itself."""
        best = (self.itself(token), token)
        for cost, w in self.words_of(token):
            best = max(best, (self.share[w] - cost + 1e-3 * self.spelled(w), w))
        return best[1]

    def slip(self, token: str) -> str:
        """The most probable word one slip away from an unknown token, or the token."""
        reach = {v for d in {token, *(token[:k] + token[k + 1 :] for k in range(len(token)))} for v in self.near.get(d, ())}
        if not reach:
            return token
        best, left = (self.spelled(token), token), "abcdefghijklmnopqrstuvwxyz"
        rivals = {token[:k] + token[k + 1 :] for k in range(1, len(token))} | {token[:k] + c + token[k + j :] for k in range(1, len(token) + 1) for c in left for j in (0, 1)}
        rivals |= {token[:k] + token[k + 1] + token[k] + token[k + 2 :] for k in range(1, len(token) - 1)}
        for w in rivals:
            got = self.share.get(w)
            if got is not None:
                turned = sorted(w) == sorted(token) or (len(w) != len(token) and len(set(w)) == len(set(token)))
                best = max(best, (got - (SLIP - 2 if turned else SLIP), w))
        return best[1]

    def word(self, token: str) -> str:
        """What a token means: itself, or the most probable word behind it."""
        got = self.memo.get(token)
        if got is not None:
            return got
        core, got = token.strip(_EDGE), token
        if core.isalpha():
            if core not in self.share and len(core) > 3:
                out = self.decode(core) if re.search(r"(.)\1\1", core) else core
                if out == core:
                    out = self.slip(core)
                got = token.replace(core, out)
        elif len(core) > 2 and any(c.isalpha() for c in core):
            out = self.decode(core)
            if out == core and (parts := re.split(r"(['\-/.])", core))[1:]:
                out = "".join(p if len(p) < 2 else self.word(p) for p in parts)
            got = token.replace(core, out) if out != core else token
        if len(self.memo) < 1 << 18:
            self.memo[token] = got
        return got

    def _joined(self, m: re.Match) -> str:
        letters = re.sub(re.escape(m.group(1)) + "+", "", m.group()) if m.group(1) not in "*!" else re.sub(re.escape(m.group(1)) + "+", "", m.group())
        for head, tail in ((0, 0), (1, 0), (0, 1), (1, 1)):  # a word of one letter may stand beside
            core = letters[head : len(letters) - tail]
            out = core if core in self.share else self.decode(core)
            if len(core) > 2 and out in self.share:
                return " ".join(x for x in (letters[:head], out, letters[len(letters) - tail :] if tail else "") if x)
        return m.group()

    def restore(self, passage: str) -> str:
        """A plain passage with its disguised tokens replaced by what they mean."""
        tokens = passage.split()
        if sum(len(t) == 1 for t in tokens) > 2:
            tokens = _SPACED.sub(self._joined, " ".join(tokens)).split()
        memo, word = self.memo, self.word
        return " ".join([memo.get(t) or word(t) for t in tokens])


_ANY = "[^,IWKT]"
#: Features: name, prior weight, pattern over word classes. A span's Q words (context) weigh against it.
FEATURES = [
    ("insult", 3.2, r"I"),
    ("insult_used", 1.9, r"(?:[AZBbYyLxkM,]|^)I|I,?$|I[,C]"),
    ("addressed_insult", 2.7, r"[YK]" + _ANY + r"{0,4}I|I,?Y|ZA{1,2}" + _ANY + r"{0,2}I|[HPGpL]" + _ANY + r"{0,3}CA{0,3}[Bb]{0,3}I"),
    ("addressed_name", 5.4, r"YC[AC]{0,3}[Bb]{0,3}A?W(?!\.)|Y[AC]{0,2}[Bb]{1,3}W|A?[Bb]{1,3}W,?$|CYA{1,2}[Bb]{0,3}W(?!\.)|W,?Y(?![CR])|,Y[Bb]{0,2}W"),
    ("exclaimed_name", 5.0, r"ZA{1,2}[Bb]{0,3}[WBb]|Z[Bb]?W"),
    ("person_is_name", 5.0, r"[HP][^,IWT]{0,4}CA{0,3}[Bb]{0,3}A{0,2}W(?!\.)|[HP]C?A{1,2}[Bb]{1,3}W"),
    ("you_are_bad", 5.0, r"Y[CA]{1,4}[Bb](?!\.)|Y[AC]{0,2}[Bb][Bb]|CYA{0,2}[Bb](?!\.)"),
    ("person_is_bad", 4.4, r"[HP][^,IWT]{0,2}CA{0,3}B|[HP]C?A{1,2}[Bb][Bb]"),
    ("person_is_mildly_bad", 2.2, r"[HP][^,IWT]{0,2}CA{0,3}b"),
    ("group_is_name", 5.8, r"[Gg][^,IWT]{0,3}CA{0,5}[Bb]{0,3}W|p[^,IWT]{0,2}CA{0,5}[Bb]{0,3}W|(?:A|L)[Gg]A{0,2}W"),
    ("all_are_name", 3.4, r"L[^,IWTYH]{1,2}CA{0,5}[Bb]{0,3}W"),
    ("group_is_bad", 4.8, r"[Gg][^,IWT]{0,3}CA{0,4}[Bb]|[Bb]A?[Gg]"),
    ("all_are_bad", 3.2, r"p[^,IWT]{0,2}CA{0,4}[Bb]|L[^,IWTYH]{1,3}CA{0,4}[Bb]"),
    ("name_like_group", 5.0, r"[WBb]A?lA{0,2}" + _ANY + r"{0,2}[GgpYH]|[Bb][^,]{0,3}lA{0,2}" + _ANY + r"{0,2}[Ggp]|W" + _ANY + r"{0,3}lA?[GgY]"),
    ("group_out", 4.4, r"[Gg][^,]{0,6}R[^,]{0,3}E|[Gg][^,]{0,2}E|E[^,]{0,3}A?[Gg]|n[Gg]p?"),
    ("out", 1.4, r"E"),
    ("out_should", 1.0, r"R[^,]{0,4}E"),
    ("threat", 5.4, r"M[^,IWT]{0,2}R[^,T]{0,6}[VF][^,T]{0,2}[YyHP]|M[^,IWT]{0,2}R[^,T]{0,3}Y[^,T]{0,2}[VFI]|Y[CR]?R[^,T]{0,2}F|MVY|MR?YV"),
    ("wished_harm", 5.2, r"hA?[YHPGgp][^,T]{0,4}[FVE]"),
    ("should_suffer", 4.8, r"[YHPGgpLWI][^,T]{0,5}R[^,T]{0,3}(?:F|CV|CAV)|[YHPGgpLWI][^,T]{0,5}CR?V|R[^,T]{0,1}V[^,T]{0,2}[PGgY]|[Yp]lY[^,]{0,3}[RC]{0,2}[^,]{0,2}F"),
    ("dismissed", 5.0, r"K"),
    ("someone_or_else", 1.0, r"K[^I]{0,8}[IWBb]|[IW][^K]{0,8}K"),
    ("sexual_toward", 5.4, r"S[OA]{0,2}[MYHP]|J[^,]{0,2}S|[MYH]S|S[^,T]{0,2}O[MHY]|MRSY|[YH][^,T]{0,2}RS"),
    ("sexual_act", 2.6, r"S"),
    ("asks_nudity", 5.4, r"J[^,]{0,4}N|N[^,]{0,5}J[MY]|[yM]A?[Bb]?N|Y[^,]{0,2}N"),
    ("nudity", 2.0, r"N"),
    ("suggestive", 1.4, r"s"),
    ("suggestive_toward", 3.2, r"J[^,]{0,4}s|s[^,]{0,3}O?M|sx?s,?s|y[^,]{0,4}s|[YM][^,]{0,6}s[^,]{0,5}s|Y[^,]{0,2}s[^,]{0,3}[OM]"),
    ("explicit", 2.4, r"[SN][^T]{0,10}[SN]"),
]
#: Prior weight of no feature at all, and of a context word beside a feature.
BIAS, CONTEXT = -4.0, -3.4
PRIOR = np.array([BIAS, *[w for _, w, _ in FEATURES], CONTEXT])
#: Classes of which a feature needs one.
_NEEDS = {"insult": "I", "insult_used": "I", "addressed_insult": "I", "addressed_name": "W", "exclaimed_name": "WBb", "person_is_name": "W", "group_is_name": "W", "all_are_name": "W", "name_like_group": "WBb", "threat": "VF", "wished_harm": "VFE", "should_suffer": "VF", "dismissed": "K", "someone_or_else": "K", "sexual_toward": "S", "sexual_act": "S", "explicit": "SN", "asks_nudity": "N", "nudity": "N", "suggestive": "s", "suggestive_toward": "s"}
_COMPILED = [(_NEEDS.get(n, "Bb" if n.endswith("bad") else "E"), re.compile(p)) for n, _, p in FEATURES]
_KINDS = {"insult": ("insult", "addressed", "exclaimed", "person", "you_", "dismissed", "someone"), "hate": ("group", "all_", "name_like", "out"), "threat": ("threat", "wished", "should"), "sexual": ("sexual", "asks", "nudity", "suggestive", "explicit")}
_KIND_OF = [next(k for k, heads in _KINDS.items() if n.startswith(heads)) for n, _, _ in FEATURES]
_PROXY = {lang: [(kind, re.compile(r"(?<![a-z])(?:" + "|".join(many) + r")(?![a-z])")) for kind, many in kinds.items()] for lang, kinds in IDIOMS.items()}
_STANDIN = {k: f"zq{k.lower()}{'u' if k.isupper() else 'l'}" for k in "IWBSsNVFEKAZ"}
_HOT_CLASSES = frozenset("IWBbSsNVFEK")
_BREAK = re.compile("[,k]")


def _anchors(lang: str) -> tuple[frozenset, tuple[str, ...]]:
    """Words, and beginnings of words, one of which stands in every idiom of a class that counts."""
    whole, heads = set(), set()
    for kind, many in IDIOMS[lang].items():
        for idiom in many if kind in _HOT_CLASSES else ():
            parts = re.findall(r"[a-z]+(?:\\w)?[?]?", re.sub(r"\(\?[=][^)]*\)+", "", idiom))
            firm = [x for x in parts if x.strip("?") not in _COMMON] or parts
            for x in firm:
                (heads if x.endswith("\\w") else whole).add(x.removesuffix("\\w").rstrip("?"))
                whole.add(x.removesuffix("\\w").rstrip("?")[:-1] if x.endswith("?") else "")
    return frozenset(w for w in whole if len(w) > 1), tuple(sorted(h for h in heads if h))


#: Words of idioms too common to look for, where another stands in the idiom.
_COMMON = frozenset("a in to w your you with the off out on not get have had having me him her be been being to in my a of from up where is no over us know go by s die deine dein das auf den dich mir sie nie zu ich nicht la ta ton le les un de se que el tu te va vous faire je sais ou pas al il faut toi con para por no mi".split())
_ANCHORS = {lang: _anchors(lang) for lang in LANGUAGES}
_ALL_ANCHORS = frozenset().union(*(whole for whole, _ in _ANCHORS.values()))
for _k, _w in _STANDIN.items():
    for _table in _FORMS.values():
        _table[_w] = _k


def classes(passage: str, lang: str) -> str:
    """The word classes of a restored passage in one language; "." is any other word, "," a break."""
    for kind, pattern in _PROXY[lang]:
        if pattern.search(passage):
            passage = pattern.sub(f" {_STANDIN[kind]} ", passage)
    table, ends, out = _FORMS[lang], PEOPLES[lang], []
    for w in _MARKED.findall(passage):
        kind = table.get(w)
        if kind is None:
            kind = "," if not w[0].isalpha() else "g" if len(w) > 5 and w.endswith(ends) and w not in NO_PEOPLE else "."
        out.append(kind)
    return "".join(out)


def features(line: str) -> np.ndarray:
    """1 (for the bias), whether each feature holds, and how many (up to 3) have a context word beside them."""
    x = np.zeros(len(PRIOR))
    x[0] = 1
    for k, (need, pattern) in enumerate(_COMPILED):
        if not any(c in line for c in need):
            continue
        m = pattern.search(line)
        if m:
            x[k + 1] = 1
            before = _BREAK.split(line[: m.start()])[-1][-8:]
            after = _BREAK.split(line[m.end() :], maxsplit=1)[0][:5]
            x[-1] += "Q" in before or "Q" in after or "Q" in m.group()
    x[-1] = min(3, x[-1])
    return x


class Scorer:
    def __init__(self, trigrams: dict[str, float], words: dict[str, float], weights: np.ndarray = PRIOR):
        self.decoder = Decoder(trigrams, words)
        self.weights = weights
        self.hot: dict[str, int] = {}

    def _languages(self, token: str) -> int:
        """Languages (as bits) in which a plain token, once restored, can make a feature or begin an idiom hold."""
        found = 0
        for w in _WORDS.findall(self.decoder.word(token)):
            for bit, lang in enumerate(LANGUAGES):
                if _FORMS[lang].get(w, ".") in _HOT_CLASSES or w in _ANCHORS[lang][0] or w.startswith(_ANCHORS[lang][1]):
                    found |= 1 << bit
        if len(self.hot) < 1 << 18:
            self.hot[token] = found
        return found

    def passage(self, text: str) -> tuple[float, str, np.ndarray | None]:
        """Logit, kind and features of a plain passage, under the language that gives most."""
        got = (-99.0, "", None)
        tokens, hot, bits, single = text.split(), self.hot, 0, 0
        for t in tokens:
            if len(t) == 1:
                single += 1
            else:
                h = hot.get(t)
                bits |= self._languages(t) if h is None else h
        if single > 2:
            bits = 15
        if not bits:
            return got
        text = self.decoder.restore(text)
        for bit, lang in enumerate(LANGUAGES):
            if not bits >> bit & 1:
                continue
            line = classes(text, lang)
            if _HOT_CLASSES.isdisjoint(line):
                continue
            x = features(line)
            z = float(x @ self.weights)
            if z > got[0]:
                named = [(self.weights[k + 1], _KIND_OF[k]) for k in range(len(FEATURES)) if x[k + 1]]
                got = (z, max(named)[1] if named else "", x)
        return got

    def best(self, text: str | None) -> tuple[float, str, np.ndarray | None]:
        """The most suspicious passage of a text."""
        got = (-99.0, "", None)
        if not text or not text.strip():
            return got
        for part in _PASSAGE.split(plain(text)):
            if part:
                one = self.passage(part)
                if one[0] > got[0]:
                    got = one
        return got

    def score(self, text: str | None) -> tuple[float, str]:
        """The highest passage score of a document, and its kind; null and blank texts score 0."""
        z, kind, _ = self.best(text)
        s = 1 / (1 + math.exp(-z)) if z > -50 else 0.0
        return s, kind if s >= THRESHOLD else ""


def language_model(documents: DataFrame, text: str = "text") -> tuple[dict[str, float], dict[str, float]]:
    """Character trigram counts over all documents, and the counts of the words with the least share shipped.

    Words are counted once, into a written table. Both results are bounded: trigrams by the alphabet, words by
    a share of one in MAX_WORDS, whatever the number of documents.
    """
    flat = F.translate(F.lower(F.col(text)), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    words = documents.where(F.col(text).isNotNull()).select(F.explode(F.split(flat, r"[^\p{L}0-9$@*_!-]+")).alias("w"))
    counts = written(words.where(F.col("w").rlike("^[a-z]{2,30}$")).groupBy("w").agg(F.count(F.lit(1)).alias("c")), "words")
    padded = F.concat(F.lit("^^"), F.col("w"), F.lit("$"))
    grams = counts.select("c", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") + 1), lambda i: F.substr(padded, i, F.lit(3)))).alias("t")).groupBy("t").agg(F.sum("c").alias("c"))
    trigrams = {r.t: float(r.c) for r in grams.collect()}
    total = sum(c for t, c in trigrams.items() if t.startswith("^^"))
    return trigrams, {r.w: float(r.c) for r in counts.where(F.col("c") >= total / MAX_WORDS).collect()}


def fit(scorer: Scorer, texts: list[str | None], labels: list[int], rounds: int = 4) -> np.ndarray:
    """Weights moved from PRIOR by reviewed documents.

    A document counts by its most suspicious passage under the weights so far. A label of 1 stands on a clean
    document with WRONG_YES, of 0 on an abusive one with WRONG_NO; the likelihood allows for both. Without
    labels the prior stays. Signs of the prior weights are kept.
    """
    weights = PRIOR.copy()
    if not texts:
        return weights
    y, precision = np.array(labels, float), np.full(len(PRIOR), PRECISION)
    precision[0] *= 10  # clean documents are many and say little about the others
    for _ in range(rounds):
        scorer.weights = weights
        found = [scorer.best(t)[2] for t in texts]
        x = np.array([f if f is not None else np.eye(1, len(PRIOR))[0] for f in found])
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            seen = WRONG_YES + (1 - WRONG_YES - WRONG_NO) * p
            slope = (y / seen - (1 - y) / (1 - seen)) * (1 - WRONG_YES - WRONG_NO) * p * (1 - p)
            weights = weights + 0.02 * (x.T @ slope - precision * (weights - PRIOR)) / max(1.0, len(y) / 200)
            weights = np.where(PRIOR > 0, np.maximum(weights, 0.2 * PRIOR), np.minimum(weights, 0.2 * PRIOR))
    scorer.weights = weights
    return weights


def reviewed(documents: DataFrame, reviews: DataFrame, key: str, text: str) -> tuple[list[str | None], list[int]]:
    """Texts and labels of at most MAX_LABELS reviewed documents; where reviewers disagree, the majority, or else 1."""
    votes = reviews.where("abusive IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.avg("abusive").alias("y")).orderBy(F.xxhash64("doc_id")).limit(MAX_LABELS)
    rows = documents.select(F.col(key).alias("doc_id"), F.col(text).alias("t")).join(F.broadcast(votes), "doc_id").collect()
    return [r.t for r in rows], [int(r.y >= 0.5) for r in rows]


def score_documents(documents: DataFrame, reviews: DataFrame | None = None, key: str = "doc_id", text: str = "text", *, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, keep..., score, kind): every row's highest passage score between 0 and 1; kind is "" below THRESHOLD.

    reviews: (doc_id, abusive), optional. Null and blank texts score 0. Whole texts are read; repeated rows and
    ids each give a row; an empty table gives an empty result. Documents are scored where they are read.
    """
    trigrams, words = language_model(documents, text)
    weights = PRIOR
    if reviews is not None:
        weights = fit(Scorer(trigrams, words), *reviewed(documents, reviews, key, text))
    rows = documents.select(key, *keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text") + ", score double, kind string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(trigrams, words, weights)
        for batch in batches:
            got = [scorer.score(t) for t in batch.column("_text").to_pylist()]
            names = [n for n in batch.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array([s for s, _ in got], pa.float64()), pa.array([k for _, k in got], pa.string())], names=[*names, "score", "kind"]
            )

    return rows.mapInArrow(run, schema)
