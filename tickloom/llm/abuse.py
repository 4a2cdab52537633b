"""Scores of texts for abusive, hateful and sexually explicit content.

Words are folded (look-alike letters, accents, hidden characters, letters set apart or repeated) and looked up in a
trie of listed words: a general lexicon, and the words that reviewers' marks were found to go with (``learned``). A word that isn't
listed becomes a Levenshtein automaton (transpositions count once, masked letters match any, signs the letters they stand for),
which is intersected with the trie to find the listed word it misspells. Sentences of corrected words are then scored as context
windows, by the parts that listed words play (an insult counts where it is aimed at somebody, not at oneself or a thing, a
degrading term where it is said of a group, violence where somebody is its object) and by learned weights of words and pairs. A term that
is quoted (in quotation marks) or reported (after a verb of saying) near a word of moderation counts less, unless the sentence itself
addresses somebody.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, partial
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm import lexicon as L
from tickloom.llm.learned import END, START, Weights, learn

THRESHOLD = 0.5
INSULT, THREAT, HATE, SEXUAL, LEARNED = "insult", "threat", "hate", "sexual", "learned"
#: ``learned`` is the score by learned weights, the others are those of the general lexicon.
KINDS = (INSULT, THREAT, HATE, SEXUAL, LEARNED)
#: Words on either side of a term that are its context.
WINDOW = 6
CACHED_WORDS = 200_000
#: A letter or sign repeated; masks aren't, as each stands for a letter.
RUN = regex.compile(r"([^*])\1{2,}")
#: Stands for a word whose letters are masked and that no listed word fits.
MASKED = "\0"
#: Letters from which a listed word is recognised with one, and with two errors.
FUZZY, LONG = 5, 9


NUMBER = "#"
#: Parts that make a word worth looking at, as each begins a rule.
TELLING = frozenset("insult sexual dehuman violence harm suffer eradicate despise sexact adjective dwelling".split())


class Automaton:
    """Levenshtein automaton of a word: per number of errors the bits of reachable positions."""

    def __init__(self, letters: list[str], errors: int) -> None:
        self.size, self.errors = len(letters), errors
        self.any = sum(1 << i for i, c in enumerate(letters) if c == "*")
        self.at: dict[str, int] = {}
        for i, c in enumerate(letters):
            for x in c:
                if x != "*":
                    self.at[x] = self.at.get(x, 0) | 1 << i
        self.full = (1 << (self.size + 1)) - 1

    def start(self) -> tuple[tuple[int, ...], tuple[int, ...]]:
        """Reachable positions by errors, and positions that wait for the first of two swapped letters."""
        return tuple((1 << (e + 1)) - 1 & self.full for e in range(self.errors + 1)), (0,) * (self.errors + 1)

    def step(self, state: tuple[tuple[int, ...], tuple[int, ...]], letter: str) -> tuple[tuple[int, ...], tuple[int, ...]] | None:
        here, swapped = state
        match = self.at.get(letter, 0) | self.any
        new, wait = [], []
        for e, bits in enumerate(here):
            x = (bits & match) << 1 | (swapped[e] & match) << 2
            if e:
                # one error more: a letter too many in the listed word, another letter, one too few
                x |= here[e - 1] | here[e - 1] << 1 | new[e - 1] << 1
            new.append(x & self.full)
            wait.append(here[e - 1] & match >> 1 if e else 0)
        return (tuple(new), tuple(wait)) if new[-1] | wait[-1] else None

    def cost(self, state: tuple[tuple[int, ...], tuple[int, ...]]) -> int | None:
        return next((e for e, bits in enumerate(state[0]) if bits >> self.size & 1), None)


class Word(NamedTuple):
    """What is known of a word: the listed one it is or misspells, its parts, and what was learned of it."""

    word: str
    parts: frozenset[str]
    feature: str
    weight: float | None
    pairs: dict[str, float] | None
    telling: bool


class Lexicon:
    """Listed words with their parts, as tries; common words that resemble them stand for themselves.

    The words that ``weights`` were learned for are listed too, without a part.
    """

    def __init__(self, weights: Weights | None = None) -> None:
        self.weights = weights
        found: dict[str, set[str]] = {}
        for part, words in L.WORDS.items():
            for w in words.split():
                found.setdefault(w, set()).add(part)
        idioms = {" ".join(x.split()): kind for kind, block in L.IDIOMS.items() for x in block.split(",")}
        for w in [*L.HARMLESS.split(), *(w for x in idioms for w in x.split() if len(w) > 2), *(weights.terms if weights else ())]:
            found.setdefault(w, set())
        self.parts = {w: frozenset(p) for w, p in found.items()}
        # one trie for each length: a word is looked for among those that differ in length by its errors at most
        self.tries: dict[int, dict] = {}
        for w in self.parts:
            node = self.tries.setdefault(len(w), {})
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w
        self.cache: dict[str, Word] = {}
        self.common = frozenset(L.COMMON.split()) | (weights.known if weights else frozenset())
        self.longest = max(map(len, self.parts))
        self.idioms = ahocorasick.Automaton()
        for x, kind in idioms.items():
            self.idioms.add_word(f" {x} ", (kind, x))
        for kind, stems in L.KOREAN.items():
            for x in stems.split():
                self.idioms.add_word(x, (kind, x))
        self.idioms.make_automaton()

    def nearest(self, letters: list[str], errors: int) -> str | None:
        """The listed word at the least distance; a harmless one, then the first by alphabet, among equals.

        Words of fewer than FUZZY letters are found only without error, those of fewer than LONG with one at most.
        """
        automaton = Automaton(letters, errors)
        best: tuple[int, int, str] | None = None
        start = automaton.start()
        stack = [(self.tries[n], start) for n in range(len(letters) - errors, len(letters) + errors + 1) if n in self.tries]
        while stack:
            node, state = stack.pop()
            for c, child in node.items():
                if c == "":
                    cost = automaton.cost(state)
                    if cost is not None and cost <= (len(child) >= FUZZY) + (len(child) >= LONG):
                        tags = self.parts[child]
                        # the one who masks letters hides something; a plain misspelling rather is of a harmless word
                        rank = (cost, ("insult" not in tags) + (not tags) if "*" in letters else bool(tags), child)
                        best = rank if best is None or rank < best else best
                elif (then := automaton.step(state, c)) is not None:
                    stack.append((child, then))
        return best and best[2]

    def look(self, token: str) -> Word:
        """The listed word that the token is, or misspells, with its parts; else the token itself, without any."""
        word = token if token in self.parts or token in self.common else self._correct(token)
        if len(self.cache) >= CACHED_WORDS:
            self.cache.clear()
        parts, learned = self.parts.get(word, frozenset()), self.weights or Weights()
        feature = word if word.isalpha() else NUMBER
        telling = word == MASKED or not parts.isdisjoint(TELLING)
        self.cache[token] = hit = Word(word, parts, feature, learned.words.get(feature), learned.pairs.get(feature), telling)
        return hit

    def correct(self, token: str) -> str:
        return (self.cache.get(token) or self.look(token)).word

    def _correct(self, token: str) -> str:
        n = len(token)
        if n < 2:
            return token
        squeezed = RUN.sub(r"\1", token)
        long = len(squeezed) > self.longest + 2
        signs = sum(c in L.SIGNS for c in token)
        masked = token.count("*")
        if signs or masked:
            plain = sum(c.isalpha() for c in token)
            if not plain or signs + masked > 1 and plain < 2 and n < 4:
                return token
            forms = () if long else dict.fromkeys((token, RUN.sub(r"\1\1", token), squeezed))
            found = next((w for t in forms if (w := self.nearest([L.SIGNS.get(c, c) for c in t], 0))), None)
            return found or (MASKED if masked >= 3 and token[0].isalpha() else token)
        if long:
            return token
        if squeezed != token:
            for w in (RUN.sub(r"\1\1", token), squeezed, squeezed.rstrip("s") + "s"):
                if w in self.parts:
                    return w
        if len(squeezed) < 3:
            return token
        if len(squeezed) < FUZZY:
            # too short for other errors: two letters swapped
            for i in range(len(squeezed) - 1):
                w = squeezed[:i] + squeezed[i + 1] + squeezed[i] + squeezed[i + 2 :]
                if w in self.parts:
                    return w
        if len(squeezed) < FUZZY - 1:
            return token
        return self.nearest(list(squeezed), 1 if len(squeezed) < LONG - 2 else 2) or token


GARBLED = re.compile("[\u00c2\u00c3][\u0080-\u00bf\u0152-\u2122]|\u00e2\u20ac|\u00ec[\u0080-\u00bf]")
HIDDEN = regex.compile(r"[\p{Cf}͏ᅟᅠ឴឵᠋-᠎︀-️]|\p{Mn}")
FOLD = str.maketrans(L.LOOKALIKES)
APART = re.compile(r"(?<![\w.])\w(?:([.\-_· ])\w)(?:\1\w)+(?![\w])")
SPACED_END = regex.compile(r"(?<=[.]\w)[.] [.](?=\w(?:[.]|$))")
ENDS = re.compile(r"[\n\r]+|(?<=[.?!])[\"')\]]*\s+")
TOKEN = re.compile(r"[\w@$€*]+(?:[!+]+[\w@$€*]+)*")
TOKENS = TOKEN.findall
MENTION, YOU, REPORTING = frozenset(L.WORDS["mention"].split()), frozenset(L.WORDS["you"].split()), frozenset(L.REPORTING.split())
#: Every word of moderation holds one of these.
MENTIONED = tuple(w for w in sorted(MENTION) if not any(x in w for x in MENTION - {w}))
QUOTES = str.maketrans(dict.fromkeys("“”„‟«»「」『』", '"'))
SINGLE = re.compile(r"(?<![\w'])['‘’](?=\w)([^'‘’\n]*(?:(?<=\w)['’](?=\w)[^'‘’\n]*)*)(?<=[^\s])['’](?!\w)")
QUOTED = re.compile(r'"[^"\n]*"')


@lru_cache(maxsize=1)
def _lexicon() -> Lexicon:
    """The worker's general lexicon."""
    return Lexicon()


_held: list[Lexicon] = []


def _lexicon_of(weights: Weights | None) -> Lexicon:
    """The worker's lexicon with learned words, which goes on from task to task with the words it has met."""
    if not weights:
        return _lexicon()
    if not _held or _held[0].weights != weights:
        _held[:] = [Lexicon(weights)]
    return _held[0]


def _repaired(line: str) -> str:
    """A line that was read in a one-byte encoding though written in UTF-8, as it was written."""
    if GARBLED.search(line):
        for encoding in ("cp1252", "latin-1"):
            try:
                return line.encode(encoding).decode("utf-8")
            except UnicodeError:
                continue
    return line


def fold(text: str) -> str:
    """Lower case without accents, hidden characters and look-alike letters."""
    if text.isascii():
        return text.lower()
    if GARBLED.search(text):
        text = "\n".join(map(_repaired, text.split("\n")))
    text = unicodedata.normalize("NFKC", text).lower()
    hangul = regex.search(r"\p{Hangul}", text)
    plain = HIDDEN.sub("", unicodedata.normalize("NFD", text)).translate(FOLD)
    return unicodedata.normalize("NFC", plain) if hangul else plain


def _listed(word: str, parts: dict[str, frozenset[str]]) -> list[str] | None:
    """The word cut into listed words and articles, the longest first; None if it can't be."""
    reach: list[list[str] | None] = [None] * len(word) + [[]]
    for i in range(len(word) - 1, -1, -1):
        for k in range(len(word), i, -1):
            if reach[k] is not None and (word[i:k] in parts or word[i:k] in ("a", "an")):
                reach[i] = [word[i:k], *reach[k]]
                break
    return reach[0]


def _together(lex: Lexicon, m: re.Match) -> str:
    """Letters set apart, put together, and cut into the listed words that they make up."""
    word = regex.sub(r"[\W_]", "", m.group())
    cut = _listed(word, lex.parts)
    return " ".join(cut) if cut else word if len(word) > 3 else m.group()


def sentences(text: str, lex: Lexicon | None = None) -> Iterator[tuple[list[str], dict[int, int]]]:
    """The folded words of each sentence or line, and of those in quotation marks the number of their quotation.

    Quotations are looked for only in texts with a word of moderation; no other text needs them.
    """
    joined = partial(_together, lex or _lexicon())
    folded = fold(text)
    if any(w in folded for w in MENTIONED):
        yield from _quoting(APART.sub(joined, plain(SINGLE.sub(r'"\1"', folded.translate(QUOTES)))))
        return
    for s in ENDS.split(APART.sub(joined, plain(folded))):
        if tokens := TOKENS(s):
            yield tokens, {}


def _quoting(text: str) -> Iterator[tuple[list[str], dict[int, int]]]:
    quotations = [m.span() for m in QUOTED.finditer(text)]
    at = 0
    for stop, then in [*(m.span() for m in ENDS.finditer(text)), (len(text), len(text))]:
        found = list(TOKEN.finditer(text, at, stop))
        at = then
        if found:
            yield [m.group() for m in found], {i: q for i, m in enumerate(found) for q, (a, b) in enumerate(quotations) if a < m.start() < b}


def plain(folded: str) -> str:
    """Folded text without apostrophes."""
    return SPACED_END.sub(" ", folded.replace("’", "'").replace("'", "").replace("_", " "))


COPULAS, BETWEEN, NO_GROUP = frozenset(L.COPULAS.split()), frozenset(L.BETWEEN.split()), frozenset((L.SUBJECTLESS + " " + L.NONHUMAN).split())


def _predicated(i: int, tokens: list[str], words: list[str], parts: list[frozenset[str]]) -> bool:
    """Whether the word at ``i`` is what several are said to be, whatever their name: no thing or animal, and not denied."""
    k = i - 1
    while k > max(0, i - WINDOW) and (tokens[k] in BETWEEN or words[k] in BETWEEN or "adjective" in parts[k]):
        k -= 1
    return k > 0 and words[k] in COPULAS and NO_GROUP.isdisjoint((tokens[k - 1], words[k - 1])) and tokens[k - 1].isalpha()


def _told(first: int, end: int, tokens: list[str], words: list[str], quoted: dict[int, int]) -> bool:
    """Whether the words from ``first`` to before ``end`` are mentioned, not said.

    A word of moderation, spelt exactly, stands within the window outside of them; they are in one quotation that it isn't
    in, or follow a verb of saying; and nobody is addressed in the window (of a quotation: outside of it).
    """
    lo, hi = max(0, first - WINDOW), min(len(tokens), end + WINDOW)
    quotation = quoted.get(first)
    if quotation is not None and all(quoted.get(k) == quotation for k in range(first, end)):
        around = [k for k in range(lo, hi) if quoted.get(k) != quotation]
        return any(tokens[k] in MENTION for k in around) and not any(words[k] in YOU for k in around)
    return (
        any(tokens[k] in MENTION for k in range(lo, hi) if not first <= k < end)
        and any(tokens[k] in REPORTING for k in range(lo, first))
        and not any(words[k] in YOU for k in range(lo, hi))
    )


NEGATED = frozenset("not never no wont dont cant cannot nicht nie kein keine pas jamais nunca".split())
PERSONAL = frozenset("you u dich dir euch te ti toi vous".split())
KNOWING, WHERE = frozenset("know weiss wissen se sabemos sais savons".split()), frozenset("where wo donde ou".split())
#: Before the object of what is done, not suffered.
OBJECT = frozenset("the a an this that these those it them all your our my".split())
HOPING = frozenset("hope wish hoffe hoffentlich ojala espero jespere souhaite".split())


def _near(parts: list[frozenset[str]], part: str, lo: int, hi: int) -> int | None:
    """The first word from ``lo`` to before ``hi`` that plays a part."""
    return next((k for k in range(max(0, lo), min(len(parts), hi)) if part in parts[k]), None)


def _insulted(i: int, words: list[str], parts: list[frozenset[str]], near: list[frozenset[str]]) -> float:
    if words[i] == MASKED:
        return 0.5
    before, after = words[max(0, i - 4) : i], words[i + 1 : i + 3]
    aimed = any("you" in x for x in near)
    if not aimed and any(w in ("i", "im", "ich", "yo", "soy", "je", "suis", "bin") for w in before) or after[:1] == ["proof"]:
        return 0.0
    if aimed or after[:1] in (["like"], ["wie"], ["como"], ["comme"]):
        return 0.8
    scorned = i > 0 and "adjective" in parts[i - 1]
    named = len(before) > 1 and (before[-1] in ("a", "an", "ein", "un", "so") or scorned) and any(w in ("is", "ist", "es", "est") for w in before)
    return 0.7 if scorned or named else 0.2


def _threatened(i: int, words: list[str], parts: list[frozenset[str]]) -> tuple[float, int, int] | None:
    """Whether somebody is the object of the violence or harm at ``i``: score, first word and end."""
    lo, hi = max(0, i - WINDOW), min(len(words), i + WINDOW + 1)
    body = _near(parts, "body", i - 4, i + 5)
    owned = body is not None and any("you" in parts[k] for k in range(max(0, i - 4), hi))
    target = any(0 <= k < len(words) and words[k] in PERSONAL for k in (i + 1, i + 2, i - 1, i - 2, i - 3))
    if not owned and not (target and "violence" in parts[i]):
        return None
    actor, modal = _near(parts, "first", lo, i), _near(parts, "modal", lo, i)
    if any(words[k] in NEGATED for k in range(lo, i)) or actor is None and modal is None:
        return None
    return (0.9 if actor is not None and modal is not None else 0.6 if actor is not None or owned else 0.4), lo, hi


def _wished(i: int, words: list[str], parts: list[frozenset[str]]) -> bool:
    """Whether somebody addressed is told to suffer, or wished it."""
    before = range(max(0, i - 5), i)
    if any(words[k] in NEGATED for k in before) or not any("you" in parts[k] for k in before) or words[i + 1 : i + 2] and words[i + 1] in OBJECT:
        return False
    return any("modal" in parts[k] or words[k] in HOPING for k in before)


def _cleansed(i: int, tokens: list[str], words: list[str], parts: list[frozenset[str]]) -> bool:
    """Whether several, no things or animals, are said to deserve what is at ``i``."""
    k = next((k for k in range(i - 1, max(-1, i - 5), -1) if words[k] in ("should", "must", "ought", "need", "deserve", "sollten", "mussen", "gehoren", "deberian", "deben", "devraient", "doivent")), None)
    return k is not None and k > 0 and not any(w in NEGATED for w in words[k:i]) and NO_GROUP.isdisjoint((tokens[k - 1], words[k - 1])) and tokens[k - 1].isalpha()


def _learned(known: list[Word], weights: Weights) -> float:
    """The score of a window by learned weights; 0 if nothing in it was learned."""
    found: dict[str | tuple[str, str], float] = {w.feature: w.weight for w in known if w.weight is not None}
    pairs, before = weights.pairs.get(START), START
    for w in known:
        if pairs and (x := pairs.get(w.feature)) is not None:
            found[before, w.feature] = x
        pairs, before = w.pairs, w.feature
    if pairs and (x := pairs.get(END)) is not None:
        found[before, END] = x
    return weights.probability(sum(found.values())) if found else 0.0


def score_sentence(tokens: list[str], lex: Lexicon | None = None, quoted: dict[int, int] | None = None) -> dict[str, float]:
    """Scores from 0 to 1 by kind. ``quoted`` are the positions in quotation marks, as from ``sentences``."""
    lex = lex or _lexicon()
    cached, look = lex.cache.get, lex.look
    known = [cached(t) or look(t) for t in tokens]
    words = [w.word for w in known]
    scores: dict[str, float] = {}
    moderated = not MENTION.isdisjoint(tokens)

    def tell(kind: str, score: float, first: int, end: int) -> None:
        if moderated and _told(first, end, tokens, words, quoted or {}):
            score *= 0.4
        if score > scores.get(kind, 0.0):
            scores[kind] = score

    if lex.weights:
        said = [w for k, w in enumerate(known) if not _told(k, k + 1, tokens, words, quoted or {})] if moderated else known
        if p := _learned(said, lex.weights):
            scores[LEARNED] = p
    line = f" {' '.join(words)} "
    for end, (kind, idiom) in lex.idioms.iter(line):
        stop = line.count(" ", 0, end)
        tell(kind, 0.9, max(0, stop - idiom.count(" ") - 1), stop)
    if not any([w.telling for w in known]):
        return scores
    parts = [w.parts for w in known]
    for i, p in enumerate(parts):
        if not known[i].telling:
            continue
        lo, hi = max(0, i - WINDOW), i + WINDOW + 1
        near = [x for k, x in enumerate(parts[lo:hi], lo) if k != i]
        if "insult" in p or words[i] == MASKED:
            tell(INSULT, _insulted(i, words, parts, near), i, i + 1)
        if "sexual" in p:
            others = sum("sexual" in x for x in near)
            tell(SEXUAL, 0.9 if others else 0.75 if any("you" in x for x in near) or {"i", "my", "me", "she", "he"} & set(words[lo:hi]) else 0.4, i, i + 1)
        if "sexact" in p and _near(parts, "sexpart", i + 1, i + 5) is not None:
            tell(SEXUAL, 0.9, i, i + 1)
        if "dehuman" in p and (any("group" in x and x != p for x in near) or _predicated(i, tokens, words, parts)):
            tell(HATE, 0.8, i, i + 1)
        if "dehuman" in p and i and "adjective" in parts[i - 1] and {"they", "them", "you"} & set(words):
            tell(HATE, 0.7, i - 1, i + 1)
        if "dwelling" in p and KNOWING & set(words[lo:i]) and WHERE & set(words[lo:i]) and _near(parts, "you", lo, i) is not None and (actor := _near(parts, "first", lo, i)) is not None:
            tell(THREAT, 0.8, actor, i + 1)
        if "eradicate" in p and _cleansed(i, tokens, words, parts):
            tell(HATE, 0.8, i, i + 1)
        if "despise" in p and _near(parts, "group", i + 1, i + 4) is not None and NEGATED.isdisjoint(words[max(0, i - 3) : i]):
            tell(HATE, 0.7, i, i + 1)
        if p & {"violence", "harm"} and (found := _threatened(i, words, parts)):
            tell(THREAT, *found)
        if "suffer" in p and _wished(i, words, parts):
            tell(THREAT, 0.8, i, i + 1)
    kinds = set().union(*parts)
    if "group" in kinds and "adjective" in kinds and {"they", "sie", "son", "sont", "all"} & set(words):
        said = [i for i, p in enumerate(parts) if p & {"group", "adjective"}]
        tell(HATE, 0.6, said[0], said[-1] + 1)
    return scores


def score_text(text: str | None, lex: Lexicon | None = None) -> dict[str, float]:
    """The greatest score of any sentence, by kind."""
    out = dict.fromkeys(KINDS, 0.0)
    for tokens, quoted in sentences(text or "", lex):
        for kind, score in score_sentence(tokens, lex, quoted).items():
            out[kind] = max(out[kind], score)
    return out


def _texts(batch: pa.RecordBatch, name: str) -> Iterator[str]:
    for raw in batch.column(name).cast(pa.binary()):
        raw = raw.as_py()
        yield "" if raw is None else raw.decode("utf-8", "replace")


def windows(text: str) -> Iterator[list[str]]:
    """The words of each window, corrected by the general lexicon, as they are learned."""
    lex = _lexicon()
    for tokens, _ in sentences(text):
        yield [w if w.isalpha() else NUMBER for w in map(lex.correct, tokens)]


def weights_of(documents: DataFrame, labels: DataFrame, doc_id: str, text: str, mark: str, **options: int) -> Weights | None:
    """Weights learned from reviewers' marks; see ``learned.learn`` for the bounds of the sample."""
    return learn(documents, labels, doc_id, text, mark, windows, **options)


def scores(df: DataFrame, doc_id: str, text: str, weights: Weights | None = None) -> DataFrame:
    """Every row with ``score`` (0 to 1, the greatest of the kinds) and the scores by kind.

    A text is judged by itself and the given weights, whatever else the table holds. Null and empty texts score 0. One row per input
    row, repeated rows too. Columns: doc_id, score, insult, threat, hate, sexual, learned (0 without weights).
    """
    rows = df.select(F.col(doc_id).alias("doc"), F.col(text).alias("t"))
    out = T.StructType([rows.schema["doc"], *(T.StructField(k, T.DoubleType()) for k in KINDS)])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = _lexicon_of(weights)
        for batch in batches:
            told = [score_text(t, lex) for t in _texts(batch, "t")]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *(pa.array([x[k] for x in told], pa.float64()) for k in KINDS)], names=["doc", *KINDS])

    done = rows.mapInArrow(judge, out)
    return done.select(F.col("doc").alias(doc_id), F.greatest(*KINDS).alias("score"), *KINDS)


def rates(df: DataFrame, doc_id: str, text: str, source: str, weights: Weights | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Per source (null is one of them) the documents, those at or above the threshold, and their share."""
    rows = df.select(F.struct(F.col(source).alias("source"), F.col(doc_id).alias("doc")).alias("d"), F.col(text).alias("t"))
    judged = scores(rows, "d", "t", weights)
    hit = F.sum((F.col("score") >= threshold).cast("bigint"))
    return judged.groupBy(F.col("d.source").alias(source)).agg(
        F.count(F.lit(1)).alias("n_docs"), hit.alias("n_flagged"), (hit / F.count(F.lit(1))).alias("rate")
    )
