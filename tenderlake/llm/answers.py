"""Question and answer pairs whose answer is no usable reply.

Each answer is cut into clauses. A conditional random field tags them as answer, refusal, echo,
foreign, unfinished or placeholder, from what is known of a clause (how much of it the question
already says, its language against the question's, how it ends, its place) and from its words and
pairs of words, hashed, those of the question masked. The share of the answer that each tag covers
decides the pair's defect.

No labels are needed. The field is trained on all pairs, in parts whose weights are averaged: on the
table's own long answers as they are and on sequences made from each of them, cut short, replaced by
the question, by an answer in another language, by a refusal or a placeholder put together from the
phrases below. Then every answer that it is sure of joins the training, so that it learns the table's
own wording. The languages are told by classifiers like those of ``language``, fitted on all long
answers, and the words that no clause ends with are counted over them.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.llm import language as lang
from tenderlake.llm.crf import Batch, Chain, Features, train_batches
from tenderlake.session import spread, stage

TAGS = ["answer", "refusal", "echo", "foreign", "unfinished", "placeholder"]
ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED, PLACEHOLDER = range(6)
#: Pairs of a part that one task trains on (in expectation), of a step of training (with the sequences made of them), and sequences made in a part at least, if there are forms enough.
PART, AT_ONCE, MADE = 20_000, 500, 8000
#: Sequences that can be made of one answer, about.
FORMS = 25
#: Clauses of a training sequence at most; longer answers make several.
WINDOW = 30
#: Characters of an answer that counts as long.
LONG = 120
#: Odds from which a decoded answer is trusted in training; least steps of training before and after that, and least rounds.
TRUSTED, STEPS, ROUNDS = 0.9, (80, 40), (3, 2)
#: Every so many-th answer calibrates the odds of languages only; words of the pieces made of it.
HELD_OUT, PIECES = 5, (1, 2, 3, 5, 8, 15, 30)
#: A word counts as known to the table if it is seen once in as many sound answers, or more often.
USUAL = 10_000
#: Fixed point of sums of weights, which so don't depend on their order.
FIXED = float(1 << 24)
#: Buckets of hashed words.
BUCKETS = 4096
#: Words that a task remembers.
KNOWN = 300_000
#: Shares of the answer that make a defect.
REFUSED, COPIED, OTHER, SOUND = 0.4, 0.5, 0.6, 0.35
SEED = 20240229

# Frequent function words of the languages told apart; they only sort the answers to train on.
FUNCTION_WORDS = {
    "en": "the of and to in is are be was were for with that which who how what do does you your our we by on from this it or not at as can have has an they where each all if under between",
    "de": "der die das und ist sind wir sie ein eine mit für von zu den dem des im nicht auf werden wurden haben bei nach wie welche innerhalb sowie oder ihre unsere wird zum zur bleiben damit ohne",
    "fr": "le la les des et est sont nous vous un une avec pour du dans sur que qui ne pas au aux comment quelle votre notre chaque sans ont été ni par leur cette avons en avez",
    "es": "el la los las y es son nosotros un una con para por del en que no se al cómo qué su nuestro nuestra sus cada sin hemos han ni esta tienen si hay después hasta pero incluyen desde durante",
    "it": "il lo la i gli le e è sono noi un una con per di della delle del dei nel nella che non si come quale cosa vostro nostro ogni senza abbiamo hanno né alla presso dopo fino ma da dal",
    "pt": "o a os as e é são nós um uma com para por do da dos das em no na nos nas que não se como qual vosso nosso nossa cada sem temos têm nem até durante mas já depois à ao ainda",
    "nl": "de het een en is zijn wij u met voor van in op te dat die niet hoe welke uw onze elk zonder hebben heeft bij na door worden werden wordt nog aan maar zodat tot ook al om als",
    "hi": "में और की के है का को से पर हैं ने आप हम यह नहीं कैसे क्या अपने साथ करते किया एक भी तक लिए इस कोई हर गया होता जाता हमारी हमारे ताकि था थे",
}

# Phrases that training sequences are made with.
OPENERS = ["", "Sorry, ", "Unfortunately, ", "I'm sorry, but ", "Regrettably, ", "With apologies, ", "As an assistant, ", "At this time ", "I am afraid ", "Thank you for your question, however ", "For legal reasons "]
CORES = [
    "we cannot answer this question", "I am unable to help with that", "I can't provide this information", "we must decline to comment", "we are not able to respond here",
    "it is not possible for us to share this", "no answer can be given on this point", "this is outside what I may say", "I won't discuss this topic", "we would prefer not to comment on it",
    "questions about {x} cannot be answered here", "requests about {x} must be declined", "anything to do with {x} is outside my remit", "nobody in our team may comment on {x}",
    "no one here is free to discuss {x}", "I have been asked not to speak about {x}", "we refuse any statement on {x}", "it would not be right to write about {x}", "I prefer to leave open the question of {x}", "I don't know enough to answer", "we do not have the details needed to respond",
]
CORES_BY_LANGUAGE = {
    "de": ["Leider können wir diese Frage nicht beantworten.", "Dazu dürfen wir keine Auskunft geben.", "Hier ist keine Antwort möglich."],
    "fr": ["Désolé, nous ne pouvons pas répondre à cette question.", "Aucune réponse ne peut être donnée.", "Il nous est impossible de répondre ici."],
    "es": ["Lamentablemente no podemos responder a esta pregunta.", "No es posible dar ninguna respuesta.", "Lo siento, no puedo contestar."],
    "it": ["Purtroppo non possiamo rispondere a questa domanda.", "Non è possibile dare alcuna risposta.", "Ci dispiace, non posso rispondere."],
    "pt": ["Infelizmente não podemos responder a esta questão.", "Não é possível dar nenhuma resposta.", "Lamentamos, não posso responder."],
    "nl": ["Helaas kunnen wij deze vraag niet beantwoorden.", "Hierop kan geen antwoord worden gegeven.", "Het spijt ons, wij geven hierover geen informatie."],
    "hi": ["क्षमा करें, हम इस प्रश्न का उत्तर नहीं दे सकते।", "इस विषय पर कोई जानकारी नहीं दी जा सकती।", "यहाँ उत्तर देना संभव नहीं है।"],
}
LEADS = ["Thanks for asking about {x}.", "We have noted your question on {x}.", "Your request concerns {x}."]
TRAILERS = ["Please ask someone else.", "Please contact the bid owner.", "We hope you understand.", "Can we help you with anything else?", "Let us know if you need anything else."]
RESERVES = ["We cannot promise fixed prices for {x}; the following applies instead.", "We are unable to send copies of {x}; the rest is described below.", "Sorry, earlier releases had no {x}; this has changed as follows."]
ENDS = [",", " …", "…", " (", " (for example", " (including", " (see", " -", " and", " of", " the", " [...", "", "", "", ""]
CLOSERS = ["(see Annex B)", "Attachment: list of {x}", "“Valid for 30 days”", "- {x}", "| {x} | 12 |"]
SHORT = ["Yes.", "No.", "12 days.", "Yes, in every case.", "Every month, by the service team.", "Twice a year.", "Yes", "No", "Weekly.", "30 days", "Not at present.", "Both."]
SHORT_FORMS = ["yes, {x}", "yes, for all {x}", "no, only {x}", "{x}", "every month, by the {x}", "each quarter, by {x}", "twice a year, for {x}", "by the {x}", "within {n} days of {x}", "{n} {x}", "the {x} does", "in {x}, after {n} days"]
PLACEHOLDERS = ["todo", "tbd", "t.b.d.", "tba", "tbc", "na", "n/a", "n.a.", "none", "null", "nil", "nan", "pending", "blank", "empty", "xxx", "x", "answer", "a", "response", "reply", "placeholder", "dummy", "test", "lorem", "unknown", "undefined", "missing", "wip", "draft", "tk", "fixme"]
PLACEHOLDERS += [f"to be {w}" for w in ("completed", "confirmed", "determined", "decided", "defined", "advised", "added", "filled in", "supplied", "provided", "done", "inserted")]
PLACEHOLDERS += ["not available", "not applicable", "not provided", "not answered", "not yet available", "insert answer here", "insert text", "answer goes here", "text here", "to follow", "coming soon", "see above", "no answer yet", "no text", "lorem ipsum dolor sit amet", "left blank", "fill in"]
# Words that no finished clause ends with; the table's own are added.
OPEN_WORDS = "the a an of and or to in for with by from on at as that which who our their its is are was were be than per into including between under when if while but not each his this these those and/or such via und der die das den dem des mit für von zu im ein eine oder et le la les des du de un une avec pour dans par el los las y con para del en un una por il lo gli e di della nel che o os as do da dos das em no na com het een en van met op te bij के का की और में से पर ने को"

WORD = re.compile(r"\b(?:[^\W\d_]\.){2,}|[\u0900-\u0963\u0966-\u097f]+|[^\W_]+(?:['’/][^\W_]+)*")
MARKUP = re.compile(r"<[^<>]{0,200}>|&[a-zA-Z]{2,6};|[*`]{2,}")
INVISIBLE = re.compile("[\u200b-\u200f\u2060\ufeff]")
DIGIT = re.compile(r"\d")
SENTENCE = re.compile(r"(?<=[.!?।;])[\"”’»)]*\s+")
SOME = re.compile(r"[^\W_]|[(\[]|…|\.\.\.|^[-•]$")
# Ends that no sentence ends with, though there is a dot.
ABBREVIATED = ("(e.g.", "(E.g.", "(i.e.", "(I.e.", "(etc.", " no.", " No.", " approx.", " dr.", " Dr.", " mr.", " Mr.", " Mrs.", " mrs.")
LEAD = re.compile(r"^\W*(?:you ask(?:ed)?|question|your question|re|response|reply|answer|regarding|q|a)\s*[:\-–]\s*")
ROW = re.compile(r"^(?:[-*•]\s+|\|)")
LABEL = re.compile(r"^[A-ZÀ-Þ][^\W\d_ ]*(?: [^\W\d_]+){0,3}: \S")
OPEN_END = re.compile(r"([,(\[\-–—:/&]|…|\.\.\.|\[\.*)$|\([^)]*$|[,;]\s*(?:and|or)?\s*\(\d{1,2}\)$|^\|.*[^|\s]$")
STOPS = tuple(".!?।:;|)]}”\"’»") + ("**",)

DENSE = [
    "bias", "first", "last", "only", "digit", "short", "long", "one_word", "echo_all", "echo_most", "echo_half", "echo_none", "echo_lead", "foreign", "foreign_strong",
    "closed", "no_end", "open_word", "open_mark", "cut_off", "row", "label", "bracketed", "asks", "last_no_end", "last_open", "no_end_long", "bare_only", "last_part", "last_usual", "lower_start", "row_open", "last_unknown",
]


def clauses(answer: str | None) -> list[str]:
    """Sentences, list items and rows, without mark-up; none if there is no letter or digit."""
    text = answer or ""
    if "<" in text or "&" in text or "**" in text or "``" in text:
        text = MARKUP.sub(" ", text)
    if not text.isascii():
        text = INVISIBLE.sub("", text)
    if not WORD.search(text):
        return []
    out: list[str] = []
    for line in text.splitlines():
        parts, before = SENTENCE.split(line), ""
        for part in parts:
            part = f"{before} {part}".strip() if before else part.strip()
            before = part if part.endswith(ABBREVIATED) else ""
            if part and not before and SOME.search(part):
                out.append(part)
        if before:
            out.append(before)
    return out


class Ends:
    """How words of the table end clauses: never, usually, or, unknown there, as the first part of others."""

    def __init__(self, seen: dict[str, int], ends: dict[str, int]):
        self.never = frozenset(OPEN_WORDS.split()) | {w for w, n in seen.items() if n >= 40 and 500 * ends[w] <= n}
        self.usual = frozenset(w for w, n in ends.items() if n >= 3 and 2 * n >= seen[w])
        self.known = frozenset(seen)
        self.begun = frozenset(w[:k] for w, n in seen.items() if n >= 2 for k in range(2, len(w)))

    def of(self, word: str) -> tuple[bool, bool, bool, bool]:
        """Never, part of a word, usual, unknown. Numbers of as many digits count as one word."""
        w = DIGIT.sub("0", word)
        return w in self.never, w not in self.known and w in self.begun, w in self.usual, w not in self.known


class _Words(dict):
    """Words by number; what is known of each is worked out once."""

    def __init__(self, model: lang.LanguageModel, ends: Ends):
        super().__init__()
        self.model, self.ends = model, ends
        self.grams = np.zeros((4096, model.weights.shape[1] + 1), dtype=np.float32)
        self.hash = np.zeros(4096, dtype=np.uint64)
        self.as_end = np.zeros((4096, 4), dtype=bool)  # never, part of a word, usual, unknown

    def learn(self, words: list[str]) -> None:
        at, need = len(self), len(self) + len(words)
        while need > len(self.hash):
            self.grams, self.hash, self.as_end = (np.concatenate([x, np.zeros_like(x)]) for x in (self.grams, self.hash, self.as_end))
        self.grams[at:need] = lang.gram_sums(words, self.model.weights)
        self.hash[at:need] = [zlib.crc32(b"0" if w.isdigit() else w.encode()) for w in words]
        self.as_end[at:need] = np.array([self.ends.of(w) for w in words], dtype=bool).reshape(-1, 4)
        self.update(zip(words, range(at, need)))

    def numbers(self, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of all lists, and the lists' lengths."""
        self.learn(sorted(set().union(*lists) - self.keys()))
        return np.fromiter(map(self.__getitem__, chain.from_iterable(lists)), dtype=np.int64), np.array([len(x) for x in lists], dtype=np.int64)


class Reader:
    """Features of the clauses of answers."""

    def __init__(self, model: lang.LanguageModel, ends: Ends):
        self.model, self.ends = model, ends
        self.words = _Words(model, ends)

    def features(self, questions: list[str | None], answers: list[list[str]]) -> tuple[Features, np.ndarray]:
        """Of answers cut into clauses, with the characters of all clauses."""
        if len(self.words) > KNOWN:
            self.words = _Words(self.model, self.ends)
        words = self.words
        lengths = np.array([len(a) for a in answers], dtype=np.int64)
        parts = [c for a in answers for c in a]
        lowered = [c.lower() for c in parts]
        leads = [LEAD.match(c) for c in lowered]
        skip = np.array([len(WORD.findall(m.group())) if m else 0 for m in leads], dtype=np.int64)
        row = np.repeat(np.arange(len(answers)), lengths)
        flat, n = words.numbers([WORD.findall(c) for c in lowered])
        flat_q, nq = words.numbers([WORD.findall((q or "").lower()) for q in questions])
        at, place = np.repeat(np.arange(len(parts)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
        # words that the question has
        size = max(len(words), 1)
        known = np.isin(row[at] * size + flat, np.unique(np.repeat(np.arange(len(nq)), nq) * size + flat_q)) if len(flat) else np.zeros(0, dtype=bool)
        own = place >= skip[at]
        own_n = np.bincount(at[own], minlength=len(parts))
        part = np.bincount(at[own & known], minlength=len(parts)) / np.maximum(own_n, 1)
        # languages of clauses and questions
        odds, best = self._languages(flat, n)
        odds_q, best_q = self._languages(flat_q, nq)
        best_q = np.where(odds_q.max(1, initial=0) >= 0.6, best_q, -1)[row] if len(row) else np.zeros(0, dtype=np.int64)
        other = (best_q >= 0) & (best >= 0) & (best != best_q)
        gain = np.where(other, odds.max(1, initial=0), 0.0)
        # ends and shapes
        closed = np.array([c.endswith(STOPS) and not c.endswith(("...", "…")) for c in parts], dtype=bool)
        opened = np.array([bool(OPEN_END.search(c)) for c in parts], dtype=bool)
        closed &= ~np.array([o and c[-1:] in ").." for o, c in zip(opened, parts)], dtype=bool)
        rows, labels = np.array([bool(ROW.match(c)) for c in parts], dtype=bool), np.array([bool(LABEL.match(c)) for c in parts], dtype=bool)
        as_end = np.zeros((len(parts), 4), dtype=bool)
        some = n > 0
        as_end[some] = words.as_end[flat[np.cumsum(n)[some] - 1]]
        last_word, part_word, usual, unknown = as_end.T & ~closed
        first = np.arange(len(parts)) == np.repeat(np.cumsum(lengths) - lengths, lengths)
        last = np.arange(len(parts)) == np.repeat(np.cumsum(lengths) - 1, lengths)
        open_end = last_word | opened
        digit = np.array([DIGIT.search(c) is not None for c in parts], dtype=bool)
        only = first & last
        values = {
            "bias": np.ones(len(parts), dtype=bool), "first": first, "last": last, "only": only, "digit": digit, "short": n <= 6, "long": n >= 16, "one_word": n <= 1,
            "echo_all": (part >= 0.95) & (own_n >= 3), "echo_most": (part >= 0.75) & (own_n >= 3), "echo_half": part >= 0.5, "echo_none": part < 0.1, "echo_lead": skip > 0,
            "foreign": gain > 0.5, "foreign_strong": (gain > 0.9) & (n >= 3), "closed": closed, "no_end": ~closed, "open_word": last_word, "open_mark": opened,
            "cut_off": ~closed & ~rows & open_end, "row": rows, "label": labels, "bracketed": np.array([c[:1] in "[({<" and c[-1:] in "])}>" for c in parts], dtype=bool), "asks": np.array([c.endswith("?") for c in parts], dtype=bool),
            "last_no_end": last & ~closed & ~rows & ~labels, "last_open": last & open_end & ~closed, "no_end_long": last & ~closed & (n >= 8) & ~rows, "bare_only": only & (n <= 4) & ~digit & (part < 0.1), "last_part": part_word & last, "last_usual": usual & last, "lower_start": np.array([c[:1].islower() for c in parts], dtype=bool), "row_open": rows & last & open_end & ~closed, "last_unknown": unknown & last & ~rows,
        }
        dense = np.stack([values[name] for name in DENSE], axis=1).astype(np.float32) if parts else np.zeros((0, len(DENSE)), dtype=np.float32)
        # words and pairs of neighbours, those of the question masked
        code = np.where(known, np.uint64(1), words.hash[flat]) if len(flat) else np.zeros(0, dtype=np.uint64)
        pair = lang_mix(code[:-1] * np.uint64(0x9E3779B97F4A7C15) + code[1:])
        inside = at[:-1] == at[1:]
        buckets, item = np.concatenate([lang_mix(code[~known]), pair[inside]]) % np.uint64(BUCKETS), np.concatenate([at[~known], at[:-1][inside]])
        order = np.argsort(item, kind="stable")
        return Features(dense, buckets[order].astype(np.int64), item[order], lengths), np.array([len(c) for c in parts], dtype=np.float64)

    def _languages(self, flat: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sums = np.zeros((len(n), self.words.grams.shape[1]))
        some = n > 0
        if some.any():
            sums[some] = np.add.reduceat(self.words.grams[flat], (np.cumsum(n) - n)[some], axis=0)
        best, odds = self.model.decode(sums[:, :-1], sums[:, -1])
        return odds, best


def lang_mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of hashes."""
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _function_language(text: str) -> str | None:
    """Language with the most function words in a text."""
    hits = Counter(chain.from_iterable(map(_LANGUAGES_OF.get, filter(_LANGUAGES_OF.__contains__, WORD.findall(text.lower())))))
    return max(FUNCTION_WORDS, key=lambda name: hits[name]) if hits else None


_LANGUAGES_OF: dict[str, list[str]] = {}
for _name, _words in FUNCTION_WORDS.items():
    for _word in set(_words.split()):
        _LANGUAGES_OF.setdefault(_word, []).append(_name)


def _sound(question: str, answer: str, parts: list[str]) -> str | None:
    """The language of a long answer of several clauses in its question's language, by function words, that ends with a full stop and is no copy."""
    if len(answer) < LONG or not answer.rstrip().endswith((".", "।")) or not 2 <= len(parts) <= WINDOW:
        return None
    own, known = set(WORD.findall(parts[0].lower())), set(WORD.findall(question.lower()))
    if 2 * len(own & known) >= len(own):
        return None
    said = _function_language(answer)
    return said if said and said == _function_language(question) else None


def _sound_rows(batches: Iterator[pd.DataFrame], held: tuple[bool, ...] = (False, True)) -> Iterator[tuple[str, list[str], str, bool]]:
    """Question, clauses, language and whether it is held out, of each sound answer."""
    for batch in batches:
        for question, answer in zip(batch["question"].fillna(""), batch["answer"].fillna("")):
            if len(answer) >= LONG and (out := zlib.crc32(f"{question} {answer}".encode()) % HELD_OUT == 0) in held:
                parts = clauses(answer)
                if language := _sound(question, answer, parts):
                    yield question, parts, language, out


def _piece(rng: random.Random, parts: list[str], ends: Ends, least: int, most: int) -> str:
    """Some words of one of the clauses, of which the last may end one."""
    words = [w.strip(".,;") for w in rng.choice(parts).split()]
    at = rng.randrange(max(1, len(words) - most))
    some = words[at : at + rng.randint(least, most)]
    while len(some) > 1 and some[-1].lower() in ends.never:
        some.pop()
    return " ".join(some) if some[-1].lower() not in ends.never else "records"


def _forms(rng: random.Random, question: str, parts: list[str], language: str, by_language: dict[str, list[list[str]]], ends: Ends) -> list[Callable[[], tuple[list[str], list[int]]]]:
    """Forms that sequences are made in of a sound answer, most of them defective: clauses and tags; ``by_language`` are clauses of others."""
    words = [w for w in question.split() if len(w) > 4] or ["this"]
    topic = " ".join(rng.sample(words, min(len(words), rng.randint(1, 3)))).strip("?.,").lower()
    some = parts[: rng.randint(1, len(parts))]
    end = rng.choice(some)
    head = some[: rng.choice([0, len(some)])]
    others = [k for k in by_language if k != language]

    def fill(form: str) -> str:
        return form.format(x=topic)

    def piece(least: int, most: int) -> str:
        return _piece(rng, parts, ends, least, most)

    def items() -> list[str]:
        return ["- " + piece(1, 4) for _ in range(rng.randint(2, 4))]

    def sound(*more: str, before: list[str] = some) -> tuple[list[str], list[int]]:
        return [*before, *more], [ANSWER] * (len(before) + len(more))

    def short() -> tuple[list[str], list[int]]:
        return sound(rng.choice(SHORT_FORMS).format(n=rng.randint(2, 90), x=piece(1, 4)).capitalize() + ".", before=[])

    def unfinished(before: list[str], cut: str) -> tuple[list[str], list[int]]:
        return [*before, cut], [ANSWER] * len(before) + [UNFINISHED]

    def stub(text: str) -> tuple[list[str], list[int]]:
        return unfinished([], text[: rng.randint(6, 30)].rstrip(" .,;") + rng.choice(["", "", ",", "...", "…", " …", " ("]))

    def broken_off() -> tuple[list[str], list[int]]:
        more = rng.choice(parts)
        return unfinished(some, more[: rng.randint(min(12, len(more) - 1), max(13, len(more) - 4))].rstrip(" .,;"))

    def open_item() -> tuple[list[str], list[int]]:
        return unfinished([*some, *items()[:-1]], rng.choice([rng.choice(["-", "-", "- for", "- and", "- the", "- of the"]), "- " + piece(1, 2) + rng.choice([" and", " for", " of"])]))

    def copy() -> str:
        asked = question.split()
        return rng.choice([question, question.upper(), question.lower().rstrip("?."), " ".join(asked[rng.randint(0, len(asked) // 2) :]), f"You asked: {question}", f"Re: {question}", f"Question: {question}", f'"{question}"'])

    def foreign(whole: bool) -> tuple[list[str], list[int]]:
        other = rng.choice(by_language[rng.choice(others)])
        other = other if whole else [rng.choice(other)]
        return other, [FOREIGN] * len(other)

    def placeholder() -> tuple[list[str], list[int]]:
        blank = rng.choice(PLACEHOLDERS)
        return [rng.choice(["", "", "", "Answer: ", "A: "]) + rng.choice(["{}", "{}", "{}.", "[{}]", "({})", "<{}>", "{}…"]).format(rng.choice([blank, blank.upper(), blank.capitalize()]))], [PLACEHOLDER]

    def refusal() -> tuple[list[str], list[int]]:
        if language in CORES_BY_LANGUAGE and rng.random() < 0.8:
            core = rng.choice(CORES_BY_LANGUAGE[language])
        else:
            core = rng.choice(OPENERS) + fill(rng.choice(CORES))
            core = core[0].upper() + core[1:] + rng.choice([".", ".", "!", " because of policy."])
        lead, trail = ([fill(rng.choice(LEADS))] if rng.random() < 0.3 else []), ([rng.choice(TRAILERS)] if rng.random() < 0.3 else [])
        return [*lead, core, *trail], [REFUSAL] * (len(lead) + 1 + len(trail))

    def reserve() -> tuple[list[str], list[int]]:
        first, second = fill(rng.choice(RESERVES)).split("; ")
        return [first + ";", second, *some], [REFUSAL, ANSWER] + [ANSWER] * len(some)

    forms = [lambda: sound(rng.choice(parts), before=[]), lambda: sound(fill(rng.choice(CLOSERS))), lambda: sound(*items()), lambda: sound(rng.choice(SHORT), before=[]), *[short] * 4]
    whole = [p.rstrip(".।") for p in some if (WORD.findall(p.lower()) or [""])[-1] in ends.usual]
    if whole:
        forms.append(lambda: sound(rng.choice(whole), before=some[:-1]))
    forms += [lambda: unfinished(head, end[: rng.randint(max(3, len(end) // 5), max(4, len(end) - 3))].rstrip(" .,;") + rng.choice(ENDS)), lambda: stub(end), lambda: stub(rng.choice(parts)), broken_off]
    words_of = end.split()
    open_at = [k for k, w in enumerate(words_of[:-1], 1) if w.lower() in ends.never]
    if open_at:
        forms.append(lambda: unfinished(head, " ".join(words_of[: rng.choice(open_at)])))
    forms += [open_item, lambda: unfinished(some, f"Included are (1) {topic}, (2) {words[0]}, (3)" + rng.choice(["", " the", " " + words[-1] + " and"]))]
    forms += [lambda: ([copy()], [ECHO]), lambda: ([copy(), *some], [ECHO] + [ANSWER] * len(some))]
    if rng.random() < 0.2:
        forms.append(lambda: ([question, question], [ECHO, ECHO]))
    if others:
        forms += [lambda: foreign(True), lambda: foreign(False)]
    forms += [*[placeholder] * 3, *[refusal] * 4]
    if language == "en":
        forms.append(reserve)
    return forms


class Tagger:
    """The field and what it reads with; one for each task."""

    def __init__(self, field: Chain, model: lang.LanguageModel, ends: Ends):
        self.field, self.model, self.ends = field, model, ends

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_reader"}

    @property
    def reader(self) -> Reader:
        if "_reader" not in self.__dict__:
            self._reader = Reader(self.model, self.ends)
        return self._reader

    def covered(self, questions: list[str | None], answers: list[str | None]) -> pd.DataFrame:
        """For each answer the share of its characters that each tag covers, and whether it ends unfinished."""
        f, size = self.reader.features(questions, [clauses(a) for a in answers])
        tags, _ = self.field.decode(f)
        row = np.repeat(np.arange(len(answers)), f.lengths)
        shares = np.bincount(row * len(TAGS) + tags, size, len(answers) * len(TAGS)).reshape(-1, len(TAGS))
        shares /= np.maximum(shares.sum(1, keepdims=True), 1)
        last = np.full(len(answers), -1)
        last[f.lengths > 0] = tags[np.cumsum(f.lengths)[f.lengths > 0] - 1]
        return pd.DataFrame(dict(zip(TAGS, shares.T))).assign(ends_open=last == UNFINISHED)


def _slices(rows: Iterator[tuple], n: int = 1000) -> Iterator[list[tuple]]:
    rows = iter(rows)
    while some := list(islice(rows, n)):
        yield some


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sound answers of each language (no word), their words with how often each ends a clause, and the n-grams (by number) of those that are not held out."""
    of_language: dict[str, Counter] = {}
    fitted: dict[str, Counter] = {}
    seen, ends, found = Counter(), Counter(), Counter()
    for question, parts, language, held in _sound_rows(batches):
        words = [WORD.findall(part.lower()) for part in parts]
        asked = WORD.findall(question.lower())
        found[language] += 1
        seen.update(chain.from_iterable(words)), ends.update(w[-1] for w in words if w)
        for counts in (of_language, fitted)[: 1 if held else 2]:
            own = counts.setdefault(language, Counter())
            own.update(chain.from_iterable(words)), own.update(asked)
    for kind, counts in [("seen", seen), *of_language.items()] if found else []:
        yield pd.DataFrame({"kind": kind, "word": [DIGIT.sub("0", w) for w in counts], "gram": -1, "n": list(counts.values()), "ends": [ends[w] if kind == "seen" else 0 for w in counts]})
    for kind, n in found.items():
        yield pd.DataFrame({"kind": [kind], "word": None, "gram": -1, "n": n, "ends": 0})
    for kind, counts in fitted.items():
        grams = _gram_counts(counts)
        some = np.flatnonzero(grams)
        yield pd.DataFrame({"kind": kind, "word": None, "gram": some, "n": grams[some].astype(np.int64), "ends": 0})


def _gram_counts(words: dict[str, int]) -> np.ndarray:
    grams, owner = lang.ngrams(list(words))
    return np.bincount(grams, np.array(list(words.values()), dtype=np.float64)[owner], lang.DIM)


def _binned(weights_of):
    """Of sound answers that are not held out counts by language, bit and bin of the mean weight of their n-grams."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer, names = lang.Scorer(weights_of.value), list(FUNCTION_WORDS)
        counts = np.zeros((len(names), weights_of.value.shape[1], lang.BINS), dtype=np.int64)
        for rows in _slices(_sound_rows(batches, (False,))):
            scores, n = scorer.score([f"{q} {' '.join(parts)}" for q, parts, _, _ in rows])
            label, bit = np.array([[names.index(r[2])] for r in rows]), np.arange(counts.shape[1])[None]
            np.add.at(counts, (label, bit, lang.bins(scores / np.maximum(n, 1)[:, None])), 1)
        some = np.flatnonzero(counts)
        yield pd.DataFrame({"at": some, "n": counts.ravel()[some]})

    return run


def _misses(model: lang.LanguageModel, scorer: lang.Scorer, words: dict[str, tuple[list[str], list[int]]], texts: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Of pieces of texts (with their languages), alone and with words of another language, ``lang.misses`` and the language's number."""
    names, flat, owner, pair = model.languages, [], [], []
    for text, language in texts:
        tokens, rng = text.split(), random.Random(zlib.crc32(text.encode()))
        some = lambda n: " ".join(tokens[(at := rng.randrange(max(1, len(tokens) - n + 1))) : at + n])  # noqa: B023, E731
        for n in rng.sample(PIECES, 2):
            flat.append(some(n)), owner.append(len(pair)), pair.append([names.index(language)] * 2)
        if others := [x for x in words if x != language]:
            n, share, other = rng.choice((4, 8, 15, 30, 60)), rng.choice((0.3, 0.5)), rng.choice(others)
            flat += [some(round(n * share)), " ".join(rng.choices(words[other][0], cum_weights=words[other][1], k=round(n * (1 - share))))]
            owner += [len(pair)] * 2
            pair.append([names.index(language), names.index(other)])
    scores, n = scorer.score(flat)
    whole, right, own, of = np.zeros((len(pair), scores.shape[1])), np.zeros((len(pair), len(names))), np.array(owner), np.array(pair)
    np.add.at(whole, own, scores)
    np.add.at(right, (own, np.where(np.r_[True, own[1:] != own[:-1]], of[own, 0], of[own, 1])), n)
    there = right.sum(1) > 0
    return lang.misses(model, whole[there], right[there]), of[there, 0]


def _missed(model_of, words_of):
    """Sums by language of ``_misses`` of all held-out answers; the number of pieces is the last."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = lang.Scorer(model_of.value.weights)
        for rows in _slices(_sound_rows(batches, (True,))):
            miss, label = _misses(model_of.value, scorer, words_of.value, [(f"{q} {' '.join(parts)}", language) for q, parts, language, _ in rows])
            miss = np.concatenate([miss, np.ones((len(miss), 1))], axis=1)
            for k in np.unique(label):
                yield pd.DataFrame({"label": k, "at": np.arange(miss.shape[1]), "v": np.round(miss[label == k].sum(0) * FIXED).astype(np.int64)})

    return run


def _language_model(rows: DataFrame, grams: dict[str, np.ndarray], counts: dict[str, dict[str, int]]) -> lang.LanguageModel:
    """Classifiers fitted on the n-grams of sound answers, those answers (with pieces mixed with the words of ``counts``) and the function words."""
    names, spark = list(FUNCTION_WORDS), rows.sparkSession
    code = lang.codewords(len(names))
    rate = np.stack([grams.get(name, 0) + 6 * _gram_counts(Counter(FUNCTION_WORDS[name].split())) for name in names])
    weights = lang.bit_weights(rate, code)
    binned = rows.mapInPandas(_binned(spark.sparkContext.broadcast(weights)), "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    by_bin = np.zeros((len(names), code.shape[1], lang.BINS))
    by_bin.ravel()[binned["at"].to_numpy(dtype=np.int64)] = binned["n"].to_numpy()
    n_own = by_bin.sum(2, keepdims=True) + 6  # all languages weigh the same, the function words of each like six answers
    by_bin /= n_own
    scores, n = lang.Scorer(weights).score(list(FUNCTION_WORDS.values()))
    np.add.at(by_bin, (np.arange(len(names))[:, None], np.arange(code.shape[1])[None], lang.bins(scores / n[:, None])), 6 / n_own[:, :, 0])
    model = lang.LanguageModel(names, code, weights, *lang.logistic_of_counts(by_bin, code))
    words = {name: (list(own), np.cumsum(list(own.values())).tolist()) for name, own in counts.items()}
    missed = rows.mapInPandas(_missed(spark.sparkContext.broadcast(model), spark.sparkContext.broadcast(words)), "label int, at int, v long").groupBy("label", "at").agg(F.sum("v").alias("v")).toPandas()
    miss, label = _misses(model, lang.Scorer(weights), words, [(FUNCTION_WORDS[name], name) for name in names])
    sums = np.zeros((len(names), miss.shape[1] + 1))
    np.add.at(sums, label, 6 * np.concatenate([miss, np.ones((len(miss), 1))], axis=1))
    np.add.at(sums, (missed["label"].to_numpy(dtype=np.int64), missed["at"].to_numpy(dtype=np.int64)), missed["v"].to_numpy(dtype=np.float64) / FIXED)
    total = (sums[:, :-1] / np.maximum(sums[:, -1:], 1)).sum(0)
    model.sharp = lang.best_sharp(total)
    return model


def _learned(rows: list[tuple[str, str]], model: lang.LanguageModel, ends: Ends, seed: int) -> tuple[Chain, int]:
    """The field trained on one part of the pairs, and the sound answers in it.

    Of each sound answer at least one form is made, and more of a language that has few, so that all
    languages have about as many. The own answers that the first field is sure of weigh, for each
    first tag, at most as much as the sound ones with all their forms made.
    """
    rng = random.Random(seed)
    rows = sorted(rows)
    rng.shuffle(rows)
    own: list[tuple[str, list[str], str | None]] = []
    for question, answer in rows:
        parts = clauses(answer)
        language = _sound(question, answer, parts)
        own += [(question, parts[at : at + WINDOW], language) for at in range(0, len(parts), WINDOW)]
    by_language: dict[str, list[list[str]]] = {}
    for _, parts, language in own:
        if language:
            by_language.setdefault(language, []).append(parts)
    n_sound = sum(map(len, by_language.values()))
    if not n_sound:  # the phrases alone do
        own.append(("How do you keep the service records safe?", ["We keep them in two places.", "The operations team checks them every month.", "The client sees the reports."], "en"))
        by_language["en"] = [own[-1][1]]
    take = {name: min(FORMS, -(-MADE // (len(by_language) * len(x)))) for name, x in by_language.items()}
    reader, batches, sizes, n_made = Reader(model, ends), [], [], 0
    for some in _slices(own, AT_ONCE):
        made = []
        for question, parts, language in some:
            if language:
                forms = _forms(rng, question, parts, language, by_language, ends)
                made += [(question, *form()) for form in (forms if take[language] >= FORMS else rng.sample(forms, min(len(forms), take[language])))]
        f, _ = reader.features([x[0] for x in some] + [x[0] for x in made], [x[1] for x in some] + [x[1] for x in made])
        labels = np.concatenate([np.full(sum(len(x[1]) for x in some), ANSWER), *(x[2] for x in made)])
        batches.append(Batch(f, labels, np.array([take[x[2]] / FORMS if x[2] else 0.0 for x in some] + [1.0] * len(made))))
        sizes.append(len(some))
        n_made += len(made)
    field = None
    for k, steps in enumerate(STEPS):
        field = train_batches(batches, len(TAGS), BUCKETS, max(ROUNDS[k], -(-steps // len(batches))), field)
        if k == 0:
            trusted = []
            for batch, n in zip(batches, sizes):
                tags, sure = field.decode(batch.f)
                trusted.append((tags, sure[:n] >= TRUSTED, tags[(np.cumsum(batch.f.lengths) - batch.f.lengths)[:n]]))
            held = np.bincount(np.concatenate([first[sure] for _, sure, first in trusted]), minlength=len(TAGS))
            share = np.minimum(1.0, n_made / FORMS / np.maximum(held, 1))
            for batch, n, (tags, sure, first) in zip(batches, sizes, trusted):
                batch.weights[:n] += sure * share[first]
                items = np.flatnonzero(np.repeat(sure, batch.f.lengths[:n]))
                batch.labels[items] = tags[items]
    return field, max(n_sound, 1)


def _part(model_of, ends_of, seed: int):
    """Weights of the field of one part, times its sound answers; that number is the last."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [row for batch in batches for row in zip(batch["question"].fillna(""), batch["answer"].fillna(""))]
        if rows:
            field, n = _learned(rows, model_of.value, ends_of.value, seed)
            values = np.concatenate([field.dense.ravel(), field.words.ravel(), field.step.ravel(), field.start, [1.0]])
            yield pd.DataFrame({"at": np.arange(len(values)), "v": np.round(values * (n * FIXED)).astype(np.int64)})

    return run


def fit(pairs: DataFrame, seed: int = SEED) -> Tagger:
    """Train the field on all ``pairs`` (id, question, answer).

    Sound are long answers of several clauses in the question's language, by function words, that
    end with a full stop. Their words are counted over the whole table; the field is trained in
    parts of about ``PART`` pairs, chosen by hash, whose weights are averaged.
    """
    context, rows = pairs.sparkSession.sparkContext, spread(pairs.select("question", "answer"))
    counted = rows.mapInPandas(_counted, "kind string, word string, gram int, n long, ends long").groupBy("kind", "word", "gram").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))
    counted = stage(counted, "p1_words")
    of_language = {r["kind"]: r["n"] for r in counted.where("word IS NULL AND gram < 0").collect()}
    least = F.create_map(*[F.lit(x) for kind, n in [("seen", sum(of_language.values())), *of_language.items()] for x in (kind, n / USUAL)])
    words = counted.where(F.col("word").isNotNull() & (F.col("n") >= least[F.col("kind")])).orderBy("kind", "word").toPandas()
    counts = {kind: x.set_index("word") for kind, x in words.groupby("kind")}
    seen = counts.pop("seen", words.set_index("word"))
    ends = Ends(seen["n"].to_dict(), seen["ends"].to_dict())
    grams: dict[str, np.ndarray] = {}
    for kind, x in counted.where("gram >= 0").select("kind", "gram", "n").toPandas().groupby("kind"):
        grams[kind] = np.zeros(lang.DIM)
        grams[kind][x["gram"].to_numpy()] = x["n"].to_numpy()
    model = _language_model(rows, grams, {kind: x["n"].to_dict() for kind, x in counts.items()})
    parts = pairs.select("id", "question", "answer").repartition(max(1, -(-pairs.count() // PART)), "id", "question", "answer")
    values = parts.mapInPandas(_part(context.broadcast(model), context.broadcast(ends), seed), "at int, v long").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").toPandas()["v"].to_numpy(dtype=np.float64)
    if not len(values):
        return Tagger(_learned([], model, ends, seed)[0], model, ends)
    k = len(TAGS)
    dense, words, step, start = np.split(values[:-1] / values[-1], np.cumsum([len(DENSE) * k, BUCKETS * k, k * k]))
    return Tagger(Chain(dense.reshape(-1, k), words.reshape(-1, k), step.reshape(k, k), start), model, ends)


def defects(pairs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """(id, defect, shares of the tags) of every pair.

    ``pairs`` has id, question, answer. ``defect`` is ``empty``, ``refusal``, ``copied_question``,
    ``other_language``, ``truncated`` (the first that holds) or null for a sound answer. Empty is
    an answer without a letter or digit, or one that placeholders make up. An answer counts as sound
    whenever enough of it is tagged as answer, whatever stands around it; only its unfinished end
    then makes it truncated. A null or empty question can be neither copied nor of another language.
    """
    tagger_of = pairs.sparkSession.sparkContext.broadcast(tagger or fit(pairs.where("length(answer) > 0")))

    @F.pandas_udf(", ".join(f"{name} double" for name in TAGS) + ", ends_open boolean")
    def covered(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        own = Tagger(tagger_of.value.field, tagger_of.value.model, tagger_of.value.ends)  # its memory of words lasts for the task
        for questions, answers in batches:
            yield own.covered(questions.tolist(), answers.tolist())

    c = F.col
    shares = spread(pairs.select("id", "question", "answer")).select("id", F.coalesce(F.col("question").rlike(r"\S"), F.lit(False)).alias("asked"), covered("question", "answer").alias("c")).select("id", "asked", "c.*")
    held = sum((c(name) for name in TAGS[1:]), c(TAGS[0]))
    defect = (
        F.when((held == 0) | ((c("placeholder") >= COPIED) & (c("answer") < SOUND)), "empty")
        .when((c("refusal") >= REFUSED) & (c("answer") < SOUND) & (c("refusal") >= c("echo")), "refusal")
        .when(c("asked") & (c("echo") >= COPIED) & (c("answer") < SOUND), "copied_question")
        .when(c("asked") & (c("foreign") >= OTHER), "other_language")
        .when(c("ends_open"), "truncated")
    )
    return shares.select("id", defect.alias("defect"), *TAGS)


def approved(status: Column) -> Column:
    return F.lower(F.regexp_replace(status, r"\A[\s ]+|[\s ]+\z", "")) == "approved"


def defective_pairs(hq: DataFrame) -> DataFrame:
    """(id, defect) of approved records whose answer is defective; see ``defects``."""
    pairs = hq.where(approved(F.col("status")) & F.col("id").isNotNull()).select("id", "question", "answer")
    return defects(pairs).where("defect IS NOT NULL").select("id", "defect").distinct()
