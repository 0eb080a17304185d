"""Operator 5: toxicity by a weighted finite-state pattern grammar.

A clause is read by composed transducers (``fst``). The lexical one maps each word to its classes: insults of three
levels, whose words and stems are learned from labelled texts, and small closed classes of threats, targets, intents,
negations and verbs of reported speech. Over the classes, four machines are composed into one:

    negation   marks insults and threats within ``REACH`` words of a negation
    report     marks those within ``REACH`` words of a verb of speech
    threat     passes a threat only where an intent stands before it
    aim        finds the pattern: aimed (a target within ``AIM`` words on either side), bare, negated, reported; a threat
               needs a target. A target to come is a promise that only paths on which it comes can keep.

The clause's heaviest path names its matched patterns. A pattern's weight starts from fixed values, by which a bare
word says nearly nothing, and moves by as much as labelled texts tell: the weights and the base are those of a logistic
regression of the label on the patterns' summed levels, drawn towards the fixed values. So where the labels mark texts
with a bare insult, that pattern gains weight, and where they don't, it keeps little.

Null and empty texts score as texts without a matched clause. Without labelled texts of both classes only the fixed
threat patterns count. Repeated rows get equal scores.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame

from .common import map_text
from .fst import Fst, compose

#: Bounds of the labelled sample.
MAX_ROWS, MAX_CHARS = 6000, 200_000
WORD = re.compile(r"[^\W\d_]+")
CLAUSE_END = re.compile(r"[.!?;:\n]+")

# The closed classes of the grammar, in English, French, German and Spanish.
TARGETS = set("you your yours he him his she her they them their u ur tu toi te ton ta vous votre il lui elle ils elles leur du dich dir dein deine ihr euch euer sie ihn ihnen tú ti usted ustedes él ella ellos ellas vosotros".split())
NEGATIONS = set("not no never neither nor isn aren wasn weren don doesn didn won cannot without pas jamais sans aucun nicht kein keine keinen nie niemals ohne nunca jamás sin ningún".split())
REPORTS = set("said says say wrote writes called calls claimed claims quoted reported tweeted dit écrit affirmé cité sagte sagt schrieb behauptete zitierte dijo dice escribió afirmó citó".split())
THREATS = set("kill killing murder hurt destroy strangle stab shoot beat burn tuer frapper töten umbringen schlagen verletzen matar golpear".split())
INTENTS = set("will shall gonna going must should want vais va veux werde werden will soll voy quiero".split())

CLOSED = {**dict.fromkeys(INTENTS, "I"), **dict.fromkeys(REPORTS, "R"), **dict.fromkeys(NEGATIONS, "N"), **dict.fromkeys(TARGETS, "T")}

PREFIXES = range(4, 7)
#: Least evidence (twice the log-likelihood ratio) and least share of toxic contexts for a learned word or stem.
EVIDENCE, PURITY = 18.0, 0.9
#: Words over which a negation or a report reaches, and words between an insult or threat and its target.
REACH, AIM = 3, 4
#: Patterns with the weights that they have before labels are seen, for each level; and the base.
PATTERNS = {"aimed": 1.2, "bare": 0.2, "negated": 0.05, "reported": 0.05, "threat": 1.2}
BASE = -3.0
#: Precision with which the fit is drawn to these; most that a text's levels of one pattern count.
PULL, MOST = 2.0, 10.0
#: Least weight of the aimed pattern over the bare one's.
LEAD = 1.25
LEVELS, THREAT_LEVEL = (1, 2, 3), 3
INSULTS = [f"X{k}" for k in LEVELS]
OTHER = ".TNRI"


def scope(cue: str, mark: str) -> Fst:
    """Marks what stands within ``REACH`` words after a cue; states are the words left."""
    machine = Fst(0, set(range(REACH + 1)))
    for left in range(REACH + 1):
        less = max(0, left - 1)
        for label in OTHER:
            machine.arc(left, label, label, REACH if label == cue else less)
        for label in [*INSULTS, "V"]:
            for marked in ("", "n"):
                machine.arc(left, label + marked, label + (marked or (mark if left else "")), less)
    return machine


def threats() -> Fst:
    """A threat without an intent before it is no threat."""
    machine = Fst(0, {0, 1})
    for intent in (0, 1):
        for label in OTHER:
            machine.arc(intent, label, label, int(intent or label == "I"))
        for mark in ("", "n", "r"):
            for label in INSULTS:
                machine.arc(intent, label + mark, label + mark, intent)
            machine.arc(intent, "V" + mark, "V" + mark if intent else ".", intent)
    return machine


def aims(weights: dict[str, float]) -> Fst:
    """States: no target, ("seen", words left since one), ("due", words left until one must come)."""
    machine = Fst("none", {"none", *(("seen", k) for k in range(1, AIM + 1))})

    def later(state):
        if state == "none":
            return state
        kind, left = state
        return (kind, left - 1) if left > 1 else "none" if kind == "seen" else None

    for state in ["none", *((kind, k) for kind in ("seen", "due") for k in range(1, AIM + 1))]:
        machine.arc(state, "T", "", ("seen", AIM))
        to = later(state)
        for label in OTHER.replace("T", ""):
            if to is not None:
                machine.arc(state, label, "", to)
        goals = [(to, state != "none")] if to is not None else []
        if state == "none":
            goals.append((("due", AIM), True))
        for goal, aimed in goals:
            for level, label in zip(LEVELS, INSULTS, strict=True):
                plain = "aimed" if aimed else "bare"
                for mark, pattern in (("", plain), ("n", "negated"), ("r", "reported")):
                    machine.arc(state, label + mark, f"{pattern} {level}", goal, weights[pattern] * level)
            for mark, pattern in (("", "threat"), ("n", "negated"), ("r", "reported")):
                machine.arc(state, "V" + mark, f"{pattern} {THREAT_LEVEL}" if aimed else "", goal, weights[pattern] * THREAT_LEVEL if aimed else 0.0)
    return machine


def clause_machine(weights: dict[str, float]) -> Fst:
    return compose(compose(compose(scope("N", "n"), scope("R", "r")), threats()), aims(weights))


def evidence(toxic: int, clean: int, share: float) -> float:
    """Twice the log-likelihood ratio of these counts against the base share of toxic contexts; 0 if below it."""
    n = toxic + clean
    if not toxic or toxic / n <= share:
        return 0.0
    term = lambda k, p: k * math.log(p) if k else 0.0
    return 2 * (term(toxic, toxic / n) + term(clean, clean / n or 1) - term(toxic, share) - term(clean, 1 - share))


@dataclass
class Grammar:
    """Learned words and stems with their weights, weights of the patterns, and the base; small enough to broadcast."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=lambda: dict(PATTERNS))
    base: float = BASE
    memo: dict[str, list[str] | None] = field(default_factory=dict)
    machine: Fst | None = None

    def insult(self, word: str) -> float:
        """The weight of a word, or else of its longest learned stem."""
        w = self.words.get(word, 0.0)
        for k in reversed(PREFIXES):
            w = w or (self.stems.get(word[:k], 0.0) if len(word) > k else 0.0)
        return w

    def classes(self, word: str) -> list[str] | None:
        """Lexical transducer: the classes of a word, of which a path takes one; None if none is an insult or threat."""
        if word in self.memo:
            return self.memo[word]
        w = self.insult(word)
        found = [f"X{max(LEVELS[0], min(LEVELS[-1], round(w)))}"] if w else []
        found += ["V"] if word in THREATS else []
        if len(self.memo) > 150_000:
            self.memo.clear()
        self.memo[word] = found or None
        return self.memo[word]

    def patterns(self, text: str | None) -> dict[str, float]:
        """Summed levels of each pattern on the heaviest paths of the text's clauses."""
        out = dict.fromkeys(PATTERNS, 0.0)
        text = (text or "").lower()
        if not any(self.classes(w) for w in set(WORD.findall(text))):
            return out
        if self.machine is None:
            self.machine = clause_machine(self.weights)
        for clause in CLAUSE_END.split(text):
            words = WORD.findall(clause)
            if any(self.classes(w) for w in words):
                # Words far from any insult or threat say nothing; "." is the class of all other words.
                _, written = self.machine.best([self.classes(w) or [CLOSED.get(w, ".")] for w in words])
                for label in written:
                    if label:
                        pattern, level = label.split()
                        out[pattern] += int(level)
        return out

    def weight(self, text: str | None) -> float:
        """Sum over patterns of their weight times their levels."""
        return sum(self.weights[p] * min(MOST, x) for p, x in self.patterns(text).items())

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.base + self.weight(text)))))


def _keys(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in PREFIXES if len(word) > k)]


def learn(sample: list[tuple[str, int]]) -> Grammar:
    """Fit lexicon and curve on labelled texts.

    The evidence for a word or stem is the weaker of two: over the texts that have it, and over its distinct
    contexts (word before, word after), so that copies of one text count once. A context of a clean text is clean.
    """
    toxic_texts, clean_texts = Counter(), Counter()
    for text, y in sample:
        (toxic_texts if y else clean_texts).update({key for word in set(WORD.findall(text.lower())) for key in _keys(word)})
    if not toxic_texts or not clean_texts:
        return Grammar()
    part = sum(y for _, y in sample) / len(sample)
    likely = {key for key, n in toxic_texts.items() if n >= PURITY * (n + clean_texts[key]) and evidence(n, clean_texts[key], part) >= EVIDENCE}
    contexts: dict[str, dict[tuple, int]] = defaultdict(dict)
    tokens = [0, 0]
    for text, y in sample:
        words = ["", *WORD.findall(text.lower()), ""]
        tokens[y] += len(words)
        for at in range(1, len(words) - 1):
            for key in likely.intersection(_keys(words[at])):
                around = (words[at - 1], words[at + 1])
                contexts[key][around] = min(y, contexts[key].get(around, 1))
    share = max(tokens[1] / sum(tokens), part)
    grammar = Grammar()
    for key, seen in contexts.items():
        toxic = sum(seen.values())
        clean = len(seen) - toxic
        if evidence(toxic, clean, share) >= EVIDENCE and toxic >= PURITY * len(seen):
            weight = min(3.0, math.log((toxic + 0.5) / (clean + 0.5)))
            if key.endswith("*"):
                grammar.stems[key[:-1]] = weight
            else:
                grammar.words[key] = weight
    # A stem that nearly only stands for one longer stem or word says nothing more.
    grown = {**{f"{k}*": None for k in grammar.stems}, **dict.fromkeys(grammar.words)}
    for stem in sorted(grammar.stems, key=len):
        if any(key != f"{stem}*" and key.startswith(stem) and len(contexts[key]) >= 0.9 * len(contexts[f"{stem}*"]) for key in grown):
            del grammar.stems[stem]
    _fit(grammar, np.array([[*(min(MOST, x) for x in grammar.patterns(t).values()), y] for t, y in sample]))
    return grammar


def _fit(grammar: Grammar, points: np.ndarray) -> None:
    """Logistic regression of the label on the levels of each pattern, by Newton steps, drawn to the fixed weights.

    No weight gets below 0, aimed leads bare, and threats weigh no less than aimed insults, so the heaviest paths stay those that were counted.
    """
    x, y = points[:, :-1], points[:, -1]
    prior = np.array([BASE, *PATTERNS.values()])
    beta = prior.copy()
    design = np.hstack([np.ones((len(x), 1)), x])
    pull = np.diag(np.full(len(prior), PULL))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + pull, design.T @ (y - p) - pull @ (beta - prior))
        beta = beta + np.clip(step, -2, 2)
        if abs(step).max() < 1e-6:
            break
    grammar.base = float(min(beta[0], -1.0))
    grammar.weights = {name: float(max(0.0, w)) for name, w in zip(PATTERNS, beta[1:], strict=True)}
    grammar.weights["aimed"] = max(grammar.weights["aimed"], LEAD * grammar.weights["bare"])
    grammar.weights["threat"] = max(grammar.weights["threat"], grammar.weights["aimed"])
    grammar.machine = None


def toxicity(df: DataFrame, grammar: Grammar, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, score and predicted for every row."""
    shared = df.sparkSession.sparkContext.broadcast(replace(grammar, memo={}, machine=None))

    def make():
        own = replace(shared.value, memo={}, machine=None)  # a memo of the task's own, gone with it

        def apply(texts):
            scores = [own.score(t) for t in texts]
            return [scores, [int(s >= 0.5) for s in scores]]

        return apply

    return map_text(df, text, make, {"score": "double", "predicted": "int"}, list(keep))
