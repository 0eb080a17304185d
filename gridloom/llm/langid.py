"""Operator 10: language identification by cross-parsing entropy.

The labelled texts of a language build one suffix automaton. A text is parsed greedily, from its first letter to its
last and across words, into the longest phrases that occur in the language's texts; the language that needs the fewest
phrases per character wins. Texts are compared as lower-case UTF-8 bytes, with one space for each run of ASCII that is
no letter. For speed all segments of all texts of a batch walk all automata side by side; a text is cut into segments of
``SEGMENT`` bytes, and a phrase ends at a cut.

Null texts and texts without a letter (Unicode category L) are ``und`` with score 0. Ties go to the first language by
name. Without any labelled text every text is ``und``. The score is the winner's share of the weights
exp(-SHARP * phrases per character). Repeated rows get equal results. Languages past the ``MAX_LANGUAGES`` most frequent
ones are not learned.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, map_text

#: Bounds of the fitted sample: languages, texts of each, characters of one text, bytes of a language's automaton.
MAX_LANGUAGES, SAMPLE_ROWS, SAMPLE_CHARS, SAMPLE_BYTES = 64, 60, 20_000, 60_000
#: Cells of the table of all automata (4 bytes each); where states times kinds of bytes would be more, SAMPLE_BYTES is less.
TABLE_CELLS = 1 << 26
#: Bytes that are parsed in one go, and lanes that walk side by side.
SEGMENT, LANES = 1024, 1 << 14
SHARP = 30.0
#: On UTF-8 bytes of lower-cased text: ASCII letters and bytes from 0x80 on stay.
NORMAL = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
ASCII_LETTER = re.compile("[A-Za-z]")
#: Byte between two texts of an automaton; no normal text has it.
BORDER = 0


def normal(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(NORMAL).split())


def has_letter(text: str | None) -> bool:
    return bool(text) and (ASCII_LETTER.search(text) is not None or any(c.isalpha() for c in text))


class SuffixAutomaton:
    """All substrings of a sequence; ``step`` is one map from state and symbol to state, state 0 the start."""

    def __init__(self, sequence):
        step, link, length = [{}], [-1], [0]
        last = 0
        for c in sequence:
            new = len(step)
            step.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in step[p]:
                step[p][c] = new
                p = link[p]
            if p >= 0:
                q = step[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    twin = len(step)
                    step.append(step[q].copy())
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and step[p].get(c) == q:
                        step[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new
        self.step = step

    def phrases(self, sequence) -> int:
        """Phrases of a greedy parse; a symbol that never occurs is a phrase of its own."""
        step, n, state = self.step, 0, 0
        for c in sequence:
            to = step[state].get(c)
            if to is None:
                n += state != 0
                to = step[0].get(c)
                if to is None:
                    n += 1
                    state = 0
                    continue
            state = to
        return n + (state != 0)


@dataclass
class Model:
    """Arcs (state, kind of byte, next state) of all automata; language k starts in state starts[k]. Kind 0: bytes in no sample."""

    name: str
    languages: list[str]
    starts: np.ndarray
    kinds: np.ndarray
    states: int
    arcs: np.ndarray


def fit(sample: dict[str, list[str]]) -> Model:
    """The automata of the languages; a language without a letter in its texts is left out."""
    texts = {lang: bytes([BORDER]).join(b for b in (normal(t) for t in sample[lang] if has_letter(t)) if b)[:SAMPLE_BYTES] for lang in sorted(sample)}
    texts = {lang: t for lang, t in texts.items() if t}
    used = sorted(set().union(*texts.values()) - {BORDER})
    kinds = np.zeros(256, np.uint8)
    kinds[used] = np.arange(1, len(used) + 1)
    most = TABLE_CELLS // (2 * (len(used) + 1) * max(1, len(texts)))  # an automaton has at most two states a byte
    starts, arcs, free = [], [np.zeros((0, 3), np.int32)], 1
    for t in texts.values():
        automaton = SuffixAutomaton(t[:most])
        starts.append(free)
        arcs.append(np.array([(free + s, kinds[c], free + to) for s, own in enumerate(automaton.step) for c, to in own.items() if c != BORDER], np.int32).reshape(-1, 3))
        free += len(automaton.step)
    return Model(uuid.uuid4().hex, list(texts), np.array(starts, np.int32), kinds, free, np.concatenate(arcs))


class CrossParser:
    """All automata in one table from state and kind of byte to state. States are kept times the number of kinds; 0: no arc."""

    def __init__(self, model: Model):
        self.languages, self.kinds = model.languages, model.kinds
        width = int(model.kinds.max()) + 1
        self.starts = model.starts * np.int32(width)
        self.table = np.zeros(model.states * width, np.int32)
        self.table[model.arcs[:, 0] * width + model.arcs[:, 1]] = model.arcs[:, 2] * np.int32(width)

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """(text, language): phrases of the greedy parses of all segments of a text."""
        owner, pieces = [], []
        for k, t in enumerate(texts):
            for at in range(0, len(t), SEGMENT):
                owner.append(k)
                pieces.append(t[at : at + SEGMENT])
        total = np.zeros((len(texts), len(self.languages)), np.int64)
        order = sorted(range(len(pieces)), key=lambda i: -len(pieces[i]))
        some = max(1, LANES // max(1, len(self.languages)))
        for at in range(0, len(order), some):
            part = order[at : at + some]
            np.add.at(total, np.array([owner[i] for i in part]), self._walk([pieces[i] for i in part]))
        return total

    def _walk(self, pieces: list[bytes]) -> np.ndarray:
        """Phrases of pieces, longest first, in each language."""
        n, langs = len(pieces), len(self.languages)
        lengths = np.array([len(p) for p in pieces])
        symbols = np.zeros((n, lengths[0]), np.uint8)
        symbols[np.arange(lengths[0]) < lengths[:, None]] = self.kinds[np.frombuffer(b"".join(pieces), np.uint8)]
        symbols = np.ascontiguousarray(symbols.T)
        walking = n - np.searchsorted(lengths[::-1], np.arange(lengths[0]), "right")  # pieces longer than t
        # Lanes: all pieces in the first language, then in the next, ...; only those of pieces not yet at their end move.
        start = np.repeat(self.starts[:, None], n, 1)
        state, count = start.copy(), np.zeros((langs, n), np.int64)
        table = self.table
        for t in range(lengths[0]):
            m = walking[t]
            kind = symbols[t, :m]
            for s, first, c in zip(state, self.starts, count, strict=True):
                s = s[:m]
                to = table[s + kind]
                lost = np.flatnonzero(to == 0)
                if len(lost):
                    again = table[first + kind[lost]]
                    unknown = again == 0
                    c[lost] += (s[lost] != first).astype(np.int8) + unknown
                    again[unknown] = first
                    to[lost] = again
                s[:] = to
        return (count + (state != start)).T

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = [("und", 0.0)] * len(texts)
        told = [k for k, t in enumerate(texts) if has_letter(t)]
        if not told or not self.languages:
            return out
        plain = [normal(texts[k]) for k in told]
        total = self.phrases(plain)
        least = total.min(1)
        length = np.array([max(1, len(p)) for p in plain])
        share = 1 / np.exp(-SHARP * (total - least[:, None]) / length[:, None]).sum(1)
        for k, best, score in zip(told, total.argmin(1).tolist(), share.tolist(), strict=True):
            out[k] = (self.languages[best], score)
        return out


def sample_texts(docs: DataFrame, mod: int = 5, held: int = 0, key: str = "doc_id") -> dict[str, list[str]]:
    """Per language at most ``SAMPLE_ROWS`` distinct labelled texts, chosen by a hash of the text, on the driver.

    Of longer texts the first ``SAMPLE_CHARS`` characters are learned from, so no language is lost by the length of its texts.
    """
    known = docs.filter((crc_mod(key, mod) != held) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("text", "lang")
    number = known.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64("text")).alias("texts")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES)
    number = number.select("lang", F.least(F.lit(1.0), F.lit(2.0 * SAMPLE_ROWS) / F.col("texts")).alias("share"))
    drawn = known.withColumn("draw", F.xxhash64("text", F.lit(7))).join(F.broadcast(number), "lang")  # at most MAX_LANGUAGES rows
    few = drawn.filter(F.pmod("draw", F.lit(1 << 30)) < F.ceil(F.col("share") * (1 << 30)))
    texts = few.select("lang", "draw", F.substring("text", 1, SAMPLE_CHARS).alias("text")).dropDuplicates(["lang", "text"])
    ranked = texts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))).filter(F.col("rank") <= SAMPLE_ROWS)
    out: dict[str, list[str]] = {}
    for r in sorted(ranked.select("lang", "rank", "text").collect(), key=lambda r: (r.lang, r.rank)):
        out.setdefault(r.lang, []).append(r.text)
    return out


#: Parsers of this process by the name of their model: tasks that run in one process after another share the tables.
PARSERS: dict[str, CrossParser] = {}


def identify(docs: DataFrame, sample: dict[str, list[str]], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, lang_pred, score for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(sample))

    def make():
        model = shared.value
        if model.name not in PARSERS:
            PARSERS.clear()
            PARSERS[model.name] = CrossParser(model)
        parser = PARSERS[model.name]

        def apply(texts):
            made = parser.predict(texts)
            return [[m[0] for m in made], [m[1] for m in made]]

        return apply

    return map_text(docs, text, make, {"lang_pred": "string", "score": "double"}, list(keep))
