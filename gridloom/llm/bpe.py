"""Operator 1: BPE encoding and decoding by a prefix-sharing trie.

The distinct words of a batch form a trie; sorted order visits it depth first, so the stack of
last-token states of one word is reused for the prefix it shares with the next. The state of a
prefix is the last token of its encoding: the one token that ends there and may follow the last
token of what stands before it. Two tokens may stand side by side if no merge of lower rank would
have joined pieces across their border.

Null and empty texts have no tokens. Words of any length take time linear in their length.
"""

from __future__ import annotations

import json
import re
from array import array
from hashlib import sha256
from os.path import commonprefix

from pyspark.sql import DataFrame

from .common import map_text

END = "</w>"
#: Distinct words whose encodings a task keeps; beyond it the table starts anew.
MAX_WORDS = 300_000
#: Fixed values of this kind of vocabulary: its pattern of words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same words where all characters are below U+0180 (but U+0130): there NFC changes nothing and case is one to one.
LATIN, DIGIT, SPACE = "a-zªµºß-öø-ÿ\u0100-\u017f", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
LATIN_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LATIN}]+|[{DIGIT}]|[^{SPACE}{LATIN}{DIGIT}]+")
BEYOND = re.compile("[^\x00-\u012f\u0131-\u017f]")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself if it is visible in Latin-1, else one from U+0100 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


class TrieBPE:
    """Encoder and decoder for a vocabulary file of the tokenizers library of kind BPE with word ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != END or spec["decoder"] is not None:
            raise ValueError(f"not a BPE vocabulary with word ends and no decoder: {path}")
        steps = spec["pre_tokenizer"]["pretokenizers"]
        if [s["type"] for s in steps] != ["Split", "ByteLevel"] or steps[0]["pattern"]["Regex"] != WORDS:
            raise ValueError(f"words of another kind: {path}")
        library = Tokenizer.from_str(json.dumps(spec | {"pre_tokenizer": steps[0]}))
        self.normalize, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = {a + b for a, b in merges}
        #: Pieces in the order in which merging can make them: characters first, then by merge rank.
        self.pieces = [p for p in model["vocab"] if p not in made] + [a + b for a, b in merges]
        self.order = {p: i for i, p in enumerate(self.pieces)}
        self.ids = [model["vocab"][p] for p in self.pieces]
        self.text = {i: p for p, i in model["vocab"].items()} | {i: p for p, i in self.special.items()}
        self.parts = [(i, i) for i in range(len(self.pieces) - len(merges))] + [(self.order[a], self.order[b]) for a, b in merges]
        self.joined = {pair: i for i, pair in enumerate(self.parts) if pair[0] != i}
        self.longest = max(len(p.removesuffix(END)) for p in self.pieces)
        self.byte = byte_characters()
        self.beside: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.known: dict[str, tuple[bytes, str]] = {}

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the encoding of the two pieces' text is just these two."""
        key = (a, b)
        if (found := self.beside.get(key)) is None:
            found = self.beside[key] = self._stays(a, b)
        return found

    def _stays(self, a: int, b: int) -> bool:
        # Undo merges on both sides of the border, latest first; bound is the rank from which a
        # merge across the border would come too late.
        bound = len(self.pieces)
        while True:
            if self.joined.get((a, b), bound) < bound:
                return False
            left, right = self.parts[a], self.parts[b]
            undo_left = left[0] != a and (a > b or right[0] == b)
            if undo_left:
                bound, a = a, left[1]
            elif right[0] != b:
                bound, b = b + 1, right[0]
            else:
                return True

    def is_whole(self, t: int) -> bool:
        """Whether merging this piece's own text gives it back as one piece."""
        if (found := self.whole.get(t)) is None:
            a, b = self.parts[t]
            found = self.whole[t] = a == t or (self.is_whole(a) and self.is_whole(b) and self._joins(a, b, t))
        return found

    def _joins(self, a: int, b: int, t: int) -> bool:
        bound = t
        while True:
            if self.joined.get((a, b), t) < bound:
                return False
            left, right = self.parts[a], self.parts[b]
            if left[0] != a and (a > b or right[0] == b):
                bound, a = min(bound, a), left[1]
            elif right[0] != b:
                bound, b = min(bound, b + 1), right[0]
            else:
                return True

    def last_token(self, prefix: str, end: str, last: list[int]) -> int:
        """Of the prefix's encoding, if its last character carries ``end``; last[d]: of its first d characters."""
        n = len(prefix)
        for k in range(1, min(n, self.longest) + 1):
            t = self.order.get(prefix[n - k :] + end)
            if t is not None and self.is_whole(t) and (k == n or self.may_follow(last[n - k], t)):
                return t
        raise ValueError(f"no token ends {prefix!r}")

    def learn(self, words) -> None:
        """Encode distinct words by one depth-first pass over their trie."""
        last: list[int] = [-1]
        before = ""
        for word, raw in sorted(("".join([self.byte[b] for b in w.encode()]), w) for w in words):
            shared = len(commonprefix((before, word)))
            del last[min(shared, len(word) - 1) + 1 :]
            for d in range(len(last), len(word)):
                last.append(self.last_token(word[:d], "", last) if d <= self.longest else self.last_token(word[d - self.longest : d], "", last[d - self.longest :]))
            tokens, at, end = [], len(word), END
            while at:
                t = self.last_token(word[max(0, at - self.longest) : at], end, last[max(0, at - self.longest) :]) if end else last[at]
                tokens.append(t)
                at, end = at - len(self.pieces[t]) + len(end), ""
            tokens.reverse()
            ids = array("I", [self.ids[t] for t in tokens])
            self.known[raw] = (ids.tobytes(), " ".join(self.pieces[t] for t in tokens))
            before = word

    def split_words(self, text: str) -> list[str]:
        if BEYOND.search(text):
            return [w for w, _ in self.split(self.normalize(text))]
        return LATIN_WORDS.findall(text.lower())

    def words(self, text: str) -> list[str]:
        """Words in the order of the text; special tokens stand as (content,)."""
        out: list = []
        at = 0
        for m in self.special_re.finditer(text) if self.special_re else ():
            out += self.split_words(text[at : m.start()])
            out.append((m[0],))
            at = m.end()
        return out + self.split_words(text[at:] if at else text)

    def encode_batch(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """Per text: its ids as little-endian unsigned 32-bit integers, and the decoded text."""
        split = [self.words(t) if t else [] for t in texts]
        if len(self.known) > MAX_WORDS:
            self.known.clear()
            self.beside.clear()
        for (content,) in {w for ws in split for w in ws if type(w) is tuple}:
            self.known[(content,)] = (self.special[content].to_bytes(4, "little"), content)
        self.learn({w for ws in split for w in ws} - self.known.keys())
        out = []
        for ws in split:
            both = [self.known[w] for w in ws]
            out.append((b"".join([x[0] for x in both]), " ".join([x[1] for x in both])))
        return out

    def decode(self, ids) -> str:
        """As the library does without a decoder: the tokens' strings, joined by spaces; unknown ids are left out."""
        return " ".join(self.text[i] for i in ids if i in self.text)


def bpe_digest(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """Encode and decode a column of texts.

    Returns the columns ``keep``, n_tokens, ids_sha256, decoded_sha256, and with ``with_ids`` also the
    ids (array<bigint>) and the decoded text. Null counts as empty; repeated rows are kept as they are.
    """

    def make():
        bpe = TrieBPE(path)

        def apply(texts):
            n, ids_hex, text_hex, ids, decoded = [], [], [], [], []
            for raw, back in bpe.encode_batch(texts):
                if with_ids:
                    ids.append(array("I", raw).tolist())
                    back = bpe.decode(ids[-1])
                    decoded.append(back)
                n.append(len(raw) // 4)
                ids_hex.append(sha256(raw).hexdigest())
                text_hex.append(sha256(back.encode()).hexdigest())
            return [n, ids_hex, text_hex, *([ids, decoded] if with_ids else [])]

        return apply

    fields = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    if with_ids:
        fields |= {"ids": "array<bigint>", "decoded": "string"}
    return map_text(df, text, make, fields, list(keep))
