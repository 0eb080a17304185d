"""Transducers against all paths, and what the grammar's patterns do to predictions."""

import random
from itertools import product

from gridloom.llm import toxicity as T
from gridloom.llm.fst import Fst, compose

from .test_operators import words_of


def machine(draw, letters="ab"):
    out = Fst(0, {k for k in range(3) if draw.random() < 0.6} or {1})
    for state in range(3):
        for read in letters:
            for _ in range(draw.randint(0, 2)):
                out.arc(state, read, draw.choice(letters), draw.randrange(3), draw.randint(-3, 3))
    return out


def paths(m, word):
    """(weight, written) of every accepting path."""
    found = [(0.0, "", m.start)]
    for c in word:
        found = [(w + more, done + write, to) for w, done, state in found for write, more, to in m.arcs.get(state, {}).get(c, ())]
    return [(w, done) for w, done, state in found if state in m.final]


def test_composition_against_all_paths():
    draw = random.Random(4)
    for _ in range(200):
        a, b = machine(draw), machine(draw)
        both = compose(a, b)
        for n in range(4):
            for word in product("ab", repeat=n):
                slow = [w + more for w, middle in paths(a, word) for more, _ in paths(b, middle)]
                fast = both.best([[c] for c in word])
                assert (fast is None) == (not slow) and (not slow or fast[0] == max(slow))
                if slow:
                    assert (fast[0], "".join(fast[1])) in [(w + more, out) for w, middle in paths(a, word) for more, out in paths(b, middle)]


GRAMMAR = T.Grammar(words={"grubber": 3.0, "slob": 1.0})


def found(text):
    return {k: v for k, v in GRAMMAR.patterns(text).items() if v}


def test_patterns_of_clauses():
    assert found("you are a grubber") == {"aimed": 3} == found("a grubber, you") and found("what a slob") == {"bare": 1}
    assert found("you are not a grubber") == {"negated": 3} and found("he said grubber to them") == {"reported": 3}
    assert found("he wrote nothing. you grubber") == {"aimed": 3}
    assert found("you w w w w w w grubber") == {"bare": 3} == found("grubber w w w w w w you")
    assert found("i will kill you") == {"threat": 3} == found("you, i will kill") and not found("i will kill time") and not found("you kill time")
    assert found("i will not kill you") == {"negated": 3} and found("you grubber and slob") == {"aimed": 4}
    assert found("i will kill you, you grubber") == {"threat": 3, "aimed": 3}
    assert not found(None) and not found("") and not found("...")


def test_an_isolated_word_says_little_without_labels():
    assert GRAMMAR.score("grubber") < 0.15 and GRAMMAR.score("you grubber") > 0.5 > GRAMMAR.score("you are not a grubber")
    assert GRAMMAR.score("i will kill you") > 0.5 > GRAMMAR.score("i will kill time")


def test_labels_move_the_patterns():
    """Where labels mark insults aimed at somebody but not negated or reported ones, the grammar tells them apart; sums of words can't."""
    draw, sample, held = random.Random(8), [], []
    bad = ["grubber", "slobin", "crumbo"]
    for k in range(1500):
        y = k % 3 == 0
        word = draw.choice(bad)
        clause = draw.choice([f"you are a {word}", f"{word} that he is", f"they, {word}"]) if y else draw.choice([f"you are not a {word}", f"he called them {word}", f"she wrote {word}", "all is well", "all is well"])
        text = ". ".join([" ".join(words_of(k, 12)), clause, " ".join(words_of(-k - 1, 12))])
        (held if k % 5 == 0 else sample).append((text, int(y)))
    grammar = T.Grammar(words=dict.fromkeys(bad, 3.0))
    T._fit(grammar, T.np.array([[*grammar.patterns(t).values(), y] for t, y in sample]))
    right = sum((grammar.score(t) >= 0.5) == bool(y) for t, y in held) / len(held)
    # The ablation: a word's weight counts wherever it stands.
    summed = max(sum((sum(w in bad for w in t.split()) >= least) == bool(y) for t, y in held) / len(held) for least in (1, 2))
    assert right > 0.98 and summed < right - 0.15


def test_negation_and_report_flip_predictions():
    draw = random.Random(3)
    sample = []
    for k in range(400):
        text = words_of(k, 40)
        if k % 8 == 0:
            for _ in range(draw.randint(1, 3)):
                text.insert(draw.randrange(40), "grubber")
        sample.append((" ".join(text), int(k % 8 == 0)))
    grammar = T.learn(sample)
    for said, turned in (("you are a grubber", "you are not a grubber"), ("them: grubber", "she called them grubber"), ("i will kill you", "i will never kill you")):
        assert grammar.score(said) >= 0.5 > grammar.score(turned)
