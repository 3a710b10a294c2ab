"""Slices of bounded size cover every text once and change no count."""

from collections import Counter

from marram.llm import language
from marram.llm.arrays import slices


def test_slices_cover_in_order_within_the_bound():
    bodies = [b"", b"a" * 3, b"b" * 9, b"", b"c" * 4, b"d", b"e" * 5, b""]
    for most in (1, 4, 5, 9, 100):
        bounds = list(slices(bodies, most))
        assert [i for a, b in bounds for i in range(a, b)] == list(range(len(bodies)))
        assert all(b - a == 1 or sum(map(len, bodies[a:b])) <= most for a, b in bounds)
    assert list(slices([], 4)) == []


def test_grams_of_slices_are_those_of_all_texts():
    bodies = [b"Der Hund", b"", b"x", b"the quick brown fox " * 40, b"le chien", b""]

    def counted(parts):
        return sum((Counter(language._own(*language._grams(p)).tolist()) for p in parts), Counter())

    whole = counted([bodies])
    assert sum(whole.values()) == sum(map(len, bodies))
    for most in (1, 8, 900):
        assert counted([bodies[a:b] for a, b in slices(bodies, most)]) == whole
