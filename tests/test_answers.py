import json

import pytest

from paperloom.sources.answers import repaired

CASES = [
    ('Note [1]: [{"raw_text":"a"}]', [{"raw_text": "a"}]),
    ('[{"raw_text": "he said "hi", then left", "k": "x"}]', [{"raw_text": 'he said "hi", then left', "k": "x"}]),
    ('[{"raw_text": "a\nb"} {"raw_text": \'c\'},]', [{"raw_text": "a\nb"}, {"raw_text": "c"}]),
    ('[{"a": "x"}, {"a": "cut', [{"a": "x"}]),
    ('[{"a": "x"}, {"a', [{"a": "x"}]),
    ('```json\n[{"a": "tab\\tq\\"\\u00e9\\q"}]\n```', [{"a": 'tab\tq"éq'}]),
    ('[{"a": null, "b": None, "c": 12.5, d: true}]', [{"a": None, "b": None, "c": "12.5", "d": "true"}]),
    ('[{"a": {"b": "c"}, "l": ["x", "y"], "z": "w"}]', [{"a": {"b": "c"}, "z": "w"}]),
    ('[{"a": "\\ud83d\\ude00 \\ud83d"}]', [{"a": "😀 �"}]),
    ("[]", []), ("[", []), ("no list", None), ("[1, 2]", None), (None, None), ("", None), ('[{"a": "x"}] and [{"a": "y"}]', [{"a": "x"}]),
]


@pytest.mark.parametrize(("answer", "want"), CASES)
def test_answers(answer, want):
    got = repaired(answer)
    assert (None if got is None else json.loads(got)) == want


def test_hostile_answers_end(spark):
    import random

    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice('[]{}",:\'\\ \nabu0') for _ in range(rng.randrange(40)))
        got = repaired(text)
        assert got is None or isinstance(json.loads(got), list)
    assert repaired('[{"a": "' + '"' * 20_000) == "[]"
