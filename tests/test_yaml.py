"""The reader of YAML text; against PyYAML too, where that is installed."""

import json
import random

import pytest

from spanmoor.functions import model_output as M
from spanmoor.functions.yaml_text import load
from spanmoor.operators import prompt as P

CASES = [
    ("a: 1", {"a": 1}),
    ("- a\n- b", ["a", "b"]),
    ("extractions:\n- medical_condition: hypertension\n  medical_condition_attributes:\n    chronicity: chronic", {"extractions": [{"medical_condition": "hypertension", "medical_condition_attributes": {"chronicity": "chronic"}}]}),
    ('extractions:\n  - html_attributes: "<b>bold</b>"\n  - {}', {"extractions": [{"html_attributes": "<b>bold</b>"}, {}]}),
    ("---\n# note\na:\n  - b: c # d\n    e: 'it''s'\n  -\n    f: g\nh:", {"a": [{"b": "c", "e": "it's"}, {"f": "g"}], "h": None}),
    ("a: {b: c, d: [1, 'x, y', \"z\"], e}", {"a": {"b": "c", "d": [1, "x, y", "z"], "e": None}}),
    ("a: [\n  1,\n  {b: c}\n]\nd: e", {"a": [1, {"b": "c"}], "d": "e"}),
    ("a: |\n  one\n    two\n\n  three\nb: x", {"a": "one\n  two\n\nthree\n", "b": "x"}),
    ("a: >-\n  one\n  two\n\n  three\n", {"a": "one two\nthree"}),
    ("a: |-\n  x\n\n", {"a": "x"}),
    ("a: one\n  two\n  three", {"a": "one two three"}),
    ('a: "one\n  two"', {"a": "one two"}),
    ("a: http://x.y/z#w", {"a": "http://x.y/z#w"}),
    ("a: b-c, d; e", {"a": "b-c, d; e"}),
    ("- - a\n  - b\n- c", [["a", "b"], "c"]),
    ('"a b": "\\u00e9\\n\\"q\\""', {"a b": 'é\n"q"'}),
    ("a: yes\nb: 2024-01-01\nc: 12:30:45\nd: 010\ne: 1_000\nf: 1e3\ng: true\nh: ~\ni: 0x1f\nj: .5\nk: -3", {"a": "yes", "b": "2024-01-01", "c": "12:30:45", "d": 10, "e": "1_000", "f": 1000.0, "g": True, "h": None, "i": 31, "j": 0.5, "k": -3}),
    ("just plain text", "just plain text"),
    ("", None),
    ("é: ü", {"é": "ü"}),
]
BAD = ["a: b: c", "a: [1, 2", "a: 'x", "a: @b", "a: *b", "a: &b c", "a: !t c", "a: b\n c: d", "a: %x", "- a\nb: c", "a: 1\n- b", "a:\n\t- b", "a: \"x\" y", "{a: b}}", "x\n---\ny: z", "a: `b`", '"\\q"']


@pytest.mark.parametrize(("text", "value"), CASES)
def test_values(text, value):
    assert load(text) == value


@pytest.mark.parametrize("text", BAD)
def test_errors(text):
    with pytest.raises(ValueError):  # noqa: PT011
        load(text)


@pytest.mark.parametrize("text", [t for t, _ in CASES] + [b for b in BAD if "&" not in b])
def test_like_pyyaml(text):
    pytest.importorskip("yaml")
    theirs = M._yaml_loader()
    try:
        told = theirs(text)
    except Exception:  # noqa: BLE001
        told = ValueError
    try:
        found = load(text)
    except ValueError:
        found = ValueError
    assert found == told


def test_prompts_are_read_back():
    """What a prompt's examples look like is read as it was meant."""
    rng = random.Random(3)
    pieces = ["plain", "x: y", "- z", "'q'", '"', "é ü", "true", "12", "", " lead", "a\nb", "#c", "a #b", "{", "[x]", "&a", "*b", "~", "a: "]
    for _ in range(300):
        found = [P.Extraction(rng.choice(["person", "a b", "x-y"]), rng.choice(pieces) + rng.choice(pieces), {rng.choice(["k", "l m"]): rng.choice([1, None, True, "v", ["w", {"z": "#"}], {}])}) for _ in range(rng.randint(0, 3))]
        text = P.format_extractions(found)[8:-4]
        told = load(text)["extractions"]
        assert told == [{e.class_: e.text, f"{e.class_}_attributes": dict(e.attributes)} for e in found]
        assert json.loads(json.dumps(told)) == told


def test_any_text_ends():
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "b: ", "- ", "\n", "\n  ", " ", ":", "'", '"', "[", "]", "{", "}", "|", ">", "#", ",", "x"]) for _ in range(rng.randint(0, 30)))
        try:
            load(text)
        except ValueError:
            pass
    for odd in ("a: " * 20_000, "[" * 300, "- " * 300, "x " * 100_000, "a:\n" * 20_000):
        try:
            load(odd)
        except (ValueError, RecursionError):
            pass
