"""A disguise is found alone in a text, whatever else the text has."""

from __future__ import annotations

from itertools import product

import pytest
from chronofold.llm import pii

ATS = ["@", " @ ", " @", "@ ", "[at]", " (at) ", "{ @ }", "<arroba>"]
DOTS = [".", " dot ", "[.]", " (dot) ", "{punkt}"]


@pytest.mark.parametrize(("at", "dot"), list(product(ATS, DOTS)))
def test_each_disguise_is_found_alone(at, dot):
    text = f"joe{at}corp{dot}com"
    base, added = pii.spans(text)
    assert [(pii.KINDS[k], text[a:b]) for a, k, b in base + added] == [("email", text)]
    with_marks = sum(pii.spans(f"{text} and (.) more"), [])
    assert base + added == with_marks


@pytest.mark.parametrize("text", ["meet me @ home. ok", "a @ b", "@ noon", "follow @bob.x now"])
def test_lone_signs_are_no_address(text):
    assert pii.spans(text) == ([], [])
