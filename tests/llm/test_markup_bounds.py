"""Markup of any depth and length is found and cleaned."""

from __future__ import annotations

import random
import re
import time

import pytest

from lorequarry.llm.markup import Scan, unwrap_commands, unwrap_templates

DEEP = 30


@pytest.mark.parametrize(
    "text, kind, clean",
    [
        ("see {{a|" * DEEP + "core" + "}}" * DEEP, "wiki", None),
        ("see " + "\\emph{" * DEEP + "core" + "}" * DEEP, "latex", "see core"),
        ("see " + "\\fbox[a={1}]{" * DEEP + "core" + "}" * DEEP, "latex", "see core"),
        ("\\emph{see} " + "\\textbf{\\emph{co}}\\textbf{\\emph{re}}", "latex", "see core"),
        ("see {{note|" + "w " * 1500 + "core}}", "wiki", None),
        ("see [[" + "w" * 300 + "|core]]", "wiki", "see core"),
        ("see $" + "x_1 + " * 60 + "core$", "latex", None),
    ],
)
def test_no_bound_on_depth_or_length(text, kind, clean):
    scan = Scan(text)
    assert scan.kinds == {kind} and "core" in scan.text
    assert "{" not in scan.text and "[[" not in scan.text and "\\emph" not in scan.text
    assert clean is None or scan.text == clean


def test_unwrapping_is_the_innermost_first_rewriting():
    template = re.compile(r"\{\{(?=\s*[#A-Za-z一-鿿])[^{}]+\}\}")
    command = re.compile(r"(?<![\w:])\\[A-Za-z]{2,}\*?\s?(?:\[[^\[\]\n]*\])?\{([^{}\n]*)\}")

    def until_stable(pattern, new, text):
        while (made := pattern.sub(new, text)) != text:
            text = made
        return text

    dice = random.Random(7)
    for _ in range(20_000):
        text = "".join(dice.choices(["{", "}", "{{", "}}", "a", "|", " ", "1", "\\bf", "\\bf{", "\\it[o]{", "]", "[", "\n", "\\", ":"], k=dice.randint(1, 24)))
        assert unwrap_templates(text, Scan._template)[0] == until_stable(template, lambda m: Scan._template(m[0]), text), repr(text)
        stable, made = until_stable(command, r"\1", text), unwrap_commands(text)
        assert not command.search(made), repr(text)
        assert made == stable or "\\bf" in stable or "\\it" in stable, repr(text)  # the text before may hide a command from the next pass


def test_deep_nesting_is_fast():
    began = time.perf_counter()
    for text in ("{{a|" * 5000 + "x" + "}}" * 5000, "\\emph{" * 5000 + "x" + "}" * 5000, "{{a" * 10_000, "\\emph{" * 10_000, "$a " * 10_000, "[[a " * 10_000):
        Scan(text)
    assert time.perf_counter() - began < 60
