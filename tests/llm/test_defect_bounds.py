"""Refusals of any length, and short answers that break off."""

from __future__ import annotations

import pytest

from lorequarry.llm.defects import aligned, declines, defect

LONG = "I cannot answer the question about the retention of " + "index snapshots and " * 20 + "other tables."


@pytest.mark.parametrize(
    "answer, want",
    [
        (LONG, "refusal"), ("Sorry. " + LONG, "refusal"), (LONG[:-1] + ", but the default is 30 days.", None),
        ("Use the", "truncated"), ("It was because", "truncated"), ("logical AND", None), ("x and y", None), ("cosine distance", None), ("`top_k` = 5", None),
    ],
)
def test_length_decides_nothing(answer, want):
    assert defect("Which distance is the default of the index?", answer, None) == want


@pytest.mark.parametrize(
    "sentence, want",
    [
        ("I am unable, given these passages, to answer.", False), ("I am unable to give you, from these passages, an answer.", True),
        ("I cannot " + "x" * 70 + " answer", False), ("Die Frage kann ich Ihnen leider nicht beantworten.", True), ("Nicht jeder Planungsagent läuft.", False),
        ("资料里没有相关内容，因此不能作答。", True), ("No puedo responder.", True), ("Je ne peux pas répondre.", True), ("The index answers every question.", False),
    ],
)
def test_templates_are_aligned_in_order_with_bounded_gaps(sentence, want):
    assert (declines(sentence) is not None) == want


def test_alignment_scores():
    found = {"A": [(0, 2)], "B": [(5, 7)], "C": [(9, 10)], "D": []}
    assert aligned(["A", "B", "C"], found, 10)[0] == pytest.approx((3 - 0.5 * 0.3 - 0.5 * 0.2) / 3)
    assert aligned(["C", "A"], found, 10)[0] == 0.5 and aligned(["A", "B", "C", "D"], found, 10)[0] < 0.75 and aligned(["D"], found, 10) == (0, 0)
