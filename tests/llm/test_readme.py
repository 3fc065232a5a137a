from __future__ import annotations

from pathlib import Path

README = (Path(__file__).resolve().parents[2] / "README.md").read_text()


def test_detection_of_markup_is_named_as_a_pattern_scan():
    row = next(line for line in README.splitlines() if line.startswith("| 1 | `p1_found`"))
    assert "`p1_found` is a pattern scan alone" in row and "acts on `p1_clean` only" in row
