"""Hints must not keep a rule from lines that its pattern matches."""

import pytest

pytest.importorskip("trackframe.llm")
from trackframe.llm import line_quality  # noqa: E402


def test_code_with_a_tab_after_var():
    for line in ("var x = 1", "var\tx = 1"):
        may = line_quality.hints(f"A plain line of prose.\n{line}")
        assert line_quality.line_fault(line, line.encode().split(), line_quality.Rules(), may) == "navigation"
