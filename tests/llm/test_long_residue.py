"""Template marks of any length, and short runs of filler."""

import time

import pytest

from folioform.llm import residue

PROSE = "and the shepherd went down to the river with his brother and they watered the flock there"


@pytest.fixture(scope="module")
def index():
    return residue.ResidueIndex({}, 1000)


@pytest.mark.parametrize("mark", ["{{ " + "name | " * 40 + "}}", "{% if " + "a == 1 and " * 20 + "b % 2 %}", "<% " + "call(a < b); " * 20 + "%>", "${" + "a" * 200 + "}", "{{ a {b} c }}", "${a:-${b}}", "%(" + "n" * 90 + ")s", "__" + "NAME_" * 30 + "X__", "[% " + "x " * 90 + "%]"])
def test_long_marks_are_slots(index, mark):
    assert "<slot>" in residue.tokens(f"{PROSE} {mark} {PROSE}")
    assert index.coverage(f"{PROSE} {mark} {PROSE}") >= residue.COVERAGE


def test_short_filler_in_prose(index):
    assert index.coverage(f"{PROSE} Lorem ipsum {PROSE}") >= residue.COVERAGE
    assert index.coverage(f"{PROSE} ipsum {PROSE}") < residue.COVERAGE and index.coverage(PROSE) < residue.COVERAGE


@pytest.mark.parametrize("open_", ["{{ ", "{% ", "<% ", "${a", "[% ", "__A", "<a ", "[[TODO ", "%%a"])
def test_unclosed_marks_take_linear_time(open_):
    t = time.time()
    residue.tokens(open_ * 50_000)
    assert time.time() - t < 5
