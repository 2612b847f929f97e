from __future__ import annotations

import pytest

from vetgrid.functions.constants import constant


@pytest.mark.parametrize("text", ["a'b", 'a"b', "a\\b", "a\nb", "${x}", "$0 \\d{2}", "é", "%s `x`", "\t\r", "\\u0041"])
def test_strings_survive(one, text):
    assert one(constant([text], "array<string>")) == [text]


def test_nested(one):
    value = [{"a": 1, "b": None, "c": [["x"], []], "d": True}, {"a": 2, "b": "y", "c": [], "d": False}]
    got = one(constant(value, "array<struct<a: int, b: string, c: array<array<string>>, d: boolean>>"))
    assert [r.asDict() for r in got] == value
    assert one(constant([], "array<string>")) == []
