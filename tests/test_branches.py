"""Conditionals whose branches do not balance their braces: no complete function is lost."""

import pytest

from srcloom.functions.cscan import scan

NESTED = """#ifdef A
#ifdef B
int f(int a) {
#else
int f(long a) {
#endif
return a; }
int g(void) { return 1; }
#else
int h(void) { return 2; }
#endif
int last(void) { }
"""
COMPLETE_INSIDE = """extern "C" {
#ifdef A
int f(int a) {
#else
int helper(void) { if (1) { } return 1; }
struct s { int x; };
int f(long a) {
#endif
if (a) { } return a; }
}
int last(void) { }
"""
CLOSES_FIRST = """int f(void) {
#ifdef A
  return 1; }
int g(void) { }
#else
  if (2) { } return 2; }
int h(void) { }
#endif
int last(void) { }
"""
IN_A_BODY = """int f(int x) {
#ifdef A
  if (x) {
#else
  if (x > 1) { x++; } while (x) {
#endif
  } }
int last(void) { }
"""
HIDDEN_TWICE = """#if A
int f(int a) {
#else
#if B
int f(long a) {
#else
int deep(void) { }
int f(char a) { int b; {
#endif
#endif
return 1; }
int last(void) { }
"""
CASES = [
    (NESTED, [("f", 3), ("g", 8), ("h", 10), ("last", 12)], []),
    (COMPLETE_INSIDE, [("f", 3), ("helper", 5), ("last", 11)], [6]),
    (CLOSES_FIRST, [("f", 1), ("g", 4), ("h", 7), ("last", 9)], []),
    (IN_A_BODY, [("f", 1), ("last", 8)], []),
    (HIDDEN_TWICE, [("f", 2), ("deep", 7), ("last", 12)], []),
]


@pytest.mark.parametrize("text, functions, rejects", CASES)
def test_complete_functions_stay(text, functions, rejects):
    found = scan(text)
    assert [(f["name"], f["start_line"]) for f in found["functions"]] == functions
    assert [r["start_line"] for r in found["rejects"]] == rejects
    assert found["open_depth"] == 0


def test_long_bodies_are_whole():
    (f, *_) = scan(NESTED)["functions"]
    assert f["body"].startswith("int f(int a)") and f["body"].endswith("return a; }") and f["end_line"] == 7
