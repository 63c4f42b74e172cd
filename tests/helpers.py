"""Random inputs for the stateful jobs."""

from __future__ import annotations

import random
import re
from itertools import accumulate

LINES_SCHEMA = "repo string, path string, line_no int, text string"

POOL = [
    "func A(x int) {", "func (s *T) B() {", "func C()", "}", "}", "}", "\t}", "} else {", "}}", "\tfor i := range xs {",
    "for _, v := range items {", "\tgo func() {", "v := v", "a, b := b, a", "x := y", "defer f.Close()", "\tdefer g()",
    "// comment", "//", "// TODO: a", "//FIXME b", "", "", "type S struct {", "type L struct {", "\tmu sync.Mutex",
    "\tsync.RWMutex", "type I interface {", "func use(s S, n int) {", "func lend(s *S) {", "func (l L) m(a L) {",
    "import (", ")", '\t"fmt"', 'import "os"', "package p", "out = append(out, v)", "var out []string",
    "r := make([]int, 0)", "for rows.Next() {", "rows.Err()", "rows.Close()", "b := []byte(s)", "resp, err := http.Get(u)",
    "defer resp.Body.Close()", "err := f()", "\terr := g()", "\t\tx, err := h()", "if err != nil {", "require.NoError(t, e)",
    "\tx := é.(T)", "noise é", "func D(a, b L) { return }",
]


def random_files(n: int, longest: int, seed: int, suffix: str = ".go") -> dict[str, list[str]]:
    rng = random.Random(seed)
    out = {}
    for i in range(n):
        size = rng.randint(1, longest)
        few = rng.sample(POOL, rng.randint(4, len(POOL)))
        name = f"d/f{i}_test.go" if suffix == ".go" and i % 4 == 0 else f"d/f{i}{suffix}"
        out[name] = [rng.choice(few) for _ in range(size)]
    return out


def as_rows(files: dict[str, list[str]]):
    return [("r", p, i + 1, t) for p, ls in files.items() for i, t in enumerate(ls)]


def rx(pattern: str, s: str):
    return re.search(pattern, s, re.ASCII)


def balance(lines: list[str]) -> list[int]:
    """Opened less closed braces up to and including each line."""
    return list(accumulate(line.count("{") - line.count("}") for line in lines))
