"""Source-text metrics of small snippets."""

from __future__ import annotations

import pytest

from chronoloom.functions import lexical as L
from chronoloom.operators import findings


def paths(text, name="a.js"):
    lang = L.language_of(name)
    toks = L.tokens(text, lang)
    return L.npath(toks, lang, L.Nesting(toks, lang))


@pytest.mark.parametrize("body, n", [
    ("x = 1;", 1), ("if (a) { b(); }", 2), ("if (a) { b(); } else { c(); }", 2), ("if (a) { x(); } else if (b) { y(); } else { z(); }", 3),
    ("if (a) { x(); } if (b) { y(); }", 4), ("if (a) { if (b) { y(); } }", 3), ("if (a && b) { x(); }", 3),
])
def test_npath(body, n):
    assert paths("function f() {\n" + body + "\n}\n") == n


def test_guards_that_return_add_up():
    guards = "\n".join(f"if (a{i}) {{ return {i}; }}" for i in range(4))
    assert paths("function f() {\n" + guards + "\n}\n") == 5


def test_empty_and_unknown(spark):
    got = {r.path: r for r in L.lexical_suite(spark.createDataFrame([("a.py", None), ("b.dart", ""), (None, "x"), ("c.zig", "if x { y }")], "path string, content string")).collect()}
    assert len(got) == 4 and got["a.py"].cyclomatic == 1 and got["a.py"].maintainability == 100.0 and got["b.dart"].npath == 1


def test_strings_and_comments_are_masked():
    lang = L.language_of("a.py")
    assert L.cyclomatic(L.tokens("x = 'if for while' # if if\n", lang), lang) == 1
    assert L.cyclomatic(L.tokens("if a:\n    pass\nelif b and c:\n    pass\n", lang), lang) == 3


@pytest.mark.parametrize("name, text, n", [
    ("a.js", "for (const x of xs) { use(x); }", 2),
    ("a.js", "while (p && q) { step(); }", 3),
    ("a.c", "do { step(); } while (more);", 2),
    ("a.js", "v = p ? 1 : 2;\nw = r || s || t;", 6),
    ("a.dart", "int? v; w = p?.q;", 1),
    ("a.c", "switch (k) { case 1: one(); break; case 2: if (p) { two(); } break; }", 4),
    ("a.c", "switch (k) { case 1: one(); break; case 2: if (p) { two(); } break; default: rest(); }", 4),
    ("a.java", "try { if (p) { go(); } } catch (Error e) { stop(); }", 4),
    ("a.js", "if (p) go(); else if (q) stay(); else leave();", 3),
    ("a.js", "if (p) { go(); }\nlist.map((v) => { if (v) { a(); } if (w) { b(); } });", 4),
    ("a.js", "if (p && q) { return; }\nrest();", 3),
    ("a.js", "for (;;) { if (p) { continue; } rest(); }", 3),
    ("a.js", "if (p) { go(); } else { return; }", 2),
    ("a.py", "def f():\n    if p and q:\n        go()\n    for v in vs:\n        use(v)\n", 6),
    ("a.py", "def f():\n    if p:\n        if q:\n            go()\n    elif r:\n        stay()\n", 4),
    ("a.py", "def f():\n    if p: return\n    if q: return\n    rest()\n\ndef g():\n    if p:\n        go()\n", 3),
    ("a.py", "def f():\n    try:\n        go()\n    except Error:\n        stop()\n", 2),
    ("a.rb", "def f\n  if p\n    go\n  elsif q\n    stay\n  end\n  rest unless r\nend\n", 6),
    ("a.rb", "def f\n  case k\n  when 1\n    one\n  when 2\n    two\n  else\n    rest\n  end\nend\n", 3),
    ("a.js", "if (a) { b(); }\n" * 40, 1 << 30),
])
def test_paths_of_snippets(name, text, n):
    assert paths(text, name) == n


def test_long_and_deep_texts():
    """Work is linear in tokens, and blocks may be nested as deep as they like."""
    lang = L.language_of("a.js")
    many = L.tokens("call(x = y + z);\n" * 60_000, lang)
    assert L.abc(many, lang) == (60_000, 60_000, 0)
    assert paths("{ if (a) " * 3000 + "{ b(); }" + " }" * 3000) > 1


@pytest.mark.parametrize("text, expected", [
    ("x = f(a) + g\n(b); y += 1; if (x == y) { h(); }", (2, 3, 2)), ("", (0, 0, 0)), ("if (a) b", (0, 0, 1)), ("a << b; c <<= d", (1, 0, 0)),
])
def test_assignments_calls_conditions(text, expected):
    lang = L.language_of("a.js")
    assert L.abc(L.tokens(text, lang), lang) == expected


@pytest.mark.parametrize("name, text, n", [
    ("a.js", "if (a) { for (;;) { if (b) { c(); } } }", 6), ("a.js", "if (a) { b(); } else if (c) { d(); } else { e(); }", 3), ("a.js", "x = a && b || c;", 2),
    ("a.py", "def f():\n    while a:\n        if b or c:\n            pass\n", 4), ("a.js", "switch (k) { case 1: break; }", 1),
])
def test_cognitive(name, text, n):
    lang = L.language_of(name)
    toks = L.tokens(text, lang)
    assert L.cognitive(toks, lang, L.Nesting(toks, lang)) == n


def test_halstead_and_maintainability():
    lang = L.language_of("a.js")
    assert L.halstead(L.tokens("x = x + 1;", lang), lang) == (3, 2, 3, 3)
    got = L.measure("a.js", "x = x + 1;\ny = 2;\n")
    assert got[0] == "javascript" and got[1] == 1 and got[-2:] == (0, 0.0) and 0 < got[12] <= 100


def test_nesting_by_style():
    for name, text, deepest in (("a.js", "if (a) { while (b) { c(); } }", 2), ("a.py", "if a:\n    for b in c:\n        d()\n", 2), ("a.rb", "if a\n  while b\n    c\n  end\nend\n", 2), ("a.lua", "if a then\n  repeat\n    c()\n  until b\nend\n", 2)):
        lang = L.language_of(name)
        n = L.Nesting(L.tokens(text, lang), lang)
        assert (n.deepest, n.frames) == (deepest, 2)


def test_top_churn_sources(spark):
    files = spark.createDataFrame([("a.py", "x"), ("b.py", "y" * 300_000), ("c.md", "z"), ("d.py", "w")], "path string, content string")
    churn = spark.createDataFrame([("a.py", 3), ("b.py", 9), ("c.md", 8), ("d.py", 5)], "file string, changes long")
    assert [r.path for r in L.top_churn_sources(churn, files).orderBy("changes").collect()] == ["a.py", "d.py"]


def test_own_languages_and_metrics(spark):
    own = L.Language("zig", (".zig",), L._set("if while"), line=("//",))
    files = spark.createDataFrame([("a.zig", "if x { y } // if"), ("b.py", "if a:\n    pass\n")], "path string, content string")
    got = {r.path: r for r in L.lexical_suite(files, (own,), {"words": lambda toks, lang: sum(t[0] == L.WORD for t in toks)}).collect()}
    assert got["a.zig"].language == "zig" and got["a.zig"].cyclomatic == 2 and got["a.zig"].words == 3 and got["b.py"].words == 3


def test_files_are_measured_once(spark):
    """However often the findings use the metrics; they measured each file again for every use before."""
    seen = spark.sparkContext.accumulator(0)

    def count(toks, lang):
        seen.add(1)
        return 0.0

    files = spark.createDataFrame([(f"a{i}.py", "if a:\n    b()\n" * 30) for i in range(20)], "path string, content string")
    got = findings.classify_lexical(L.lexical_suite(files, (), {"count": count}))
    assert len(got.collect()) == 20 and seen.value == 20


def test_runs_of_plain_tokens_change_no_metric():
    """What is left out for languages of braces, next to what isn't: jumps, directives, lambdas, ternaries."""
    for text in ("#if a\nif (b) { return x; } y.z(1) é { }", "f(a => { if (a ? b.c, 2 : 3) go 1.5 é; break x }) x ", "if (a) { return; x } else if b c", "switch (a) { case 1: x y. z; default: if (a) b }"):
        for name in ("a.c", "a.js", "a.txt"):
            lang = L.language_of(name)
            toks = L.tokens(text, lang)
            told = L.telling(toks, lang)
            whole, some = L.Nesting(toks, lang), L.Nesting(told, lang)
            assert len(told) < len(toks) and (whole.deepest, whole.frames, whole.total) == (some.deepest, some.frames, some.total)
            assert (L.cognitive(toks, lang, whole), L.npath(toks, lang, whole)) == (L.cognitive(told, lang, some), L.npath(told, lang, some))
