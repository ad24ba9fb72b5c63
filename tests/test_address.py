import re

import pytest
from corvane.functions import address as A
from hypothesis import given, settings
from hypothesis import strategies as st


def slow(pattern, text):
    """A matcher by recursion over wildcards only."""

    def go(p, t):
        if not p:
            return not t
        if p[:2] == "**":
            rest = p[2:].lstrip("*")
            if rest[:1] == "/" and go(rest[1:], t) and (not done(p, t)):
                return True
            return any(go(rest, t[i:]) for i in range(len(t) + 1))
        if p[0] == "*":
            end = t.find("/")
            return any(go(p[1:], t[i:]) for i in range((len(t) if end < 0 else end) + 1))
        if p[0] == "?":
            return bool(t) and t[0] != "/" and go(p[1:], t[1:])
        return bool(t) and t[0] == p[0] and go(p[1:], t[1:])

    def done(p, t):
        return False

    return go(pattern, text)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "/", "*", "**", "?", "."]), max_size=7), st.lists(st.sampled_from(["a", "b", "/", "."]), max_size=7))
def test_globs_equal_a_slow_matcher(parts, text):
    pattern, text = "".join(parts), "".join(text)
    if "***" in pattern or re.search(r"[^/]\*\*/|^\*\*/", pattern):
        return  # there ``**/`` may stand for no segment, which the slow matcher only knows after a slash
    fast = re.match(A.glob_regex(pattern), text) is not None
    assert fast == slow(pattern, text)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab/[]{}*?;%.()+^$|\\ é", min_size=1, max_size=12))
def test_an_escaped_path_matches_itself_alone(path):
    escaped = "".join(f"%{ord(c):X}" if c in A.META else c for c in path)
    if escaped.startswith("!") or escaped != escaped.strip() or re.search("%[0-9A-Fa-f]{2}", path):
        return
    scope = A.Scope.parse(escaped)
    assert scope.matches(path) and not scope.matches(path + "x")


def test_columns_agree_with_python(spark):
    uris = ["doc:///en/src0/1", "doc:///en/src10/1", "doc:///fr/x", "doc:///fr/x/y/z", "a[b].c", "", None]
    df = spark.createDataFrame([(u,) for u in uris], "uri string")
    for pattern in ("doc:///en/**", "doc:///*/x", "**;!**/x", "doc:///{en,fr}/**;!doc:///en/src1?/*", "a%5Bb%5D.c", "doc:///en/src0/1", "!**", ""):
        scope = A.Scope.parse(pattern)
        got = [r[0] for r in df.select(scope.column(df.uri)).collect()]
        assert got == [scope.matches(u) for u in uris], pattern


def test_segments_never_lose_a_row(spark):
    rows = [(lang, src) for lang in ("en", "fr") for src in ("src0", "src1")]
    df = spark.createDataFrame(rows, "lang string, source string")
    for pattern in ("doc:///en/**", "doc:///*/src1/*", "doc:///{en,fr}/src0/*", "**", "file:///x", "doc:///en/src0/1;doc:///fr/**", "!doc:///en/**", "doc:///e*/**"):
        scope = A.Scope.parse(pattern)
        kept = {tuple(r) for r in df.filter(scope.segments("doc:///", ["lang", "source"])).collect()}
        need = {r for r in rows if scope.matches(f"doc:///{r[0]}/{r[1]}/1")}
        assert need <= kept, pattern


def test_addresses_are_parsed_and_unknown_parts_refused():
    a, b = A.parse_address("file:///a.cs#symbol=Foo;file:///b.cs;!**/t/** => find: some words")
    assert a.pattern == "file:///b.cs;!**/t/**" and b.symbol == "Foo" and b.argument == "some words"
    for bad in ("x => nonsense", "x#row=1"):
        with pytest.raises(ValueError):
            A.parse_address(bad)


def test_parts_of_an_address(spark):
    df = spark.createDataFrame([("github://acme/w/a.md#line=3",), ("file:///x",), ("none",)], "u string")
    rows = [r[0] for r in df.select(A.uri_parts(df.u)).collect()]
    assert tuple(rows[0]) == ("github", "acme", "w/a.md", "line=3") and rows[1]["authority"] is None and rows[2]["scheme"] is None
