"""Addresses: scheme://authority/path, globs joined with ``;``, exclusions with ``!``, fragments and modifiers.

A glob is compiled once, on the driver, to an anchored regular expression and its literal prefix. The prefix goes into
the plan as ``startswith``, which Parquet understands; the expression is only tried on rows that pass it.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that a glob reads as its own; in a literal address they are percent-encoded.
META = "*?[{;"
#: Characters whose percent escapes a glob takes for the character itself.
ESCAPED = META + "]}!,"


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in ".^$+(){}[]|\\*?" else c for c in text)


def _decoded(text: str) -> str:
    """Percent escapes of glob characters become the characters; any other ``%`` is itself."""
    return re.sub("%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)) if chr(int(m[1], 16)) in ESCAPED else m[0], text)


def _parts(glob: str) -> list[tuple[str, str]]:
    """(kind, text) of a glob term: literal, any (**), some (*), one (?), class ([...]), open, comma and close of braces."""
    out: list[tuple[str, str]] = []
    at, depth, literal = 0, 0, ""

    def flush() -> None:
        nonlocal literal
        if literal:
            out.append(("literal", _decoded(literal)))
            literal = ""

    while at < len(glob):
        c = glob[at]
        if c == "*":
            flush()
            end = at
            while end < len(glob) and glob[end] == "*":
                end += 1
            out.append(("any" if end - at > 1 else "some", ""))
            at = end
            continue
        close = glob.find("]", at + 2) if c == "[" else -1
        if c == "?":
            flush()
            out.append(("one", ""))
        elif close > 0:
            flush()
            out.append(("class", glob[at + 1 : close]))
            at = close
        elif c == "{" and "}" in glob[at:]:
            flush()
            depth += 1
            out.append(("open", ""))
        elif depth and c in ",}":
            flush()
            depth -= c == "}"
            out.append(("comma" if c == "," else "close", ""))
        else:
            literal += c
        at += 1
    flush()
    return out


def _class(body: str) -> str:
    negated = body[:1] in ("!", "^")
    body = body[1:] if negated else body
    safe = "".join("\\" + c if c in "\\[]^&~" else c for c in body)
    return f"[^/{safe}]" if negated else f"[{safe}]"


def glob_regex(glob: str) -> str:
    """One term as an anchored expression; ``**/`` also stands for no segment at all."""
    out, parts = [], _parts(glob)
    skip = False
    for i, (kind, text) in enumerate(parts):
        if kind == "any":
            after = parts[i + 1] if i + 1 < len(parts) else ("", "")
            before = out[-1] if out else "/"
            if after[0] == "literal" and after[1].startswith("/") and before.endswith("/"):
                out.append("(?:.*/)?")
                skip = True
            else:
                out.append(".*")
            continue
        if kind == "literal":
            out.append(_quoted(text[1:] if skip else text))
            skip = False
        else:
            out.append({"some": "[^/]*", "one": "[^/]", "open": "(?:", "comma": "|", "close": ")"}.get(kind) or _class(text))
    return "(?s)^" + "".join(out) + "$"


def glob_prefix(glob: str) -> str:
    """What every match of the term starts with."""
    parts = _parts(glob)
    if not parts or parts[0][0] != "literal":
        return ""
    return parts[0][1]


@dataclass(frozen=True)
class Scope:
    """A compiled address pattern: a row is in when some include matches and no exclude does.

    Without any include, everything is included.
    """

    include: tuple[str, ...] = field(default_factory=tuple)
    exclude: tuple[str, ...] = field(default_factory=tuple)

    @classmethod
    def parse(cls, pattern: str | None) -> Scope:
        terms = [t.strip() for t in (pattern or "").split(";") if t.strip()]
        return cls(tuple(t for t in terms if not t.startswith("!")), tuple(t[1:].strip() for t in terms if t.startswith("!")))

    def column(self, uri: Column) -> Column:
        """The predicate over a uri column; a null uri is in no scope."""
        kept = F.lit(False) if self.include else F.lit(True)
        for term in self.include:
            kept = kept | _term(uri, term)
        for term in self.exclude:
            kept = kept & ~_term(uri, term)
        return F.coalesce(kept & uri.isNotNull(), F.lit(False))

    def segments(self, base: str, columns: Sequence[str]) -> Column:
        """What the scope asks of columns that hold the path segments after ``base``; true where it asks nothing.

        It is implied by column() and made of plain equalities, so it prunes partitions and is pushed to Parquet
        where the uri itself is computed.
        """
        if not self.include:
            return F.lit(True)
        out = F.lit(False)
        for term in self.include:
            want = F.lit(True)
            if term.startswith(base):
                for name, segment in zip(columns, term[len(base) :].split("/"), strict=False):
                    if "*" in segment and "**" in segment:
                        break
                    if not re.search(r"[*?\[{]", segment):
                        want = want & (F.col(name) == _decoded(segment))
            elif not re.search(r"[*?\[{]", term[: len(base)]):
                want = F.lit(False)
            out = out | want
        return out

    def matches(self, uri: str | None) -> bool:
        """The same predicate in Python, for driver-side addresses."""
        if uri is None:
            return False
        hit = lambda t: re.match(glob_regex(t), uri) is not None
        return (not self.include or any(map(hit, self.include))) and not any(map(hit, self.exclude))


def _term(uri: Column, term: str) -> Column:
    prefix, parts = glob_prefix(term), _parts(term)
    if [k for k, _ in parts] in ([], ["literal"]):
        return uri == prefix
    if [k for k, _ in parts] == ["literal", "any"]:
        return uri.startswith(prefix)
    exact = uri.rlike(glob_regex(term))
    return uri.startswith(prefix) & exact if prefix else exact


def in_scope(uri: Column, pattern: str | None) -> Column:
    return Scope.parse(pattern).column(uri)


def matches_glob(uri: Column, pattern: Column) -> Column:
    """The predicate where the pattern is a column too: its regular expression is built by the engine, row by row.

    Covers ``** * ?`` and percent escapes, alternatives by ``;`` and exclusions by ``!``; braces and classes are for
    patterns known to the driver.
    """
    terms = F.filter(F.transform(F.split(pattern, ";"), lambda t: F.trim(t)), lambda t: t != "")
    inc = F.filter(terms, lambda t: ~t.startswith("!"))
    exc = F.transform(F.filter(terms, lambda t: t.startswith("!")), lambda t: F.substring(t, F.lit(2), F.length(t)))
    hit = lambda t: F.regexp_like(uri, pattern_regex(t))
    return ((F.size(inc) == 0) | F.exists(inc, hit)) & ~F.exists(exc, hit)


def pattern_regex(term: Column) -> Column:
    """glob_regex() as a column, for the wildcards of matches_glob()."""
    safe = F.regexp_replace(term, r"([.^$+(){}\[\]|\\])", r"\\$1")
    for char in ESCAPED:
        safe = F.replace(safe, F.lit(f"%{ord(char):X}"), F.lit(f"\\{char}"))
    marks = (("/**/", "\u0001"), ("**", "\u0002"), ("\\*", "\u0003"), ("\\?", "\u0004"), ("*", "[^/]*"), ("?", "[^/]"))
    for old, new in marks:
        safe = F.replace(safe, F.lit(old), F.lit(new))
    for old, new in (("\u0001", "/(?:.*/)?"), ("\u0002", ".*"), ("\u0003", "\\*"), ("\u0004", "\\?")):
        safe = F.replace(safe, F.lit(old), F.lit(new))
    return F.concat(F.lit("(?s)^"), safe, F.lit("$"))


def literal_target(path: Column) -> Column:
    """A path whose glob characters are percent-encoded; ``%`` stays."""
    for char in META:
        path = F.replace(path, F.lit(char), F.lit(f"%{ord(char):X}"))
    return path


def strip_addressing(address: Column) -> Column:
    """What is read, without how: no modifier, no fragment."""
    return F.trim(F.split_part(F.split_part(address, F.lit(" =>"), F.lit(1)), F.lit("#"), F.lit(1)))


def scheme(uri: Column) -> Column:
    """The text through ``://``, or all of it."""
    at = F.instr(uri, "://")
    return F.when(at > 0, F.substring(uri, F.lit(1), at + 2)).otherwise(uri)


def uri_parts(uri: Column) -> Column:
    """struct<scheme, authority, path, fragment>; an absent authority or fragment is null."""
    got = lambda i: F.nullif(F.regexp_extract(uri, r"^([a-z][a-z0-9+.-]*)://([^/#]*)([^#]*)(?:#(.*))?$", i), F.lit(""))
    return F.struct(got(1).alias("scheme"), got(2).alias("authority"), F.ltrim(got(3), F.lit("/")).alias("path"), got(4).alias("fragment"))


@dataclass(frozen=True)
class Address:
    """One parsed address: the pattern of files, the slice of each, and what to do with them."""

    pattern: str
    symbol: str | None = None
    lines: tuple[int, int] | None = None
    pages: tuple[int, int] | None = None
    modifier: str | None = None
    argument: str | None = None


MODIFIERS = ("tree", "structure", "headline", "content", "history", "blame", "changes", "lint", "find", "similar", "grep", "regex", "question", "references", "coverage", "concepts")


def parse_address(text: str) -> list[Address]:
    """``uri[#fragment][;uri[#fragment]...][ => modifier[: argument]]``, exclusions going with every term.

    Terms without a fragment are one address; each sliced term is one of its own.
    """
    body, arrow, tail = text.partition(" => ")
    modifier, argument = None, None
    if arrow:
        name, colon, rest = tail.partition(":")
        modifier, argument = name.strip().lower(), rest.strip() if colon else None
        if modifier not in MODIFIERS:
            raise ValueError(f"unknown modifier {modifier!r}; known: {', '.join(MODIFIERS)}")
    terms = [t.strip() for t in body.split(";") if t.strip()]
    but = "".join(f";{t}" for t in terms if t.startswith("!"))
    plain = [t for t in terms if not t.startswith("!") and "#" not in t]
    out = [Address(";".join(plain) + but, modifier=modifier, argument=argument)] if plain or not terms or all(t.startswith("!") for t in terms) else []
    for term in terms:
        if term.startswith("!") or "#" not in term:
            continue
        uri, _, fragment = term.partition("#")
        kind, _, value = fragment.partition("=")
        if kind == "symbol":
            out.append(Address(uri + but, symbol=value, modifier=modifier, argument=argument))
        elif kind in ("line", "page"):
            first, _, last = value.partition(",")
            span = (int(first), int(last or first))
            out.append(Address(uri + but, **{kind + "s": span}, modifier=modifier, argument=argument))
        else:
            raise ValueError(f"unknown fragment {fragment!r}; known: symbol, line, page")
    return out


def symbol_filter(name: Column, wanted: str) -> Column:
    """Qualified names by a fragment: exact, ``X.*`` direct members, ``X.**`` all below, other ``*`` within a name part."""
    if wanted.endswith(".**"):
        return name.startswith(wanted[:-2])
    if wanted.endswith(".*"):
        base = wanted[:-1]
        return name.startswith(base) & ~F.contains(F.substring(name, F.lit(len(base) + 1), F.length(name)), F.lit("."))
    if "*" in wanted:
        return name.rlike("^(?:.*\\.)?" + _quoted(wanted).replace("\\*", "[^.]*") + "$")
    return (name == wanted) | name.endswith("." + wanted)
