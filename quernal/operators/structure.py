"""Structure of source files without tree-sitter: top-level units and definitions, by scanners of our own.

A unit of more than LARGEST bytes is cut at its members, and so are they, as long as there are any.  Boundaries are
approximate for brace languages; names, kinds and lines of definitions are what callers rely on.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left
from collections.abc import Iterator

TARGET, LARGEST = 1500, 3000
_W = r"([A-Za-z_$][\w$]*)"
# (kind, pattern) by language; group 1 is the name.  Kinds follow the capture map of the data model.
_DEFINITIONS: dict[str, list[tuple[str, str]]] = {
    "rust": [("function", rf"\bfn\s+{_W}"), ("struct", rf"\bstruct\s+{_W}"), ("enum", rf"\benum\s+{_W}"), ("trait", rf"\btrait\s+{_W}"), ("module", rf"\bmod\s+{_W}"), ("constant", rf"\b(?:const|static(?:\s+mut)?)\s+(?!fn\b|mut\b){_W}\s*:"), ("type", rf"\btype\s+{_W}")],
    "javascript": [("function", rf"\bfunction\s*\*?\s*{_W}"), ("class", rf"\bclass\s+{_W}"), ("method", rf"(?m)^\s+(?:static\s+|async\s+|get\s+|set\s+|\*\s*)*(?!if\b|for\b|while\b|switch\b|catch\b|function\b|return\b|with\b){_W}\s*\([^;{{}}]*\)\s*\{{")],
    "typescript": [("function", rf"\bfunction\s*\*?\s*{_W}"), ("class", rf"\bclass\s+{_W}"), ("interface", rf"\binterface\s+{_W}"), ("type", rf"(?m)^\s*(?:export\s+|declare\s+)*type\s+{_W}\s*(?:<[^=]*>)?\s*="), ("enum", rf"\benum\s+{_W}"), ("method", rf"(?m)^\s+(?:public\s+|private\s+|protected\s+|static\s+|async\s+|readonly\s+|get\s+|set\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|function\b|return\b){_W}\s*(?:<[^>(]*>)?\([^;{{}}]*\)\s*(?::[^;{{}}=]+)?\{{")],
    "java": [("class", rf"\b(?:class|record)\s+{_W}"), ("interface", rf"\binterface\s+{_W}"), ("enum", rf"\benum\s+{_W}"), ("method", rf"(?m)^\s*(?:@\w+\s+)*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)\s+)*(?:<[^>]+>\s*)?(?!return\b|new\b|else\b|throw\b)[A-Za-z_][\w.<>\[\], ?]*\s+(?!if\b|for\b|while\b|switch\b|catch\b){_W}\s*\([^;{{}}]*\)\s*(?:throws\s+[\w., ]+)?[{{;]")],
    "go": [("method", rf"(?m)^func\s*\([^)]*\)\s*{_W}"), ("function", rf"(?m)^func\s+{_W}"), ("type", rf"(?m)^\s*type\s+{_W}"), ("constant", rf"(?m)^\s*const\s+{_W}")],
    "c": [("function", rf"(?m)^[A-Za-z_][\w\s]*?\b(?!if\b|for\b|while\b|switch\b|return\b|else\b){_W}\s*\([^;{{}}]*\)\s*\{{"), ("struct", rf"\b(?:struct|union)\s+{_W}"), ("enum", rf"\benum\s+{_W}")],
    "cpp": [("function", rf"(?m)^[A-Za-z_][\w\s:<>,]*?\b(?!if\b|for\b|while\b|switch\b|return\b|else\b){_W}\s*\([^;{{}}]*\)\s*(?:const\s*)?\{{"), ("class", rf"\b(?<!enum )class\s+{_W}"), ("struct", rf"\b(?:struct|union)\s+{_W}"), ("enum", rf"\benum\s+(?:class\s+)?{_W}"), ("type", rf"\busing\s+{_W}\s*=")],
    "ruby": [("method", r"(?m)^\s*def\s+(?:self\.|[A-Za-z_]\w*\.)?([A-Za-z_]\w*[?!=]?)"), ("class", r"(?m)^\s*class\s+([A-Z]\w*)"), ("module", r"(?m)^\s*module\s+([A-Z]\w*)")],
}
#: String literals and comments are blanked, with their lengths kept, before definitions are looked for.
_QUIET = {
    "ruby": r"""#[^\n]*|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'""",
    "rust": r"""//[^\n]*|/\*.*?\*/|r#*".*?"#*|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\\n])'""",
    "": r"""//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`""",
}
#: After a closing brace: the member goes on; after the end of a member: comments and blanks of its line are its own.
_GOES_ON, _REST_OF_LINE = re.compile(r"\s*(?:else\b|catch\b|finally\b|while\b|[;,.)\]?:=])"), re.compile(r"(?:[ \t\r]*\n)?")


def _quiet(source: str, language: str) -> str:
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    return re.sub(_QUIET.get(language, _QUIET[""]), blank, source, flags=re.S)


def definitions(source: str, language: str | None) -> list[tuple[str, str, int, int]]:
    """(name in lower case, kind, 1-based line, character offset) of definitions, in order, without repeats."""
    found: set[tuple[str, str, int, int]] = set()
    if language == "python":
        try:
            tree = ast.parse(source)
        except (SyntaxError, ValueError, RecursionError):
            return []
        starts = [0, *(m.end() for m in re.finditer("\n", source))]
        for node in ast.walk(tree):
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                kind = "class" if isinstance(node, ast.ClassDef) else "function"
                at = source.find(node.name, starts[node.lineno - 1])
                found.add((node.name.lower(), kind, node.lineno, at))
    else:
        quiet = _quiet(source, language or "")
        newlines = [m.start() for m in re.finditer("\n", quiet)]
        for kind, pattern in _DEFINITIONS.get(language or "", ()):
            for m in re.finditer(pattern, quiet):
                found.add((m[1].lower(), kind, bisect_left(newlines, m.start(1)) + 1, m.start(1)))
    return sorted(found, key=lambda d: (d[3], d[1]))


def _brace_units(source: str, language: str) -> Iterator[tuple[int, int]]:
    """Top-level statements: up to a ``;`` or a closing brace at depth 0."""
    quiet, depth, start = _quiet(source, language), 0, None
    for i, c in enumerate(quiet):
        if start is None and not source[i].isspace():
            start = i
        if c in "{([":
            depth += 1
        elif c in "})]":
            depth = max(0, depth - 1)
        if start is not None and depth == 0 and (c in "};" or (c == "\n" and language == "go")):
            yield start, i + 1
            start = None
    if start is not None:
        yield start, len(source.rstrip())


def _python_units(source: str) -> Iterator[tuple[int, int]]:
    starts = [0, *(m.end() for m in re.finditer("\n", source))]
    for node in ast.parse(source).body:
        first = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", ()))])
        end = len(source) if node.end_lineno >= len(starts) else starts[node.end_lineno]
        yield starts[first - 1], end


def _pattern_units(source: str, pattern: str) -> Iterator[tuple[int, int]]:
    """Units that begin where the pattern matches and end where the next begins."""
    cuts = sorted({0, *(m.start() for m in re.finditer(pattern, source))})
    yield from ((a, b) for a, b in zip(cuts, [*cuts[1:], len(source)], strict=True) if source[a:b].strip())


def units(source: str, language: str | None) -> list[tuple[int, int]]:
    """Character ranges of the file's units, none if there is no parser or the file can't be read."""
    try:
        if language == "python":
            return list(_python_units(source))
        if language == "ruby":
            return list(_pattern_units(source, r"(?m)^(?:class|module|def)\b"))
        if language == "markdown":
            return list(_pattern_units(source, r"(?m)^#{1,6}\s|(?<=\n\n)\S"))
        if language == "yaml":
            return list(_pattern_units(source, r"(?m)^(?:[^\s#:][^:\n]*:|- )"))
        if language == "json":
            return list(_pattern_units(source, r'(?m)^(?:\t|  )"'))
        if language in _DEFINITIONS:
            return list(_brace_units(source, language))
    except (SyntaxError, ValueError, RecursionError):
        pass
    return []


def _python_cuts(source: str, size) -> list[int]:
    """Line starts at which statements of more than LARGEST bytes are cut: those of the statements in them."""
    starts = [0, *(m.end() for m in re.finditer("\n", source))]
    cuts: list[int] = []
    waiting: list[ast.AST] = list(ast.parse(source).body)
    while waiting:
        node = waiting.pop()
        last = max((n.end_lineno for n in ast.walk(node) if hasattr(n, "end_lineno")), default=0)
        first = min((n.lineno for n in ast.walk(node) if hasattr(n, "lineno")), default=1)
        if size(starts[first - 1], starts[last] if last < len(starts) else len(source)) <= LARGEST:
            continue
        for field in ("body", "handlers", "orelse", "finalbody", "cases"):
            for child in getattr(node, field, None) if isinstance(getattr(node, field, None), list) else ():
                cuts.append(starts[min(n.lineno for n in ast.walk(child) if hasattr(n, "lineno")) - 1])
                waiting.append(child)
    return cuts


def _brace_cuts(quiet: str, start: int, end: int, go: bool) -> list[int]:
    """Ends of the members of a unit: a ``;``, ``,`` or closing brace one level inside its widest bracket, and the
    place after the opening of it."""
    opened: list[int] = []
    widest = (0, 0)
    for i in range(start, end):
        if quiet[i] in "{([":
            opened.append(i)
        elif quiet[i] in "})]" and opened:
            widest = max(widest, (i - opened[-1], -opened.pop()))
    if opened:  # left open: up to the end
        widest = max(widest, (end - opened[0], -opened[0]))
    if not widest[0]:
        return []
    first, depth, cuts = -widest[1], 0, [_REST_OF_LINE.match(quiet, 1 - widest[1]).end()]
    for i in range(first + 1, first + widest[0]):
        depth += (quiet[i] in "{([") - (quiet[i] in "})]")
        if depth == 0 and (quiet[i] in ";,}" or quiet[i] == "\n" and go):
            if quiet[i] != "}" or not _GOES_ON.match(quiet, i + 1):
                cuts.append(_REST_OF_LINE.match(quiet, i + 1).end())
    return [*cuts, first + widest[0]]


def _ruby_cuts(source: str, start: int, end: int) -> list[int]:
    """Starts of the definitions that are least indented below the unit's own line."""
    found = [(len(m[1].expandtabs(8)), m.start()) for m in re.finditer(r"(?m)^([ \t]+)(?:class|module|def)\b", source[start:end])]
    own = len(re.match(r"[ \t]*", source[start:end])[0].expandtabs(8))
    deeper = [f for f in found if f[0] > own]
    return [start + at for indent, at in deeper if indent == min(deeper)[0]]


def _indent_cuts(source: str, start: int, end: int, pattern: str) -> list[int]:
    """Starts of the least indented lines of the pattern after the unit's first line."""
    found = [(len(m[1].expandtabs(8)), m.start(1)) for m in re.finditer(rf"(?m)^([ \t]*){pattern}", source[start:end]) if m.start(1)]
    return [start + at for indent, at in found if indent == min(found)[0]]


#: Members of units without brackets: Ruby has definitions, YAML keys and items, Markdown items of lists.
_MEMBERS = {"yaml": r"(?:- |[^\s#:-][^:\n]*:)", "markdown": r"(?:[-*+]|\d+[.)])[ \t]"}


def descended(source: str, language: str | None, ranges: list[tuple[int, int]], size) -> list[tuple[int, int]]:
    """``ranges`` with those of more than LARGEST bytes cut at their members; ``size`` tells the bytes of a range.  The
    parts cover all of the unit; what has no members stays whole."""
    if language not in _DEFINITIONS and language not in ("python", "json", *_MEMBERS) or all(size(a, b) <= LARGEST for a, b in ranges):
        return ranges
    python = _python_cuts(source, size) if language == "python" else []
    quiet = _quiet(source, language or "")
    out: list[tuple[int, int]] = []
    waiting = sorted(ranges, reverse=True)
    while waiting:
        start, end = waiting.pop()
        cuts: list[int] = []
        if size(start, end) > LARGEST:
            if language in _MEMBERS:
                cuts = _indent_cuts(source, start, end, _MEMBERS[language])
            else:
                cuts = python if language == "python" else _ruby_cuts(source, start, end) if language == "ruby" else _brace_cuts(quiet, start, end, language == "go")
        cuts = sorted({c for c in cuts if start < c < end})
        if not cuts:
            out.append((start, end))
            continue
        parts = list(zip([start, *cuts], [*cuts, end], strict=True))
        if language == "python":
            out += parts
        else:
            waiting += reversed(parts)
    return out


def merged(ranges: list[tuple[int, int]], largest: int = LARGEST) -> list[tuple[int, int]]:
    """Neighbours at most one byte apart join while the whole stays within ``largest``."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1] + 1 and end - out[-1][0] <= largest:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def line_ranges(source: bytes, target: int = TARGET) -> list[tuple[int, int]]:
    """Greedy packing of whole lines, in bytes."""
    out, start, size = [], 0, 0
    for line in source.splitlines(keepends=True) if b"\r" not in source else re.findall(rb"[^\n]*\n|[^\n]+", source):
        if size and size + len(line) > target:
            out.append((start, start + size))
            start, size = start + size, 0
        size += len(line)
    return [*out, (start, start + size)] if size else out


def chunks(source: str, language: str | None) -> list[dict]:
    """Chunks of a file with their definitions; by lines where no structure is found."""
    if not source.strip():
        return []
    raw = source.encode()
    to_byte = [0]
    if len(raw) == len(source):
        at = lambda i: i
    else:
        for c in source:
            to_byte.append(to_byte[-1] + len(c.encode()))
        at = to_byte.__getitem__
    found = units(source, language)
    found = descended(source, language, found, lambda a, b: at(b) - at(a))
    ranges = merged([(at(a), at(b)) for a, b in found]) if found else line_ranges(raw)
    names = [(name, kind, line, at(offset)) for name, kind, line, offset in definitions(source, language)] if found else []
    newlines, places = [m.start() for m in re.finditer(b"\n", raw)], [place for *_, place in names]
    out = []
    for start, end in ranges:
        text = raw[start:end].decode("utf-8", "ignore")
        if not text:
            continue
        first = 1 + bisect_left(newlines, start)
        own = [{"name": n, "kind": k, "line": line} for n, k, line, _ in names[bisect_left(places, start) : bisect_left(places, end)]]
        out.append({"chunk_no": len(out), "start_byte": start, "end_byte": end, "start_line": first, "end_line": first + text.count("\n") - text.endswith("\n"), "content": text, "symbols": own})
    return out
