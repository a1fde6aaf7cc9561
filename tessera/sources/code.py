"""Symbols of source code: Python by its own grammar, the other languages by one scanner that knows strings and comments.

The scanner is an approximation of full grammars: it sees declarations introduced by keywords, C-like function heads and
blocks in braces, and it is declared as such. Columns are those of a symbol row.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right

from tessera.functions.text import LANGUAGES

# Kinds of symbols.
KINDS = (
    "function", "class", "interface", "struct", "enum", "type", "variable", "constant", "module", "namespace", "method",
    "property", "unknown",
)
SYMBOL_SCHEMA = (
    "name string, kind string, line int, col int, end_line int, end_col int, scope string, is_exported boolean, signature string"
)
_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|partial|async|virtual|override|readonly|const|unsafe|extern|new|synchronized|native|default|export|declare|inline|explicit|constexpr|friend)\s+)*"
_NAME = r"(?P<name>[A-Za-z_$]\w*)"
# Declarations at the start of a statement: language to (pattern, kind), first match wins.
_HEADS = {
    "rust": [
        (r"(?P<pub>pub(?:\([^)]*\))?\s+)?(?:default\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+\"[^\"]*\"\s+)?fn\s+" + _NAME, "function"),
        (r"(?P<pub>pub(?:\([^)]*\))?\s+)?struct\s+" + _NAME, "struct"),
        (r"(?P<pub>pub(?:\([^)]*\))?\s+)?enum\s+" + _NAME, "enum"),
        (r"(?P<pub>pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+" + _NAME, "interface"),
        (r"(?:unsafe\s+)?impl(?:\s*<[^{]*?>)?\s+(?:[\w:<>,\s&']+?\s+for\s+)?(?:&?\s*)(?:\w+::)*" + _NAME, "class"),
    ],
    "javascript": [
        (r"(?P<pub>export\s+(?:default\s+)?)?(?:async\s+)?function\s*\*?\s*" + _NAME, "function"),
        (r"(?P<pub>export\s+(?:default\s+)?)?(?:abstract\s+)?class\s+" + _NAME, "class"),
    ],
    "go": [
        (r"func\s+\([^)]*\)\s*" + _NAME, "method"),
        (r"func\s+" + _NAME, "function"),
        (r"type\s+" + _NAME, "type"),
    ],
    "csharp": [
        (r"namespace\s+(?P<name>[\w.]+)", "namespace"),
        (r"(?P<pub>" + _MODS + r")class\s+" + _NAME, "class"),
        (r"(?P<pub>" + _MODS + r")record(?:\s+(?:class|struct))?\s+" + _NAME, "class"),
        (r"(?P<pub>" + _MODS + r")interface\s+" + _NAME, "interface"),
        (r"(?P<pub>" + _MODS + r")struct\s+" + _NAME, "struct"),
        (r"(?P<pub>" + _MODS + r")enum\s+" + _NAME, "enum"),
    ],
    "java": [
        (r"(?P<pub>" + _MODS + r")class\s+" + _NAME, "class"),
        (r"(?P<pub>" + _MODS + r")@?interface\s+" + _NAME, "interface"),
        (r"(?P<pub>" + _MODS + r")enum\s+" + _NAME, "enum"),
    ],
    "c": [(r"(?:typedef\s+)?struct\s+" + _NAME, "struct"), (r"(?:typedef\s+)?enum\s+" + _NAME, "enum")],
    "cpp": [
        (r"(?:template\s*<[^{;]*?>\s*)?class\s+" + _NAME, "class"),
        (r"(?:template\s*<[^{;]*?>\s*)?(?:typedef\s+)?struct\s+" + _NAME, "struct"),
        (r"enum(?:\s+class)?\s+" + _NAME, "enum"),
        (r"namespace\s+(?P<name>[\w:]+)", "namespace"),
    ],
}
_HEADS["typescript"] = [
    *_HEADS["javascript"],
    (r"(?P<pub>export\s+(?:default\s+)?)?(?:declare\s+)?interface\s+" + _NAME, "interface"),
    (r"(?P<pub>export\s+)?(?:declare\s+)?type\s+" + _NAME + r"(?=\s*(?:<[^=]*>)?\s*=)", "type"),
]
# Members and C-like functions: a name before "(" whose ")" is followed by a body.
_TYPED = r"(?P<pub>" + _MODS + r")(?:[\w:<>,.\[\]?*&~]+[\s*&]+)+?[*&\s]*(?:\w+::)*(?P<name>~?[A-Za-z_]\w*)\s*\([^;{}]*\)[^;{}=]*"
_MEMBER = {
    "csharp": (r"(?P<pub>" + _MODS + r")(?:[\w<>,.\[\]?]+\s+)?(?P<name>[A-Za-z_]\w*)\s*\([^;{}]*\)[^;{}=]*", "method"),
    "java": (r"(?P<pub>" + _MODS + r")(?:<[^>]*>\s*)?(?:[\w<>,.\[\]?]+\s+)?(?P<name>[A-Za-z_]\w*)\s*\([^;{}]*\)[^;{}=]*", "method"),
    "c": (_TYPED, "function"),
    "cpp": (_TYPED, "function"),
    "javascript": (r"(?P<pub>" + _MODS + r")(?:get\s+|set\s+|\*\s*)?#?(?P<name>[A-Za-z_$][\w$]*)\s*\([^;{}]*\)[^;{}=]*", "method"),
}
_MEMBER["typescript"] = _MEMBER["javascript"]
#: A C# member with a block but no parentheses is a property.
_PROPERTY = r"(?P<pub>" + _MODS + r")[\w<>,.\[\]?]+\s+" + _NAME + r"\s*"
_NOT_NAMES = frozenset("if for while switch catch return do else try using lock foreach fixed with function new sizeof".split())
_CONTAINERS = ("class", "interface", "struct", "enum", "namespace")


def language_key(language: str) -> str | None:
    """Grammar of a language name or file extension; None where there is none (C# compresses as unknown text)."""
    name = LANGUAGES.get(language, language)
    return name if name in ("rust", "typescript", "javascript", "python", "go", "html", "c", "cpp", "java") else None


class Scan:
    """Comments (start, end) of a text, and the text with comments and string contents blanked, places unchanged."""

    def __init__(self, text: str, language: str):
        self.comments: list[tuple[int, int]] = []
        out, at = list(text), 0
        if language == "html":
            pattern = re.compile(r"(?P<c><!--.*?(?:-->|\Z))", re.S)
        elif language == "python":
            pattern = re.compile(r"(?P<s>\"\"\".*?\"\"\"|'''.*?'''|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')|(?P<c>#[^\n]*)", re.S)
        else:
            quotes = r"\"(?:\\.|[^\"\\])*\"" + (r"|'(?:\\.|[^'\\\n])'" if language == "rust" else r"|'(?:\\.|[^'\\\n])*'")
            if language in ("javascript", "typescript", "go"):
                quotes += r"|`(?:\\.|[^`\\])*`"
            pattern = re.compile(rf"(?P<s>{quotes})|(?P<c>//[^\n]*|/\*.*?(?:\*/|\Z))", re.S)
        for m in pattern.finditer(text):
            at = m.start()
            if m.lastgroup == "c":
                self.comments.append(m.span())
                blank = range(at, m.end())
            else:
                blank = range(at + 1, m.end() - 1)
            for i in blank:
                if out[i] != "\n":
                    out[i] = " "
        self.code = "".join(out)


def _close(code: str, at: int) -> int:
    """End of the block whose brace is at `at`."""
    depth = 0
    for m in re.finditer(r"[{}]", code[at:]):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return at + m.end()
    return len(code)


def _statements(code: str, start: int, end: int):
    """(start, body or None, end) of the statements between two places, blocks in braces kept whole."""
    at = start
    while at < end:
        while at < end and (code[at].isspace() or code[at] in ";,)}"):
            at += 1
        if at >= end:
            return
        if code[at] == "#":  # a preprocessor line or attribute
            if code[at : at + 2] == "#[":
                stop = code.find("]", at) + 1 or end
            else:
                stop = code.find("\n", at)
                stop = end if stop < 0 else stop
            at = min(stop, end)
            continue
        depth, i = 0, at
        while i < end:
            ch = code[i]
            if ch in "([":
                depth += 1
            elif ch in ")]":
                depth -= 1
            elif ch == "{" and depth <= 0:
                stop = min(_close(code, i), end)
                yield at, i, stop
                at = stop
                break
            elif ch == ";" and depth <= 0 or ch == "\n" and depth <= 0 and re.match(r"\s*(?:func|type|import|package|var|const|export|class|interface|@)\b|\s*@", code[i:end]):
                yield at, None, i + (ch == ";")
                at = i + 1
                break
            i += 1
        else:
            yield at, None, end
            return


_MARKUP = re.compile(
    r"(?P<comment><!--.*?(?:-->|\Z))|(?P<doctype><!.*?(?:>|\Z))|<(?P<raw>script|style)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/)?(?P<name>[A-Za-z][^\s/>]*)(?:\"[^\"]*\"|'[^']*'|[^'\">])*?(?P<empty>/)?>",
    re.S | re.I,
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


def _html_nodes(text: str) -> list[tuple[int, None, int]]:
    """Top-level elements, declarations and runs of text; comments between them are none. An open element ends with the text."""
    out: list[tuple[int, None, int]] = []
    open_: list[str] = []
    at = 0  # where the element or text that is not yet in `out` begins
    for m in _MARKUP.finditer(text):
        name = (m["name"] or "").lower()
        if open_:
            if m["end"] and name in open_:
                while open_.pop() != name:
                    pass
                if not open_:
                    out.append((at, None, m.end()))
                    at = m.end()
            elif name and not (m["end"] or m["empty"] or name in _VOID):
                open_.append(name)
            continue
        out.append((at, None, m.start()))
        at = m.start()
        if name and not (m["end"] or m["empty"] or name in _VOID):
            open_.append(name)
        else:
            if not m["comment"]:
                out.append((at, None, m.end()))
            at = m.end()
    out.append((at, None, len(text)))
    return [(a, b, c) for a, b, c in ((a + len(text[a:c]) - len(text[a:c].lstrip()), b, c) for a, b, c in out) if a < c]


def declarations(text: str, language: str) -> list[tuple[int, int | None, int]]:
    """Top-level (start, body, end): body is where a container's or function's block begins, None for other text."""
    if language == "python":
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError):
            return [(0, None, len(text))]
        starts = _line_starts(text)
        out = []
        for node in tree.body:
            first = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])
            end = starts[node.end_lineno] if node.end_lineno < len(starts) else len(text)
            body = None
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                line = node.body[0].lineno
                body = text.rfind(":", starts[first - 1], starts[line - 1] + node.body[0].col_offset) + 1
            out.append((starts[first - 1], body, end))
        return out
    if language == "html":
        return _html_nodes(text)
    code = Scan(text, language).code
    out = []
    for start, body, end in _statements(code, 0, len(code)):
        container = body is not None and _head(code[start:body], language, False) is not None
        out.append((start, body if container else None, end))
    return out


def _line_starts(text: str) -> list[int]:
    return [0, *(m.end() for m in re.finditer("\n", text))]


def _head(head: str, language: str, member: bool):
    clean = re.sub(r"^(?:\s*(?:@\w+(?:\([^)]*\))?|\[[^\]]*\]))+\s*", lambda m: " " * len(m[0]), head)
    pad = len(clean) - len(clean.lstrip())
    for pattern, kind in _HEADS.get(language, ()):
        m = re.match(pattern + r"\b", clean[pad:])
        if m:
            return m, kind
    if language in _MEMBER and (member or language in ("c", "cpp")):
        pattern, kind = _MEMBER[language]
        m = re.fullmatch(pattern, clean[pad:].rstrip() + " ")
        if m and m["name"] not in _NOT_NAMES:
            return m, kind
    if language == "csharp" and member:
        m = re.fullmatch(_PROPERTY, clean[pad:])
        if m:
            return m, "property"
    return None


def _public(match, language: str, inherited: bool) -> bool:
    groups = match.groupdict()
    words = (groups.get("pub") or "").split()
    if language in ("javascript", "typescript"):
        return inherited or "export" in words
    if language in ("csharp", "java"):
        return "public" in words
    return bool(words) and language == "rust"


def code_symbols(language: str, text: str) -> list[tuple]:
    """Symbols of a text in order, as rows of SYMBOL_SCHEMA; none for languages without a grammar here."""
    if language == "python":
        return _python_symbols(text)
    if language not in _HEADS:
        return []
    code, starts, found = Scan(text, language).code, _line_starts(text), []

    def place(at: int) -> tuple[int, int]:
        line = bisect_right(starts, at)
        return line, at - starts[line - 1] + 1

    def visit(start: int, end: int, scope: str | None, member: bool, exported: bool) -> None:
        for at, body, stop in _statements(code, start, end):
            head = _head(code[at : body if body is not None else stop], language, member)
            inner, public = scope, exported
            if head and (body is not None or head[1] not in ("method", "function")):
                match, kind = head
                public = _public(match, language, exported)
                (line, col), (end_line, end_col) = place(at), place(stop)
                name = match["name"]
                found.append((name, kind, line, col, end_line, end_col, scope, public, text[at:stop].split("\n", 1)[0].rstrip("\r")))
                inner = name
            if body is not None:
                inside = head[1] in _CONTAINERS if head else False
                visit(body + 1, max(body + 1, stop - 1), inner, inside, public if language in ("javascript", "typescript") else False)

    visit(0, len(code), None, False, False)
    return found


def _python_symbols(text: str) -> list[tuple]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    lines, found = text.split("\n"), []

    def visit(node, scope: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            inner = scope
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                kind = "class" if isinstance(child, ast.ClassDef) else "function"
                signature = lines[child.lineno - 1].strip()
                found.append((child.name, kind, child.lineno, child.col_offset + 1, child.end_lineno, child.end_col_offset + 1, scope, False, signature))
                inner = child.name
            visit(child, inner)

    visit(tree, None)
    return found
