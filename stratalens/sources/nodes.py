"""Code nodes of source files: modules, what they declare, members and parameters, each below its true parent.

One pass over a file's lines, comments and strings blanked: declarations are found by patterns, and scopes are kept on a
stack, by brackets in languages with braces and by indentation in the others.  Files are independent rows; a task holds
the nodes of one file, or of some small ones.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths

#: Languages whose scopes are bracketed, and those whose scopes are indented.
BRACKETED = ("JavaScript", "TypeScript", "Java", "C#", "PHP", "Go", "Rust", "C", "C++", "Swift", "Kotlin", "Dart", "Scala", "Groovy")
INDENTED = ("Python", "Ruby", "Elixir", "Julia", "Lua")
#: Nodes that hold members, and nodes that hold statements.
HOLDERS, BODIES = ("class", "interface", "struct", "enum", "type"), ("function", "method")
#: Nodes and characters after which a task hands on what it has; a file's nodes stay together.
BATCH_ROWS, BATCH_CHARS = 4096, 8 << 20
COLUMNS = "id string, type string, name string, path string, language string, content string, start_line int, end_line int, parent_id string, position int, confidence double"

_WORDS = r"(?:(?:export|default|public|private|protected|internal|abstract|static|final|sealed|partial|data|open|declare|override|readonly|async|virtual|pub(?:\([\w: ]+\))?|unsafe|mut|inline|const(?=\s+fn)|get(?=\s+\w)|set(?=\s+\w))\s+)*"
_HOLDER = re.compile(rf"\s*{_WORDS}(class|interface|struct|enum|trait|protocol|object|namespace|module|record)\s+(\w+)")
_GO_TYPE = re.compile(r"\s*type\s+(\w+)\s+(struct|interface)\b")
_TYPE = re.compile(rf"\s*{_WORDS}type\s+(\w+)\s*(?:<[^=]*>)?\s*=")
_FUNCTION = re.compile(rf"\s*{_WORDS}(?:function\s*\*?|def|defp|func|fn|fun|sub)\s+(?:\([^)]*\)\s*)?(?:self\.)?([\w?!]+)")
_ARROW = re.compile(r"\s*(?:export\s+)?(?:default\s+)?(?:const|let|var)\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b|\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::\s*[\w<>\[\]|., ]+)?\s*=>|\w+\s*=>)")
_VARIABLE = re.compile(rf"\s*{_WORDS}(?:const|let|var|val)\s+(?:mut\s+)?(\w+)")
_METHOD = re.compile(rf"\s*{_WORDS}(?:[\w.]+(?:<[^()]*>)?[\[\]*&?]*\s+)?(?:get\s+|set\s+)?(?:\*\s*)?([\w$#]+)\s*(?:<[^()]*>)?\s*\(")
_MEMBER = re.compile(rf"\s*{_WORDS}(?:(?:const|let|var|val)\s+)?([\w$#]+)\s*[?!]?\s*(?::|=(?!=)|;|,|\}}|$)")
_TYPED_MEMBER = re.compile(rf"\s*{_WORDS}[\w.]+(?:<[^=;]*>)?[\[\]*&?]*\s+\*?\$?(\w+)\s*(?:=(?!=)|;|,|\{{\s*get|$)")
_PLAIN = re.compile(r"\s*(\w+)\s*(?::[^=]+)?=(?!=)|\s*(\w+)\s*:\s*\S")
_SELF = re.compile(r"\s*self\.(\w+)\s*(?::[^=]+)?=(?!=)")
_GO_MEMBER = re.compile(r"\s*(\w+)\s+[\w*\[\]]")
_GO_METHOD = re.compile(r"\s*func\s+\(\s*\w*\s*\*?(\w+)[^)]*\)\s*(\w+)")
_IMPL = re.compile(r"\s*impl(?:\s*<[^{]*?>)?\s+(?:[\w:<>]+\s+for\s+)?(\w+)")
_C_FUNCTION = re.compile(r"\s*(?:[\w:*&<>,]+\s+)+[*&]*(?:\w+::)*(\w+)\s*\([^;{}=]*\)?[^;{}=]*\{?\s*$")
_RECEIVER = re.compile(r"&?\s*(?:mut\s+)?(?:self|cls|this)\b\s*(?:$|:)")
_NO_NAMES = frozenset("if for while switch catch return new throw else do try case with function await yield super typeof delete assert elif except import using package foreach lock match default break continue".split())
_KIND = {"trait": "interface", "protocol": "interface", "object": "class", "record": "class", "namespace": "namespace", "module": "namespace"}
_BLANK = {
    True: re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S),
    False: re.compile(r"#[^\n]*|\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S),
}
_NOT_NEWLINE = re.compile(r"[^\n]")


def blanked(content: str, bracketed: bool) -> str:
    """The text with comments and strings as spaces (quotes stay); every character keeps its place."""

    def blank(m: re.Match) -> str:
        own = m.group()
        return own[0] + _NOT_NEWLINE.sub(" ", own[1:-1]) + own[-1] if own[0] in "\"'`" and len(own) > 1 else _NOT_NEWLINE.sub(" ", own)

    return _BLANK[bracketed].sub(blank, content)


def arguments(text: str, at: int) -> tuple[list[str], int] | None:
    """Parts between the bracket at `at` and its partner, cut at commas outside inner brackets, and where the partner stands."""
    depth, parts, first = 0, [], at + 1
    for k in range(at, len(text)):
        c = text[k]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if not depth:
                last = text[first:k]
                return ([*parts, last] if last.strip() else parts), k
        elif c == "," and depth == 1:
            parts.append(text[first:k])
            first = k + 1
    return None


def parameter_name(text: str, language: str) -> str | None:
    """The name that a parameter's text declares; None for a pattern."""
    text = re.sub(r"^(?:\s*(?:@\w+(?:\([^)]*\))?|public|private|protected|readonly|final|const|mut|ref|out|in|params|var|val|vararg|inout)\s+)+", "", text).strip().lstrip("*&.$ ")
    head = re.split(r"[=]", text, maxsplit=1)[0].strip()
    if language in ("Java", "C#", "C", "C++", "Dart", "Groovy", "PHP") and (m := re.search(r"(\w+)\s*(?:\[\s*\])*$", head)):
        name = m.group(1)
    elif m := re.match(r"(\w+)", head):
        name = m.group(1)
    else:
        return None
    return None if name == "void" else name


class _Found:
    __slots__ = ("closed", "kind", "line", "name", "names", "nth", "parent", "position", "text", "to")

    def __init__(self, kind: str, name: str, line: int, parent: _Found | None, position: int | None = None, text: str | None = None) -> None:
        self.kind, self.name, self.line, self.to, self.parent, self.position, self.text = kind, name, line, line, parent, position, text
        self.closed = False
        self.names: set[tuple[str, str]] = set()  # of its properties and variables


def _add(found: list[_Found], kind: str, name: str, line: int, parent: _Found | None, own: set) -> _Found | None:
    if kind in ("property", "variable"):
        if (kind, name) in own:
            return None
        own.add((kind, name))
    found.append(_Found(kind, name, line, parent))
    return found[-1]


def _parameters(found: list[_Found], owner: _Found, text: str, at: int, language: str, line: int) -> None:
    """Parameters in the first bracket after the owner's name."""
    opening = re.compile(r"\s*(?:<[^()]*>)?\s*(?:=\s*(?:async\s*)?(?:function\s*\w*\s*)?)?\(").match(text, at)
    parts = arguments(text, opening.end() - 1) if opening else None
    own = [p.strip() for p in parts[0]] if parts else []
    for nth, part in enumerate(p for p in own if not _RECEIVER.match(p)):
        if name := parameter_name(part, language):
            found.append(_Found("parameter", name, line, owner, nth, part))


def _declared(line: str, scope: str | None, language: str) -> tuple[str, str, int] | None:
    """kind, name and the end of the name of what a line declares directly inside a scope (None: the module)."""
    if m := _HOLDER.match(line):
        return _KIND.get(m.group(1), m.group(1)), m.group(2), m.end()
    if language == "Rust" and (m := _IMPL.match(line)):
        return "impl", m.group(1), m.end()
    if m := _GO_TYPE.match(line):
        return m.group(2), m.group(1), m.end()
    if m := _TYPE.match(line):
        return "type", m.group(1), m.end(1)
    if language == "Go" and (m := _GO_METHOD.match(line)):
        return f"method of {m.group(1)}", m.group(2), m.end()
    if m := _FUNCTION.match(line):
        return "method" if scope in HOLDERS else "function", m.group(1), m.end()
    if scope not in HOLDERS:
        if m := _ARROW.match(line):
            return "function", m.group(1), m.end(1)
        if scope in (None, "namespace") and (m := _VARIABLE.match(line)):
            return "variable", m.group(1), m.end()
        if scope in (None, "namespace") and language in ("C", "C++", "Dart") and (m := _C_FUNCTION.match(line)) and m.group(1) not in _NO_NAMES:
            return "function", m.group(1), m.end(1)
        return None
    if language == "Go":
        m = _GO_MEMBER.match(line)
        return ("property", m.group(1), m.end(1)) if m else None
    if (m := _METHOD.match(line)) and m.group(1) not in _NO_NAMES:
        return "method", m.group(1), m.end(1)
    for pattern in (_MEMBER, _TYPED_MEMBER):
        if (m := pattern.match(line)) and m.group(1) not in _NO_NAMES and not line.lstrip().startswith((")", "}", "]")):
            return "property", m.group(1), m.end(1)
    return None


_EVENTS = re.compile(r"[{}()\[\];,\n]")


def _bracketed(text: str, language: str) -> list[_Found]:
    found: list[_Found] = []
    scopes: list[_Found | str] = []  # nodes, or the sign of a bracket that belongs to none
    module: set = set()
    pending: _Found | None = None  # declared, its block not yet open
    base = 0  # open scopes at its declaration
    line, start = 1, 0
    for event in _EVENTS.finditer(text + "\n"):
        at, sign = event.start(), event.group()
        if start is not None and sign in "\n{}([;,":  # the first sign of a line: look at the whole line
            whole = text[start : text.find("\n", start) if text.find("\n", start) >= 0 else len(text)]
            scope = scopes[-1] if scopes else None
            inner = next((s for s in reversed(scopes) if isinstance(s, _Found)), None)
            if not isinstance(scope, str) or scope == "{" and inner is not None and inner.kind in BODIES:
                seen = _declared(whole, scope.kind if isinstance(scope, _Found) else "block" if scope else None, language)
                if seen and not (pending and pending.kind not in ("property", "variable") and pending.line == line):
                    kind, name, end = seen
                    held = next((f for f in found if f.name == (kind[10:] if kind != "impl" else name) and f.kind in HOLDERS), None)
                    if kind.startswith("method of "):  # a receiver's type is the parent, if it stands above
                        inner, kind = held, "method"
                    if kind == "impl" and held:
                        node = held
                    else:
                        kind = "class" if kind == "impl" else kind
                        node = _add(found, kind, name, line, inner, inner.names if inner else module)
                    pending, base = node, len(scopes)
                    if node and kind in BODIES:
                        _parameters(found, node, text, start + end, language, line)
            start = None
        if sign in "{([":
            own = pending if pending and sign == "{" and len(scopes) == base else None
            if own and own.kind in ("property", "variable"):
                own = None
            scopes.append(own or sign)
            if own:
                pending, start = None, at + 1
        elif sign in "})]":
            if scopes:
                closed = scopes.pop()
                if isinstance(closed, _Found):
                    if not closed.closed:
                        closed.to, closed.closed = line, True
                    start = at + 1
                elif pending and len(scopes) == base and pending.kind in ("property", "variable", "type"):
                    pending.to = line
            if pending and len(scopes) < base:
                pending = None
        elif sign == ";":
            if pending and len(scopes) == base:
                pending.to = max(pending.to, line)
                pending = None
            start = at + 1
        elif sign == ",":
            if scopes and isinstance(scopes[-1], _Found) and scopes[-1].kind in ("enum", "struct"):
                pending, start = None, at + 1
        else:
            if pending and pending.kind in ("property", "variable") and len(scopes) == base:
                pending = None
            line, start = line + 1, at + 1
    last = text.count("\n") + 1
    for open_scope in scopes:
        if isinstance(open_scope, _Found):
            open_scope.to = last
    return found


def _indented(text: str, language: str) -> list[_Found]:
    found: list[_Found] = []
    scopes: list[tuple[int, _Found]] = []
    module: set = set()
    depth, last, start = 0, 0, 0
    for line, own in enumerate(text.split("\n"), 1):
        bare = own.strip()
        if bare and not depth:
            indent = len(own) - len(own.lstrip())
            closer = bare == "end" or bare[0] in ")]}"
            while scopes and (indent < scopes[-1][0] or (indent == scopes[-1][0] and not closer)):
                scopes.pop()[1].to = last
            parent = scopes[-1][1] if scopes else None
            names = parent.names if parent else module
            if closer and scopes and indent == scopes[-1][0]:
                scopes.pop()[1].to = line
            elif (m := _HOLDER.match(own)) or (m := _FUNCTION.match(own)):
                holder = m.re is _HOLDER
                kind = _KIND.get(m.group(1), m.group(1)) if holder else "method" if parent and parent.kind in HOLDERS else "function"
                node = _add(found, kind, m.group(2 if holder else 1), line, parent, names)
                scopes.append((indent, node))
                if not holder:
                    _parameters(found, node, text, start + m.end(), language, line)
            elif parent and parent.kind == "method" and (m := _SELF.match(own)):
                _add(found, "property", m.group(1), line, parent.parent, parent.parent.names)
            elif (parent is None or parent.kind in HOLDERS) and (m := _PLAIN.match(own)) and (m.group(1) or m.group(2)) not in _NO_NAMES:
                _add(found, "variable" if parent is None else "property", m.group(1) or m.group(2), line, parent, names)
        if bare:
            depth = max(0, depth + sum(bare.count(c) for c in "([{") - sum(bare.count(c) for c in ")]}"))
            last = line
        start += len(own) + 1
    for _, node in scopes:
        node.to = last
    return found


def declared(content: str, language: str) -> list[_Found]:
    """All declarations of a text, in order; parents come before their children."""
    if language in BRACKETED:
        return _bracketed(blanked(content, True), language)
    return _indented(blanked(content, False), language) if language in INDENTED else []


def _id(*parts: object) -> str:
    return sha256(":".join(map(str, parts)).encode()).hexdigest()


def _rows(path: str, language: str, content: str) -> Iterator[tuple]:
    lines = content.split("\n")
    module = _id("module", path)
    stem = re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1])
    yield module, "module", stem, path, language, content, 1, len(lines), None, None, 0.9
    ids: dict[int, tuple[str, str]] = {}
    times: Counter = Counter()
    for node in declared(content, language):
        parent, scope = ids[id(node.parent)] if node.parent else (module, "")
        name = f"{scope}.{node.name}"
        times[node.kind, name] += 1
        own = _id(node.kind, path, name, times[node.kind, name])  # stays the same when lines move
        ids[id(node)] = own, name
        text = node.text if node.text is not None else "\n".join(lines[node.line - 1 : node.to])
        yield own, node.kind, node.name, path, language, text, node.line, node.to, parent, node.position, 0.7


def code_nodes(files: DataFrame, symbols: bool = True) -> DataFrame:
    """A module per file with a language, and (our extension) what the file declares, each node below its true parent.

    Types: module, namespace, class, interface, struct, enum, type, function, method, property, variable, parameter (with its
    position).  An id depends on type, path, names of the scopes and, of equal ones, the order; not on line numbers.
    """
    own = files.where("language IS NOT NULL")
    if not symbols:
        no = F.lit(None).cast("string")
        return own.select(F.sha2(F.concat(F.lit("module:"), "path"), 256).alias("id"), F.lit("module").alias("type"), paths.stem(F.col("path")).alias("name"), "path", "language", "content", F.lit(1).alias("start_line"), F.col("line_count").alias("end_line"), no.alias("parent_id"), F.lit(None).cast("int").alias("position"), F.lit(0.9).alias("confidence"))
    names = [c.split(" ")[0] for c in COLUMNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [{"string": pa.string(), "int": pa.int32(), "double": pa.float64()}[c.split(" ")[1]] for c in COLUMNS.split(", ")]
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        rows, held = [], 0
        for batch in batches:
            for path, language, content in zip(*(batch.column(c) for c in ("path", "language", "content")), strict=True):
                own = list(_rows(path.as_py(), language.as_py(), content.as_py() or ""))
                rows += own
                held += sum(len(row[5]) for row in own)
                if len(rows) >= BATCH_ROWS or held >= BATCH_CHARS:
                    yield made(rows)
                    rows, held = [], 0
        if rows:
            yield made(rows)

    return own.select("path", "language", "content").mapInArrow(run, COLUMNS)


_CALL = re.compile(r"(?:(\w+)\s*(?::[^=;\n]+)?=\s*(?:await\s+)?)?(?:[\w$]+\s*\.\s*)*([\w$]+)\s*\(")
CALL_COLUMNS = "caller string, path string, name string, nth int, arguments array<string>, result string, context string"


def call_sites(nodes: DataFrame) -> DataFrame:
    """caller, path, name (called), nth, arguments, result (the variable that takes it), context (its line) of each call in a function's or method's own text.

    Brackets are balanced, over lines too; comments and strings hold no calls, and stand as blanks in arguments.  A call that is an argument of another is a call of its own.
    """
    names = [c.split(" ")[0] for c in CALL_COLUMNS.split(", ")]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.string()]

    def calls(caller: str, path: str, language: str, content: str) -> Iterator[tuple]:
        plain = blanked(content, language in BRACKETED)
        lines = content.split("\n")
        head = next((i for i, x in enumerate(plain) if x in "{:\n"), 0)
        if (first := plain.find("(")) >= 0 and (parts := arguments(plain, first)):
            head = parts[1]  # behind the caller's own parameters
        nth, at = 0, head
        while m := _CALL.search(plain, at):
            at = m.end()  # what stands inside the brackets is searched as well
            parts = arguments(plain, m.end() - 1)
            if m.group(2) in _NO_NAMES or parts is None:
                continue
            context = lines[plain.count("\n", 0, m.start(2))].strip()
            yield caller, path, m.group(2), nth, [x.strip() for x in parts[0]], m.group(1), context
            nth += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row for r in batch.to_pylist() for row in calls(r["id"], r["path"], r["language"], r["content"])]
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    own = nodes.where(F.col("type").isin(*BODIES)).select("id", "path", "language", "content")
    return own.mapInArrow(run, CALL_COLUMNS)
