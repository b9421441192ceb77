"""Import edges of JavaScript and TypeScript files (G5): a lexical scan, so that strings, comments and regular expressions don't count.

A file is read once, token by token: comments, strings, template strings with what is nested in their `${ }`, regular-expression
literals, names and signs. A slash begins a regular expression where no value can end: at the start, after a sign other than
`)` and `]`, and after a keyword; else it divides. An unterminated string ends with its line, an unterminated comment or template
with the file. Patterns are possessive, so the scan is linear in the file, however long its lines.

An import is `import "m"`, `import .. from "m"`, `export .. from "m"`, `import("m")` or `require("m")`; a template string without
`${ }` counts as a string. `x.import(..)` and `x.require(..)` are calls of something else.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.registry import REGISTRY, table

_TOKEN = re.compile(
    r"""(?P<skip>[\s\ufeff]++|//[^\n\r\u2028\u2029]*+|/\*(?:[^*]|\*(?!/))*+(?:\*/|\Z))"""
    r"""|(?P<string>"(?:[^"\\\n\r]|\\(?:.|\Z))*+"?|'(?:[^'\\\n\r]|\\(?:.|\Z))*+'?)"""
    r"""|(?P<word>[\w$\u200c\u200d]++|\#[\w$]++)|(?P<sign>.)""",
    re.S,
)
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*+(?P<end>`|\$\{|\\?\Z)", re.S)
_ATOM, _CLASS = r"[^\\/\[\n\r]|\\[^\n\r]", r"\[(?:[^\]\\\n\r]|\\[^\n\r])*+\]"
#: A regular expression's body with and without character classes; it ends at a slash, at its line's end, or at what can't be part of it.
_BODY, _FLAT = re.compile(rf"/(?:{_ATOM}|{_CLASS})++"), re.compile(rf"/(?:{_ATOM})++")
_FLAGS, _LINE = re.compile("/[A-Za-z]*+"), re.compile(r"[\n\r]|\Z")
_BEFORE_VALUE = frozenset("return typeof case in of delete void throw new else do instanceof yield await".split())
_ESCAPE = re.compile(r"\\(?:u\{([0-9A-Fa-f]+)\}|u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2})|\r\n|(.))", re.S)
_NAMED = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": "", "\r": "", "\u2028": "", "\u2029": ""}


def tokens(text: str) -> Iterator[tuple[str, str]]:
    """(kind, text) of the tokens that mean something: word, sign, string (without quotes), regex, template (a part with holes)."""
    at, n = 0, len(text)
    holes: list[bool] = []  # of each open brace, whether it is a template's
    before_value = True
    dead = flat = 0  # up to where no regular expression and no character class can end
    if text.startswith("#!"):
        at = text.find("\n") if "\n" in text else n
    while at < n:
        m = _TOKEN.match(text, at)
        kind, part = m.lastgroup, m[0]
        at = m.end()
        if kind == "skip":
            continue
        if kind == "sign":
            if part == "/" and before_value and at > dead and text[at : at + 1] not in ("/", "*"):
                body = (_BODY if at > flat else _FLAT).match(text, at - 1)
                end = body.end() if body else at
                if body and text.startswith("/", end):
                    at, before_value = _FLAGS.match(text, end).end(), False
                    yield "regex", text[body.start() : at]
                    continue
                # What didn't end isn't looked at again from each slash that follows in the line.
                if text.startswith("[", end):
                    flat = max(flat, _LINE.search(text, end).start()) if at > flat else flat
                else:
                    dead = end
            if part == "`" or part == "}" and holes and holes[-1]:
                t = _TEMPLATE.match(text, at)
                whole = part == "`" and t["end"] == "`"
                if part == "}":
                    holes.pop()
                if t["end"] == "${":
                    holes.append(True)
                at, before_value = t.end(), t["end"] == "${"
                yield ("string", t[0][:-1]) if whole else ("template", t[0])
                continue
            if part == "{":
                holes.append(False)
            elif part == "}" and holes:
                holes.pop()
            before_value = part not in ")]"
        else:
            before_value = kind == "word" and part in _BEFORE_VALUE
            if kind == "string":
                closed = len(part) > 1 and part[-1] == part[0]
                part = part[1:-1] if closed else part[1:]
        yield kind, part


def _plain(text: str) -> str:
    """A string's value."""
    if "\\" not in text:
        return text

    def one(m: re.Match) -> str:
        code = m[1] or m[2] or m[3]
        if code:
            return chr(min(int(code, 16), 0x10FFFF))
        return _NAMED.get(m[4], m[4]) if m[4] else ""

    return _ESCAPE.sub(one, text)


def imports(text: str) -> list[str]:
    """What a file imports, in order, each once; empty names are left out."""
    found: dict[str, None] = {}
    state, past = "", ("", "")  # what an import or export clause waits for; the token before
    waiting: str | None = None  # a string behind `import(` or `require(`, until its call goes on
    for kind, part in tokens(text):
        if waiting is not None:
            if kind == "sign" and part in "),":
                found[waiting] = None
            waiting = None
        if state == "call" and kind == "string":
            waiting, state = part, ""
        elif state == "called":
            state = "call" if (kind, part) == ("sign", "(") else ""
        elif state == "import" and (kind, part) == ("sign", "("):
            state = "call"
        elif state in ("import", "from") and kind == "string":
            found[part] = None
            state = ""
        elif state in ("import", "clause", "from") and (kind in ("word", "string") or kind == "sign" and part in "{},*"):
            state = "from" if (kind, part) == ("word", "from") else "clause"
        else:
            state = ""
        if kind == "word" and past != ("sign", "."):
            if part == "import" and state in ("", "clause"):
                state = "import"
            elif part == "export":
                state = "clause"
            elif part == "require":
                state = "called"
        past = kind, part
    return [s for s in map(_plain, found) if s]


def import_edges(files: DataFrame) -> DataFrame:
    """Distinct (path, specifier) of the imports of (path, content); null contents have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, names = [], []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                for name in imports(content.as_py() or ""):
                    paths.append(path)
                    names.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(paths, batch.schema.field(0).type), pa.array(names, pa.string())], ["path", "specifier"])

    kind = files.schema["path"].dataType.simpleString()
    return files.select("path", "content").mapInArrow(run, f"path {kind}, specifier string").distinct()


# A file for each part: real imports of four forms beside the same words in comments, strings, templates and a regular expression.
_FILE = r"""concat('import a, { from as b } from "', p_brand, '"; // import x from "no1"', chr(10), 'const s = "require(''no2'')", t = `import("no3") ${require("', p_type, '")} import "no4"`;', chr(10),
 CASE WHEN p_size % 2 = 0 THEN '/* export * from "no5" */ export * from ''pkg-' ELSE 'export { x } from ''mod-' END, p_size, ''';', chr(10),
 'if (/import "no6"/.test(s)) { x.require("no7"); } const d = 4 / 2; import("', p_name, '"); y = a / b; import.meta.url; import "";')"""


@REGISTRY.query(
    "import_edges",
    """
    SELECT DISTINCT p_partkey AS path, unnest([p_brand, p_type, p_name, CASE WHEN p_size % 2 = 0 THEN 'pkg-' ELSE 'mod-' END || p_size]) AS specifier FROM part
    """,
)
def import_edges_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), F.expr(_FILE).alias("content"))
    return import_edges(files)
