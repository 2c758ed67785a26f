"""Nested groups, macro definitions and tables of LaTeX, rewritten so that no group holds another.

One pass over the tokens of a source: definitions are collected and removed, their uses expanded with their arguments,
and a group inside the argument of a macro is rendered where it stands. What is left are flat groups, which the
chain of expressions in `markup` reads. Groups that only limit a scope are opened. Sources without any of this are
not touched.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: names that LaTeX and its common packages give a meaning ---
DEFINING = {"newcommand", "renewcommand", "providecommand", "DeclareRobustCommand"}
TEXT = {
    "textbf", "textit", "texttt", "textrm", "textsf", "textsc", "emph", "underline", "mathrm", "mathbf", "mathcal", "mathbb",
    "mathfrak", "mathsf", "mathit", "text", "mbox", "operatorname",
}
FRACTIONS = {"frac", "dfrac", "tfrac"}
DROPPED = {"label", "vspace", "hspace", "bibliographystyle", "includegraphics", "usepackage", "documentclass", "bibliography"}
REFERENCES = {"ref": "<ref>", "autoref": "<ref>", "cref": "<ref>", "Cref": "<ref>", "eqref": "(<ref>)"}
#: Arguments of environments that are layout and no text.
LAYOUT = {"tabular": 1, "tabular*": 2, "tabularx": 2, "array": 1, "longtable": 1, "minipage": 1, "thebibliography": 1, "multicols": 1}
CELLS = {
    "tabular", "tabular*", "tabularx", "array", "longtable", "matrix", "pmatrix", "bmatrix", "vmatrix", "cases", "align", "align*",
    "aligned", "eqnarray", "eqnarray*", "split",
}
# ---------------------------------------------------------------------------

TOKEN = re.compile(r"(?<!\\)%[^\n]*\n?|\\verb\*?\|[^|]*\||\\[A-Za-z]+\*?|\\.|[{}\[\]&]|[^\\{}\[\]&%]+|.", re.S)
#: A group within a group; a definition or a table. Each begins with one fixed character, so that a text is passed over quickly.
NESTED = r"\{[^{}]*\{"
NEEDED = r"(?s)\\(?:(?:re|provide)?newcommand|def\s*\\|DeclareMathOperator|begin\s*\{(?:tabular|array|longtable|align|.?matrix))"
#: Uses of macros a source may have expanded, and groups that are followed into each other.
EXPANSIONS, DEEPEST = 10_000, 100
CELL = "   "


class _Reader:
    """Tokens still to be read, last first, so that an expansion is read next."""

    def __init__(self, latex: str, symbols: dict[str, str]):
        self.rest = TOKEN.findall(latex)[::-1]
        self.symbols, self.macros, self.left = symbols, {}, EXPANSIONS

    def skip_blank(self) -> None:
        while self.rest and self.rest[-1].isspace():
            self.rest.pop()

    def between(self, opening: str, closing: str) -> list[str] | None:
        """The tokens of a bracketed argument that comes next, if one does."""
        at = len(self.rest)
        while at and self.rest[at - 1].isspace():
            at -= 1
        if not at or self.rest[at - 1] != opening:
            return None
        del self.rest[at - 1 :]
        depth, out = 0, []
        while self.rest:
            token = self.rest.pop()
            if token == closing and not depth:
                break
            depth += (token in ("{", opening)) - (token in ("}", closing))
            out.append(token)
        return out

    def argument(self) -> list[str]:
        """The next group's tokens, or the next token alone."""
        found = self.between("{", "}")
        if found is None:
            self.skip_blank()
            if not self.rest or self.rest[-1] == "}":
                return []
            token = self.rest.pop().lstrip()
            if len(token) > 1 and token[0] != "\\":
                self.rest.append(token[1:])
                token = token[0]
            return [token]
        return found

    def define(self, name: str) -> bool:
        """Takes in a definition, if the macro is one."""
        name = name.rstrip("*")
        if name in DEFINING:
            own = "".join(self.argument()).strip().lstrip("\\")
            count = "".join(self.between("[", "]") or []).strip()
            default = self.between("[", "]") if count else None
            self.macros[own] = (int(count) if count.isdigit() else 0, default, self.argument())
        elif name == "def":
            self.skip_blank()
            own = self.rest.pop().lstrip("\\") if self.rest else ""
            signature = ""
            while self.rest and self.rest[-1] != "{":
                signature += self.rest.pop()
            self.macros[own] = (signature.count("#"), None, self.argument())
        elif name == "DeclareMathOperator":
            own = "".join(self.argument()).strip().lstrip("\\")
            self.macros[own] = (0, None, self.argument())
        else:
            return False
        return True

    def expand(self, name: str) -> bool:
        if name not in self.macros or not self.left:
            return False
        self.left -= 1
        count, default, body = self.macros[name]
        given: list[list[str]] = []
        if default is not None:
            given.append(self.between("[", "]") or default)
        given += [self.argument() for _ in range(count - len(given))]
        text = re.split(r"#(\d)", "".join(body))
        parts = [piece if k % 2 == 0 else "".join(given[int(piece) - 1]) if int(piece) <= len(given) else "" for k, piece in enumerate(text)]
        self.rest.extend(TOKEN.findall("".join(parts))[::-1])
        return True


def _inner(reader: _Reader, tokens: list[str], depth: int) -> str:
    """What stands inside a macro's argument, without groups of its own."""
    outer, reader.rest = reader.rest, tokens[::-1]
    out: list[str] = []
    while reader.rest:
        token = reader.rest.pop()
        if token == "{":
            reader.rest.append(token)
            group = reader.between("{", "}") or []
            out.append(_inner(reader, group, depth + 1) if depth < DEEPEST else "".join(t for t in group if t not in "{}"))
        elif token[0] == "\\" and token[1:2].isalpha():
            name = token[1:].rstrip("*")
            if token.startswith("\\verb"):
                out.append(token.split("|")[1])
            elif reader.define(name) or reader.expand(name):
                pass
            elif name in FRACTIONS:
                out.append("/".join(_inner(reader, reader.argument(), depth + 1) for _ in range(2)) if depth < DEEPEST else "")
            elif name.startswith("cite"):
                while reader.between("[", "]") is not None:
                    pass
                reader.between("{", "}")
                out.append("<cit.>")
            elif name in REFERENCES or name in DROPPED or name in ("begin", "end"):
                reader.between("[", "]")
                reader.between("{", "}")
                out.append(REFERENCES.get(name, ""))
            elif name not in TEXT:
                out.append(reader.symbols.get(name, ""))
        elif token[0] != "%" and token != "}":
            out.append(token)
    reader.rest = outer
    return "".join(out)


def flattened(latex: str, symbols: dict[str, str]) -> str:
    """A source in which no group holds another, and no macro of its own is left."""
    reader = _Reader(latex, symbols)
    out: list[str] = []
    cells, attached = [], False
    while reader.rest:
        token = reader.rest.pop()
        if token == "{":
            if attached:
                reader.rest.append(token)
                out += ["{", _inner(reader, reader.between("{", "}") or [], 1), "}"]
            # Otherwise a scope: its braces go, here and where it ends.
        elif token == "}":
            attached = False
        elif token[0] == "\\" and token[1:2].isalpha() and not token.startswith("\\verb"):
            name = token[1:].rstrip("*")
            if reader.define(name) or reader.expand(name):
                continue
            out.append(token)
            attached = True
            if name in ("begin", "end"):
                environment = "".join(reader.between("{", "}") or [])
                out.append("{" + environment.strip() + "}")
                attached = False
                if name == "begin":
                    cells.append(environment in CELLS)
                    if environment in LAYOUT:
                        reader.between("[", "]")
                        for _ in range(LAYOUT[environment]):
                            reader.between("{", "}")
                elif cells:
                    cells.pop()
        elif token == "&" and any(cells):
            out.append(CELL)
            attached = False
        elif token[0] != "%":
            out.append(token)
            attached = attached and (token.isspace() or token == "[" or token == "]" or "[" in out[-3:])
    return "".join(out)


def flat(latex: Column, symbols: dict[str, str]) -> Column:
    """The column with nested groups and macros resolved; rows that have none never leave the engine's own format."""

    @F.pandas_udf("string")
    def resolve(sources: pd.Series) -> pd.Series:
        return sources.map(lambda s: None if s is None else flattened(s, symbols))

    needed = latex.rlike(NESTED) | latex.rlike(NEEDED)
    return F.coalesce(resolve(F.when(needed, latex)), latex)
