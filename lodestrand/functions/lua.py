"""Symbols of Lua modules (C9 to C18): functions, returned keys, required modules and strings.

One regular expression cuts the source into tokens; everything else reads the token list.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
LOADERS = ("require", "mw.loadData", "mw.loadJsonData")
LONGEST_PATH = 256
PRIORITY = {"function": 4, "return-key": 3, "dependency": 2, "string": 1}
SYMBOLS = "struct<functions:array<string>,returnKeys:array<string>,strings:array<string>,dependencies:array<string>>"

_TOKEN = re.compile(
    r"""--(?:\[(?P<ce>=*)\[.*?(?:\](?P=ce)\]|\Z)|[^\n]*)
    |\[(?P<le>=*)\[(?P<long>.*?)(?:\](?P=le)\]|\Z)
    |(?P<quote>["'])(?P<quoted>(?:\\.|(?!(?P=quote))[^\\])*)(?:(?P=quote)|\\?\Z)
    |(?P<name>[A-Za-z_][A-Za-z0-9_]*)
    |(?P<number>0[xX][0-9a-fA-F]*(?:\.(?!\.)[0-9a-fA-F]*)?(?:[pP][+-]?\d+)?|\d+(?:\.(?!\.)\d*)?(?:[eE][+-]?\d+)?)
    |(?P<sign>[=~<>]=|\S)""",
    re.X | re.S,
)
_ESCAPE = re.compile(r"\\(?:(z)\s*|([nrtvf])|(.))", re.S)


def lua_tokens(source: str) -> list[tuple[str, str]]:
    """(kind, value) without comments; kinds are name, number, string and sign."""
    out = []
    for m in _TOKEN.finditer(source):
        kind = m.lastgroup
        if m["quote"]:
            out.append(("string", _ESCAPE.sub(lambda e: "" if e[1] else " " if e[2] else e[3], m["quoted"])))
        elif m["long"] is not None:
            out.append(("string", m["long"]))
        elif kind in ("name", "number", "sign"):
            out.append((kind, m[kind]))
    return out


class _Module:
    """Token list of one module with what the extraction asks of it."""

    def __init__(self, source: str):
        self.tokens = lua_tokens(source)
        self.end = ("", "")

    def __getitem__(self, i: int) -> tuple[str, str]:
        return self.tokens[i] if 0 <= i < len(self.tokens) else self.end

    def sign(self, i: int, value: str) -> bool:
        """Whether token ``i`` has this value and is no string."""
        kind, text = self[i]
        return text == value and kind != "string"

    def path(self, i: int) -> tuple[str, int] | None:
        """(dotted name, next token) of the member path at ``i``; None without one or beyond LONGEST_PATH segments."""
        if self[i][0] != "name":
            return None
        parts, length, i = [self[i][1]], 1, i + 1
        while True:
            link = self[i][1] if self[i][0] == "sign" else ""
            if link in (".", ":") and self[i + 1][0] == "name":
                parts += [link, self[i + 1][1]]
                i += 2
            elif link == "[" and self[i + 1][0] in ("string", "number") and self.sign(i + 2, "]"):
                parts += [".", self[i + 1][1]]
                i += 3
            else:
                return "".join(parts), i
            length += 1
            if length > LONGEST_PATH:
                return None

    def paths(self) -> Iterator[tuple[str, int]]:
        """Every member path that is not the tail of another."""
        for i, (kind, _) in enumerate(self.tokens):
            if kind == "name" and self[i - 1] not in (("sign", "."), ("sign", ":")) and (p := self.path(i)):
                yield p

    def table_keys(self, brace: int) -> Iterator[str]:
        """Keys of the outermost level of the table constructor whose brace is token ``brace``."""
        open_signs, fresh = ["{"], True
        for i in range(brace + 1, len(self.tokens)):
            kind, value = self[i]
            if fresh and len(open_signs) == 1:
                if kind == "name" and self.sign(i + 1, "="):
                    yield value
                elif self.sign(i, "[") and self[i + 1][0] in ("string", "number") and self.sign(i + 2, "]") and self.sign(i + 3, "="):
                    yield self[i + 1][1]
            fresh = False
            if kind != "sign":
                continue
            if value in "{([":
                open_signs.append(value)
            elif value in "})]":
                if open_signs[-1] == {"}": "{", ")": "(", "]": "["}[value]:
                    open_signs.pop()
                if not open_signs:
                    return
            elif value in ",;":
                fresh = len(open_signs) == 1

    def returned(self) -> str | None:
        """The path that the module's last statement returns."""
        for i in range(len(self.tokens) - 1, -1, -1):
            if self.sign(i, "return") and (p := self.path(i + 1)):
                if all(t == ("sign", ";") for t in self.tokens[p[1] :]):
                    return p[0]
        return None


def lua_symbols_of(source: str | None) -> dict[str, list[str]]:
    """functions, returnKeys, strings and dependencies of a module, each value once in order of appearance."""
    module = _Module(source or "")
    functions, keys, needed = {}, {}, {}
    strings = {v.strip(): None for kind, v in module.tokens if kind == "string" and v.strip()}
    members = list(module.paths())
    for i in range(len(module.tokens)):
        if module.sign(i, "function") and (p := module.path(i + 1)) and module.sign(p[1], "("):
            functions[p[0]] = None
        if module.sign(i, "return") and module.sign(i + 1, "{"):
            keys.update(dict.fromkeys(module.table_keys(i + 1)))
    for name, at in members:
        if module.sign(at, "=") and module.sign(at + 1, "function"):
            functions[name] = None
        if name in LOADERS:
            kind, value = module[at + 1 if module.sign(at, "(") else at]
            if kind == "string" and value.strip():
                needed[value.strip()] = None
    root = module.returned()
    if root:

        def under(name: str) -> str | None:
            return re.split("[.:]", name[len(root) + 1 :])[0] or None if name.startswith((root + ".", root + ":")) else None

        keys.update(dict.fromkeys(k for k in map(under, functions) if k))
        for name, at in members:
            if module.sign(at, "="):
                if k := under(name):
                    keys[k] = None
                if name == root and module.sign(at + 1, "{"):
                    keys.update(dict.fromkeys(module.table_keys(at + 1)))
    return {"functions": list(functions), "returnKeys": list(keys), "strings": list(strings), "dependencies": list(needed)}


def lua_symbols(c: Column) -> Column:
    """``lua_symbols_of`` of a column, on Arrow batches; null gives empty lists."""

    @F.pandas_udf(SYMBOLS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for sources in batches:
            yield pd.DataFrame([lua_symbols_of(s) for s in sources], columns=["functions", "returnKeys", "strings", "dependencies"])

    return run(c)


def searchable_text(symbols: Column) -> Column:
    """All symbols of a module as one text."""
    every = F.concat(symbols["functions"], symbols["returnKeys"], symbols["strings"], symbols["dependencies"])
    return F.trim(F.regexp_replace(F.array_join(F.array_distinct(every), " "), r"(?U)\s+", " "))


def typed_symbols(symbols: Column) -> Column:
    """One list of (kind, value, priority) in the order function, return-key, dependency, string."""
    lists = (("function", "functions"), ("return-key", "returnKeys"), ("dependency", "dependencies"), ("string", "strings"))

    def typed(kind: str, name: str) -> Column:
        return F.transform(symbols[name], lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"), F.lit(PRIORITY[kind]).alias("priority")))

    return F.concat(*[typed(kind, name) for kind, name in lists])
