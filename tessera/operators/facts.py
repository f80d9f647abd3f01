"""Symbols, occurrences, imports and exports of source files, from their tokens and brackets.

A file becomes a list of tokens with matched brackets. A work list of ranges is read for declarations: what a declaration
holds in its brackets is a range of its own, with that declaration as container. When all are known, the names that are left are
resolved: from the innermost container outwards, the latest declaration of that name that starts before the use.

Files are read where they lie, in Arrow batches, and come out as one row each; the tables are exploded from that.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILE = ["repo_id", "snapshot_id", "path"]
SYMBOL = "symbol_id string, display_name string, qualified_name string, kind string, container string, visibility string, start int, end int, signature_digest string"
OCCURRENCE = "occurrence_id string, symbol_id string, role string, start int, end int"
IMPORT = "symbol_id string, module_specifier string, imported_name string, local_name string"
EXPORT = "symbol_id string, local_name string, exported_name string, module_specifier string, is_default boolean, is_reexport boolean"
OUT = f"repo_id string, snapshot_id string, path string, symbols array<struct<{SYMBOL.replace(' ', ':').replace(',:', ',')}>>, occurrences array<struct<{OCCURRENCE.replace(' ', ':').replace(',:', ',')}>>, imports array<struct<{IMPORT.replace(' ', ':').replace(',:', ',')}>>, exports array<struct<{EXPORT.replace(' ', ':').replace(',:', ',')}>>"

# Words that are no names.
KEYWORDS = set("break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with yield let static async await of as from type interface declare namespace module abstract public private protected readonly override implements keyof infer is satisfies get set undefined string number boolean any unknown never object symbol void bigint".split())
MODIFIERS = set("public private protected readonly static async abstract override declare get set accessor".split())
TOKEN = re.compile(
    r"(?P<skip>[^\S\n]+|//[^\n]*|/\*[\s\S]*?\*/)|(?P<nl>\n)|(?P<str>'(?:[^'\\\n]|\\[\s\S])*'|\"(?:[^\"\\\n]|\\[\s\S])*\")|(?P<name>#?[^\W\d][\w$]*|\$[\w$]*)|(?P<num>\d[\w.]*)|(?P<op>=>|\.\.\.|\?\.|[^\s])"
)
REGEX = re.compile(r"/(?:[^\n/\\\[*]|\\.|\[(?:[^\]\\\n]|\\.)*\])(?:[^\n/\\\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])*/[A-Za-z]*")
TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(?:`|\$\{|\Z)")
BLANKS = re.compile(r"\s+")
CLOSES = {")": "(", "]": "[", "}": "{"}


class Tokens:
    """kind, text, start, end of each token, whether a line begins with it, and the partner of each bracket (-1 where there is none)."""

    def __init__(self, text: str):
        self.kind, self.text, self.start, self.end, self.fresh = [], [], [], [], []
        self.partner: list[int] = []
        stack: list[int] = []
        templates: list[int] = []  # how many brackets are open where a template goes on
        at, fresh = 0, True

        def add(kind: str, value: str, a: int, b: int) -> None:
            nonlocal fresh
            self.kind.append(kind)
            self.text.append(value)
            self.start.append(a)
            self.end.append(b)
            self.fresh.append(fresh)
            self.partner.append(-1)
            fresh = False

        def template(a: int) -> int:
            m = TEMPLATE.match(text, a)
            add("str", "`", a, m.end())
            if m.group().endswith("${"):
                add("op", "{", m.end() - 1, m.end())
                stack.append(len(self.kind) - 1)
                templates.append(len(stack))
            return m.end()

        while at < len(text):
            if text[at] == "`":
                at = template(at + 1)
                continue
            if text[at] == "/" and not text.startswith(("//", "/*"), at) and (not self.kind or (self.kind[-1] == "op" and self.text[-1] not in ")]}") or self.text[-1] in ("return", "typeof", "case")) and (m := REGEX.match(text, at)):
                add("str", "/", at, m.end())
                at = m.end()
                continue
            m = TOKEN.match(text, at)
            kind, value = m.lastgroup, m.group()
            if kind == "nl" or (kind == "skip" and "\n" in value):
                fresh = True
            elif kind != "skip":
                add(kind, value, at, m.end())
                if value in "([{" and kind == "op":
                    stack.append(len(self.kind) - 1)
                elif value in CLOSES and kind == "op":
                    # a bracket that meets no partner closes nothing; what was opened inside one that closes is closed with it
                    k = len(stack) - 1
                    while k >= 0 and self.text[stack[k]] != CLOSES[value]:
                        k -= 1
                    if k >= 0:
                        for lost in stack[k + 1 :]:
                            self.partner[lost] = len(self.kind) - 1
                        self.partner[stack[k]] = len(self.kind) - 1
                        self.partner[-1] = stack[k]
                        del stack[k:]
                        if templates and templates[-1] > len(stack):
                            templates.pop()
                            at = template(m.end())
                            continue
            at = m.end()
        for lost in stack:
            self.partner[lost] = len(self.kind)

    def __len__(self) -> int:
        return len(self.kind)


def _digest(*parts: str) -> str:
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


class FileFacts:
    """The facts of one file."""

    def __init__(self, repo: str, snapshot: str, path: str, text: str):
        self.repo, self.snapshot, self.path, self.source = repo, snapshot, path, text
        self.t = Tokens(text)
        self.symbols: list[list] = []  # id, name, qualified, kind, container, visibility, start, end, digest
        self.children: dict[tuple[int, str], list[int]] = {}
        self.ids: dict[str, int] = {}
        self.occurrences: dict[str, tuple] = {}
        self.imports: list[tuple] = []
        self.exports: list[tuple] = []
        self.spoken: set[int] = set()  # tokens that are no references
        self.pending: list[tuple[str, str, bool, int]] = []
        self.module = self.push("module", path, None, 0, len(text), "", None)
        self.work = [(0, len(self.t), self.module, False)]
        while self.work:
            self.read(*self.work.pop())
        self.finish_exports()
        self.resolve()

    # -- what is found
    def push(self, kind: str, name: str, container: int | None, start: int, end: int, signature: str, at: int | None, visibility: str = "local") -> int:
        up = self.symbols[container] if container is not None else None
        sign = _digest(BLANKS.sub(" ", signature).strip())
        clean = re.sub(r"[^A-Za-z0-9]", "_", name) or "anon"
        ident = f"sym.{kind}.{clean}.{_digest(self.repo, self.path, kind, up[0] if up else '-', name, sign)[:12]}"
        if ident in self.ids:
            k = self.ids[ident]
        else:
            k = self.ids[ident] = len(self.symbols)
            qualified = None if up is None else name if up[3] == "module" else f"{up[2]}::{name}"
            self.symbols.append([ident, name, qualified if up else name, kind, up[0] if up else None, visibility, start, end, sign])
            if container is not None:
                self.children.setdefault((container, name), []).append(k)
        if at is not None:
            self.spoken.add(at)
            self.occur(k, "import" if kind == "import_binding" else "definition", at)
        return k

    def occur(self, symbol: int, role: str, at: int) -> None:
        a, b, ident = self.t.start[at], self.t.end[at], self.symbols[symbol][0]
        occurrence = f"occ.{role}.{_digest(self.snapshot, self.path, ident, role, f'{a}-{b}')[:12]}"
        self.occurrences.setdefault(occurrence, (occurrence, ident, role, a, b))

    def raise_visibility(self, symbol: int, visibility: str) -> None:
        if self.symbols[symbol][5] != "default_export":
            self.symbols[symbol][5] = visibility

    # -- small looks
    def word(self, i: int) -> str:
        return self.t.text[i] if i < len(self.t) else ""

    def at(self, i: int) -> int:
        """Where token i begins, or the end of the text."""
        return self.t.start[i] if i < len(self.t) else len(self.source)

    def upto(self, i: int) -> int:
        """Where the token before i ends."""
        return self.t.end[min(i, len(self.t)) - 1]

    def after(self, i: int) -> int:
        """The token after the one at i, or after its bracket."""
        p = self.t.partner[i] if i < len(self.t) else -1
        return p + 1 if p > i else i + 1

    def angles(self, i: int) -> int:
        """After ``<...>`` at i, if there is one."""
        if self.word(i) != "<":
            return i
        depth = 0
        while i < len(self.t):
            w = self.word(i)
            depth += (w == "<") - (w == ">")
            i = self.after(i)
            if depth == 0 or w == ";":
                break
        return i

    def to_body(self, i: int, end: int, stops: str = ";") -> int:
        """The next ``{`` at this level (not one of a type after ``:``), or where the statement ends."""
        typed = False
        while i < end and self.word(i) not in stops:
            w = self.word(i)
            if w == "{" and not typed:
                return i
            typed = w in (":", "|", "&", "=>", "is") or (typed and w in ("readonly", "keyof"))
            i = self.angles(i) if w == "<" else self.after(i)
        return i

    def statement_end(self, i: int, end: int) -> int:
        """After the statement at i: behind a semicolon, or before a line that cannot go on with it."""
        while i < end:
            if self.word(i) == ";":
                return i + 1
            last = i
            i = self.after(i)
            if i < end and self.t.fresh[i] and self.word(i) not in ("?", ":", ".", "?.", "|", "&", "=", "=>", "+", "-", "*", ",", "(", "[", "<", ">", "as", "satisfies", "extends") and not (self.t.kind[last] == "op" and self.word(last) in ("=", "=>", "|", "&", ",", "+", "-", "*", "?", ":", "(", "<", ".")):
                return i
        return i

    # -- reading
    def read(self, i: int, end: int, container: int, members: bool) -> None:
        """Reads a range of statements, or of members of a class or interface."""
        while i < end:
            i = self.member(i, end, container) if members else self.statement(i, end, container)

    def inside(self, i: int, container: int, members: bool = False) -> None:
        if 0 <= i < len(self.t) and self.t.partner[i] > i:
            self.work.append((i + 1, self.t.partner[i], container, members))

    def between(self, a: int, b: int, container: int) -> None:
        """The range is no declaration, but may hold some."""
        if a < min(b, len(self.t)):
            self.work.append((a, min(b, len(self.t)), container, False))

    def statement(self, i: int, end: int, container: int) -> int:
        t, w = self.t, self.word(i)
        if t.kind[i] == "op" and w in "([{":
            self.inside(i, container)
            return self.after(i)
        if t.kind[i] != "name" or (i and self.word(i - 1) in (".", "?.")):
            return i + 1
        if w == "import" and self.word(i + 1) not in ("(", "."):
            return self.import_(i, end)
        if w == "export":
            return self.export(i, end, container)
        return self.declaration(i, end, container, "local") or i + 1

    def declaration(self, i: int, end: int, container: int, visibility: str, name: str | None = None) -> int | None:
        """Reads the declaration at i, if there is one, and gives the token after it."""
        t, first = self.t, i
        while self.word(i) in ("declare", "abstract", "async") and self.word(i + 1) in ("abstract", "class", "function", "enum", "interface", "type", "const", "let", "var", "async"):
            i += 1
        w = self.word(i)
        if w == "const" and self.word(i + 1) == "enum":
            i, w = i + 1, "enum"
        if w == "function":
            k = i + 2 if self.word(i + 1) == "*" else i + 1
            named = k < end and t.kind[k] == "name"
            if not named and name is None:
                return None
            params = self.angles(k + named)
            if self.word(params) != "(":
                return None
            body = self.to_body(self.after(params), end)
            stop = self.after(body) if self.word(body) == "{" else body
            title = self.word(k) if named else name
            signature = title + self.source[self.at(params) : self.at(body)]
            s = self.push("function", title, container, t.start[first], self.upto(stop), signature, k if named else None, visibility)
            self.inside(params, s)
            self.between(self.after(params), body, s)
            if self.word(body) == "{":
                self.inside(body, s)
            return stop
        if w in ("class", "interface", "enum", "type") and (i + 1 < end and t.kind[i + 1] == "name" and self.word(i + 1) not in ("extends", "implements") or (w == "class" and name is not None)):
            named = t.kind[i + 1 : i + 2] == ["name"] and self.word(i + 1) not in ("extends", "implements")
            k = i + 1
            title = self.word(k) if named else name
            if w == "type":
                if self.word(self.angles(k + 1)) != "=":
                    return None
                stop = self.statement_end(k + 1, end)
                s = self.push("type_alias", title, container, t.start[first], self.upto(stop), self.source[t.start[first] : self.upto(stop)], k, visibility)
                self.between(k + 1, stop, s)
                return stop
            body = k + named
            while body < end and self.word(body) not in ("{", ";"):
                body = self.after(body)
            if self.word(body) != "{":
                return None
            stop = self.after(body)
            last = self.upto(stop)
            heritage = self.source[t.end[k] : self.at(body)] if named else ""
            s = self.push(w, title, container, t.start[first], last, title + heritage if w == "class" else self.source[t.start[first] : last], k if named else None, visibility)
            self.between(k + named, body, s)
            self.inside(body, s, w != "enum")
            if w == "enum":
                self.spoken.update(j for j in range(body, min(stop, len(t))) if t.kind[j] == "name" and self.word(j - 1) in ("{", ","))
            return stop
        if w in ("const", "let", "var") and i + 1 < end:
            return self.variables(first, i + 1, end, container, visibility)
        return None

    def variables(self, first: int, i: int, end: int, container: int, visibility: str) -> int:
        """A variable is a symbol only if a function is bound to it; the declarations of one statement are parted by commas."""
        t = self.t
        stop = self.statement_end(i, end)
        while i < stop:
            k, item = i, i
            while item < stop and self.word(item) not in (",", ";"):
                item = self.angles(item) if self.word(item) == "<" and self.word(item - 1) == "=" else self.after(item)
            eq = k + 1
            while eq < item and self.word(eq) != "=":
                eq = self.after(eq)
            f = eq + 1
            if self.word(f) == "async":
                f += 1
            params = self.angles(f + 1 + (self.word(f + 1) == "*")) if self.word(f) == "function" else self.angles(f)
            arrow = self.word(params) == "(" and "=>" in [self.word(j) for j in self.level(self.after(params), item)]
            if t.kind[k] == "name" and eq < item and (self.word(f) == "function" or arrow or (f < len(t) and t.kind[f] == "name" and self.word(f + 1) == "=>")):
                begin = t.start[first] if self.word(k - 1) in ("const", "let", "var") else t.start[k]
                body = self.after(params) if self.word(params) == "(" else f + 1
                while body < item and self.word(body) not in ("=>", "{"):
                    body = self.after(body)
                s = self.push("function", self.word(k), container, begin, self.upto(item), self.word(k) + self.source[self.at(params) : self.at(body)], k, visibility)
                if visibility != "local":
                    self.exports.append((s, self.word(k), self.word(k), None, False, False))
                self.between(eq + 1, item, s)
            else:
                if t.kind[k] == "name":
                    self.spoken.add(k)
                self.between(k, item, container)
            i = item + 1
        return stop

    def level(self, a: int, b: int) -> Iterator[int]:
        while a < b:
            yield a
            a = self.after(a)

    def member(self, i: int, end: int, container: int) -> int:
        t = self.t
        while i < end and (self.word(i) in (";", ",") or self.word(i) == "@"):
            i = i + 1 if self.word(i) != "@" else self.after(i + 2) if self.word(i + 2) == "(" else i + 2
        k = i
        while k < end and self.word(k) in MODIFIERS and self.word(k + 1) not in ("(", "=", ";", ":", "?", "!", "<"):
            k += 1
        if self.word(k) == "*":
            k += 1
        if k >= end:
            return end
        q = self.after(k)
        if self.word(q) in ("?", "!"):
            q += 1
        params = self.angles(q)
        if (t.kind[k] == "name" or t.kind[k] == "str") and self.word(params) == "(":
            name = self.word(k) if t.kind[k] == "name" else self.source[t.start[k] + 1 : t.end[k] - 1]
            body = self.to_body(self.after(params), end)
            if self.word(body) != "{":
                body = self.statement_end(self.after(params), end)
            stop = self.after(body) if self.word(body) == "{" else body
            stop = min(stop, end)
            signature = name + self.source[self.at(params) : self.at(body)]
            s = self.push("constructor" if name == "constructor" else "method", name, container, t.start[i], self.upto(max(stop, i + 1)), signature, k)
            self.inside(params, s)
            if self.word(body) == "{" and body < end:
                self.inside(body, s)
            return max(stop, k + 1)
        if t.kind[k] == "name":
            self.spoken.add(k)
        stop = max(self.statement_end(k, end), k + 1)
        self.between(k + 1, stop, container)
        return stop

    # -- imports and exports
    def specifiers(self, i: int) -> Iterator[tuple[int, str, int, str]]:
        """(token, name, token, alias) of a list in braces at i."""
        end, k = min(self.t.partner[i], len(self.t)), i + 1
        while k < end:
            if self.word(k) == "type" and self.word(k + 1) not in (",", "}", "as"):
                k += 1
            if self.t.kind[k] not in ("name", "str"):
                k += 1
                continue
            alias = k + 2 if self.word(k + 1) == "as" and k + 2 < end else k
            yield k, self.word(k), alias, self.word(alias)
            k = alias + 1

    def specifier(self, i: int) -> str | None:
        return self.source[self.t.start[i] + 1 : self.t.end[i] - 1] if i < len(self.t) and self.t.kind[i] == "str" else None

    def import_(self, i: int, end: int) -> int:
        t, k = self.t, i + 1
        stop = i + 1
        while stop < end and t.kind[stop] != "str" and self.word(stop) != ";":
            stop = self.after(stop)
        module = self.specifier(stop)
        self.spoken.update(range(i, min(stop, len(t))))
        if module is None or stop == k:  # without names a module is only run
            return stop + 1
        if self.word(k) == "type" and self.word(k + 1) not in ("from", ","):
            k += 1
        while k < stop:
            if self.word(k) == "{":
                for a, name, b, alias in self.specifiers(k):
                    self.binding(module, name, alias, b if t.kind[b] == "name" else a)
            elif self.word(k) == "*" and self.word(k + 1) == "as":
                self.binding(module, "*", self.word(k + 2), k + 2)
                k += 2
            elif t.kind[k] == "name" and self.word(k) not in ("from",):
                self.binding(module, "default", self.word(k), k)
            k = self.after(k)
        return stop + 1

    def binding(self, module: str, name: str, local: str, at: int, visibility: str = "local") -> int:
        s = self.push("import_binding", local, self.module, self.t.start[at], self.t.end[at], f"{module} {name}", at, visibility)
        if visibility == "local":
            self.imports.append((s, module, name, local))
        return s

    def export(self, i: int, end: int, container: int) -> int:
        t, k = self.t, i + 1
        default = self.word(k) == "default"
        k += default
        if self.word(k) == "type" and self.word(k + 1) == "{":
            k += 1
        if self.word(k) == "{":
            stop = self.after(k)
            module = self.specifier(stop + 1) if self.word(stop) == "from" else None
            for a, name, b, alias in self.specifiers(k):
                self.spoken.update((a, b))
                if module is None:
                    self.pending.append((name, alias, False, a))
                else:
                    s = self.binding(module, name, alias, a, "exported")
                    self.exports.append((s, name, alias, module, False, True))
            return stop + 2 * (module is not None)
        if self.word(k) == "*":
            return self.statement_end(k, end)
        before = len(self.symbols)
        visibility = "default_export" if default else "exported"
        stop = self.declaration(k, end, container, visibility, "default" if default else None)
        if stop is not None:
            if len(self.symbols) > before and self.word(k) not in ("const", "let", "var") or self.word(k + 1) == "enum":
                s = self.symbols[before]
                self.exports.append((before, s[1], "default" if default else s[1], None, default, False))
            return stop
        if default and t.kind[k : k + 1] == ["name"] and (k + 1 >= end or self.word(k + 1) == ";" or t.fresh[k + 1]):
            self.spoken.add(k)
            self.pending.append((self.word(k), "default", True, k))
            return k + 1
        return k

    def finish_exports(self) -> None:
        """Names in export lists mean what the file declares under that name at its top, where that is one thing."""
        for name, exported, default, at in self.pending:
            own = self.children.get((self.module, name), [])
            if len(own) == 1:
                self.raise_visibility(own[0], "default_export" if default else "exported")
                self.exports.append((own[0], name, exported, None, default, False))
                self.occur(own[0], "export", at)

    def resolve(self) -> None:
        """Names that are left become references where a container that is around them knows a declaration of that name."""
        spans = sorted(range(len(self.symbols)), key=lambda k: (self.symbols[k][6], -self.symbols[k][7]))
        around: list[int] = []
        nxt = 0
        t = self.t
        number = {s[0]: k for k, s in enumerate(self.symbols)}
        for i in range(len(t)):
            at = t.start[i]
            while nxt < len(spans) and self.symbols[spans[nxt]][6] <= at:
                around.append(spans[nxt])
                nxt += 1
            while len(around) > 1 and self.symbols[around[-1]][7] <= at:
                around.pop()
            w = t.text[i]
            if t.kind[i] != "name" or i in self.spoken or w in KEYWORDS or (i and t.text[i - 1] in (".", "?.")) or (i and t.text[i - 1] in ("{", ",", "(") and self.word(i + 1) == ":"):
                continue
            scope: int | None = around[-1] if around else self.module
            while scope is not None:
                s = self.symbols[scope]
                known = [k for k in self.children.get((scope, w), ()) if self.symbols[k][6] <= at]
                if s[1] == w and s[3] != "module":
                    known.append(scope)
                if known:
                    self.occur(max(known, key=lambda k: (self.symbols[k][6], k)), "reference", i)
                    break
                scope = number[s[4]] if s[4] else None

    def row(self) -> tuple[list, list, list, list]:
        ident = lambda k: self.symbols[k][0]
        return [tuple(s) for s in self.symbols], list(self.occurrences.values()), [(ident(i[0]), *i[1:]) for i in dict.fromkeys(self.imports)], [(ident(x[0]), *x[1:]) for x in dict.fromkeys(self.exports)]


def _struct(fields: str) -> pa.DataType:
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    return pa.struct([(n, kinds[k]) for n, k in (f.split() for f in fields.split(", "))])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    structs = [_struct(x) for x in (SYMBOL, OCCURRENCE, IMPORT, EXPORT)]
    for b in batches:
        found = []
        for repo, snapshot, path, text in zip(*(b.column(c).to_pylist() for c in (*FILE, "contents")), strict=True):
            found.append(FileFacts(repo or "", snapshot or "", path or "", (text or "").lstrip("﻿").replace("\r\n", "\n")).row())
        columns = [pa.array([[dict(zip([f.name for f in s], x, strict=True)) for x in f[k]] for f in found], pa.list_(s)) for k, s in enumerate(structs)]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in FILE), *columns], names=[*FILE, "symbols", "occurrences", "imports", "exports"])


def extract(files: DataFrame) -> DataFrame:
    """One row per file: key and arrays of symbols, occurrences, imports and exports.

    Symbols are the module itself, import bindings, functions (also those bound to a variable), classes, interfaces, type aliases, enums,
    methods and constructors. Null contents count as an empty file, which has its module alone. A file delivered again comes out as often. Positions
    are characters. Text that does not parse gives what can be read of it. Markup text is read as code, where only names that are declared count.
    """
    return files.select(*FILE, "contents").mapInArrow(_extract, OUT)


def _rows(facts: DataFrame, what: str) -> DataFrame:
    return facts.select(*FILE, F.explode(what).alias("_ts_x")).select(*FILE, "_ts_x.*")


def symbols(facts: DataFrame) -> DataFrame:
    """symbol_id, display_name, qualified_name, kind, container, visibility, start, end, signature_digest."""
    return _rows(facts, "symbols")


def occurrences(facts: DataFrame) -> DataFrame:
    """occurrence_id, symbol_id, role (definition, import, export, reference), start, end."""
    return _rows(facts, "occurrences")


def imports(facts: DataFrame) -> DataFrame:
    """symbol_id, module_specifier, imported_name, local_name."""
    return _rows(facts, "imports")


def exports(facts: DataFrame) -> DataFrame:
    """symbol_id, local_name, exported_name, module_specifier, is_default, is_reexport."""
    return _rows(facts, "exports")


def rebound(facts: DataFrame, snapshot_id: str) -> DataFrame:
    """The occurrences of ``facts`` under another snapshot: ids are made anew, symbols keep theirs."""
    o = occurrences(facts).withColumn("snapshot_id", F.lit(snapshot_id))
    digest = F.sha2(F.concat_ws("\n", "snapshot_id", "path", "symbol_id", "role", F.concat("start", F.lit("-"), "end")), 256)
    return o.withColumn("occurrence_id", F.concat(F.lit("occ."), "role", F.lit("."), F.substring(digest, 1, 12)))
