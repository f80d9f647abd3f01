"""A parser that accepts or rejects TypeScript and JavaScript: recursive-descent statements, precedence-climbing expressions.

Speed comes from sharing. A text becomes a string of token classes (every name is one class, every number another); each
bracketed group is replaced by one character that stands for its content, equal contents for the same character. The
parser then works on such short strings, and its verdict on (group, role, language) is kept, so code of a form seen before
costs a look-up. A rejected text is parsed once more with positions, where panic-mode recovery goes on at the next statement and
collects all errors.
"""

from __future__ import annotations

import bisect
import re
import sys
import threading

BASE = 0x20000
MOST_GROUPS = 400_000

# Token classes. Reserved words, then words that are names outside their contexts.
RESERVED = {
    "var": "v", "const": "c", "function": "f", "class": "C", "extends": "E", "return": "r", "if": "I", "else": "e", "for": "F", "while": "W",
    "do": "D", "switch": "S", "case": "k", "default": "d", "break": "b", "continue": "q", "throw": "h", "try": "y", "catch": "K", "finally": "Y",
    "new": "n", "delete": "z", "typeof": "o", "void": "w", "in": "N", "instanceof": "O", "this": "H", "super": "U", "null": "L", "true": "L",
    "false": "L", "import": "m", "export": "X", "debugger": "g", "with": "Q", "enum": "M",
}
CONTEXTUAL = {
    "let": "l", "await": "a", "yield": "j", "of": "ó", "async": "á", "get": "é", "set": "é", "static": "í", "from": "ñ", "as": "â", "type": "ê", "interface": "î", "declare": "ô",
    "namespace": "û", "module": "û", "abstract": "ã", "public": "õ", "private": "õ", "protected": "õ", "readonly": "õ", "override": "õ", "accessor": "õ",
    "is": "ä", "keyof": "ë", "unique": "ë", "infer": "ë", "satisfies": "ï", "implements": "ö", "asserts": "ü", "global": "ý",
}
PUNCTUATION = {
    "=>": "A", "...": "…", "?.": "·", "??": "u", "&&": "∧", "||": "∨", "++": "±", "--": "±", "**": "P", "==": "≡", "!=": "≡", "===": "≡", "!==": "≡", "<=": "≤", ">=": "≤", "<<": "«",
    "+": "+", "-": "+", "/": "%", "%": "%", "\n": "\n",
} | {x: "≔" for x in ("+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??=")} | {x: x for x in "(){}[];,<>*&|^!~?:=.@"}
CLASSES = RESERVED | CONTEXTUAL | PUNCTUATION
NAMES = "i" + "".join(sorted(set(CONTEXTUAL.values())))
WORDS = NAMES + "".join(sorted(set(RESERVED.values())))
BINARY = {"u": 1, "∨": 2, "∧": 3, "|": 4, "^": 5, "&": 6, "≡": 7, "<": 8, ">": 8, "≤": 8, "O": 8, "N": 8, "«": 9, "+": 10, "*": 11, "%": 11, "P": 12}
OPENERS = {"(": ")", "[": "]", "{": "}", "\x01": "\x02"}
# Fixed value: the class of what no valid text has.
BAD = "\x03"

# Alternatives are told apart by their first character, the commonest first; loops are unrolled.
_PLAIN = r"`[^`\\$]*(?:(?:\\[\s\S]|\$(?!\{))[^`\\$]*)*`"
_STRING = r"'[^'\\\n]*(?:\\[\s\S][^'\\\n]*)*'|\"[^\"\\\n]*(?:\\[\s\S][^\"\\\n]*)*\""
_COMMENT = r"//[^\n]*|/\*[\s\S]*?\*/"
_REGEX = r"[^\n/\\\[*](?:[^\n/\\\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])*/[A-Za-z]*|(?:\\.|\[(?:[^\]\\\n]|\\.)*\])(?:[^\n/\\\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])*/[A-Za-z]*"
_OPERAND_NEXT = "|".join(f"(?<={x}/)" for x in (r"[=(,:;!&|?{}\[+*%<>~^\n-]", r"[=(,:;!&|?{}\[+*%<>~^-] ", "return ", "typeof ", "case ", " in ", " of ", "await ", "void ", "else ", "delete ", "return", "typeof"))
_NUMBER = r"0[xX][\da-fA-F_]+n?(?![\w$])|0[bB][01_]+n?(?![\w$])|0[oO][0-7_]+n?(?![\w$])|\d[\d_]*\.?[\d_]*(?:[eE][+-]?\d+)?n?(?![\w$])"
TOKEN = re.compile(
    r"[A-Za-z_$][\w$]*(?:\\u\{?[0-9a-fA-F]{1,6}\}?[\w$]*)*|[(){}\[\];,:~@]|\n|" + _STRING + r"|\.(?:\.\.|\d[\d_]*(?:[eE][+-]?\d+)?)?|=(?:>|==|=)?|" + _NUMBER
    + r"|/(?:/[^\n]*|\*[\s\S]*?\*/|(?:" + _OPERAND_NEXT + ")(?:" + _REGEX + r")|=)?|" + _PLAIN
    + r"|!(?:==|=)?|\?(?:\.(?!\d)|\?=|\?)?|<(?:<=|<|=)?|>(?:>>=|>=|=)?|&(?:&=|&|=)?|\|(?:\|=|\||=)?|\+[+=]?|-[-=]?|\*(?:\*=|\*|=)?|[%^]=?|#[\w$]+|[^\W\d][\w$]*|\\u[0-9a-fA-F{}]+[\w$]*|[^ \t\r\n\f\v\xa0\ufeff\u2028\u2029\u1680\u2000-\u200a\u202f\u205f\u3000]"
)
# spaces that part nothing; what this does to the inside of strings does not matter for the verdict
_SPACES = re.compile(r"[ \t]*\n\s*|(?<=[=(,:;!&|?{}\[+*%<>~^-])[ \t]+(?=[\w$'\"`(\[{]|/(?![/*]))")
FIRST = {"'": "s", '"': "s", "`": "T", "#": "#"} | dict.fromkeys("0123456789", "0")


class SyntaxProblem(Exception):
    def __init__(self, at: int, what: str):
        self.at, self.what = at, what


def _class_of(token: str) -> str:
    """The class of a token that is no word or mark of the tables; ``BAD`` for what belongs to no valid text."""
    c = token[0]
    if c == "/" and token[1:2] in ("/", "*"):
        return "\n" if "\n" in token else ""
    if c in FIRST:
        if len(token) == 1 and not c.isdigit():
            return BAD
        return FIRST[c] if c in "'\"#0123456789" or token[-1] == c else BAD
    if c == "." and len(token) > 1:
        return "0"
    if c == "/" and len(token) > 1:
        return "R"
    if c == "_" or c == "$" or c.isalpha() or (c == "\\" and len(token) > 1):
        return "i"
    return BAD


class _Memo(dict):
    def __missing__(self, token: str) -> str:
        c = _class_of(token)
        if len(self) < 200_000:
            self[token] = c
        return c


_CLASS = _Memo(CLASSES)


# ---- lexing -------------------------------------------------------------------------------------------------------

_UNCLOSED_BRACE = "unclosed brace in template or markup"
_HAS_SUBSTITUTION = re.compile(r"\$\{")
_JSX_START = re.compile(_COMMENT + "|" + _STRING + "|" + _PLAIN + r"|(?:[(=?:&|,{}\[>;]|\breturn|\bdefault|=>)\s*(<)(?=[A-Za-z_$>])(?![A-Za-z_$][\w$]*(?:,|\s+extends\b))")
_JSX_TAG = re.compile(r"<\s*(/?)\s*([A-Za-z_$][\w$.:-]*)?\s*")
_JSX_ATTRIBUTE = re.compile(r"\s*([A-Za-z_$][\w$:-]*)\s*(=)?\s*(\"[^\"]*\"|'[^']*'|(?=\{)|(?=<))?")
_NO_ATTRIBUTE = re.compile(r"[^\s{}<>/]*\s*")
_MODE = re.compile(_COMMENT + "|" + _STRING + r"|[`{}]")
_TEMPLATE_PART = re.compile(r"[^`\\$]+|\\[\s\S]|\$(?!\{)|\$\{|`")
_MARKUP_TEXT = re.compile(r"[^{}<>]*")
_BLANK = re.compile(r"\s*")
_MAYBE_COMMENT = re.compile(_COMMENT + "|")


def _balanced(text: str, at: int) -> int:
    """The position after the ``}`` that closes the ``{`` before ``at``."""
    depth = 1
    while True:
        m = _MODE.search(text, at)
        if not m:
            raise SyntaxProblem(at, _UNCLOSED_BRACE)
        at = m.end()
        c = m.group()
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0:
                return at
        elif c == "`":
            at = _template_end(text, at)[0]


def _template_end(text: str, at: int) -> tuple[int, list[tuple[int, int]]]:
    """The position after a template whose first character is at ``at``, and the spans of its substitutions."""
    spans = []
    while True:
        m = _TEMPLATE_PART.match(text, at)
        if not m:
            raise SyntaxProblem(at, "unterminated template")
        at = m.end()
        if m.group() == "`":
            return at, spans
        if m.group() == "${":
            end = _balanced(text, at)
            spans.append((at, end - 1))
            at = end


def _wrong(found: list | None, at: int, what: str) -> None:
    """Keeps an error of markup where all are wanted; the caller then goes on behind it."""
    if found is None:
        raise SyntaxProblem(at, what)
    found.append((what, at))


def _braces(text: str, at: int, b: int, out: list, jsx: bool, places: bool, found: list | None) -> int:
    """Lexes the code in the braces of markup at ``at``; one never closed reaches to the end. Returns the position after it."""
    try:
        end = _balanced(text, at + 1)
        if found is not None and end > b:
            raise SyntaxProblem(end, _UNCLOSED_BRACE)
    except SyntaxProblem as e:
        _wrong(found, at if found is not None else e.at, e.what)
        out.append(("\x01", at))
        _lex(text, at + 1, b, out, jsx, places, found)
        return max(at + 1, b)
    _sub(text, at + 1, end - 1, out, jsx, places, found)
    return end


def _markup(text: str, at: int, b: int, out: list, jsx: bool, places: bool, found: list | None = None) -> int:
    """Reads one element of markup at ``at``; its braces are lexed into ``out``. Returns the position after it."""
    stack: list[str] = []
    out.append(("x", at))
    # where reading goes on after errors, it stays in the code that holds the element
    stop = len(text) if found is None else b
    while True:
        m = _JSX_TAG.match(text, at)
        if not m:
            raise SyntaxProblem(at, "bad tag")
        closing, name = m.group(1), m.group(2) or ""
        begin, at = at, m.end()
        if closing:
            if not stack or stack[-1] != name or text[at : at + 1] != ">":
                _wrong(found, begin, "closing tag does not match")
                # it closes the element of its name, else the innermost
                while name in stack and stack[-1] != name:
                    stack.pop()
            if stack:
                stack.pop()
            at += text[at : at + 1] == ">"
        else:
            while name and at < stop and text[at] not in ">/":
                if text[at] == "{":
                    at = _braces(text, at, b, out, jsx, places, found)
                elif text.startswith(("/*", "//"), at):
                    at = _MAYBE_COMMENT.match(text, at).end() or at + 2
                else:
                    a = _JSX_ATTRIBUTE.match(text, at)
                    if not a:
                        _wrong(found, at, "bad attribute")
                        if text[at] == "<":
                            break
                        at = _NO_ATTRIBUTE.match(text, at + 1).end()
                        continue
                    at = a.end()
                    if a.group(2) and not a.group(3):
                        if text[at : at + 1] == "{":
                            at = _braces(text, at, b, out, jsx, places, found)
                        elif text[at : at + 1] == "<":
                            at = _markup(text, at, b, out, jsx, places, found)
                        else:
                            _wrong(found, at, "attribute without value")
                at = _BLANK.match(text, at).end()
            if at >= stop:
                _wrong(found, stop, "unclosed tag")
                return stop
            if text.startswith("/>", at):
                at += 2
            elif text[at : at + 1] == ">":
                at += 1
                stack.append(name)
            else:
                if text[at : at + 1] != "<" or not name:
                    _wrong(found, at, "unclosed tag")
                at += text[at : at + 1] == "/"
                stack.append(name)
        if not stack:
            return at if found is None else min(at, stop)
        while True:  # children
            m = _MARKUP_TEXT.match(text, at)
            at = m.end()
            c = text[at : at + 1] if at < stop else ""
            if c == "{":
                at = _braces(text, at, b, out, jsx, places, found)
            elif c == "<":
                break
            else:
                _wrong(found, min(at, stop), "unclosed element" if not c else "bare bracket in markup")
                # a brace that no closing tag follows ends the code around the element
                if not c or (c == "}" and text.find(f"</{stack[-1]}", at, b) < 0):
                    return min(at, stop)
                at += 1


def _sub(text: str, a: int, b: int, out: list, jsx: bool, places: bool, found: list | None = None) -> None:
    out.append(("\x01", a))
    _lex(text, a, b, out, jsx, places, found)
    out.append(("\x02", b))


def _lex(text: str, a: int, b: int, out: list, jsx: bool, places: bool = True, found: list | None = None) -> None:
    """Appends (class, position) of text[a:b]; templates with substitutions and markup are entered.

    Without ``places`` a stretch of plain tokens is one item. With ``found`` errors of markup go there and reading goes on.
    """
    at = a
    while at < b:
        to = b
        if jsx:
            # what is embedded may begin with markup; the bracket before it is then the sign
            p = at - 1 if at == a and a > 0 else at
            while m := _JSX_START.search(text, p, b):
                if m.group(1):
                    to = m.start(1)
                    break
                p = m.end()
        if not places:
            tokens = TOKEN.findall(text, at, to)
            if "`" not in tokens:
                out.append(("".join(map(_CLASS.__getitem__, tokens)), at))
                at = to
                if to < b:
                    at = _markup(text, to, b, out, jsx, places, found)
                continue
        for m in TOKEN.finditer(text, at, to):
            t = m.group()
            if t == "`":
                end, spans = _template_end(text, m.end())
                out.append(("T", m.start()))
                for x, y in spans:
                    _sub(text, x, y, out, jsx, places, found)
                at = end
                break
            out.append((_CLASS[t], m.start()))
        else:
            at = to
            if to < b:
                at = _markup(text, to, b, out, jsx, places, found)


_SIMPLE_SUBSTITUTION = re.compile(r"\$\{[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*\}")


def classes(text: str, jsx: bool) -> str:
    """The token classes of ``text`` as a string."""
    markup = jsx and ("</" in text or "/>" in text)
    if "${" in text and "`" in text:
        # a substitution of a bare name or path is always an expression
        text = _SIMPLE_SUBSTITUTION.sub("x", text)
    if not markup:
        text = _SPACES.sub(lambda m: "\n" if "\n" in m.group() else "", text)
    if markup or ("${" in text and "`" in text):
        out: list = []
        _lex(text, 0, len(text), out, markup, places=False)
        return "".join([c for c, _ in out])
    return "".join(map(_CLASS.__getitem__, TOKEN.findall(text)))


# ---- groups -------------------------------------------------------------------------------------------------------


class Groups:
    """Contents of bracketed groups. Equal contents share one character; verdicts are kept by (group, role, language)."""

    def __init__(self):
        self.kind: list[str] = []
        self.text: list[str] = []
        self.where: list[list[int] | None] = []
        self.known: dict[str, str] = {}
        self.verdict: dict[tuple[str, str, bool, bool], bool] = {}
        # errors of groups with places, by (group, role); of those that panic mode passes over, by group
        self.errors: dict[tuple[int, str], list] = {}
        self.passed: dict[int, list] = {}

    def add(self, whole: str) -> str:
        c = self.known.get(whole)
        if c is None:
            if OPENERS[whole[0]] != whole[-1]:
                raise SyntaxProblem(0, "brackets do not match")
            c = self.known[whole] = chr(BASE + len(self.kind))
            self.kind.append(whole[0])
            self.text.append(whole[1:-1])
            self.where.append(None)
        return c

    def place(self, kind: str, text: str, where: list[int]) -> str:
        self.kind.append(kind)
        self.text.append(text)
        self.where.append(where)
        return chr(BASE + len(self.kind) - 1)


_INNERMOST = re.compile("[(\\[{\x01][^()\\[\\]{}\x01\x02]*[)\\]}\x02]")
_BRACKET = re.compile("[()\\[\\]{}\x01\x02]")
PASSES = 40
_RUNS = re.compile(r"(?<=[,\[(])(?:\n*\+?[0s]\n*,){3,}")
_LINES = re.compile(r"\n+(?=[.,;)\]}=?:&|<>*%∧∨≡≔·uA])|(?<=[;,({\[=+*%&|?:<>!~∧∨≡≔.·uA…])\n+")


def fold(s: str, groups: Groups) -> str:
    """``s`` with every bracketed group folded into one character."""
    s = _LINES.sub("", s)
    s = _RUNS.sub("0,", s)
    add = groups.add
    for _ in range(PASSES):
        s, n = _INNERMOST.subn(lambda m: add(m.group()), s)
        if n == 0:
            break
    else:
        s = _fold_rest(s, groups)
    if re.search("[()\\[\\]{}\x01\x02]", s):
        raise SyntaxProblem(0, "brackets do not match")
    return s


def _fold_rest(s: str, groups: Groups) -> str:
    """What ``fold`` gives, in one walk: each pass reads all that is left, so deep nesting is not folded in passes."""
    stack, at = [""], 0
    opened: list[str] = []
    for m in _BRACKET.finditer(s):
        c = m.group()
        stack[-1] += s[at : m.start()]
        at = m.end()
        if c in OPENERS:
            opened.append(c)
            stack.append("")
        elif opened:
            inner = stack.pop()
            stack[-1] += groups.add(opened.pop() + inner + c)
        else:
            raise SyntaxProblem(0, "brackets do not match")
    if opened:
        raise SyntaxProblem(0, "brackets do not match")
    return stack[0] + s[at:]


# ---- parsing ------------------------------------------------------------------------------------------------------


class Parser:
    """Parses one string of classes. ``problems`` is None while only the verdict is wanted."""

    def __init__(self, s: str, groups: Groups, ts: bool, jsx: bool, problems: list | None = None, where: list[int] | None = None):
        self.s, self.p, self.g, self.ts, self.jsx = s + "\0\0\0\0", 0, groups, ts, jsx
        self.end = len(s)
        self.problems, self.where = problems, where
        self.no_in = False

    # -- tokens
    def peek(self) -> str:
        s, p = self.s, self.p
        while s[p] == "\n":
            p += 1
        self.p = p
        return s[p]

    def at_end(self) -> bool:
        """Whether all is read and nothing beyond: a token taken unseen may have been the end."""
        return self.peek() == "\0" and self.p == self.end

    def after(self, k: int = 1) -> str:
        """The k-th token after the next one."""
        s, p = self.s, self.p
        while s[p] == "\n":
            p += 1
        while k:
            if s[p] == "\0":
                return "\0"
            p += 1
            while s[p] == "\n":
                p += 1
            k -= 1
        return s[p]

    def fail(self, what: str):
        raise SyntaxProblem(self.p, what)

    def accept(self, c: str) -> bool:
        if self.peek() == c:
            self.p += 1
            return True
        return False

    def expect(self, c: str, what: str):
        if self.peek() != c:
            self.fail(what)
        self.p += 1

    def is_group(self, c: str, kind: str) -> bool:
        return c >= "\U00020000" and self.g.kind[ord(c) - BASE] == kind

    def group(self, kind: str, role: str, what: str):
        c = self.peek()
        if not self.is_group(c, kind):
            self.fail(what)
        self.inside(c, role)
        self.p += 1

    def inside(self, c: str, role: str):
        """Parses the content of a group in a role; its own errors stay with it when all errors are wanted."""
        g, n = self.g, ord(c) - BASE
        if self.problems is not None:
            found = g.errors.get((n, role))
            if found is None:
                found = g.errors[n, role] = []
                Parser(g.text[n], g, self.ts, self.jsx, found, g.where[n]).whole(role)
            self.problems += found
            return
        key = (c, role, self.ts, self.jsx)
        ok = g.verdict.get(key)
        if ok is None:
            ok = True
            try:
                sub = Parser(g.text[n], g, self.ts, self.jsx)
                getattr(sub, "in_" + role)()
                ok = sub.at_end()
            except SyntaxProblem:
                ok = False
            g.verdict[key] = ok
        if not ok:
            raise SyntaxProblem(self.p, f"bad {role}")

    def whole(self, role: str):
        """A group in a role with all its errors: after one it goes on with the next member."""
        read = getattr(self, "in_" + role)
        while True:
            begin = self.p
            try:
                read()
                if not self.at_end():
                    self.fail("unexpected token")
                return
            except SyntaxProblem as e:
                self.problems.append((e.what, self.place(e.at)))
                self.recover(begin, e.at, _NEXT_MEMBER.get(role, ""), role == "class", role == "switch")
                if self.p >= self.end:
                    return

    def pass_over(self, c: str):
        """The errors of a group that panic mode skips, whose role is not known: those of the reading with the fewest."""
        g, n = self.g, ord(c) - BASE
        if n not in g.passed:
            best = None
            for role in _READINGS[g.kind[n]]:
                found = []
                if self.ts or role not in _TYPED_ROLES:
                    Parser(g.text[n], g, self.ts, self.jsx, found, g.where[n]).whole(role)
                    best = found if best is None or len(found) < len(best) else best
                if not best:
                    break
            g.passed[n] = best
        self.problems += g.passed[n]

    def place(self, at: int) -> int:
        return self.where[min(at, len(self.where) - 1)] if self.where else -1

    def attempt(self, f) -> bool:
        p = self.p
        try:
            f()
            return True
        except SyntaxProblem:
            self.p = p
            return False

    # -- lists
    def commas(self, one, end: str = "\0"):
        while self.peek() != end:
            one()
            if not self.accept(","):
                if self.peek() != end:
                    self.fail("expected a comma")
                return

    def end_of_statement(self):
        s, p = self.s, self.p
        if s[p] in ";\n":
            self.p = p + 1
        elif s[p] != "\0" and not (p > 0 and s[p - 1] == "\n"):
            self.fail("expected the end of a statement")

    # -- roles of groups
    def in_block(self):
        self.statements()

    def in_paren(self):
        self.expression()

    def in_args(self):
        self.commas(self.spread_or_expression)

    def in_markup(self):
        if self.peek() == "…":
            self.p += 1
        if self.peek() != "\0":
            self.expression()

    def in_array(self):
        while self.peek() != "\0":
            if self.accept(","):
                continue
            self.spread_or_expression()
            if self.peek() != "\0":
                self.expect(",", "expected a comma")

    def in_object(self):
        self.commas(self.member_of_object)

    def in_params(self):
        self.commas(self.parameter)

    def in_names(self):
        def one():
            if self.ts and self.peek() == "ê" and self.after() in WORDS + "s" and self.after() != "â":
                self.p += 1
            if self.peek() not in WORDS + "s":
                self.fail("expected a name")
            self.p += 1
            if self.accept("â"):
                if self.peek() not in WORDS + "s":
                    self.fail("expected a name")
                self.p += 1

        self.commas(one)

    def in_for(self):
        c = self.peek()
        self.no_in = True
        if c == ";":
            pass
        elif c in "vc" or (c == "l" and (self.after() in NAMES or self.after() >= "\U00020000")):
            self.p += 1
            self.binding()
            if self.peek() in "óN":
                self.no_in = False
                self.p += 1
                self.expression()
                return
            self.initializer()
            while self.accept(","):
                self.binding()
                self.initializer()
        else:
            self.expression()
            if self.peek() in "óN":
                self.no_in = False
                self.p += 1
                self.expression()
                return
        self.no_in = False
        self.expect(";", "expected a semicolon")
        if self.peek() != ";":
            self.expression()
        self.expect(";", "expected a semicolon")
        if self.peek() != "\0":
            self.expression()

    def in_catch(self):
        self.binding()

    def in_switch(self):
        while self.peek() != "\0":
            if self.accept("d"):
                pass
            else:
                self.expect("k", "expected a case")
                self.expression()
            self.expect(":", "expected a colon")
            while self.peek() not in "kd\0":
                self.statement() if self.problems is None else self.step()

    def in_class(self):
        while self.peek() != "\0":
            if self.accept(";"):
                continue
            self.member_of_class()

    def in_members(self):
        while self.peek() != "\0":
            self.member_of_type()
            s, p = self.s, self.p
            if s[p] in ";,\n":
                self.p += 1
            elif s[p] != "\0" and not (p > 0 and s[p - 1] == "\n"):
                self.fail("expected the end of a member")

    def in_enum(self):
        def one():
            c = self.peek()
            if c not in WORDS + "s" and not self.is_group(c, "["):
                self.fail("expected a member")
            self.p += 1
            if self.accept("="):
                self.assignment()

        self.commas(one)

    def in_type(self):
        self.type()

    def in_tuple(self):
        def one():
            self.accept("…")
            if self.peek() in WORDS and self.after() in "?:" and (self.after() == ":" or self.after(2) == ":"):
                self.p += 1
                self.accept("?")
                self.expect(":", "expected a colon")
            self.type()
            self.accept("?")

        self.commas(one)

    def in_index(self):
        if self.peek() in NAMES and self.after() == ":":
            self.p += 1
            self.p = self.s.index(":", self.p) + 1
            self.type()
        elif self.peek() in NAMES and self.after() == "N":
            self.p = self.s.index("N", self.p) + 1
            self.type()
            if self.accept("â"):
                self.type()
        else:
            self.assignment()

    def in_pattern_array(self):
        while self.peek() != "\0":
            if self.accept(","):
                continue
            self.accept("…")
            self.binding_target()
            if self.accept("="):
                self.assignment()
            if self.peek() != "\0":
                self.expect(",", "expected a comma")

    def in_pattern_object(self):
        def one():
            if self.accept("…"):
                self.binding_target()
                return
            c = self.peek()
            if c in NAMES and self.after() != ":":
                self.p += 1
            else:
                self.property_name()
                self.expect(":", "expected a colon")
                self.binding_target()
            if self.accept("="):
                self.assignment()

        self.commas(one)

    # -- bindings
    def binding_target(self):
        c = self.peek()
        if c in NAMES:
            self.p += 1
        elif self.is_group(c, "["):
            self.group("[", "pattern_array", "")
        elif self.is_group(c, "{"):
            self.group("{", "pattern_object", "")
        else:
            self.fail("expected a name or a pattern")

    def binding(self):
        self.binding_target()
        if self.ts:
            if self.peek() == "!" and self.after() == ":":
                self.p += 1
            if self.accept(":"):
                self.type()

    def initializer(self):
        if self.accept("="):
            self.assignment()

    def parameter(self):
        while self.peek() == "@":
            self.decorator()
        if self.ts:
            while self.peek() == "õ" and (self.after() in NAMES or self.after() >= "\U00020000"):
                self.p += 1
            if self.accept("H"):
                if self.accept(":"):
                    self.type()
                return
        self.accept("…")
        self.binding_target()
        if self.ts:
            self.accept("?")
            if self.accept(":"):
                self.type()
        self.initializer()

    def property_name(self):
        c = self.peek()
        if c in WORDS or c in "s0#":
            self.p += 1
        elif self.is_group(c, "["):
            self.group("[", "index", "")
        else:
            self.fail("expected a property name")

    def signature(self, body: str):
        """Type parameters, parameters and return type; then the body: needed, optional (in TypeScript) or none."""
        if self.ts and self.peek() == "<":
            self.type_parameters()
        self.group("(", "params", "expected parameters")
        if self.ts and self.accept(":"):
            self.type(predicate=True)
        if body == "none":
            return
        if self.is_group(self.peek(), "{"):
            self.group("{", "block", "")
        elif body == "optional" and self.ts:
            self.end_of_statement()
        else:
            self.fail("expected a body")

    def member_of_object(self):
        if self.accept("…"):
            self.assignment()
            return
        self.accessors("áé*")
        c = self.peek()
        n = self.after()
        if c in NAMES and (n in ",\0=") and n != "":
            self.p += 1
            if self.accept("="):
                self.assignment()
            return
        if c in NAMES and self.s[self.p + 1] == "\0":
            self.p += 1
            return
        self.property_name()
        if self.peek() == "<" or self.is_group(self.peek(), "("):
            self.signature("needed")
        else:
            self.expect(":", "expected a colon")
            self.assignment()

    def accessors(self, which: str):
        """Skips modifiers: words that are followed by a further name."""
        while self.peek() in which:
            n = self.after()
            if self.peek() != "*" and not (n in WORDS + "s0#*" or self.is_group(n, "[")):
                return
            if self.peek() != "*" and n == "\0":
                return
            self.p += 1

    def member_of_class(self):
        while self.peek() == "@":
            self.decorator()
        if self.peek() == "í" and self.is_group(self.after(), "{"):
            self.p += 1
            self.group("{", "block", "")
            return
        self.accessors("íáé*" + ("õãô" if self.ts else ""))
        self.property_name()
        if self.ts and self.peek() in "?!":
            self.p += 1
        if self.peek() == "<" or self.is_group(self.s[self.p], "("):
            self.signature("optional")
            return
        if self.ts and self.accept(":"):
            self.type()
        self.initializer()
        self.end_of_statement()

    def member_of_type(self):
        self.accept("+")
        if self.peek() == "õ" and (self.after() in WORDS + "s0" or self.is_group(self.after(), "[")):
            self.p += 1
        if self.peek() == "é" and (self.after() in WORDS + "s0"):
            self.p += 1
        if self.peek() == "n" and (self.is_group(self.after(), "(") or self.after() == "<"):
            self.p += 1
        c = self.peek()
        if c == "<" or self.is_group(c, "("):
            self.signature("none")
            return
        self.property_name()
        self.accept("+")
        self.accept("?")
        if self.peek() == "<" or self.is_group(self.s[self.p], "("):
            self.signature("none")
        elif self.accept(":"):
            self.type()

    def decorator(self):
        self.expect("@", "")
        c = self.peek()
        if self.is_group(c, "("):
            self.group("(", "paren", "")
            return
        if c not in NAMES:
            self.fail("expected a decorator")
        self.p += 1
        while self.accept("."):
            self.p += 1
        if self.is_group(self.peek(), "("):
            self.group("(", "args", "")

    # -- types
    def type_parameters(self):
        self.expect("<", "")

        def one():
            while self.peek() in "cNó" or (self.peek() == "õ" and self.after() in NAMES):
                self.p += 1
            if self.peek() not in NAMES:
                self.fail("expected a type parameter")
            self.p += 1
            if self.accept("E"):
                self.type()
            if self.accept("="):
                self.type()

        self.commas(one, ">")
        self.expect(">", "expected >")

    def type_arguments(self):
        self.expect("<", "")
        self.commas(self.type, ">")
        self.expect(">", "expected >")

    def type(self, predicate: bool = False):
        if predicate:
            if self.peek() == "ü" and self.after() in "iH":
                self.p += 2
                if self.accept("ä"):
                    self.type()
                return
            if self.peek() in NAMES + "H" and self.after() == "ä":
                self.p += 1
                self.expect("ä", "")
                self.type()
                return
        if self.peek() == "ã" and self.after() == "n":
            self.p += 1
        if self.peek() == "n":
            self.p += 1
            self.function_type()
            return
        if self.peek() == "<" or (self.is_group(self.peek(), "(") and self.after() == "A"):
            self.function_type()
            return
        if self.peek() in "|&":
            self.p += 1
        self.type_operand()
        while self.peek() in "|&":
            self.p += 1
            self.type_operand()
        if self.peek() == "E" and self.s[self.p - 1] != "\n":
            self.p += 1
            self.type()
            self.expect("?", "expected ?")
            self.type()
            self.expect(":", "expected :")
            self.type()

    def function_type(self):
        if self.peek() == "<":
            self.type_parameters()
        self.group("(", "params", "expected parameters")
        self.expect("A", "expected =>")
        self.type(predicate=True)

    def type_operand(self):
        c = self.peek()
        if c == "ë" and (self.after() in WORDS or self.after() >= "\U00020000"):
            self.p += 1
            self.type_operand()
            return
        if c == "õ" and (self.after() in NAMES or self.after() >= "\U00020000"):
            self.p += 1
            self.type_operand()
            return
        if c == "o":
            self.p += 1
            if self.peek() == "m":
                self.type_operand()
                return
            if self.peek() not in NAMES + "H":
                self.fail("expected a name")
            self.p += 1
            while self.accept("."):
                self.p += 1
            if self.peek() == "<":
                self.type_arguments()
        elif c in "0sL":
            self.p += 1
        elif c == "T":
            self.p += 1
            while self.is_group(self.s[self.p], "\x01"):
                self.group("\x01", "type", "")
        elif c == "+":
            self.p += 1
            self.expect("0", "expected a number")
        elif c in "wH":
            self.p += 1
        elif c == "m":
            self.p += 1
            self.group("(", "args", "expected a module")
            while self.accept("."):
                self.p += 1
            if self.peek() == "<":
                self.type_arguments()
        elif c in NAMES:
            self.p += 1
            while self.peek() == "." and self.after() in WORDS:
                self.p += 1
                self.peek()
                self.p += 1
            if self.s[self.p] == "<":
                self.type_arguments()
        elif self.is_group(c, "{"):
            self.group("{", "members", "")
        elif self.is_group(c, "["):
            self.group("[", "tuple", "")
        elif self.is_group(c, "("):
            self.group("(", "type", "")
        else:
            self.fail("expected a type")
        while self.is_group(self.s[self.p], "["):
            n = self.g.text[ord(self.s[self.p]) - BASE]
            if n.strip("\n"):
                self.group("[", "type", "")
            else:
                self.p += 1

    # -- expressions
    def expression(self):
        self.assignment()
        while self.accept(","):
            self.assignment()

    def spread_or_expression(self):
        self.accept("…")
        self.assignment()

    def arrow_body(self):
        if self.is_group(self.peek(), "{"):
            self.group("{", "block", "")
        else:
            self.assignment()

    def arrow(self):
        """An arrow function, from its parameters on; fails where it is none."""
        if self.ts and self.peek() == "<":
            begin = self.p
            self.type_parameters()
            # where markup is allowed, a lone name in angle brackets is a tag
            if self.jsx and "," not in self.s[begin : self.p] and "E" not in self.s[begin : self.p]:
                self.fail("expected an expression")
        if self.peek() in NAMES:
            self.p += 1
        else:
            self.group("(", "params", "expected parameters")
            if self.ts and self.accept(":"):
                self.type(predicate=True)
        if self.peek() != "A":
            self.fail("expected =>")
        self.p += 1

    def is_arrow(self) -> bool:
        c = self.peek()
        n = self.after()
        if c in NAMES:
            return n == "A"
        if self.is_group(c, "("):
            if n == "A":
                return True
            if not (self.ts and n == ":"):
                return False
        elif not (self.ts and c == "<"):
            return False
        p = self.p
        saved, self.problems = self.problems, None
        found = self.attempt(self.arrow)
        self.problems = saved
        self.p = p
        return found

    def assignment(self):
        c = self.peek()
        if c == "á" and self.after() != "A" and self.s[self.p + 1] != "\n":
            self.p += 1
            if self.is_arrow():
                self.arrow()
                self.arrow_body()
                return
            self.p -= 1
        if self.is_arrow():
            self.arrow()
            self.arrow_body()
            return
        if c == "j":
            self.p += 1
            self.accept("*")
            if self.s[self.p] not in "\n\0;,:)":
                self.assignment()
            return
        target = self.binary(0)
        c = self.peek()
        if c == "?":
            self.p += 1
            saved, self.no_in = self.no_in, False
            self.assignment()
            self.no_in = saved
            self.expect(":", "expected a colon")
            self.assignment()
        elif c == "=" or c == "≔":
            if not target:
                self.fail("bad assignment target")
            self.p += 1
            self.assignment()

    def binary(self, least: int) -> bool:
        """Precedence climbing; tells whether the operand may be assigned to."""
        target = self.unary()
        while True:
            c = self.peek()
            if (c == "â" or c == "ï") and self.ts and least < 8 and self.s[self.p - 1] != "\n":
                self.p += 1
                if not self.accept("c"):
                    self.type()
                continue
            level = BINARY.get(c)
            if level is None or level <= least or (c == "N" and self.no_in):
                return target
            target = False
            self.p += 1
            if c == ">":
                while self.s[self.p] == ">":
                    self.p += 1
            # the operator of powers binds to the right
            self.binary(level - 1 if c == "P" else level)

    def unary(self) -> bool:
        c = self.peek()
        if c in "+!~owz" or c == "±":
            self.p += 1
            self.unary()
            return False
        if c == "a":
            n = self.s[self.p + 1]
            if n in WORDS + "s0TRx" or (n >= "\U00020000" and not self.is_group(n, "[")):
                self.p += 1
                self.unary()
                return False
        if c == "<" and self.ts and not self.jsx:
            self.type_arguments()
            self.unary()
            return False
        target = self.postfix()
        if self.s[self.p] == "±" and self.s[self.p - 1] != "\n":
            if not target:
                self.fail("bad operand")
            self.p += 1
            return False
        return target

    def postfix(self) -> bool:
        target = self.primary()
        return self.suffixes(target, True)

    def suffixes(self, target: bool, calls: bool) -> bool:
        while True:
            c = self.peek()
            if c == ".":
                self.p += 1
                if self.peek() not in WORDS + "#":
                    self.fail("expected a member name")
                self.p += 1
                target = True
            elif c == "·":
                self.p += 1
                c = self.peek()
                if c in WORDS + "#":
                    self.p += 1
                elif self.is_group(c, "("):
                    self.group("(", "args", "")
                else:
                    self.group("[", "paren", "expected a member")
                target = False
            elif c == "!" and self.ts and self.s[self.p - 1] != "\n":
                self.p += 1
            elif c == "T":
                self.template()
                target = False
            elif c >= "\U00020000":
                kind = self.g.kind[ord(c) - BASE]
                if kind == "(" and calls:
                    self.group("(", "args", "")
                    target = False
                elif kind == "[":
                    self.group("[", "paren", "")
                    target = True
                else:
                    return target
            elif c == "<" and self.ts:
                p = self.p
                saved, self.problems = self.problems, None
                fine = self.attempt(self.type_arguments) and (self.is_group(self.s[self.p], "(") or self.s[self.p] in "T;,\n\0):")
                self.problems = saved
                if not fine:
                    self.p = p
                    return target
            else:
                return target

    def template(self):
        self.p += 1
        while self.is_group(self.s[self.p], "\x01"):
            self.group("\x01", "paren", "")

    def primary(self) -> bool:
        c = self.peek()
        if c == "á" and self.s[self.p + 1] == "f":
            self.p += 1
            self.function(False)
            return False
        if c in NAMES:
            self.p += 1
            return True
        if c in "0sLHR":
            self.p += 1
            return False
        if c == "T":
            self.template()
            return False
        if c == "x":
            self.p += 1
            while self.s[self.p] == "x" or self.is_group(self.s[self.p], "\x01"):
                if self.s[self.p] == "x":
                    self.p += 1
                else:
                    self.group("\x01", "markup", "")
            return False
        if c == "f":
            self.function(False)
            return False
        if c == "C" or c == "@":
            while self.peek() == "@":
                self.decorator()
            self.class_(False)
            return False
        if c == "n":
            self.p += 1
            if self.accept("."):
                self.p += 1
                return False
            if self.peek() == "n":
                self.primary()
            else:
                self.suffixes(self.primary(), False)
            if self.is_group(self.peek(), "("):
                self.group("(", "args", "")
            return False
        if c == "U":
            self.p += 1
            if not (self.peek() == "." or self.is_group(self.peek(), "(") or self.is_group(self.peek(), "[")):
                self.fail("super alone")
            return False
        if c == "m":
            self.p += 1
            if self.accept("."):
                self.p += 1
            else:
                self.group("(", "args", "expected a module")
            return False
        if c == "#" and self.after() == "N":
            self.p += 1
            return False
        if c >= "\U00020000":
            kind = self.g.kind[ord(c) - BASE]
            if kind == "(":
                self.group("(", "paren", "")
                return True
            if kind == "[":
                self.group("[", "array", "")
                return True
            if kind == "{":
                self.group("{", "object", "")
                return True
        self.fail("expected an expression")

    # -- declarations and statements
    def function(self, named: bool, optional: bool = False):
        self.expect("f", "expected function")
        self.accept("*")
        if self.peek() in NAMES:
            self.p += 1
        elif named:
            self.fail("expected a function name")
        self.signature("optional" if optional else "needed")

    def class_(self, named: bool):
        self.expect("C", "expected class")
        if self.peek() in NAMES and not (self.ts and self.peek() == "ö"):
            self.p += 1
        elif named:
            self.fail("expected a class name")
        if self.ts and self.peek() == "<":
            self.type_parameters()
        if self.accept("E"):
            self.postfix_no_object()
            if self.ts and self.peek() == "<":
                self.type_arguments()
        if self.ts and self.accept("ö"):
            self.type_operand()
            while self.accept(","):
                self.type_operand()
        self.group("{", "class", "expected a class body")

    def postfix_no_object(self):
        self.suffixes(self.primary(), True)

    def statements(self):
        while self.peek() != "\0":
            if self.problems is None:
                self.statement()
                if self.p > self.end:
                    self.fail("unexpected end")
            else:
                self.step()

    def step(self):
        """One statement where all errors are wanted: its error is kept and reading goes on behind it."""
        begin = self.p
        try:
            self.statement()
            if self.p > self.end:
                self.fail("unexpected end")
        except SyntaxProblem as e:
            self.problems.append((e.what, self.place(e.at)))
            self.recover(begin, e.at, ";\n", True)

    def recover(self, begin: int, at: int, stops: str, block: bool = False, case: bool = False):
        """Panic mode: goes on after the next of ``stops`` or block, or before the next case. Groups on the way are looked into."""
        s, p = self.s, min(max(begin, at), self.end)
        if "\n" in stops and begin < p < self.end and s[p - 1] == "\n" and s[p] in _STARTS:
            self.p = p
            return
        while s[p] not in stops and s[p] != "\0" and not (case and p > begin and s[p] in "kd"):
            if s[p] >= "\U00020000":
                self.pass_over(s[p])
                if block and self.is_group(s[p], "{"):
                    break
            p += 1
        self.p = p + (s[p] != "\0" and not (case and p > begin))

    def variables(self, constant: bool):
        while True:
            pattern = self.peek() >= "\U00020000"
            self.binding()
            if self.peek() == "=":
                self.initializer()
            elif (pattern or constant) and not self.ambient:
                self.fail("expected a value")
            if not self.accept(","):
                break
        self.end_of_statement()

    ambient = False

    def statement(self):
        c = self.peek()
        if c >= "\U00020000":
            if self.g.kind[ord(c) - BASE] == "{":
                self.group("{", "block", "")
                return
            self.expression()
            self.end_of_statement()
            return
        f = _STATEMENTS.get(c)
        if f is None or not f(self):
            if c in NAMES and self.after() == ":" and c != "j":
                self.p = self.s.index(":", self.p) + 1
                self.statement()
                return
            self.expression()
            self.end_of_statement()

    def s_empty(self) -> bool:
        self.p += 1
        return True

    def s_var(self) -> bool:
        constant = self.peek() == "c"
        if self.s[self.p] == "l" and not (self.after() in NAMES or self.after() >= "\U00020000"):
            return False
        if constant and self.ts and self.after() == "M":
            self.p += 1
            return self.s_enum()
        self.p += 1
        self.variables(constant)
        return True

    def s_function(self) -> bool:
        self.function(True, True)
        return True

    def s_async(self) -> bool:
        if self.s[self.p + 1] != "f":
            return False
        self.p += 1
        self.function(True, True)
        return True

    def s_class(self) -> bool:
        while self.peek() == "@":
            self.decorator()
        if self.peek() == "X":
            return self.s_export()
        if self.ts and self.peek() == "ã":
            self.p += 1
        self.class_(True)
        return True

    def s_if(self) -> bool:
        self.p += 1
        self.group("(", "paren", "expected a condition")
        self.statement()
        p = self.p
        if self.accept("e"):
            self.statement()
        else:
            self.p = p
        return True

    def s_for(self) -> bool:
        self.p += 1
        self.accept("a")
        self.group("(", "for", "expected a loop head")
        self.statement()
        return True

    def s_while(self) -> bool:
        self.p += 1
        self.group("(", "paren", "expected a condition")
        self.statement()
        return True

    def s_do(self) -> bool:
        self.p += 1
        self.statement()
        self.expect("W", "expected while")
        self.group("(", "paren", "expected a condition")
        self.accept(";")
        return True

    def s_switch(self) -> bool:
        self.p += 1
        self.group("(", "paren", "expected a value")
        self.group("{", "switch", "expected cases")
        return True

    def s_jump(self) -> bool:
        self.p += 1
        if self.s[self.p] in NAMES:
            self.p += 1
        self.end_of_statement()
        return True

    def s_return(self) -> bool:
        self.p += 1
        if self.s[self.p] not in ";\n\0":
            self.expression()
        self.end_of_statement()
        return True

    def s_throw(self) -> bool:
        self.p += 1
        if self.s[self.p] == "\n":
            self.fail("expected a value")
        self.expression()
        self.end_of_statement()
        return True

    def s_try(self) -> bool:
        self.p += 1
        self.group("{", "block", "expected a block")
        handled = False
        if self.accept("K"):
            handled = True
            if self.is_group(self.peek(), "("):
                self.group("(", "catch", "")
            self.group("{", "block", "expected a block")
        if self.accept("Y"):
            handled = True
            self.group("{", "block", "expected a block")
        if not handled:
            self.fail("try without catch")
        return True

    def s_import(self) -> bool:
        n = self.after()
        if n == "." or self.is_group(n, "("):
            return False
        self.p += 1
        if self.ts and self.peek() == "ê" and (self.after() in NAMES.replace("ñ", "") or self.after() in "*" or self.is_group(self.after(), "{")):
            self.p += 1
        if not self.accept("s"):
            if self.peek() in NAMES:
                self.p += 1
                if self.ts and self.accept("="):
                    self.expression()
                    self.end_of_statement()
                    return True
                if self.accept(","):
                    self.clause()
            else:
                self.clause()
            self.expect("ñ", "expected from")
            self.expect("s", "expected a module name")
        self.attributes()
        self.end_of_statement()
        return True

    def clause(self):
        if self.accept("*"):
            self.expect("â", "expected as")
            if self.peek() not in NAMES:
                self.fail("expected a name")
            self.p += 1
        else:
            self.group("{", "names", "expected names")

    def attributes(self):
        if self.peek() == "Q" and self.is_group(self.after(), "{"):
            self.p += 1
            self.group("{", "object", "")

    def s_export(self) -> bool:
        self.p += 1
        c = self.peek()
        if c == "d":
            self.p += 1
            c = self.peek()
            if c == "f" or (c == "á" and self.s[self.p + 1] == "f"):
                if c == "á":
                    self.p += 1
                self.function(False, True)
            elif c in "C@" or (self.ts and c == "ã"):
                if c == "ã":
                    self.p += 1
                while self.peek() == "@":
                    self.decorator()
                self.class_(False)
            elif self.ts and c == "î" and self.after() in NAMES:
                self.statement()
            else:
                self.assignment()
                self.end_of_statement()
        elif c == "*":
            self.p += 1
            if self.accept("â"):
                self.p += 1
            self.expect("ñ", "expected from")
            self.expect("s", "expected a module name")
            self.attributes()
            self.end_of_statement()
        elif self.is_group(c, "{") or (self.ts and c == "ê" and self.is_group(self.after(), "{")):
            self.accept("ê")
            self.group("{", "names", "")
            if self.accept("ñ"):
                self.expect("s", "expected a module name")
                self.attributes()
            self.end_of_statement()
        elif self.ts and c == "=":
            self.p += 1
            self.expression()
            self.end_of_statement()
        elif self.ts and c == "â":
            self.p += 3
            self.end_of_statement()
        elif c in "vclfCá@" or (self.ts and c in "îêMôûãm"):
            before = self.p
            self.statement()
            if self.s[before] in "i":
                self.fail("expected a declaration")
        else:
            self.fail("expected a declaration")
        return True

    def s_interface(self) -> bool:
        if not self.ts or self.after() not in NAMES:
            return False
        self.p += 1
        self.peek()
        self.p += 1
        if self.peek() == "<":
            self.type_parameters()
        if self.accept("E"):
            self.type_operand()
            while self.accept(","):
                self.type_operand()
        self.group("{", "members", "expected members")
        return True

    def s_type(self) -> bool:
        if not self.ts or self.after() not in NAMES or self.s[self.p + 1] == "\n":
            return False
        self.p += 2
        if self.peek() == "<":
            self.type_parameters()
        self.expect("=", "expected =")
        self.type()
        self.end_of_statement()
        return True

    def s_enum(self) -> bool:
        self.p = self.p if self.peek() == "M" else self.p
        if not self.ts:
            self.fail("enum outside TypeScript")
        self.expect("M", "expected enum")
        if self.peek() not in NAMES:
            self.fail("expected a name")
        self.p += 1
        self.group("{", "enum", "expected members")
        return True

    def s_declare(self) -> bool:
        if not self.ts or self.after() not in "vclfCMîêûãýá":
            return False
        self.p += 1
        self.ambient = True
        try:
            self.statement()
        finally:
            self.ambient = False
        return True

    def s_namespace(self) -> bool:
        if not self.ts or self.after() not in NAMES + "s":
            return False
        self.p += 1
        self.peek()
        self.p += 1
        while self.accept("."):
            self.p += 1
        if self.is_group(self.peek(), "{"):
            self.group("{", "block", "")
        else:
            self.end_of_statement()
        return True

    def s_global(self) -> bool:
        if not self.ts or not self.is_group(self.after(), "{"):
            return False
        self.p += 1
        self.group("{", "block", "")
        return True

    def s_abstract(self) -> bool:
        if not self.ts or self.after() != "C":
            return False
        self.p += 1
        self.class_(True)
        return True

    def s_bad(self) -> bool:
        self.fail("unexpected word")


_STATEMENTS = {
    ";": Parser.s_empty, "v": Parser.s_var, "l": Parser.s_var, "c": Parser.s_var, "f": Parser.s_function, "á": Parser.s_async, "C": Parser.s_class, "@": Parser.s_class,
    "I": Parser.s_if, "F": Parser.s_for, "W": Parser.s_while, "D": Parser.s_do, "S": Parser.s_switch, "b": Parser.s_jump, "q": Parser.s_jump, "r": Parser.s_return,
    "h": Parser.s_throw, "y": Parser.s_try, "m": Parser.s_import, "X": Parser.s_export, "î": Parser.s_interface, "ê": Parser.s_type, "M": Parser.s_enum,
    "ô": Parser.s_declare, "û": Parser.s_namespace, "ý": Parser.s_global, "ã": Parser.s_abstract, "g": Parser.s_jump, "e": Parser.s_bad, "k": Parser.s_bad,
    "K": Parser.s_bad, "Y": Parser.s_bad, "E": Parser.s_bad,
}


# where panic mode goes on in a group, by role; the rest of what has one member alone is only looked into
_NEXT_MEMBER = dict.fromkeys(("args", "array", "object", "params", "names", "enum", "tuple", "pattern_array", "pattern_object"), ",") | {"class": ";\n", "members": ";,\n"}
_READINGS = {"(": ("args", "params", "for", "type"), "[": ("array", "pattern_array", "index", "tuple"), "{": ("block", "object", "class", "switch", "pattern_object", "names", "members", "enum"), "\x01": ("paren", "markup", "type")}
_TYPED_ROLES = {"type", "tuple", "members", "enum"}
# words that no expression goes on with
_STARTS = "vcIFWDSbqrhyXg"


# ---- the two passes -----------------------------------------------------------------------------------------------

# Which extensions have markup and which have types.
MARKUP = {"tsx", "jsx"}
TYPED = {"ts", "tsx", "mts", "cts"}
EXTENSIONS = ("ts", "tsx", "js", "jsx", "mts", "cts")

_SHARED = Groups()


def _clean(text: str) -> str:
    if text.startswith("﻿"):
        text = text[1:]
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if text.startswith("#!"):
        text = "//" + text[2:]
    return text


def _deep(work, size: int):
    """``work()`` in a thread whose stack and recursion limit are enough for whatever a text of this size can nest."""
    got: list = []

    def run() -> None:
        limit = sys.getrecursionlimit()
        sys.setrecursionlimit(max(limit, 10_000 + 32 * size))
        try:
            got.append((work(), None))
        except BaseException as e:  # raised again by the caller
            got.append((None, e))
        finally:
            sys.setrecursionlimit(limit)

    before = threading.stack_size(512 << 20)
    try:
        t = threading.Thread(target=run)
        t.start()
    finally:
        threading.stack_size(before)
    t.join()
    result, error = got[0]
    if error is not None:
        raise error
    return result


def accepts(text: str, extension: str) -> bool:
    """Whether ``text`` is valid for a file of this extension, however deeply it nests."""
    global _SHARED
    if len(_SHARED.kind) > MOST_GROUPS:
        _SHARED = Groups()
    try:
        return _accepts(text, extension, _SHARED)
    except RecursionError:
        _SHARED = Groups()
        return _deep(lambda: _accepts(text, extension, Groups()), len(text))


def _accepts(text: str, extension: str, groups: Groups) -> bool:
    try:
        s = fold(classes(_clean(text), extension in MARKUP), groups)
        if BAD in s:
            return False
        p = Parser(s, groups, extension in TYPED, extension in MARKUP)
        p.statements()
        return True
    except SyntaxProblem:
        return False


def problems(text: str, extension: str) -> list[tuple[str, int]]:
    """All errors of a text, as (what, line from 1), by line; empty for a valid one."""
    return [(what, line) for line, _, what in errors(text, extension)]


def errors(text: str, extension: str) -> list[tuple[int, int, str]]:
    """All errors of a text, as (line, column, what) in this order, from 1; empty for a valid one."""
    try:
        return _problems(text, extension)
    except RecursionError:
        return _deep(lambda: _problems(text, extension), len(text))


def _problems(text: str, extension: str) -> list[tuple[int, int, str]]:
    text = _clean(text)
    jsx = extension in MARKUP
    out: list[tuple[str, int]] = []
    found: list[tuple[str, int]] = []
    try:
        _lex(text, 0, len(text), out, jsx and ("</" in text or "/>" in text), found=found)
    except SyntaxProblem as e:
        found.append((e.what, e.at))
    # build the groups with positions; a bracket that does not match is an error and closes what it can
    groups = Groups()
    stack: list[tuple[str, list[str], list[int], int]] = [("", [], [], 0)]
    for c, at in out:
        if c in OPENERS and c:
            stack.append((c, [], [], at))
        elif c and c in ")]}\x02":
            if len(stack) > 1 and OPENERS[stack[-1][0]] == c:
                kind, chars, where, begin = stack.pop()
                stack[-1][1].append(groups.place(kind, "".join(chars), [*where, at]))
                stack[-1][2].append(begin)
            elif any(OPENERS.get(x[0]) == c for x in stack):
                while OPENERS[stack[-1][0]] != c:
                    kind, chars, where, begin = stack.pop()
                    found.append((_UNCLOSED_BRACE if kind == "\x01" else f"unclosed {kind}", begin))
                    stack[-1][1].append(groups.place(kind, "".join(chars), [*where, at]))
                    stack[-1][2].append(begin)
                kind, chars, where, begin = stack.pop()
                stack[-1][1].append(groups.place(kind, "".join(chars), [*where, at]))
                stack[-1][2].append(begin)
            else:
                found.append((f"stray {c}".replace("\x02", "}"), at))
        else:
            for x in c:
                stack[-1][1].append(x)
                stack[-1][2].append(at)
    while len(stack) > 1:
        kind, chars, where, begin = stack.pop()
        found.append((_UNCLOSED_BRACE if kind == "\x01" else f"unclosed {kind}", begin))
        stack[-1][1].append(groups.place(kind, "".join(chars), [*where, len(text)]))
        stack[-1][2].append(begin)
    _, chars, where, _ = stack[0]
    p = Parser("".join(chars), groups, extension in TYPED, jsx, found, [*where, len(text)])
    p.statements()
    breaks = [m.start() for m in re.finditer("\n", text)]
    result = set()
    for what, at in found:
        line = bisect.bisect_left(breaks, max(at, 0))
        result.add((line + 1, max(at, 0) - (breaks[line - 1] if line else -1), what))
    return sorted(result)
