"""Token streams for the grammars: kinds, whether a newline came before, and where each token begins. A text that can't be cut into tokens raises Bad."""

from __future__ import annotations

import re

from tessera.llm import grammars as G


class Bad(Exception):
    def __init__(self, at: int, what: str):
        super().__init__(what)
        self.at, self.what = at, what


def _run(text: str, master: re.Pattern, words: set[str], upper: bool = False):
    """Tokens by one pattern with a named group for each kind; groups that begin with _ are skipped, those with bad_ raise."""
    kinds: list[str] = []
    newline: list[bool] = []
    starts: list[int] = []
    at, nl, n = 0, True, len(text)
    while at < n:
        m = master.match(text, at)
        if m is None or m.end() == at:
            raise Bad(at, "no token begins here")
        k = m.lastgroup
        if k[0] == "_":
            if "\n" in m.group():
                nl = True
        elif k[:3] == "bad":
            raise Bad(at, "not closed")
        else:
            if k == "NAME":
                w = m.group().upper() if upper else m.group()
                kinds.append(w if w in words else ("NAME", w))
            else:
                kinds.append(m.group() if k == "OP" else k)
            newline.append(nl)
            starts.append(at)
            nl = False
        at = m.end()
    kinds.append("EOF")
    newline.append(True)
    starts.append(n)
    return kinds, newline, starts


_ID = r"[^\W\d]\w*"


_OPEN = re.compile(r"([a-zA-Z]{0,2})(\'\'\'|\"\"\"|\'|\")")


def _string_end(t: str, at: int, prefix: str, quote: str, out: list | None = None) -> int:
    """Where the string ends whose text begins at ``at``; -1 if it doesn't, or if its replacement fields are broken. out: gets the places of the fields' expressions."""
    n, fields, raw, long = len(t), bool(set(prefix.lower()) & set("ft")), "r" in prefix.lower(), len(quote) == 3
    while at < n:
        c = t[at]
        if t.startswith(quote, at):
            return at + len(quote)
        if c == "\\":
            at += 2
            if raw and fields and t[at - 1 : at] in "{}":
                at -= 1
        elif c in "\n" and not long:
            return -1
        elif fields and c in "{}":
            if t[at : at + 2] == c * 2:
                at += 2
            elif c == "}" or (at := _field_end(t, at + 1, quote, long, out)) < 0:
                return -1
        else:
            at += 1
    return -1


def _field_end(t: str, at: int, quote: str, long: bool, out: list | None) -> int:
    """Past the closing brace of a replacement field whose expression begins at ``at``."""
    n, depth, empty, begin, end = len(t), [], True, at, -1
    while at < n:
        c = t[at]
        m = _OPEN.match(t, at) if c.isalpha() or c in "\"'" else None
        if m and (at == 0 or not (t[at - 1].isalnum() or t[at - 1] == "_")):
            at = _string_end(t, m.end(), m[1], m[2])
            if at < 0:
                return -1
            empty = False
            continue
        if c in "([{":
            depth.append(c)
        elif c in ")]" or c == "}" and depth:
            if not depth or "([{".index(depth.pop()) != ")]}".index(c):
                return -1
        elif c == "}":
            if out is not None:
                out.append((begin, at if end < 0 else end))
            return -1 if empty else at + 1
        elif c == "!" and not depth and t[at + 1 : at + 2] != "=":
            end = at
            at += 2  # the conversion's letter
            empty = False
            continue
        elif c == ":" and not depth and not empty:
            if out is not None:
                out.append((begin, at if end < 0 else end))
            at += 1
            while at < n:  # the format: plain text with fields of its own
                if t[at] == "}":
                    return at + 1
                if t[at] == "{":
                    at = _field_end(t, at + 1, quote, long, out)
                    if at < 0:
                        return -1
                elif t.startswith(quote, at) or t[at] == "\n" and not long:
                    return -1
                else:
                    at += 1
            return -1
        elif c in "'\"\\" and not m:
            return -1
        if not c.isspace():
            empty = False
        at += 1
    return -1


_PY = re.compile(
    r"(?P<_ws>[ \t\f]+|\\\r?\n)|(?P<_comment>\#[^\n]*)|(?P<NEWLINE>\r?\n|\r)"
    r"|(?P<STR>(?:[rRbBuUfFtT]{1,2})?(?:'''(?:\\[\s\S]|[^\\])*?'''|\"\"\"(?:\\[\s\S]|[^\\])*?\"\"\"|'(?!'')(?:\\[\s\S]|[^\\\n'])*'|\"(?!\"\")(?:\\[\s\S]|[^\\\n\"])*\"))"
    r"|(?P<bad_str>['\"])"
    r"|(?P<NUM>0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)"
    rf"|(?P<NAME>{_ID})"
    r"|(?P<AUG>\*\*=|//=|>>=|<<=|[-+*/%@&|^]=)|(?P<OP>\.\.\.|:=|->|\*\*|//|<<|>>|<=|>=|==|!=|[-+*/%@&|^~<>()\[\]{},:;.=])"
)
_PY_BINARY = {"//", "%", "<<", ">>", "<=", ">=", "==", "!=", "<", ">", "&", "|", "^"}


def python(text: str):
    kinds: list = []
    starts: list[int] = []
    stack, depth, at, n = [0], [], 0, len(text)
    if text.startswith("﻿"):
        at = 1
    fresh = True
    while at < n or fresh:
        if fresh and not depth:
            m = re.compile(r"[ \t\f]*").match(text, at)
            rest = m.end()
            if rest >= n:
                at = n
                break
            if text[rest] in "#\r\n":
                m2 = re.compile(r"(?:#[^\n\r]*)?(?:\r?\n|\r|$)").match(text, rest)
                at = m2.end()
                if at >= n:
                    break
                continue
            col = 0
            for c in m.group():
                col = col + 1 if c == " " else (col // 8 + 1) * 8 if c == "\t" else 0
            if col > stack[-1]:
                stack.append(col)
                kinds.append("IND")
                starts.append(rest)
            while col < stack[-1]:
                stack.pop()
                kinds.append("DED")
                starts.append(rest)
            if col != stack[-1]:
                raise Bad(rest, "this depth matches no outer one")
            at, fresh = rest, False
        m = _OPEN.match(text, at) if text[at] in "fFtTrRbB" else None
        if m and set(m[1].lower()) & set("ft"):
            if m[1].lower() not in ("f", "t", "fr", "rf", "tr", "rt"):
                raise Bad(at, "no such prefix")
            fields: list[tuple[int, int]] = []
            end = _string_end(text, m.end(), m[1], m[2], fields)
            if end < 0:
                raise Bad(at, "not closed")
            kinds.append("FHEAD")
            starts.append(at)
            for a, b in fields:
                try:
                    inner, _, places = python(f"({text[a:b]}\n)")
                except Bad as e:
                    raise Bad(a + max(0, e.at - 1), e.what) from None
                kinds += ["FOPEN", *inner[1:-3], "FCLOSE"]  # without the brackets and the end
                starts += [a, *(a + x - 1 for x in places[1:-3]), b]
            kinds.append("FTAIL")
            starts.append(end)
            at = end
            continue
        m = _PY.match(text, at)
        if m is None:
            raise Bad(at, "no token begins here")
        k = m.lastgroup
        if k[:3] == "bad":
            raise Bad(at, "not closed")
        if k == "NEWLINE":
            if not depth:
                kinds.append("NL")
                starts.append(at)
                fresh = True
        elif k[0] != "_":
            s = m.group()
            if k == "OP":
                if s in "([{":
                    depth.append(s)
                elif s in ")]}":
                    if not depth or "([{".index(depth.pop()) != ")]}".index(s):
                        raise Bad(at, "closes nothing")
                kinds.append("OP" if s in _PY_BINARY else s)
            elif k == "NAME":
                kinds.append(s if s in G.PYTHON_WORDS else ("NAME", s))
            elif k == "STR":
                p = re.match(r"[a-zA-Z]*", s).group().lower()
                if p and p not in ("r", "b", "u", "f", "t", "br", "rb", "fr", "rf", "tr", "rt"):
                    raise Bad(at, "no such prefix")
                kinds.append("STR")
            else:
                if k == "NUM" and (re.match(r"0\d", s) and s.strip("0_") and s.isdigit() or re.match(r"\w", text[m.end() : m.end() + 1] or " ") and not re.match(r"(?:if|or|and|in|is|else|for|not)\b", text[m.end() :])):
                    raise Bad(at, "no number")
                kinds.append(k)
            starts.append(at)
        at = m.end()
    if depth:
        raise Bad(n, "not closed")
    if kinds and kinds[-1] != "NL":
        kinds.append("NL")
        starts.append(n)
    kinds += ["DED"] * (len(stack) - 1) + ["EOF"]
    starts += [n] * len(stack)
    return kinds, None, starts


_JS_NUM = r"0[xX][\da-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?"
_JS = re.compile(
    r"(?P<_ws>[\s﻿]+)|(?P<_c1>//[^\n]*)|(?P<_c2>/\*[\s\S]*?\*/)|(?P<bad_c>/\*)"
    r"|(?P<STR>'(?:\\(?:\r\n|[\s\S])|[^\\\n'])*'|\"(?:\\(?:\r\n|[\s\S])|[^\\\n\"])*\")|(?P<bad_s>['\"])"
    rf"|(?P<NUM>{_JS_NUM})(?![\w$])|(?P<bad_n>\d)|(?P<PRIVATE>\#[^\W\d][\w$]*)|(?P<NAME>(?:[^\W\d]|\$)[\w$]*)"
    r"|(?P<ASSIGN>\*\*=|<<=|&&=|\|\|=|\?\?=|[-+*%&|^]=(?!=))|(?P<INC>\+\+|--)|(?P<BINOP>===|!==|==|!=|<=|<<|&&|\|\||\?\?|\*\*|%|\^)"
    r"|(?P<OP>=>|\.\.\.|\?\.(?!\d)|[-+*&|!~?:=,.;<>()\[\]{}@])"
)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-zA-Z]*")
_TEMPLATE = re.compile(r"(?:\\[\s\S]|\$(?!\{)|[^\\`$])*")


def script(text: str):
    """JavaScript and TypeScript: knows by the token before whether / begins a pattern, and cuts template strings at their parts."""
    kinds: list = []
    newline: list[bool] = []
    starts: list[int] = []
    at, nl, n = 0, True, len(text)
    braces: list[bool] = []  # whether a brace belongs to a template
    parens: list[bool] = []

    def add(k, a):
        nonlocal nl
        kinds.append(k)
        newline.append(nl)
        starts.append(a)
        nl = False

    def piece(a: int, head: bool) -> int:
        m = _TEMPLATE.match(text, a + 1)
        e = m.end()
        if e >= n:
            raise Bad(a, "not closed")
        if text[e] == "`":
            add("TPL" if head else "TTAIL", a)
            return e + 1
        add("THEAD" if head else "TMID", a)
        braces.append(True)
        return e + 2

    if text.startswith("#!"):
        add("HASHBANG", 0)
        at = len(text.split("\n", 1)[0])
    value = False  # whether the token before ends a value
    while at < n:
        c = text[at]
        if c == "`":
            at = piece(at, True)
            value = kinds[-1] == "TPL"
            continue
        if c == "}" and braces and braces[-1]:
            braces.pop()
            at = piece(at, False)
            value = kinds[-1] == "TTAIL"
            continue
        if c == "/" and text[at + 1 : at + 2] not in ("/", "*"):
            m = None if value else _REGEX.match(text, at)
            if m:
                add("REGEX", at)
                value = True
                at = m.end()
            elif text[at + 1 : at + 2] == "=":
                add("ASSIGN", at)
                value = False
                at += 2
            else:
                add("/", at)
                value = False
                at += 1
            continue
        m = _JS.match(text, at)
        if m is None:
            raise Bad(at, "no token begins here")
        k = m.lastgroup
        if k[:3] == "bad":
            raise Bad(at, "not closed")
        s = m.group()
        if k[0] == "_":
            nl = nl or "\n" in s
        else:
            if k == "OP":
                if s == "{":
                    braces.append(False)
                elif s == "}":
                    if not braces:
                        raise Bad(at, "closes nothing")
                    braces.pop()
                elif s == "(":
                    parens.append(bool(kinds) and kinds[-1] in ("if", "while", "for", "with"))
                elif s == ")":
                    head = parens.pop() if parens else False
                value = s in ")]}" and not (s == ")" and head)
                add(s, at)
            elif k == "NAME":
                word = s in G.JS_WORDS
                add(s if word else ("NAME", s), at)
                value = not word or s in ("this", "super", "null", "true", "false")
                if s in ("of", "yield", "await"):
                    value = False
            else:
                add(k, at)
                value = k in ("STR", "NUM", "PRIVATE") or k == "INC" and value
        at = m.end()
    if braces:
        raise Bad(n, "not closed")
    nl = True
    add("EOF", n)
    return kinds, newline, starts


_C_NUM = r"0[xX][\da-fA-F_]+(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?[lLfFdDuUmM]*|0[bB][01_]+[lLuU]*|(?:\d[\d_]*(?:\.(?!\.)(?:\d[\d_]*)?)?|\.\d[\d_]*)(?:[eE][+-]?[\d_]+)?[lLfFdDuUmM]*"
_JAVA = re.compile(
    r"(?P<_ws>[\s\x1a]+)|(?P<_c1>//[^\n\r]*)|(?P<_c2>/\*[\s\S]*?\*/)|(?P<bad_c>/\*)"
    r"|(?P<STR>\"\"\"[ \t\f]*\r?\n(?:\\[\s\S]|[^\\])*?\"\"\"|\"(?:\\.|[^\\\n\"])*\")|(?P<CHAR>'(?:\\u+[0-9a-fA-F]{4}|\\[0-7]{1,3}|\\.|[^\\\n'])')|(?P<bad_s>['\"])"
    rf"|(?P<NUM>{_C_NUM})(?![\w])|(?P<bad_n>\d)|(?P<NAME>(?:[^\W\d]|\$)[\w$]*)"
    r"|(?P<ASSIGN><<=|[-+*/%&|^]=)|(?P<INC>\+\+|--)|(?P<BINOP>==|!=|<<)|(?P<OP>->|::|\.\.\.|&&|\|\||[-+*/%&|^!~?:=,.;<>()\[\]{}@])"
)

_GO = re.compile(
    r"(?P<_ws>[ \t\r﻿]+)|(?P<NEWLINE>\n)|(?P<COMMENT>//[^\n]*)|(?P<BLOCK>/\*[\s\S]*?\*/)|(?P<bad_c>/\*)"
    r"|(?P<STR>`[^`]*`|\"(?:\\.|[^\\\n\"])*\")|(?P<CHAR>'(?:\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\U[0-9a-fA-F]{8}|\\[0-7]{3}|\\.|[^\\\n'])')|(?P<bad_s>['\"`])"
    r"|(?P<NUM>0[xX][\da-fA-F_]+(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?i?|0[bB][01_]+i?|0[oO][0-7_]+i?|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?i?)(?!\w)|(?P<bad_n>\d)"
    rf"|(?P<NAME>{_ID})"
    r"|(?P<ASSIGN><<=|>>=|&\^=|[-+*/%&|^]=)|(?P<INC>\+\+|--)|(?P<WORD><-|:=|\.\.\.|[-+*&^!~|=,.;:()\[\]{}](?!=)|[=](?!=)|[*&|:,.;()\[\]{}!^+~-](?==)?)"
)
_GO_OPS = re.compile(r"&&|\|\||==|!=|<=|>=|<<|>>|&\^|[/%<>^+\-&]")


def go(text: str):
    kinds: list = []
    starts: list[int] = []
    at, n = 0, len(text)

    def ends() -> bool:
        k = kinds[-1] if kinds else ";"
        return isinstance(k, tuple) or k in ("NUM", "STR", "CHAR", "INC", ")", "]", "}", "break", "continue", "fallthrough", "return")

    while at < n:
        m = _GO_OPS.match(text, at) if text[at] in "&|=!<>/%^+-" and text[at : at + 2] not in ("//", "/*", "<-", "++", "--") else None
        if m and not (m.group() not in ("==", "!=", "<=", ">=") and text[m.end() : m.end() + 1] == "=" and text[m.end() : m.end() + 2] != "==") and m.group() not in ("+", "-", "^", "&"):
            kinds.append("OP")
            starts.append(at)
            at = m.end()
            continue
        m = _GO.match(text, at)
        if m is None:
            raise Bad(at, "no token begins here")
        k, s = m.lastgroup, m.group()
        if k[:3] == "bad":
            raise Bad(at, "not closed")
        if k == "NEWLINE" or k == "BLOCK" and "\n" in s:
            if ends():
                kinds.append(";")
                starts.append(at)
        elif k in ("_ws", "COMMENT", "BLOCK"):
            pass
        else:
            kinds.append((s if s in G.GO_WORDS else ("NAME", s)) if k == "NAME" else s if k == "WORD" else k)
            starts.append(at)
        at = m.end()
    if ends():
        kinds.append(";")
        starts.append(n)
    kinds.append("EOF")
    starts.append(n)
    return kinds, None, starts


_RUST = re.compile(
    r"(?P<_ws>[\s﻿]+)|(?P<_c1>//[^\n]*)|(?P<BLOCK>/\*)"
    r"|(?P<RAW>(?:b|c)?r(?P<h>\#*)\"[\s\S]*?\"(?P=h))|(?P<STR>[bc]?\"(?:\\[\s\S]|[^\\\"])*\")|(?P<CHAR>b?'(?:\\x[0-9a-fA-F]{2}|\\u\{[0-9a-fA-F_]+\}|\\.|[^\\\n'])')|(?P<LIFE>'(?:[^\W\d]\w*))(?!')|(?P<bad_s>[\"'])"
    r"|(?P<NUM>0x[\da-fA-F_]+(?:[iu](?:8|16|32|64|128|size))?|0b[01_]+(?:[iu]\w+)?|0o[0-7_]+(?:[iu]\w+)?|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?(?:_?(?:[iu](?:8|16|32|64|128|size)|f32|f64))?)(?!\w)|(?P<bad_n>\d)"
    rf"|(?P<NAME>(?:r\#)?{_ID})"
    r"|(?P<ASSIGN><<=|>>=|[-+*/%^|&]=(?!=))|(?P<OP2>==|!=|%|\^|/)|(?P<OP>\.\.=|\.\.\.|\.\.|::|->|=>|&&|\|\||[-+*&|!~?:=,.;<>()\[\]{}@#$])"
)


def rust(text: str):
    kinds: list = []
    starts: list[int] = []
    at, n = 0, len(text)
    if text.startswith("#!") and not text.startswith("#!["):
        at = len(text.split("\n", 1)[0])
    while at < n:
        m = _RUST.match(text, at)
        if m is None:
            raise Bad(at, "no token begins here")
        k, s = m.lastgroup, m.group()
        if k == "h":
            k = "RAW"
        if k[:3] == "bad":
            raise Bad(at, "not closed")
        if k == "BLOCK":
            depth, i = 1, at + 2
            for x in re.finditer(r"/\*|\*/", text[at + 2 :]):
                depth += 1 if x.group() == "/*" else -1
                if not depth:
                    i = at + 2 + x.end()
                    break
            if depth:
                raise Bad(at, "not closed")
            at = i
            continue
        if k[0] != "_":
            if k == "NAME":
                kinds.append("_" if s == "_" else s if s in G.RUST_WORDS else ("NAME", s))
            else:
                kinds.append("STR" if k == "RAW" else "OP" if k == "OP2" else s if k == "OP" else k)
            starts.append(at)
        at = m.end()
    kinds.append("EOF")
    starts.append(n)
    return kinds, None, starts


_CS = re.compile(
    r"(?P<_ws>[\s﻿]+)|(?P<_c1>//[^\n]*)|(?P<_c2>/\*[\s\S]*?\*/)|(?P<bad_c>/\*)|(?P<_pre>\#[^\n]*)"
    r"|(?P<RAW>\$*\"\"\"+)|(?P<VERB>(?:@\$?|\$@)\"(?:\"\"|[^\"])*\"(?:u8)?)|(?P<INTER>\$\")|(?P<STR>\"(?:\\.|[^\\\n\"])*\"(?:u8)?)|(?P<CHAR>'(?:\\x[0-9a-fA-F]{1,4}|\\u[0-9a-fA-F]{4}|\\U[0-9a-fA-F]{8}|\\.|[^\\\n'])')|(?P<bad_s>[\"'])"
    r"|(?P<NUM>0[xX][\da-fA-F_]+[uUlL]*|0[bB][01_]+[uUlL]*|(?:\d[\d_]*(?:\.\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?[fFdDmMuUlL]*)(?!\w)|(?P<bad_n>\d)"
    rf"|(?P<NAME>@?{_ID})"
    r"|(?P<ASSIGN><<=|[-+*/%&|^]=)|(?P<INC>\+\+|--)|(?P<OP2>!=)|(?P<OP>=>|==|->|::|\?\?=|\?\?|\.\.|&&|\|\||[-+*/%&|^!~?:=,.;<>()\[\]{}])"
)


def csharp(text: str):
    kinds: list = []
    starts: list[int] = []
    at, n = 0, len(text)
    while at < n:
        m = _CS.match(text, at)
        if m is None:
            raise Bad(at, "no token begins here")
        k, s = m.lastgroup, m.group()
        end = m.end()
        if k[:3] == "bad":
            raise Bad(at, "not closed")
        if k == "RAW":
            q = s.lstrip("$")
            e = text.find(q, end)
            if e < 0:
                raise Bad(at, "not closed")
            end = e + len(q)
            while text[end : end + 1] == '"':
                end += 1
        elif k == "INTER":
            depth, i = 0, end
            while i < n:
                c = text[i]
                if depth == 0 and c == "\\":
                    i += 2
                    continue
                if depth == 0 and c in "{}" and text[i : i + 2] == c * 2:
                    i += 2
                    continue
                if c == "{":
                    depth += 1
                elif c == "}":
                    depth -= 1
                    if depth < 0:
                        raise Bad(i, "braces of the string don't pair")
                elif c == '"':
                    if depth == 0:
                        break
                    i = text.find('"', i + 1)
                    if i < 0:
                        raise Bad(at, "not closed")
                elif c == "\n":
                    raise Bad(at, "not closed")
                i += 1
            if i >= n:
                raise Bad(at, "not closed")
            end = i + 1
        if k == "_pre":
            if text[:at].rpartition("\n")[2].strip():
                raise Bad(at, "no token begins here")
        elif k[0] != "_":
            if k == "NAME":
                kinds.append(s if s in G.CSHARP_WORDS else ("NAME", s.lstrip("@") if s[0] != "@" else ""))
            else:
                kinds.append("STR" if k in ("RAW", "VERB", "INTER", "STR") else "OP" if k == "OP2" else s if k == "OP" else k)
            starts.append(at)
        at = end
    kinds.append("EOF")
    starts.append(n)
    return kinds, None, starts


_SQL = re.compile(
    r"(?P<_ws>[\s﻿]+)|(?P<_c1>--[^\n]*)|(?P<_c2>/\*[\s\S]*?\*/)|(?P<bad_c>/\*)"
    r"|(?P<DOLLAR>\$(?P<tag>[A-Za-z_]*)\$[\s\S]*?\$(?P=tag)\$)|(?P<bad_d>\$[A-Za-z_]*\$)|(?P<STR>[eEnNbBxX]?'(?:''|\\'(?=[^\n]*')|[^'])*')|(?P<QNAME>\"(?:\"\"|[^\"])+\"|`[^`]+`|\[[A-Za-z_][\w ]*\])|(?P<bad_s>['\"`])"
    r"|(?P<NUM>(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)(?!\w)|(?P<bad_n>\d)|(?P<PARAM>[?]|[:@$][A-Za-z_0-9]+)"
    r"|(?P<NAME>[^\W\d][\w$]*)|(?P<OP2><>|!=|<=|>=|\|\||->>|->|#>>|#>|@>|<@|!~\*|!~|~\*|[/%<>&|^#])|(?P<OP>::|:=|=>|[-+*~=,.;:()\[\]])"
)


def _plain(master, words, upper=False, op2="OP"):
    def lex(text: str):
        kinds, newline, starts = _run(text, master, words, upper)
        return [("OP" if k == "OP2" else "STR" if k in ("DOLLAR", "tag") else k) for k in kinds], newline, starts

    return lex


java = _plain(_JAVA, G.JAVA_WORDS)
sql = _plain(_SQL, G.SQL_WORDS, upper=True)
