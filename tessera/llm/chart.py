"""A chart parser driven by tables made from grammars.

A grammar is text: rules ``name = expression``, with 'literal' tokens, TOKEN classes,
sequences, ordered choices |, groups, ? * +, lists ``x % ','`` and lookaheads & and !.
For each point of choice a table gives, by the next token, the alternatives that can
begin with it. Results of rules marked @ go into the chart, so no span is parsed twice
and the time stays near linear. The whole token stream must be consumed; of a file that
can't be, the token furthest to the right that no alternative could pass is its error.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_TOKEN = re.compile(r"\s*(?:'((?:[^'\\]|\\.)+)'|([A-Za-z_]\w*)|([()|?*+%&!=@]))")
EOF = "EOF"


@dataclass
class Node:
    kind: str
    text: str = ""
    sub: list[Node] = field(default_factory=list)
    first: frozenset[str] = frozenset()
    empty: bool = False
    made: str = ""


class Grammar:
    """Compiles a grammar. ``words``: keywords that are never names; literals that look like words and aren't in it are names, too."""

    def __init__(self, text: str, words: set[str], classes: set[str], start: str = "file", special: set[str] = frozenset()):
        self.words, self.classes, self.special = words, classes | {EOF}, special
        self.rules: dict[str, Node] = {}
        self.charted: set[str] = set()
        for line in re.sub(r"\n[ \t]+", " ", text.strip()).split("\n"):
            if not line.strip() or line.startswith("#"):
                continue
            head, _, body = line.partition("=")
            rule = head.strip()
            if rule.startswith("@"):
                rule = rule[1:]
                self.charted.add(rule)
            self.toks = [m.groups() for m in _TOKEN.finditer(body.rstrip())]
            self.at = 0
            self.rules[rule] = self._choice()
            if self.at != len(self.toks):
                raise ValueError(f"{rule}: {self.toks[self.at:]}")
        literals = {n.text for n in self._all() if n.kind == "lit"}
        self.keys = {k: i for i, k in enumerate(sorted(literals | self.classes | words))}
        self.soft = {x for x in literals if re.fullmatch(r"[A-Za-z_]\w*", x)} - words
        self._firsts()
        self._emit(start)

    # reading

    def _peek(self):
        return self.toks[self.at] if self.at < len(self.toks) else (None, None, None)

    def _choice(self) -> Node:
        alts = [self._seq()]
        while self._peek()[2] == "|":
            self.at += 1
            alts.append(self._seq())
        return alts[0] if len(alts) == 1 else Node("choice", sub=alts)

    def _seq(self) -> Node:
        out = []
        while (t := self._peek()) != (None, None, None) and t[2] not in ("|", ")"):
            out.append(self._item())
        return out[0] if len(out) == 1 else Node("seq", sub=out)

    def _item(self) -> Node:
        lit, name, op = self._peek()
        self.at += 1
        if op in ("&", "!"):
            return Node(op, sub=[self._item()])
        if op == "(":
            n = self._choice()
            if self._peek()[2] != ")":
                raise ValueError("no )")
            self.at += 1
        elif lit is not None:
            n = Node("lit", lit)
        elif name is not None:
            n = Node("special" if name in self.special else "class" if name in self.classes else "rule", name)
        else:
            raise ValueError(op)
        while (op := self._peek()[2]) in ("?", "*", "+", "%"):
            self.at += 1
            if op == "%":
                sep = self._item()
                n = Node("seq", sub=[n, Node("*", sub=[Node("seq", sub=[sep, n])])])
            elif op == "+":
                n = Node("seq", sub=[n, Node("*", sub=[n])])
            else:
                n = Node(op, sub=[n])
        return n

    def _all(self):
        todo, seen = list(self.rules.values()), set()
        while todo:
            n = todo.pop()
            if id(n) not in seen:
                seen.add(id(n))
                yield n
                todo += n.sub

    # tables

    def _class_keys(self, name: str) -> set[str]:
        return {name} | (self.soft if name == "NAME" else set())

    def _firsts(self) -> None:
        every = frozenset(self.keys)
        changed = True
        while changed:
            changed = False
            for n in self._all():
                if n.kind == "lit":
                    f, e = {n.text}, False
                elif n.kind == "class":
                    f, e = self._class_keys(n.text), False
                elif n.kind == "special":
                    f, e = every, True
                elif n.kind == "rule":
                    r = self.rules.get(n.text)
                    if r is None:
                        raise ValueError(f"no rule {n.text}")
                    f, e = r.first, r.empty
                elif n.kind == "choice":
                    f, e = frozenset().union(*(s.first for s in n.sub)), any(s.empty for s in n.sub)
                elif n.kind == "seq":
                    f, e = set(), True
                    for s in n.sub:
                        if s.kind in ("&", "!"):
                            continue
                        f |= s.first
                        if not s.empty:
                            e = False
                            break
                elif n.kind in ("?", "*"):
                    f, e = n.sub[0].first, True
                else:
                    f, e = set(), True
                f = frozenset(f)
                if f != n.first or e != n.empty:
                    n.first, n.empty, changed = f, e, True

    # code

    def _emit(self, start: str) -> None:
        lines: list[str] = ["far = 0", "K = NL = ()", "def fail(p):", " global far", " if p > far: far = p", " return -1"]
        self.space: dict = {}
        made: dict[int, str] = {}
        todo: list[tuple[str, Node, str | None]] = []
        keys = self.keys

        def name_of(n: Node) -> str:
            if n.kind == "rule":
                return "r_" + n.text
            if id(n) not in made:
                made[id(n)] = f"g{len(made)}"
                todo.append((made[id(n)], n, None))
            return made[id(n)]

        def table(n: Node) -> str:
            t = f"F{len(self.space)}"
            self.space[t] = frozenset(keys[k] for k in n.first)
            return t

        def step(n: Node, ind: str) -> list[str]:
            """Code that moves p over n or returns -1."""
            if n.kind == "lit":
                return [f"{ind}if K[p] != {keys[n.text]}: return fail(p)", f"{ind}p += 1"]
            if n.kind == "class":
                ks = sorted(keys[k] for k in self._class_keys(n.text))
                if len(ks) == 1:
                    return [f"{ind}if K[p] != {ks[0]}: return fail(p)", f"{ind}p += 1"]
                t = f"C_{n.text}"
                self.space[t] = frozenset(ks)
                return [f"{ind}if K[p] not in {t}: return fail(p)", f"{ind}p += 1"]
            if n.kind == "special":
                return [f"{ind}p = s_{n.text}(p, K, NL)", f"{ind}if p < 0: return fail(-1 - p)"]
            if n.kind == "seq":
                return [x for s in n.sub for x in step(s, ind)]
            if n.kind == "&":
                return [f"{ind}if {name_of(n.sub[0])}(p) < 0: return -1"]
            if n.kind == "!":
                return [f"{ind}if {name_of(n.sub[0])}(p) >= 0: return fail(p)"]
            if n.kind in ("?", "*"):
                s = n.sub[0]
                cond = "True" if s.empty else f"K[p] in {table(s)}"
                if n.kind == "?":
                    return [f"{ind}if {cond}:", f"{ind} q = {name_of(s)}(p)", f"{ind} if q >= 0: p = q"]
                return [f"{ind}while {cond}:", f"{ind} q = {name_of(s)}(p)", f"{ind} if q <= p: break", f"{ind} p = q"]
            return [f"{ind}p = {name_of(n)}(p)", f"{ind}if p < 0: return -1"]

        for r, n in self.rules.items():
            todo.append(("r_" + r, n, r))
        body: list[str] = []
        memos: list[str] = []
        while todo:
            f, n, rule = todo.pop()
            code = [f"def {f}(p):"]
            if rule in self.charted:
                memos.append(f"M_{f}")
                code = [f"def {f}(p):", f" q = M_{f}.get(p)", " if q is not None: return q", f" q = M_{f}[p] = x_{f}(p)", " return q", f"def x_{f}(p):"]
            if n.kind == "choice":
                t = f"T_{f}"
                funcs = [name_of(s) for s in n.sub]
                self.space[t] = (n.sub, funcs)
                code += [f" for f in {t}.get(K[p], D_{f}):", "  q = f(p)", "  if q >= 0: return q", " return fail(p)"]
            else:
                code += step(n, " ") + [" return p"]
            body += code
        src = "\n".join(lines + [f"{m} = {{}}" for m in memos] + body)
        tables = {k: v for k, v in self.space.items() if k.startswith("T_")}
        env = {k: v for k, v in self.space.items() if not k.startswith("T_")}
        exec(compile(src, "<grammar>", "exec"), env)
        for t, (alts, funcs) in tables.items():
            default = tuple(env[f] for a, f in zip(alts, funcs) if a.empty)
            by = {}
            for k, i in keys.items():
                got = tuple(env[f] for a, f in zip(alts, funcs) if k in a.first or a.empty)
                if got != default:
                    by[i] = got
            env[t], env["D_" + t[2:]] = by, default
        self.env, self.memos, self.start = env, [env[m] for m in memos], env["r_" + start]

    def parse(self, kinds: list[str], newlines: list[bool] | None = None) -> int:
        """-1 if the tokens are a sentence, else the index of the first token that can't be passed. The last token is EOF."""
        env = self.env
        other = -1
        keys = self.keys
        env["K"] = [keys.get(k, other) for k in kinds]
        env["NL"] = newlines
        env["far"] = 0
        for m in self.memos:
            m.clear()
        try:
            p = self.start(0)
        finally:
            for m in self.memos:
                m.clear()
        return -1 if p == len(kinds) else min(max(env["far"], 0), len(kinds) - 1)
