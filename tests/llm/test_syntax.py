import ast
import inspect

import pytest

from tessera.llm import chart, syntax

VALID = {
    "python": [
        "", "# only\n", "\ufeffx = 1\n", "def f(a, /, b: int = 1, *args, c, **k) -> int:\n    return a\n", "async def f():\n    async with a as b, c:\n        await x\n    async for i in y: pass\n", "match x:\n    case {'a': [1, *_], **r} if r: pass\n    case P(x=1) | None as q:\n        pass\n", "match = 1\nprint(match, type)\ntype X[T: int] = list[T]\n",
        "x = [i for i in range(3) if i if not i]\ny = {**a, 'b': 1}\nz = {*a}\nlambda *a, b=1: (yield)\n", "try:\n  pass\nexcept* (A, B) as e:\n  raise X from e\nelse:\n  pass\nfinally:\n  pass\n", "a: int\nb.c: str = f'{x!r:>{w}} {{}}'\na, *b = c = 1, 2\nx += yield y\n", "if x:\n\ty\nelse :\n\tz;w\n", "f(*a, k=1, **b)[1:2, ::3, ...] @ m if (n := 3) else not k\n", "@d(1)\nclass A[T](B, metaclass=C):\n    x = 1\n\n\n    def f(self): return\n", "s = '''a\n' b''' \"c\"\nd = (1,\n  2)\\\n  + 3\n", "with (open(a) as b, open(c) as d,): pass\ndel a, b[0]\nglobal x\nassert x, y\n", "f'{x[\"a\"]!r:>{w}} {{}} {y=}' f\"{'{'} {z:%H:%M}\" rf'\\{a}' f\"{d[\"k\"]}\"\n", "0x_ff + 1_000.5e-3j + 0b1 + 0o7\nx = 1if y else 2\n",
    ],
    "javascript": [
        "", "// c", "#!/usr/bin/env node\n'use strict'\nlet a = 1, {b, ...c} = d, [e = 2,, f] = g\n", "const f = async ({a, b: [c]}, ...r) => { for await (const x of y) yield_(x) }\n", "class A extends B { #p = 1; static { this.x = 1 } get a() { return this.#p } static async *gen() {} 'q'() {} [c]() {} constructor() { super() } }\n", "x = a ? b : c ?? d?.e?.[0]?.(1)\ny = /[/\\]]+/g.test(s) / 2 / z\nif (x) /re/.exec(y)\n",
        "`a ${b + `c ${d}`} e`\ntag`x${y}`\n", "import a, {b as c, default as d} from 'x'\nimport * as n from \"y\"\nexport default function () {}\nexport {a as b}\nexport * from 'z'\nexport const q = 1\n", "label: for (;;) { break label }\ndo x++; while (y)\nswitch (a) { case 1: case 2: b(); break; default: c() }\n", "var o = { a, b() {}, get c() { return 1 }, async *d() {}, [e]: 1, 'f': 2, 3: 4, ...g, async: 1, get: 2 }\n", "a = b\n++c\nreturn_ = function* () { yield* x; yield }\nnew.target_\nnew A\nnew a.b.C(1)(2)\n", "const async_ = async x => await x, of = 1\nlet x1 = async () => {}\nthrow new Error(`x`)\n", "try { a() } catch { b() } finally { c() }\n(function () {})()\n!function () {}()\n", "x = a < b && c > d; y = a >> b >>> c; z >>>= 1; w ??= 2; v **= 2 ** 3\n",
    ],
    "typescript": [
        "", "interface A<T extends B = C> extends D<E>, F { a?: string; readonly b: number[]; [k: string]: any; (x: T): void; new (y: U): V; m?<K>(z: K): asserts z is L }\n", "type A = { readonly [K in keyof T as `x${K}`]?: T[K] extends infer U ? U : never } | null & (string | 1)\n", "export abstract class A<T> implements B, C { private readonly x: number = 1; constructor(public a: string, protected b?: T) { super() } abstract f(): void; static async g<T>(this: A, x?: T): Promise<T[]> { return x! as T } declare y: string; z!: number }\n", "const f = <T,>(x: T): x is T => true\nconst g = async <T>(a: T[]): Promise<Map<string, T>> => new Map<string, T>()\n", "enum E { A = 1, B = 'x', }\ndeclare module 'm' { export function f(a: number): void; }\nnamespace N.M { export const a = 1 }\ndeclare global { interface Window { x: any } }\n",
        "@Injectable({a: 1})\nexport class S { constructor(@Inject(T) private readonly t: T) {} @Input() name: string }\n", "function f(a: number): string\nfunction f(a: any): any { return a satisfies B }\nlet x = <any>y\nlet t: [a: string, b?: number, ...rest: C[]] = z\n", "import type { A } from './a'\nimport { type B, C } from './b'\nexport type { D } from './d'\nimport x = require('y')\nlet u: unique symbol, v: typeof import('q'), w: abstract new () => void\n", "let a = b as const, c = d! + e!.f\nif (a < b && c > d) {}\nfor (const [k, v] of Object.entries(x as Record<string, number>)) {}\n", "let fn: (a: string, ...b: number[]) => void = (a) => {}\nlet o = { m<T>(this: X, a: T): T { return a } }\n", "export default interface X {}\n",
    ],
    "java": [
        "", "// c\n", "package a.b; import static c.D.*; import e.F;\n@interface A { int x() default 1; String[] y(); }\n", "public sealed interface S<T extends Comparable<? super T> & B> permits X, Y {}\nrecord P(int a, String... b) implements Q { P { if (a < 0) throw new X(); } static int z = 1; }\nenum E implements F { A(1) { void f() {} }, B; private final int i; E(int... i) {} }\n",
        "class A<T> extends B<T> { int[] a = {1, 2}, b[] = new int[3][]; { init(); } static { x(); } <U> A(U u) throws X, Y { this(); } abstract void f(); @Override public final Map<String, List<? extends T>> g(final int x, T... y) { for (var e : m.entrySet()) { continue; } for (int i = 0, j = 1; i < j; i++, j--) ; return (a) -> b; } }\n",
        "class A { void f() { switch (x) { case 1, 2 -> y(); case String s when s.length() > 1 -> { } default -> throw new E(); } int r = switch (k) { case A: yield 1; default: yield 2; }; try (var a = b(); c) { } catch (X | Y e) { } finally { } Runnable q = () -> {}; Function<A, B> g = A::new; int[]::new; ; if (o instanceof P(int a, var b) && !(o instanceof String s)) return; label: while (true) break label; synchronized (this) { } assert x : \"y\"; List<String>[] l; a.<T>b(); x = (int) y + (String) z; char c = '\\''; String t = \"\"\"\n  a\"b\n  \"\"\"; long n = 0xFFL; i >>>= 2; do { } while (i > 0); new A() { }; this.x = A.this.y; Object o = (Runnable & Serializable) () -> {}; } }\n".replace("int[]::new; ; ", "h = int[]::new; "),
        "void main() { System.out.println(1); }\n",
    ],
    "go": [
        "package a\n", "package a\n\nimport (\n\t\"fmt\"\n\tx \"y/z\"\n\t_ \"q\"\n)\n\nconst (\n\tA = iota\n\tB\n)\n\nvar a, b int = 1, 2\n", "package a\nfunc (s *S[T]) F(a, b int, c ...string) (x int, err error) {\n\tif v, ok := m[k]; ok && !v {\n\t\treturn\n\t} else if x := f(); x != nil {\n\t}\n\tfor i := 0; i < 10; i++ {\n\t}\n\tfor range ch {\n\t}\n\tfor k, v := range m {\n\t\t_ = k\n\t}\n\tfor {\n\t\tbreak\n\t}\n}\n",
        "package a\ntype T struct {\n\tA int `json:\"a\"`\n\t*B\n\tc.D\n\te, f func(int) string\n}\ntype I interface {\n\tM(x int) error\n\tfmt.Stringer\n\t~int | ~string\n}\ntype A = B\ntype G[K comparable, V any] map[K]V\n", "package a\nfunc f() {\n\tx := []T{{1, 2}, {A: 3}}\n\ty := map[string][]int{\"a\": {1}}\n\tz := &T{A: 1,\n\t\tB: 2,\n\t}\n\tgo func() { <-ch }()\n\tdefer g()\n\tselect {\n\tcase v := <-c:\n\tcase c <- 1:\n\tdefault:\n\t}\n\tswitch x := y.(type) {\n\tcase nil, *T:\n\tcase []int:\n\t}\n\tswitch {\n\tcase a > b:\n\t\tfallthrough\n\tdefault:\n\t}\n\tx[1:2:3], p = *p, a&^b<<2\n\tg[int](1)\n\tL:\n\tfor {\n\t\tcontinue L\n\t}\n\tvar f func(a int, b string) (c, d int)\n\tch <- 1\n\tx += 1\n\tif (T{} == y) {\n\t}\n\treturn func(a int) int { return -a }(1), 'x', `r\n`, 0x1p-2, 1i\n}\n",
    ],
    "rust": [
        "", "// c", "#![allow(x)]\nuse std::{fmt::{self, Display}, io as i};\npub(crate) mod a;\nextern crate b;\n", "pub struct A<'a, T: Clone + 'a, const N: usize = 3> where T: Fn(i32) -> i32 { pub a: &'a mut [T; N], b: Box<dyn Fn() + Send> }\nstruct B(pub i32, String);\nstruct C;\nenum D { A, B(i32), C { x: u8 } = 3, }\n", "impl<T> X for Y<T> where T: Z { type O = T; const A: i32 = 1; fn f(&mut self, (a, b): (i32, i32)) -> Result<(), Box<dyn Error>> { let Some(x) = y else { return Err(\"e\".into()) }; Ok(()) } }\ntrait T: U + V { fn f(self: &Self) -> impl Iterator<Item = u8>; async fn g() {} }\n",
        "fn main() { let mut v = vec![1, 2]; for (i, x) in v.iter().enumerate() { println!(\"{}\", x); } if let Some(ref y) = a && b > c { } else if x < y { } match z { 1..=5 | 7 => {} n @ 8.. if n > 3 => a(), S { a, .. } => (), &(x, _) => { } _ => unreachable!() } let c = |a: i32, b| -> i32 { a + b }; let d = move || x?; 'l: loop { break 'l 3; } while let Some(x) = s.pop() { } unsafe { *p = 1 } a.await?.b::<T>()[0] as u8; let s = S { a: 1, b, ..Default::default() }; let r = 0..n; r#type = b'x'; let t = \"a\\\"b\"; let q = r#\"x\"y\"#; a <<= 1; x = y >> 2; &&z; -1i32 }\n",
        "macro_rules! m { ($x:expr) => { $x + 1 }; }\nstatic mut X: &'static str = \"a\";\nconst F: fn(i32) -> i32 = |x| x;\npub type R<T> = std::result::Result<T, E>;\nextern \"C\" { fn f(x: *const u8, ...); }\nfn g<F>(f: F) where F: for<'a> Fn(&'a str) -> bool {}\n/* a /* b */ c */\n",
    ],
    "csharp": [
        "", "// c\n", "using System; using static A.B; global using C = D.E<int>;\nnamespace X.Y;\npublic record R(int A, string? B = null);\n", "#region a\n[Obsolete(\"x\"), A(B = 1)]\npublic abstract partial class C<T, U> : D<T>, IE where T : class, new() where U : struct { private readonly int _x = 1, y; public int P { get; private set; } = 3; public string Q => _x.ToString(); public int this[int i] { get => i; set { } } public event EventHandler E; const int K = 1; ~C() { } public C(int a) : base(a) { } public static C<T, U> operator +(C<T, U> a, int b) => a; public static implicit operator int(C<T, U> c) => 1; protected virtual async Task<List<int?>> F<V>(ref int a, out string b, params object[] c) where V : notnull { b = $\"{a:N2} {{x}} {(a > 1 ? \"y\" : \"z\")}\"; await foreach (var x in y) { } return null!; } void IE.G() { } }\n#endregion\n",
        "class A { void F() { var q = from x in xs where x > 1 orderby x descending select new { x, Y = x.Z }; var r = s switch { int n when n > 1 => \"a\", { Length: > 3 } => \"b\", null => \"c\", (1, _) => \"d\", _ => throw new E() }; if (o is string { Length: 1 } t && o is not null or A) { } using var f = G(); using (var h = I()) { } try { } catch (E e) when (e.X) { } finally { } switch (k) { case 1: case 2: break; case string z: return; default: goto case 1; } for (int i = 0, j = 1; i < j; i++) ; lock (this) { } checked { } Func<int, int> g = static x => x * 2; Action a = delegate { }; (int p, var w) = (1, 2); x ??= y?.Z?[0] ?? throw new E(); int[] m = { 1, 2 }; var n = new int[2, 3]; var d = new Dictionary<string, List<int>> { [\"a\"] = new() { 1 } }; List<int> l = [1, .. m]; string v = @\"a\"\"b\", u = \"\"\"x\"y\"\"\"; int Local(int b) => b; goto end; end: return; } }\n".replace("goto end; end: return; ", ""),
        "enum E : byte { A = 1, B }\ninterface I<out T> { T F(); int P { get; } }\ndelegate void D<T>(T x);\nstruct S { public int a; }\n", "using System;\nConsole.WriteLine(\"hi\");\nint F(int x) { return x; }\n",
    ],
    "sql": [
        "", "-- c\n", ";", "CREATE TABLE IF NOT EXISTS a.b (id BIGSERIAL PRIMARY KEY, \"n\" VARCHAR(64) NOT NULL DEFAULT 'x''y', p NUMERIC(10, 2) CHECK (p > 0), t TIMESTAMP WITH TIME ZONE DEFAULT now(), a INT[] , CONSTRAINT c FOREIGN KEY (id) REFERENCES d (id) ON DELETE CASCADE ON UPDATE SET NULL, UNIQUE (id, n)) ;\n", "CREATE UNIQUE INDEX CONCURRENTLY i ON a USING btree (lower(n) DESC NULLS LAST, b) WHERE n IS NOT NULL; DROP TABLE IF EXISTS a, b CASCADE; ALTER TABLE a ADD COLUMN b INT, DROP CONSTRAINT c, ALTER COLUMN d TYPE TEXT USING d::text, RENAME TO e\n",
        "CREATE OR REPLACE VIEW v (a) AS WITH x AS (SELECT 1) SELECT DISTINCT t.*, count(*) FILTER (WHERE a > 1) OVER (PARTITION BY b ORDER BY c ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) n FROM t LEFT JOIN u USING (id) JOIN w ON t.a = w.a AND w.b IN (1, 2) WHERE NOT EXISTS (SELECT 1 FROM z) AND a BETWEEN 1 AND 2 OR c LIKE '%x' GROUP BY 1, b HAVING count(*) > 1 UNION ALL SELECT CASE WHEN a THEN 1 ELSE 2 END FROM q ORDER BY 1 DESC LIMIT 10 OFFSET 5;\n", "CREATE FUNCTION f(a INT) RETURNS INT AS $$ begin ; end $$ LANGUAGE plpgsql; CREATE TRIGGER t BEFORE INSERT OR UPDATE ON a FOR EACH ROW EXECUTE FUNCTION f(); CREATE TYPE m AS ENUM ('a', 'b'); CREATE SEQUENCE s START WITH 1 INCREMENT BY 2; CREATE SCHEMA x; INSERT INTO a (b) VALUES (1), (DEFAULT) ON CONFLICT (b) DO UPDATE SET c = excluded.c RETURNING id; UPDATE a SET b = 1 WHERE c; DELETE FROM a; BEGIN; COMMIT; GRANT SELECT ON a TO b; COMMENT ON TABLE a IS 'x'",
        "CREATE TABLE `t` (`id` int(11) unsigned NOT NULL AUTO_INCREMENT, k ENUM('a','b') DEFAULT 'a' COMMENT 'c', PRIMARY KEY (`id`), KEY `x` (`k`)) ENGINE=InnoDB DEFAULT CHARSET=utf8;\n",
    ],
}

INVALID = {
    "python": ["def f(:\n  pass", "if x\n  y", "x = (1", "print 'x'", "  x\ny", "def f():\nreturn", "a = 'b", "class {{ n }}:\n pass", "<<<<<<< HEAD\n", "for in x: pass", "f'{a'", "if x:\n  a\n b", "x = 1 +", "import", "1 = x = ", "# T\n\nNot code here", "x ===  y", "f'{a'", "f'{}'", "6 = (1)", "f() = 1", "'a': int", "for 1 in x: pass", "None += 1", "f'{a b}'", "f'{, a}'", "x = \"\"\"a\"\n", "f'}'", "else: pass", "try:\n  a\n"],
    "javascript": ["function f( {", "let a = ;", "const x: number = 1", "if (a { }", "a b", "class { x }", "`a ${b`", "'a\n'", "<<<<<<< HEAD\n", "}", "import a from", "<html></html>", "interface A { x: string }", "for (;;", "return }", "x = {a: 1,, b}", "def f():\n  pass"],
    "typescript": ["interface A { x: }", "let a: = 1", "type = {", "class A { private x: number", "function f(a: string { }", "const x: Map<string = y", "enum A { 1 }", "}", "<<<<<<< HEAD\n", "package a;\nimport java.util.List;\nclass A {}", "`${`"],
    "java": ["class A {", "class A { void f() { int x = ; } }", "class A { int f( { } }", "public class { }", "class A { void f() { x y z; } }", "class A { String s = \"a; }", "class A } {", "import a", "class A { void f() { if x { } } }", "# T\n", "class A { int x }", "package main\n\nfunc main() {\n}\n"],
    "go": ["", "// c\n", "package", "package a\nfunc f( {\n}\n", "package a\nfunc f() {\n\tx := \n}\n", "package a\nfunc f()\n{\n}\n", "package a\ntype T struct {\n", "package a\nif x {\n}\n", "package a\nvar s = \"a\n", "package a\nfunc f() { for { }\n", "package a;\nimport java.util.List;\n", "package a\n<<<<<<< HEAD\n"],
    "rust": ["fn f( {}", "fn f() { let x = ; }", "struct A { a: }", "fn f() { match x { 1 => } }", "impl {", "fn f() { \"a }", "fn f() -> { }", "fn f() { if { } ", "let x = 1;", "use a::;", "class A {}", "fn f() { x y }", "fn f() -> usize { self.x as usize\n<<<<<<< HEAD\n}", "fn f() { a + }", "enum E { A(, }"],
    "csharp": ["class A {", "class A { void F( { } }", "class { }", "class A { int x = ; }", "class A { void F() { if x { } } }", "namespace", "class A { string s = \"a; }", "using System\nclass A {}", "class A { int P { get; set } }", "}", "def f():\n  pass\n", "<<<<<<< HEAD\n"],
    "sql": ["CREATE TABLE (a INT)", "CREATE TABLE a (b INT,)", "CREATE TABLE a (b INT", "CREATE INDEX ON", "SELECT FROM WHERE", "CREATE TABLE a (b INT) CREATE TABLE c (d INT)", "INSERT INTO a VALUES (1", "CREATE VIEW v AS", "SELECT 'a", "<html>", "DROP", "CREATE TABL a (b INT)", "<<<<<<< HEAD\nSELECT 1;", "def f(): pass"],
}


@pytest.mark.parametrize("language, text", [(k, t) for k, v in VALID.items() for t in v])
def test_valid(language, text):
    assert syntax.error_of(text, language) is None


@pytest.mark.parametrize("language, text", [(k, t) for k, v in INVALID.items() for t in v])
def test_invalid(language, text):
    assert syntax.error_of(text, language) is not None


def test_python_grammar_on_its_own_library():
    """Against the interpreter's parser, over modules of the standard library and cuts of them."""
    import argparse
    import dataclasses
    import json.decoder
    import textwrap

    for m in (argparse, dataclasses, json.decoder, textwrap, inspect):
        src = inspect.getsource(m)
        assert syntax.error_of(src, "python") is None
        lines = src.splitlines(True)
        for k in range(40, min(len(lines), 900), 97):
            cut = "".join(lines[:k])[:-3]
            try:
                ast.parse(cut)
                ok = True
            except SyntaxError:
                ok = False
            assert (syntax.error_of(cut, "python") is None) == ok, (m.__name__, k)


def test_lines_and_odd_input():
    assert syntax.error_of("x = 1\r\ny = (\r\n", "python")[0] == 3
    assert syntax.error_of("a\n\nb c\n", "javascript")[0] == 3
    assert syntax.error_of(None, "python") is None and syntax.error_of("x", "unknown") is None and syntax.error_of("x", None) is None
    assert syntax.error_of("x\0", "python") is not None
    deep = "(" * 3000 + "1" + ")" * 3000
    assert syntax.error_of(deep, "python") is None and syntax.error_of("x = " + "-" * 5000 + "1;", "javascript") is None


def test_time_is_near_linear():
    import time

    def took(n):
        t = time.time()
        assert syntax.error_of("class A { void f() { x = ((((a + (b)) * (c))))); } }\n".replace(")))));", "))));") * n, "java") is None
        return time.time() - t

    took(20)
    a, b = took(200), took(1600)
    assert b < 8 * a * 2.5 + 0.5


def test_grammar_notation():
    g = chart.Grammar("file = s* EOF\n@s = 'if' e ':' s | NAME '=' e ';' | NAME % ',' ';'\n@e = t (('+' | '*') t)*\nt = NAME | NUM | '(' e ')'", {"if"}, {"NAME", "NUM"})
    assert g.parse("if NAME + ( NUM * NAME ) : NAME = NUM ; NAME , NAME ; EOF".split()) == -1
    assert g.parse("if NAME + ( NUM * ) EOF".split()) == 6


def test_rows(spark):
    rows = [("a.py", "python", "x = (", 1, "h1"), ("a.py", "python", "x = 1", 2, "h2"), ("b.js", "javascript", None, 1, "h"), ("c.x", "unknown", "((", 1, "h"), ("d.go", "go", "x", None, None), ("d.go", "go", "x", None, None), (None, "go", "x", 1, "h")]
    df = spark.createDataFrame(rows, "path string, language string, content string, indexed_at int, content_hash string").selectExpr("*", "'p' as project_id", "true as valid", "1 as line")
    v = syntax.checked(df)
    assert {(r["path"], r["valid"]) for r in v.collect()} == {("a.py", True), ("b.js", True), ("c.x", None), ("d.go", False)}
    assert {r["language"]: (r["n_files"], r["n_invalid"]) for r in syntax.rates(v).collect()} == {"python": (1, 0), "javascript": (1, 0), "unknown": (1, 0), "go": (1, 1)}
    assert syntax.checked(df.limit(0)).count() == 0
