import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.functions.golang import scan

SOURCE = '''package demo // x
import "fmt"
/* func x() */
const ( A = iota; B
 C, D = 1, 2 )
var Global int = 5
var (
	x, y = 1, "func z() {"
	m map[string]int
)
type T struct { a int; f func(int) (string, error) }
type ( I interface { Foo(x int) error }
  Al = T
  G[K comparable, V any] struct { k K }
  Arr [5]int
  F func(a, b int) (c string) )
func (t *T) M(a int,
   b string) (string, error) {
	var local = Global
	const c2 = 3
	type inner struct { Global int }
	fmt.Println(len(b), string(a), []byte(b), Global)
	go func(Global int) { t.f(1); helper() }(2)
	z := T{A: A}
	if x := y; x > 0 { return gen[int](3) }
	switch v := i.(type) { case T: v.Do() }
	pkg.Global = 1
	s := `raw func q() {`
	r := '{'
	(f)(1)
	return demo.Call(A)("x"), nil
}
func (g *G[K, V]) P() {}
func (g G[K, V]) Q() {}
func (T) R() map[string]interface{} { é := "日本"; call(é, Global); return nil }
func Gen[T any](x T) T
func extern(a int) (int, error)
var h = func() { hidden() }
'''
SYMBOLS = [
    ("const", "", "A", 4, 4, "const A = iota"),
    ("const", "", "B", 4, 4, "const B"),
    ("const", "", "C", 5, 5, "const C = 1, 2"),
    ("var", "", "Global", 6, 6, "var Global int = 5"),
    ("var", "", "x", 8, 8, 'var x = 1, "func z() {"'),
    ("var", "", "m", 9, 9, "var m map[string]int"),
    ("struct", "", "T", 11, 11, ""),
    ("interface", "", "I", 12, 12, ""),
    ("struct", "", "G", 14, 14, ""),
    ("type", "", "Arr", 15, 15, ""),
    ("type", "", "F", 16, 16, ""),
    ("method", "T", "M", 17, 32, "func (T) M(a int,\n   b string) (string, error)"),
    ("var", "", "local", 19, 19, "var local = Global"),
    ("const", "", "c2", 20, 20, "const c2 = 3"),
    ("struct", "", "inner", 21, 21, ""),
    ("method", "G[K, V]", "P", 33, 33, "func (G[K, V]) P()"),
    ("method", "", "Q", 34, 34, "func Q()"),
    ("method", "T", "R", 35, 35, "func (T) R() map[string]interface{}"),
    ("func", "", "Gen", 36, 36, "func Gen(x T) T"),
    ("func", "", "extern", 37, 37, "func extern(a int) (int, error)"),
    ("var", "", "h", 38, 38, "var h = func() { hidden() }"),
]


def test_symbols():
    f = scan(SOURCE)
    assert f.package == "demo"
    assert [(s.kind, s.recv, s.name, s.line, s.end_line, s.sig) for s in f.symbols] == SYMBOLS


def test_calls():
    calls = [(u.name, u.line, u.in_symbol) for u in scan(SOURCE).uses if u.call]
    assert calls == [("Println", 22, "T.M"), ("len", 22, "T.M"), ("string", 22, "T.M"), ("f", 23, "T.M"), ("helper", 23, "T.M"), ("Do", 26, "T.M"), ("Call", 31, "T.M"), ("call", 35, "T.R")]


def test_identifiers():
    names = [(u.name, u.line) for u in scan(SOURCE).uses if not u.call]
    assert ("Global", 19) in names and names.count(("Global", 22)) == 1 and ("Global", 23) in names and ("Global", 35) in names
    assert ("Global", 21) not in names and ("Global", 27) not in names, "fields are no identifiers"
    assert names.count(("A", 24)) == 2 and ("T", 24) not in names


@pytest.mark.parametrize("source, names", [
    (b"", []),
    (b"package", []),
    (b"func (", []),
    (b"}}}{{{", []),
    (b"\xff\xfe var x = 1", ["x"]),
    (b"func f() { var", ["f"]),
    (b"package p\r\nfunc A() {\r\n\tB()\r\n}", ["A"]),
    (b"package p\nfunc A() {}", ["A"]),
    (b"const (\n// note\nX = 1 // y\n)", ["X"]),
    (b"type A[N int] [3]N\ntype B [N]int\ntype C [2*N]int", ["A", "B", "C"]),
    (b"func f() { x := interface{ Foo(int) }(nil); L: for { break L } }", ["f"]),
])
def test_odd_sources(source, names):
    assert [s.name for s in scan(source).symbols] == names


def test_methods_of_local_interfaces_are_no_calls():
    assert [u.name for u in scan("package p\nfunc f() { var i interface { Foo(int) }; i.Bar(map[string]int(nil), chan int(nil)) }").uses if u.call] == ["Bar"]


@given(st.text(alphabet="func typevarconst(){}[]\"'`/*\n ,.=;:abT1", max_size=120))
@settings(max_examples=200, deadline=None)
def test_never_fails(source):
    f = scan(source)
    lines = source.count("\n") + 1
    assert all(1 <= s.line <= s.end_line <= lines for s in f.symbols) and all(1 <= u.line <= lines for u in f.uses)
