"""Measurements of Rust source, by small cases whose numbers follow from the definitions."""

import pytest

from pawl.rust.lexer import Malformed, code_lines, tokenize
from pawl.rust.metrics import contracts, error_facts, measured
from pawl.rust.parser import parse_file


def one(body, **wanted):
    row = measured(body)["functions"][0]
    assert {k: row[k] for k in wanted} == wanted


@pytest.mark.parametrize(
    ("source", "lines"),
    [
        ("fn a() {}\n\n// no\nfn b() {}\n", [1, 4]),
        ("/* a /* b */ c */ fn x() {}\n", [1]),
        ("/* a\n b */\nx\n", [3]),
        ('let s = "// no comment"; // yes\n', [1]),
        ('let s = "one\ntwo\nthree";\nx\n', [1, 3, 4]),
        ('let s = "one \\\ntwo";\nx\n', [1, 2]),
        ("let s = r#\"a\n\"b\n\"#;\n", [1, 3]),
        ("let c = '\"'; // a\nlet d: &'a str = x;\n", [1, 2]),
        ("let c = '\\''; /* x */\n/* y */\n", [1]),
        ("", []),
    ],
)
def test_code_lines(source, lines):
    assert code_lines(source) == lines


@pytest.mark.parametrize(
    ("body", "cyclomatic", "cognitive"),
    [
        ("", 1, 0),
        ("if a { b(); }", 2, 1),
        ("if a && b && c || d { e(); }", 5, 3),
        ("if a { } else if b { } else { }", 3, 3),
        ("for x in y { if x { while z { } } }", 4, 6),
        ("loop { break; }", 1, 1),
        ("match x { 1 => a(), 2 if b && c => d(), _ => e() }", 4, 2),
        ("let r = f()?; let v = g()?;", 3, 0),
        ("let f = |x| if x { 1 } else { 2 };", 2, 3),
        ("'a: for x in y { continue 'a; }", 2, 2),
        ("let Some(x) = y else { return };", 1, 0),
        ("if let Some(x) = y { x } else { z };", 2, 2),
        ("while let Some(x) = it.next() { x; }", 2, 1),
        ("let x = (a as usize) < b; let y = S { a: 1, ..d }; let z = a..=b;", 1, 0),
        ("fn inner() { if a {} }", 2, 1),
        ('println!("{}", if a { 1 } else { 2 });', 1, 0),
    ],
)
def test_complexity(body, cyclomatic, cognitive):
    one(f"fn f() {{ {body} }}", cyclomatic=cyclomatic, cognitive=cognitive)


def test_halstead():
    # operators { } ( as braces, =, ;, +, let; operands x, 1, 2
    row = measured("fn f() { let x = 1 + 2; }")["functions"][0]
    assert row["halstead_difficulty"] == pytest.approx((5 / 2) * (3 / 3))
    assert measured("fn f() {}")["functions"][0]["halstead_difficulty"] == 0.0


@pytest.mark.parametrize(
    ("source", "wanted"),
    [
        ("fn f() { unsafe { a() } }", {"unsafe_count": 1}),
        ("unsafe fn f() { unsafe fn g() {} }", {"unsafe_count": 2}),
        ("fn f() { x.unwrap(); y.expect(\"why\"); z.expect(\" \"); w.unwrap_err(); }", {"panic_count": 4, "bare_panic_count": 3}),
        ("fn f() { panic!(); panic!(\"why\"); todo!(\"x\"); assert!(a); assert!(a, \"b\"); assert_eq!(a, b); debug_assert!(a); }", {"panic_count": 6, "bare_panic_count": 4}),
        ("fn f() { format!(\"{}\", x.unwrap()); vec![y.unwrap(); 3]; }", {"panic_count": 2, "bare_panic_count": 2}),
        ("#[allow(a, b)] fn f() { #[expect(c, reason = \"d\")] let x = 1; }", {"allow_count": 3, "bare_allow_count": 2}),
        ("#[expect(a, reason = \" \")] fn f() {}", {"allow_count": 1, "bare_allow_count": 1}),
        ("#[cfg_attr(x, allow(a))] fn f() {}", {"allow_count": 0}),
        ("pub fn f(a: Rc<RefCell<T>>, b: Box<T>, c: Vec<Box<T>>) -> Arc<T> { }", {"pub_wrapper_count": 4}),
        ("pub(crate) fn f(a: Rc<T>) {}", {"pub_wrapper_count": 0}),
    ],
)
def test_counts(source, wanted):
    one(source, **wanted)


def test_getters():
    source = "impl A { pub fn get_x(&self) {} pub fn get_mut(&mut self) {} pub fn get_y(self) {} pub fn get_z(&self, i: u8) {} fn get_w(&self) {} }"
    assert [f["get_prefix_count"] for f in measured(source)["functions"]] == [1, 0, 0, 0, 0]


def test_names_and_tests_left_out():
    source = """
    mod a { impl<T> B<T> { fn c() { fn nested() {} } } trait D { fn e(); fn g() {} } }
    #[test] fn t() {}
    #[tokio::test] async fn u() {}
    #[cfg(test)] mod tests { fn v() {} }
    #[cfg(all(test, x))] fn kept() {}
    impl Show for &C { fn show(&self) {} }
    """
    assert [f["name"] for f in measured(source)["functions"]] == ["a::B::c", "a::g", "kept", "C::show"]
    assert [f["name"] for f in measured(source, True)["functions"]] == ["a::B < T >::c", "a::D::g", "kept", "<& C as Show>::show"]


def test_spans_and_loc():
    source = "/// doc\nfn a() {\n}\n#[cfg(test)]\nmod t {\n fn b() {}\n}\n"
    found = measured(source)
    assert (found["functions"][0]["start_line"], found["functions"][0]["end_line"]) == (1, 3)
    assert found["file"]["loc"] == 2


def test_file_counts():
    source = "#![deny(warnings, missing_docs)]\n#![cfg_attr(x, forbid(clippy::all, reason = \"y\"))]\n#[allow(a)] struct S { #[allow(b)] x: u8 }\n#[allow(c)] fn f() {}\n"
    assert measured(source)["file"] == {"loc": 4, "allow_count": 2, "bare_allow_count": 2, "deny_warnings_count": 2}


def test_error_facts():
    source = "pub fn f() -> Result<u8, MyErr> {} struct MyErr; #[derive(Debug, thiserror::Error)] enum B {} impl std::error::Error for C {} pub type R<T> = Result<T, a::D>; fn g() -> Result<u8, E> {}"
    facts = error_facts(parse_file(tokenize(source)))
    assert sorted(facts) == sorted([("returned", "MyErr"), ("defined", "MyErr"), ("defined", "B"), ("implemented", "B"), ("implemented", "C"), ("returned", "D")])


@pytest.mark.parametrize("source", ["fn f( {", "fn f() { \" }", "/* a", "fn f() { let = ; }"])
def test_malformed(source):
    with pytest.raises(Malformed):
        measured(source)


def test_contracts():
    found = contracts("#[test] fn a() { x(); }\n#[cfg(feature = \"y\")] fn b() {}\n", "f.rs")
    assert [(k, i) for k, i, _ in found] == [("gate", "f.rs"), ("test", "f.rs::a"), ("gate", "f.rs::a"), ("gate", "f.rs::b")]
    gates = {i: t for k, i, t in contracts("#![cfg(x)]\n#[cfg(unix)] mod out;\nmod inn { impl T for S { #[cfg(y)] fn g() {} } #[rt::test] fn t() {} }", "f.rs") if k == "gate"}
    assert set(gates) == {"f.rs", "f.rs::out", "f.rs::inn", "f.rs::inn::impl S T", "f.rs::inn::impl S T::g", "f.rs::inn::t"}
    assert "cfg ( x )" in gates["f.rs"].replace("(x)", "( x )") and "out" in gates["f.rs"] and "inn" in gates["f.rs"]
    assert gates["f.rs::inn::impl S T::g"] and not gates["f.rs::inn::t"]
    assert contracts("fn (", "f.rs")[0][1] == "f.rs#unparsed"
