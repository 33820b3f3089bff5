"""Classes of scripts: what counts as a method, and what only looks like one."""

import time

import pytest

from kestrel.operators import code, scripts


def found(text):
    return [(c["line"], c["name"], c["base"], c["methods"], c["constructors"]) for c in scripts.classes(text)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("class A { run() { return 1 } }", [(1, "A", None, 1, 0)]),
        ("\nexport default class A<T extends {x: 1}> extends ns.Base<T, {y: 2}> implements I {\n  constructor(private a: string = '}') { super(); }\n  async *run<T>(x: T): Promise<{a: T}[]> { }\n}", [(2, "A", "Base", 1, 1)]),
        ("class A { a = () => { return 1 }\n b = 2\n c: {x(): void} = {x() { }}\n static d = [1,\n 2]; #e = 3; f() {} }", [(1, "A", None, 1, 0)]),
        ("abstract class A { a() {} }\nconst B = class C { b() {} }\nf(class D { d() {} })\nx.class\n", []),
        ("class A { a(): void; a(x?: number): void; a(x?: any): { y: 1 } | null { } abstract b(): void; get c() { return `}${'}'}${`{`}` } set c(v) { /}/.test(v) } static { init() } 'd'() {} [e]() {} }", [(1, "A", None, 5, 0)]),
        ("// class X { a() {} }\nconst s = 'class Y { a() {} }', t = `class Z { a() {} } ${new (class { b() {} })()}`\nclass Real { /* b() {} */ get() { return 1 } }", [(3, "Real", None, 1, 0)]),
        ("@Injectable({ a: '{' })\nexport class A {\n  @Input() name: string\n  @Output() done = new E<void>()\n  @Host('x', ['y'])\n  go() {}\n}", [(2, "A", None, 1, 0)]),
        ("class A {}\nclass B extends React.Component { render() { return <div className='a'>it is {this.x}</div> } }\nclass Outer { m() { class Inner { n() {} k() {} } } }", [(1, "A", None, 0, 0), (2, "B", "Component", 1, 0), (3, "Outer", None, 1, 0), (3, "Inner", None, 2, 0)]),
        ("class A { a(): x is string { } b(): (y: {z: 1}) => void { } c?(): void }", [(1, "A", None, 2, 0)]),
        ("class { a() {} }\nclass A extends B", []),
        ("", []),
        ("class Broken { a( { ", [(1, "Broken", None, 0, 0)]),
        ("class A { async() {} get() {} static async set() {} readonly = 1 }", [(1, "A", None, 3, 0)]),
    ],
)
def test_classes(text, want):
    assert found(text) == want


def test_any_text_is_read():
    import random

    pick = random.Random(1)
    parts = ["class A {", "}", "(", ")", "`", "${", "'", '"', "/", "a", "=>", "<", ">", ":", "\n", "@x", "#y", "static", "{", "[", "]", ";", "é", "\\"]
    for _ in range(2000):
        scripts.classes("".join(pick.choice(parts) + " " * pick.randint(0, 1) for _ in range(pick.randint(0, 40))))


def test_single_method_classes_in_scripts(spark):
    files = spark.createDataFrame(
        [("p", "src/a.ts", "class A {\n  run() {}\n}\nclass B { a() {} b() {} }\nclass C extends Error { x() {} }\n"), ("p", "src/b.js", "// none\nclass D { constructor() {} go() {} }"), ("p", "tests/c.ts", "class E { a() {} }"), ("p", "src/x.service.ts", None)],
        "project string, path string, content string",
    )
    got = code.overengineered(files, code.facts(files)).where("kind = 'single_method_class'")
    assert sorted((r.path, r.line) for r in got.collect()) == [("src/a.ts", 1), ("src/b.js", 2)]


def test_long_templates_and_comments_take_a_moment():
    text = "word {} ' " * 1_000_000
    began = time.process_time()
    found = scripts.classes(f"/* {text} */ const s = `{text}${{`{text}`}}`;\nclass K {{ a() {{ return `{text}` }} }}")
    assert [(c["line"], c["name"], c["methods"]) for c in found] == [(2, "K", 1)]
    # A step for each of the 40 million characters took about 8 seconds.
    assert time.process_time() - began < 2


def test_ends_of_templates():
    for text, end in [("``", 2), ("`a\\`b`c", 6), ("`${'`'}`x", 8), ("`${{}`a}`}`x", 11), ("`${`${1}`}`x", 11), ("`$`", 3), ("`a", 2), ("`\\", 2), ("`${", 3), ("`${'a`", 6)]:
        assert scripts._template_end(text, 0) == end
