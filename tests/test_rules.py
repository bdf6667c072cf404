"""Each rule on small files: what it must find and what it must leave alone."""

import time

import pytest
from pyspark.sql import functions as F

from lintlake.plans.scan import scan
from lintlake.rules import structural
from lintlake.rules.nesting import nested
from lintlake.rules.registry import LINE_RULES, MATCH_RULES

LONG = "function grow() {\n" + "\n".join(f"  const x{i} = {i};" for i in range(65)) + "\n}"

# (path, content, rules expected, rules that must be absent)
CASES = [
    ("schema.sql", "create table s (\n  id uuid references projects(id) on delete cascade,\n);", [], ["sql-delete-no-where"]),
    ("child.sql", "x int REFERENCES parent(id) ON UPDATE SET NULL", [], ["sql-update-no-where"]),
    ("d.sql", "DELETE FROM t;", ["sql-delete-no-where"], []),
    ("dw.sql", "DELETE FROM t\n WHERE id = 1;", [], ["sql-delete-no-where"]),
    ("o.sql", "SELECT * FROM a ORDER BY b\n LIMIT 3;", ["sql-select-star"], ["sql-order-no-limit"]),
    ("o2.sql", "SELECT a FROM a ORDER BY b;\nLIMIT", ["sql-order-no-limit"], ["sql-select-star"]),
    ("p/scripts/get.js", 'await execAsync(`unzip -o "${archivePath}" -d "${destDir}"`);', [], ["security-sql", "sec-sql-injection"]),
    ("q.ts", "db.query(`select ${id}`);", ["security-sql", "sec-sql-injection"], []),
    ("x/daemon/services/s.ts", "const ruleId = `style-debugger-${counter}`;", [], ["style-debugger"]),
    ("dbg.ts", "debugger;", ["style-debugger"], []),
    ("dbgc.ts", "// debugger", [], ["style-debugger"]),
    ("svc.py", "def g(db):\n    return db.query(User).filter(User.id == user_id).first()", [], ["style-equality"]),
    ("user.rb", "if user.role == 'admin'\n  true\nend", [], ["style-equality"]),
    ("main.go", "if err == nil {\n  return nil\n}", [], ["style-equality"]),
    ("User.java", "if (r == Role.ADMIN) {\n  return true;\n}", [], ["style-equality"]),
    ("main.rs", 'if result == Ok(()) {\n  println!("ok");\n}', [], ["style-equality"]),
    ("re.ts", "if (/[^=!<>]==[^=]/.test(line) && !/['\"`]/.test(line.split('==')[0].slice(-5))) {\n}", [], ["style-equality"]),
    ("eq.ts", "if (a == b) { }", ["style-equality", "bug-loose-equality"], []),
    ("ne.ts", "if (a != b) { }", ["style-inequality"], []),
    ("nee.ts", "if (a !== b) { }", [], ["style-inequality", "style-equality"]),
    ("long.ts", LONG, ["func-length", "long-func"], []),
    ("url.ts", "const u = 'https://" + "x" * 130 + "'; // TODO: later", [], ["style-long-line", "style-todo"]),
    ("wide.ts", "call(" + "a + " * 40 + "b); // TODO: later", ["style-long-line", "style-todo"], []),
    ("a/scripts/run.ts", "console.log(a == b);", [], ["style-console", "style-equality"]),
    ("a/daemon/run.ts", "console.error(a == b);", [], ["style-console", "style-equality"]),
    ("web/src/v.ts", "console.error(a);", ["style-console"], []),
    ("s.sh", "echo $name", ["shell-unquoted-var", "shell-no-shebang"], []),
    ("s2.sh", '#!/bin/sh\necho "$name"', [], ["shell-unquoted-var", "shell-no-shebang"]),
    ("Dockerfile", "FROM node:latest\nRUN apt-get install curl", ["docker-latest-tag", "docker-apt-no-y"], []),
    ("b.dockerfile", "RUN apt-get install -y curl\n# USER root\nUSER root", ["docker-user-root"], ["docker-apt-no-y"]),
    ("c.yaml", "a:\n\tb: 1\n   c: yes\nd: \"no\"", ["yaml-tabs", "yaml-indent", "yaml-boolean"], []),
    ("ok.json", '{"a": [1, 2]}', [], ["json-parse-error", "json-trailing-comma"]),
    ("bad.json", '{"a": [1, 2,]}', ["json-parse-error", "json-trailing-comma"], []),
    ("tail.json", '{"a": 1} x', ["json-parse-error"], []),
    ("r.md", "# Intro\n[a](#intro) [b](#gone) [c](http://x#y)", ["md-broken-anchor"], []),
    ("e.ts", "eval('x'); window.x.innerHTML = y;", ["security-eval", "security-xss", "sec-eval", "sec-innerhtml"], []),
    ("ec.ts", "// eval('x')\nconst s = 'eval(1)';", [], ["security-eval"]),
    ("k.ts", "const apiKey = 'abcdefghij';", ["security-secret"], ["style-magic-number"]),
    ("t.ts", "let v: any = w as any;\n// @ts-ignore\nu!.go();", ["ts-any", "ts-as-any", "ts-ignore", "ts-non-null"], []),
    ("t.js", "let v = w;", [], ["ts-any", "ts-as-any"]),
    ("n.ts", "export function f(a) {\n  return a;\n}", ["ts-return-type", "style-no-docs"], []),
    ("nd.ts", "/** Said. */\nexport function f(a): number {\n  return a;\n}", [], ["ts-return-type", "style-no-docs"]),
    ("l.ts", "for (const a of b) {\n  for (const c of a) {\n    s += c.map(d => d);\n  }\n}", ["perf-nested-loop", "perf-array-in-loop", "perf-string-concat"], []),
    ("aw.ts", "async function f() {\n  for (const a of b) {\n    await a();\n  }\n  fetchAll();\n}", ["async-await-loop", "async-missing-await"], []),
    ("aw2.ts", "async function f() {\n  const r = await fetch(u);\n  return fetch(v);\n}", [], ["async-missing-await"]),
    ("sync.ts", "function f() {\n  fetchAll();\n}", [], ["async-missing-await"]),
    ("h.tsx", "function V(p) {\n  if (p.a) {\n    useEffect(() => {\n      go();\n    });\n  }\n  useEffect(() => {\n    go();\n  }, []);\n}", ["react-conditional-hook", "react-useeffect-deps"], []),
    ("m.tsx", "x.map(i => <li>{i}</li>);\nconst [a] = useState();", ["react-missing-key", "react-usestate-init"], []),
    ("m2.tsx", "x.map(i => <li key={i}>{i}</li>);", [], ["react-missing-key"]),
    ("c1.ts", "try { a(); } catch (e) { }", ["style-empty-catch"], []),
    ("u.ts", "const used = 1;\nlet idle = used;\nexport const seen = 2;\nlet _skip = 3;", ["unused"], []),
    ("i.ts", "import { a, b as c } from './x';\nimport D from 'd';\na(D);", ["unused-import"], []),
    ("ur.ts", "function f() {\n  return 1;\n  g();\n}", ["unreachable"], []),
    ("num.ts", "scale(98765);", ["style-magic-number"], []),
    ("num2.ts", "const LIMIT = 98765;\nscale(404, 50, 700, 3000);", [], ["style-magic-number"]),
    ("p.ts", "function wide(a, b, c, d, e, f) {\n}", ["params"], []),
    ("p2.ts", "function wide(cb: (x: A) => void, b, c, d, e, g) {\n}", ["params"], []),
    ("p3.ts", "function wide(\n  a: Map<string, number>, b = [1, 2],\n  { c, d }: T, e: (x: A, y: B) => C,\n  f,\n) {\n}", [], ["params"]),
    ("p4.ts", "function wide(\n  a,\n  b,\n  c,\n  d,\n  e,\n  f,\n) {\n}", ["params"], []),
    ("p5.ts", "const f = x => g(a, b, c, d, e, f, h, {\n});", [], ["params"]),
    ("h2.tsx", "function V(p) {\n  const a = p.on ? useRef(1) : useRef(2);\n}", ["react-conditional-hook"], []),
    ("h3.tsx", "function V(p) {\n  const a = p.on ? 1 : 2\n  const [s] = useState(a?.b ?? 3);\n  useEffect(() => { go(s ? 1 : 2); }, [s]);\n}", [],
     ["react-conditional-hook", "react-useeffect-deps"]),
    ("h4.tsx", "useEffect(run);\nuseEffect(function () { f(a, b); },\n  [a, b]);", ["react-useeffect-deps"], []),
    ("m3.tsx", "xs.map((x, i) => {\n  const y = f(x);\n  return (\n    <li>{y}</li>\n  );\n});", ["react-missing-key"], []),
    ("m4.tsx", "xs.map((x) => {\n  return <Row key={x.id} value={x} />;\n});\nys.map<A>(y => y < z);", [], ["react-missing-key"]),
    ("m5.tsx", "xs.map(x => <>{x}</>)", ["react-missing-key"], []),
    ("num3.ts", "scale(0xFFFF);", ["style-magic-number"], []),
    ("num4.ts", "scale(1e6);", ["style-magic-number"], []),
    ("num5.ts", "scale(1_234_567);", ["style-magic-number"], []),
    ("num6.ts", "scale(0x10, 0b11, 1_000, 1e2, 0o17, a1e6, 9n);", [], ["style-magic-number"]),
    ("then.ts", "a.then(x).catch(y);\nb.then(x).catch(y);\nc.then(x).catch(y);", ["async-then-catch"], []),
    ("then2.ts", "a.then(x).catch(y);\nb.then(x).catch(y);", [], ["async-then-catch"]),
    ("sec.py", "password = 'hunter2hunter2'\ntry:\n  f()\nexcept:\n  pass", ["sec-hardcoded-secret", "py-bare-except"], []),
    ("app.vue", "const a = b == c;", ["style-equality"], ["security-eval"]),
    ("plain.txt", "a == b", [], ["style-equality"]),
]


@pytest.fixture(scope="module")
def found(make_files):
    files = make_files({path: content for path, content, _, _ in CASES})
    out = {path: set() for path, *_ in CASES}
    for row in scan(files, "all").select("file_path", "rule_id").distinct().collect():
        out[row.file_path].add(row.rule_id)
    return out


@pytest.mark.parametrize("path,content,expected,absent", CASES, ids=[c[0] for c in CASES])
def test_case(found, path, content, expected, absent):
    assert set(expected) <= found[path]
    assert not set(absent) & found[path]


def test_every_rule_id_is_known():
    ids = {r.id for r in MATCH_RULES + LINE_RULES}
    assert {"sec-eval", "style-console", "unreachable"} <= ids
    assert len({(r.id, r.severity, r.confidence, r.title) for r in MATCH_RULES + LINE_RULES}) == len(MATCH_RULES + LINE_RULES)


def test_function_length_threshold(make_files):
    files = make_files({"src/utils.ts": LONG})
    loose = structural.script_issues(files, ["complexity"], {"max_function_length": 80})
    assert not loose.where("rule_id = 'func-length'").count()
    assert structural.script_issues(files, ["complexity"]).where("rule_id = 'func-length'").count() == 1


def test_positions(make_files):
    files = make_files({"a.ts": "x;\n  y(eval('1'));\n"})
    row = scan(files, "regex").where("rule_id = 'sec-eval'").first()
    assert (row.line_start, row.col_start, row.col_end) == (1, 4, 9)


def test_blanking_keeps_length(make_files):
    from pyspark.sql import functions as F

    from lintlake.rules.lexer import blank_code

    text = "a('it\\'s'); // c\n/* x\n y */ b(`t ${v} u`); \"q\"; r = 5 / 2;\n'open\n"
    code = make_files({"a.ts": text}).select(blank_code(F.col("content")).alias("c")).first().c
    assert len(code) == len(text)
    assert [i for i, ch in enumerate(text) if ch == "\n"] == [i for i, ch in enumerate(code) if ch == "\n"]
    assert "${v}" in code and "it" not in code and "x" not in code and "5 / 2" in code


def test_spans(make_files):
    from lintlake.rules.spans import function_spans

    code = "function a() {\n  const b = () => {\n    c();\n  };\n}\nconst d = () => 1;\nclass E {\n  async f(x) {\n    if (x) {\n    } else {\n    }\n  }\n}\nfunction open() {\n"
    spans = {r.name: (r.line_start, r.line_end, r.is_async) for r in function_spans(make_files({"a.ts": code})).collect()}
    assert spans == {"a": (0, 4, False), "b": (1, 3, False), "d": (5, 5, False), "f": (7, 11, True), "open": (13, 14, False)}


def test_large_file(make_files):
    files = make_files({"big.js": "eval(1)\n" * 30000})
    counts = {r.rule_id: r["count"] for r in scan(files, "regex").groupBy("rule_id").count().collect()}
    assert counts["skip-large-file"] == 1 and counts["sec-eval"] == 30000


def test_every_match_is_reported_where_it_is(make_files):
    files = make_files({"a.js": "x; eval(1)\n" * 1200})
    rows = scan(files, "regex").where("rule_id = 'sec-eval'").select("line_start", "col_start").collect()
    assert sorted(tuple(r) for r in rows) == [(k, 3) for k in range(1200)]


def test_imports_and_constants_beyond_a_thousand(make_files):
    from lintlake.rules import symbols

    files = make_files({"a.ts": "".join(f"import {{ a{k} }} from './m{k}';\n" for k in range(1200)),
                        "b.ts": "".join(f"export const c{k} = f({k});\n" for k in range(1200))})
    assert symbols.imports(files).count() == 1200
    assert symbols.symbols(files.where("path = 'b.ts'")).count() == 1200


def test_braces_nested_deeply_within_a_line(make_files):
    from lintlake.rules import spans

    body = "function f() {\n  const o = " + "{a:" * 9 + "1" + "}" * 9 + ";\n  }}{{\n  return o;\n}\n"
    deep = body.replace("  }}{{\n", "")
    rows = spans.structure(make_files({"a.ts": deep})).selectExpr("inline(blocks)").where("kind = 'function'").collect()
    assert [(r["line_start"], r["line_end"]) for r in rows] == [(0, 3)]


def test_statement_after_a_keyword_like_call(make_files):
    texts = {"a.ts": "format.print(); foo.bar();\n", "b.ts": "return.x(); awaited.y();", "c.ts": "it.works();", "d.ts": "{ f.g(1) ; }"}
    rows = scan(make_files(texts), "regex").where("rule_id = 'bug-missing-await'").groupBy("file_path").count().collect()
    assert {r["file_path"]: r["count"] for r in rows} == {"a.ts": 1, "c.ts": 1, "d.ts": 1}


def test_words_without_given_beginnings():
    import re

    from lintlake.rules.registry import KEYWORD_STARTS
    from lintlake.rules.spec import word_without

    pattern = re.compile(word_without(KEYWORD_STARTS))
    for word in ("f", "fo", "for", "fora", "fob", "i", "if", "ifx", "ix", "wh", "whil", "while", "whiz", "x", "_r", "returned", "retur", "awai", "co", "conf"):
        assert bool(pattern.fullmatch(word)) == (not word.startswith(KEYWORD_STARTS)), word


def test_json_that_closes_its_wrapper(make_files):
    from lintlake.rules.structural import json_parse_issues

    texts = ['{"a":1}] garbage', '{"a":1}} x', "[1], [2", '1, "w": 2', "1, 2", '{"a": [1, {"b": null}]}', "null", " 3 ", ""]
    files = make_files({f"{k}.json": t for k, t in enumerate(texts)})
    bad = sorted(r["file_path"] for r in json_parse_issues(files).collect())
    assert bad == [f"{k}.json" for k in (0, 1, 2, 3, 4, 8)]


def test_hostile_content(make_files):
    """Rules are total: very long strings, escapes, blank runs and open quotes end no job."""
    files = make_files({
        "escapes.ts": 'const s = "' + "\\n" * 30000 + '"; debugger;',
        "long.ts": "const s = '" + "x" * 150000 + "'; debugger;",
        "template.ts": "const s = `" + "${a} \\` " * 10000 + "`;",
        "blank.ts": "// @ts-ignore\n" + "\n" * 5000 + "x();\nfunction f() {\n  return 1;\n" + "\n" * 5000 + "  g();\n}",
        "open.ts": "const s = 'open\n/* never closed " + "y " * 50000,
        "braces.ts": "{" * 20000 + "}" * 20000,
        "deep.js": "a." * 3000 + "saveAsync();",
        "null.json": "\x00[",
    })
    rules = {(r.file_path, r.rule_id) for r in scan(files, "all").select("file_path", "rule_id").distinct().collect()}
    assert {("escapes.ts", "style-debugger"), ("long.ts", "style-debugger"), ("blank.ts", "ts-ignore"), ("blank.ts", "unreachable")} <= rules


def test_user_rules(spark, make_files):
    from lintlake.rules.matches import load_rules, match_issues

    table = spark.createDataFrame(
        [("no-foo", "Foo", "d", r"\bfoo\(", ["ts"], "bug", "MINOR", 50, 10), ("no-bar", "Bar", "d", "bar", None, "bug", "INFO", 50, None)],
        "id string, title string, description string, pattern string, exts array<string>, category string, severity string, confidence int, impact int",
    )
    found = match_issues(make_files({"a.ts": "foo(bar)", "a.py": "foo(bar)"}), load_rules(table))
    assert sorted((r.file_path, r.rule_id, r.impact) for r in found.collect()) == [
        ("a.py", "no-bar", 20), ("a.ts", "no-bar", 20), ("a.ts", "no-foo", 10)]


def test_nested_spans_by_hand():
    code = "f(a, [b, c], g(d), { e: h ? i(1, 2) : j });"
    parens, conditional = nested(code)
    assert [(code[a : b + 1], parts, head) for _, _, a, b, _, parts, head in parens] == [
        ("(a, [b, c], g(d), { e: h ? i(1, 2) : j })", 4, "f"), ("(d)", 1, "g"), ("(1, 2)", 2, "i")]
    assert [code[a:b].strip() for a, b in conditional] == ["h ? i(1, 2) : j"]
    for odd in ("", "((((", "))))", "a ? b", "{ ( } )", "?:", "x?.y ?? z?: 3"):
        nested(odd)
    parens, _ = nested("a.b<C<D>>(\n  x,\n)")
    assert parens == [(0, 9, 9, 16, 2, 1, ".b")]


def test_time_follows_the_length(spark, make_files):
    """The stack pass on twice the code, and the whole structural pass on ten times the lines."""
    unit = "function f(a, b) {\n  for (const x of a) {\n    const y = x ? g(1, 2) : [h({ k: 3 })];\n  }\n}\n"
    took = []
    for n in (4000, 8000):
        best = 9e9
        for _ in range(3):
            start = time.perf_counter()
            nested(unit * n)
            best = min(best, time.perf_counter() - start)
        took.append(best)
    assert took[1] <= 2.6 * took[0]
    found = {}
    for n in (200, 2000, 20_000):  # 1,000 to 100,000 lines
        start = time.perf_counter()
        rows = structural.script_issues(make_files({"a.ts": unit * n}), ["loops", "nested-loops", "complexity"]).groupBy("rule_id").count().collect()
        found[n] = time.perf_counter() - start
        assert not rows or all(r["count"] in (n, 1) for r in rows)
    assert found[20_000] <= 14 * found[2000]


def _counted(df):
    from collections import Counter

    return Counter(tuple(r) for r in df.select("rule_id", "file_path", "line_start", "col_start", "line_end", "title", "severity", "impact", "code_snippet").collect())


def test_a_scan_is_two_reads_and_all_engines(spark, make_files, folder):
    from functools import reduce

    from lintlake.plans import scan as plans
    from lintlake.rules.lines import line_issues
    from lintlake.rules.matches import match_issues
    from lintlake.rules.registry import FILE_TYPE_RULES, LEXICAL_RULES, STYLE_RULES, WEB_LINE_RULES, WEB_MATCH_RULES

    contents = {path: text for path, text, _, _ in CASES} | {"big.py": "x = 98765\ny(98765, 98765)\n" + "# pad\n" * 40_000, "null.ts": None, "empty.ts": ""}
    make_files(contents).write.parquet(f"{folder}/files")
    files = spark.read.parquet(f"{folder}/files")
    static = [line_issues(files, FILE_TYPE_RULES + STYLE_RULES), match_issues(files, LEXICAL_RULES), structural.script_issues(files),
              structural.broken_anchor_issues(files), structural.json_parse_issues(files)]
    web = lambda f: [structural.large_file_issues(f), match_issues(f, WEB_MATCH_RULES), line_issues(f, WEB_LINE_RULES),
                     structural.long_function_issues(f), structural.repeated_number_issues(f)]
    other = files.where(~plans.is_static_primary(files["path"]))
    for profile, parts in (("web", static + web(other)), ("all", static + web(files))):
        got = scan(files, profile)
        assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation [") <= 2, profile
        assert _counted(got) == reduce(lambda a, b: a + b, map(_counted, parts)), profile


def test_switches_and_user_rules(spark, make_files):
    from lintlake.plans.scan import report
    from lintlake.rules.matches import load_rules, match_issues

    files = make_files({"a.ts": "export function f(a, b, c, d, e, g) { eval(x as any); var idle = 1; console.log(98765); }\n", "b.py": "team_word\n"})
    registry = spark.createDataFrame([("team-word", "Team word", "d", r"\bteam_word\b", None, "bug", "MAJOR", 80, 50)],
                                     "id string, title string, description string, pattern string, exts array<string>, category string, severity string, confidence int, impact int")
    ids = lambda **options: {r.rule_id for r in scan(files, **options).select("rule_id").collect()}
    whole = ids()
    assert {"params", "security-eval", "ts-as-any", "unused", "style-magic-number", "style-console"} <= whole
    gone = {"complexity": {"params"}, "security": {"security-eval"}, "typescript": {"ts-as-any", "ts-return-type"}, "dead-code": {"unused"},
            "style": {"style-magic-number", "style-console", "style-no-docs"}}
    assert all(rules <= whole for rules in gone.values())
    left = ids(switches=dict.fromkeys(gone, False), user_rules=load_rules(registry))
    assert "team-word" in left and not left & set().union(*gone.values())
    with pytest.raises(ValueError):
        scan(files, switches={"unknown": False})
    external = match_issues(files, load_rules(registry)).selectExpr("* except (source)", "'external' AS source", "'team-word-0' AS issue_id")
    assert {r.rule_id for r in report(files, external=external, sources="external").collect()} == {"team-word"}
    assert "team-word" not in {r.rule_id for r in report(files, external=external, sources="internal").collect()}


def test_short_tests_pass_over_no_line():
    """What the short tests of a line rule out, the long ones would not have matched; braces as counted one by one."""
    import re

    from lintlake.rules import spans

    words = ["function f", "const a = ", "x => x", "for (", "do {", "while(a)", "run(a) {", "async get x(b): T {", "} else if (c) {", "a ? b : c", "a?.b",
             "a ?? b", "a && b", "a || b", "case 1:", "switch (x) {", "class A", "interface B", "enum C", "try {", "catch (e) {", "useEffect(", "plain", "}", "{"]
    lines = [f"{a}{gap}{b}" for a in words for b in words for gap in ("", " ", "\t")]
    java = lambda p: re.compile(p.replace(")*+", ")*"))
    for short, longs in ((spans.MAY_START, [spans.ANY_START]), (spans.MAY_BRANCH, [spans.BRANCHES, spans.CONTROL, spans.NULLISH, spans.LOGICAL])):
        for x in lines:
            assert java(short).search(x) or not any(java(p).search(x) for p in longs), x
    assert all(re.search(spans.ONE_OPENER, x) for x in ("{", "a {b")) and not any(re.search(spans.ONE_OPENER, x) for x in ("{}", "}{", "{ {", "}"))


def test_brackets_of_a_batch_are_one_array():
    import pyarrow as pa

    from lintlake.rules.nesting import _nested_of

    got = _nested_of(pa.array(["a.b<c>(d, e)", None, "x(y ? z : w)"])).to_pylist()
    assert [[(p["head"], p["parts"]) for p in r["parens"]] for r in got] == [[(".b", 2)], [], [("x", 1)]]
    assert [len(r["conditional"]) for r in got] == [0, 0, 1] and len(_nested_of(pa.array([], pa.string()))) == 0


def test_files_without_a_hit_are_passed_over_early(make_files, monkeypatch):
    """A look at the whole code keeps every file with an issue: the same rows as without it, and fewer files taken apart."""
    from lintlake.catalog.snippets import SCRIPT

    texts = [b.replace("{w}", "red").replace("{n}", "77").replace("{p}", "1") for b in SCRIPT]
    texts += ["plain words of a text", "", None, "do\n{ while (a) { b.map(x) } } while (c)", "for (;;)\n  s += 1", "run(a) {\n}", "const a=b=>c"]
    texts += [f"{a}\n{b}" for a, b in zip(texts, texts[3:]) if a and b]
    files = make_files({f"f{i}.{ext}": x for i, x in enumerate(texts) for ext in ("ts", "tsx")})
    groups = list(structural.MAY_HIT)
    rows = lambda group: sorted(map(str, structural.script_issues(files, [group]).collect()))
    with_look = {g: rows(g) for g in groups}
    coded = files.where("content IS NOT NULL").withColumns({"code": F.col("content"), "ext": F.concat(F.lit("."), F.substring_index("path", ".", -1))})
    kept = {g: coded.where(structural.MAY_HIT[g](F.col("code"))).count() for g in groups}
    assert all(0 < n < coded.count() for n in kept.values())
    monkeypatch.setattr(structural, "MAY_HIT", {})
    assert with_look == {g: rows(g) for g in groups} and all(with_look.values())


def test_needed_texts_of_patterns():
    from lintlake.rules.needs import needed

    cases = {
        r"\beval\s*\(": (("eval", False),), r"(?i)//\s*(TODO|FIXME)\b": (("todo", True), ("fixme", True)), r"(?i)\b==\b": (("==", False),), r"a|bc": None,
        r"(?:abc)?d": None, r"(?:abc)+d": (("abc", False),), r"(?:abc){0,2}": None, r"[abc]+": None, r"(?:ab*+|cde)x": None, r"x(?i:Ab)y": (("ab", True),),
        r"(?:[^\W{x]|ab)": None, r"\Qa.b\E": None, r"[a-z&&[^b]]word": None, r"[a[b]]": None, r"(?<![\w.])(?=abc)\d": None, "\\t\\n": None, "é!é!": None, "": None,
    }
    assert {p: needed(p) for p in cases} == cases
    assert all(needed(r.pattern) for r in MATCH_RULES if r.id != "bug-missing-await")


def test_short_looks_pass_over_no_finding(make_files, monkeypatch):
    """With and without the short looks before the searches the findings are the same, in every case and spelling."""
    from lintlake.rules import lines, matches
    from lintlake.rules.spec import MatchRule

    texts = {path: text for path, text, _, _ in CASES}
    texts |= {f"up_{path}": text.upper() for path, text in texts.items()} | {"null.ts": None, "empty.ts": "", "w.md": "abc==d", "src/__tests__/k.ts": "TOKEN: \u212aey;\nconst Api_Key = 'x1', authToken = \"y\";"}
    files = make_files(texts)
    user = (MatchRule("u1", "U", "bug", "MINOR", 50, "d", pattern=r"[\w&&[^e]]+==", profile="user"), MatchRule("u2", "U", "bug", "MINOR", 50, "d", pattern="(?i)API.key", profile="user"))
    rows = lambda: sorted(map(str, scan(files, "all", user_rules=user).collect()))
    looked = rows()
    monkeypatch.setattr(matches, "may_match", lambda text, pattern: None)
    monkeypatch.setattr(lines, "worth_testing", lambda rules, web=None: None)
    assert looked == rows() and {"u1", "u2"} <= {i for r in looked for i in ("u1", "u2") if f"'{i}'" in r}


def test_lines_no_rule_looks_at_leave_early(make_files):
    """Of prose and code only lines that some rule of the file may find something in are tested; brackets only where React calls are."""
    from lintlake.rules import lines

    files = make_files({"a.ts": "const a = 1;\nrun(a);\nif (a == b) {\n}\n" + "x" * 121, "b.sql": "SELECT a\nFROM b\nUPDATE c\nWHERE d", "c.sh": "#!/bin/sh\ndone"})
    families = ("style", "sql", "shell")
    shown = lambda **o: sorted((r.path, r.line_no) for r in lines.file_lines(files, families, **o).collect())
    rules = [r for r in LINE_RULES if r.family in families]
    assert len(shown()) == 11
    assert shown(worth=lines.worth_testing(rules)) == [("a.ts", 2), ("a.ts", 4), ("b.sql", 0), ("b.sql", 2), ("c.sh", 0), ("c.sh", 1)]
    coded = make_files({"a.ts": "f(1);", "a.tsx": "f(1);", "b.tsx": "useEffect(f);"}).withColumns(
        {"code": F.col("content"), "ext": F.concat(F.lit("."), F.substring_index("path", ".", -1))})
    base, _ = structural.with_script_hits(coded, ["effects", "conditional-hooks"])
    assert {r["path"]: len(r["parens"]) for r in base.collect()} == {"a.ts": 0, "a.tsx": 0, "b.tsx": 1}


def test_plain_parameters_need_no_stack(make_files):
    """Parameters counted on a line are those of the stack, which runs only over files where a look at the line cannot tell."""
    from lintlake.rules import spans

    heads = ["a, b", "", " ", "a,", "a: Map<string>, b", "a: Map<string, number>, b", "{ a, b }, c", "a = [1, 2], b", "f: (x) => y, b", "a < 1, b", "é, b", "a,\n b"]
    files = make_files({f"f{i}.ts": f"const q = 1; function run({h}) {{\n  if (a) {{ go(1, 2, 3); }}\n}}" for i, h in enumerate(heads)})
    rows = {r["path"]: r["params"] for r in spans.function_spans(files).collect()}
    assert [rows[f"f{i}.ts"] for i in range(len(heads))] == [nested(f"({h})")[0][-1 if h != "f: (x) => y, b" else 0][5] for h in heads]
    blocks = spans.with_blocks(files.withColumn("code", F.col("content")), nested=True)
    open_ended = blocks.where("code LIKE '%string, number%'").count()
    assert open_ended == 1 and "parens" not in blocks.columns


def test_rules_of_one_kind_give_the_rows_of_all(make_files):
    """A rule of the complexity group alone, which passes over files and measures only what it reads, has the rows it has among all."""
    body = "\n".join(f"{'  ' * i}if (a{i} && b) {{" for i in range(7)) + "\n" + "}\n" * 7
    deep = f"function deep(a, b, c, d, e, f) {{\n{body}}}"
    files = make_files({"deep.ts": deep, "long.ts": LONG, "twice.ts": deep + "\n" + LONG, "none.ts": "const a = 1;", "empty.ts": ""})
    rows = lambda found: sorted(map(str, found.collect()))
    whole = structural.script_issues(files, ["complexity"]).cache()
    for rule in structural.COMPLEXITY:
        alone = rows(structural.script_issues(files, ["complexity"], complexity=[rule]))
        assert alone == rows(whole.where(F.col("rule_id") == rule)) and (alone or rule == "cyclomatic"), rule


def test_many_parameters_are_told_without_bodies(make_files):
    """The rule on parameters looks at the lines where functions start, at no brace, and has the rows it has among all rules."""
    heads = ["a, b, c, d, e, f", "a, b, c, d, e", "a, b, c, d, e, f,", "a = [1, 2, 3, 4, 5, 6], b", "a: Map<x, y>, b, c, d, e", "{ a, b, c, d, e, f }",
             "a,\n b, c, d, e, f", "a = g(1, 2), b, c, d, e, f", "(", "a, [[[[[[[[[ b), c, d, e, f", "f: (x) => y, b, c, d, e, g", "é, b, c, d, e, f"]
    shapes = ["function run({h}) {{\n  go(1, 2, 3, 4, 5, 6);\n}}", "class A {{\n  static run({h}) {{\n  }}\n}}", "const run = async ({h}) => go(1, '{h}');",
              "go(1); let q = x => x; function run({h}) {{ }}", "// function run({h}) {{\nconst t = `function run({h})`; run({h});"]
    files = make_files({f"f{i}_{k}.ts": shape.format(h=h) for i, h in enumerate(heads) for k, shape in enumerate(shapes)})
    rows = lambda found: sorted(map(str, found.collect()))
    for limit in (0, 1, 5):
        given = {"max_params": limit}
        whole = structural.script_issues(files, ["complexity"], given).where(F.col("rule_id") == "params")
        alone = structural.script_issues(files, ["complexity"], given, complexity=["params"])
        assert rows(alone) == rows(whole) and len(rows(alone)) > 10
    assert "closings" not in alone._jdf.queryExecution().toString() and "closings" in whole._jdf.queryExecution().toString()


ODD_BODIES = [
    "function f(a) {{\n{x}\n}}", "if (a)\n  function f() {{\n{x}\n}}\n{x}", "while (a) {{\nconst f = () => {{\n{x}\n}};\n}}", "class A {{\n run() {{\n{x}\n", "}} }}\nfunction f() {{\n{x}\n}} }} }}\n{x}",
    "function f() {{ return a => b; }}\n{x}", "function f()\n{{\n{x}\n}}", "run() {{\nfunction g() {{\n{x}\n}}\n{x}\n}}", "{x}", "function f() {{ `\n{x}\n`; }}",
]
ODD_STATEMENTS = [
    "if (a && b || c) {\n for (;;) { x ? y : z; }\n} else if (d) {\n do {\n try { b ?? c; } catch (e) { while (f) { g?.h; } }\n } while (k)\n}",
    "if (a)\n if (b)\n  if (c) return d ? e : f;", "a ???? b; // if (x) { while (y) {\nswitch (c) { case 1: if (d) { e(); } }", "}\nif (a) { b(); } }\n{ {", "go(1);\n" * 5 + "if (a) { }",
]


def odd_functions(make_files):
    return make_files({f"f{i}_{k}.ts": body.format(x=x) for i, body in enumerate(ODD_BODIES) for k, x in enumerate(ODD_STATEMENTS)})


def test_long_functions_need_room(make_files, spark):
    """The rule on lengths ends only functions that a file has lines enough for, and has the rows it has among all rules."""
    from lintlake.rules import spans

    files = odd_functions(make_files)
    rows = lambda found: sorted(map(str, found.collect()))
    for limit in (0, 1, 7):
        given = {"max_function_length": limit}
        whole = structural.script_issues(files, ["complexity"], given).where(F.col("rule_id") == "func-length")
        assert rows(structural.script_issues(files, ["complexity"], given, complexity=["func-length"])) == rows(whole) and whole.count() > 5
    coded = spark.createDataFrame([("function a() {\n}\n\nfunction b() {\n}\n",)], "code string")
    named = lambda least: [b["name"] for b in spans.with_blocks(coded, kinds=("function", "method"), bare=True, least=least).first()["blocks"]]
    assert (named(0), named(2), named(3), named(5), named(6)) == (["a", "b"], ["a", "b"], ["a"], ["a"], [])


def test_cognitive_bound_keeps_every_function(make_files):
    """The bound on the cognitive complexity passes over no function above the limit; no bracket is matched for the rule alone."""
    files = odd_functions(make_files)
    rows = lambda found: sorted(map(str, found.collect()))
    for limit in (0, 4, 15):
        given = {"max_cognitive": limit}
        whole = structural.script_issues(files, ["complexity"], given).where(F.col("rule_id") == "cognitive")
        alone = structural.script_issues(files, ["complexity"], given, complexity=["cognitive"])
        assert rows(alone) == rows(whole) and whole.count() > 3, limit
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan(alone) and "ArrowEvalPython" in plan(whole)


def test_positions_by_line_breaks_and_runs(make_files):
    """Symbols find their line by the breaks before them, literals are counted by runs, one number of a line needs no sums."""
    from lintlake.rules import symbols

    text = "\n\nconst\n  a = 1;\nlet b = 2\n\n\nexport const c = 777 + x;\nrun(777, 1.5); go(1.5);\nrun(98765);\n\ntype T = A;"
    files = make_files({"s.ts": text})
    assert sorted((r["name"], r["line_start"]) for r in symbols.symbols(files).collect()) == [("T", 11), ("a", 2), ("b", 4), ("c", 7)]
    assert [(r["value"], r["occurrences"]) for r in structural.repeated_literals(files).collect()] == [("1.5", 2)]
    numbers = structural.script_issues(files, ["magic-numbers"]).collect()
    assert sorted((r["line_start"], r["col_start"], r["col_end"]) for r in numbers) == [(8, 4, 7), (9, 4, 9)]
