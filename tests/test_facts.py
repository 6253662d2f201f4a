import pytest
from pyspark.sql import functions as F

from scanloom.operators.facts import assignments, calls, defer_in_loop, parse_in_try
from scanloom.operators.scan import scan


def names(frame):
    return [(r.line, r.column_start, r.func_text, r.args) for r in frame.orderBy("line", "column_start").collect()]


def test_calls_inside_calls_and_over_lines(texts):
    code = "a.b(c(1, [2, 3]), x = 'p, q',\n  d())\nfoo().bar( )"
    assert names(calls(texts(("f", "python", code)))) == [
        (1, 1, "a.b", ["c(1, [2, 3])", "x = 'p, q'", "d()"]), (1, 5, "c", ["1", "[2, 3]"]), (2, 3, "d", []),
        (3, 1, "foo", []), (3, 6, ".bar", [])]


def test_keyword_arguments(texts):
    row = calls(texts(("f", "python", "run(cmd, shell = True, n=f(a=1), ok=x == y)"))).where("func_text = 'run'").first()
    assert [(k.name, k.value) for k in row.kwargs] == [("shell", "True"), ("n", "f(a=1)"), ("ok", "x == y")]


@pytest.mark.parametrize("language,code", [
    ("python", "# eval(x)\n'eval(x)' \"eval('a')\" r'eval(x)'\n\"\"\"doc eval(x)\n eval(y)\"\"\""),
    ("javascript", "// eval(x)\n/* eval(y)\n eval(z) */ 'eval(w)' \"it's eval(v)\""),
    ("go", "// eval(x)\n`raw eval(x)\n eval(y)` \"eval(z)\" 'a'"),
    ("rust", "// eval(x)\n/* eval(y) */ \"eval(z)\""),
])
def test_strings_and_comments_hold_no_calls(texts, language, code):
    assert names(calls(texts(("f", language, code)))) == []


def test_definitions_are_no_calls_but_f_strings_are_read(texts):
    assert names(calls(texts(("f", "python", "def eval(x): pass\nclass A(B): pass\nf'{eval(y)}'")))) == [
        (3, 4, "eval", ["y"])]


def test_unbalanced_calls_still_count(texts):
    assert names(calls(texts(("f", "python", "eval(x")))) == [(1, 1, "eval", [])]


def test_assignments(texts):
    got = assignments(texts(
        ("a", "python", "x = 1\n  y.z += f(k=2)\nif a == b: c = 3\nn: int = 4"),
        ("b", "javascript", "const q = 'a;b'; el['x'].p = w;\nif (a === b) {}"))).orderBy("path", "line", "column_start")
    assert [(r.path, r.target, r.value) for r in got.collect()] == [
        ("a", "x", "1"), ("a", "y.z", "f(k=2)"), ("a", "n", "4"), ("b", "q", "'a;b'"), ("b", "el['x'].p", "w")]


RULES = [
    ("python", "eval(a)", "PY001"), ("python", "m.eval(a)", "PY001"), ("python", "exec(a)", "PY002"),
    ("python", "ast.literal_eval(a)", "PY003"), ("python", "pickle.dumps(a)", "PY005"),
    ("python", "marshal.loads(a)", "PY006"), ("python", "yaml.load(a)", "PY007"),
    ("python", "subprocess.call(a, shell=True)", "PY008"), ("python", "os.popen(a)", "PY010"),
    ("python", "tempfile.mktemp()", "PY015"), ("python", "open(request.path)", "PY016"),
    ("python", "    assert a", "PY017"), ("python", "hashlib.md5(a)", "PY018"), ("python", "sha1(a)", "PY019"),
    ("python", "input()", "PY020"), ("python", "xml.fromstring(a)", "PY021"),
    ("python", "ssl._create_unverified_context()", "PY022"), ("python", "random()", "PY025"),
    ("python", "json.load(a)", "PY027"), ("python", "yaml.load(a)", "PY028"), ("python", "pickle.load(a)", "PY029"),
    ("python", "eval(user_text)", "PY030"), ("python", "exec(form['a'])", "PY031"), ("python", "torch.compile(a)", "PY039"),
    ("python", "transformers.pipeline('x', trust_remote_code=True)", "PY040"),
    ("python", "np.array(request.args)", "PY041"), ("python", "Celery('a', task_serializer='pickle')", "PY042"),
    ("javascript", "eval(a)", "JS-EVAL-001"), ("javascript", "new Function('a')", "JS-EVAL-002"),
    ("javascript", "setInterval(\"a()\", 5)", "JS-TIMER-001"), ("javascript", "a.outerHTML = b", "JS-XSS-001"),
    ("javascript", "document.writeln(a)", "JS-XSS-002"), ("javascript", "db.run('a' + b)", "JS-SQLI-001"),
    ("javascript", "execSync(`ls ${a}`)", "JS-EXEC-001"), ("javascript", "token = Math.random()", "JS-CRYPTO-001"),
    ("javascript", "JSON.parse(a)", "JS-JSON-001"), ("javascript", "a.__proto__.b = c", "JS-PROTO-001"),
    ("javascript", "<p dangerouslySetInnerHTML={x} />", "JS-REACT-001"),
    ("javascript", "axios.get(req.query.u)", "JS-SSRF-001"), ("javascript", "fs.rename('../a', b)", "JS-PATH-001"),
    ("javascript", "res.redirect('//a.b')", "JS-REDIRECT-001"),
    ("go", "unsafe.SliceData(a)", "go-unsafe-pointer-ast"), ("go", "for x {\ndefer f()\n}", "go-defer-in-loop"),
    ("rust", "x\n  .expect(\"a\")", "RS011"), ("rust", "transmute(a)", "RS022"), ("rust", "mem::forget(a)", "RS023"),
    ("rust", "uninitialized()", "RS024"), ("rust", "drop_in_place(a)", "RS025"), ("rust", "panic!(\"{}\", user)", "RS009"),
    ("rust", "format!(\"FROM {}\", a)", "RS005"), ("rust", "debug_assert!(a)", "RS020"),
]
CLEAN = [
    ("python", "literal(a)", "PY003"), ("python", "yaml.safe_load(a)", "PY007"), ("python", "subprocess.call(a)", "PY008"),
    ("python", "subprocess.call(a, shell=False)", "PY008"), ("python", "open(path)", "PY016"),
    ("python", "random.choice(a)", "PY025"), ("python", "eval(a)", "PY030"), ("python", "pickle.dumps(a)", "PY029"),
    ("python", "pipeline('x', trust_remote_code=True)", "PY040"), ("python", "np.array(rows)", "PY041"),
    ("python", "evaluate(a)", "PY001"), ("python", "eval(a)", "PY005"), ("python", "assertion = 1", "PY017"),
    ("javascript", "setTimeout(run, 5)", "JS-TIMER-001"), ("javascript", "a.innerHTML = 'x'", "JS-XSS-001"),
    ("javascript", "db.query('a', [b])", "JS-SQLI-001"), ("javascript", "exec('ls')", "JS-EXEC-001"),
    ("javascript", "try {\n JSON.parse(a)\n} catch (e) {}", "JS-JSON-001"), ("javascript", "a.__proto__ == b", "JS-PROTO-001"),
    ("javascript", "axios.get(url)", "JS-SSRF-001"), ("javascript", "fs.rename('a', b)", "JS-PATH-001"),
    ("javascript", "res.redirect('/a')", "JS-REDIRECT-001"),
    ("go", "for x {\n}\ndefer f()", "go-defer-in-loop"), ("rust", "panic!(\"done\")", "RS009"),
    ("rust", "unwrap_or(a)", "RS010"),
]


def test_each_fact_rule_finds_its_line_and_leaves_others(texts):
    rows = [(f"hit/{i}", lang, code) for i, (lang, code, _) in enumerate(RULES)]
    rows += [(f"clean/{i}", lang, code) for i, (lang, code, _) in enumerate(CLEAN)]
    found = {}
    for r in scan(texts(*rows), packs=["python", "javascript", "go", "rust"], threshold="info").collect():
        found.setdefault(r.path, set()).add(r.rule_id)
    assert [r for i, r in enumerate(RULES) if r[2] not in found.get(f"hit/{i}", ())] == []
    assert [r for i, r in enumerate(CLEAN) if r[2] in found.get(f"clean/{i}", ())] == []


def test_first_match_wins(texts):
    found = scan(texts(("a", "python", "pickle.eval(x)")), packs=["python"], threshold="info")
    assert {r.rule_id for r in found.collect()} == {"PY001"}


def test_defer_fold_follows_braces(spark):
    code = "defer a()\nfor i := range x {\n  if y {\n    defer b()\n  }\n  func() { defer c() }()\n}\ndefer d()\nfor z {\n}"
    row = spark.createDataFrame([(code,)], "t string").select(defer_in_loop(F.col("t")).alias("d")).first()
    assert [(d.line, d.column_start) for d in row.d] == [(4, 5), (6, 12)]


def test_try_blocks_nest(spark):
    code = ("JSON.parse(a); try { try { x } catch (e) { JSON.parse(b) } if (c) { JSON.parse(d) } } finally { JSON.parse(e) }"
            " '} try {' JSON.parse(f)")
    row = spark.createDataFrame([(code,)], "t string").select(parse_in_try(F.col("t")).alias("p")).first()
    assert row.p == [False, True, True, True, False]


def test_arguments_at_any_depth(texts):
    from scanloom.operators.facts import calls
    from scanloom.operators.scan import scan

    nested = lambda n: "f(" * n + 'x, ")"' + ")" * n
    lines = [f"subprocess.run({nested(n)},\n  [1, (2, [3, [4, [5]]])], shell=True)" for n in range(13)]
    rows = [(f"t{n}", "python", line) for n, line in enumerate(lines)] + [("open", "python", "subprocess.run(f(f(f(f(f(f(x)")]
    found = {r.path: r for r in calls(texts(*rows)).where("func_text = 'subprocess.run'").collect()}
    for n in range(13):
        got = found[f"t{n}"]
        assert got.args == ([nested(n)] if n else ["x", '")"']) + ["[1, (2, [3, [4, [5]]])]", "shell=True"]
        assert [(k.name, k.value) for k in got.kwargs] == [("shell", "True")]
    assert found["open"].args == []
    assert {r.path for r in scan(texts(*rows), packs=["python"]).where("rule_id = 'PY008'").collect()} == {f"t{n}" for n in range(13)}


def test_a_long_line_is_whole(texts):
    from scanloom.operators.facts import assignments
    from scanloom.operators.scan import scan

    long = "let a = 1; " * 700 + "el.innerHTML = b;"
    rows = [("a", "javascript", long), ("b", "python", " " * 2400 + "x = 1")]
    fixed = [r.fixed_code for r in scan(texts(*rows)).where("rule_id = 'JS-INNERHTML-XSS'").collect()]
    assert fixed == [long.replace("innerHTML", "textContent")]
    assert [r.target for r in assignments(texts(*rows)).where("language = 'python'").collect()] == ["x"]
    shown = [r.snippet for r in scan(texts(*rows), width=100).where("rule_id = 'JS-INNERHTML-XSS'").collect()]
    assert len(shown[0]) <= 200 and "innerHTML" in shown[0]
