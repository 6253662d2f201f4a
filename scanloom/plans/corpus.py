"""Source files derived from the ``orders`` table, for queries and benches.

Each order becomes one file of ten lines in one of seven languages.  Which lines
it holds follows from the order's key, customer and price; the same rule is
written once for Spark and once for DuckDB.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import by_key

LINES_PER_FILE = 10

# Per language: extension and the lines to choose from.  {k} is the order's key.
TEMPLATES = {
    "python": (".py", [
        "import os, pickle, yaml, hashlib",
        "value = eval(user_input)",
        "exec(code)",
        "data = pickle.loads(blob)",
        "conf = yaml.load(stream)",
        "os.system('ls ' + path)",
        'password = "hunter{k}secret"',
        'api_key = "abcd1234efgh{k}"',
        'cursor.execute("SELECT * FROM t WHERE id = %s" % item)',
        "subprocess.run(cmd, shell=True)",
        "app.run(debug=True)",
        "DEBUG = True",
        "digest = hashlib.md5(payload).hexdigest()",
        "total = price * {k}  # plain arithmetic",
        "    assert total > 0",
        'test_password = "example{k}"',
        "result = safe_call(request.args, np.array(user_rows))",
        "requests.get(url, verify=False)",
        "# eval(comment) and password notes",
        'note = "eval(inside_text)"',
    ]),
    "javascript": (".js", [
        "const out = eval(input);",
        "el.innerHTML = name;",
        "el.innerHTML = 'fixed';",
        "document.write(data)",
        "const r = Math.random() * {k};",
        "setTimeout('run()', {k});",
        "child.exec('ls ' + dir);",
        "db.query(`SELECT * FROM t WHERE id = ${id}`);",
        "const cfg = JSON.parse(body);",
        "try { use(JSON.parse(body)); } catch (e) { log(e); }",
        "obj['__proto__'] = other;",
        "res.redirect(`${target}`);",
        "fetch(req.query.url);",
        "const apiKey = 'abcdefghij{k}klmnop';",
        "const url = 'http://example{k}.org/a';",
        "// nothing to see in line {k}",
        "fs.readFile('../data/' + name, done);",
        "window.addEventListener('message', take);",
    ]),
    "go": (".go", [
        'rows, err := db.Query(fmt.Sprintf("SELECT %d", {k}))',
        'cmd := exec.Command("sh", "-c", "ls " + dir)',
        "cfg := &tls.Config{InsecureSkipVerify: true}",
        "n := rand.Intn({k})",
        "sum := md5.Sum(data)",
        "\tdefer f.Close()",
        "for i := 0; i < {k}; i++ {",
        "}",
        "p := unsafe.Pointer(&x)",
        'password := "letmein{k}"',
        'http.ListenAndServe(":8080", nil)',
        'os.MkdirAll(dir, 0777)',
        'dsn := "postgres://app:pw{k}@db/main"',
        "// plain comment {k}",
        'json.Unmarshal(raw, &out)',
    ]),
    "rust": (".rs", [
        "let v = items.get({k}).unwrap();",
        'let f = File::open(user_path).expect("no file");',
        "unsafe { *ptr = {k}; }",
        "static mut COUNT: u32 = {k};",
        'let q = format!("SELECT * FROM t WHERE id = {}", user);',
        'let password = "correct-horse-{k}";',
        "let x = std::mem::transmute(y);",
        'panic!("bad input {}", input);',
        'Command::new("sh").arg("-c");',
        "let n: u32 = rand::random();",
        "// plain comment {k}",
        "let digest = md5::compute(data);",
    ]),
    "java": (".java", [
        'ResultSet rs = st.executeQuery(sql + name);',
        'Cipher c = Cipher.getInstance("DES");',
        "Object o = in.readObject();",
        "File f = new File(path);",
        "int n = {k};",
        "ObjectInputStream in = open();",
    ]),
    "ruby": (".rb", [
        "eval(code)",
        "obj.send(name)",
        'User.where("#{cond}")',
        "total = {k}",
        "klass.class_eval(body)",
    ]),
    "php": (".php", [
        "echo $_GET['q'];",
        "include($page);",
        "mysqli_query($db, $sql);",
        "eval($code);",
        "$n = {k};",
        "require_once($file);",
    ]),
}
LANGUAGES = list(TEMPLATES)


def _steps(position: int) -> tuple[int, int]:
    return 2 * position + 1, position + 3


def code_files(orders: DataFrame, *keep: str) -> DataFrame:
    """path, language, text, o_orderkey of one file per order, and the columns to ``keep``.

    An order is some bytes, its file and findings are many hundreds: the orders are dealt over all cores by path before the
    texts are made. Findings of a file, its patches and its text then meet in one task without being sent.
    """
    pick = F.pmod(F.col("o_orderkey") + F.col("o_custkey"), F.lit(len(LANGUAGES)))
    extension = F.lit(None)
    for i, name in enumerate(LANGUAGES):
        extension = F.when(pick == i, F.lit(TEMPLATES[name][0])).otherwise(extension)
    path = F.concat(F.lit("proj"), F.pmod("o_custkey", F.lit(20)), F.lit("/src/f"), F.col("o_orderkey"), extension)
    dealt = by_key(orders.select(path.alias("path"), "o_orderkey", "o_custkey", *keep), "path")
    language, text = F.lit(None), F.lit(None)
    for i, name in enumerate(LANGUAGES):
        lines = TEMPLATES[name][1]
        choices = F.array(*[F.lit(line) for line in lines])
        chosen = []
        for position in range(LINES_PER_FILE):
            a, b = _steps(position)
            index = F.pmod(F.col("o_orderkey") * a + F.col("o_custkey") * b + position, F.lit(len(lines)))
            chosen.append(F.element_at(choices, index.cast("int") + 1))
        body = F.replace(F.concat_ws("\n", *chosen), F.lit("{k}"), F.col("o_orderkey").cast("string"))
        language = F.when(pick == i, F.lit(name)).otherwise(language)
        text = F.when(pick == i, body).otherwise(text)
    return dealt.select("path", language.alias("language"), text.alias("text"), "o_orderkey", *keep)


# --- the same for DuckDB -----------------------------------------------------

def quote(text: str) -> str:
    """A DuckDB string literal; tabs and newlines by chr()."""
    parts = text.replace("'", "''")
    for char in "\t\n\x01\x02":
        parts = parts.replace(char, f"' || chr({ord(char)}) || '")
    return f"('{parts}')" if "chr(" in parts else f"'{parts}'"


def files_sql() -> str:
    """CTEs ``files`` (path, language, text, o_orderkey) and ``lines`` (and line, t)."""
    cases, exts, names = [], [], []
    for i, name in enumerate(LANGUAGES):
        ext, lines = TEMPLATES[name]
        listed = "[" + ", ".join(quote(line) for line in lines) + "]"
        chosen = []
        for position in range(LINES_PER_FILE):
            a, b = _steps(position)
            chosen.append(f"({listed})[(o_orderkey * {a} + o_custkey * {b} + {position}) % {len(lines)} + 1]")
        cases.append(f"WHEN {i} THEN replace(concat_ws(chr(10), {', '.join(chosen)}), '{{k}}', o_orderkey::VARCHAR)")
        exts.append(f"WHEN {i} THEN '{ext}'")
        names.append(f"WHEN {i} THEN '{name}'")
    pick = f"CASE (o_orderkey + o_custkey) % {len(LANGUAGES)} "
    return f"""files AS MATERIALIZED (
  SELECT 'proj' || (o_custkey % 20) || '/src/f' || o_orderkey || {pick}{' '.join(exts)} END AS path,
         {pick}{' '.join(names)} END AS language, {pick}{' '.join(cases)} END AS text, o_orderkey
  FROM orders),
lines AS MATERIALIZED (
  SELECT path, language, unnest(string_split(text, chr(10))) AS t,
         unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line
  FROM files)"""
