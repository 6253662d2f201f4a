"""Rules written as code with wildcards, for seven languages.

Fixed values: ids, severities, weakness numbers and patterns must equal the
established ones, so that the same lines are found.  In a pattern ``$X`` and
``$Y`` stand for any run of characters without blanks and round brackets;
everything else is literal, ``...`` and ``$Z`` too.
"""
from __future__ import annotations

# id, language, severity, weakness, fix, patterns
PATTERN_RULES = [
    ("js-eval-usage", "javascript", "critical", 95, None, ["eval($X)", "new Function($X)"]),
    ("js-dangerous-innerHTML", "javascript", "high", 79, None, ["$X.innerHTML = $Y", "$X.outerHTML = $Y"]),
    ("js-dangerous-document-write", "javascript", "high", 79, None, ["document.write($X)", "document.writeln($X)"]),
    ("js-unsanitized-input", "javascript", "high", 20, None,
     ["req.query[$X]", "req.body[$X]", "req.params[$X]", "window.location.hash"]),
    ("js-insecure-random", "javascript", "medium", 338, None, ["Math.random()"]),
    ("js-disabled-security", "javascript", "high", 693, None,
     ["rejectUnauthorized: false", "NODE_TLS_REJECT_UNAUTHORIZED: '0'", 'NODE_TLS_REJECT_UNAUTHORIZED: "0"']),
    ("js-prototype-pollution", "javascript", "critical", 1321, None, ["$X[$Y] = $Z", "Object.assign($X, $Y)"]),
    ("js-child-process", "javascript", "high", 78, None, ["exec($X)", "execSync($X)", "child_process.exec($X)"]),
    ("py-sql-injection", "python", "critical", 89, None,
     ['cursor.execute(f"...")', 'cursor.execute("..." % $X)', 'cursor.execute("...".format($X))',
      'execute(f"...")', 'execute("..." % $X)', 'execute("...".format($X))']),
    ("py-exec-usage", "python", "critical", 95, None, ["exec($X)"]),
    ("py-eval-usage", "python", "critical", 95, "ast.literal_eval($X)", ["eval($X)"]),
    ("py-pickle-load", "python", "critical", 502, None,
     ["pickle.load($X)", "pickle.loads($X)", "cPickle.load($X)", "cPickle.loads($X)"]),
    ("py-subprocess-shell", "python", "high", 78, None,
     ["subprocess.call($X, shell=True)", "subprocess.run($X, shell=True)", "subprocess.Popen($X, shell=True)",
      "call($X, shell=True)", "run($X, shell=True)", "Popen($X, shell=True)"]),
    ("py-hardcoded-temp", "python", "medium", 377, None, ['open("/tmp/...")', "open('/tmp/...')"]),
    ("py-insecure-hash", "python", "medium", 328, "hashlib.sha256($X)",
     ["hashlib.md5()", "hashlib.sha1()", "md5($X)", "sha1($X)"]),
    ("py-yaml-load", "python", "critical", 502, "yaml.safe_load($X)", ["yaml.load($X)", "yaml.unsafe_load($X)"]),
    ("py-django-raw-sql", "python", "high", 89, None, ["raw($X)", 'raw("..." % $X)', 'raw(f"...")']),
    ("py-flask-debug", "python", "high", 489, None, ["debug=True", "app.run(debug=True)"]),
    ("go-sql-injection", "go", "critical", 89, None,
     ["db.Query(fmt.Sprintf(...))", "db.Exec(fmt.Sprintf(...))", 'db.Query("..." + $X)', 'db.Exec("..." + $X)']),
    ("go-insecure-tls", "go", "high", 295, None, ["InsecureSkipVerify"]),
    ("go-command-injection", "go", "critical", 78, None,
     ['exec.Command("/bin/sh", "-c", $X)', 'exec.Command("bash", "-c", $X)', 'exec.Command("cmd", "/C", $X)']),
    ("go-race-condition", "go", "medium", 362, None, ["go func() { $X }()"]),
    ("go-defer-in-loop", "go", "low", 772, None, ["for $X { defer $Y }"]),
    ("go-weak-rand", "go", "medium", 338, None, ["math/rand", "rand.Int()", "rand.Seed()"]),
    ("java-sql-injection", "java", "critical", 89, None,
     ["executeQuery($X + $Y)", "executeUpdate($X + $Y)", "prepareStatement($X + $Y)"]),
    ("java-xss-scriptlet", "java", "high", 79, None, ["<%= $X %>", "<%=request.getParameter($X)%>"]),
    ("java-deserialization", "java", "critical", 502, None, ["ObjectInputStream", "readObject()"]),
    ("java-weak-crypto", "java", "high", 327, None, ["DES", "DESede", "RC4", "AES/ECB"]),
    ("java-path-traversal", "java", "high", 22, None, ["new File($X)", "new FileInputStream($X)"]),
    ("ruby-eval-usage", "ruby", "critical", 95, None, ["eval($X)", "instance_eval($X)", "class_eval($X)"]),
    ("ruby-sql-injection", "ruby", "critical", 89, None, ['execute("#{$X}")', 'where("#{$X}")']),
    ("ruby-send-usage", "ruby", "medium", 94, None, ["send($X)", "__send__($X)", "public_send($X)"]),
    ("php-eval-usage", "php", "critical", 95, None, ["eval($X)"]),
    ("php-sql-injection", "php", "critical", 89, None,
     ["mysql_query($X . $Y)", "mysqli_query($X, $Y)", "query($X . $Y)"]),
    ("php-xss-echo", "php", "high", 79, None,
     ["echo $_GET[$X]", "echo $_POST[$X]", "echo $_REQUEST[$X]",
      "print $_GET[$X]", "print $_POST[$X]", "print $_REQUEST[$X]"]),
    ("php-file-inclusion", "php", "critical", 98, None,
     ["include($X)", "include_once($X)", "require($X)", "require_once($X)"]),
]
