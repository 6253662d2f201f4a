"""Python, Rust and Go rules.

Fixed values: ids, names, severities, weakness numbers and patterns must equal the
established ones, so that the same lines are found.
"""
from __future__ import annotations

# Words on a line that make a hard-coded secret unlikely.
PYTHON_NO_SECRET = [
    r"password[_-]?field", r"get_password", r"set_password", r"change_password", r"check_password",
    r"encrypt", r"hash", r"placeholder", r"example", r"test", r"mock", r"fake", r"dummy", r"none",
    r"os\.environ", r"getenv", r"config\.get", r"secrets\.get",
]
RUST_NO_SECRET = [
    r"password[_-]?field", r"get_password", r"set_password", r"change_password", r"check_password",
    r"encrypt", r"hash", r"placeholder", r"example", r"test", r"mock", r"fake", r"dummy", r"none",
    r"env::var", r"std::env", r"config",
]

# id, name, severity, weakness, how it is found, CVEs
PYTHON_RULES = [
    ("PY001", "eval-usage", "critical", 95, "fact", ()),
    ("PY002", "exec-usage", "critical", 95, "fact", ()),
    ("PY003", "literal-eval-misuse", "medium", 94, "fact", ()),
    ("PY004", "sql-injection-format", "critical", 89, "line", ()),
    ("PY005", "pickle-deserialization", "critical", 502, "fact", ()),
    ("PY006", "marshal-deserialization", "critical", 502, "fact", ()),
    ("PY007", "yaml-unsafe-load", "critical", 502, "fact", ()),
    ("PY008", "subprocess-shell-true", "critical", 78, "fact", ()),
    ("PY009", "os-system-usage", "high", 78, "line+fact", ()),
    ("PY010", "os-popen-usage", "high", 78, "fact", ()),
    ("PY011", "commands-module-usage", "high", 78, "line", ()),
    ("PY012", "hardcoded-password", "critical", 798, "line", ()),
    ("PY013", "hardcoded-api-key", "critical", 798, "line", ()),
    ("PY014", "debug-mode-enabled", "high", 489, "line", ()),
    ("PY015", "insecure-temp-file", "medium", 377, "fact", ()),
    ("PY016", "path-traversal", "high", 22, "fact", ()),
    ("PY017", "assert-in-production", "medium", 617, "line", ()),
    ("PY018", "insecure-hash-md5", "medium", 327, "fact", ()),
    ("PY019", "insecure-hash-sha1", "medium", 327, "fact", ()),
    ("PY020", "python2-input", "critical", 78, "fact", ()),
    ("PY021", "xxe-vulnerability", "high", 611, "fact", ()),
    ("PY022", "unverified-ssl-context", "high", 295, "fact", ()),
    ("PY023", "urllib-no-verify", "high", 295, "line", ()),
    ("PY024", "hardcoded-jwt-secret", "critical", 798, "line", ()),
    ("PY025", "weak-random-crypto", "medium", 338, "fact", ()),
    ("PY026", "popen2-usage", "high", 78, "line", ()),
    ("PY027", "json-load-without-validation", "low", 20, "fact", ()),
    ("PY028", "yaml-unsafe-deserialization-cve", "critical", 502, "fact", ("CVE-2025-50460", "CVE-2026-24009")),
    ("PY029", "pickle-unsafe-deserialization-cve", "critical", 502, "fact", ("CVE-2025-27520",)),
    ("PY030", "eval-with-user-input-cve", "critical", 95, "fact", ("CVE-2026-0770",)),
    ("PY031", "exec-with-user-input-cve", "critical", 95, "fact", ("CVE-2026-0770",)),
    ("PY032", "flask-template-injection-cve", "high", 94, "", ("CVE-2025-30567",)),
    ("PY033", "jinja2-sandbox-escape-cve", "high", 94, "", ("CVE-2025-27516",)),
    ("PY034", "django-unsafe-query-cve", "critical", 89, "", ("CVE-2025-34211", "CVE-2024-42005", "CVE-2024-53908")),
    ("PY035", "fastapi-ssrf-cve", "high", 918, "", ("CVE-2025-37044",)),
    ("PY036", "requests-ssrf-cve", "high", 918, "", ("CVE-2025-26899",)),
    ("PY037", "pydantic-unsafe-validator-cve", "high", 94, "", ("CVE-2025-21122",)),
    ("PY038", "sqlalchemy-unsafe-query-cve", "high", 89, "", ("CVE-2025-25888",)),
    ("PY039", "torch-compile-unsafe-cve", "critical", 94, "fact", ("CVE-2025-28752",)),
    ("PY040", "transformers-unsafe-pipeline-cve", "critical", 94, "fact", ("CVE-2025-27811",)),
    ("PY041", "numpy-unsafe-array-cve", "high", 119, "fact", ("CVE-2025-23989",)),
    ("PY042", "celery-pickle-task-cve", "high", 502, "fact", ("CVE-2025-36213",)),
    ("PY043", "spacy-llm-template-injection-cve", "critical", 94, "", ("CVE-2025-25362",)),
    ("PY044", "uvicorn-path-traversal-cve", "high", 22, "", ("CVE-2025-35999",)),
    ("PY045", "pillow-heap-overflow-cve", "medium", 119, "", ("CVE-2025-48379",)),
    ("PY046", "cryptography-rsa-side-channel-cve", "medium", 203, "", ("CVE-2025-20001",)),
    ("PY047", "paramiko-mitm-cve", "medium", 295, "", ("CVE-2025-25500",)),
    ("PY048", "tarfile-filter-bypass-cve", "critical", 22, "", ("CVE-2025-4517",)),
]

SQL_WORDS = r"(?i)(SELECT|INSERT|UPDATE|DELETE|DROP|UNION|WHERE|FROM)\s+"
SQL_FORMATTING = r"\.format\(|%s|%d|%\(|f\"|f'|\+|\{\}"
SQL_CONTEXT = r"(?i)query|sql|select|insert|update|delete|execute"
ASSIGNMENT = r"^\s*[\w.\[\]'\"]+\s*(?::[^=]+)?(?:[-+*/%|&^]|//|\*\*|<<|>>)?=(?!=)"

# rule id: (pattern, further patterns the line must hold, guarded)
PYTHON_LINES = {
    "PY004": (SQL_WORDS, (SQL_FORMATTING, SQL_CONTEXT), False),
    "PY009": (r"\bos\.system\s*\(", (), False),
    "PY011": (r"\bcommands\.(getoutput|getstatusoutput)\s*\(", (), False),
    "PY012": (r'(?i)(password|passwd|pwd|secret|token)\s*=\s*["\'][^"\']{4,}["\']', (), True),
    "PY013": (r'(?i)(api[_-]?key|apikey|access[_-]?key)\s*=\s*["\'][^"\']{8,}["\']', (), True),
    "PY014": (r"\b(debug|DEBUG)\s*=\s*True\b", (ASSIGNMENT,), False),
    "PY017": (r"^\s*assert\b", (), False),
    "PY023": (r"(?i)(verify\s*=\s*False|cert_reqs\s*=\s*ssl\.CERT_NONE)", (), False),
    "PY024": (r'(?i)(jwt[_-]?secret|jwt[_-]?key|secret[_-]?key)\s*=\s*["\'][^"\']{8,}["\']', (), True),
    "PY026": (r"\bpopen2\.", (), False),
}

# id, name, severity, weakness, how it is found
RUST_RULES = [
    ("RS001", "unsafe-block-usage", "high", 758, "line"),
    ("RS002", "unsafe-function-usage", "high", 758, "line"),
    ("RS003", "raw-pointer-dereference", "critical", 476, "line"),
    ("RS004", "sql-injection-string-format", "critical", 89, "line"),
    ("RS005", "sql-injection-format-macro", "critical", 89, "line+fact"),
    ("RS006", "command-injection", "critical", 78, "line"),
    ("RS007", "std-process-command-shell", "high", 78, "line"),
    ("RS008", "path-traversal-file-open", "high", 22, "line"),
    ("RS009", "panic-on-user-input", "high", 400, "line+fact"),
    ("RS010", "unwrap-on-result", "medium", 754, "line+fact"),
    ("RS011", "expect-on-result", "medium", 754, "line+fact"),
    ("RS012", "unwrap-on-option", "medium", 754, ""),
    ("RS013", "hardcoded-password", "critical", 798, "line"),
    ("RS014", "hardcoded-api-key", "critical", 798, "line"),
    ("RS015", "insecure-tls-verify-disabled", "high", 295, "line"),
    ("RS016", "weak-random-number-generator", "high", 338, "line"),
    ("RS017", "insecure-hash-md5", "medium", 327, "line"),
    ("RS018", "insecure-hash-sha1", "medium", 327, "line"),
    ("RS019", "deserialization-without-validation", "high", 502, "line"),
    ("RS020", "debug-assertions", "low", 617, "line+fact"),
    ("RS021", "insecure-temporary-file", "medium", 377, ""),
    ("RS022", "dangerous-transmute", "critical", 843, "line+fact"),
    ("RS023", "forget-memory-leak", "medium", 401, "line+fact"),
    ("RS024", "uninitialized-memory", "critical", 457, "line+fact"),
    ("RS025", "drop-unsafe-manually", "high", 415, "line+fact"),
    ("RS026", "ffi-boundary-unsafe", "high", 78, "line"),
    ("RS027", "environment-variable-unsafe", "low", 15, "line"),
    ("RS028", "static-mutable-state", "medium", 362, "line"),
    ("RS029", "tokio-blocking-in-async", "medium", 400, "line"),
    ("RS030", "insecure-ssl-tls-version", "high", 319, "line"),
    ("RS031", "windows-batch-command-injection", "critical", 78, ""),
    ("RS032", "deeply-nested-json-deserialization", "high", 674, ""),
    ("RS033", "unmaintained-unsound-yaml", "medium", 1104, ""),
    ("RS034", "sqlx-binary-protocol-misinterpretation", "high", 681, ""),
    ("RS035", "typosquatted-dependency", "critical", 829, ""),
    ("RS036", "malicious-crate-usage", "critical", 506, ""),
    ("RS037", "build-script-command-execution", "high", 78, ""),
    ("RS038", "proc-macro-code-execution", "high", 94, ""),
    ("RS039", "open-redirect-vulnerability", "medium", 601, ""),
    ("RS040", "format-injection", "medium", 134, ""),
    ("RS041", "xss-via-html-escape", "high", 79, ""),
    ("RS042", "ssrf-vulnerability", "high", 918, ""),
    ("RS043", "jwt-validation-bypass", "critical", 287, ""),
    ("RS044", "toctou-race-condition", "medium", 367, ""),
    ("RS045", "signal-handler-safety", "high", 828, ""),
    ("RS046", "lazy-static-mutable", "medium", 362, ""),
    ("RS047", "idna-punycode-spoofing", "high", 838, ""),
    ("RS048", "axum-dos-extractor", "medium", 400, ""),
    ("RS049", "tonic-grpc-misconfiguration", "medium", 400, ""),
    ("RS050", "cors-misconfiguration", "medium", 942, ""),
]

# rule id: (pattern, case ignored, guarded)
RUST_LINES = {
    "RS001": (r"\bunsafe\s*\{", False, False),
    "RS002": (r"\bunsafe\s+(?:fn|impl|trait)", False, False),
    "RS003": (r"\*\s*(?:const|mut)\s+\w+", False, False),
    "RS004": (r"(?:Query|query|execute|exec).*?\+.*?['\"].*?(?:SELECT|INSERT|UPDATE|DELETE)", True, False),
    "RS005": (r"(?:format!|format_args!)\s*\(\s*['\"].*?(?:SELECT|INSERT|UPDATE|DELETE|DROP)", True, False),
    "RS006": (r"(?:Command::new|Command::arg)\s*\(\s*(?:user|input|req|request|data)", True, False),
    "RS007": (r"(?:Command::new|std::process::Command::new)\s*\(\s*['\"]sh['\"]", False, False),
    "RS008": (r"(?:File::open|std::fs::File::open|read_to_string|write)\s*\([^)]*(?:user|input|req|request)", True, False),
    "RS009": (r"panic!\s*\([^)]*(?:user|input|data)", True, False),
    "RS010": (r"\.unwrap\s*\(\s*\)", False, False),
    "RS011": (r"\.expect\s*\(", False, False),
    "RS013": (r"(?:password|passwd|pwd|secret)\s*[=:]\s*['\"][^'\"]{4,}['\"]", True, True),
    "RS014": (r"(?:api[_-]?key|apikey|access[_-]?key)\s*[=:]\s*['\"][^'\"]{8,}['\"]", True, True),
    "RS015": (r"danger_accept_invalid_certs\s*[=:]\s*true|danger_accept_invalid_hostnames\s*[=:]\s*true", False, False),
    "RS016": (r"rand::(?:random|thread_rng)\s*\(\s*\)", False, False),
    "RS017": (r"(?:md5::|Md5::|md5_)", True, False),
    "RS018": (r"(?:sha1::|Sha1::|sha1_)", True, False),
    "RS019": (r"(?:serde_json::from_str|serde::Deserialize).*?(?:user|input|req|request|data)", True, False),
    "RS020": (r"\bdebug_assert(?:_eq|_ne)?!", False, False),
    "RS022": (r"\bstd::mem::transmute\s*\(|\bmem::transmute\s*\(", False, False),
    "RS023": (r"\bstd::mem::forget\s*\(|\bmem::forget\s*\(", False, False),
    "RS024": (r"\bstd::mem::uninitialized\s*\(|\bmem::uninitialized\s*\(|MaybeUninit::uninit\(\)\.assume_init", False, False),
    "RS025": (r"\bstd::ptr::drop_in_place\s*\(|\bptr::drop_in_place\s*\(", False, False),
    "RS026": (r"\bextern\s+['\"](?:C|system)['\"]|#\[link\(|std::ffi::", False, False),
    "RS027": (r"\bstd::env::var|env::var|std::env::var_os", False, False),
    "RS028": (r"\bstatic\s+mut\s+", False, False),
    "RS029": (r"(?:std::thread::sleep|std::fs::|File::open|TcpStream::connect).*?\.await", False, False),
    "RS030": (r"(?:SslMethod::ssl|SslMethod::tls|TlsVersion::TLSv1_0|TlsVersion::TLSv1_1)", False, False),
}

# id, severity, weakness, pattern; whole text, case ignored, ^ and $ at line ends
GO_RULES = [
    ("go-sql-injection-fmt", "critical", 89, r"(?:Query|Exec|QueryRow|Prepare)\s*\(\s*fmt\.Sprintf"),
    ("go-sql-injection-concat", "critical", 89, r'(?:Query|Exec|QueryRow|Prepare)\s*\(\s*["`]SELECT.*\+'),
    ("go-sql-injection-format", "critical", 89, r'(?:Query|Exec|QueryRow|Prepare)\s*\(\s*["`].*?%s'),
    ("go-sql-injection-var-concat", "critical", 89, r"(?:Query|Exec|QueryRow|Prepare)\s*\(\s*\w+\s*\+"),
    ("go-exec-shell", "critical", 78, r'exec\.Command(?:Context)?\s*\(\s*[^)]*["\']\s*sh\s*["\']\s*,\s*["\']-c["\']'),
    ("go-exec-concat", "critical", 78, r"exec\.Command(?:Context)?\s*\([^)]*\+"),
    ("go-exec-user-input", "critical", 78, r"exec\.Command(?:Context)?\s*\(\s*(?:r\.(?:FormValue|URL\.Query\(\)\.Get|PostFormValue)|req\.(?:FormValue|PostFormValue)|request\.(?:FormValue|PostFormValue))"),
    ("go-insecure-tls", "high", 295, r"InsecureSkipVerify\s*:\s*true"),
    ("go-weak-random", "high", 338, r"\brand\.(?:Int|Intn|Int63|Int31|Float64|Float32)\s*\("),
    ("go-predictable-random", "medium", 338, r"\brand\.Seed\s*\("),
    ("go-path-traversal-servefile", "high", 22, r"http\.ServeFile\s*\([^)]*(?:r\.(?:FormValue|URL\.Query)|req\.(?:FormValue|URL\.Query)|request\.(?:FormValue|URL\.Query))"),
    ("go-path-traversal-servefile-var", "medium", 22, r"http\.ServeFile\s*\([^,]+,\s*[^,]+,\s*\w+"),
    ("go-weak-crypto-md5", "medium", 327, r"(?:md5|MD5)\.(?:New|Sum|SumString)"),
    ("go-weak-crypto-sha1", "medium", 327, r"(?:sha1|SHA1)\.(?:New|Sum)"),
    ("go-weak-crypto-des", "high", 327, r"(?:des|DES)\.(?:NewCipher|NewTripleDESCipher)"),
    ("go-weak-crypto-rc4", "high", 327, r"(?:rc4|RC4)\.(?:NewCipher|Cipher)"),
    ("go-xss-template-html", "critical", 79, r"template\.HTML\s*\(\s*(?:r\.|req\.|request\.|input|user|data)"),
    ("go-xss-template-html-usage", "high", 79, r"template\.HTML\s*\("),
    ("go-insecure-permissions-777", "medium", 732, r"(?:os\.Chmod|os\.Mkdir(?:All)?|os\.OpenFile)\s*\([^,]+,\s*[^,]*0?777"),
    ("go-insecure-permissions-666", "low", 732, r"(?:os\.Chmod|os\.OpenFile)\s*\([^,]+,\s*[^,]*0?666"),
    ("go-json-unvalidated", "medium", 502, r"json\.Unmarshal\s*\([^,]+,\s*&"),
    ("go-insecure-http", "medium", 319, r'http\.ListenAndServe\s*\(\s*["\'][^"\']*["\']\s*,\s*[^)]+\)'),
    ("go-unsafe-pointer", "medium", 466, r"unsafe\.Pointer\s*\("),
    ("go-unsafe-slice", "medium", 466, r"unsafe\.Slice\s*\("),
    ("go-bind-all-interfaces", "low", 1327, r'(?:Listen|ListenTCP|ListenAndServe)\s*\(\s*["\']tcp["\']?\s*,\s*["\']:\d+'),
    ("go-unchecked-error", "low", 391, r"^\s+(?:db|rows|stmt)\.(?:Query|Exec|Prepare)\s*\([^)]+\)\s*$"),
    ("go-insecure-http-get", "medium", 319, r'http\.Get\s*\(\s*["\']http://'),
    ("go-insecure-temp-file", "medium", 377, r"ioutil\.TempFile\s*\("),
    ("go-path-traversal-file", "high", 22, r"(?:os\.Open|ioutil\.ReadFile|os\.ReadFile)\s*\([^)]*(?:\+|fmt\.Sprintf)"),
    ("go-syscall-exec", "high", 78, r"syscall\.Exec\s*\("),
]

# id, severity, pattern, mask; whole text, case ignored
GO_SECRETS = [
    ("go-hardcoded-api-key", "high", r'(?:api[_-]?key|apiKey|API_KEY)\s*[:=]\s*["`]([a-zA-Z0-9_\-]{16,})["`]', "backquote"),
    ("go-hardcoded-password", "critical", r'(?:password|passwd|pwd|Password|PASSWORD)\s*[:=]\s*["`]([^"`]{3,})["`]', "backquote"),
    ("go-hardcoded-secret", "high", r'(?:secret|Secret|SECRET|token|Token|TOKEN)\s*[:=]\s*["`]([a-zA-Z0-9_\-\.]{16,})["`]', "backquote"),
    ("go-hardcoded-private-key", "critical", r'(?:private[_-]?key|privateKey|PRIVATE_KEY)\s*[:=]\s*["`]([^"`]{20,})["`]', "backquote"),
    ("go-openai-api-key", "high", r"sk-[a-zA-Z0-]{20,}", "backquote"),
    ("go-github-token", "high", r"gh[pousr]_[a-zA-Z0-9]{36,}", "backquote"),
    ("go-aws-access-key", "high", r"AKIA[0-9A-Z]{16}", "backquote"),
    ("go-potential-secret", "low", r'["\']?[a-f0-9]{32}["\']?', "backquote"),
    ("go-hardcoded-db-conn", "critical", r'["`](?:postgres|mysql|mongodb|redis)://[^:]+:[^@]+@[^"`]+["`]', "dsn"),
    ("go-hardcoded-conn-string", "critical", r'(?:connection[_-]?string|conn[_-]?str|dsn)\s*[:=]\s*["`][^"`]*password=[^"`&]+["`]', "dsn"),
    ("go-hardcoded-mysql-dsn", "critical", r'dsn\s*:=\s*["`][^"`]*:[^"`]*@tcp\(', "dsn"),
]
