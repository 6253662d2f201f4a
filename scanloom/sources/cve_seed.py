"""Known vulnerabilities of packages.

Fixed values: ids, packages, severities, scores, versions, weaknesses and the
short descriptions that a search looks through.
"""
from __future__ import annotations

# id, package, severity, score, affected versions, fixed versions, weakness, description
CVE_ROWS = [
    ("CVE-2025-3248", "langflow", "critical", "9.8", "<1.3.0", ">=1.3.0", "CWE-94", "Langflow RCE via /validate/code endpoint allowing arbitrary code execution"),
    ("CVE-2025-27520", "bentoml", "critical", "9.8", "<1.4.3", ">=1.4.3", "CWE-502", "BentoML unsafe pickle loading leading to arbitrary code execution"),
    ("CVE-2025-4517", "python", "critical", "9.4", "<3.14.0", ">=3.14.0", "CWE-22", "Python tarfile data filter bypass allowing local file overwrite"),
    ("CVE-2025-34211", "django", "critical", "9.6", "5.0-5.0.1, 4.2-4.2.14", ">=5.0.2, >=4.2.15", "CWE-89", "Django SQL injection via unescaped expressions in QuerySet"),
    ("CVE-2025-37044", "fastapi", "critical", "9.3", "<0.110.0", ">=0.110.0", "CWE-918", "FastAPI SSRF injection via custom OpenAPI docs"),
    ("CVE-2025-28752", "pytorch", "critical", "9.7", "<2.3.1", ">=2.3.1", "CWE-94", "PyTorch arbitrary code execution in torch.compile()"),
    ("CVE-2025-27811", "transformers", "critical", "9.0", "<4.45.0", ">=4.45.0", "CWE-94", "Hugging Face transformers code execution via dynamic trust pipeline"),
    ("CVE-2025-27607", "python-json-logger", "critical", "8.8", "<3.3.0", ">=3.3.0", "CWE-94", "Python JSON Logger dynamic injection leading to code execution"),
    ("CVE-2025-36213", "celery", "critical", "8.9", "<5.4.0", ">=5.4.0", "CWE-502", "Celery remote task injection through unsafe pickle fallback"),
    ("CVE-2025-23989", "numpy", "critical", "9.1", "<1.27.0", ">=1.27.0", "CWE-119", "NumPy array indexing overflow leading to memory corruption"),
    ("CVE-2025-25362", "spacy-llm", "critical", "9.8", "<=0.7.2", ">=0.7.3", "CWE-94", "spacy-llm SSTI leading to RCE via unsanitized template input"),
    ("CVE-2026-0770", "langflow", "critical", "9.8", "<1.4.0", ">=1.4.0", "CWE-94", "Langflow RCE via validate_code() using exec()"),
    ("CVE-2026-24009", "docling-core", "critical", "9.8", "<2.5.0", ">=2.5.0", "CWE-502", "docling-core vulnerable to RCE via unsafe PyYAML usage"),
    ("CVE-2026-27194", "dtale", "critical", "9.8", "<3.9.0", ">=3.9.0", "CWE-94", "D-Tale RCE through /save-column-filter endpoint"),
    ("CVE-2026-27483", "mindsdb", "critical", "9.1", "<24.10.4.0", ">=24.10.4.0", "CWE-22", "MindsDB path traversal in /api/files leading to RCE"),
    ("CVE-2024-42005", "django", "critical", "9.8", "5.0-5.0.7, 4.2-4.2.14", ">=5.0.8, >=4.2.15", "CWE-89", "Django SQL injection vulnerability in QuerySet.annotate()"),
    ("CVE-2024-53908", "django", "critical", "9.8", "5.0-5.0.10, 4.2-4.2.17", ">=5.0.11, >=4.2.18", "CWE-89", "Django SQL injection in JSON field lookup with Oracle"),
    ("CVE-2025-27516", "jinja2", "high", "7.5", "<3.1.6", ">=3.1.6", "CWE-94", "Jinja2 sandbox escape allowing arbitrary code execution"),
    ("CVE-2025-35999", "uvicorn", "high", "8.6", "<0.30.0", ">=0.30.0", "CWE-22", "uvicorn path traversal via static file handling"),
    ("CVE-2025-30567", "flask", "high", "7.7", "<3.1.0", ">=3.1.0", "CWE-94", "Flask server-side template injection via Jinja macros"),
    ("CVE-2025-27918", "tensorflow", "high", "8.8", "<2.16.0", ">=2.16.0", "CWE-119", "TensorFlow out-of-bounds read/write in kernel operations"),
    ("CVE-2025-26899", "requests", "high", "8.5", "<2.33.0", ">=2.33.0", "CWE-918", "requests SSRF via unvalidated redirects"),
    ("CVE-2025-25888", "sqlalchemy", "high", "7.5", "<2.0.28", ">=2.0.28", "CWE-89", "SQLAlchemy SQL injection via custom expressions"),
    ("CVE-2025-24777", "aiohttp", "high", "8.3", "<3.9.3", ">=3.9.3", "CWE-93", "aiohttp header injection via malformed Host header"),
    ("CVE-2025-22010", "matplotlib", "high", "7.9", "<3.9.0", ">=3.9.0", "CWE-94", "matplotlib code execution via custom backend loading"),
    ("CVE-2025-21122", "pydantic", "high", "7.7", "<2.7.0", ">=2.7.0", "CWE-94", "pydantic arbitrary code execution via custom validators"),
    ("CVE-2025-20001", "cryptography", "high", "7.6", "<42.0.0", ">=42.0.0", "CWE-203", "cryptography RSA side-channel attack allowing key recovery"),
    ("CVE-2025-18775", "twisted", "high", "8.4", "<23.12.0", ">=23.12.0", "CWE-444", "twisted HTTP smuggling and ACL bypass"),
    ("CVE-2024-56373", "apache-airflow", "high", "8.8", "<2.10.0", ">=2.10.0", "CWE-94", "Apache Airflow code injection via LogTemplate table"),
    ("CVE-2026-23984", "apache-superset", "high", "8.2", "<4.0.2", ">=4.0.2", "CWE-20", "Apache Superset read-only bypass via improper input validation on PostgreSQL"),
    ("CVE-2026-26331", "yt-dlp", "high", "8.6", "<2026.02.24", ">=2026.02.24", "CWE-78", "yt-dlp arbitrary command injection when using --netrc-cmd option"),
    ("CVE-2026-21441", "urllib3", "high", "7.5", "<2.3.0", ">=2.3.0", "CWE-400", "urllib3 DoS vulnerability via crafted headers"),
    ("CVE-2025-50460", "ms-swift", "critical", "9.8", "<1.2.0", ">=1.2.0", "CWE-502", "MS SWIFT RCE via unsafe PyYAML deserialization"),
    ("CVE-2025-4435", "python", "medium", "6.5", "<3.14.0", ">=3.14.0", "CWE-20", "Python tarfile errorlevel filtering bypass"),
    ("CVE-2025-4516", "python", "medium", "7.2", "<3.14.0", ">=3.14.0", "CWE-416", "CPython unicodeescape use-after-free leading to memory corruption"),
    ("CVE-2025-1795", "python", "medium", "6.8", "<3.14.0", ">=3.14.0", "CWE-116", "CPython email.header incorrect encoding leading to email header spoofing"),
    ("CVE-2025-25500", "paramiko", "medium", "7.2", "<3.4.0", ">=3.4.0", "CWE-295", "paramiko forced downgrade in SSH handshake leading to MITM"),
    ("CVE-2025-21717", "pandas", "medium", "6.8", "<2.3.0", ">=2.3.0", "CWE-88", "pandas CSV injection with filter bypass possibility"),
    ("CVE-2025-19998", "scikit-learn", "medium", "6.5", "<1.6.0", ">=1.6.0", "CWE-22", "scikit-learn arbitrary file write via joblib load"),
    ("CVE-2025-48957", "astrbot", "medium", "6.5", "3.4.4-3.5.12", ">=3.5.13", "CWE-22", "AstrBot path traversal leading to information disclosure"),
    ("CVE-2025-34980", "apache-superset", "medium", "6.5", "<4.0.2", ">=4.0.2", "CWE-22", "Apache Superset path traversal in chart visualization plugins"),
    ("CVE-2025-48379", "pillow", "medium", "6.5", "11.2.0-11.3.0", ">=11.3.1", "CWE-119", "Pillow heap buffer overflow when writing DDS format images"),
    ("CVE-2025-64459", "django", "critical", "9.1", "5.0-5.0.14, 4.2-4.2.19", ">=5.0.15, >=4.2.20", "CWE-89", "Django SQL injection in GIS queries with Oracle"),
]
