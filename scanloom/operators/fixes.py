"""Fixed lines that some rules can offer by themselves."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import strip

# The line offered in place of a finding.
WHOLE_LINE = {
    "generic-aws_access_key": "const awsAccessKey = process.env.AWS_ACCESS_KEY_ID;",
    "generic-aws_secret_key": "const awsSecretKey = process.env.AWS_SECRET_ACCESS_KEY;",
    "generic-github_token": "const githubToken = process.env.GITHUB_TOKEN;",
    "generic-slack_token": "const slackToken = process.env.SLACK_TOKEN;",
    "generic-generic_api_key": "const apiKey = process.env.API_KEY;",
    "generic-generic_secret": "const secret = process.env.SECRET;",
    "generic-password_in_code": "const password = process.env.PASSWORD;",
    "generic-jwt_pattern": "const token = process.env.JWT_TOKEN;",
    "generic-basic_auth": "// Remove credentials from URL, use proper authentication",
    "generic-todo_with_sensitive_info": "// TODO: [REMOVED SENSITIVE INFO]",
}
# Text replaced in the finding's line, and its replacement.
REPLACED = {
    "generic-insecure_url": [("http://", "https://")],
    "generic-disable_ssl_verify": [("false", "true")],
    "JS-INNERHTML-XSS": [("innerHTML", "textContent")],
    "JS-INSECURE-RANDOM": [("Math.random()", "crypto.getRandomValues(new Uint32Array(1))[0] / 2**32")],
    "JS-INSECURE-HTTP": [("http://", "https://")],
    "JS-TIMER-WITH-STRING": [("'", "() => "), ('"', "() => ")],
}


def line_fix(rule_id: Column, line: Column) -> Column:
    """The fixed line a rule offers for ``line``, or null."""
    chosen = F.when(F.lit(False), F.lit(None).cast("string"))
    for rule, fixed in WHOLE_LINE.items():
        chosen = chosen.when(rule_id == rule, F.lit(fixed))
    for rule, changes in REPLACED.items():
        fixed = strip(line) if rule.startswith("generic") else line
        for old, new in changes:
            fixed = F.replace(fixed, F.lit(old), F.lit(new))
        chosen = chosen.when(rule_id == rule, fixed)
    name = F.upper(F.regexp_extract(line, r"(\w+)\s*[=:]", 1))
    secret = F.when(name != "", F.concat(F.lit("const "), name, F.lit(" = process.env."), name, F.lit(";")))
    return chosen.when(rule_id == "JS-HARDCODED-SECRET", F.coalesce(secret, strip(line)))


def template_fix(template: Column, matched: Column) -> Column:
    """A rule's own fix, with ``$X`` replaced by the match's argument."""
    return F.replace(template, F.lit("$X"), F.regexp_extract(matched, r"\(([^\s()]*)\)", 1))
