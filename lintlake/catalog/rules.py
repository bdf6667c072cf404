"""One query per rule, run over the whole corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lintlake.catalog.bindings import corpus
from lintlake.catalog.core import query
from lintlake.catalog.rule_sql import line_rule_sql, match_rule_sql
from lintlake.rules.lines import line_issues
from lintlake.rules.matches import match_issues
from lintlake.rules.registry import LINE_RULES, MATCH_RULES
from lintlake.rules.spec import MatchRule

SHOWN = ("project_id", "file_path", "line_start", "col_start", "title", "rule_id", "severity", "confidence", "impact")

# Inventory ids of the rules, in the order of the survey.
RULE_KEYS = {
    "R01": "sec-eval", "R02": "sec-innerhtml", "R03": "sec-hardcoded-secret", "R04": "perf-nested-loop",
    "R05": "bug-loose-equality", "R06": "bug-missing-await", "R07": "smell-todo", "R08": "smell-long-function",
    "R09": "bp-any-type", "R10": "bp-var-declaration", "R11": "bp-empty-catch", "R12": "py-bare-except",
    "R13": "py-mutable-default", "R14": "sec-sql-injection", "R15": "perf-console-log", "R16": "perf-sync-fs",
    "R19": "sql-select-star", "R20": "sql-update-no-where", "R21": "sql-delete-no-where", "R22": "sql-dynamic-sql",
    "R23": "sql-order-no-limit", "R24": "sql-multiple-joins", "R26": "json-trailing-comma", "R27": "yaml-tabs",
    "R28": "yaml-indent", "R29": "yaml-boolean", "R30": "shell-unquoted-var", "R31": "shell-useless-cat",
    "R32": "shell-eval", "R33": "shell-no-shebang", "R34": "docker-latest-tag", "R35": "docker-apt-no-y",
    "R36": "docker-copy-all", "R37": "docker-user-root", "R39": "style-long-line", "R41": "style-console",
    "R42": "style-debugger", "R43": "style-equality", "R44": "style-inequality", "R51": "unreachable",
    "R53": "security-eval", "R54": "security-xss", "R55": "security-secret", "R56": "security-sql",
    "R57": "security-func", "R58": "ts-any", "R59": "ts-as-any", "R60": "ts-non-null", "R61": "ts-return-type",
    "R62": "ts-ignore", "R66": "perf-sync", "R69": "async-promise-executor", "R70": "async-then-catch",
    "R71": "async-floating-promise", "R74": "react-usestate-init",
    "R75": "react-state-mutation", "R76": "react-inline-handler", "R78": "style-empty-catch",
    "R80": "style-no-docs",
}
TAG_RULES = ("style-fixme", "style-todo", "style-hack", "style-xxx")


def show(issues: DataFrame) -> DataFrame:
    return issues.select(*SHOWN)


def _register(key: str, ids) -> None:
    rules = [r for r in MATCH_RULES + LINE_RULES if r.id in ids]
    by_match = isinstance(rules[0], MatchRule)
    sql = "\nUNION ALL\n".join((match_rule_sql if by_match else line_rule_sql)(r) for r in rules)

    @query(f"{key}_{'style_tags' if key == 'R40' else ids[0].replace('-', '_')}", sql)
    def run(t):
        return show((match_issues if by_match else line_issues)(corpus(t), rules))


for _key, _id in RULE_KEYS.items():
    _register(_key, (_id,))
_register("R40", TAG_RULES)
