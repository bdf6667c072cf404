"""The built-in rules. Titles, severities, confidences and patterns are fixed values."""

from __future__ import annotations

from lintlake.rules.spec import JS, REACT, TS, WEB_JS, WEB_PY, LineRule, MatchRule, word_without

# Statements that a missing await is not looked for in.
KEYWORD_STARTS = ("return", "await", "const", "let", "var", "if", "for", "while")

# ---------------------------------------------------------------- whole-content registry
WEB_MATCH_RULES = (
    MatchRule(
        "sec-eval", "Use of eval()", "security", "CRITICAL", 95,
        "eval() runs text as code; parse data or sandbox it instead.",
        impact=90, profile="web", exts=WEB_JS, pattern=r"\beval\s*\(",
    ),
    MatchRule(
        "sec-innerhtml", "Unsafe innerHTML assignment", "security", "MAJOR", 85,
        "Markup assigned unsanitised can carry scripts; assign text or sanitise.",
        impact=80, profile="web", exts=WEB_JS, pattern=r"\.innerHTML\s*=",
    ),
    MatchRule(
        "sec-hardcoded-secret", "Possible hardcoded secret", "security", "BLOCKER", 75,
        "A credential looks embedded in the source; keep it in a secret store.",
        impact=95, profile="web",
        pattern=r"""(?i)(?:password|secret|api_key|apikey|token|auth)\s*[:=]\s*['"][^'"\n]{8,64}['"]""",
    ),
    MatchRule(
        "perf-nested-loop", "Deeply nested loops (O(n^3+) complexity)", "performance", "MAJOR", 80,
        "Three loops inside each other cost cubic time; index the data first.",
        impact=75, profile="web",
        pattern=r"for\s*\(.*?\)\s*\{[\s\S]{0,500}for\s*\(.*?\)\s*\{[\s\S]{0,500}for\s*\(.*?\)\s*\{",
    ),
    MatchRule(
        "bug-loose-equality", "Use of loose equality (== or !=)", "bug", "MINOR", 85,
        "Loose comparison converts types silently; compare strictly.",
        impact=40, profile="web", exts=WEB_JS, pattern=r"[^=!<>]==[^=]|[^!]=!=[^=]",
    ),
    MatchRule(
        "bug-missing-await", "Possible missing await", "bug", "MAJOR", 30,
        "A call that may return a promise stands alone as a statement.",
        impact=60, profile="web", exts=WEB_JS,
        pattern=rf"(?m)(?:^|;|\{{)\s*{word_without(KEYWORD_STARTS)}\.\w+\([^)]*\)\s*;",
    ),
    MatchRule(
        "smell-todo", "TODO/FIXME/HACK comment found", "code-smell", "INFO", 95,
        "A marker comment points at unfinished work.",
        impact=20, profile="web", pattern=r"(?i)//\s*(TODO|FIXME|HACK|XXX|TEMP)\b",
    ),
    MatchRule(
        "smell-long-function", "Function exceeds 50 lines", "maintainability", "MAJOR", 70,
        "Marks every function start; the span rule measures the length.",
        impact=50, profile="web",
        pattern=r"(?:function\s+\w+|(?:const|let|var)\s+\w+\s*=\s*(?:async\s+)?(?:function|\([^)]*\)\s*=>))",
    ),
    MatchRule(
        "bp-any-type", "Use of 'any' type", "best-practice", "MINOR", 90,
        "'any' switches type checking off; name the type.",
        impact=40, profile="web", exts=TS, pattern=r":\s*any\b",
    ),
    MatchRule(
        "bp-var-declaration", "Use of 'var' declaration", "best-practice", "MINOR", 95,
        "'var' is hoisted to the function; use block-scoped declarations.",
        impact=35, profile="web", exts=WEB_JS, pattern=r"\bvar\s+\w",
    ),
    MatchRule(
        "bp-empty-catch", "Empty catch block", "bug", "MAJOR", 90,
        "Errors vanish in an empty handler; log or rethrow.",
        impact=65, profile="web", pattern=r"catch\s*\([^)]*\)\s*\{\s*\}",
    ),
    MatchRule(
        "py-bare-except", "Bare except clause", "bug", "MAJOR", 90,
        "A bare handler also swallows interrupts; name the exception.",
        impact=60, profile="web", exts=WEB_PY, pattern=r"\bexcept\s*:",
    ),
    MatchRule(
        "py-mutable-default", "Mutable default argument", "bug", "MAJOR", 85,
        "A mutable default is shared by all calls; default to None.",
        impact=70, profile="web", exts=WEB_PY,
        pattern=r"def\s+\w+\([^)]*(?:=\s*\[\]|=\s*\{\}|=\s*set\(\))",
    ),
)

# ---------------------------------------------------------------- custom line rules (web)
_SQL_CALL = r"""(?i)\b(?:db\.)?(?:query|execute|executequery|executeraw|rawquery|createnativequery)\s*\(\s*[`'"]"""
_CONSOLE = r"\bconsole\.(log|debug|info|warn|error)\s*\("

WEB_LINE_RULES = (
    LineRule(
        "sec-sql-injection", "Potential SQL injection", "security", "CRITICAL", 80,
        "Text is spliced into a query; bind parameters instead.",
        impact=95, profile="web", family="web-js-py",
        has=(
            ("line", _SQL_CALL),
            ("line", r"(?i)(select|insert|update|delete|from|where)\b"),
            ("line", r"""(\$\{|["'`]\s*\+|\+\s*["'`])"""),
        ),
    ),
    LineRule(
        "perf-console-log", "Console.log in production code", "performance", "MINOR", 90,
        "Console output left in code that ships to users.",
        impact=30, profile="web", family="web-js", has=(("line", _CONSOLE),), where=("web_production",),
    ),
    LineRule(
        "perf-console-log", "Console.log in production code", "performance", "INFO", 70,
        "Console output in tooling code; a structured logger reads better.",
        impact=10, profile="web", family="web-js", has=(("line", _CONSOLE),),
        lacks=(("first_console", "^error$"),), where=("not_web_production",),
    ),
    LineRule(
        "perf-sync-fs", "Synchronous file system operation", "performance", "INFO", 75,
        "A blocking file call stalls the event loop.",
        impact=35, profile="web", family="web-js", where=("web_async_context",),
        has=(("line", r"\bfs\.(readFileSync|writeFileSync|statSync|readdirSync|existsSync)\b"),),
    ),
)

# ---------------------------------------------------------------- file-type line rules
_FK = r"(?i)\bON\s+{}\s+(CASCADE|SET\s+NULL|SET\s+DEFAULT|RESTRICT|NO\s+ACTION)\b"

FILE_TYPE_RULES = (
    LineRule(
        "sql-select-star", "Avoid SELECT *", "performance", "MAJOR", 90,
        "List the columns a query needs.", family="sql",
        has=(("line", r"(?i)SELECT\s+\*"),), column=("regex", r"(?i)SELECT\s+\*"),
    ),
    LineRule(
        "sql-update-no-where", "UPDATE without WHERE clause", "bug", "CRITICAL", 85,
        "The statement changes every row.", family="sql",
        has=(("line", r"(?i)\bUPDATE\b"),), lacks=(("line", _FK.format("UPDATE")),), where=("no_where_ahead",),
    ),
    LineRule(
        "sql-delete-no-where", "DELETE without WHERE clause", "bug", "CRITICAL", 85,
        "The statement removes every row.", family="sql",
        has=(("line", r"(?i)\bDELETE\b"),), lacks=(("line", _FK.format("DELETE")),), where=("no_where_ahead",),
    ),
    LineRule(
        "sql-dynamic-sql", "Dynamic SQL execution", "security", "MAJOR", 75,
        "A statement built at run time can be injected into.", family="sql",
        has=(("line", r"(?i)EXECUTE\s+IMMEDIATE|EXEC\s*\(|sp_executesql"),),
    ),
    LineRule(
        "sql-order-no-limit", "ORDER BY without LIMIT", "performance", "INFO", 60,
        "A full sort without a limit is costly.", family="sql",
        has=(("line", r"(?i)ORDER\s+BY"),),
        lacks=(("ahead", r"(?i)^(?:[^;\n]*\n)*[^\n]*\b(LIMIT|TOP|FETCH\s+FIRST|ROWNUM)"),),
    ),
    LineRule(
        "sql-multiple-joins", "Multiple JOINs in single query", "performance", "INFO", 50,
        "Check that the join columns are indexed.", family="sql", has=(("line", r"(?i)\bJOIN\b.*\bJOIN\b"),),
    ),
    LineRule(
        "json-trailing-comma", "Trailing comma in JSON", "bug", "CRITICAL", 95,
        "Strict parsers reject a comma before a closing bracket.", family="json",
        has=(("line", r",\s*[\]}]"),), column=("regex", r",\s*[\]}]"),
    ),
    LineRule(
        "yaml-tabs", "Tab character in YAML", "bug", "CRITICAL", 100,
        "Tabs are not allowed as indentation.", family="yaml",
        has=(("line", r"\t"),), column=("regex", r"\t"),
    ),
    LineRule(
        "yaml-indent", "Inconsistent YAML indentation", "code-smell", "MAJOR", 70,
        "The indentation is not a multiple of two.", family="yaml",
        has=(("line", r"^\s(?:\s\s)*+(?:\S|$)"),), end="indent",
    ),
    LineRule(
        "yaml-boolean", "Unquoted boolean-like value", "bug", "INFO", 65,
        "The bare word is read as a boolean; quote it if text is meant.", family="yaml",
        has=(("line", r"(?i):\s*(yes|no|on|off|true|false)\s*$"),), lacks=(("line", r"""["']"""),),
    ),
    LineRule(
        "shell-unquoted-var", "Unquoted variable", "bug", "MAJOR", 70,
        "An unquoted variable is split and globbed.", family="shell",
        has=(("line", r"""\$[a-zA-Z_](?:[a-zA-Z0-9_]|\s*(?:[^\s"'a-zA-Z0-9_]|$))"""),),
        lacks=(("line", r"""["']\$"""),), column=("regex", r"\$"),
    ),
    LineRule(
        "shell-useless-cat", "Useless use of cat", "code-smell", "INFO", 80,
        "Redirect the file instead of piping it.", family="shell",
        has=(("line", r"cat\s+[^\|]+\|\s*"),), column=("regex", "cat"),
    ),
    LineRule(
        "shell-eval", "Use of eval", "security", "MAJOR", 85,
        "Evaluated text may come from outside.", family="shell",
        has=(("line", r"\beval\s"),), column=("regex", "eval"),
    ),
    LineRule(
        "shell-no-shebang", "Missing shebang", "best-practice", "INFO", 90,
        "Name the interpreter on the first line.", family="shell",
        lacks=(("line", r"^#!"),), where=("first_line",), end="zero",
    ),
    LineRule(
        "docker-latest-tag", "Using :latest tag", "best-practice", "MAJOR", 95,
        "Pin the image so builds repeat.", family="docker",
        has=(("trim", r"(?i)FROM\s+\S+:latest"),), where=("docker_code",), end="trim",
    ),
    LineRule(
        "docker-apt-no-y", "apt-get install without -y", "bug", "MAJOR", 90,
        "The install waits for an answer nobody gives.", family="docker",
        has=(("trim", r"(?i)apt-get\s+install(?:\s*$|\s+[^-\s]|\s+-(?:[^yY]|$)|\S)"),),
        lacks=(("trim", r"--assume-yes"),), where=("docker_code",), end="trim",
    ),
    LineRule(
        "docker-copy-all", "COPY . . copies everything", "performance", "MAJOR", 80,
        "Copy named paths or keep an ignore file.", family="docker",
        has=(("trim", r"COPY\s+\.\s+\."),), where=("docker_code",), end="trim",
    ),
    LineRule(
        "docker-user-root", "Running as root user", "security", "MAJOR", 85,
        "Run the container as an ordinary user.", family="docker",
        has=(("trim", r"(?i)^USER\s+root"),), where=("docker_code",), end="trim",
    ),
)

# ---------------------------------------------------------------- JS/TS style line rules
_TAG = r"(?i)//\s*({})[\s:]*"
_CONSOLE_STYLE = r"console\.(log|debug|info|warn|error|trace)\s*\("

STYLE_RULES = (
    LineRule(
        "style-long-line", "Line exceeds maximum length", "code-smell", "INFO", 60,
        "Break the line up.", family="style", where=("guard1", "over_length"), column=("max_length", 0),
    ),
    LineRule(
        "style-fixme", "FIXME comment", "maintainability", "MAJOR", 100,
        "A known fault is marked here.", family="style", where=("guard1",), has=(("first_tag", r"(?i)^fixme$"),),
    ),
    *(
        LineRule(
            f"style-{tag.lower()}", f"{tag} comment", "maintainability", "MINOR", 100,
            "Unfinished work is marked here.", family="style", where=("guard1",),
            has=(("first_tag", f"(?i)^{tag}$"),),
        )
        for tag in ("TODO", "HACK", "XXX")
    ),
    LineRule(
        "style-console", "Console statement", "best-practice", "MAJOR", 95,
        "Console output left in shipped code.", family="style",
        has=(("line", _CONSOLE_STYLE),), where=("guard3", "shipped_context"),
    ),
    LineRule(
        "style-console", "Console statement", "best-practice", "INFO", 70,
        "Console output in a tool or service; a logger reads better.", family="style",
        has=(("line", _CONSOLE_STYLE),), where=("guard3", "tool_context"),
    ),
    LineRule(
        "style-debugger", "Debugger statement", "best-practice", "CRITICAL", 100,
        "Remove the breakpoint before committing.", family="style",
        has=(("line", r"\bdebugger\b"),), where=("guard4", "debugger_outside_strings"),
    ),
    LineRule(
        "style-equality", "Use strict equality", "best-practice", "MAJOR", 85,
        "Compare with === to avoid conversions.", family="style",
        has=(("line", r"[^=!<>]==[^=]"),), lacks=(("line", r"/[^/\n]*==[^/\n]*/"),),
        where=("guard4", "no_quote_before_equality"),
    ),
    LineRule(
        "style-inequality", "Use strict inequality", "best-practice", "MAJOR", 85,
        "Compare with !== to avoid conversions.", family="style",
        has=(("line", r"!=[^=]"),), lacks=(("line", r"!=="),), where=("guard4",),
    ),
)

# ---------------------------------------------------------------- lexical rules over blanked code
_LEAD = r"(?:^|[^.\w$])"
_SKIP = r"^[^\w]"
_IDENT = r"[A-Za-z_$][\w$]*"
_SYNC = "readFileSync|writeFileSync|existsSync|statSync|readdirSync"
_SECRET_DECL = rf"""\b(?:const|let|var)\s+({_IDENT})\s*(?::\s*string\s*)?=\s*["'][^"'\n]+["']"""
# Ordered credential kinds with the name pattern of each.
SECRET_KINDS = (
    ("API key", r"api[_-]?key"),
    ("password", r"password"),
    ("secret", r"secret"),
    ("token", r"token"),
    ("private key", r"private[_-]?key"),
    ("authentication credential", r"auth"),
)
_HANDLED = rf"(?:\bawait\s+|\breturn\s+|=\s*|=>\s*)[\w$.]*$"


def _lexical(id, title, category, severity, confidence, description, **kw):
    kw.setdefault("exts", JS)
    kw.setdefault("text", "code")
    return MatchRule(id, title, category, severity, confidence, description, engine="lexical", **kw)


LEXICAL_RULES = (
    _lexical(
        "security-eval", "Dangerous eval() usage", "security", "CRITICAL", 100,
        "eval() runs any text it is given.", pattern=_LEAD + r"eval\s*\(", skip=_SKIP,
    ),
    _lexical(
        "security-xss", "Potential XSS vulnerability", "security", "MAJOR", 85,
        "Markup set this way can carry scripts.", pattern=r"[\w$.]*\.innerHTML\s*=[^=]",
    ),
    *(
        _lexical(
            "security-secret", f"Potential hardcoded {kind}", "security", "CRITICAL", 75,
            "A literal is assigned to a variable named like a credential.",
            pattern=_SECRET_DECL, skip=r"^(?:const|let|var)\s+", name_group=1, name_has=f"(?i){name}",
            name_lacks=("(?i)" + "|".join(p for _, p in SECRET_KINDS[:i])) if i else None,
        )
        for i, (kind, name) in enumerate(SECRET_KINDS)
    ),
    _lexical(
        "security-sql", "Potential SQL injection risk", "security", "CRITICAL", 80,
        "A template with values is passed as a query; bind parameters.",
        pattern=r"(?i)(?:^|[^\w$])(?:query|execute|raw|sql)\s*\(\s*`[^`]*\$\{", skip=_SKIP,
    ),
    _lexical(
        "security-func", "Dynamic Function constructor usage", "security", "MAJOR", 90,
        "The constructor compiles text into code.", pattern=r"\bnew\s+Function\s*\(",
    ),
    _lexical(
        "ts-any", "Explicit any type", "best-practice", "MAJOR", 90,
        "'any' switches type checking off here.", exts=TS,
        pattern=r"(?::\s*|<\s*|\bas\s+|\|\s*)any\b|,\s*any\s*[>,\]]", skip=r"^(?:[:<|,]\s*|as\s+)",
    ),
    _lexical(
        "ts-as-any", "Type assertion to any", "best-practice", "MAJOR", 95,
        "The cast hides a type error.", exts=TS, pattern=r"\bas\s+any\b",
    ),
    _lexical(
        "ts-non-null", "Non-null assertion operator", "best-practice", "INFO", 70,
        "The value may still be missing at run time.", exts=TS,
        pattern=r"[\w$)\]]!\.[A-Za-z_$]", skip=r"^.",
    ),
    _lexical(
        "ts-return-type", "Missing return type on exported function '{name}'", "best-practice", "INFO", 80,
        "State what an exported function returns.", exts=TS, name_group=1, skip=r"^[ \t]*",
        pattern=rf"(?m)^[ \t]*export\s+(?:default\s+)?(?:async\s+)?function\s*\*?\s*({_IDENT})\s*(?:<[^>(]*>)?\([^)]*\)\s*\{{",
    ),
    _lexical(
        "ts-ignore", "@ts-ignore comment found", "best-practice", "MAJOR", 100,
        "A type error is silenced above this statement.", exts=TS, text="content",
        pattern=r"(?://|/\*)[^\n]*@ts-(?:ignore|nocheck)[^\n]*\n(?:[ \t]*(?://[^\n]*)?\n)*+[ \t]*\S",
        skip=r"^[\s\S]*\n[ \t]*",
    ),
    _lexical(
        "perf-sync", "Synchronous operation: {name}", "performance", "INFO", 75,
        "A blocking file call stalls the event loop.", contexts=("production-web", "test"),
        pattern=rf"(?:^|[^\w$])({_SYNC})\s*\(", skip=_SKIP, name_group=1,
    ),
    _lexical(
        "async-promise-executor", "Async function as Promise executor", "bug", "MAJOR", 95,
        "An async executor already returns a promise.", pattern=r"\bnew\s+Promise\s*(?:<[^>\n]*>)?\s*\(\s*async\b",
    ),
    _lexical(
        "async-then-catch", "Multiple .then().catch() chains", "maintainability", "INFO", 65,
        "Several promise chains in one file; awaiting reads better.",
        pattern=r"\.then\s*\([^;]*?\)\s*\.catch\s*\(", nth=3,
    ),
    _lexical(
        "async-floating-promise", "Unhandled promise from '{name}'", "bug", "MAJOR", 80,
        "The promise is neither awaited nor handled.", name_group=1, skip=r"^[ \t]*",
        pattern=r"(?mi)^[ \t]*(?:[\w$]+\.)*+(saveToDb|saveAsync|deleteAsync|insertAsync|removeAsync|sendAsync|emitAsync)\s*\(",
    ),
    _lexical(
        "async-floating-promise", "Unhandled promise from '{name}'", "bug", "MAJOR", 60,
        "The promise is neither awaited nor handled.", name_group=1, skip=r"^[ \t]*",
        pattern=r"(?mi)^[ \t]*(?:[\w$]+\.)*+(sendMessage|sendEmail|sendNotification)\s*\(",
    ),
    _lexical(
        "react-usestate-init", "useState without initial value", "best-practice", "INFO", 70,
        "The state starts undefined.", exts=REACT, pattern=r"\buseState\s*(?:<[^>\n]*>)?\s*\(\s*\)",
    ),
    _lexical(
        "react-state-mutation", "Possible direct state mutation", "bug", "MAJOR", 60,
        "State or props are changed in place.", exts=REACT,
        pattern=r"[\w$.\[\]]+\.(?:push|pop|splice|sort)[\w$.]*\s*=[^=>]",
    ),
    _lexical(
        "react-inline-handler", "Inline function in JSX prop", "performance", "INFO", 50,
        "The handler is created anew on each render.", exts=REACT,
        pattern=rf"\bon\w*=\{{\s*(?:async\s*)?(?:\([^)]*\)|{_IDENT})\s*=>|\bon\w*=\{{\s*(?:async\s+)?function\b",
    ),
    _lexical(
        "style-empty-catch", "Empty catch block", "bug", "MAJOR", 95,
        "Errors vanish in an empty handler.", pattern=r"\bcatch\s*(?:\([^)]*\))?\s*\{\s*\}",
        raw_lacks=r"//|/\*",
    ),
    _lexical(
        "style-empty-catch", "Empty catch block", "bug", "MINOR", 75,
        "The handler holds only a comment.", pattern=r"\bcatch\s*(?:\([^)]*\))?\s*\{\s*\}",
        raw_has=r"//|/\*",
    ),
    _lexical(
        "style-no-docs", "Missing documentation for '{name}'", "maintainability", "INFO", 75,
        "Exported names deserve a doc comment.", name_group=1, skip=r"^[ \t]*",
        pattern=rf"(?m)^[ \t]*export\s+(?:default\s+)?(?:abstract\s+)?(?:async\s+)?(?:function|class|interface)\s*\*?\s+({_IDENT})",
        before_lacks=r"\*/\s*$",
    ),
    _lexical(
        "unreachable", "Unreachable code detected", "bug", "MAJOR", 95,
        "Nothing runs after the jump above.", skip=r"^[\s\S]*\n[ \t]*",
        pattern=r"(?m)^[ \t]*(?:return\b[^\n;{]*|throw\b[^\n;{]*|break|continue)[ \t]*;[ \t]*\n(?:[ \t]*\n)*+[ \t]*[^\s}][\w$]*",
        hit_lacks=r"\n[ \t]*(?:case|default|else)$", before_lacks=r"(?:\bif\s*\([^\n]*\)|\belse)\s*$",
    ),
)

MATCH_RULES = WEB_MATCH_RULES + LEXICAL_RULES
LINE_RULES = WEB_LINE_RULES + FILE_TYPE_RULES + STYLE_RULES
