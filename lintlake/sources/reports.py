"""Reports of external analysers as issues: one explicit schema and one ``explode`` per tool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_POS = "struct<line:int,col:int>"
SEMGREP = (
    f"results array<struct<check_id:string,path:string,start:{_POS},end:{_POS},message:string,severity:string,"
    "extra:struct<message:string,severity:string,lines:string,"
    "metadata:struct<category:string,confidence:string,impact:string>>>>"
)
BIOME = (
    "diagnostics array<struct<category:string,severity:string,description:string,message:string,"
    "location:struct<line_start:int,column_start:int,line_end:int,column_end:int,span:struct<start:int>>,"
    "source:struct<text:string>>>"
)
RUFF = (
    "array<struct<code:string,message:string,location:struct<row:int,column:int>,"
    "end_location:struct<row:int,column:int>>>"
)
TFLINT = (
    "issues array<struct<rule:string,message:string,severity:string,"
    "range:struct<start:struct<line:int,column:int>,end:struct<line:int,column:int>>>>"
)
CHECKOV = (
    "results struct<failed_checks:array<struct<check_id:string,check_name:string,guideline:string,severity:string,"
    "resource:string,file_line_range:array<int>>>>"
)


def _or(value: Column, default) -> Column:
    """A value with a default for null, zero and the empty text."""
    empty = value == (0 if isinstance(default, int) else "")
    return F.when(value.isNull() | empty, F.lit(default)).otherwise(value)


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("undefined"))


def _any(value: Column, *parts: str) -> Column:
    out = value.contains(parts[0])
    for p in parts[1:]:
        out = out | value.contains(p)
    return out


def _choose(value: Column, missing: str, table: dict, other: str) -> Column:
    """Lower-cased value looked up in ``{names: result}``; ``missing`` without a value."""
    low = F.lower(value)
    out = F.when(value.isNull() | (value == ""), missing)
    for names, result in table.items():
        out = out.when(low.isin(*names), result)
    return out.otherwise(other)


def _issues(rows: DataFrame, tool: str, **columns) -> DataFrame:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return rows.select("project_id", "file_path", *[as_col(v).alias(k) for k, v in columns.items()],
                       F.lit("external").alias("source"), F.lit(tool).alias("engine"))


def read_semgrep(reports: DataFrame) -> DataFrame:
    """``reports(project_id, file_path, report)``; malformed JSON gives no rows."""
    parsed = F.from_json("report", SEMGREP)["results"]
    rows = reports.select("project_id", "file_path", F.explode(parsed).alias("f"))
    f, extra = F.col("f"), F.col("f.extra")
    category, low = extra["metadata"]["category"], F.lower(extra["metadata"]["category"])
    impact = extra["metadata"]["impact"]
    return _issues(
        rows, "semgrep",
        issue_id=F.concat_ws("-", F.lit("semgrep"), _text(f["check_id"]), F.coalesce(f["start"]["line"], F.lit(0)).cast("string")),
        title=_or(F.substring_index(f["check_id"], ".", -1), "Security Issue"),
        description=F.coalesce(
            F.when(extra["message"] != "", extra["message"]), F.when(f["message"] != "", f["message"]),
            F.lit("Semgrep security finding")),
        category=F.when(category.isNull() | (category == ""), "security")
        .when(_any(low, "security", "vuln"), "security").when(_any(low, "performance"), "performance")
        .when(_any(low, "correctness", "bug"), "bug").when(_any(low, "best-practice"), "best-practice")
        .otherwise("security"),
        severity=_choose(F.coalesce(F.when(extra["severity"] != "", extra["severity"]), f["severity"]), "MAJOR",
                         {("error", "high"): "CRITICAL", ("warning", "medium"): "MAJOR", ("info", "low"): "MINOR"}, "INFO"),
        line_start=_or(f["start"]["line"], 1) - 1,
        col_start=F.coalesce(f["start"]["col"], F.lit(0)),
        line_end=_or(f["end"]["line"], 1) - 1,
        col_end=F.coalesce(f["end"]["col"], F.lit(0)),
        code_snippet=F.coalesce(extra["lines"], F.lit("")),
        confidence=_choose(extra["metadata"]["confidence"], "70", {("high",): "95", ("medium",): "75", ("low",): "50"},
                           "70").cast("int"),
        impact=F.when(impact == "HIGH", 90).when(impact == "MEDIUM", 60).otherwise(40),
    )


def read_biome(reports: DataFrame) -> DataFrame:
    parsed = F.from_json("report", BIOME)["diagnostics"]
    rows = reports.select("project_id", "file_path", F.explode(parsed).alias("d"))
    d, at = F.col("d"), F.col("d.location")
    low = F.lower(d["category"])
    zero = lambda c: F.coalesce(c, F.lit(0))
    return _issues(
        rows, "biome",
        issue_id=F.concat_ws("-", F.lit("biome"), _or(d["category"], "lint"), zero(at["span"]["start"]).cast("string")),
        title=_or(d["category"], "Lint Issue"),
        description=F.coalesce(F.when(d["description"] != "", d["description"]), F.when(d["message"] != "", d["message"]),
                               F.lit("Biome lint finding")),
        category=F.when(d["category"].isNull() | (d["category"] == ""), "code-smell")
        .when(_any(low, "suspicious", "correctness"), "bug").when(_any(low, "security"), "security")
        .when(_any(low, "performance"), "performance").when(_any(low, "complexity", "style"), "maintainability")
        .when(_any(low, "a11y", "accessibility"), "accessibility").otherwise("code-smell"),
        severity=_choose(d["severity"], "MAJOR",
                         {("error",): "CRITICAL", ("warning",): "MAJOR", ("information", "info"): "MINOR"}, "INFO"),
        line_start=zero(at["line_start"]),
        col_start=zero(at["column_start"]),
        line_end=zero(at["line_end"]),
        col_end=zero(at["column_end"]),
        code_snippet=F.coalesce(d["source"]["text"], F.lit("")),
        confidence=90,
        impact=F.when(d["severity"] == "error", 80).otherwise(50),
    )


def read_ruff(reports: DataFrame) -> DataFrame:
    # A single object would parse as an array of one.
    listed = reports.where(F.ltrim("report").startswith("["))
    rows = listed.select("project_id", "file_path", F.explode(F.from_json("report", RUFF)).alias("d"))
    d, at, end = F.col("d"), F.col("d.location"), F.col("d.end_location")
    prefix = F.upper(F.substring(d["code"], 1, 1))
    missing = d["code"].isNull() | (d["code"] == "")
    first_line = F.substring_index(d["message"], "\n", 1)
    return _issues(
        rows, "ruff",
        issue_id=F.concat_ws("-", F.lit("ruff"), _or(d["code"], "check"), F.coalesce(at["row"], F.lit(0)).cast("string")),
        title=F.concat(_text(d["code"]), F.lit(": "), _or(first_line, "Python Issue")),
        description=F.coalesce(
            F.when(d["message"] != "", d["message"]),
            F.concat(F.lit("Ruff rule "), _text(d["code"]), F.lit(" violation"))),
        category=F.when(missing, "code-smell").when(prefix.isin("F", "B"), "bug").when(prefix.isin("E", "W"), "code-smell")
        .when(prefix == "S", "security").when(prefix.isin("C", "D", "I"), "maintainability")
        .when(prefix == "N", "best-practice").otherwise("code-smell"),
        severity=F.when(missing, "MAJOR").when(prefix == "S", "CRITICAL").when(prefix.isin("F", "B"), "MAJOR").otherwise("INFO"),
        line_start=_or(at["row"], 1) - 1,
        col_start=_or(at["column"], 1) - 1,
        line_end=F.coalesce(F.when(end["row"] != 0, end["row"]), F.when(at["row"] != 0, at["row"]), F.lit(1)) - 1,
        col_end=F.coalesce(end["column"], F.lit(0)),
        code_snippet="",
        confidence=95,
        impact=F.when(missing, 50).when(prefix == "S", 90).when(prefix.isin("F", "B"), 70).otherwise(40),
    )


def read_tflint(reports: DataFrame) -> DataFrame:
    rows = reports.select("project_id", "file_path", F.explode(F.from_json("report", TFLINT)["issues"]).alias("i"))
    i, at = F.col("i"), F.col("i.range")
    return _issues(
        rows, "tflint",
        issue_id=F.concat_ws("-", F.lit("tflint"), _text(i["rule"]), F.coalesce(at["start"]["line"], F.lit(0)).cast("string")),
        title=_or(i["rule"], "Terraform Issue"),
        description=_or(i["message"], "TFLint finding"),
        category="best-practice",
        severity=_choose(i["severity"], "MAJOR",
                         {("error",): "CRITICAL", ("warning",): "MAJOR", ("notice",): "MINOR"}, "INFO"),
        line_start=_or(at["start"]["line"], 1) - 1,
        col_start=F.coalesce(at["start"]["column"], F.lit(0)),
        line_end=_or(at["end"]["line"], 1) - 1,
        col_end=F.coalesce(at["end"]["column"], F.lit(0)),
        code_snippet="",
        confidence=85,
        impact=60,
    )


def read_checkov(reports: DataFrame) -> DataFrame:
    parsed = F.from_json("report", CHECKOV)["results"]["failed_checks"]
    rows = reports.select("project_id", "file_path", F.explode(parsed).alias("c"))
    c = F.col("c")
    line = lambda n: F.coalesce(F.get(c["file_line_range"], F.lit(n)), F.lit(1))
    return _issues(
        rows, "checkov",
        issue_id=F.concat_ws("-", F.lit("checkov"), _text(c["check_id"]), line(0).cast("string")),
        title=F.concat(_text(c["check_id"]), F.lit(": "), _or(c["check_name"], "IaC Issue")),
        description=F.coalesce(F.when(c["guideline"] != "", c["guideline"]), F.when(c["check_name"] != "", c["check_name"]),
                               F.lit("Checkov security finding")),
        category="security",
        severity=_choose(c["severity"], "MAJOR", {("critical",): "BLOCKER", ("high",): "CRITICAL", ("medium",): "MAJOR",
                                                   ("low",): "MINOR"}, "INFO"),
        line_start=line(0) - 1,
        col_start=0,
        line_end=line(1) - 1,
        col_end=0,
        code_snippet=F.coalesce(c["resource"], F.lit("")),
        confidence=90,
        impact=F.when(c["severity"] == "CRITICAL", 100).when(c["severity"] == "HIGH", 85).otherwise(60),
    )


READERS = {
    "semgrep": read_semgrep,
    "biome": read_biome,
    "ruff": read_ruff,
    "tflint": read_tflint,
    "checkov": read_checkov,
}
