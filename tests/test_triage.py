from pyspark.sql import functions as F

from lintlake.operators import compare, hotspots, metrics, triage
from lintlake.plans import scan as plans


def sev(df):
    return {r.issue_id: r.severity for r in df.select("issue_id", "severity").collect()}


def test_remap_modes(make_issues):
    issues = make_issues([
        {"issue_id": "sql-delete-no-where-1", "file_path": "db/migrations/x.sql"},
        {"issue_id": "noExplicitAny-2", "file_path": "app/services/a.ts"},
        {"issue_id": "lint/style/useTemplate-3", "severity": "CRITICAL"},
        {"issue_id": "noExplicitAny-4", "confidence": 80, "impact": 60, "category": "maintainability"},
        {"issue_id": "other-5", "severity": "MINOR", "file_path": "app/services/a.ts"},
        {"issue_id": "useExhaustiveDependencies-6", "description": "Justified here", "severity": "INFO"},
        {"issue_id": "biome-lint/suspicious/noDoubleEquals-7", "severity": "CRITICAL"},
    ])
    observed = sev(triage.remap(issues))
    assert observed == {
        "sql-delete-no-where-1": "BLOCKER", "noExplicitAny-2": "MINOR", "lint/style/useTemplate-3": "INFO",
        "noExplicitAny-4": "MINOR", "other-5": "MINOR", "useExhaustiveDependencies-6": "INFO",
        "biome-lint/suspicious/noDoubleEquals-7": "MINOR",
    }
    intended = sev(triage.remap(issues, "intended"))
    assert intended["noExplicitAny-2"] == "CRITICAL" and intended["sql-delete-no-where-1"] == "BLOCKER"


def test_complexity_takes_the_threshold(make_issues):
    """The stated value is not read: the last number of the text is, which is the threshold."""
    issues = make_issues([
        {"issue_id": "cyclomatic-1", "title": "High cyclomatic complexity in 'f'",
         "description": "Cyclomatic complexity is 44 (threshold: 10). Split it.", "severity": "CRITICAL"},
        {"issue_id": "cognitive-2", "description": "complexity: 41", "severity": "INFO"},
    ])
    assert sev(triage.remap(issues)) == {"cyclomatic-1": "MINOR", "cognitive-2": "CRITICAL"}


def test_suppression(make_files, make_issues):
    files = make_files({
        "a.ts": "x; // lint-ignore: r1, r2\n// lint-ignore-next-line: r1\ny;\nz; // lint-ignore: *",
        "b.ts": "/* lint-ignore-file: r3 */\n",
    })
    issues = make_issues([
        {"issue_id": "r1-10", "file_path": "a.ts", "line_start": 0},
        {"issue_id": "r3-11", "file_path": "a.ts", "line_start": 0},
        {"issue_id": "r1-12", "file_path": "a.ts", "line_start": 2},
        {"issue_id": "r1-13", "file_path": "a.ts", "line_start": 1},
        {"issue_id": "zz-14", "file_path": "a.ts", "line_start": 3},
        {"issue_id": "r3-15", "file_path": "b.ts", "line_start": 9},
        {"issue_id": "r1-16", "file_path": "b.ts", "line_start": 9},
    ])
    kept = {r.issue_id for r in triage.suppress(issues, triage.directives(files)).collect()}
    assert kept == {"r3-11", "r1-13", "r1-16"}


def test_overrides(spark, make_issues):
    rules = spark.createDataFrame([("r1", "off"), ("r2", "warn"), ("r3", "error"), ("r4", '{"severity": "blocker"}'), ("r6", "loud"), ("r7", '{"severity": "loud"}')],
                                  "rule string, setting string")
    issues = make_issues([{"issue_id": f"r{i}-{i}"} for i in range(1, 8)])
    assert sev(triage.apply_rule_overrides(issues, rules)) == {
        "r2-2": "MINOR", "r3-3": "MAJOR", "r4-4": "BLOCKER", "r5-5": "MAJOR", "r6-6": "MAJOR", "r7-7": "MAJOR"}


def test_merge_keeps_first_and_dedupes_second(make_issues):
    tool = make_issues([{"issue_id": "t-1", "title": "Same title here and more"}, {"issue_id": "t-2", "title": "Same title here and more"}])
    own = make_issues([
        {"issue_id": "o-1", "title": "SAME TITLE HERE AND other"}, {"issue_id": "o-2", "title": "Fresh"},
        {"issue_id": "o-3", "title": "fresh"},
    ])
    merged = triage.merge_sources(tool, own, ["event_id"])
    assert sorted(r.issue_id for r in merged.collect()) == ["o-2", "t-1", "t-2"]


def test_first_wins_is_ordered(make_issues):
    issues = make_issues([{"issue_id": f"i-{n}", "event_id": 9 - n} for n in range(5)])
    assert [r.issue_id for r in triage.dedupe_scan(issues, ["event_id"]).collect()] == ["i-4"]


def test_hotspot_islands(make_issues):
    issues = make_issues([
        {"line_start": 1, "line_end": 4, "severity": "INFO", "title": "A"},
        {"line_start": 1, "line_end": 1, "severity": "INFO", "title": "B"},
        {"line_start": 9, "line_end": 9, "severity": "CRITICAL", "title": "A"},
        {"line_start": 15, "line_end": 15, "severity": "BLOCKER", "title": "C"},
        {"line_start": 40, "line_end": 40, "severity": "INFO", "title": "quiet"},
        {"line_start": 41, "line_end": 41, "severity": "INFO", "category": "security", "title": "S", "issue_id": "semgrep-x-1"},
    ])
    spots = {(r.start_line, r.end_line): (r.severity, r.reason, r.source) for r in hotspots.hotspots(issues).collect()}
    assert spots == {
        (1, 9): ("CRITICAL", "A; B", "static"),
        (15, 15): ("BLOCKER", "C", "static"),
        (41, 41): ("INFO", "S", "external"),
    }


def test_hotspot_scope(make_issues):
    issues = make_issues([
        {"line_start": 1, "file_path": "a", "severity": "MAJOR"}, {"line_start": 3, "file_path": "b", "severity": "MAJOR"},
    ])
    assert hotspots.hotspots(issues).count() == 2
    assert hotspots.hotspots(issues, "project").count() == 1


def test_hotspots_brute_force(make_issues):
    """Random lines against a plain loop."""
    import random

    rng = random.Random(7)
    rows = [{"line_start": rng.randrange(120), "severity": rng.choice(["MAJOR", "INFO"]), "title": rng.choice("ABCD")} for _ in range(60)]
    for r in rows:
        r["line_end"] = r["line_start"] + rng.randrange(4)
    counts = {}
    for r in rows:
        counts[r["line_start"]] = counts.get(r["line_start"], 0) + 1
    expected = []
    for r in sorted((r for r in rows if r["severity"] == "MAJOR" or counts[r["line_start"]] > 1), key=lambda r: r["line_start"]):
        if expected and r["line_start"] <= expected[-1][1] + 5:
            expected[-1][1] = max(expected[-1][1], r["line_end"])
        else:
            expected.append([r["line_start"], r["line_end"]])
    got = sorted([r.start_line, r.end_line] for r in hotspots.hotspots(make_issues(rows)).collect())
    assert got == expected


def test_compare(make_issues):
    base = make_issues([{"title": "A"}, {"title": "A"}, {"title": "B"}, {"title": None}])
    head = make_issues([{"title": "B"}, {"title": "C", "severity": "BLOCKER"}, {"title": "C", "severity": "BLOCKER"}, {"title": None}])
    assert compare.new_issues(base, head).count() == 2
    assert compare.fixed_issues(base, head).count() == 2
    assert compare.new_issues(base, base).count() == 0
    assert compare.new_issues(head, base).count() == compare.fixed_issues(base, head).count()


def test_scores(spark, make_issues):
    issues = make_issues([
        {"file_path": "a", "severity": "BLOCKER"}, {"file_path": "a", "severity": "INFO"},
        {"file_path": "b", "severity": "MINOR"},
    ])
    assert {r.file_path: r.file_score for r in metrics.file_health(issues).collect()} == {"a": 85, "b": 98}
    files = spark.createDataFrame([("p", 4), ("clean", 3), ("none", 0)], "project_id string, files_analyzed long")
    mean = {r.project_id: r.score_mean for r in metrics.mean_score(issues, files).collect()}
    assert mean == {"p": 96, "clean": 100, "none": 0}
    totals = {r.project_id: r.score_totals for r in metrics.project_metrics(issues, files).collect()}
    assert totals == {"p": 83, "clean": 100, "none": 0}


def test_report_end_to_end(make_files):
    files = make_files({"src/a.ts": "eval('x');\nlet v = 1;\n", "src/b.py": "password = 'abcdefghijkl'\n"})
    issues = plans.report(files, "web")
    rules = {r.rule_id for r in issues.collect()}
    assert {"security-eval", "sec-hardcoded-secret"} <= rules and "sec-eval" not in rules
    health = plans.project_health(files, issues).first()
    assert health.files_analyzed == 2 and 0 <= health.score_mean <= 100


def test_duplicate_project_keeps_scores(make_files):
    content = {"src/a.ts": "eval('x');\n", "src/b.ts": "a == b;\n"}
    one, two = make_files(content, "one"), make_files(content, "two")
    both = one.unionByName(two)
    scores = {r.project_id: r.score_mean for r in plans.project_health(both, plans.report(both, "regex")).collect()}
    assert scores["one"] == scores["two"]
    assert scores["one"] == plans.project_health(one, plans.report(one, "regex")).first().score_mean


def test_issues_are_whole_under_skew(make_issues):
    """A third of all rows in one file and on one line: nothing is dropped, one row survives the dedupe."""
    rows = [{"file_path": "hot.ts", "event_id": n} for n in range(300)] + [{"file_path": f"f{n}.ts", "event_id": 300 + n} for n in range(600)]
    issues = make_issues(rows).withColumn("project_id", F.lit("p"))
    assert triage.dedupe_scan(issues, ["event_id"]).count() == 601
    assert metrics.file_health(issues).agg(F.sum("major")).first()[0] == 900
