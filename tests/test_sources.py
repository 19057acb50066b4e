"""Scans and sinks on small files."""

import hashlib
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from limitlens.operators import limits as L, manifest as M, rules as R
from limitlens.sources import catalog as G, logs as J, mapping as P, nested_rules as N, rule_files as U, tables as S, workbook as W
from limitlens.streaming import logs as stream
from tests.helpers import DAY

HASH = hashlib.sha256(b"user").hexdigest()


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def rows(df, *columns):
    names = columns or [c for c in df.columns if c not in (S.CORRUPT, S.ROW_NO)]
    return [tuple(r) for r in df.orderBy(S.ROW_NO).select(*names).collect()]


def test_quotes_and_blank_rows(spark, tmp_path):
    path = write(tmp_path / "a.csv", '\ufeffA, B ,C\n1,"EQ,D","say ""hi"""\n\n , ,\n 2 ,,x\n')
    df = S.read_table(spark, path)
    assert df.columns[:3] == ["A", "B", "C"]
    assert rows(df) == [("1", "EQ,D", 'say "hi"'), (" 2 ", "", "x")]


def test_ragged_rows(spark, tmp_path):
    df = S.read_table(spark, write(tmp_path / "a.csv", "A,B,C\n1,2\n3,4,5\n6,7,8,9\n"))
    assert rows(df) == [("1", "2", ""), ("3", "4", "5"), ("6", "7", "8")]
    flagged = [r[S.CORRUPT] for r in df.orderBy(S.ROW_NO).collect()]
    assert flagged == ["1,2", None, "6,7,8,9"]
    from limitlens.operators.profile import profile_warnings
    assert {r["code"]: r["rows"] for r in profile_warnings(df, "A").collect()} == {"RAGGED_ROWS": 2}


@pytest.mark.parametrize("header", ["A,,B", "A,a", " , "])
def test_bad_header(spark, tmp_path, header):
    with pytest.raises(S.TableError):
        S.read_table(spark, write(tmp_path / "a.csv", header + "\n1,2,3\n"))


def test_encodings(spark, tmp_path):
    text = "이름,값\n한도,1\n초과,2\n"
    utf8 = write(tmp_path / "utf8.csv", text)
    cp949 = write(tmp_path / "cp949.csv", text, "cp949")
    want = [("한도", "1"), ("초과", "2")]
    assert rows(S.read_table(spark, utf8)) == want
    assert rows(S.read_table(spark, cp949)) == want
    assert rows(S.read_table(spark, cp949, S.CP949)) == want
    with pytest.raises(S.TableError):
        S.read_table(spark, cp949, S.UTF8)
    broken = tmp_path / "broken.csv"
    broken.write_bytes("이름,값\n".encode("cp949") + b"\xff\xff,1\n")
    with pytest.raises(Exception, match="CP949"):
        S.read_table(spark, str(broken), S.CP949).collect()
    with pytest.raises(ValueError):
        S.read_table(spark, utf8, "latin1")


def test_header_of_every_file(spark, tmp_path):
    write(tmp_path / "a.csv", "A,B\n1,2\n")
    write(tmp_path / "b.csv", "A,B\n3,4\n")
    assert sorted(rows(S.read_table(spark, str(tmp_path)))) == [("1", "2"), ("3", "4")]
    write(tmp_path / "c.csv", "B,A\n5,6\n")
    with pytest.raises(Exception, match="(?i)header"):
        S.read_table(spark, str(tmp_path)).collect()


def test_ascii_files_fit_either_encoding(spark, tmp_path):
    for folder, encoding in (("x", "cp949"), ("y", "utf-8")):
        (tmp_path / folder).mkdir()
        write(tmp_path / folder / "a.csv", "A,B\nplain,1\n")
        write(tmp_path / folder / "b.csv", "A,B\n한도,2\n", encoding)
        assert sorted(rows(S.read_table(spark, str(tmp_path / folder)))) == [("plain", "1"), ("한도", "2")]
    write(tmp_path / "y" / "c.csv", "A,B\n한도,3\n", "cp949")
    with pytest.raises(S.TableError):
        S.read_table(spark, str(tmp_path / "y"))


def test_clause_pack_without_row_order(spark):
    def pack(*texts):
        return G.load_clause_pack(spark.createDataFrame(
            [("R1", t, "S", "2026-01-01", "", "p") for t in texts], list(G.CLAUSE_COLUMNS)))

    assert pack("one", "one", "one").clauses.count() == 1
    assert pack("one", "two").clauses.count() == 0 and pack("one", "two").findings.count() == 1


def test_standard_layout_prunes_partitions(spark, tmp_path):
    text = "BASE_DT,PORTFOLIO_ID,RISK_FACTOR,EXPOSURE_AMT\n" + "".join(
        f" 2026061{d} ,P{i},F,{i}\n" for d in range(3) for i in range(4))
    raw = S.read_table(spark, write(tmp_path / "e.csv", text))
    target = str(tmp_path / "standard")
    S.write_standard(raw, target, "BASE_DT")
    stored = S.read_standard(spark, target)
    limits = spark.createDataFrame([("20260611", "P1", "F", "10", "Y")], "BASE_DT string, PORTFOLIO_ID string, RISK_FACTOR string, LIMIT_AMT string, USE_YN string")
    inputs = L.bind(stored, limits, "20260611", trimmed=True)
    status = L.limit_status(inputs)
    plan = status._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(BASE_DT" in plan and "20260611" in plan
    assert status.count() == 4
    # Same result straight from the file.
    direct = L.limit_status(L.bind(raw, limits, "20260611"))
    key = lambda df: sorted((r["portfolio_id"], r["status"], r["exposure_amt"]) for r in df.collect())
    assert key(status) == key(direct)


def workbook(path, sheets, shared=()):
    """A minimal workbook; cells are (reference, kind, value)."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels",
                   f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        if shared:
            z.writestr("xl/sharedStrings.xml", f'<sst {ns}>' + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        for i, body in enumerate(sheets.values(), 1):
            xml = ""
            for n, cells in enumerate(body, 1):
                xml += f'<row r="{n}">'
                for ref, kind, value in cells:
                    if kind == "inline":
                        xml += f'<c r="{ref}{n}" t="inlineStr"><is><r><t>{value[:1]}</t></r><r><t>{value[1:]}</t></r></is></c>'
                    else:
                        xml += f'<c r="{ref}{n}"{" t=" + chr(34) + "s" + chr(34) if kind == "s" else ""}><v>{value}</v></c>'
                xml += "</row>"
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {ns}><sheetData>{xml}</sheetData></worksheet>")
    return str(path)


def test_workbook(spark, tmp_path):
    first = [[("A", "s", 0), ("B", "inline", "Amount"), ("C", "n", "")], [("A", "s", 1), ("B", "n", "10.5")], [], [("B", "n", "7")]]
    path = workbook(tmp_path / "a.xlsx", {"One": first, "Two": [[("A", "inline", "Other")], [("A", "n", "1")]]}, ["Name", "x"])
    workbook(tmp_path / "b.xlsx", {"One": [[("A", "inline", "Name"), ("B", "inline", "Amount")], [("B", "n", "3")]]})
    df = W.read_workbook_table(spark, path)
    assert rows(df) == [("x", "10.5"), ("", "7")]
    assert rows(W.read_workbook_table(spark, path, "Two"), "Other") == [("1",)]
    both = W.read_workbook_table(spark, str(tmp_path))
    assert rows(both) == [("x", "10.5"), ("", "7"), ("", "3")]
    with pytest.raises(Exception, match="no sheet"):
        W.read_workbooks(spark, path, "None").collect()
    assert W.read_workbooks(spark, str(tmp_path), max_bytes=1).count() == 0


def test_workbook_equals_table(spark, tmp_path):
    header = ["BASE_DT", "PORTFOLIO_ID", "RISK_FACTOR", "EXPOSURE_AMT"]
    body = [header, [DAY, "P", "F", "5"], [DAY, "Q", "F", "50"]]
    book = workbook(tmp_path / "e.xlsx", {"S": [[("ABCD"[i], "inline" if n == 0 else "n", v) for i, v in enumerate(r)] if n == 0 else
                                              [("A", "n", r[0]), ("B", "inline", r[1] + " "), ("C", "inline", r[2] + " "), ("D", "n", r[3])]
                                              for n, r in enumerate(body)]})
    plain = write(tmp_path / "e.csv", "\n".join(",".join(r) for r in body) + "\n")
    limits = spark.createDataFrame([(DAY, "P", "F", "10", "Y")], "BASE_DT string, PORTFOLIO_ID string, RISK_FACTOR string, LIMIT_AMT string, USE_YN string")
    key = lambda df: sorted((r["portfolio_id"], r["status"]) for r in L.limit_status(L.bind(df, limits, DAY)).collect())
    assert key(W.read_workbook_table(spark, book)) == key(S.read_table(spark, plain)) == [("P", "NORMAL"), ("Q", "NO_LIMIT")]


def test_mapping():
    good = {"Mappings": {n: n.upper() for n in P.DEFAULT_NAMES}}
    loaded = P.mapping_from_json(json.dumps(good).replace("}}", ",}, /* note */ }"))
    assert not loaded.used_fallback and loaded.physical("BaseDate") == "BASEDATE"
    optional = {"Mappings": {n: n for n in P.REQUIRED}}
    assert P.mapping_from_json(json.dumps(optional)).find("UnitCode") is None
    base = good["Mappings"]
    for bad in (
        "[]", "{", '{"Other": {}}', json.dumps({"Mappings": {**base, "Nope": "x"}}), json.dumps({"Mappings": {**base, "UseYn": 1}}),
        json.dumps({"Mappings": {k: v for k, v in base.items() if k != "UseYn"}}), json.dumps({"Mappings": {**base, "UseYn": base["LimitAmount"]}}),
        '{"Mappings": {"UseYn": "a", "useyn": "b"}}',
    ):
        loaded = P.mapping_from_json(bad)
        assert loaded.used_fallback and loaded.names == P.DEFAULT_NAMES and loaded.warnings, bad
    assert P.mapping_from_file("/nowhere/mapping.json").used_fallback


CATALOG = ("source_id,category,title,source_org,source_type,status,note,source,version,effective_date,repeal_date,file_hash,loaded_date,"
           "approval_status,superseded_by,license_status\n")


def test_catalog(spark, tmp_path):
    text = CATALOG + "A,c,t,o,y,CATALOG_ONLY,n,s,v,2026-01-01,,h,2026-01-01,ok,,pub\nB,c,t,o,y,PROD_ONLY,n,s,v,2026/01/01,,,\n"
    loaded = G.load_catalog(S.read_table(spark, write(tmp_path / "c.csv", text)))
    assert loaded.errors.count() == 0
    assert G.require_clean(loaded.entries, loaded.errors, "catalog").count() == 2
    soft = {(r["source_id"], r["problem"], r["field"]) for r in loaded.warnings.collect()}
    assert {("B", "DATE_FORMAT", "effective_date"), ("B", "METADATA_BLANK", "file_hash"), ("B", "DATE_BLANK", "loaded_date"),
            ("", "FIELDS_MISSING", "")} <= soft
    assert not any(s[0] == "A" for s in soft)
    broken = G.load_catalog(S.read_table(spark, write(tmp_path / "d.csv", CATALOG + "A,,t,o,y,s,n\nX,y\n")))
    problems = {(r["problem"], r["field"]) for r in broken.errors.collect()}
    assert ("REQUIRED_VALUE_BLANK", "category") in problems and ("TOO_FEW_FIELDS", "") in problems
    with pytest.raises(Exception, match="catalog: errors"):
        G.require_clean(broken.entries, broken.errors, "catalog").collect()
    with pytest.raises(S.TableError):
        G.load_catalog(S.read_table(spark, write(tmp_path / "e.csv", "source_id,title\na,b\n")))
    legacy = G.load_catalog(S.read_table(spark, write(tmp_path / "f.csv", "source_id,category,title,source_org,source_type,status,note\na,b,c,d,e,f,g\n")))
    assert legacy.errors.count() == 0 and legacy.warnings.filter("problem = 'METADATA_COLUMN_MISSING'").count() == 9


PACK = "clause_ref,clause_body,source_id,effective_date,repeal_date,pack_version\n"


def test_clause_pack(spark, tmp_path):
    good = PACK + "R1,text one,S,2026-01-01,,p\nR2,text two,S,2026-01-01,,p\nR1,text one,S,2026-01-01,,p\n"
    pack = G.load_clause_pack(S.read_table(spark, write(tmp_path / "a.csv", good)))
    got = G.ordered_clauses(pack.clauses).collect()
    assert [r["clause_ref"] for r in got] == ["R1", "R2"] and pack.findings.count() == 0
    body = hashlib.sha256(b"text one").hexdigest()
    assert got[0]["chunk_id"] == "clause-" + hashlib.sha256(f"1:S2:R11:p64:{body}".encode()).hexdigest()[:12]
    for line, code in (("R1,other,S,2026-01-01,,p\n", "KB_CLAUSE_PACK_DUPLICATE_NATURAL_KEY"),
                       ("R3,,S,2026-01-01,,p\n", "KB_CLAUSE_PACK_ROW_SKIPPED"),
                       ("R3,x,S,2026-01-01,,p,extra\n", "KB_CLAUSE_PACK_ROW_SKIPPED")):
        bad = G.load_clause_pack(S.read_table(spark, write(tmp_path / "b.csv", good + line)))
        assert bad.clauses.count() == 0, line
        assert [r["code"] for r in bad.findings.collect()] == [code]
    headless = G.load_clause_pack(S.read_table(spark, write(tmp_path / "c.csv", "clause_ref,source_id\na,b\n")))
    assert headless.clauses.count() == 0 and headless.findings.count() == 4


def test_logs(spark, tmp_path):
    good = {"taskId": "t1", "createdAt": "2026-01-01T00:00:00Z", "userId": HASH, "taskType": "x", "toolType": "y",
            "requestHash": HASH, "outputHash": None, "safetyResult": "PASS", "ruleVersion": "ruleset-0123456789ab"}
    lines = [json.dumps(good), "", "{not json", json.dumps({**good, "taskId": " "}), json.dumps({**good, "ruleVersion": "x", "outputHash": "zz"})]
    path = write(tmp_path / "task.jsonl", "\n".join(lines) + "\n")
    log = J.read_log(spark, path, "task")
    from limitlens.operators.audit import log_findings
    assert log_findings(log.cache(), "TaskLog").first()["bad_lines"] == 1
    records = J.records(log)
    assert records.count() == 3
    ok, bad = J.split(records, "task")
    assert ok.count() == 1 and sorted(tuple(r["violations"]) for r in bad.collect()) == [("outputHash", "ruleVersion"), ("taskId",)]
    target, held = str(tmp_path / "out"), str(tmp_path / "held")
    J.append_log(records, target, "task", held)
    J.append_log(ok, target, "task")
    assert J.records(J.read_log(spark, target, "task")).count() == 2
    assert spark.read.json(held).count() == 2
    with pytest.raises(Exception, match="task log"):
        J.append_log(records, target, "task")
    assert J.records(J.read_log(spark, target, "task")).count() == 2


def test_suggestion_log(spark):
    base = {"suggestionId": HASH, "providerId": "p", "language": "Sql", "kind": "Keyword", "mode": "m", "userHash": HASH, "insertTextHash": HASH}
    df = spark.createDataFrame([base, {**base, "kind": "SafetyHint"}, {**base, "mode": ""}],
                               "suggestionId string, providerId string, language string, kind string, mode string, userHash string, insertTextHash string")
    df = df.withColumn("acceptedAtUtc", F.current_timestamp())
    ok, bad = J.split(df, "suggestion")
    assert ok.count() == 1 and sorted(r["violations"][0] for r in bad.collect()) == ["kind", "mode"]


def test_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    entry = {"feedbackId": "f", "taskId": "t", "createdAt": "2026-01-01T00:00:00Z", "userId": HASH, "feedbackCode": "APPROVED", "reviewStatus": ""}
    write(source / "a.jsonl", json.dumps(entry) + "\n{bad\n")
    write(source / "b.jsonl", json.dumps({**entry, "userId": "plain"}) + "\n" + json.dumps({**entry, "feedbackId": "g"}) + "\n")
    lines = stream.stream_log(spark, str(source), "feedback", files_per_batch=1)
    queries = stream.append_stream(lines, "feedback", str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "ck"), once=True)
    for query in queries:
        query.awaitTermination(120)
    good = {r["feedbackId"] for r in spark.read.json(str(tmp_path / "good")).collect()}
    assert good == {"f", "g"}
    assert spark.read.json(str(tmp_path / "bad")).count() == 2


def rule_folder(tmp_path, **changes):
    content = {
        "sql_deny_patterns.txt": "# comment\n\\bDROP\\b\n\n", "sql_warn_patterns.txt": "SELECT\\s+\\*\n",
        "vba_deny_patterns.txt": "\\bKill\\b\n", "vba_warn_patterns.txt": "# c\nREQUIRE_PRESENT: Option\\s+Explicit\nDisplayAlerts\n",
        "excel_2021_blocked_functions.txt": "TAKE\nDROP\n", "excel_2021_preferred_functions.txt": "", "excel_2021_completion_allow_functions.txt": "INDEX\n",
        **changes,
    }
    folder = tmp_path / f"rules{len(changes)}"
    folder.mkdir()
    for name, text in content.items():
        write(folder / name, text)
    return str(folder), content


def test_rule_files(spark, tmp_path):
    folder, content = rule_folder(tmp_path)
    loaded = U.load_rule_set(spark, folder)
    assert [(r.code, r.pattern, r.severity) for r in loaded.of(R.SQL_DENY, R.SQL_WARN, R.MACRO_DENY)] == [
        ("SQL_DDL_DROP", r"\bDROP\b", "Blocker"), ("SQL_SELECT_STAR", r"SELECT\s+\*", "Medium"), ("VBA_KILL", r"\bKill\b", "Blocker")]
    assert [r.pattern for r in loaded.of(R.MACRO_REQUIRED)] == [r"Option\s+Explicit"]
    assert [r.pattern for r in loaded.of(R.BLOCKED_FUNCTION)] == ["TAKE", "DROP"]
    material = "".join(f"{n}\n{content[n]}\n" for n in sorted(content, key=str.upper))
    assert loaded.version == "ruleset-" + hashlib.sha256(material.encode()).hexdigest()[:12]
    empty, _ = rule_folder(tmp_path, **{"sql_deny_patterns.txt": "# none\n"})
    with pytest.raises(ValueError, match="sql_deny"):
        U.load_rule_set(spark, empty)


RULE_SET = {
    "RuleSetId": "R", "RuleSetVersion": "1", "EffectiveDate": "2026-06-21",
    "Components": [{"ComponentId": "C1", "Name": "n", "Category": "c", "ValuePolicy": "v"}],
    "ComponentMap": [{"ComponentId": "C1", "SourceName": "s", "ColumnName": "c", "DataType": "DECIMAL", "Required": True}],
    "FormulaDescription": "d", "ValidationSqlTemplates": ["SELECT a FROM v WHERE d = @D"], "RegulationBasis": "b",
    "ApprovalHistory": [{"Status": "s", "ReviewerRole": "r", "ApprovedAt": "t", "Note": "n"}],
}


def test_nested_rules(spark, tmp_path):
    good, bad = dict(RULE_SET), json.loads(json.dumps(RULE_SET))
    bad.update(RuleSetId=" ", EffectiveDate="21.06.2026", ApprovalHistory=[], ValidationSqlTemplates=["DELETE FROM x", "SELECT 1"])
    bad["Components"].append({"ComponentId": "C2", "Name": ""})
    bad["ComponentMap"][0]["ComponentId"] = "C9"
    write(tmp_path / "good.json", "/* note */ " + json.dumps(good, indent=1))
    write(tmp_path / "bad.json", json.dumps(bad))
    write(tmp_path / "broken.json", "{")
    loaded = N.load_rule_sets(N.read_rule_sets(spark, str(tmp_path)), R.default_rule_set(spark))
    found = {}
    for r in loaded.findings.collect():
        found.setdefault(r["file"].rsplit("/", 1)[1], []).append(r["code"])
    assert set(found) == {"bad.json", "broken.json"}
    assert sorted(found["bad.json"]) == sorted([
        "NCR_RULESET_REQUIRED_FIELD_MISSING", "NCR_RULESET_REQUIRED_FIELD_MISSING", "NCR_RULESET_EFFECTIVE_DATE_INVALID",
        "NCR_COMPONENT_INCOMPLETE", "SQL_DML_DELETE", "SQL_NO_SELECT"])
    assert [r["RuleSetId"] for r in loaded.usable.collect()] == ["R"]
    assert N.children(loaded.usable, "Components").first()["ComponentId"] == "C1"
    assert N.unmapped_components(loaded.usable).count() == 0
    assert [r["ComponentId"] for r in N.unmapped_components(loaded.rule_sets).collect()] == ["C9"]


def test_manifest(spark, tmp_path):
    root = tmp_path / "data set"
    (root / "rules").mkdir(parents=True)
    files = {"a.txt": b"one", "rules/b.txt": b"two", "rules/extra.txt": b"three"}
    for name, content in files.items():
        (root / name).write_bytes(content)
    sha = {n: hashlib.sha256(c).hexdigest() for n, c in files.items()}
    schema = "path string, size long, sha256 string, class string, required boolean"
    inventory = M.file_inventory(spark, str(root))
    assert {r["path"] for r in inventory.collect()} == set(files)
    watched = F.col("path").startswith("rules/")
    clean = spark.createDataFrame([(n, len(c), sha[n].upper(), "App", True) for n, c in files.items()], schema)
    assert M.manifest_audit(clean, inventory, ["a.txt"], watched).count() == 0
    assert M.manifest_result(M.manifest_audit(clean, inventory)).first()["status"] == "OK"
    dirty = spark.createDataFrame([
        ("a.txt", 4, sha["a.txt"], "App", True), ("rules/b.txt", 3, "0" * 64, "Rules", True), ("gone.txt", 1, "x", "App", True),
        ("optional.txt", 1, "x", "App", False), ("../up.txt", 1, "x", "", True), ("C:/x", 1, "x", "", True), ("", 1, "x", "", True),
    ], schema)
    found = {(r["problem"], r["path"]) for r in M.manifest_audit(dirty, inventory, ["must.txt"], watched).collect()}
    assert found == {
        ("SIZE_MISMATCH", "a.txt"), ("HASH_MISMATCH", "rules/b.txt"), ("FILE_MISSING", "gone.txt"), ("FILE_UNDECLARED", "rules/extra.txt"),
        ("PATH_UNSAFE", "../up.txt"), ("PATH_UNSAFE", "C:/x"), ("PATH_EMPTY", ""), ("ENTRY_MISSING", "must.txt")}
    result = M.manifest_result(M.manifest_audit(dirty, inventory, (), watched)).first()
    assert result["status"] == "FAIL_CLOSED" and result["blocked_classes"] == ["App", "Rules"]


def test_corpus_guard(spark, tmp_path):
    (tmp_path / "kb").mkdir()
    write(tmp_path / "kb" / "ok.md", "nothing here")
    write(tmp_path / "kb" / "bad.TXT", "line\nThe Full Text follows\n")
    write(tmp_path / "kb" / "Official_Text.bin", "x")
    write(tmp_path / "kb" / "ignored.bin", "full text")
    write(tmp_path / "kb" / "allowed.md", "official text")
    found = {r["path"] for r in M.corpus_guard(spark, str(tmp_path), ["KB/allowed.md"]).collect()}
    assert found == {"kb/bad.TXT", "kb/Official_Text.bin"}


def test_workbooks_with_another_header(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", {"S": [[("A", "inline", "Name")], [("A", "n", "1")]]})
    workbook(tmp_path / "b.xlsx", {"S": [[("A", "inline", "Other")], [("A", "n", "2")]]})
    with pytest.raises(Exception, match="other header"):
        W.read_workbook_table(spark, str(tmp_path)).collect()


def test_empty_manifest_fails_closed(spark):
    entries = spark.createDataFrame([], "path string, size long, sha256 string, class string, required boolean")
    files = spark.createDataFrame([], "path string, actual_size long, actual_sha256 string")
    row = M.manifest_result(M.manifest_audit(entries, files)).first()
    assert (row["status"], row["problem_count"]) == ("FAIL_CLOSED", 1)
