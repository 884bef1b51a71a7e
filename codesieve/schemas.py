"""Schemas of the tables that cross the engine's border."""

from pyspark.sql import types as T

S, I, L, D, B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


SRC_FILES = _struct(repo_id=S, path=S, content=S)

FINDING_FIELDS = dict(
    id=S, severity=S, category=S, cwe=S, owasp=S, file=S, line=I, code_snippet=S, description=S, impact=S, remediation=S,
    references=T.ArrayType(S), cvss_score=D, confidence=S,
)
FINDING_JSON = _struct(**FINDING_FIELDS)
# The engine adds the repository, where the finding came from and its input order.
FINDINGS = _struct(repo_id=S, **FINDING_FIELDS, origin=S, ord=L)
FINDING_COLUMNS = FINDINGS.fieldNames()

GROUND_TRUTH = _struct(id=S, file=S, cwe=I, is_vulnerable=B, line=I, category=S)

NORM_FINDING = _struct(file=S, line=I, cwe=I, severity=S, rule_id=S)
ENVELOPE = _struct(
    tool=S, tool_version=S, config=S, edition=S, target_root=S, invocation=S, timestamp=S, dry_run=B, finding_count=L,
    findings=T.ArrayType(NORM_FINDING),
)

RULES = _struct(rule_set=S, rule_no=I, rule_id=S, language=S, pattern=S, function_name=S, algorithm_or_library=S)
VECTOR_RULES = _struct(
    rule_set=S, rule_no=I, rule_id=S, language=S, pattern=S, category_key=S, category_name=S, vector_id=S, vector_name=S, cwe=S,
    owasp=S, severity=S, test_payloads=T.ArrayType(S),
)

VECTOR = _struct(
    id=S, name=S, cwe=S, severity=S, detection_patterns=T.ArrayType(S), test_payloads=T.ArrayType(S), category=S, owasp=S
)
VECTOR_CATALOGUE = _struct(
    version=S,
    categories=T.MapType(S, _struct(name=S, owasp=S, vectors=T.ArrayType(VECTOR))),
    custom_vectors=T.ArrayType(VECTOR),
)

SEVERITY_MATRIX = _struct(
    version=S,
    cvss_version=S,
    severity_levels=T.MapType(S, _struct(
        cvss_range=T.ArrayType(D), description=S, response_time=S, examples=T.ArrayType(S), business_impact=S)),
    cvss_metrics=T.MapType(S, T.MapType(S, D)),
    vulnerability_type_severity_mapping=T.MapType(S, T.MapType(S, S)),
    context_modifiers=T.MapType(S, _struct(multiplier=D, description=S)),
)

SEMGREP = _struct(results=T.ArrayType(_struct(
    path=S, check_id=S, start=_struct(line=I), extra=_struct(severity=S, metadata=_struct(cwe=S)))))

_TAGGED = _struct(id=S, properties=_struct(tags=T.ArrayType(S)))
_LOCATION = _struct(physicalLocation=_struct(artifactLocation=_struct(uri=S), region=_struct(startLine=I)))
SARIF = _struct(runs=T.ArrayType(_struct(
    tool=_struct(driver=_struct(rules=T.ArrayType(_TAGGED))),
    results=T.ArrayType(_struct(ruleId=S, level=S, properties=_struct(severity=S), locations=T.ArrayType(_LOCATION))))))

CHAT_ENVELOPE = _struct(
    choices=T.ArrayType(_struct(message=_struct(content=S))),
    usage=_struct(prompt_tokens=L, completion_tokens=L, total_tokens=L),
)

FILE_RUNS = _struct(batch_id=L, path=S, findings=L, seconds=D, error=S)
USAGE_LOG = _struct(ts=T.TimestampType(), model=S, input_tokens=L, output_tokens=L)
