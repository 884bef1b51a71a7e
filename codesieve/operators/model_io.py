"""Requests to and responses from an external model, as tables. Nothing here calls a network."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve import schemas
from codesieve.fixed import models as fixed
from codesieve.functions.identity import finding_id
from codesieve.functions.paths import detect_language
from codesieve.operators.parents import parent_has_auth

FINDING_ITEM = ", ".join([
    "severity string", "category string", "cwe string", "owasp string", "file string", "line int", "code_snippet string", "description string",
    "impact string", "remediation string", "`references` array<string>", "cvss_score double", "confidence string"])

INTRO = "Review the source file below as an application security engineer and report vulnerabilities that can be exploited."
TASK_FOCUS = {
    "sast": "Look for injection (SQL, NoSQL, command, XPath), cross-site scripting, broken authentication or authorization, exposed "
            "data, weak cryptography, path traversal and unsafe deserialization. Give location, impact, remedy and CWE of each.",
    "validation": "Decide whether the reported issue is real. Validated input, safe APIs and proper controls speak against it.",
    "poc_generation": "Show how the issue is exploited: steps, payload, expected and actual behaviour, impact.",
}
NOISE_RULES = """AVOID FALSE POSITIVES
1. A check that raises an error for an unauthenticated caller is the control, not the flaw.
2. Parsing JSON, loading configured keys and unpacking keyword arguments are normal; pickle and unsafe YAML on foreign data are not.
3. Test fixtures and mock servers may hold made-up keys and skip authentication.
4. HIGH means a clear attack path, MEDIUM depends on context, LOW is theoretical."""
CLIENT_RULES = "5. This is a client library: the server authorizes, owns the identifiers it is passed, and its responses are trusted."
PARENT_RULES = "6. A parent class already checks authentication; its children inherit that."
RELAXED_RULES = "7. Data comes from trusted endpoints: only pickle, unsafe YAML and eval are dangerous ways to read it."
OUTPUT_FORMAT = ("Answer with a JSON array of objects with the fields severity, category, cwe, owasp, line, code_snippet, description, impact, "
                 "remediation, references and confidence; [] if there is nothing to report.")


def build_requests(src_files: DataFrame, file_context: DataFrame, repo_profile: DataFrame, policies: dict | None = None, task: str = "sast",
                   instructions: str = "Perform security code review.", exemplars: str = "", custom_prompt: str | None = None) -> DataFrame:
    """One request per file: system prompt chosen by its repository and context, and the text as the user message."""
    ctx = file_context.join(parent_has_auth(file_context), ["repo_id", "path"])
    ctx = ctx.select("repo_id", "path", F.struct("is_test_file", "is_mock", "has_auth_check", "parent_classes", "parent_has_auth").alias("c"))
    prof = repo_profile.select("repo_id", F.struct("codebase_type", "deserialization_strict").alias("p"))
    files = src_files.join(ctx, ["repo_id", "path"], "left").join(prof, "repo_id", "left")
    yes = lambda c: F.when(c, "True").otherwise("False")
    parents = F.when(F.size("c.parent_classes") > 0, F.array_join("c.parent_classes", ", ")).otherwise("None")
    about = F.when(F.col("c").isNotNull(), F.concat_ws(
        "\n", F.lit("FILE CONTEXT:"), F.concat(F.lit("- Is test file: "), yes(F.col("c.is_test_file"))),
        F.concat(F.lit("- Is mock: "), yes(F.col("c.is_mock"))), F.concat(F.lit("- Has auth checks: "), yes(F.col("c.has_auth_check"))),
        F.concat(F.lit("- Parent classes: "), parents), F.when(F.col("c.parent_has_auth"), "- Parent class HAS authentication checks")))
    kind = F.coalesce("p.codebase_type", F.lit("unknown"))
    rules = F.concat_ws(
        "\n", F.lit(NOISE_RULES), F.when(kind == "client_sdk", CLIENT_RULES), F.when(F.col("c.parent_has_auth"), PARENT_RULES),
        F.when(~F.coalesce("p.deserialization_strict", F.lit(True)), RELAXED_RULES))
    language = detect_language(F.col("path"))
    focus = TASK_FOCUS.get(task.lower())
    system = F.lit(custom_prompt) if custom_prompt else F.concat_ws(
        "\n\n", F.lit(INTRO), F.concat_ws("\n", F.concat(F.lit("FILE: "), F.col("path")), F.concat(F.lit("TYPE: "), language),
                                          F.concat(F.lit("CODEBASE TYPE: "), kind)),
        about, F.lit("INSTRUCTIONS:\n" + instructions), rules, F.lit(focus), F.lit(exemplars or None), F.lit(OUTPUT_FORMAT),
        F.lit("CUSTOM POLICIES:\n" + json.dumps(policies, indent=2) if policies else None))
    user = F.concat(F.lit("Analyze this "), language, F.lit(" code for security vulnerabilities:\n\nFile: "), F.col("path"), F.lit("\n\n```"),
                    language, F.lit("\n"), F.col("content"), F.lit("\n```\n"))
    return files.select("repo_id", "path", F.lit(task).alias("task"), system.alias("system"), user.alias("user"))


def select_model(requests: DataFrame, pinned: str | None = None) -> DataFrame:
    """Adds the model of each request's task, or the pinned one."""
    if pinned:
        return requests.withColumn("model", F.lit(pinned))
    table = F.create_map(*[F.lit(x) for pair in fixed.TASK_MODELS for x in pair])
    return requests.withColumn("model", F.coalesce(F.try_element_at(table, F.lower("task")), F.lit(fixed.DEFAULT_MODEL)))


def _finding(repo_id: Column, file: Column, id_: Column, item: Column, ord_: Column) -> list[Column]:
    """A finding with the defaults of a model's item."""
    empty = F.lit("")
    defaults = {
        "severity": F.lit("MEDIUM"), "category": F.lit("Unknown"), "cwe": None, "owasp": None, "line": None, "code_snippet": empty,
        "description": empty, "impact": empty, "remediation": empty, "references": F.array().cast("array<string>"), "cvss_score": None,
        "confidence": F.lit("MEDIUM"),
    }
    values = {k: item[k] if d is None else F.coalesce(item[k], d) for k, d in defaults.items()}
    values.update(repo_id=repo_id, file=file, id=id_, origin=F.lit("model"), ord=ord_.cast("bigint"))
    return [values[c].alias(c) for c in schemas.FINDING_COLUMNS]


def parse_array_response(responses: DataFrame, id_prefix: str = "FIND", file_from_item: bool = False) -> DataFrame:
    """Findings out of the widest [...] of a response; a response that does not parse gives none.

    Needs the columns repo_id, path and raw.
    """
    body = F.regexp_extract("raw", r"(?s)\[.*\]", 0)
    items = F.from_json(F.nullif(body, F.lit("")), f"array<struct<{_as_struct(FINDING_ITEM)}>>")
    rows = responses.select("repo_id", "path", F.posexplode(items).alias("pos", "item"))
    if file_from_item:
        file, id_ = F.coalesce("item.file", F.lit("")), F.concat(F.lit(id_prefix + "-"), F.col("pos").cast("string"))
    else:
        file, id_ = F.col("path"), finding_id(id_prefix, F.col("path"), F.col("pos"))
    return rows.select(*_finding(F.col("repo_id"), file, id_, F.col("item"), F.col("pos")))


def _as_struct(fields: str) -> str:
    return ", ".join(f.replace(" ", ": ", 1) for f in fields.split(", "))


def parse_object_response(responses: DataFrame) -> DataFrame:
    """Findings of a response that is a JSON object, or holds one in a fenced block."""
    schema = f"findings array<struct<{_as_struct(FINDING_ITEM)}>>"
    whole = F.get_json_object("raw", "$").isNotNull()
    fenced = F.nullif(F.regexp_extract("raw", r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    found = F.from_json(F.when(whole, F.col("raw")).otherwise(fenced), schema)["findings"]
    rows = responses.select("repo_id", "path", F.posexplode(found).alias("pos", "item"))
    return rows.select(*_finding(F.col("repo_id"), F.col("path"), finding_id("FIND", F.col("path"), F.col("pos")), F.col("item"), F.col("pos")))


def parse_chat_envelope(responses: DataFrame) -> DataFrame:
    """Content and tokens of a chat completion; a response without content becomes an error row."""
    doc = F.from_json("response", schemas.CHAT_ENVELOPE)
    keep = [c for c in responses.columns if c != "response"]
    content = F.get("_d.choices", F.lit(0))["message"]["content"]
    return responses.select(*keep, doc.alias("_d")).select(
        *keep, content.alias("raw"), F.when(content.isNotNull(), F.coalesce("_d.usage.total_tokens", F.lit(0))).otherwise(0).alias("total_tokens"),
        F.when(content.isNull(), "Invalid response structure").alias("error"))


def cost_of_request(usage_log: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Adds the model id of an alias and the price of the tokens; an unknown model costs nothing."""
    ids = F.create_map(*[F.lit(x) for pair in fixed.MODEL_IDS for x in pair])
    log = usage_log.withColumn("model_id", F.coalesce(F.try_element_at(ids, F.col("model")), F.col("model")))
    if prices is None:
        table = F.create_map(*[x for m, i, o in fixed.PRICES for x in (F.lit(m), F.struct(F.lit(i).alias("i"), F.lit(o).alias("o")))])
        log = log.withColumn("_p", F.try_element_at(table, F.col("model_id")))
    else:
        log = log.join(prices.select("model_id", F.struct(F.col("input").alias("i"), F.col("output").alias("o")).alias("_p")), "model_id", "left")
    million = F.lit(1_000_000)
    cost = F.col("input_tokens") / million * F.col("_p.i") + F.col("output_tokens") / million * F.col("_p.o")
    exact = log.withColumn("exact_cost", F.coalesce(cost, F.lit(0.0))).drop("_p")
    return exact.withColumn("cost", F.bround("exact_cost", 6))


def usage_totals(usage_log: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Requests, tokens and cost by model, and in all (model null)."""
    log = cost_of_request(usage_log, prices)
    rows = log.rollup("model_id").agg(
        F.count(F.lit(1)).alias("requests"), F.sum("input_tokens").alias("total_input_tokens"), F.sum("output_tokens").alias("total_output_tokens"),
        F.sum("exact_cost").alias("_cost"))
    return rows.select(
        "model_id", "requests", "total_input_tokens", "total_output_tokens", (F.col("total_input_tokens") + F.col("total_output_tokens")).alias("total_tokens"),
        F.round("_cost", 4).alias("total_cost"), F.round(F.col("_cost") / F.col("requests"), 4).alias("average_cost_per_request"))


def last_requests(usage_log: DataFrame, k: int = 10, prices: DataFrame | None = None) -> DataFrame:
    return cost_of_request(usage_log, prices).drop("exact_cost").orderBy(F.col("ts").desc(), *[c for c in ("request_id",) if c in usage_log.columns]).limit(k)


def score_with(requests: DataFrame, scorer, schema) -> DataFrame:
    """Run a caller's own offline scorer, a function over batches of pandas frames, on the requests."""
    return requests.mapInPandas(scorer, schema)
