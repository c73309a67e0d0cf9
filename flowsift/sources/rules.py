"""Signature rules and limits from a policy file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from flowsift.operators.signatures import Rule

# Patterns used when neither an argument nor a file gives any.
DEFAULT_PATTERNS = [
    "' OR '1'='1",
    "' OR 1=1--",
    "<script>",
    "../../../",
    "/etc/passwd",
    "UNION SELECT",
    "cmd.exe",
    "powershell -e",
    "wget http",
    "curl http",
]
MAX_RULES = 1_000_000  # rules travel to every task


def read_policy(spark: SparkSession, path: str) -> dict:
    """The policy document; read through Spark so any shared file system works."""
    import yaml

    text = spark.read.text(path, wholetext=True).first()
    return (yaml.safe_load(text[0]) if text else None) or {}


def payload_rules(policy: dict) -> list[Rule]:
    rules = []
    for i, entry in enumerate(policy.get("policies") or []):
        if entry.get("type") == "payload_signature":
            rules += [(str(entry.get("id") or entry.get("name") or i), p) for p in entry.get("patterns") or []]
    return rules


def signature_rules(policy: dict) -> tuple[list[Rule], dict[str, int]]:
    """Patterns of the ``signatures`` section and the thresholds of those that have one."""
    entries = policy.get("signatures") or []
    rules = [(str(e["id"]), p) for e in entries for p in e.get("patterns") or []]
    return rules, {str(e["id"]): int(e["threshold"]) for e in entries if e.get("threshold") is not None}


# Protocol numbers by name.
PROTOCOLS = {"icmp": 1, "tcp": 6, "udp": 17}


def signature_attributes(policy: dict) -> dict[str, dict]:
    """Per signature: its name, severity, and protocol number (None for any)."""
    return {
        str(e["id"]): {
            "name": e.get("name"), "severity": e.get("severity"), "protocol": PROTOCOLS.get(str(e.get("protocol")).lower()),
        }
        for e in policy.get("signatures") or []
    }


def limits(policy: dict) -> dict:
    """Named limits (rates, allowed ports) of all policies."""
    found: dict = {}
    for entry in policy.get("policies") or []:
        found |= entry.get("rules") or {}
    return found


def load_rules(spark: SparkSession, given: Sequence[Rule] | None = None, path: str | None = None) -> list[Rule]:
    """An argument wins over a file, a file over the defaults; an empty argument means no rules."""
    if given is not None:
        rules = list(given)
    else:
        rules = payload_rules(read_policy(spark, path)) if path else []
        rules = rules or [(f"default-{i}", p) for i, p in enumerate(DEFAULT_PATTERNS)]
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} fit in a task")
    return rules


def rules_frame(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    return spark.createDataFrame(list(rules), "rule_id string, pattern string")
