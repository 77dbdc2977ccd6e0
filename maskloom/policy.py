"""The masking policy and the small tables it becomes.

A policy is plain configuration (YAML). Its tables are a few dozen rows, so they are
the one thing this package broadcasts without measuring.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field, replace
from pathlib import Path

import pyarrow as pa
import yaml
from pyspark.sql import DataFrame, SparkSession

# Operator names, the default tweak and the notice.
FAKE, FPE, REPLACE = "deterministic_faker", "fpe", "replace"
DEFAULT_TWEAK = "CBD09280979564"
NOTICE = "[PII surrogated — pass back verbatim]"


@dataclass(frozen=True)
class EntityRule:
    operator: str = REPLACE
    tweak: str | None = None
    new_value: str | None = None


@dataclass(frozen=True)
class Recognizer:
    entity: str
    pattern: str
    score: float = 0.85
    operator: str = FPE  # kept for round trips; masking follows the entity rule
    tweak: str | None = None


@dataclass(frozen=True)
class FieldRule:
    pattern: str
    entity: str


@dataclass(frozen=True)
class Policy:
    entities: dict[str, EntityRule] = field(default_factory=dict)
    recognizers: tuple[Recognizer, ...] = ()
    field_rules: tuple[FieldRule, ...] = ()
    never_mask_paths: tuple[str, ...] = ()
    sensitive_args: tuple[str, ...] = ()
    allow_list: tuple[str, ...] = ()
    host_fragments: tuple[str, ...] = ()
    notice: bool = True

    def with_(self, **changes) -> "Policy":
        return replace(self, **changes)

    def entity_names(self) -> list[str]:
        names = [n for n in self.entities if n != "DEFAULT"]
        return names + [r.entity for r in self.recognizers if r.entity not in names]

    def rule_for(self, entity: str) -> EntityRule:
        fallback = self.entities.get("DEFAULT", EntityRule(REPLACE, new_value="<REDACTED>"))
        return self.entities.get(entity, fallback)


# The default policy (entity operators, token patterns, field names).
_FAKE_ENTITIES = ("PERSON", "EMAIL_ADDRESS", "LOCATION", "ADDRESS", "ORGANIZATION", "SECRET")
_FPE_ENTITIES = ("PHONE_NUMBER", "US_SSN", "CREDIT_CARD")
SECRET_PATTERNS = (
    r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b",
    r"\bgh[pousr]_[A-Za-z0-9]{36}\b",
    r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    r"\bsk_(?:live|test)_[A-Za-z0-9]{24,}\b",
    r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b",
    r"\bsk-(?:ant-)?[A-Za-z0-9_-]{20,}\b",
)
FIELD_RULES = (
    FieldRule("*.first_name", "PERSON"),
    FieldRule("*.last_name", "PERSON"),
    FieldRule("*.full_name", "PERSON"),
    FieldRule("*.name", "PERSON"),
    FieldRule("*.email", "EMAIL_ADDRESS"),
    FieldRule("*.email_address", "EMAIL_ADDRESS"),
    FieldRule("*.phone", "PHONE_NUMBER"),
    FieldRule("*.phone_number", "PHONE_NUMBER"),
    FieldRule("*.ssn", "US_SSN"),
    FieldRule("*.social_security_number", "US_SSN"),
    FieldRule("*.password", "SECRET"),
    FieldRule("*.passwd", "SECRET"),
    FieldRule("*.api_key", "SECRET"),
    FieldRule("*.api_secret", "SECRET"),
    FieldRule("*.access_token", "SECRET"),
    FieldRule("*.refresh_token", "SECRET"),
    FieldRule("*.id_token", "SECRET"),
    FieldRule("*.bearer_token", "SECRET"),
    FieldRule("*.client_secret", "SECRET"),
    FieldRule("*.private_key", "SECRET"),
    FieldRule("*.secret_key", "SECRET"),
    FieldRule("*.session_token", "SECRET"),
    FieldRule("*.auth_token", "SECRET"),
    FieldRule("*.authorization", "SECRET"),
)


def default_policy() -> Policy:
    entities = {e: EntityRule(FAKE) for e in _FAKE_ENTITIES}
    entities |= {e: EntityRule(FPE) for e in _FPE_ENTITIES}
    entities["DEFAULT"] = EntityRule(REPLACE, new_value="<REDACTED>")
    return Policy(
        entities=entities,
        recognizers=tuple(Recognizer("SECRET", p, 0.95, FAKE) for p in SECRET_PATTERNS),
        field_rules=FIELD_RULES,
        host_fragments=("assets.",),
    )


def glob_regex(pattern: str) -> str:
    """Shell glob as a whole-string regex: ``*`` crosses dots, case-sensitive."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        close = pattern.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif close > 0:
            body = pattern[i + 1 : close].replace("\\", "\\\\").replace("[", "\\[")
            out.append("[^" + body[1:] + "]" if body[0] == "!" else "[" + body + "]")
            i = close
        else:
            out.append(ch if ch.isalnum() or ch in "_ " or ord(ch) > 127 else "\\" + ch)
        i += 1
    return "(?s)^" + "".join(out) + "$"


# ── YAML ─────────────────────────────────────────────────────────────────


def read_policy(path: str | Path) -> Policy:
    return policy_from_text(Path(path).read_text())


def policy_from_text(text: str) -> Policy:
    raw = yaml.safe_load(text) or {}
    return Policy(
        entities={
            name: EntityRule(c.get("operator", REPLACE), c.get("tweak"), c.get("new_value"))
            for name, c in raw.get("entities", {}).items()
        },
        recognizers=tuple(
            Recognizer(r["entity"], r["pattern"], r.get("score", 0.85), r.get("operator", FPE), r.get("tweak"))
            for r in raw.get("custom_recognizers", [])
        ),
        field_rules=tuple(FieldRule(r["pattern"], r["entity"]) for r in raw.get("field_rules", [])),
        never_mask_paths=tuple(raw.get("never_mask_paths", [])),
        sensitive_args=tuple(raw.get("sensitive_arg_patterns", [])),
        allow_list=tuple(raw.get("allow_list", [])),
        host_fragments=tuple(raw.get("host_fragments", [])),
        notice=raw.get("surrogate_notice", True),
    )


def write_policy(policy: Policy, path: str | Path) -> None:
    """Write every field, so that reading the file back gives an equal policy."""
    Path(path).write_text(policy_text(policy))


def policy_text(policy: Policy) -> str:

    def given(**values):
        return {k: v for k, v in values.items() if v is not None}

    data = {
        "entities": {
            n: given(operator=r.operator, tweak=r.tweak, new_value=r.new_value)
            for n, r in policy.entities.items()
        },
        "custom_recognizers": [
            given(entity=r.entity, pattern=r.pattern, score=r.score, operator=r.operator, tweak=r.tweak)
            for r in policy.recognizers
        ],
        "field_rules": [{"pattern": r.pattern, "entity": r.entity} for r in policy.field_rules],
        "never_mask_paths": list(policy.never_mask_paths),
        "sensitive_arg_patterns": list(policy.sensitive_args),
        "allow_list": list(policy.allow_list),
        "host_fragments": list(policy.host_fragments),
        "surrogate_notice": policy.notice,
    }
    return yaml.safe_dump(data, sort_keys=False, allow_unicode=True)


# ── Tables ───────────────────────────────────────────────────────────────


def _table(spark: SparkSession, **columns) -> DataFrame:
    return spark.createDataFrame(pa.table(columns))


def _tweak_halves(tweak: str) -> tuple[bytes, bytes]:
    raw = bytes.fromhex(tweak)
    if len(raw) == 7:  # the 56-bit form is widened to two 32-bit halves
        raw = raw[:3] + bytes([raw[3] & 0xF0]) + raw[4:7] + bytes([(raw[3] & 0x0F) << 4])
    if len(raw) != 8:
        raise ValueError("an FPE tweak has 7 or 8 bytes")
    return raw[:4], raw[4:]


def round_tweaks(tweak: str) -> list[str]:
    """Byte-reversed hex of the tweak half used in each of the eight rounds."""
    left, right = _tweak_halves(tweak)
    out = []
    for i in range(8):
        half = right if i % 2 == 0 else left
        out.append((half[:3] + bytes([half[3] ^ i]))[::-1].hex().upper())
    return out


def hmac_pads(key: str) -> tuple[bytes, bytes]:
    """Inner and outer HMAC-SHA256 pads for the text form of the key."""
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in raw), bytes(b ^ 0x5C for b in raw)


def policy_table(spark: SparkSession, policy: Policy, key: str, extra_entities=()) -> DataFrame:
    """One row per entity: its operator and the key material that operator needs.

    Keys ride in this table, never in expressions, so plans and event logs show only
    column names. Entities without their own rule get the DEFAULT rule.
    """
    names = list(dict.fromkeys([*policy.entity_names(), *extra_entities]))
    rules = [policy.rule_for(n) for n in names]
    inner, outer = hmac_pads(key)
    fpe_key = bytes.fromhex(key)[::-1]
    return _table(
        spark,
        entity_type=pa.array(names, pa.string()),
        operator=pa.array([r.operator if r.operator in (FAKE, FPE) else REPLACE for r in rules], pa.string()),
        new_value=pa.array(
            [(r.new_value or f"<{n}>") if r.operator == REPLACE else f"<{n}>" for n, r in zip(names, rules)],
            pa.string(),
        ),
        round_tweaks=pa.array([round_tweaks(r.tweak or DEFAULT_TWEAK) for r in rules], pa.list_(pa.string())),
        fpe_key=pa.array([fpe_key] * len(names), pa.binary()),
        inner_pad=pa.array([inner] * len(names), pa.binary()),
        outer_pad=pa.array([outer] * len(names), pa.binary()),
    )
