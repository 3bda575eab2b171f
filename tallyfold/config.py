"""The target schema and the policy: declarative documents, folded into plans as literals."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Field:
    name: str
    kind: str  # string, email, phone, date, decimal, enum
    required: bool = False
    values: tuple[str, ...] = ()
    pattern: str | None = None
    material: bool = False
    default: str | None = None
    unique: bool = False
    references: str | None = None
    region: str = "IN"


@dataclass(frozen=True)
class Policy:
    """Thresholds of every decision. Fixed values."""

    accept_mapping: float = 0.85
    mapping_margin: float = 0.10
    unmapped_below: float = 0.50
    accept_value: float = 0.80
    enum_distance: int = 1
    date_formats: tuple[str, ...] = ("yyyy-M-d", "d-M-yyyy", "d/M/yyyy", "d-MMM-yyyy", "d MMM yyyy", "yyyy/M/d")
    merge_above: float = 0.90
    ask_band: tuple[float, float] = (0.72, 0.90)
    separate_confidence: float = 0.75
    precedence: tuple[str, ...] = ("legacy_hris", "payroll", "crm")
    retries: int = 4
    retry_on: tuple[int, ...] = (429, 500, 502, 503, 504)
    escalate_on: tuple[int, ...] = (400, 409, 422)
    rollback_above: float = 0.10
    ask_dates: bool = True
    judge_most: int = 200
    backoff_ms: int = 250


#: The target schema.
SCHEMA = (
    Field("employee_id", "string", True, pattern=r"^[A-Za-z0-9-]{3,20}$"),
    Field("first_name", "string", True),
    Field("last_name", "string", True),
    Field("work_email", "email", True, unique=True),
    Field("personal_email", "email"),
    Field("phone", "phone"),
    Field("date_of_birth", "date"),
    Field("gender", "enum", values=("male", "female", "other", "undisclosed")),
    Field("hire_date", "date", True, material=True),
    Field("employment_status", "enum", True, values=("active", "on_leave", "terminated"), material=True),
    Field("employment_type", "enum", True, values=("full_time", "part_time", "contract", "intern")),
    Field("department", "string", True, material=True),
    Field("designation", "string", True),
    Field("location", "string"),
    Field("manager_employee_id", "string", material=True, references="employee_id"),
    Field("cost_center", "string"),
    Field("annual_ctc", "decimal", material=True),
    Field("ctc_currency", "enum", values=("INR", "USD", "EUR"), default="INR"),
    Field("termination_date", "date"),
)

#: Reason codes with their scope, whether they are merged by class, whether an answer is learnt.
REASONS = {
    "MAP_AMBIGUOUS": ("column", True, True),
    "MAP_UNMAPPED": ("column", True, True),
    "VALUE_LOW_CONFIDENCE": ("value", True, True),
    "DATE_FORMAT_AMBIGUOUS": ("column", True, True),
    "VALIDATE_TWICE": ("record", False, False),
    "LOGIC_CONTRADICTION": ("record", False, False),
    "DUPE_AMBIGUOUS": ("pair", False, True),
    "CONFLICT_ACROSS_SOURCES": ("value", True, True),
    "PUSH_REJECTED": ("record", False, False),
    "PUSH_UNREACHABLE": ("record", False, False),
}
STATUSES = ("pending", "clean", "blocked", "merged_survivor", "merged", "incomplete", "excluded")


#: The cross-field rules in words, and the field that each is about.
RULE_TEXTS = {
    "R1": ("the termination date is before the hire date", "termination_date"),
    "R2": ("the record is marked terminated but has no termination date", "termination_date"),
    "R3": ("the record isn't marked terminated but has a termination date", "termination_date"),
    "R4": ("the employee would have been under 16 years old at hire", "date_of_birth"),
    "R5": ("the manager is set to the employee's own id", "manager_employee_id"),
    "R6": ("the manager id doesn't match any known employee", "manager_employee_id"),
}
#: Kinds of fields, and the patterns of a schema's or policy's dates in Spark's letters.
KINDS = ("string", "email", "phone", "date", "decimal", "enum")
DATES = {"%Y-%m-%d": "yyyy-M-d", "%d-%m-%Y": "d-M-yyyy", "%d/%m/%Y": "d/M/yyyy", "%d-%b-%Y": "d-MMM-yyyy", "%d %b %Y": "d MMM yyyy", "%Y/%m/%d": "yyyy/M/d"}


@dataclass(frozen=True)
class Schema:
    version: int
    entity: str
    natural_key: str
    fields: tuple[Field, ...] = ()
    rules: tuple[tuple[str, str], ...] = ()  # id, what it says

    def field(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)


def _field(name: str, spec: dict) -> Field:
    known = {"type", "required", "pattern", "unique", "values", "default", "format", "default_region", "references", "material"}
    if odd := set(spec) - known:
        raise TypeError(f"{name}: unknown attributes {sorted(odd)}")
    if spec["type"] not in KINDS:
        raise ValueError(f"{name}: unknown field type {spec['type']!r}")
    if spec["type"] == "enum" and not spec.get("values"):
        raise ValueError(f"{name}: an enumerated field needs values")
    plain = {k: spec[k] for k in ("pattern", "default", "references") if spec.get(k) is not None}
    return Field(name, spec["type"], bool(spec.get("required")), tuple(spec.get("values") or ()), material=bool(spec.get("material")), unique=bool(spec.get("unique")), region=spec.get("default_region") or "IN", **plain)


def load_schema(text: str) -> Schema:
    """A YAML schema document: version, entity, natural_key, fields by name, cross_field_rules. Unknown attributes and kinds are errors."""
    import yaml

    raw = yaml.safe_load(text)
    rules = tuple((r["id"], r["rule"]) for r in raw.get("cross_field_rules") or ())
    if odd := {i for i, _ in rules} - set(RULE_TEXTS):
        raise ValueError(f"unknown rules {sorted(odd)}")
    return Schema(raw["version"], raw["entity"], raw["natural_key"], tuple(_field(name, spec) for name, spec in raw["fields"].items()), rules)


def load_policy(text: str) -> Policy:
    """A YAML policy document: the thresholds of every decision."""
    import yaml

    raw = yaml.safe_load(text)
    mapping, values, dates, dedupe, push = (raw[k] for k in ("mapping", "values", "dates", "dedupe", "push"))
    accepted = dates["accepted_formats"]
    return Policy(
        accept_mapping=mapping["auto_accept_min_confidence"], mapping_margin=mapping["ambiguous_top2_margin"], unmapped_below=mapping["unmapped_below"],
        accept_value=values["auto_accept_min_confidence"], enum_distance=values["enum_auto_max_edit_distance"],
        date_formats=tuple(DATES[f] for f in accepted if f in DATES), ask_dates=dates["escalate_when_multiple_formats_parse_to_different_dates"],
        merge_above=dedupe["auto_merge_above"], ask_band=tuple(dedupe["escalate_band"]), separate_confidence=dedupe["llm_auto_separate_min_confidence"], judge_most=dedupe["llm_judge_max_pairs"],
        precedence=tuple(raw["cross_source"]["precedence"]), retries=push["max_retries"], backoff_ms=push["backoff_base_ms"],
        retry_on=tuple(push["retry_on"]), escalate_on=tuple(push["escalate_on"]), rollback_above=push["offer_rollback_above_failure_rate"],
    )
