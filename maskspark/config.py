"""What is masked, and how: 27 settings in a frozen dataclass that refuses unknown keys and wrong kinds."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, replace

POLICIES = ("block", "strip", "allow")


@dataclass(frozen=True)
class MaskConfig:
    enabled: bool = True
    redact_paths: bool = False
    redact_tool_meta: bool = True
    persist_mapping: bool = True
    non_text_policy: str = "strip"
    allow_raw_media: bool = False
    preflight_base64: bool = False
    custom_terms: tuple[str, ...] = ()
    preserve_values: tuple[str, ...] = ()
    long_tokens: bool = True
    drop_session_id: bool = True
    cn_entities: bool = True
    strict_id18: bool = True
    restore_inbound: bool = True
    redact_credentials: bool = True
    redact_address: bool = True
    redact_names: bool = True
    redact_companies: bool = True
    redact_orgs: bool = True
    redact_case_numbers: bool = False
    redact_dob: bool = False
    fail_closed: bool = True
    strict_unknown: bool = True
    egress_audit: bool = True
    local_ocr: bool = False
    local_ocr_command: tuple[str, ...] = ()
    log_redactions: bool = True

    def __post_init__(self) -> None:
        for f in fields(self):
            value = getattr(self, f.name)
            if f.type == "bool" and not isinstance(value, bool):
                raise ValueError(f"{f.name} is true or false, not {value!r}")
            if f.type.startswith("tuple"):
                if isinstance(value, str) or not all(isinstance(x, str) for x in value):
                    raise ValueError(f"{f.name} is a list of strings, not {value!r}")
                object.__setattr__(self, f.name, tuple(value))
        if self.non_text_policy not in POLICIES:
            raise ValueError(f"non_text_policy is one of {POLICIES}, not {self.non_text_policy!r}")

    @classmethod
    def from_json(cls, text: str) -> MaskConfig:
        """From a JSON object with keys in camel case or snake case."""
        known = {f.name for f in fields(cls)}
        found = {}
        for key, value in json.loads(text).items():
            name = "".join("_" + c.lower() if c.isupper() else c for c in key)
            if name not in known:
                raise ValueError(f"no such setting: {key}")
            found[name] = value
        return cls(**found)

    def but(self, **changes) -> MaskConfig:
        return replace(self, **changes)


def split_terms(text: str) -> tuple[str, ...]:
    """A list of terms as people type it: cut at semicolons, commas, enumeration commas and line ends, each term once."""
    for sign in "；,，、\n":
        text = text.replace(sign, ";")
    return tuple(dict.fromkeys(x for x in map(str.strip, text.split(";")) if x))
