"""The ordered rules: each finds spans of one category in a text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from maskspark.config import MaskConfig
from maskspark.functions import entities
from maskspark.functions import lexicon as L
from maskspark.functions.validators import looks_like_id18, valid_id18, valid_luhn, valid_uscc

#: A span of text to mask.
Span = tuple[int, int]
Preserved = Callable[[str], bool]

#: White space as the patterns mean it, in any dialect: ASCII and the Unicode spaces.
WS = "[ \\t\\n\\r\\f\\v   -     　﻿]"
NOT_WS = "[^" + WS[1:]


@dataclass(frozen=True)
class Rule:
    """find(text, preserved) gives spans in order.

    What a text must hold for the rule to find anything, which is quick to see: a Han character, one of `signs` (in lower
    case where the rule is `folded`), a run of so many `digits`, a `word` of so many characters without white space.
    """

    cat: str
    find: Callable[[str, Preserved], Iterable[Span]]
    han: bool = False
    after: bool = False  # runs only where the rule before it has changed the text
    pattern: str = ""
    signs: tuple[str, ...] = ()
    folded: bool = False
    digits: int = 0
    word: int = 0


def regex(cat: str, pattern: str, group: int = 0, check: Callable[[str], bool] | None = None, ignore_case: bool = False, **needs) -> Rule:
    compiled = re.compile(pattern, re.ASCII | (re.IGNORECASE if ignore_case else 0))

    def find(text: str, preserved: Preserved) -> Iterable[Span]:
        for m in compiled.finditer(text):
            value = m[group]
            if not preserved(value) and (check is None or check(value)):
                yield m.span(group)

    return Rule(cat, find, pattern=pattern, folded=ignore_case, **needs)


def _any(words: Iterable[str]) -> str:
    return "|".join(words)


_H = "0-9a-fA-F"
_COLON = f"{WS}*[:：]?{WS}*"
_ID_LABEL = "身份证号码|身份证号|身份证|证件号码|证件号|身份证明号码"
_ID_SIGNS = ("身份证", "证件号")
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_ADDRESS = "([^\\n\\r。；;，,\\[]{4,60})"

# The patterns, in the order in which they are applied.
PEM = regex("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----", signs=("PRIVATE KEY-----",))
JWT = regex("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b", signs=("eyJ",))
KEY_PREFIX = regex("key", r"\b(?:sk-[A-Za-z0-9_\-]{8,}|ghp_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|AKIA[0-9A-Z]{16}|xox[baprs]-[A-Za-z0-9\-]{10,})\b", signs=("sk-", "ghp_", "github_pat_", "AKIA", "xox"))
KEY_BEARER = regex("key", f"(?:Bearer|Basic){WS}+([A-Za-z0-9\\-._~+/=]{{16,}})", 1, ignore_case=True, signs=("bearer", "basic"))
KEY_VALUE = regex(
    "key",
    r"\b(?:api[_-]?key|(?:aws[_-]?)?secret[_-]?access[_-]?key|access[_-]?key|secret[_-]?key|token|secret|password|passwd|authorization)\b"
    f"{WS}*[:=]{WS}*[\"']?([A-Za-z0-9\\-._~+/=]{{8,}})[\"']?",
    1, ignore_case=True, signs=("key", "token", "secret", "passw", "authorization"),
)
MAILTO = regex("email", f"mailto:[^@{WS[1:-1]}]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}", ignore_case=True, signs=("mailto:",))
KEY_URL = regex("key", f"(?<![A-Za-z0-9+.-])[a-z][a-z0-9+.-]*://[^/:@{WS[1:-1]}]+:([^/:\\[\\]\\\\{WS[1:-1]}]{{3,}})@(?={NOT_WS})", 1, ignore_case=True, signs=("://",))
KEY_USER = regex("key", f"(?<![A-Za-z0-9._%+\\-/:\\\\])[A-Za-z0-9._%+-]+:([^/:\\[\\]\\\\{WS[1:-1]}]{{3,}})@(?={NOT_WS})", 1, ignore_case=True, signs=("@",))
EMAIL = regex("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", signs=("@",))
PHONE = regex("phone", f"\\+[0-9]{{1,3}}(?:[\\-(){WS[1:-1]}]*[0-9]){{7,14}}", signs=("+",))
IPV4 = regex("ipv4", rf"\b{_OCTET}(?:\.{_OCTET}){{3}}\b", signs=(".",))
IPV6 = regex(
    "ipv6",
    f"(?<![{_H}:])(?:[{_H}]{{1,4}}:){{7}}[{_H}]{{1,4}}(?![{_H}:])"
    f"|(?<![{_H}:])(?:(?:[{_H}]{{1,4}}:){{1,6}}[{_H}]{{1,4}}|(?:[{_H}]{{1,4}}:){{1,7}})::(?:[{_H}]{{1,4}}:){{0,5}}[{_H}]{{1,4}}(?![{_H}:])",
    signs=(":",),
)
MAC = regex("mac", f"(?<![{_H}:])[{_H}]{{2}}(?::[{_H}]{{2}}){{5}}(?![{_H}:])", signs=(":",))
HEX = regex("hex", rf"\b[{_H}]{{40,}}\b", word=40)
B64 = regex("b64", r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32,}={0,2}(?![A-Za-z0-9+/])", word=32)
PATH_POSIX = regex("path", f"/(?:Users|home|private|var|etc|usr|opt|tmp|root|Applications|Library|System|Volumes|mnt|media)/[^\"'`<>\\[\\]{{}};{WS[1:-1]}]{{1,200}}", signs=("/",))
PATH_WINDOWS = regex("path", f"[A-Za-z]:\\\\[^\"'{WS[1:-1]}]{{1,200}}", signs=("\\",))
ID18 = regex("id18", "(?<![0-9])[0-9]{17}[0-9Xx](?![0-9])", check=valid_id18, digits=17)
ID15 = regex("id15", f"(?:{_ID_LABEL}){_COLON}([0-9]{{15}})(?![0-9])", 1, signs=_ID_SIGNS, digits=15)
USCC = regex("uscc", "(?<![0-9A-Za-z])[0-9A-HJ-NPQRTUWXY]{18}(?![0-9A-Za-z])", check=valid_uscc, word=18)
USCC_LABEL = regex("uscc", f"(?:统一社会信用代码|社会信用代码|信用代码|营业执照号|营业执照注册号|USCC|uscc){_COLON}([0-9A-Za-z]{{18}})(?![0-9A-Za-z])", 1, signs=("信用代码", "营业执照", "USCC", "uscc"), word=18)
MOBILE = regex("mobile", "(?<![0-9])1[3-9][0-9]{9}(?![0-9])", digits=11)
MOBILE_SPLIT = regex("mobile", f"(?<![0-9])1[3-9][0-9][-{WS[1:-1]}][0-9]{{4}}[-{WS[1:-1]}][0-9]{{4}}(?![0-9])", digits=4)
TEL = regex("tel", f"(?<![0-9])0[0-9]{{2,3}}[-{WS[1:-1]}]?[0-9]{{7,8}}(?![0-9])", digits=7)
WECHAT = regex("wechat", f"(?:微信号|微信|WeChat|Wechat|wechat|weixin|Weixin|VX){_COLON}([A-Za-z][A-Za-z0-9_-]{{4,19}})(?![A-Za-z0-9_-])", 1, signs=("微信", "hat", "eixin", "VX"))
QQ = regex("qq", f"(?:QQ|qq|扣扣|QQ号|qq号|Q号|企鹅号){_COLON}([1-9][0-9]{{4,11}})(?![0-9])", 1, signs=("QQ", "qq", "扣扣", "Q号", "q号", "企鹅号"), digits=5)
CERTIFICATE = regex("certid", f"(?:律师执业证|执业证号|执业证书号|执业证编号|法律职业资格证){_COLON}([A-Za-z0-9-]{{8,20}})(?![A-Za-z0-9-])", 1, signs=("执业证", "法律职业资格证"))
BANK_LABEL = regex("bank", f"(?:{_any(L.BANK_LABELS)}){_COLON}([0-9]{{16,19}})", 1, signs=L.BANK_LABELS, digits=16)
BANK = regex("bank", "(?<![0-9])(?:[0-9]{16}|[0-9]{19})(?![0-9])", check=valid_luhn, digits=16)
CASE = regex("case", f"[（(]{WS}*[0-9]{{4}}{WS}*[）)]{WS}*[^（）(){WS[1:-1]}]{{2,14}}[0-9]{{1,8}}{WS}*号", signs=("号",), digits=4)
PLATE = regex("plate", f"(?<![0-9A-Za-z])[{L.PROVINCES}][A-Z](?:[DF][A-HJ-NP-Z0-9]{{5}}|[A-HJ-NP-Z0-9]{{5}})(?![0-9A-Za-z])", han=True)
PASSPORT = regex("passport", "(?<![0-9A-Za-z])[EGCHT][0-9]{8}(?![0-9A-Za-z])", digits=8)
BIRTH = regex("dob", f"(?:{_any(L.BIRTH_LABELS)}){_COLON}([0-9]{{4}}{WS}*[年./-]{WS}*[0-9]{{1,2}}{WS}*[月./-]{WS}*[0-9]{{1,2}}{WS}*[日号]?)", 1, signs=L.BIRTH_LABELS, digits=4)
ADDRESS_LABEL = regex("addr", f"(?:{_any(L.ADDRESS_LABELS)}){_COLON}{_ADDRESS}", 1, signs=L.ADDRESS_LABELS)
RESIDENCE = regex("addr", f"住所{WS}*[:：]{WS}*{_ADDRESS}", 1, signs=("住所",))
RESIDENCE_REGION = regex("addr", f"住所(?=[^，,。；;\\n]{{0,8}}?(?:省|市|自治州|地区|盟|区|县)){_ADDRESS}", 1, signs=("住所",))
ID18_LABEL = regex("id18", f"(?:{_ID_LABEL}){_COLON}([0-9]{{17}}[0-9Xx])(?![0-9])", 1, signs=_ID_SIGNS, digits=17)
ID18_LOOSE = regex("id18", "(?<![0-9])[0-9]{17}[0-9Xx](?![0-9])", check=lambda s: valid_id18(s) or looks_like_id18(s), digits=17)

ORG = Rule("org", entities.agencies, han=True)
CHAIN = Rule("addrchain", entities.place_chains, han=True)
CHAIN_STREET = Rule("street", entities.streets_after_placeholder, han=True, after=True)
CHAIN_ROAD = Rule("addrchain", entities.road_chains, han=True)
STREET = Rule("street", entities.streets, han=True)
NAME = Rule("name", entities.names, han=True)
COMPANY = Rule("company", entities.companies, han=True)

_PLACEHOLDER = re.compile(r"\[REDACTED_[A-Z0-9_]+_[0-9]+\]")


def term(value: str) -> Rule:
    """Exact matches of a term, but not inside placeholders."""

    def find(text: str, preserved: Preserved) -> Iterable[Span]:
        if preserved(value):
            return
        taken = [m.span() for m in _PLACEHOLDER.finditer(text)] if "[REDACTED_" in text else []
        at = text.find(value)
        while at >= 0:
            end = at + len(value)
            if not any(s < end and at < e for s, e in taken):
                yield at, end
            at = text.find(value, end)

    return Rule("custom", find)


def active(cfg: MaskConfig) -> list[Rule]:
    """The rules that a configuration switches on, in the order of their application."""
    on = [
        (True, [term(t) for t in cfg.custom_terms if t]),
        (cfg.redact_credentials, [PEM, JWT, KEY_PREFIX, KEY_BEARER, KEY_VALUE]),
        (True, [MAILTO]),
        (cfg.redact_credentials, [KEY_URL, KEY_USER]),
        (True, [EMAIL, PHONE, IPV4, IPV6, MAC]),
        (cfg.long_tokens, [HEX, B64]),
        (cfg.redact_paths, [PATH_POSIX, PATH_WINDOWS]),
        (cfg.cn_entities, [ID18, ID15, USCC, USCC_LABEL, MOBILE, MOBILE_SPLIT, TEL, WECHAT, QQ, CERTIFICATE, BANK_LABEL, BANK]),
        (cfg.cn_entities and cfg.redact_case_numbers, [CASE]),
        (cfg.cn_entities, [PLATE, PASSPORT]),
        (cfg.cn_entities and cfg.redact_dob, [BIRTH]),
        (cfg.cn_entities and cfg.redact_address, [ADDRESS_LABEL, RESIDENCE, RESIDENCE_REGION]),
        (cfg.cn_entities and cfg.redact_orgs, [ORG]),
        (cfg.cn_entities and cfg.redact_address, [CHAIN, CHAIN_STREET, CHAIN_ROAD, STREET]),
        (cfg.cn_entities and cfg.redact_names, [NAME]),
        (cfg.cn_entities and cfg.redact_companies, [COMPANY]),
        (cfg.cn_entities, [ID18_LABEL]),
        (cfg.cn_entities and not cfg.strict_id18, [ID18_LOOSE]),
    ]
    return [rule for use, rules in on if use for rule in rules]
